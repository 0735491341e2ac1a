"""Fill-in-the-middle rewriting of texts by one match with repeated captures.

A text is a row of units (lines, unless another unit is asked for). One `fullmatch` of the unit repeated, by the regex
library, keeps every repetition of its group: the number of the captures' ends is the number of units, and two of
these ends are the places where the text is cut. Nothing walks over the units one by one.

Which units are cut at, whether a text is rewritten at all and in which order comes from the sha256 of `seed:doc_id`
alone, so reruns and other partitions agree, and a text's form can be told without its text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.batches import map_rows
from plumbline.llm.tables import text_or_empty

LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE = 100
SUFFIX_FIRST = 50


def _choices(seed: int, key: int | None) -> tuple[int, int, int, int]:
    """Four numbers below 2^32; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def rewritten(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", unit: str = LINE, seed: int = SEED, rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """One row per row of `docs`: doc_id, n (units), form, prefix_chars, middle_chars, output.

    `form` is "plain" (output is the text) for an empty text, one that holds a mark, or one outside the `rate` percent;
    else "spm" for `suffix_first` percent and "psm" for the rest. Characters are code points, null where plain. `unit`
    must match every text when repeated; where it does not, the whole text is one unit.

    A null text is empty (no units, plain). Very long texts are matched whole in linear time. Repeated rows give
    repeated rows, other columns of `docs` are left out whatever their names, and an empty table gives an empty result.
    """
    p, s, m = marks

    def make():
        import regex

        units = regex.compile(f"({unit})*+").fullmatch

        def one(key, body):
            found = units(body)
            ends = found.ends(1) if found else [len(body)]
            n = len(ends)
            h1, h2, h3, h4 = _choices(seed, key)
            if not body or p in body or s in body or m in body or h3 % 100 >= rate:
                yield key, n, "plain", None, None, body
                return
            first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = (ends[k - 1] if k else 0 for k in (first, second))
            if h4 % 100 < suffix_first:
                form, output = "spm", f"{s}{body[b:]}{p}{body[:a]}{m}{body[a:b]}"
            else:
                form, output = "psm", f"{p}{body[:a]}{s}{body[b:]}{m}{body[a:b]}"
            yield key, n, form, a, b - a, output

        return one

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return map_rows(rows, make, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The exact text from a row's output and form. Each mark stands once in a rewritten text, so first places decide."""
    p, s, m = marks
    after = lambda mark: F.locate(mark, output) + len(mark)
    between = lambda a, b: F.substr(output, after(a), F.locate(b, output) - after(a))
    last = F.substr(output, after(m))
    psm = F.concat(between(p, s), last, between(s, m))
    spm = F.concat(between(p, m), last, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
