"""License scans: exact phrases, and fuzzy search for short notices.

A notice that occurs with at most k edits contains one of its k + 1 pieces unchanged (pigeonhole). One Aho-Corasick
pass over a text finds all pieces of all notices; around each hit, a window as wide as the notice and its edits goes
to the regex library, whose bounded-error matching verifies the notice and reports span and edits.

Texts are compared as words: A-Z in lower case, words are runs of letters, digits and all characters above ASCII.
"""

from __future__ import annotations

import ahocorasick
import regex
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.batches import map_rows
from plumbline.llm.tables import text_or_empty

# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# The library's own notices: words, label.
NOTICES = (
    ("all rights reserved", "reserved"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("permission is hereby granted free of charge to any person", "mit"),
    ("licensed under the mit license", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"),
    ("dedicated to the public domain", "public-domain"),
)
LETTERS_PER_EDIT = 9
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
SPANS = "array<struct<label string, first_word long, last_word long, edits int, base boolean>>"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of `edits` + 1 pieces of nearly equal length."""
    cut = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:])]


class NoticeFinder:
    """All places of base phrases, and the best fuzzy match of each notice wherever a piece of it occurs."""

    def __init__(self, notices=NOTICES, base=BASE, letters_per_edit: int = LETTERS_PER_EDIT) -> None:
        self.base = [(f" {phrase} ".encode(), label, len(phrase.split())) for phrase, label in base]
        self.notices, seeds = [], {}
        for n, (notice, label) in enumerate(notices):
            k = len(notice) // letters_per_edit
            pattern = regex.compile(rf"(?e)\b(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}\b")
            self.notices.append((notice, label, k, pattern))
            for at, piece in pieces(notice, k):
                seeds.setdefault(piece, []).append((n, at))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def __call__(self, text: str) -> tuple[int, list[tuple[str, int, int, int, bool]]]:
        """(number of words, spans as (label, first word, last word, edits, base))."""
        found = words(text)
        joined = b" " + b" ".join(found) + b" "
        spans = []
        for phrase, label, n in self.base:
            at, word, counted = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", counted, at)
                counted = at
                spans.append((label, word, word + n - 1, 0, True))
                at = joined.find(phrase, at + 1)
        return len(found), spans + self._fuzzy(joined.decode("utf-8", "replace"))

    def _fuzzy(self, line: str) -> list[tuple[str, int, int, int, bool]]:
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.seeds.iter(line):
            for n, at in where:
                notice, _, k, _ = self.notices[n]
                start = end + 1 - length - at
                window = [max(0, start - k - 1), start + len(notice) + k + 1]
                mine = windows.setdefault(n, [])
                if mine and window[0] <= mine[-1][1]:  # hits come in order of their end, so windows nearly do
                    mine[-1] = [min(mine[-1][0], window[0]), max(mine[-1][1], window[1])]
                else:
                    mine.append(window)
        spans = set()
        for n, mine in windows.items():
            _, label, _, pattern = self.notices[n]
            for a, b in mine:
                for m in pattern.finditer(line[a:b]):
                    s, e = a + m.start(), a + m.end()
                    s += len(line[s:e]) - len(line[s:e].lstrip(" "))
                    first = line.count(" ", 0, s) - 1
                    spans.add((label, first, first + line[s:e].strip(" ").count(" "), sum(m.fuzzy_counts), False))
        return sorted(spans)


def scan(docs: DataFrame, text: str = "text", notices=NOTICES, letters_per_edit: int = LETTERS_PER_EDIT) -> DataFrame:
    """`docs` without `text`, plus n_words and spans (label, first and last word, edits, whether a base phrase).

    A null or empty text has no words and no spans. Rows are independent, so repeated rows give repeated results, and
    an empty table an empty one. A notice of n letters may have n / `letters_per_edit` edits. Columns of `docs` called
    n_words or spans are replaced.
    """
    keep = [c for c in docs.columns if c != text and c.lower() not in ("n_words", "spans")]

    def make():
        find = NoticeFinder(notices, letters_per_edit=letters_per_edit)

        def one(*row):
            n, spans = find(row[-1])
            named = [{"label": a, "first_word": b, "last_word": c, "edits": d, "base": e} for a, b, c, d, e in spans]
            yield (*row[:-1], n, named)

        return one

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text).alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return map_rows(rows, make, ", ".join([*fields, "n_words long", f"spans {SPANS}"]))
