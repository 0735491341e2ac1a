"""One query per operator over its whole tables, and the pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import collocations, embedding_dedup, exact_dedup, fill_middle, jaccard_join, license_scan, lm_scoring, mixing, packing, pii_scan, quality, secret_scan, token_files
from plumbline.llm.registry import ORACLES, QUERIES, query
from plumbline.llm.tables import table
from plumbline.session import checkpoint_folder

__all__ = ["ORACLES", "QUERIES"]

WHITE = "[ \\x09-\\x0D]+"


@query(
    "op1_exact_dedup",
    f"""WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
      doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM h WINDOW g AS (PARTITION BY text_sha256)""",
)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.repeat_groups(table(spark, sf, "documents"))


@query("op5_source_mix")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf, "documents"))
    taken = F.size("shards").cast("long") * F.col("size")
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


@query("op2_pii_scan")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = pii_scan.scan(table(spark, sf, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii_scan.KINDS], F.sha2(pii_scan.digest(F.col("base")), 256).alias("base_sha256"),
        pii_scan.digest(F.concat("base", "discovered")).alias("spans"), F.size("discovered").cast("long").alias("n_discovered"),
    )


@query("op6_license_scan")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first_word"])
    # one edit in k allowed ones costs 1 / (k + 1); an exact notice or a base phrase scores 1
    likeness = F.transform("spans", lambda s: 1 / (1 + s["edits"].cast("double")))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"),
    )


@query("op10_secret_scan")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    ledger = f"{checkpoint_folder(spark)}/llm-ledger-{uuid.uuid4().hex}"
    found = secret_scan.scan(table(spark, sf, "documents").select("doc_id", "text"), ledger)
    base = tuple(r.name for r in secret_scan.BASE)
    every = tuple(r.name for r in secret_scan.RULES)
    f = F.col("findings")
    return found.select(
        "doc_id", *[secret_scan.count_of(f, k).alias(f"n_{k}") for k in base],
        F.sha2(secret_scan.digest(f, base), 256).alias("base_sha256"), secret_scan.digest(f, every).alias("spans"),
        F.lower(F.hex("blob")).alias("blob"),
    )


@query("op3_pattern_packing")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents").select("doc_id", "text"))


@query("op9_lm_scoring")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Target: documents labelled as good; background: all."""
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lm_scoring.score(docs, lm_scoring.fit(lm_scoring.marked(docs, good)))


@query("op4_quality_cotraining")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    out = quality.score(docs, quality.fit(docs, table(spark, sf, "labels").select("doc_id", "quality")))
    kept = F.col("score") >= quality.THRESHOLD
    return out.select("doc_id", "content_score", "page_score", "score", kept.alias("kept"))


@query("op8_graph_dedup")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_groups(table(spark, sf, "embeddings"))


@query("op7_jaccard_join")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf, "documents"))


@query(
    "op11_fill_middle",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h,
        regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u FROM documents),
      c AS (SELECT *, len(u) AS n, 
        [CAST('0x' || h[1:8] AS BIGINT), CAST('0x' || h[9:16] AS BIGINT), CAST('0x' || h[17:24] AS BIGINT), CAST('0x' || h[25:32] AS BIGINT)] AS k FROM d),
      f AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 100 THEN 'plain'
          WHEN k[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
      s AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM f)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM s""",
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    out = fill_middle.rewritten(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


@query(
    "op12_collocations",
    """WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
      w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS ws FROM p),
      i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
      g AS (SELECT lang, ks.k AS k, array_to_string(ws[i:i + ks.k - 1], ' ') AS phrase FROM i, (VALUES (1), (2), (3), (4)) ks(k) WHERE i + ks.k - 1 <= len(ws)),
      f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
      n AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
      c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
      x AS (SELECT c.lang, c.phrase, s.f AS s FROM c JOIN f s ON s.lang = c.lang AND s.k > c.k AND contains(' ' || s.phrase || ' ', ' ' || c.phrase || ' ')
        WHERE 100::HUGEINT * s.f >= 80::HUGEINT * c.a),
      d AS (SELECT * FROM c WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM x)),
      u AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS cut FROM d),
      t AS (SELECT u.*, l.f AS l, r.f AS r, (2000000::HUGEINT * u.a // (l.f::HUGEINT + r.f)) AS score FROM u
        JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.ws[1:cut], ' ')
        JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.ws[cut + 1:u.k], ' ')),
      b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
      o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
    SELECT o.lang, rank, phrase, a, l, r, n.n AS n, CAST(score AS BIGINT) AS score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000""",
)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.mine(table(spark, sf, "documents").select("text", "lang"))


@query("op13_token_files")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/llm-tokens-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").select("doc_id", "text")
    token_files.write(docs, folder)
    places = token_files.find(spark, folder, token_files.keys_of(docs))
    return token_files.read(spark, folder, places).drop("occurrence")
