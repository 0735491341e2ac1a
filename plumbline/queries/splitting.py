"""Splits as one column, their metadata and their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import splits as P
from plumbline.operators.ordered import global_rank, hash_rank, top_k
from plumbline.operators.metrics import class_balance
from plumbline.queries.common import DATED, KNOWN, PROPERTY, known, mixed, mixed_sql, properties, query, table
from plumbline.queries.common import ORDER_SCORES, order_scores

CUTOFF = "2000-06-01"


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def labelled(spark, sf, dated=False):
    return known(properties(spark, sf, dated)).select("property_id", "ward", "service_line_material", *(["inspected_at"] if dated else []))


ROWS = f"WITH {DATED}, lab AS (SELECT * FROM dated WHERE {KNOWN})"

HELD = f"""g AS (SELECT DISTINCT ward FROM lab), gr AS (SELECT ward, row_number() OVER (ORDER BY {mixed_sql('ward')}, ward) AS rk FROM g),
  sz AS (SELECT greatest(1, floor(count(*)*0.25)) AS held FROM g),
  held AS (SELECT ward, CASE WHEN rk <= greatest(1, floor(held/2)) THEN 'calibration' ELSE 'test' END AS part FROM gr CROSS JOIN sz WHERE rk <= held)"""


@query(
    "i1_random_split",
    f"""{ROWS}, r AS (SELECT property_id, service_line_material = 'Lead' AS s, row_number() OVER (PARTITION BY service_line_material = 'Lead' ORDER BY {mixed_sql('property_id')}, property_id) AS rk,
      count(*) OVER (PARTITION BY service_line_material = 'Lead') AS n FROM lab)
      SELECT property_id, CASE WHEN rk <= round(n*0.15::DOUBLE) THEN 'test' WHEN rk <= round(n*0.15::DOUBLE) + round(n*0.15::DOUBLE) THEN 'calibration' ELSE 'train' END AS split FROM r""",
)
def i1(spark, sf):
    rows = labelled(spark, sf)
    return P.random_split(rows, "property_id", F.col("service_line_material") == "Lead", key=mixed(F.col("property_id"))).select("property_id", "split")


@query("i2_geographic_split", f"{ROWS}, {HELD} SELECT property_id, coalesce(part, 'train') AS split FROM lab LEFT JOIN held USING (ward)")
def i2(spark, sf):
    rows = labelled(spark, sf)
    parts = P.holdout_groups(rows, "ward", key=mixed(F.col("ward")))
    return P.by_groups(rows, "ward", parts).select("property_id", "split")


@query("i2_geographic_split_listed", f"{ROWS} SELECT property_id, CASE WHEN ward IN (19, 3) THEN 'calibration' WHEN ward IN (4, 11) THEN 'test' ELSE 'train' END AS split FROM lab")
def i2_listed(spark, sf):
    rows = labelled(spark, sf)
    return P.by_groups(rows, "ward", P.listed_groups(rows, "ward", [19, 3, 4, 11])).select("property_id", "split")


@query(
    "i3_greedy_group_split",
    f"""{ROWS}, c AS (SELECT ward, count(*) AS n FROM lab GROUP BY ward),
      b AS (SELECT ward, n, coalesce(sum(n) OVER (ORDER BY n DESC, ward ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM c),
      t AS (SELECT sum(n) AS nt FROM b WHERE before < total*0.15::DOUBLE),
      parts AS (SELECT ward, CASE WHEN before < total*0.15::DOUBLE THEN 'test' WHEN before - nt < total*0.15::DOUBLE THEN 'calibration' ELSE 'train' END AS part FROM b CROSS JOIN t)
      SELECT property_id, part AS split FROM lab JOIN parts USING (ward)""",
)
def i3(spark, sf):
    rows = labelled(spark, sf)
    return P.by_groups(rows, "ward", P.greedy_groups(rows, "ward")).select("property_id", "split")


@query(
    "i4_temporal_split_bounds",
    f"""{ROWS} SELECT property_id, CASE WHEN inspected_at < TIMESTAMP '2000-06-01' THEN 'train' WHEN inspected_at < TIMESTAMP '2001-01-01' THEN 'calibration'
      WHEN inspected_at < TIMESTAMP '2001-06-01' THEN 'test' END AS split FROM lab""",
)
def i4(spark, sf):
    rows = labelled(spark, sf, True)
    return P.temporal_split(rows, "inspected_at", ntz(CUTOFF), "property_id", ntz("2001-01-01"), ntz("2001-06-01")).select("property_id", "split")


@query(
    "g4_temporal_split_halves",
    f"""{ROWS}, f AS (SELECT property_id, row_number() OVER (ORDER BY inspected_at, property_id) AS rk, count(*) OVER () AS n FROM lab WHERE inspected_at >= TIMESTAMP '2000-06-01')
      SELECT property_id, CASE WHEN rk <= floor(n/2) THEN 'calibration' ELSE 'test' END AS split FROM f
      UNION ALL SELECT property_id, 'train' FROM lab WHERE inspected_at < TIMESTAMP '2000-06-01'""",
)
def g4(spark, sf):
    return P.temporal_split(labelled(spark, sf, True), "inspected_at", ntz(CUTOFF), "property_id").select("property_id", "split")


@query(
    "i5_spatial_temporal_split",
    f"""{ROWS}, {HELD} SELECT property_id, CASE WHEN part IS NULL AND inspected_at < TIMESTAMP '2000-06-01' THEN 'train' WHEN inspected_at >= TIMESTAMP '2000-06-01' THEN part END AS split
      FROM lab LEFT JOIN held USING (ward)""",
)
def i5(spark, sf):
    rows = labelled(spark, sf, True)
    parts = P.holdout_groups(rows, "ward", key=mixed(F.col("ward")))
    return P.spatial_temporal_split(rows, "ward", "inspected_at", ntz(CUTOFF), parts).select("property_id", "split")


@query(
    "i6_split_metadata",
    f"""{ROWS}, {HELD}, s AS (SELECT *, coalesce(part, 'train') AS split FROM lab LEFT JOIN held USING (ward))
      SELECT 'geographic' AS split_mode, count(*) AS total_labeled_rows, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'calibration') AS calibration_rows,
        count(*) FILTER (split = 'test') AS test_rows, count(DISTINCT ward) FILTER (split = 'calibration') AS calibration_groups,
        count(DISTINCT ward) FILTER (split = 'test') AS test_groups,
        CAST(epoch_us(max(inspected_at) FILTER (split = 'train')) AS BIGINT) AS train_max_us, CASE WHEN count(*) FILTER (split = 'test') < 100 THEN 'INSUFFICIENT_SAMPLE' ELSE 'OK' END AS status FROM s""",
)
def i6(spark, sf):
    rows = labelled(spark, sf, True)
    parted = P.by_groups(rows, "ward", P.holdout_groups(rows, "ward", key=mixed(F.col("ward"))))
    meta = P.split_metadata(parted, "geographic", "inspected_at", "ward", 100)
    return meta.select(
        "split_mode", "total_labeled_rows", "train_rows", "calibration_rows", "test_rows", "calibration_groups", "test_groups",
        F.unix_micros(F.col("train_max_at").cast("timestamp")).alias("train_max_us"), "status",
    )


@query("i6_split_groups", f"{ROWS}, {HELD} SELECT DISTINCT coalesce(part, 'train') AS split, ward FROM lab LEFT JOIN held USING (ward)")
def i6_groups(spark, sf):
    rows = labelled(spark, sf)
    return P.split_groups(P.by_groups(rows, "ward", P.holdout_groups(rows, "ward", key=mixed(F.col("ward")))), "ward")


@query(
    "i7_inner_validation",
    f"""{ROWS}, g AS (SELECT DISTINCT ward FROM lab), gr AS (SELECT ward, row_number() OVER (ORDER BY {mixed_sql('ward', 7)}, ward) AS rk, greatest(1, floor(count(*) OVER () / 10)) AS m FROM g)
      SELECT property_id, rk <= m AS is_validation FROM lab JOIN gr USING (ward)""",
)
def i7(spark, sf):
    return P.inner_validation(labelled(spark, sf), "property_id", "geographic", key=mixed(F.col("ward"), 7)).select("property_id", "is_validation")


@query(
    "d6_split_invariants",
    f"""{ROWS}, {HELD}, s AS (SELECT *, CASE WHEN part IS NULL AND inspected_at < TIMESTAMP '2000-06-01' THEN 'train' WHEN inspected_at >= TIMESTAMP '2000-06-01' THEN part END AS split FROM lab LEFT JOIN held USING (ward))
      SELECT 'ids_in_one_split' AS invariant, count(*) AS n_bad FROM (SELECT property_id FROM s GROUP BY property_id HAVING count(DISTINCT split) > 1)
      UNION ALL SELECT 'train_before_cutoff', count(*) FROM s WHERE split = 'train' AND inspected_at >= TIMESTAMP '2000-06-01'
      UNION ALL SELECT 'holdout_after_cutoff', count(*) FROM s WHERE split IN ('calibration','test') AND inspected_at < TIMESTAMP '2000-06-01'
      UNION ALL SELECT 'groups_not_shared', count(*) FROM (SELECT ward FROM s GROUP BY ward HAVING bool_or(split = 'train') AND bool_or(split = 'test'))""",
)
def d6(spark, sf):
    rows = labelled(spark, sf, True)
    parted = P.spatial_temporal_split(rows, "ward", "inspected_at", ntz(CUTOFF), P.holdout_groups(rows, "ward", key=mixed(F.col("ward"))))
    return P.split_invariants(parted, "property_id", "inspected_at", ntz(CUTOFF), "ward")


@query(
    "d8_sample_status",
    "SELECT c_nationkey AS ward, count(*) AS n, CASE WHEN count(*) < 60 THEN 'INSUFFICIENT_SAMPLE' ELSE 'OK' END AS status FROM customer GROUP BY c_nationkey",
)
def d8(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("ward"), F.lit("test").alias("split"))
    out = P.split_metadata(rows, "geographic", min_test_rows=60, by=("ward",))
    return out.select("ward", F.col("total_labeled_rows").alias("n"), "status")


@query("g2_global_rank", f"WITH {ORDER_SCORES} SELECT id, row_number() OVER (ORDER BY p DESC, id) AS rank FROM scores")
def g2(spark, sf):
    return global_rank(order_scores(spark, sf), [F.desc("p"), F.asc("id")]).select("id", "rank")


@query("h1_global_sort_positions", "SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_quantity) AS position FROM lineitem")
def h1(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_quantity")]
    return global_rank(rows, order, "position").select("l_orderkey", "l_partkey", "l_suppkey", "position")


@query("h2_top_k", f"WITH {ORDER_SCORES}, r AS (SELECT id, p, row_number() OVER (ORDER BY p DESC, id) AS rank FROM scores) SELECT id, p, rank FROM r WHERE rank <= 500")
def h2(spark, sf):
    return top_k(order_scores(spark, sf).select("id", "p"), [F.desc("p"), F.asc("id")], 500)


@query("h3_oracle_top_k", f"WITH {ORDER_SCORES}, r AS (SELECT id, row_number() OVER (ORDER BY {mixed_sql('id', 5)}, id) AS rank FROM scores WHERE y = 1) SELECT id, rank FROM r WHERE rank <= 200")
def h3(spark, sf):
    hits = order_scores(spark, sf).where("y = 1").withColumn("_k", mixed(F.col("id"), 5))
    return top_k(hits, [F.asc("_k"), F.asc("id")], 200).select("id", "rank")


ACQUIRED = f"""WITH {ORDER_SCORES}, r AS (SELECT id, y, row_number() OVER (ORDER BY {{order}}) AS nth FROM scores {{where}})
    SELECT id, CAST(y AS DOUBLE) AS _y FROM r WHERE nth <= 200"""


def acquired(spark, sf, strategy, y):
    from plumbline.models.pipelines import LABEL
    from plumbline.plans.backtest import acquire

    pool = order_scores(spark, sf).where(y).withColumns({LABEL: F.col("y").cast("double"), "priority_score": F.col("p")})
    return acquire(pool, "id", strategy, 200, 42, key=mixed(F.col("id"), 5)).select("id", F.col(LABEL).alias("_y"))


@query("h3_acquired_by_oracle", ACQUIRED.format(order=mixed_sql("id", 5) + ", id", where="WHERE y = 1"))
def h3_oracle(spark, sf):
    """The oracle's batch from the whole pool: positives only, as there are enough."""
    return acquired(spark, sf, "oracle", F.lit(True))


@query("h3_acquired_by_oracle_without_hits", ACQUIRED.format(order=mixed_sql("id", 5) + ", id", where="WHERE y = 0"))
def h3_none(spark, sf):
    """No positive is left in the pool: its first rows."""
    return acquired(spark, sf, "oracle", F.col("y") == 0)


@query("h3_acquired_by_priority", ACQUIRED.format(order="p DESC, id", where=""))
def h3_priority(spark, sf):
    return acquired(spark, sf, "risk_uncertainty_equity", F.lit(True))


@query("h5_seeded_fraction", f"WITH {ORDER_SCORES}, r AS (SELECT id, row_number() OVER (ORDER BY {mixed_sql('id', 3)}, id) AS rk, count(*) OVER () AS n FROM scores) SELECT id FROM r WHERE rk <= greatest(1, floor(n*0.10::DOUBLE))")
def h5(spark, sf):
    from plumbline.plans.backtest import initial_labels

    return initial_labels(order_scores(spark, sf), "id", 0.10, key=mixed(F.col("id"), 3))


@query("h7_disjoint_ids", "SELECT count(*) AS n_shared FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def h7(spark, sf):
    a = table(spark, sf, "customer").select("c_custkey")
    b = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return a.join(b, "c_custkey", "left_semi").distinct().agg(F.count("*").alias("n_shared"))


@query("h9_union_of_ids", "SELECT property_id FROM (SELECT user_id AS property_id FROM events UNION SELECT o_custkey FROM orders)")
def h9(spark, sf):
    a = table(spark, sf, "events").select(F.col("user_id").alias("property_id"))
    return a.union(table(spark, sf, "orders").select("o_custkey")).distinct()
