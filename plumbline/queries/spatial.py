"""Spatial joins, lookups, history and the feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import fixed_values as fv
from plumbline.functions.scores import clip, whole_days_between
from plumbline.operators import history, lookup, spatial
from plumbline.plans.features import add_cells, base_features, label_features, write_base_features
from plumbline.queries.cleaning import IMPUTED, hex_sql
from plumbline.queries.common import (
    DATED, HAVERSINE, KNOWN, LAT0, LOG, LON0, POINTS, PROPERTY, inspection_log, known, mixed, mixed_sql, points, properties, query, r6, scratch, table,
)
from plumbline.session import stage

def positive():
    return F.col("service_line_material") == "Lead"


def labelled():
    return F.col("service_line_material").isin(*fv.KNOWN_LABELS)



@query(
    "e1_left_join_address",
    """SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT *, lower(trim(concat('CUSTOMER#', lpad(CAST(o_custkey AS VARCHAR), 9, '0'), ' '))) AS addr FROM orders) o
       ON lower(trim(c.c_name)) = o.addr""",
)
def e1(spark, sf):
    from plumbline.plans.clean import join_assessor

    inventory = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("address"))
    orders = table(spark, sf, "orders")
    address = F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(" "))
    assessor = orders.select(address.alias("address"), F.col("o_orderkey").alias("pin"))
    return join_assessor(inventory, assessor).select("c_custkey", F.col("pin").alias("o_orderkey"))


@query(
    "e2_cell_rate",
    f"""WITH {PROPERTY}, {hex_sql('property', 'h', 531.414)}, rates AS (SELECT cell, avg(CASE WHEN service_line_material = 'Lead' THEN 1.0 ELSE 0.0 END) AS rate FROM h WHERE {KNOWN} AND ward < 18 GROUP BY cell),
      overall AS (SELECT avg(CASE WHEN service_line_material = 'Lead' THEN 1.0 ELSE 0.0 END) AS g FROM h WHERE {KNOWN} AND ward < 18)
      SELECT property_id, round(coalesce(rate, g), 6) AS rate FROM h LEFT JOIN rates USING (cell) CROSS JOIN overall""",
)
def e2(spark, sf):
    rows = add_cells(properties(spark, sf), LAT0, LON0)
    out = spatial.cell_rate(rows, rows.where("ward < 18"), "h3_index_res8", positive(), labelled(), "rate")
    return out.select("property_id", r6(F.col("rate"), "rate"))


def _nearest_sql(a: str, b: str) -> str:
    return f"SELECT a.property_id, round(min({HAVERSINE}), 3) AS metres FROM {a} a CROSS JOIN {b} b GROUP BY a.property_id"


@query("e3_nearest_hydrant", f"WITH {PROPERTY}, {POINTS} {_nearest_sql('property', 'points')}")
def e3(spark, sf):
    out = spatial.nearest_distance(properties(spark, sf).select("property_id", "latitude", "longitude"), points(spark, sf), "metres", 5000.0)
    return out.select("property_id", F.round("metres", 3).alias("metres"))


LEADS = "leads AS (SELECT * FROM property WHERE service_line_material = 'Lead')"


@query("e3_nearest_positive", f"WITH {PROPERTY}, {LEADS} {_nearest_sql('property', 'leads')}")
def e3_positive(spark, sf):
    rows = properties(spark, sf)
    out = spatial.nearest_distance(rows.select("property_id", "latitude", "longitude"), rows.where(positive()), "metres", 10000.0)
    return out.select("property_id", F.round("metres", 3).alias("metres"))


@query("e3_nearest_empty_reference", f"WITH {PROPERTY} SELECT property_id, CAST(10000 AS DOUBLE) AS metres FROM property")
def e3_empty(spark, sf):
    rows = properties(spark, sf).select("property_id", "latitude", "longitude", "service_line_material")
    none = rows.where("service_line_material = 'Plastic'")
    return spatial.nearest_distance(rows, none, "metres", 10000.0).select("property_id", "metres")


@query(
    "e4_knn_join",
    f"""WITH {PROPERTY}, pairs AS (SELECT a.property_id, b.point_id, {HAVERSINE} AS d FROM property a CROSS JOIN points b),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY d, point_id) AS nth FROM pairs)
      SELECT property_id, point_id, nth, round(d, 3) AS metres FROM ranked WHERE nth <= 5""".replace("WITH", f"WITH {POINTS},"),
)
def e4(spark, sf):
    rows = properties(spark, sf).select("property_id", "latitude", "longitude")
    found = spatial.knn_join(rows, points(spark, sf), 5, "point_id")
    out = found.select("property_id", F.posexplode("neighbours").alias("pos", "e"))
    return out.select("property_id", F.col("e.ref_id").alias("point_id"), (F.col("pos") + 1).cast("bigint").alias("nth"), F.round("e.dist", 3).alias("metres"))


DENSE = """spots AS (SELECT point_id, CASE WHEN point_id = 1 THEN -33.0::DOUBLE ELSE 41.8::DOUBLE + latitude / 1e5 END AS latitude,
    CASE WHEN point_id = 1 THEN 151.0::DOUBLE ELSE -87.7::DOUBLE + longitude / 1e5 END AS longitude FROM points)"""


@query("e3_dense_spot", f"WITH {PROPERTY}, {POINTS}, {DENSE}, near AS (SELECT property_id, 41.8::DOUBLE + latitude / 1e5 AS latitude, -87.7::DOUBLE + longitude / 1e5 AS longitude FROM property) {_nearest_sql('near', 'spots')}")
def e3_dense(spark, sf):
    """All within a metre or so but for one point on the far side of the world."""
    squeezed = lambda df: df.withColumns({"latitude": F.lit(41.8) + F.col("latitude") / F.lit(1e5), "longitude": F.lit(-87.7) + F.col("longitude") / F.lit(1e5)})
    rows = squeezed(properties(spark, sf).select("property_id", "latitude", "longitude"))
    far = F.col("point_id") == 1
    spots = squeezed(points(spark, sf)).withColumns({"latitude": F.when(far, -33.0).otherwise(F.col("latitude")), "longitude": F.when(far, 151.0).otherwise(F.col("longitude"))})
    out = spatial.nearest_distance(rows, spots, "metres", 5000.0)
    return out.select("property_id", F.round("metres", 3).alias("metres"))


def _knn_sql(src: str, extra: str = "", k: int = 10) -> str:
    return f"""pairs AS (SELECT a.property_id, b.property_id AS rid, CASE WHEN b.service_line_material = 'Lead' THEN 1.0 ELSE 0.0 END AS y, {HAVERSINE} AS d
      FROM {src} a CROSS JOIN (SELECT * FROM {src} WHERE {KNOWN}{extra}) b),
     nearest AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY d, rid) AS nth FROM pairs),
     knn AS (SELECT property_id, avg(y) AS knn10_lead_rate FROM nearest WHERE nth <= {k} GROUP BY property_id)"""


@query("e5_knn_rate", f"WITH {PROPERTY}, {_knn_sql('property')} SELECT property_id, round(knn10_lead_rate, 6) AS rate FROM knn")
def e5(spark, sf):
    rows = properties(spark, sf)
    out = spatial.knn_rate(rows.select("property_id", "latitude", "longitude"), rows.where(labelled()), 10, "property_id", positive(), "rate")
    return out.select("property_id", r6(F.col("rate"), "rate"))


@query(
    "e5_knn_rate_exclude_self",
    f"""WITH {PROPERTY}, pairs AS (SELECT a.property_id, b.property_id AS rid, CASE WHEN b.service_line_material = 'Lead' THEN 1.0 ELSE 0.0 END AS y, {HAVERSINE} AS d
      FROM property a JOIN (SELECT * FROM property WHERE {KNOWN}) b ON a.property_id <> b.property_id),
     nearest AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY d, rid) AS nth FROM pairs)
     SELECT property_id, round(avg(y), 6) AS rate FROM nearest WHERE nth <= 10 GROUP BY property_id""",
)
def e5_self(spark, sf):
    rows = properties(spark, sf)
    out = spatial.knn_rate(
        rows.select("property_id", "latitude", "longitude"), rows.where(labelled()), 10, "property_id", positive(), "rate", exclude_self="property_id"
    )
    return out.select("property_id", r6(F.col("rate"), "rate"))


@query(
    "e6_group_stats",
    "SELECT c_nationkey AS ward, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (c_mktsegment = 'MACHINERY') AS DOUBLE) AS hits, round(count(*) FILTER (c_mktsegment = 'MACHINERY')/count(*), 6) AS rate FROM customer GROUP BY c_nationkey",
)
def e6(spark, sf):
    names = {"count": "n", "positives": "hits", "rate": "rate", "last": "last"}
    rows = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "ward")
    out = history.group_stats(rows, "ward", F.col("c_mktsegment") == "MACHINERY", None, names)
    return out.select("ward", "n", "hits", r6(F.col("rate"), "rate"))


@query(
    "e7_group_default_join",
    "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) ON s_nationkey = c_nationkey",
)
def e7(spark, sf):
    stats = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n"))
    return lookup.with_default(table(spark, sf, "customer"), stats, ["c_nationkey"], {"n": 0}).select("c_custkey", "n")


@query(
    "e8_days_since_last",
    """SELECT c_custkey, CAST(CASE WHEN last IS NULL THEN 3650 ELSE greatest(floor((epoch_us(TIMESTAMP '1996-01-01') - epoch_us(last))/86400000000.0::DOUBLE), 0) END AS DOUBLE) AS days
       FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def e8(spark, sf):
    as_of = F.lit("1996-01-01").cast("timestamp_ntz")
    seen = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return history.days_since_last(table(spark, sf, "customer"), seen, "c_custkey", "o_orderdate", as_of, "days", 3650).select("c_custkey", "days")


@query(
    "e9_quartile_join",
    f"WITH {PROPERTY} SELECT property_id, coalesce(q, 2) AS income_quartile FROM property LEFT JOIN (SELECT concat('17031', lpad(CAST(n_nationkey AS VARCHAR), 6, '0')) AS census_tract, CAST(1 + n_nationkey%4 AS INTEGER) AS q FROM nation) USING (census_tract)",
)
def e9(spark, sf):
    from plumbline.operators.equity import with_quartile

    k = F.col("n_nationkey")
    ref = table(spark, sf, "nation").select(F.concat(F.lit("17031"), F.lpad(k.cast("string"), 6, "0")).alias("census_tract"), (1 + k % 4).cast("int").alias("income_quartile"))
    return with_quartile(properties(spark, sf), ref).select("property_id", "income_quartile")


@query("e10_pool_anti_join", f"WITH {PROPERTY} SELECT property_id FROM property WHERE {KNOWN} AND property_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def e10(spark, sf):
    visible = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("property_id"))
    return known(properties(spark, sf)).join(visible, "property_id", "left_anti").select("property_id")


@query("e11_semi_join_ids", f"WITH {PROPERTY} SELECT property_id, p_lead FROM property WHERE property_id IN (SELECT user_id FROM events)")
def e11(spark, sf):
    wanted = table(spark, sf, "events").select(F.col("user_id").alias("property_id"))
    return lookup.restrict(properties(spark, sf), wanted, "property_id").select("property_id", "p_lead")


@query("e11_missing_ids", "SELECT DISTINCT p_partkey AS c_custkey FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def e11_missing(spark, sf):
    wanted = table(spark, sf, "part").select(F.col("p_partkey").alias("c_custkey"))
    return lookup.missing_keys(wanted, table(spark, sf, "customer"), "c_custkey")


@query("e12_enrich_events", f"WITH {PROPERTY} SELECT event_id, census_tract FROM events LEFT JOIN property ON property_id = user_id + CASE WHEN event_id%9 = 0 THEN 100000000 ELSE 0 END")
def e12(spark, sf):
    key = F.col("user_id") + F.when(F.col("event_id") % 9 == 0, 100000000).otherwise(0)
    rows = table(spark, sf, "events").select("event_id", key.alias("property_id"))
    return lookup.enrich(rows, properties(spark, sf), "property_id", ["census_tract"]).select("event_id", "census_tract")


@query("e13_area_value", f"WITH {PROPERTY} SELECT property_id, coalesce(b, 0.0::DOUBLE) AS boost FROM property LEFT JOIN (SELECT concat('17031', lpad(CAST(n_nationkey AS VARCHAR), 6, '0')) AS census_tract, n_nationkey/100.0::DOUBLE AS b FROM nation) USING (census_tract)")
def e13(spark, sf):
    k = F.col("n_nationkey")
    values = table(spark, sf, "nation").select(F.concat(F.lit("17031"), F.lpad(k.cast("string"), 6, "0")).alias("census_tract"), (k / 100.0).alias("boost"))
    return lookup.with_default(properties(spark, sf), values, ["census_tract"], {"boost": 0.0}).select("property_id", "boost")


@query("f1_group_and_overall_rate", "SELECT p_brand, round(avg(CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0.0 END), 6) AS rate, round((SELECT avg(CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0.0 END) FROM part), 6) AS overall FROM part GROUP BY p_brand")
def f1(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", (F.col("p_type") == "ECONOMY").cast("double").alias("y"))
    overall = rows.agg(F.coalesce(F.avg("y"), F.lit(0.0))).scalar()
    return rows.groupBy("p_brand").agg(F.avg("y").alias("rate")).select("p_brand", r6(F.col("rate"), "rate"), r6(overall, "overall"))


@query("f2_safe_ratio", "SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS hits, round(count(*) FILTER (l_returnflag = 'R')/count(*), 6) AS rate FROM lineitem GROUP BY l_suppkey")
def f2(spark, sf):
    n, hits = F.count("*"), F.count_if(F.col("l_returnflag") == "R")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(n.alias("n"), hits.alias("hits"), r6(history.rate(hits, n), "rate"))


@query(
    "g6_as_of_history",
    """WITH e AS (SELECT o_orderkey, o_custkey%25 AS grp, epoch_us(o_orderdate) AS t, o_orderstatus = 'F' AS hit, o_orderstatus <> 'P' AS lab FROM orders)
       SELECT o_orderkey, coalesce(CAST(sum(CASE WHEN lab THEN 1 ELSE 0 END) OVER w AS BIGINT), 0) AS prior_count,
         coalesce(CAST(sum(CASE WHEN lab AND hit THEN 1 ELSE 0 END) OVER w AS BIGINT), 0) AS prior_positives, max(CASE WHEN lab THEN t END) OVER w AS prior_last_us
       FROM e WINDOW w AS (PARTITION BY grp ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def g6(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("grp"), "o_orderdate", "o_orderstatus")
    status = F.col("o_orderstatus")
    return history.as_of_history(rows, "grp", "o_orderdate", status == "F", status != "P").select("o_orderkey", "prior_count", "prior_positives", "prior_last_us")


@query("d7_visible_reference", f"WITH {DATED} SELECT property_id FROM dated WHERE inspected_at <= TIMESTAMP '2000-01-01'")
def d7(spark, sf):
    as_of = F.lit("2000-01-01").cast("timestamp_ntz")
    return history.visible(properties(spark, sf, dated=True), "inspected_at", as_of).select("property_id")


BASE_COLUMNS = ("property_id", "year_built", "stories", "coarse", "fine", "metres")
BASE_SQL = f"""WITH {PROPERTY}, {POINTS}, {IMPUTED}, {hex_sql('imputed', 'h', 531.414)},
  fine_ax AS (SELECT property_id, (CAST(0.5773502691896257 AS DOUBLE) * x - y / CAST(3 AS DOUBLE)) / CAST(200.786 AS DOUBLE) AS q, (CAST(0.6666666666666666 AS DOUBLE) * y) / CAST(200.786 AS DOUBLE) AS r FROM hexed),
  fine_cu AS (SELECT *, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM fine_ax),
  fine AS (SELECT property_id, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs + q + r) AS ds, rq, rr, rs FROM fine_cu),
  fc AS (SELECT property_id, (CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) + 1073741824) * 2147483648
   + CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) + 1073741824 AS fine FROM fine),
  near AS ({_nearest_sql('property', 'points')})
  SELECT property_id, year_built, stories, cell AS coarse, fine, metres FROM h JOIN fc USING (property_id) JOIN near USING (property_id)"""


def base(spark, sf, dated: bool = False):
    return base_features(properties(spark, sf, dated), points(spark, sf), LAT0, LON0)


@query("j1_base_features", BASE_SQL)
def j1(spark, sf):
    return base(spark, sf).select(
        "property_id", "year_built", "stories", F.col("h3_index_res8").alias("coarse"), F.col("h3_index_res9").alias("fine"),
        F.round("dist_to_nearest_hydrant_m", 3).alias("metres"),
    )


@query("j3_base_feature_table", f"WITH {PROPERTY}, {IMPUTED} SELECT ward, count(*) AS n, round(avg(year_built), 4) AS year_built FROM imputed GROUP BY ward")
def j3(spark, sf):
    path = scratch(spark)
    write_base_features(base(spark, sf), path)
    return spark.read.parquet(path).groupBy("ward").agg(F.count("*").alias("n"), F.round(F.avg("year_built"), 4).alias("year_built"))


TRAIN = f"{KNOWN} AND ward < 18"
J2_SQL = f"""WITH {DATED}, {hex_sql('dated', 'h', 531.414)},
  train AS (SELECT * FROM h WHERE {TRAIN}),
  leads AS (SELECT * FROM train WHERE service_line_material = 'Lead'),
  near AS ({_nearest_sql('h', 'leads')}),
  {_knn_sql('h', ' AND ward < 18')},
  rates AS (SELECT cell, avg(CASE WHEN service_line_material = 'Lead' THEN 1.0 ELSE 0.0 END) AS rate FROM train GROUP BY cell),
  overall AS (SELECT avg(CASE WHEN service_line_material = 'Lead' THEN 1.0 ELSE 0.0 END) AS g, max(inspected_at) AS now FROM train),
  wards AS (SELECT ward, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (service_line_material = 'Lead') AS DOUBLE) AS hits, max(inspected_at) AS last FROM train GROUP BY ward)
  SELECT property_id, metres, round(coalesce(rate, g), 6) AS cell_rate, round(knn10_lead_rate, 6) AS knn, coalesce(n, 0) AS ward_n, coalesce(hits, 0) AS ward_hits,
    round(coalesce(hits/n, 0), 6) AS ward_rate, CAST(CASE WHEN last IS NULL THEN 3650 ELSE greatest(floor((epoch_us(now) - epoch_us(last))/86400000000.0::DOUBLE), 0) END AS DOUBLE) AS days
  FROM h JOIN near USING (property_id) JOIN knn USING (property_id) LEFT JOIN rates USING (cell) LEFT JOIN wards USING (ward) CROSS JOIN overall"""


@query("j2_label_features", J2_SQL)
def j2(spark, sf):
    rows = stage(add_cells(properties(spark, sf, dated=True), LAT0, LON0))
    train = rows.where(labelled() & (F.col("ward") < 18))
    out = label_features(rows, train, "property_id")
    return out.select(
        "property_id", F.round("dist_to_nearest_known_lead_m", 3).alias("metres"), r6(F.col("neighbor_lead_rate_h3res8"), "cell_rate"),
        r6(F.col("knn10_lead_rate"), "knn"), F.col("inspection_count_in_ward").alias("ward_n"), F.col("known_lead_count_in_ward").alias("ward_hits"),
        r6(F.col("known_lead_rate_in_ward"), "ward_rate"), F.col("days_since_last_inspection_in_ward").alias("days"),
    )
