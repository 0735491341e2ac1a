"""Cleaning: expressions, filters, data-quality rules, deduplication and the composed clean job."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scores as S, text as X
from plumbline.functions.geo import haversine_m, hex_cell
from plumbline.operators import impute, quality as Q
from plumbline.operators.lookup import restrict
from plumbline.operators.ordered import first_by
from plumbline.plans.clean import clean, drop_unplaced
from plumbline.queries.common import DATED, KNOWN, LAT0, LON0, POINTS, PROPERTY, known, points, properties, query, r6, table

HEX = """hexed AS (
  SELECT *, radians(longitude - CAST({lon0} AS DOUBLE)) * CAST({kx} AS DOUBLE) AS x,
    radians(latitude - CAST({lat0} AS DOUBLE)) * CAST(6371000 AS DOUBLE) AS y FROM {src}),
{name}_ax AS (SELECT *, (CAST({s3} AS DOUBLE) * x - y / CAST(3 AS DOUBLE)) / CAST({edge} AS DOUBLE) AS q,
    (CAST({t3} AS DOUBLE) * y) / CAST({edge} AS DOUBLE) AS r FROM hexed),
{name}_cu AS (SELECT *, -q - r AS s, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM {name}_ax),
{name}_df AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM {name}_cu),
{name} AS (SELECT *, (CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) + 1073741824) * 2147483648
   + CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) + 1073741824 AS cell FROM {name}_df)"""


def hex_sql(src: str, name: str, edge: float) -> str:
    import math

    return HEX.format(
        src=src, name=name, edge=edge, lat0=LAT0, lon0=LON0, kx=repr(6_371_000.0 * math.cos(math.radians(LAT0))),
        s3=repr(math.sqrt(3.0) / 3.0), t3=repr(2.0 / 3.0),
    )


@query("b1_rename", "SELECT c_custkey AS property_id, c_name AS address, c_nationkey AS ward FROM customer")
def b1(spark, sf):
    renamed = table(spark, sf, "customer").withColumnsRenamed({"c_custkey": "property_id", "c_name": "address", "c_nationkey": "ward"})
    return renamed.select("property_id", "address", "ward")


@query(
    "b2_normalise_address",
    r"SELECT p_partkey, lower(trim(regexp_replace(concat('  ', upper(p_name), '   ', p_type, ' '), '\s+', ' ', 'g'))) AS address FROM part",
)
def b2(spark, sf):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("   "), "p_type", F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", X.normalise_text(raw).alias("address"))


@query(
    "b3_stable_id",
    """SELECT c_custkey, concat('chi-', substr(sha256(concat(lower(trim(c_name)), '|',
       CASE WHEN c_custkey%3 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END)), 1, 12)) AS property_id FROM customer""",
)
def b3(spark, sf):
    pin = F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", X.stable_id(F.col("c_name"), pin).alias("property_id"))


@query(
    "b4_lossy_number",
    "SELECT event_id, TRY_CAST(CASE WHEN event_id%5 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number FROM events",
)
def b4(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return table(spark, sf, "events").select("event_id", X.to_number(raw).alias("number"))


@query(
    "b5_canonical_category",
    """SELECT c_custkey, CASE lower(trim(CASE c_mktsegment WHEN 'MACHINERY' THEN ' LEAD' WHEN 'BUILDING' THEN 'Galvanized Steel '
       WHEN 'FURNITURE' THEN 'not determined' WHEN 'AUTOMOBILE' THEN 'Copper' ELSE 'brass' END))
       WHEN 'lead' THEN 'Lead' WHEN 'copper' THEN 'Copper' WHEN 'galvanized steel' THEN 'Galvanized' WHEN 'not determined' THEN 'Unknown' END AS material
       FROM customer""",
)
def b5(spark, sf):
    s = F.col("c_mktsegment")
    raw = F.when(s == "MACHINERY", " LEAD").when(s == "BUILDING", "Galvanized Steel ").when(s == "FURNITURE", "not determined").when(s == "AUTOMOBILE", "Copper").otherwise("brass")
    return table(spark, sf, "customer").select("c_custkey", X.canonical(raw).alias("material"))


@query(
    "b6_label_source",
    f"""WITH {PROPERTY} SELECT property_id, CASE WHEN {KNOWN} AND lower(CASE WHEN property_id%4 = 0 THEN 'Inspected 2020' END) LIKE '%inspect%' THEN 'inspected'
        WHEN {KNOWN} THEN 'self_reported' ELSE 'unknown' END AS material_source FROM property""",
)
def b6(spark, sf):
    kind = F.when(F.col("property_id") % 4 == 0, "Inspected 2020")
    return properties(spark, sf).select("property_id", X.label_source(F.col("service_line_material"), kind).alias("material_source"))


@query(
    "b7_defaults",
    f"WITH {PROPERTY} SELECT property_id, coalesce(stories, 1.0::DOUBLE) AS stories, CAST(NULL AS VARCHAR) AS zip_code, FALSE AS has_garage FROM property",
)
def b7(spark, sf):
    rows = properties(spark, sf).select("property_id", "stories")
    return Q.with_columns(rows, {"stories": ("double", 1.0), "zip_code": ("string", None), "has_garage": ("boolean", False)})


@query(
    "b8_fips_key",
    "SELECT o_orderkey, concat('17031', CASE WHEN length(CAST(o_orderkey*97 AS VARCHAR)) >= 6 THEN CAST(o_orderkey*97 AS VARCHAR) ELSE lpad(CAST(o_orderkey*97 AS VARCHAR), 6, '0') END) AS census_tract FROM orders",
)
def b8(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.tract_key(F.col("o_orderkey") * 97).alias("census_tract"))


@query("b9_encode_target", f"WITH {PROPERTY} SELECT property_id, CASE WHEN service_line_material = 'Lead' THEN 1 ELSE 0 END AS y FROM property WHERE {KNOWN}")
def b9(spark, sf):
    return known(properties(spark, sf)).select("property_id", S.encode_target(F.col("service_line_material")).alias("y"))


@query("b10_selection_flag", f"WITH {PROPERTY} SELECT property_id, CASE WHEN {KNOWN} THEN 1 ELSE 0 END AS is_inspected FROM property")
def b10(spark, sf):
    return properties(spark, sf).select("property_id", S.is_known(F.col("service_line_material")).alias("is_inspected"))


@query(
    "b11_ambiguity",
    "SELECT event_id, round(1.0::DOUBLE - abs(2.0::DOUBLE*least(1.0::DOUBLE, greatest(0.0::DOUBLE, value/50.0::DOUBLE)) - 1.0::DOUBLE), 6) AS u FROM events",
)
def b11(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(S.ambiguity(F.col("value") / 50.0), "u"))


@query(
    "b12_set_size_uncertainty",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (l_linenumber - 1.0::DOUBLE)/4.0::DOUBLE)), 6) AS u FROM lineitem",
)
def b12(spark, sf):
    u = S.set_size_uncertainty(F.col("l_linenumber"), 5)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(u, "u"))


@query(
    "b13_haversine",
    f"""WITH {PROPERTY} SELECT property_id, round(CAST(12742000 AS DOUBLE)*asin(sqrt(least(1.0::DOUBLE,
      sin(radians(41.83::DOUBLE - latitude)/2)*sin(radians(41.83::DOUBLE - latitude)/2)
      + cos(radians(latitude))*cos(radians(41.83::DOUBLE))*sin(radians(-87.73::DOUBLE - longitude)/2)*sin(radians(-87.73::DOUBLE - longitude)/2)))), 4) AS metres FROM property""",
)
def b13(spark, sf):
    d = haversine_m(F.col("latitude"), F.col("longitude"), F.lit(LAT0), F.lit(LON0))
    return properties(spark, sf).select("property_id", F.round(d, 4).alias("metres"))


@query(
    "b14_hex_cells",
    f"WITH {PROPERTY}, {hex_sql('property', 'h', 531.414)} SELECT property_id, cell FROM h",
)
def b14(spark, sf):
    return properties(spark, sf).select("property_id", hex_cell(F.col("latitude"), F.col("longitude"), 531.414, LAT0, LON0).alias("cell"))


@query(
    "b15_nonconformity",
    f"WITH {PROPERTY} SELECT property_id, round(1 - CASE WHEN service_line_material = 'Lead' THEN p_lead ELSE 1 - p_lead END, 6) AS score FROM property WHERE {KNOWN}",
)
def b15(spark, sf):
    y = S.is_positive(F.col("service_line_material"))
    return known(properties(spark, sf)).select("property_id", r6(S.nonconformity(y, F.col("p_lead")), "score"))


@query("b16_year_heuristic", f"WITH {PROPERTY} SELECT property_id, CASE WHEN year_built < 1950 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p FROM property")
def b16(spark, sf):
    return properties(spark, sf).select("property_id", S.cutoff_heuristic(F.col("year_built")).alias("p"))


@query("b17_decision", f"WITH {PROPERTY} SELECT property_id, p_lead >= 0.5 AS flagged FROM property")
def b17(spark, sf):
    return properties(spark, sf).select("property_id", S.decide(F.col("p_lead")).alias("flagged"))


@query(
    "b18_clip",
    f"WITH {PROPERTY} SELECT property_id, CASE WHEN building_sqft IS NOT NULL THEN greatest(1000.0::DOUBLE, least(3000.0::DOUBLE, building_sqft)) END AS clipped FROM property",
)
def b18(spark, sf):
    return properties(spark, sf).select("property_id", S.clip(F.col("building_sqft"), 1000.0, 3000.0).alias("clipped"))


@query("b19_round4", "SELECT c_custkey, round_even(c_acctbal/7.0::DOUBLE, 4) AS share FROM customer")
def b19(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.round4(F.col("c_acctbal") / 7.0).alias("share"))


@query(
    "b20_event_record_id",
    "SELECT event_id, concat('insp-', substr(sha256(concat(CAST(user_id AS VARCHAR), CAST(epoch_us(ts) AS VARCHAR))), 1, 12)) AS inspection_id FROM events",
)
def b20(spark, sf):
    return table(spark, sf, "events").select("event_id", X.event_id(F.col("user_id"), F.col("ts")).alias("inspection_id"))


@query(
    "b21_whole_days",
    f"""WITH {DATED} SELECT property_id, CAST(CASE WHEN inspected_at IS NULL THEN 3650 ELSE greatest(floor((epoch_us(TIMESTAMP '2000-01-01 12:00:00') - epoch_us(inspected_at))/86400000000.0::DOUBLE), 0) END AS DOUBLE) AS days FROM dated""",
)
def b21(spark, sf):
    as_of = F.lit("2000-01-01 12:00:00").cast("timestamp_ntz")
    return properties(spark, sf, dated=True).select("property_id", S.whole_days_between(F.col("inspected_at"), as_of).alias("days"))


@query(
    "b22_feature_contract",
    f"WITH {PROPERTY} SELECT property_id, CAST(year_built AS DOUBLE) AS year_built, lot_size_sqft, CAST(has_basement AS DOUBLE) AS has_basement FROM property",
)
def b22(spark, sf):
    return Q.feature_contract(properties(spark, sf), ["year_built", "lot_size_sqft", "has_basement"], ["property_id"])


@query("c1_known_labels", f"WITH {PROPERTY} SELECT property_id, service_line_material FROM property WHERE {KNOWN}")
def c1(spark, sf):
    return known(properties(spark, sf)).select("property_id", "service_line_material")


@query("c2_non_null_labels", f"WITH {PROPERTY} SELECT ward, count(*) AS n FROM property WHERE service_line_material IS NOT NULL GROUP BY ward")
def c2(spark, sf):
    return properties(spark, sf).where(F.col("service_line_material").isNotNull()).groupBy("ward").agg(F.count("*").alias("n"))


@query("c3_drop_unplaced", f"WITH {PROPERTY} SELECT property_id, latitude, longitude FROM (SELECT property_id, latitude, CASE WHEN property_id%6 <> 0 THEN longitude END AS longitude FROM property) WHERE longitude IS NOT NULL")
def c3(spark, sf):
    rows = properties(spark, sf).withColumn("longitude", F.when(F.col("property_id") % 6 != 0, F.col("longitude")))
    return drop_unplaced(rows).select("property_id", "latitude", "longitude")


@query("c4_drop_suppressed", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def c4(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal")


@query("c5_half_open_dates", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def c5(spark, sf):
    at = F.col("o_orderdate")
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1997-01-01", "1998-01-01"))
    return table(spark, sf, "orders").where((at >= start) & (at < end)).select("o_orderkey", "o_custkey")


@query("c6_outside_groups", f"WITH {PROPERTY} SELECT property_id, ward FROM (SELECT property_id, CASE WHEN property_id%10 <> 0 THEN ward END AS ward FROM property) WHERE ward IS NULL OR ward NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def c6(spark, sf):
    rows = properties(spark, sf).select("property_id", F.when(F.col("property_id") % 10 != 0, F.col("ward")).alias("ward"))
    listed = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("ward"))
    return rows.join(listed, "ward", "left_anti").select("property_id", "ward")


@query("c7_positive_references", f"WITH {PROPERTY} SELECT property_id, latitude, longitude FROM property WHERE service_line_material = 'Lead'")
def c7(spark, sf):
    return properties(spark, sf).where("service_line_material = 'Lead'").select("property_id", "latitude", "longitude")


@query(
    "d1_coerce",
    """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey%6 = 0 THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END AS INTEGER) AS ward,
       CASE WHEN o_orderkey%6 = 0 THEN 'ward' ELSE '' END AS failed FROM orders""",
)
def d1(spark, sf):
    raw = F.when(F.col("o_orderkey") % 6 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderkey").cast("string"))
    schema = Q.Schema((Q.Field("ward", "int"),))
    out = Q.coerce(table(spark, sf, "orders").select("o_orderkey", raw.alias("ward")), schema)
    return out.select("o_orderkey", "ward", F.array_join("_uncast", ",").alias("failed"))


@query(
    "d2_rules",
    """SELECT * FROM (SELECT 'not_null' AS rule, 'stories' AS "column", count(*) FILTER (c_custkey%11 = 0) AS n_bad FROM customer
       UNION ALL SELECT 'in_range', 'c_acctbal', count(*) FILTER (c_acctbal NOT BETWEEN 0 AND 9000) FROM customer
       UNION ALL SELECT 'allowed_values', 'c_mktsegment', count(*) FILTER (c_mktsegment NOT IN ('BUILDING','MACHINERY')) FROM customer
       UNION ALL SELECT 'min_length', 'c_name', count(*) FILTER (length(c_name) < 5) FROM customer)""",
)
def d2(spark, sf):
    rows = table(spark, sf, "customer").withColumn("stories", F.when(F.col("c_custkey") % 11 != 0, 1))
    fields = (
        Q.Field("stories", "int", nullable=False), Q.Field("c_acctbal", "double", low=0, high=9000),
        Q.Field("c_mktsegment", "string", allowed=("BUILDING", "MACHINERY")), Q.Field("c_name", "string", min_length=5),
    )
    return Q.rule_report(rows, [r for f in fields for r in f.rules()])


@query("d3_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def d3(spark, sf):
    return Q.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "d5_violation_report",
    f"""WITH {PROPERTY}, bad AS (SELECT property_id, CASE WHEN property_id%8 = 0 THEN 200.0 ELSE latitude END AS latitude, CASE WHEN property_id%5 <> 0 THEN ward END AS ward FROM property
       UNION ALL SELECT property_id, latitude, ward FROM property WHERE ward = 3)
       SELECT 'in_range' AS rule, 'latitude' AS "column", count(*) AS n_bad, min(CAST(property_id AS VARCHAR)) AS sample FROM bad WHERE latitude > 90
       UNION ALL SELECT 'not_null', 'ward', count(*), min(CAST(property_id AS VARCHAR)) FROM bad WHERE ward IS NULL
       UNION ALL SELECT 'unique', 'property_id', count(*), min(CAST(property_id AS VARCHAR)) FROM (SELECT property_id FROM bad GROUP BY property_id HAVING count(*) > 1)""",
)
def d5(spark, sf):
    k, rows = F.col("property_id"), properties(spark, sf)
    bad = rows.select("property_id", F.when(k % 8 == 0, 200.0).otherwise(F.col("latitude")).alias("latitude"), F.when(k % 5 != 0, F.col("ward")).alias("ward"))
    bad = bad.unionByName(rows.where("ward = 3").select("property_id", "latitude", "ward"))
    schema = Q.Schema((Q.Field("property_id", "bigint", False), Q.Field("latitude", "double", low=-90, high=90), Q.Field("ward", "int", False)), unique=("property_id",))
    return Q.violations(Q.coerce(bad, schema), schema)


@query("g1_dedup_first", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1")
def g1(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    order = [-F.col("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")]
    return first_by(rows, ["l_orderkey"], order).drop("l_quantity")


@query("f3_last_time", "SELECT o_custkey, CAST(epoch_us(max(o_orderdate)) AS BIGINT) AS last_us FROM orders GROUP BY o_custkey")
def f3(spark, sf):
    last = F.unix_micros(F.max("o_orderdate").cast("timestamp")).alias("last_us")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(last)


@query("f5_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def f5(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


IMPUTED = f"""fills AS (SELECT median(year_built) AS y, median(lot_size_sqft) AS l, median(building_sqft) AS b,
  (SELECT stories FROM property WHERE stories IS NOT NULL GROUP BY stories ORDER BY count(*) DESC, stories LIMIT 1) AS s FROM property),
 imputed AS (SELECT p.* REPLACE (coalesce(CAST(year_built AS DOUBLE), y) AS year_built, coalesce(lot_size_sqft, l) AS lot_size_sqft,
   coalesce(building_sqft, b) AS building_sqft, coalesce(stories, s) AS stories, coalesce(has_basement, FALSE) AS has_basement) FROM property p CROSS JOIN fills)"""


@query("f6_impute", f"WITH {PROPERTY}, {IMPUTED} SELECT property_id, year_built, lot_size_sqft, building_sqft, stories, has_basement FROM imputed")
def f6(spark, sf):
    rows = properties(spark, sf)
    return impute.apply(rows, impute.fit(rows)).select("property_id", "year_built", "lot_size_sqft", "building_sqft", "stories", "has_basement")


@query(
    "f12_profile",
    f"""WITH {PROPERTY} SELECT count(*) AS n_rows, count(service_line_material) AS n_labelled, count(*) FILTER (service_line_material = 'Lead') AS n_lead,
       count(*) FILTER (service_line_material = 'Copper') AS n_copper, count(*) FILTER (service_line_material = 'Galvanized') AS n_galvanized,
       round(count(*) FILTER (year_built IS NULL)/count(*), 6) AS missing_year_built, round(count(*) FILTER (building_sqft IS NULL)/count(*), 6) AS missing_building_sqft FROM property""",
)
def f12(spark, sf):
    out = Q.profile(properties(spark, sf), "service_line_material", ["year_built", "building_sqft"])
    return out.withColumns({c: F.round(c, 6) for c in ("missing_year_built", "missing_building_sqft")})


@query("f13_distinct_values", "SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def f13(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))


@query(
    "h6_union",
    "SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier",
)
def h6(spark, sf):
    from plumbline.sources.files import union_all

    a = table(spark, sf, "customer").selectExpr("c_custkey id", "c_acctbal balance", "c_mktsegment segment")
    return union_all([a, table(spark, sf, "supplier").selectExpr("s_suppkey id", "s_acctbal balance")])


@query("h8_stray_labels", "SELECT DISTINCT c_mktsegment AS label FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING')")
def h8(spark, sf):
    labels = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("label")).distinct()
    usable = spark.createDataFrame([("MACHINERY",), ("BUILDING",)], "label string")
    return labels.join(usable, "label", "left_anti")


CLEAN = """raw AS (SELECT concat('  ', upper(c_name), '  ') AS address, CAST(c_custkey%7 AS VARCHAR) AS pin, CASE WHEN c_custkey%6 <> 0 THEN CAST(c_custkey%90 AS DOUBLE) END AS latitude,
  CAST(-(c_custkey%180) AS DOUBLE) AS longitude, c_nationkey AS ward, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Lead' WHEN 'BUILDING' THEN 'Copper' END AS material,
  CASE WHEN c_custkey%4 = 0 THEN 'Inspection' ELSE 'RES' END AS kind FROM customer)"""


@query(
    "k0_clean_job",
    f"""WITH {CLEAN}, tax AS (SELECT lower(trim(concat(' Customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0')))) AS addr, CAST(min(o_orderkey) AS VARCHAR) AS pin2, CAST(1900 + min(o_orderkey)%100 AS DOUBLE) AS year_built FROM orders GROUP BY o_custkey)
      SELECT concat('chi-', substr(sha256(concat(lower(trim(address)), '|', coalesce(pin2, ''))), 1, 12)) AS property_id, ward, latitude, longitude, year_built, material AS service_line_material,
        CASE WHEN material IS NULL THEN 'unknown' WHEN kind = 'Inspection' THEN 'inspected' ELSE 'self_reported' END AS material_source
      FROM raw LEFT JOIN tax ON tax.addr = lower(trim(address)) WHERE latitude IS NOT NULL""",
)
def k0(spark, sf):
    k = F.col("c_custkey")
    inventory = table(spark, sf, "customer").select(
        F.concat(F.lit("  "), F.upper("c_name"), F.lit("  ")).alias("address"), F.lit("60601").alias("zip_code"), F.col("c_nationkey").alias("ward"),
        F.when(k % 6 != 0, (k % 90).cast("double")).alias("latitude"), (-(k % 180)).cast("double").alias("longitude"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Lead").when(F.col("c_mktsegment") == "BUILDING", "Copper").alias("service_line_material"),
        F.when(k % 4 == 0, "Inspection").otherwise("RES").alias("property_type"),
    )
    # every row twice: the deduplication has to take the copies out again
    inventory = inventory.unionByName(inventory)
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"))
    assessor = first.select(
        F.concat(F.lit(" Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("address"), F.col("k").cast("string").alias("pin"), (1900 + F.col("k") % 100).cast("double").alias("year_built")
    )
    out = clean(inventory, assessor)
    return out.select("property_id", "ward", "latitude", "longitude", "year_built", "service_line_material", "material_source")
