"""Scans and sinks. Files are written from the given tables into a shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.queries.common import LOG, PROPERTY, inspection_log, properties, query, r6, scratch, table
from plumbline.sources import files, manifest
from plumbline.operators.ordered import global_rank


def _inventory_csv(spark, sf):
    k = F.col("c_custkey")
    spelled = F.when(k % 3 == 0, F.upper("c_mktsegment")).when(k % 3 == 1, F.concat(F.lit(" "), F.lower("c_mktsegment"))).otherwise(F.col("c_mktsegment"))
    material = (
        F.when(F.col("c_mktsegment") == "MACHINERY", F.when(k % 2 == 0, " LEAD ").otherwise("lead"))
        .when(F.col("c_mktsegment") == "BUILDING", "Galvanized Steel").when(F.col("c_mktsegment") == "FURNITURE", "not determined")
        .otherwise(spelled)
    )
    rows = table(spark, sf, "customer").select(
        F.col("c_name").alias(" Street Address "), F.lit("60601").alias("ZIP Code"),
        F.when(k % 11 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string")).alias("Ward"),
        material.alias("Service Line Material"),
        F.when(k % 17 == 0, "unreadable").otherwise((k % 90).cast("string")).alias("Latitude"),
        (-(k % 180)).cast("string").alias("Longitude"), k.cast("string").alias("Extra"),
    )
    path = scratch(spark)
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query(
    "a1_csv_scan",
    """SELECT c_name AS address, '60601' AS zip_code,
      CASE WHEN c_custkey%11 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS ward,
      CASE c_mktsegment WHEN 'MACHINERY' THEN 'Lead' WHEN 'BUILDING' THEN 'Galvanized' WHEN 'FURNITURE' THEN 'Unknown' END AS service_line_material,
      CASE WHEN c_custkey%17 <> 0 THEN CAST(c_custkey%90 AS DOUBLE) END AS latitude,
      CAST(-(c_custkey%180) AS DOUBLE) AS longitude, CAST(c_custkey AS VARCHAR) AS extra FROM customer""",
)
def a1(spark, sf):
    return files.read_inventory(spark, _inventory_csv(spark, sf)).withColumnRenamed("Extra", "extra")


def _assessor_csv(spark, sf):
    k = F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("PIN"),
        F.concat(F.lit("  CUSTOMER#"), F.lpad(k.cast("string"), 9, "0"), F.lit(" ")).alias("Address"),
        F.when(F.col("o_orderkey") % 13 == 0, "?").otherwise((1880 + F.col("o_orderkey") % 125).cast("string")).alias(" Year Built"),
        F.col("o_orderstatus").alias("Class"), F.floor("o_totalprice").cast("string").alias("Building Sq Ft"),
    )
    path = scratch(spark)
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query(
    "a2_assessor_scan",
    """SELECT CAST(o_orderkey AS VARCHAR) AS pin,
      concat('  CUSTOMER#', lpad(CAST(o_custkey AS VARCHAR), 9, '0'), ' ') AS address,
      CASE WHEN o_orderkey%13 <> 0 THEN CAST(1880 + o_orderkey%125 AS DOUBLE) END AS year_built,
      o_orderstatus AS property_class, floor(o_totalprice) AS building_sqft, FALSE AS has_basement FROM orders""",
)
def a2(spark, sf):
    return files.read_assessor(spark, _assessor_csv(spark, sf))


@query(
    "a3_parquet_folder",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""",
)
def a3(spark, sf):
    path = scratch(spark)
    table(spark, sf, "customer").selectExpr("c_custkey id", "c_name name", "c_mktsegment segment").write.mode("append").parquet(path)
    table(spark, sf, "supplier").selectExpr("s_suppkey id", "s_name name").write.mode("append").parquet(path)
    return files.read_parquet_folder(spark, path, merge=True).select("id", "name", "segment")


@query(
    "a4_json_elements",
    """SELECT CAST(s_suppkey%90 AS DOUBLE) AS latitude, CAST(s_nationkey AS DOUBLE) AS longitude FROM supplier WHERE s_suppkey%7 <> 0
       UNION ALL SELECT CAST(s_suppkey%45 AS DOUBLE), CAST(s_nationkey AS DOUBLE) FROM supplier""",
)
def a4(spark, sf):
    path, k = scratch(spark), F.col("s_suppkey")
    lon = F.col("s_nationkey").cast("double").alias("lon")
    first = F.struct(F.when(k % 7 != 0, (k % 90).cast("double")).alias("lat"), lon)
    second = F.struct((k % 45).cast("double").alias("lat"), lon)
    table(spark, sf, "supplier").select(F.array(first, second).alias("elements")).write.json(path)
    return files.read_point_elements(spark, path, one_document=False)


def income_csv(spark, sf):
    tract = (F.col("c_custkey") % 100).cast("string").alias("tract")
    rows = table(spark, sf, "customer").groupBy(tract).agg(F.floor(F.avg("c_acctbal")).alias("m"))
    income = F.when(F.col("tract").cast("int") % 10 == 3, "-666666666").when(F.col("tract").cast("int") % 10 == 4, "").otherwise(F.col("m").cast("string"))
    path = scratch(spark)
    rows.select(F.lit("x").alias("NAME"), income.alias("B19013_001E"), F.lit("17").alias("state"), F.lit("031").alias("county"), "tract").write.csv(path, header=True)
    return path


INCOME = """income AS (
  SELECT concat('17031', lpad(CAST(c_custkey%100 AS VARCHAR), 6, '0')) AS census_tract, floor(avg(c_acctbal)) AS income
  FROM customer GROUP BY c_custkey%100 HAVING (c_custkey%100)%10 NOT IN (3, 4) AND floor(avg(c_acctbal)) > 0)"""


@query("a5_income_scan", f"WITH {INCOME} SELECT census_tract, income FROM income")
def a5(spark, sf):
    return files.read_income(spark, income_csv(spark, sf))


def log_json(spark, sf):
    path = scratch(spark)
    files.append_inspections(inspection_log(spark, sf), path)
    return path


@query(
    "a6_inspection_log_scan",
    f"WITH {LOG} SELECT inspected_material, count(*) AS n, round(sum(cost_usd), 4) AS cost FROM log GROUP BY inspected_material",
)
def a6(spark, sf):
    log = files.read_inspections(spark, log_json(spark, sf))
    return log.groupBy("inspected_material").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost"))


@query("a7_log_append", "SELECT inspection_id, count(*) AS n FROM (SELECT CAST(event_id AS VARCHAR) AS inspection_id FROM events UNION ALL SELECT CAST(event_id AS VARCHAR) FROM events) GROUP BY inspection_id")
def a7(spark, sf):
    path, log = scratch(spark), inspection_log(spark, sf)
    files.append_inspections(log, path)
    files.append_inspections(log, path)
    return files.read_inspections(spark, path).groupBy("inspection_id").agg(F.count("*").alias("n"))


@query("a8_parquet_sink", f"WITH {PROPERTY} SELECT property_id, ward, census_tract FROM property")
def a8(spark, sf):
    path = scratch(spark)
    files.write_table(properties(spark, sf), path, ("ward",))
    return spark.read.parquet(path).select("property_id", "ward", "census_tract")


@query("a9_report_sink", f"WITH {PROPERTY} SELECT count(*) AS n, round(avg(p_lead), 6) AS mean_p FROM property")
def a9(spark, sf):
    path = scratch(spark)
    files.write_report(properties(spark, sf).agg(F.count("*").alias("n"), r6(F.avg("p_lead"), "mean_p")), path)
    return spark.read.schema("n bigint, mean_p double").json(path)


@query("a10_curve_sink", f"WITH {PROPERTY} SELECT CAST(ward AS VARCHAR) AS ward, CAST(count(*) AS VARCHAR) AS n FROM property GROUP BY ward")
def a10(spark, sf):
    path = scratch(spark)
    files.write_curve(properties(spark, sf).groupBy("ward").agg(F.count("*").alias("n")), path)
    return files.read_csv_strings(spark, path)


@query("a11_incremental_ingest", "SELECT o_orderkey, o_custkey FROM orders")
def a11(spark, sf):
    """Record the files of one table, add another: exactly the rows of the new files remain to be read."""
    path, seen = scratch(spark), scratch(spark)
    table(spark, sf, "customer").write.mode("append").parquet(f"{path}/customer")
    manifest.record(manifest.fingerprints(spark, path), seen)
    table(spark, sf, "orders").write.mode("append").parquet(f"{path}/orders")
    old = manifest.read_manifest(spark, seen)
    new = manifest.changed(manifest.fingerprints(spark, path, old), old)
    # all columns of both tables, so that a customer file that is read again would show as rows of nulls
    rows = spark.read.option("recursiveFileLookup", "true").schema("o_orderkey bigint, o_custkey bigint").parquet(path)
    rows = rows.withColumn("_file", F.input_file_name())
    fresh = F.broadcast(new.where(F.col("path").endswith(".parquet")).select(manifest.same_path(F.col("path")).alias("_file")))
    return rows.withColumn("_file", manifest.same_path(F.col("_file"))).join(fresh, "_file", "left_semi").drop("_file")


@query(
    "a11_reads_only_new_bytes",
    """SELECT 'customer' AS folder, count(*) AS n_rows, false AS read_again FROM customer
    UNION ALL SELECT 'orders', count(*), true FROM orders""",
)
def a11_bytes(spark, sf):
    """Two tables, one of them recorded before: only the other's files are hashed, block by block, and the sizes of all
    files tell which folder was read."""
    path, seen = scratch(spark), scratch(spark)
    table(spark, sf, "customer").write.parquet(f"{path}/customer")
    manifest.record(manifest.fingerprints(spark, path, block_bytes=1 << 14), seen)
    table(spark, sf, "orders").write.parquet(f"{path}/orders")
    found = manifest.fingerprints(spark, path, manifest.read_manifest(spark, seen), block_bytes=1 << 14, settle=0)
    folder = F.substring_index("name", "/", 1).alias("folder")
    read = found.groupBy(folder).agg((F.sum("hashed") > 0).alias("read_again"))
    rows = spark.read.option("recursiveFileLookup", "true").schema("_none int").parquet(path)
    rows = rows.select(F.element_at(F.split(manifest.same_path(F.input_file_name()), "/"), -2).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("n_rows")).join(read, "folder")


@query(
    "a14_ranked_id_list",
    f"""WITH {PROPERTY}, wanted AS (SELECT DISTINCT o_custkey AS property_id FROM orders WHERE o_orderpriority = '1-URGENT'),
    hit AS (SELECT p.property_id, p_lead FROM property p WHERE property_id IN (SELECT property_id FROM wanted)),
    ranked AS (SELECT *, row_number() OVER (ORDER BY p_lead DESC, property_id) AS rank FROM hit)
    SELECT rank, property_id, p_lead FROM ranked""",
)
def a14(spark, sf):
    path = scratch(spark)
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    urgent.select(F.col("o_custkey").alias("property_id")).write.csv(path, header=True)
    ids = files.read_csv_strings(spark, path).select(F.col("property_id").cast("bigint").alias("property_id"))
    from plumbline.operators.lookup import restrict

    scored = restrict(properties(spark, sf).select("property_id", "p_lead"), ids, "property_id", strict=True)
    return global_rank(scored, [F.desc("p_lead"), F.asc("property_id")])
