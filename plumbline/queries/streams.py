"""Streaming over the inspection log: the events are written as log files and consumed until none are left."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.equity import equity_boost
from plumbline.queries.common import LOG, PROPERTY, inspection_log, properties, query, r6, scratch, table
from plumbline.queries.decisions import BOOST
from plumbline.queries.sources import log_json
from plumbline.sources import files
from plumbline.streaming import inspections as I

GOOD = "inspected_material <> 'Plastic' AND cost_usd >= 0"


@query("l1_stream_ingest", f"""WITH {LOG} SELECT inspected_material, count(*) AS n,
  concat_ws(',', CASE WHEN inspected_material = 'Plastic' THEN 'material' END, CASE WHEN cost_usd IS NULL OR cost_usd < 0 THEN 'cost' END) AS rejected FROM log GROUP BY ALL""")
def l1(spark, sf):
    good, bad = scratch(spark), scratch(spark)
    I.ingest(I.read_log(spark, log_json(spark, sf), 2), good, bad, scratch(spark)).awaitTermination()
    ok = spark.read.parquet(good).select("inspected_material", F.lit("").alias("rejected"))
    no = spark.read.parquet(bad).select("inspected_material", F.array_join("rejected_for", ",").alias("rejected"))
    return ok.unionByName(no).groupBy("inspected_material", "rejected").agg(F.count("*").alias("n"))


FILE_ROWS = 50_000


def weeks(spark, sf, resent: bool) -> tuple[str, int]:
    """The log in order of time, each week in the same number of files, and that number; with `resent` every week is
    written twice. A batch of that many files is a week, and tasks share its writing and reading."""
    path, rows = scratch(spark), inspection_log(spark, sf)
    week = F.least(F.lit(3), F.floor((F.dayofmonth(F.col("inspected_at").cast("timestamp")) - 1) / 7))
    sizes = rows.groupBy(week.alias("week")).count().where("week IS NOT NULL")
    # by the smallest week, so that no file of any is empty and left out
    n = max(1, (sizes.agg(F.min("count")).first()[0] or 0) // FILE_ROWS)
    for i in range(4):
        for _ in range(1 + resent):
            files.append_inspections(rows.where(week == i).repartition(n), path)
    return path, n


@query("l2_stream_dedup", "SELECT CAST(event_id AS VARCHAR) AS inspection_id, 1 AS n FROM events")
def l2(spark, sf):
    """Every week of the log is sent twice, one at a time; each id comes out once, at the default delay."""
    out = scratch(spark)
    once = I.deduplicated(I.read_log(spark, *weeks(spark, sf, True)))
    I.run_to_table(once.select("inspection_id"), out, scratch(spark)).awaitTermination()
    return spark.read.parquet(out).groupBy("inspection_id").agg(F.count("*").cast("int").alias("n"))


@query(
    "l3_live_area_shares",
    f"""WITH {PROPERTY}, {LOG}, ok AS (SELECT p.census_tract FROM log l JOIN property p ON CAST(p.property_id AS VARCHAR) = l.property_id WHERE {GOOD})
      SELECT census_tract, count(*) AS n_inspections FROM ok GROUP BY census_tract""",
)
def l3(spark, sf):
    dimension = properties(spark, sf).select(F.col("property_id").cast("string").alias("property_id"), "census_tract")
    out = scratch(spark)
    counts = I.counts_by_area(I.read_log(spark, log_json(spark, sf), 2), dimension)
    I.run_to_table(counts, out, scratch(spark), "complete").awaitTermination()
    return I.latest(spark, out)


@query(
    "l3_live_equity",
    f"""WITH {PROPERTY}, {LOG}, ok AS (SELECT p.census_tract FROM log l JOIN property p ON CAST(p.property_id AS VARCHAR) = l.property_id WHERE {GOOD}),
      {BOOST.replace('FROM log', 'FROM ok')} SELECT census_tract, round(equity_boost, 6) AS equity_boost FROM boost""",
)
def l3_equity(spark, sf):
    boosts = equity_boost(properties(spark, sf), l3(spark, sf), count="n_inspections")
    return boosts.select("census_tract", r6(F.col("equity_boost"), "equity_boost"))


WEEK_SQL = "least(3, CAST(floor((day(ts) - 1) / 7) AS INTEGER))"


@query(
    "l4_retrain_trigger",
    f"""WITH {LOG}, w AS (SELECT {WEEK_SQL} AS week, count(*) FILTER (inspected_material IN ('Lead','Copper','Galvanized') AND NOT used_in_training) AS new FROM log WHERE {GOOD} GROUP BY 1),
      t AS (SELECT week, sum(new) OVER (ORDER BY week) AS pending FROM w) SELECT CAST(pending AS BIGINT) AS pending FROM t WHERE pending >= 500""",
)
def l4(spark, sf):
    """The totals of unused labels at the batches where they had reached the threshold; every week is sent twice."""
    fired: list[tuple[int]] = []
    stream = I.read_log(spark, *weeks(spark, sf, True))
    I.retrain_trigger(stream, scratch(spark), 500, lambda batch, pending: fired.append((pending,))).awaitTermination()
    return spark.createDataFrame(fired, "pending bigint")


@query(
    "l5_windowed_monitoring",
    f"""WITH {LOG} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(avg(CASE WHEN inspected_material = 'Lead' THEN 1.0 ELSE 0.0 END), 6) AS lead_rate, round(sum(cost_usd), 4) AS cost_usd
      FROM log WHERE {GOOD} GROUP BY 1""",
)
def l5(spark, sf):
    out = scratch(spark)
    stream = I.accepted(I.read_log(spark, log_json(spark, sf), 2))
    I.run_to_table(I.windowed(stream), out, scratch(spark), "complete").awaitTermination()
    day = F.date_format(F.col("window.start"), "yyyy-MM-dd")
    return I.latest(spark, out).select(day.alias("day"), "n", r6(F.col("lead_rate"), "lead_rate"), F.round("cost_usd", 4).alias("cost_usd"))


def _with_stale(spark, sf) -> tuple[str, int]:
    """Weeks in order of time, then some records of the first week once more under new ids."""
    path, n = weeks(spark, sf, False)
    old = (F.dayofmonth(F.col("inspected_at").cast("timestamp")) <= 7) & (F.col("inspection_id").cast("bigint") % 50 == 0)
    stale = inspection_log(spark, sf).where(old).withColumn("inspection_id", F.concat(F.lit("again-"), "inspection_id"))
    files.append_inspections(stale.coalesce(1), path)
    return path, n


@query(
    "l5_closed_windows",
    f"""WITH {LOG} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(cost_usd), 4) AS cost_usd FROM log
      WHERE {GOOD} AND date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM log WHERE {GOOD}) - INTERVAL 2 DAY GROUP BY 1""",
)
def l5_closed(spark, sf):
    """Appended windows: each once, when an event two days younger than its end has come; stale records change none."""
    out = scratch(spark)
    stream = I.accepted(I.read_log(spark, *_with_stale(spark, sf)))
    I.run_to_table(I.windowed(stream, late="2 days"), out, scratch(spark)).awaitTermination()
    day = F.date_format(F.col("window.start"), "yyyy-MM-dd")
    return spark.read.parquet(out).select(day.alias("day"), "n", F.round("cost_usd", 4).alias("cost_usd"))


@query(
    "l5_late_records",
    f"WITH {LOG} SELECT concat('again-', inspection_id) AS inspection_id FROM log WHERE {GOOD} AND CAST(inspection_id AS BIGINT) % 50 = 0 AND day(ts) <= 7",
)
def l5_late(spark, sf):
    out = scratch(spark)
    stream = I.accepted(I.read_log(spark, *_with_stale(spark, sf)))
    I.late_records(stream, out, scratch(spark), scratch(spark), late="2 days").awaitTermination()
    return spark.read.parquet(out).select("inspection_id")


@query(
    "k8_record_inspections",
    f"""WITH {PROPERTY} SELECT concat('insp-', substr(sha256(concat(CAST(user_id AS VARCHAR), CAST(epoch_us(ts) AS VARCHAR))), 1, 12)) AS inspection_id, CAST(user_id AS VARCHAR) AS property_id,
      'field_inspection' AS source, coalesce(CASE WHEN event_id%3 <> 0 THEN value END, 500.0::DOUBLE) AS cost_usd, census_tract, FALSE AS used_in_training
      FROM events LEFT JOIN property p ON p.property_id = user_id WHERE event_type <> 'error' AND coalesce(CASE WHEN event_id%3 <> 0 THEN value END, 500) >= 0""",
)
def k8(spark, sf):
    log = inspection_log(spark, sf)
    at = F.to_timestamp("inspected_at").alias("inspected_at")
    cost = F.when(F.col("inspection_id").cast("bigint") % 3 != 0, F.col("cost_usd")).alias("cost_usd")
    requests = log.select("property_id", "inspected_material", at, cost, F.lit(None).cast("string").alias("source"))
    dimension = properties(spark, sf).select(F.col("property_id").cast("string").alias("property_id"), "census_tract")
    out = I.accepted(I.record(requests, dimension, now=F.lit(0).cast("timestamp")))
    return out.select("inspection_id", "property_id", "source", "cost_usd", "census_tract", "used_in_training")


@query("k9_inspection_count", f"WITH {LOG} SELECT count(*) AS n FROM log WHERE {GOOD}")
def k9(spark, sf):
    return I.accepted(files.read_inspections(spark, log_json(spark, sf))).agg(F.count("*").alias("n"))
