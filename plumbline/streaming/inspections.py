"""Ingestion of inspection results: validation with quarantine, deduplication, live shares, triggers, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline import fixed_values as fv
from plumbline.functions.text import event_id
from plumbline.sources.files import INSPECTION_LOG

LATE = "7 days"

REASONS = (
    ("material", lambda: F.col("inspected_material").isin(*fv.LABEL_DOMAIN)),
    ("source", lambda: F.col("source").isin(*fv.INSPECTION_SOURCES)),
    ("cost", lambda: F.col("cost_usd") >= 0),
    ("key", lambda: F.col("property_id").isNotNull()),
)


def rejected_for() -> Column:
    """Names of the rules a record breaks; missing values break theirs."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok(), F.lit(False)), F.lit(name)) for name, ok in REASONS])
    )


def judge(df: DataFrame) -> DataFrame:
    return df.withColumn("rejected_for", rejected_for())


def accepted(df: DataFrame) -> DataFrame:
    return judge(df).where(F.size("rejected_for") == 0).drop("rejected_for")


def record(requests: DataFrame, dimension: DataFrame | None, default_cost: float = 500.0, now: Column | None = None) -> DataFrame:
    """Inspection records from requests: defaults filled, id from key and event time, area from the dimension."""
    now = F.current_timestamp() if now is None else now
    out = requests.withColumns(
        {
            "source": F.coalesce("source", F.lit(fv.INSPECTION_SOURCES[0])),
            "cost_usd": F.coalesce("cost_usd", F.lit(default_cost)),
            "inspected_at": F.coalesce("inspected_at", now),
            "used_in_training": F.lit(False),
        }
    )
    out = out.withColumn("inspection_id", event_id(F.col("property_id"), F.col("inspected_at")))
    if dimension is not None:
        out = out.join(dimension.select("property_id", "census_tract"), "property_id", "left")
    return out


def read_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The JSON-lines log as a stream, with its event time as `ts`."""
    reader = spark.readStream.schema(INSPECTION_LOG)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).withColumn("ts", F.col("inspected_at").try_cast("timestamp"))


def deduplicated(stream: DataFrame, late: str = LATE, key: str = "inspection_id", arrival: bool = False) -> DataFrame:
    """Each id once among records within `late` of each other; the state holds the ids of that span and no others.

    Time is event time, and records older than the delay, or without a time, are dropped as late; with `arrival` it is
    the time at which a record is read, and none is late.
    """
    if arrival:
        once = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", late)
        return once.dropDuplicatesWithinWatermark([key]).drop("_arrived")
    return stream.where("ts IS NOT NULL").withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Accepted records to one folder, rejected ones with their reasons to another, each batch exactly once.

    The batch number is part of the path and written in overwrite mode, so a replayed batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        judged = judge(batch).persist()
        ok = F.size("rejected_for") == 0
        judged.where(ok).drop("rejected_for").write.mode("overwrite").parquet(f"{good}/batch={number}")
        judged.where(~ok).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        judged.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_area(stream: DataFrame, dimension: DataFrame, area: str = "census_tract") -> DataFrame:
    """Running inspections per area; the area comes from the static dimension."""
    joined = accepted(stream).drop(area).join(dimension.select("property_id", area), "property_id", "left")
    return joined.groupBy(area).agg(F.count("*").alias("n_inspections"))


def windowed(df: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Count, label rate and cost per tumbling event-time window.

    With `late` (streams only) a window closes once an event that much younger has been seen: append output then gives
    each window once and its state goes. Records of closed windows are left to `late_records`.
    """
    if late is not None:
        df = df.withWatermark("ts", late)
    hit = F.avg((F.col("inspected_material") == fv.POSITIVE_LABEL).cast("double"))
    return df.groupBy(F.window("ts", width)).agg(
        F.count("*").alias("n"), hit.alias("lead_rate"), F.sum("cost_usd").alias("cost_usd")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available. A complete result is a folder of its own per batch (see `latest`), so that a
    failure while one is written leaves the one before."""
    if mode not in ("append", "complete"):
        raise ValueError(f"mode must be append or complete, not {mode}")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:

        def replace(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

        writer = stream.writeStream.foreachBatch(replace)
    return writer.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete result under `path`."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")


def _earlier(spark: SparkSession, path: str, kind: str, batch: int) -> object | None:
    """The value that the last batch before `batch` has left under `path`."""
    try:
        rows = spark.read.schema(f"value {kind}, batch bigint").parquet(path)
        return rows.where(F.col("batch") < batch).agg(F.max_by("value", "batch")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _leave(spark: SparkSession, path: str, kind: str, batch: int, value: object) -> None:
    spark.createDataFrame([(value,)], f"value {kind}").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def late_records(stream: DataFrame, path: str, state: str, checkpoint: str, width: str = "1 day", late: str = LATE) -> StreamingQuery:
    """Records whose window had closed before their batch, to a folder of their own per batch.

    The latest event time of the batches so far stands under `state`, one row per batch, so a replayed batch decides as
    before. Batches must be those of the stream that fills the windows (same source and trigger).
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen, rows = _earlier(spark, state, "timestamp", number), batch.persist()
        newest = rows.agg(F.max("ts")).first()[0]
        if seen is not None:
            closed = F.window("ts", width)["end"] <= F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {late}")
            rows.where(closed).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if newest is not None or seen is not None:
            _leave(spark, state, "timestamp", number, max(x for x in (newest, seen) if x is not None))
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retrain_trigger(
    stream: DataFrame, checkpoint: str, threshold: int, notify: Callable[[int, int], None], state: str | None = None, late: str = LATE,
) -> StreamingQuery:
    """Call `notify(batch, pending)` after each batch at which the labels unused in training have reached the threshold.

    Records sent again within `late` count once, and none is left out for its age: ids are deduplicated by arrival.
    The total of each batch is written under `state` (by default beside the checkpoint); a replayed batch starts from the
    total before it and replaces its own.
    """
    state = state or f"{checkpoint}-pending"
    usable = F.col("inspected_material").isin(*fv.KNOWN_LABELS) & ~F.coalesce("used_in_training", F.lit(False))

    def check(batch: DataFrame, number: int) -> None:
        new = batch.where(usable).count()
        pending = new + (_earlier(batch.sparkSession, state, "bigint", number) or 0)
        _leave(batch.sparkSession, state, "bigint", number, pending)
        if new and pending >= threshold:
            notify(number, pending)

    once = deduplicated(accepted(stream), late, arrival=True)
    return once.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
