"""The registry, and the views every query starts from: the same derivations in Spark and in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.session import checkpoint_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LAT0, LON0 = 41.83, -87.73
AS_OF = "2000-01-01"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, reachable by every executor."""
    return f"{checkpoint_folder(spark)}/queries-{uuid.uuid4().hex}"


def mixed(c: Column, seed: int = 42) -> Column:
    """32-bit arithmetic hash that both engines share."""
    return ((c.cast("bigint") % 2147483647) * F.lit(2654435761) + F.lit(seed * 97)) % F.lit(4294967296)


def mixed_sql(c: str, seed: int = 42) -> str:
    return f"(((CAST({c} AS BIGINT) % 2147483647) * 2654435761 + {seed * 97}) % 4294967296)"


def _latitude(k: Column) -> Column:
    return F.lit(41.64) + ((k * 7919) % 10007).cast("double") / F.lit(10007.0) * F.lit(0.38)


def _longitude(k: Column) -> Column:
    return F.lit(-87.94) + ((k * 104729) % 10009).cast("double") / F.lit(10009.0) * F.lit(0.42)


def _material(segment: Column) -> Column:
    return (
        F.when(segment == "MACHINERY", "Lead")
        .when(segment.isin("BUILDING", "AUTOMOBILE"), "Copper")
        .when(segment == "FURNITURE", "Galvanized")
    )


def properties(spark: SparkSession, sf: str, dated: bool = False) -> DataFrame:
    """One asset per customer; with `dated` also its last order date as inspection time."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    out = c.select(
        k.alias("property_id"),
        F.col("c_nationkey").alias("ward"),
        _latitude(k).alias("latitude"),
        _longitude(k).alias("longitude"),
        F.concat(F.lit("17031"), F.lpad((k % 100).cast("string"), 6, "0")).alias("census_tract"),
        F.when(k % 14 != 0, (1880 + (k * 31) % 125).cast("int")).alias("year_built"),
        (1000 + (k * 37) % 9000).cast("double").alias("lot_size_sqft"),
        F.when(k % 9 != 0, (500 + (k * 53) % 4000).cast("double")).alias("building_sqft"),
        F.when(k % 11 != 0, (1 + k % 3).cast("double")).alias("stories"),
        (k % 5 < 3).alias("has_basement"),
        _material(F.col("c_mktsegment")).alias("service_line_material"),
        (((k * 6151) % 1000).cast("double") / F.lit(1000.0)).alias("p_lead"),
        F.abs("c_acctbal").alias("cost"),
    )
    if not dated:
        return out
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("property_id")).agg(F.max("o_orderdate").alias("_at"))
    return (
        out.join(last, "property_id", "left")
        .withColumn("inspected_at", F.when(F.col("service_line_material").isNotNull(), F.col("_at")))
        .drop("_at")
    )


PROPERTY = """property AS (
  SELECT c_custkey AS property_id, c_nationkey AS ward,
    CAST(41.64 AS DOUBLE) + CAST((c_custkey*7919)%10007 AS DOUBLE)/CAST(10007 AS DOUBLE)*CAST(0.38 AS DOUBLE) AS latitude,
    CAST(-87.94 AS DOUBLE) + CAST((c_custkey*104729)%10009 AS DOUBLE)/CAST(10009 AS DOUBLE)*CAST(0.42 AS DOUBLE) AS longitude,
    concat('17031', lpad(CAST(c_custkey%100 AS VARCHAR), 6, '0')) AS census_tract,
    CASE WHEN c_custkey%14 <> 0 THEN CAST(1880 + (c_custkey*31)%125 AS INTEGER) END AS year_built,
    CAST(1000 + (c_custkey*37)%9000 AS DOUBLE) AS lot_size_sqft,
    CASE WHEN c_custkey%9 <> 0 THEN CAST(500 + (c_custkey*53)%4000 AS DOUBLE) END AS building_sqft,
    CASE WHEN c_custkey%11 <> 0 THEN CAST(1 + c_custkey%3 AS DOUBLE) END AS stories,
    c_custkey%5 < 3 AS has_basement,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'Lead' WHEN 'BUILDING' THEN 'Copper' WHEN 'AUTOMOBILE' THEN 'Copper'
      WHEN 'FURNITURE' THEN 'Galvanized' END AS service_line_material,
    CAST((c_custkey*6151)%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS p_lead,
    abs(c_acctbal) AS cost
  FROM customer)"""

DATED = PROPERTY + """, dated AS (
  SELECT p.*, CASE WHEN service_line_material IS NOT NULL THEN last_at END AS inspected_at
  FROM property p LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_at FROM orders GROUP BY o_custkey) o
    ON o.o_custkey = p.property_id)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("point_id"), _latitude(k).alias("latitude"), _longitude(k).alias("longitude")
    )


POINTS = """points AS (
  SELECT s_suppkey AS point_id,
    CAST(41.64 AS DOUBLE) + CAST((s_suppkey*7919)%10007 AS DOUBLE)/CAST(10007 AS DOUBLE)*CAST(0.38 AS DOUBLE) AS latitude,
    CAST(-87.94 AS DOUBLE) + CAST((s_suppkey*104729)%10009 AS DOUBLE)/CAST(10009 AS DOUBLE)*CAST(0.42 AS DOUBLE) AS longitude
  FROM supplier)"""


def inspection_log(spark: SparkSession, sf: str) -> DataFrame:
    """One log record per event; one event type carries a material outside the enumeration."""
    kind = F.col("event_type")
    material = (
        F.when(kind == "click", "Lead").when(kind == "view", "Copper").when(kind == "purchase", "Galvanized")
        .when(kind == "signup", "Unknown").otherwise("Plastic")
    )
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("inspection_id"), F.col("user_id").cast("string").alias("property_id"),
        material.alias("inspected_material"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("inspected_at"),
        F.lit("field_inspection").alias("source"), F.col("value").alias("cost_usd"),
        F.concat(F.lit("17031"), F.lpad((F.col("user_id") % 100).cast("string"), 6, "0")).alias("census_tract"),
        (F.col("event_id") % 4 == 0).alias("used_in_training"),
    )


LOG = """log AS (
  SELECT CAST(event_id AS VARCHAR) AS inspection_id, CAST(user_id AS VARCHAR) AS property_id,
    CASE event_type WHEN 'click' THEN 'Lead' WHEN 'view' THEN 'Copper' WHEN 'purchase' THEN 'Galvanized'
      WHEN 'signup' THEN 'Unknown' ELSE 'Plastic' END AS inspected_material,
    ts, 'field_inspection' AS source, value AS cost_usd,
    concat('17031', lpad(CAST(user_id%100 AS VARCHAR), 6, '0')) AS census_tract, event_id%4 = 0 AS used_in_training
  FROM events)"""

KNOWN = "service_line_material IN ('Lead','Copper','Galvanized')"

# Great-circle distance between aliases a and b.
HAVERSINE = """(CAST(12742000 AS DOUBLE) * asin(sqrt(least(CAST(1 AS DOUBLE),
  sin(radians(b.latitude-a.latitude)/2)*sin(radians(b.latitude-a.latitude)/2)
  + cos(radians(a.latitude))*cos(radians(b.latitude))
  * sin(radians(b.longitude-a.longitude)/2)*sin(radians(b.longitude-a.longitude)/2)))))"""


def known(df: DataFrame) -> DataFrame:
    return df.where(F.col("service_line_material").isin("Lead", "Copper", "Galvanized"))


def order_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A label and a score per order, with a unique id."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        (((k * 6151 + F.col("o_custkey") * 37) % 1000).cast("double") / 1000.0).alias("p"),
    )


ORDER_SCORES = """scores AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
    CAST((o_orderkey*6151 + o_custkey*37)%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) AS p FROM orders)"""


def line_scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (((F.col("l_orderkey") * 6151 + F.col("l_partkey") * 31 + F.col("l_linenumber")) % 100000).cast("double") / 100000.0).alias("p"),
        F.col("l_linestatus").alias("part"),
    )


LINE_SCORES = """scores AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
    CAST((l_orderkey*6151 + l_partkey*31 + l_linenumber)%100000 AS DOUBLE)/CAST(100000 AS DOUBLE) AS p,
    l_linestatus AS part FROM lineitem)"""


def r6(c: Column, name: str) -> Column:
    """Six decimals, without a negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)
