"""Datapoints: one row each, labels and resource as string maps, times in nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow import shipped

SCHEMA = """batch_id long, rm_id long, metric_id long, dp_id long, header_tenant string,
resource map<string,string>, name string, unit string, kind string, temporality string, is_monotonic boolean,
labels map<string,string>, ts_ns long, value double"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as gauge datapoints: name event_type, labels user and k, resource service.name."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # epoch arithmetic on times without zone
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    return e.select(
        F.expr("event_id div 100").alias("batch_id"),
        F.expr("event_id div 10").alias("rm_id"),
        F.col("event_id").alias("metric_id"),
        F.col("event_id").alias("dp_id"),
        F.when(F.col("user_id") % 11 == 0, F.lit("header-t")).alias("header_tenant"),
        F.create_map(F.lit("service.name"), F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string"))).alias("resource"),
        F.col("event_type").alias("name"),
        F.lit("1").alias("unit"),
        F.lit("gauge").alias("kind"),
        F.lit(None).cast("string").alias("temporality"),
        F.lit(False).alias("is_monotonic"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), k).alias("labels"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.col("value").cast("double").alias("value"),
    )


#: The same rows for DuckDB.
DP = """WITH dp AS (SELECT event_id // 100 AS batch_id, event_id // 10 AS rm_id, event_id AS dp_id,
 CASE WHEN user_id % 11 = 0 THEN 'header-t' END AS header_tenant, 'svc-' || CAST(user_id % 7 AS VARCHAR) AS service,
 event_type AS name, CAST(user_id AS VARCHAR) AS u, COALESCE(json_extract_string(props, '$.k'), '') AS k,
 epoch_us(ts) * 1000 AS ts_ns, value FROM events)
"""

HOUR = 3_600_000_000_000
DAY = 24 * HOUR


def window_start(ts_ns: Column, width_ns: int) -> Column:
    return ts_ns - F.pmod(ts_ns, F.lit(width_ns))
