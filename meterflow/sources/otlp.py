"""Metric export requests in JSON: a fixed schema, exploded to one row a datapoint; and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_POINT = f"struct<attributes:{_ATTRS},startTimeUnixNano:string,timeUnixNano:string,asDouble:double,asInt:string,flags:int>"
_HIST = f"struct<attributes:{_ATTRS},startTimeUnixNano:string,timeUnixNano:string,count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>,min:double,max:double>"
_METRIC = (
    f"struct<name:string,unit:string,description:string,gauge:struct<dataPoints:array<{_POINT}>>,"
    f"sum:struct<dataPoints:array<{_POINT}>,aggregationTemporality:string,isMonotonic:boolean>,"
    f"histogram:struct<dataPoints:array<{_HIST}>,aggregationTemporality:string>>"
)
#: Schema of a request.
REQUEST = f"struct<resourceMetrics:array<struct<resource:struct<attributes:{_ATTRS}>,scopeMetrics:array<struct<scope:struct<name:string,version:string>,metrics:array<{_METRIC}>>>>>>"


def _map(attrs):
    """Attributes as a string map; of equal keys the last wins, values that aren't strings read as empty."""
    last = F.filter(attrs, lambda a, i: ~F.exists(F.slice(attrs, i + 2, F.greatest(F.size(attrs), F.lit(1))), lambda b: b["key"] == a["key"]))
    pairs = F.transform(last, lambda a: F.struct(a["key"].alias("key"), F.coalesce(a["value"]["stringValue"], F.lit("")).alias("value")))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))


def decode(bodies: DataFrame, body: str = "body", most_bytes: int = 64 << 20) -> DataFrame:
    """One row a datapoint of requests in a string column. Bodies that are too long or not JSON give no rows."""
    cols = [c for c in bodies.columns if c != body]
    df = bodies.where(F.octet_length(body) <= most_bytes).select(*cols, F.from_json(F.col(body), REQUEST).alias("r"))
    df = df.select(*cols, F.posexplode("r.resourceMetrics").alias("rm_pos", "rm"))
    df = df.select(*cols, "rm_pos", _map(F.col("rm.resource.attributes")).alias("resource"), F.explode("rm.scopeMetrics").alias("sm"))
    df = df.select(*cols, "rm_pos", "resource", F.col("sm.scope.name").alias("scope"), F.posexplode("sm.metrics").alias("metric_pos", "m"))
    kind = F.when(F.col("m.gauge").isNotNull(), "gauge").when(F.col("m.sum").isNotNull(), "sum").when(F.col("m.histogram").isNotNull(), "histogram")
    plain = F.coalesce("m.gauge.dataPoints", "m.sum.dataPoints")
    hist = F.transform("m.histogram.dataPoints", lambda p: F.struct(p["attributes"].alias("attributes"), p["startTimeUnixNano"].alias("startTimeUnixNano"), p["timeUnixNano"].alias("timeUnixNano"), p["sum"].alias("asDouble"), p["count"].alias("asInt"), F.lit(0).alias("flags")))
    df = df.select(*cols, "rm_pos", "metric_pos", "resource", "scope", F.col("m.name").alias("name"), F.col("m.unit").alias("unit"), kind.alias("kind"), F.coalesce("m.sum.aggregationTemporality", "m.histogram.aggregationTemporality").alias("temporality"), F.coalesce("m.sum.isMonotonic", F.lit(False)).alias("is_monotonic"), F.explode(F.coalesce(plain, hist)).alias("p"))
    value = F.coalesce("p.asDouble", F.expr("try_cast(p.asInt AS double)"))
    return df.select(*cols, "rm_pos", "metric_pos", "resource", "scope", "name", "unit", "kind", "temporality", "is_monotonic", _map(F.col("p.attributes")).alias("labels"), F.expr("try_cast(p.timeUnixNano AS long)").alias("ts_ns"), value.alias("value"))


def encode(points: DataFrame, by: str = "batch_id") -> DataFrame:
    """One gauge request for each value of by, a resource entry for each resource, a metric for each datapoint."""
    attrs = lambda m: F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    point = F.struct(attrs(F.col("labels")).alias("attributes"), F.col("ts_ns").cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"))
    metric = F.struct(F.col("name"), F.col("unit"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))
    rows = points.withColumn("_a", attrs(F.col("resource"))).groupBy(by, "_a").agg(F.array_sort(F.collect_list(F.struct("dp_id", metric.alias("m")))).alias("ms"))
    entry = F.struct(F.struct(F.col("_a").alias("attributes")).alias("resource"), F.array(F.struct(F.transform("ms", lambda x: x["m"]).alias("metrics"))).alias("scopeMetrics"))
    got = rows.groupBy(by).agg(F.sort_array(F.collect_list(entry)).alias("resourceMetrics"))
    return got.select(by, F.to_json(F.struct("resourceMetrics")).alias("body"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Datapoints of files with one request a line."""
    return decode(spark.read.text(path).withColumnRenamed("value", "body"))


def stream_json(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """The same as a stream: requests land as files, a bounded number of them enters each micro-batch."""
    return decode(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path).withColumnRenamed("value", "body"))
