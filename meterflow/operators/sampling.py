"""Sampling of datapoints: counted, random, by series hash, and bounded for quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterflow.functions.hashing import sampled
from meterflow.operators.downsample import series_key


def numbered(df: DataFrame, order: list[str], out: str, parts: int | None = None) -> DataFrame:
    """df with a 1-based number of each row in the given order, without bringing all rows to one task.

    Rows are dealt by ranges of the order; each range counts its own, and the sums of earlier ranges (one
    row a range) are added.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    counts = ranges.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    own = ranges.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return own.join(F.broadcast(before), "_p").withColumn(out, F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")


def head(points: DataFrame, rate: float) -> DataFrame:
    """Every int(1/rate)-th datapoint in order of arrival; all from rate 1 on, none at 0."""
    if rate >= 1:
        return points
    if rate <= 0:
        return points.limit(0)
    n = int(1 / rate)
    return points if n <= 1 else numbered(points, ["ts_ns", "dp_id"], "_n").where(F.col("_n") % n == 0).drop("_n")


def probabilistic(points: DataFrame, rate: float, seed: int = 1) -> DataFrame:
    """Each datapoint with the given chance; the same ones at every run, whatever the partitions."""
    u = F.pmod(F.xxhash64(F.lit(seed), "dp_id"), F.lit(1 << 53)) / float(1 << 53)
    return points.where(u < rate)


def by_series(points: DataFrame, rate: float) -> DataFrame:
    """All datapoints of the given share of series."""
    return points.where(sampled(series_key(), rate))


def reservoir(points: DataFrame, group: list[str], cap: int = 10_000, seed: int = 1, spread: int = 64) -> DataFrame:
    """At most cap datapoints of each group, all while there are no more: a bounded base for quantiles.

    A group is first cut down to cap within each of spread parts, so a large one isn't sorted in one task.
    """
    draw = F.xxhash64(F.lit(seed), "dp_id")
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "dp_id"), F.lit(spread))
    first = Window.partitionBy(*group, "_part").orderBy("_draw")
    rows = points.withColumn("_draw", draw).withColumn("_part", part).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= cap)
    last = Window.partitionBy(*group).orderBy("_draw")
    return rows.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= cap).drop("_k", "_part", "_draw")
