"""Statistics of datapoints: counts, exact, sketched and hybrid cardinality, label combinations, rule counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions import labels as L
from meterflow.model import window_start


def stat_series() -> Column:
    """Series key of statistics: labels win over equal resource labels."""
    r = F.map_filter(F.col("resource"), lambda k, v: ~F.map_contains_key(F.col("labels"), k))
    return L.canonical(F.map_concat(r, F.col("labels")))


def per_metric(points: DataFrame, full: bool = True) -> DataFrame:
    """Datapoints, and with full the distinct series, of each metric name."""
    aggs = [F.count(F.lit(1)).alias("datapoints")]
    if full:
        aggs.append(F.count_distinct(stat_series()).alias("cardinality"))
    return points.groupBy("name").agg(*aggs)


def totals(points: DataFrame) -> DataFrame:
    """Metrics, datapoints, and the sum of the metrics' cardinalities."""
    return per_metric(points).agg(F.count(F.lit(1)).alias("metrics"), F.sum("datapoints").alias("datapoints"), F.sum("cardinality").alias("cardinality"))


def per_window(points: DataFrame, width_ns: int) -> DataFrame:
    return points.groupBy(window_start(F.col("ts_ns"), width_ns).alias("window_ns"), "name").agg(F.count(F.lit(1)).alias("datapoints"), F.count_distinct(stat_series()).alias("cardinality"))


def per_combination(points: DataFrame, tracked: list[str], cap: int | None = None) -> DataFrame:
    """Datapoints and distinct (metric, series) of each combination of tracked labels; the first cap to appear."""
    every = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.try_element_at("resource", F.lit(k)))
    key = F.array_join(F.filter(F.array(*[F.concat(F.lit(f"{k}="), every(k)) for k in tracked]), lambda x: x.isNotNull()), ",")
    out = points.withColumn("combination", key).groupBy("combination").agg(
        F.count(F.lit(1)).alias("datapoints"), F.count_distinct(F.col("name"), stat_series()).alias("cardinality"), F.min(F.struct("ts_ns", "dp_id")).alias("_f")
    )
    if cap is not None:
        out = out.orderBy("_f").limit(cap)
    return out.drop("_f")


def with_threshold(points: DataFrame, least: int) -> DataFrame:
    """Cardinality only of metrics with at least so many datapoints in their first batch."""
    w = points.groupBy("name", "batch_id").agg(F.count(F.lit(1)).alias("_n"))
    first = w.groupBy("name").agg(F.min_by("_n", "batch_id").alias("_b"))
    return per_metric(points).join(first, "name").select("name", "datapoints", F.when(F.col("_b") >= least, F.col("cardinality")).alias("cardinality"))


def sketched(points: DataFrame, bits: int = 14) -> DataFrame:
    """HyperLogLog estimate of each metric's series; sketches merge by hll_union_agg."""
    return points.groupBy("name").agg(F.hll_sketch_estimate(F.hll_sketch_agg(stat_series(), bits)).alias("estimate"))


def stored_sketches(points: DataFrame, width_ns: int, bits: int = 14) -> DataFrame:
    """A sketch of each metric and window, as a binary column that can be kept and merged later."""
    return points.groupBy("name", window_start(F.col("ts_ns"), width_ns).alias("window_ns")).agg(F.hll_sketch_agg(stat_series(), bits).alias("sketch"))


def merged(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def hybrid(points: DataFrame, threshold: int = 10_000, bits: int = 14) -> DataFrame:
    """Exact cardinality up to the threshold, an estimate above. Only series of metrics near or below it are counted one by one."""
    s = points.select("name", stat_series().alias("s"))
    estimate = s.groupBy("name").agg(F.hll_sketch_estimate(F.hll_sketch_agg("s", bits)).alias("e"))
    few = estimate.where(F.col("e") <= 1.1 * threshold).select("name")  # an estimate errs by far less
    exact = s.join(few, "name", "left_semi").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("x"))
    within = F.coalesce(F.col("x") <= threshold, F.lit(False))
    return estimate.join(exact, "name", "left").select("name", F.when(within, F.col("x")).otherwise(F.col("e")).alias("cardinality"), F.when(within, "exact").otherwise("hll").alias("mode"))


def bloom_inserts(points: DataFrame) -> DataFrame:
    """First appearances of each metric's series by batch: what a membership filter counts as new, without its errors."""
    first = points.groupBy("name", stat_series().alias("s")).agg(F.min("batch_id").alias("batch_id"))
    return first.groupBy("name", "batch_id").agg(F.count(F.lit(1)).alias("new_series"))


def rule_counters(routed: DataFrame) -> DataFrame:
    """Rows of each rule and action, passing ones under an empty rule."""
    return routed.groupBy(F.coalesce("terminal_rule", F.lit("")).alias("rule"), F.coalesce("terminal_action", F.lit("pass")).alias("action")).agg(F.count(F.lit(1)).alias("rows"))


def exposition(points: DataFrame) -> DataFrame:
    """Derived statistics as (metric, label, value) rows."""
    m = per_metric(points)
    return (
        m.select(F.lit("datapoints_total").alias("metric"), F.col("name").alias("label"), F.col("datapoints").cast("double").alias("value"))
        .unionByName(m.select(F.lit("cardinality").alias("metric"), F.col("name").alias("label"), F.col("cardinality").cast("double").alias("value")))
        .unionByName(totals(points).select(F.lit("metrics_total").alias("metric"), F.lit("").alias("label"), F.col("metrics").cast("double").alias("value")))
    )


def dead_rules(rules: DataFrame, matched: DataFrame, now_ns: int, idle_ns: int) -> DataFrame:
    """Rules never matched and loaded longer than idle ago, or last matched longer ago. rules: rule, loaded_ns; matched: rule, ts_ns."""
    last = matched.groupBy("rule").agg(F.max("ts_ns").alias("last_ns"))
    since = F.lit(now_ns) - F.coalesce("last_ns", "loaded_ns")
    return rules.join(last, "rule", "left").select("rule", "last_ns", (since > idle_ns).alias("dead"))
