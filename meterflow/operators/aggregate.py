"""Cross-series aggregation in tumbling event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions import labels as L
from meterflow.model import window_start
from meterflow.plans.rules import Rule


def quantile_suffix(q: float) -> str:
    p = q * 100
    return f"_p{p:.0f}" if abs(p - round(p)) < 1e-9 else f"_p{p:.1f}"


def value_of(name: str, interval_ns: int, points: tuple[float, ...] = (), approximate: bool = False) -> Column:
    """One function over the rows of a group, in order of (ts_ns, dp_id) where order matters.

    Quantiles are exact, or with approximate come from a bounded summary (rank error 1 in 10,000).
    """
    v, order = F.col("value"), F.struct("ts_ns", "dp_id")
    first, last = F.min_by(v, order), F.max_by(v, order)
    return {
        "sum": lambda: F.sum(v),
        "avg": lambda: F.avg(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "count": lambda: F.count(F.lit(1)).cast("double"),
        "last": lambda: last,
        "increase": lambda: last - first,
        "rate": lambda: (last - first) / F.lit(interval_ns / 1e9),
        "stddev": lambda: F.stddev_pop(v),
        "stdvar": lambda: F.var_pop(v),
        "quantiles": lambda: F.percentile_approx(v, list(points), 10_000) if approximate else F.percentile(v, F.array(*[F.lit(q) for q in points])),
    }[name]()


def group_labels(rule: Rule, labels: Column) -> Column:
    if rule.group_by:
        return L.keep(labels, *rule.group_by)
    return L.remove(labels, *rule.drop_labels)


def aggregate(points: DataFrame, rule: Rule) -> DataFrame:
    """(name, labels, ts_ns, value, ...): gauges without resource, one for each function, window and label group.

    Groups ignore metric name and resource. One shuffle, with partial sums before it; exact quantiles
    are the only function whose state grows with a group (option approximate bounds it). Several functions add their names to the
    output's; quantiles always add theirs. ts_ns is the window's end.
    """
    width = rule.interval_ns
    g = points.withColumn("_w", window_start(F.col("ts_ns"), width)).withColumn("_g", L.canonical(group_labels(rule, F.col("labels"))))
    made = [value_of(f, width, q, bool(rule.options.get("approximate"))).alias(f"_f{i}") for i, (f, q) in enumerate(rule.functions)]
    got = g.groupBy("_w", "_g").agg(F.first(group_labels(rule, F.col("labels"))).alias("labels"), *made)
    base, several = rule.output or rule.input, len(rule.functions) > 1
    parts = []
    for i, (f, q) in enumerate(rule.functions):
        if f == "quantiles":
            parts += [F.struct(F.lit(base + quantile_suffix(x)).alias("name"), F.col(f"_f{i}")[j].alias("value")) for j, x in enumerate(q)]
        else:
            parts.append(F.struct(F.lit(base + (f"_{f}" if several else "")).alias("name"), F.col(f"_f{i}").alias("value")))
    rows = got.select("_w", "labels", F.explode(F.array(*parts)).alias("p"))
    return rows.select("p.name", "labels", (F.col("_w") + width).alias("ts_ns"), "p.value", F.lit("gauge").alias("kind"), F.create_map().cast("map<string,string>").alias("resource"))
