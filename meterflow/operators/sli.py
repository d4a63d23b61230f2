"""Service levels from cumulative counters; token usage of language-model services; rates; pipeline health."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of 30 seconds in each lookback.
LOOKBACKS = {"5m": 10, "30m": 60, "1h": 120, "6h": 720}


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def delta(col: str, slots: int, by: list[str] | None = None, order: str = "slot") -> Column:
    """Growth of a counter over a lookback, from the first slot kept where it is shorter."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    old = F.coalesce(F.lag(col, slots - 1).over(w), F.first(col).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return F.col(col) - old


def delivery(slots: int, by: list[str] | None = None) -> Column:
    """Sent of what was received and not dropped on purpose; 1 if nothing was due."""
    due = delta("received", slots, by) - delta("drops", slots, by)
    return F.when(due <= 0, F.lit(1.0)).otherwise(clamp01(delta("sent", slots, by) / due))


def export(slots: int, by: list[str] | None = None) -> Column:
    """Batches that went well of all; 1 if there were none."""
    ok, bad = delta("batches", slots, by), delta("errors", slots, by)
    return F.when(ok + bad <= 0, F.lit(1.0)).otherwise(clamp01(ok / (ok + bad)))


def burn(ratio: Column, target: float) -> Column:
    return F.lit(0.0) if target >= 1 else (1.0 - ratio) / F.lit(1.0 - target)


def budget(ratio: Column, target: float, elapsed_s: Column) -> Column:
    """Share of the error budget left; 1 in the first minute."""
    if target >= 1:
        return F.lit(1.0)
    return F.when(elapsed_s < 60, F.lit(1.0)).otherwise(clamp01(1.0 - (1.0 - ratio) / F.lit(1.0 - target)))


def windowed_ratio(df: DataFrame, good: str, total: str, width_s: int, by: list[str], ts: str = "ts_s") -> DataFrame:
    """good over total growth within width_s before each row; the denominator is 1 at least."""
    w = Window.partitionBy(*by).orderBy(ts).rangeBetween(-width_s, 0)
    growth = lambda c: F.max(c).over(w) - F.min(c).over(w)
    return df.withColumn("ratio", growth(good) / F.greatest(growth(total), F.lit(1)))


def alerts(df: DataFrame, pairs: list[tuple[str, str, float, str]]) -> DataFrame:
    """Rows whose burn exceeds the factor over both windows of a pair: (long, short, factor, severity)."""
    out = F.lit(None).cast("string")
    for long, short, factor, severity in reversed(pairs):
        out = F.when((F.col(f"burn_{long}") > factor) & (F.col(f"burn_{short}") > factor), severity).otherwise(out)
    return df.withColumn("severity", out).where("severity IS NOT NULL")


def tokens(points: DataFrame, most_models: int = 500) -> DataFrame:
    """(provider, model, input, output): whole tokens above 0 by model, of the models first to appear.

    points: provider, model, type, value, ts_ns. Types output and completion are output, all others input.
    """
    n = F.floor("value").cast("long")
    out = F.col("type").isin("output", "completion")
    got = points.where(n > 0).groupBy("provider", "model").agg(F.sum(F.when(~out, n).otherwise(0)).alias("input"), F.sum(F.when(out, n).otherwise(0)).alias("output"), F.min("ts_ns").alias("_f"))
    return got.orderBy("_f", "provider", "model").limit(most_models).drop("_f")


def token_rate(df: DataFrame, slots: int, slot_s: int) -> DataFrame:
    """Tokens a second over the last slots; df: model, slot, total (cumulative)."""
    w = Window.partitionBy("model").orderBy("slot")
    old, at = F.coalesce(F.lag("total", slots).over(w), F.first("total").over(w)), F.coalesce(F.lag("slot", slots).over(w), F.first("slot").over(w))
    dt = (F.col("slot") - at) * slot_s
    return df.withColumn("rate", F.when(dt > 0, (F.col("total") - old) / dt).otherwise(F.lit(0.0)))


def glob(pattern: str) -> str:
    """A shell pattern as a regular expression; * and ? don't cross a slash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i:]:
            j = pattern.index("]", i)
            out += pattern[i : j + 1]
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def token_budgets(usage: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """usage with rule, remaining share and burn of the first (name, glob, budget) rule that fits the model; others go."""
    name, most = F.lit(None).cast("string"), F.lit(None).cast("long")
    for n, g, b in reversed(rules):
        hit = F.col("model").rlike(glob(g))
        name, most = F.when(hit, n).otherwise(name), F.when(hit, F.lit(b).cast("long")).otherwise(most)
    used = F.col("input") + F.col("output")
    df = usage.withColumn("rule", name).withColumn("budget", most).where("rule IS NOT NULL")
    return df.withColumn("remaining", clamp01(1.0 - used / F.col("budget"))).withColumn("burn", used / F.col("budget"))


def health(queue: Column, buffer: Column, latency_ms: Column, circuit_open: Column, weights=(0.35, 0.30, 0.20, 0.15)) -> Column:
    """Weighted pressure of queue, buffer, export latency (2 s is full) and an open circuit."""
    parts = (queue, buffer, clamp01(latency_ms / 2000.0), F.when(circuit_open, 1.0).otherwise(0.0))
    total = F.lit(0.0)
    for p, w in zip(parts, weights):
        total = total + p * w
    return clamp01(total)
