"""Tenants: detection, labels, and quotas over batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.functions import labels as L
from meterflow.model import window_start


def detect(points: DataFrame, mode: str, key: str = "", default: str = "default") -> DataFrame:
    """points with tenant: from the header, a resource attribute, or the first non-empty label of its resource batch."""
    if mode == "header":
        found: Column = F.col("header_tenant")
    elif mode == "attribute":
        found = L.get(F.col("resource"), key)
    elif mode == "label":
        v = F.nullif(L.get(F.col("labels"), key), F.lit(""))
        first = points.where(v.isNotNull()).groupBy("rm_id").agg(F.min_by(v, "dp_id").alias("_t"))
        return points.join(first, "rm_id", "left").withColumn("tenant", F.coalesce("_t", F.lit(default))).drop("_t")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return points.withColumn("tenant", F.coalesce(F.nullif(found, F.lit("")), F.lit(default)))


def inject(points: DataFrame, label: str = "tenant") -> DataFrame:
    return points.withColumn("labels", L.put(F.col("labels"), label, F.col("tenant")))


def strip(points: DataFrame, label: str) -> DataFrame:
    return points.withColumn("labels", L.remove(F.col("labels"), label))


def series() -> Column:
    """Name and sorted labels, without the resource."""
    return F.concat(F.col("name"), F.lit("{"), L.canonical(F.col("labels")), F.lit("}"))


def quota_table(df: DataFrame, quotas: DataFrame, default: int) -> DataFrame:
    """df with max_datapoints of its tenant; quotas: tenant, max_datapoints (one row a configured tenant, as many as there are)."""
    return df.join(quotas, "tenant", "left").withColumn("max_datapoints", F.coalesce("max_datapoints", F.lit(default)))


def batches(points: DataFrame, width_ns: int, with_series: bool = False) -> DataFrame:
    """(w, tenant, batch_id, ts_ns, n, series): the tenant's part of each batch; a batch belongs to the window it starts in.

    Series are gathered only where a limit of cardinality needs them; a batch bounds them.
    """
    own = F.collect_set(series()) if with_series else F.first(F.array().cast("array<string>"))
    got = points.groupBy("tenant", "batch_id").agg(F.min("ts_ns").alias("ts_ns"), F.count(F.lit(1)).alias("n"), own.alias("series"))
    return got.withColumn("w", window_start(F.col("ts_ns"), width_ns))


def quota(parts: DataFrame, most: int, most_series: int = 0, action: str = "drop", by: list[str] | None = None, weak: set[str] | None = None) -> DataFrame:
    """(tenant, batch_id, kept): batches admitted whole while they fit, over the window (and by columns).

    With action log all stay, and are charged; adaptive drops those of weak tenants only. Projected
    cardinality counts a batch's new series. The fold is fed one row a tenant and batch.
    """
    keys = ["w", *(by or [])]
    weak = weak or set()

    def run(pdf):
        pdf = pdf.sort_values(["ts_ns", "batch_id", "tenant"])
        total, seen, kept = 0, set(), []
        for t, n, s in zip(pdf["tenant"], pdf["n"], pdf["series"]):
            s = set(s)
            over = bool(most and total + n > most) or bool(most_series and len(seen | s) > most_series)
            ok = not over or action == "log" or (action == "adaptive" and t not in weak)
            if ok:
                total += n
                seen |= s if most_series else set()
            kept.append(ok)
        pdf["kept"] = kept
        return pdf[["tenant", "batch_id", "kept"]]

    return parts.groupBy(*keys).applyInPandas(run, "tenant string, batch_id long, kept boolean")


def quota_prefix(points: DataFrame, most: int, width_ns: int) -> DataFrame:
    """Resource batches of each tenant and window that stand before the first that overflows."""
    rm = points.groupBy("tenant", "rm_id").agg(F.min("ts_ns").alias("ts_ns"), F.count(F.lit(1)).alias("n")).withColumn("w", window_start(F.col("ts_ns"), width_ns))
    run = F.sum("n").over(Window.partitionBy("tenant", "w").orderBy("ts_ns", "rm_id").rowsBetween(Window.unboundedPreceding, 0))
    return rm.withColumn("_r", run).where(F.col("_r") <= most).select("tenant", "w", "rm_id", "n")


def new_series(points: DataFrame, batch_id: int) -> DataFrame:
    """Series of one batch that no earlier batch had."""
    now = points.where(F.col("batch_id") == batch_id).select("tenant", series().alias("s")).distinct()
    before = points.where(F.col("batch_id") < batch_id).select("tenant", series().alias("s"))
    return now.join(before, ["tenant", "s"], "left_anti").groupBy("tenant").agg(F.count(F.lit(1)).alias("new_series"))
