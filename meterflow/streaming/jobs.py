"""Streaming forms of the operators: event-time windows with watermarks, and per-series state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions import labels as L
from meterflow.operators.downsample import Door, closing, corridor, series_key


def windowed_aggregate(points: DataFrame, interval: str, group_by: list[str], late: str = "10 minutes") -> DataFrame:
    """Sum and count of each label group in tumbling windows of event time; rows later than the watermark are left out.

    points has a timestamp column ts. Emission follows the watermark, not a wall clock.
    """
    key = L.canonical(L.keep(F.col("labels"), *group_by))
    got = points.withWatermark("ts", late).groupBy(F.window("ts", interval).alias("w"), key.alias("group")).agg(F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count"))
    return got.select(F.col("w.start").alias("start"), "group", "sum", "count")


def sliding_cardinality(points: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    """Approximate series of each metric in sliding windows."""
    return points.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "name").agg(F.approx_count_distinct(series_key()).alias("cardinality")).select(F.col("w.start").alias("start"), "name", "cardinality")


def sessions(points: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a series without a gap: what stays before a series counts as stale."""
    return points.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), series_key().alias("series")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "series", "n")


def swinging_door(points: DataFrame, deviation: float, stale_ms: int = 600_000) -> DataFrame:
    """(series, ts_ns, value): the swinging door with a corridor kept for each series between micro-batches.

    A series without rows for stale_ms of processing time gives its last point and is forgotten.
    """

    def unpacked(kept) -> Door:
        ats, av, sts, sv, steepest, flattest = kept
        return Door((ats, av), (sts, sv), steepest, flattest)

    def run(key, parts, state):
        import pandas as pd

        if state.hasTimedOut:
            out = closing(unpacked(state.get))
            state.remove()
            yield pd.DataFrame({"series": [key[0]] * len(out), "ts_ns": [t for t, _ in out], "value": [v for _, v in out]})
            return
        rows = pd.concat(list(parts)).sort_values(["ts_ns", "dp_id"])
        out, door = corridor(rows["ts_ns"], rows["value"], deviation, unpacked(state.get) if state.exists else None)
        state.update((*door.anchor, *door.seen, door.steepest, door.flattest))
        state.setTimeoutDuration(stale_ms)
        yield pd.DataFrame({"series": [key[0]] * len(out), "ts_ns": [t for t, _ in out], "value": [v for _, v in out]})

    rows = points.select(series_key().alias("series"), "ts_ns", "dp_id", "value")
    return rows.groupBy("series").applyInPandasWithState(
        run, "series string, ts_ns long, value double", "ats long, av double, sts long, sv double, steepest double, flattest double", "append", "ProcessingTimeTimeout"
    )
