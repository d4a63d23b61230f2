"""Sharding by consistent hash, and batches by count, bytes and capacity."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.operators.sampling import numbered


def shard_key(keys: list[str]) -> Column:
    """Name and the configured labels that aren't empty, sorted."""
    both = lambda k: F.coalesce(F.try_element_at("labels", F.lit(k)), F.try_element_at("resource", F.lit(k)), F.lit(""))
    parts = [F.when(both(k) != "", F.concat(F.lit(f"{k}="), both(k))) for k in sorted(keys)]
    return F.concat_ws("|", F.col("name"), *parts)


class Ring:
    """Endpoints on a circle of 64-bit hashes, each at many places; a key belongs to the next place."""

    def __init__(self, endpoints: list[str], places: int = 150):
        at = sorted((xxhash.xxh64_intdigest(f"{e}#{i}", seed=42), e) for e in sorted(set(endpoints)) for i in range(places))
        self.hashes = [h for h, _ in at]
        self.owners = [e for _, e in at]

    def owner(self, key: str) -> str:
        return self.owners[bisect_left(self.hashes, xxhash.xxh64_intdigest(key, seed=42)) % len(self.hashes)]


def with_owner(points: DataFrame, keys: list[str], ring: Ring) -> DataFrame:
    """points with shard_key and endpoint. The ring is searched once for each distinct key, vectorised."""
    hashes, owners = np.array(ring.hashes, np.uint64), np.array(ring.owners)

    @F.pandas_udf("string")
    def owner(h):
        import pandas as pd

        return pd.Series(owners[np.searchsorted(hashes, h.to_numpy().astype(np.int64).view(np.uint64)) % len(hashes)])

    keyed = points.withColumn("shard_key", shard_key(keys))
    return keyed.withColumn("endpoint", owner(F.xxhash64("shard_key")))


def split_request(points: DataFrame, keys: list[str], ring: Ring) -> DataFrame:
    """(part, what, dp_id, endpoint): each series' datapoints go to the owner of its shard key, a metric's metadata to every endpoint."""
    series = with_owner(points, keys, ring).select(F.lit("series").alias("part"), F.col("shard_key").alias("what"), "dp_id", "endpoint")
    everywhere = F.explode(F.array(*[F.lit(e) for e in sorted(set(ring.owners))]))
    return series.unionByName(points.select(F.lit("metadata").alias("part"), F.col("name").alias("what"), "dp_id", everywhere.alias("endpoint")))


def by_count(df: DataFrame, most: int, order: list[str]) -> DataFrame:
    """df with batch: consecutive groups of at most most rows."""
    return numbered(df, order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / most)).drop("_n")


def halves(sizes: list[int], most: int, depth: int = 4) -> list[int]:
    """Part of each item: lists over most bytes are halved, up to depth times; single items never."""
    out: list[int] = []
    part = 0

    def go(a: int, b: int, left: int) -> None:
        nonlocal part
        if b - a <= 1 or sum(sizes[a:b]) <= most or left == 0:
            out.extend([part] * (b - a))
            part += 1
            return
        mid = (b - a) // 2
        go(a, a + mid, left - 1)
        go(a + mid, b, left - 1)

    if sizes:
        go(0, len(sizes), depth)
    return out


def by_bytes(df: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """df's group, order and size columns with part: each group halved until its parts fit."""
    types = dict(df.dtypes)

    def run(pdf):
        pdf = pdf.sort_values(order)
        pdf["part"] = halves(pdf[size].tolist(), most)
        return pdf

    return df.select(group, order, size).groupBy(group).applyInPandas(run, f"{group} {types[group]}, {order} {types[order]}, {size} {types[size]}, part long")


def newest_within(df: DataFrame, by: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """Rows that stay when the oldest are evicted until a group's bytes fit."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_r", F.sum(size).over(w)).where(F.col("_r") <= most).drop("_r")


def with_metadata_first(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Batches with the metadata rows of their families in the first batch only. df: batch, family."""
    first = df.groupBy("family").agg(F.min("batch").alias("batch"))
    return first.join(metadata, "family", "left")
