"""Sinks: datapoints by endpoint as Parquet, idempotent micro-batches, extra labels, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions import labels as L


def extra_labels(points: DataFrame, extra: dict[str, str]) -> DataFrame:
    """Constant labels win over labels of the same name."""
    if not extra:
        return points
    new = F.create_map(*[F.lit(x) for kv in sorted(extra.items()) for x in kv])
    return points.withColumn("labels", F.map_concat(L.remove(F.col("labels"), *extra), new))


def write_sharded(points: DataFrame, path: str, by: str = "endpoint", mode: str = "overwrite") -> None:
    """One folder an endpoint; rows are dealt by endpoint and a spread of 8, so a busy one has several files."""
    points.withColumn("_s", F.pmod(F.xxhash64("dp_id"), F.lit(8))).repartition(by, "_s").drop("_s").write.mode(mode).partitionBy(by).parquet(path)


def batch_writer(path: str):
    """For foreachBatch: each micro-batch in a folder of its own number, so a repeated one replaces itself."""

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write
