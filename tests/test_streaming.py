"""Streams give the rows of their batch forms."""

from pyspark.sql import functions as F

from meterflow.model import event_points
from meterflow.operators import downsample as D
from meterflow.streaming import jobs


def _stream(spark, small, tmp_path):
    p = event_points(spark, small).withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000"))).cache()
    for i in range(3):  # files in order of time
        p.where((F.col("dp_id") >= i * 334) & (F.col("dp_id") < (i + 1) * 334)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return p, spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"check-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windowed_aggregate(spark, small, tmp_path):
    p, s = _stream(spark, small, tmp_path)
    got = _run(jobs.windowed_aggregate(s, "1 day", ["user"], "40 days"), "agg", tmp_path, "complete")
    want = p.groupBy(F.window("ts", "1 day").start.alias("start"), F.concat(F.lit("user="), F.col("labels")["user"]).alias("group")).agg(F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count"))
    as_rows = lambda df: {(r.start, r.group): (round(r.sum, 6), r["count"]) for r in df.collect()}
    assert as_rows(got) == as_rows(want)


def test_swinging_door_between_batches(spark, small, tmp_path):
    p, s = _stream(spark, small, tmp_path)
    plain = lambda df: df.withColumn("labels", F.create_map().cast("map<string,string>"))
    got = {tuple(r) for r in _run(jobs.swinging_door(plain(s), 25.0), "door", tmp_path).collect()}
    want = {tuple(r) for r in D.sdt(plain(p), 25.0).collect()}
    assert got <= want and len(want - got) <= p.select(D.series_key()).distinct().count()


def test_landed_requests(spark, small, tmp_path):
    from meterflow.sources import otlp

    p = event_points(spark, small).where("dp_id < 300")
    otlp.encode(p).select("body").coalesce(2).write.text(str(tmp_path / "in"))
    got = _run(otlp.stream_json(spark, str(tmp_path / "in"), 1).select("name", "ts_ns", "value"), "landed", tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, p.select("name", "ts_ns", "value").collect()))
    assert otlp.read_json(spark, str(tmp_path / "in")).count() == 300
    bad = spark.createDataFrame([("{",), ("[]",), ("",), (None,), ("{}",)], "body string")
    assert otlp.decode(bad).count() == 0
