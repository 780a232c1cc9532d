"""Streams over several micro-batches."""

from pyspark.sql import functions as F

from loomline.streaming import channels

SCHEMA = "id long, k string, v double, ts timestamp"


def source(spark, path, *batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "id long, k string, v double, t string").select("id", "k", "v", F.to_timestamp("t").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
    return channels.channel(spark, path, SCHEMA)


def drained(spark, df, at):
    channels.to_channel(df, f"{at}/out", f"{at}/check").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


ONE = [(1, "a", 1.0, "2024-01-01 00:00:00"), (2, "a", 1.0, "2024-01-01 00:01:00"), (3, "b", 2.0, "2024-01-01 00:02:00")]
TWO = [(4, "a", 1.0, "2024-01-01 00:03:00"), (5, "a", 3.0, "2024-01-01 00:04:00"), (6, "b", None, "2024-01-01 02:00:00")]


def test_state_goes_on_between_batches(spark, tmp_path):
    rows = source(spark, str(tmp_path / "in"), ONE, TWO).select("id", "k", "v")
    out = drained(spark, channels.dedupe(rows, "k", ["id"], "v"), tmp_path / "dedupe")
    assert sorted(r.id for r in out.collect()) == [1, 3, 5, 6]
    total = drained(spark, channels.running_sum(rows, "k", ["id"], "v"), tmp_path / "sum")
    assert {r.id: r.running for r in total.collect()} == {1: 1.0, 2: 2.0, 3: 2.0, 4: 3.0, 5: 6.0, 6: 2.0}


def test_event_time_windows_close_behind_the_watermark(spark, tmp_path):
    rows = source(spark, str(tmp_path / "in"), ONE, TWO)
    out = drained(spark, channels.windowed(rows, "ts", "1 hour", "10 minutes", "k", n=F.count("*")), tmp_path / "w")
    assert {(r.k, r.n) for r in out.collect()} == {("a", 4), ("b", 1)}
    kept = drained(spark, channels.unique(rows, "k", time="ts"), tmp_path / "u")
    assert sorted(r.k for r in kept.collect()) == ["a", "b"]


def test_sessions(spark, tmp_path):
    rows = source(spark, str(tmp_path / "in"), ONE, TWO)
    out = drained(spark, channels.sessions(rows, "ts", "5 minutes", "1 minute", "k", n=F.count("*")), tmp_path / "s")
    assert {(r.k, r.n) for r in out.collect()} == {("a", 4), ("b", 1)}
