"""Sinks and streams, each read back as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import filter_
from ..operators.projections import map_, with_values
from ..shared import shared_dir
from ..sources.sinks import append, append_unordered, append_widen, foreach, map_into, set_input, unordered, with_progress, write
from ..streaming import channels
from .registry import load, query

c = F.col


def scratch(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints, which all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


@query("select row_number() over (order by b, k) - 1 as ord, name from (select 0 as b, n_nationkey as k, n_name as name from nation union all select 1, r_regionkey, r_name from region)")
def append_sequences(spark, sf):
    a, b = load(spark, sf, "nation"), load(spark, sf, "region")
    return append(a.select(c("n_name").alias("name")), b, map_(name=c("r_name"))).df.select("ord", "name")


@query("select row_number() over (order by b, k) - 1 as ord, x, extra from (select 0 as b, n_nationkey as k, n_regionkey::DOUBLE as x, null as extra from nation union all select 1, c_custkey, c_acctbal, c_name from customer)")
def append_widening(spark, sf):
    a = load(spark, sf, "nation").select(c("n_regionkey").alias("x"))
    b = load(spark, sf, "customer").select(c("c_acctbal").alias("x"), c("c_name").alias("extra"))
    return append_widen(a, b).df.select("ord", "x", "extra")


@query("select event_id, case when event_type = 'click' then value * 2 else value end as value from events")
def map_in_place(spark, sf):
    s = load(spark, sf, "events", "event_type", "value")
    step = filter_(c("event_type") == "click") >> map_(value=c("value") * 2)
    return map_into(s.select("value"), s, step, "value").df.select("event_id", "value")


@query("select event_id, value from events where event_type = 'view'")
def copy_to_files(spark, sf):
    s = filter_(c("event_type") == "view")(load(spark, sf, "events")).select("value")
    path = scratch(spark)
    write(s, path)
    return spark.read.parquet(path)


@query("select r_regionkey, r_name as value from region")
def overwritten_files(spark, sf):
    """A folder whose contents are replaced by another sequence's."""
    path = scratch(spark)
    write(load(spark, sf, "nation").select(c("n_name").alias("value")), path)
    write(load(spark, sf, "region").select(c("r_name").alias("value")), path, mode="overwrite")
    return spark.read.parquet(path)


@query("select count(*)::BIGINT as calls, sum(event_id)::BIGINT as total from events where event_type = 'error'")
def foreach_effect(spark, sf):
    """A function called for each element in the tasks; what it does is seen in accumulators."""
    calls, total = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def effect(row) -> None:
        calls.add(1)
        total.add(row.id)

    foreach(load(spark, sf, "events"), effect, filter_(c("event_type") == "error") >> map_(id=c("event_id")))
    return spark.createDataFrame([(calls.value, total.value)], "calls long, total long")


@query("select event_type, value from events where value > 50")
def channel_unordered(spark, sf):
    return unordered(load(spark, sf, "events"), filter_(c("value") > 50)).select("event_type", "value")


@query("select n_name as name from nation union all select r_name from region")
def append_unordered_files(spark, sf):
    path = scratch(spark)
    append_unordered(load(spark, sf, "nation"), path, map_(name=c("n_name")))
    append_unordered(load(spark, sf, "region"), path, map_(name=c("r_name")))
    return spark.read.parquet(path)


@query("select c_custkey as id, c_acctbal > 5000 as rich from customer")
def pipeline_on_other_input(spark, sf):
    pipeline = map_(rich=c("bal") > 5000)
    s = load(spark, sf, "customer").select(c("c_acctbal").alias("bal"))
    return set_input(pipeline, s).df.withColumnRenamed("c_custkey", "id")


@query("select count(*) as rows from events where event_type = 'click'")
def progress(spark, sf):
    s, seen = with_progress(filter_(c("event_type") == "click")(load(spark, sf, "events")))
    s.df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"],)], "rows long")


# -- streams


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf)


def _drained(spark: SparkSession, out: DataFrame) -> DataFrame:
    at = scratch(spark)
    channels.to_channel(out, f"{at}/rows", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


@query("select event_id, user_id * 2 as twice from events where event_type = 'click'")
def stream_map_filter(spark, sf):
    return _drained(spark, _stream(spark, sf).where("event_type = 'click'").select("event_id", (c("user_id") * 2).alias("twice")))


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as p from events) where event_type is distinct from p")
def stream_dedupe(spark, sf):
    rows = _stream(spark, sf).select("event_id", "user_id", "event_type")
    return _drained(spark, channels.dedupe(rows, "user_id", ["event_id"], "event_type"))


@query("select event_id, user_id, value, round(sum(value) over (partition by user_id order by event_id), 4) as running from events")
def stream_running_sum(spark, sf):
    rows = _stream(spark, sf).select("event_id", "user_id", "value")
    out = _drained(spark, channels.running_sum(rows, "user_id", ["event_id"], "value"))
    return out.withColumn("running", F.round("running", 4))


@query("select distinct user_id from events")
def stream_unique(spark, sf):
    return _drained(spark, channels.unique(_stream(spark, sf).select("user_id"), "user_id"))


@query("select event_type, count(*) as n from events group by 1")
def stream_to_batches(spark, sf):
    at = scratch(spark)

    def sink(df: DataFrame, batch: int) -> None:
        df.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")

    channels.append_unordered(_stream(spark, sf), sink, f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/rows").groupBy("event_type").agg(F.sum("n").alias("n"))
