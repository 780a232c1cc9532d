"""Unbounded sequences by Structured Streaming.

A stream has no global order, so steps with state work for each key, in order of
arrival within a micro-batch by the columns given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship


def channel(spark: SparkSession, path: str, schema: str, format: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """A folder of files as a stream."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def to_channel(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A stream to a folder of files, each row exactly once; with once, what there is now."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def append_unordered(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Every micro-batch to a function; with the batch's number it can tell a repeated one."""
    w = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def keyed(df: DataFrame, key: str, order: list[str], f: Callable, init: tuple, output: str, state: str) -> DataFrame:
    """A machine for each key: f(state, row) -> (state, rows to give), states being tuples of schema `state`.

    Rows of a micro-batch are taken in the order given; the state goes on to the next.
    """
    ship(df.sparkSession)
    names = df.sparkSession.createDataFrame([], output).columns
    columns = df.columns

    def work(own: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else init
        out: list[tuple] = []
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        for row in rows[columns].itertuples(index=False):
            now, given = f(now, row)
            out += given
        held.update(tuple(now))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(work, output, state, "append", GroupStateTimeout.NoTimeout)


def _frames(df: DataFrame, key: str, order: list[str], f: Callable, init: tuple, output: str, state: str) -> DataFrame:
    """As keyed, for a machine that takes the rows of a micro-batch as one sorted frame: f(state, frame) -> (state, frame)."""
    ship(df.sparkSession)

    def work(own: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable").reset_index(drop=True)
        now, out = f(held.get if held.exists else init, rows)
        held.update(now)
        yield out

    return df.groupBy(key).applyInPandasWithState(work, output, state, "append", GroupStateTimeout.NoTimeout)


def dedupe(df: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """For each key, rows whose value differs from the one before it (nulls are equal)."""
    kind = dict(df.dtypes)[column]

    def f(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        seen, last = state
        x = rows[column]
        before = x.shift()
        same = (x == before) | (x.isna() & before.isna())
        first, end = x.iloc[0], x.iloc[-1]
        same.iloc[0] = seen and bool(first == last if pd.notna(first) else last is None)
        return (True, None if pd.isna(end) else getattr(end, "item", lambda: end)()), rows[~same]

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return _frames(df, key, order, f, (False, None), schema, f"seen boolean, last {kind}")


def running_sum(df: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """Each row with the sum of its key's values so far, in `running`; nulls add nothing."""

    def f(state: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        sums = rows[column].astype(float).fillna(0.0).cumsum() + state[0]
        return (float(sums.iloc[-1]),), rows.assign(running=sums)

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return _frames(df, key, order, f, (0.0,), schema + ", running double", "total double")


def unique(df: DataFrame, *columns: str, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row for each value; with a time, state older than the delay is let go."""
    if time is None:
        return df.dropDuplicates(list(columns))
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(columns))


def windowed(df: DataFrame, time: str, length: str, delay: str, *keys: str, slide: str | None = None, **aggregates: Column) -> DataFrame:
    """Event-time windows with a watermark; beyond what sequences offer."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = df.withWatermark(time, delay).groupBy(w, *keys).agg(*[x.alias(n) for n, x in aggregates.items()])
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, delay: str, *keys: str, **aggregates: Column) -> DataFrame:
    """Sessions that a gap ends; beyond what sequences offer."""
    out = df.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(*[x.alias(n) for n, x in aggregates.items()])
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *aggregates)
