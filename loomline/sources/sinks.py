"""Where sequences go."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..seq import Seq, Step, identity


def collect(s: Seq, step: Step = identity) -> list:
    """The elements in order, on the driver: plain values where there is one column of them."""
    out = step(s)
    rows = out.df.orderBy(*out.keys).select(*out.values).collect()
    return [r[0] for r in rows] if len(out.values) == 1 else rows


def iterate(s: Seq, step: Step = identity) -> Iterator[Row]:
    """The elements in order, a partition at a time in the driver's memory: a bounded channel."""
    out = step(s)
    yield from out.df.orderBy(*out.keys).select(*out.values).toLocalIterator(prefetchPartitions=True)


def copy_pandas(s: Seq, step: Step = identity) -> pd.DataFrame:
    """As a pandas frame, with its columns even if there is no element."""
    out = step(s)
    return out.df.orderBy(*out.keys).select(*out.values).toPandas()


def write(s: Seq, path: str, mode: str = "error", format: str = "parquet") -> None:
    """To files, ranged by order, so a later scan of a part of the order skips the rest."""
    s.df.repartitionByRange(*s.keys).sortWithinPartitions(*s.keys).write.mode(mode).format(format).save(path)


def append(dest: Seq, s: Seq, step: Step = identity) -> Seq:
    """dest with the outputs after its elements, as one sequence `ord`; the values' names and types must fit."""
    return _append(dest, step(s), False)


def append_widen(dest: Seq, s: Seq, step: Step = identity) -> Seq:
    """append that widens: columns of either, and of two types the one that holds both."""
    return _append(dest, step(s), True)


def _append(dest: Seq, s: Seq, widen: bool) -> Seq:
    if not widen and sorted(dest.values) != sorted(s.values):
        raise ValueError(f"values {s.values} can't be appended to {dest.values}")
    a = dest.indexed("_i").df.select(F.lit(0).alias("_b"), "_i", *dest.values)
    b = s.indexed("_i").df.select(F.lit(1).alias("_b"), "_i", *s.values)
    if not widen:
        kinds = dict(dest.df.dtypes)
        b = b.select("_b", "_i", *[F.col(c).cast(kinds[c]).alias(c) for c in dest.values])
    size = dest.df.agg(F.count("*").alias("_n"))  # one row
    both = a.unionByName(b, allowMissingColumns=widen).crossJoin(F.broadcast(size))
    return Seq(both.withColumn("ord", F.col("_i") + F.when(F.col("_b") == 1, F.col("_n")).otherwise(F.lit(0))).drop("_b", "_i", "_n"), ("ord",))


def map_into(dest: Seq, s: Seq, step: Step, value: str = "x") -> Seq:
    """dest with each element replaced by what the step gives for the element of s at its place; where it gives nothing, the old one stays."""
    if step.expansive:
        raise ValueError(f"{step.name} may give more than one element for one")
    new = step(s.with_df(s.indexed("_at").df, (*s.order, "_at")))
    found = new.df.select("_at", F.struct(F.col(new.values[0]).alias("v")).alias("_new"))
    out = dest.indexed("_at").df.join(found, "_at", "left")
    return dest.with_df(out.withColumn(value, F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col(value))).drop("_at", "_new"))


def foreach(s: Seq, effect: Callable[[Row], None], step: Step = identity) -> None:
    """A side effect for each element, in the tasks; the order holds within a task only."""
    out = step(s)
    out.df.select(*out.values).foreach(effect)


def unordered(s: Seq, step: Step = identity) -> DataFrame:
    """The elements without their order, so nothing is sorted for it."""
    out = step(s)
    return out.df.select(*out.values)


def append_unordered(s: Seq, path: str, step: Step = identity) -> None:
    unordered(s, step).write.mode("append").parquet(path)


def set_input(pipeline: Step, s: Seq) -> Seq:
    """The same pipeline on another input."""
    return pipeline(s)


def with_progress(s: Seq, name: str = "progress") -> tuple[Seq, Observation]:
    """s whose rows are counted while an action runs; the observation then has `rows`."""
    seen = Observation(name)
    return s.with_df(s.df.observe(seen, F.count(F.lit(1)).alias("rows"))), seen
