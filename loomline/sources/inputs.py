"""What sequences are made of."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..seq import Seq
from ..shipping import ship

_ADAPTERS: list[tuple[type, Callable]] = []


def register(kind: type, adapt: Callable[[SparkSession, object], Seq]) -> None:
    """Teach as_seq another kind of object."""
    _ADAPTERS.insert(0, (kind, adapt))


def as_seq(spark: SparkSession, x: object, order: Iterable[str] | None = None) -> Seq:
    """A sequence from a Seq, a DataFrame (give its order), a range, a pandas frame or any iterable."""
    if isinstance(x, Seq):
        return x
    if isinstance(x, DataFrame):
        if not order:
            raise ValueError("a DataFrame has no order of its own: name the columns that order it")
        return Seq(x, tuple(order))
    for kind, adapt in _ADAPTERS:
        if isinstance(x, kind):
            return adapt(spark, x)
    if isinstance(x, range):
        return from_range(spark, x)
    if isinstance(x, pd.DataFrame):
        return Seq(spark.createDataFrame(x.reset_index(drop=True).assign(ord=lambda d: range(len(d)))), ("ord",))
    return from_values(spark, x)


def table(spark: SparkSession, path: str, *order: str, format: str = "parquet", **options: str) -> Seq:
    """A table of files; parquet prunes columns and takes filters on the order as well."""
    return Seq(spark.read.format(format).options(**options).load(path), order)


def from_values(spark: SparkSession, xs: Iterable, kind: str | None = None, name: str = "x") -> Seq:
    """ord, x of a Python iterable; the kind is needed where it can't be inferred."""
    rows = list(enumerate(xs))
    return Seq(spark.createDataFrame(rows, f"ord long, {name} {kind}" if kind else (["ord", name] if rows else f"ord long, {name} long")), ("ord",))


def from_range(spark: SparkSession, r: range, name: str = "x") -> Seq:
    df = spark.range(len(r)).withColumnRenamed("id", "ord")
    return Seq(df.withColumn(name, F.lit(r.start) + F.col("ord") * r.step), ("ord",))


def from_tuple(spark: SparkSession, *fields) -> Seq:
    """One element for each field of a tuple."""
    return from_values(spark, fields)


def from_array(df: DataFrame, column: str, *by: str) -> Seq:
    """The elements of each row's array, grouped by the other columns given."""
    return Seq(df.select(*by, F.posexplode(column).alias("ord", "x")), ("ord",), by)


def zipped(*seqs: Seq) -> Seq:
    """Element-wise; values are renamed x1, x2, ... and the shortest ends it."""
    first = seqs[0].indexed("_i")
    df = first.df.select("_i", F.col(seqs[0].values[0]).alias("x1"))
    for k, s in enumerate(seqs[1:], 2):
        df = df.join(s.indexed("_i").df.select("_i", F.col(s.values[0]).alias(f"x{k}")), "_i")
    return Seq(df.withColumnRenamed("_i", "ord"), ("ord",))


def product(*seqs: Seq) -> Seq:
    """Every combination; the first sequence varies fastest."""
    df, order = None, []
    for k, s in enumerate(seqs, 1):
        own = s.df.select(*[F.col(c).alias(f"{c}{k}") for c in (*s.order, *s.values)])
        df = own if df is None else df.crossJoin(own)
        order = [*[f"{c}{k}" for c in s.order], *order]
    return Seq(df, tuple(order))


def concat(*seqs: Seq) -> Seq:
    """One after another: (branch, their order); columns that one lacks are null."""
    df = None
    for k, s in enumerate(seqs):
        own = s.df.select(F.lit(k).alias("branch"), *[F.col(c).alias(f"ord{i}") for i, c in enumerate(s.order)], *s.values)
        df = own if df is None else df.unionByName(own, allowMissingColumns=True)
    return Seq(df, ("branch", *[f"ord{i}" for i in range(max(len(s.order) for s in seqs))]))


def blocks(parts: DataFrame, block: str, column: str) -> Seq:
    """Arrays in blocks, traversed block by block."""
    return Seq(parts.select(block, F.posexplode(column).alias("pos", "x")), (block, "pos"))


def generated(spark: SparkSession, f: Callable[[int], Iterator[tuple]], parts: int, schema: str) -> Seq:
    """A source of any kind: f(part) gives the rows of each of `parts` parts, made in parallel; order is (part, pos)."""
    ship(spark)
    columns = spark.createDataFrame([], schema).columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in pdf["id"]:
                buffer, at = [], 0
                for row in f(int(part)):
                    buffer.append((int(part), at, *row))
                    at += 1
                    if len(buffer) == 4096:
                        yield pd.DataFrame(buffer, columns=["part", "pos", *columns])
                        buffer = []
                if buffer:
                    yield pd.DataFrame(buffer, columns=["part", "pos", *columns])

    rows = spark.range(0, parts, 1, parts)
    return Seq(rows.mapInPandas(work, f"part long, pos long, {schema}"), ("part", "pos"))


class RangeSource(DataSource):
    """A custom source as Spark's Data Source API has it: the numbers from `start` up to before `end` by `step`, in `parts` parts.

    Another kind of source is another class like this; register_source makes
    it a format of the session.
    """

    @classmethod
    def name(cls) -> str:
        return "loomline_range"

    def schema(self) -> str:
        return "ord long, x long"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(*(int(self.options.get(k, d)) for k, d in (("start", 0), ("end", 0), ("step", 1), ("parts", 1))))


class _RangeReader(DataSourceReader):
    def __init__(self, start: int, end: int, step: int, parts: int):
        self.range, self.parts = range(start, end, step), parts

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        n = len(self.range)
        for at in range(n * partition.value // self.parts, n * (partition.value + 1) // self.parts, 1 << 16):
            ord_ = np.arange(at, min(at + (1 << 16), n * (partition.value + 1) // self.parts))
            yield pa.RecordBatch.from_arrays([pa.array(ord_), pa.array(self.range.start + ord_ * self.range.step)], ["ord", "x"])


def register_source(spark: SparkSession, source: type[DataSource]) -> None:
    ship(spark)
    spark.dataSource.register(source)


def comprehend(s: Seq, *, where: object = None, flatten: str | None = None, **exprs) -> Seq:
    """What a comprehension says: elements where ..., perhaps flattened, mapped to these values."""
    from ..operators.filters import filter_
    from ..operators.flatten import cat
    from ..operators.projections import map_

    if flatten:
        s = cat(flatten)(s)
    if where is not None:
        s = filter_(where)(s)
    return map_(**exprs)(s) if exprs else s
