"""Steps that give one element for one: maps, lookups, counters, zips."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..seq import Seq, Step, estimated_bytes
from ..shipping import ship

#: Values of an iterated function that a task computes from one that is known.
STRIDE = 1024


def small(df: DataFrame, limit: int = 16 << 20) -> DataFrame:
    """df, marked for broadcast if Catalyst's estimate of its size allows that."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def map_(**exprs: Column) -> Step:
    """Replace the values by these."""
    return Step("map", lambda s: s.select(*[x.alias(n) for n, x in exprs.items()]), stable=True)


def with_values(**exprs: Column) -> Step:
    """Add or replace these values and keep the others."""
    return Step("with_values", lambda s: s.with_df(s.df.withColumns(exprs)), stable=True)


def map_pandas(f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Step:
    """Replace the values by what f gives for frames of them, row for row: for what Column expressions can't say.

    Frames come as Arrow batches in no order; f must give as many rows as it is
    given, in the columns of `schema`.
    """

    def apply(s: Seq) -> Seq:
        ship(s.df.sparkSession)
        keys, values = list(s.keys), s.values

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = f(pdf[values])
                if len(out) != len(pdf):
                    raise ValueError(f"{len(out)} rows for {len(pdf)}")
                yield pd.concat([pdf[keys].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

        types = dict(s.df.dtypes)
        head = ", ".join(f"`{k}` {types[k]}" for k in keys)
        return s.with_df(s.df.select(*keys, *values).mapInPandas(work, f"{head}, {schema}"))

    return Step("map_pandas", apply, stable=True)


def map_splat(column: str, f: Callable[..., Column], name: str = "x") -> Step:
    """f of the fields of a struct."""

    def apply(s: Seq) -> Seq:
        fields = s.df.schema[column].dataType.fieldNames()
        return s.select(f(*[F.col(column)[n] for n in fields]).alias(name))

    return Step("map_splat", apply, stable=True)


def replace(column: str, table: Mapping | DataFrame) -> Step:
    """Look the value up and keep it where it isn't found.

    The table is a mapping, or a DataFrame (key, value) of distinct keys, whose
    null values do replace.
    """

    def apply(s: Seq) -> Seq:
        if isinstance(table, Mapping):
            if not table:
                return s
            kind = s.df.schema[column].dataType
            pairs = F.create_map(*[F.lit(x).cast(kind) for x in chain(*table.items())])
            return s.with_df(s.df.withColumn(column, F.when(F.map_contains_key(pairs, F.col(column)), F.element_at(pairs, F.col(column))).otherwise(F.col(column))))
        found = small(table.select(F.col("key").alias("_k"), F.col("value").alias("_v"), F.lit(True).alias("_hit")))
        df = s.df.join(found, F.col(column) == F.col("_k"), "left")
        return s.with_df(df.withColumn(column, F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(column))).drop("_k", "_v", "_hit"))

    return Step("replace", apply, stable=True)


def get_index(column: str, values: list | DataFrame, inbounds: bool = False, name: str = "x") -> Step:
    """The element of a 1-based list at the value; out of range is an error, or null with inbounds.

    A DataFrame (index, value) is joined instead; rows beyond it are dropped, or
    null with inbounds.
    """

    def apply(s: Seq) -> Seq:
        if isinstance(values, DataFrame):
            table = small(values.select(F.col("index").alias("_k"), F.col("value").alias("_v")))
            df = s.df.join(table, F.col(column) == F.col("_k"), "left" if inbounds else "inner")
            return s.with_df(df).select(F.col("_v").alias(name))
        array = F.lit(list(values))
        at = F.col(column).cast("int")
        return s.select((F.try_element_at(array, at) if inbounds else F.element_at(array, at)).alias(name))

    return Step("get_index", apply, stable=True)


def set_index(s: Seq, base: DataFrame, column: str, value: str) -> DataFrame:
    """base (index, value) after each element in turn set value at its index; the last one wins."""
    last = s.df.groupBy(F.col(column).alias("_k")).agg(F.max_by(F.struct(F.col(value).alias("v")), s.place()).alias("_new"))
    out = base.join(last, F.col("index") == F.col("_k"), "left")
    return out.select("index", F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(F.col("value")).alias("value"))


def flag_first(name: str = "is_first") -> Step:
    def apply(s: Seq) -> Seq:
        table, cut = s.first_place()
        on = s.df.join(table, list(s.by)) if s.by else s.df.crossJoin(F.broadcast(table))
        return s.with_df(on.withColumn(name, s.place() == F.col(cut)).drop(cut))

    return Step("flag_first", apply, stable=True)


def enumerate_(start=1, step=1, name: str = "n") -> Step:
    """start + i * step beside the values: numbers, or a date or time and an interval.

    The result is of the start's type. A date thus counts in whole days or
    months; for parts of days start from a timestamp.
    """

    def apply(s: Seq) -> Seq:
        one = s.indexed("_i")
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (start, step))
        kind = s.df.select(a.alias("a")).schema["a"].dataType
        n = a + b * F.col("_i")
        return one.with_df(one.df.withColumn(name, n.cast(kind) if isinstance(kind, T.DateType) else n).drop("_i"))

    return Step("enumerate", apply, stable=True)


def count(start=1, step=1, name: str = "n") -> Step:
    """As enumerate_, without the values."""
    return Step("count", lambda s: enumerate_(start, step, name)(s).select(F.col(name)), stable=True)


def iterated(f: Callable[[Column], Column], init: Column, name: str = "x", closed: Callable[[Column], Column] | None = None) -> Step:
    """init, f(init), f(f(init)), ... for the elements in turn, whose values are dropped.

    With closed, the i-th value is closed(i).  Else one task goes through the
    values, as it must, but keeps only every STRIDE-th; from each of these a row
    makes those up to the next, and elements are joined with them by index.
    """

    def apply(s: Seq) -> Seq:
        one = s.indexed("_i")
        if closed is not None:
            return one.select(closed(F.col("_i")).alias(name))

        def again(x: Column, n: int) -> Column:
            return F.aggregate(F.sequence(F.lit(1), F.lit(n)), x, lambda a, _: f(a))

        def longer(a: Column, next_: Callable[[Column], Column]) -> Column:
            return F.concat(a, F.array(next_(F.element_at(a, -1))))

        def numbers(first: int, last: Column) -> Column:
            return F.when(last >= first, F.sequence(F.lit(first), last.cast("int"))).otherwise(F.array().cast("array<int>"))

        top = one.df.agg(F.max("_i").alias("_m")).where("_m is not null")
        firsts = F.aggregate(numbers(1, F.floor(F.col("_m") / STRIDE)), F.array(init), lambda a, _: longer(a, lambda x: again(x, STRIDE)))
        starts = top.select("_m", F.posexplode(firsts).alias("_s", "_x")).repartition("_s")
        place = F.col("_s").cast("long") * STRIDE
        # no value is computed that no element has, as it might not be possible
        values = F.aggregate(numbers(2, F.least(F.lit(STRIDE), F.col("_m") - place + 1)), F.array("_x"), lambda a, _: longer(a, f))
        table = starts.select(place.alias("_at"), F.posexplode(values).alias("_p", "_v")).select((F.col("_at") + F.col("_p")).alias("_k"), "_v")
        df = one.df.join(table, F.col("_i") == F.col("_k"))
        return one.with_df(df).select(F.col("_v").alias(name))

    return Step("iterated", apply, stable=True)


def interpose(separator: Column, column: str = "x") -> Step:
    """separator between neighbours; the order gets a column `pos`."""

    def apply(s: Seq) -> Seq:
        one = flag_first("_f")(s)
        both = F.when(F.col("_f"), F.array(F.col(column))).otherwise(F.array(separator.cast(s.df.schema[column].dataType), F.col(column)))
        df = one.df.select(*s.keys, F.posexplode(both).alias("pos", column))
        return s.with_df(df, (*s.order, "pos"))

    return Step("interpose", apply, expansive=True)


def inject(other: Seq, prefix: str = "") -> Step:
    """Each element with the one of the other sequence at the same place; it ends with the shorter."""

    def apply(s: Seq) -> Seq:
        a, b = s.indexed("_i"), other.indexed("_j")
        on = [F.col("_i") == F.col("_j"), *[F.col(f"a.{c}") == F.col(f"b.{c}") for c in s.by]]
        joined = a.df.alias("a").join(b.df.alias("b"), on)
        own = [F.col(f"a.{c}") for c in (*s.keys, *s.values)]
        return s.with_df(joined.select(*own, *[F.col(f"b.{c}").alias(f"{prefix}{c}") for c in other.values]))

    return Step("inject", apply)


def broadcasting(s: Seq, column: str, aggregate: Callable[[Column], Column] = F.sum) -> DataFrame:
    """(by..., pos, value): the element-wise fold over an array column; a scalar counts at every position."""
    if not s.df.schema[column].dataType.typeName().startswith("array"):
        return s.df.groupBy(*s.by).agg(aggregate(F.col(column)).alias("value"))
    items = s.df.select(*s.by, F.posexplode(column).alias("pos", "_x"))
    return items.groupBy(*s.by, "pos").agg(aggregate(F.col("_x")).alias("value"))
