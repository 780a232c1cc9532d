"""Ordered sequences over DataFrames, and steps that turn one into another.

A Seq is a DataFrame with columns that order it totally (`order`) and,
possibly, columns that divide it into sequences of their own (`by`).  What comes
out never depends on how rows lie in partitions.

Running state (indices, scans, previous rows) uses one window per group.  A
sequence without groups whose rows take more than BLOCK_BYTES is divided into
blocks by ranges of its order.  Every block has a task and a window of its own,
and what earlier blocks carry over comes from a table with one row for each
block, so no task ever holds the whole sequence, nor more than a block of it.
The cut points are found once, and go with the sequence through the steps that
keep its order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: A sequence without groups is worked on in blocks beyond this size of its rows, and blocks are of about that size; sorts and windows take some ten times that.
BLOCK_BYTES = 16 << 20
#: Rows may take so many times what Catalyst estimates, which goes by the size of compressed files; below that they aren't counted.
COMPRESSION = 8
MOST_BLOCKS = 100_000
#: So many places are drawn for each block, to cut between them.
DRAWN = 20
#: A small side is broadcast up to this many rows.
BROADCAST_ROWS = 100_000
#: Up to so many cut points are compared one by one; the code for more would be too long to be compiled.
COMPARED = 16
BLOCK = "_block"


class EmptyResultError(ValueError):
    """A fold without an initial value met no element."""


class IdentityNotDefinedError(ValueError):
    """An operation without a known identity was asked to start from it."""


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@dataclass(frozen=True)
class Running:
    """A running aggregate: of a window, of a block, and how the two combine."""

    aggregate: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]


RUNNING = {
    "sum": Running(F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": Running(F.count, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "max": Running(F.max, lambda a, b: F.greatest(a, b)),
    "min": Running(F.min, lambda a, b: F.least(a, b)),
    "and": Running(F.bool_and, lambda a, b: F.coalesce(a & b, a, b)),
    "product": Running(F.product, lambda a, b: F.coalesce(a * b, a, b)),
    "or": Running(F.bool_or, lambda a, b: F.coalesce(a | b, a, b)),
}


@dataclass(frozen=True)
class Seq:
    df: DataFrame
    order: tuple[str, ...]
    by: tuple[str, ...] = ()
    block_bytes: int | None = field(default=None, compare=False)
    #: Cut points between blocks, as JSON, and the order that they are of; empty for a sequence found to be small.
    cuts: tuple[str, ...] | None = field(default=None, compare=False)
    cut_by: tuple[str, ...] = field(default=(), compare=False)
    #: Whether steps leave the blocks that they divide it into for the next ones, so rows go to their blocks once.
    keeps_blocks: bool = field(default=False, compare=False)

    # -- columns

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.by, *self.order)

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys and c != BLOCK]

    def with_df(self, df: DataFrame, order: Sequence[str] | None = None) -> Seq:
        return replace(self, df=df, order=tuple(order) if order else self.order)

    def select(self, *columns: Column | str) -> Seq:
        """These values, with the keys before them."""
        return self.with_df(self.df.select(*self.keys, *([BLOCK] if self.is_blocked else []), *columns))

    def grouped(self, *by: str) -> Seq:
        """A sequence for each value of these columns; steps then work on each by itself."""
        return replace(self.unblocked(), by=by)

    def place(self) -> Column:
        """The order columns as one comparable value."""
        return F.struct(*[F.col(c) for c in self.order])

    # -- windows

    def blocked(self) -> Seq:
        """With a block for each row, and each block in a partition of its own, where the sequence is large; else as it is."""
        if self.by:
            return self
        s = self.cut()
        if s.by or s.is_blocked or not s.cuts:
            return s
        df = _locate(s.df, s.cut_by, s.cuts)
        # by its number, as a hash puts several blocks into one task, and adaptive execution joins small partitions
        return replace(s, df=df.repartitionById(len(s.cuts) + 1, F.col(BLOCK)))

    def cut(self) -> Seq:
        """With its cut points, but no blocks yet; as it is, if they are known already."""
        if self.by or self.cuts is not None and self.cut_by == self.order[: len(self.cut_by)]:
            return self
        s = self.with_df(self.df.drop(BLOCK))
        return replace(s, cuts=s._cuts(), cut_by=s.order)

    def _cuts(self) -> tuple[str, ...]:
        """Places that divide the sequence into blocks of about the same size, of a sample of its order columns."""
        limit = self.block_bytes or BLOCK_BYTES
        if estimated_bytes(self.df) * COMPRESSION <= limit:
            return ()
        # Catalyst's estimate is of compressed files, and of joins a wild one: count before dividing
        rows, more = self.df.agg(F.count(F.lit(1)), _beyond_default(self.df)).first()
        n = min(MOST_BLOCKS, ceil((rows * self.df._jdf.schema().defaultSize() + (more or 0)) / limit))
        if n < 2:
            return ()
        drawn = self.df.select(self.place().alias("p")).sample(min(1.0, DRAWN * n / rows), 1)
        places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get(F.col("a"), (i * F.size("a") / n).cast("int"))))
        cuts = drawn.agg(F.array_sort(F.collect_list("p")).alias("a")).select(F.transform(places, lambda p: F.to_json(p, _EXACT)).alias("c")).first()["c"]
        return tuple(c for c in cuts or () if c is not None)

    @property
    def is_blocked(self) -> bool:
        return BLOCK in self.df.columns and not self.by

    def unblocked(self) -> Seq:
        return replace(self, df=self.df.drop(BLOCK), keeps_blocks=False)

    def left(self, given: Seq) -> Seq:
        """What a step leaves of the blocks that it made: all, if it was given some or is to keep them; else none."""
        return replace(self, keeps_blocks=given.keeps_blocks) if given.is_blocked or given.keeps_blocks else self.unblocked()

    def window(self) -> WindowSpec:
        by = [*self.by, *([BLOCK] if self.is_blocked else [])]
        return (Window.partitionBy(*by) if by else Window).orderBy(*self.order)

    def so_far(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    # -- running state

    def running(self, **columns: tuple[str, Column]) -> Seq:
        """Inclusive running aggregates: name=(kind, expression), a kind of RUNNING; nulls add nothing."""
        s = self.blocked()
        w = s.so_far()
        df = s.df.withColumns({name: RUNNING[kind].aggregate(x).over(w) for name, (kind, x) in columns.items()})
        if s.is_blocked:
            totals = s.df.groupBy(BLOCK).agg(*[RUNNING[kind].aggregate(x).alias(name) for name, (kind, x) in columns.items()])
            before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
            carry = totals.select(BLOCK, *[RUNNING[kind].aggregate(F.col(name)).over(before).alias(f"_c_{name}") if kind != "count" else F.sum(name).over(before).alias(f"_c_{name}") for name, (kind, _) in columns.items()])
            df = df.join(F.broadcast(carry), BLOCK)
            df = df.withColumns({name: RUNNING[kind].combine(F.col(f"_c_{name}"), F.col(name)) for name, (kind, _) in columns.items()}).drop(*[f"_c_{name}" for name in columns])
        return s.with_df(df).left(self)

    def indexed(self, name: str = "i") -> Seq:
        """With the 0-based place of each row."""
        s = self.blocked()
        df = s.df.withColumn(name, (F.row_number().over(s.window()) - 1).cast("long"))
        if s.is_blocked:
            before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
            sizes = s.df.groupBy(BLOCK).count().select(BLOCK, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
            df = df.join(F.broadcast(sizes), BLOCK).withColumn(name, F.col(name) + F.col("_before")).drop("_before")
        return s.with_df(df).left(self)

    def previous(self, **columns: Column) -> Seq:
        """With values of the row before: name=expression; null for the first row."""
        s = self.blocked()
        df = s.df.withColumns({name: F.lag(x).over(s.window()) for name, x in columns.items()})
        if s.is_blocked:
            ends = s.df.groupBy(BLOCK).agg(F.min(s.place()).alias("_head"), *[F.max_by(x, s.place()).alias(f"_l_{n}") for n, x in columns.items()])
            w = Window.orderBy(BLOCK)  # a row for each block
            carry = ends.select(BLOCK, "_head", *[F.lag(f"_l_{n}").over(w).alias(f"_l_{n}") for n in columns])
            df = df.join(F.broadcast(carry), BLOCK)
            df = df.withColumns({n: F.when(s.place() == F.col("_head"), F.col(f"_l_{n}")).otherwise(F.col(n)) for n in columns}).drop("_head", *[f"_l_{n}" for n in columns])
        return s.with_df(df).left(self)

    def following(self, n: int, name: str, value: Column) -> Seq:
        """With the values of the n rows after each, as an array that is shorter near the end; of 64 bits or not, they are whole values."""
        s = self.blocked()
        ahead = s.window().rowsBetween(1, n)
        df = s.df.withColumn(name, F.collect_list(F.struct(value.alias("v"))).over(ahead))
        if s.is_blocked:
            # the first n of each block, and so of the blocks after it, as there may be shorter ones
            heads = s.df.select(BLOCK, s.place().alias("_p"), F.struct(value.alias("v")).alias("_v"), F.row_number().over(s.window()).alias("_r")).where(F.col("_r") <= n)
            heads = heads.groupBy(BLOCK).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda r: r["_v"]).alias("_h"))
            after = F.flatten(F.collect_list("_h").over(Window.orderBy(BLOCK).rowsBetween(1, n)))  # a row for each block
            carry = heads.select(BLOCK, F.slice(after, 1, n).alias("_a"))
            df = df.join(F.broadcast(carry) if n * len(s.cuts) <= BROADCAST_ROWS else carry, BLOCK)
            df = df.withColumn(name, F.when(F.size(name) < n, F.slice(F.concat(name, "_a"), 1, n)).otherwise(F.col(name))).drop("_a")
        return s.with_df(df.withColumn(name, F.transform(name, lambda r: r["v"]))).left(self)

    def first_place(self, where: Column | None = None) -> tuple[DataFrame, str]:
        """The least place (column `_cut`) where the condition is true, for each group; one row without groups."""
        x = self.place() if where is None else F.when(where, self.place())
        cut = F.min(x).alias("_cut")
        return (self.df.groupBy(*self.by).agg(cut) if self.by else self.df.agg(cut)), "_cut"

    def against_cut(self, where: Column | None, keep: Callable[[Column, Column], Column]) -> Seq:
        """Rows for which keep(place, cut) holds; cut is null where the condition never is true."""
        if self.by:
            w = Window.partitionBy(*self.by)
            cut = F.min(self.place() if where is None else F.when(where, self.place())).over(w)
            df = self.df.withColumn("_cut", cut).where(keep(self.place(), F.col("_cut")))
        else:
            table, _ = self.first_place(where)
            df = self.df.crossJoin(F.broadcast(table)).where(keep(self.place(), F.col("_cut")))  # one row
        return self.with_df(df.drop("_cut"))


def _beyond_default(df: DataFrame) -> Column:
    """What strings, binaries and arrays take beyond Spark's default sizes, summed over all rows."""
    more = F.lit(0).cast("long")
    for c, kind in zip(df.columns, df._jdf.schema().fields()):
        name, default = kind.dataType().typeName(), kind.dataType().defaultSize()
        if name in ("string", "binary"):
            more += F.coalesce(F.greatest(F.octet_length(F.col(f"`{c}`")) - default, F.lit(0)), F.lit(0))
        elif name == "array":
            more += F.coalesce(F.greatest((F.size(F.col(f"`{c}`")).cast("long") - 1) * default, F.lit(0)), F.lit(0))
    return F.sum(more)


#: How cut points are written: with all digits of a time, and no field left out.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _locate(df: DataFrame, columns: Sequence[str], cuts: Sequence[str]) -> DataFrame:
    """df with the number of cuts that lie below each row's place, by one or two short searches.

    The optimizer makes cuts literals.  Comparisons with them one by one are
    compiled, other than a filter of an array, as long as there are few of them.
    """
    kind = "struct<" + ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in columns) + ">"
    place = F.struct(*[F.col(c) for c in columns])

    def listed(some: Sequence[str]) -> Column:
        return F.from_json(F.lit("[" + ",".join(some) + "]"), f"array<{kind}>", _EXACT)

    def total(below: Sequence[Column]) -> Column:
        return reduce(lambda a, b: a + b, [F.when(b, F.lit(1)).otherwise(F.lit(0)) for b in below])

    def below(cut: str) -> Column:
        whole = F.from_json(F.lit(cut), kind, _EXACT)
        if len(columns) > 1:
            return whole < place
        x = F.col(columns[0])
        return x.isNotNull() if json.loads(cut)[columns[0]] is None else whole[columns[0]] < x  # a null is the least

    if len(cuts) <= COMPARED:
        return df.withColumn(BLOCK, total([below(c) for c in cuts]))
    step = ceil(sqrt(len(cuts)))
    coarse = cuts[step - 1 :: step]
    if step > 2 * COMPARED:
        found = F.size(F.filter(listed(coarse), lambda c: c < place))
        return df.withColumn(BLOCK, found * step + F.size(F.filter(F.slice(listed(cuts), found * step + 1, F.lit(step)), lambda c: c < place)))
    fine = [F.coalesce(F.get(listed(cuts), F.col("_coarse") * step + j) < place, F.lit(False)) for j in range(step - 1)]
    return df.withColumn("_coarse", total([below(c) for c in coarse])).withColumn(BLOCK, F.col("_coarse") * step + total(fine)).drop("_coarse")


# -- steps


@dataclass(frozen=True)
class Step:
    """A named function from Seq to Seq; steps compose from left to right with >>.

    expansive: may give more than one row for one; stable: gives one for each;
    ends: the condition under which it ends a sequence early, as an aggregate
    over what comes into it, for a step that can.
    """

    name: str
    apply: Callable[[Seq], Seq]
    expansive: bool = False
    stable: bool = False
    ends: Callable[[Seq], Column] | None = None
    parts: tuple[Step, ...] = ()

    def __call__(self, s: Seq) -> Seq:
        return self.apply(s)

    def __rshift__(self, other: Step) -> Step:
        return compose(self, other)


identity = Step("identity", lambda s: s, stable=True)


def compose(*steps: Step) -> Step:
    """The steps from left to right, without identities."""
    real = [s for s in steps if s is not identity]
    if not real:
        return identity
    if len(real) == 1:
        return real[0]
    parts = tuple(p for s in real for p in s.parts or (s,))
    return Step(" >> ".join(s.name for s in parts), lambda seq: reduce(lambda x, s: s(x), parts, seq), any(s.expansive for s in parts), all(s.stable for s in parts), None, parts)


def ended(step: Step, s: Seq) -> DataFrame:
    """(by..., terminated): whether a step, or any that it is composed of, ends the sequence early; a row for each group, or one."""
    out = None
    for part in step.parts or (step,):
        if part.ends is not None:
            own = (s.df.groupBy(*s.by) if s.by else s.df.groupBy()).agg(F.coalesce(part.ends(s), F.lit(False)).alias("terminated"))
            out = own if out is None else out.unionByName(own)
        s = part(s)
    if out is None:
        one = s.df.select(*s.by).distinct() if s.by else s.df.sparkSession.range(1).select()
        return one.withColumn("terminated", F.lit(False))
    return (out.groupBy(*s.by) if s.by else out.groupBy()).agg(F.bool_or("terminated").alias("terminated"))


def free(name: str, taken: Sequence[str]) -> str:
    """name, with as many underscores after it as it takes to be none of those taken."""
    while name in taken:
        name += "_"
    return name


def check_count(n: int, least: int, what: str) -> None:
    if n < least:
        raise ValueError(f"{what} must be at least {least}, not {n}")
