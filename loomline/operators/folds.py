"""Folds: a sequence to one value, or one for each group."""

from __future__ import annotations

import copy
import dataclasses
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.monoids import MONOIDS
from ..seq import EmptyResultError, Seq, Step, ended, identity
from ..shipping import ship

#: Stands for no initial value; "identity" asks for the operation's own, and "optional" for that if it has one.
NONE = object()


@dataclass(frozen=True)
class Copied:
    """An initial value of a Reducer that every task gets a copy of, so a fold may change it and it can be used again."""

    value: object

    def __call__(self) -> object:
        return copy.deepcopy(self.value)


def _start(kind: str, init) -> Column | None:
    if init is NONE or (isinstance(init, str) and init == "optional" and MONOIDS[kind].identity is None):
        return None
    if isinstance(init, str) and init == "optional":
        init = "identity"
    if callable(init) and not isinstance(init, Column):
        init = init()
    return init if isinstance(init, Column) else F.lit(MONOIDS[kind].start() if init == "identity" else init)


def fold(s: Seq, kind: str, x: Column, init=NONE, name: str = "value") -> DataFrame:
    """(by..., value, n): the fold, and of how many elements; null of none without an initial value.

    An initial value goes first and counts even if it is no identity.
    """
    value = MONOIDS[kind].aggregate(x, s.place())
    first = _start(kind, init)
    if first is not None:
        some = F.count("*") > 0
        joined = MONOIDS[kind].combine(first, value)
        value = F.when(some & value.isNotNull(), joined).otherwise(first)
    return (s.df.groupBy(*s.by) if s.by else s.df.groupBy()).agg(value.alias(name), F.count("*").alias("n"))


def fold_value(s: Seq, kind: str, x: Column, init=NONE):
    """The fold as a Python value; EmptyResultError of nothing without an initial value."""
    row = fold(s, kind, x, init).first()
    if row is None or (init is NONE and row["n"] == 0):
        raise EmptyResultError(f"{kind} of no element, and no initial value")
    return row["value"]


def transduce(step: Step, kind: str, x: Column, s: Seq, init=NONE) -> DataFrame:
    """(by..., value, n, terminated): a step and then a fold, in one plan, and whether the step ended it early."""
    out, stopped = fold(step(s), kind, x, init), ended(step, s)
    if s.by:
        return out.join(stopped, list(s.by))
    return out.crossJoin(F.broadcast(stopped))  # one row


def if_unreduced(result: DataFrame, f: Callable[[Column], Column], name: str = "value") -> DataFrame:
    """The result of transduce, with f of it where it was not ended early."""
    return result.withColumn(name, F.when(F.col("terminated"), F.col(name)).otherwise(f(F.col(name))))


def foldl(s: Seq, f: Callable[[Column, Column], Column], x: Column, init: Column | None = None, name: str = "value") -> DataFrame:
    """A left fold with a function that needn't be associative, over each group's elements in order, as an array."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in s.order], x.alias("_v"))))
    g = (s.df.groupBy(*s.by) if s.by else s.df.groupBy()).agg(rows.alias("_l"))
    if init is None:
        tail = F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0)))
        value = F.when(F.size("_l") > 0, F.aggregate(tail, F.get("_l", 0)["_v"], lambda a, r: f(a, r["_v"])))
    else:
        value = F.aggregate("_l", init, lambda a, r: f(a, r["_v"]))
    return g.select(*s.by, value.alias(name))


def tee(s: Seq, /, **aggregates: Column) -> DataFrame:
    """Many folds in one pass; each may filter for itself with reducing(where=...)."""
    return (s.df.groupBy(*s.by) if s.by else s.df.groupBy()).agg(*[x.alias(n) for n, x in aggregates.items()])


def tee_started(s: Seq, /, **filters: Column) -> DataFrame:
    """Whether every branch of a tee, given its filter, met an element: else the tee is empty."""
    met = [F.count_if(c) > 0 for c in filters.values()]
    both = met[0]
    for m in met[1:]:
        both &= m
    return (s.df.groupBy(*s.by) if s.by else s.df.groupBy()).agg(both.alias("started"))


def product(s: Seq, column: str, *kinds: str) -> DataFrame:
    """The i-th fold over the i-th field of a struct."""
    fields = s.df.schema[column].dataType.fieldNames()
    parts = [MONOIDS[k].aggregate(F.col(column)[n], s.place()).alias(n) for k, n in zip(kinds, fields, strict=True)]
    return (s.df.groupBy(*s.by) if s.by else s.df.groupBy()).agg(F.struct(*parts).alias(column)).select(*s.by, f"{column}.*")


def to_set(s: Seq) -> DataFrame:
    return s.df.select(*s.by, *s.values).distinct()


def to_dict(s: Seq, key: str, value: str) -> DataFrame:
    """(key, value), where the last value of a key wins."""
    last = s.df.groupBy(*s.by, key).agg(F.max_by(F.struct(F.col(value).alias("v")), s.place()).alias("_l"))
    return last.select(*s.by, key, F.col("_l.v").alias(value))


# -- folds in Python


@dataclass(frozen=True)
class Reducer:
    """A fold of any kind: a fresh state, the next state for a row, the merge of two neighbouring states, the result.

    next needn't be associative; combine must be, and need not commute: states
    are merged in order.  basecase finishes what one task has folded.
    """

    next: Callable
    combine: Callable
    init: Callable[[], object] | None = None
    start: Callable | None = None
    basecase: Callable | None = None
    complete: Callable | None = None

    def wheninit(self, f: Callable[[], object]) -> Reducer:
        return dataclasses.replace(self, init=f)

    def whenstart(self, f: Callable) -> Reducer:
        return dataclasses.replace(self, start=f)

    def whencombine(self, f: Callable) -> Reducer:
        return dataclasses.replace(self, combine=f)

    def whencompletebasecase(self, f: Callable) -> Reducer:
        return dataclasses.replace(self, basecase=f)

    def whencomplete(self, f: Callable) -> Reducer:
        return dataclasses.replace(self, complete=f)


def _fresh(r: Reducer):
    state = r.init() if r.init else None
    return r.start(state) if r.start else state


def reduce_python(s: Seq, reducer: Reducer, schema: str, step: Step = identity, parts: int | None = None) -> DataFrame:
    """The reducer's result over the sequence, as one row of `schema` (none for an empty sequence without init).

    Ranges of the order are folded by tasks of their own and merged in their
    order by one, which gets a state for each range.
    """
    ship(s.df.sparkSession)
    seq = step(s)
    n = parts or int(seq.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = seq.values
    rows = seq.df.repartitionByRange(n, *seq.order).sortWithinPartitions(*seq.order).select(*seq.order, *values)
    rows = rows.withColumn("_part", F.spark_partition_id())

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, part = None, None
        for pdf in batches:
            for p, row in zip(pdf["_part"], pdf[values].itertuples(index=False)):
                if part is None:
                    part, state = int(p), _fresh(reducer)
                state = reducer.next(state, row)
        if part is not None:
            yield pd.DataFrame({"part": [part], "state": [pickle.dumps(reducer.basecase(state) if reducer.basecase else state)]})

    def root(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states = sorted(((int(p), b) for pdf in batches for p, b in zip(pdf["part"], pdf["state"])), key=lambda x: x[0])
        if not states:
            if not reducer.init:
                return
            state = _fresh(reducer)
        else:
            state = pickle.loads(states[0][1])
            for _, b in states[1:]:
                state = reducer.combine(state, pickle.loads(b))
        out = reducer.complete(state) if reducer.complete else state
        yield pd.DataFrame([out if isinstance(out, tuple) else (out,)], columns=columns)

    columns = s.df.sparkSession.createDataFrame([], schema).columns
    states = rows.mapInPandas(leaf, "part int, state binary")
    return states.repartition(1).mapInPandas(root, schema)
