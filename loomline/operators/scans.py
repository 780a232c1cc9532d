"""Running state, and several branches over one input."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..seq import BLOCK, RUNNING, Seq, Step
from ..shipping import ship


def scan(kind: str | Callable[[Column, Column], Column], column: str, init: Column | None = None, name: str = "x") -> Step:
    """The inclusive prefix fold, f(init, x1) first.

    A kind of RUNNING goes through windows.  A function of columns folds the
    array of all elements so far, which costs the square of a group's length:
    for long groups write it as scan_emit.
    """

    def apply(s: Seq) -> Seq:
        x = F.col(column)
        if isinstance(kind, str):
            out = s.running(_x=(kind, x))
            value = F.col("_x") if init is None else RUNNING[kind].combine(init, F.col("_x"))
            return out.select(value.alias(name))
        items = F.collect_list(F.struct(x.alias("v"))).over(s.so_far())
        if init is None:
            value = F.aggregate(F.slice(F.col("_l"), 2, F.greatest(F.size("_l") - 1, F.lit(0))), F.col("_l")[0]["v"], lambda a, r: kind(a, r["v"]))
        else:
            value = F.aggregate("_l", init, lambda a, r: kind(a, r["v"]))
        return s.with_df(s.df.withColumn("_l", items)).select(value.alias(name))

    return Step("scan", apply, stable=True)


def running_stat(kind: str, column: str, name: str = "x") -> Step:
    """A statistic of all elements so far: mean, variance, deviation, sum, count, min, max; null for fewer than it takes.

    Of a sequence in blocks, each block has its own count, mean and sum of
    squares about it; those of the blocks before are merged pair by pair, so a
    variance keeps its digits however large the mean is.
    """
    if kind in ("sum", "count", "min", "max"):
        return Step(f"running_{kind}", lambda s: s.running(_x=(kind, F.col(column))).select(F.col("_x").alias(name)), stable=True)
    least = {"mean": 0, "variance": 1, "deviation": 1}[kind]

    def apply(given: Seq) -> Seq:
        x = F.col(column).cast("double")
        s = given.blocked()
        w = s.so_far()
        n, mean, squares = F.count(x).over(w), F.avg(x).over(w), F.var_pop(x).over(w) * F.count(x).over(w)
        df = s.df.withColumns({"_n": n, "_m": mean, "_q": squares})
        if s.is_blocked:
            totals = s.df.groupBy(BLOCK).agg(F.count(x).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(x)).alias("q"))
            ship(s.df.sparkSession)
            # a row for each block
            carry = totals.repartition(1).sortWithinPartitions(BLOCK).mapInPandas(_moments_before, f"{BLOCK} int, _bn long, _bm double, _bq double")
            df = df.join(F.broadcast(carry), BLOCK)
            a, b = F.col("_bn"), F.col("_n")
            gap = F.col("_m") - F.col("_bm")
            both = F.struct((a + b).alias("n"), (F.col("_bm") + gap * b / (a + b)).alias("m"), (F.col("_q") + F.col("_bq") + gap * gap * a * b / (a + b)).alias("q"))
            merged = F.when(a == 0, F.struct(b.alias("n"), F.col("_m").alias("m"), F.col("_q").alias("q"))).when(b == 0, F.struct(a.alias("n"), F.col("_bm").alias("m"), F.col("_bq").alias("q"))).otherwise(both)
            df = df.withColumn("_s", merged).withColumns({"_n": F.col("_s.n"), "_m": F.col("_s.m"), "_q": F.col("_s.q")})
        variance = F.col("_q") / (F.col("_n") - 1)
        value = {"mean": F.col("_m"), "variance": variance, "deviation": F.sqrt(variance)}[kind]
        return s.with_df(df).select(F.when(F.col("_n") > least, value).alias(name)).left(given)

    return Step(f"running_{kind}", apply, stable=True)


def _moments_before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the blocks before each: count, mean, and sum of squares about the mean."""
    n, mean, squares = 0, 0.0, 0.0
    for pdf in batches:
        out = []
        for block, k, m, q in pdf.itertuples(index=False):
            out.append((block, n, mean, squares))
            if k:
                gap = m - mean
                n += k
                mean += gap * k / n
                squares += q + gap * gap * k * (n - k) / n
        yield pd.DataFrame(out, columns=[BLOCK, "_bn", "_bm", "_bq"])


def adhoc(f: Callable, init: Callable[[], object], schema: str, onlast: Callable | None = None) -> Step:
    """Any stateful step in Python: f(state, row) -> (state, rows to give), and onlast(state) -> rows at the end.

    Rows are namedtuples of the values; what is given are tuples for `schema`.
    Each group, or the whole sequence without groups, is read in order in
    batches, so only the state is held.  The new order is the row's own order
    and `pos`, the place of a row among those given for it; rows of onlast come
    last.
    """

    def apply(s: Seq) -> Seq:
        ship(s.df.sparkSession)
        keys, values = list(s.keys), s.values
        by, order = list(s.by), list(s.order)
        sorted_rows = (s.df.repartition(*by) if by else s.df.repartition(1)).sortWithinPartitions(*keys).select(*keys, *values)

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            group: tuple | None = None
            state, at = None, None

            def last() -> list[tuple]:
                return [(*at, j, True, *r) for j, r in enumerate(onlast(state))] if onlast and group is not None else []

            for pdf in batches:
                out = []
                own = [tuple(r) for r in pdf[keys].astype(object).itertuples(index=False)]
                for key, row in zip(own, pdf[values].itertuples(index=False)):
                    if group is None or key[: len(by)] != group:
                        out += last()
                        group, state = key[: len(by)], init()
                    state, given = f(state, row)
                    at = key
                    out += [(*key, j, False, *r) for j, r in enumerate(given)]
                if out:
                    yield pd.DataFrame(out, columns=columns)
            if out := last():
                yield pd.DataFrame(out, columns=columns)

        types = dict(s.df.dtypes)
        head = ", ".join(f"`{k}` {types[k]}" for k in keys)
        pos = "pos"
        while pos in keys:
            pos += "_"
        full = f"{head}, `{pos}` int, _last boolean, {schema}"
        columns = s.df.sparkSession.createDataFrame([], full).columns
        made = sorted_rows.mapInPandas(work, full)
        # rows of the end follow all that the same element gave
        made = made.withColumn(pos, F.when(F.col("_last"), F.col(pos) + F.lit(1 << 30)).otherwise(F.col(pos))).drop("_last")
        return s.with_df(made, (*order, pos))

    return Step("adhoc", apply, expansive=True)


def scan_emit(f: Callable, init: object, schema: str, onlast: Callable | None = None) -> Step:
    """A Mealy machine: f(state, row) -> (output, state); onlast(state) -> one last output."""

    def one(state, row):
        y, state = f(state, row)
        return state, [y if isinstance(y, tuple) else (y,)]

    def end(state):
        y = onlast(state)
        return [y if isinstance(y, tuple) else (y,)]

    return Step("scan_emit", adhoc(one, lambda: init, schema, end if onlast else None).apply, expansive=onlast is not None)


def _carried(s: Seq, **columns: Column) -> Seq:
    """With columns that every step keeps: they stand behind the order, which is total without them."""
    return s.with_df(s.df.withColumns(columns), (*s.order, *columns))


def zip_source(step: Step, name: str = "source") -> Step:
    """Each output of the step beside the element that it comes from."""

    def apply(s: Seq) -> Seq:
        out = step(_carried(s, **{name: F.struct(*[F.col(c) for c in s.values])}))
        return out.with_df(out.df, [c for c in out.order if c != name])

    return Step("zip_source", apply, step.expansive, step.stable)


def zip_(**branches: Step) -> Step:
    """The outputs of several branches side by side, each of one value.

    A branch sees the elements that the branches before it gave something for,
    so a filter in any of them drops the element, but a counter before it counts
    it.
    """

    def apply(s: Seq) -> Seq:
        source = s.values
        # cut before, as the order then has the values too
        now = _carried(replace(s.cut(), keeps_blocks=True), _src=F.struct(*[F.col(c) for c in source]))
        for name, step in branches.items():
            out = step(now)
            value = F.col(out.values[0]) if len(out.values) == 1 else F.struct(*[F.col(c) for c in out.values])
            held = [c for c in out.order if c.startswith("_z_")]
            df = out.df.select(*[F.col(c) for c in (*s.by, *out.order, *([BLOCK] if out.is_blocked else []))], value.alias(f"_z_{name}"), *[F.col("_src")[c].alias(c) for c in source])
            base = [c for c in out.order if c not in held and c != "_src"]
            now = out.with_df(df, (*base, "_src", *held, f"_z_{name}"))
        order = [c for c in now.order if c != "_src" and not c.startswith("_z_")]
        out = now.df.select(*s.by, *order, *([BLOCK] if now.is_blocked else []), *[F.col(f"_z_{n}").alias(n) for n in branches])
        return now.with_df(out, order).left(s)

    return Step("zip", apply, any(b.expansive for b in branches.values()), all(b.stable for b in branches.values()))
