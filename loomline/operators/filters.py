"""Steps that keep some elements as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..seq import Seq, Step


def filter_(predicate: Column) -> Step:
    """Keep where true; a null predicate drops."""
    return Step("filter", lambda s: s.with_df(s.df.where(predicate)))


def not_null(*columns: str) -> Step:
    """Drop elements of which one of these is missing (all values, if none is named)."""

    def apply(s: Seq) -> Seq:
        return s.with_df(s.df.dropna(subset=list(columns or s.values)))

    return Step("not_null", apply)


def of_type(column: str, *tags: str) -> Step:
    """Of a struct of alternatives, keep elements that have all of these, and unwrap a single one."""

    def apply(s: Seq) -> Seq:
        kept = s.df.where(" and ".join(f"`{column}`.`{t}` is not null" for t in tags))
        return s.with_df(kept.withColumn(column, F.col(column)[tags[0]])) if len(tags) == 1 else s.with_df(kept)

    return Step("of_type", apply)


def keep_something(expr: Column, present: Column | None = None, name: str = "x") -> Step:
    """Map, and drop what is nothing.

    Nothing is null, unless present tells what there is: then a null may be kept.
    """

    def apply(s: Seq) -> Seq:
        if present is not None:
            return s.with_df(s.df.where(present)).select(expr.alias(name))
        mapped = s.select(expr.alias(name))
        return mapped.with_df(mapped.df.where(F.col(name).isNotNull()))

    return Step("keep_something", apply)


keep = keep_something


def unique(*keys: Column | str) -> Step:
    """The first element for each key, in order; the whole value is the key if none is given.

    An aggregation that combines before it shuffles, not a window.
    """

    def apply(s: Seq) -> Seq:
        cols = [F.col(k) if isinstance(k, str) else k for k in (keys or s.values)]
        row = F.struct(*[F.col(c) for c in s.df.columns])
        first = s.df.groupBy(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(s.by)], *[k.alias(f"_k{i}") for i, k in enumerate(cols)])
        return s.with_df(first.agg(F.min_by(row, s.place()).alias("_r")).select("_r.*"))

    return Step("unique", apply)


distinct = unique


def dedupe(*keys: Column | str) -> Step:
    """Drop an element that equals the one before it (nulls are equal)."""

    def apply(s: Seq) -> Seq:
        cols = [F.col(k) if isinstance(k, str) else k for k in (keys or s.values)]
        # the struct tells the first element from one after a null
        before = s.previous(_p=F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)]))
        same = F.col("_p").isNotNull()
        for i, c in enumerate(cols):
            same &= F.col(f"_p.k{i}").eqNullSafe(c)
        return before.with_df(before.df.where(~same).drop("_p"))

    return Step("dedupe", apply)
