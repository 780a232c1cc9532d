"""Steps that give any number of elements for one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..seq import Seq, Step, check_count, free


def map_cat(expr: Column, name: str = "x", pos: str = "pos", keep: bool = False) -> Step:
    """The elements of an array for each element; the place inside it joins the order."""

    def apply(s: Seq) -> Seq:
        at = free(pos, s.order)
        rest = [c for c in s.values if c != name] if keep else []
        out = s.with_df(s.df.select(*s.keys, *rest, F.posexplode(expr).alias(at, name)), (*s.order, at))
        return replace(out, cuts=None)  # it may be much larger

    return Step("map_cat", apply, expansive=True)


def map_table(function: Callable, *arguments: Column, pos: str = "pos") -> Step:
    """The rows that a table function (made with udtf) gives for each element, in place of the element's values.

    The function's first column must be the place of a row among those given;
    it joins the order as `pos`.  An element for which it gives none vanishes.
    """

    def apply(s: Seq) -> Seq:
        at, (first, *rest) = free(pos, s.keys), function.returnType.fieldNames()
        # the keys go as one struct, so no name of the function's clashes with theirs
        given = [f"_a{i}" for i in range(len(arguments))]
        rows = s.df.select(F.struct(*s.keys).alias("_keys"), *[a.alias(n) for a, n in zip(arguments, given)]).lateralJoin(function(*[F.col(n).outer() for n in given]))
        out = rows.select(*[F.col("_keys")[k].alias(k) for k in s.keys], F.col(first).alias(at), *rest)
        return replace(s.with_df(out, (*s.order, at)), cuts=None)

    return Step("map_table", apply, expansive=True)


def cat(column: str = "x", name: str | None = None) -> Step:
    """Concatenate the arrays of a column; empty and null ones vanish."""
    return map_cat(F.col(column), name or column)


def tcat(column: str = "x", basesize: int = 1) -> Step:
    """cat whose elements are spread over the cluster again, for a few large arrays."""
    check_count(basesize, 1, "the base size")

    def apply(s: Seq) -> Seq:
        out = cat(column)(s)
        return out.with_df(out.df.repartition(*out.order))

    return Step("tcat", apply, expansive=True)
