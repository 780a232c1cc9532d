"""Steps that cut a sequence by place or at a condition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..seq import BROADCAST_ROWS, Seq, Step, check_count, ended


def _ends(s: Seq, n: int, last: bool) -> Seq:
    """The first or last n elements."""
    way = [F.desc(c) if last else F.asc(c) for c in s.order]
    if s.by:
        from pyspark.sql.window import Window

        df = s.df.withColumn("_r", F.row_number().over(Window.partitionBy(*s.by).orderBy(*way)))
        return s.with_df(df.where(F.col("_r") <= n).drop("_r"))
    return s.with_df(s.df.orderBy(*way).limit(n))


def take(n: int) -> Step:
    check_count(n, 0, "the number of elements")
    return Step("take", lambda s: _ends(s, n, False), ends=lambda s: F.count("*") >= n)


def take_last(n: int) -> Step:
    check_count(n, 0, "the number of elements")
    return Step("take_last", lambda s: _ends(s, n, True))


def _without_ends(s: Seq, n: int, last: bool) -> Seq:
    if n == 0:
        return s
    if s.by:
        from pyspark.sql.window import Window

        way = [F.desc(c) if last else F.asc(c) for c in s.order]
        df = s.df.withColumn("_r", F.row_number().over(Window.partitionBy(*s.by).orderBy(*way)))
        return s.with_df(df.where(F.col("_r") > n).drop("_r"))
    if n > BROADCAST_ROWS:
        one = s.indexed("_i")
        if not last:
            return one.with_df(one.df.where(F.col("_i") >= n).drop("_i"))
        size = s.df.agg(F.count("*").alias("_n"))
        return one.with_df(one.df.crossJoin(F.broadcast(size)).where(F.col("_i") < F.col("_n") - n).drop("_i", "_n"))
    # the place of the n-th element is one row: no window over everything
    edge = _ends(s, n, last).df.agg((F.min if last else F.max)(s.place()).alias("_edge"))
    beyond = s.place() < F.col("_edge") if last else s.place() > F.col("_edge")
    return s.with_df(s.df.crossJoin(F.broadcast(edge)).where(beyond).drop("_edge"))


def drop(n: int) -> Step:
    check_count(n, 0, "the number of elements")
    return Step("drop", lambda s: _without_ends(s, n, False))


def drop_last(n: int) -> Step:
    check_count(n, 0, "the number of elements")
    return Step("drop_last", lambda s: _without_ends(s, n, True))


def take_nth(n: int) -> Step:
    """The first element and every n-th after it."""
    check_count(n, 1, "the distance")

    def apply(s: Seq) -> Seq:
        one = s.indexed("_i")
        return one.with_df(one.df.where(F.col("_i") % n == 0).drop("_i"))

    return Step("take_nth", apply)


def _not(predicate: Column) -> Column:
    return ~F.coalesce(predicate, F.lit(False))


def take_while(predicate: Column) -> Step:
    """Up to the first element for which it isn't true."""
    return Step("take_while", lambda s: s.against_cut(_not(predicate), lambda at, cut: cut.isNull() | (at < cut)), ends=lambda s: F.bool_or(_not(predicate)))


def drop_while(predicate: Column) -> Step:
    return Step("drop_while", lambda s: s.against_cut(_not(predicate), lambda at, cut: at >= cut))


def reduce_if(predicate: Column) -> Step:
    """Up to the first element for which it is true, that one too."""
    return Step("reduce_if", lambda s: s.against_cut(predicate, lambda at, cut: cut.isNull() | (at <= cut)), ends=lambda s: F.bool_or(predicate))


def abort_if(predicate: Column) -> Step:
    """Up to before the first element for which it is true."""
    return Step("abort_if", lambda s: s.against_cut(predicate, lambda at, cut: cut.isNull() | (at < cut)), ends=lambda s: F.bool_or(predicate))


def terminated(step: Step, s: Seq) -> bool:
    """Whether the step ends the sequence, or one of its groups, early."""
    return bool(ended(step, s).where("terminated").head(1))
