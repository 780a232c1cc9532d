"""Grouped folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..seq import Seq, Step


def group_by(s: Seq, /, *keys: Column | str, where: Column | None = None, **aggregates: Column) -> DataFrame:
    """The final table: an aggregate row for each key.

    Elements that `where` rejects start no group, so a group without any other
    is absent.
    """
    df = s.df if where is None else s.df.where(where)
    return df.groupBy(*s.by, *keys).agg(*[x.alias(n) for n, x in aggregates.items()])


def group_running(*keys: str, **columns: tuple[str, Column]) -> Step:
    """After each element its group's new state; the last change of each key makes the final table."""

    def apply(s: Seq) -> Seq:
        out = s.grouped(*s.by, *keys).running(**columns)
        return Seq(out.df.select(*s.keys, *[k for k in keys if k not in s.keys], *columns), s.order, s.by, s.block_bytes)

    return Step("group_running", apply, stable=True)


def group_until(s: Seq, /, *keys: str, state: tuple[str, Column], stop: Column, **aggregates: Column) -> DataFrame:
    """The table at the first element after which some group's state (column `state`) meets `stop`.

    That ends the whole stream: groups that begin later don't appear.
    """
    run = s.grouped(*s.by, *keys).running(state=state)
    whole = Seq(run.df, s.order, s.by, s.block_bytes)
    kept = whole.against_cut(stop, lambda at, cut: cut.isNull() | (at <= cut))
    return kept.df.groupBy(*s.by, *keys).agg(*[x.alias(n) for n, x in aggregates.items()])


def per_group(step: Step, *keys: str) -> Step:
    """A step, with state or without, on each group by itself."""

    def apply(s: Seq) -> Seq:
        return step(s.grouped(*s.by, *keys))

    return Step(f"per_group({step.name})", apply, step.expansive, step.stable)


def get_group(table: DataFrame, key: str, wanted: DataFrame, value: str, default: Column) -> DataFrame:
    """The values of the wanted keys (a column of that name), or the default for a group that there isn't."""
    found = table.select(F.col(key), F.col(value).alias("_v"), F.lit(True).alias("_hit"))
    return wanted.join(found, key, "left").select(key, F.when(F.col("_hit"), F.col("_v")).otherwise(default).alias(value))
