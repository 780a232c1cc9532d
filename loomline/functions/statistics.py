"""Statistics whose states are columns: they can be stored, and merged later.

moments: count, mean and sum of squares about it; counts of fixed bins; and
sketches of quantiles and of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def moments(x: Column) -> Column:
    """The state of mean and variance, as an aggregate."""
    x = x.cast("double")
    n = F.count(x)
    return F.struct(n.alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * n).alias("squares"))


def merged_moments(state: Column) -> Column:
    """The state of all that went into these states, as an aggregate: merged two by two, so no digits are lost to a large mean."""

    def pair(a: Column, b: Column) -> Column:
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        both = F.struct(n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"), (a["squares"] + b["squares"] + gap * gap * a["n"] * b["n"] / n).alias("squares"))
        return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("squares"))
    return F.aggregate(F.array_sort(F.collect_list(state)), none, pair)


def mean(state: Column) -> Column:
    return state["mean"]


def variance(state: Column) -> Column:
    return F.when(state["n"] > 1, state["squares"] / (state["n"] - 1))


def histogram(x: Column, edges: Sequence[float]) -> Column:
    """How many values lie in each bin, as an aggregate: below the first edge, from each edge up to before the next, and from the last on; nulls in none."""
    bounds = [None, *edges, None]
    return F.array(*[F.count_if((F.lit(True) if a is None else x >= a) & (F.lit(True) if b is None else x < b) & x.isNotNull()) for a, b in zip(bounds, bounds[1:])])


def merged_histogram(state: Column, bins: int) -> Column:
    return F.array(*[F.sum(F.get(state, i)) for i in range(bins)])


def quantile_sketch(x: Column) -> Column:
    """A mergeable sketch of quantiles; merged_quantiles joins them."""
    return F.call_function("kll_sketch_agg_double", x.cast("double"))


def merged_quantiles(sketch: Column) -> Column:
    return F.call_function("kll_merge_agg_double", sketch)


def quantile(sketch: Column, share: float) -> Column:
    return F.call_function("kll_sketch_get_quantile_double", sketch, F.lit(share))


def distinct_sketch(x: Column) -> Column:
    return F.hll_sketch_agg(x)


def merged_distinct(sketch: Column) -> Column:
    """The estimated number of distinct values of all that went into the sketches."""
    return F.hll_sketch_estimate(F.hll_union_agg(sketch))
