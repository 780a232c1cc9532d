"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its weight times all text over its own
text.  How often a document recurs is drawn from a Poisson distribution of that
mean by inverting it at a number hashed from the document's id and a seed, so a
run can be repeated, and a document's count depends on no other document but
through its source's rate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checked, cut, free_name, unit_sql, unwrapped, wrapped

#: Targets for sources that are given none share what is left in equal parts; with None all sources get equal shares.
WEIGHTS: dict[str, float] | None = None
SEED = 4
#: A Poisson distribution is inverted so many deviations, and so many repeats, either way of its mean: beyond lies less than a double can tell.
REACH, MORE = 10, 20


def rates(docs: DataFrame, weights: dict[str, float] | None = WEIGHTS) -> DataFrame:
    """(source, rate) of every source with text; a null source is a source as well, named 'null' in weights."""
    name = F.coalesce(F.col("source").cast("string"), F.lit("null"))
    sums = docs.select(name.alias("source"), F.length(F.col("text").cast("string")).cast("long").alias("n")).groupBy("source").agg(F.sum("n").alias("chars"))
    sums = sums.where("chars > 0")
    if weights:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, given double")
        sums = sums.join(given, "source", "left")
    else:
        sums = sums.withColumn("given", F.lit(None).cast("double"))
    totals = sums.agg(F.sum("chars").alias("all_chars"), F.coalesce(F.sum("given"), F.lit(0.0)).alias("claimed"), F.count_if(F.col("given").isNull()).alias("others"))
    rest = F.greatest(F.lit(0.0), 1 - F.col("claimed")) / F.col("others")
    weight = F.coalesce(F.col("given"), rest)
    return sums.crossJoin(F.broadcast(totals)).select("source", (weight * F.col("all_chars") / F.col("chars")).alias("rate"))  # totals: one row


def _log_factorial(j: Column) -> Column:
    """ln j!: looked up below 20, and by Stirling's series, exact to a double, from there on."""
    first = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(20)])
    x = F.greatest(j, F.lit(20)).cast("double")
    series = x * F.log(x) - x + F.log(x * (2 * math.pi)) / 2 + 1 / (x * 12) - 1 / (F.pow(x, 3) * 360) + 1 / (F.pow(x, 5) * 1260) - 1 / (F.pow(x, 7) * 1680)
    return F.when(j < 20, F.get(first, F.least(j, F.lit(19)).cast("int"))).otherwise(series)


def breakpoints(rates: DataFrame) -> DataFrame:
    """(source, low, cdf): the Poisson distribution of each rate, from low repeats on.

    A number u in [0, 1) stands for low repeats and as many more as entries of
    cdf lie at or below it.  An array has about twenty entries for each
    deviation of its rate.
    """
    each = rates.where("rate > 0").select("source", F.col("rate").alias("mean"))
    spread = F.sqrt("mean") * REACH + MORE
    each = each.select("source", "mean", F.greatest(F.lit(0).cast("long"), F.floor(F.col("mean") - spread)).alias("low"), F.ceil(F.col("mean") + spread).alias("high"))
    rows = each.select("*", F.explode(F.sequence("low", "high")).alias("j"))
    by = Window.partitionBy("source").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    p = F.exp(F.col("j") * F.log("mean") - F.col("mean") - _log_factorial(F.col("j")))
    rows = rows.withColumn("c", F.sum(p).over(by))
    return rows.groupBy("source", "low").agg(F.array_sort(F.collect_list("c")).alias("cdf"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = WEIGHTS, seed: int = SEED) -> DataFrame:
    """docs, each row as often as drawn, in globally shuffled order, and last `copy_no` from 0 (with underscores after it where docs has such a column).

    A row with null or empty text adds nothing to its source's size, but is
    drawn like the others of its source if that has any text; a source without
    text gives nothing.  Rows with one doc_id are drawn alike; a null id is an
    id like any other.
    """
    rows = _drawn(docs, cut(breakpoints(rates(docs, weights))), seed)
    return unwrapped(rows, docs.columns, F.col("_copy").alias(free_name("copy_no", docs.columns)))


def _drawn(docs: DataFrame, table: DataFrame, seed: int) -> DataFrame:
    """(_row, _copy): each row as often as drawn, shuffled."""
    size = table.agg(F.max(F.size("cdf"))).first()[0] or 0
    table = checked(table.select(F.col("source").alias("_source"), F.col("low").alias("_low"), F.col("cdf").alias("_cdf")), 64 + 8 * size)
    name = F.coalesce(F.col("_row.source").cast("string"), F.lit("null"))
    key = F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("null"))
    drawn = wrapped(docs).join(table, name == F.col("_source")).withColumn("_u", _unit(F.concat_ws("|", key, F.lit(str(seed)))))
    n = F.col("_low") + F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))
    drawn = drawn.withColumn("_n", n.cast("long")).where("_n > 0").select("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_copy"))
    place = F.xxhash64("_row.doc_id", "_copy", F.lit(seed))
    return drawn.withColumn("_place", place).repartition(F.col("_place")).sortWithinPartitions("_place")


def _unit(key):
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def replicate_sql(documents: str = "documents", seed: int = SEED, columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """DuckDB's way to replicate() with equal weights."""
    return f"""
    with s as (select coalesce(source, 'null') as source, sum(length(text)) as chars from {documents} group by all having sum(length(text)) > 0),
    r as (select source, (1.0::DOUBLE / count(*) over ()) * (sum(chars) over ())::DOUBLE / chars::DOUBLE as mean from s),
    b as (select source, mean, greatest(0, floor(mean - {REACH} * sqrt(mean) - {MORE}))::BIGINT as low from r),
    j as (select source, mean, low, unnest(range(low, ceil(mean + {REACH} * sqrt(mean) + {MORE})::BIGINT + 1)) as j from b),
    c as (select source, low, sum(exp(-mean + j * ln(mean) - lgamma(j + 1))) over (partition by source order by j) as c from j),
    a as (select source, low, list(c order by c) as cdf from c group by source, low),
    n as (select d.*, low + len(list_filter(cdf, lambda x: x <= {unit_sql('d.doc_id', seed=seed)})) as n from {documents} d join a on coalesce(d.source, 'null') = a.source)
    select {columns}, unnest(range(0, n)) as copy_no from n where n > 0"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents replicated to equal shares of the sources, with their columns as they are.

    Null and empty texts, null sources and ids, and repeated rows are treated
    as in replicate; an empty table stays empty.
    """
    return unwrapped(_drawn(docs, cut(breakpoints(rates(docs))), SEED), docs.columns)
