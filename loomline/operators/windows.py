"""Chunks of a sequence: windows by count, runs of a key, parts between delimiters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..seq import Seq, Step, check_count


def _ordered(s: Seq, value: Column) -> Column:
    """The values of a group as an array in the sequence's order."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in s.order], value.alias("_v"))))
    return F.transform(rows, lambda r: r["_v"])


def _value(s: Seq, column: str | None) -> Column:
    if column:
        return F.col(column)
    return F.col(s.values[0]) if len(s.values) == 1 else F.struct(*[F.col(c) for c in s.values])


def partition(size: int, step: int | None = None, flush: bool = False, column: str | None = None, name: str = "xs") -> Step:
    """Windows of `size` elements, one beginning every `step` of them.

    Only full ones, but with flush also the one that the input's end breaks off,
    if it has an element that no full one has.  The new order is `k`, the
    window's number.  Rows go to their windows by index, so windows of any size
    take no global window but for the index.
    """
    step = size if step is None else step
    check_count(size, 1, "the size")
    check_count(step, 1, "the step")

    def apply(s: Seq) -> Seq:
        one = s.indexed("_i")
        value = _value(s, column)
        i, w, d = F.col("_i"), F.lit(size).cast("long"), F.lit(step).cast("long")
        low = F.greatest(F.lit(0).cast("long"), F.ceil((i - w + 1) / d).cast("long"))
        high = F.floor(i / d).cast("long")
        rows = one.df.where(low <= high).select(*s.by, "_i", value.alias("_v"), F.explode(F.sequence(low, high)).alias("k"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda r: r["_v"])
        chunks = rows.groupBy(*s.by, "k").agg(listed.alias(name), F.count("*").alias("_n"))
        if not flush:
            return s.with_df(chunks.where(F.col("_n") == size).drop("_n"), ("k",))
        n = F.col("_all")
        full = F.when(n < size, F.lit(0)).otherwise(F.floor((n - size) / step) + 1)
        consumed = F.when(full == 0, F.lit(0)).otherwise((full - 1) * step + size)
        sizes = s.df.groupBy(*s.by).agg(F.count("*").alias("_all")) if s.by else s.df.agg(F.count("*").alias("_all"))
        chunks = chunks.join(sizes, list(s.by)) if s.by else chunks.crossJoin(F.broadcast(sizes))
        keep = (F.col("_n") == size) | ((F.col("k") == full) & (n > consumed))
        return s.with_df(chunks.where(keep).drop("_n", "_all"), ("k",))

    return Step("partition", apply, expansive=step < size)


def consecutive(size: int, step: int = 1, column: str | None = None, name: str = "xs") -> Step:
    """Structs _1.._size of neighbours; as many as there are full windows.

    With step 1 each keeps the order of its first element; else the order is
    `k`, as of partition.
    """
    check_count(size, 1, "the size")
    check_count(step, 1, "the step")

    def apply(s: Seq) -> Seq:
        if step == 1:
            value = _value(s, column)
            ahead = s.following(size - 1, "_next", value) if size > 1 else s.with_df(s.df.withColumn("_next", F.array().cast("array<int>")))
            fields = [value.alias("_1"), *[F.get("_next", j).alias(f"_{j + 2}") for j in range(size - 1)]]
            df = ahead.df.where(F.size("_next") == size - 1).select(*s.keys, F.struct(*fields).alias(name))
            return ahead.with_df(df)
        chunks = partition(size, step, False, column, name)(s)
        return chunks.with_df(chunks.df.withColumn(name, F.struct(*[F.get(F.col(name), j).alias(f"_{j + 1}") for j in range(size)])))

    return Step("consecutive", apply)


def runs(key: Column, name: str = "run") -> Step:
    """Number the runs of consecutive equal keys (nulls are equal), from 0."""

    def apply(s: Seq) -> Seq:
        one = replace(s, keeps_blocks=True)
        before = one.with_df(one.df.withColumn("_k", key)).previous(_p=F.struct(F.col("_k").alias("k")))
        changed = F.col("_p").isNotNull() & ~F.col("_p.k").eqNullSafe(F.col("_k"))
        marked = before.with_df(before.df.withColumn("_c", changed.cast("long")).drop("_p", "_k"))
        out = marked.running(**{name: ("sum", F.col("_c"))})
        return out.with_df(out.df.drop("_c")).left(s)

    return Step("runs", apply, stable=True)


def partition_by(key: Column, column: str | None = None, name: str = "xs") -> Step:
    """Each run of consecutive equal keys as an array."""

    def apply(s: Seq) -> Seq:
        one = runs(key)(s)
        return s.with_df(one.df.groupBy(*s.by, "run").agg(_ordered(s, _value(s, column)).alias(name)), ("run",))

    return Step("partition_by", apply)


def ranges_by(key: Column) -> Step:
    """Each run of consecutive equal keys as its first and last index."""

    def apply(s: Seq) -> Seq:
        one = runs(key)(replace(s, keeps_blocks=True).indexed("_i"))
        return s.with_df(one.df.groupBy(*s.by, "run").agg(F.min("_i").alias("first"), F.max("_i").alias("last")), ("run",))

    return Step("ranges_by", apply)


def reduce_partition_by(key: Column, **aggregates: Column) -> Step:
    """Each run of consecutive equal keys, folded; no array is built."""

    def apply(s: Seq) -> Seq:
        one = runs(key)(s)
        return s.with_df(one.df.groupBy(*s.by, "run").agg(*[x.alias(n) for n, x in aggregates.items()]), ("run",))

    return Step("reduce_partition_by", apply)


def _chunks(s: Seq, delimiter: Column) -> Seq:
    hit = F.coalesce(delimiter, F.lit(False))
    marked = s.with_df(s.df.withColumn("_d", hit)).running(chunk=("sum", F.col("_d").cast("long")))
    return marked.with_df(marked.df.withColumn("chunk", F.col("chunk") - F.col("_d").cast("long")))


def split_by(delimiter: Column, keepend: bool = False, keepempty: bool = False, column: str | None = None, name: str = "xs") -> Step:
    """The parts between delimiters as arrays; none follows a delimiter that ends the input."""

    def apply(s: Seq) -> Seq:
        one = _chunks(s, delimiter)
        own = F.lit(True) if keepend else ~F.col("_d")
        row = F.when(own, F.struct(*[F.col(c) for c in s.order], _value(s, column).alias("_v")))
        out = one.df.groupBy(*s.by, "chunk").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["_v"]).alias(name))
        return s.with_df(out if keepempty else out.where(F.size(name) > 0), ("chunk",))

    return Step("split_by", apply)


def reduce_split_by(delimiter: Column, keepend: bool = False, keepempty: bool = False, **aggregates: Column) -> Step:
    """The parts between delimiters, each folded, the first and last like any other."""

    def apply(s: Seq) -> Seq:
        one = _chunks(s, delimiter)
        own = one.df if keepend else one.df.where(~F.col("_d"))
        out = own.groupBy(*s.by, "chunk").agg(*[x.alias(n) for n, x in aggregates.items()])
        if keepempty and not keepend:
            out = one.df.select(*s.by, "chunk").distinct().join(out, [*s.by, "chunk"], "left")
        return s.with_df(out, ("chunk",))

    return Step("reduce_split_by", apply)


def split_string(column: str, separator: str, name: str = "xs") -> Step:
    """Strings to the parts between a literal separator; without an empty part at the end."""

    def apply(s: Seq) -> Seq:
        parts = F.split(column, "\\Q" + separator + "\\E", -1)
        last = F.element_at(parts, -1) == ""
        return s.with_df(s.df.withColumn(name, F.when(last, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)))

    return Step("split_string", apply, stable=True)
