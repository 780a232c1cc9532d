"""Steps on small sequences, with results known from their definitions; every one also over shuffled rows and in blocks."""

import dataclasses
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loomline.functions.monoids import MONOIDS
from loomline.operators import filters as fi
from loomline.operators import flatten as fl
from loomline.operators import grouping as gr
from loomline.operators import projections as pr
from loomline.operators import scans as sc
from loomline.operators import slices as sl
from loomline.operators import windows as wi
from loomline import executors
from loomline.functions import statistics
from loomline.operators.folds import Copied, Reducer, fold_value, foldl, if_unreduced, product, reduce_python, to_dict, transduce
from loomline.seq import EmptyResultError, IdentityNotDefinedError, compose, identity
from loomline.sources.inputs import RangeSource, as_seq, concat, from_tuple, from_values, generated, register, register_source, zipped
from loomline.sources.inputs import product as product_source
from loomline.sources.sinks import append, append_widen, collect, copy_pandas, foreach, iterate, map_into, with_progress, write

x = F.col("x")


@F.udtf(returnType="x int, digit string")
class digits:
    """Its first column is called as the sequence's, which must do no harm."""

    def eval(self, v: int):
        for i, digit in enumerate(str(v)):
            yield i, digit


odd = fi.filter_(x % 2 == 1)


def plain(rows):
    return [tuple(r) if isinstance(r, tuple) else r for r in rows]


CASES = {
    "take": (range(1, 6), sl.take(3), [1, 2, 3]),
    "take more than there is": (range(1, 6), sl.take(10), [1, 2, 3, 4, 5]),
    "take none": (range(1, 6), sl.take(0), []),
    "take last": (range(1, 6), sl.take_last(2), [4, 5]),
    "take last none": (range(1, 6), sl.take_last(0), []),
    "drop": (range(1, 6), sl.drop(3), [4, 5]),
    "drop then take": (range(1, 11), sl.drop(2) >> sl.take(3), [3, 4, 5]),
    "take odd": (range(101), odd >> sl.take(10), list(range(1, 20, 2))),
    "drop last": (range(1, 11), sl.drop_last(3), list(range(1, 8))),
    "every third": (range(1, 11), sl.take_nth(3), [1, 4, 7, 10]),
    "drop while": (range(1, 11), sl.drop_while(x % 3 != 0), list(range(3, 11))),
    "drop while always": ([1, 2], sl.drop_while(x > 0), []),
    "take while": ([1, 2, 3, 1], sl.take_while(x < 3), [1, 2]),
    "reduce if": (range(1, 11), sl.reduce_if(x == 3), [1, 2, 3]),
    "abort if": (range(1, 11), sl.abort_if(x == 3), [1, 2]),
    "cat": ([[3, 2], [], None, [5]], fl.cat("x"), [3, 2, 5]),
    "tcat": ([[3, 2], [5]], fl.tcat("x", 1), [3, 2, 5]),
    "cat then drop while": ([[1, 2, 3, 4, 5], [1, 2]], fl.cat("x") >> sl.drop_while(x < 3), [3, 4, 5, 1, 2]),
    "reverse and cat": ([[3, 2, 1, 0], [6, 5, 4], [9, 8, 7]], pr.map_(x=F.reverse("x")) >> fl.cat("x"), list(range(10))),
    "runs": (range(1, 6), wi.partition_by(x == 3), [[1, 2], [3], [4, 5]]),
    "reduced runs": (range(1, 7), wi.reduce_partition_by(F.floor(x / 3), n=F.count("*")), [2, 3, 1]),
    "scan max": ([0, -1, 3, -2, 1], sc.scan("max", "x"), [0, 0, 3, 3, 3]),
    "scan min": ([0, -1, 3, -2, 1], sc.scan("min", "x"), [0, -1, -1, -2, -2]),
    "scan sum": ([1, None, 3], sc.scan("sum", "x"), [1, 1, 4]),
    "scan by function": ([1, 2, 3, 4], sc.scan(lambda a, b: a - b, "x"), [1, -1, -4, -8]),
    "scan product": ([1, 2, 3, 4], sc.scan("product", "x"), [1.0, 2.0, 6.0, 24.0]),
    "zip": ([10, None, 20], sc.zip_(n=pr.count(), x=fi.not_null("x")), [(1, 10), (3, 20)]),
    "replace": ([1, 2, 3], pr.replace("x", {1: 10, 2: 20}), [10, 20, 3]),
    "unique": ([1, 1, 2, -1, 3, 2], fi.unique(x * x), [1, 2, 3]),
    "dedupe": ([1, 1, 2, None, None, 2], fi.dedupe("x"), [1, 2, None, 2]),
    "dedupe after null": ([None, 1], fi.dedupe("x"), [None, 1]),
    "tumbling": (range(1, 11), wi.partition(3), [[1, 2, 3], [4, 5, 6], [7, 8, 9]]),
    "sliding": (range(1, 5), wi.partition(3, 1), [[1, 2, 3], [2, 3, 4]]),
    "flush": (range(1, 6), wi.partition(2, flush=True), [[1, 2], [3, 4], [5]]),
    "enumerate": ([2, 4, 6], pr.enumerate_(10, 20), [(2, 10), (4, 30), (6, 50)]),
    "count": ([7, 7], pr.count(), [1, 2]),
    "iterated": ([0, 0, 0], pr.iterated(lambda v: v * 2, F.lit(1).cast("long")), [1, 2, 4]),
    "interpose": ([1, 2, 3], pr.interpose(F.lit(0)), [1, 0, 2, 0, 3]),
    "flag first": ([5, 6], pr.flag_first("f"), [(5, True), (6, False)]),
    "consecutive": (range(1, 5), wi.consecutive(2), [(1, 2), (2, 3), (3, 4)]),
    "consecutive of too few": ([1], wi.consecutive(2), []),
    "consecutive nulls": ([None, 1, None], wi.consecutive(2), [(None, 1), (1, None)]),
    "split": (range(1, 6), wi.split_by(x == 3), [[1, 2], [4, 5]]),
    "split keepempty": ([3, 1, 3, 3], wi.split_by(x == 3, keepempty=True), [[], [1], []]),
    "split keepend": ([1, 3, 2], wi.split_by(x == 3, keepend=True), [[1, 3], [2]]),
    "reduced split": ([3, 1, 2, 3, 4], wi.reduce_split_by(x == 3, s=F.sum("x")), [3, 4]),
    "zip source": ([1, 2, 3, 4], sc.zip_source(odd >> pr.map_(y=x * 10)) >> pr.map_(y=F.col("y"), s=F.col("source.x")), [(10, 1), (30, 3)]),
    "get index": ([2, 1], pr.get_index("x", ["a", "b"]), ["b", "a"]),
    "get index out of range": ([3, 1], pr.get_index("x", ["a", "b"], inbounds=True), [None, "a"]),
    "keep something": ([1, 2, 3], fi.keep_something(F.when(x > 1, x * 2)), [4, 6]),
    "keep a null": ([1, 2], fi.keep_something(F.lit(None).cast("long"), present=x > 1), [None]),
    "running mean": ([1, 3, None], sc.running_stat("mean", "x"), [1.0, 2.0, 2.0]),
    "running mean of nothing yet": ([None, 4], sc.running_stat("mean", "x"), [None, 4.0]),
    "running variance": ([1, 3, None, 5], sc.running_stat("variance", "x"), [None, 2.0, 2.0, 4.0]),
    "running deviation": ([1, 3, 5], sc.running_stat("deviation", "x"), [None, 2.0**0.5, 2.0]),
    "running variance far from zero": ([10**9 + i for i in range(40)], sc.running_stat("variance", "x"), [None, *[n * (n + 1) / 12 for n in range(2, 41)]]),
    "running sum and others": ([2, None, 1], sc.zip_(s=sc.running_stat("sum", "x"), n=sc.running_stat("count", "x"), lo=sc.running_stat("min", "x")), [(2, 1, 2), (2, 1, 2), (3, 2, 1)]),
    "consecutive over several blocks": (range(30), wi.consecutive(12), [tuple(range(i, i + 12)) for i in range(19)]),
    "consecutive of one": ([1, None], wi.consecutive(1), [(1,), (None,)]),
    "consecutive with a step": (range(7), wi.consecutive(2, 3), [(0, 1), (3, 4)]),
    "iterated over strides": ([0] * 25, pr.iterated(lambda v: v + 3, F.lit(1).cast("long")), list(range(1, 76, 3))),
    "iterated of one": ([0], pr.iterated(lambda v: v * 0, F.lit(7).cast("long")), [7]),
    "count days": ([0] * 3, pr.count(F.lit("2024-02-28").cast("date"), F.expr("interval 1 day")), [date(2024, 2, 28), date(2024, 2, 29), date(2024, 3, 1)]),
    "count months": ([0] * 3, pr.count(F.lit("2024-01-31").cast("date"), F.expr("interval 1 month")), [date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 31)]),
    "count hours": ([0] * 2, pr.count(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.expr("interval 12 hours")), [datetime(2024, 1, 1), datetime(2024, 1, 1, 12)]),
    "vectorized map": ([1, 2], pr.map_pandas(lambda pdf: (pdf[["x"]] * 10).rename(columns={"x": "y"}), "y long"), [10, 20]),
    "table function": ([12, 7, 345], fl.map_table(digits, x), ["1", "2", "7", "3", "4", "5"]),
    "delay": ([1, 2, 3], sc.scan_emit(lambda s, r: (s, int(r.x)), 0, "x long", lambda s: s), [0, 1, 2, 3]),
    "identity": ([1, 2], compose(identity, identity), [1, 2]),
}


def same(found, expected):
    """Equal, but that floats may differ in their last digits."""
    if isinstance(found, (list, tuple)) and isinstance(expected, (list, tuple)):
        return len(found) == len(expected) and all(map(same, found, expected))
    return found == (pytest.approx(expected, rel=1e-9) if isinstance(expected, float) else expected)


@pytest.mark.parametrize("name", CASES)
def test_golden(spark, name, monkeypatch):
    """In one window and in blocks: the same values, in the same columns and order."""
    monkeypatch.setattr(pr, "STRIDE", 4)
    xs, step, expected = CASES[name]
    kind = "array<long>" if isinstance(next(iter(xs)), list) else "long"
    s = from_values(spark, xs, kind)
    assert same(plain(collect(s, step)), expected)
    shuffled = dataclasses.replace(s.with_df(s.df.repartition(3, F.rand(1))), block_bytes=1)
    assert same(plain(collect(shuffled, step)), expected)
    whole, parts = step(s), step(shuffled)
    assert (whole.df.columns, whole.order, whole.by) == (parts.df.columns, parts.order, parts.by) and whole.df.dtypes == parts.df.dtypes


def test_blocks_are_cut_once_and_by_the_whole_order(spark):
    import loomline.seq as seq

    s = dataclasses.replace(concat(from_values(spark, list("abcdef"), "string"), from_values(spark, list("uvwxyz"), "string")), block_bytes=60)
    cut = s.blocked()
    assert len(cut.cuts) > 3 and cut.df.select(seq.BLOCK).distinct().count() == len(cut.cuts) + 1
    after = fi.dedupe("x")(cut.unblocked())
    assert after.cuts == cut.cuts and pr.enumerate_()(after).cuts == cut.cuts
    assert fl.map_cat(F.array("x", "x"))(cut.unblocked()).cuts is None
    by_text = dataclasses.replace(s, order=("x",), cuts=None)
    assert len(by_text.blocked().cuts) > 3 and collect(by_text, pr.enumerate_()) == [(*r,) for r in zip([0] * 6 + [1] * 6, [*range(6)] * 2, range(1, 13))]
    times = from_values(spark, range(50), "long").df.select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("ord") / 1e6)).alias("t"), F.nullif("ord", F.lit(3)).alias("ord"), "x")
    one = as_seq(spark, times, ["t", "ord"])
    assert collect(dataclasses.replace(one, block_bytes=1), sc.scan("sum", "x")) == collect(one, sc.scan("sum", "x"))


def test_many_blocks_are_found_in_two_searches(spark):
    s = dataclasses.replace(from_values(spark, range(3000), "long"), block_bytes=160)
    cut = s.blocked()
    assert len(cut.cuts) > 64
    import loomline.seq as seq

    rows = cut.df.orderBy("ord").select("ord", seq.BLOCK).collect()
    import json

    bounds = [json.loads(c)["ord"] for c in cut.cuts]
    assert all(r[1] == sum(b < r[0] for b in bounds) for r in rows)


def test_flush_rule(spark):
    """Against the rule itself, for windows that overlap and ones that leave gaps."""
    for n in (0, 1, 5, 6, 7):
        for size in (1, 2, 3):
            for step in (1, 2, 3, 4):
                full = 0 if n < size else (n - size) // step + 1
                used = 0 if full == 0 else (full - 1) * step + size
                expected = [list(range(k * step, k * step + size)) for k in range(full)]
                if n > used and full * step < n:
                    expected.append(list(range(full * step, n)))
                assert collect(from_values(spark, range(n), "long"), wi.partition(size, step, True)) == expected, (n, size, step)


@pytest.mark.parametrize("parts", [1, 3, 7, 16])
def test_partition_invariance(spark, sf, parts):
    events = spark.read.parquet(f"{sf}/events.parquet")
    base = as_seq(spark, events.select("event_id", "event_type", "value"), ["event_id"])
    moved = dataclasses.replace(base.with_df(base.df.repartition(parts, F.rand(parts))), block_bytes=9000)
    assert moved.blocked().is_blocked
    error = F.col("event_type") == "error"
    for step in (wi.partition_by(F.col("event_type"), "event_type"), wi.split_by(error, column="event_type", keepempty=True), fi.dedupe("event_type"), pr.enumerate_(), sc.scan("max", "value"), wi.consecutive(3, column="event_type"), fi.unique("event_type")):
        assert collect(base, step) == collect(moved, step), step.name


def test_folds(spark):
    s = from_values(spark, range(5))
    plus = odd >> pr.map_(x=x + 1)
    assert fold_value(plus(s), "sum", x, 0) == 6 and fold_value(plus(s), "sum", x, 100) == 106
    nothing = fi.filter_(x > 100)(s)
    assert fold_value(nothing, "sum", x, 32) == 32 and fold_value(nothing, "sum", x, "identity") == 0
    with pytest.raises(EmptyResultError):
        fold_value(nothing, "sum", x)
    with pytest.raises(IdentityNotDefinedError):
        fold_value(nothing, "max", x, "identity")
    assert foldl(from_values(spark, range(1, 5)), lambda a, b: a - b, x).first()[0] == -8
    assert foldl(nothing, lambda a, b: a - b, x, F.lit(9).cast("long")).first()[0] == 9
    assert fold_value(s, "append", x) == [0, 1, 2, 3, 4] and fold_value(s, "right", x) == 4 and fold_value(s, "left", x) == 0
    pairs = from_values(spark, [(1, v) for v in (5, 2, 6, 8, 3)], "struct<a:long,b:long>")
    assert tuple(product(pairs, "x", "sum", "max").first()) == (5, 8)
    assert pr.broadcasting(from_values(spark, [[1, 5], [1, 2], [1, 6], [1, 8], [1, 3]], "array<long>"), "x").orderBy("pos").collect() == [(0, 5), (1, 24)]
    assert set(MONOIDS) >= {"sum", "product", "min", "max", "and", "or", "append", "right", "left"}


def test_reducer_merges_in_order(spark):
    join = Reducer(lambda s, r: s + [int(r.x)], lambda a, b: a + b, list)
    xs = [3, 1, 2] * 7
    for parts in (1, 2, 5):
        assert reduce_python(from_values(spark, xs), join, "x array<long>", parts=parts).first()[0] == xs
    assert reduce_python(from_values(spark, [], "long"), join.whencomplete(len), "x long").first()[0] == 0
    assert reduce_python(from_values(spark, [], "long"), dataclasses.replace(join, init=None), "x long").count() == 0
    total = Reducer(lambda s, r: s + int(r.x), lambda a, b: a + b).wheninit(lambda: 0).whencompletebasecase(lambda s: s * 10).whencomplete(lambda s: s + 1)
    assert reduce_python(from_values(spark, [1, 2, 3]), total, "x long", parts=2).first()[0] == 61


def test_groups(spark):
    s = from_values(spark, [1, 2, 1, 2, 3])
    keyed = pr.with_values(k=x)(s)
    stopped = gr.group_until(keyed, "k", state=("sum", x), stop=F.col("state") > 3, t=F.sum("x"))
    assert {r.k: r.t for r in stopped.collect()} == {1: 2, 2: 4}
    parity = pr.with_values(k=x % 2)(from_values(spark, range(1, 11)))
    assert {r.k: r.t for r in gr.group_by(parity, "k", where=x % 2 == 1, t=F.sum("x")).collect()} == {1: 25}
    import math

    rows = [(math.gcd(v, 6), math.gcd(v, 4), v) for v in range(1, 11)]
    nested = from_values(spark, rows, "struct<a:long,b:long,v:long>")
    nested = pr.map_(a=F.col("x.a"), b=F.col("x.b"), v=F.col("x.v"))(nested)
    out = gr.per_group(fi.unique("b"), "a")(nested).df.groupBy("a").agg(F.sort_array(F.collect_list("v")).alias("l"))
    assert {r.a: r.l for r in out.collect()} == {2: [2, 4], 3: [3], 6: [6], 1: [1]}
    assert {r.x: r.v for r in to_dict(pr.with_values(v=F.col("ord"))(s), "x", "v").collect()} == {1: 2, 2: 3, 3: 4}


def test_two_sequences(spark):
    a, b = from_values(spark, range(1, 4)), from_values(spark, [5, 6], name="y")
    assert plain(collect(pr.inject(b)(a))) == [(1, 5), (2, 6)]
    assert plain(collect(zipped(a, from_values(spark, [5, 6])))) == [(1, 5), (2, 6)]
    assert plain(collect(product_source(from_values(spark, [1, 2]), from_values(spark, [8, 9])))) == [(1, 8), (2, 8), (1, 9), (2, 9)]
    assert collect(concat(a, from_values(spark, [9]))) == [1, 2, 3, 9]
    assert collect(from_tuple(spark, 4, 5)) == [4, 5]
    assert collect(generated(spark, lambda p: ((p * 10 + k,) for k in range(2)), 2, "x long")) == [0, 1, 10, 11]


def test_sinks(spark):
    a = from_values(spark, [1, 2])
    assert collect(append(a, from_values(spark, [3]))) == [1, 2, 3]
    assert collect(append_widen(a, from_values(spark, [0.5]))) == [1.0, 2.0, 0.5]
    with pytest.raises(ValueError):
        append(a, from_values(spark, [3], name="y"))
    assert collect(map_into(from_values(spark, [0, 0, 0]), from_values(spark, [1, 2, 3]), odd >> pr.map_(x=x * 10))) == [10, 0, 30]
    with pytest.raises(ValueError):
        map_into(a, a, pr.interpose(F.lit(0)))
    assert list(copy_pandas(fi.filter_(x > 9)(a)).columns) == ["x"]
    assert [r.x for r in iterate(a)] == [1, 2]
    seen, progress = with_progress(a)
    seen.df.write.format("noop").mode("overwrite").save()
    assert progress.get["rows"] == 2


def test_effects_and_overwriting(spark, tmp_path):
    a, total = from_values(spark, range(5)), spark.sparkContext.accumulator(0)
    foreach(a, lambda r: total.add(r.x), odd)
    assert total.value == 4
    at = str(tmp_path / "rows")
    write(a, at)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write(a, at)
    write(from_values(spark, [9]), at, mode="overwrite")
    assert [r.x for r in spark.read.parquet(at).collect()] == [9]


def test_phases_of_a_reducer(spark):
    calls = Reducer(lambda s, r: (*s, int(r.x)), lambda a, b: a + b, tuple).whenstart(lambda s: (*s, 0)).whencombine(lambda a, b: (*a, -1, *b)).whencomplete(list)
    assert reduce_python(from_values(spark, [5, 6]), calls, "x array<long>", parts=1).collect() == [([0, 5, 6],)]
    two = reduce_python(from_values(spark, range(1, 9)), calls, "x array<long>", parts=2).first()[0]
    assert two.count(0) == 2 and two.count(-1) == 1 and [v for v in two if v > 0] == list(range(1, 9))
    start = Copied([])
    grown = Reducer(lambda s, r: s.append(int(r.x)) or s, lambda a, b: a + b, start)
    for _ in range(2):
        assert reduce_python(from_values(spark, [3, 4]), grown, "x array<long>", parts=2).first()[0] == [3, 4]
    assert start.value == []


def test_initial_values(spark):
    s, nothing = from_values(spark, [4, 5]), fi.filter_(x > 100)(from_values(spark, [1]))
    assert fold_value(s, "max", x, "optional") == 5 and fold_value(nothing, "sum", x, "optional") == 0
    with pytest.raises(EmptyResultError):
        fold_value(nothing, "max", x, "optional")
        fold_value(nothing, "max", x)
    assert fold_value(nothing, "sum", x, lambda: 7) == 7


def test_statistics(spark):
    s = from_values(spark, [1, 2, 4, 9])
    assert fold_value(s, "median", x) == 3 and fold_value(s, "deviation", x) == pytest.approx((38 / 3) ** 0.5)
    assert fold_value(s, "mean", x) == 4 and fold_value(s, "distinct", x) == 4
    far = spark.createDataFrame([(g, v) for g, vs in enumerate(([1e9], [1e9 + 1, None], [], [1e9 + 2, 1e9 + 3, 1e9 + 3])) for v in vs], "g long, v double")
    merged = far.groupBy("g").agg(statistics.moments(F.col("v")).alias("s")).agg(statistics.merged_moments(F.col("s")).alias("s"))
    mean, variance = merged.select(statistics.mean(F.col("s")), statistics.variance(F.col("s"))).first()
    assert mean == pytest.approx(1e9 + 1.8) and variance == pytest.approx(1.7)
    assert far.limit(0).agg(statistics.moments(F.col("v")).alias("s")).select(statistics.variance(F.col("s"))).first()[0] is None
    bins = far.agg(statistics.histogram(F.col("v") - 1e9, [1, 3]).alias("h")).first()[0]
    assert bins == [1, 2, 2]


def test_early_ends(spark):
    s = from_values(spark, range(1, 6))
    for step, early in ((sl.reduce_if(x == 3), True), (sl.reduce_if(x == 9), False), (sl.abort_if(x == 3), True), (sl.take_while(x < 9), False), (sl.take(5), True), (sl.take(6), False), (pr.map_(x=x * 2) >> sl.take_while(x < 9), True), (sl.drop(1), False)):
        assert sl.terminated(step, s) == early, step.name
        row = transduce(step, "count", x, s).first()
        assert row.terminated == early and row.value == len(collect(s, step))
        assert if_unreduced(transduce(step, "sum", x, s), lambda v: -v).first().value == sum(collect(s, step)) * (1 if early else -1)
    each = pr.with_values(k=x % 2)(s).grouped("k")
    assert {r.k: (r.value, r.terminated) for r in transduce(sl.reduce_if(x == 3), "sum", x, each).collect()} == {0: (6, False), 1: (4, True)}


def test_adapters_and_sources(spark):
    class Pair:
        def __init__(self, a, b):
            self.a, self.b = a, b

    register(Pair, lambda spark, p: from_values(spark, [p.a, p.b]))
    assert collect(as_seq(spark, Pair(4, 2))) == [4, 2]
    register_source(spark, RangeSource)
    for parts in (1, 3):
        df = spark.read.format("loomline_range").options(start="10", end="0", step="-3", parts=str(parts)).load()
        assert collect(as_seq(spark, df, ["ord"])) == [10, 7, 4, 1] and df.rdd.getNumPartitions() == parts
    with pytest.raises(ValueError):
        as_seq(spark, df)


def test_the_same_fold_under_every_executor(spark):
    """Sessions differ in where tasks run; what is folded doesn't."""
    conf = {e.name: e for e in (executors.sequential, executors.threaded, executors.distributed)}
    assert conf["sequential"].master == "local[1]" and conf["distributed"].master is None
    own = executors.Executor("mine", None, 4).session("again", spark__sql__ansi__enabled="true")
    assert own.sparkContext is spark.sparkContext and fold_value(from_values(own, range(5)), "sum", x) == 10


def test_a_map_that_loses_rows_is_an_error(spark):
    with pytest.raises(Exception, match="1 rows for 2"):
        collect(from_values(spark, [1, 2]).with_df(from_values(spark, [1, 2]).df.coalesce(1)), pr.map_pandas(lambda pdf: pdf.head(1), "x long"))


def test_invalid_arguments():
    for f, n in ((sl.take, -1), (sl.take_last, -1), (sl.drop, -1), (sl.drop_last, -1), (sl.take_nth, 0), (wi.partition, 0), (wi.consecutive, 0)):
        with pytest.raises(ValueError):
            f(n)
    with pytest.raises(ValueError):
        wi.partition(2, 0)
    with pytest.raises(ValueError):
        fl.tcat("x", 0)


def test_composition():
    both = sl.take(1) >> identity >> pr.interpose(F.lit(0))
    assert both.name == "take >> interpose" and both.expansive and not both.stable
    assert (identity >> identity) is identity
