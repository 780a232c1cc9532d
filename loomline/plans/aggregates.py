"""Folds of whole sequences and of groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.monoids import reducing
from ..operators.filters import filter_, unique
from ..operators.folds import Reducer, fold, foldl, if_unreduced, product, reduce_python, tee, tee_started, to_dict, to_set, transduce
from ..operators.grouping import get_group, group_by, group_running, group_until, per_group
from ..operators.projections import map_, with_values
from ..operators.slices import reduce_if
from ..seq import Seq
from .registry import load, query

c = F.col


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc,
round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark, sf):
    """Filter, map and grouped folds in one pass: the flagship."""
    s = Seq(spark.read.parquet(f"{sf}/lineitem.parquet"), ("l_orderkey", "l_linenumber"))
    s = filter_(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))(s)
    return group_by(
        s, "l_returnflag", "l_linestatus", sum_qty=F.round(F.sum("l_quantity"), 2), sum_base=F.round(F.sum("l_extendedprice"), 2),
        sum_disc=F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2), avg_disc=F.round(F.avg("l_discount"), 6), n=F.count("*"),
    )


@query("select round(sum(l_extendedprice * l_discount), 2) as value, count(*) as n from lineitem where l_discount between 0.02 and 0.08 and l_quantity < 24")
def filter_map_reduce(spark, sf):
    s = Seq(spark.read.parquet(f"{sf}/lineitem.parquet"), ("l_orderkey", "l_linenumber"))
    s = filter_((c("l_discount") >= 0.02) & (c("l_discount") <= 0.08) & (c("l_quantity") < 24))(s)
    return fold(s, "sum", c("l_extendedprice") * c("l_discount")).withColumn("value", F.round("value", 2))


@query("""select (select sum(user_id) from events)::BIGINT as s, min(value) as lo, max(value) as hi, bool_and(value >= 0) as all_pos, bool_or(event_type = 'error') as any_error,
(bit_xor(event_id))::BIGINT as x, arg_max(event_type, event_id) as last_type, arg_min(event_type, event_id) as first_type, count(distinct user_id) as users, round(var_samp(value), 4) as var from events""")
def known_monoids(spark, sf):
    s = load(spark, sf, "events")
    return tee(
        s, s=reducing("sum", c("user_id"), s), lo=reducing("min", c("value"), s), hi=reducing("max", c("value"), s), all_pos=reducing("and", c("value") >= 0, s), any_error=reducing("or", c("event_type") == "error", s),
        x=reducing("bit_xor", c("event_id"), s), last_type=reducing("right", c("event_type"), s), first_type=reducing("left", c("event_type"), s), users=reducing("distinct", c("user_id"), s), var=F.round(reducing("variance", c("value"), s), 4),
    )


@query("select min(value) as lo, max(value) as hi, min(value) filter (where event_type = 'click') as lo_click from events")
def tee_with_filter(spark, sf):
    s = load(spark, sf, "events")
    return tee(s, lo=F.min("value"), hi=F.max("value"), lo_click=reducing("min", c("value"), s, c("event_type") == "click"))


@query("select count(*) filter (where value > 1000000) > 0 and count(*) > 0 as started from events")
def tee_not_started(spark, sf):
    return tee_started(load(spark, sf, "events"), high=c("value") > 1_000_000, any=F.lit(True))


@query("select sum(user_id)::BIGINT as a, max(value) as b from events")
def product_of_folds(spark, sf):
    s = map_(p=F.struct(c("user_id").alias("a"), c("value").alias("b")))(load(spark, sf, "events"))
    return product(s, "p", "sum", "max")


@query("select (100 + sum(user_id) filter (where event_type = 'click'))::BIGINT as value, count(*) filter (where event_type = 'click') as n from events")
def fold_with_init(spark, sf):
    s = filter_(c("event_type") == "click")(load(spark, sf, "events"))
    return fold(s, "sum", c("user_id"), F.lit(100).cast("long"))


@query("select 32::BIGINT as value, 0::BIGINT as n")
def fold_of_nothing(spark, sf):
    s = filter_(c("value") > 1e12)(load(spark, sf, "events"))
    return fold(s, "sum", c("user_id"), F.lit(32).cast("long"))


@query("select null::DOUBLE as value, 0::BIGINT as n")
def fold_of_nothing_without_init(spark, sf):
    return fold(filter_(c("value") > 1e12)(load(spark, sf, "events")), "max", c("value"))


@query("select user_id, list_reduce(list(k order by event_id), lambda a, b: (a * 31 - b) % 1000003) as value from (select *, (value * 10)::BIGINT as k from events where event_id < 2000) group by user_id")
def left_fold(spark, sf):
    s = filter_(c("event_id") < 2000)(load(spark, sf, "events")).grouped("user_id")
    return foldl(s, lambda a, b: (a * 31 - b) % 1000003, F.rint(c("value") * 10).cast("long"))


@query("select sum(user_id)::BIGINT as value, count(*) as n, true as terminated from events where event_id <= (select min(event_id) from events where event_type = 'error')")
def transduce_until_error(spark, sf):
    return transduce(reduce_if(c("event_type") == "error"), "sum", c("user_id"), load(spark, sf, "events"))


@query("""with e as (select *, min(event_id) filter (where event_type = 'error' and value > 95) over (partition by user_id) as m from events)
select user_id, case when bool_or(m is not null) then sum(event_id) filter (where m is null or event_id <= m) else -sum(event_id) end::BIGINT as value, bool_or(m is not null) as terminated from e group by user_id""")
def if_unreduced_per_user(spark, sf):
    """Sums up to the first severe error of each user; negative for those that have none."""
    s = with_values(id=c("event_id") + 0)(load(spark, sf, "events")).grouped("user_id")
    out = transduce(reduce_if((c("event_type") == "error") & (c("value") > 95)), "sum", c("id"), s)
    return if_unreduced(out, lambda x: -x).select("user_id", "value", "terminated")


@query("select max(n)::BIGINT as longest, arg_min(start, (-n, start))::BIGINT as start from (select min(event_id) as start, count(*) as n from (select *, event_id - row_number() over (partition by event_type order by event_id) as g from events) group by event_type, g)")
def longest_run_by_reducer(spark, sf):
    """A fold that doesn't commute, in Python: ranges of the order are folded apart and merged at their seams."""

    # state: length, then (kind, start, size) of the first, best and last run
    def step(state, row):
        if state is None:
            run = (row.event_type, int(row.id), 1)
            return [run, run, run, True]
        first, best, last, one = state
        if last[0] == row.event_type:
            last = (last[0], last[1], last[2] + 1)
            first = last if one else first
        else:
            last, one = (row.event_type, int(row.id), 1), False
        return [first, last if last[2] > best[2] else best, last, one]

    def merge(a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[2][0] != b[0][0]:
            return [a[0], b[1] if b[1][2] > a[1][2] else a[1], b[2], False]
        seam = (a[2][0], a[2][1], a[2][2] + b[0][2])
        best = min((a[1], seam, b[1]), key=lambda r: (-r[2], r[1]))
        return [seam if a[3] else a[0], best, seam if b[3] else b[2], a[3] and b[3]]

    s = with_values(id=c("event_id") + 0)(load(spark, sf, "events", "event_type"))
    return reduce_python(s, Reducer(step, merge).whencomplete(lambda s: (s[1][2], s[1][1])), "longest long, start long")


@query("select distinct event_type, user_id % 3 as third from events")
def set_of_values(spark, sf):
    s = load(spark, sf, "events")
    return to_set(map_(event_type=c("event_type"), third=c("user_id") % 3)(s))


@query("select user_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def dict_last_wins(spark, sf):
    return to_dict(load(spark, sf, "events"), "user_id", "event_type")


# -- groups


@query("select user_id, count(*) as n, round(sum(value), 4) as total from events group by user_id")
def group_by_user(spark, sf):
    return group_by(load(spark, sf, "events"), "user_id", n=F.count("*"), total=F.round(F.sum("value"), 4))


@query("select user_id, count(*) as n from events where event_type = 'purchase' group by user_id")
def group_with_filter(spark, sf):
    return group_by(load(spark, sf, "events"), "user_id", where=c("event_type") == "purchase", n=F.count("*"))


@query("select event_id, event_type, (count(*) over (partition by event_type order by event_id))::BIGINT as n, max(value) over (partition by event_type order by event_id) as top from events")
def group_running_state(spark, sf):
    return group_running("event_type", n=("count", c("value")), top=("max", c("value")))(load(spark, sf, "events")).df


@query("""with r as (select *, sum(value) over (partition by user_id order by event_id) as s from events), m as (select coalesce(min(event_id), 9e18) as m from r where s > 300)
select user_id, count(*) as n from r, m where event_id <= m group by user_id""")
def group_until_limit(spark, sf):
    return group_until(load(spark, sf, "events"), "user_id", state=("sum", c("value")), stop=c("state") > 300, n=F.count("*"))


@query("select user_id, string_agg(event_type, ',' order by event_id) as types from (select user_id, event_type, min(event_id) as event_id from events group by 1, 2) group by user_id")
def group_with_unique(spark, sf):
    s = per_group(unique("event_type"), "user_id")(load(spark, sf, "events", "user_id", "event_type"))
    rows = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return s.df.groupBy("user_id").agg(F.array_join(F.transform(rows, lambda r: r["event_type"]), ",").alias("types"))


@query("select n_nationkey, coalesce(n, -1)::BIGINT as n from nation left join (select c_nationkey as n_nationkey, count(*) as n from customer where c_acctbal > 9900 group by 1) using (n_nationkey)")
def get_with_default(spark, sf):
    rich = load(spark, sf, "customer")
    found = group_by(filter_(c("c_acctbal") > 9900)(rich), c("c_nationkey").alias("n_nationkey"), n=F.count("*"))
    return get_group(found, "n_nationkey", load(spark, sf, "nation").df.select("n_nationkey"), "n", F.lit(-1).cast("long"))
