"""Whole tasks that steps are combined for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import statistics
from ..functions.monoids import reducing
from ..operators.filters import filter_, not_null
from ..operators.flatten import map_cat
from ..operators.folds import foldl, tee
from ..operators.grouping import group_by, per_group
from ..operators.projections import enumerate_, map_, with_values
from ..operators.scans import adhoc
from ..operators.slices import take
from ..sources.inputs import from_range
from .registry import load, query

c = F.col


@query(r"""select word, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '\s+')) as word from documents) where word <> '' group by word""")
def word_count(spark, sf):
    words = map_cat(F.split(F.lower("text"), r"\s+"), "word") >> filter_(c("word") != "")
    return group_by(words(load(spark, sf, "documents", "text")), "word", n=F.count("*"))


@query("select substr((p_retailprice)::INT::VARCHAR, 1, 1) as digit, count(*) as n from part group by 1")
def leading_digits(spark, sf):
    s = map_(digit=F.substring(F.rint("p_retailprice").cast("int").cast("string"), 1, 1))(load(spark, sf, "part"))
    return group_by(s, "digit", n=F.count("*"))


@query("select round(sum(x * y), 4) as dot, count(*) as n from (select case when event_type <> 'error' then value end as x, case when user_id % 7 <> 0 then user_id end as y from events) where x is not null and y is not null")
def missing_dot(spark, sf):
    s = map_(x=F.when(c("event_type") != "error", c("value")), y=F.when(c("user_id") % 7 != 0, c("user_id")))(load(spark, sf, "events"))
    return tee(not_null("x", "y")(s), dot=F.round(F.sum(c("x") * c("y")), 4), n=F.count("*"))


@query("select round(covar_samp(x, y), 4) as cov, round(corr(x, y), 6) as corr from (select case when event_type <> 'error' then value end as x, (user_id % 50)::DOUBLE as y from events) where x is not null")
def missing_covariance(spark, sf):
    s = map_(x=F.when(c("event_type") != "error", c("value")), y=(c("user_id") % 50).cast("double"))(load(spark, sf, "events"))
    return tee(not_null()(s), cov=F.round(F.covar_samp("x", "y"), 4), corr=F.round(F.corr("x", "y"), 6))


@query("select round(sum(case when event_type <> 'error' then value end), 4) as a, sum(case when event_type <> 'view' then user_id end)::BIGINT as b from events")
def missing_column_sums(spark, sf):
    return tee(load(spark, sf, "events"), a=F.round(F.sum(F.when(c("event_type") != "error", c("value"))), 4), b=F.sum(F.when(c("event_type") != "view", c("user_id"))))


@query("select arg_max(event_id, (x, -event_id)) as at, max(x) as top from (select event_id, case when event_type <> 'purchase' then value end as x from events) where x is not null")
def missing_argmax(spark, sf):
    s = not_null("x")(map_(x=F.when(c("event_type") != "purchase", c("value")))(load(spark, sf, "events")))
    return tee(s, at=F.max_by("event_id", F.struct("x", -c("event_id"))), top=F.max("x"))


@query("select event_id as found from events where value > 90")
def find_all(spark, sf):
    return filter_(c("value") > 90)(load(spark, sf, "events")).df.select(c("event_id").alias("found"))


@query("select event_id, value from events where value > 99 order by event_id limit 1")
def find_first(spark, sf):
    return (filter_(c("value") > 99) >> take(1))(load(spark, sf, "events")).df.select("event_id", "value")


@query("select event_id, coalesce(json_extract_string(props, '$.key'), json_extract_string(props, '$.k'), 'none') as k from events")
def keys_with_fallback(spark, sf):
    k = F.coalesce(F.get_json_object("props", "$.key"), F.get_json_object("props", "$.k"), F.lit("none"))
    return map_(k=k)(load(spark, sf, "events")).df


@query("select c_nationkey, o_orderkey, o_totalprice from customer join orders on c_custkey = o_custkey where c_nationkey < 3")
def nested_flatten(spark, sf):
    """Objects with arrays of objects, built and then flattened two levels deep."""
    orders = load(spark, sf, "orders").df.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("orders"))
    people = load(spark, sf, "customer").df.where("c_nationkey < 3").join(orders, c("c_custkey") == c("o_custkey"))
    nested = people.groupBy("c_nationkey").agg(F.collect_list(F.struct("orders")).alias("people"))
    return nested.select("c_nationkey", F.inline("people")).select("c_nationkey", F.inline("orders"))


@query("select vec_id, p::INT as pos, round(a::DOUBLE, 6) as a, b::BIGINT as b from (select vec_id, unnest(embedding[1:8]) as a, unnest(range(0, 8)) as p, unnest(range(0, 80, 10)) as b from embeddings)")
def zip_inside_row(spark, sf):
    tens = F.sequence(F.lit(0).cast("long"), F.lit(70).cast("long"), F.lit(10).cast("long"))
    zipped = F.arrays_zip(F.slice("embedding", 1, 8).alias("a"), tens.alias("b"))
    rows = load(spark, sf, "embeddings").df.select("vec_id", F.posexplode(zipped).alias("pos", "z"))
    return rows.select("vec_id", "pos", F.round(c("z.a").cast("double"), 6).alias("a"), c("z.b").alias("b"))


@query("""with a as (select vec_id as i, unnest(embedding[1:16])::DOUBLE as x, unnest(range(0, 16)) as k from embeddings where vec_id < 16), b as (select vec_id as k, unnest(embedding[1:16])::DOUBLE as y, unnest(range(0, 16)) as j from embeddings where vec_id < 16)
select i, j::INT as j, round(sum(x * y), 5) as v from a join b using (k) group by i, j""")
def matrix_multiply(spark, sf):
    rows = load(spark, sf, "embeddings").df.where("vec_id < 16").select("vec_id", F.posexplode(F.slice("embedding", 1, 16)).alias("p", "v"))
    a = rows.select(c("vec_id").alias("i"), c("p").cast("long").alias("k"), c("v").cast("double").alias("x"))
    b = rows.select(c("vec_id").alias("k"), c("p").alias("j"), c("v").cast("double").alias("y"))
    return a.join(b, "k").groupBy("i", "j").agg(F.round(F.sum(c("x") * c("y")), 5).alias("v"))


@query("select pos::INT as pos, round(sum(x), 4) as total from (select unnest(embedding)::DOUBLE as x, unnest(range(0, len(embedding))) as pos from embeddings) group by pos")
def transposed_sum(spark, sf):
    rows = load(spark, sf, "embeddings").df.select(F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("pos").agg(F.round(F.sum(c("x").cast("double")), 4).alias("total"))


@query("select count(*)::BIGINT as n, round(avg(value), 6) as mean, round(var_samp(value), 4) as variance from events")
def merged_statistics(spark, sf):
    """States of each type and user, merged: what could also be stored between."""
    states = group_by(load(spark, sf, "events"), "event_type", "user_id", state=statistics.moments(c("value")))
    all_ = states.agg(statistics.merged_moments(c("state")).alias("s"))
    return all_.select("s.n", F.round(statistics.mean(c("s")), 6).alias("mean"), F.round(statistics.variance(c("s")), 4).alias("variance"))


@query("select user_id, count(*) filter (where value < 10) as below, count(*) filter (where value >= 10 and value < 50) as middle, count(*) filter (where value >= 50) as above from events group by user_id")
def histograms(spark, sf):
    bins = group_by(load(spark, sf, "events"), "user_id", "event_type", bins=statistics.histogram(c("value"), [10, 50]))
    whole = bins.groupBy("user_id").agg(statistics.merged_histogram(c("bins"), 3).alias("b"))
    return whole.select("user_id", *[F.get("b", i).alias(n) for i, n in enumerate(("below", "middle", "above"))])


@query("select true as close, true as near")
def merged_sketches(spark, sf):
    """Sketches of each type, merged: whether the median and the number of users come out within three percent."""
    e = load(spark, sf, "events")
    own = group_by(e, "event_type", q=statistics.quantile_sketch(c("value")), u=statistics.distinct_sketch(c("user_id")))
    both = own.agg(statistics.merged_quantiles(c("q")).alias("q"), statistics.merged_distinct(c("u")).alias("u"))
    median, exact = statistics.quantile(c("q"), 0.5), tee(e, users=F.countDistinct("user_id"))
    rank = e.df.crossJoin(F.broadcast(both.select(median.alias("m")))).agg(F.avg((c("value") <= c("m")).cast("int")).alias("share"))  # one row
    rows = both.crossJoin(F.broadcast(exact)).crossJoin(F.broadcast(rank))  # a row each
    return rows.select((F.abs(c("share") - 0.5) < 0.03).alias("close"), (F.abs(c("u") / c("users") - 1) < 0.03).alias("near"))


@query("select p as x from (select range as p from range(2, 400)) a where not exists (select 1 from range(2, 20) b(d) where d * d <= p and p % d = 0)")
def primes(spark, sf):
    """A sieve whose state grows as it goes: sequential by nature, so in one Python machine."""

    def f(found, row):
        x = int(row.x)
        if all(x % p for p in found if p * p <= x):
            return [*found, x], [(x,)]
        return found, []

    return adhoc(f, list, "x long")(from_range(spark, range(2, 400))).df.select("x")


@query()
def random_recall(spark, sf):
    """Each element gives one that was seen before it, at random but seeded: rows can't be had from SQL."""
    import random

    def f(state, row):
        rng, seen = state
        seen.append(int(row.event_id_))
        return (rng, seen[-64:]), [(rng.choice(seen),)]

    s = with_values(event_id_=c("event_id") + 0)(load(spark, sf, "events", "event_type"))
    return per_group(adhoc(f, lambda: (random.Random(7), []), "recalled long"), "event_type")(s).df


@query("with g as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n, value from events) select user_id, round(max(value) filter (where n = 1), 4) as first, count(*) as n from g group by 1")
def enumerate_in_groups(spark, sf):
    s = per_group(enumerate_(F.lit(1).cast("long")), "user_id")(load(spark, sf, "events", "user_id", "value"))
    return s.df.groupBy("user_id").agg(F.round(F.max(F.when(c("n") == 1, c("value"))), 4).alias("first"), F.count("*").alias("n"))


@query("select o_orderpriority, list_aggregate(list(k order by o_orderkey), 'last')::BIGINT as last_status, count(*) as n from (select *, o_orderkey % 10 as k from orders) group by 1")
def last_of_priority(spark, sf):
    s = load(spark, sf, "orders")
    return group_by(s, "o_orderpriority", last_status=reducing("right", c("o_orderkey") % 10, s), n=F.count("*"))
