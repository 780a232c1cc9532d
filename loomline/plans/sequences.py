"""Steps over single sequences: projections, filters, slices, expansions, windows, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import dedupe, filter_, keep_something, not_null, of_type, unique
from ..operators.flatten import cat, map_cat, map_table, tcat
from ..operators.grouping import per_group
from ..operators.projections import broadcasting, count, enumerate_, flag_first, get_index, inject, interpose, iterated, map_, map_pandas, map_splat, replace, set_index, with_values
from ..operators.scans import adhoc, running_stat, scan, scan_emit, zip_, zip_source
from ..operators.slices import abort_if, drop, drop_last, drop_while, reduce_if, take, take_last, take_nth, take_while
from ..operators.windows import consecutive, partition, partition_by, ranges_by, reduce_partition_by, reduce_split_by, split_by, split_string
from ..seq import compose, identity
from ..sources.inputs import RangeSource, as_seq, blocks, comprehend, concat, from_array, generated, product, register_source, zipped
from .registry import load, query

c = F.col


def events(spark: SparkSession, sf: str, *columns: str):
    return load(spark, sf, "events", *(columns or ("user_id", "event_type", "value")))


def joined(column: str = "xs"):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


# -- projections


@query("select event_id, user_id * 2 as twice, upper(event_type) as kind from events")
def map_values(spark, sf):
    return map_(twice=c("user_id") * 2, kind=F.upper("event_type"))(events(spark, sf)).df


@query("select event_id, user_id * 1000 + length(event_type) as x from events")
def map_splat_fields(spark, sf):
    s = map_(p=F.struct("user_id", "event_type"))(events(spark, sf))
    return map_splat("p", lambda a, b: a * 1000 + F.length(b))(s).df


@query("select event_id, case event_type when 'click' then 'C' when 'view' then 'V' else event_type end as event_type from events")
def replace_small(spark, sf):
    return replace("event_type", {"click": "C", "view": "V"})(events(spark, sf, "event_type")).df


@query("select s_suppkey, coalesce(n_name, s_nationkey::VARCHAR) as nation from supplier left join (select * from nation where n_regionkey = 1) on s_nationkey = n_nationkey")
def replace_by_table(spark, sf):
    names = load(spark, sf, "nation").df.where("n_regionkey = 1").select(c("n_nationkey").cast("string").alias("key"), c("n_name").alias("value"))
    s = map_(nation=c("s_nationkey").cast("string"))(load(spark, sf, "supplier"))
    return replace("nation", names)(s).df


@query("select c_custkey, n_name as x from customer join nation on c_nationkey = n_nationkey")
def get_index_by_table(spark, sf):
    names = load(spark, sf, "nation").df.select(c("n_nationkey").alias("index"), c("n_name").alias("value"))
    return get_index("c_nationkey", names)(load(spark, sf, "customer")).df


@query("select event_id, list_extract(['a', 'b', 'c'], (user_id % 4)::INT) as x from events")
def get_index_in_list(spark, sf):
    s = map_(k=F.nullif(c("user_id") % 4, F.lit(0)))(events(spark, sf))  # places count from 1
    return get_index("k", ["a", "b", "c"], inbounds=True)(s).df


@query("select n_nationkey as index, coalesce(v, 0)::BIGINT as value from nation left join (select c_nationkey, arg_max(c_custkey, c_custkey) as v from customer group by 1) on n_nationkey = c_nationkey")
def set_index_last_wins(spark, sf):
    base = load(spark, sf, "nation").df.select(c("n_nationkey").alias("index"), F.lit(0).cast("long").alias("value"))
    s = load(spark, sf, "customer").select("c_nationkey", c("c_custkey").alias("v"))
    return set_index(s, base, "c_nationkey", "v")


@query("select event_id, value, event_id = min(event_id) over () as is_first from events")
def flag_first_event(spark, sf):
    return flag_first()(events(spark, sf, "value")).df


@query("select event_id, value, 10 + 20 * (row_number() over (order by event_id) - 1) as n from events")
def enumerate_events(spark, sf):
    return enumerate_(F.lit(10).cast("long"), 20)(events(spark, sf, "value")).df


@query("select event_id, row_number() over (order by event_id) as n from events where event_type = 'click'")
def count_clicks(spark, sf):
    return (filter_(c("event_type") == "click") >> count(F.lit(1).cast("long")))(events(spark, sf)).df


@query("select event_id, strftime(date '2024-01-01' + (row_number() over (order by event_id) - 1)::INT, '%Y-%m-%d') as day from events where event_id < 500")
def count_days(spark, sf):
    days = filter_(c("event_id") < 500) >> count(F.lit("2024-01-01").cast("date"), F.expr("interval 1 day"), "day")
    return (days >> map_(day=c("day").cast("string")))(events(spark, sf)).df


@query("select n_nationkey, strftime(date '2024-01-31' + to_months((row_number() over (order by n_nationkey) - 1)::INT), '%Y-%m-%d') as month from nation")
def enumerate_months(spark, sf):
    months = count(F.lit("2024-01-31").cast("date"), F.expr("interval 1 month"), "month")
    return (months >> map_(month=c("month").cast("string")))(load(spark, sf, "nation")).df


@query("select event_id, user_id + value as x from events")
def map_vectorized(spark, sf):
    """A function of whole columns in Python, in Arrow batches."""
    return map_pandas(lambda pdf: (pdf["user_id"] + pdf["value"]).to_frame("x"), "x double")(events(spark, sf)).df


@query("with recursive t as (select 0::BIGINT as i, 1::BIGINT as x union all select i + 1, (x * 48271) % 2147483647 from t where i < 2999) select event_id, x from (select event_id, row_number() over (order by event_id) - 1 as i from events) join t using (i)")
def iterated_generator(spark, sf):
    """A function of which no closed form is used, over several strides."""
    s = take(3000)(events(spark, sf, "user_id"))
    return iterated(lambda x: (x * 48271) % 2147483647, F.lit(1).cast("long"))(s).df


@query("select r_regionkey, (2 ** (row_number() over (order by r_regionkey) - 1))::BIGINT as x from region")
def iterated_doubling(spark, sf):
    return iterated(lambda x: x * 2, F.lit(1).cast("long"))(load(spark, sf, "region")).df


@query("select event_id, 3 + 7 * (row_number() over (order by event_id) - 1) as x from events")
def iterated_closed(spark, sf):
    return iterated(lambda x: x + 7, F.lit(3).cast("long"), closed=lambda i: 3 + i * 7)(events(spark, sf)).df


@query("""with i as (select event_id, event_id = min(event_id) over () as f, event_type from events)
select event_id, 0 as pos, case when f then event_type else '--' end as x from i union all select event_id, 1, event_type from i where not f""")
def interpose_marks(spark, sf):
    return interpose(F.lit("--"))(map_(x=c("event_type"))(events(spark, sf))).df


@query("""with a as (select *, row_number() over (order by event_id) as i from events), b as (select *, row_number() over (order by c_custkey) as i from customer)
select event_id, event_type, c_name from a join b using (i)""")
def inject_customers(spark, sf):
    return inject(load(spark, sf, "customer", "c_name"))(events(spark, sf, "event_type")).df


@query("select (pos - 1)::INT as pos, round(sum(x), 3) as value from (select unnest(embedding)::DOUBLE as x, unnest(range(1, len(embedding) + 1)) as pos from embeddings) group by pos")
def broadcasting_sum(spark, sf):
    s = load(spark, sf, "embeddings").select(c("embedding").cast("array<double>").alias("e"))
    return broadcasting(s, "e").select("pos", F.round("value", 3).alias("value"))


@query("select event_id, value from events")
def identity_step(spark, sf):
    return compose(identity, identity)(events(spark, sf, "value")).df


# -- filters


@query("select event_id, user_id, event_type from events where value > 50 and event_type <> 'error'")
def filter_events(spark, sf):
    return filter_((c("value") > 50) & (c("event_type") != "error"))(events(spark, sf)).select("user_id", "event_type").df


@query("select event_id, event_type as x from events where event_type <> 'error'")
def not_null_types(spark, sf):
    return (map_(x=F.nullif(c("event_type"), F.lit("error"))) >> not_null())(events(spark, sf)).df


@query("select event_id, value as x from events where event_type = 'purchase'")
def of_type_number(spark, sf):
    buys = c("event_type") == "purchase"
    tagged = map_(x=F.struct(F.when(buys, c("value")).alias("number"), F.when(~buys, c("event_type")).alias("text")))
    return (tagged >> of_type("x", "number"))(events(spark, sf)).df


@query("select event_id, user_id // 2 as x from events where user_id % 2 = 0")
def keep_something_halves(spark, sf):
    return keep_something(F.when(c("user_id") % 2 == 0, F.expr("user_id div 2")))(events(spark, sf)).df


@query("select event_id, nullif(event_type, 'error') as x from events where value > 20")
def keep_something_present(spark, sf):
    return keep_something(F.nullif(c("event_type"), F.lit("error")), present=c("value") > 20)(events(spark, sf)).df


@query("select min(event_id) as event_id, user_id from events group by user_id")
def unique_users(spark, sf):
    return unique("user_id")(events(spark, sf, "user_id")).df


@query("select event_id, event_type from (select *, lag(event_type) over (order by event_id) as p from events) where event_type is distinct from p")
def dedupe_types(spark, sf):
    return dedupe("event_type")(events(spark, sf, "event_type")).df


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as p from events) where event_type is distinct from p")
def dedupe_per_user(spark, sf):
    return per_group(dedupe("event_type"), "user_id")(events(spark, sf, "user_id", "event_type")).df.select("event_id", "user_id", "event_type")


# -- slices


@query("select event_id, value from events order by event_id limit 10")
def take_first(spark, sf):
    return take(10)(events(spark, sf, "value")).df


@query("select event_id, value from events order by event_id desc limit 7")
def take_last_events(spark, sf):
    return take_last(7)(events(spark, sf, "value")).df


@query("select event_id, user_id, value from (select *, row_number() over (partition by user_id order by event_id) as r from events) where r <= 2")
def take_per_user(spark, sf):
    return per_group(take(2), "user_id")(events(spark, sf, "user_id", "value")).df


@query("select event_id, value from events where event_id < (select coalesce(min(event_id), 9e18) from events where value > 95)")
def take_while_small(spark, sf):
    return take_while(c("value") <= 95)(events(spark, sf, "value")).df


@query("select event_id, value from (select *, row_number() over (order by event_id) - 1 as i from events) where i % 9 = 0")
def take_every_ninth(spark, sf):
    return take_nth(9)(events(spark, sf, "value")).df


@query("select event_id, value from events order by event_id offset 25")
def drop_first(spark, sf):
    return drop(25)(events(spark, sf, "value")).df


@query("select event_id, value from events order by event_id limit (select count(*) - 30 from events)")
def drop_last_events(spark, sf):
    return drop_last(30)(events(spark, sf, "value")).df


@query("select event_id, value from events where event_id >= (select min(event_id) from events where event_type = 'purchase')")
def drop_while_not_buying(spark, sf):
    return drop_while(c("event_type") != "purchase")(events(spark, sf)).select("value").df


@query("select event_id, value from events where event_id <= (select min(event_id) from events where event_type = 'error')")
def reduce_if_error(spark, sf):
    return reduce_if(c("event_type") == "error")(events(spark, sf)).select("value").df


@query("select event_id, value from events where event_id < (select min(event_id) from events where event_type = 'error')")
def abort_if_error(spark, sf):
    return abort_if(c("event_type") == "error")(events(spark, sf)).select("value").df


@query("""with f as (select user_id as u, min(event_id) as m from events where event_type = 'error' group by 1)
select event_id, user_id, value from events left join f on user_id = u where m is null or event_id <= m""")
def reduce_if_per_user(spark, sf):
    return per_group(reduce_if(c("event_type") == "error"), "user_id")(events(spark, sf)).select("value").df


# -- flattening


@query("select doc_id, (p - 1)::INT as pos, w as x from (select doc_id, unnest(string_split(text, ' ')) as w, unnest(range(1, len(string_split(text, ' ')) + 1)) as p from documents)")
def cat_words(spark, sf):
    return (map_(x=F.split("text", " ")) >> cat("x"))(load(spark, sf, "documents", "text")).df


@query("select event_id, pos::INT as pos, value * (pos + 1) as x from events, (values (0), (1), (2)) as p(pos) where event_type = 'click'")
def map_cat_multiples(spark, sf):
    return (filter_(c("event_type") == "click") >> map_cat(F.array(*[c("value") * k for k in (1, 2, 3)])))(events(spark, sf)).df


@query("select vec_id, (p - 1)::INT as pos, round(x::DOUBLE, 6) as x from (select vec_id, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as p from embeddings)")
def tcat_embeddings(spark, sf):
    s = load(spark, sf, "embeddings").select(c("embedding").cast("array<double>").alias("x"))
    return tcat("x", 8)(s).df.select("vec_id", "pos", F.round("x", 6).alias("x"))


@F.udtf(returnType="place int, digit string")
class _Digits:
    def eval(self, x: int):
        for i, digit in enumerate(str(x)):
            yield i, digit


@query("select c_custkey, (p - 1)::INT as pos, substr(c_custkey::VARCHAR, p, 1) as digit from customer, range(1, 20) r(p) where p <= length(c_custkey::VARCHAR)")
def table_function(spark, sf):
    """A function in Python that gives a table for each element."""
    return map_table(_Digits, c("key"))(map_(key=c("c_custkey"))(load(spark, sf, "customer"))).df


# -- windows


WINDOWED = """with e as (select *, row_number() over (order by event_id) - 1 as i from events), n as (select count(*) as n from e)"""


@query(WINDOWED + " select (i // 50)::BIGINT as k, count(*)::BIGINT as size, round(sum(value), 4) as total from e, n where i // 50 < n // 50 group by 1")
def tumbling(spark, sf):
    chunks = partition(50, column="value")(events(spark, sf)).df
    return chunks.select("k", F.size("xs").cast("long").alias("size"), F.round(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(WINDOWED + ", k as (select unnest(range(0, (n - 5) // 2 + 1)) as k from n where n >= 5) select k, string_agg(event_id::VARCHAR, ',' order by i) as xs from k join e on i >= k * 2 and i < k * 2 + 5 group by k")
def hopping(spark, sf):
    return partition(5, 2, column="id")(with_values(id=c("event_id") + 0)(events(spark, sf))).df.select("k", joined().alias("xs"))


@query(WINDOWED + " select (i // 64)::BIGINT as k, string_agg(event_id::VARCHAR, ',' order by i) as xs from e group by 1")
def tumbling_flush(spark, sf):
    return partition(64, flush=True, column="id")(with_values(id=c("event_id") + 0)(events(spark, sf))).df.select("k", joined().alias("xs"))


@query("""with e as (select *, lead(user_id, 1) over w as b, lead(user_id, 2) over w as d from events window w as (order by event_id))
select event_id, user_id as _1, b as _2, d as _3 from e where d is not null""")
def consecutive_triples(spark, sf):
    return consecutive(3)(events(spark, sf, "user_id")).df.select("event_id", "xs.*")


RUNS = "with c as (select *, case when event_type is distinct from lag(event_type) over (order by event_id) and row_number() over (order by event_id) > 1 then 1 else 0 end as c from events), r as (select *, (sum(c) over (order by event_id))::BIGINT as run from c)"


@query(RUNS + " select run, string_agg(event_id::VARCHAR, ',' order by event_id) as xs from r group by run")
def runs_of_types(spark, sf):
    return partition_by(c("event_type"), "id")(with_values(id=c("event_id") + 0)(events(spark, sf))).df.select("run", joined().alias("xs"))


@query(RUNS + " select run, min(i) as first, max(i) as last from (select *, row_number() over (order by event_id) - 1 as i from r) group by run")
def run_ranges(spark, sf):
    return ranges_by(c("event_type"))(events(spark, sf, "event_type")).df


@query(RUNS + " select run, count(*)::BIGINT as n, max(value) as top, min(event_type) as kind from r group by run")
def reduced_runs(spark, sf):
    return reduce_partition_by(c("event_type"), n=F.count("*"), top=F.max("value"), kind=F.min("event_type"))(events(spark, sf)).df


@query(RUNS + ", l as (select run, event_type, count(*) as n from r group by 1, 2) select event_type, max(n)::BIGINT as longest from l group by 1")
def longest_runs(spark, sf):
    runs = reduce_partition_by(c("event_type"), n=F.count("*"), event_type=F.min("event_type"))(events(spark, sf, "event_type"))
    return runs.df.groupBy("event_type").agg(F.max("n").alias("longest"))


SPLIT = "with d as (select *, (event_type = 'error')::INT as d from events), s as (select *, (sum(d) over (order by event_id) - d)::BIGINT as chunk from d)"


@query(SPLIT + " select chunk, string_agg(event_id::VARCHAR, ',' order by event_id) as xs from s where d = 0 group by chunk")
def split_at_errors(spark, sf):
    return split_by(c("event_type") == "error", column="id")(with_values(id=c("event_id") + 0)(events(spark, sf))).df.select("chunk", joined().alias("xs"))


@query(SPLIT + " select chunk, coalesce(string_agg(event_id::VARCHAR, ',' order by event_id) filter (where d = 0), '') as xs from s group by chunk")
def split_keeping_empty(spark, sf):
    return split_by(c("event_type") == "error", keepempty=True, column="id")(with_values(id=c("event_id") + 0)(events(spark, sf))).df.select("chunk", joined().alias("xs"))


@query(SPLIT + " select chunk, string_agg(event_id::VARCHAR, ',' order by event_id) as xs from s group by chunk")
def split_keeping_ends(spark, sf):
    return split_by(c("event_type") == "error", keepend=True, column="id")(with_values(id=c("event_id") + 0)(events(spark, sf))).df.select("chunk", joined().alias("xs"))


@query(SPLIT + " select chunk, count(*)::BIGINT as n, max(value) as top from s where d = 0 group by chunk")
def reduced_split(spark, sf):
    return reduce_split_by(c("event_type") == "error", n=F.count("*"), top=F.max("value"))(events(spark, sf)).df


@query("select item_id, len(string_split(text, ' '))::INT - (text like '% ')::INT as words from benchmark")
def split_strings(spark, sf):
    return split_string("text", " ")(load(spark, sf, "benchmark", "text")).df.select("item_id", F.size("xs").alias("words"))


# -- scans and branches


@query("select event_id, round(sum(value) over (order by event_id), 4) as x from events")
def scan_sum(spark, sf):
    return scan("sum", "value")(events(spark, sf)).df.select("event_id", F.round("x", 4).alias("x"))


@query("select event_id, user_id, max(value) over (partition by user_id order by event_id) as x from events")
def scan_max_per_user(spark, sf):
    return per_group(scan("max", "value"), "user_id")(events(spark, sf)).df


@query("select n_nationkey, (100 + sum(n_regionkey) over (order by n_nationkey))::BIGINT as x from nation")
def scan_with_init(spark, sf):
    s = map_(r=c("n_regionkey").cast("long"))(load(spark, sf, "nation"))
    return scan("sum", "r", F.lit(100).cast("long"))(s).df


@query("with recursive t as (select 0 as n_nationkey, (select n_regionkey::BIGINT from nation where n_nationkey = 0) as x union all select n.n_nationkey, n.n_regionkey - t.x from t join nation n on n.n_nationkey = t.n_nationkey + 1) select * from t")
def scan_any_function(spark, sf):
    s = map_(r=c("n_regionkey").cast("long"))(load(spark, sf, "nation"))
    return scan(lambda a, x: x - a, "r")(s).df


@query("select event_id, 0 as pos, coalesce(lag(user_id) over (order by event_id), 0) as x from events")
def scan_emit_delay(spark, sf):
    return scan_emit(lambda state, row: (state, int(row.user_id)), 0, "x long")(events(spark, sf, "user_id")).df


@query("select event_id, user_id, 0 as pos, (sum((event_type = 'click')::INT) over (partition by user_id order by event_id))::BIGINT as clicks from events")
def adhoc_click_counter(spark, sf):
    def f(state, row):
        state += row.event_type == "click"
        return state, [(state,)]

    return per_group(adhoc(f, lambda: 0, "clicks long"), "user_id")(events(spark, sf, "user_id", "event_type")).df


@query("select event_id, round(avg(value) over (order by event_id) * row_number() over (order by event_id), 2) as x from events")
def running_mean(spark, sf):
    return running_stat("mean", "value", "m")(events(spark, sf)).indexed().df.select("event_id", F.round(c("m") * (c("i") + 1), 2).alias("x"))


@query("select event_id, case when row_number() over w > 1 then round(var_samp(value) over w * 1000) end as x, max(value) over w as top from events window w as (order by event_id)")
def running_variance(spark, sf):
    both = zip_(x=running_stat("variance", "value"), top=running_stat("max", "value"))
    return both(events(spark, sf)).df.select("event_id", F.round(c("x") * 1000).alias("x"), "top")


@query("select event_id, user_id, case when count(*) over w > 1 then round(var_samp(value) over w * count(*) over w * (count(*) over w - 1) + 0.00003, 2) end as x from events window w as (partition by user_id order by event_id)")
def welford_per_user(spark, sf):
    """The running variance; times n (n - 1), so values of two places give no ties to round."""
    both = zip_(v=running_stat("variance", "value"), n=count(F.lit(1).cast("long")))
    s = per_group(both, "user_id")(events(spark, sf))
    return s.df.select("event_id", "user_id", F.round(c("v") * c("n") * (c("n") - 1) + 0.00003, 2).alias("x"))


@query("select event_id, row_number() over (order by event_id) as n, value as x from (select * from events) where true qualify event_type <> 'error'")
def zip_counter_and_filter(spark, sf):
    clean = filter_(c("event_type") != "error") >> map_(x=c("value"))
    return zip_(n=count(F.lit(1).cast("long")), x=clean)(events(spark, sf)).df


@query("select event_id, value * 10 as x, event_type from events where event_type = 'purchase'")
def zip_source_purchases(spark, sf):
    step = filter_(c("event_type") == "purchase") >> map_(x=c("value") * 10)
    return zip_source(step)(events(spark, sf)).df.select("event_id", "x", "source.event_type")


# -- sources


@query("select c_custkey as id, 0 as branch, c_name as name from customer union all select s_suppkey, 1, s_name from supplier")
def concat_tables(spark, sf):
    a = load(spark, sf, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"))
    b = load(spark, sf, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"))
    return concat(a, b).df.select("id", "branch", "name")


@query("select r_name as a, n_name as b, row_number() over (order by n_nationkey, r_regionkey) - 1 as i from region, nation")
def product_source(spark, sf):
    s = product(load(spark, sf, "region", "r_name"), load(spark, sf, "nation", "n_name")).indexed("i")
    return s.df.select(c("r_name1").alias("a"), c("n_name2").alias("b"), "i")


@query("""select i, r_name as a, n_name as b from (select *, row_number() over (order by n_nationkey, r_regionkey) - 1 as i from region, nation) where i % 5 = 0""")
def product_every_fifth(spark, sf):
    s = product(load(spark, sf, "region", "r_name"), load(spark, sf, "nation", "n_name")).indexed("i")
    return take_nth(5)(s).df.select("i", c("r_name1").alias("a"), c("n_name2").alias("b"))


@query("""with r as (select r_name, row_number() over (order by r_regionkey) - 1 as ord from region), n as (select n_name, row_number() over (order by n_nationkey) - 1 as ord from nation)
select ord, r_name as x1, n_name as x2 from r join n using (ord)""")
def zip_source_tables(spark, sf):
    return zipped(load(spark, sf, "region", "r_name"), load(spark, sf, "nation", "n_name")).df


@query("select vec_id, (p - 1)::INT as pos, round(x::DOUBLE, 6) as x from (select vec_id, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as p from embeddings)")
def block_source(spark, sf):
    s = blocks(load(spark, sf, "embeddings").df, "vec_id", "embedding")
    return s.df.select("vec_id", "pos", F.round(c("x").cast("double"), 6).alias("x"))


@query("select vec_id, max(x)::DOUBLE as top from (select vec_id, unnest(embedding) as x from embeddings) group by 1")
def array_source(spark, sf):
    s = from_array(load(spark, sf, "embeddings").df, "embedding", "vec_id")
    return s.df.groupBy("vec_id").agg(F.max(c("x").cast("double")).alias("top"))


@query("select p::BIGINT as part, k::BIGINT as pos, (p * 100 + k)::BIGINT as x from range(4) a(p), range(25) b(k)")
def generated_source(spark, sf):
    return generated(spark, lambda part: ((part * 100 + k,) for k in range(25)), 4, "x long").df


@query("select ord, 2 * ord + 5 as x from (select range as ord from range(100))")
def range_source(spark, sf):
    return as_seq(spark, range(5, 205, 2)).df


@query("select range as ord, 7 * range - 100 as x from range(5000)")
def custom_source(spark, sf):
    register_source(spark, RangeSource)
    return spark.read.format(RangeSource.name()).options(start="-100", end="34900", step="7", parts="4").load()


@query("select n_nationkey, n_name || '!' as x from nation where n_regionkey > 1")
def comprehension(spark, sf):
    return comprehend(load(spark, sf, "nation"), where=c("n_regionkey") > 1, x=F.concat("n_name", F.lit("!"))).df
