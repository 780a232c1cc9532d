"""What Spark adds to sequences: keyed joins, set operations, grouping sets, event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.projections import small
from ..streaming.channels import windowed
from .registry import load, query

c = F.col


@query("select n_name, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
def join_orders(spark, sf):
    o, k, n = (load(spark, sf, t).df for t in ("orders", "customer", "nation"))
    joined = o.join(k, c("o_custkey") == c("c_custkey")).join(small(n), c("c_nationkey") == c("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
def anti_join(spark, sf):
    big = load(spark, sf, "orders").df.where("o_totalprice > 100000")
    return load(spark, sf, "customer").df.join(big, c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def semi_join(spark, sf):
    done = load(spark, sf, "orders").df.where("o_orderstatus = 'F'")
    return load(spark, sf, "customer").df.join(done, c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey")


@query("select e.event_id, coalesce(max(p.event_id), -1) as last_purchase from events e left join events p on p.user_id = e.user_id and p.event_type = 'purchase' and p.event_id <= e.event_id where e.event_type = 'error' group by 1")
def as_of_join(spark, sf):
    """The last purchase before each error: a running maximum over both, no range join."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = load(spark, sf, "events", "user_id", "event_type").df
    last = F.coalesce(F.max(F.when(c("event_type") == "purchase", c("event_id"))).over(w), F.lit(-1))
    return e.withColumn("last_purchase", last).where("event_type = 'error'").select("event_id", "last_purchase")


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier where s_acctbal > 0")
def intersect_nations(spark, sf):
    a = load(spark, sf, "customer").df.select(c("c_nationkey").alias("k"))
    return a.intersect(load(spark, sf, "supplier").df.where("s_acctbal > 0").select("s_nationkey"))


@query("select user_id from events except select user_id from events where event_type = 'error' and value > 60")
def except_users(spark, sf):
    e = load(spark, sf, "events").df
    return e.select("user_id").subtract(e.where("event_type = 'error' and value > 60").select("user_id"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_counts(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup_sums(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("select p_brand, p_partkey, r from (select p_brand, p_partkey, (row_number() over (partition by p_brand order by p_retailprice desc, p_partkey))::INT as r from part) where r <= 3")
def top_per_brand(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return load(spark, sf, "part").df.withColumn("r", F.row_number().over(w)).where("r <= 3").select("p_brand", "p_partkey", "r")


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as start, event_type, count(*) as n from events group by 1, 2")
def hourly_windows(spark, sf):
    e = load(spark, sf, "events").df.withColumn("ts", c("ts").cast("timestamp"))
    return windowed(e, "ts", "1 hour", "1 hour", "event_type", n=F.count("*")).select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")
