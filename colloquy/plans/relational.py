"""Relational queries on the star schema, statistics, and the reader of joined reviews."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators.quantiles import exact_quantiles, wide
from colloquy.plans.registry import Registry
from colloquy.runtime import read_table

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, round(avg(l_discount), 6) avg_disc, count(*) n
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def rel_pricing_summary(spark, d):
    t = read_table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query("""select n_name, count(*) n_orders, round(sum(o_totalprice), 2) total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name""")
def rel_inner_join(spark, d):
    o, c, n = (read_table(spark, d, t) for t in ("orders", "customer", "nation"))
    per = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"), F.sum("o_totalprice").alias("s"))  # reduced before the joins
    j = per.join(c, per["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy("n_name").agg(F.sum("k").alias("n_orders"), F.round(F.sum("s"), 2).alias("total"))


@query("select c_custkey, count(o_orderkey) n_orders from customer left join orders on o_custkey = c_custkey group by c_custkey")
def rel_left_join(spark, d):
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders")
    per = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return c.join(per, c["c_custkey"] == per["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def rel_semi_join(spark, d):
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders").where("o_totalprice > 200000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def rel_anti_join(spark, d):
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders").where("o_totalprice > 300000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("select coalesce(s_nationkey, c_nationkey) nationkey, count(distinct s_suppkey) n_sup, count(distinct c_custkey) n_cus from (select * from supplier where s_acctbal > 5000) s full join (select * from customer where c_acctbal > 9000) c on s_nationkey = c_nationkey group by 1")
def rel_full_join(spark, d):
    s = read_table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count_distinct("s_suppkey").alias("n_sup"))
    c = read_table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count_distinct("c_custkey").alias("n_cus"))
    return s.join(c, "nationkey", "full_outer").fillna(0, ["n_sup", "n_cus"])


@query("select l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) lvl, count(*) n, round(sum(l_quantity), 2) qty from lineitem group by rollup (l_returnflag, l_linestatus)")
def rel_rollup(spark, d):
    g = read_table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg((F.grouping("l_returnflag") + F.grouping("l_linestatus")).cast("int").alias("lvl"), F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return g


@query("select o_orderstatus, o_orderpriority, count(*) n from orders group by cube (o_orderstatus, o_orderpriority)")
def rel_cube(spark, d):
    return read_table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def rel_grouping_sets(spark, d):
    o = read_table(spark, d, "orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("select s_nationkey nationkey from supplier intersect select c_nationkey from customer where c_acctbal < 0")
def rel_intersect(spark, d):
    s, c = read_table(spark, d, "supplier"), read_table(spark, d, "customer").where("c_acctbal < 0")
    return s.select(F.col("s_nationkey").alias("nationkey")).intersect(c.select("c_nationkey"))


@query("select p_partkey partkey from part except select l_partkey from lineitem where l_quantity > 49")
def rel_except(spark, d):
    p, li = read_table(spark, d, "part"), read_table(spark, d, "lineitem").where("l_quantity > 49")
    return p.select(F.col("p_partkey").alias("partkey")).exceptAll(li.select("l_partkey").distinct())


@query("select n_nationkey k, n_name v from nation union select r_regionkey, r_name from region")
def rel_union(spark, d):
    n, r = read_table(spark, d, "nation"), read_table(spark, d, "region")
    return n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")).union(r.select("r_regionkey", "r_name")).distinct()


@query("select o_custkey, o_orderkey, k from (select *, cast(row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as int) k from orders) where k <= 3")
def rel_topk_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read_table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k")).where("k <= 3")


@query("""select c_custkey, cast(ntile(4) over w as int) quartile, cast(rank() over w as int) rnk, cast(dense_rank() over w as int) dense, round(percent_rank() over w, 6) pct, lag(c_custkey) over w prev, lead(c_custkey) over w next
from customer window w as (partition by c_nationkey order by c_acctbal, c_custkey)""")
def rel_window_functions(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return read_table(spark, d, "customer").select(
        "c_custkey", F.ntile(4).over(w).alias("quartile"), F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"),
        F.round(F.percent_rank().over(w), 6).alias("pct"), F.lag("c_custkey").over(w).alias("prev"), F.lead("c_custkey").over(w).alias("next"),
    )


@query("select o_orderstatus, round(quantile_cont(o_totalprice, 0.5), 2) median, round(quantile_cont(o_totalprice, 0.9), 2) p90, round(stddev_samp(o_totalprice), 2) sd from orders group by 1")
def rel_quantiles(spark, d):
    o = read_table(spark, d, "orders")
    q = wide(exact_quantiles(o, ["o_orderstatus"], "o_totalprice", {"median": 0.5, "p90": 0.9}, linear=True), ["o_orderstatus"], ["median", "p90"])
    sd = o.groupBy("o_orderstatus").agg(F.round(F.stddev_samp("o_totalprice"), 2).alias("sd"))
    return sd.join(q, "o_orderstatus", "left").select("o_orderstatus", F.round("median", 2).alias("median"), F.round("p90", 2).alias("p90"), "sd")


@query("""select round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 4) intercept, round(corr(l_extendedprice, l_quantity), 6) corr, count(*) n from lineitem""")
def ols_corr(spark, d):
    return read_table(spark, d, "lineitem").agg(
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"),
        F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("corr"), F.count(F.lit(1)).alias("n"),
    )


@query("""with q as (select quantile_cont(o_totalprice, 0.3) lo, quantile_cont(o_totalprice, 0.7) hi from orders), x as (select o_totalprice, extract(dow from o_orderdate)::double y from orders),
g as (select count(*) filter (where o_totalprice >= hi) nh, count(*) filter (where o_totalprice <= lo) nl, avg(y) filter (where o_totalprice >= hi) mh, avg(y) filter (where o_totalprice <= lo) ml,
  var_samp(y) filter (where o_totalprice >= hi) vh, var_samp(y) filter (where o_totalprice <= lo) vl from x, q)
select nh n_high, nl n_low, round(mh - ml, 6) diff, round((mh - ml) / sqrt(vh / nh + vl / nl), 4) t from g""")
def welch_t(spark, d):
    """High against low by the 0.3 and 0.7 quantiles, both inclusive."""
    o = read_table(spark, d, "orders").select("o_totalprice", (F.dayofweek("o_orderdate") - 1).cast("double").alias("y"))
    q = wide(exact_quantiles(o, [], "o_totalprice", {"lo": 0.3, "hi": 0.7}, linear=True), [], ["lo", "hi"]).drop("n")
    x = o.join(F.broadcast(q))
    hi, lo = F.when(F.expr("o_totalprice >= hi"), F.col("y")), F.when(F.expr("o_totalprice <= lo"), F.col("y"))
    g = x.agg(F.count(hi).alias("nh"), F.count(lo).alias("nl"), F.avg(hi).alias("mh"), F.avg(lo).alias("ml"), F.var_samp(hi).alias("vh"), F.var_samp(lo).alias("vl"))
    return g.select(F.col("nh").alias("n_high"), F.col("nl").alias("n_low"), F.round(F.expr("mh - ml"), 6).alias("diff"), F.round(F.expr("(mh - ml) / sqrt(vh / nh + vl / nl)"), 4).alias("t"))


@query()
def bootstrap_ci(spark, d):
    """Mean difference of the weekday between high and low prices, as in welch_t, over 2,000 seeded resamples, and its 95 % interval.

    A resample with replacement is drawn as counts of the distinct values, which is the same
    distribution; Python gets one row for each group and value. Without two rows a group no row."""
    o = read_table(spark, d, "orders").select("o_totalprice", (F.dayofweek("o_orderdate") - 1).cast("double").alias("y"))
    q = wide(exact_quantiles(o, [], "o_totalprice", {"lo": 0.3, "hi": 0.7}, linear=True), [], ["lo", "hi"]).drop("n")
    side = F.array(F.when(F.expr("o_totalprice >= hi"), "high"), F.when(F.expr("o_totalprice <= lo"), "low"))
    x = o.join(F.broadcast(q)).where("y is not null").select("y", F.explode(F.array_compact(side)).alias("side"))

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        rng, means = np.random.default_rng(42), {}
        for g in ("high", "low"):
            t = pdf[pdf.side == g].sort_values("y")
            n = int(t["n"].sum())
            if n < 2:
                return pd.DataFrame({"mean_diff": [], "low": [], "high": []})
            share, y = (t["n"] / n).to_numpy(), t["y"].to_numpy()
            means[g] = np.array([rng.multinomial(n, share) @ y for _ in range(2000)]) / n
        diff = means["high"] - means["low"]
        return pd.DataFrame({"mean_diff": [diff.mean()], "low": [np.quantile(diff, 0.025)], "high": [np.quantile(diff, 0.975)]})

    c = x.groupBy("side", "y").agg(F.count(F.lit(1)).alias("n")).groupBy().applyInPandas(resample, "mean_diff double, low double, high double")
    return c.select(*(F.round(n, 6).alias(n) for n in ("mean_diff", "low", "high")))


@query("""with j as (select distinct * from joined_qa_audio_review), m as (select unnest(transcript_hedge_markers) marker, row_id from j) select lower(trim(marker)) marker, count(*) n, count(distinct row_id) n_rows from m where trim(marker) <> '' group by 1""")
def hedge_markers(spark, d):
    j = read_table(spark, d, "joined_qa_audio_review").distinct().select("row_id", F.explode("transcript_hedge_markers").alias("m"))
    return j.where("trim(m) <> ''").groupBy(F.lower(F.trim("m")).alias("marker")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("n_rows"))


@query(r"""with j as (select distinct row_id, answer_time_range r, review_priority p from joined_qa_audio_review), t as (select row_id, lower(trim(coalesce(p, ''))) p, regexp_extract(r, '^(\d+):(\d+)-(\d+):(\d+)$', ['a', 'b', 'c', 'd']) x from j where regexp_matches(r, '^\d+:\d+-\d+:\d+$'))
select p priority, count(*) n, round(avg((x.c::int * 60 + x.d::int) - (x.a::int * 60 + x.b::int)), 4) mean_seconds from t group by p""")
def answer_durations(spark, d):
    p = r"^(\d+):(\d+)-(\d+):(\d+)$"
    j = read_table(spark, d, "joined_qa_audio_review").select("row_id", "answer_time_range", "review_priority").distinct().where(F.col("answer_time_range").rlike(p))
    g = lambda i: F.regexp_extract("answer_time_range", p, i).cast("int")
    secs = g(3) * 60 + g(4) - g(1) * 60 - g(2)
    return j.groupBy(F.lower(F.trim(F.coalesce("review_priority", F.lit("")))).alias("priority")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(secs), 4).alias("mean_seconds"))
