"""Aggregations, runs, ranks and the flagship phenotype query."""
from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.operators import aggregates as ag, filters as fl, sets as st
from cladeloom.operators.ordered import join_same, quantile_column, quantiles, row_index, with_avg_rank
from cladeloom.plans import views as v
from cladeloom.plans.registry import query, table


@query("species_phenotype", f"""
with {v.POINTS}, c as (select distinct species, lat, lon, value from v_points where not (lat = 0 and lon = 0) and lat between -90 and 90 and lon between -180 and 180),
q as (select species, quantile_cont(value, 0.1) as p10, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.9) as p90, count(*) as n from c group by 1 having count(*) > 4)
select species, c_mktsegment as trait, round(p10, 6) as p10, round(p50, 6) as p50, round(p90, 6) as p90, n from q left join customer on c_custkey = species""")
def _(s, d):
    p = fl.coord_filter(v.points(s, d)).select("species", "lat", "lon", "value").distinct()
    q = quantiles(p, "value", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["species"]).where("n > 4")
    c = table(s, d, "customer").select(F.col("c_custkey").alias("species"), F.col("c_mktsegment").alias("trait"))
    return q.join(c, "species", "left").select("species", "trait", *[v.rnd(x).alias(x) for x in ("p10", "p50", "p90")], "n")


@query("count_by", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2")
def _(s, d):
    return ag.value_counts(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("summary_stats", """
select count(*) as n_rows, count(distinct user_id) as n_species, count(distinct event_type) as n_countries,
  min(value) as min_value, max(value) as max_value from events""")
def _(s, d):
    return ag.summary_stats(table(s, d, "events"), {"n_species": "user_id", "n_countries": "event_type"}, ["value"])


@query("retention_report", """
with t as (select count(*) as processed, count(*) filter (value > 20) as a, count(*) filter (value > 20 and event_type <> 'error') as b,
  count(*) filter (value > 20 and event_type <> 'error' and user_id % 2 = 0) as c from events)
select 0 as stage_no, 'positive' as stage, processed, a as kept, round(a / processed, 6) as rate from t
union all select 1, 'typed', processed, b, round(b / processed, 6) from t union all select 2, 'even', processed, c, round(c / processed, 6) from t""")
def _(s, d):
    r = ag.retention_report(table(s, d, "events"), {"positive": F.col("value") > 20, "typed": F.col("event_type") != "error", "even": F.col("user_id") % 2 == 0})
    return r.withColumn("rate", v.rnd("rate"))


@query("group_quantiles", """
select l_suppkey, round(quantile_cont(l_extendedprice, 0.1), 6) as p10, round(quantile_cont(l_extendedprice, 0.5), 6) as p50,
  round(quantile_cont(l_extendedprice, 0.9), 6) as p90, count(*) as n from lineitem group by 1""")
def _(s, d):
    q = quantiles(table(s, d, "lineitem"), "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, ["l_suppkey"])
    return q.select("l_suppkey", *[v.rnd(x).alias(x) for x in ("p10", "p50", "p90")], "n")


@query("global_quantile_threshold", """
select l_returnflag, count(*) filter (l_extendedprice <= q) as at_or_below, count(*) filter (l_extendedprice < q) as below
from lineitem, (select quantile_cont(l_extendedprice, 0.1) as q from lineitem) group by 1""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_returnflag", "l_extendedprice")
    q = quantile_column(li, "l_extendedprice", 0.1)
    x = F.col("l_extendedprice")
    return li.withColumn("q", q).groupBy("l_returnflag").agg(F.count_if(x <= F.col("q")).alias("at_or_below"), F.count_if(x < F.col("q")).alias("below"))


@query("group_median_n", """
select l_returnflag, l_linenumber, round(median(l_quantity), 6) as med_q, round(median(l_extendedprice), 6) as med_p, count(*) as n from lineitem group by 1, 2""")
def _(s, d):
    li = table(s, d, "lineitem")
    by = ["l_returnflag", "l_linenumber"]
    a = quantiles(li, "l_quantity", {"med_q": 0.5}, by).drop("n")
    b = quantiles(li, "l_extendedprice", {"med_p": 0.5}, by)
    return a.join(b, by).select(*by, v.rnd("med_q").alias("med_q"), v.rnd("med_p").alias("med_p"), "n")


@query("group_moments", """
select l_suppkey, count(*) as n, round(avg(l_quantity), 5) as mean, round(stddev_samp(l_quantity), 5) as sd, round(stddev_samp(l_quantity) / sqrt(count(*)), 5) as se,
  round(stddev_samp(l_quantity) / avg(l_quantity), 5) as cv, max(l_quantity) - min(l_quantity) as range from lineitem group by 1""")
def _(s, d):
    m = ag.group_moments(table(s, d, "lineitem"), ["l_suppkey"], "l_quantity")
    return m.withColumns({c: v.rnd(c, 5) for c in ("mean", "sd", "se", "cv")})


@query("multi_agg_named", """
select l_returnflag, count(*) as n, round(avg(l_tax), 4) as mean_tax, round(stddev_samp(l_tax), 4) as sd_tax, max(l_tax) as max_tax,
  round(avg((l_discount > 0.05)::int), 4) as share_discounted from lineitem group by 1""")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").agg(
        v.count_as(), v.rnd(F.avg("l_tax"), 4).alias("mean_tax"), v.rnd(F.stddev_samp("l_tax"), 4).alias("sd_tax"), F.max("l_tax").alias("max_tax"),
        v.rnd(F.avg((F.col("l_discount") > 0.05).cast("int")), 4).alias("share_discounted"))


@query("conditional_counts", """
select l_suppkey, count(*) filter (l_quantity > 25) as n_large, count(*) filter (l_returnflag = 'R' and l_tax = 0) as n_r0, sum((l_discount = 0)::bigint)::bigint as n_gap
from lineitem group by 1""")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_quantity") > 25).alias("n_large"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_tax") == 0)).alias("n_r0"),
        F.sum(F.when(F.col("l_discount") == 0, 1).otherwise(0)).alias("n_gap"))


@query("majority_label", """
with c as (select user_id, lower(event_type) as label, count(*) as n from events where lower(event_type) <> 'error' group by 1, 2)
select user_id, n, label from (select *, row_number() over (partition by user_id order by n desc, label) as rn from c) where rn = 1""")
def _(s, d):
    return ag.majority_label(table(s, d, "events"), ["user_id"], F.lower("event_type"), ["error"])


@query("conflicting_keys", """
select o_custkey from orders group by 1 having count(distinct o_orderpriority) > 1""")
def _(s, d):
    return ag.conflicting_keys(table(s, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("contingency_table", """
select l_returnflag, count(*) filter (l_linestatus = 'F') as F, count(*) filter (l_linestatus = 'O') as O from lineitem group by 1""")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().fillna(0)


@query("proportion_within", """
select l_returnflag, l_linestatus, l_linenumber, count(*) as n, cast(sum(count(*)) over (partition by l_returnflag) as bigint) as total,
  round(count(*) / sum(count(*)) over (partition by l_returnflag), 8) as share from lineitem group by 1, 2, 3""")
def _(s, d):
    p = ag.proportion_within(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_returnflag"])
    return p.withColumn("share", v.rnd("share", 8))


@query("median_by_key_pivot", """
with m as (select l_partkey, l_returnflag, median(l_discount) as m from lineitem group by 1, 2),
w as (select l_partkey, max(m) filter (l_returnflag = 'A') as A, max(m) filter (l_returnflag = 'N') as N, max(m) filter (l_returnflag = 'R') as R from m group by 1)
select l_partkey, round(A, 6) as A, round(N, 6) as N, round(R, 6) as R, round(case when N > 0 then log10(N) end, 6) + 0.0 as log10_N, round(case when A > 0 then log10(A) end, 6) + 0.0 as log10_A, round(case when R > 0 then log10(R) end, 6) + 0.0 as log10_R,
  round(case when R > 0 then A / R end, 6) as ratio from w""")
def _(s, d):
    w = ag.median_pivot(table(s, d, "lineitem"), ["l_partkey"], "l_returnflag", ["A", "N", "R"], "l_discount")
    return w.select("l_partkey", *[(v.rnd(c) + (0.0 if c.startswith("log") else 0)).alias(c) for c in ("A", "N", "R", "log10_A", "log10_N", "log10_R")],
                    v.rnd(F.when(F.col("R") > 0, F.col("A") / F.col("R"))).alias("ratio"))


@query("best_genome_summary", """
with g as (select o_custkey, count(*) as n from orders group by 1)
select count(*) as n_organisms, count(*) filter (n = 1) as n_singletons, count(*) filter (n > 1) as n_duplicated, cast(sum(greatest(n - 1, 0)) as bigint) as n_surplus from g""")
def _(s, d):
    return ag.best_genome_summary(table(s, d, "orders"), "o_custkey")


_RUNS = """
with r as (select *, case when lag(event_type) over w = event_type and event_id - lag(event_id) over w <= 200 then 0 else 1 end as brk
  from events window w as (partition by user_id order by ts, event_id)),
k as (select *, cast(sum(brk) over (partition by user_id order by ts, event_id) as bigint) as run from r)"""


def _runs(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return ag.break_runs(e, ["user_id"], ["ts", "event_id"], "event_type", "event_id", 200)


@query("lag_break_runs", _RUNS + " select user_id, event_id, run from k")
def _(s, d):
    return _runs(s, d).select("user_id", "event_id", "run")


@query("run_aggregate", _RUNS + """
select user_id, run, min(event_id) as first, max(event_id) as last, count(*) as n, min(event_type) as state from k group by 1, 2""")
def _(s, d):
    return ag.run_aggregate(_runs(s, d), ["user_id"], "event_id", "event_type")


@query("rle_collapse", """
with r as (select *, case when lag(event_type) over w = event_type then 0 else 1 end as brk from events window w as (partition by user_id order by ts, event_id)),
k as (select *, sum(brk) over (partition by user_id order by ts, event_id) as run from r)
select user_id, cast(run as bigint) as run, min(event_type) as state, count(*) as n from k group by 1, 2""")
def _(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    r = ag.break_runs(e, ["user_id"], ["ts", "event_id"], "event_type")
    return r.groupBy("user_id", "run").agg(F.min("event_type").alias("state"), v.count_as())


@query("weighted_group_mean", """
select l_suppkey, l_returnflag, sum(l_quantity) as weight, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as mean from lineitem group by 1, 2""")
def _(s, d):
    return ag.weighted_mean(table(s, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_extendedprice", "l_quantity").withColumn("mean", v.rnd("mean", 4))


@query("gene_order_signature", """
with f as (select l_orderkey, l_linenumber, min(l_extendedprice) as s from lineitem group by 1, 2),
c as (select l_linenumber from f group by 1 having count(*) > 0.4 * (select count(distinct l_orderkey) from lineitem)),
p as (select l_orderkey, string_agg(cast(l_linenumber as varchar), '>' order by s, l_linenumber) as pattern from f where l_linenumber in (select l_linenumber from c) group by 1)
select pattern, count(*) as n_genomes from p group by 1""")
def _(s, d):
    return ag.gene_order_signature(table(s, d, "lineitem"), "l_orderkey", "l_linenumber", "l_extendedprice", 0.4)


@query("haplotype_counts", f"""
with {v.SITES}, h as (select id, string_agg(gene || ':' || pos || allele, ',' order by gene, pos) as haplotype from v_sites group by 1)
select haplotype, count(*) as n from h group by 1""")
def _(s, d):
    return ag.haplotype_counts(v.sites(s, d), F.lit(True))


@query("rollup_totals", """
select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by rollup (l_returnflag, l_linestatus)""")
def _(s, d):
    return table(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(v.count_as(), v.rnd(F.sum("l_quantity"), 2).alias("qty"))


@query("mad_outlier_by_species", f"""
with {v.POINTS}, p as (select event_id, species, lat, lon, radians(lat) as a, radians(lon) as o from v_points),
d as (select x.species, x.event_id, any_value(x.lat) as lat, any_value(x.lon) as lon,
  sum(2 * 6371.0 * asin(sqrt(least(1.0, power(sin((x.a - y.a) / 2), 2) + cos(x.a) * cos(y.a) * power(sin((x.o - y.o) / 2), 2))))) / (count(*) - 1) as m
  from p x join p y on x.species = y.species group by 1, 2),
e as (select species, median(m) as med from d group by 1),
f as (select d.species, median(abs(m - med)) as mad from d join e using (species) group by 1)
select species, round(lat, 6) as lat, round(lon, 6) as lon, count(*) as n_points, round(any_value(m), 4) as mean_dist, cast(any_value(m) > any_value(med) + 2 * any_value(mad) as int) as is_outlier
from d join e using (species) join f using (species) group by 1, d.lat, d.lon""")
def _(s, d):
    m = ag.mad_outliers(v.points(s, d), "species", "event_id", "lat", "lon", 2.0)
    return m.select("species", v.rnd("lat").alias("lat"), v.rnd("lon").alias("lon"), "n_points", v.rnd("mean_dist", 4).alias("mean_dist"), F.col("is_outlier").cast("int").alias("is_outlier"))


@query("largest_hit", """
select l_suppkey, l_extendedprice, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rn from lineitem) where rn = 1""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", "l_extendedprice", "l_linenumber", "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_o"))
    return ag.largest_hit(li, ["l_suppkey"], "l_extendedprice", "_o", ["l_orderkey", "l_linenumber"])


@query("histogram_table", "select l_returnflag, cast(floor((l_extendedprice - 900) / 2500) as bigint) as bin, count(*) as n from lineitem group by 1, 2")
def _(s, d):
    return ag.histogram(table(s, d, "lineitem"), "l_extendedprice", 900.0, 2500.0, ["l_returnflag"])


@query("bin2d_table", """
select cast(floor(l_quantity / 5) as bigint) as bin_x, cast(floor(l_extendedprice / 10000) as bigint) as bin_y, count(*) as n, round(avg(l_tax), 6) as mean_z from lineitem group by 1, 2""")
def _(s, d):
    return ag.bin2d(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", 5.0, 10000.0, "l_tax").withColumn("mean_z", v.rnd("mean_z"))


@query("quantile_bin_means", """
with q as (select quantile_cont(l_quantity, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as b from lineitem),
t as (select len(list_filter(b, lambda z: z < l_quantity)) as bin, l_quantity, l_extendedprice from lineitem, q)
select cast(bin as bigint) as bin, count(*) as n, round(avg(l_quantity), 6) as mean_x, round(avg(l_extendedprice), 4) as mean_y,
  round(stddev_samp(l_extendedprice) / sqrt(count(*)), 4) as se_y from t group by 1""")
def _(s, d):
    q = ag.quantile_bin_means(table(s, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")
    return q.select(F.col("bin").cast("bigint").alias("bin"), "n", v.rnd("mean_x").alias("mean_x"), v.rnd("mean_y", 4).alias("mean_y"), v.rnd("se_y", 4).alias("se_y"))


# ---- windows --------------------------------------------------------------

_RANK = "case tech when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 else 3 end"


@query("best_per_group", f"""
with {v.GENOMES} select organism, id, gene_count, tech, yr from (
  select *, row_number() over (partition by organism order by gene_count desc, yr desc nulls last, {_RANK}, id) as rn from v_genomes) where rn = 1""")
def _(s, d):
    rank = F.when(F.col("tech") == "1-URGENT", 0).when(F.col("tech") == "2-HIGH", 1).when(F.col("tech") == "3-MEDIUM", 2).otherwise(3)
    return ag.best_per_group(v.genomes(s, d), ["organism"], [F.desc("gene_count"), F.desc_nulls_last("yr"), rank, F.col("id")]).select("organism", "id", "gene_count", "tech", "yr")


@query("argmin_per_group", """
select o_custkey, o_totalprice, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as rn from orders) where rn = 1""")
def _(s, d):
    return ag.argmin_per_group(table(s, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("rolling_mean_centered", """
select user_id, event_id, round(case when count(value) over w = 15 then avg(value) over w end, 6) as rolling from events
window w as (partition by user_id order by ts, event_id rows between 7 preceding and 7 following)""")
def _(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id", "value")
    return ag.rolling_mean(e, ["user_id"], ["ts", "event_id"], "value", 15).select("user_id", "event_id", v.rnd("rolling").alias("rolling"))


@query("rank_within", """
select l_suppkey, l_orderkey, l_linenumber, l_partkey, rank() over (partition by l_suppkey order by l_extendedprice)
  + (count(*) over (partition by l_suppkey, l_extendedprice) - 1) / 2 as rank from lineitem""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return with_avg_rank(li, "l_extendedprice", ["l_suppkey"]).drop("l_extendedprice")


@query("cumulative_offsets", """
with g as (select l_suppkey, max(l_orderkey) as len from lineitem group by 1), r as (select *, sum(len) over (order by l_suppkey) as e from g)
select l_suppkey, len, cast(e - len as bigint) as "offset", e - len / 2 as midpoint from r""")
def _(s, d):
    return ag.cumulative_offsets(table(s, d, "lineitem"), "l_suppkey", "l_orderkey")


@query("zscore_within_group", """
select l_orderkey, l_linenumber, l_partkey, round((l_quantity - avg(l_quantity) over w) / stddev_samp(l_quantity) over w, 5) + 0.0 as z_l_quantity,
  round((l_extendedprice - avg(l_extendedprice) over w) / stddev_samp(l_extendedprice) over w, 5) + 0.0 as z_l_extendedprice from lineitem window w as (partition by l_suppkey)""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    z = ag.zscore_within(li, ["l_suppkey"], ["l_quantity", "l_extendedprice"])
    return z.select("l_orderkey", "l_linenumber", "l_partkey", *[(v.rnd(c, 5) + 0.0).alias(c) for c in ("z_l_quantity", "z_l_extendedprice")])


@query("ntile_calibration", """
with t as (select o_totalprice, (o_orderstatus = 'F')::int as obs, ntile(10) over (order by o_totalprice, o_orderkey) as bin from orders)
select bin, round(avg(o_totalprice), 3) as mean_pred, round(avg(obs), 6) as rate, count(*) as n from t group by 1""")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    c = ag.ntile_calibration(o, "o_totalprice", (F.col("o_orderstatus") == "F").cast("int"), ["o_orderkey"])
    return c.select("bin", v.rnd("mean_pred", 3).alias("mean_pred"), v.rnd("rate").alias("rate"), "n")


@query("qq_table", """
with t as (select o_orderkey, o_totalprice / 1e6 as p, row_number() over (order by o_totalprice, o_orderkey) as i, count(*) over () as n from orders)
select o_orderkey, i, round(-log10((i - 0.5) / n), 6) + 0.0 as expected, round(-log10(p), 6) + 0.0 as observed from t""")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") / 1e6).alias("p"))
    return ag.qq_table(o, "p", ["o_orderkey"]).select("o_orderkey", "i", (v.rnd("expected") + 0.0).alias("expected"), (v.rnd("observed") + 0.0).alias("observed"))


@query("first_mapping_per_key", """
select l_partkey, l_orderkey, l_suppkey from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) as rn from lineitem) where rn = 1""")
def _(s, d):
    li = table(s, d, "lineitem")
    return ag.first_mapping_per_key(li, ["l_partkey"], ["l_orderkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_suppkey"])


@query("enumerate_within_group", """
select event_id, 'env_' || user_id || '_' || row_number() over (partition by user_id order by ts, event_id) as env_id from events""")
def _(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "ts")
    r = row_index(e, ["ts", "event_id"], ["user_id"], "_i")
    return r.select("event_id", F.concat(F.lit("env_"), F.col("user_id").cast("string"), F.lit("_"), F.col("_i").cast("string")).alias("env_id"))
