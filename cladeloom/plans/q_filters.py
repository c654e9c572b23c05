"""Filters, rule labels, set operations, top-k and sampling."""
from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.operators import filters as fl, sets as st
from cladeloom.plans import sqlstat as q, views as v
from cladeloom.plans.registry import query, table


@query("clade_filter", """
select doc_id, source, lang from documents
where (source like '%src1%' or source like '%src7%') and source not like '%src13%' and source not like '%src15%'""")
def _(s, d):
    df = table(s, d, "documents").select("doc_id", "source", "lang")
    return fl.clade_filter(df, "source", keep=["src1", "src7"], drop=["src13", "src15"])


@query("range_filter", """
select doc_id, n_chars, length(text) as len from documents where n_chars between 500 and 3000 and length(text) >= 600""")
def _(s, d):
    df = table(s, d, "documents").select("doc_id", "n_chars", F.length("text").cast("bigint").alias("len"))
    return fl.range_filter(df, {"n_chars": (500, 3000), "len": (600, None)})


@query("coord_filter", f"""
with {v.POINTS} select event_id, round(lat, 6) as lat, round(lon, 6) as lon from v_points
where lat is not null and lon is not null and not (lat + lon = 0 and lat - lon = 0)
  and lat between -90 and 90 and lon between -180 and 180""")
def _(s, d):
    df = fl.coord_filter(v.points(s, d).select("event_id", "lat", "lon"))
    return df.select("event_id", v.rnd("lat").alias("lat"), v.rnd("lon").alias("lon"))


@query("recent_filter", """
select l_orderkey, l_linenumber, l_partkey, cast(year(l_shipdate) as bigint) as yr
from lineitem where year(l_shipdate) > 2000""")
def _(s, d):
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.year("l_shipdate").cast("bigint").alias("yr"))
    return fl.recent_filter(df, "yr", 2000)


@query("name_in_set", """
with k as (select distinct regexp_replace(c_name, '[^0-9A-Za-z]', '', 'g') as k from customer where c_acctbal > 5000)
select o_orderkey from orders
where regexp_replace('Customer-' || lpad(cast(o_custkey as varchar), 9, '0'), '[^0-9A-Za-z]', '', 'g') in (select k from k)
   or regexp_replace('Customer_' || lpad(cast(o_orderkey as varchar), 9, '0'), '[^0-9A-Za-z]', '', 'g') in (select k from k)""")
def _(s, d):
    from cladeloom.functions.names import alnum_key
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    keys = table(s, d, "customer").where("c_acctbal > 5000").select(alnum_key(F.col("c_name")).alias("k"))
    pad = lambda p, c: alnum_key(F.concat(F.lit(p), F.lpad(F.col(c).cast("string"), 9, "0")))
    return fl.name_in_set(o, pad("Customer-", "o_custkey"), pad("Customer_", "o_orderkey"), keys, "k").select("o_orderkey")


@query("length_outlier", """
with g as (select source, avg(n_chars) as m, stddev_samp(n_chars) as sd from documents group by 1)
select doc_id, d.source, n_chars, cast(not (n_chars between m - 3 * sd and m + 3 * sd) as int) as flagged
from documents d join g using (source)""")
def _(s, d):
    df = table(s, d, "documents").select("doc_id", "source", "n_chars")
    return fl.length_outlier(df, ["source"], "n_chars").select("doc_id", "source", "n_chars", F.col("is_outlier").cast("int").alias("flagged"))


@query("valid_sequence", f"""
with {v.SEQ}, p as (select id, replace(replace(seq, 'B', ''), 'J', '') as p from v_seq)
select id, cast(length(p) as bigint) as len from p where length(p) >= 50 and regexp_matches(p, '^[ACDEFGHIKLMNPQRSTVWYOU]+$')""")
def _(s, d):
    df = v.seqs(s, d).select("id", F.translate("seq", "BJ", "").alias("p"))
    return fl.valid_sequence(df, "p", 50, "^[ACDEFGHIKLMNPQRSTVWYOU]+$").select("id", F.length("p").cast("bigint").alias("len"))


@query("site_gap_filter", f"""
with {v.SITES}, g as (select gene, pos from v_sites group by 1, 2 having avg(case when allele = '-' then 1.0 else 0.0 end) < 0.13)
select s.id, s.gene, s.pos, s.allele from v_sites s join g using (gene, pos)""")
def _(s, d):
    return fl.site_gap_filter(v.sites(s, d), 0.13).select("id", "gene", "pos", "allele")


@query("site_qc", f"""
with {v.SITES} select gene, pos, count(*) as n_samples, count(distinct allele) as n_alleles from v_sites
where allele <> '-' group by 1, 2 having count(*) >= 100 and count(distinct allele) >= 2""")
def _(s, d):
    return fl.site_qc(v.sites(s, d), 100)


@query("drop_invariant", """
with k as (select l_orderkey, l_linestatus from lineitem group by 1, 2 having count(distinct l_tax) > 1)
select l_orderkey, l_linestatus, count(*) as n from lineitem join k using (l_orderkey, l_linestatus) group by 1, 2""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linestatus", "l_tax")
    return fl.drop_invariant(li, ["l_orderkey", "l_linestatus"], "l_tax").groupBy("l_orderkey", "l_linestatus").agg(v.count_as())


@query("complete_cases", """
with e as (select event_id, case when event_type <> 'error' then value end as a, case when user_id % 5 > 0 then user_id end as b from events)
select event_id from e where a is not null and b is not null""")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("a"),
                                     F.when(F.col("user_id") % 5 > 0, F.col("user_id")).alias("b"))
    return fl.complete_cases(e, ["a", "b"]).select("event_id")


@query("sentinel_to_null", """
select event_id, case when event_type = 'error' then null else floor(value) end as soil_a,
       case when floor(value) = 156 then null else floor(value) end as soil_b from events""")
def _(s, d):
    e = table(s, d, "events").select(
        "event_id", F.when(F.col("event_type") == "error", -99.0).otherwise(F.floor("value").cast("double")).alias("soil_a"),
        F.floor("value").cast("double").alias("soil_b"))
    return fl.sentinel_to_null(e, ["soil_a", "soil_b"], second=156.0)


@query("min_group_size", """
select l_partkey, l_orderkey, l_linenumber from lineitem
where l_partkey in (select l_partkey from lineitem group by 1 having count(*) >= 30)""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return fl.min_group_size(li, ["l_partkey"], 30)


@query("conditional_classify", """
with c as (select case when l_quantity < 5 and l_tax > 0.05 then 'core' when l_returnflag = 'R' then 'interface'
                       when l_quantity > 40 then 'surface' else 'other' end as context, l_extendedprice from lineitem)
select context, count(*) as n, min(l_extendedprice) as lo, max(l_extendedprice) as hi from c group by 1""")
def _(s, d):
    li = table(s, d, "lineitem")
    label = fl.classify([(F.col("l_quantity") > 40, "surface"), (F.col("l_returnflag") == "R", "interface"),
                         ((F.col("l_quantity") < 5) & (F.col("l_tax") > 0.05), "core")], "other")
    return (li.select(label.alias("context"), "l_extendedprice").groupBy("context")
            .agg(v.count_as(), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")))


_CLASSES = """
with q as (select quantile_cont(l_extendedprice, 0.05) as a, quantile_cont(l_quantity, 0.2) as b from lineitem),
c as (select *, case when l_extendedprice < a and l_quantity < b then 'sig_both' when l_extendedprice < a then 'sig_control'
                     when l_quantity < b then 'sig_nocontrol' else 'not_sig' end as site_class from lineitem, q)"""


@query("site_class", _CLASSES + """
select site_class, count(*) as n, max(l_extendedprice) as hi_with, max(l_quantity) as hi_only from c group by 1""")
def _(s, d):
    c = fl.site_class(table(s, d, "lineitem").select("l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity")
    return c.groupBy("site_class").agg(v.count_as(), F.max("l_extendedprice").alias("hi_with"), F.max("l_quantity").alias("hi_only"))


@query("variant_class", _CLASSES + """
select case when l_tax >= 0.05 then 'not_sig' else site_class end as variant_class, count(*) as n from c group by 1""")
def _(s, d):
    c = fl.site_class(table(s, d, "lineitem").select("l_extendedprice", "l_quantity", "l_tax"), "l_extendedprice", "l_quantity")
    return c.groupBy(fl.variant_class(c, "site_class", "l_tax").alias("variant_class")).agg(v.count_as())


# ---- set operations -------------------------------------------------------

@query("union_all", """
select 'events' as package, event_id as id, user_id as species, value, cast(null as varchar) as status from events
union all select 'orders', o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders""")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("species"), "value")
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("species"),
                                     F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"))
    return st.union_tagged({"events": e, "orders": o})


@query("intersect_keys", """
select l_suppkey from lineitem where l_quantity > 10 group by 1
having count(distinct l_linenumber) = (select count(distinct l_linenumber) from lineitem where l_quantity > 10)""")
def _(s, d):
    return st.intersect_keys(table(s, d, "lineitem").where("l_quantity > 10"), "l_suppkey", "l_linenumber")


@query("union_keys", "select l_orderkey as id from lineitem union select o_orderkey from orders where o_orderstatus = 'F'")
def _(s, d):
    return st.union_keys(table(s, d, "lineitem").select(F.col("l_orderkey").alias("id")),
                         table(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey"))


@query("difference_or_rare", """
select c_custkey, coalesce(n, 0) as n_observed from customer
left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey where coalesce(n, 0) < 10""")
def _(s, d):
    obs = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return st.difference_or_rare(table(s, d, "customer"), obs, "c_custkey", 10)


@query("distinct_rows", f"""
with {v.POINTS} select species, round(lat, 6) as lat, round(lon, 6) as lon, event_id from (
  select *, row_number() over (partition by species, lat, lon order by event_id) as rn from v_points) where rn = 1""")
def _(s, d):
    p = v.points(s, d).select("species", "lat", "lon", "event_id")
    out = st.distinct_rows(p, ["species", "lat", "lon"], "event_id")
    return out.select("species", v.rnd("lat").alias("lat"), v.rnd("lon").alias("lon"), "event_id")


@query("overlap_summary", """
with a as (select distinct l_orderkey as k from lineitem where l_returnflag = 'R'),
b as (select distinct o_orderkey as k from orders where o_orderstatus = 'F'),
f as (select a.k as ka, b.k as kb from a full join b on a.k = b.k)
select count(ka) as n_a, count(kb) as n_b, count(*) filter (ka is not null and kb is not null) as n_both,
       count(*) filter (kb is null) as a_only, count(*) filter (ka is null) as b_only from f""")
def _(s, d):
    a = table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    b = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return st.overlap_summary(a, b, "k")


# ---- top-k and sampling ---------------------------------------------------

@query("top_k", """
select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem
order by l_extendedprice, l_orderkey, l_linenumber, l_partkey limit 50""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return st.top_k(li, [F.col(c) for c in ("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")], 50)


@query("top_k_per_group", """
select l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank_no from (select *, row_number() over (
  partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rank_no from lineitem) where rank_no <= 3""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    out = st.top_k_per_group(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3)
    return out.withColumn("rank_no", F.col("rank_no").cast("bigint"))


@query("top_participants", """
with p as (select o_custkey as a, l_suppkey as b from orders join lineitem on l_orderkey = o_orderkey
           order by l_extendedprice desc, o_orderkey, l_linenumber, l_suppkey limit 50)
select member, count(*) as n from (select a as member from p union all select b from p) group by 1""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    p = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return st.top_participants(p, "o_custkey", "l_suppkey", [F.desc("l_extendedprice"), F.col("o_orderkey"),
                                                             F.col("l_linenumber"), F.col("l_suppkey")], 50)


_DRAW = q.draw("l_orderkey", "l_linenumber", "l_partkey")


@query("sample_n", f"""
with n as (select l_returnflag, count(*) as n, count(*) over () as g from lineitem group by 1)
select l_orderkey, l_linenumber, l_partkey, l_returnflag from lineitem join n using (l_returnflag) where {_DRAW} % 1000000 < least(1.0e0, 3000.0e0 / g / n) * 1000000""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return st.sample_budget(li, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey"], 3000)


@query("sample_frac", f"select l_orderkey, l_linenumber, l_partkey from lineitem where {_DRAW} % 1000000 < 100000")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return st.sample_fraction(li, ["l_orderkey", "l_linenumber", "l_partkey"], 0.1)


@query("stratified_balanced_sample", f"""
with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, {_DRAW} as h from lineitem),
r as (select *, row_number() over (partition by l_suppkey order by h, l_orderkey, l_linenumber, l_partkey) as i from l where l_quantity < 50)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, h % 1000000 < 700000 as is_train
from (select * from l where l_quantity >= 50 union all select * exclude (i) from r where i <= 10)""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    out = st.stratified_balanced_sample(li, F.col("l_quantity") >= 50, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 10)
    return st.holdout_split(out, ["l_orderkey", "l_linenumber", "l_partkey"], 0.7)


@query("split_batches", """
select doc_id, cast((row_number() over (order by doc_id) - 1) // 64 as bigint) as batch from documents""")
def _(s, d):
    return st.split_batches(table(s, d, "documents").select("doc_id"), ["doc_id"], 64)
