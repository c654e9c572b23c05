"""Joins: traits, names, intervals, grids, neighbours and pairs."""
from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.functions import names as nm
from cladeloom.operators import joins as jn, sites as si
from cladeloom.plans import views as v
from cladeloom.plans.registry import query, table


@query("left_join_traits", """
with t as (select c_name, min(c_mktsegment) as trait from customer where c_acctbal > 0 group by 1)
select o_orderkey, trait from orders left join t on c_name = 'Customer#' || lpad(cast(o_custkey as varchar), 9, '0')""")
def _(s, d):
    t = table(s, d, "customer").where("c_acctbal > 0").groupBy("c_name").agg(F.min("c_mktsegment").alias("trait"))
    o = table(s, d, "orders").select("o_orderkey", F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("c_name"))
    return o.join(t, "c_name", "left").select("o_orderkey", "trait")


@query("inner_join_env", "select o_orderkey, c_acctbal from orders join customer on c_custkey = o_custkey where o_orderstatus = 'F'")
def _(s, d):
    o = table(s, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return o.join(table(s, d, "customer").select("c_custkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_acctbal")


@query("join_on_normalised_name", """
with n as (select regexp_replace(n_name, '[^0-9A-Za-z]', '', 'g') as k, n_regionkey from nation)
select c_custkey, n_regionkey from customer left join n on k = 'NATION' || cast(c_nationkey + 1 as varchar)""")
def _(s, d):
    n = table(s, d, "nation").select(nm.alnum_key(F.col("n_name")).alias("k"), "n_regionkey")
    c = table(s, d, "customer").select("c_custkey", nm.alnum_key(F.concat(F.lit("NATION-"), (F.col("c_nationkey") + 1).cast("string"))).alias("k"))
    return c.join(n, "k", "left").select("c_custkey", "n_regionkey")


@query("multi_way_outer", """
select l_suppkey, max(l_quantity) filter (l_linenumber = 1) as "1", max(l_quantity) filter (l_linenumber = 2) as "2", max(l_quantity) filter (l_linenumber = 3) as "3"
from lineitem group by 1""")
def _(s, d):
    return jn.outer_merge_long(table(s, d, "lineitem"), "l_suppkey", "l_linenumber", [1, 2, 3], F.max("l_quantity"))


@query("composite_key_inner", """
with a as (select l_orderkey, l_linenumber, sum(l_quantity) as q from lineitem where l_returnflag = 'R' group by 1, 2),
b as (select l_orderkey, l_linenumber, max(l_extendedprice) as p from lineitem where l_linestatus = 'F' group by 1, 2)
select l_orderkey, l_linenumber, q, p from a join b using (l_orderkey, l_linenumber)""")
def _(s, d):
    li, k = table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    a = li.where("l_returnflag = 'R'").groupBy(*k).agg(F.sum("l_quantity").alias("q"))
    b = li.where("l_linestatus = 'F'").groupBy(*k).agg(F.max("l_extendedprice").alias("p"))
    return a.join(b, k)


@query("semi_in_set", """
select c_custkey, 'in' as side from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')
union all select c_custkey, 'out' from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')""")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey")
    o = table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("side", F.lit("in")).union(c.join(o, "c_custkey", "left_anti").withColumn("side", F.lit("out")))


@query("interval_join_point_in_range", """
with cds as (select p_partkey, p_size * 10 as lo, p_size * 10 + 50 as hi from part), v as (select l_orderkey, l_linenumber, l_partkey, l_partkey % 600 as pos from lineitem),
f as (select pos, min(p_partkey) as p_partkey from (select distinct pos from v) join cds on pos between lo and hi group by 1)
select l_orderkey, l_linenumber, l_partkey, f.p_partkey as cds, lo as cds_start from v left join f using (pos) left join cds on cds.p_partkey = f.p_partkey""")
def _(s, d):
    cds = table(s, d, "part").select("p_partkey", (F.col("p_size") * 10).alias("lo"), (F.col("p_size") * 10 + 50).alias("hi"))
    p = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 600).alias("pos"))
    r = jn.first_interval(p, "pos", cds, "lo", "hi", "p_partkey", ["p_partkey", "lo"], 64)
    return r.select("l_orderkey", "l_linenumber", "l_partkey", F.col("p_partkey").alias("cds"), F.col("lo").alias("cds_start"))


@query("self_join_pairs", f"""
with {v.SITES}, t as (select gene, pos, allele, row_number() over () as r from v_sites)
select gene, pos, a, b, cast(case when a = b then na * (na - 1) / 2 else na * nb end as bigint) as n_pairs from (
  select x.gene, x.pos, x.allele as a, y.allele as b, x.n as na, y.n as nb from (select gene, pos, allele, count(*) as n from t group by all) x
  join (select gene, pos, allele, count(*) as n from t group by all) y on x.gene = y.gene and x.pos = y.pos and x.allele <= y.allele)""")
def _(s, d):
    return jn.allele_pair_counts(v.sites(s, d))


@query("theta_self_join", """
select x.p_brand, x.p_partkey, count(*) filter (y.p_retailprice - x.p_retailprice >= 50) as n_above, count(*) filter (x.p_retailprice - y.p_retailprice >= 50) as n_below
from part x join part y on x.p_brand = y.p_brand and (x.p_name <> y.p_name or x.p_partkey = y.p_partkey) group by 1, 2""")
def _(s, d):
    p = table(s, d, "part").select("p_brand", "p_partkey", "p_name", "p_retailprice")
    return jn.theta_pair_counts(p, "p_brand", "p_partkey", "p_name", "p_retailprice", 50.0)


@query("pair_attribute_join", """
select o_orderkey, round(x.c_acctbal - y.c_acctbal, 4) as c_acctbal_diff, x.c_nationkey - y.c_nationkey as c_nationkey_diff
from orders join customer x on x.c_custkey = o_custkey join customer y on y.c_custkey = o_orderkey % 1500""")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1500).alias("b"))
    r = jn.pair_attributes(o, "a", "b", table(s, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"])
    return r.select("o_orderkey", v.rnd("c_acctbal_diff", 4).alias("c_acctbal_diff"), "c_nationkey_diff")


@query("lookup_map_join", """
select case l_returnflag when 'A' then 'Small' when 'N' then 'Amide' else 'unknown' end as class, count(*) as n from lineitem group by 1""")
def _(s, d):
    m = F.create_map(F.lit("A"), F.lit("Small"), F.lit("N"), F.lit("Amide"))
    return table(s, d, "lineitem").groupBy(F.coalesce(F.try_element_at(m, F.col("l_returnflag")), F.lit("unknown")).alias("class")).agg(v.count_as())


_GRID = """g as (select 'bio' || p_size % 2 as layer, cast(p_partkey // 40 as bigint) as "row", cast(p_partkey % 40 as bigint) as col, min(p_retailprice) as cell from part group by 1, 2, 3)"""
_CELLS = f"with {v.POINTS}, {_GRID}, c as (select event_id, cast(floor((90 - lat) / 10) as bigint) as \"row\", cast(floor((lon + 180) / 10) as bigint) as col from v_points)"


def _grid(s, d):
    p = table(s, d, "part")
    return p.groupBy(F.concat(F.lit("bio"), (F.col("p_size") % 2).cast("string")).alias("layer"), F.floor(F.col("p_partkey") / 40).alias("row"),
                     (F.col("p_partkey") % 40).alias("col")).agg(F.min("p_retailprice").alias("cell"))


@query("grid_lookup_join", _CELLS + ' select event_id, layer, cell from c join g using ("row", col)')
def _(s, d):
    return jn.grid_lookup(v.points(s, d), _grid(s, d), "lon", "lat", -180.0, 90.0, 10.0).select("event_id", "layer", "cell")


@query("land_mask_semi", _CELLS + """, l as (select distinct "row", col from g where layer = 'bio1')
select event_id, case when l.col is null then 'removed' else 'kept' end as status from c left join l using ("row", col)""")
def _(s, d):
    land, p = _grid(s, d).where("layer = 'bio1'"), v.points(s, d)
    args = ("lon", "lat", -180.0, 90.0, 10.0)
    k = jn.land_mask(p, land, *args).select("event_id", F.lit("kept").alias("status"))
    return k.union(jn.land_mask(p, land, *args, removed=True).select("event_id", F.lit("removed").alias("status")))


_XYZ = f"{v.VEC}, xyz as (select id, gene, [v[1] * 50, v[2] * 50, v[3] * 50] as p from v_vec)"


def xyz(s, d):
    x = v.vectors(s, d)
    return x.select("id", "gene", F.array(*[F.col("v")[i] * 50 for i in range(3)]).alias("p"))


@query("nearest_neighbour_join", f"""
with {_XYZ} select a.id, round(min(list_distance(a.p, b.p)), 6) as distance from xyz a join xyz b on a.gene < 8 and b.gene >= 8 group by 1""")
def _(s, d):
    x = xyz(s, d)
    return jn.nearest_neighbour(x.where("gene < 8"), x.where("gene >= 8"), "id", "p").withColumn("distance", v.rnd("distance"))


@query("radius_count_join", f"""
with {_XYZ} select a.id, count(*) filter (list_distance(a.p, b.p) > 0 and list_distance(a.p, b.p) <= 4) as n_within from xyz a, xyz b group by 1""")
def _(s, d):
    return jn.radius_count(xyz(s, d), "id", "p", 4.0)


@query("position_map_join", f"""
with {v.SITES}, r as (select gene, id, pos, sum((allele <> '-')::int) over (partition by gene, id order by pos) as k from v_sites where allele <> '-'),
ref as (select gene, min(id) as id from v_sites where allele <> '-' group by 1)
select r.gene, r.id, r.pos, cast(q.pos as int) as ref_pos from r join ref on r.gene = ref.gene join r q on q.gene = ref.gene and q.id = ref.id and q.k = r.k""")
def _(s, d):
    m = si.ungapped_index(v.sites(s, d)).where("residue_no is not null").select("gene", "id", "pos", "residue_no")
    ref = m.groupBy("gene").agg(F.min("id").alias("id"))
    r = m.join(ref, ["gene", "id"]).select("gene", "residue_no", F.col("pos").alias("ref_pos"))
    return jn.position_chain(m, r).select("gene", "id", "pos", "ref_pos")


@query("segment_means", """
with seg as (select r_name, r_regionkey * 90 as lo, r_regionkey * 90 + 49 as hi from region), e as (select floor(value)::bigint as pos, user_id from events)
select r_name, count(*) as n, round(avg(user_id), 6) as mean_score from e left join seg on pos between lo and hi group by 1""")
def _(s, d):
    seg = table(s, d, "region").select("r_name", (F.col("r_regionkey") * 90).alias("lo"), (F.col("r_regionkey") * 90 + 49).alias("hi"))
    e = table(s, d, "events").select(F.floor("value").alias("pos"), "user_id")
    return jn.segment_means(e, "pos", "user_id", seg, "lo", "hi", "r_name", 64).withColumn("mean_score", v.rnd("mean_score"))


@query("nearest_site_1d", """
with m as (select distinct p_size * 37 as mk from part where p_type = 'ECONOMY')
select event_id, (select min(abs(floor(value)::bigint - mk)) from m) as distance from events""")
def _(s, d):
    m = table(s, d, "part").where("p_type = 'ECONOMY'").select((F.col("p_size") * 37).cast("bigint").alias("mk"))
    e = table(s, d, "events").select("event_id", F.floor("value").alias("pos"))
    return jn.nearest_on_line(e, "pos", m, "mk").select("event_id", "distance")
