"""Embeddings, components, pair scores and autocorrelation."""
from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.functions import scales as sc, vectors as vx
from cladeloom.operators import matrix as mx, stats as sx, sets as st, aggregates as ag
from cladeloom.plans import views as v
from cladeloom.plans.q_joins import _XYZ, xyz
from cladeloom.plans.q_stats import r_
from cladeloom.plans.registry import query, table


@query("pca_fit")
def _(s, d):
    m = mx.pca_fit(v.vectors(s, d), "v", 10)
    return r_(m.select("n", "comp", "variance", "ratio", "cumulative"))


@query("pca_total_variance", f"""
with {v.VEC}, u as (select gene, unnest(v) as x, unnest(range(0, 64)) as dim from v_vec), t as (select gene, dim, var_samp(x) as v, count(*) as n from u group by 1, 2)
select gene, max(n) as n, round(sum(v), 8) as total from t group by 1""")
def _(s, d):
    """All components of each gene together carry the whole variance."""
    m = mx.pca_fit(v.vectors(s, d), "v", 64, ["gene"])
    return r_(m.groupBy("gene").agg(F.max("n").alias("n"), F.sum("variance").alias("total")), 8)


@query("pca_transform_by_group")
def _(s, d):
    x = v.vectors(s, d)
    t = mx.pca_transform(x, "v", mx.pca_fit(x, "v", 5))
    pc = F.col("pcs")[0]
    return r_(t.groupBy("gene").agg(F.count("*").alias("n"), F.avg(pc).alias("mean_pc1"), F.stddev_samp(pc).alias("sd_pc1"), F.min(pc).alias("min_pc1"), F.max(pc).alias("max_pc1")))


@query("incremental_pca")
def _(s, d):
    return r_(mx.pca_merge_batches(v.vectors(s, d), "v", 10, "gene"))


@query("top_loadings")
def _(s, d):
    return r_(mx.top_loadings(mx.pca_fit(v.vectors(s, d), "v", 5), 10))


_CEN = f"with {v.VEC}, u as (select id, unnest(v) as x, unnest(range(0, 64)) as dim from v_vec), m as (select dim, avg(x) as m from u group by 1)"


@query("centroid_distance", _CEN + """,
d as (select id, sqrt(sum(power(x - m, 2))) as d from u join m using (dim) group by 1), q as (select quantile_cont(d, 0.9) as a, quantile_cont(d, 0.95) as b, quantile_cont(d, 0.99) as c from d)
select id, round(d, 6) as distance, (d > a)::int as above_90, (d > b)::int as above_95, (d > c)::int as above_99 from d, q""")
def _(s, d):
    return r_(mx.centroid_distance(v.vectors(s, d), "id", "v"))


@query("embedding_outliers")
def _(s, d):
    return r_(mx.embedding_outliers(v.vectors(s, d), "id", "gene", "v", 2.0, {3: 2.5}))


_MEAN = f"{v.VEC}, u as (select gene, unnest(v) as x, unnest(range(0, 64)) as dim from v_vec), m as (select gene, dim, avg(x) as x from u group by 1, 2)"


@query("cosine_matrix", f"""
with {_MEAN} select a.gene as a, b.gene as b, round(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) + 0.0 as cosine, (a.gene // 5 = b.gene // 5)::int as same_block
from m a join m b on a.dim = b.dim and a.gene < b.gene group by 1, 2""")
def _(s, d):
    c = mx.group_cosines(v.vectors(s, d), "gene", "v")
    return r_(c.withColumn("same_block", (F.floor(F.col("a") / 5) == F.floor(F.col("b") / 5)).cast("int")))


@query("paired_residue_cosine", f"""
with {v.VEC}, r as (select id, i, v[i * 8 + 1 : i * 8 + 8] as w from (select id, v, unnest(range(0, 8)) as i from v_vec))
select a.id, cast(a.i as int) as residue, round(list_cosine_similarity(a.w, b.w), 6) + 0.0 as cosine from r a join r b on b.id = a.id + 1 and a.i = b.i""")
def _(s, d):
    r = v.vectors(s, d).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, F.lit(8)))).alias("residue", "w"))
    b = r.select((F.col("id") - 1).alias("id"), "residue", F.col("w").alias("w2"))
    return r_(r.join(b, ["id", "residue"]).select("id", "residue", vx.cosine(F.col("w"), F.col("w2")).alias("cosine")))


_PAIRS = f"""with {v.VEC}, p as (select x.gene, x.id as a, y.id as b, list_distance(x.v, y.v) as d, x.y - y.y as dy from v_vec x join v_vec y on x.gene = y.gene and x.id < y.id),
q as (select quantile_cont(d, 0.01) as qd from p)"""


@query("pairwise_distance_table", _PAIRS + " select gene, a, b, round(d, 6) as distance, round(dy, 6) + 0.0 as y_diff from p, q where d <= qd + 1e-12 and abs(dy) >= 0.2")
def _(s, d):
    x = v.vectors(s, d)
    cut = mx.pair_quantile(x, ["gene"], "id", "v", 0.01).first()["q"]
    return r_(mx.close_contrasting_pairs(x, ["gene"], "id", "v", "y", cut + 1e-12, 0.2))


@query("pair_distance_quantile", _PAIRS + " select round(any_value(qd), 6) as q, count(*) as n_pairs from p, q")
def _(s, d):
    return r_(mx.pair_quantile(v.vectors(s, d), ["gene"], "id", "v", 0.01))


@query("sister_diff_features", f"""
with {v.VEC}, p as (select a.id, a.y - b.y as dy, unnest(a.v) - unnest(b.v) as diff, unnest(range(0, 64)) as dim from v_vec a join v_vec b on b.id = a.id + 1)
select id, cast(dim as int) as dim, round(diff, 6) + 0.0 as diff, (dy > 0)::int as label from p""")
def _(s, d):
    x = v.vectors(s, d).select("id", "v", "y")
    b = x.select((F.col("id") - 1).alias("id"), F.col("v").alias("v2"), F.col("y").alias("y2"))
    p = x.join(b, "id").select("id", (F.col("y") > F.col("y2")).cast("int").alias("label"), F.posexplode(vx.subtract(F.col("v"), F.col("v2"))).alias("dim", "diff"))
    return r_(p)


# id = supplier gives each sample most sites
PANEL = """v_panel as (select l_suppkey as id, l_linestatus as gene, l_linenumber as pos, arg_max(l_returnflag, (l_orderkey * 100000 + l_partkey) * 256 + ascii(l_returnflag)) as allele from lineitem group by 1, 2, 3)"""


def panel(s, d):
    li = table(s, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("id"), F.col("l_linestatus").alias("gene"), F.col("l_linenumber").alias("pos")).agg(
        F.max_by("l_returnflag", (F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 256 + F.ascii("l_returnflag")).alias("allele"))


_XP = f"with {v.SITES}, xp as (select x.gene as gene_a, x.pos as pos_a, x.allele as a, y.gene as gene_b, y.pos as pos_b, y.allele as b from v_sites x join v_sites y on x.id = y.id and (x.gene < y.gene or (x.gene = y.gene and x.pos < y.pos)) where x.allele <> '-' and y.allele <> '-')"


@query("residue_covariance", _XP + """
select gene_a, gene_b, pos_a, pos_b, count(*) as n, round(covar_samp(case a when 'A' then 1 when 'N' then 2 else 3 end, case b when 'A' then 1 when 'N' then 2 else 3 end), 6) + 0.0 as cov from xp group by 1, 2, 3, 4""")
def _(s, d):
    return r_(mx.residue_covariance(v.sites(s, d), {"A": 1, "N": 2, "R": 3}, 1))


def _kf(col, i):
    return f"(case {col} " + " ".join(f"when '{a}' then {sc.KIDERA[a][i]}e0" for a in "ANR") + " end)"


_SS = lambda p, r: " + ".join(f"power(covar_pop({_kf(p, i)}, {_kf(r, j)}), 2)" for i in range(10) for j in range(10))
_RV = _XP + f""",
rv as (select gene_a, gene_b, pos_a, pos_b, count(*) as n, ({_SS('a', 'b')}) / sqrt(({_SS('a', 'a')}) * ({_SS('b', 'b')})) as rv from xp group by 1, 2, 3, 4)"""


@query("rv_coefficient", _RV + " select gene_a, gene_b, pos_a, pos_b, n, round(rv, 8) as rv from rv")
def _(s, d):
    return r_(mx.rv_coefficients(v.sites(s, d), sc.KIDERA), 8)


@query("block_summary", _RV + """
select gene_a, gene_b, case when gene_a = gene_b then 'within' else 'between' end as kind, count(*) as n_pairs, round(avg(rv), 8) as mean, round(stddev_samp(rv), 8) as sd, round(median(rv), 8) as median from rv group by 1, 2, 3""")
def _(s, d):
    return r_(mx.block_summary(mx.rv_coefficients(v.sites(s, d), sc.KIDERA), "rv"), 8)


_CPL = "c as (select least(l_suppkey, l_partkey % 100) as i, greatest(l_suppkey, l_partkey % 100) as j, avg(l_extendedprice) as score from lineitem where l_suppkey <> l_partkey % 100 group by 1, 2)"


@query("apc_correct", f"""
with {_CPL}, e as (select i as k, score from c union all select j, score from c), m as (select k, avg(score) as m from e group by 1), o as (select avg(score) as o from c),
a as (select c.i, c.j, score, score - x.m * y.m / o as apc from c join m x on x.k = c.i join m y on y.k = c.j, o where abs(c.i - c.j) >= 5), q as (select quantile_cont(apc, 0.95) as q from a)
select i, j, round(score, 7) as score, round(apc, 4) + 0.0 as apc, (apc >= q)::int as is_top from a, q""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 100).alias("b"), "l_extendedprice").where("l_suppkey <> b")
    c = li.groupBy(F.least("l_suppkey", "b").alias("i"), F.greatest("l_suppkey", "b").alias("j")).agg(F.avg("l_extendedprice").alias("score"))
    return r_(mx.apc_correct(c).withColumn("is_top", F.col("is_top").cast("int")), 4, score=7)


_HAP = f"{PANEL}, k as (select distinct gene, pos from v_panel), f as (select i.id, k.gene, k.pos, coalesce(allele, '-') as a from (select distinct id from v_panel) i cross join k left join v_panel p on p.id = i.id and p.gene = k.gene and p.pos = k.pos), h as (select id, string_agg(a, '' order by gene, pos) as seq from f group by 1)"


@query("effective_sequences", f"""
with {_HAP}, p as (select x.id, count(*) as c from h x, h y where len(list_filter(range(1, length(x.seq) + 1), lambda i: substr(x.seq, i, 1) = substr(y.seq, i, 1))) / length(x.seq) >= 0.6 group by 1)
select count(*) as n, round(sum(1.0e0 / c), 6) as neff, cast((select max(length(seq)) from h) as int) as len, round(sum(1.0e0 / c) / (select max(length(seq)) from h), 6) as neff_per_site from p""")
def _(s, d):
    from cladeloom.operators.sites import supermatrix
    return r_(mx.effective_sequences(supermatrix(panel(s, d)), "seq", 0.6))


@query("kinship", f"""
with {_HAP}, x as (select id, gene, pos, case a when 'A' then 1 when 'N' then 2 when 'R' then 3 else 0 end as x from f), c as (select id, gene, pos, x - avg(x) over (partition by gene, pos) as z from x),
r as (select a.id, sum(a.z * a.z) filter (a.id = b.id) / 14 as d, sum(a.z * b.z) / 14 as t from c a join c b using (gene, pos) group by 1)
select id, round(d, 6) as self_kinship, round(t, 5) + 0.0 as row_sum from r""")
def _(s, d):
    from cladeloom.operators.sites import supermatrix
    code = F.create_map(*[F.lit(x) for kv in (("A", 1.0), ("N", 2.0), ("R", 3.0)) for x in kv])
    x = supermatrix(panel(s, d)).select("id", F.transform(F.split("seq", ""), lambda c: F.coalesce(F.try_element_at(code, c), F.lit(0.0))).alias("v"))
    return r_(mx.kinship_totals(x, "id", "v"), row_sum=5)


_COLLAPSE = """
with recursive p as (select split_part(p_name, ' ', 1) as genus, p_partkey, [floor(p_partkey / 1 % 4), floor(p_partkey / 4 % 4), floor(p_partkey / 16 % 4), floor(p_partkey / 64 % 4), floor(p_partkey / 256 % 4), p_size::double] as v from part),
o as (select *, row_number() over (partition by genus order by p_partkey) as i from p),
r as (select distinct genus, 0::bigint as i, []::struct(k bigint, v double[])[] as reps from p union all
  select r.genus, o.i, case when len(list_filter(r.reps, lambda x: list_sum(list_transform(list_zip(x.v, o.v), lambda z: (z[1] <> z[2])::int)) <= 2)) = 0
    then list_append(r.reps, {'k': o.p_partkey, 'v': o.v}) else r.reps end from r join o on o.genus = r.genus and o.i = r.i + 1),
f as (select genus, arg_max(reps, i) as reps from r group by 1)
select o.genus, p_partkey, list_min(list_transform(list_filter(f.reps, lambda x: list_sum(list_transform(list_zip(x.v, o.v), lambda z: (z[1] <> z[2])::int)) <= 2), lambda x: x.k)) as representative
from o join f using (genus)"""


@query("greedy_collapse", _COLLAPSE)
def _(s, d):
    p = table(s, d, "part").select(F.split("p_name", " ")[0].alias("genus"), "p_partkey",
                                   F.array(*[(F.col("p_partkey") / k % 4).cast("int").cast("double") for k in (1, 4, 16, 64, 256)], F.col("p_size").cast("double")).alias("v"))
    return mx.greedy_collapse(p, ["genus"], "p_partkey", "v", 2)


_GAPPED = _COLLAPSE.split("o as (select")[0].replace("with recursive p as", "with recursive p0 as").rstrip().rstrip(",") + """,
p as (select genus, p_partkey, list_transform(v, lambda x: case when x = 3 then -1 else x end) as v from p0),
s as (select p_partkey as k, v from p order by ('0x' || substr(md5(concat_ws('|', p_partkey, 42)), 1, 13))::bigint, p_partkey limit 2000),
dd as (select list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] <> -1 and z[2] <> -1)::int)) as c, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] <> z[2] and z[1] <> -1 and z[2] <> -1)::int)) as d from s a join s b on a.k < b.k),
q as (select quantile_cont(d / c, 0.01) as q from dd where c > 0),
"""
_NEAR = "list_sum(list_transform(list_zip(x.v, o.v), lambda z: (z[1] <> z[2] and z[1] <> -1 and z[2] <> -1)::int)) <= o.qv * list_sum(list_transform(list_zip(x.v, o.v), lambda z: (z[1] <> -1 and z[2] <> -1)::int)) + 1e-12 and list_sum(list_transform(list_zip(x.v, o.v), lambda z: (z[1] <> -1 and z[2] <> -1)::int)) > 0"


@query("collapse_by_distance", _GAPPED + "o as (select (select q from q) as qv," + _COLLAPSE.split("o as (select")[1].replace("list_sum(list_transform(list_zip(x.v, o.v), lambda z: (z[1] <> z[2])::int)) <= 2", _NEAR))
def _(s, d):
    v_ = F.array(*[(F.col("p_partkey") / k % 4).cast("int").cast("double") for k in (1, 4, 16, 64, 256)], F.col("p_size").cast("double"))
    p = table(s, d, "part").select(F.split("p_name", " ")[0].alias("genus"), "p_partkey", F.transform(v_, lambda x: F.when(x == 3, -1.0).otherwise(x)).alias("v"))
    c = mx.collapse_by_distance(p, ["genus"], "p_partkey", "v", 0.01, gap=-1.0)
    # a part of gaps alone is near no representative, itself included, and the SQL gives NULL
    gaps = p.where(F.forall("v", lambda x: x == -1.0)).select("p_partkey", F.lit(True).alias("_gaps"))
    return c.join(gaps, "p_partkey", "left").select("genus", "p_partkey", F.when(F.col("_gaps").isNull(), F.col("representative")).alias("representative"))


@query("similarity_of_profiles", f"""
with {v.VEC}, u as (select gene, y, unnest(v) as x, unnest(range(0, 64)) as dim from v_vec), c as (select gene, dim, corr(x, y) as r from u group by 1, 2)
select a.gene as a, b.gene as b, round(corr(a.r, b.r), 6) + 0.0 as r from c a join c b on a.dim = b.dim and a.gene < b.gene group by 1, 2""")
def _(s, d):
    return r_(mx.profile_similarity(sx.corr_with(v.vectors(s, d), "v", "y", ["gene"]), "gene", "dim", "r"))


@query("cluster_representatives", "select source || lang as cluster, min(doc_id) as doc_id, min_by(n_chars, doc_id) as n_chars from documents group by 1")
def _(s, d):
    x = table(s, d, "documents").select(F.concat("source", "lang").alias("cluster"), "doc_id", "n_chars")
    return st.distinct_rows(x, ["cluster"], "doc_id")


@query("position_variability", f"""
with {v.VEC}, u as (select gene, id, unnest(v) as x, unnest(range(0, 64)) as dim from v_vec), m as (select gene, dim, avg(x) as mean, stddev_samp(x) as sd, max(x) - min(x) as rng from u group by 1, 2)
select gene, count(*) as n, round(corr(sd, rng), 6) as r_sd_range, round(corr(mean, sd), 6) + 0.0 as r_mean_sd from m group by 1""")
def _(s, d):
    u = v.vectors(s, d).select("gene", F.posexplode("v").alias("dim", "x"))
    m = ag.group_moments(u, ["gene", "dim"], "x")
    return r_(m.groupBy("gene").agg(v.count_as(), F.corr("sd", "range").alias("r_sd_range"), F.corr("mean", "sd").alias("r_mean_sd")))


@query("pc_vs_raw_correlation")
def _(s, d):
    return r_(mx.pc_vs_raw(v.vectors(s, d), "v", "y", ["gene"], 5))


@query("raw_correlation_by_gene", f"""
with {v.VEC}, u as (select gene, y, unnest(v) as x, unnest(range(0, 64)) as dim from v_vec)
select gene, cast(dim as int) as dim, count(*) as n, round(corr(x, y), 6) + 0.0 as r from u group by 1, 2""")
def _(s, d):
    return r_(mx.pc_vs_raw(v.vectors(s, d), "v", "y", ["gene"], 5).where("kind = 'raw'").drop("kind"))


# ---- autocorrelation ------------------------------------------------------

_LOC = "loc as (select c_custkey as id, [c_acctbal / 100, c_nationkey * 3.0e0] as p, c_acctbal * 0.01e0 + c_custkey % 13 as x from customer)"


def _loc(s, d):
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 100, F.col("c_nationkey") * 3.0).alias("p"), (F.col("c_acctbal") * 0.01 + F.col("c_custkey") % 13).alias("x"))


_MOR = """, z as (select id, p, x - avg(x) over () as z from loc),
w as (select a.id as i, b.id as j, {w} as w, a.z as zi, b.z as zj from z a join z b on a.id <> b.id {on}),
r as (select i, sum(w) as rw from w group by 1),
q as (select w.i, w.j, zi, zj, w.w / x.rw as wij, w.w / y.rw as wji from w join r x on x.i = w.i join r y on y.i = w.j),
s as (select (select count(*) from z) as n, (select sum(z * z) from z) as z2, sum(wij) as s0, sum(wij * zi * zj) as num, sum(power(wij + wji, 2)) / 2 as s1 from q),
c as (select sum(power(a.o + b.c, 2)) as s2 from (select i, sum(wij) as o from q group by 1) a join (select j, sum(wij) as c from q group by 1) b on a.i = b.j),
m as (select n, n / s0 * num / z2 as mi, -1.0e0 / (n - 1) as ei, (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1.0e0) * s0 * s0) - 1.0e0 / ((n - 1.0e0) * (n - 1)) as va from s, c)
select n, round(mi, 8) + 0.0 as moran_i, round(ei, 8) as expected, round(va, 10) as variance, round((mi - ei) / sqrt(va), 5) + 0.0 as z from m"""


@query("morans_i", f"with {_LOC}" + _MOR.format(w="1 / (list_distance(a.p, b.p) + 0.001e0)", on=""))
def _(s, d):
    return r_(mx.morans_i(_loc(s, d), "id", "p", "x"), 8, variance=10, z=5)


@query("morans_i_cutoff", f"with {_LOC}" + _MOR.format(w="1.0e0", on="and list_distance(a.p, b.p) > 0 and list_distance(a.p, b.p) <= 20"))
def _(s, d):
    return r_(mx.morans_i(_loc(s, d), "id", "p", "x", max_dist=20.0), 8, variance=10, z=5)


@query("correlogram", f"""
with {_LOC}, z as (select id, p, x - avg(x) over () as z from loc), w as (select list_distance(a.p, b.p) as d, a.z * b.z as zz from z a join z b on a.id < b.id),
t as (select count(*) as n, sum(z * z) as z2 from z), k as (select unnest(range(0, 6)) as cls)
select cast(cls as int) as cls, count(*) as n_pairs, round(any_value(n) / count(*) * sum(zz) / any_value(z2), 8) + 0.0 as moran_i from k join w on d > cls * 20 and d <= cls * 20 + 20, t group by 1 having count(*) >= 10""")
def _(s, d):
    return r_(mx.correlogram(_loc(s, d), "id", "p", "x", [0, 20, 40, 60, 80, 100, 120]), 8)
