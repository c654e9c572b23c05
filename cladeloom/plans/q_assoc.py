"""Association scans and models."""
from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.functions import scales as sc
from cladeloom.operators import assoc as az, aggregates as ag, matrix as mx, sites as si, stats as sx
from cladeloom.operators.ordered import join_same
from cladeloom.plans import sqlstat as q, views as v
from cladeloom.plans.q_stats import _AOV, r_
from cladeloom.plans.registry import query, table


@query("ols_by_group", f"""
with m as (select l_suppkey, count(*) as n, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, corr(l_extendedprice, l_quantity) as r,
  regr_sxx(l_extendedprice, l_quantity) as sxx, regr_syy(l_extendedprice, l_quantity) as syy from lineitem group by 1),
t as (select *, sqrt((1 - r * r) * syy / (n - 2) / sxx) as se from m)
select l_suppkey, 'l_quantity' as term, n, round(b, 4) + 0.0 as estimate, round(se, 4) as se, round(b / se, 5) + 0.0 as t, round({q.t_tail('b / se', 'n - 2')}, 6) as p_value, round(r * r, 8) as r2 from t""")
def _(s, d):
    o = az.ols_by_group(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_suppkey"]).where("term = 'l_quantity'")
    return r_(o, estimate=4, se=4, t=5, r2=8)


@query("ols_multi", """
with c as (select l_suppkey, covar_pop(l_quantity, l_quantity) as xx, covar_pop(l_tax, l_tax) as zz, covar_pop(l_quantity, l_tax) as xz, covar_pop(l_quantity, l_extendedprice) as xy, covar_pop(l_tax, l_extendedprice) as zy from lineitem group by 1)
select l_suppkey, round((xy * zz - zy * xz) / (xx * zz - xz * xz), 3) + 0.0 as b_quantity, round((zy * xx - xy * xz) / (xx * zz - xz * xz), 1) + 0.0 as b_tax from c""")
def _(s, d):
    o = az.ols_by_group(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_tax"], ["l_suppkey"])
    pick = lambda t: F.max(F.when(F.col("term") == t, F.col("estimate")))
    return r_(o.groupBy("l_suppkey").agg(pick("l_quantity").alias("b_quantity"), pick("l_tax").alias("b_tax")), 3, b_tax=1)


@query("weighted_ols", """
with m as (select sum(l_linenumber) as w, sum(l_linenumber * l_quantity) as x, sum(l_linenumber * l_extendedprice) as y, sum(l_linenumber * l_quantity * l_quantity) as xx, sum(l_linenumber * l_quantity * l_extendedprice) as xy, count(*) as n from lineitem)
select 'l_quantity' as term, n, round((xy - x * y / w) / (xx - x * x / w), 5) as estimate from m""")
def _(s, d):
    o = az.weighted_ols(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity"], "l_linenumber").where("term = 'l_quantity'")
    return r_(o.select("term", "n", "estimate"), 5)


@query("site_anova_scan", f"with {v.SITES}, v2 as (select gene || ':' || pos as site, allele, y from v_sites), " + _AOV.format(by="site", grp="allele", x="y", src="v2") + f"""
select string_split(site, ':')[1] as gene, cast(string_split(site, ':')[2] as int) as pos, cast(n as bigint) as n, k, round(f, 6) as statistic, round(ssb / (ssb + ssw), 8) as r2,
  round({q.f_tail('f', 'k - 1', 'n - k')}, 6) as p_value from a""")
def _(s, d):
    return r_(az.site_anova_scan(v.sites(s, d), "y").drop("ssb", "ssw"), r2=8)


_FULL = f"""with {v.SITES}, g as (select i.gene, i.id, p.pos from (select distinct gene, id from v_sites) i join (select distinct gene, pos from v_sites) p using (gene)),
c as (select gene, pos, id, coalesce(allele, '-') as allele from g left join v_sites using (gene, pos, id)),
d as (select c.*, o_totalprice as y, cast(o_custkey % 101 as double) as z from c join orders on o_orderkey = id)"""
_SCAN = _FULL + """,
t as (select gene, pos, count(*) as n, var_pop(y) * count(*) as syy, var_pop(z) * count(*) as szz, covar_pop(y, z) * count(*) as syz, count(distinct allele) as k from d group by 1, 2),
w as (select gene, pos, allele, var_pop(y) * count(*) as syy, var_pop(z) * count(*) as szz, covar_pop(y, z) * count(*) as syz from d group by 1, 2, 3),
ws as (select gene, pos, sum(syy) as wyy, sum(szz) as wzz, sum(syz) as wyz from w group by 1, 2),
f as (select gene, pos, n, k, syy, wyy as rss_aa, syy - syz * syz / szz as rss_z, wyy - wyz * wyz / wzz as rss_full from t join ws using (gene, pos))"""


def _traits(s, d, n=1):
    o = table(s, d, "orders")
    z = [(F.col("o_custkey") % m).cast("double") for m in (101, 17, 29, 7)][:n]
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"), F.array(*z).alias("z"))


def _complete(s, d):
    return az.complete_sites(v.sites(s, d).select("gene", "pos", "id", "allele"))


@query("site_scan_with_covariates", _SCAN + f"""
select gene, pos, n, round(1 - rss_aa / syy, 8) as r2_aa, round(1 - rss_z / syy, 8) as r2_pcs, round(1 - rss_full / syy, 8) as r2_full,
  round({q.f_tail('((syy - rss_aa) / (k - 1)) / (rss_aa / (n - k))', 'k - 1', 'n - k')}, 6) as p_aa_only,
  round({q.f_tail('(syy - rss_z) / (rss_z / (n - 2))', '1', 'n - 2')}, 6) as p_pcs_only,
  round({q.f_tail('((rss_z - rss_full) / (k - 1)) / (rss_full / (n - k - 1))', 'k - 1', 'n - k - 1')}, 6) as p_aa_with_pcs from f""")
def _(s, d):
    r = az.site_scan(_complete(s, d), _traits(s, d))
    return r_(r.drop("residue_counts", "effects"), r2_aa=8, r2_pcs=8, r2_full=8)


@query("residue_effects")
def _(s, d):
    r = az.site_scan(_complete(s, d), _traits(s, d, 4))
    return r_(r.select("gene", "pos", F.explode("effects").alias("e")).select("gene", "pos", "e.*"))


# one covariate: the common slope comes from the deviations within alleles
_EFF1 = _SCAN + """,
m as (select gene, pos, allele, count(*) as m, avg(y) as my, avg(z) as mz from d group by 1, 2, 3), l as (select gene, pos, max(allele) as last from m group by 1, 2),
e as (select m.gene, m.pos, m.allele as residue, m.m as cnt, (m.my - r.my) - wyz / wzz * (m.mz - r.mz) as effect, sqrt(rss_full / (n - 1 - k) * (1.0e0 / m.m + 1.0e0 / r.m + (m.mz - r.mz) * (m.mz - r.mz) / wzz)) as se, n - 1 - k as dof
  from m join l using (gene, pos) join m r on r.gene = m.gene and r.pos = m.pos and r.allele = l.last and m.allele <> l.last join f on f.gene = m.gene and f.pos = m.pos join ws on ws.gene = m.gene and ws.pos = m.pos)"""


@query("residue_effects_one_covariate", _EFF1 + f" select gene, pos, residue, round(effect, 4) + 0.0 as effect, round(se, 4) as se, round(effect / se, 5) + 0.0 as t, round({q.t_tail('effect / se', 'dof')}, 6) as p from e")
def _(s, d):
    r = az.site_scan(_complete(s, d), _traits(s, d))
    return r_(r.select("gene", "pos", F.explode("effects").alias("e")).select("gene", "pos", "e.*"), effect=4, se=4, t=5)


@query("hit_direction_one_covariate", _EFF1 + f""", hit as (select *, {q.t_tail('effect / se', 'dof')} as p from e), way as (select gene, pos, count(*) filter (p < 0.5 and effect > 0) as h, count(*) filter (p < 0.5 and effect < 0) as c from hit group by 1, 2)
select gene, pos, residue, cnt as count, round(effect, 4) + 0.0 as effect, round(p, 6) as p, case when h > 0 and c > 0 then 'mixed' when h > 0 then 'hot' when c > 0 then 'cold' else 'none' end as direction from hit join way using (gene, pos)""")
def _(s, d):
    return r_(az.hit_direction(az.site_scan(_complete(s, d), _traits(s, d)), 0.5).drop("p_aa_with_pcs"), effect=4)


@query("covariate_sweep_one_covariate", _SCAN + f""", p as (select 0 as n_pcs, {q.f_tail('((syy - rss_aa) / (k - 1)) / (rss_aa / (n - k))', 'k - 1', 'n - k')} as p from f
  union all select 1, {q.f_tail('((rss_z - rss_full) / (k - 1)) / (rss_full / (n - k - 1))', 'k - 1', 'n - k - 1')} from f), ps as (select *, count(*) over (partition by n_pcs) as n_sites from p)
select n_pcs, n_sites, count(*) filter (p < 0.5) as n_nominal, count(*) filter (p < 0.5 / n_sites) as n_bonferroni, round(median(-log10(p)), 4) as median_log10p from ps group by 1, 2""")
def _(s, d):
    return r_(az.sweep_summary(az.covariate_sweep(_complete(s, d), _traits(s, d), [0, 1]), 0.5), 4)


@query("residue_counts_of_scan", _FULL + " select gene, pos, allele as residue, count(*) as n from d group by 1, 2, 3")
def _(s, d):
    r = az.site_scan(_complete(s, d), _traits(s, d))
    return r.select("gene", "pos", F.explode("residue_counts").alias("residue", "n"))


@query("covariate_sweep")
def _(s, d):
    return r_(az.sweep_summary(az.covariate_sweep(_complete(s, d), _traits(s, d, 4), [0, 1, 2, 4])))


@query("residualize", """
with o as (select o_orderkey, o_totalprice as y, o_custkey % 101 as z from orders), m as (select regr_slope(y, z) as b, regr_intercept(y, z) as a from o)
select o_orderkey, round(y - a - b * z, 4) + 0.0 as residual from o, m""")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.array((F.col("o_custkey") % 101).cast("double")).alias("z"))
    return r_(az.residualize(o, F.col("z"), "y").select("o_orderkey", "residual"), 4)


@query("run_scan")
def _(s, d):
    x = v.vectors(s, d).withColumn("z", F.array((F.col("id") % 11).cast("double")))
    raw = az.vector_f_scan(x, ["gene"], "v", "y", 5).withColumn("kind", F.lit("raw"))
    adj = az.vector_f_scan(az.residualize(x, F.col("z"), "y"), ["gene"], "v", "residual", 5).withColumn("kind", F.lit("residualised"))
    return r_(raw.union(adj))


@query("vector_f_single", f"""
with {v.VEC}, c as (select gene, count(*) as n, corr(v[1], y) as r from v_vec group by 1)
select gene, n, cast(1 as int) as rank, round(r * r, 8) as r2, round(r * r / ((1 - r * r) / (n - 2)), 5) as f, round({q.f_tail('r * r / ((1 - r * r) / (n - 2))', '1', 'n - 2')}, 6) as p_value from c""")
def _(s, d):
    x = v.vectors(s, d).withColumn("w", F.slice("v", 1, 1))
    return r_(az.vector_f_scan(x, ["gene"], "w", "y"), r2=8, f=5)


@query("embedding_site_scan")
def _(s, d):
    e = v.vectors(s, d).select("id", "v")
    e = mx.pca_transform(e, "v", mx.pca_fit(e, "v", 10, scale=True), scale=True).select("id", F.col("pcs").alias("v"))
    st = v.sites(s, d).join(e, "id").join(_traits(s, d, 2).select("id", "z", F.col("y").alias("pheno")), "id")
    one = F.array(*[(F.col("allele") == a).cast("double") for a in "ANR"])
    return r_(az.nested_r2(st, ["gene", "pos"], {"pcs": F.col("z"), "aa": one, "emb": F.col("v")}, "pheno",
                           {"pcs": ["pcs"], "pcs_aa": ["pcs", "aa"], "pcs_emb": ["pcs", "emb"]}))


@query("ridge_cv_site")
def _(s, d):
    x = v.vectors(s, d)
    return r_(az.ridge_cv(x, ["gene"], "v", "y", F.pmod(F.xxhash64("id"), F.lit(5)), [0.001, 0.01, 0.1, 1.0]))


def _runs(s, d, dims):
    """Positions of ten vectors' length in two genes, one state for every three positions."""
    x = v.vectors(s, d).select((F.col("id") % 50).alias("taxon"), F.floor(F.col("id") / 50).alias("pos"), (F.col("gene") % 2).alias("gene"), "v")
    t = s.range(50).select(F.col("id").alias("taxon"), (F.col("id") * 37 % 101 / 10).alias("y"), F.array((F.col("id") % 11).cast("double")).alias("z"))
    t = az.residualize(t, F.col("z"), "y")
    st = x.select("gene", "pos").distinct().withColumn("state", F.get(F.array(*[F.lit(c) for c in "HEC"]), (F.floor(F.col("pos") / 3) % 3).cast("int")))
    if dims == 1:
        x = x.withColumn("v", F.slice("v", 1, 1))
    return az.structural_run_scan(x, st, t, "gene", "pos", "taxon", "v", "state", "y", "residual", 10, k=dims if dims > 1 else None)


@query("structural_run_scan")
def _(s, d):
    return r_(_runs(s, d, 5))


@query("structural_run_scan_single", f"""
with {v.VEC}, x as (select id % 50 as taxon, id // 50 as pos, gene % 2 as gene, v[1] as v from v_vec), st as (select distinct gene, pos, substr('HEC', ((pos // 3) % 3 + 1)::int, 1) as state from x),
b as (select *, case when state = lag(state) over w and pos - lag(pos) over w <= 1 then 0 else 1 end as fresh from st window w as (partition by gene order by pos)),
r as (select *, sum(fresh) over (partition by gene order by pos) as run from b), sp as (select gene, run, any_value(state) as state, min(pos) as first_pos, max(pos) as last_pos, count(*) as n_pos from r group by 1, 2),
t as (select i as taxon, i * 37 % 101 / 10 as y, (i % 11)::double as z from range(50) u(i)), k as (select regr_slope(y, z) as b, regr_intercept(y, z) as a from t),
m as (select gene, run, taxon, avg(v) as v from x join r using (gene, pos) group by all), j as (select m.*, y, y - a - b * z as e from m join t using (taxon), k),
c as (select gene, run, 'raw' as kind, count(*) as n, corr(v, y) as r from j group by 1, 2 union all select gene, run, 'residualised', count(*), corr(v, e) from j group by 1, 2)
select gene, run::bigint as run, kind, n, 1 as rank, round(r * r, 8) as r2, round(r * r / ((1 - r * r) / (n - 2)), 5) as f, round({q.f_tail('r * r / ((1 - r * r) / (n - 2))', '1', 'n - 2')}, 6) as p_value, state, first_pos, last_pos, n_pos
from c join sp using (gene, run) where n >= 10""")
def _(s, d):
    return r_(_runs(s, d, 1), r2=8, f=5)


@query("ridge_reduced_full")
def _(s, d):
    from cladeloom.functions.arith import draw
    x = v.vectors(s, d).withColumn("pc", F.array((F.col("id") % 7).cast("double"), (F.col("id") % 11).cast("double")))
    return r_(az.ridge_compare(x, ["gene"], "pc", "v", "y", draw("id") % 5, [0.001, 0.01, 0.1, 1.0]))


@query("presence_scan", f"""
with y as (select c_custkey as id, c_acctbal as y from customer), p as (select distinct l_linenumber * 100 + l_suppkey % 50 as gene, o_custkey as id from lineitem join orders on o_orderkey = l_orderkey),
t as (select count(*) as n, avg(y) as m, var_pop(y) as vp from y), g as (select gene, count(*) as n1, avg(y) as m1 from p join y using (id) group by 1),
e as (select gene, n1, n - n1 as n0, m1 - (n * m - n1 * m1) / (n - n1) as effect, n, vp from g, t where n1 < n),
f as (select *, n1 * n0 / n * effect * effect as ssb, n * vp as sst from e), h as (select *, ssb / ((sst - ssb) / (n - 2)) as f from f),
w as (select gene, n1, n0, effect, ssb / sst as r2, f, {q.f_tail('f', '1', 'n - 2')} as p from h)
select gene, n1, n0, round(effect, 5) as effect, round(r2, 8) as r2, round(f, 6) as f, round(p, 6) as p_value,
  round(least(1, min(p * cnt / rk) over (order by p desc rows between unbounded preceding and current row)), 6) as p_bh from (select *, rank() over (order by p) as rk, count(*) over () as cnt from w)""")
def _(s, d):
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    p = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("l_linenumber") * 100 + F.col("l_suppkey") % 50).alias("gene"), F.col("o_custkey").alias("id"))
    y = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("y"))
    return r_(az.presence_scan(p, "gene", "id", y), effect=5, r2=8)


@query("kmer_label_scan", f"""
with {v.SEQ}, l as (select doc_id as id, quality as l from labels), s as (select id, dna, l from v_seq join l using (id)), t as (select sum(l) as p, count(*) as n from s),
k as (select distinct id, l, unnest(list_transform(range(1, length(dna) - 4), lambda i: substr(dna, i, 6))) as kmer from s),
c as (select kmer, sum(l)::bigint as a, count(*) - sum(l)::bigint as b from k group by 1), f as (select kmer, a, b, (p - a)::bigint as c, (n - p - b)::bigint as d from c, t),
u as (select distinct a, b, c, d, {q.fisher_tail('a', 'b', 'c', 'd')} as p from f), w as (select kmer, a, b, c, d, p as raw, round(p, 9) as p from f join u using (a, b, c, d)),
g as (select p, sum(count(*)) over (order by p) as rk, sum(count(*)) over () as n from w group by 1),
h as (select p, least(1, min(p * n / rk) over (order by p desc rows between unbounded preceding and current row)) as bh from g)
select kmer, a, b, c, d, round(raw, 6) as p_value, round(bh, 4) as p_bh from w join h using (p)""")
def _(s, d):
    lab = table(s, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return r_(az.kmer_label_scan(v.seqs(s, d), "id", "dna", lab, "quality", 6).drop("odds_ratio"), p_bh=4)


@query("logistic_fit")
def _(s, d):
    from cladeloom.operators.models import logistic_fit
    x = table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select(
        "doc_id", "quality", F.array((F.col("n_chars") / 1000).cast("double"), F.length(F.regexp_replace("text", "[^ ]", "")) / F.col("n_chars")).alias("v"))
    return r_(logistic_fit(x, "v", "quality"), 4)


@query("logistic_holdouts")
def _(s, d):
    """1,000 balanced holdouts of the quality label, negatives balanced over sources."""
    from cladeloom.operators.models import holdout_summary, repeated_holdouts
    x = table(s, d, "labels").join(table(s, d, "documents"), "doc_id").select(
        "doc_id", "quality", "source", F.array((F.col("n_chars") / 1000).cast("double"), F.length(F.regexp_replace("text", "[^ ]", "")) / F.col("n_chars")).alias("v"))
    return r_(holdout_summary(repeated_holdouts(x.where("quality is not null and n_chars > 0"), "doc_id", "v", "quality", "source")), 4)


@query("grid_search_genes")
def _(s, d):
    """Genes are labels, taxa residues of the vector's id, clades residues of the taxon; the grid holds 4 x 4 x 5 rows."""
    e = v.vectors(s, d).withColumn("taxon", F.col("id") % 100).withColumn("clade", F.col("taxon") % 10)
    e = e.drop("y").join(e.groupBy("taxon").agg(F.avg("y").alias("y")), "taxon")
    a = lambda c, xs: F.explode(F.array(*[F.lit(x) for x in xs])).alias(c)
    grid = s.range(1).select(a("n_genes", (3, 6, 8, 10))).select("n_genes", a("n_dims", (1, 2, 3, 5))).select("n_genes", "n_dims", a("min_abs_r", (0.0, 0.1, 0.12, 0.15, 0.2)))
    grid = grid.withColumn("param", (F.col("n_genes") * 10000 + F.col("n_dims") * 1000 + F.round(F.col("min_abs_r") * 100)).cast("int"))
    return r_(az.grid_search_genes(e, "taxon", "gene", "v", "y", "clade", F.col("clade") < 7, grid), 5)


@query("lasso_ridge")
def _(s, d):
    from cladeloom.operators.models import elastic_net_cv
    x = v.vectors(s, d)
    return r_(elastic_net_cv(x, "v", "y", F.pmod(F.col("gene"), F.lit(5)), 5, [0.01, 0.1], [0.0, 1.0]), 4)


@query("cv_models_table")
def _(s, d):
    from cladeloom.operators.models import cv_models_table
    return r_(cv_models_table(v.vectors(s, d), "v", "y", F.pmod(F.col("id"), F.lit(5)), 5), 4)


@query("feature_select_top_cor", f"""
with {v.VEC}, u as (select gene, id % 5 as ord, y, unnest(v) as x, unnest(range(0, 64)) as dim from v_vec),
c as (select gene, ord, dim, count(*) as n, corr(x, y) as r from u group by 1, 2, 3 having count(*) >= 3), m as (select gene, dim, sum(n) as n, sum(r * n) / sum(n) as r from c group by 1, 2)
select gene, cast(dim as int) as dim, cast(n as bigint) as n, round(r, 6) as r, cast(rn as int) as rank_no from (select *, row_number() over (partition by gene order by round(abs(r), 10) desc, dim) as rn from m) where rn <= 5""")
def _(s, d):
    x = v.vectors(s, d).withColumn("ord", F.col("id") % 5)
    return r_(az.top_correlated_features(x, "gene", "v", "y", "ord", 5, "weighted").select("gene", "dim", "n", "r", "rank_no"))


@query("top_share_by_abs", f"""
with {v.VEC}, u as (select gene, y, unnest(v) as x, unnest(range(0, 64)) as dim from v_vec), c as (select gene, dim, count(*) as n, corr(x, y) as r from u group by 1, 2)
select gene, cast(dim as int) as dim, n, round(r, 6) as r, cast(rn as int) as rank_no from (select *, row_number() over (partition by gene order by round(abs(r), 10) desc, dim) as rn from c) where rn <= 3""")
def _(s, d):
    return r_(az.top_correlated_features(v.vectors(s, d), "gene", "v", "y", None, 3).select("gene", "dim", "n", "r", "rank_no"))


@query("greedy_orthogonal_select")
def _(s, d):
    return r_(az.greedy_orthogonal(v.vectors(s, d), "gene", "v", "y"))


@query("greedy_orthogonal_two_steps", f"""
with {v.VEC}, u as (select gene, id, y, unnest(v) as x, unnest(range(0, 64)) as dim from v_vec),
c1 as (select gene, dim, corr(x, y) as r from u group by 1, 2), s1 as (select gene, arg_max(dim, abs(r)) as d1, arg_max(r, abs(r)) as r1 from c1 group by 1),
p as (select u.gene, u.id, u.y, u.x from u join s1 on u.gene = s1.gene and u.dim = s1.d1), b as (select gene, regr_slope(y, x) as b, regr_intercept(y, x) as a from p group by 1),
e as (select p.gene, p.id, y - a - b * x as y from p join b using (gene)), c2 as (select u.gene, u.dim, corr(u.x, e.y) as r from u join e on u.id = e.id join s1 on s1.gene = u.gene and u.dim <> s1.d1 group by 1, 2), nn as (select gene, count(*) as n from v_vec group by 1)
select gene, cast(1 as int) as step, cast(d1 as int) as dim, n, round(r1, 6) as r from s1 join nn using (gene) union all select gene, 2, cast(arg_max(dim, abs(r)) as int), any_value(n), round(arg_max(r, abs(r)), 6) from c2 join nn using (gene) group by 1""")
def _(s, d):
    return r_(az.greedy_orthogonal(v.vectors(s, d), "gene", "v", "y", 2))


@query("grid_search")
def _(s, d):
    grid = s.range(3).select(F.explode(F.array(*[F.lit(k) for k in (5, 15, 30)])).alias("n_dims"), F.col("id").alias("i")).select(
        (F.col("i") * 100 + F.col("n_dims")).alias("param"), "n_dims", (F.col("i") * 0.05).alias("min_abs_r"))
    return r_(az.grid_search(v.vectors(s, d), "v", "y", "gene", F.pmod(F.xxhash64("id"), F.lit(10)) < 7, None, grid), 5)


@query("group_holdout_cv")
def _(s, d):
    return r_(az.group_holdout(v.vectors(s, d), "gene", "v", "y"))


@query("group_holdout_one_dimension", f"""
with {v.VEC}, g as (select distinct gene as h from v_vec), m as (select h, count(*) as n, regr_slope(y, v[2]) as b, regr_intercept(y, v[2]) as a from v_vec, g where gene <> h group by 1)
select h as gene, any_value(n) as n_train, count(*) as n_test, round(sqrt(avg(power(y - a - b * v[2], 2))), 6) as rmse, round(corr(a + b * v[2], y), 6) as r,
  round(1 - sum(power(y - a - b * v[2], 2)) / (var_pop(y) * count(*)), 6) + 0.0 as r2 from v_vec join m on gene = h group by 1""")
def _(s, d):
    x = v.vectors(s, d).withColumn("w", F.slice("v", 2, 1))
    return r_(az.group_holdout(x, "gene", "w", "y"))


@query("within_group_metrics", f"""
with k as (select l_suppkey, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2 as a,
  rank() over (partition by l_suppkey order by l_tax) + (count(*) over (partition by l_suppkey, l_tax) - 1) / 2 as b from lineitem), c as (select corr(a, b) as r from k group by l_suppkey),
w as (select corr(a, b) as g from (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 as a, rank() over (order by l_tax) + (count(*) over (partition by l_tax) - 1) / 2 as b from lineitem)),
m as (select count(*) as n, avg(r) as e, stddev_samp(r) as sd from c)
select n, round(e, 8) as estimate, round(e / (sd / sqrt(n)), 5) as statistic, round({q.t_tail('e / (sd / sqrt(n))', 'n - 1')}, 6) as p_value, round(sd, 8) as sd, round(g, 8) as global_rho from m, w""")
def _(s, d):
    return r_(az.within_group_metrics(table(s, d, "lineitem"), "l_quantity", "l_tax", "l_suppkey"), 8, statistic=5, p_value=6)


@query("hit_direction")
def _(s, d):
    return r_(az.hit_direction(az.site_scan(_complete(s, d), _traits(s, d, 4)), 0.5))


@query("major_minor_transitions", f"""
with {v.SITES}, c as (select gene, pos, allele, count(*) as n from v_sites where allele not in ('-', 'X') group by 1, 2, 3),
r as (select *, row_number() over (partition by gene, pos order by n desc, allele) as rn from c), h as (select 'A' as aa, 1.8e0 as h, 71.0788e0 as m union all select 'N', -3.5e0, 114.1038e0 union all select 'R', -4.5e0, 156.1875e0)
select a.gene, a.pos, a.allele as major, b.allele as minor, b.n as count, round(y.h - x.h, 6) as delta_hydro, round(y.m - x.m, 4) as delta_mw,
  case when y.h > x.h then 'increase' when y.h < x.h then 'decrease' else 'no_change' end as hydro_dir
from r a join r b on a.gene = b.gene and a.pos = b.pos and a.rn = 1 and b.rn > 1 and b.n > 10 join h x on x.aa = a.allele join h y on y.aa = b.allele""")
def _(s, d):
    m = lambda t, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), F.col(c))
    t = az.major_minor_transitions(v.sites(s, d))
    dh, dm = m(sc.HYDROPATHY, "minor") - m(sc.HYDROPATHY, "major"), m(sc.RESIDUE_MASS, "minor") - m(sc.RESIDUE_MASS, "major")
    return r_(t.withColumns({"delta_hydro": dh, "delta_mw": dm, "hydro_dir": F.when(dh > 0, "increase").when(dh < 0, "decrease").otherwise("no_change")}), delta_mw=4)


@query("positional_enrichment", """
with t as (select l_suppkey, max(l_orderkey) as l from lineitem group by 1), b as (select l_returnflag, least(9, floor((l_orderkey - 1) / l * 10))::bigint as bin from lineitem join t using (l_suppkey)),
n as (select l_returnflag, bin, count(*) as n, sum(count(*)) over (partition by l_returnflag) as total from b group by 1, 2)
select l_returnflag, bin, n, cast(total as bigint) as total, round(n / total, 8) as share, round(sqrt(n / total * (1 - n / total) / total), 8) as se from n""")
def _(s, d):
    return r_(az.positional_enrichment(table(s, d, "lineitem"), "l_suppkey", "l_orderkey", "l_returnflag").withColumn("bin", F.col("bin").cast("bigint")), 8)


@query("score_comparison", """
with a as (select l_partkey, min(l_quantity) / 51 as p from lineitem where l_linestatus = 'F' group by 1), b as (select l_partkey, min(l_quantity) / 51 as p from lineitem where l_linestatus = 'O' group by 1),
j as (select a.p as pa, b.p as pb from a join b using (l_partkey))
select count(*) as n, round(corr(-log10(pa), -log10(pb)), 6) as r, count(*) filter (pa < 0.05 and pb < 0.05) as "both", count(*) filter (pa < 0.05 and pb >= 0.05) as only_a, count(*) filter (pa >= 0.05 and pb < 0.05) as only_b from j""")
def _(s, d):
    f = lambda st: table(s, d, "lineitem").where(F.col("l_linestatus") == st).groupBy("l_partkey").agg((F.min("l_quantity") / 51).alias("p"))
    return r_(az.score_comparison(f("F"), f("O"), ["l_partkey"], "p"))


@query("run_site_overlap", """
with r as (select *, case when lag(event_type) over w = event_type then 0 else 1 end as brk from events window w as (partition by user_id order by ts, event_id)),
k as (select *, sum(brk) over (partition by user_id order by ts, event_id) as run, value / 500 as p from r), a as (select user_id, run, avg(p) as pr, min(p) as ps, bool_or(p < 0.05) as hit, count(*) as n from k group by 1, 2)
select case when pr < 0.05 then 1 else 0 end as run_sig, hit::int as any_site_sig, count(*) as n_runs, cast(sum(n) as bigint) as n_sites, round(min(ps), 8) as min_site_p from a group by 1, 2""")
def _(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id", "event_type", (F.col("value") / 500).alias("p"))
    r = ag.break_runs(e, ["user_id"], ["ts", "event_id"], "event_type")
    runs = r.groupBy("user_id", "run").agg(F.avg("p").alias("pr"))
    o = az.run_site_overlap(runs, r, ["user_id"], "event_id", "pr", "p", 0.05)
    return r_(o.groupBy(F.col("run_sig").cast("int").alias("run_sig"), F.col("any_site_sig").cast("int").alias("any_site_sig")).agg(
        v.count_as("n_runs"), F.sum("n_sites").alias("n_sites"), F.min("min_site_p").alias("min_site_p")), 8)


@query("metrics_by_file", """
with f as (select 'pred_' || l_returnflag || '_bio' || l_linenumber || '_p' || case when l_linestatus = 'F' then 10 else 90 end || '.csv' as file, l_quantity as a, l_extendedprice / 1000 as b from lineitem),
k as (select *, rank() over (partition by file order by a) + (count(*) over (partition by file, a) - 1) / 2 as ra, rank() over (partition by file order by b) + (count(*) over (partition by file, b) - 1) / 2 as rb from f)
select regexp_extract(file, 'pred_([A-Z]+)_(bio[0-9]+)_p([0-9]+)', 1) as ord, regexp_extract(file, 'pred_([A-Z]+)_(bio[0-9]+)_p([0-9]+)', 2) as pheno, regexp_extract(file, 'pred_([A-Z]+)_(bio[0-9]+)_p([0-9]+)', 3) as pct,
  count(*) as n, round(corr(a, b), 6) as pearson, round(corr(ra, rb), 6) as spearman, round(sqrt(avg(power(a - b, 2))), 5) as rmse from k group by file""")
def _(s, d):
    f = F.concat(F.lit("pred_"), "l_returnflag", F.lit("_bio"), F.col("l_linenumber").cast("string"), F.lit("_p"), F.when(F.col("l_linestatus") == "F", "10").otherwise("90"), F.lit(".csv"))
    x = table(s, d, "lineitem").select(f.alias("file"), F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    return r_(az.metrics_by_file(x, "file", "pred_([A-Z]+)_(bio[0-9]+)_p([0-9]+)", ["ord", "pheno", "pct"], "a", "b"), rmse=5)


_PROP = ", ".join(f"('{a}', {sc.RESIDUE_MASS[a]}e0, {sc.ISOELECTRIC[a]}e0, {sc.HYDROPATHY[a]}e0)" for a in "ANR")


@query("site_property_summary", f"""
with {v.SITES}, c as (select gene, pos, allele, count(*) as n from v_sites where allele <> '-' group by 1, 2, 3), pr(aa, mass, pi, hyd) as (values {_PROP})
select gene, pos, round(sum(n * mass) / sum(n), 4) as mean_mass, round(sum(n * pi) / sum(n), 6) as mean_pi, round(sum(n * hyd) / sum(n), 6) as mean_hydrophobicity,
  round(sum(n) filter (aa in ('R', 'K', 'D', 'E', 'H')) / sum(n), 8) as prop_charged, round(sum(n) filter (aa in ('S', 'T', 'Y', 'N', 'Q', 'C')) / sum(n), 8) as prop_polar from c join pr on aa = allele group by 1, 2""")
def _(s, d):
    c = si.allele_counts(v.sites(s, d))
    m = lambda t: F.try_element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), F.col("allele"))
    n = F.col("n")
    share = lambda k: F.sum(F.when(F.col("allele").isin(list(sc.RESIDUE_CLASSES[k])), n)) / F.sum("n")
    g = c.groupBy("gene", "pos").agg((F.sum(n * m(sc.RESIDUE_MASS)) / F.sum("n")).alias("mean_mass"), (F.sum(n * m(sc.ISOELECTRIC)) / F.sum("n")).alias("mean_pi"),
                                     (F.sum(n * m(sc.HYDROPATHY)) / F.sum("n")).alias("mean_hydrophobicity"), share("charged").alias("prop_charged"), share("polar").alias("prop_polar"))
    return r_(g, mean_mass=4, prop_charged=8, prop_polar=8)
