"""Tree-shaped tables: node k of the customer tree hangs under k div 2, so SQL ancestors are right shifts."""
from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.operators import assoc as az, jumps, matrix as mx, stats as sx, tree as tr
from cladeloom.plans import sqlstat as q, views as v
from cladeloom.plans.q_matrix import _LOC, _MOR, _loc
from cladeloom.plans.q_stats import r_
from cladeloom.plans.registry import query, table

# closure, node facts, tip traits
_T = f"""{v.EDGES}, v_anc as (select * from (select child as node, child >> j as ancestor, j as steps from v_edges, (select unnest(range(1, 60)) as j)) where ancestor >= 1),
v_len as (select a.node, a.ancestor, a.steps, sum(e.length) as length from v_anc a join v_anc p on p.node = a.node and p.steps < a.steps join v_edges e on e.child = p.ancestor group by 1, 2, 3),
v_clo as (select a.node, a.ancestor, a.steps, e.length + coalesce(l.length, 0) as length from v_anc a join v_edges e on e.child = a.node left join v_len l using (node, ancestor)),
v_node as (select n.node, not exists (select 1 from v_edges e where e.parent = n.node) as is_tip from (select child as node from v_edges union select 1) n),
v_size as (select n.node, n.is_tip, 1 + (select count(*) from v_anc a where a.ancestor = n.node) as sz from v_node n),
v_tip as (select node, c_acctbal as x from v_node join customer on c_custkey + 1 = node where is_tip)"""
_IX = _T + """,
v_off as (select e.child as node, 1 + coalesce(sum(s.sz), 0) as off from v_edges e left join v_edges o on o.parent = e.parent and o.child < e.child left join v_size s on s.node = o.child group by 1),
v_ix as (select n.node, n.is_tip, n.sz, coalesce((select max(steps) from v_clo c where c.node = n.node), 0) as depth, coalesce((select max(length) from v_clo c where c.node = n.node), 0) as root_dist,
  coalesce((select off from v_off o where o.node = n.node), 0) + coalesce((select sum(off) from v_clo c join v_off o on o.node = c.ancestor where c.node = n.node), 0) as tin,
  case when n.is_tip then 1 else (select count(*) from v_anc a join v_node t on t.node = a.node and t.is_tip where a.ancestor = n.node) end as n_tips from v_size n)"""


def tips(s, d):
    e = v.edges(s, d)
    t = tr.nodes_of(e).where("is_tip").select("node")
    return t.join(table(s, d, "customer").select((F.col("c_custkey") + 1).alias("node"), F.col("c_acctbal").alias("x")), "node")


def _tree(s, d):
    return jumps.grow(v.edges(s, d))


@query("ancestor_descendant_join", f"with {_T} select ancestor, node, steps::int as steps, round(length, 6) as length from v_clo")
def _(s, d):
    return r_(tr.ancestor_closure(v.edges(s, d)))


@query("tree_index", f"""
with {_IX} select node, is_tip::int as is_tip, depth::int as depth, round(root_dist, 6) as root_dist, n_tips::bigint as n_tips, tin::bigint as tin, (tin + sz - 1)::bigint as tout from v_ix""")
def _(s, d):
    ix = _tree(s, d).index
    return r_(ix.select("node", F.col("is_tip").cast("int").alias("is_tip"), "depth", "root_dist", "n_tips", F.col("tin").cast("bigint").alias("tin"), F.col("tout").cast("bigint").alias("tout")))


_PC = f"{v.STATES}, pc as (select e.parent, e.child, c.pos, p.aa as from_aa, c.aa as to_aa, e.length from v_edges e join v_states c on c.node = e.child join v_states p on p.node = e.parent and p.pos = c.pos)"
_SUB = _PC + ", sub as (select * from pc where from_aa <> to_aa and from_aa <> '-' and to_aa <> '-')"


def subs(s, d):
    return tr.extract_substitutions(v.edges(s, d), v.states(s, d))


@query("parent_child_self_join", f"with {v.EDGES}, {_PC} select parent, child, pos, from_aa, to_aa, round(length, 6) as length from pc")
def _(s, d):
    return r_(tr.parent_child_states(v.edges(s, d), v.states(s, d)))


@query("extract_substitutions", f"with {v.EDGES}, {_SUB} select parent, child, pos, from_aa, to_aa, round(length, 6) as length from sub")
def _(s, d):
    return r_(subs(s, d))


@query("sister_join", f"with {v.EDGES} select a.child as node, b.child as sister, a.parent from v_edges a join v_edges b on a.parent = b.parent and a.child <> b.child")
def _(s, d):
    return tr.sisters(v.edges(s, d))


@query("edge_co_occurrence", f"""
with {v.EDGES}, {_PC} select a.pos as pos_a, b.pos as pos_b, count(*) filter (a.from_aa <> a.to_aa and b.from_aa <> b.to_aa) as "both", count(*) filter (a.from_aa <> a.to_aa and b.from_aa = b.to_aa) as only_a,
  count(*) filter (a.from_aa = a.to_aa and b.from_aa <> b.to_aa) as only_b, count(*) filter (a.from_aa = a.to_aa and b.from_aa = b.to_aa) as neither from pc a join pc b on a.child = b.child and a.pos < b.pos group by 1, 2""")
def _(s, d):
    return tr.edge_co_occurrence(v.edges(s, d), v.states(s, d))


_ORI = _SUB + """, tipst as (select pos, aa, count(*) as n_tips from v_states join v_node using (node) where is_tip group by 1, 2),
ori as (select o.pos, o.aa, o.n_origins, o.parents, coalesce(n_tips, 0) as n_tips from (select pos, to_aa as aa, count(*) as n_origins, string_agg(distinct from_aa, ',' order by from_aa) as parents from sub group by 1, 2) o left join tipst using (pos, aa))"""


def _origins(s, d):
    e = v.edges(s, d)
    t = v.states(s, d).join(tr.nodes_of(e).where("is_tip").select("node"), "node", "left_semi")
    return tr.count_origins(subs(s, d), t)


@query("count_origins", f"with {_T}, {_ORI} select pos, aa, n_origins, parents, n_tips, round(n_origins / n_tips, 6) as ratio from ori")
def _(s, d):
    return r_(_origins(s, d))


@query("site_convergence", f"""
with {_T}, {_ORI} select pos, cast(sum(n_origins) as bigint) as total_origins, max(n_origins) as max_origins, count(*) as n_variants, round(sum(n_origins) / count(*), 6) as origins_per_variant,
  round(sum(n_origins / n_tips * n_tips) / sum(n_tips), 6) as weighted_ratio from ori group by 1""")
def _(s, d):
    return r_(tr.site_convergence(_origins(s, d)))


_MRCA = """g as (select c_nationkey as grp, node from customer join v_node on node = c_custkey + 1 where is_tip), up as (select grp, g.node, ancestor from g join v_anc a on a.node = g.node union select grp, node, node from g),
cov as (select grp, ancestor, count(*) as k from up group by 1, 2), tot as (select grp, count(*) as n from g group by 1), m as (select grp, n, max(ancestor) as mrca from cov join tot using (grp) where k = n group by 1, 2)"""


def _groups(s, d):
    return tips(s, d).join(table(s, d, "customer").select((F.col("c_custkey") + 1).alias("node"), F.col("c_nationkey").alias("grp")), "node").select("grp", "node")


@query("mrca_depth", f"""
with {_IX}, {_MRCA} select grp, n as n_members, mrca, depth::int as mrca_depth, round(root_dist, 6) as mrca_dist, n_tips::bigint as clade_tips from m join v_ix on node = mrca""")
def _(s, d):
    return r_(tr.mrca(_groups(s, d), ["grp"], _tree(s, d)))


@query("monophyly_check", f"with {_IX}, {_MRCA} select grp, n as n_members, mrca, n_tips::bigint as clade_tips, (n = n_tips)::int as is_monophyletic from m join v_ix on node = mrca")
def _(s, d):
    return tr.monophyly(_groups(s, d), "grp", _tree(s, d)).withColumn("is_monophyletic", F.col("is_monophyletic").cast("int"))


_CM = "cm as (select node, count(*) as n_tips, avg(x) as mean from (select ancestor as node, x from v_anc join v_tip using (node) union all select node, x from v_tip) group by 1)"


@query("clade_mean", f"""
with {_T}, {_CM} select c.node, c.n_tips, round(c.mean + 1e-7, 5) as mean, (c.mean > p.mean)::int as above_parent from cm c left join v_edges on child = c.node left join cm p on p.node = parent""")
def _(s, d):
    e = v.edges(s, d)
    m = tr.clade_means(e, tips(s, d), "x")
    par = e.select(F.col("child").alias("node"), "parent").join(m.select(F.col("node").alias("parent"), F.col("mean").alias("pm")), "parent")
    return r_(m.join(par, "node", "left").select("node", "n_tips", (F.col("mean") + 1e-7).alias("mean"), (F.col("mean") > F.col("pm")).cast("int").alias("above_parent")), 5)


_EFF = "eff as (select pos, aa, avg(c_acctbal) / 1000 as effect from v_states join customer on c_custkey + 1 = node group by 1, 2)"


def _effects(s, d):
    c = table(s, d, "customer").select((F.col("c_custkey") + 1).alias("node"), "c_acctbal")
    return v.states(s, d).join(c, "node").groupBy("pos", "aa").agg((F.avg("c_acctbal") / 1000).alias("effect"))


@query("sister_contrasts", f"""
with {_T}, {_CM}, {_SUB}, {_EFF} select s.pos, s.parent, s.child, o.child as sister, from_aa, to_aa, round(t.effect - f.effect, 6) + 0.0 as effect_change, round(a.mean - b.mean + 1e-7, 5) + 0.0 as contrast
from sub s join v_edges o on o.parent = s.parent and o.child <> s.child join cm a on a.node = s.child join cm b on b.node = o.child join eff f on f.pos = s.pos and f.aa = from_aa join eff t on t.pos = s.pos and t.aa = to_aa""")
def _(s, d):
    e = v.edges(s, d)
    m = tr.clade_means(e, tips(s, d), "x")
    return r_(tr.sister_contrasts(subs(s, d), e, m, _effects(s, d)).withColumn("contrast", F.col("contrast") + 1e-7), contrast=5)


@query("back_mutation_flag", f"""
with {_T}, {_SUB}, h as (select distinct b.pos, a.ancestor as child from sub b join v_anc a on a.node = b.child), f as (select s.pos, s.parent, s.child, (h.child is not null) as x from sub s left join h on h.pos = s.pos and h.child = s.child)
select pos, parent, child, x::int as is_above, (bool_or(x) over (partition by child))::int as edge_is_above from f""")
def _(s, d):
    b = tr.back_mutations(subs(s, d), _tree(s, d))
    return b.select("pos", "parent", "child", F.col("is_above").cast("int").alias("is_above"), F.col("edge_is_above").cast("int").alias("edge_is_above"))


@query("confidence_filter", f"""
with {v.EDGES}, {_SUB} select s.pos, s.parent, s.child, from_aa, to_aa from sub s join v_probs p on p.node = s.parent and p.pos = s.pos and p.aa = from_aa and p.prob >= 0.4
join v_probs c on c.node = s.child and c.pos = s.pos and c.aa = to_aa and c.prob >= 0.4""")
def _(s, d):
    return tr.confidence_filter(subs(s, d), v.state_probs(s, d), 0.4).select("pos", "parent", "child", "from_aa", "to_aa")


# estimates from tips to root, one depth a step; tips above the current depth wait
_UP = """dn as (select node, floor(log2(node))::bigint as depth from v_node),
up as ({base}
  union all select {by} cur - 1, case when depth = cur then u.node // 2 else u.node end, case when depth = cur then depth - 1 else depth end, {vals},
    case when any_value(depth) = any_value(cur) then 1 / sum(1 / (var + e.length)) else 0 end, count(*), {con}
  from up u join v_edges e on e.child = u.node where cur > 0 group by all)"""


@query("ancestral_trait", f"""
with recursive {_T}, {_UP.format(base="select (select max(depth) from dn) as cur, t.node, depth, x, 0.0e0 as var, 1::bigint as k, 0.0e0 as c from v_tip t join dn using (node)", by="",
                                vals="sum(x * case when depth = cur then 1 / (var + e.length) else 1 end) / sum(case when depth = cur then 1 / (var + e.length) else 1 end)", con="0.0e0")},
est as (select node, any_value(x) as x, any_value(var) as var from up group by 1),
down as (select node, x from est where node = 1 union all
  select est.node, case when est.var = 0 then est.x else (est.x / est.var + d.x / length) / (1 / est.var + 1 / length) end from down d join v_edges on parent = d.node join est on est.node = child)
select node, round(x, 6) + 0.0 as x from down""")
def _(s, d):
    return r_(tr.ancestral_trait(v.edges(s, d), tips(s, d), "x"))


@query("independent_contrasts", f"""
with recursive {_T}, {v.STATES}, {_EFF}, ts as (select s.pos, s.node, s.aa, effect as score, x as trait from v_states s join v_tip using (node) join eff using (pos, aa) where s.aa <> '-'),
st as (select pos, count(*) as n_tips, count(distinct aa) as n_residues, case when count(*) < 20 then 'insufficient_tips' when count(distinct aa) < 2 then 'monomorphic'
  when var_samp(score) < 1e-10 or var_samp(trait) < 1e-10 then 'no_variance' else 'success' end as status from ts group by 1),
{_UP.format(base="select pos, (select max(depth) from dn) as cur, t.node, depth, score, trait, 0.0e0 as var, 1::bigint as k, 0.0e0 as cs, 0.0e0 as ct from ts t join dn using (node) join st using (pos) where status = 'success'", by="pos,",
            vals=", ".join(f"sum({c} * case when depth = cur then 1 / (var + e.length) else 1 end) / sum(case when depth = cur then 1 / (var + e.length) else 1 end)" for c in ("score", "trait")),
            con=", ".join(f"(arg_min({c}, u.node) - arg_max({c}, u.node)) / sqrt(sum(var + e.length))" for c in ("score", "trait")))},
con as (select pos, node, any_value(cs) as cs, any_value(ct) as ct from up where k = 2 group by 1, 2),
c as (select pos, count(*) as n, corr(cs, ct) as r from con group by 1), t as (select *, r * sqrt((n - 2) / (1 - r * r)) as t from c)
select pos, n_tips, n_residues, status, n as n_contrasts, round(r, 6) + 0.0 as r, round({q.t_tail('t', 'n - 2')}, 6) as p_value from st left join t using (pos)""")
def _(s, d):
    e = v.edges(s, d)
    st = v.states(s, d).where("aa <> '-'").join(tips(s, d).withColumnRenamed("x", "trait"), "node")
    t = st.join(_effects(s, d).withColumnRenamed("effect", "score"), ["pos", "aa"]).select("pos", "node", "aa", "score", "trait")
    return r_(tr.contrast_scan(e, t, 20))


@query("trait_clades", f"""
with {_T}, b as (select ancestor as node, count(*) as n_tips, min((x > 0)::int) as ok from v_anc join v_tip using (node) group by 1), k as (select node, n_tips from b where ok = 1 and n_tips >= 3)
select node, n_tips from k where not exists (select 1 from v_anc a join k o on o.node = a.ancestor where a.node = k.node)""")
def _(s, d):
    return tr.trait_clades(_tree(s, d), tips(s, d).withColumn("ok", F.col("x") > 0), "ok", 3)


# the greedy choice in hash order, one candidate a step
@query("select_holdout_clades", f"""
with recursive {_IX}, cand as (select node, n_tips, tin, tin + sz - 1 as tout, row_number() over (order by ('0x' || substr(md5(node || '|42'), 1, 13))::bigint, node) as k from v_ix where not is_tip and n_tips between 10 and 30),
g as (select 0::bigint as k, []::bigint[] as starts, []::bigint[] as ends
  union all select c.k, case when hit then starts else list_append(starts, c.tin::bigint) end, case when hit then ends else list_append(ends, c.tout::bigint) end
  from (select g.starts, g.ends, c.*, len(list_filter(list_zip(g.starts, g.ends), lambda z: z[1] <= c.tout and c.tin <= z[2])) > 0 as hit from g join cand c on c.k = g.k + 1) c),
last as (select starts, ends from g order by k desc limit 1),
ch as (select c.* from cand c join (select unnest(starts) as tin, unnest(ends) as tout from last) u using (tin, tout)), cu as (select node, n_tips, sum(n_tips) over (order by k) as cum from ch)
select node, n_tips::bigint as n_tips, cum::bigint as cum_tips from cu where cum - n_tips < (select floor(count(*) * 0.15) from v_node where is_tip)""")
def _(s, d):
    return tr.select_holdout_clades(_tree(s, d))


@query("sister_tip_pairs", f"""
with {_T} select parent, min(child) as a, max(child) as b from v_edges join v_node on node = child where is_tip group by 1 having count(*) = 2""")
def _(s, d):
    return tr.cherries(v.edges(s, d))


_KD = " + ".join(f"power((case {{a}} {' '.join(f'when {chr(39)}{x}{chr(39)} then {v_[i]}e0' for x, v_ in __import__('cladeloom.functions.scales', fromlist=['KIDERA']).KIDERA.items() if x in 'ANR')} end) - (case {{b}} {' '.join(f'when {chr(39)}{x}{chr(39)} then {v_[i]}e0' for x, v_ in __import__('cladeloom.functions.scales', fromlist=['KIDERA']).KIDERA.items() if x in 'ANR')} end), 2)" for i in range(10))


@query("transition_matrix", f"""
with {v.EDGES}, {_SUB}, n as (select (length > 5)::int as cls, from_aa, to_aa, count(*) as n from sub group by 1, 2, 3)
select cls, from_aa, to_aa, n, round(n / sum(n) over (partition by cls), 8) as share, round(sqrt({_KD.format(a='from_aa', b='to_aa')}), 6) as kidera_distance, 0 as is_conservative from n""")
def _(s, d):
    c = subs(s, d).withColumn("cls", (F.col("length") > 5).cast("int"))
    return r_(tr.transition_matrix(c, "cls", "from_aa", "to_aa").withColumn("is_conservative", F.col("is_conservative").cast("int")), share=8)


@query("direction_summaries", f"""
with {_T}, val as (select c_custkey + 1 as node, c_acctbal as x from customer), ch as (select e.parent, e.child, c.x - p.x as change from v_edges e join val c on c.node = e.child join val p on p.node = e.parent),
sd as (select stddev_samp(change) as s from ch), l as (select child, case when change > 0.5 * s then 'warm' when change < -0.5 * s then 'cold' else 'neutral' end as direction, change from ch, sd),
b as (select ancestor as node, avg(x) as m from v_anc join val using (node) where steps <= 3 group by 1)
select direction, count(*) as n, round(avg(change), 5) as mean_change, count(m) as n_with_descendants, round(avg(m - x), 5) as mean_after from l join val on val.node = l.child left join b on b.node = l.child group by 1""")
def _(s, d):
    e = v.edges(s, d)
    val = table(s, d, "customer").select((F.col("c_custkey") + 1).alias("node"), F.col("c_acctbal").alias("x"))
    l = tr.trait_shifts(e, val, "x")
    b = tr.downstream_mean(e, val, "x", 3).select(F.col("node").alias("child"), "mean_below")
    j = l.join(val.withColumnRenamed("node", "child"), "child").join(b, "child", "left")
    return r_(j.groupBy("direction").agg(v.count_as(), F.avg("change").alias("mean_change"), F.count("mean_below").alias("n_with_descendants"), F.avg(F.col("mean_below") - F.col("x")).alias("mean_after")), 5)


@query("ancestor_trend", f"""
with {_T}, val as (select c_custkey + 1 as node, c_acctbal as x from customer), p as (select a.node, steps, x from v_anc a join val on val.node = a.ancestor where steps <= 5 union all select node, 0, x from val)
select node, count(*) as n, round(-regr_slope(x, steps), 5) + 0.0 as trend from p group by 1 having count(*) >= 2""")
def _(s, d):
    val = table(s, d, "customer").select((F.col("c_custkey") + 1).alias("node"), F.col("c_acctbal").alias("x"))
    return r_(tr.ancestor_trend(v.edges(s, d), val, "x"), 5)


@query("patristic_distance", f"""
with {_IX}, u as (select node, ancestor from v_anc union select node, node from v_node), p as (select t.node as a, t.node + 1 as b from v_tip t join v_tip o on o.node = t.node + 1),
m as (select a, b, max(i.root_dist) as m from p join u x on x.node = a join u y on y.node = b and y.ancestor = x.ancestor join v_ix i on i.node = x.ancestor group by 1, 2)
select a, b, round(x.root_dist + y.root_dist - 2 * m, 6) as distance from m join v_ix x on x.node = a join v_ix y on y.node = b""")
def _(s, d):
    t = tips(s, d).select("node")
    p = t.select(F.col("node").alias("a"), (F.col("node") + 1).alias("b")).join(t.select(F.col("node").alias("b")), "b", "left_semi")
    return r_(tr.patristic_distance(p, "a", "b", _tree(s, d)))


# the variance of the residuals dealt to the places at random, which depends on their kurtosis, and the p-value
_MOR_RANDOMISED = _MOR.replace("(select sum(z * z) from z) as z2,", "(select sum(z * z) from z) as z2, (select sum(power(z, 4)) from z) as z4,").replace(
    "(n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1.0e0) * s0 * s0)",
    "(n * ((n * n - 3.0e0 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - n * z4 / (z2 * z2) * (n * (n - 1.0e0) * s1 - 2.0e0 * n * s2 + 6 * s0 * s0)) / ((n - 1.0e0) * (n - 2) * (n - 3) * s0 * s0)").replace(
    "as z from m", f"as z, round({q.norm_tail('(mi - ei) / sqrt(va)')}, 6) as p_value from m".replace("{", "{{").replace("}", "}}"))


@query("residual_autocorrelation", f"with {_LOC.replace('c_acctbal * 0.01e0 + c_custkey % 13 as x from customer', 'x - regr_slope(x, t) over () * t - regr_intercept(x, t) over () as x from (select *, (c_mktsegment = ' + chr(39) + 'BUILDING' + chr(39) + ')::int::double as x, c_acctbal as t from customer)')}"
       + _MOR_RANDOMISED.format(w="1 / (list_distance(a.p, b.p) + 0.001e0)", on=""))
def _(s, d):
    c = table(s, d, "customer")
    x = c.select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 100, F.col("c_nationkey") * 3.0).alias("p"),
                 (F.col("c_mktsegment") == "BUILDING").cast("double").alias("code"), F.array("c_acctbal").alias("t"))
    return r_(mx.morans_i(az.residualize(x, F.col("t"), "code", "x"), "id", "p", "x", randomised=True), 8, variance=10, z=5, p_value=6)


@query("binary_state_association", f"""
with {_T}, {v.STATES}, e as (select pos, aa, avg(x) as m from v_states join v_tip using (node) where aa <> '-' group by 1, 2), g as (select pos, avg(x) as gm from v_states join v_tip using (node) where aa <> '-' group by 1),
md as (select median(x) as md from v_tip), t as (select s.pos, (m > gm) as st, (x > md) as hi from v_states s join v_tip using (node) join e on e.pos = s.pos and e.aa = s.aa join g on g.pos = s.pos, md),
c as (select pos, count(*) filter (st and hi) as a, count(*) filter (st and not hi) as b, count(*) filter (not st and hi) as c, count(*) filter (not st and not hi) as d from t group by 1)
select pos, a, b, c, d, round({q.fisher_tail('a', 'b', 'c', 'd')}, 6) as p_value from c""")
def _(s, d):
    from cladeloom.operators.ordered import quantile_column
    t = tips(s, d)
    st = v.states(s, d).where("aa <> '-'").join(t, "node")
    e = st.groupBy("pos", "aa").agg(F.avg("x").alias("m"))
    g = st.groupBy("pos").agg(F.avg("x").alias("gm"))
    x = st.join(e, ["pos", "aa"]).join(g, "pos").withColumn("md", quantile_column(t, "x", 0.5))
    a, b = F.col("m") > F.col("gm"), F.col("x") > F.col("md")
    c = x.groupBy("pos").agg(F.count_if(a & b).alias("a"), F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"), F.count_if(~a & ~b).alias("d"))
    return r_(sx.fisher_exact(c, "a", "b", "c", "d").drop("odds_ratio"))


@query("branch_aggregates", f"""
with {v.EDGES}, {_SUB}, {_EFF}, c as (select s.child, t.effect - f.effect as x from sub s join eff f on f.pos = s.pos and f.aa = from_aa join eff t on t.pos = s.pos and t.aa = to_aa)
select parent, e.child, count(x) as n_changes, round(coalesce(sum(x), 0), 6) + 0.0 as sum_change from v_edges e left join c on c.child = e.child group by 1, 2""")
def _(s, d):
    ef = _effects(s, d)
    e = lambda a, o: ef.select("pos", F.col("aa").alias(a), F.col("effect").alias(o))
    x = subs(s, d).join(e("from_aa", "f"), ["pos", "from_aa"]).join(e("to_aa", "t"), ["pos", "to_aa"]).withColumn("x", F.col("t") - F.col("f"))
    return r_(tr.branch_aggregates(v.edges(s, d), x, "x"))


@query("branch_diagnostics", f"""
with {_IX}, q as (select quantile_cont(length, 0.99) as q from v_edges)
select count(*) as n_edges, round(avg(length), 6) as mean_length, round(median(length), 6) as median_length, round(avg(length) filter (is_tip), 6) as mean_tip, round(avg(length) filter (not is_tip), 6) as mean_internal,
  count(*) filter (length < 0.2) as n_near_zero, count(*) filter (length > q) as n_long, round(min(root_dist) filter (is_tip), 6) as min_root_to_tip, round(max(root_dist) filter (is_tip), 6) as max_root_to_tip,
  0::bigint as n_polytomies from v_edges join v_ix on node = child, q""")
def _(s, d):
    t = _tree(s, d)
    return r_(tr.branch_diagnostics(t.edges, t.index, 0.2))


@query("clamp_branches", f"with {v.EDGES} select child, round(greatest(length, 1.0), 6) as length from v_edges")
def _(s, d):
    return r_(tr.clamp_branches(v.edges(s, d), 1.0).select("child", "length"))
