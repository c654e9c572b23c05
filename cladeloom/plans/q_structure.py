"""Structure-shaped tables: residues are embedding points, chains are labels."""
from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.functions import scales as sc
from cladeloom.operators import joins as jn, structure as sr
from cladeloom.plans import sqlstat as q, views as v
from cladeloom.plans.q_joins import _XYZ, xyz
from cladeloom.plans.q_matrix import PANEL, panel
from cladeloom.plans.q_sequences import _COD
from cladeloom.plans.q_stats import r_
from cladeloom.plans.registry import query, table

_RES = f"{_XYZ}, res as (select id, gene as chain, 'g' || gene % 2 as gene, id // 10 as pos, p from xyz)"


def residues(s, d):
    x = xyz(s, d)
    return x.select("id", F.col("gene").alias("chain"), F.concat(F.lit("g"), (F.col("gene") % 2).cast("string")).alias("gene"), F.floor(F.col("id") / 10).alias("pos"), "p")


def atoms(s, d):
    r = residues(s, d)
    return r.select("chain", F.col("id").cast("int").alias("resno"), F.col("gene").alias("resid"), *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")])


@query("chain_summary", f"with {_RES} select chain, count(distinct id) as n_residues, min(id)::int as first_resno, max(id)::int as last_resno from res group by 1")
def _(s, d):
    return sr.chain_summary(atoms(s, d))


@query("ligand_centroids", f"with {_RES} select chain, gene as resid, round(avg(p[1]), 6) + 0.0 as x, round(avg(p[2]), 6) + 0.0 as y, round(avg(p[3]), 6) + 0.0 as z, count(*) as n_atoms from res group by 1, 2")
def _(s, d):
    return r_(sr.ligand_centroids(atoms(s, d), ["chain", "resid"]))


@query("residue_features", f"""
with {_RES}, lig as (select a.id, min(list_distance(a.p, b.p)) as l from res a join res b on b.chain = 9 where a.chain < 9 group by 1), fc as (select a.id, min(list_distance(a.p, b.p)) as f from res a join res b on a.chain <> b.chain and b.chain < 9 where a.chain < 9 group by 1),
g as (select gene, pos, count(*) as n, min(l) as a, avg(l) as b, max(l) as c, min(f) as i, sqrt(var_samp(p[1]) + var_samp(p[2]) + var_samp(p[3])) as s, avg(p[3]) as z from res join lig using (id) join fc using (id) group by 1, 2)
select gene, pos, n as n_copies, round(a, 6) as lig_min, round(b, 6) as lig_mean, round(c, 6) as lig_max, round(i, 6) as interface, round(s, 6) as spread, round(z, 6) + 0.0 as z, (a < 8)::int as near_ligand, (i < 15)::int as at_interface,
  case when z > 2 then 'lumen' when z < -2 then 'stroma' else 'membrane' end as compartment from g""")
def _(s, d):
    r = residues(s, d)
    return r_(sr.residue_features(r.where("chain < 9"), r.where("chain = 9"), 2.0))


@query("axis_distance", f"""
with {_XYZ}, c as (select avg(p[1]) as cx, avg(p[2]) as cy, avg(p[3]) as cz from xyz where gene = 0), l as (select avg(p[1]) as cx, avg(p[2]) as cy, avg(p[3]) as cz from xyz where gene = 1)
select id, round(sqrt(power(p[1] - c.cx, 2) + power(p[2] - c.cy, 2)), 6) as axis_dist,
  round(((p[1] - c.cx) * (l.cx - c.cx) + (p[2] - c.cy) * (l.cy - c.cy) + (p[3] - c.cz) * (l.cz - c.cz)) / (power(l.cx - c.cx, 2) + power(l.cy - c.cy, 2) + power(l.cz - c.cz, 2)), 6) + 0.0 as depth,
  round(p[1] * cos(radians(30)) - p[2] * sin(radians(30)), 6) + 0.0 as rx, round(p[1] * sin(radians(30)) + p[2] * cos(radians(30)), 6) + 0.0 as ry from xyz, c, l""")
def _(s, d):
    x = xyz(s, d)
    cen = lambda g: x.where(F.col("gene") == g).agg(F.array(*[F.avg(F.col("p")[i]) for i in range(3)])).scalar()
    y = x.withColumns({"a": cen(0), "b": cen(1)})
    rx, ry = sr.rotate2d(F.col("p")[0], F.col("p")[1], 30.0)
    return r_(y.select("id", sr.axis_distance(F.col("p"), F.col("a")).alias("axis_dist"), sr.membrane_depth(F.col("p"), F.col("a"), F.col("b")).alias("depth"), rx.alias("rx"), ry.alias("ry")))


@query("surface_proxy", f"""
with {_RES}, n as (select a.id, count(*) filter (list_distance(a.p, b.p) > 0 and list_distance(a.p, b.p) <= 5) as k from res a, res b group by 1),
g as (select gene, pos, min(k) as a, avg(k) as b, max(k) as c from res join n using (id) group by 1, 2)
select gene, pos, a as min_n, round(b, 6) as mean_n, c as max_n, (b < (select median(b) from g))::int as exposed from g""")
def _(s, d):
    return r_(sr.surface_proxy(residues(s, d), 5.0))


_ENR = """with r as (select case when l_quantity < 8 then 'sig_both' when l_quantity < 16 then 'sig_control' else 'not_sig' end as cls, l_extendedprice as price, l_tax as tax, (l_returnflag = 'R')::int as is_r, (l_linestatus = 'F')::int as is_f from lineitem)"""


@query("feature_enrichment_suite", _ENR + f""",
u as (select cls, 'price' as feature, price as x from r union all select cls, 'tax', tax from r),
t as (select c.cls as target, feature, x, (u.cls <> 'not_sig') as a from u join (select distinct cls from r where cls <> 'not_sig') c on u.cls = c.cls or u.cls = 'not_sig'),
k as (select *, rank() over (partition by target, feature order by x) + (count(*) over (partition by target, feature, x) - 1) / 2 as rk, power(count(*) over (partition by target, feature, x), 2) - 1.0e0 as tie from t),
m as (select target, feature, count(*) filter (a) as n1, count(*) filter (not a) as n2, sum(rk) filter (a) as r1, sum(tie) as ties from k group by 1, 2),
z as (select *, r1 - n1 * (n1 + 1) / 2 as w, sqrt(n1 * 1.0e0 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0e0)))) as sg from m),
zz as (select *, (w - n1 * 1.0e0 * n2 / 2 - sign(w - n1 * 1.0e0 * n2 / 2) * 0.5e0) / sg as zv from z),
b as (select cls, 'is_r' as feature, is_r as x from r union all select cls, 'is_f', is_f from r),
c as (select s.cls as target, feature, count(*) filter (b.cls <> 'not_sig' and x = 1) as a, count(*) filter (b.cls <> 'not_sig' and x = 0) as b, count(*) filter (b.cls = 'not_sig' and x = 1) as c, count(*) filter (b.cls = 'not_sig' and x = 0) as d
  from b join (select distinct cls from r where cls <> 'not_sig') s on b.cls = s.cls or b.cls = 'not_sig' group by 1, 2)
select target, feature, 'rank_sum' as test, n1, n2, round(w / (n1 * 1.0e0 * n2), 8) as estimate, round({q.norm_tail('zv')}, 6) as p_value from zz
union all select target, feature, 'exact', a + b, c + d, round(a * 1.0e0 * d / (b * 1.0e0 * c), 8), round({q.fisher_tail('a', 'b', 'c', 'd')}, 6) from c""")
def _(s, d):
    x = F.col("l_quantity")
    r = table(s, d, "lineitem").select(F.when(x < 8, "sig_both").when(x < 16, "sig_control").otherwise("not_sig").alias("cls"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"),
                                       (F.col("l_returnflag") == "R").cast("int").alias("is_r"), (F.col("l_linestatus") == "F").cast("int").alias("is_f"))
    return r_(sr.feature_enrichment(r, "cls", "not_sig", ["price", "tax"], ["is_r", "is_f"]), estimate=8)


@query("nearest_neighbour_stat", f"""
with {_XYZ}, k as (select count(*) as k from xyz where gene = 4), o as (select j as perm, id, p, row_number() over (partition by j order by ('0x' || substr(md5(concat_ws('|', id, j, 42)), 1, 13))::bigint, id) as i from xyz, (select unnest(range(1, 1000)) as j)),
d as (select perm, id, p from o, k where i <= k union all select 0, id, p from xyz where gene = 4), n as (select a.perm, a.id, min(list_distance(a.p, b.p)) as m from d a join d b on a.perm = b.perm and a.id <> b.id group by 1, 2),
m as (select perm, avg(m) as m from n group by 1), w as (select m as obs from m where perm = 0)
select round(max(obs), 6) as observed, round(avg(m), 6) as null_mean, count(*) as n_perm, round((count(*) filter (m <= obs + 1e-12) + 1) / (count(*) + 1), 6) as p_value from m, w where perm > 0""")
def _(s, d):
    return r_(sr.nearest_neighbour_stat(xyz(s, d), "id", "p", F.col("gene") == 4, 999))


@query("nearest_in_set", f"with {_XYZ} select a.gene, a.id, round(min(list_distance(a.p, b.p)), 6) as distance from xyz a join xyz b on a.gene = b.gene and a.id <> b.id group by 1, 2")
def _(s, d):
    return r_(sr.nearest_in_set(xyz(s, d), ["gene"], "id", "p"))


@query("contact_map", f"with {_XYZ} select a.id as a, b.id as b, round(list_distance(a.p, b.p), 6) as distance from xyz a join xyz b on a.id < b.id and list_distance(a.p, b.p) < 2")
def _(s, d):
    return r_(jn.radius_pairs(xyz(s, d), "id", "p", 2.0))


@query("genome_position", """
select l_orderkey, l_linenumber, l_partkey, case when p_partkey % 2 = 0 then p_size * 10 + (l_quantity::int - 1) * 3 else p_size * 10 + 400 - (l_quantity::int - 1) * 3 - 2 end as genome_pos from lineitem join part on p_partkey = l_partkey""")
def _(s, d):
    g = table(s, d, "part").select("p_partkey", (F.col("p_size") * 10).alias("start"), (F.col("p_size") * 10 + 400).alias("end"), F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1).alias("strand"))
    j = table(s, d, "lineitem").join(g, F.col("l_partkey") == F.col("p_partkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", sr.codon_start(F.col("strand"), F.col("start"), F.col("end"), F.col("l_quantity").cast("int")).alias("genome_pos"))


@query("spliced_offset", """
select p_brand as gene, p_partkey * 100 as "start", p_partkey * 100 + p_size as "end", coalesce(sum(p_size + 1) over (partition by p_brand order by p_partkey rows between unbounded preceding and 1 preceding), 0)::bigint as cds_offset from part""")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_brand").alias("gene"), (F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + F.col("p_size")).alias("end"))
    return sr.spliced_offset(p)


_TR = lambda c: _COD.replace("substr(dna, i + 1, 1)", f"substr({c}, 2, 1)").replace("substr(dna, i, 1)", f"substr({c}, 1, 1)").replace("instr('TCAG', substr(dna, i + 2, 1))", f"instr('TCAG', substr({c}, 3, 1))").replace("substr(dna, i, 3)", c).replace("substr(dna, i + 2, 1)", f"substr({c}, 3, 1)")


@query("variant_effect", f"""
with {v.SEQ}, va as (select l_orderkey, l_linenumber, l_partkey, l_suppkey as id, (l_partkey % 300)::bigint as "offset", substr('ACGT', l_linenumber % 4 + 1, 1) as alt from lineitem),
c as (select va.*, "offset" // 3 + 1 as residue_no, substr(dna, ("offset" // 3) * 3 + 1, 3) as ref_codon from va join v_seq using (id) where "offset" < length(dna) // 3 * 3),
a as (select *, substr(ref_codon, 1, ("offset" % 3)::bigint) || alt || substr(ref_codon, ("offset" % 3 + 2)::bigint, 3) as alt_codon from c)
select l_orderkey, l_linenumber, l_partkey, residue_no, ref_codon, alt_codon, {_TR('ref_codon')} as ref_aa, {_TR('alt_codon')} as alt_aa, ({_TR('ref_codon')} = {_TR('alt_codon')})::int as synonymous from a where alt_codon <> ref_codon""")
def _(s, d):
    va = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("id"), (F.col("l_partkey") % 300).alias("offset"),
                                        F.expr("substring('ACGT', l_linenumber % 4 + 1, 1)").alias("alt"))
    e = sr.variant_effect(va, v.seqs(s, d), "id", "offset", "alt", "dna")
    return e.select("l_orderkey", "l_linenumber", "l_partkey", "residue_no", "ref_codon", "alt_codon", "ref_aa", "alt_aa", "synonymous")


@query("cross_candidates", f"""
with {PANEL}, p as (select x.id as a, y.id as b, count(*) filter (x.allele <> y.allele) as n_diff, count(*) as n_shared,
  string_agg(x.gene || ':' || x.pos || '(' || x.allele || '/' || y.allele || ')', ';' order by x.gene, x.pos) filter (x.allele <> y.allele) as detail
  from v_panel x join v_panel y on x.gene = y.gene and x.pos = y.pos and x.id < y.id group by 1, 2)
select a, b, n_diff, n_shared, detail, round(100 * n_diff / n_shared, 6) as pct from p order by n_diff desc, a, b limit 10""")
def _(s, d):
    return r_(sr.cross_candidates(panel(s, d), ["A", "N", "R"], 10))


@query("variant_score_join", """
with v as (select distinct l_linestatus, l_linenumber, l_returnflag from lineitem), p as (select l_linestatus, l_linenumber, min(l_extendedprice) / 1e6 as p from lineitem where l_returnflag = 'R' group by 1, 2), q as (select quantile_cont(p, 0.1) as q from p)
select l_linestatus, count(*) as n_variants, count(*) filter (p <= q) as n_hits, round(min(p), 10) as best_p from v left join p using (l_linestatus, l_linenumber), q group by 1""")
def _(s, d):
    li = table(s, d, "lineitem")
    vr = li.select("l_linestatus", "l_linenumber", "l_returnflag").distinct()
    p = li.where("l_returnflag = 'R'").groupBy("l_linestatus", "l_linenumber").agg((F.min("l_extendedprice") / 1e6).alias("p"))
    x = sr.variant_scores(vr, p, ["l_linestatus", "l_linenumber"], "p")
    return r_(x.groupBy("l_linestatus").agg(v.count_as("n_variants"), F.count_if("is_hit").alias("n_hits"), F.min("p").alias("best_p")), 10)
