"""Alignment columns: diversity, indices and encodings."""
from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.functions import scales as sc
from cladeloom.operators import sites as si
from cladeloom.plans import views as v
from cladeloom.plans.registry import query, table

_CNT = f"with {v.SITES}, c as (select gene, pos, allele, count(*) as n from v_sites where allele <> '-' group by 1, 2, 3)"
_FIRST = ", m as (select gene, pos, allele as major from (select *, row_number() over (partition by gene, pos order by n desc, allele) as rn from c) where rn = 1)"


@query("consensus_state", f"""
with {v.SITES}, c as (select gene, pos, allele, count(*) as n from v_sites group by 1, 2, 3),
t as (select *, n / sum(n) over (partition by gene, pos) as p, row_number() over (partition by gene, pos order by n desc, allele) as rn from c)
select gene, pos, max(allele) filter (rn = 1) as consensus, round(max(p) filter (rn = 1), 8) as consensus_freq, cast(sum(n) as bigint) as n,
  count(*) as n_states, round(sum(-p * log2(p)), 8) as entropy from t group by 1, 2""")
def _(s, d):
    c = si.consensus_state(v.sites(s, d), ["gene", "pos"], "allele")
    return c.withColumns({"consensus_freq": v.rnd("consensus_freq", 8), "entropy": v.rnd("entropy", 8)})


@query("site_diversity", f"""
with {v.SITES}, c as (select gene, pos, allele, count(*) as n from v_sites group by 1, 2, 3),
g as (select gene, pos, sum(n) as al, sum(n) filter (allele <> '-') as n, count(*) filter (allele <> '-') as k, sum(n * n) filter (allele <> '-') as sq,
  list(n order by n desc) filter (allele <> '-') as top from c group by 1, 2),
h as (select *, list_sum(list_transform(range(1, n::bigint), lambda i: 1.0::double / i)) as a1 from g)
select gene, pos, cast(n as bigint) as n, round(1 - sq / (n * n), 8) as pi, round((k - 1) / a1, 8) as theta_w, round(1 - sq / (n * n) - (k - 1) / a1, 8) as tajima,
  round(coalesce(top[2], 0) / n, 8) as maf, round((n * n) / sq, 6) as n_eff, round((al - n) / al, 8) as gap_freq from h""")
def _(s, d):
    g = si.site_diversity(v.sites(s, d))
    return g.select("gene", "pos", "n", *[v.rnd(c, 6 if c == "n_eff" else 8).alias(c) for c in ("pi", "theta_w", "tajima", "maf", "n_eff", "gap_freq")])


@query("maf_nalleles_entropy", _CNT + """,
g as (select gene, pos, sum(n) as n, count(*) as k, list(n order by n desc) as top from c group by 1, 2)
select gene, pos, cast(n as bigint) as n, k as n_alleles, round(case when coalesce(top[2], 0) >= 3000 then top[2] / n else 0 end, 8) as maf,
  round(list_sum(list_transform(top, lambda x: -(x / n) * ln(x / n))), 8) as entropy,
  round(case when k > 1 then list_sum(list_transform(top, lambda x: (x / n - 1 / k) * (x / n - 1 / k))) / (k - 1) end, 8) as freq_var from g""")
def _(s, d):
    g = si.maf_alleles_entropy(v.sites(s, d), 3000)
    return g.select("gene", "pos", "n", "n_alleles", *[v.rnd(c, 8).alias(c) for c in ("maf", "entropy", "freq_var")])


@query("polymorphic_sites", f"""
with {v.SITES}, k as (select gene, pos, count(distinct allele) filter (allele <> '-') as k from v_sites group by 1, 2)
select gene, count(*) filter (k > 1) as n_polymorphic, count(*) as length, round(count(*) filter (k > 1) / count(*), 8) as rate from k group by 1""")
def _(s, d):
    return si.polymorphic_sites(v.sites(s, d)).withColumn("rate", v.rnd("rate", 8))


@query("alleles_per_site", _CNT + " select gene, pos, count(*) as n_alleles, string_agg(allele, ',' order by allele) as alleles from c group by 1, 2")
def _(s, d):
    return si.alleles_per_site(v.sites(s, d))


@query("gap_counts", f"""
with {v.SITES} select 'site' as level, gene || ':' || pos as key, count(*) filter (allele = '-') as n_gaps, round(count(*) filter (allele = '-') / count(*), 8) as gap_fraction from v_sites group by 2
union all select 'row', gene || ':' || id, count(*) filter (allele = '-'), round(count(*) filter (allele = '-') / count(*), 8) from v_sites group by 2""")
def _(s, d):
    x = v.sites(s, d)
    a, b = si.gap_counts(x, ["gene", "pos"]), si.gap_counts(x, ["gene", "id"])
    f = lambda df, lvl, k: df.select(F.lit(lvl).alias("level"), F.concat_ws(":", "gene", F.col(k).cast("string")).alias("key"), "n_gaps", v.rnd("gap_fraction", 8).alias("gap_fraction"))
    return f(a, "site", "pos").union(f(b, "row", "id"))


@query("ungapped_index", f"""
with {v.SITES} select gene, id, pos, case when allele <> '-' then cast(sum((allele <> '-')::int) over (partition by gene, id order by pos) as bigint) end as residue_no from v_sites""")
def _(s, d):
    return si.ungapped_index(v.sites(s, d)).select("gene", "id", "pos", "residue_no")


@query("consensus_ungapped_index", _CNT.replace("where allele <> '-'", "") + """,
t as (select *, row_number() over (partition by gene, pos order by n desc, allele) as rn, n / sum(n) over (partition by gene, pos) as f from c)
select gene, pos, allele as consensus, round(f, 8) as consensus_freq, case when allele <> '-' then cast(sum((allele <> '-')::int) over (partition by gene order by pos) as bigint) end as residue_no from t where rn = 1""")
def _(s, d):
    return si.consensus_ungapped_index(v.sites(s, d)).select("gene", "pos", F.col("allele").alias("consensus"), v.rnd("consensus_freq", 8).alias("consensus_freq"), "residue_no")


@query("global_position", f"""
with {v.SITES}, k as (select distinct gene, pos from v_sites)
select gene, pos, row_number() over (partition by gene order by pos) as gene_pos, row_number() over (order by gene, pos) as global_pos from k""")
def _(s, d):
    return si.global_position(v.sites(s, d))


@query("explode_sites", f"""
with {v.SEQ}, e as (select gene, id, unnest(string_split(regexp_replace(seq, '[^{sc.AMINO_ACIDS}]', '-', 'g'), '')) as allele, unnest(range(1, length(seq) + 1)) as pos from v_seq where length(seq) > 0)
select gene, allele, count(*) as n, cast(sum(pos) as bigint) as pos_sum, max(pos) as last_pos, count(distinct id) as n_ids from e group by 1, 2""")
def _(s, d):
    e = si.explode_sites(v.seqs(s, d), "id", "gene", "seq")
    per = e.groupBy("gene", "allele", "id").agg(v.count_as(), F.sum("pos").alias("s"), F.max("pos").alias("m"))
    return per.groupBy("gene", "allele").agg(F.sum("n").alias("n"), F.sum("s").alias("pos_sum"), F.max("m").cast("bigint").alias("last_pos"), F.count("*").alias("n_ids"))


@query("major_minor", _CNT + _FIRST + """
select gene, pos, id, case when allele = '-' then null when allele = major then 0.0::double else 1.0::double end as x from v_sites left join m using (gene, pos)""")
def _(s, d):
    return si.major_minor(v.sites(s, d))


@query("onehot_alleles", f"""
with {v.SITES} select gene, pos, id, case when allele <> '-' then (allele = 'A')::int end as is_A, case when allele <> '-' then (allele = 'N')::int end as is_N,
  case when allele <> '-' then (allele = 'R')::int end as is_R from v_sites""")
def _(s, d):
    return si.onehot_alleles(v.sites(s, d), ["A", "N", "R"])


_K3 = ", ".join(f"round(avg(case allele {' '.join(f'when {chr(39)}{a}{chr(39)} then {sc.KIDERA[a][i]}e0' for a in 'ANR')} end), 6) as kf{i + 1}" for i in range(3))


@query("aa_to_vector", f"with {v.SITES} select gene, pos, {_K3} from v_sites group by 1, 2")
def _(s, d):
    x = si.aa_to_vector(v.sites(s, d), sc.KIDERA)
    return x.groupBy("gene", "pos").agg(*[v.rnd(F.avg(F.col("vec")[i])).alias(f"kf{i + 1}") for i in range(3)])


@query("supermatrix", f"""
with {v.SITES}, k as (select gene, pos, row_number() over (order by gene, pos) as g from (select distinct gene, pos from v_sites)),
f as (select i.id, k.g, coalesce(allele, '-') as a from (select distinct id from v_sites) i cross join k left join v_sites s on s.id = i.id and s.gene = k.gene and s.pos = k.pos)
select id, string_agg(a, '' order by g) as seq from f group by 1""")
def _(s, d):
    return si.supermatrix(v.sites(s, d))


_IMP = """with t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, case when l_discount = 0 then null else l_quantity end as x from lineitem)"""


def _holes(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("x"))


@query("impute", _IMP + """, m as (select l_suppkey, median(x) as m from t where l_linestatus = 'F' group by 1)
select l_orderkey, l_linenumber, l_partkey, round(coalesce(x, m), 6) as x from t left join m using (l_suppkey)""")
def _(s, d):
    r = si.impute(_holes(s, d), ["l_suppkey"], "x", "median", F.col("l_linestatus") == "F")
    return r.select("l_orderkey", "l_linenumber", "l_partkey", v.rnd("x").alias("x"))


@query("impute_random", _IMP + """, pool as (select l_suppkey, x as fill, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) as i, count(*) over (partition by l_suppkey) as n from t where x is not null),
k as (select *, ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, 42)), 1, 13))::bigint as h from t), c as (select distinct l_suppkey, n from pool)
select k.* exclude (h, x), coalesce(x, fill) as x from k left join c using (l_suppkey) left join pool on x is null and pool.l_suppkey = k.l_suppkey and pool.i = h % c.n + 1""")
def _(s, d):
    return si.impute(_holes(s, d), ["l_suppkey"], "x", "random", key=["l_orderkey", "l_linenumber", "l_partkey"])


@query("standardize", f"""
with {v.VEC}, u as (select id, unnest(v) as x, unnest(range(0, 64)) as dim from v_vec)
select id, dim, round((x - avg(x) over (partition by dim)) / stddev_samp(x) over (partition by dim), 5) + 0.0 as z from u""")
def _(s, d):
    u = v.vectors(s, d).select("id", F.posexplode("v").alias("dim", "x"))
    return si.standardize(u, ["dim"], "x").select("id", F.col("dim").cast("bigint").alias("dim"), (v.rnd("z", 5) + 0.0).alias("z"))


_V10 = " + ".join(f"var_pop(case allele {' '.join(f'when {chr(39)}{a}{chr(39)} then {sc.KIDERA[a][i]}e0' for a in 'ANR')} end)" for i in range(10))


@query("position_variance_filter", f"with {v.SITES} select gene, pos, round({_V10}, 6) as var_sum from v_sites group by 1, 2 having {_V10} >= 0.1")
def _(s, d):
    return si.position_variance_filter(v.sites(s, d), sc.KIDERA).withColumn("var_sum", v.rnd("var_sum"))


@query("label_encode", "select p_partkey, p_brand, dense_rank() over (order by p_brand) - 1 as code from part")
def _(s, d):
    return si.label_encode(table(s, d, "part").select("p_partkey", "p_brand"), "p_brand", "code")


@query("variance_quick_stats", """
with n as (select count(distinct l_suppkey) as n from lineitem), p as (select l_partkey, count(distinct l_suppkey) / any_value(n) as share from lineitem, n group by 1)
select round(avg(share), 8) as mean_presence, count(*) as n_genes, count(*) filter (share > 0.25) as above_25, count(*) filter (share > 0.3) as above_30 from p""")
def _(s, d):
    return si.presence_stats(table(s, d, "lineitem"), "l_partkey", "l_suppkey", (0.25, 0.3)).withColumn("mean_presence", v.rnd("mean_presence", 8))


@query("relative_position_matrix", """
with f as (select p_brand, p_type, (p_size * 10 + p_size * 10 + 50) / 2 / (600 + p_partkey % 7) as rel, case when p_partkey % 2 = 0 then 1 else -1 end as strand from part)
select p_brand, round(avg(rel) filter (p_type = 'ECONOMY'), 8) as economy, round(avg(rel) filter (p_type = 'STANDARD'), 8) as standard,
  cast(sum(strand) filter (p_type = 'ECONOMY') as bigint) as strand_economy, count(*) filter (p_type not in ('ECONOMY', 'STANDARD')) as n_other from f group by 1""")
def _(s, d):
    p = table(s, d, "part").select("p_brand", "p_type", (F.col("p_size") * 10).alias("start"), (F.col("p_size") * 10 + 50).alias("end"),
                                   (600 + F.col("p_partkey") % 7).alias("size"), F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1).alias("strand"))
    p = p.withColumn("rel", si.relative_position(p, "start", "end", "size"))
    is_ = lambda t: F.col("p_type") == t
    return p.groupBy("p_brand").agg(v.rnd(F.avg(F.when(is_("ECONOMY"), F.col("rel"))), 8).alias("economy"), v.rnd(F.avg(F.when(is_("STANDARD"), F.col("rel"))), 8).alias("standard"),
                                    F.sum(F.when(is_("ECONOMY"), F.col("strand"))).alias("strand_economy"), F.count_if(~F.col("p_type").isin("ECONOMY", "STANDARD")).alias("n_other"))


@query("column_null_filter", """
with t as (select event_id, case when user_id % 20 = 0 then null else value end as a, case when event_type = 'error' then null else value end as b, cast(user_id as double) as c from events)
select event_id, 'a' as variable, round(coalesce(a, (select median(a) from t)), 6) as value from t
union all select event_id, 'c', round(c, 6) from t""")
def _(s, d):
    e = table(s, d, "events").select("event_id", F.when(F.col("user_id") % 20 != 0, F.col("value")).alias("a"),
                                     F.when(F.col("event_type") != "error", F.col("value")).alias("b"), F.col("user_id").alias("c"))
    return si.column_null_filter(e, "event_id", ["a", "b", "c"]).withColumn("value", v.rnd("value"))
