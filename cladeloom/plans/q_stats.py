"""Statistical tests; p-values are checked against quadrature in SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from cladeloom.functions.arith import slope
from cladeloom.operators import matrix as mx, stats as sx
from cladeloom.operators.ordered import quantile_column
from cladeloom.plans import sqlstat as q, views as v
from cladeloom.plans.registry import query, table


def r_(frame, digits=6, **special):
    """Round every double column for the value comparison."""
    return frame.select(*[(v.rnd(c, special.get(c, digits)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


_CI = "tanh(atanh(r) {s} 1.959963984540054 / sqrt(n - 3))"
_RT = "(r * sqrt((n - 2) / (1 - r * r)))"


def _corr_sql(src):
    return f"""{src} select k as l_suppkey, n, round(r, 6) + 0.0 as estimate, round({_RT}, 5) + 0.0 as statistic, round({_CI.format(s='-')}, 6) + 0.0 as ci_lo,
  round({_CI.format(s='+')}, 6) + 0.0 as ci_hi, round({q.t_tail(_RT, 'n - 2')}, 6) + 0.0 as p_value from c"""


@query("pearson_test", _corr_sql("with c as (select l_suppkey as k, count(*) as n, corr(l_quantity, l_extendedprice) as r from lineitem group by 1)"))
def _(s, d):
    return r_(sx.corr_test(table(s, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_suppkey"]), statistic=5)


@query("spearman_test", _corr_sql("""with k as (select l_suppkey, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2 as a,
  rank() over (partition by l_suppkey order by l_tax) + (count(*) over (partition by l_suppkey, l_tax) - 1) / 2 as b from lineitem),
c as (select l_suppkey as k, count(*) as n, corr(a, b) as r from k group by 1)"""))
def _(s, d):
    return r_(sx.corr_test(table(s, d, "lineitem"), "l_quantity", "l_tax", ["l_suppkey"], "spearman"), statistic=5)


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", " union all ".join(f"select '{a}' as a, '{b}' as b, count(*) as n, round(corr({a}, {b}), 8) + 0.0 as r from lineitem" for i, a in enumerate(_COLS) for b in _COLS[i + 1:]))
def _(s, d):
    return r_(sx.corr_matrix(table(s, d, "lineitem").select(*_COLS), _COLS), 8)


@query("corrwith", f"""
with {v.VEC}, u as (select gene, y, unnest(v) as x, unnest(range(0, 64)) as dim from v_vec)
select gene, cast(dim as int) as dim, count(*) as n, round(corr(x, y), 6) + 0.0 as r from u group by 1, 2""")
def _(s, d):
    return r_(sx.corr_with(v.vectors(s, d), "v", "y", ["gene"]))


@query("fisher_z_compare", f"""
with c as (select l_suppkey, count(*) as n, corr(l_quantity, l_extendedprice) as r from lineitem group by 1),
g as (select count(*) as n, corr(l_quantity, l_extendedprice) as r from lineitem),
z as (select l_suppkey, (atanh(c.r) - atanh(g.r)) / sqrt(1.0e0 / (c.n - 3) + 1.0e0 / (g.n - 3)) as z from c, g)
select l_suppkey, round(z, 7) + 0.0 as z, round({q.norm_tail('z')}, 7) + 0.0 as p_value from z""")
def _(s, d):
    li = table(s, d, "lineitem")
    c = sx.corr_test(li, "l_quantity", "l_extendedprice", ["l_suppkey"]).select("l_suppkey", "n", "estimate")
    g = sx.corr_test(li, "l_quantity", "l_extendedprice").select(F.struct(F.col("estimate").alias("r"), F.col("n").alias("n"))).scalar()
    z = c.withColumn("_g", g).select("l_suppkey", sx.fisher_z(F.col("estimate"), F.col("n"), F.col("_g.r"), F.col("_g.n")).alias("z"))
    return r_(z.withColumn("p_value", sx.norm_p("z")), 7)


@query("welch_t", f"""
with m as (select l_suppkey, count(*) filter (l_linestatus = 'F') as n1, count(*) filter (l_linestatus = 'O') as n2, avg(l_tax) filter (l_linestatus = 'F') as m1,
  avg(l_tax) filter (l_linestatus = 'O') as m2, var_samp(l_tax) filter (l_linestatus = 'F') as v1, var_samp(l_tax) filter (l_linestatus = 'O') as v2 from lineitem group by 1),
t as (select *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) as t, power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) as df from m where n1 > 1 and n2 > 1)
select l_suppkey, n1, n2, round(m1 - m2, 6) + 0.0 as estimate, round(t, 6) + 0.0 as statistic, round(df, 4) + 0.0 as df, round({q.t_tail('t', 'df')}, 6) + 0.0 as p_value from t""")
def _(s, d):
    return r_(sx.welch_t(table(s, d, "lineitem"), "l_tax", F.col("l_linestatus"), "F", "O", ["l_suppkey"]), df=4)


@query("one_sample_t", f"""
with m as (select l_suppkey, count(*) as n, avg(l_quantity) - 25 as e, (avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))) as t from lineitem group by 1)
select l_suppkey, n, round(e, 8) + 0.0 as estimate, round(t, 6) + 0.0 as statistic, round({q.t_tail('t', 'n - 1')}, 6) + 0.0 as p_value from m""")
def _(s, d):
    li = table(s, d, "lineitem").select("l_suppkey", (F.col("l_quantity") - 25).alias("x"))
    return r_(sx.one_sample_t(li, "x", ["l_suppkey"]), estimate=8)


_RANKS = """with r as (select *, rank() over (partition by l_linenumber order by l_quantity) + (count(*) over (partition by l_linenumber, l_quantity) - 1) / 2 as rk,
  power(count(*) over (partition by l_linenumber, l_quantity), 2) - 1 as tie from lineitem)"""


@query("wilcoxon_rank_sum", _RANKS.replace("from lineitem", "from lineitem where l_returnflag in ('A', 'R')") + f""",
m as (select l_linenumber, count(*) filter (l_returnflag = 'A') as n1, count(*) filter (l_returnflag = 'R') as n2, sum(rk) filter (l_returnflag = 'A') as r1, sum(tie) as ties from r group by 1),
w as (select *, r1 - n1 * (n1 + 1) / 2 as w, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0e0)))) as sg from m),
z as (select *, (w - n1 * n2 / 2 - sign(w - n1 * n2 / 2) * 0.5e0) / sg as z from w)
select l_linenumber, n1, n2, w as statistic, round(w / (n1 * n2), 8) as auc, round(z, 6) + 0.0 as z, round({q.norm_tail('z')}, 6) as p_value from z""")
def _(s, d):
    return r_(sx.wilcoxon(table(s, d, "lineitem"), "l_quantity", "l_returnflag", "A", "R", ["l_linenumber"]), auc=8)


@query("kruskal_wallis", _RANKS + f""",
g as (select l_linenumber, l_returnflag, count(*) as n, sum(rk) as rs, sum(tie) as ties from r group by 1, 2),
h as (select l_linenumber, cast(sum(n) as bigint) as n, count(*) as k, (12.0e0 / (sum(n) * (sum(n) + 1)) * sum(rs * rs / n) - 3 * (sum(n) + 1)) / (1 - sum(ties) / (power(sum(n), 3) - sum(n))) as h from g group by 1)
select l_linenumber, n, k, round(h, 5) + 0.0 as statistic, round({q.chi2_tail('h', 'k - 1')}, 6) as p_value from h""")
def _(s, d):
    return r_(sx.kruskal(table(s, d, "lineitem"), "l_quantity", "l_returnflag", ["l_linenumber"]), statistic=5)


_2X2 = """with f as (select l_partkey, count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') as a, count(*) filter (l_returnflag = 'R' and l_linestatus = 'O') as b,
  count(*) filter (l_returnflag <> 'R' and l_linestatus = 'F') as c, count(*) filter (l_returnflag <> 'R' and l_linestatus = 'O') as d from lineitem group by 1)"""


def _tables(s, d):
    x, y = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    n = lambda p, o: F.count_if(p & o)
    return table(s, d, "lineitem").groupBy("l_partkey").agg(n(x, y).alias("a"), n(x, ~y).alias("b"), n(~x, y).alias("c"), n(~x, ~y).alias("d"))


@query("fisher_exact_2x2", _2X2 + f" select l_partkey, a, b, c, d, round({q.fisher_tail('a', 'b', 'c', 'd')}, 6) as p_value from f")
def _(s, d):
    return r_(sx.fisher_exact(_tables(s, d), "a", "b", "c", "d").drop("odds_ratio"))


_CHI = """with n as (select l_suppkey, l_returnflag, l_linenumber, count(*)::double as o from lineitem group by 1, 2, 3),
e as (select *, sum(o) over (partition by l_suppkey, l_returnflag) as rt, sum(o) over (partition by l_suppkey, l_linenumber) as ct, sum(o) over (partition by l_suppkey) as t from n),
g as (select l_suppkey, count(distinct l_returnflag) as nr, count(distinct l_linenumber) as nc, max(t) as t, sum(o * o / (rt * ct)) as q from e group by 1),
c as (select l_suppkey, cast(t as bigint) as n, (nr - 1) * (nc - 1) as df, least(nr, nc) as k, t * (q - 1) as x from g)"""


@query("chi_square", _CHI + f" select l_suppkey, n, df, round(x, 6) + 0.0 as statistic, round({q.chi2_tail('x', 'df')}, 6) as p_value, round(sqrt(x / (n * (k - 1))), 6) as cramers_v from c")
def _(s, d):
    n = table(s, d, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linenumber").agg(v.count_as("o"))
    return r_(sx.chi_square(n, "l_returnflag", "l_linenumber", "o", ["l_suppkey"]))


@query("chi_square_gof", f"""
with c as (select l_linenumber, count(*) as o from lineitem group by 1), t as (select sum(o)::double as t from c),
g as (select sum(power(o - t / 7, 2) / (t / 7)) as x, count(*) - 1 as df, cast(sum(o) as bigint) as n from c, t)
select round(x, 6) as statistic, df, n, round({q.chi2_tail('x', 'df')}, 6) as p_value from g""")
def _(s, d):
    return r_(sx.chi_square_gof(table(s, d, "lineitem").groupBy("l_linenumber").agg(v.count_as("o")), "o", F.lit(1 / 7)))


@query("binomial_test", f"""
with c as (select l_suppkey, count(*) as n, count(*) filter (l_linestatus = 'F') as k from lineitem group by 1)
select l_suppkey, n, k, round({q.binom_tail('k', 'n')}, 6) as p_value from c""")
def _(s, d):
    c = table(s, d, "lineitem").groupBy("l_suppkey").agg(v.count_as(), F.count_if(F.col("l_linestatus") == "F").alias("k"))
    return r_(sx.binomial_test(c, "k", "n"))


_AOV = """g as (select {by}, {grp} as g, count(*) as n, avg({x}) as m, var_pop({x}) as vp from {src} group by 1, 2),
t as (select {by}, sum(n) as n, sum(n * m) / sum(n) as gm, count(*) as k from g group by 1),
f as (select {by}, max(t.n) as n, max(k) as k, sum(g.n * power(m - gm, 2)) as ssb, sum(g.n * vp) as ssw from g join t using ({by}) group by 1),
a as (select *, (ssb / (k - 1)) / (ssw / (n - k)) as f from f)"""


@query("anova_oneway", "with " + _AOV.format(by="l_suppkey", grp="l_returnflag", x="l_quantity", src="lineitem") + f"""
select l_suppkey, cast(n as bigint) as n, k, round(ssb, 4) as ssb, round(ssw, 3) as ssw, round(f, 6) + 0.0 as statistic, round(ssb / (ssb + ssw), 8) as r2,
  round({q.f_tail('f', 'k - 1', 'n - k')}, 6) as p_value from a""")
def _(s, d):
    return r_(sx.anova_oneway(table(s, d, "lineitem"), "l_quantity", "l_returnflag", ["l_suppkey"]), ssb=4, ssw=3, r2=8)


# two levels in the second factor: its effect beyond the first is one regression of what the first leaves
@query("anova_twoway", f"""
with t as (select l_linenumber as g, l_returnflag as a, (l_linestatus = 'F')::int::double as b, l_quantity::double as x from lineitem),
m as (select *, avg(x) over (partition by g) as gx, avg(x) over (partition by g, a) as ax, avg(b) over (partition by g, a) as ab, avg(b) over (partition by g) as gb, avg(x) over (partition by g, b) as bx, avg(x) over (partition by g, a, b) as cx from t),
s as (select g, count(*) as n, count(distinct a) as na, count(distinct b) as nb, count(distinct (a, b)) as nc, sum((ax - gx) * (ax - gx)) as ssa, sum((bx - gx) * (bx - gx)) as only_b,
  sum((b - ab) * (x - ax)) as sxy, sum((b - ab) * (b - ab)) as sbb, sum((cx - gx) * (cx - gx)) as cells, sum((x - cx) * (x - cx)) as ssw from m group by 1),
u as (select *, case when sbb > 1e-9 then sxy * sxy / sbb else 0 end as ssb, case when sbb > 1e-9 then 1 else 0 end as dfb from s),
w as (select *, nc - na - dfb as dfi, n - nc as dfr from u),
r as (select g, 'l_returnflag' as term, na - 1 as df, ssa as ss, ssa + ssb - only_b as part, dfr, ssw from w union all select g, 'l_linestatus', dfb, ssb, ssb, dfr, ssw from w
  union all select g, 'l_returnflag:l_linestatus', dfi, case when dfi > 0 then cells - ssa - ssb else 0 end, case when dfi > 0 then cells - ssa - ssb else 0 end, dfr, ssw from w
  union all select g, 'residuals', dfr, ssw, ssw, null, null from w),
f as (select *, case when df > 0 then ss / df / (ssw / dfr) end as f, case when df > 0 then part / df / (ssw / dfr) end as fp from r)
select g as l_linenumber, term, df::bigint as df, round(ss, 2) + 0.0 as ss, round(part, 2) + 0.0 as ss_partial, case when df > 0 then round(ss / df, 3) + 0.0 end as ms, round(f, 5) + 0.0 as statistic,
  round(case when f is not null then {q.f_tail('f', 'df', 'dfr')} end, 5) as p_value, round(case when fp is not null then {q.f_tail('fp', 'df', 'dfr')} end, 5) as p_partial from f""")
def _(s, d):
    return r_(sx.anova_twoway(table(s, d, "lineitem"), "l_quantity", "l_returnflag", "l_linestatus", ["l_linenumber"]), 5, ss=2, ss_partial=2, ms=3)


@query("cramers_v", f"""
with {v.SITES}, p as (select x.gene, x.pos as pos_a, y.pos as pos_b, x.allele as a, y.allele as b, count(*)::double as o from v_sites x join v_sites y on x.id = y.id and x.gene = y.gene and x.pos < y.pos
  where x.allele <> '-' and y.allele <> '-' group by all),
e as (select *, sum(o) over (partition by gene, pos_a, pos_b, a) as rt, sum(o) over (partition by gene, pos_a, pos_b, b) as ct, sum(o) over (partition by gene, pos_a, pos_b) as t from p),
g as (select gene, pos_a, pos_b, max(t) as t, count(distinct a) as nr, count(distinct b) as nc, sum(o * o / (rt * ct)) as q from e group by 1, 2, 3)
select gene, pos_a, pos_b, cast(t as bigint) as n, round(sqrt(t * (q - 1) / (t * (least(nr, nc) - 1))), 6) as v from g where t >= 100""")
def _(s, d):
    return r_(mx.cramers_v_panel(v.sites(s, d), min_n=100))


@query("enrichment_ratio", """
with c as (select l_linenumber, count(*) filter (l_returnflag = 'R') as h, count(*) as b from lineitem group by 1)
select l_linenumber, h, b, round(h / sum(h) over (), 8) as observed, round(b / sum(b) over (), 8) as expected, round((h / sum(h) over ()) / (b / sum(b) over ()), 6) as fold from c""")
def _(s, d):
    c = table(s, d, "lineitem").groupBy("l_linenumber").agg(F.count_if(F.col("l_returnflag") == "R").alias("h"), v.count_as("b"))
    return r_(sx.enrichment(c, "l_linenumber", "h", "b"), observed=8, expected=8)


@query("log_odds_pseudo", """
with c as (select l_linenumber, l_returnflag, count(*) filter (l_linestatus = 'F') as a, count(*) filter (l_linestatus = 'O') as b from lineitem group by 1, 2)
select l_linenumber, l_returnflag, a, b, round(log2(((a + 0.5e0) / (sum(a) over () + 0.5e0 * 21)) / ((b + 0.5e0) / (sum(b) over () + 0.5e0 * 21))), 6) + 0.0 as log_odds,
  cast(sum(a) over () - a as bigint) as rest_a, cast(sum(b) over () - b as bigint) as rest_b from c""")
def _(s, d):
    c = table(s, d, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("a"), F.count_if(F.col("l_linestatus") == "O").alias("b"))
    return r_(sx.log_odds(c, ["l_linenumber", "l_returnflag"], "a", "b", 21))


@query("p_adjust", """
with r as (select o_orderkey, o_totalprice / 1e6 as p, rank() over (order by o_totalprice) + count(*) over (partition by o_totalprice) - 1 as rk, count(*) over () as n from orders)
select o_orderkey, n as n_tests, round(least(1, min(p * n / rk) over (order by p desc rows between unbounded preceding and current row)), 8) as p_bh,
  round(least(1, p * n), 8) as p_bonferroni, round(0.05 / n, 12)::double as threshold from r""")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1e6).alias("p"))
    return r_(sx.p_adjust(o, "p").drop("p"), 8, threshold=12)


@query("genomic_inflation", f"""
with p as (select o_orderpriority, o_totalprice / 1e6 as p, row_number() over (partition by o_orderpriority order by o_totalprice) as i, count(*) over (partition by o_orderpriority) as n from orders),
m as (select o_orderpriority, n, p from p where i in ((n - 1) // 2 + 1, n // 2 + 1)), z as (select o_orderpriority, n, {q.norm_quantile('p / 2')} as z from m)
select o_orderpriority, max(n) as n, round(avg(z * z) / 0.4549364231195724, 5) as lambda from z group by 1""")
def _(s, d):
    o = table(s, d, "orders").select("o_orderpriority", (F.col("o_totalprice") / 1e6).alias("p"))
    return r_(sx.genomic_inflation(o, "p", ["o_orderpriority"]), 5)


@query("concordance", f"""
with e as (select l_linenumber, l_quantity - 25 as dx, l_tax - 0.04 as dy from lineitem), sd as (select stddev_samp(dx) as sd from e),
c as (select l_linenumber, count(*) as n, count(*) filter (sign(dx) = sign(dy)) as k from e, sd where abs(dx) > 0.5 * sd and dy <> 0 group by 1)
select l_linenumber, n, k as n_concordant, round(k / n, 8) as share, round(k / n - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n), 6) as ci_lo,
  round(k / n + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n), 6) as ci_hi, round({q.binom_tail('k', 'n')}, 6) as p_value from c""")
def _(s, d):
    e = table(s, d, "lineitem").select("l_linenumber", (F.col("l_quantity") - 25).alias("dx"), (F.col("l_tax") - 0.04).alias("dy"))
    return r_(sx.concordance(e, "dx", "dy", ["l_linenumber"]), share=8)


@query("roc_auc", """
with t as (select quality as y, ((n_chars % 97) / 97.0e0 + quality * 0.1e0) / 1.2e0 as s from labels join documents using (doc_id)),
r as (select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 as rk from t)
select count(*) as n, count(*) filter (s >= 0.5 and y = 1) as tp, count(*) filter (s >= 0.5 and y = 0) as fp, count(*) filter (s < 0.5 and y = 1) as fn, count(*) filter (s < 0.5 and y = 0) as tn,
  round(sqrt(avg((s - y) * (s - y))), 6) as rmse, round(avg(abs(s - y)), 6) as mae, round((count(*) filter ((s >= 0.5) = (y = 1))) / count(*), 8) as accuracy,
  round((sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2) / (count(*) filter (y = 1) * count(*) filter (y = 0)), 8) as auc from r""")
def _(s, d):
    t = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    t = t.select(F.col("quality").alias("y"), (((F.col("n_chars") % 97) / 97.0 + F.col("quality") * 0.1) / 1.2).alias("s"))
    return r_(sx.classifier_metrics(t, "s", "y"), accuracy=8, auc=8)


@query("permutation_test", f"""
with b as (select o_orderkey, o_totalprice as x, (o_orderstatus = 'F')::int as l from orders), t as (select sum(l) as k, count(*) as n, sum(x) as s, sum(x * l) as t from b),
p as (select perm, x, row_number() over (partition by perm order by {q.draw('o_orderkey', 'perm')}, o_orderkey) as i from b, range(1, 100) r(perm)),
d as (select perm, sum(x) as u from p, t where i <= k group by perm), e as (select u / k - (s - u) / (n - k) as d, t / k - (s - t) / (n - k) as obs from d, t)
select round(max(obs), 4) as observed, round(avg(d), 4) as null_mean, round(stddev_samp(d), 4) as null_sd, count(*) as n_perm, round((count(*) filter (abs(d) >= abs(obs)) + 1) / (count(*) + 1), 4) as p_value from e""")
def _(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return r_(sx.permutation_test(o, ["o_orderkey"], "o_totalprice", F.col("o_orderstatus") == "F", 99), 4)


@query("delta_signal", """
with t as (select l_quantity / 51 as a, l_discount as b, l_tax as maf from lineitem where l_discount > 0)
select case when maf < 0.02 then 'low' when maf < 0.05 then 'mid' else 'high' end as maf_bin, count(*) as n, round(avg(-log10(a) + log10(b)), 6) as mean_delta,
  round(regr_slope(-log10(a) + log10(b), maf), 5) as slope from t group by 1""")
def _(s, d):
    t = table(s, d, "lineitem").select((F.col("l_quantity") / 51).alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("maf"))
    x = sx.delta_signal(t, "a", "b")
    b = F.when(F.col("maf") < 0.02, "low").when(F.col("maf") < 0.05, "mid").otherwise("high")
    return x.groupBy(b.alias("maf_bin")).agg(v.count_as(), v.rnd(F.avg("delta")).alias("mean_delta"), v.rnd(slope(F.col("delta"), F.col("maf")), 5).alias("slope"))


@query("likelihood_ratio", f"""
with t as (select l_suppkey, -sum(ln(l_quantity)) - 4 as l0, -sum(ln(l_quantity)) as l1, count(distinct l_linenumber) as df from lineitem group by 1),
x as (select l_suppkey, 2 * (l1 - l0) as x, df from t) select l_suppkey, df, round(x, 4) as statistic, round({q.chi2_tail('x', 'df')}, 5) as p_value from x""")
def _(s, d):
    t = table(s, d, "lineitem").groupBy("l_suppkey").agg((-F.sum(F.log("l_quantity")) - 4).alias("l0"), (-F.sum(F.log("l_quantity"))).alias("l1"), F.count_distinct("l_linenumber").alias("df"))
    return r_(sx.likelihood_ratio(t, "l0", "l1", "df").select("l_suppkey", "df", "statistic", "p_value"), statistic=4, p_value=5)


@query("coefficient_stability", f"""
with {v.VEC}, u as (select gene, y, unnest(v) as x, unnest(range(0, 64)) as dim from v_vec), c as (select gene, dim, corr(x, y) as r from u group by 1, 2)
select cast(dim as int) as dim, count(*) as n_groups, round(avg(r), 6) + 0.0 as mean_r, round(stddev_samp(r), 6) as sd_r, round(stddev_samp(r) / abs(avg(r)), 3) as cv_r from c group by 1""")
def _(s, d):
    c = sx.corr_with(v.vectors(s, d), "v", "y", ["gene"])
    return r_(sx.coefficient_stability(c, ["dim"], "r"), cv_r=3)
