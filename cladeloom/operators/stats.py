"""Statistical tests: statistics are Spark aggregations, tail probabilities run on the result rows."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cladeloom.functions import special as sp
from cladeloom.functions.arith import corr, digest, draw, ratio
from cladeloom.operators.gram import centred, gram, unpack
from cladeloom.operators.ordered import join_same, quantiles, row_index, suffix_min, value_ranks, with_avg_rank
from cladeloom.session import materialize


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(lambda a, b: sp.t_sf2(a, b), t, df)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _masked(lambda a, b, c: sp.f_sf(a, b, c), f, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(lambda a, b: sp.chi2_sf(a, b), x, df)


@F.pandas_udf(T.DoubleType())
def norm_p(z: pd.Series) -> pd.Series:
    return _masked(lambda a: sp.norm_sf2(a), z)


@F.pandas_udf(T.DoubleType())
def binom_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(sp.binom_tests(k, n, p))


@F.pandas_udf(T.StructType([T.StructField("odds_ratio", T.DoubleType()), T.StructField("p_value", T.DoubleType())]))
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
    ratio_, p = sp.fisher_tables(a, b, c, d)
    return pd.DataFrame({"odds_ratio": ratio_, "p_value": p})


def _masked(fn, *cols: pd.Series) -> pd.Series:
    arrs = [c.to_numpy(dtype=float, na_value=np.nan) for c in cols]
    ok = ~np.any([np.isnan(a) for a in arrs], axis=0)
    out = np.full(len(arrs[0]), np.nan)
    if ok.any():
        out[ok] = fn(*[a[ok] for a in arrs])
    s = pd.Series(out, dtype=object)
    s[np.isnan(out)] = None
    return s


def _corr_columns(r: Column, n: Column) -> list[Column]:
    t = r * F.sqrt(ratio(n - 2, 1 - r * r))
    z, h = F.atanh(r), ratio(1.959963984540054, F.sqrt(n - 3))
    return [t.alias("statistic"), F.when(n > 3, F.tanh(z - h)).alias("ci_lo"), F.when(n > 3, F.tanh(z + h)).alias("ci_hi")]


def corr_test(df: DataFrame, x: str, y: str, by: Sequence[str] = (), method: str = "pearson", min_n: int = 3) -> DataFrame:
    """Pearson or Spearman correlation per group with t, p and Fisher-z interval."""
    d = df.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    if method == "spearman":
        # copies of an (x, y) point are one weighted row through both rank joins
        d = d.groupBy(*by, "_x", "_y").agg(F.count("*").alias("_w"))
        for c in ("_x", "_y"):
            rk = value_ranks(d, c, by, F.col("_w")).select(*by, c, F.col("avg_rank").alias(f"{c}r"))
            d = join_same(d, rk, [*by, c])
        d = d.select(*by, F.col("_xr").alias("_x"), F.col("_yr").alias("_y"), "_w")
    else:
        d = d.withColumn("_w", F.lit(1))
    m = d.groupBy(*by).agg(F.sum("_w").alias("n"), (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("mx"),
                           (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("my"),
                           F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_w") * F.col("_y") * F.col("_y")).alias("yy"),
                           F.sum(F.col("_w") * F.col("_x") * F.col("_y")).alias("xy"))
    if method == "spearman":
        n = F.col("n")
        sxx, syy = F.col("xx") - n * F.col("mx") ** 2, F.col("yy") - n * F.col("my") ** 2
        m = m.select(*by, "n", F.when((sxx > 0) & (syy > 0), (F.col("xy") - n * F.col("mx") * F.col("my")) / F.sqrt(sxx * syy)).alias("estimate"))
    else:
        m = d.groupBy(*by).agg(F.count("*").alias("n"), corr(F.col("_x"), F.col("_y")).alias("estimate"))
        m = m.withColumn("estimate", F.when(~F.isnan("estimate"), F.col("estimate")))
    m = m.where(F.col("n") >= min_n).select(*by, "n", "estimate", *_corr_columns(F.col("estimate"), F.col("n")))
    return m.withColumn("p_value", t_p("statistic", F.col("n") - 2))


def _long_corr(g, names):
    n, _, s = centred(unpack(np.asarray(g)))
    sd = np.sqrt(np.diag(s))
    with np.errstate(all="ignore"):
        return s / np.outer(sd, sd)


def corr_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """All pairwise correlations (a < b by position) over complete rows, from one cross-product sum."""
    d = df.dropna(subset=list(cols))
    g = gram(d, F.array(*[F.col(c).cast("double") for c in cols]), by)
    names, by_list = list(cols), list(by)
    types = dict(df.dtypes)

    def run(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                r = _long_corr(row["_gram"], names)
                for i in range(len(names)):
                    for j in range(i + 1, len(names)):
                        out.append((*[row[c] for c in by_list], names[i], names[j], row["n"], r[i, j]))
            yield pd.DataFrame(out, columns=[*by_list, "a", "b", "n", "r"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "a string, b string, n bigint, r double"])
    return g.mapInPandas(run, schema)


def corr_with(df: DataFrame, vec: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of every vector dimension with y, per group."""
    g = gram(df, F.concat(F.col(vec), F.array(F.col(y).cast("double"))), by)
    by_list = list(by)
    types = dict(df.dtypes)

    def run(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                r = _long_corr(row["_gram"], None)[-1, :-1]
                out += [(*[row[c] for c in by_list], i, row["n"], None if np.isnan(x) else x) for i, x in enumerate(r)]
            yield pd.DataFrame(out, columns=[*by_list, "dim", "n", "r"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "dim int, n bigint, r double"])
    return g.mapInPandas(run, schema)


def fisher_z(r1: Column, n1: Column, r2: Column, n2: Column) -> Column:
    return ratio(F.atanh(r1) - F.atanh(r2), F.sqrt(ratio(1, n1 - 3) + ratio(1, n2 - 3)))


def welch_t(df: DataFrame, x: str, group: Column, a, b, by: Sequence[str] = ()) -> DataFrame:
    """Unequal-variance two-sample t between groups a and b."""
    g = df.withColumn("_g", group)
    one = lambda lab, f: f(F.when(F.col("_g") == lab, F.col(x)))
    m = g.groupBy(*by).agg(*[one(lab, f).alias(f"{n}{s}") for lab, s in ((a, 1), (b, 2)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    q1, q2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    m = m.where((F.col("n1") > 1) & (F.col("n2") > 1))
    m = m.select(*by, "n1", "n2", (F.col("m1") - F.col("m2")).alias("estimate"), ratio(F.col("m1") - F.col("m2"), F.sqrt(q1 + q2)).alias("statistic"),
                 ratio((q1 + q2) * (q1 + q2), q1 * q1 / (F.col("n1") - 1) + q2 * q2 / (F.col("n2") - 1)).alias("df"))
    return m.withColumn("p_value", t_p("statistic", "df"))


def one_sample_t(df: DataFrame, x: str, by: Sequence[str] = (), mu: float = 0.0) -> DataFrame:
    m = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("estimate"), F.stddev_samp(x).alias("_s"))
    m = m.where("n > 1").withColumn("statistic", ratio(F.col("estimate") - mu, F.col("_s") / F.sqrt("n"))).drop("_s")
    return m.withColumn("p_value", t_p("statistic", F.col("n") - 1))


def rank_sums(df: DataFrame, x: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Per (by, group): n and rank sum; plus the group total and tie term of `by`.

    Only distinct values with counts are ranked.
    """
    d = df.where(F.col(x).isNotNull() & F.col(group).isNotNull())
    ranks = value_ranks(d, x, by)
    per = d.groupBy(*by, x, group).agg(F.count("*").alias("_k"))
    t = F.col("n").cast("double")
    tie = ranks.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(t * t * t - t).alias("ties"))
    rs = (join_same(per, ranks.select(*by, x, "avg_rank"), [*by, x]).groupBy(*by, group)
          .agg(F.sum("_k").alias("n"), F.sum(F.col("_k") * F.col("avg_rank")).alias("rank_sum")))
    return join_same(rs, tie, list(by)) if by else rs.withColumns({
        "total": tie.select("total").scalar(), "ties": tie.select("ties").scalar()})


def wilcoxon(df: DataFrame, x: str, group: str, a, b, by: Sequence[str] = ()) -> DataFrame:
    """Two-group rank-sum test: W, AUC, tie- and continuity-corrected normal p."""
    two = df.where(F.col(group).isin(a, b))
    r = rank_sums(two, x, group, by)
    pick = lambda lab, c: F.max(F.when(F.col(group) == lab, F.col(c)))
    m = r.groupBy(*by).agg(pick(a, "n").alias("n1"), pick(b, "n").alias("n2"), pick(a, "rank_sum").alias("_r"), F.max("total").alias("_t"), F.max("ties").alias("_ties"))
    n1, n2, t = F.col("n1"), F.col("n2"), F.col("_t")
    m = m.where((n1 > 0) & (n2 > 0)).withColumn("statistic", F.col("_r") - n1 * (n1 + 1) / 2)
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((t + 1) - ratio(F.col("_ties"), t * (t - 1))))
    diff = F.col("statistic") - mu
    m = m.withColumn("z", F.when(sigma > 0, (diff - F.signum(diff) * 0.5) / sigma)).withColumn("auc", F.col("statistic") / (n1 * n2))
    return m.withColumn("p_value", norm_p("z")).select(*by, "n1", "n2", "statistic", "auc", "z", "p_value")


def kruskal(df: DataFrame, x: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    r = rank_sums(df, x, group, by)
    m = r.groupBy(*by).agg(F.count("*").alias("k"), F.max("total").alias("n"), F.max("ties").alias("_ties"), F.sum(F.col("rank_sum") ** 2 / F.col("n")).alias("_s"))
    n = F.col("n")
    h = ratio(12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1), 1 - ratio(F.col("_ties"), n.cast("double") ** 3 - n))
    return m.withColumn("statistic", h).withColumn("p_value", chi2_p("statistic", F.col("k") - 1)).select(*by, "n", "k", "statistic", "p_value")


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Exact 2x2 test per row; each distinct table is solved once and joined back."""
    keys = [a, b, c, d]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    u = df.select(*keys).distinct().repartition(tasks).withColumn("_r", fisher_p(*keys)).select(*keys, "_r.*")
    return df.join(u, keys)


def chi_square(counts: DataFrame, row: str, col: str, n: str, by: Sequence[str] = ()) -> DataFrame:
    """Independence test on a long count table (absent cells count as 0)."""
    rt = counts.groupBy(*by, row).agg(F.sum(n).alias("_rt"))
    ct = counts.groupBy(*by, col).agg(F.sum(n).alias("_ct"))
    tot = counts.groupBy(*by).agg(F.sum(n).alias("n"), F.count_distinct(row).alias("_nr"), F.count_distinct(col).alias("_nc"))
    j = join_same(join_same(counts, rt, [*by, row]), ct, [*by, col])
    # sum (o-e)^2/e over all cells equals n * (sum o^2/(r c) - 1), so absent cells need no rows
    s = j.groupBy(*by).agg(F.sum(ratio(F.col(n).cast("double") * F.col(n), F.col("_rt").cast("double") * F.col("_ct"))).alias("_q"))
    m = join_same(s, tot, list(by)) if by else s.withColumns({c: tot.select(c).scalar() for c in ("n", "_nr", "_nc")})
    m = m.withColumn("statistic", F.col("n") * (F.col("_q") - 1)).withColumn("df", (F.col("_nr") - 1) * (F.col("_nc") - 1))
    return m.withColumn("p_value", chi2_p("statistic", "df")).withColumn(
        "cramers_v", F.sqrt(ratio(F.col("statistic"), F.col("n") * (F.least("_nr", "_nc") - 1)))).select(*by, "n", "df", "statistic", "p_value", "cramers_v")


def chi_square_gof(counts: DataFrame, n: str, prob: Column) -> DataFrame:
    tot = counts.agg(F.sum(n)).scalar()
    d = counts.withColumn("_e", prob).withColumn("_t", tot)
    e = F.col("_e") * F.col("_t")
    m = d.agg(F.sum(ratio((F.col(n) - e) * (F.col(n) - e), e)).alias("statistic"), (F.count("*") - 1).alias("df"), F.sum(n).alias("n"))
    return m.withColumn("p_value", chi2_p("statistic", "df"))


def binomial_test(df: DataFrame, k: str, n: str, p0: float = 0.5) -> DataFrame:
    u = df.select(k, n).distinct().withColumn("p_value", binom_p(k, n, F.lit(p0)))
    return df.join(u, [k, n])


def anova_oneway(df: DataFrame, x: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """F test from group moments; the within sum of squares uses the stable variance aggregate."""
    g = df.where(F.col(x).isNotNull()).groupBy(*by, group).agg(F.count(x).alias("_n"), F.avg(x).alias("_m"), F.var_pop(x).alias("_v"))
    tot = g.groupBy(*by).agg(F.sum("_n").alias("n"), (F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_gm"))
    j = join_same(g, tot, list(by)) if by else g.withColumns({c: tot.select(c).scalar() for c in ("n", "_gm")})
    m = j.groupBy(*by).agg(F.max("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("_n") * (F.col("_m") - F.col("_gm")) ** 2).alias("ssb"),
                           F.sum(F.col("_n") * F.col("_v")).alias("ssw"))
    m = m.where((F.col("k") > 1) & (F.col("n") > F.col("k")))
    m = m.withColumn("statistic", ratio(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k"))))
    return m.withColumn("r2", ratio(F.col("ssb"), F.col("ssb") + F.col("ssw"))).withColumn("p_value", f_p("statistic", F.col("k") - 1, F.col("n") - F.col("k")))


def _sweep(m: np.ndarray, k: int) -> None:
    """Sweeps column k of a cross-product matrix in place: the last diagonal entry becomes the residual sum of squares."""
    row = m[k] / m[k, k]
    m -= np.outer(m[:, k], row)
    m[k] = row


def _fit_blocks(m: np.ndarray, blocks: Sequence[range]) -> list[tuple[float, int]]:
    """(sum of squares explained, degrees of freedom) of each block of columns after those before it."""
    m, out, scale = m.copy(), [], np.diag(m).copy()
    for block in blocks:
        before, df = m[-1, -1], 0
        for k in block:
            if m[k, k] > 1e-9 * scale[k]:  # a column that earlier ones give adds nothing
                _sweep(m, k)
                df += 1
        out.append((max(0.0, float(before - m[-1, -1])), df))
    return out


TERMS = "term string, df bigint, ss double, ss_partial double"


def anova_twoway(df: DataFrame, x: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Two-way analysis of variance with interaction for unbalanced cells: by..., term, df, ss, ss_partial, ms, statistic, p_value, p_partial.

    `ss` is sequential (a, then b, then a:b), `ss_partial` that of a factor after the other one.  Data is read once, into
    counts, means and variances of the cells; a group's cells (as many as its level pairs) become one cross-product of
    indicator columns that is swept in both orders.  Empty cells and columns that others give cost degrees of freedom;
    a term without any, or a group without residual ones, has NULL statistics.  Rows with a null in x, a or b are left out.
    """
    ok = df.where(F.col(x).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = ok.groupBy(*by, a, b).agg(F.count(x).alias("_n"), F.avg(F.col(x).cast("double")).alias("_m"), F.var_pop(F.col(x).cast("double")).alias("_v"))
    keys = list(by) or ["_all"]
    cells = cells if by else cells.withColumn("_all", F.lit(0))
    types = dict(cells.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean = pdf["_n"].to_numpy(float), pdf["_m"].to_numpy(float)
        mean = mean - (n @ mean) / n.sum()
        ia, ib = (pd.factorize(pdf[c], sort=True)[0] for c in (a, b))
        na, nb = ia.max() + 1, ib.max() + 1
        z = np.column_stack([np.ones(len(n)), np.eye(na)[ia], np.eye(nb)[ib], mean])
        m = (z.T * n) @ z
        first, second = range(1, 1 + na), range(1 + na, 1 + na + nb)
        _, (ssa, dfa), (ssb, dfb) = _fit_blocks(m, [range(1), first, second])
        _, _, (part, _) = _fit_blocks(m, [range(1), second, first])
        between, within = float(n @ mean ** 2), float(n @ pdf["_v"].to_numpy(float))
        inter = max(0.0, between - ssa - ssb)
        dfi = len(n) - 1 - dfa - dfb
        rows = [(a, dfa, ssa, part), (b, dfb, ssb, ssb), (f"{a}:{b}", dfi, inter if dfi else 0.0, inter if dfi else 0.0), ("residuals", int(n.sum()) - len(n), within, within)]
        return pd.DataFrame([(*pdf[keys].iloc[0], *r) for r in rows], columns=[*keys, "term", "df", "ss", "ss_partial"])

    out = cells.groupBy(*keys).applyInPandas(fit, ", ".join([*[f"`{k}` {types[k]}" for k in keys], TERMS]))
    res = out.where("term = 'residuals'").select(*keys, F.col("df").alias("_d"), F.col("ss").alias("_s"))
    j = join_same(out, res, keys).withColumn("ms", ratio(F.col("ss"), F.col("df")))
    error = ratio(F.col("_s"), F.col("_d"))
    f = lambda ss: F.when(F.col("term") != "residuals", ratio(ratio(F.col(ss), F.col("df")), error))
    j = j.withColumn("statistic", f("ss")).withColumn("_fp", f("ss_partial"))
    p = lambda c: F.when(F.col(c).isNotNull(), f_p(c, "df", "_d"))
    return j.select(*by, "term", "df", "ss", "ss_partial", "ms", "statistic", p("statistic").alias("p_value"), p("_fp").alias("p_partial"))


def p_adjust(df: DataFrame, p: str, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg and Bonferroni values plus the alpha / n threshold.

    Works on distinct p with counts: the adjusted value of p is the smallest
    p' n / rank(p') over p' >= p.
    """
    r = value_ranks(df, p, by)
    tot = r.groupBy(*by).agg(F.sum("n").alias("n_tests"))
    r = join_same(r, tot, list(by)) if by else r.withColumn("n_tests", tot.scalar())
    r = r.withColumn("_raw", F.col(p) * F.col("n_tests") / F.col("cum_n")).select(*by, p, "n_tests", "_raw")
    s = suffix_min(r, F.col("_raw"), [p], "_bh", by)
    s = s.select(*by, p, "n_tests", F.least(F.lit(1.0), "_bh").alias("p_bh"), F.least(F.lit(1.0), F.col(p) * F.col("n_tests")).alias("p_bonferroni"),
                 (F.lit(alpha) / F.col("n_tests")).alias("threshold"))
    return join_same(df, s, [*by, p])


@F.pandas_udf(T.DoubleType())
def chi2_quantile_of_p(p: pd.Series) -> pd.Series:
    return p.map(lambda x: sp.chi2_1_isf(float(x)))


def genomic_inflation(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """lambda = median chi-square (1 df) / 0.4549; the quantile map is monotone, so the two middle p suffice."""
    r = value_ranks(df, p, by)
    tot = r.groupBy(*by).agg(F.sum("n").alias("_t"))
    r = join_same(r, tot, list(by)) if by else r.withColumn("_t", tot.scalar())
    at = lambda i: F.max(F.when((F.col("cum_n") > i) & (F.col("cum_n") - F.col("n") <= i), F.col(p)))
    m = r.groupBy(*by).agg(at(F.floor((F.col("_t") - 1) / 2)).alias("_a"), at(F.floor(F.col("_t") / 2)).alias("_b"), F.max("_t").alias("n"))
    med = (chi2_quantile_of_p("_a") + chi2_quantile_of_p("_b")) / 2
    return m.select(*by, "n", (med / 0.4549364231195724).alias("lambda"))


def enrichment(counts: DataFrame, label: str, hits: str, background: str) -> DataFrame:
    """Observed share among hits over the background share, per label."""
    t = counts.agg(F.struct(F.sum(hits).alias("h"), F.sum(background).alias("b"))).scalar()
    c = counts.withColumn("_t", t)
    obs, bg = ratio(F.col(hits), F.col("_t.h")), ratio(F.col(background), F.col("_t.b"))
    return c.select(label, hits, background, obs.alias("observed"), bg.alias("expected"), F.when(bg > 0, obs / bg).alias("fold"))


def log_odds(counts: DataFrame, keys: Sequence[str], a: str, b: str, cells: int, pseudo: float = 0.5) -> DataFrame:
    """log2 ratio of smoothed shares of two count columns over a grid of `cells` cells."""
    t = counts.agg(F.struct(F.sum(a).alias("a"), F.sum(b).alias("b"))).scalar()
    c = counts.withColumn("_t", t)
    share = lambda x, tot: ratio(F.col(x) + pseudo, F.col(tot) + pseudo * cells)
    return c.select(*keys, a, b, F.log2(ratio(share(a, "_t.a"), share(b, "_t.b"))).alias("log_odds"),
                    (F.col("_t.a") - F.col(a)).alias("rest_a"), (F.col("_t.b") - F.col(b)).alias("rest_b"))


def concordance(df: DataFrame, dx: str, dy: str, by: Sequence[str]) -> DataFrame:
    """Sign agreement among changes beyond +-0.5 sd of dx, with an exact binomial against 0.5."""
    sd = df.agg(F.stddev_samp(dx)).scalar()
    d = df.withColumn("_sd", sd).where((F.abs(dx) > 0.5 * F.col("_sd")) & (F.col(dy) != 0))
    m = d.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.signum(dx) == F.signum(dy)).alias("n_concordant"))
    m = binomial_test(m, "n_concordant", "n")
    p = F.col("n_concordant") / F.col("n")
    h = 1.959963984540054 * F.sqrt(p * (1 - p) / F.col("n"))
    return m.select(*by, "n", "n_concordant", p.alias("share"), (p - h).alias("ci_lo"), (p + h).alias("ci_hi"), "p_value")


def classifier_metrics(df: DataFrame, score: str, label: str, cut: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """AUC (rank form), confusion counts, accuracy, RMSE and MAE of a 0/1 label against a score."""
    w = wilcoxon(df, score, label, 1, 0, by).select(*by, "auc")
    s, y = F.col(score), F.col(label)
    pos = s >= cut
    m = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(pos & (y == 1)).alias("tp"), F.count_if(pos & (y == 0)).alias("fp"),
                            F.count_if(~pos & (y == 1)).alias("fn"), F.count_if(~pos & (y == 0)).alias("tn"),
                            F.sqrt(F.avg((s - y) * (s - y))).alias("rmse"), F.avg(F.abs(s - y)).alias("mae"))
    m = m.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.col("n"))
    return join_same(m, w, list(by)) if by else m.withColumn("auc", w.scalar())


def permutation_test(df: DataFrame, key: Sequence[str], x: str, label: Column, n_perm: int = 99, seed: int = 42) -> DataFrame:
    """Difference of means between labelled and other rows against shuffled labels, p = (#>=obs + 1)/(B + 1).

    A shuffle gives the labels to the rows that come first in hash order, so the label
    count is kept exactly.  Rows are counted and summed per bin of the hash; only those of the bin
    that holds the last label, one in 256, are ranked, block-wise.
    """
    base = df.select(*key, F.col(x).cast("double").alias("_x"), label.cast("int").alias("_l"))
    tot = base.agg(F.struct(F.sum("_l").alias("k"), F.count("*").alias("n"), F.sum("_x").alias("s"), F.sum(F.col("_x") * F.col("_l")).alias("t"))).scalar()
    # hashing is heavy per row: fix the task count so small tables are not one task
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    perm = base.repartition(tasks, *key).select(*key, "_x", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("perm")).withColumn("_b", F.substring(digest(*key, "perm", seed=seed), 1, 2))
    bins = perm.groupBy("perm", "_b").agg(F.count("*").alias("_n"), F.coalesce(F.sum("_x"), F.lit(0.0)).alias("_s"))
    w = Window.partitionBy("perm").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    cut = bins.select("perm", "_b", "_n", before("_n").alias("_m"), before("_s").alias("_below")).withColumn("_t", tot)
    cut = materialize(cut.where((F.col("_m") < F.col("_t.k")) & (F.col("_t.k") <= F.col("_m") + F.col("_n"))))
    last = perm.join(F.broadcast(cut), ["perm", "_b"]).select(*key, "_x", "perm", draw(*key, "perm", seed=seed).alias("_h"), "_m", "_below")
    idx = row_index(last, ["_h", *key], ["perm"], "_i").withColumn("_t", tot)
    diff = lambda t: ratio(t, F.col("_t.k")) - ratio(F.col("_t.s") - t, F.col("_t.n") - F.col("_t.k"))
    sums = idx.where(F.col("_m") + F.col("_i") <= F.col("_t.k")).groupBy("perm").agg((F.max("_below") + F.coalesce(F.sum("_x"), F.lit(0.0))).alias("_sum"), F.first("_t").alias("_t"))
    r = sums.select("perm", diff(F.col("_sum")).alias("d"), diff(F.col("_t.t")).alias("obs"))
    return r.agg(F.max("obs").alias("observed"), F.avg("d").alias("null_mean"), F.stddev_samp("d").alias("null_sd"), F.count("*").alias("n_perm"),
                 ((F.count_if(F.abs("d") >= F.abs("obs")) + 1) / (F.count("*") + 1)).alias("p_value"))


def delta_signal(df: DataFrame, p_only: str, p_with: str) -> DataFrame:
    """-log10 P_only minus -log10 P_with, rows with infinite values dropped."""
    ok = (F.col(p_only) > 0) & (F.col(p_with) > 0)
    return df.where(ok).withColumn("delta", -F.log10(F.col(p_only)) + F.log10(F.col(p_with)))


def likelihood_ratio(df: DataFrame, lnl0: str, lnl1: str, dof: str) -> DataFrame:
    return df.withColumn("statistic", 2 * (F.col(lnl1) - F.col(lnl0))).withColumn("p_value", chi2_p("statistic", dof))


def coefficient_stability(cors: DataFrame, by: Sequence[str], r: str) -> DataFrame:
    """Mean, sd and CV of a correlation across groups."""
    return cors.where(F.col(r).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n_groups"), F.avg(r).alias("mean_r"), F.stddev_samp(r).alias("sd_r"),
        F.when(F.avg(r) != 0, F.stddev_samp(r) / F.abs(F.avg(r))).alias("cv_r"))
