"""Association scans and regressions from sufficient statistics.

No sample row reaches Python in a per-site model fit: Spark sums counts, means and
cross-products per site or fold, and each small system is solved on its result row.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from cladeloom.functions.arith import corr, ratio
from cladeloom.functions import special as sp, vectors as vx
from cladeloom.operators.gram import centred, gram, gram_of_columns, unpack
from cladeloom.operators.matrix import _components, _expand
from cladeloom.operators.ordered import join_same, quantiles
from cladeloom.operators.sequences import kmer_presence
from cladeloom.operators import stats as sx
from cladeloom.session import materialize, tasks_for

TOL = 1e-9
#: Covariates from which sums of a site are formed as vectors.
WIDE = 32


def _solve(a: np.ndarray, b: np.ndarray):
    """Minimum-norm solution of symmetric normal equations, with rank and inverse (scaled for conditioning)."""
    s = np.sqrt(np.maximum(np.diag(a), 0))
    keep = s > 0
    s = np.where(keep, s, 1.0)
    m = a / np.outer(s, s)
    val, vec = np.linalg.eigh(m)
    ok = val > TOL * max(val.max(), 0) if len(val) else np.array([], bool)
    inv = (vec[:, ok] / val[ok]) @ vec[:, ok].T
    inv = inv / np.outer(s, s)
    return inv @ b, int(ok.sum()), inv


def _p(fn, *args):
    x = float(fn(*[np.array([float(a)]) for a in args])[0])
    return None if np.isnan(x) else x


def ols_by_group(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by..., term, n, estimate, se, t, p_value, r2 of a least-squares fit per group; degenerate groups are skipped."""
    cols = [*xs, y]
    doubles, whole = [F.col(c).cast("double") for c in cols], df.dropna(subset=cols)
    g = (gram_of_columns(whole, doubles, by) if len(cols) <= 12 else gram(whole, F.array(*doubles), by)).where("n > 0").drop("n")
    names = list(xs)

    def fit(row):
        n, mean, s = centred(unpack(row["_gram"]))
        b, rank, inv = _solve(s[:-1, :-1], s[:-1, -1])
        dof = n - 1 - rank
        if rank < len(names) or dof <= 0 or s[-1, -1] <= 0:
            return
        rss = max(s[-1, -1] - b @ s[:-1, -1], 0.0)
        s2 = rss / dof
        r2 = 1 - rss / s[-1, -1]
        icpt = mean[-1] - b @ mean[:-1]
        var0 = s2 * (1 / n + mean[:-1] @ inv @ mean[:-1])
        for t, e, v in zip(["(intercept)", *names], [icpt, *b], [var0, *(s2 * np.diag(inv))]):
            se = float(np.sqrt(v))
            tt = float(e / se) if se > 0 else None
            yield t, int(n), float(e), se, tt, (_p(sp.t_sf2, tt, dof) if tt is not None else None), float(r2)

    return _expand(g, by, "term string, n bigint, estimate double, se double, t double, p_value double, r2 double", fit)


def weighted_ols(df: DataFrame, y: str, xs: Sequence[str], w: str) -> DataFrame:
    """Least squares with row weights; weights are folded into the cross-products."""
    sw = F.sqrt(F.col(w).cast("double"))
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in (*xs, y)]]
    g = gram(df.where(F.col(w) > 0), F.array(*[c * sw for c in cols])).withColumnRenamed("n", "n_rows")
    names = ["(intercept)", *xs]

    def fit(row):
        m = unpack(row["_gram"])[1:, 1:]
        b, rank, inv = _solve(m[:-1, :-1], m[:-1, -1])
        dof = row["n_rows"] - rank
        rss = max(m[-1, -1] - b @ m[:-1, -1], 0.0)
        for t, e, v in zip(names, b, np.diag(inv)):
            se = float(np.sqrt(rss / dof * v)) if dof > 0 else float("nan")
            yield t, int(row["n_rows"]), float(e), se, float(e / se), _p(sp.t_sf2, e / se, dof)

    return _expand(g, (), "term string, n bigint, estimate double, se double, t double, p_value double", fit)


def site_anova_scan(sites: DataFrame, y: str, min_n: int = 1) -> DataFrame:
    """Per site: F test of the phenotype on the residue (gap is a level)."""
    a = sx.anova_oneway(sites, y, "allele", ["gene", "pos"])
    return a.where(F.col("n") >= min_n)


def complete_sites(sites: DataFrame) -> DataFrame:
    """Every sample of a gene at every column of the gene, absent cells as gaps."""
    lv = sites.select("gene", "pos").distinct().groupBy("gene").agg(F.collect_list("pos").alias("_p"))
    own = sites.groupBy("gene", "id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "allele"))).alias("_m"))
    g = own.join(lv, "gene").select("gene", "id", "_m", F.explode("_p").alias("pos"))
    return g.select("gene", "pos", "id", F.coalesce(F.try_element_at("_m", F.col("pos")), F.lit("-")).alias("allele"))


def site_scan(sites: DataFrame, traits: DataFrame, min_n: int = 1) -> DataFrame:
    """Null / residue / covariate / full models per site with nested F tests and residue effects.

    `traits` holds (id, y, z array).  Sites must be complete per gene.  Only allele-level
    sums of (y, z) and one cross-product per gene are formed, so covariates are shared
    by all sites of the gene and samples are combined map-side.
    """
    return _scan_rows(_scan_sums(sites, traits, min_n), _site_models)


def _scan_sums(sites: DataFrame, traits: DataFrame, min_n: int) -> DataFrame:
    """One row per site: alleles with their counts and sums of (z, y), and the cross-product of its gene.

    A sample's sites of a gene are one row until they are summed, so it meets its traits once per gene.
    """
    own = sites.groupBy("gene", "id").agg(F.collect_list(F.struct("pos", "allele")).alias("_sites"))
    own = materialize(own.join(traits.select("id", "y", "z"), "id"))
    per_gene = gram(own.select("gene", "id", "y", "z").dropDuplicates(["gene", "id"]), F.concat(F.col("z"), F.array("y")), ["gene"]).select("gene", "_gram")
    s = own.select("gene", F.inline("_sites"), F.concat(F.col("z"), F.array("y")).alias("v"))
    width = own.select(F.max(F.size("z"))).first()[0]
    if width is not None and width < WIDE:  # sums of numbers cost a tenth of those of vectors
        known = lambda x: F.coalesce(x, F.raise_error(F.lit("a covariate or phenotype is null")).cast("double"))
        total = F.array(*[F.sum(known(F.col("v")[i])) for i in range(width + 1)])
    else:
        total = vx.sum_vector(F.col("v"))
    sums = s.groupBy("gene", "pos", "allele").agg(F.count("*").alias("n"), total.alias("s"))
    packed = sums.groupBy("gene", "pos").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("allele", F.col("n").alias("k"), "s"))).alias("a"),
                                             F.coalesce(F.sum(F.when(F.col("allele") != "-", F.col("n"))), F.lit(0)).alias("ng"))
    packed = packed.where((F.col("ng") >= min_n) & (F.size("a") >= 2))
    return packed.join(per_gene, "gene")


def _site_models(row, size: int | None = None):
    """Results of a site, with the first `size` covariates only where it is given."""
    whole = unpack(row["_gram"])
    some = np.arange(len(whole) - 2 if size is None else min(max(size, 0), len(whole) - 2))
    n, mean, c = centred(whole[np.ix_(*[np.concatenate([[0], 1 + some, [len(whole) - 1]])] * 2)])
    alle = [a["allele"] for a in row["a"]]
    cnt = np.array([a["k"] for a in row["a"]], float)
    if row["n"] != n:
        raise ValueError(f"site {row['gene']}:{row['pos']} has {row['n']} samples, its gene {n}")
    sm = np.vstack([a["s"] for a in row["a"]])[:, np.append(some, len(whole) - 2)] - cnt[:, None] * mean
    szz, szy, syy = c[:-1, :-1], c[:-1, -1], c[-1, -1]
    # centred indicator columns of all levels but the last
    k = len(alle) - 1
    saa = np.diag(cnt[:k]) - np.outer(cnt[:k], cnt[:k]) / n
    saz, say = sm[:k, :-1], sm[:k, -1]
    rss0 = syy

    def rss(m, v):
        b, rank, inv = _solve(m, v) if len(v) else (np.zeros(0), 0, np.zeros((0, 0)))
        return max(syy - b @ v, 0.0), rank, b, inv

    ra, ka, _, _ = rss(saa, say)
    rz, kz, _, _ = rss(szz, szy)
    full = np.block([[saa, saz], [saz.T, szz]])
    rf, kf, b, inv = rss(full, np.concatenate([say, szy]))

    def nested(r0, k0, r1, k1):
        dof = n - 1 - k1
        if k1 <= k0 or dof <= 0 or r1 <= 0:
            return None
        return _p(sp.f_sf, ((r0 - r1) / (k1 - k0)) / (r1 / dof), k1 - k0, dof)

    eff = []
    dof = n - 1 - kf
    if dof > 0 and rf > 0:
        for i in range(k):
            se = float(np.sqrt(rf / dof * inv[i, i]))
            if se > 0:
                eff.append({"residue": alle[i], "effect": float(b[i]), "se": se, "t": float(b[i] / se), "p": _p(sp.t_sf2, b[i] / se, dof)})
    yield (int(n), float(1 - ra / syy), float(1 - rz / syy), float(1 - rf / syy), nested(rss0, 0, ra, ka), nested(rss0, 0, rz, kz), nested(rz, kz, rf, kf),
           {a: int(x) for a, x in zip(alle, cnt)}, eff)


SCAN_SCHEMA = ("gene string, pos int, n bigint, r2_aa double, r2_pcs double, r2_full double, p_aa_only double, p_pcs_only double, p_aa_with_pcs double, "
               "residue_counts map<string,bigint>, effects array<struct<residue:string,effect:double,se:double,t:double,p:double>>")


def _scan_rows(rows: DataFrame, fit, sizes: Sequence[int] | None = None) -> DataFrame:
    """fit(row) for every row or, tagged n_pcs, fit(row, size) for every size."""
    import pandas as pd
    names = ["gene", "pos", "n", "r2_aa", "r2_pcs", "r2_full", "p_aa_only", "p_pcs_only", "p_aa_with_pcs", "residue_counts", "effects"]
    tags = [] if sizes is None else ["n_pcs"]

    def run(batches):
        for pdf in batches:
            if sizes is None:
                out = [(r["gene"], r["pos"], *x) for _, r in pdf.iterrows() for x in fit(r)]
            else:
                out = [(r["gene"], r["pos"], *x, k) for _, r in pdf.iterrows() for k in sizes for x in fit(r, k)]
            yield pd.DataFrame(out, columns=[*names, *tags])

    return rows.mapInPandas(run, SCAN_SCHEMA if sizes is None else SCAN_SCHEMA + ", n_pcs int")


def covariate_sweep(sites: DataFrame, traits: DataFrame, sizes: Sequence[int], min_n: int = 1) -> DataFrame:
    """Repeat the scan with the first k covariates for each k, tagged n_pcs.  The sums of all covariates are formed once
    and kept; each k takes its part of them."""
    most = max([0, *sizes])
    z = F.slice("z", 1, most) if most > 0 else F.array().cast("array<double>")
    return _scan_rows(materialize(_scan_sums(sites, traits.select("id", "y", z.alias("z")), min_n)), _site_models, [int(k) for k in sizes])


def sweep_summary(sweep: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per covariate count: significant sites (nominal, Bonferroni) and median -log10 p."""
    p = F.coalesce("p_aa_with_pcs", "p_aa_only")
    s = materialize(sweep.select("n_pcs", p.alias("_p")))  # one row per site and count
    n = s.groupBy("n_pcs").agg(F.count("_p").alias("n_sites"))
    j = s.join(n, "n_pcs")
    m = j.groupBy("n_pcs", "n_sites").agg(F.count_if(F.col("_p") < alpha).alias("n_nominal"), F.count_if(F.col("_p") < alpha / F.col("n_sites")).alias("n_bonferroni"))
    q = quantiles(s.where("_p > 0").withColumn("_l", -F.log10("_p")), "_l", {"median_log10p": 0.5}, ["n_pcs"]).drop("n")
    return m.join(q, "n_pcs", "left")


def linear_coefficients(df: DataFrame, z: Column, y: str) -> DataFrame:
    """One row: intercept and coefficient array of y on the vector z."""
    g = gram(df, F.concat(z, F.array(F.col(y).cast("double")))).drop("n")

    def fit(row):
        _, mean, s = centred(unpack(row["_gram"]))
        b, _, _ = _solve(s[:-1, :-1], s[:-1, -1])
        yield float(mean[-1] - b @ mean[:-1]), b.tolist()

    return _expand(g, (), "intercept double, beta array<double>", fit)


def residualize(df: DataFrame, z: Column, y: str, out: str = "residual") -> DataFrame:
    """y minus its least-squares prediction from z, computed JVM-side from one small model row."""
    m = linear_coefficients(df, z, y).select(F.struct("intercept", "beta")).scalar()
    j = df.withColumn("_m", m)
    return j.withColumn(out, F.col(y) - F.col("_m.intercept") - vx.dot(z, F.col("_m.beta"))).drop("_m")


def vector_f_scan(df: DataFrame, by: Sequence[str], vec: str, y: str, k: int | None = None) -> DataFrame:
    """F test of y on a vector per group, on its first k components when k is given."""
    g = gram(df, F.concat(F.col(vec), F.array(F.col(y).cast("double"))), by).drop("n")

    def fit(row):
        n, _, s = centred(unpack(row["_gram"]))
        sxx, sxy, syy = s[:-1, :-1], s[:-1, -1], s[-1, -1]
        if n < 3 or syy <= 0:
            return
        if k is not None:
            _, w, _, _ = _components(sxx, n, k, False)
            sxx, sxy = w @ sxx @ w.T, w @ sxy
        b, rank, _ = _solve(sxx, sxy)
        rss = max(syy - b @ sxy, 0.0)
        dof = n - 1 - rank
        if rank == 0 or dof <= 0:
            return
        f = ((syy - rss) / rank) / (rss / dof) if rss > 0 else float("inf")
        yield int(n), rank, float(1 - rss / syy), float(f), _p(sp.f_sf, f, rank, dof)

    return _expand(g, by, "n bigint, rank int, r2 double, f double, p_value double", fit)


def nested_r2(df: DataFrame, by: Sequence[str], blocks: Mapping[str, Column], y: str, models: Mapping[str, Sequence[str]]) -> DataFrame:
    """R2 and rank of several models per group over named column blocks, from one cross-product.

    Non-nested models are reported by their R2 only.
    """
    z = F.concat(*blocks.values(), F.array(F.col(y).cast("double")))
    sizes = F.array(*[F.size(c) for c in blocks.values()])
    g = gram(df, z, by).drop("n").withColumn("_sz", df.select(F.max(sizes)).scalar())
    names, spec = list(blocks), {m: list(b) for m, b in models.items()}

    def fit(row):
        n, _, s = centred(unpack(row["_gram"]))
        ends = np.cumsum(np.asarray(row["_sz"], int))
        idx = {b: np.arange(e - w, e) for b, e, w in zip(names, ends, np.asarray(row["_sz"], int))}
        syy = s[-1, -1]
        if syy <= 0:
            return
        for m, bl in spec.items():
            i = np.concatenate([idx[b] for b in bl])
            b, rank, _ = _solve(s[np.ix_(i, i)], s[i, -1])
            yield m, int(n), rank, float(b @ s[i, -1] / syy)

    return _expand(g, by, "model string, n bigint, rank int, r2 double", fit)


def ridge_cv(df: DataFrame, by: Sequence[str], vec: str, y: str, fold: Column, lambdas: Sequence[float]) -> DataFrame:
    """Cross-validated ridge error per group and penalty; folds are differences of cross-products."""
    g = gram(df.withColumn("_f", fold.cast("int")), F.concat(F.col(vec), F.array(F.col(y).cast("double"))), [*by, "_f"])
    packed = g.groupBy(*by).agg(F.collect_list(F.struct("_f", "n", "_gram")).alias("folds"))
    grid = [float(x) for x in lambdas]

    def fit(row):
        ms = [unpack(np.asarray(f["_gram"])) for f in row["folds"]]
        tot = sum(ms)
        if len(ms) < 2:
            return
        for lam in grid:
            err = 0.0
            for test in ms:
                n, mean, s = centred(tot - test)
                p = len(s) - 1
                b = np.linalg.solve(s[:p, :p] + lam * n * np.eye(p), s[:p, -1])
                c = np.concatenate([[-(mean[-1] - b @ mean[:-1])], -b, [1.0]])
                err += c @ test @ c
            base = 0.0
            for test in ms:
                t = tot - test
                c = np.zeros(len(t)); c[-1] = 1; c[0] = -t[0, -1] / t[0, 0]
                base += c @ test @ c
            yield int(tot[0, 0]), lam, float(err / tot[0, 0]), float(err / base)

    return _expand(packed, by, "n bigint, lambda double, cve double, cve_ratio double", fit)


def ridge_compare(df: DataFrame, by: Sequence[str], covariates: str, vec: str, y: str, fold: Column, lambdas: Sequence[float], penalise_covariates: bool = True) -> DataFrame:
    """Cross-validated ridge error with covariates alone (reduced) and with covariates and embeddings (full), per group.

    Columns are scaled within each training fold; each model takes its own best penalty (ties: the smaller).  Everything
    comes from one cross-product per group and fold: training sums are differences, errors quadratic forms.  Gives n,
    lambda and error of both models, their difference and ratio, and r2 of the full fit to all rows.  Groups with fewer
    than two folds drop out; without error in the reduced model the ratio is NULL.
    """
    z = F.concat(F.col(covariates), F.col(vec), F.array(F.col(y).cast("double")))
    g = gram(df.select(*by, fold.cast("int").alias("_f"), z.alias("_z"), F.size(covariates).alias("_k")), F.col("_z"), [*by, "_k", "_f"])
    packed = g.groupBy(*by, "_k").agg(F.collect_list(F.struct("_f", "_gram")).alias("folds"))
    grid = sorted(float(x) for x in lambdas)

    def solve(m: np.ndarray, use: np.ndarray, free: np.ndarray, lam: float) -> np.ndarray:
        """Coefficients for (1, z..., y) of the residual y - prediction."""
        n, mean, s = centred(m)
        sd = np.sqrt(np.diag(s) / n)
        on = use[sd[use] > TOL * (1 + np.abs(mean[use]))]
        c = np.zeros(len(m))
        c[-1] = 1
        if len(on):
            a = s[np.ix_(on, on)] / np.outer(sd[on], sd[on]) / n
            b = np.linalg.lstsq(a + lam * np.diag(~np.isin(on, free)).astype(float), s[on, -1] / sd[on] / n, rcond=None)[0] / sd[on]
            c[1 + on] = -b
        c[0] = -(mean[-1] + c[1:-1] @ mean[:-1])
        return c

    def fit(row):
        ms = [unpack(np.asarray(f["_gram"])) for f in sorted(row["folds"], key=lambda f: f["_f"])]
        if len(ms) < 2:
            return
        tot, k = sum(ms), row["_k"]
        p = len(tot) - 2
        free = np.zeros(0, int) if penalise_covariates else np.arange(k)
        best = []
        for use in (np.arange(k), np.arange(p)):
            errors = [(sum(float(c @ test @ c) for test in ms for c in [solve(tot - test, use, free, lam)]) / tot[0, 0], lam) for lam in grid]
            best.append(min(errors))
        (low, lam_low), (full, lam_full) = best
        c = solve(tot, np.arange(p), free, lam_full)
        _, _, s = centred(tot)
        b = -c[1:-1]
        den = (b @ s[:-1, :-1] @ b) * s[-1, -1]
        yield int(tot[0, 0]), lam_low, low, lam_full, full, low - full, (full / low if low > 0 else None), (float((b @ s[:-1, -1]) ** 2 / den) if den > 0 else None)

    schema = "n bigint, lambda_reduced double, cve_reduced double, lambda_full double, cve_full double, cve_diff double, cve_ratio double, r2 double"
    return _expand(packed, [*by, "_k"], schema, fit).drop("_k")


def structural_run_scan(embeds: DataFrame, structure: DataFrame, traits: DataFrame, gene: str, pos: str, taxon: str, vec: str, state: str, y: str, residual: str, min_n: int = 100, max_gap: int = 1, k: int | None = None) -> DataFrame:
    """F test of a trait on a taxon's mean embedding over each structural run, raw and residualised.

    A run is a stretch of positions of one state (`structure`: gene, pos, state); taxa average their embeddings over its
    positions before anything is fitted, so the fits see one row per taxon and run.  With `k` the test is on the run's first
    k components.  Runs with fewer than `min_n` taxa drop out.
    """
    from cladeloom.operators.aggregates import break_runs
    runs = break_runs(structure.select(gene, pos, state), [gene], [pos], state, pos, max_gap)
    spans = runs.groupBy(gene, "run").agg(F.first(state).alias(state), F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count("*").alias("n_pos"))
    at = embeds.select(gene, pos, taxon, vec).join(runs.select(gene, pos, "run"), [gene, pos])
    mean = at.groupBy(gene, "run", taxon).agg(vector_to_array(Summarizer.mean(array_to_vector(vec))).alias("_v"))
    x = materialize(mean.join(traits.select(taxon, F.col(y).alias("_y"), F.col(residual).alias("_r")), taxon))
    kinds = [vector_f_scan(x.where(F.col(c).isNotNull()), [gene, "run"], "_v", c, k).where(F.col("n") >= min_n).withColumn("kind", F.lit(name)) for c, name in (("_y", "raw"), ("_r", "residualised"))]
    return kinds[0].unionByName(kinds[1]).join(spans, [gene, "run"])


def presence_scan(long: DataFrame, gene: str, id: str, y: DataFrame) -> DataFrame:
    """y on a 0/1 gene presence per gene (invariant genes skipped) with BH; absences come from totals."""
    t = y.agg(F.struct(F.count("*").alias("n"), F.sum("y").alias("s"), F.var_pop("y").alias("v"), F.avg("y").alias("m"))).scalar()
    p = long.select(gene, id).distinct().join(y, id)
    g = p.groupBy(gene).agg(F.count("*").alias("n1"), F.avg("y").alias("m1")).withColumn("_t", t)
    n, n1 = F.col("_t.n"), F.col("n1")
    m0 = ratio(n * F.col("_t.m") - n1 * F.col("m1"), n - n1)
    g = g.where(n1 < n).withColumn("effect", F.col("m1") - m0)
    ssb = n1 * (n - n1) / n * F.col("effect") * F.col("effect")
    sst = n * F.col("_t.v")
    g = g.select(gene, "n1", (n - n1).alias("n0"), "effect", ratio(ssb, sst).alias("r2"), ratio(ssb, ratio(sst - ssb, n - 2)).alias("f"), (n - 2).alias("_d"))
    g = g.withColumn("p_value", sx.f_p("f", F.lit(1.0), F.col("_d").cast("double"))).drop("_d")
    return sx.p_adjust(g, "p_value").drop("n_tests", "threshold", "p_bonferroni")


def kmer_label_scan(seqs: DataFrame, id: str, seq: str, labels: DataFrame, label: str, k: int) -> DataFrame:
    """Per k-mer: presence against a 0/1 label, exact test and BH; absent counts come from label totals."""
    lab = labels.select(id, F.col(label).cast("int").alias("_l"))
    tot = lab.join(seqs.select(id), id).agg(F.struct(F.sum("_l").alias("p"), F.count("*").alias("n"))).scalar()
    pr = kmer_presence(seqs.join(lab.select(id), id, "left_semi"), id, seq, k).join(lab, id)
    c = pr.groupBy("kmer").agg(F.sum("_l").alias("a"), F.count_if(F.col("_l") == 0).alias("b")).withColumn("_t", tot)
    c = c.select("kmer", "a", "b", (F.col("_t.p") - F.col("a")).alias("c"), (F.col("_t.n") - F.col("_t.p") - F.col("b")).alias("d"))
    f = sx.fisher_exact(materialize(c), "a", "b", "c", "d")
    return sx.p_adjust(f, "p_value").drop("n_tests", "threshold", "p_bonferroni")


def top_correlated_features(df: DataFrame, gene: str, vec: str, y: str, order: str | None, top: int, how: str = "overall") -> DataFrame:
    """Per gene the `top` dimensions by |r|: overall, mean over orders, or n-weighted mean."""
    if how == "overall":
        r = sx.corr_with(df, vec, y, [gene]).select(gene, "dim", "n", "r")
    else:
        per = sx.corr_with(df, vec, y, [gene, order]).where(F.col("r").isNotNull() & (F.col("n") >= 3))
        w = F.col("n") if how == "weighted" else F.lit(1)
        r = per.groupBy(gene, "dim").agg(F.sum("n").alias("n"), ratio(F.sum(F.col("r") * w), F.sum(w)).alias("r"))
    from cladeloom.operators.sets import top_k_per_group
    return top_k_per_group(r.where(F.col("r").isNotNull()), [gene], [F.desc(F.round(F.abs("r"), 10)), F.col("dim")], top)


def greedy_orthogonal(df: DataFrame, gene: str, vec: str, y: str, steps: int = 5) -> DataFrame:
    """Per gene: pick the dimension most correlated with the residual of y, partial it out, repeat.

    All steps run on the gene's cross-product matrix, so the data is read once.
    """
    g = gram(df, F.concat(F.col(vec), F.array(F.col(y).cast("double"))), [gene]).drop("n")

    def fit(row):
        n, _, s = centred(unpack(row["_gram"]))
        sxx, sxy, syy = s[:-1, :-1], s[:-1, -1], s[-1, -1]
        chosen: list[int] = []
        for step in range(steps):
            if chosen:
                b, rank, _ = _solve(sxx[np.ix_(chosen, chosen)], sxy[chosen])
                res_xy, res_yy = sxy - sxx[:, chosen] @ b, syy - b @ sxy[chosen]
            else:
                res_xy, res_yy = sxy, syy
            den = np.sqrt(np.diag(sxx) * max(res_yy, 0))
            r = np.where(den > 0, res_xy / np.where(den > 0, den, 1), 0)
            r[chosen] = 0
            j = int(np.argmax(np.round(np.abs(r), 10)))
            if r[j] == 0:
                return
            chosen.append(j)
            yield step + 1, j, int(n), float(r[j])

    return _expand(g, [gene], "step int, dim int, n bigint, r double", fit)


def group_holdout(df: DataFrame, group: str, vec: str, y: str) -> DataFrame:
    """Leave one group out: fit on the others, R2 / RMSE / r on the held-out group, all from cross-products."""
    g = gram(df, F.concat(F.col(vec), F.array(F.col(y).cast("double"))), [group])
    tot = g.agg(vx.sum_vector(F.col("_gram")).alias("t")).scalar()

    def fit(row):
        test, t = unpack(row["_gram"]), unpack(np.asarray(row["_t"]))
        n, mean, s = centred(t - test)
        b, _, _ = _solve(s[:-1, :-1], s[:-1, -1])
        icpt = mean[-1] - b @ mean[:-1]
        c = np.concatenate([[-icpt], -b, [1.0]])
        m, mu, q = centred(test)
        sse = c @ test @ c
        vp, cov = b @ q[:-1, :-1] @ b, b @ q[:-1, -1]
        den = np.sqrt(max(vp, 0) * q[-1, -1])
        yield int(n), int(m), float(np.sqrt(sse / m)), (float(cov / den) if den > 0 else None), float(1 - sse / q[-1, -1]) if q[-1, -1] > 0 else None

    return _expand(g.withColumn("_t", tot).drop("n"), [group], "n_train bigint, n_test bigint, rmse double, r double, r2 double", fit)


def within_group_metrics(df: DataFrame, pred: str, y: str, group: str, min_n: int = 3) -> DataFrame:
    """Spearman per group, then mean, sd, t against 0, plus the global value."""
    per = sx.corr_test(df, pred, y, [group], "spearman", min_n).select("estimate").where("estimate is not null")
    t = sx.one_sample_t(per, "estimate")
    g = sx.corr_test(df, pred, y, (), "spearman").select(F.col("estimate").alias("global_rho"))
    sd = per.agg(F.stddev_samp("estimate")).scalar()
    return t.withColumn("sd", sd).withColumn("global_rho", g.scalar())


def grid_search(df: DataFrame, vec: str, y: str, group: str, train: Column, candidates: DataFrame, grid: DataFrame) -> DataFrame:
    """For each parameter row (param, n_dims, min_abs_r): pick training features, fit, and score held-out
    rows by mean within-group Spearman.  One cross-product serves every parameter row.
    """
    tr = df.where(train)
    g = gram(tr, F.concat(F.col(vec), F.array(F.col(y).cast("double")))).select("_gram").scalar()

    def fit(row):
        n, mean, s = centred(unpack(np.asarray(row["_g"])))
        d = np.sqrt(np.diag(s))
        r = np.where(d[:-1] * d[-1] > 0, s[:-1, -1] / (d[:-1] * d[-1]), 0)
        order = [int(i) for i in np.argsort(-np.round(np.abs(r), 10), kind="stable") if abs(r[i]) >= row["min_abs_r"]][: int(row["n_dims"])]
        b = np.zeros(len(r))
        if order:
            b[order], _, _ = _solve(s[np.ix_(order, order)], s[order, -1])
        r2 = float(b @ s[:-1, -1] / s[-1, -1])
        yield len(order), r2, float(mean[-1] - b @ mean[:-1]), b.tolist()

    models = _expand(grid.withColumn("_g", g), ["param", "n_dims", "min_abs_r"], "n_features int, train_r2 double, intercept double, beta array<double>", fit)
    packed = models.agg(F.collect_list(F.struct("param", "intercept", "beta")).alias("m")).scalar()
    test = df.where(~train).withColumn("_m", packed).select(group, y, vec, F.explode("_m").alias("m"))
    pred = test.select(group, y, F.col("m.param").alias("param"), (F.col("m.intercept") + vx.dot(F.col(vec), F.col("m.beta"))).alias("pred"))
    per = sx.corr_test(pred, "pred", y, ["param", group], "spearman", 3)
    score = per.groupBy("param").agg(F.count("estimate").alias("n_groups"), F.avg("estimate").alias("mean_rho"), F.stddev_samp("estimate").alias("sd_rho"))
    return models.select("param", "n_dims", "min_abs_r", "n_features", "train_r2").join(score, "param", "left")


# ---- results of scans -----------------------------------------------------

def hit_direction(scan: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Residue predictors of each site with counts; the site is hot, cold or mixed by the signs of its significant residues."""
    e = scan.select("gene", "pos", "p_aa_with_pcs", "residue_counts", F.explode("effects").alias("e")).select(
        "gene", "pos", F.col("e.residue").alias("residue"), F.col("e.effect").alias("effect"), F.col("e.p").alias("p"),
        F.try_element_at("residue_counts", F.col("e.residue")).alias("count"))
    sig = F.col("p") < alpha
    d = e.groupBy("gene", "pos").agg(F.count_if(sig & (F.col("effect") > 0)).alias("_h"), F.count_if(sig & (F.col("effect") < 0)).alias("_c"))
    lab = F.when((F.col("_h") > 0) & (F.col("_c") > 0), "mixed").when(F.col("_h") > 0, "hot").when(F.col("_c") > 0, "cold").otherwise("none")
    return e.join(d.select("gene", "pos", lab.alias("direction")), ["gene", "pos"])


def major_minor_transitions(sites: DataFrame, min_minor: int = 10) -> DataFrame:
    """Major allele and each minor allele above the count, per site (gaps and X left out)."""
    from cladeloom.operators.sites import allele_counts
    c = allele_counts(sites).where("allele <> 'X'")
    g = c.groupBy("gene", "pos").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "allele"))).alias("a"))
    x = g.select("gene", "pos", F.col("a")[0]["allele"].alias("major"), F.explode(F.slice("a", F.lit(2), F.size("a"))).alias("b"))
    return x.where(-F.col("b.m") > min_minor).select("gene", "pos", "major", F.col("b.allele").alias("minor"), (-F.col("b.m")).alias("count"))


def positional_enrichment(df: DataFrame, gene: str, pos: str, label: str, bins: int = 10) -> DataFrame:
    """Relative position in the gene, binned; share of each label per bin with its standard error."""
    top = df.groupBy(gene).agg(F.max(pos).alias("_l"))
    b = join_same(df, top, [gene]).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(pos) - 1) / F.col("_l") * bins)))
    n = b.groupBy(label, "bin").agg(F.count("*").alias("n"))
    t = n.groupBy(label).agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return join_same(n, t, [label]).select(label, "bin", "n", "total", p.alias("share"), F.sqrt(p * (1 - p) / F.col("total")).alias("se"))


def score_comparison(a: DataFrame, b: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Agreement of two scans: correlation of -log10 p over shared sites and hit overlap at 0.05."""
    j = a.select(*keys, F.col(p).alias("pa")).join(b.select(*keys, F.col(p).alias("pb")), list(keys)).where("pa > 0 and pb > 0")
    return j.agg(F.count("*").alias("n"), corr(-F.log10("pa"), -F.log10("pb")).alias("r"), F.count_if((F.col("pa") < 0.05) & (F.col("pb") < 0.05)).alias("both"),
                 F.count_if((F.col("pa") < 0.05) & (F.col("pb") >= 0.05)).alias("only_a"), F.count_if((F.col("pa") >= 0.05) & (F.col("pb") < 0.05)).alias("only_b"))


def run_site_overlap(runs: DataFrame, sites: DataFrame, by: Sequence[str], order: str, p_run: str, p_site: str, alpha: float) -> DataFrame:
    """Per run: significant itself, any constituent site significant, smallest site p.  `sites` carries the run id."""
    s = sites.groupBy(*by, "run").agg(F.min(p_site).alias("min_site_p"), F.bool_or(F.col(p_site) < alpha).alias("any_site_sig"), F.count("*").alias("n_sites"))
    return join_same(runs, s, [*by, "run"]).withColumn("run_sig", F.col(p_run) < alpha)


def metrics_by_file(df: DataFrame, file: str, pattern: str, fields: Sequence[str], pred: str, y: str) -> DataFrame:
    """Pearson, Spearman and RMSE per prediction file; tags are parsed from the file name."""
    tags = {f: F.regexp_extract(file, pattern, i + 1) for i, f in enumerate(fields)}
    a = sx.corr_test(df, pred, y, [file]).select(file, "n", F.col("estimate").alias("pearson"))
    with tasks_for(df.sparkSession, df.count()):
        b = materialize(sx.corr_test(df, pred, y, [file], "spearman").select(file, F.col("estimate").alias("spearman")))
    c = df.groupBy(file).agg(F.sqrt(F.avg((F.col(pred) - F.col(y)) ** 2)).alias("rmse"))
    return a.join(b, file).join(c, file).select(*[t.alias(k) for k, t in tags.items()], "n", "pearson", "spearman", "rmse")


def grid_search_genes(df: DataFrame, taxon: str, gene: str, vec: str, y: str, group: str, train: Column, grid: DataFrame) -> DataFrame:
    """For each parameter row (param, n_genes, n_dims, min_abs_r): training features nested in genes, a linear fit, and the
    mean within-group Spearman correlation of held-out taxa with its t-test; `is_best` marks the largest mean.

    `df` holds one row per taxon and gene (several are averaged).  Genes are taken by their best dimension's |r| with y
    over the training rows (at least `min_abs_r`), then the best dimensions inside each; ties by gene and dimension.  The
    data is read three times whatever the grid: for the correlations, for one cross-product of the at most
    max(n_genes) x max(n_dims) features any parameter row can choose, and for the predictions.  A taxon without a gene
    has the gene's training means.  Parameter rows without features have NULL measures.
    """
    wide_genes, wide_dims = grid.agg(F.max("n_genes"), F.max("n_dims")).first()
    r = sx.corr_with(df.where(train & F.col(y).isNotNull()), vec, y, [gene]).where(F.col("r").isNotNull())
    from cladeloom.operators.sets import top_k_per_group
    order = F.desc(F.round(F.abs("r"), 10))
    dims = top_k_per_group(r.select(gene, "dim", "r"), [gene], [order, F.col("dim")], wide_dims, "dim_rank")
    genes = dims.where("dim_rank = 1").select(gene, "r").orderBy(order, gene).limit(wide_genes)
    genes = top_k_per_group(genes.withColumn("_one", F.lit(1)), ["_one"], [order, F.col(gene)], wide_genes, "gene_rank").select(gene, "gene_rank", F.abs("r").alias("best"))
    chosen = dims.join(genes, gene).select(gene, "dim", "dim_rank", "gene_rank", "best")
    features = materialize(chosen.groupBy().agg(F.array_sort(F.collect_list(F.struct("gene_rank", "dim_rank", "best", F.col(gene).alias("gene"), "dim"))).alias("f")))
    k = features.select(F.size("f")).first()[0]
    f = features.select("f").scalar()
    if not k:
        none = {"n_features": "int", "train_r2": "double", "n_groups": "bigint", "mean_rho": "double", "statistic": "double", "p_value": "double", "is_best": "boolean"}
        return grid.select("param", "n_genes", "n_dims", "min_abs_r", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    own = df.where(F.col(y).isNotNull()).withColumn("_f", f).withColumn("_train", train)
    at = F.filter(F.transform("_f", lambda x, i: F.struct(i.alias("i"), x["gene"].alias("g"), x["dim"].alias("d"))), lambda x: x["g"] == F.col(gene))
    cells = own.select(taxon, group, "_train", F.col(y).alias("_y"), F.explode(F.transform(at, lambda x: F.struct(x["i"].alias("i"), F.get(F.col(vec), x["d"]).alias("v")))).alias("_c"))
    per = cells.groupBy(taxon, group, "_train", "_c.i").agg(F.avg("_c.v").alias("v"), F.avg("_y").alias("_y"))
    mean = per.where("_train").groupBy("i").agg(F.avg("v").alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("i", "v")))).scalar()
    wide = per.groupBy(taxon, group, "_train").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("_v"), F.avg("_y").alias("_y")).withColumn("_m", mean)
    wide = materialize(wide.select(group, "_train", "_y", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("_v", i), F.try_element_at("_m", i), F.lit(0.0))).alias("_x")))
    g = gram(wide.where("_train"), F.concat("_x", F.array("_y"))).select("_gram").scalar()

    def fit(row):
        _, mean, s = centred(unpack(np.asarray(row["_g"])))
        use = [i for i, x in enumerate(row["_f"]) if x["gene_rank"] <= row["n_genes"] and x["dim_rank"] <= row["n_dims"] and x["best"] >= row["min_abs_r"]]
        b = np.zeros(k)
        if not use:
            return
        b[use], _, _ = _solve(s[np.ix_(use, use)], s[use, -1])
        yield len(use), float(b @ s[:-1, -1] / s[-1, -1]) if s[-1, -1] > 0 else None, float(mean[-1] - b @ mean[:-1]), b.tolist()

    keys = ["param", "n_genes", "n_dims", "min_abs_r"]
    models = materialize(_expand(grid.withColumn("_g", g).withColumn("_f", f), keys, "n_features int, train_r2 double, intercept double, beta array<double>", fit))
    packed = models.agg(F.collect_list(F.struct("param", "intercept", "beta"))).scalar()
    test = wide.where(~F.col("_train")).withColumn("_m", packed).select(group, "_y", "_x", F.explode("_m").alias("m"))
    pred = test.select(group, "_y", F.col("m.param").alias("param"), (F.col("m.intercept") + vx.dot(F.col("_x"), F.col("m.beta"))).alias("pred"))
    rho = sx.corr_test(pred, "pred", "_y", ["param", group], "spearman", 3).where("estimate is not null")
    t = sx.one_sample_t(rho, "estimate", ["param"]).select("param", F.col("n").alias("n_groups"), F.col("estimate").alias("mean_rho"), "statistic", "p_value")
    top = t.agg(F.max_by("param", F.struct(F.round("mean_rho", 10), -F.col("param")))).scalar()
    out = grid.select(*keys).join(models.select("param", "n_features", "train_r2"), "param", "left").join(t, "param", "left")
    return out.withColumn("is_best", F.col("param") == top)
