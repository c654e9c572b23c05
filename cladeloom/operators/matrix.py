"""Embeddings, principal components, pair scores between sites, and spatial autocorrelation."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cladeloom.functions.arith import draw, ratio
from cladeloom.functions import vectors as vx
from cladeloom.operators.fields import BORDER_LEAF, SMOOTH_LEAF, Boxes, class_sums, inverse_sums, within_sums, z_order
from cladeloom.operators.gram import centred, gram, unpack
from cladeloom.operators.ordered import join_same, quantiles, row_index, running_sums
from cladeloom.operators.pairs import chunk_pairs, distances
from cladeloom.operators.stats import norm_p
from cladeloom.session import materialize


#: Points of a group that one task passes over in a round of `greedy_collapse`; up to 1000 are cut before the shuffle.
BLOCK_ROWS = 1000


def _expand(g: DataFrame, by: Sequence[str], schema: str, fn: Callable) -> DataFrame:
    """Turn one packed matrix per key into result rows: fn(row) -> iterable of tuples."""
    types = dict(g.dtypes)
    by_list = list(by)
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                out += [(*[row[c] for c in by_list], *r) for r in fn(row)]
            yield pd.DataFrame(out, columns=[*by_list, *names])

    full = ", ".join([*[f"`{c}` {types[c]}" for c in by], schema])
    return g.mapInPandas(run, full)


def _components(s: np.ndarray, n: float, k: int, scale: bool):
    """Eigenvalues, loadings (rows) and column sds of a centred cross-product matrix; sign fixed."""
    cov = s / (n - 1)
    sd = np.sqrt(np.diag(cov))
    if scale:
        safe = np.where(sd > 0, sd, 1.0)
        cov = cov / np.outer(safe, safe)
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(val)[::-1][:k]
    w = vec[:, order].T
    big = np.abs(w).argmax(1)
    w = w * np.sign(w[np.arange(len(w)), big])[:, None]
    return np.maximum(val[order], 0), w, sd, np.maximum(val, 0).sum()


def pca_fit(df: DataFrame, vec: str, k: int, by: Sequence[str] = (), scale: bool = False) -> DataFrame:
    """by..., n, comp, variance, ratio, cumulative, loading, mean, sd from one distributed cross-product."""
    def fit(row):
        n, mean, s = centred(unpack(row["_gram"]))
        if n < 2:
            return
        val, w, sd, tot = _components(s, n, k, scale)
        cum = 0.0
        for i, lam in enumerate(val):
            cum += lam / tot if tot > 0 else 0.0
            yield int(n), i + 1, float(lam), float(lam / tot) if tot > 0 else 0.0, cum, w[i].tolist(), mean.tolist(), sd.tolist()

    g = gram(df, F.col(vec), by).drop("n")
    return _expand(g, by, "n bigint, comp int, variance double, ratio double, cumulative double, loading array<double>, mean array<double>, sd array<double>", fit)


def pca_merge_batches(df: DataFrame, vec: str, k: int, batch: str) -> DataFrame:
    """Batch-wise fit: cross-products per batch, then summed; equals the all-at-once fit."""
    per = gram(df, F.col(vec), [batch])
    tot = per.agg(vx.sum_vector(F.col("_gram")).alias("_gram"))

    def fit(row):
        n, _, s = centred(unpack(row["_gram"]))
        val, _, _, t = _components(s, n, k, False)
        for i, lam in enumerate(val):
            yield int(n), i + 1, float(lam), float(lam / t)

    return _expand(tot, (), "n bigint, comp int, variance double, ratio double", fit)


def pca_transform(df: DataFrame, vec: str, model: DataFrame, by: Sequence[str] = (), scale: bool = False) -> DataFrame:
    """Add `pcs`: projections on the fitted components (the model is comps x width, one row per key)."""
    arr = F.array_sort(F.collect_list(F.struct("comp", "loading", "mean", "sd"))).alias("_m")
    packed = (model.groupBy(*by) if by else model.groupBy()).agg(arr)
    j = join_same(df, packed, list(by)) if by else df.withColumn("_m", packed.scalar())
    centred_v = vx.subtract(F.col(vec), F.col("_m")[0]["mean"])
    if scale:
        centred_v = F.zip_with(centred_v, F.col("_m")[0]["sd"], lambda x, s: F.when(s > 0, x / s).otherwise(x))
    j = j.withColumn("_c", centred_v)
    return j.withColumn("pcs", F.transform("_m", lambda m: vx.dot(F.col("_c"), m["loading"]))).drop("_m", "_c")


def top_loadings(model: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k strongest features of each component."""
    arr = F.transform("loading", lambda x, i: F.struct((-F.abs(x)).alias("o"), i.alias("feature"), x.alias("weight")))
    top = F.slice(F.array_sort(arr), 1, k)
    return model.select(*by, "comp", F.explode(top).alias("t")).select(*by, "comp", "t.feature", "t.weight")


def centroid_distance(df: DataFrame, id: str, vec: str, cuts: Sequence[float] = (0.90, 0.95, 0.99)) -> DataFrame:
    """Distance to the overall mean vector and a flag per percentile cut."""
    m = df.agg(vx.mean_vector(F.col(vec))).scalar()
    d = df.withColumn("_m", m).select(id, vx.euclidean(F.col(vec), F.col("_m")).alias("distance"))
    q = quantiles(d, "distance", {f"q{int(c * 100)}": c for c in cuts})
    qs = q.select(F.struct(*[f"q{int(c * 100)}" for c in cuts])).scalar()
    return d.withColumn("_q", qs).select(id, "distance", *[(F.col("distance") > F.col(f"_q.q{int(c * 100)}")).cast("int").alias(f"above_{int(c * 100)}") for c in cuts])


def embedding_outliers(df: DataFrame, id: str, gene: str, vec: str, cutoff: float = 3.0, overrides: Mapping[str, float] | None = None) -> DataFrame:
    """Radial distance in the first two components of each gene, z-scored within the gene.

    Two-dimensional classical scaling of Euclidean distances equals the centred
    two-component projection, so no distance matrix is formed.
    """
    sc = pca_transform(df, vec, pca_fit(df, vec, 2, [gene]), [gene])
    r = sc.select(id, gene, F.sqrt(vx.dot(F.col("pcs"), F.col("pcs"))).alias("radius"))
    st = r.groupBy(gene).agg(F.avg("radius").alias("_a"), F.stddev_samp("radius").alias("_s"))
    z = join_same(r, st, [gene]).withColumn("z", F.when(F.col("_s") > 0, (F.col("radius") - F.col("_a")) / F.col("_s")))
    cut = F.lit(cutoff)
    for g, c in (overrides or {}).items():
        cut = F.when(F.col(gene) == g, c).otherwise(cut)
    return z.select(id, gene, "radius", "z", (F.abs("z") >= cut).alias("is_outlier"))


def group_cosines(df: DataFrame, gene: str, vec: str) -> DataFrame:
    """Cosine between mean vectors of every two groups (as many pairs as gene pairs)."""
    m = df.groupBy(gene).agg(vx.mean_vector(F.col(vec)).alias("v"))

    def kernel(a, b, same):
        na = a["v"] / np.linalg.norm(a["v"], axis=1, keepdims=True)
        nb = b["v"] / np.linalg.norm(b["v"], axis=1, keepdims=True)
        c = na @ nb.T
        i, j = np.nonzero(a[gene][:, None] < b[gene][None, :]) if same else np.nonzero(np.ones_like(c, bool))
        x, y = a[gene][i], b[gene][j]
        return {"a": np.where(x < y, x, y), "b": np.where(x < y, y, x), "cosine": c[i, j]}

    t = dict(df.dtypes)[gene]
    return chunk_pairs(m, (), gene, ["v"], kernel, f"a {t}, b {t}, cosine double", vectors=["v"])


def pair_quantile(points: DataFrame, by: Sequence[str], key: str, vec: str, p: float, bins: int = 4096) -> DataFrame:
    """Exact quantile of all within-group pair distances, without listing them.

    Pass 1 counts distances per bin; pass 2 returns only distances of the bins that
    hold the two middle ranks.  NULL and 0 when there is no pair.
    """
    hi = 2 * (points.agg(F.max(vx.l2_norm(F.col(vec)))).first()[0] or 0.0) + 1e-9
    width = hi / bins

    def dist(a, b, same):
        d = distances(a[vec], b[vec])
        return d[np.triu_indices(len(d), 1)] if same else d.ravel()

    def count(a, b, same):
        n = np.bincount((dist(a, b, same) / width).astype(int), minlength=bins)
        (i,) = np.nonzero(n)
        return {"bin": i, "n": n[i]}

    h = materialize(chunk_pairs(points, by, key, [vec], count, "bin int, n bigint", vectors=[vec]).groupBy("bin").agg(F.sum("n").alias("n")))
    run = running_sums(h, {"cum": F.col("n")}, ["bin"])
    total = h.agg(F.sum("n")).first()[0]
    if not total:
        return points.sparkSession.range(1).select(F.lit(None).cast("double").alias("q"), F.lit(0).cast("bigint").alias("n_pairs"))
    pos = (total - 1) * p
    want = [int(np.floor(pos)), int(np.ceil(pos))]
    hit = [r for r in run.where(F.expr(" or ".join(f"(cum > {w} and cum - n <= {w})" for w in want))).collect()]
    chosen = {r["bin"] for r in hit}
    before = min(r["cum"] - r["n"] for r in hit)

    def keep(a, b, same):
        d = dist(a, b, same)
        return {"d": d[np.isin((d / width).astype(int), list(chosen))]}

    vals = row_index(chunk_pairs(points, by, key, [vec], keep, "d double", vectors=[vec]).select("d"), ["d"], out="i")
    at = lambda w: F.max(F.when(F.col("i") == w - before + 1, F.col("d")))
    return vals.agg((at(want[0]) + (at(want[1]) - at(want[0])) * (pos - want[0])).alias("q"), F.lit(total).alias("n_pairs"))


def close_contrasting_pairs(points: DataFrame, by: Sequence[str], key: str, vec: str, y: str, max_dist: float, min_diff: float) -> DataFrame:
    """Pairs of a group at most `max_dist` apart whose phenotypes differ by at least `min_diff`."""
    def kernel(a, b, same):
        d = distances(a[vec], b[vec])
        dy = a[y][:, None] - b[y][None, :]
        ok = (d <= max_dist) & (np.abs(dy) >= min_diff)
        if same:
            ok &= np.triu(np.ones_like(ok), 1)
        i, j = np.nonzero(ok)
        x, z = a[key][i], b[key][j]
        sw = x > z
        return {"a": np.where(sw, z, x), "b": np.where(sw, x, z), "distance": d[i, j], "y_diff": np.where(sw, -dy[i, j], dy[i, j])}

    t = dict(points.dtypes)[key]
    return chunk_pairs(points, by, key, [vec, y], kernel, f"a {t}, b {t}, distance double, y_diff double", vectors=[vec])


# ---- pair scores between alignment columns --------------------------------

def site_pair_tables(sites: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Run fn(C, alleles_i, alleles_j) on the allele-by-allele table of every two sites.

    One 0/1 vector per sample and gene; gene blocks are multiplied pairwise, so samples
    stay distributed and only gene x gene tables are held by a task.
    """
    s = sites.where((F.col("allele") != "-") & F.col("id").isNotNull())
    lv = (s.select("gene", "pos", "allele").distinct().groupBy("gene")
          .agg(F.array_sort(F.collect_list(F.struct("pos", "allele"))).alias("levels")))
    # a join on the gene would send all samples to as many tasks as there are genes; the levels are bounded by the alignment
    table = lv.agg(F.array_sort(F.collect_list(F.struct("gene", "levels")))).scalar()
    # one shuffle: sites of a sample meet first per gene, then for pairs of genes
    per = s.select("gene", "id", "pos", "allele").repartition("id").groupBy("gene", "id").agg(F.collect_list(F.struct("pos", "allele")).alias("own"))
    code = lambda g, own: F.transform(g["levels"], lambda l: F.array_contains(own, l).cast("double"))
    own = per.withColumn("_t", table).select("gene", "id", code(F.filter("_t", lambda g: g["gene"] == F.col("gene"))[0], F.col("own")).alias("x"))
    side = own.groupBy("id").agg(F.collect_list(F.struct("gene", "x")).alias("_x"))
    two = side.select(F.explode("_x").alias("a"), "_x").select("a", F.explode("_x").alias("b")).where("a.gene <= b.gene")
    z = two.select(F.col("a.gene").alias("gene_a"), F.col("b.gene").alias("gene_b"),
                   F.when(F.col("a.gene") == F.col("b.gene"), F.col("a.x")).otherwise(F.concat("a.x", "b.x")).alias("z"))
    g = gram(z, F.col("z"), ["gene_a", "gene_b"])
    g = g.join(lv.select(F.col("gene").alias("gene_a"), F.col("levels").alias("la")), "gene_a").join(
        lv.select(F.col("gene").alias("gene_b"), F.col("levels").alias("lb")), "gene_b")

    def each(row):
        m = unpack(row["_gram"])[1:, 1:]
        la = [(x["pos"], x["allele"]) for x in row["la"]]
        same = row["gene_a"] == row["gene_b"]
        lb = la if same else [(x["pos"], x["allele"]) for x in row["lb"]]
        off = 0 if same else len(la)
        ia: dict = {}
        ib: dict = {}
        for i, (p, _) in enumerate(la):
            ia.setdefault(p, []).append(i)
        for i, (p, _) in enumerate(lb):
            ib.setdefault(p, []).append(i)
        for p, ri in ia.items():
            for q, ci in ib.items():
                if same and q <= p:
                    continue
                c = m[np.ix_(ri, [off + i for i in ci])]
                for res in fn(c, [la[i][1] for i in ri], [lb[i][1] for i in ci]):
                    yield int(p), int(q), *res

    return _expand(g, ["gene_a", "gene_b"], f"pos_a int, pos_b int, {schema}", each)


def cramers_v_panel(sites: DataFrame, min_n: int = 100, within_gene: bool = True) -> DataFrame:
    def fn(c, _a, _b):
        n = c.sum()
        c = c[c.sum(1) > 0][:, c.sum(0) > 0]
        k = min(c.shape) if c.size else 0
        if n >= min_n and k > 1:
            e = np.outer(c.sum(1), c.sum(0)) / n
            yield int(n), float(np.sqrt(((c - e) ** 2 / e).sum() / (n * (k - 1))))

    r = site_pair_tables(sites, fn, "n bigint, v double")
    return r.where("gene_a = gene_b").select(F.col("gene_a").alias("gene"), "pos_a", "pos_b", "n", "v") if within_gene else r


def _moments(c, x, y):
    """n and centred second moments of row values x and column values y under counts c."""
    n = c.sum()
    ra, cb = c.sum(1), c.sum(0)
    mx, my = ra @ x / n, cb @ y / n
    xc, yc = x - mx, y - my
    return n, xc.T @ (ra[:, None] * xc), yc.T @ (cb[:, None] * yc), xc.T @ c @ yc


def rv_coefficients(sites: DataFrame, table: Mapping[str, Sequence[float]], min_obs: int = 10) -> DataFrame:
    """RV coefficient of the property vectors of every two sites over samples complete at both."""
    def fn(c, la, lb):
        i = [k for k, a in enumerate(la) if a in table]
        j = [k for k, a in enumerate(lb) if a in table]
        if not i or not j:
            return
        c = c[np.ix_(i, j)]
        if c.sum() < min_obs:
            return
        x = np.array([table[la[k]] for k in i], float)
        y = np.array([table[lb[k]] for k in j], float)
        n, sx, sy, sxy = _moments(c, x, y)
        den = np.sqrt((sx ** 2).sum() * (sy ** 2).sum())
        yield int(n), (float((sxy ** 2).sum() / den) if den > 0 else None)

    return site_pair_tables(sites, fn, "n bigint, rv double")


def residue_covariance(sites: DataFrame, codes: Mapping[str, float], min_n: int = 100) -> DataFrame:
    """Pairwise-complete sample covariance of integer-coded residues."""
    def fn(c, la, lb):
        x = np.array([[codes[a]] for a in la], float)
        y = np.array([[codes[b]] for b in lb], float)
        if c.sum() < min_n:
            return
        n, _, _, sxy = _moments(c, x, y)
        yield int(n), float(sxy[0, 0] / (n - 1))

    return site_pair_tables(sites, fn, "n bigint, cov double")


def block_summary(pairs: DataFrame, score: str) -> DataFrame:
    """Within / between gene mean, median, sd and count of pair scores."""
    p = pairs.where(F.col(score).isNotNull()).withColumn("kind", F.when(F.col("gene_a") == F.col("gene_b"), "within").otherwise("between"))
    m = p.groupBy("gene_a", "gene_b", "kind").agg(F.count("*").alias("n_pairs"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"))
    q = quantiles(p, score, {"median": 0.5}, ["gene_a", "gene_b"]).drop("n")
    return join_same(m, q, ["gene_a", "gene_b"])


def apc_correct(couplings: DataFrame, min_sep: int = 5, top: float = 0.05) -> DataFrame:
    """score - mean_i * mean_j / mean, long-range pairs only, flagged when in the top share."""
    ends = couplings.select(F.explode(F.array("i", "j")).alias("k"), "score")
    m = ends.groupBy("k").agg(F.avg("score").alias("_m"))
    overall = couplings.agg(F.avg("score")).scalar()
    c = (couplings.join(m.select(F.col("k").alias("i"), F.col("_m").alias("_mi")), "i").join(m.select(F.col("k").alias("j"), F.col("_m").alias("_mj")), "j"))
    c = c.withColumn("_o", overall).withColumn("apc", F.col("score") - ratio(F.col("_mi") * F.col("_mj"), F.col("_o")))
    c = c.where(F.abs(F.col("i") - F.col("j")) >= min_sep).select("i", "j", "score", "apc")
    cut = quantiles(c, "apc", {"q": 1 - top}).select("q").scalar()
    return c.withColumn("_q", cut).withColumn("is_top", F.col("apc") >= F.col("_q")).drop("_q")


def effective_sequences(df: DataFrame, seq: str, theta: float) -> DataFrame:
    """n, Neff = sum of 1 / #(identity >= theta) and Neff per column; identical copies are one weighted row."""
    u = df.groupBy(seq).agg(F.count("*").cast("double").alias("_w")).withColumn("_k", F.xxhash64(seq))
    u = u.withColumn("_v", F.transform(F.split(seq, ""), lambda ch: F.ascii(ch).cast("double")))

    def kernel(a, b, same):
        ident = (a["_v"][:, None, :] == b["_v"][None, :, :]).mean(2) >= theta
        k, s = [a["_k"]], [ident @ b["_w"]]
        if not same:
            k.append(b["_k"]); s.append(a["_w"] @ ident)
        return {"_k": np.concatenate(k), "_c": np.concatenate(s)}

    c = chunk_pairs(u, (), "_k", ["_v", "_w"], kernel, "_k bigint, _c double", vectors=["_v"]).groupBy("_k").agg(F.sum("_c").alias("_c"))
    j = u.join(c, "_k")
    return j.agg(F.sum("_w").cast("bigint").alias("n"), F.sum(F.col("_w") / F.col("_c")).alias("neff"), F.max(F.length(seq)).alias("len")).withColumn(
        "neff_per_site", F.col("neff") / F.col("len"))


def kinship_blocks(df: DataFrame, id: str, vec: str) -> DataFrame:
    """Centred X X^T / p as dense blocks: ids of both sides and the flattened block."""
    m = df.agg(vx.mean_vector(F.col(vec))).scalar()
    c = df.withColumn("_m", m).select(id, vx.subtract(F.col(vec), F.col("_m")).alias("_x"))

    def kernel(a, b, same):
        return {"ids_a": [a[id].tolist()], "ids_b": [b[id].tolist()], "block": [(a["_x"] @ b["_x"].T / a["_x"].shape[1]).ravel().tolist()], "is_diagonal": [bool(same)]}

    t = dict(df.dtypes)[id]
    return chunk_pairs(c, (), id, ["_x"], kernel, f"ids_a array<{t}>, ids_b array<{t}>, block array<double>, is_diagonal boolean", vectors=["_x"])


def kinship_totals(df: DataFrame, id: str, vec: str) -> DataFrame:
    """Self-kinship and sum over all partners per sample; blocks are added up in the task that forms them."""
    m = df.agg(vx.mean_vector(F.col(vec))).scalar()
    c = df.withColumn("_m", m).select(id, vx.subtract(F.col(vec), F.col("_m")).alias("_x"))

    def kernel(a, b, same):
        k = a["_x"] @ b["_x"].T / a["_x"].shape[1]
        if same:
            return {id: a[id], "self": np.diag(k), "total": k.sum(1)}
        return {id: np.concatenate([a[id], b[id]]), "self": np.zeros(sum(k.shape)), "total": np.concatenate([k.sum(1), k.sum(0)])}

    t = dict(df.dtypes)[id]
    r = chunk_pairs(c, (), id, ["_x"], kernel, f"`{id}` {t}, self double, total double", vectors=["_x"])
    return r.groupBy(id).agg(F.sum("self").alias("self_kinship"), F.sum("total").alias("row_sum"))


def kinship_summary(blocks: DataFrame, id: str) -> DataFrame:
    """Self-kinship and sum over all partners per sample, from the blocks."""
    t = dict(blocks.dtypes)["ids_a"][6:-1]

    def run(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                m = np.asarray(r["block"]).reshape(len(r["ids_a"]), len(r["ids_b"]))
                if r["is_diagonal"]:
                    out.append(pd.DataFrame({id: r["ids_a"], "self": np.diag(m), "total": m.sum(1)}))
                else:
                    out.append(pd.DataFrame({id: r["ids_a"], "self": 0.0, "total": m.sum(1)}))
                    out.append(pd.DataFrame({id: r["ids_b"], "self": 0.0, "total": m.sum(0)}))
            yield pd.concat(out)

    return blocks.mapInPandas(run, f"`{id}` {t}, self double, total double").groupBy(id).agg(F.sum("self").alias("self_kinship"), F.sum("total").alias("row_sum"))


def position_differences(a: np.ndarray, b: np.ndarray, gap: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Differing and compared positions of all pairs of two blocks of vectors, by one product per value."""
    ok_a, ok_b = (np.ones(x.shape) if gap is None else (x != gap).astype(float) for x in (a, b))
    compared = ok_a @ ok_b.T
    same = sum(((a == x) * ok_a) @ ((b == x) * ok_b).T for x in np.intersect1d(a, b) if gap is None or x != gap)
    return np.rint(compared - same), np.rint(compared)


def raw_distance_quantile(df: DataFrame, key: str, vec: str, p: float, gap: float | None = None, sample: int = 2000, seed: int = 42) -> DataFrame:
    """(q, n): exact quantile of the differing share of compared positions over all pairs of `sample` points taken in MD5
    order (all, if fewer); pairs without a common position are left out.  A pair kernel returns counts per
    (differing, compared), so no list of distances is formed."""
    some = materialize(df.select(key, vec).orderBy(draw(key, seed=seed), key).limit(sample))

    def count(a, b, same):
        diff, compared = position_differences(a[vec], b[vec], gap)
        on = np.triu_indices(len(diff), 1) if same else np.indices(diff.shape).reshape(2, -1)
        pairs = np.column_stack([diff[tuple(on)], compared[tuple(on)]])
        kinds, n = np.unique(pairs[pairs[:, 1] > 0], axis=0, return_counts=True)
        return {"d": kinds[:, 0].astype(int), "c": kinds[:, 1].astype(int), "n": n}

    counts = chunk_pairs(some, [], key, [vec], count, "d int, c int, n bigint", vectors=[vec]).groupBy("d", "c").agg(F.sum("n").alias("_n"))
    return quantiles(counts.select((F.col("d") / F.col("c")).alias("x"), "_n"), "x", {"q": p}, weight=F.col("_n"))


def collapse_by_distance(df: DataFrame, by: Sequence[str], key: str, vec: str, p: float = 0.001, gap: float | None = None, sample: int = 2000) -> DataFrame:
    """Representatives as in `greedy_collapse`, where close means a raw distance of at most the `p` quantile of all
    distances (of a sample over all groups)."""
    cut = raw_distance_quantile(df, key, vec, p, gap, sample).first()
    return greedy_collapse(df, by, key, vec, None, gap, cut["q"] if cut and cut["q"] is not None else 0.0)


def greedy_collapse(df: DataFrame, by: Sequence[str], key: str, vec: str, max_diff: int | None, gap: float | None = None, max_share: float | None = None) -> DataFrame:
    """Representatives of each group: taking keys in order, a point within `max_diff` differences of an earlier
    representative belongs to the smallest such one, any other point becomes a representative.  Positions where
    either point holds `gap` are not compared.  With `max_share` the cut is on differences per compared position, and
    points without a common position are apart.

    Same result as the sequential pass: each round passes over the first `BLOCK_ROWS` undecided points of every group
    in one task, then drops the points near its representatives; when all representatives are known, every point takes
    its smallest one.  So a group needs one round per block of points that are no copies and near no earlier representative.
    """
    def close(a, b):
        diff, compared = position_differences(a, b, gap)
        return diff <= max_diff if max_share is None else (compared > 0) & (diff <= max_share * compared + 1e-12)

    t = dict(df.dtypes)[key]
    by_list = list(by)
    # a point of gaps alone lies near none, not even its copies
    alone = F.lit(False) if max_share is None or gap is None else F.forall(vec, lambda x: x == gap)
    known = df.dropna(subset=[*by, key, vec])
    lone = known.where(alone).select(*by, key, F.col(key).alias("representative"))
    pts = materialize(known.where(~alone).groupBy(*by, vec).agg(F.min(key).alias(key)))

    def pass_over(pdf):
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        v = np.vstack(pdf[vec]).astype(float)
        free = np.ones(len(v), bool)
        reps = []
        for i in range(len(v)):
            if free[i]:
                reps.append(i)
                free[i + 1:] &= ~close(v[i:i + 1], v[i + 1:])[0]
        return pdf.iloc[reps][[*by_list, key, vec]]

    def absorbed(a, b, same):
        near = close(a[vec], b[vec])
        first = np.where(near, b[key][None, :], np.iinfo(np.int64).max).min(1)
        hit = near.any(1)
        return {key: a[key][hit], "_rep": first[hit]}

    nearest = lambda p, reps: chunk_pairs(p, by, key, [vec], absorbed, f"`{key}` {t}, _rep {t}", vectors=[vec], other=reps)
    undecided, found = pts, None
    while True:
        block = undecided.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(key))).where(F.col("_i") <= BLOCK_ROWS).drop("_i")
        reps = materialize(block.select(*by, key, vec).groupBy(*by).applyInPandas(pass_over, pts.select(*by, key, vec).schema))
        found = reps if found is None else found.union(reps)
        rest = undecided.join(block.select(*by, key), [*by, key], "left_anti")
        undecided = materialize(rest.join(nearest(rest, reps).select(*by, key).distinct(), [*by, key], "left_anti"))
        if undecided.isEmpty():
            break
    final = nearest(pts, found).unionByName(found.select(*by, key, F.col(key).alias("_rep"))).groupBy(*by, key).agg(F.min("_rep").alias("representative"))
    done = pts.join(final, [*by, key]).select(*by, vec, "representative")
    return df.join(done, [*by, vec]).select(*by, key, "representative").unionByName(lone)


def profile_similarity(cors: DataFrame, gene: str, dim: str, r: str) -> DataFrame:
    """Correlation between the per-dimension profiles of every two genes."""
    prof = cors.groupBy(gene).agg(F.transform(F.array_sort(F.collect_list(F.struct(dim, F.coalesce(F.col(r), F.lit(0.0)).alias("r")))), lambda x: x["r"]).alias("v"))
    mean = prof.withColumn("_m", F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"))
    return group_cosines(mean.select(gene, F.transform("v", lambda x: x - F.col("_m")).alias("v")), gene, "v").withColumnRenamed("cosine", "r")


def pc_vs_raw(df: DataFrame, vec: str, y: str, by: Sequence[str], k: int, min_n: int = 10) -> DataFrame:
    """Per group: correlation with y of each component and each raw dimension, from one cross-product."""
    def fn(row):
        n, _, s = centred(unpack(row["_gram"]))
        if n < min_n:
            return
        sxx, sxy, syy = s[:-1, :-1], s[:-1, -1], s[-1, -1]
        val, w, _, _ = _components(sxx, n, k, False)
        for i in range(len(val)):
            den = np.sqrt(val[i] * (n - 1) * syy)
            yield "pc", i + 1, int(n), (float(w[i] @ sxy / den) if den > 0 else None)
        for i in range(len(sxy)):
            den = np.sqrt(sxx[i, i] * syy)
            yield "raw", i, int(n), (float(sxy[i] / den) if den > 0 else None)

    g = gram(df, F.concat(F.col(vec), F.array(F.col(y).cast("double"))), by).drop("n")
    return _expand(g, by, "kind string, dim int, n bigint, r double", fn)


# ---- spatial autocorrelation ----------------------------------------------

#: Least and most places of a chunk.
PLACES = (1 << 12, 1 << 16)


def _places(points: DataFrame, by: Sequence[str], key: str, coord: str, z: str) -> DataFrame:
    """One row per place: its smallest key, points `_c`, sums of z, z^2 and z^4 (`_s`, `_q`, `_f`), `_i` (position in the group along a
    curve on which near places mostly follow each other) and `_known` (whether distances are defined).  Weights depend on places alone."""
    zz = F.col(z) * F.col(z)
    p = points.groupBy(*by, coord).agg(F.min(key).alias(key), F.count("*").cast("double").alias("_c"), F.sum(z).alias("_s"), F.sum(zz).alias("_q"), F.sum(zz * zz).alias("_f"))
    known = F.forall(coord, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    p = materialize(p.withColumn("_known", F.coalesce(known, F.lit(False))))
    sides = p.where("_known").select(F.posexplode(coord).alias("_j", "_x")).groupBy("_j").agg(F.min("_x").alias("low"), F.max("_x").alias("high")).orderBy("_j").collect()
    low, high = (np.array([r[c] for r in sides], float) for c in ("low", "high"))

    @F.pandas_udf("bigint")
    def curve(v: pd.Series) -> pd.Series:
        return pd.Series(z_order(np.vstack(v).astype(float), low, high) if len(v) and len(low) else np.zeros(len(v), np.int64))

    return materialize(row_index(p.withColumn("_code", curve(coord)), ["_code", key], by, "_i").drop("_code"))


def _place_pairs(places: DataFrame, by: Sequence[str], cols: Sequence[str], coord: str, kernel: Callable, schema: str) -> DataFrame:
    n = places.count()
    rows = min(PLACES[1], max(PLACES[0], n // 16))
    return chunk_pairs(places, by, "_i", cols, kernel, schema, vectors=[coord], chunk_rows=rows, position="_i", most_tasks=(n // rows + 1) * (n // rows + 2) // 2)


def _trees(blocks: Sequence[dict], coord: str, size: int) -> tuple[list, list]:
    on = [np.isfinite(x[coord]).all(1) for x in blocks]
    return on, [Boxes(x[coord][o], size) if o.any() else None for x, o in zip(blocks, on)]


def _weighted_sums(coord: str, max_dist: float | None, names: Sequence[str], charges: Callable) -> Callable:
    """Kernel: per place the sums of w q and w^2 q2 over the places of the other chunk, (q, q2) = charges(chunk), under `names`."""
    def kernel(a, b, same):
        blocks = [a] if same else [a, b]
        on, trees = _trees(blocks, coord, SMOOTH_LEAF if max_dist is None else BORDER_LEAF)
        q, q2 = zip(*[[np.nan_to_num(np.column_stack(c)[o].astype(float)) for c in charges(x)] for x, o in zip(blocks, on)])
        out = [np.zeros((len(o), len(names))) for o in on]
        if all(t is not None for t in trees):
            if max_dist is None:
                ends = [inverse_sums(t, u, 0.001, c, c2) for t, u, c, c2 in zip(trees, trees[::-1], q[::-1], q2[::-1])]
            else:
                ends = within_sums(trees[0], trees[-1], max_dist, np.hstack([q[0], q2[0]]), np.hstack([q[-1], q2[-1]]))
            for o, x, total in zip(out, on, ends):
                o[x] = total
        return {"_i": np.concatenate([x["_i"] for x in blocks]), **dict(zip(names, np.vstack(out).T))}

    return kernel


def morans_i(points: DataFrame, key: str, coord: str, x: str, max_dist: float | None = None, row_standardise: bool = True,
             by: Sequence[str] = (), randomised: bool = False) -> DataFrame:
    """Moran's I with its expectation and variance: that of normal values or, with `randomised`, that of the given values
    dealt to the places at random (it depends on their kurtosis), then with a two-sided p-value.

    Weights are 1/(d + 0.001) or a distance cutoff.  Chunks of near places meet in tasks, where boxes of places are summed
    together (`fields`); only row sums leave a task.  Points of one place are counted, not compared.  Without a
    defined distance between all points inverse weights give no row.
    """
    st = points.groupBy(*by).agg(F.avg(x).alias("_mean"))
    p = join_same(points, st, list(by)) if by else points.withColumn("_mean", st.scalar())
    p = _places(p.withColumn("_z", F.col(x) - F.col("_mean")), by, key, coord, "_z")
    at0 = 1 / 0.001 if max_dist is None else 0.0  # between two points of one place

    def pairs(q, names, cols, charges):
        schema = "_i bigint, " + ", ".join(f"{n} double" for n in names)
        r = _place_pairs(q, by, [coord, *cols], coord, _weighted_sums(coord, max_dist, names, charges), schema)
        return join_same(q, r.groupBy(*by, "_i").agg(*[F.sum(n).alias(n) for n in names]), [*by, "_i"])

    q = pairs(p, ["_w", "_wz", "_sq"], ["_c", "_s"], lambda a: ([a["_c"], a["_s"]], [a["_c"]]))
    q = materialize(q.withColumn("_w", F.col("_w") + (F.col("_c") - 1) * at0))
    q = q.withColumn("_rw", F.when(F.col("_w") > 0, F.col("_w")) if row_standardise else F.lit(1.0))
    q = q.withColumn("_inv", F.coalesce(ratio(1, F.col("_rw")), F.lit(0.0)))
    f = pairs(q, ["_col", "_sqcol"], ["_c", "_inv"], lambda a: ([a["_c"] * a["_inv"]], [a["_c"] * a["_inv"]]))
    c, s, inv = F.col("_c"), F.col("_s"), F.col("_inv")
    row, col = F.col("_w") * inv, F.col("_col") + (c - 1) * at0 * inv
    num = (s * F.col("_wz") + (s * s - F.col("_q")) * at0) * inv
    # half the sum of (w_ij + w_ji)^2
    s1 = c * inv * (inv * F.col("_sq") + F.col("_sqcol")) + c * (c - 1) * 2 * (inv * at0) ** 2
    m = f.groupBy(*by).agg(F.sum("_c").alias("_n"), F.sum(c * row).alias("_s0"), F.when(F.count("_s") == F.count("*"), F.sum(num)).alias("_num"), F.sum("_q").alias("_z2"),
                           F.sum("_f").alias("_z4"), F.sum(s1).alias("_s1"), F.sum(c * (row + col) ** 2).alias("_s2"), F.bool_and("_known").alias("_known"))
    N, s0, s1, s2 = (F.col(k) for k in ("_n", "_s0", "_s1", "_s2"))
    ei = ratio(-1, N - 1)
    if randomised:
        k = ratio(N * F.col("_z4"), F.col("_z2") * F.col("_z2"))
        var = ratio(N * ((N * N - 3 * N + 3) * s1 - N * s2 + 3 * s0 * s0) - k * (N * (N - 1) * s1 - 2 * N * s2 + 6 * s0 * s0), (N - 1) * (N - 2) * (N - 3) * s0 * s0) - ei * ei
    else:
        var = ratio(N * N * s1 - N * s2 + 3 * s0 * s0, (N * N - 1) * s0 * s0) - ei * ei
    if max_dist is None:
        m = m.where("_known")
    m = m.where((N > 2) & (s0 > 0)).select(*by, N.cast("bigint").alias("n"), ratio(N / s0 * F.col("_num"), F.col("_z2")).alias("moran_i"), ei.alias("expected"), var.alias("variance"))
    m = m.withColumn("z", ratio(F.col("moran_i") - F.col("expected"), F.sqrt("variance")))
    return m.withColumn("p_value", norm_p("z")) if randomised else m


def correlogram(points: DataFrame, key: str, coord: str, x: str, breaks: Sequence[float], min_pairs: int = 10) -> DataFrame:
    """Moran's I per distance class (breaks[c], breaks[c+1]] with 0/1 weights; only class totals leave a task."""
    mean = points.agg(F.avg(x)).scalar()
    p = _places(points.withColumn("_m", mean).withColumn("_z", F.col(x) - F.col("_m")), (), key, coord, "_z")
    edges = np.asarray(breaks, float)
    k, at0 = len(edges) - 1, int(np.searchsorted(edges, 0.0)) - 1

    def kernel(a, b, same):
        blocks = [a] if same else [a, b]
        on, trees = _trees(blocks, coord, BORDER_LEAF)
        n, zz = np.zeros(k), np.zeros(k)
        if all(t is not None for t in trees):
            ends = [(x["_c"][o], np.nan_to_num(x["_s"].astype(float))[o]) for x, o in zip(blocks, on)]
            n, zz = class_sums(trees[0], trees[-1], edges, *ends[0], *ends[-1])
            if same:
                c, s = ends[0]
                if 0 <= at0 < k:  # pairs of two points of one place
                    n[at0] += (c * (c - 1)).sum()
                    zz[at0] += (s * s - np.nan_to_num(a["_q"].astype(float))[on[0]]).sum()
                n, zz = n / 2, zz / 2
        return {"cls": np.arange(k), "_n": np.rint(n).astype(np.int64), "_z": zz}

    tot = p.agg(F.struct(F.sum("_c").alias("n"), F.sum("_q").alias("z2"))).scalar()
    g = _place_pairs(p, (), [coord, "_c", "_s", "_q"], coord, kernel, "cls int, _n bigint, _z double").groupBy("cls").agg(F.sum("_n").alias("n_pairs"), F.sum("_z").alias("_s"))
    g = g.where(F.col("n_pairs") >= min_pairs).withColumn("_t", tot)
    return g.select("cls", "n_pairs", ratio(F.col("_t.n") / F.col("n_pairs") * F.col("_s"), F.col("_t.z2")).alias("moran_i"))
