"""Hand-made cases and brute-force comparisons for what SQL does not check."""
import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cladeloom.functions.arith import draw
from cladeloom.functions import names as nm, scales as sc, sequence as sq, special as sp, vectors as vx
from cladeloom.operators import gram as gr
from cladeloom.operators import aggregates as ag, assoc as az, filters as fl, joins as jn, jumps, matrix as mx, ordered as od, pairs as pr, sequences as so, sets as st, sites as si, stats as sx, structure as sr, tree as tr


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_fourfold_gc_micro(spark):
    assert one(spark, sq.fourfold_gc(F.lit("ATGCATCATGTG"))) == 1.0
    assert one(spark, sq.fourfold_gc(F.lit("ATGCATCATGTGGTA"))) == 0.5
    assert one(spark, sq.fourfold_gc(F.lit("CCCGTG"))) is None


def test_names_micro(spark):
    assert one(spark, nm.accession_from_filename(F.lit("AP0004231fa"), "fa")) == "AP000423.1"
    assert one(spark, nm.species_name(F.lit("Quercus cf. robur var. x"))) == "Quercus robur"
    assert one(spark, nm.year_from_date(F.lit("03-MAY-2019"))) in (2019, None)
    assert one(spark, nm.year_from_date(F.lit("Unknown"))) is None
    assert one(spark, nm.order_from_taxonomy(F.lit("Eukaryota; Rosales ;Rosaceae"))) == "Rosales"


def test_codon_usage_null_when_out_of_frame(spark):
    df = spark.createDataFrame([(1, "ATGATG"), (2, "ATGA")], "id int, cds string")
    rows = {(r.id, r.codon): r.freq for r in so.codon_usage(df, "id", "cds").collect()}
    assert rows == {(1, "ATG"): 1.0, (2, None): None}


def test_canonical_kmers(spark):
    dna = "ACGTTGCANNACGGT"
    comp = str.maketrans("ACGT", "TGCA")
    want = [min(k, k.translate(comp)[::-1]) for k in (dna[i:i + 4] for i in range(len(dna) - 3))]
    assert one(spark, sq.canonical_pieces(F.lit(dna), 4)) == want


def test_supermatrix_micro(spark):
    a = [("A", i + 1, s, c) for s, q in (("1", "AAAA"), ("2", "AA-A")) for i, c in enumerate(q)]
    b = [("B", i + 1, s, c) for s, q in (("1", "T--T"), ("2", "TTTT")) for i, c in enumerate(q)]
    df = spark.createDataFrame(a + b, "gene string, pos int, id string, allele string")
    assert {r.id: r.seq for r in si.supermatrix(df).collect()} == {"1": "AAAAT--T", "2": "AA-ATTTT"}
    assert {(r.gene, r.gene_pos, r.global_pos) for r in si.partition_map(df).collect()} == {("A", i, i) for i in range(1, 5)} | {("B", i, i + 4) for i in range(1, 5)}


def test_property_expansion(spark):
    t = {"W": (1.2, .8, .5), "A": (.2, .3, .1)}
    df = spark.createDataFrame([("g", 1, "x", "W"), ("g", 2, "x", "A"), ("g", 3, "x", "?")], "gene string, pos int, id string, allele string")
    rows = [r.vec for r in si.aa_to_vector(df, t, unknown_zero=True).orderBy("pos").collect()]
    assert rows == [[1.2, .8, .5], [.2, .3, .1], [0.0, 0.0, 0.0]]


def test_likelihood_ratio(spark):
    df = spark.createDataFrame([(-4727634.696, -4727612.807, 19)], "a double, b double, k int")
    r = sx.likelihood_ratio(df, "a", "b", "k").first()
    assert abs(r.statistic - 43.778) < 1e-6
    assert 0.0009 < r.p_value < 0.0012


def test_tails_closed_forms():
    assert np.allclose(sp.betainc(1, 3, 0.3), 1 - 0.7 ** 3)
    assert np.allclose(sp.chi2_sf([3.0, 50.0], 2), np.exp([-1.5, -25.0]))
    assert np.allclose(sp.t_sf2(1.0, 1), 0.5)                      # Cauchy
    assert np.allclose(sp.f_sf(2.5, 2, 10), (1 + 0.5) ** -5.0)
    assert np.allclose(sp.norm_sf2(1.959963984540054), 0.05)
    assert abs(sp.chi2_1_isf(0.05) - 3.841458820694124) < 1e-9
    assert abs(sp.binom_two_sided(8, 10, 0.5) - 0.109375) < 1e-12
    o, p = sp.fisher_exact(3, 1, 1, 3)
    assert abs(p - 0.4857142857) < 1e-9 and abs(o - 6.408309) < 1e-4


def test_tails_of_small_statistics_with_many_degrees_of_freedom():
    """At these sizes the two laws lie within 1e-11 of the normal one, which needs no difference of numbers near 1."""
    for f in (8.6e-10, 5e-10, 4.9e-6):
        for n in (899_998.0, 5_399_998.0):
            want = math.erfc(math.sqrt(f / 2))
            assert abs(float(sp.f_sf(f, 1.0, n)) - want) < 1e-9
            assert abs(float(sp.t_sf2(math.sqrt(f), n)) - want) < 1e-9
    # a closed form: with two degrees above, (1 + 2 f / d) ** (-d / 2)
    assert abs(float(sp.f_sf(1.5, 2.0, 5_399_998.0)) - math.exp(-2_699_999.0 * math.log1p(3 / 5_399_998.0))) < 1e-12


def test_quantiles_with_one_group_holding_most_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    rows = [("hot" if i % 3 else f"k{i % 7}", float(v)) for i, v in enumerate(x)] + [("hot", 0.5)] * 500 + [("solo", 2.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(13)
    got = {r.k: (r.q1, r.q5, r.q9) for r in od.quantiles(df, "x", {"q1": 0.1, "q5": 0.5, "q9": 0.9}, ["k"]).collect()}
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    assert set(got) == set(by)
    for k, v in by.items():
        assert np.allclose(got[k], np.quantile(v, [0.1, 0.5, 0.9]))


def test_running_sum_and_index_match_plain_order(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("g"))
    got = {(r.g, r.id): r.s for r in od.running_sums(df, {"s": F.col("v")}, ["id"], ["g"]).collect()}
    tot = {0: 0, 1: 0}
    for i in range(5000):
        g = 1 if i % 3 == 0 else 0
        tot[g] += i % 7
        assert got[(g, i)] == tot[g]
    idx = od.row_index(df, ["id"]).agg(F.min("row_no"), F.max("row_no"), F.count_distinct("row_no")).first()
    assert tuple(idx) == (1, 5000, 5000)


def test_halo_buckets_keep_frames_whole(spark):
    df = spark.range(1000).select(F.lit("hot").alias("g"), "id", (F.col("id") % 13).cast("double").alias("x"))
    from pyspark.sql import Window
    h = od.halo_buckets(df, ["id"], ["g"], before=3, after=3, size=50)
    w = Window.partitionBy("g", "_bucket").orderBy("_i").rowsBetween(-3, 3)
    got = {r.id: (r.n, r.m) for r in h.withColumn("n", F.count("x").over(w)).withColumn("m", F.sum("x").over(w)).where("_own").collect()}
    assert len(got) == 1000
    for i in range(1000):
        win = [j % 13 for j in range(max(0, i - 3), min(1000, i + 4))]
        assert got[i] == (len(win), float(sum(win)))


def test_bh_brute_force(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.uniform(size=300) ** 2, 3)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double")
    o = np.argsort(p, kind="stable")
    q = np.empty(300)
    run = 1.0
    for r in range(299, -1, -1):
        run = min(run, p[o[r]] * 300 / (r + 1))
        q[o[r]] = run
    got = {r.i: r.p_bh for r in sx.p_adjust(df, "p").collect()}
    assert all(abs(got[i] - q[i]) < 1e-12 for i in range(300))


def test_chunk_pairs_visits_every_pair_once(spark):
    df = spark.range(300).select(F.when(F.col("id") < 250, "hot").otherwise("b").alias("g"), "id", F.col("id").cast("double").alias("x"))

    def kernel(a, b, same):
        n = len(a["id"]) * (len(a["id"]) - 1) // 2 if same else len(a["id"]) * len(b["id"])
        return {"n": np.array([n])}

    r = {x.g: x.n for x in pr.chunk_pairs(df, ["g"], "id", ["x"], kernel, "n bigint", chunk_rows=16).groupBy("g").agg(F.sum("n").alias("n")).collect()}
    assert r == {"hot": 250 * 249 // 2, "b": 50 * 49 // 2}


def test_mad_outlier_drops_far_point(spark):
    rows = [(1, i, 10.0 + i * 0.01, 20.0) for i in range(30)] + [(1, 99, -60.0, -150.0), (2, 100, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sp int, id bigint, lat double, lon double")
    out = {(r.sp, r.lat): r.is_outlier for r in ag.mad_outliers(df, "sp", "id", "lat", "lon", 10.0).collect()}
    assert out[(1, -60.0)] and not out[(2, 1.0)] and sum(out.values()) == 1


def test_site_scan_against_least_squares(spark):
    rng = np.random.default_rng(5)
    n = 120
    z = rng.normal(size=(n, 3))
    res = rng.choice(list("ARN-"), size=(n, 2))
    y = z @ [1, 0, -1] + (res[:, 0] == "A") * 1.5 + rng.normal(size=n)
    sites = spark.createDataFrame([("g", j + 1, f"s{i}", str(res[i, j])) for i in range(n) for j in range(2)], "gene string, pos int, id string, allele string")
    tr_ = spark.createDataFrame([(f"s{i}", float(y[i]), [float(v) for v in z[i]]) for i in range(n)], "id string, y double, z array<double>")
    got = {r.pos: r for r in az.site_scan(sites, tr_).collect()}

    def rss(x):
        x = np.column_stack([np.ones(n), *x]) if len(x) else np.ones((n, 1))
        b, *_ = np.linalg.lstsq(x, y, rcond=None)
        return ((y - x @ b) ** 2).sum(), b, x

    for j in range(2):
        lv = sorted(set(res[:, j]))
        ind = [(res[:, j] == a).astype(float) for a in lv[:-1]]
        r0, r1, r2 = rss([])[0], rss(ind)[0], rss(list(z.T))[0]
        r3, b, x = rss(ind + list(z.T))
        k, dof = len(lv) - 1, n - 1 - len(lv) - 2
        row = got[j + 1]
        assert abs(row.r2_aa - (1 - r1 / r0)) < 1e-9 and abs(row.r2_pcs - (1 - r2 / r0)) < 1e-9 and abs(row.r2_full - (1 - r3 / r0)) < 1e-9
        f = ((r2 - r3) / k) / (r3 / dof)
        assert abs(row.p_aa_with_pcs - float(sp.f_sf(f, k, dof))) < 1e-9
        cov = r3 / dof * np.linalg.inv(x.T @ x)
        for i, e in enumerate(row.effects):
            assert e.residue == lv[i] and abs(e.effect - b[i + 1]) < 1e-8 and abs(e.se - math.sqrt(cov[i + 1, i + 1])) < 1e-8
        assert sum(row.residue_counts.values()) == n


def _tree(n, rng):
    return [(k // 2, k, float(rng.uniform(0.5, 2))) for k in range(2, n + 1)]


def test_ancestral_trait_is_generalised_least_squares(spark):
    rng = np.random.default_rng(2)
    e = _tree(15, rng)
    length = {c: l for _, c, l in e}
    path = lambda k: [] if k == 1 else [k, *path(k // 2)]
    tips = range(8, 16)
    x = {t: float(rng.normal()) for t in tips}
    cov = lambda a, b: sum(length[k] for k in set(path(a)) & set(path(b)))
    v = np.array([[cov(a, b) for b in tips] for a in tips])
    vi, one_ = np.linalg.inv(v), np.ones(8)
    xv = np.array([x[t] for t in tips])
    mu = one_ @ vi @ xv / (one_ @ vi @ one_)
    edges = spark.createDataFrame(e, "parent bigint, child bigint, length double")
    td = spark.createDataFrame(list(x.items()), "node bigint, x double")
    got = {r.node: r.x for r in tr.ancestral_trait(edges, td, "x").collect()}
    assert abs(got[1] - mu) < 1e-9
    for k in range(2, 8):
        c = np.array([cov(k, t) for t in tips])
        assert abs(got[k] - (mu + c @ vi @ (xv - mu))) < 1e-9


def test_contrasts_recursion(spark):
    rng = np.random.default_rng(4)
    e = _tree(15, rng)
    length = {c: l for _, c, l in e}
    keep = {8, 9, 10, 12, 13, 15}
    x = {t: float(rng.normal()) for t in keep}
    con = {}

    def go(k):
        if k in x:
            return x[k], 0.0
        kids = [(c, go(c)) for c in (2 * k, 2 * k + 1) if c <= 15]
        kids = [(c, r) for c, r in kids if r is not None]
        if not kids:
            return None
        if len(kids) == 1:
            (c, (val, var)), = kids
            return val, var + length[c]
        (a, (va, sa)), (b, (vb, sb)) = kids
        sa, sb = sa + length[a], sb + length[b]
        con[k] = (va - vb) / math.sqrt(sa + sb)
        return (va / sa + vb / sb) / (1 / sa + 1 / sb), 1 / (1 / sa + 1 / sb)

    go(1)
    edges = spark.createDataFrame(e, "parent bigint, child bigint, length double")
    td = spark.createDataFrame(list(x.items()), "node bigint, x double")
    _, c = tr.upward_pass(edges, td, ["x"])
    got = {r.node: r.x for r in c.collect()}
    assert set(got) == set(con) and all(abs(got[k] - con[k]) < 1e-9 for k in con)


def test_uneven_tree_closure(spark):
    e = [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0), (5, 6, 1.0), (1, 7, 2.0), (3, 8, 0.5)]
    edges = spark.createDataFrame(e, "parent bigint, child bigint, length double")
    c = tr.ancestor_closure(edges)
    par = {b: a for a, b, _ in e}
    want = set()
    for k in par:
        a, s = par[k], 1
        while a is not None:
            want.add((a, k, s))
            a, s = par.get(a), s + 1
    assert {(r.ancestor, r.node, r.steps) for r in c.collect()} == want
    ix = {r.node: r for r in jumps.grow(edges).index.collect()}
    for a, k, _ in want:
        assert ix[a].tin < ix[k].tin and ix[k].tout <= ix[a].tout
    assert sorted(r.tin for r in ix.values()) == list(range(8))
    assert {r.node: r.depth for r in tr.level_depth(edges).collect()} == {k: r.depth for k, r in ix.items()}


def test_greedy_collapse_equals_sequential(spark):
    rng = np.random.default_rng(6)
    v = rng.integers(0, 3, size=(90, 6))
    df = spark.createDataFrame([("g", i, [float(a) for a in r]) for i, r in enumerate(v)], "g string, id bigint, v array<double>")
    rep, taken = {}, set()
    for i in range(90):
        if i in taken:
            continue
        for j in range(90):
            if j not in taken and (v[i] != v[j]).sum() <= 2:
                taken.add(j)
                rep[j] = i
    got = {r.id: r.representative for r in mx.greedy_collapse(df, ["g"], "id", "v", 2).collect()}
    assert set(got.values()) == set(rep.values())
    assert all((v[k] != v[r]).sum() <= 2 for k, r in got.items())


def test_stem_regions_against_stack(spark):
    seq, stc = "GCGGATTTAGCTCAGTTGGGAGAGCGCCAGACTGAAGATCTGGAGGTCCTGTGTTCGATCCACAGAATTCGCACCA", ">>>>>>>..>>>>........<<<<.>>>>>.......<<<<<.....>>>>>.......<<<<<<<<<<<<...."
    df = spark.createDataFrame([(1, seq, stc), (2, "ACGT", "<>.<"), (3, "AAAA", "....")], "id int, s string, b string")
    r = {x.id: x.asDict() for x in so.stem_regions(df, "id", "s", "b").collect()}
    gc = lambda t: sum(c in "GC" for c in t) / len(t)
    assert r[1]["acceptor_stem_len"] == 14 and r[1]["d_stem_len"] == 8 and r[1]["anticodon_stem_len"] == 10 and r[1]["t_stem_len"] == 10
    assert r[1]["d_loop_len"] == 8 and r[1]["anticodon_loop_len"] == 7 and r[1]["t_loop_len"] == 7 and r[1]["variable_loop_len"] == 5
    assert abs(r[1]["acceptor_stem_gc"] - gc(seq[:7] + seq[65:72])) < 1e-12
    assert abs(r[1]["anticodon_loop_gc"] - gc(seq[31:38])) < 1e-12
    assert r[2]["acceptor_stem_len"] == 2 and r[3]["total_stem_len"] == 0 and r[3]["total_stem_gc"] is None


def test_rv_of_a_site_with_its_copy_is_one(spark):
    rng = np.random.default_rng(8)
    a = rng.choice(list("ACDEF"), 200)
    b = rng.choice(list("GHIKL"), 200)
    rows = [("g", p, i, str(c[i])) for i in range(200) for p, c in ((1, a), (2, a), (3, b))]
    df = spark.createDataFrame(rows, "gene string, pos int, id int, allele string")
    rv = {(r.pos_a, r.pos_b): r.rv for r in mx.rv_coefficients(df, sc.KIDERA).collect()}
    assert abs(rv[(1, 2)] - 1) < 1e-9 and rv[(1, 3)] < 0.2


def test_pca_matches_numpy_and_batches(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "id int, b int, v array<double>")
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    m = mx.pca_fit(df, "v", 5)
    assert np.allclose([r.variance for r in m.orderBy("comp").collect()], want)
    assert np.allclose([r.variance for r in mx.pca_merge_batches(df, "v", 5, "b").orderBy("comp").collect()], want)
    s = np.array([r.pcs for r in mx.pca_transform(df, "v", m).orderBy("id").collect()])
    assert np.allclose(s.var(0, ddof=1), want) and np.allclose(s.mean(0), 0, atol=1e-9)


def test_ridge_cv_brute_force(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(60, 3))
    y = x @ [1, 2, 0] + rng.normal(size=60)
    df = spark.createDataFrame([("g", i, [float(v) for v in x[i]], float(y[i])) for i in range(60)], "g string, id int, v array<double>, y double")
    r = az.ridge_cv(df, ["g"], "v", "y", F.col("id") % 4, [0.1]).first()
    err = 0.0
    for f in range(4):
        te = np.arange(60) % 4 == f
        xm, ym = x[~te].mean(0), y[~te].mean()
        xc = x[~te] - xm
        b = np.linalg.solve(xc.T @ xc + 0.1 * len(xc) * np.eye(3), xc.T @ (y[~te] - ym))
        err += ((y[te] - ym - (x[te] - xm) @ b) ** 2).sum()
    assert abs(r.cve - err / 60) < 1e-9


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).withColumn("g", F.col("id") % 5)
    a = {r.id for r in st.sample_fraction(df.repartition(3), ["id"], 0.2).collect()}
    b = {r.id for r in st.sample_fraction(df.repartition(11), ["id"], 0.2).collect()}
    assert a == b and 300 < len(a) < 500
    s = st.stratified_balanced_sample(df, F.col("id") < 20, ["g"], ["id"], 7)
    n = {r.g: r.n for r in s.where("id >= 20").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert n == {g: 7 for g in range(5)} and s.where("id < 20").count() == 20


def test_permutation_is_reproducible_and_calibrated(spark):
    df = spark.range(400).withColumn("x", F.when(F.col("id") < 100, F.col("id") % 10 + 30).otherwise(F.col("id") % 10))
    a = sx.permutation_test(df.repartition(3), ["id"], "x", F.col("id") < 100, 49).first()
    b = sx.permutation_test(df.repartition(9), ["id"], "x", F.col("id") < 100, 49).first()
    assert a.p_value == b.p_value == 1 / 50 and abs(a.null_mean) < 3


def test_holdout_clades_do_not_overlap(spark):
    rng = np.random.default_rng(11)
    edges = spark.createDataFrame(_tree(511, rng), "parent bigint, child bigint, length double")
    h = [r.node for r in tr.select_holdout_clades(jumps.grow(edges), 0.2, 3, 10).collect()]
    anc = lambda k: {k >> j for j in range(1, 12)}
    assert h and not any(a in anc(b) for a in h for b in h)


def test_radius_count_in_a_crowded_cell(spark):
    rng = np.random.default_rng(12)
    p = np.vstack([rng.uniform(0, 1, size=(300, 3)), rng.uniform(-40, 40, size=(100, 3)), np.zeros((3, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(p)], "id bigint, p array<double>")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    want = ((d > 0) & (d <= 0.7)).sum(1)
    got = {r.id: r.n_within for r in jn.radius_count(df, "id", "p", 0.7, chunk_rows=32).collect()}
    assert all(got[i] == want[i] for i in range(len(p)))
    n = {(r.a, r.b) for r in jn.radius_pairs(df.where("id >= 290"), "id", "p", 5.0).collect()}
    assert n == {(i, j) for i in range(290, 403) for j in range(i + 1, 403) if d[i, j] < 5.0}


def test_random_impute_uses_observed_values(spark):
    df = spark.createDataFrame([("a", i, None if i % 3 == 0 else float(i)) for i in range(60)], "c string, id int, x double")
    out = si.impute(df, ["c"], "x", "random", key=["id"]).collect()
    assert len(out) == 60 and all(r.x is not None and r.x % 3 != 0 for r in out)


def test_reader_edge_cases(spark, tmp_path):
    from cladeloom.sources import readers as rd
    (tmp_path / "a.fasta").write_text(">s1|Gene_rbcL|Taxonomy:X;Y desc\nAC\nGT\n\n>s2 z\n;note\nTT\n")
    r = {x.id: (x.seq, x.file) for x in rd.read_fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert r == {"s1|Gene_rbcL|Taxonomy:X;Y": ("ACGT", "a"), "s2": ("TT", "a")}
    h = spark.createDataFrame([("s1|Gene_rbcL|Taxonomy:X;Y",), ("s3_matK_Rosa",)], "h string").select(*[c.alias(k) for k, c in rd.parse_header(F.col("h")).items()]).collect()
    assert [(x.id, x.gene) for x in h] == [("s1", "rbcL"), ("s3", "matK")]
    (tmp_path / "m.gb").write_text(
        "LOCUS       X1 900 bp DNA\nVERSION     X1.1\nFEATURES             Location/Qualifiers\n     source          1..900\n     CDS             complement(join(10..20,\n"
        "                     40..50))\n                     /gene=\"rps12\"\n                     /translation=\"MK\n                     V\"\nORIGIN\n//\n")
    f = [(x.genome_id, x.genome_size, x.gene, x.part_no, x.start, x.end, x.strand, x.translation) for x in rd.read_features(spark, str(tmp_path / "m.gb")).where("feature_type = 'CDS'").orderBy("part_no").collect()]
    assert f == [("X1.1", 900, "rps12", 1, 10, 20, -1, "MKV"), ("X1.1", 900, "rps12", 2, 40, 50, -1, "MKV")]


def test_classify_later_rule_wins_and_required_columns(spark):
    from cladeloom.schemas import require_columns
    df = spark.range(3).select("id", fl.classify([(F.col("id") >= 0, "a"), (F.col("id") >= 2, "b")], "z").alias("c"))
    assert [r.c for r in df.orderBy("id").collect()] == ["a", "a", "b"]
    with pytest.raises(ValueError):
        require_columns(df, "id", "nope")


def test_nearest_neighbour_stat_is_small_for_a_cluster(spark):
    rng = np.random.default_rng(13)
    p = np.vstack([rng.uniform(0, 1, size=(15, 3)), rng.uniform(-50, 50, size=(150, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(p)], "id bigint, p array<double>")
    r = sr.nearest_neighbour_stat(df, "id", "p", F.col("id") < 15, 29).first()
    assert r.p_value == 1 / 30 and r.observed < r.null_mean


# ---- degenerate groups and repaired answers --------------------------------

def test_degenerate_groups_give_null(spark):
    line = spark.createDataFrame([("line", float(i), 2.0 * i) for i in range(5)] + [("flat", 1.0, 1.0)] * 4, "g string, x double, y double")
    for method in ("pearson", "spearman"):
        r = {x["g"]: x for x in sx.corr_test(line, "x", "y", ["g"], method).collect()}
        assert abs(r["line"]["estimate"]) > 0.999999
    same = spark.createDataFrame([("a", "u", 1.0), ("a", "u", 1.0), ("a", "w", 1.0), ("a", "w", 1.0), ("b", "u", 1.0), ("b", "u", 2.0), ("b", "w", 3.0), ("b", "w", 4.5)], "g string, k string, x double")
    f = {x["g"]: x["statistic"] for x in sx.anova_oneway(same, "x", "k", ["g"]).collect()}
    assert f["a"] is None and f["b"] > 0
    t = {x["g"]: x["statistic"] for x in sx.one_sample_t(same, "x", ["g"]).collect()}
    assert t["a"] is None and t["b"] > 0
    w = {x["g"]: x["statistic"] for x in sx.welch_t(same, "x", F.col("k"), "u", "w", ["g"]).collect()}
    assert w["a"] is None and w["b"] < 0
    h = {x["g"]: x["statistic"] for x in sx.kruskal(same, "x", "k", ["g"]).collect()}
    assert h["a"] is None and h["b"] > 0
    one = spark.createDataFrame([("r", "c1", 5), ("r", "c2", 3)], "r string, c string, n bigint")
    assert sx.chi_square(one, "r", "c", "n").first()["cramers_v"] is None
    assert sx.anova_oneway(same.limit(0), "x", "k", ["g"]).count() == 0
    assert mx.apc_correct(spark.createDataFrame([(1, 2, 0.0), (2, 3, 0.0)], "i int, j int, score double"), min_sep=0, top=0.5).where("apc is null").count() == 2


def test_zero_branches_and_cycles(spark):
    edges = spark.createDataFrame([(0, 1, 0.0), (0, 2, 1.0), (0, 3, 0.0)], "parent bigint, child bigint, length double")
    tips = spark.createDataFrame([(1, 3.0), (2, 9.0), (3, 5.0)], "node bigint, x double")
    got = {r["node"]: r["x"] for r in tr.ancestral_trait(edges, tips, "x").collect()}
    assert got[0] == 4.0 and got[1] == 3.0 and got[2] == 9.0
    ring = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "parent bigint, child bigint, length double")
    for f in (tr.ancestor_closure, tr.level_depth):
        with pytest.raises(ValueError):
            f(ring).count()


def test_greedy_collapse_takes_the_smallest_representative(spark):
    v = lambda t: [float(c) for c in t]
    pts = spark.createDataFrame([("g", 1, v("0000")), ("g", 2, v("1000")), ("g", 3, v("1100")), ("g", 4, v("1111")), ("g", 5, v("1110"))], "g string, k bigint, v array<double>")
    assert {r["k"]: r["representative"] for r in mx.greedy_collapse(pts, ["g"], "k", "v", 1).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3}
    gaps = spark.createDataFrame([("g", 1, v("0000")), ("g", 2, v("9910")), ("g", 3, v("1111"))], "g string, k bigint, v array<double>")
    assert {r["k"]: r["representative"] for r in mx.greedy_collapse(gaps, ["g"], "k", "v", 1, gap=9.0).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["k"]: r["representative"] for r in mx.greedy_collapse(gaps, ["g"], "k", "v", 1).collect()} == {1: 1, 2: 2, 3: 3}


def test_pair_quantile_without_pairs(spark):
    r = mx.pair_quantile(spark.createDataFrame([("a", 1, [1.0, 2.0])], "g string, k bigint, v array<double>"), ["g"], "k", "v", 0.5).first()
    assert r["q"] is None and r["n_pairs"] == 0


def test_log_gamma_at_every_size():
    x = np.array([0.5, 1, 2, 3.5, 10, 100, 1e4, 1e7, 1e12])
    assert np.allclose(sp.lgamma(x), [math.lgamma(a) for a in x], rtol=1e-13, atol=1e-13)


def test_ladder_and_forest_by_jump_pointers(spark):
    rng = np.random.default_rng(21)
    n = 2000
    names = rng.permutation(10 * n)[:n + 40]
    parent = {int(names[i]): int(names[i - 1]) for i in range(1, n)}  # a ladder
    parent |= {int(names[n + j]): int(names[rng.integers(0, n)]) for j in range(30)}  # with side branches
    parent |= {int(names[n + j]): int(names[n + 30]) for j in range(31, 40)}  # and a second tree, a star
    edges = spark.createDataFrame([(p, c, 0.5) for c, p in parent.items()], "parent bigint, child bigint, length double")
    t = jumps.grow(edges)
    ix = {r.node: r for r in t.index.collect()}

    def path(k):
        out = [k]
        while out[-1] in parent:
            out.append(parent[out[-1]])
        return out

    inner = set(parent.values())
    below, tips, height = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in ix:
        for s, a in enumerate(path(k)):
            below[a] += 1
            tips[a] += k not in inner
            height[a] = max(height[a], s)
    assert len(ix) == n + 40 and sorted(r.tin for r in ix.values()) == list(range(n + 40))
    for k, r in ix.items():
        assert (r.depth, r.height, r.n_tips, r.tout - r.tin + 1, r.root_dist) == (len(path(k)) - 1, height[k], tips[k], below[k], 0.5 * (len(path(k)) - 1))
        if k in parent:
            assert ix[parent[k]].tin < r.tin and r.tout <= ix[parent[k]].tout
    rows = [(g, int(names[i])) for g in range(40) for i in rng.integers(0, n + 30, size=1 + g % 4)] + [(99, int(names[0])), (99, int(names[n + 35]))]
    got = {r.g: (r.mrca, r.n_members) for r in tr.mrca(spark.createDataFrame(rows, "g int, node bigint"), ["g"], t).collect()}
    for g in range(40):
        members = [k for h, k in rows if h == g]
        common = set.intersection(*[set(path(k)) for k in members])
        assert got[g] == (max(common, key=lambda a: len(path(a))), len(members))
    assert 99 not in got  # nothing in common
    value = {k: float(rng.normal()) for k in ix if k not in inner}
    means = {r.node: (r.n_tips, r.mean) for r in tr.clade_means(edges, spark.createDataFrame(list(value.items()), "node bigint, x double"), "x").collect()}
    sums = defaultdict(float)
    for k, x in value.items():
        for a in path(k):
            sums[a] += x
    assert all(means[k][0] == tips[k] and abs(means[k][1] - sums[k] / tips[k]) < 1e-9 for k in ix)
    sub = [(p, c) for p in (1, 2) for c in map(int, rng.choice(list(parent), 60, replace=False))] + [(1, next(iter(parent)))] * 2
    flags = {(r.pos, r.child): (r.is_above, r.edge_is_above) for r in tr.back_mutations(spark.createDataFrame(sub, "pos int, child bigint"), t).collect()}
    above = {(p, c): any(q == p and e != c and c in path(e) for q, e in sub) for p, c in sub}
    assert flags == {(p, c): (above[p, c], any(f for (_, e), f in above.items() if e == c)) for p, c in sub}


def test_holdout_clades_follow_the_order(spark):
    rng = np.random.default_rng(31)
    parent = {k: int(rng.integers(max(1, k - 12), k)) for k in range(2, 260)}  # with chains of one child
    edges = spark.createDataFrame([(p, c, 1.0) for c, p in parent.items()], "parent bigint, child bigint, length double")
    t = jumps.grow(edges)
    ix = {r.node: r for r in t.index.collect()}
    lo, hi, target = 3, 12, 0.4
    from cladeloom.functions.arith import draw
    order = {r.node: r.o for r in t.index.select("node", draw("node").alias("o")).collect()}
    chosen, cum, want = [], 0, []
    for k in sorted((k for k, r in ix.items() if not r.is_tip and lo <= r.n_tips <= hi), key=lambda k: (order[k], k)):
        if not any(ix[k].tin <= ix[c].tout and ix[c].tin <= ix[k].tout for c in chosen):
            chosen.append(k)
            if cum < int(target * sum(r.is_tip for r in ix.values())):
                cum += ix[k].n_tips
                want.append((k, ix[k].n_tips, cum))
    assert [tuple(r) for r in tr.select_holdout_clades(t, target, lo, hi).orderBy("cum_tips").collect()] == want


def test_anova_twoway_of_unbalanced_cells(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in ("full", "gaps", "nested", "one"):
        for i in range(90):
            a, b = (rng.integers(0, 3), rng.integers(0, 4)) if g != "nested" else (lambda k: (k // 2, k))(rng.integers(0, 6))
            if (g == "gaps" and (a, b) in ((0, 1), (2, 3))) or (g == "one" and (a or i > 3)):
                continue
            rows.append((g, f"a{a}", f"b{b}", float(a * 2 - b + a * b * 0.5 + rng.normal()), 1))
    rows += [("full", None, "b1", 3.0, 1), ("full", "a1", "b1", None, 1)]
    df = spark.createDataFrame(rows, "g string, a string, b string, x double, term int")
    got = {(r.g, r.term): r for r in sx.anova_twoway(df, "x", "a", "b", ["g"]).collect()}
    for g in ("full", "gaps", "nested", "one"):
        part = [r for r in rows if r[0] == g and None not in r]
        y = np.array([r[3] for r in part])
        one_hot = lambda vals: np.array([[v == u for u in sorted(set(vals))] for v in vals], float)
        za, zb, zc = one_hot([r[1] for r in part]), one_hot([r[2] for r in part]), one_hot([r[1:3] for r in part])
        ones = np.ones((len(y), 1))

        def fit(*blocks):
            z = np.hstack([ones, *blocks])
            return float(((y - z @ np.linalg.lstsq(z, y, rcond=None)[0]) ** 2).sum()), np.linalg.matrix_rank(z)

        r0, ra, rb, rab, rc = fit(), fit(za), fit(zb), fit(za, zb), fit(zc)
        want = {"a": (r0[0] - ra[0], rb[0] - rab[0], ra[1] - 1), "b": (ra[0] - rab[0], ra[0] - rab[0], rab[1] - ra[1]), "a:b": (rab[0] - rc[0],) * 2 + (rc[1] - rab[1],), "residuals": (rc[0], rc[0], len(y) - rc[1])}
        for term, (ss, partial, dof) in want.items():
            r = got[g, term]
            assert r.df == dof and abs(r.ss - ss) < 1e-7 and abs(r.ss_partial - partial) < 1e-7, (g, term)
            if term != "residuals" and dof and want["residuals"][2]:
                f = ss / dof / (rc[0] / want["residuals"][2])
                assert abs(r.statistic - f) < 1e-6 * max(1, f) and 0 <= r.p_value <= 1
            else:
                assert r.statistic is None
    assert {r.term for r in sx.anova_twoway(df.drop("g"), "x", "a", "b").collect()} == {"a", "b", "a:b", "residuals"}


def test_greedy_and_holdout_on_all_dimensions(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(120, 8))
    y = x @ rng.normal(size=8) + rng.normal(size=120)
    g = np.arange(120) % 3
    df = spark.createDataFrame([(int(k), [float(a) for a in r], float(b)) for k, r, b in zip(g, x, y)], "gene int, v array<double>, y double")
    steps = {(r.gene, r.step): r for r in az.greedy_orthogonal(df, "gene", "v", "y").collect()}
    held = {r.gene: r for r in az.group_holdout(df, "gene", "v", "y").collect()}
    for k in range(3):
        xk, yk, chosen = x[g == k], y[g == k], []
        for step in range(1, 6):
            z = np.column_stack([np.ones(40), xk[:, chosen]])
            e = yk - z @ np.linalg.lstsq(z, yk, rcond=None)[0]
            r = [0 if j in chosen else np.corrcoef(xk[:, j], e)[0, 1] for j in range(8)]
            j = int(np.argmax(np.abs(r)))
            assert (steps[k, step].dim, steps[k, step].n) == (j, 40) and abs(steps[k, step].r - r[j]) < 1e-9
            chosen.append(j)
        z = np.column_stack([np.ones(80), x[g != k]])
        b = np.linalg.lstsq(z, y[g != k], rcond=None)[0]
        e = yk - np.column_stack([np.ones(40), xk]) @ b
        assert abs(held[k].rmse - math.sqrt((e ** 2).mean())) < 1e-9 and abs(held[k].r2 - (1 - (e ** 2).sum() / ((yk - yk.mean()) ** 2).sum())) < 1e-9


def test_repeated_holdouts_equal_single_fits(spark):
    from cladeloom.operators import models as md
    rng = np.random.default_rng(17)
    n, reps = 400, 6
    x = rng.normal(size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 1)))).astype(int)
    s = rng.integers(0, 3, n)
    rows = [(i, [float(a) for a in r], int(l), f"s{k}") for i, (r, l, k) in enumerate(zip(x, y, s))]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, y int, s string").repartition(3)
    got = {r.replicate: r for r in md.repeated_holdouts(df.union(spark.createDataFrame([(None, [0.0, 0.0], 1, "s0"), (9999, None, 1, "s0"), (9998, [1.0, 1.0], None, "s1")], df.schema)), "id", "v", "y", "s", reps).collect()}
    key = np.array([r.h for r in spark.range(n).select("id", F.xxhash64("id").alias("h")).orderBy("id").collect()])
    share = np.array([min(1.0, 0.7 * y.sum() / 3 / ((s == k) & (y == 0)).sum()) for k in range(3)])[s]
    rest = 0.3 * y.sum() / ((1 - share) * (y == 0)).sum()
    train, held = md.holdout_masks(key, y, share, np.full(n, rest), 0.3, reps)
    assert not (train & held).any() and not np.array_equal(train[:, 0], train[:, 1])
    z = np.column_stack([np.ones(n), x])
    for k in range(reps):
        t, b = train[:, k], np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-z[t] @ b))
            b += np.linalg.solve((z[t].T * (p * (1 - p))) @ z[t], z[t].T @ (y[t] - p))
        p = 1 / (1 + np.exp(-z @ b))
        rate = y[t].mean()
        r2 = 1 - np.log(np.where(y[t] == 1, p[t], 1 - p[t])).sum() / (t.sum() * (rate * math.log(rate) + (1 - rate) * math.log(1 - rate)))
        h = held[:, k]
        a, c = p[h & (y == 1)], p[h & (y == 0)]
        auc = ((a[:, None] > c).sum() + 0.5 * (a[:, None] == c).sum()) / (len(a) * len(c))
        r = got[k]
        assert (r.n_train, r.n_test) == (t.sum(), h.sum()) and abs(r.pseudo_r2 - r2) < 1e-6 and abs(r.auc - auc) < 1e-9 and abs(r.acc_positive - (a >= 0.5).mean()) < 1e-9
        assert abs(h[y == 1].sum() - 0.3 * y.sum()) < 25 and abs(t[y == 0].sum() - t[y == 1].sum()) < 50
    one = md.holdout_summary(md.repeated_holdouts(df, "id", "v", "y", "s", 3)).first()
    assert one.replicates == 3 and 0.4 < one.mean_auc < 1
    assert md.repeated_holdouts(df.where("y = 1"), "id", "v", "y", "s", 3).count() == 0


def test_repeated_holdouts_by_ranges_with_few_scans(spark, monkeypatch):
    """Tied scores in many packs and ranges; nearly all steps are those of the common fit."""
    from cladeloom.operators import models as md
    rng = np.random.default_rng(23)
    n, reps = 3000, 5
    x = rng.integers(-3, 4, (n, 2)).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(1 - x[:, 0]))).astype(int)
    df = spark.createDataFrame([(i, r.tolist(), int(l), "s") for i, (r, l) in enumerate(zip(x, y))], "id bigint, v array<double>, y int, s string").repartition(3)
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or send(self, value))
    monkeypatch.setattr(md, "SCORES_AT_ONCE", 200)
    monkeypatch.setattr(md, "ROWS_PACKED", 300)
    got = {r.replicate: r for r in md.repeated_holdouts(df, "id", "v", "y", "s", reps).collect()}
    assert sum(len(b) == reps for b in sent) <= 6
    beta = sent[-1]
    key = np.array([r.h for r in spark.range(n).select("id", F.xxhash64("id").alias("h")).orderBy("id").collect()])
    share = min(1.0, 0.7 * y.sum() / (y == 0).sum())
    rest = min(1.0, 0.3 * y.sum() / ((1 - share) * (y == 0).sum()))
    _, held = md.holdout_masks(key, y, np.full(n, share), np.full(n, rest), 0.3, reps)
    for k in range(reps):
        p = 1 / (1 + np.exp(-(beta[k, 0] + x @ beta[k, 1:])))
        a, c = p[held[:, k] & (y == 1)], p[held[:, k] & (y == 0)]
        auc = ((a[:, None] - c > 1e-12).sum() + 0.5 * (abs(a[:, None] - c) <= 1e-12).sum()) / (len(a) * len(c))
        assert got[k].n_test == held[:, k].sum() and abs(got[k].auc - auc) < 1e-3 and abs(got[k].acc_positive - (a >= 0.5).mean()) < 1e-9
        assert abs(got[k].accuracy - ((a >= 0.5).sum() + (c < 0.5).sum()) / held[:, k].sum()) < 1e-9


def test_repeated_holdouts_without_a_held_out_label(spark):
    """Negatives that all train leave no replicate, as none has an AUC."""
    from cladeloom.operators import models as md
    df = spark.createDataFrame([(i, [float(i * 37 % 101)], int(i % 10 > 0), "s") for i in range(300)], "id bigint, v array<double>, y int, s string")
    assert md.repeated_holdouts(df, "id", "v", "y", "s", 4).count() == 0


def test_logistic_fit_of_separated_classes(spark):
    from cladeloom.operators import models as md
    df = spark.createDataFrame([([float(i)], int(i >= 10)) for i in range(20)], "v array<double>, y int")
    r = md.logistic_fit(df, "v", "y").first()
    assert r.auc == 1.0 and not math.isnan(r.log_lik) and r.log_lik <= 0 and r.pseudo_r2 > 0.9


def test_grid_search_over_genes(spark):
    rng = np.random.default_rng(19)
    rows, ys = [], {}
    for t in range(60):
        ys[t] = float(rng.normal())
        for g in range(5):
            if (t, g) in ((3, 1), (50, 2)):
                continue
            v = rng.normal(size=4)
            v[g % 4] += ys[t] * (5 - g) * 0.3
            rows += [(t, f"g{g}", [float(a) for a in v], ys[t], t % 6)] * (2 if t == 5 else 1)
    df = spark.createDataFrame(rows, "taxon bigint, gene string, v array<double>, y double, clade bigint")
    grid = [(1, 2, 1, 0.0), (2, 3, 2, 0.0), (3, 5, 3, 0.3), (4, 2, 2, 0.99)]
    got = {r.param: r for r in az.grid_search_genes(df, "taxon", "gene", "v", "y", "clade", F.col("clade") < 3, spark.createDataFrame(grid, "param int, n_genes int, n_dims int, min_abs_r double")).collect()}
    r = {}
    for g in range(5):
        part = [x for x in rows if x[1] == f"g{g}" and x[4] < 3]
        for j in range(4):
            r[g, j] = abs(np.corrcoef([x[2][j] for x in part], [x[3] for x in part])[0, 1])
    genes = sorted(range(5), key=lambda g: -max(r[g, j] for j in range(4)))
    value = {(x[0], int(x[1][1]), j): x[2][j] for x in rows for j in range(4)}
    fit_on, other = [t for t in range(60) if t % 6 < 3], [t for t in range(60) if t % 6 >= 3]
    rank = lambda a: np.argsort(np.argsort(a))
    best = {}
    for param, ng, nd, cut in grid:
        use = [(g, j) for g in genes[:ng] if max(r[g, k] for k in range(4)) >= cut for j in sorted(range(4), key=lambda j: -r[g, j])[:nd]]
        if not use:
            assert got[param].n_features is None and got[param].mean_rho is None
            continue
        mean = {f: np.mean([value[(t, *f)] for t in fit_on if (t, *f) in value]) for f in use}
        row = lambda t: [1.0, *(value.get((t, *f), mean[f]) for f in use)]
        z = np.array([row(t) for t in fit_on])
        b = np.linalg.lstsq(z, np.array([ys[t] for t in fit_on]), rcond=None)[0]
        rho = [np.corrcoef(rank([np.array(row(t)) @ b for t in other if t % 6 == c]), rank([ys[t] for t in other if t % 6 == c]))[0, 1] for c in (3, 4, 5)]
        best[param] = np.mean(rho)
        x = got[param]
        assert x.n_features == len(use) and x.n_groups == 3 and abs(x.mean_rho - np.mean(rho)) < 1e-9
        assert abs(x.statistic - np.mean(rho) / (np.std(rho, ddof=1) / math.sqrt(3))) < 1e-6
    assert [p for p, x in got.items() if x.is_best] == [max(best, key=best.get)]


def test_ridge_reduced_against_full(spark):
    rng = np.random.default_rng(23)
    n = 150
    c, x = rng.normal(size=(n, 2)) * [1, 40], np.hstack([rng.normal(size=(n, 4)), np.ones((n, 1))])
    y = c[:, 0] + 0.01 * c[:, 1] + x[:, 0] + rng.normal(size=n)
    fold = rng.integers(0, 4, n)
    df = spark.createDataFrame([("g", [float(a) for a in p], [float(a) for a in r], float(t), int(k)) for p, r, t, k in zip(c, x, y, fold)] + [("one", [1.0, 2.0], [0.0] * 5, 1.0, 0)], "g string, pc array<double>, v array<double>, y double, k int")
    grid = [0.001, 0.05, 0.5]

    def plain(z, keep):
        def fit(zt, yt, lam):
            mu, sd = zt.mean(0), zt.std(0)
            on = sd > 1e-9
            zs = (zt[:, on] - mu[on]) / sd[on]
            pen = lam * len(zt) * np.diag([0.0 if j < keep else 1.0 for j in np.flatnonzero(on)])
            b = np.linalg.solve(zs.T @ zs + pen, zs.T @ (yt - yt.mean()))
            return lambda q: yt.mean() + ((q[:, on] - mu[on]) / sd[on]) @ b
        best = min((sum(((y[fold == k] - fit(z[fold != k], y[fold != k], lam)(z[fold == k])) ** 2).sum() for k in range(4)) / n, lam) for lam in grid)
        return best, np.corrcoef(y, fit(z, y, best[1])(z))[0, 1] ** 2

    for penalised in (True, False):
        got = az.ridge_compare(df, ["g"], "pc", "v", "y", F.col("k"), grid, penalised).collect()
        assert len(got) == 1
        keep = 0 if penalised else 2
        (low, lam_low), _ = plain(c, keep)
        (full, lam_full), r2 = plain(np.hstack([c, x]), keep)
        r = got[0]
        assert (r.n, r.lambda_reduced, r.lambda_full) == (n, lam_low, lam_full) and max(abs(r.cve_reduced - low), abs(r.cve_full - full), abs(r.r2 - r2), abs(r.cve_ratio - full / low)) < 1e-9


def test_structural_runs(spark):
    rng = np.random.default_rng(29)
    states = "HHHEEHHHHCC"
    x = {(t, p): rng.normal(size=3) for t in range(30) for p in range(11) if (t + p) % 7}
    y = {t: float(rng.normal()) for t in range(30)}
    emb = spark.createDataFrame([("g", p, t, [float(a) for a in v]) for (t, p), v in x.items()], "gene string, pos int, taxon int, v array<double>")
    st = spark.createDataFrame([("g", p, s) for p, s in enumerate(states)], "gene string, pos int, state string")
    tr_ = spark.createDataFrame([(t, a, a - 1 if t % 5 else None) for t, a in y.items()], "taxon int, y double, e double")
    got = {(r.first_pos, r.kind): r for r in az.structural_run_scan(emb, st, tr_, "gene", "pos", "taxon", "v", "state", "y", "e", 10).collect()}
    for first, last in ((0, 2), (3, 4), (5, 8), (9, 10)):
        for kind, taxa in (("raw", list(y)), ("residualised", [t for t in y if t % 5])):
            m = {t: np.mean([x[t, p] for p in range(first, last + 1) if (t, p) in x], axis=0) for t in taxa if any((t, p) in x for p in range(first, last + 1))}
            z, w = np.array([[1, *v] for v in m.values()]), np.array([y[t] for t in m])
            e = w - z @ np.linalg.lstsq(z, w, rcond=None)[0]
            r = got[first, kind]
            assert (r.state, r.last_pos, r.n_pos, r.n) == (states[first], last, last - first + 1, len(m)) and abs(r.r2 - (1 - (e ** 2).sum() / ((w - w.mean()) ** 2).sum())) < 1e-9
    assert len(got) == 8


def test_exact_tests_against_enumeration():
    rng = np.random.default_rng(37)
    tables = np.vstack([rng.integers(0, hi, (60, 4)) for hi in (3, 9, 60)])
    odds, p = sp.fisher_tables(*tables.T)
    for (a, b, c, d), o, q in zip(tables.tolist(), odds, p):
        r1, c1, n = a + b, a + c, a + b + c + d
        k = range(max(0, c1 - (n - r1)), min(r1, c1) + 1)
        w = np.array([math.comb(r1, i) * math.comb(n - r1, c1 - i) for i in k], dtype=float)
        seen = w[a - k[0]]
        assert abs(q - w[w <= seen * (1 + 1e-7)].sum() / w.sum()) < 1e-9
        if k[0] < a < k[-1]:
            v = w * np.array([float(o) ** (i - a) for i in k])
            assert abs((v * np.array(k)).sum() / v.sum() - a) < 1e-6
        else:
            assert np.isnan(o) if len(k) == 1 else o == (0.0 if a == k[0] else np.inf)
    for n, p0 in ((1, 0.5), (12, 0.3), (60, 0.85)):
        w = np.array([math.comb(n, i) * p0 ** i * (1 - p0) ** (n - i) for i in range(n + 1)])
        assert np.allclose(sp.binom_tests(np.arange(n + 1), n, p0), [w[w <= x * (1 + 1e-7)].sum() for x in w], atol=1e-12)
    big = 10 ** 9
    odds, p = sp.fisher_tables([big, big // 2], [big + 50_000, big], [big, big], [big, big])
    assert abs(p[0] - math.erfc(math.log(1 + 5e-5) / math.sqrt(4 / big) / math.sqrt(2))) < 1e-3 and p[1] == 0 and abs(odds[1] - 0.5) < 1e-6
    assert abs(sp.binom_two_sided(big // 2 + 15_000, big, 0.5) - math.erfc(30_000 / math.sqrt(big) / math.sqrt(2))) < 1e-3


def test_collapse_by_distance_equals_sequential(spark):
    rng = np.random.default_rng(41)
    v = rng.integers(0, 4, size=(70, 12)).astype(float)
    v[30:60] = v[:30]
    v[30:60, 0] = 0
    v[rng.random(v.shape) < 0.15] = -1
    v[69] = -1
    df = spark.createDataFrame([(f"g{i % 2}", i, [float(a) for a in r]) for i, r in enumerate(v)], "g string, id bigint, v array<double>")

    def distance(i, j):
        ok = (v[i] != -1) & (v[j] != -1)
        return (v[i] != v[j])[ok].mean() if ok.any() else None

    all_ = [x for i in range(70) for j in range(i) if (x := distance(i, j)) is not None]
    got = mx.raw_distance_quantile(df, "id", "v", 0.02, -1.0).first()
    assert got.n == len(all_) and abs(got.q - np.quantile(all_, 0.02)) < 1e-12
    reps, want = {}, {}
    for i in range(70):
        mine = [r for r in reps if r % 2 == i % 2 and (x := distance(i, r)) is not None and x <= got.q + 1e-12]
        if not mine:
            reps[i] = True
            want[i] = i
        else:
            want[i] = min(mine)
    assert {r.id: r.representative for r in mx.collapse_by_distance(df, ["g"], "id", "v", 0.02, -1.0).collect()} == want


def test_vector_sums_of_counts_are_whole(spark):
    rows = spark.range(0, 60_000, 1, 32).select((F.col("id") % 97).alias("g"), F.array((F.col("id") % 7).cast("double"), (F.col("id") % 13 - 5).cast("double")).alias("v"))
    want = defaultdict(lambda: [0, 0])
    count = defaultdict(int)
    for i in range(60_000):
        count[i % 97] += 1
        want[i % 97][0] += i % 7
        want[i % 97][1] += i % 13 - 5
    assert {r.g: r.s for r in rows.groupBy("g").agg(vx.sum_vector(F.col("v")).alias("s")).collect()} == dict(want)
    parts = {r.g: gr.unpack(r["_gram"]) for r in gr.gram(rows, F.col("v"), ["g"]).collect()}
    assert all(m[0, 0] == count[g] and m[0, 1:].tolist() == want[g] for g, m in parts.items())


def test_vector_sum_keeps_nan_and_infinity(spark):
    df = spark.createDataFrame([([1.0, float("inf"), float("nan")],), ([-2.5, 1.0, 1.0],)], "v array<double>")
    s = df.agg(vx.sum_vector(F.col("v")).alias("s")).first().s
    assert s[0] == -1.5 and s[1] == float("inf") and math.isnan(s[2])


def test_site_scan_over_many_partitions(spark):
    n = 6_007
    ids = spark.range(0, n, 1, 32)
    sites = ids.select(F.lit("g").alias("gene"), F.lit(1).alias("pos"), "id", F.when(F.col("id") % 3 == 0, "A").otherwise("R").alias("allele"))
    traits = ids.select("id", (F.col("id") * 37 % 101).cast("double").alias("y"), F.array((F.col("id") % 11).cast("double")).alias("z"))
    assert az.site_scan(sites, traits).first().n == n


def test_hybrid36_numbers(spark):
    from cladeloom.sources import readers as rd
    n = [0, 7, 9_999, 10_000, 10_035, 10_036, 1_223_055, 1_223_056, 2_436_111]
    df = spark.createDataFrame([(i,) for i in n], "n bigint").withColumn("t", rd.to_hybrid36(F.col("n"), 4))
    got = df.select("n", "t", rd.hybrid36(F.trim("t"), 4).alias("b")).collect()
    assert all(len(r.t) == 4 and r.b == r.n for r in got)
    assert [r.t for r in got] == ["   0", "   7", "9999", "A000", "A00Z", "A010", "ZZZZ", "a000", "zzzz"]


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_read_atoms_with_wide_numbers(spark, tmp_path):
    from cladeloom.plans import QUERIES
    ids = [3, 9_999, 10_000, 123_456, 1_500_000]
    spark.createDataFrame([(i, [0.5, 0.25, -0.125], i % 10) for i in ids], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = _rows(QUERIES["read_atoms"](spark, str(tmp_path)), ["resno", "chain", "x", "z"])
    assert got == [(i, str(i % 10), 25.0, -6.25) for i in ids if i % 10 < 8]


def test_stream_dedupe_joins_values_360_apart(spark, tmp_path):
    from datetime import datetime
    from cladeloom.plans import QUERIES
    values = [x / 100 for x in range(0, 20_000, 37)]
    rows = [(i, datetime(2024, 1, 1), 5, "x", float(x), "") for i, x in enumerate([*values, *[x + 360 for x in values]])]
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    got = _rows(QUERIES["stream_dedupe"](spark, str(tmp_path)), ["species", "lat", "lon"])
    assert len(got) == len(set(got)) == len(values)


def test_collapse_with_copies_of_gaps_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mx, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(7)
    v = rng.integers(0, 3, size=(40, 6)).astype(float)
    v[10] = v[20] = v[30] = -1
    df = spark.createDataFrame([("g" if i else None, i, [float(a) for a in r]) for i, r in enumerate(v)], "g string, id bigint, v array<double>")
    reps, want = [], {}
    for i in range(1, 40):
        near = [r for r in reps if ((v[i] != -1) & (v[r] != -1)).any() and (v[i] != v[r]).mean() <= 0.4 + 1e-12]
        want[i] = min(near) if near else i
        reps += [] if near else [i]
    assert {r.id: r.representative for r in mx.greedy_collapse(df, ["g"], "id", "v", None, -1.0, 0.4).collect()} == want


def test_autocorrelation_of_points_at_one_place(spark):
    rng = np.random.default_rng(11)
    p = rng.integers(0, 4, size=(60, 2)).astype(float)
    x = rng.normal(size=60)
    df = spark.createDataFrame([(i, [float(c) for c in p[i]], float(x[i])) for i in range(60)], "id bigint, p array<double>, x double")
    d, z = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)), x - x.mean()
    off = ~np.eye(60, dtype=bool)
    for cut in (None, 2.0):
        w = np.where(off, 1 / (d + 0.001), 0) if cut is None else ((d > 0) & (d <= cut)).astype(float)
        w = w / w.sum(1, keepdims=True)
        s0, s1, s2 = w.sum(), ((w + w.T) ** 2).sum() / 2, ((w.sum(1) + w.sum(0)) ** 2).sum()
        got = mx.morans_i(df, "id", "p", "x", cut).first()
        assert got.n == 60 and abs(got.moran_i - 60 / s0 * (z @ w @ z) / (z @ z)) < 1e-9
        assert abs(got.variance - ((3600 * s1 - 60 * s2 + 3 * s0 ** 2) / (3599 * s0 ** 2) - 1 / 59 ** 2)) < 1e-9
    for r in mx.correlogram(df, "id", "p", "x", [-1, 0, 1, 2, 5], min_pairs=1).collect():
        on = np.triu((d > [-1, 0, 1, 2][r.cls]) & (d <= [0, 1, 2, 5][r.cls]), 1)
        assert r.n_pairs == on.sum() and abs(r.moran_i - 60 / on.sum() * (np.outer(z, z)[on]).sum() / (z @ z)) < 1e-9


def test_chunks_are_not_sent_through_the_driver(spark):
    df = spark.range(40).select("id", F.array(F.col("id").cast("double")).alias("p"))
    plan = pr.chunk_pairs(df, (), "id", ["p"], lambda a, b, same: {"n": [1]}, "n bigint", vectors=["p"])._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan


def test_permutation_ranks_only_the_last_bin(spark, monkeypatch):
    ranked = []
    plain = sx.row_index
    monkeypatch.setattr(sx, "row_index", lambda df, *a, **k: (ranked.append(df.count()), plain(df, *a, **k))[1])
    n, b = 3000, 9
    x = [float(i * 37 % 101) for i in range(n)]
    df = spark.createDataFrame([(i, x[i], i % 3 == 0) for i in range(n)], "id bigint, x double, l boolean")
    got = sx.permutation_test(df, ["id"], "x", F.col("l"), b).first()
    order = {j: [] for j in range(1, b + 1)}
    for r in df.select("id", F.explode(F.sequence(F.lit(1), F.lit(b))).alias("perm")).withColumn("h", draw("id", "perm")).collect():
        order[r.perm].append((r.h, r.id))
    gap = lambda ids: sum(x[i] for i in ids) / 1000 - (sum(x) - sum(x[i] for i in ids)) / 2000
    d = [gap([i for _, i in sorted(o)[:1000]]) for o in order.values()]
    obs = gap(range(0, n, 3))
    assert abs(got.observed - obs) < 1e-9 and abs(got.null_mean - np.mean(d)) < 1e-9 and abs(got.null_sd - np.std(d, ddof=1)) < 1e-9
    assert got.n_perm == b and got.p_value == (sum(abs(v) >= abs(obs) for v in d) + 1) / (b + 1)
    assert sum(ranked) < n * b / 50


def test_chunk_meets_itself_in_one_order(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(300, 3))
    base = spark.createDataFrame([(i, [float(c) for c in r], float(i % 2)) for i, r in enumerate(p)], "id bigint, p array<double>, y double")

    def mix(batches):
        for pdf in batches:
            yield pdf.sample(frac=1.0, random_state=np.random.default_rng())

    df = base.coalesce(1).mapInPandas(mix, base.schema)  # rows come in another order each time they are read
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    off = d + np.diag(np.full(300, np.inf))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        near = {r.id: r.distance for r in sr.nearest_in_set(df, [], "id", "p").collect()}
        pairs = sorted((r.a, r.b) for r in mx.close_contrasting_pairs(df, [], "id", "p", "y", 0.5, 0.5).collect())
        kin = {r.id: (r.self_kinship, r.row_sum) for r in mx.kinship_summary(mx.kinship_blocks(df.select("id", "p"), "id", "p"), "id").collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert all(abs(near[i] - off[i].min()) < 1e-12 for i in range(300))
    assert pairs == sorted((i, j) for i in range(300) for j in range(i + 1, 300) if d[i, j] <= 0.5 and (i - j) % 2)
    c = p - p.mean(0)
    assert all(abs(kin[i][0] - c[i] @ c[i] / 3) < 1e-9 and abs(kin[i][1]) < 1e-9 for i in range(300))


def test_batches_and_distances_are_bounded(spark, monkeypatch):
    wide = spark.range(0, 40, 1, 1).select("id", F.array_repeat(F.lit(1.5), 1 << 20).alias("v"))

    def rows(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    assert max(r.n for r in wide.mapInPandas(rows, "n int").collect()) <= 10
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(70, 64)), rng.normal(size=(50, 64))
    monkeypatch.setattr(pr, "STRIP", 64 * 50 * 3)
    assert (pr.distances(a, b) == np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))).all() and pr.distances(a, b[:0]).shape == (70, 0)


def test_kinship_totals_equal_the_blocks(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(rng.integers(0, 4, size=(1100, 5)))], "id bigint, v array<double>")
    a = {r.id: (r.self_kinship, r.row_sum) for r in mx.kinship_summary(mx.kinship_blocks(df, "id", "v"), "id").collect()}
    b = {r.id: (r.self_kinship, r.row_sum) for r in mx.kinship_totals(df, "id", "v").collect()}
    assert len(b) == 1100 and all(abs(a[i][j] - b[i][j]) < 1e-9 for i in a for j in (0, 1))


def test_theta_counts_on_roundings_and_without_chunk_pairs(spark, monkeypatch):
    monkeypatch.setattr(jn, "chunk_pairs", None)  # quadratic in the rows of a gene
    rng = np.random.default_rng(8)
    gap = 0.3
    v = [0.1, 0.4, 0.7, 1.0, -0.2, 0.0, -0.3, 0.30000000000000004, 1e-17, -1e-17, 1e16, 1e16 + 2] + [round(float(x), 1) for x in rng.normal(size=150)]
    rows = [("g" if i % 3 else "h", i, f"s{i % 4}" if i % 7 else None, x if i % 11 else None) for i, x in enumerate(v)] + [(None, 999, "s1", 0.0)]
    got = {r.id: (r.n_above, r.n_below) for r in jn.theta_pair_counts(spark.createDataFrame(rows, "g string, id bigint, s string, y double"), "g", "id", "s", "y", gap).collect()}
    pair = lambda a, b: a[0] == b[0] and None not in (a[2], b[2], a[3], b[3]) and a[2] != b[2]
    want = {a[1]: (sum(pair(a, b) and b[3] - a[3] >= gap for b in rows), sum(pair(a, b) and a[3] - b[3] >= gap for b in rows)) for a in rows if a[0]}
    assert got == want
    x = np.array([0.0, 1e-17, -0.3, 5.0, -1e16])
    e = jn.least_beyond(x, gap)
    assert (e - x >= gap).all() and (np.nextafter(e, -np.inf) - x < gap).all()


def test_distinct_kmers_of_any_text(spark):
    from collections import Counter
    from cladeloom.functions import kmers as km
    rc = lambda p: p[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
    for text in ("", "ACG", "ACGTNACGTTACGACGT", "acgTTxé日ACGTé日A", "".join(chr(33 + i % 90) for i in range(200))):
        for k, step, canonical in ((4, 1, False), (4, 1, True), (3, 3, False), (2, 3, False), (12, 1, True)):
            c = Counter(text[i:i + k] for i in range(0, len(text) - k + 1, step))
            if canonical:
                c = Counter(min(text[i:i + k], rc(text[i:i + k])) for i in range(len(text) - k + 1))
            names, n = km.distinct_kmers(text, k, step, canonical)
            assert list(zip(names.to_pylist(), n)) == sorted(c.items())
    df = spark.createDataFrame([(1, "ACGTACG"), (2, "ACGT"), (2, "ACG"), (3, None), (4, "A"), (None, "CCCC")], "id bigint, s string")
    for part, ids in ((df, (1, 2, None)), (df.where("id is null or id <> 2"), (1, None))):
        got = {(r.id, r.kmer): r.cnt for r in so.kmer_counts(part, "id", "s", 3).collect()}
        want = Counter((r.id, r.s[i:i + 3]) for r in part.collect() for i in range(len(r.s or "") - 2))
        assert got == want
        s = {r.id: (r.total, r.n_distinct, r.top_count, r.first_kmer) for r in so.kmer_summary(part, "id", "s", 3).collect()}
        assert s == {i: (sum(n for (j, _), n in want.items() if j == i), sum(j == i for j, _ in want), max(n for (j, _), n in want.items() if j == i), min(x for j, x in want if j == i)) for i in ids}
        assert so.kmer_presence(part, "id", "s", 3).count() == len(want)


def test_kmers_stems_and_segments_stay_in_the_row(spark):
    df = spark.createDataFrame([(1, "ACGTACGTTTGGCA" * 3, "<>>..<<.>>>..<<" * 2 + ".>..<<<>>..<")], "id bigint, s string, b string")
    for q in (so.kmer_counts(df, "id", "s", 4), so.kmer_presence(df, "id", "s", 4), so.kmer_summary(df, "id", "s", 12, True), so.stem_regions(df, "id", "s", "b")):
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Generate" not in plan
    plan = so.hydropathy_segments(df, "id", "s")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_rounding_of_halves_as_the_sql(spark):
    import duckdb
    from cladeloom.plans import views
    x = [n / m for m in (64000, 12800, 320, 4096 * 5) for n in range(1, 400)] + [-0.0158984375, 1.0000005, 2.5, 1e300, None, 0.0]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(views.rnd("x", 8).alias("x")).collect()]
    assert got == [duckdb.execute("select round(?::double, 8)", [v]).fetchone()[0] for v in x]


def test_site_pairs_are_not_dealt_by_gene(spark):
    rows = [(i, g, p, "ARN-"[(i * (p + 1) + (g == "h")) % 4]) for i in range(40) for g in "gh" for p in range(3) if (i + p) % 5] + [(None, "g", 0, "A")] * 3
    df = spark.createDataFrame(rows, "id bigint, gene string, pos int, allele string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = mx.residue_covariance(df, {"A": 1, "R": 2, "N": 3}, 1)
        plan = r._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [gene#" not in plan
    at = defaultdict(dict)
    for i, g, p, a in rows:
        if i is not None and a != "-":
            at[g, p][i] = "ARN".index(a) + 1
    got = {(x.gene_a, x.pos_a, x.gene_b, x.pos_b): (x.n, x.cov) for x in r.collect()}
    keys = sorted(at)
    assert sorted(got) == sorted((*k, *l) for k in keys for l in keys if k < l)
    for (ga, pa_, gb, pb), (n, cov) in got.items():
        both = sorted(at[ga, pa_].keys() & at[gb, pb].keys())
        assert n == len(both) and abs(cov - np.cov([at[ga, pa_][i] for i in both], [at[gb, pb][i] for i in both])[0, 1]) < 1e-9


def test_ols_by_group_sums_without_python(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 40, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(rng.normal(size=(400, 3)))] + [(99, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g int, y double, a double, b double")
    r = az.ols_by_group(df, "y", ["a", "b"], ["g"])
    assert r._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1  # the fits
    got = {(x.g, x.term): x.estimate for x in r.collect()}
    assert len(got) == 120
    for g in range(40):
        m = np.array([(1.0, a, b, y) for k, y, a, b in rows if k == g])
        w = np.linalg.lstsq(m[:, :3], m[:, 3], rcond=None)[0]
        assert all(abs(got[g, t] - v) < 1e-9 for t, v in zip(("(intercept)", "a", "b"), w))


def test_tree_levels_do_not_pass_through_the_driver(spark, monkeypatch):
    plans = []
    keep = tr.materialize

    def spy(df):  # the plan as it ran: joins of small tables become broadcasts only then
        out = keep(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(tr, "materialize", spy)
    monkeypatch.setattr(jumps, "materialize", spy)
    edges = spark.createDataFrame([(k // 2, k, 0.1 + k / 10) for k in range(2, 32)], "parent bigint, child bigint, length double")
    tips = spark.createDataFrame([(k, float(k % 5)) for k in range(16, 32)], "node bigint, x double")
    got = {r.node: r.x for r in tr.ancestral_trait(edges, tips, "x").collect()}
    assert len(got) == 31 and len(plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)
    up = {}
    for k in range(31, 0, -1):
        kids = [(up[c][0], up[c][1] + 0.1 + c / 10) for c in (2 * k, 2 * k + 1) if c in up]
        up[k] = (float(k % 5), 0.0) if not kids else (sum(x / v for x, v in kids) / sum(1 / v for _, v in kids), 1 / sum(1 / v for _, v in kids))
    want = {1: up[1][0]}
    for k in range(2, 32):
        x, v, b = *up[k], 0.1 + k / 10
        want[k] = x if v == 0 else (x / v + want[k // 2] / b) / (1 / v + 1 / b)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_first_interval_meets_each_pair_of_ends_once(spark, monkeypatch):
    met = []
    plain = jn.point_in_interval
    monkeypatch.setattr(jn, "point_in_interval", lambda p, pos, iv, *a: (met.append(iv.count()), plain(p, pos, iv, *a))[1])
    iv = [(i, i % 5 * 10, i % 5 * 10 + 25, f"n{i}") for i in range(200, 0, -1)]
    df = spark.createDataFrame(iv, "k int, lo int, hi int, name string")
    pts = spark.createDataFrame([(p,) for p in [*range(0, 80, 3), None]], "pos int")
    got = {r.pos: (r.k, r.lo, r.name) for r in jn.first_interval(pts, "pos", df, "lo", "hi", "k", ["k", "lo", "name"], 16).collect()}
    assert met == [5]
    for p in got:
        hit = min(((k, lo, n) for k, lo, hi, n in iv if p is not None and lo <= p <= hi), default=(None, None, None))
        assert got[p] == hit


def test_members_of_a_cluster_do_not_carry_its_block(spark, tmp_path):
    from cladeloom.sources import readers as rd
    (tmp_path / "c.clstr").write_text(">Cluster 0\n0\t9aa, >a_1... *\n1\t9aa, >b... at 99%\n>Cluster 12\n0\t9aa, >c... *\n>Cluster 13\n")
    df = rd.read_clusters(spark, str(tmp_path / "c.clstr"))
    assert sorted(map(tuple, df.collect())) == [(0, "a_1"), (0, "b"), (12, "c")]
    above = df._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "regexp_extract" not in above


def test_neighbours_are_counted_by_boxes(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 4, (900, 3)), np.round(rng.normal(0, 4, (1100, 3)), 1)
    b[:300], a[:200], a[-1], b[-1] = b[0], np.round(a[:200], 1), np.nan, np.inf
    grid = np.stack(np.meshgrid(*[np.arange(11.0)] * 3), -1).reshape(-1, 3)  # many distances equal to the radius
    for x, y, radius in ((a, b, 5.0), (b, a, 0.5), (grid, grid, 5.0), (grid, grid, math.sqrt(3)), (a, b[:0], 5.0)):
        with np.errstate(invalid="ignore"):
            d = pr.distances(x, y)
        assert (pr.near_counts(x, y, radius, 16) == ((d > 0) & (d <= radius)).sum(1)).all()
    # most points of two cells are not compared one by one: the widths of all difference arrays add up to far less than the pairs
    compared, take = [], np.count_nonzero
    monkeypatch.setattr(pr.np, "count_nonzero", lambda hit, axis=None: compared.append(hit.size) or take(hit, axis=axis))
    pr.near_counts(rng.uniform(0, 5, (4000, 3)), rng.uniform(0, 5, (4000, 3)) + [5, 0, 0], 5.0, 16)
    assert 0 < sum(compared) < 4000 * 4000 / 2


def test_metrics_by_file_reckons_its_tasks_by_rows(spark, monkeypatch):
    from cladeloom import session as ses
    key = "spark.sql.shuffle.partitions"
    before, seen = spark.conf.get(key), []
    monkeypatch.setattr(ses, "ROWS_PER_TASK", 10)
    ranks = az.sx.corr_test
    monkeypatch.setattr(az.sx, "corr_test", lambda *a, **k: seen.append((str(a[-1]), spark.conf.get(key))) or ranks(*a, **k))
    df = spark.range(200).select(F.concat(F.lit("f"), F.col("id") % 2).alias("file"), F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("b"))
    got = az.metrics_by_file(df, "file", "f([0-9])", ["n_file"], "a", "b").collect()
    assert sorted((r.n_file, r.n, round(r.spearman, 9)) for r in got) == [("0", 100, 1.0), ("1", 100, 1.0)]
    assert dict(seen)["spearman"] == str(max(20, int(before))) and spark.conf.get(key) == before


def test_back_mutations_compute_the_substitutions_once(spark):
    t = jumps.grow(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (2, 4, 1.0)], "parent bigint, child bigint, length double"))
    subs = spark.range(2, 4).select(F.lit(7).alias("pos"), F.col("id").alias("child"))
    b = tr.back_mutations(subs, t)
    assert "Range (" not in b._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.child, r.is_above, r.edge_is_above) for r in b.collect()) == [(2, True, True), (3, False, False)]


def test_box_sums_are_those_of_all_pairs(monkeypatch):
    from cladeloom.operators import fields as fd
    rng = np.random.default_rng(5)
    plane, lines = rng.uniform(0, 100, (3000, 2)), np.column_stack([rng.uniform(0, 100, 3000), rng.integers(0, 9, 3000) * 4.0])
    wide = rng.normal(size=(3000, 2)) * np.exp(2 * rng.normal(size=(3000, 1)))
    plain = fd._inverse
    for p in (plane, lines, wide):
        q = np.column_stack([rng.integers(1, 4, 3000), rng.normal(size=3000)]).astype(float)
        want, scale = plain(p, p, 0.001, q, q[:, :1], True), plain(p, p, 0.001, abs(q), q[:, :1], True)
        tree = fd.Boxes(p, 64)
        assert (abs(fd.inverse_sums(tree, tree, 0.001, q, q[:, :1]) - want) / scale).max() < 1e-12
        a, b = fd.Boxes(p[:1200], 64), fd.Boxes(p[1200:], 64)
        both = fd.inverse_sums(a, a, 0.001, q[:1200], q[:1200, :1]) + fd.inverse_sums(a, b, 0.001, q[1200:], q[1200:, :1])
        assert (abs(both - want[:1200]) / scale[:1200]).max() < 1e-12
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        near = (d > 0) & (d <= 20)
        tree, a, b = fd.Boxes(p, 32), fd.Boxes(p[:1200], 32), fd.Boxes(p[1200:], 32)
        assert np.allclose(fd.within_sums(tree, tree, 20.0, q, q)[0], near @ q, rtol=0, atol=1e-9)
        one, other = fd.within_sums(a, b, 20.0, q[:1200], q[1200:])
        assert np.allclose(one, near[:1200, 1200:] @ q[1200:], rtol=0, atol=1e-9) and np.allclose(other, near[1200:, :1200] @ q[:1200], rtol=0, atol=1e-9)
        edges = np.array([0, 20.0, 40, 45, 120])
        c, z = q.T
        n, zz = fd.class_sums(a, b, edges, c[:1200], z[:1200], c[1200:], z[1200:])
        for i in range(4):
            on = (d[:1200, 1200:] > edges[i]) & (d[:1200, 1200:] <= edges[i + 1])
            assert n[i] == c[:1200] @ on @ c[1200:] and abs(zz[i] - z[:1200] @ on @ z[1200:]) < 1e-7
    met, p = [], np.column_stack([rng.uniform(0, 100, 20000), rng.integers(0, 9, 20000) * 4.0])
    monkeypatch.setattr(fd, "_inverse", lambda x, y, *a: (met.append(len(x) * len(y)), plain(x, y, *a))[1])
    tree = fd.Boxes(p, 128)
    fd.inverse_sums(tree, tree, 0.001, np.ones((20000, 1)), np.ones((20000, 1)))
    assert sum(met) < 0.6 * 20000 ** 2, sum(met)


def test_autocorrelation_over_chunks_of_places(spark, monkeypatch):
    """Keys that come twice, groups, and chunks of few places."""
    monkeypatch.setattr(mx, "PLACES", (50, 50))
    rng = np.random.default_rng(12)
    p, x = rng.uniform(0, 30, size=(300, 2)), rng.normal(size=300)
    df = spark.createDataFrame([(i % 7, "a" if i < 200 else "b", [float(c) for c in p[i]], float(x[i])) for i in range(300)], "id bigint, g string, p array<double>, x double")
    for cut in (None, 8.0):
        got = {r.g: r for r in mx.morans_i(df, "id", "p", "x", cut, by=["g"]).collect()}
        for g, s in (("a", slice(0, 200)), ("b", slice(200, 300))):
            d, z, n = np.sqrt(((p[s, None] - p[None, s]) ** 2).sum(2)), x[s] - x[s].mean(), len(x[s])
            w = np.where(np.eye(n) == 1, 0, 1 / (d + 0.001)) if cut is None else ((d > 0) & (d <= cut)).astype(float)
            w = w / w.sum(1, keepdims=True)
            s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(1) + w.sum(0)) ** 2).sum()
            assert got[g].n == n and abs(got[g].moran_i - (z @ w @ z) / (z @ z)) < 1e-11
            assert abs(got[g].variance - ((n * n * s1 - n * s2 + 3 * n * n) / ((n * n - 1) * n * n) - 1 / (n - 1) ** 2)) < 1e-11
    d, z = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)), x - x.mean()
    for r in mx.correlogram(df, "id", "p", "x", [0, 5, 10, 60], min_pairs=1).collect():
        on = np.triu((d > [0, 5, 10][r.cls]) & (d <= [5, 10, 60][r.cls]), 1)
        assert r.n_pairs == on.sum() and abs(r.moran_i - 300 / on.sum() * (np.outer(z, z)[on]).sum() / (z @ z)) < 1e-11


def test_variance_of_values_dealt_at_random(spark):
    """Moran's I of skewed residuals: the variance takes their kurtosis, as in siteAutocorrelation.r."""
    rng = np.random.default_rng(14)
    p, x = rng.uniform(0, 30, size=(40, 2)), np.exp(2 * rng.normal(size=40))
    df = spark.createDataFrame([(i, [float(c) for c in p[i]], float(x[i])) for i in range(40)], "id bigint, p array<double>, x double")
    w = 1 / (np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) + 0.001)
    np.fill_diagonal(w, 0)
    w = w / w.sum(1, keepdims=True)
    n, z, s0, s1, s2 = 40, x - x.mean(), w.sum(), ((w + w.T) ** 2).sum() / 2, ((w.sum(1) + w.sum(0)) ** 2).sum()
    k = (z ** 4).mean() / (z ** 2).mean() ** 2
    var = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 ** 2) - k * (n * (n - 1) * s1 - 2 * n * s2 + 6 * s0 ** 2)) / ((n - 1) * (n - 2) * (n - 3) * s0 ** 2) - 1 / (n - 1) ** 2
    r = mx.morans_i(df, "id", "p", "x", randomised=True).first()
    assert abs(r.variance - var) < 1e-12 and abs(r.z - (r.moran_i + 1 / 39) / var ** 0.5) < 1e-9
    assert abs(r.p_value - math.erfc(abs(r.z) / 2 ** 0.5)) < 1e-9 and abs(mx.morans_i(df, "id", "p", "x").first().variance - var) > 1e-6


def test_sweep_forms_its_sums_once(spark, monkeypatch):
    rng = np.random.default_rng(15)
    sites = spark.createDataFrame([("g", p, i, "AC-"[int(rng.integers(3))]) for p in (1, 2) for i in range(60)], "gene string, pos int, id bigint, allele string")
    traits = spark.createDataFrame([(i, float(rng.normal()), [float(v) for v in rng.normal(size=3)]) for i in range(60)], "id bigint, y double, z array<double>")
    calls, plain = [], az.gram
    monkeypatch.setattr(az, "gram", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    got = az.covariate_sweep(sites, traits, [0, 2, 3]).collect()
    assert len(calls) == 1 and len(got) == 6
    for k in (0, 2, 3):
        z = F.slice("z", 1, k) if k else F.array().cast("array<double>")
        want = {r.pos: r for r in az.site_scan(sites, traits.select("id", "y", z.alias("z"))).collect()}
        for r in [r for r in got if r.n_pcs == k]:
            for c in ("r2_aa", "r2_pcs", "r2_full", "p_aa_only", "p_aa_with_pcs"):
                assert r[c] == want[r.pos][c] or abs(r[c] - want[r.pos][c]) < 1e-9
            assert [e.residue for e in r.effects] == [e.residue for e in want[r.pos].effects] and r.residue_counts == want[r.pos].residue_counts


def test_logistic_fit_forms_its_rows_once(spark):
    from cladeloom.operators import models as md
    formed = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def label(i):
        formed.add(1)
        return int(i * 7 % 10 > 3)

    df = spark.range(200).select(F.array((F.col("id") % 13).cast("double"), (F.col("id") % 5).cast("double")).alias("v"), label("id").alias("y"))
    r = md.logistic_fit(df, "v", "y").first()
    assert r.n == 200 and formed.value <= 400, formed.value


def test_nearest_neighbour_stat_draws_999_sets(spark):
    rng = np.random.default_rng(17)
    p = rng.uniform(0, 9, size=(30, 2))
    df = spark.createDataFrame([(i, [float(v) for v in p[i]]) for i in range(30)], "id bigint, p array<double>")
    r = sr.nearest_neighbour_stat(df, "id", "p", F.col("id") < 8).first()
    import hashlib
    nearest = lambda s: np.mean([min(np.sqrt(((p[a] - p[b]) ** 2).sum()) for b in s if b != a) for a in s])
    sets = [sorted(range(30), key=lambda i: (int(hashlib.md5(f"{i}|{j}|42".encode()).hexdigest()[:13], 16), i))[:8] for j in range(1, 1000)]
    null, seen = [nearest(s) for s in sets], nearest(range(8))
    assert r.n_perm == 999 and abs(r.observed - seen) < 1e-9 and abs(r.null_mean - np.mean(null)) < 1e-9
    assert abs(r.p_value - (sum(m <= seen + 1e-12 for m in null) + 1) / 1000) < 2e-3
