"""Atoms, residues and variants."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cladeloom.functions import sequence as sq
from cladeloom.functions.arith import draw
from cladeloom.operators import stats as sx
from cladeloom.operators.joins import nearest_neighbour, radius_count
from cladeloom.operators.ordered import join_same, quantile_column, quantiles, row_index
from cladeloom.operators.pairs import chunk_pairs, distances
from cladeloom.session import materialize


def chain_summary(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("chain").agg(F.count_distinct("resno").alias("n_residues"), F.min("resno").alias("first_resno"), F.max("resno").alias("last_resno"))


def ligand_centroids(ligands: DataFrame, by: Sequence[str] = ("chain", "resid", "resno")) -> DataFrame:
    return ligands.groupBy(*by).agg(*[F.avg(c).alias(c) for c in "xyz"], F.count("*").alias("n_atoms"))


def residue_features(residues: DataFrame, ligands: DataFrame, z_cut: float) -> DataFrame:
    """Per (gene, pos) over its chain copies: ligand distance min / mean / max, nearest other-chain
    residue, coordinate spread, proximity flags and compartment by height.

    `residues` holds (id, gene, pos, chain, p array); `ligands` holds (id, p array).
    """
    lig = nearest_neighbour(residues.select("id", "p"), ligands.select("id", "p"), "id", "p").withColumnRenamed("distance", "_lig")
    face = other_group_distance(residues, "id", "chain", "p").withColumnRenamed("distance", "_face")
    j = residues.join(lig, "id").join(face, "id", "left")
    x = [F.col("p")[i] for i in range(3)]
    spread = F.sqrt(F.var_samp(x[0]) + F.var_samp(x[1]) + F.var_samp(x[2]))
    g = j.groupBy("gene", "pos").agg(F.count("*").alias("n_copies"), F.min("_lig").alias("lig_min"), F.avg("_lig").alias("lig_mean"), F.max("_lig").alias("lig_max"),
                                     F.min("_face").alias("interface"), spread.alias("spread"), F.avg(x[2]).alias("z"))
    return g.withColumns({"near_ligand": (F.col("lig_min") < 8).cast("int"), "at_interface": (F.col("interface") < 15).cast("int"),
                          "compartment": F.when(F.col("z") > z_cut, "lumen").when(F.col("z") < -z_cut, "stroma").otherwise("membrane")})


def other_group_distance(points: DataFrame, id: str, group: str, vec: str) -> DataFrame:
    """Distance from each point to the nearest point of any other group, reduced in-task."""
    def kernel(a, b, same):
        d = distances(a[vec], b[vec])
        d[a[group][:, None] == b[group][None, :]] = np.inf
        ids, m = [a[id]], [d.min(1)]
        if not same:
            ids.append(b[id]); m.append(d.min(0))
        return {id: np.concatenate(ids), "_d": np.concatenate(m)}

    t = dict(points.dtypes)[id]
    r = chunk_pairs(points.select(id, group, vec), (), id, [group, vec], kernel, f"`{id}` {t}, _d double", vectors=[vec]).groupBy(id).agg(F.min("_d").alias("distance"))
    return r.where(F.col("distance") < float("inf"))


def nearest_in_set(points: DataFrame, by: Sequence[str], id: str, vec: str) -> DataFrame:
    """Distance of each point to its nearest other member of the same group."""
    def kernel(a, b, same):
        d = distances(a[vec], b[vec])
        if same:
            np.fill_diagonal(d, np.inf)
        ids, m = [a[id]], [d.min(1)]
        if not same:
            ids.append(b[id]); m.append(d.min(0))
        return {id: np.concatenate(ids), "_d": np.concatenate(m)}

    t = dict(points.dtypes)[id]
    r = chunk_pairs(points, by, id, [vec], kernel, f"`{id}` {t}, _d double", vectors=[vec]).groupBy(*by, id).agg(F.min("_d").alias("distance"))
    return r.where(F.col("distance") < float("inf"))


def nearest_neighbour_stat(points: DataFrame, id: str, vec: str, hit: Column, n_perm: int = 999, seed: int = 42) -> DataFrame:
    """Mean nearest-neighbour distance among hits against equally large hash-drawn sets.

    A set takes the points that come first in hash order.  They are counted per bin of the hash; only those of the bin that holds a
    set's last point, one in 256, are ranked.
    """
    base = points.select(id, vec, hit.alias("_h"))
    k = base.where("_h").agg(F.count("*")).scalar()
    # hashing is heavy per row: fix the task count so small tables are not one task
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = base.repartition(tasks, id).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm)))).withColumn("_o", draw(id, "perm", seed=seed))
    sets = sets.withColumn("_b", F.shiftright("_o", 44))  # of 52 bits
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("perm").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sets.groupBy("perm", "_b").agg(F.count("*").alias("_n")).withColumn("_m", before).withColumn("_k", k)
    cut = materialize(cut.where((F.col("_m") < F.col("_k")) & (F.col("_k") <= F.col("_m") + F.col("_n"))).select("perm", F.col("_b").alias("_last"), "_m", "_k"))
    sets = sets.join(F.broadcast(cut), "perm")
    last = row_index(sets.where(F.col("_b") == F.col("_last")).select(id, vec, "perm", "_o", "_m", "_k"), ["_o", id], ["perm"], "_i").where(F.col("_m") + F.col("_i") <= F.col("_k"))
    drawn = sets.where(F.col("_b") < F.col("_last")).select("perm", id, vec).unionByName(last.select("perm", id, vec))
    alls = drawn.unionByName(base.where("_h").select(F.lit(0).alias("perm"), id, vec))
    m = nearest_in_set(alls, ["perm"], id, vec).groupBy("perm").agg(F.avg("distance").alias("m"))
    obs = m.where("perm = 0").select("m").scalar()
    r = m.where("perm > 0").withColumn("_obs", obs)
    return r.agg(F.max("_obs").alias("observed"), F.avg("m").alias("null_mean"), F.count("*").alias("n_perm"),
                 ((F.count_if(F.col("m") <= F.col("_obs")) + 1) / (F.count("*") + 1)).alias("p_value"))


def axis_distance(p: Column, axis: Column) -> Column:
    """Radial distance to an axis along z through a point."""
    return F.sqrt((p[0] - axis[0]) ** 2 + (p[1] - axis[1]) ** 2)


def membrane_depth(p: Column, lumen: Column, stroma: Column) -> Column:
    """Projection on the lumen -> stroma axis, 0 at lumen and 1 at stroma."""
    num = sum(((p[i] - lumen[i]) * (stroma[i] - lumen[i]) for i in range(1, 3)), (p[0] - lumen[0]) * (stroma[0] - lumen[0]))
    den = sum(((stroma[i] - lumen[i]) ** 2 for i in range(1, 3)), (stroma[0] - lumen[0]) ** 2)
    return num / den


def rotate2d(x: Column, y: Column, degrees: float) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees)))
    return x * c - y * s, x * s + y * c


def surface_proxy(residues: DataFrame, radius: float = 10.0) -> DataFrame:
    """Neighbours within the radius per residue copy, summarised over copies; exposed = below the median."""
    n = radius_count(residues.select("id", "p"), "id", "p", radius)
    g = residues.select("id", "gene", "pos").join(n, "id").groupBy("gene", "pos").agg(F.min("n_within").alias("min_n"), F.avg("n_within").alias("mean_n"), F.max("n_within").alias("max_n"))
    return g.withColumn("_m", quantile_column(g, "mean_n", 0.5)).withColumn("exposed", (F.col("mean_n") < F.col("_m")).cast("int")).drop("_m")


def feature_enrichment(df: DataFrame, cls: str, background: str, continuous: Sequence[str], binary: Sequence[str]) -> DataFrame:
    """Every class against the background for every feature, as one long result.

    Continuous features get a rank-sum test, binary ones an exact 2x2 test; all pairs of
    class and feature run in one grouped job.
    """
    names = df.where(F.col(cls) != background).select(cls).distinct().agg(F.array_sort(F.collect_list(cls))).scalar()
    long = df.select(cls, *[F.col(c).cast("double").alias(c) for c in (*continuous, *binary)]).unpivot([cls], [*continuous, *binary], "feature", "value").where("value is not null")
    # background rows serve every class; class rows serve their own
    t = long.withColumn("_n", names).withColumn("target", F.explode(F.when(F.col(cls) == background, F.col("_n")).otherwise(F.array(cls))))
    t = t.withColumn("_g", F.when(F.col(cls) == background, "b").otherwise("a"))
    w = sx.wilcoxon(t.where(F.col("feature").isin(*continuous)), "value", "_g", "a", "b", ["target", "feature"])
    w = w.select("target", "feature", F.lit("rank_sum").alias("test"), "n1", "n2", F.col("auc").alias("estimate"), "p_value")
    a, v = F.col("_g") == "a", F.col("value") > 0
    c = t.where(F.col("feature").isin(*binary)).groupBy("target", "feature").agg(F.count_if(a & v).alias("a"), F.count_if(a & ~v).alias("b"), F.count_if(~a & v).alias("c"), F.count_if(~a & ~v).alias("d"))
    f = sx.fisher_exact(c, "a", "b", "c", "d").select("target", "feature", F.lit("exact").alias("test"), (F.col("a") + F.col("b")).alias("n1"), (F.col("c") + F.col("d")).alias("n2"),
                                                      F.when((F.col("b") > 0) & (F.col("c") > 0), F.col("a") * F.col("d") / (F.col("b") * F.col("c"))).alias("estimate"), "p_value")
    return w.unionByName(f)


def codon_start(strand: Column, start: Column, end: Column, residue: Column) -> Column:
    """Genome position of a residue's codon, 1-based: forward from the start, backward from the end."""
    return F.when(strand > 0, start + (residue - 1) * 3).otherwise(end - (residue - 1) * 3 - 2)


def spliced_offset(parts: DataFrame, gene: str = "gene") -> DataFrame:
    """Coding offset at which each part of a multi-part feature begins (parts per gene are few)."""
    w = Window.partitionBy(gene).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("cds_offset", F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(w), F.lit(0)))


def variant_effect(variants: DataFrame, cds: DataFrame, gene: str, offset: str, alt: str, seq: str) -> DataFrame:
    """Codon, residue number, reference and alternative residue, and whether the change is silent.

    `offset` is the 0-based position in the coding sequence; the codon is cut out right
    after the join so the sequence itself travels no further.
    """
    j = variants.join(cds.select(gene, seq), gene).where(F.col(offset) < F.floor(F.length(seq) / 3) * 3)
    k = F.floor(F.col(offset) / 3)
    codon = F.substring(F.col(seq), k * 3 + 1, F.lit(3))
    j = j.select(*variants.columns, (k + 1).cast("bigint").alias("residue_no"), codon.alias("ref_codon"), (F.col(offset) % 3 + 1).cast("int").alias("_i"))
    altc = F.concat(F.expr("substring(ref_codon, 1, _i - 1)"), F.col(alt), F.expr("substring(ref_codon, _i + 1, 3)"))
    j = j.withColumn("alt_codon", altc).drop("_i").where(F.col("alt_codon") != F.col("ref_codon"))
    return j.withColumns({"ref_aa": sq.translate_codons(F.col("ref_codon")), "alt_aa": sq.translate_codons(F.col("alt_codon"))}).withColumn(
        "synonymous", (F.col("ref_aa") == F.col("alt_aa")).cast("int"))


def cross_candidates(sites: DataFrame, levels: Sequence[str], n_crosses: int = 10) -> DataFrame:
    """The n sample pairs that differ at most of the given sites, with the ordered differing sites.

    Each chunk pair returns only its own best n pairs (the global best are among them).
    """
    pos = sites.select("gene", "pos").distinct().agg(F.array_sort(F.collect_list(F.struct("gene", "pos")))).scalar()
    code = F.create_map(*[x for i, a in enumerate(levels) for x in (F.lit(a), F.lit(float(i + 1)))])
    own = sites.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("gene", "pos"), F.coalesce(F.try_element_at(code, F.col("allele")), F.lit(0.0))))).alias("m")).withColumn("_p", pos)
    v = own.select("id", F.transform("_p", lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0.0))).alias("v"))

    def kernel(a, b, same):
        x, y = a["v"][:, None, :], b["v"][None, :, :]
        both = ((x > 0) & (y > 0)).sum(2)
        diff = ((x != y) & (x > 0) & (y > 0)).sum(2)
        i, j = np.triu_indices(len(diff), 1) if same else np.indices(diff.shape).reshape(2, -1)
        p, q = a["id"][i], b["id"][j]
        lo, hi = np.minimum(p, q), np.maximum(p, q)
        o = np.lexsort((hi, lo, -diff[i, j]))[:n_crosses]
        return {"a": lo[o], "b": hi[o], "n_diff": diff[i, j][o], "n_shared": both[i, j][o]}

    t = dict(sites.dtypes)["id"]
    best = chunk_pairs(v, (), "id", ["v"], kernel, f"a {t}, b {t}, n_diff bigint, n_shared bigint", vectors=["v"]).orderBy(F.desc("n_diff"), "a", "b").limit(n_crosses)
    s = sites.where(F.col("allele").isin(*levels))
    x = best.join(s.select(F.col("id").alias("a"), "gene", "pos", F.col("allele").alias("_x")), "a").join(s.select(F.col("id").alias("b"), "gene", "pos", F.col("allele").alias("_y")), ["b", "gene", "pos"])
    lst = F.array_sort(F.collect_list(F.when(F.col("_x") != F.col("_y"), F.struct("gene", "pos", "_x", "_y"))))
    det = F.array_join(F.transform(lst, lambda r: F.concat(r["gene"], F.lit(":"), r["pos"].cast("string"), F.lit("("), r["_x"], F.lit("/"), r["_y"], F.lit(")"))), ";")
    return x.groupBy("a", "b", "n_diff", "n_shared").agg(det.alias("detail")).withColumn("pct", 100 * F.col("n_diff") / F.col("n_shared"))


def variant_scores(variants: DataFrame, scores: DataFrame, keys: Sequence[str], p: str, q: float = 0.1) -> DataFrame:
    """Variants with their association score and a flag for the best `q` share (inclusive)."""
    cut = quantile_column(scores.where(F.col(p).isNotNull()), p, q)
    return variants.join(scores.select(*keys, p), list(keys), "left").withColumn("_q", cut).withColumn("is_hit", F.coalesce(F.col(p) <= F.col("_q"), F.lit(False))).drop("_q")
