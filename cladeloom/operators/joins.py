"""Joins beyond equality: intervals, grids, neighbours, pairs."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cladeloom.operators.ordered import join_same, running_sums
from cladeloom.operators.pairs import chunk_pairs, distances, near_counts
from cladeloom.session import materialize


def outer_merge_long(df: DataFrame, key: str, source: str, sources: Sequence[str], value: Column) -> DataFrame:
    """Full outer merge of many one-key sources as a single grouped pivot."""
    return df.groupBy(key).pivot(source, list(sources)).agg(value)


def point_in_interval(points: DataFrame, pos: str, intervals: DataFrame, lo: str, hi: str, bin_size: int) -> DataFrame:
    """Every (distinct position, interval) with lo <= pos <= hi, by equi-join on bins.

    Positions are de-duplicated first, so copies of a hot position cost one row; join
    the result back on the position.
    """
    p = points.select(pos).where(F.col(pos).isNotNull()).distinct().withColumn("_bin", F.floor(F.col(pos) / bin_size))
    iv = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / bin_size), F.floor(F.col(hi) / bin_size))))
    return p.join(iv, "_bin").where(F.col(pos).between(F.col(lo), F.col(hi))).drop("_bin")


def first_interval(points: DataFrame, pos: str, intervals: DataFrame, lo: str, hi: str, order: str, cols: Sequence[str], bin_size: int) -> DataFrame:
    """Attach the first (by `order`) interval that contains each point; NULL when none does.

    Of intervals with the same ends only the first can win, so copies are dropped before positions meet them.
    """
    rest = [c for c in dict.fromkeys([order, *cols]) if c not in (lo, hi)]
    held = F.min_by(F.struct(lo, hi, *rest), order).alias("_f")
    ends = intervals.groupBy(F.col(lo).alias("_lo"), F.col(hi).alias("_hi")).agg(held).select("_f.*")
    m = point_in_interval(points, pos, ends, lo, hi, bin_size)
    first = m.groupBy(pos).agg(F.min_by(F.struct(order, *[c for c in cols if c != order]), order).alias("_f"))
    return points.join(first, pos, "left").select(*points.columns, *[F.col(f"_f.{c}").alias(c) for c in dict.fromkeys([order, *cols])])


def segment_means(points: DataFrame, pos: str, score: str, segments: DataFrame, lo: str, hi: str, label: str, bin_size: int) -> DataFrame:
    """Mean score per annotated segment and outside all of them (label NULL).

    Scores are pre-aggregated per position, so a hot position is one row.
    """
    pre = points.groupBy(pos).agg(F.sum(score).alias("_s"), F.count(score).alias("_n"))
    m = point_in_interval(pre, pos, segments, lo, hi, bin_size).select(pos, label).distinct()
    j = pre.join(m, pos, "left")
    return j.groupBy(label).agg(F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("mean_score"))


def nearest_on_line(df: DataFrame, pos: str, marks: DataFrame, mark: str) -> DataFrame:
    """Distance from each position to the closest mark.

    Positions and marks are merged into one ordered line; the last mark before and the
    first mark after come from a running maximum over range-partitioned blocks.
    """
    line = (df.select(F.col(pos).alias("_p")).distinct().withColumn("_m", F.lit(0))
            .union(marks.select(F.col(mark).alias("_p")).distinct().withColumn("_m", F.lit(1))))
    g = line.groupBy("_p").agg(F.max("_m").alias("_m"))
    r = running_sums(g, {"_k": F.col("_m")}, ["_p"])
    ms = r.where("_m = 1").select(F.col("_k").alias("_k1"), F.col("_p").alias("_at"))
    # the k-th mark is the latest at or before; the (k+1)-th the next
    near = (r.join(ms, F.col("_k") == F.col("_k1"), "left").withColumnRenamed("_at", "_lo").drop("_k1")
            .join(ms, F.col("_k") + 1 == F.col("_k1"), "left").withColumnRenamed("_at", "_hi").drop("_k1"))
    dist = F.least(F.col("_p") - F.col("_lo"), F.col("_hi") - F.col("_p"))
    return df.join(near.select(F.col("_p").alias(pos), dist.alias("distance")), pos)


def cell_columns(lon: str, lat: str, lon0: float, lat0: float, res: float) -> dict[str, Column]:
    return {"row": F.floor((F.lit(lat0) - F.col(lat)) / res), "col": F.floor((F.col(lon) - lon0) / res)}


def grid_lookup(points: DataFrame, grid: DataFrame, lon: str, lat: str, lon0: float, lat0: float, res: float) -> DataFrame:
    """Raster value per layer at each point: points are reduced to distinct cells before the join."""
    p = points.withColumns(cell_columns(lon, lat, lon0, lat0, res))
    cells = p.select("row", "col").distinct()
    hit = cells.join(grid, ["row", "col"])
    return p.join(hit, ["row", "col"])


def land_mask(points: DataFrame, land: DataFrame, lon: str, lat: str, lon0: float, lat0: float, res: float, removed: bool = False) -> DataFrame:
    """Points on land cells, or (removed=True) the points dropped."""
    p = points.withColumns(cell_columns(lon, lat, lon0, lat0, res))
    return p.join(land.select("row", "col").distinct(), ["row", "col"], "left_anti" if removed else "left_semi")


def _norms(a, b):
    d = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def nearest_neighbour(left: DataFrame, right: DataFrame, id: str, vec: str, by: Sequence[str] = (), chunk_rows: int = 512) -> DataFrame:
    """Smallest Euclidean distance from each left point to the right set (its chunks), reduced in-task."""
    def kernel(a, b, same):
        return {id: a[id], "_d": distances(a[vec], b[vec]).min(1)}

    t = dict(left.dtypes)[id]
    part = chunk_pairs(left, by, id, [vec], kernel, f"`{id}` {t}, _d double", other=right, vectors=[vec], chunk_rows=chunk_rows)
    return part.groupBy(*by, id).agg(F.min("_d").alias("distance"))


def radius_count(points: DataFrame, id: str, vec: str, radius: float, other: DataFrame | None = None, by: Sequence[str] = (),
                 chunk_rows: int = 1 << 15) -> DataFrame:
    """Number of points with 0 < d <= radius: cells of one radius meet their 27 neighbours, and within a pair of cells
    most points are counted by boxes that lie wholly within the radius.

    A crowded cell is cut into chunks; only counts leave a task.
    """
    cell = lambda i: F.floor(F.col(vec)[i] / radius)
    in_cells = lambda df: df.select(*by, id, vec, *[cell(i).alias(f"_c{i}") for i in range(3)])
    cells = ["_c0", "_c1", "_c2"]
    keys = [*by, *cells]

    def kernel(a, b, same):
        return {id: a[id], "_n": near_counts(a[vec], b[vec], radius)}

    t = dict(points.dtypes)[id]
    part = chunk_pairs(in_cells(points), keys, id, [vec], kernel, f"`{id}` {t}, _n bigint", other=in_cells(points if other is None else other), vectors=[vec], chunk_rows=chunk_rows, cells=cells)
    n = part.groupBy(*by, id).agg(F.sum("_n").alias("_n"))
    return join_same(points.select(*by, id), n, [*by, id], "left").select(*by, id, F.coalesce("_n", F.lit(0)).alias("n_within"))


def radius_pairs(points: DataFrame, id: str, vec: str, radius: float, chunk_rows: int = 256) -> DataFrame:
    """Contact list: unordered pairs closer than `radius` (sparse for atoms of bounded density)."""
    cell = lambda i: F.floor(F.col(vec)[i] / radius)
    left = points.select(id, vec, *[cell(i).alias(f"_c{i}") for i in range(3)])
    r = left
    for i in range(3):
        r = r.withColumn(f"_s{i}", F.explode(F.array(*[F.lit(x) for x in (-1, 0, 1)])))
    r = r.select(id, vec, *[(F.col(f"_c{i}") + F.col(f"_s{i}")).alias(f"_c{i}") for i in range(3)])
    keys = ["_c0", "_c1", "_c2"]
    r = r.join(left.select(*keys).distinct(), keys, "left_semi")

    def kernel(a, b, same):
        d = distances(a[vec], b[vec])
        i, j = np.nonzero((d < radius) & (a[id][:, None] < b[id][None, :]))
        return {"a": a[id][i], "b": b[id][j], "distance": d[i, j]}

    t = dict(points.dtypes)[id]
    return chunk_pairs(left, keys, id, [vec], kernel, f"a {t}, b {t}, distance double", other=r, vectors=[vec], chunk_rows=chunk_rows).drop(*keys)


def least_beyond(v: np.ndarray, gap: float) -> np.ndarray:
    """Per finite v the least double e with e - v >= gap as doubles subtract, by bisection over the doubles in order."""
    turn = lambda i: np.where(i < 0, np.int64(-2 ** 63) - i, i)  # whole numbers in the order of the doubles, and back
    ends = turn(np.array([-np.inf, np.inf]).view(np.int64))
    lo, hi = np.full(len(v), ends[0]), np.full(len(v), ends[1])
    for _ in range(65):
        mid = (lo >> 1) + (hi >> 1) + (lo & hi & 1)
        ok = turn(mid).view(np.float64) - v >= gap
        lo, hi = np.where(ok, lo, mid), np.where(ok, mid, hi)
    return turn(hi).view(np.float64)


def _beyond(df: DataFrame, by: Sequence[str], y: str, min_diff: float) -> DataFrame:
    """by..., y, _above, _below: rows of the group at least `min_diff` above and below each value of it.

    Values and the two bounds of every value stand in one ordered line, whose running counts answer all of them.
    """
    @F.pandas_udf("up double, down double")
    def bounds(v: pd.Series) -> pd.DataFrame:
        x = v.to_numpy(float)
        return pd.DataFrame({"up": least_beyond(x, min_diff), "down": -least_beyond(-x, min_diff)})

    c = df.groupBy(*by, y).agg(F.count("*").alias("_n")).withColumn("_b", bounds(y))
    at = lambda v, kind, n: F.struct(F.col(v).alias("_at"), F.lit(kind).alias("_kind"), n.cast("bigint").alias("_w"))
    line = c.select(*by, y, F.explode(F.array(at("_b.up", -1, F.lit(0)), at(y, 0, F.col("_n")), at("_b.down", 1, F.lit(0)))).alias("_l")).select(*by, y, "_l.*")
    r = running_sums(line, {"_cum": F.col("_w")}, ["_at", "_kind", y], by)
    of = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_cum")))
    g = join_same(r.groupBy(*by, y).agg(of(-1).alias("_less"), of(1).alias("_below")), c.groupBy(*by).agg(F.sum("_n").alias("_t")), list(by))
    return g.select(*by, y, (F.col("_t") - F.col("_less")).alias("_above"), "_below")


def theta_pair_counts(df: DataFrame, gene: str, id: str, seq_key: str, y: str, min_diff: float) -> DataFrame:
    """Per row: how many partners of the same gene with another sequence lie at least `min_diff`
    above and below in phenotype.  Partners are counted along the ordered phenotypes, those with the
    same sequence taken off; a row without phenotype or sequence has none.
    """
    rows = df.select(gene, id, seq_key, F.col(y).cast("double").alias("_y")).where(F.col(gene).isNotNull())
    p = materialize(rows.withColumn("_y", F.when(F.col(seq_key).isNotNull() & (F.abs("_y") < float("inf")), F.col("_y") + 0.0)))
    own = p.where(F.col("_y").isNotNull())
    all_, same = _beyond(own, [gene], "_y", min_diff), _beyond(own, [gene, seq_key], "_y", min_diff)
    j = own.join(all_, [gene, "_y"]).join(same.withColumnsRenamed({"_above": "_same_above", "_below": "_same_below"}), [gene, seq_key, "_y"])
    n = lambda side: (F.col(f"_{side}") - F.col(f"_same_{side}")).alias(f"n_{side}")
    none = p.where(F.col("_y").isNull()).select(gene, id, *[F.lit(0).cast("bigint").alias(c) for c in ("n_above", "n_below")])
    part = j.select(gene, id, n("above"), n("below")).unionByName(none)
    return part.groupBy(gene, id).agg(F.sum("n_above").alias("n_above"), F.sum("n_below").alias("n_below"))


def allele_pair_counts(sites: DataFrame) -> DataFrame:
    """Per site, how many unordered sample pairs carry each unordered allele combination.

    Pairs are counted from allele counts: n_a * n_b across alleles, n(n-1)/2 within one.
    """
    c = sites.groupBy("gene", "pos", "allele").agg(F.count("*").alias("n"))
    arr = c.groupBy("gene", "pos").agg(F.array_sort(F.collect_list(F.struct("allele", "n"))).alias("a"))
    p = arr.select("gene", "pos", F.explode("a").alias("x"), "a").select("gene", "pos", "x", F.explode("a").alias("z")).where("x.allele <= z.allele")
    n = F.when(F.col("x.allele") == F.col("z.allele"), F.col("x.n") * (F.col("x.n") - 1) / 2).otherwise(F.col("x.n") * F.col("z.n"))
    return p.select("gene", "pos", F.col("x.allele").alias("a"), F.col("z.allele").alias("b"), n.cast("bigint").alias("n_pairs"))


def pair_attributes(pairs: DataFrame, a: str, b: str, attrs: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Attach attributes of both endpoints and their differences."""
    out = pairs
    for side, k in (("a", a), ("b", b)):
        out = out.join(attrs.select(F.col(key).alias(k), *[F.col(c).alias(f"{c}_{side}") for c in cols]), k)
    return out.withColumns({f"{c}_diff": F.col(f"{c}_a") - F.col(f"{c}_b") for c in cols})


def position_chain(map_pdb: DataFrame, map_ref: DataFrame) -> DataFrame:
    """Structure residue -> reference residue -> alignment column, chained over two maps."""
    return map_pdb.join(map_ref, ["gene", "residue_no"])
