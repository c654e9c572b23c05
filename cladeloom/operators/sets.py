"""Set operations on key columns, top-k and sampling."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cladeloom.functions.arith import draw
from cladeloom.operators.ordered import row_index


def union_tagged(sources: Mapping[str, DataFrame], tag: str = "package") -> DataFrame:
    """Stack sources by column name with a tag; columns missing in one source become NULL."""
    out = None
    for name, df in sources.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def intersect_keys(df: DataFrame, key: str, source: str) -> DataFrame:
    """Keys present in every source: one grouped count instead of n intersections."""
    n = df.select(source).distinct().agg(F.count("*")).scalar()
    return (df.select(key, source).distinct().groupBy(key).agg(F.count("*").alias("_n"))
            .where(F.col("_n") == n).select(key))


def union_keys(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def difference_or_rare(universe: DataFrame, observed: DataFrame, key: str, min_count: int = 10) -> DataFrame:
    """Universe keys never observed, or observed fewer than `min_count` times, with their count."""
    n = observed.groupBy(key).agg(F.count("*").alias("n_observed"))
    return (universe.select(key).distinct().join(n, key, "left")
            .withColumn("n_observed", F.coalesce("n_observed", F.lit(0)))
            .where(F.col("n_observed") < min_count))


def distinct_rows(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """One row per key, the first by an explicit order; combines map-side (no window)."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*"))


def overlap_summary(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """|A|, |B|, |A and B|, |A - B|, |B - A| of two key sets in one grouped pass."""
    tagged = (a.select(key).distinct().withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
              .union(b.select(key).distinct().withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))))
    per = tagged.groupBy(key).agg(F.max("_a").alias("a"), F.max("_b").alias("b"))
    i = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return per.agg(i(F.col("a") == 1).alias("n_a"), i(F.col("b") == 1).alias("n_b"),
                   i((F.col("a") == 1) & (F.col("b") == 1)).alias("n_both"),
                   i((F.col("a") == 1) & (F.col("b") == 0)).alias("a_only"),
                   i((F.col("a") == 0) & (F.col("b") == 1)).alias("b_only"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank_no") -> DataFrame:
    """First k rows per group; Spark prunes to k rows per group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def sample_fraction(df: DataFrame, key: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Seeded sample that does not depend on partitioning: keep keys whose hash falls below a cut."""
    m = 1_000_000
    return df.where(F.pmod(draw(*key, seed=seed), F.lit(m)) < int(fraction * m))


def sample_budget(df: DataFrame, by: Sequence[str], key: Sequence[str], total: int, seed: int = 42) -> DataFrame:
    """Equal share of a global row budget per group, by hash cut (expected size, whole groups if small)."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    share = F.lit(float(total)) / sizes.agg(F.count("*")).scalar()
    m = 1_000_000
    cut = sizes.withColumn("_cut", F.least(F.lit(1.0), share / F.col("_n")) * m).drop("_n")
    return (df.join(cut, list(by)).where(F.pmod(draw(*key, seed=seed), F.lit(m)) < F.col("_cut")).drop("_cut"))


def stratified_balanced_sample(df: DataFrame, positive: Column, stratum: Sequence[str], key: Sequence[str],
                               k: int, seed: int = 42) -> DataFrame:
    """All positives plus, per stratum, the k negatives that come first in hash order."""
    tagged = df.withColumns({"_pos": positive, "_h": draw(*key, seed=seed)})
    neg = top_k_per_group(tagged.where(~F.col("_pos")), stratum, [F.col("_h"), *[F.col(c) for c in key]], k, "_rn").drop("_rn")
    return tagged.where("_pos").unionByName(neg).drop("_pos", "_h")


def holdout_split(df: DataFrame, key: Sequence[str], train: float = 0.7, seed: int = 42, out: str = "is_train") -> DataFrame:
    m = 1_000_000
    return df.withColumn(out, F.pmod(draw(*key, seed=seed), F.lit(m)) < int(train * m))


def split_batches(df: DataFrame, order: Sequence[str], size: int, by: Sequence[str] = ()) -> DataFrame:
    """Fixed-size batches along an order, numbered from 0."""
    r = row_index(df, order, by, "_rn")
    return r.withColumn("batch", F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def top_participants(pairs: DataFrame, a: str, b: str, order: Sequence[Column], k: int) -> DataFrame:
    """How often each member appears among the k best pairs."""
    return (pairs.orderBy(*order).limit(k).select(F.explode(F.array(a, b)).alias("member"))
            .groupBy("member").agg(F.count("*").alias("n")))
