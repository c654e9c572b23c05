"""Ranks, running sums and exact quantiles that survive one group holding most rows.

A plain window sends a whole group to one task.  Here rows are range-partitioned
on (group, order), so a large group is cut into consecutive blocks; each block is
summed by itself and the totals of the earlier blocks (at most one row per
partition and group) are added afterwards.
"""
from __future__ import annotations

from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cladeloom.session import materialize


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named keys where NULL matches NULL; one copy of the keys is kept."""
    if not keys:
        raise ValueError("join_same needs at least one key")
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def range_blocks(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Add `_blk`: consecutive block number along (by, order).

    The result is checkpointed because range boundaries are sampled: two branches
    that sampled separately could disagree.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(n, *[F.col(c) for c in (*by, *order)])
    return materialize(out.withColumn("_blk", F.spark_partition_id()))


def _offsets(totals: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums over `_blk` of per-block totals (few rows per group)."""
    w = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_blk", *by, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_off_{c}") for c in cols])


def running_sums(df: DataFrame, values: dict[str, Column], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sum of each expression along (by, order).

    Rows that tie on (by, order) stay in one block, so give a unique order (or
    distinct values with counts) when the running sum must be unambiguous.
    """
    src = df.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()])
    b = range_blocks(src, order, by)
    keys = ["_blk", *by]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumns({k: F.sum(f"_v_{k}").over(w) for k in values})
    totals = b.groupBy(*keys).agg(*[F.sum(f"_v_{k}").alias(k) for k in values])
    joined = join_same(local, _offsets(totals, by, list(values)), keys)
    out = joined.withColumns({k: F.col(k) + F.col(f"_off_{k}") for k in values})
    return out.drop("_blk", *[f"_v_{k}" for k in values], *[f"_off_{k}" for k in values])


def suffix_min(df: DataFrame, value: Column, order: Sequence[str], out: str, by: Sequence[str] = ()) -> DataFrame:
    """Smallest `value` at or after each row along (by, order)."""
    b = range_blocks(df.withColumn("_v", value), order, by)
    keys = ["_blk", *by]
    # running from the far end: a frame open towards the end would rescan the block for every row
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumn("_local", F.min("_v").over(back))
    tot = b.groupBy(*keys).agg(F.min("_v").alias("_m"))
    later = Window.partitionBy(*by).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*keys, F.min("_m").over(later).alias("_later"))
    return (join_same(local, off, keys).withColumn(out, F.least("_local", "_later")).drop("_blk", "_v", "_local", "_later"))


def lead_value(df: DataFrame, value: str, order: Sequence[str], out: str, by: Sequence[str] = ()) -> DataFrame:
    """`value` of the next row along (by, order), NULL at the end of a group; give a unique order."""
    b = range_blocks(df, order, by)
    keys = ["_blk", *by]
    local = b.withColumn("_local", F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)))
    # the first row of the group's next block, for the last row of each block
    first = b.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("_m"))
    after = first.select(*keys, F.lead("_m").over(Window.partitionBy(*by).orderBy("_blk")).alias("_after"))
    return join_same(local, after, keys).withColumn(out, F.coalesce("_local", "_after")).drop("_blk", "_local", "_after")


def row_index(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "row_no") -> DataFrame:
    """1-based position along (by, order) with no single-task window."""
    res = running_sums(df, {out: F.lit(1)}, order, by)
    return res.withColumn(out, F.col(out).cast("bigint"))


def halo_buckets(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), before: int = 0, after: int = 0, size: int = 100_000) -> DataFrame:
    """Cut each ordered group into buckets of `size` rows and lend `before` / `after` rows to the neighbours.

    A frame of that reach can then run per (by, _bucket), however large the group is;
    keep the rows with `_own` afterwards.  `_i` is the position in the group.
    """
    r = row_index(df, order, by, "_i")
    at = lambda shift: F.floor((F.col("_i") - 1 + shift) / size)
    home = at(0)
    r = r.withColumn("_bucket", F.explode(F.array_distinct(F.array(home, at(before), at(-after)))))
    return r.withColumn("_own", F.col("_bucket") == home)


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """One row per distinct (by, value): count `n`, cumulative `cum_n`, average `avg_rank`.

    Copies of a value are pre-aggregated before anything is shuffled by order.
    """
    counts = (df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
              .groupBy(*by, value)
              .agg(F.sum(F.lit(1) if weight is None else weight).cast("bigint").alias("n")))
    run = running_sums(counts, {"cum_n": F.col("n")}, [value], by)
    return run.withColumn("avg_rank", F.col("cum_n") - (F.col("n") - 1) / 2)


def with_avg_rank(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Attach the tie-averaged rank of `value` within `by` to every row."""
    ranks = value_ranks(df, value, by).select(*by, value, F.col("avg_rank").alias(out))
    return join_same(df, ranks, [*by, value])


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (type 7), one column per name, plus `n`; `weight` says how often a row counts.

    Works on distinct values with cumulative counts, so neither a histogram of a
    large group nor the group itself has to fit one task.
    """
    ranks = value_ranks(df, value, by, weight)
    totals = ranks.groupBy(*by).agg(F.sum("n").alias("_total")) if by else ranks.agg(F.sum("n").alias("_total"))
    if by:
        r = join_same(ranks, totals, list(by))
    else:
        r = ranks.withColumn("_total", totals.scalar())
    aggs = [F.max("_total").alias("n")]
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        for tag, idx in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("cum_n") > idx) & (F.col("cum_n") - F.col("n") <= idx)
            aggs.append(F.max(F.when(hit, F.col(value))).cast("double").alias(f"_{tag}_{name}"))
    g = r.groupBy(*by).agg(*aggs)
    cols = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        cols.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (pos - F.floor(pos))).alias(name))
    return g.select(*by, *cols, "n")


def quantile_column(df: DataFrame, value: str, p: float) -> Column:
    """The exact global quantile as a scalar subquery, usable inside any expression."""
    return quantiles(df, value, {"q": p}).select("q").scalar()
