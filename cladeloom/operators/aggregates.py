"""Grouped summaries.  Everything combines map-side; value lists are never collected whole."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from cladeloom.operators.ordered import halo_buckets, join_same, quantiles, row_index, running_sums, value_ranks
from cladeloom.operators.pairs import chunk_pairs
from cladeloom.session import materialize


def value_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def summary_stats(df: DataFrame, distinct: Mapping[str, str], ranged: Sequence[str]) -> DataFrame:
    """Row count, distinct counts and ranges in one pass (distincts are de-duplicated before the merge)."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_distinct(c).alias(k) for k, c in distinct.items()],
                  *[f(c).alias(f"{n}_{c}") for c in ranged for n, f in (("min", F.min), ("max", F.max))])


def retention_report(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """Rows surviving each cumulative filter and the share kept, in one scan."""
    ok = F.lit(True)
    aggs = []
    for i, (name, cond) in enumerate(stages.items()):
        ok = ok & F.coalesce(cond, F.lit(False))
        aggs.append(F.struct(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), F.count_if(ok).alias("kept")))
    r = df.agg(F.count("*").alias("processed"), F.array(*aggs).alias("s"))
    return (r.select("processed", F.explode("s").alias("s"))
            .select("s.stage_no", "s.stage", "processed", "s.kept", (F.col("s.kept") / F.col("processed")).alias("rate")))


def group_moments(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    sd, n, m = F.stddev_samp(x), F.count(x), F.avg(x)
    return df.groupBy(*by).agg(n.alias("n"), m.alias("mean"), sd.alias("sd"), (sd / F.sqrt(n)).alias("se"),
                               F.when(m != 0, sd / m).alias("cv"), (F.max(x) - F.min(x)).alias("range"))


def majority_label(df: DataFrame, key: Sequence[str], label: Column, skip: Sequence[str] = ()) -> DataFrame:
    """Most frequent normalised label per key; ties go to the smallest label."""
    t = df.select(*key, label.alias("label")).where(F.col("label").isNotNull())
    if skip:
        t = t.where(~F.col("label").isin(*skip))
    n = t.groupBy(*key, "label").agg(F.count("*").alias("n"))
    best = n.groupBy(*key).agg(F.max("n").alias("n"))
    return join_same(n.withColumnRenamed("n", "_n"), best, list(key)).where("_n = n").groupBy(*key, "n").agg(F.min("label").alias("label"))


def conflicting_keys(df: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """Keys that carry more than one distinct label."""
    return (df.groupBy(*key).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a < _b").select(*key))


def best_genome_summary(df: DataFrame, organism: str) -> DataFrame:
    g = df.groupBy(organism).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("n_organisms"), F.count_if(F.col("n") == 1).alias("n_singletons"),
                 F.count_if(F.col("n") > 1).alias("n_duplicated"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("n_surplus"))


def proportion_within(df: DataFrame, by: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Count per group and its share of the coarser group."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    tot = n.groupBy(*within).agg(F.sum("n").alias("total"))
    return join_same(n, tot, list(within)).withColumn("share", F.col("n") / F.col("total"))


def median_pivot(df: DataFrame, by: Sequence[str], kind: str, kinds: Sequence[str], value: str) -> DataFrame:
    """Median of replicate measurements, one column per kind, log10 (non-positive -> NULL)."""
    m = quantiles(df, value, {"med": 0.5}, [*by, kind])
    wide = m.groupBy(*by).agg(*[F.max(F.when(F.col(kind) == k, F.col("med"))).alias(k) for k in kinds])
    return wide.withColumns({f"log10_{k}": F.when(F.col(k) > 0, F.log10(F.col(k))) for k in kinds})


def weighted_mean(df: DataFrame, by: Sequence[str], x: str, w: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(w).alias("weight"), (F.sum(F.col(x) * F.col(w)) / F.sum(w)).alias("mean"))


def gene_order_signature(df: DataFrame, genome: str, gene: str, start: str, min_share: float = 0.9) -> DataFrame:
    """Order pattern of the widely present genes per genome and how many genomes share it."""
    first = df.groupBy(genome, gene).agg(F.min(start).alias("_s"))
    n = first.select(genome).distinct().agg(F.count("*")).scalar()
    common = first.groupBy(gene).agg(F.count("*").alias("_n")).where(F.col("_n") > min_share * n).select(gene)
    arr = F.array_sort(F.collect_list(F.struct("_s", F.col(gene).alias("g"))))
    pat = first.join(common, gene, "left_semi").groupBy(genome).agg(F.array_join(F.transform(arr, lambda x: x["g"].cast("string")), ">").alias("pattern"))
    return pat.groupBy("pattern").agg(F.count("*").alias("n_genomes"))


def haplotype_counts(sites: DataFrame, keep: Column) -> DataFrame:
    """Distinct sample haplotypes over the kept sites and how often each occurs."""
    arr = F.array_sort(F.collect_list(F.struct("gene", "pos", "allele")))
    h = sites.where(keep).groupBy("id").agg(arr.alias("a"))
    text = F.array_join(F.transform("a", lambda x: F.concat(x["gene"], F.lit(":"), x["pos"].cast("string"), x["allele"])), ",")
    return h.groupBy(text.alias("haplotype")).agg(F.count("*").alias("n"))


def largest_hit(df: DataFrame, by: Sequence[str], length: str, order: str, cols: Sequence[str]) -> DataFrame:
    """Longest hit per group; the earliest row wins a tie."""
    return df.groupBy(*by).agg(F.max_by(F.struct(length, *cols), F.struct(F.col(length), -F.col(order))).alias("_h")).select(*by, "_h.*")


def histogram(df: DataFrame, x: str, lo: float, width: float, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.floor((F.col(x) - lo) / width).alias("bin")).agg(F.count("*").alias("n"))


def bin2d(df: DataFrame, x: str, y: str, wx: float, wy: float, z: str | None = None) -> DataFrame:
    aggs = [F.count("*").alias("n")] + ([F.avg(z).alias("mean_z")] if z else [])
    return df.groupBy(F.floor(F.col(x) / wx).alias("bin_x"), F.floor(F.col(y) / wy).alias("bin_y")).agg(*aggs)


def quantile_bin_means(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Means within quantile bins of x; equal values always share a bin."""
    names = {f"b{i}": i / bins for i in range(1, bins)}
    q = quantiles(df, x, names).select(F.array(*names).alias("b")).scalar()
    t = df.withColumn("_b", q)
    no = F.size(F.filter("_b", lambda b: b < F.col(x)))
    return t.groupBy(no.alias("bin")).agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
                                          (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("se_y"))


def mad_outliers(points: DataFrame, species: str, key: str, lat: str, lon: str, k: float) -> DataFrame:
    """Mean great-circle distance (km) of each distinct location to all other points of its
    species; kept when not above median + k * MAD.

    Copies of a location are weighted, not repeated, and a species of any size is cut
    into chunk pairs.
    """
    loc = (points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
           .groupBy(species, lat, lon).agg(F.count("*").cast("double").alias("_w"), F.min(key).alias("_key")))

    def kernel(a, b, same):
        la, oa, lb, ob = (np.radians(z.astype(float)) for z in (a[lat], a[lon], b[lat], b[lon]))
        h = np.sin((la[:, None] - lb) / 2) ** 2 + np.cos(la)[:, None] * np.cos(lb) * np.sin((oa[:, None] - ob) / 2) ** 2
        dist = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
        keys, sums = [a["_key"]], [dist @ b["_w"]]
        if not same:
            keys.append(b["_key"])
            sums.append(a["_w"] @ dist)
        return {"_key": np.concatenate(keys), "_s": np.concatenate(sums)}

    sums = chunk_pairs(loc, [species], "_key", [lat, lon, "_w"], kernel, "_key bigint, _s double")
    tot = loc.groupBy(species).agg(F.sum("_w").alias("_n"))
    m = join_same(sums.groupBy(species, "_key").agg(F.sum("_s").alias("_s")), tot, [species])
    m = m.withColumn("mean_dist", F.when(F.col("_n") > 1, F.col("_s") / (F.col("_n") - 1)).otherwise(0.0))
    m = join_same(m, loc.select(species, "_key", lat, lon, "_w"), [species, "_key"])
    m = materialize(m)
    med = weighted_median(m, "mean_dist", "_w", species, "_med")
    dev = join_same(m, med, [species]).withColumn("_dev", F.abs(F.col("mean_dist") - F.col("_med")))
    mad = weighted_median(dev, "_dev", "_w", species, "_mad")
    out = join_same(dev, mad, [species])
    return out.select(species, lat, lon, F.col("_w").cast("bigint").alias("n_points"), "mean_dist",
                      (F.col("mean_dist") > F.col("_med") + k * F.col("_mad")).alias("is_outlier"))


def weighted_median(df: DataFrame, value: str, weight: str, by: str, out: str) -> DataFrame:
    """Median over rows that each stand for `weight` copies."""
    r = value_ranks(df, value, [by], F.col(weight))
    tot = r.groupBy(by).agg(F.sum("n").alias("_t"))
    r = join_same(r, tot, [by])
    lo, hi = F.floor((F.col("_t") - 1) / 2), F.floor(F.col("_t") / 2)
    at = lambda i: F.max(F.when((F.col("cum_n") > i) & (F.col("cum_n") - F.col("n") <= i), F.col(value)))
    return r.groupBy(by).agg(((at(lo) + at(hi)) / 2).alias(out))


# ---- windows --------------------------------------------------------------

def best_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group by explicit keys and directions (row_number prunes before the shuffle)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def argmin_per_group(df: DataFrame, by: Sequence[str], value: str, tie: str) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(value, tie)).alias("_r")).select(*by, "_r.*")


def first_mapping_per_key(df: DataFrame, by: Sequence[str], value: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(F.struct(*value), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def break_runs(df: DataFrame, by: Sequence[str], order: Sequence[str], state: str, index: str | None = None, max_gap: int = 2) -> DataFrame:
    """Number runs: a new one starts at the first row, a state change, or an index gap above `max_gap`.

    The look-back needs one row and the run number is a running sum, so a group of any
    size is worked on in buckets.
    """
    h = halo_buckets(df, order, by, before=1)
    w = Window.partitionBy(*by, "_bucket").orderBy("_i")
    new = F.lag("_i").over(w).isNull() | ~F.lag(state).over(w).eqNullSafe(F.col(state))
    if index:
        new = new | F.coalesce(F.col(index) - F.lag(index).over(w) > max_gap, F.lit(False))
    f = h.withColumn("_new", new.cast("int")).where("_own").drop("_bucket", "_own")
    r = running_sums(f, {"run": F.col("_new")}, ["_i"], by)
    return r.withColumn("run", F.col("run").cast("bigint")).drop("_new", "_i")


def run_aggregate(runs: DataFrame, by: Sequence[str], order: str, state: str) -> DataFrame:
    return runs.groupBy(*by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"),
                                        F.min_by(state, order).alias("state"))


def rolling_mean(df: DataFrame, by: Sequence[str], order: Sequence[str], x: str, width: int = 15) -> DataFrame:
    """Centred rolling mean, NULL where the window is incomplete; large groups are cut into overlapping buckets."""
    h = width // 2
    b = halo_buckets(df, order, by, before=h, after=h)
    w = Window.partitionBy(*by, "_bucket").orderBy("_i").rowsBetween(-h, h)
    r = b.withColumn("rolling", F.when(F.count(x).over(w) == width, F.avg(x).over(w)))
    return r.where("_own").drop("_bucket", "_own", "_i")


def cumulative_offsets(df: DataFrame, gene: str, length: str) -> DataFrame:
    """Start offset and midpoint of each gene laid end to end (one row per gene)."""
    lens = df.groupBy(gene).agg(F.max(length).cast("bigint").alias("len"))
    r = running_sums(lens, {"end": F.col("len")}, [gene])
    return r.select(gene, "len", (F.col("end") - F.col("len")).alias("offset"), (F.col("end") - F.col("len") / 2).alias("midpoint"))


def zscore_within(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """z-scores with the sample sd of each group; statistics are joined, not windowed."""
    st = df.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    j = join_same(df, st, list(by))
    return j.withColumns({f"z_{c}": F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in cols}).drop(
        *[f"_{n}_{c}" for c in cols for n in "ms"])


def ntile_column(index: Column, total: Column, bins: int) -> Column:
    """ntile from a 1-based position: the first total % bins bins take one row more."""
    base, extra = F.floor(total / bins), total % bins
    cut = extra * (base + 1)
    return F.when(index <= cut, F.floor((index - 1) / (base + 1)) + 1).otherwise(extra + F.floor((index - 1 - cut) / F.greatest(base, F.lit(1))) + 1)


def ntile_calibration(df: DataFrame, pred: str, observed: Column, tie: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean prediction and observed rate in equal-count bins, numbered without a global window."""
    t = row_index(df.withColumn("_obs", observed), [pred, *tie], out="_i")
    n = df.agg(F.count("*")).scalar()
    return t.groupBy(ntile_column(F.col("_i"), n, bins).cast("bigint").alias("bin")).agg(
        F.avg(pred).alias("mean_pred"), F.avg("_obs").alias("rate"), F.count("*").alias("n"))


def qq_table(df: DataFrame, p: str, tie: Sequence[str]) -> DataFrame:
    """Observed against expected -log10 p (plotting positions (i-a)/(n+1-2a))."""
    t = row_index(df.where(F.col(p).isNotNull()), [p, *tie], out="i").withColumn("n", df.where(F.col(p).isNotNull()).agg(F.count("*")).scalar())
    a = F.when(F.col("n") <= 10, 3 / 8).otherwise(0.5)
    return t.withColumn("expected", -F.log10((F.col("i") - a) / (F.col("n") + 1 - 2 * a))).withColumn("observed", -F.log10(F.col(p)))
