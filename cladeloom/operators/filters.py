"""Row filters and rule-based labels."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cladeloom.operators.ordered import join_same, quantile_column


def _any(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def clade_filter(df: DataFrame, col: str, keep: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """Keep rows whose lineage text holds any `keep` name and no `drop` name; NULL never matches."""
    text = F.coalesce(F.col(col), F.lit(""))
    out = df
    if keep:
        out = out.where(_any([text.contains(k) for k in keep]))
    if drop:
        out = out.where(~_any([text.contains(k) for k in drop]))
    return out


def range_filter(df: DataFrame, limits: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Inclusive numeric bounds per column; None leaves a side open."""
    for c, (lo, hi) in limits.items():
        if lo is not None:
            df = df.where(F.col(c) >= lo)
        if hi is not None:
            df = df.where(F.col(c) <= hi)
    return df


def coord_filter(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Both coordinates present, not the (0, 0) default, inside valid ranges."""
    a, o = F.col(lat), F.col(lon)
    return df.where(a.isNotNull() & o.isNotNull() & ~((a + o == 0) & (a - o == 0)) & a.between(-90, 90) & o.between(-180, 180))


def recent_filter(df: DataFrame, year: str, after: int = 2000) -> DataFrame:
    return df.where(F.col(year).isNotNull() & (F.col(year) > after))


def name_in_set(df: DataFrame, a: Column, b: Column, keys: DataFrame, key: str) -> DataFrame:
    """Rows for which either normalised name is in the key set; two semi-joins, no OR join."""
    cols = df.columns
    named = df.withColumns({"_a": a, "_b": b})
    ks = keys.select(F.col(key).alias("_k")).distinct()
    first = named.join(ks, F.col("_a") == F.col("_k"), "left_semi")
    rest = named.join(ks, F.col("_a") == F.col("_k"), "left_anti").join(ks, F.col("_b") == F.col("_k"), "left_semi")
    return first.select(cols).unionByName(rest.select(cols))


def length_outlier(df: DataFrame, by: Sequence[str], length: str, n_sd: float = 3.0, slack: float = 0.0) -> DataFrame:
    """Flag lengths outside mean +- n_sd sample sd of their gene (bounds inclusive, optional slack)."""
    stats = df.groupBy(*by).agg(F.avg(length).alias("len_mean"), F.stddev_samp(length).alias("len_sd"))
    out = join_same(df, stats, list(by))
    lo = F.col("len_mean") - n_sd * F.col("len_sd") - slack
    hi = F.col("len_mean") + n_sd * F.col("len_sd") + slack
    return out.withColumn("is_outlier", ~F.col(length).between(lo, hi))


def valid_sequence(df: DataFrame, seq: str, min_len: int, pattern: str = "^[ACDEFGHIKLMNPQRSTVWY]+$") -> DataFrame:
    return df.where((F.length(seq) >= min_len) & F.col(seq).rlike(pattern))


def site_gap_filter(sites: DataFrame, max_gap: float, inclusive: bool = False) -> DataFrame:
    """Keep alignment columns whose gap share is below (or at) `max_gap`."""
    share = F.avg(F.when(F.col("allele") == "-", 1.0).otherwise(0.0))
    g = sites.groupBy("gene", "pos").agg(share.alias("_g"))
    kept = g.where(F.col("_g") <= max_gap if inclusive else F.col("_g") < max_gap).select("gene", "pos")
    return sites.join(kept, ["gene", "pos"], "left_semi")


def site_qc(sites: DataFrame, min_samples: int, min_alleles: int = 2) -> DataFrame:
    """Alignment columns with enough non-gap samples and at least two non-gap alleles."""
    per_allele = sites.where(F.col("allele") != "-").groupBy("gene", "pos", "allele").agg(F.count("*").alias("n"))
    return (per_allele.groupBy("gene", "pos").agg(F.sum("n").alias("n_samples"), F.count("*").alias("n_alleles"))
            .where((F.col("n_samples") >= min_samples) & (F.col("n_alleles") >= min_alleles)))


def drop_invariant(long: DataFrame, column: Sequence[str], value: str) -> DataFrame:
    """Long-form removal of columns with a single distinct value."""
    kept = (long.groupBy(*column).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
            .where(F.col("_a") < F.col("_b")).select(*column))
    return long.join(kept, list(column), "left_semi")


def complete_cases(df: DataFrame, subset: Sequence[str], how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=list(subset))


def sentinel_to_null(df: DataFrame, cols: Sequence[str], sentinels: Sequence[float] = (-99.0, -999.0),
                     second: float | None = None) -> DataFrame:
    """Sentinels and infinities become NULL; `second` only in columns that then hold no NULL."""
    inf = float("inf")
    out = df.withColumns({c: F.when(~F.col(c).isin(*sentinels, inf, -inf), F.col(c)) for c in cols})
    if second is None:
        return out
    nulls = out.agg(F.struct(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).alias("s")).scalar()
    return out.withColumns({c: F.when((nulls[c] > 0) | (F.col(c) != second), F.col(c)) for c in cols})


def min_group_size(df: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    big = df.groupBy(*by).count().where(F.col("count") >= k).select(*by)
    return df.join(big, list(by), "left_semi")


def classify(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """Label from rules where a later matching rule overrides an earlier one."""
    out: Column = F.lit(default)
    for cond, label in rules:
        out = F.when(cond, label).otherwise(out)
    return out


def site_class(df: DataFrame, p_with: str, p_only: str, q_with: float = 0.05, q_only: float = 0.20) -> DataFrame:
    """sig_both / sig_control / sig_nocontrol / not_sig from two strict quantile cuts."""
    a = F.col(p_with) < quantile_column(df, p_with, q_with)
    b = F.col(p_only) < quantile_column(df, p_only, q_only)
    label = (F.when(a & b, "sig_both").when(a, "sig_control").when(b, "sig_nocontrol").otherwise("not_sig"))
    return df.withColumn("site_class", label)


def variant_class(df: DataFrame, site_class_col: str, p: str, alpha: float = 0.05) -> Column:
    return F.when(F.col(p) >= alpha, "not_sig").otherwise(F.col(site_class_col))
