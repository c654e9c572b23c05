"""Alignment-column operators on the long table sites(gene, pos, id, allele)."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cladeloom.functions import scales as sc
from cladeloom.functions.arith import draw
from cladeloom.operators.ordered import join_same, quantiles, row_index, running_sums

KEY = ["gene", "pos"]


def explode_sites(df: DataFrame, id: str, gene: str, seq: str, alphabet: str = sc.AMINO_ACIDS) -> DataFrame:
    """Aligned strings to long rows: upper-cased, anything outside the alphabet becomes a gap, positions from 1."""
    clean = F.regexp_replace(F.upper(F.col(seq)), f"[^{alphabet}]", "-")
    p = df.select(F.col(id).alias("id"), F.col(gene).alias("gene"), F.posexplode(F.split(clean, "")).alias("p", "allele"))
    return p.where("allele <> ''").select("gene", (F.col("p") + 1).alias("pos"), "id", "allele")


def unequal_lengths(df: DataFrame, gene: str, seq: str) -> DataFrame:
    """Genes whose aligned strings differ in length (must be empty before exploding)."""
    return df.groupBy(gene).agg(F.min(F.length(seq)).alias("min_len"), F.max(F.length(seq)).alias("max_len")).where("min_len < max_len")


def allele_counts(sites: DataFrame, gaps: bool = False) -> DataFrame:
    """The small table behind every site statistic: gene, pos, allele, n."""
    s = sites if gaps else sites.where(F.col("allele") != "-")
    return s.groupBy("gene", "pos", "allele").agg(F.count("*").alias("n"))


def _modal(counts: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Most frequent allele per site, smallest letter on ties."""
    arr = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "allele")))
    return counts.groupBy(*by).agg(arr.alias("a"), F.sum("n").alias("total"))


def consensus_state(df: DataFrame, by: Sequence[str], state: str) -> DataFrame:
    """Modal state, its share, number of states and Shannon entropy (bits)."""
    c = df.groupBy(*by, F.col(state).alias("allele")).agg(F.count("*").alias("n"))
    m = _modal(c, by)
    p = F.transform("a", lambda x: -x["m"] / F.col("total"))
    ent = F.aggregate(p, F.lit(0.0), lambda s, q: s - q * F.log2(q))
    return m.select(*by, F.col("a")[0]["allele"].alias("consensus"), (-F.col("a")[0]["m"] / F.col("total")).alias("consensus_freq"),
                    F.col("total").alias("n"), F.size("a").cast("bigint").alias("n_states"), ent.alias("entropy"))


def site_diversity(sites: DataFrame, min_n: int = 10) -> DataFrame:
    """pi, Watterson theta, Tajima proxy, minor frequency, effective alleles and gap share per site."""
    c = allele_counts(sites, gaps=True)
    g = c.groupBy(*KEY).agg(F.sum("n").alias("n_all"), F.coalesce(F.sum(F.when(F.col("allele") != "-", F.col("n"))), F.lit(0)).alias("n"),
                            F.count_if(F.col("allele") != "-").alias("k"),
                            F.sum(F.when(F.col("allele") != "-", F.col("n") * F.col("n"))).alias("sq"),
                            F.sort_array(F.collect_list(F.when(F.col("allele") != "-", F.col("n"))), False).alias("top"))
    harm = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / i)
    ss = F.col("sq") / (F.col("n") * F.col("n"))
    ok = F.col("n") >= min_n
    pi, theta = 1 - ss, (F.col("k") - 1) / harm
    return g.select(*KEY, "n", F.when(ok, pi).alias("pi"), F.when(ok, theta).alias("theta_w"), F.when(ok, pi - theta).alias("tajima"),
                    F.when(ok, F.coalesce(F.get("top", F.lit(1)), F.lit(0)) / F.col("n")).alias("maf"),
                    F.when(ok, 1 / ss).alias("n_eff"), ((F.col("n_all") - F.col("n")) / F.col("n_all")).alias("gap_freq"))


def maf_alleles_entropy(sites: DataFrame, min_minor: int = 10) -> DataFrame:
    """Minor frequency (0 when the second allele is rarer than `min_minor`), alleles, natural-log entropy, frequency variance."""
    g = allele_counts(sites).groupBy(*KEY).agg(F.sum("n").alias("n"), F.count("*").alias("n_alleles"),
                                               F.sort_array(F.collect_list("n"), False).alias("top"))
    p = F.transform("top", lambda x: x / F.col("n"))
    second = F.coalesce(F.get("top", F.lit(1)), F.lit(0))
    mean = 1 / F.col("n_alleles")
    var = F.when(F.col("n_alleles") > 1, F.aggregate(p, F.lit(0.0), lambda s, q: s + (q - mean) * (q - mean)) / (F.col("n_alleles") - 1))
    return g.select(*KEY, "n", "n_alleles", F.when(second >= min_minor, second / F.col("n")).otherwise(0.0).alias("maf"),
                    F.aggregate(p, F.lit(0.0), lambda s, q: s - q * F.log(q)).alias("entropy"), var.alias("freq_var"))


def alleles_per_site(sites: DataFrame) -> DataFrame:
    return allele_counts(sites).groupBy(*KEY).agg(F.count("*").alias("n_alleles"), F.array_join(F.array_sort(F.collect_list("allele")), ",").alias("alleles"))


def polymorphic_sites(sites: DataFrame) -> DataFrame:
    a = sites.select(*KEY, "allele").distinct().groupBy(*KEY).agg(F.count_if(F.col("allele") != "-").alias("k"))
    return a.groupBy("gene").agg(F.count_if(F.col("k") > 1).alias("n_polymorphic"), F.count("*").alias("length"),
                                 (F.count_if(F.col("k") > 1) / F.count("*")).alias("rate"))


def gap_counts(sites: DataFrame, by: Sequence[str]) -> DataFrame:
    g = F.count_if(F.col("allele") == "-")
    return sites.groupBy(*by).agg(g.alias("n_gaps"), (g / F.count("*")).alias("gap_fraction"))


def ungapped_index(sites: DataFrame, by: Sequence[str] = ("gene", "id")) -> DataFrame:
    """Residue number of each non-gap column along one aligned sequence (bounded by its length)."""
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(F.col("allele") != "-", 1).otherwise(0)).over(w)
    return sites.withColumn("residue_no", F.when(F.col("allele") != "-", run).cast("bigint"))


def consensus_ungapped_index(sites: DataFrame) -> DataFrame:
    """Residue numbers along each gene's consensus sequence."""
    c = consensus_state(sites, KEY, "allele").select(*KEY, F.col("consensus").alias("allele"), "consensus_freq")
    return ungapped_index(c, ["gene"])


def global_position(kept: DataFrame) -> DataFrame:
    """Running site number over (gene, pos), without a single-task window."""
    g = row_index(kept.select(*KEY).distinct(), ["gene", "pos"], out="global_pos")
    first = g.groupBy("gene").agg(F.min("global_pos").alias("_f"))
    return join_same(g, first, ["gene"]).select("gene", "pos", (F.col("global_pos") - F.col("_f") + 1).alias("gene_pos"), "global_pos")


# ---- encodings ------------------------------------------------------------

def major_minor(sites: DataFrame, gap_is_major: bool = False) -> DataFrame:
    """0 for the modal non-gap allele, 1 for any other, gap NULL (or: major-or-gap 1, else 0)."""
    m = _modal(allele_counts(sites)).select(*KEY, F.col("a")[0]["allele"].alias("major"))
    j = sites.join(m, KEY, "left")
    if gap_is_major:
        x = F.when((F.col("allele") == "-") | (F.col("allele") == F.col("major")), 1).otherwise(0)
    else:
        x = F.when(F.col("allele") == "-", None).when(F.col("allele") == F.col("major"), 0).otherwise(1)
    return j.select(*KEY, "id", x.cast("double").alias("x"))


def onehot_alleles(sites: DataFrame, alleles: Sequence[str]) -> DataFrame:
    """0/1 column per allele, NULL on gaps; no shuffle."""
    a = F.col("allele")
    return sites.select(*KEY, "id", *[F.when(a != "-", (a == x).cast("int")).alias(f"is_{x}") for x in alleles])


def aa_to_vector(sites: DataFrame, table: Mapping[str, Sequence[float]], unknown_zero: bool = False) -> DataFrame:
    """Property vector of each residue from a fixed table; unknown -> NULL or zeros."""
    k = len(next(iter(table.values())))
    m = F.create_map(*[x for aa, vec in table.items() for x in (F.lit(aa), F.array(*[F.lit(float(z)) for z in vec]))])
    vec = F.try_element_at(m, F.col("allele"))
    if unknown_zero:
        vec = F.coalesce(vec, F.array(*[F.lit(0.0)] * k))
    return sites.withColumn("vec", vec)


def supermatrix(sites: DataFrame) -> DataFrame:
    """One concatenated string per sample over all genes, `-` where a sample lacks a site.

    Only the site list (bounded by the alignment) is shared; sample rows stay distributed.
    """
    gp = global_position(sites)
    width = gp.agg(F.max("global_pos")).scalar()
    s = sites.join(gp.select("gene", "pos", "global_pos"), KEY)
    rows = s.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("global_pos", "allele"))).alias("m"))
    rows = rows.withColumn("_w", width)
    chars = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("_w")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("-")))
    return rows.select("id", F.array_join(chars, "").alias("seq"))


def partition_map(sites: DataFrame) -> DataFrame:
    return global_position(sites)


def impute(long: DataFrame, column: Sequence[str], value: str, how: str = "median", train: Column | None = None,
           key: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Fill NULLs per column with the (train) median, zero, or a hash-chosen observed value."""
    if how == "zero":
        return long.withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))
    obs = long.where(F.col(value).isNotNull() & (F.lit(True) if train is None else train))
    if how == "median":
        med = quantiles(obs, value, {"_fill": 0.5}, column).select(*column, "_fill")
        return join_same(long, med, column, "left").withColumn(value, F.coalesce(F.col(value), F.col("_fill"))).drop("_fill")
    if how != "random":
        raise ValueError(how)
    pool = row_index(obs.select(*column, value, *key), [*key], column, "_i").select(*column, "_i", F.col(value).alias("_fill"))
    n = pool.groupBy(*column).agg(F.max("_i").alias("_n"))
    want = join_same(long, n, column, "left")
    pick = F.when(F.col(value).isNull(), draw(*key, seed=seed) % F.col("_n") + 1)
    return join_same(want.withColumn("_i", pick), pool, [*column, "_i"], "left").withColumn(
        value, F.coalesce(F.col(value), F.col("_fill"))).drop("_i", "_n", "_fill")


def standardize(long: DataFrame, column: Sequence[str], value: str, out: str = "z") -> DataFrame:
    st = long.groupBy(*column).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return join_same(long, st, column).withColumn(out, F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def position_variance_filter(sites: DataFrame, table: Mapping[str, Sequence[float]], min_var: float = 0.1) -> DataFrame:
    """Sites whose summed population variance over the property factors reaches `min_var`.

    Works from allele counts: copies of an allele share one vector.
    """
    k = len(next(iter(table.values())))
    c = aa_to_vector(allele_counts(sites), table).where("vec is not null")
    tot = F.sum("n")
    v = None
    for i in range(k):
        x = F.col("vec")[i]
        term = F.sum(F.col("n") * x * x) / tot - (F.sum(F.col("n") * x) / tot) * (F.sum(F.col("n") * x) / tot)
        v = term if v is None else v + term
    return c.groupBy(*KEY).agg(v.alias("var_sum")).where(F.col("var_sum") >= min_var)


def label_encode(df: DataFrame, col: str, out: str) -> DataFrame:
    """Alphabetical code from 0, numbered on the distinct values."""
    codes = row_index(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], out=out)
    return df.join(codes.withColumn(out, F.col(out) - 1), col, "left")


def presence_stats(df: DataFrame, gene: str, id: str, cuts: Sequence[float] = (0.90, 0.95, 0.98, 0.99)) -> DataFrame:
    """Mean presence over genes and number of genes above each presence share."""
    n = df.select(id).distinct().agg(F.count("*")).scalar()
    p = df.select(gene, id).distinct().groupBy(gene).agg((F.count("*") / n).alias("share"))
    return p.agg(F.avg("share").alias("mean_presence"), F.count("*").alias("n_genes"),
                 *[F.count_if(F.col("share") > c).alias(f"above_{int(round(c * 100))}") for c in cuts])


def relative_position(df: DataFrame, start: str, end: str, size: str) -> Column:
    return (F.col(start) + F.col(end)) / 2 / F.col(size)


def column_null_filter(df: DataFrame, id: str, cols: Sequence[str], max_null: float = 0.10) -> DataFrame:
    """Long form of the columns whose NULL share is below the cut, gaps filled with the column median."""
    long = df.select(id, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([id], list(cols), "variable", "value")
    ok = (long.groupBy("variable").agg(F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).alias("_s"))
          .where(F.col("_s") < max_null).select("variable"))
    return impute(long.join(ok, "variable", "left_semi"), ["variable"], "value", "median")
