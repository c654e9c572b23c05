"""Set-returning sequence operators."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cladeloom.functions.arith import draw
from cladeloom.functions import kmers as km, scales as sc, sequence as sq
from cladeloom.operators.ordered import quantiles, row_index


#: Rows of k-mers that a task gathers before it hands them on.
GATHER = 1 << 17


def repeats(df: DataFrame, id: str) -> bool:
    """Whether an id stands in more than one row, so that what is found in a row is only a part."""
    return not df.groupBy(id).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()


def _own_kmers(df: DataFrame, id: str, seq: str, k: int, step: int, canonical: bool, carry: Sequence[str] = ()) -> DataFrame:
    """(id, kmer, cnt, carry...): the distinct k-mers of every row, found within the row."""
    types, keep = dict(df.dtypes), [id, *carry]

    def run(batches):
        held, n = [], 0

        def out():
            rows = pa.concat_tables(held).combine_chunks().to_batches()
            held.clear()
            return rows

        for batch in batches:
            seqs = batch.column(batch.schema.get_field_index(seq))
            for i, x in enumerate(seqs):
                text = x.as_py()
                if text is None:
                    continue
                names, cnt = km.distinct_kmers(text, k, step, canonical)
                at = pa.array(np.full(len(cnt), i))
                of = {c: batch.column(batch.schema.get_field_index(c)).take(at) for c in keep}
                held.append(pa.table({id: of[id], "kmer": names, "cnt": pa.array(cnt, pa.int64()), **{c: of[c] for c in carry}}))
                n += len(cnt)
                if n > GATHER:
                    yield from out()
                    n = 0
        if held:
            yield from out()

    schema = ", ".join([f"`{id}` {types[id]}", "kmer string", "cnt bigint", *[f"`{c}` {types[c]}" for c in carry]])
    return df.select(*dict.fromkeys([id, seq, *carry])).mapInArrow(run, schema)


def kmer_counts(df: DataFrame, id: str, seq: str, k: int, step: int = 1, canonical: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """(id, kmer, cnt, carry...): counted within the row, and added up only where ids repeat; `carry` holds columns of the id."""
    own = _own_kmers(df, id, seq, k, step, canonical, carry)
    if not repeats(df, id):
        return own
    return own.groupBy(id, "kmer").agg(F.sum("cnt").alias("cnt"), *[F.max(c).alias(c) for c in carry])


def kmer_summary(df: DataFrame, id: str, seq: str, k: int, canonical: bool = False) -> DataFrame:
    """(id, total, n_distinct, top_count, first_kmer) of ids with a k-mer, within the row where ids do not repeat."""
    if repeats(df, id):
        c = kmer_counts(df, id, seq, k, canonical=canonical)
        return c.groupBy(id).agg(F.sum("cnt").alias("total"), F.count("*").alias("n_distinct"), F.max("cnt").alias("top_count"), F.min("kmer").alias("first_kmer"))

    def run(batches):
        for pdf in batches:
            rows = []
            for i, text in zip(pdf[id], pdf[seq]):
                names, cnt = km.distinct_kmers(text, k, 1, canonical) if text is not None else ((), ())
                if len(cnt):
                    rows.append((i, int(cnt.sum()), len(cnt), int(cnt.max()), names[0].as_py()))
            yield pd.DataFrame(rows, columns=[id, "total", "n_distinct", "top_count", "first_kmer"])

    return df.select(id, seq).mapInPandas(run, f"`{id}` {dict(df.dtypes)[id]}, total bigint, n_distinct bigint, top_count bigint, first_kmer string")


def dinucleotide_freq(df: DataFrame, id: str, seq: str, only_acgt: bool = False) -> DataFrame:
    """Overlapping two-letter frequencies, over all pairs or over unambiguous pairs only."""
    c = kmer_counts(df, id, seq, 2)
    clean = F.col("kmer").rlike("^[ACGT]{2}$")
    tot = c.groupBy(id).agg(F.sum(F.when(clean, F.col("cnt")) if only_acgt else F.col("cnt")).alias("_t"))
    return c.where(clean).join(tot, id).select(id, F.col("kmer").alias("di"), (F.col("cnt") / F.col("_t")).alias("freq"))


def kmer_presence(df: DataFrame, id: str, seq: str, k: int, canonical: bool = False) -> DataFrame:
    """Distinct (id, kmer); duplicates inside one sequence are dropped in-row, nothing is shuffled unless ids repeat."""
    own = _own_kmers(df, id, seq, k, 1, canonical).select(id, "kmer")
    return own.distinct() if repeats(df, id) else own


def with_letter_counts(df: DataFrame, seq: str) -> DataFrame:
    """Add one count column per residue, so later measures are arithmetic on 20 numbers."""
    return df.withColumns({f"_c_{a}": c for a, c in sq.letter_counts(F.col(seq)).items()})


def letter_columns() -> dict[str, Column]:
    return {a: F.col(f"_c_{a}") for a in sc.AMINO_ACIDS}


def codon_usage(df: DataFrame, id: str, cds: str) -> DataFrame:
    """Codon frequencies per sequence; a length that is no multiple of 3 gives one NULL row."""
    ok = df.where(F.length(cds) % 3 == 0)
    counts = kmer_counts(ok, id, cds, 3, 3)
    lens = ok.select(id, (F.length(cds) / 3).alias("_n"))
    freq = counts.join(lens, id).select(id, F.col("kmer").alias("codon"), (F.col("cnt") / F.col("_n")).alias("freq"))
    bad = df.where(F.length(cds) % 3 != 0).select(id, F.lit(None).cast("string").alias("codon"), F.lit(None).cast("double").alias("freq"))
    return freq.unionByName(bad)


def concat_ordered(df: DataFrame, by: Sequence[str], order: str, seq: Column, out: str = "seq") -> DataFrame:
    """Concatenate a group's pieces in order (e.g. one genome's genes by start)."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), seq.alias("s"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(pieces, lambda p: p["s"]), "").alias(out))


def clean_residues(seq: Column) -> Column:
    return F.regexp_replace(F.upper(seq), f"[^{sc.AMINO_ACIDS}]", "")


def fourfold_consensus_gc(df: DataFrame, id: str, gene: str, seq: str, min_freq: float = 0.99) -> DataFrame:
    """Third-base counts at codon columns whose majority prefix is free and frequent enough."""
    codons = (df.select(id, gene, F.posexplode(sq.pieces(F.upper(F.col(seq)), 3, 3)).alias("k", "codon"))
              .where(F.col("codon").rlike("^[ACGT]{3}$") & ~F.col("codon").isin("TAA", "TAG", "TGA"))
              .withColumn("prefix", F.substring("codon", 1, 2)))
    pc = codons.groupBy(gene, "k", "prefix").agg(F.count("*").alias("n"))
    best = pc.groupBy(gene, "k").agg(F.sum("n").alias("tot"), F.max_by(F.struct("prefix", "n"), F.struct(
        F.col("n"), F.translate("prefix", "ACGT", "DCBA"))).alias("b"))
    valid = (best.where((F.col("b.n") / F.col("tot") >= min_freq) & F.col("b.prefix").isin(sc.FOURFOLD_PREFIXES))
             .select(gene, "k", F.col("b.prefix").alias("prefix")))
    hits = codons.join(valid, [gene, "k", "prefix"]).withColumn("base", F.substring("codon", 3, 1))
    n = lambda b: F.count_if(F.col("base") == b).alias(f"n_{b.lower()}")
    out = hits.groupBy(gene, id).agg(n("A"), n("C"), n("G"), n("T"))
    tot = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    return out.withColumn("gc", (F.col("n_g") + F.col("n_c")) / tot)


def gc_windows(df: DataFrame, id: str, seq: str, width: int) -> DataFrame:
    """GC share of non-overlapping windows; an incomplete tail is dropped."""
    w = df.select(id, F.posexplode(sq.pieces(F.col(seq), width, width)).alias("window_no", "_piece"))
    return w.select(id, "window_no", sq.gc_fraction(F.col("_piece")).alias("gc"))


def hydropathy_segments(df: DataFrame, id: str, seq: str, width: int = 20, cut: float = 1.6,
                        scale: Mapping[str, float] = sc.HYDROPATHY) -> DataFrame:
    """Count rising edges of the sliding mean above `cut` (membrane segments), within the row."""
    table = dict(scale)

    def run(batches):
        for pdf in batches:
            rows = []
            for i, text in zip(pdf[id], pdf[seq]):
                if text is not None and len(text) >= width:
                    rows.append((i, *km.rising_edges(text, table, width, cut)))
            yield pd.DataFrame(rows, columns=[id, "n_segments", "max_mean"])

    r = df.select(id, seq).mapInPandas(run, f"`{id}` {dict(df.dtypes)[id]}, n_segments bigint, max_mean double")
    return r.groupBy(id).agg(F.sum("n_segments").alias("n_segments"), F.max("max_mean").alias("max_mean"))


def stem_regions(df: DataFrame, id: str, seq: str, structure: str) -> DataFrame:
    """Stems and loops of a bracket structure (`>` opens, `<` closes, `.` unpaired), with
    GC and length of the first four stems and of the loops between them; one row per sequence.

    Brackets are matched by nesting level: a close pairs with the latest open of its level.
    """
    parts = [f"{p}_{c}" for p in ("s1", "s2", "s3", "s4", "d", "ac", "t", "v") for c in ("len", "gc")]

    def run(batches):
        for pdf in batches:
            rows = [(i, *km.stems_and_loops(b or "", c or "")) for i, b, c in zip(pdf[id], pdf[seq], pdf[structure])]
            yield pd.DataFrame(rows, columns=[id, *parts])

    out = df.select(id, seq, structure).mapInPandas(run, ", ".join([f"`{id}` {dict(df.dtypes)[id]}", *[f"{p} bigint" for p in parts]]))
    cols: dict[str, tuple[Column, Column]] = {}
    for name, s in (("acceptor_stem", "s1"), ("d_stem", "s2"), ("anticodon_stem", "s3"), ("t_stem", "s4")):
        cols[name] = (F.col(f"{s}_len"), F.col(f"{s}_gc"))
    for name, s in (("d_loop", "d"), ("anticodon_loop", "ac"), ("t_loop", "t")):
        cols[name] = (F.col(f"{s}_len"), F.col(f"{s}_gc"))
    cols["variable_loop"] = (F.col("v_len"), F.col("v_gc"))
    sel = []
    for name, (n, gc) in cols.items():
        sel += [F.coalesce(n, F.lit(0)).cast("bigint").alias(f"{name}_len"), F.when(n > 0, gc / n).alias(f"{name}_gc")]
    out = out.select(id, *sel)
    for kind in ("stem", "loop"):
        names = [c for c in cols if c.endswith(kind)]
        n = sum((F.col(f"{c}_len") for c in names[1:]), F.col(f"{names[0]}_len"))
        gc = sum((F.coalesce(F.col(f"{c}_gc") * F.col(f"{c}_len"), F.lit(0.0)) for c in names[1:]),
                 F.coalesce(F.col(f"{names[0]}_gc") * F.col(f"{names[0]}_len"), F.lit(0.0)))
        out = out.withColumn(f"total_{kind}_len", n).withColumn(f"total_{kind}_gc", F.when(n > 0, gc / n))
    return out


def identity_sampled(df: DataFrame, id: str, seq: str, n_pairs: int, seed: int = 42) -> DataFrame:
    """Identity (matches / jointly ungapped positions) of `n_pairs` hash-drawn sequence pairs."""
    idx = row_index(df.select(id, seq), [id], out="_no")
    n = idx.agg(F.max("_no")).scalar()
    spark = df.sparkSession
    draws = spark.range(n_pairs).select(
        F.col("id").alias("draw"),
        (F.pmod(draw("id", seed=seed), n) + 1).alias("na"),
        F.pmod(draw("id", seed=seed + 1), F.greatest(n - 1, F.lit(1))).alias("_b"))
    draws = draws.withColumn("nb", F.pmod(F.col("na") + F.col("_b"), n) + 1)
    a = idx.select(F.col("_no").alias("na"), F.col(seq).alias("sa"))
    b = idx.select(F.col("_no").alias("nb"), F.col(seq).alias("sb"))
    p = draws.join(a, "na").join(b, "nb")
    m = F.least(F.length("sa"), F.length("sb"))
    za = F.zip_with(F.split(F.substring(F.col("sa"), F.lit(1), m), ""), F.split(F.substring(F.col("sb"), F.lit(1), m), ""),
                    lambda x, y: F.when((x == "-") | (y == "-"), F.lit(None).cast("int")).otherwise((x == y).cast("int")))
    both, same = F.size(F.filter(za, lambda x: x.isNotNull())), F.size(F.filter(za, lambda x: x == 1))
    return p.select("draw", F.when(both > 0, same / both).alias("identity"))


def identity_threshold(identities: DataFrame, percentile: float = 90, lo: float = 0.5, hi: float = 0.99) -> DataFrame:
    q = quantiles(identities.where("identity is not null"), "identity", {"q": percentile / 100})
    return q.select(F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("q"))).alias("threshold"), "n")


def complete_grid(df: DataFrame, a: str, b: str, value: str, fill=0) -> DataFrame:
    """Every (a, b) combination of a bounded set of b levels, missing values filled."""
    levels = df.select(b).distinct().agg(F.array_sort(F.collect_list(b))).scalar()
    grid = df.select(a).distinct().withColumn(b, F.explode(levels))
    return grid.join(df.select(a, b, value), [a, b], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def multi_hot(df: DataFrame, id: str, labels: str, vocab: Sequence[str]) -> DataFrame:
    """0/1 presence column per known label plus the number present; no shuffle."""
    arr = F.col(labels)
    return df.select(id, *[F.array_contains(arr, x).cast("int").alias(f"has_{x}") for x in vocab],
                     F.size(F.array_intersect(arr, F.array(*[F.lit(x) for x in vocab]))).cast("bigint").alias("n_present"))
