"""Text and table sinks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), fmt: str = "parquet", mode: str = "error") -> None:
    w = df.write.mode(mode)
    if fmt != "parquet":
        w = w.option("header", True)
    (w.partitionBy(*by) if by else w).format(fmt).save(path)


def fasta_record(header: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), seq)


def write_fasta(df: DataFrame, path: str, header: str, seq: str, by: str | None = None, min_tokens: int = 1) -> None:
    """One record per row; headers with fewer than `min_tokens` words are skipped; one folder per `by` value."""
    ok = df.where(F.size(F.split(F.trim(header), r"\s+")) >= min_tokens)
    rec = fasta_record(F.col(header), F.col(seq)).alias("value")
    if by:
        ok.select(rec, by).write.partitionBy(by).text(path)
    else:
        ok.select(rec).write.text(path)


def gff3_lines(genes: DataFrame) -> DataFrame:
    """gene -> mRNA -> CDS lines of (genome_id, gene, start, end, strand, product)."""
    s = F.when(F.col("strand") > 0, "+").otherwise("-")
    row = lambda kind, phase, attrs: F.concat_ws("\t", "genome_id", F.lit("GenBank"), F.lit(kind), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), s, F.lit(phase), attrs)
    g = F.col("gene")
    prod = F.when(F.col("product") != "", F.concat(F.lit(";product="), "product")).otherwise("")
    lines = F.array(row("gene", ".", F.concat(F.lit("ID="), g, F.lit(";Name="), g)),
                    row("mRNA", ".", F.concat(F.lit("ID="), g, F.lit("_mRNA;Parent="), g)),
                    row("CDS", "0", F.concat(F.lit("ID="), g, F.lit("_CDS;Parent="), g, F.lit("_mRNA;Name="), g, prod)))
    return genes.select(F.explode(lines).alias("value"))


def vcf_rows(calls: DataFrame, chrom: str, pos: str, sample: str, base: str) -> DataFrame:
    """REF = first sample's base, ALT in sorted order, GT codes in sample order; unvarying sites are skipped."""
    g = calls.groupBy(chrom, pos).agg(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("s"), F.col(base).alias("b")))).alias("a"))
    bases = F.transform("a", lambda x: x["b"])
    g = g.select(chrom, pos, bases.alias("b")).withColumn("ref", F.col("b")[0])
    g = g.withColumn("alt", F.array_sort(F.array_distinct(F.filter("b", lambda x: x != F.col("ref"))))).where(F.size("alt") > 0)
    gt = F.transform("b", lambda x: F.when(x == F.col("ref"), F.lit("0")).otherwise(F.array_position("alt", x).cast("string")))
    g = g.withColumn("genotypes", F.array_join(gt, "\t"))
    return g.select(chrom, pos, "ref", F.array_join("alt", ",").alias("alt"), "genotypes")


def vcf_lines(rows: DataFrame, chrom: str, pos: str) -> DataFrame:
    v = F.concat_ws("\t", F.col(chrom).cast("string"), F.col(pos).cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT"), "genotypes")
    return rows.select(v.alias("value"))


def feature_track(runs: DataFrame, start: str, end: str, label: str, kind: str = "gene") -> DataFrame:
    """Tab lines `* start end kind label` from run-length rows."""
    return runs.select(F.concat_ws("\t", F.lit("*"), F.col(start).cast("string"), F.col(end).cast("string"), F.lit(kind), F.col(label).cast("string")).alias("value"))
