"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated strings are
cut, benchmark documents go, the rest is packed into windows.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of
documents, for every document that they keep.
"""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cladeloom.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from cladeloom.llm.queries import VOCABULARY, remainder
from cladeloom.llm.text import documents, table
from cladeloom.session import shared_dir, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below 0.5."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.75 or more)."""
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without bytes of repeated strings; n_chars follows."""
    return suffix_dedup.without_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.drop_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    placed, _ = packing.pack(docs, public_tokenizers.path(VOCABULARY))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("jaccard_join", keep_one_of_each), ("suffix_dedup", cut_repeats), ("decontamination", drop_benchmark), ("packing", pack)]
ORACLE_SQL = None  # scores and token ids are not SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    ship(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
