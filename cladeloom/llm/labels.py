"""Bounded samples of labelled documents for the classifiers."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most `per_class` labelled documents of each class: those
    with the smallest hash of doc_id. Hashes are first cut by exact counts, so only about twice as many
    rows are ordered, and only sampled texts move. Null ids and labels are no labels; of several labels
    for one id the largest holds; repeated documents with one id are all taken."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = rows.withColumn("rank", F.xxhash64("doc_id"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    near = rows.join(F.broadcast(counts), "label").where(F.col("rank") / 2.0 ** 64 + 0.5 < 2.0 * per_class / F.col("n"))
    chosen = near.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy("rank", "doc_id"))).where(F.col("at") <= per_class)
    return docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "label")), "doc_id")  # at most 2 * per_class small rows
