"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are byte trigrams of the whole text, hashed into `TERMS` slots, and three pseudo-terms: words equal
to the word before, words seen earlier in the text, and words. Trigrams are weighted by log counts and inverse document
frequency and scaled to length one, the first two pseudo-terms enter as shares of the words, and a bounded sample of labelled documents (`per_class` of each class) gives the latent space
by a truncated singular value decomposition. The labelled vectors are broadcast (their number and width are
parameters); every document is projected, its cosine with every labelled vector is computed in blocks,
and the `neighbours` nearest vote, weighted by similarity and by how often their class occurs among all
labelled documents.

Defined results: null and empty texts have a zero vector, whose cosine with every vector is 0, and get the
share of label 1 among all labelled documents; without labelled documents every score is 0; repeated rows are scored
each; an empty table gives an empty result; other columns do not matter.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.labels import labelled_sample
from cladeloom.llm.text import column, prefix_hash, rows_of, scan, slices, span_hash, string_buffers, word_spans

TERMS = 4096
WIDTH = TERMS + 3
#: Weight of the first two pseudo-terms, as shares of the words, beside trigram vectors of length one.
SHARE_WEIGHTS = np.array([2.0, 0.5], np.float32)
#: Rows that are made into a dense block together.
BLOCK = 512


def term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of the terms (columns) in each text."""
    buf, offsets = string_buffers(texts)
    n, size = len(texts), np.diff(offsets)
    out = np.zeros((n, WIDTH), np.float32)
    if len(buf) >= 3:
        code = buf[:-2].astype(np.uint32) | buf[1:-1].astype(np.uint32) << np.uint32(8) | buf[2:].astype(np.uint32) << np.uint32(16)
        slot = (code * np.uint32(2654435769) >> np.uint32(20)).astype(np.int64)
        row = rows_of(size)
        inside = row[:-2] == row[2:]
        out[:, :TERMS] = np.bincount(row[:-2][inside] * TERMS + slot[inside], minlength=n * TERMS).reshape(n, TERMS)
    starts, ends, first = word_spans(buf, offsets)
    if len(starts):
        codes = span_hash(prefix_hash(buf), starts, ends)
        row = rows_of(np.diff(first))
        again = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
        out[:, TERMS] = np.bincount(row[1:][again], minlength=n)
        out[:, TERMS + 1] = np.diff(first) - distinct_per_row(codes, row, n)
        out[:, TERMS + 2] = np.diff(first)
    return out


def distinct_per_row(codes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((codes, row))
    c, r = codes[order], row[order]
    return np.bincount(r[np.concatenate([[True], (c[1:] != c[:-1]) | (r[1:] != r[:-1])])], minlength=n)


class Space:
    """Latent space, and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, totals: dict[int, int], dims: int, neighbours: int):
        n = len(counts)
        self.idf = np.log((1 + n) / (1 + (counts[:, :TERMS] > 0).sum(0))).astype(np.float32) + 1
        x = self.weigh(counts)
        rng = np.random.default_rng(7)
        q = np.linalg.qr(x @ rng.standard_normal((TERMS + 2, min(dims + 16, n))).astype(np.float32))[0]
        for _ in range(4):  # power steps of the randomised decomposition
            q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
        self.axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:dims].T.astype(np.float32)
        self.vectors = self.unit(x @ self.axes)
        self.labels = labels
        share = {k: totals[k] / sum(totals.values()) for k in totals}
        self.weights = np.array([share[k] / (labels == k).sum() for k in labels.tolist()]) * n
        self.share = share.get(1, 0.0)
        self.neighbours = min(neighbours, n)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        words = np.maximum(counts[:, TERMS + 2:], 1)
        shares = counts[:, TERMS:TERMS + 2] / words * SHARE_WEIGHTS
        return self.unit(np.hstack([self.unit(np.log1p(counts[:, :TERMS]) * self.idf), shares]))

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        length = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(length > 0, length, 1)

    def vote(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 in the weighted vote of the nearest labelled vectors."""
        cosine = self.unit(self.weigh(counts) @ self.axes) @ self.vectors.T
        near = np.argpartition(-cosine, self.neighbours - 1, axis=1)[:, :self.neighbours]
        similar = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(float)
        weight = similar ** 8 * self.weights[near]  # near ones count, far ones hardly do
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1), self.share)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, dims: int = 64, neighbours: int = 25) -> Space | None:
    """The latent space; its size is set by the parameters. None without labelled documents."""
    totals = {r[label]: r["n"] for r in labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(label).agg(F.countDistinct("doc_id").alias("n")).collect()}

    def run(batches):
        for part in slices(batches):
            for at in range(0, part.num_rows, BLOCK):
                some = part.slice(at, BLOCK)
                counts = term_counts(column(some, "text"))
                sizes, cols = (counts > 0).sum(1), np.nonzero(counts)[1]
                edges = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays([column(some, "label"), pa.ListArray.from_arrays(edges, pa.array(cols.astype(np.int32))),
                                                  pa.ListArray.from_arrays(edges, pa.array(counts[counts > 0]))], ["label", "term", "n"])

    rows = labelled_sample(docs, labels, label, per_class).mapInArrow(run, "label int, term array<int>, n array<float>").toArrow()
    if not rows.num_rows:
        return None
    counts = np.zeros((rows.num_rows, WIDTH), np.float32)
    for i, (t, n) in enumerate(zip(rows["term"], rows["n"])):
        counts[i, t.values.to_numpy()] = n.values.to_numpy()
    return Space(counts, rows["label"].to_numpy(), totals, dims, neighbours)


def score(docs: DataFrame, space: Space | None, carry: list[str] | None = None) -> DataFrame:
    """row and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def make():
        space = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            if space is None:
                return [pa.array(np.zeros(len(texts)))]
            return [pa.array(np.concatenate([space.vote(term_counts(texts.slice(at, BLOCK))) for at in range(0, len(texts), BLOCK)]))]

        return work

    return scan(docs, make, "score double", carry)
