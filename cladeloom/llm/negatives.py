"""Hard negatives of labelled vectors from exact integer scores by Kronecker-packed products.

A vector's components become integers floor(scale * x). For a set of candidates the components of several of them are
biased to be non-negative and packed into separated fields of one wide integer; a field is wide enough for the largest
possible sum, so multiplying the packed integer once per (biased) anchor component and adding up leaves the score of
every candidate in its own field. While two sums fit below 2**53 the wide integers are held in doubles, where the
matrix product is exact; larger components take Python integers with as many fields as there are candidates in a
block. No score is estimated.

Anchors (a share of the rows that grows with the table) meet all rows in blocks: rows are dealt to strips by their
position in the scan, anchors to groups, and each (strip, group) is one task with bounded tables. It keeps, per anchor,
the best rows only; a window per anchor merges the strips. The number of strips grows with the square root of the
rows, so that neither a strip nor the kept rows grow with the table's square. Nothing is broadcast.

Left out: rows with a null label, a null vector, or a null or non-finite component. A shorter vector counts as
followed by zeros. Ids: ties go to the smaller id, null ids last, then to a fixed order of label and vector; a null id
is no anchor. A repeated row is another row: as an anchor it gives its rows again, and a copy can be a positive of its copy.
Scores beyond the range of long raise an error. Empty tables, and tables without anchors, give no rows.
"""
from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cladeloom.llm.text import ranges
from cladeloom.session import materialize

#: Strips: at most this many rows; fewer while the table is small, ROWS_AT_ONE * strips**2 rows for that many strips.
STRIP_ROWS, ROWS_AT_ONE = 1_000_000, 8192
#: Anchors of a task, and candidates whose scores with one block of anchors are held at a time.
GROUP_ROWS, BLOCK_ROWS, BLOCK_ANCHORS = 65_536, 16_384, 256
#: Integers below this are exact in a double, and so are their sums.
EXACT = 1 << 53


class Vectors:
    """A column of vectors as one flat array of doubles."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        self.offsets = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
        self.flat = np.asarray(lists.flatten(), np.float64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.offsets[i]:self.offsets[i + 1]]

    def integers(self, scale: int) -> np.ndarray:
        """floor(scale * x) of every component, short vectors padded with zeros: int64, or Python integers if one is too large."""
        sizes = np.diff(self.offsets)
        out = np.zeros((len(self), int(sizes.max(initial=0))))
        out[np.repeat(np.arange(len(self)), sizes), ranges(sizes)] = self.flat
        with np.errstate(over="ignore"):
            scaled = np.floor(out * scale)
        if not scaled.size or np.abs(scaled).max() < EXACT:
            return scaled.astype(np.int64)
        wide = np.empty(out.shape, object)
        for at, x in np.ndenumerate(out):
            n, d = float(x).as_integer_ratio()
            wide[at] = n * scale // d
        return wide


def bias_of(a: np.ndarray) -> int:
    """What makes every component non-negative."""
    return max(0, -int(a.min())) if a.size else 0


class Packed:
    """Candidates packed for products with anchors whose biased components are at most `largest`."""

    def __init__(self, candidates: np.ndarray, largest: int):
        self.rows, width = candidates.shape
        self.bias = bias_of(candidates)
        shifted = candidates + self.bias
        self.sums = candidates.sum(axis=1) if width else np.zeros(self.rows, np.int64)
        top = int(shifted.max(initial=0)) * largest * max(1, width)
        self.bits = max(1, top.bit_length())
        self.fields = (EXACT.bit_length() - 1) // self.bits
        if self.fields:
            words = -(-self.rows // self.fields)
            full = np.zeros((words * self.fields, width))
            full[:self.rows] = shifted.astype(np.float64)
            full = full.reshape(self.fields, words, width)
            self.words = sum(full[f] * float(1 << f * self.bits) for f in range(self.fields)).T
        else:
            self.bits = -(-self.bits // 8) * 8
            self.words = [sum(int(v) << i * self.bits for i, v in enumerate(column)) for column in shifted.T]

    def scores(self, anchors: np.ndarray, bias: int) -> np.ndarray:
        """Inner products of all anchors (unbiased; `bias` makes them non-negative) and candidates."""
        shifted = anchors + bias
        if self.fields:
            product = (shifted.astype(np.float64) @ self.words).astype(np.int64)
            mask = (1 << self.bits) - 1
            sums = np.concatenate([product >> f * self.bits & mask for f in range(self.fields)], axis=1)[:, :self.rows]
        else:
            size = self.bits // 8
            sums = np.zeros((len(anchors), self.rows), object)
            for i, row in enumerate(shifted):
                total = sum(int(x) * w for x, w in zip(row, self.words))
                raw = total.to_bytes(size * self.rows, "little")
                sums[i] = [int.from_bytes(raw[k:k + size], "little") for k in range(0, len(raw), size)]
        own = anchors.sum(axis=1)
        width = anchors.shape[1]
        # (a + b)(c + d) summed = a c + d sum(a) + b sum(c) + b d width
        return sums - self.bias * own[:, None] - bias * self.sums[None, :] - bias * self.bias * width


def widen(a: np.ndarray, width: int) -> np.ndarray:
    return np.concatenate([a, np.zeros((len(a), width - a.shape[1]), a.dtype)], axis=1) if a.shape[1] < width else a


def participants(vectors: DataFrame, scale_label: Column | None = None, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.where(v.isNotNull() & F.col("label").isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(False)))
    return rows.select("vec_id", (F.col("label") if scale_label is None else scale_label).cast("long").alias("label"), v.alias("vector"))


class Strip:
    """Candidates of a task in the order of ties: by id (null last), then by mark."""

    def __init__(self, ids: list, labels: np.ndarray, vectors: Vectors, scale: int, anchor_width: int, largest: int):
        sort = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        order = [i for _, same in itertools.groupby(sort, key=lambda i: ids[i]) for i in _by_mark(list(same), labels, vectors)]
        self.ids, self.labels = [ids[i] for i in order], labels[order]
        self.order, self.vectors = order, vectors
        whole = vectors.integers(scale)[order]
        self.ints = widen(whole, max(whole.shape[1], anchor_width))
        self.blocks = [(at, Packed(self.ints[at:at + BLOCK_ROWS], largest)) for at in range(0, len(ids), BLOCK_ROWS)]

    def mark(self, i: int) -> bytes:
        return mark(int(self.labels[i]), self.vectors[self.order[i]])


def _by_mark(rows: list[int], labels: np.ndarray, vectors: Vectors) -> list[int]:
    return rows if len(rows) == 1 else sorted(rows, key=lambda i: mark(int(labels[i]), vectors[i]))


def mark(label: int, vector: np.ndarray) -> bytes:
    """Tells rows of one id apart."""
    return hashlib.blake2b(label.to_bytes(8, "little", signed=True) + (vector + 0.0).tobytes(), digest_size=16).digest()


def best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Positions (ascending in `at`, the order of ties) of the k best scores, best first."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
        scores, at = scores[keep], at[keep]
    order = sorted(range(len(scores)), key=lambda i: (-int(scores[i]), int(at[i])))[:k]
    return at[order]


def meet(anchors: DataFrame, rows: DataFrame, n: int, scale: int, schema: str, choose: Callable) -> DataFrame:
    """`choose` (anchor, scores, strip, first position) gives rows for every anchor and block of candidates.

    `rows` are `n`; `anchors` has a unique number `anchor`, vec_id, label, vector and what `choose` needs.
    """
    m = anchors.count()
    strips = max(1, math.isqrt(max(0, n - 1) // ROWS_AT_ONE) + 1, -(-n // STRIP_ROWS))
    groups = max(1, -(-m // GROUP_ROWS))
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    deal = lambda count: (F.monotonically_increasing_id() % count).cast("int")
    left = anchors.toDF(*anchors.columns).withColumn("group", (F.col("anchor") % groups).cast("int")).withColumn("strip", spread(strips))
    right = rows.withColumn("strip", deal(strips)).withColumn("group", spread(groups))
    fields = StructType.fromDDL(schema)
    types = to_arrow_schema(fields)

    def run(a: pa.Table, c: pa.Table) -> pa.Table:
        out: list[dict] = []
        if a.num_rows and c.num_rows:
            points, vectors = a.drop_columns("vector").to_pylist(), Vectors(a["vector"])
            for i, p in enumerate(points):
                p["mark"] = mark(p["label"], vectors[i])
            ints = vectors.integers(scale)
            bias = bias_of(ints)
            largest = int(ints.max(initial=0)) + bias
            strip = Strip(c["vec_id"].to_pylist(), np.asarray(c["label"], np.int64), Vectors(c["vector"]), scale, ints.shape[1], largest)
            ints = widen(ints, strip.ints.shape[1])
            for begin in range(0, len(points), BLOCK_ANCHORS):
                for at, packed in strip.blocks:
                    scores = packed.scores(ints[begin:begin + BLOCK_ANCHORS], bias)
                    for p, s in zip(points[begin:begin + BLOCK_ANCHORS], scores):
                        out += choose(p, s, strip, at)
        return pa.Table.from_pylist(out, types)

    return left.groupBy("strip", "group").cogroup(right.groupBy("strip", "group")).applyInArrow(run, fields)


def positives(anchors: DataFrame, rows: DataFrame, n: int, scale: int = 256, k: int = 5) -> DataFrame:
    """(anchor, place, positive_id, positive_score): the k best other rows of an anchor's label."""

    def choose(p: dict, scores: np.ndarray, strip: Strip, at: int) -> list[dict]:
        same = np.flatnonzero(strip.labels[at:at + len(scores)] == p["label"])
        out = []
        for i in best(scores[same], same, k + 1).tolist():
            j = at + i
            out.append({"anchor": p["anchor"], "positive_id": strip.ids[j], "positive_score": int(scores[i]), "mark": strip.mark(j), "own": strip.ids[j] == p["vec_id"] and strip.mark(j) == p["mark"]})
        return out

    found = meet(anchors, rows, n, scale, "anchor long, positive_id long, positive_score long, mark binary, own boolean", choose)
    order = [F.desc("positive_score"), F.asc_nulls_last("positive_id"), "mark"]
    # the anchor itself is one of the rows that look like it
    itself = F.row_number().over(Window.partitionBy("anchor", "own").orderBy(*order))
    rest = found.withColumn("_n", itself).where(~F.col("own") | (F.col("_n") > 1))
    return rest.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("place") <= k).select("anchor", "place", "positive_id", "positive_score")


def mine(rows: DataFrame, is_anchor: Column, scale: int = 256, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for `participants`.

    A negative has another label and a score from `low` to `high` percent of the positive's; the best
    `n_negatives` per anchor and positive are returned.
    """
    n = rows.count()
    anchors = materialize(rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()))
    found = materialize(positives(anchors, rows, n, scale, n_positives))
    lists = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("wanted"))

    def choose(p: dict, scores: np.ndarray, strip: Strip, at: int) -> list[dict]:
        other = np.flatnonzero(strip.labels[at:at + len(scores)] != p["label"])
        theirs = scores[other]
        out, seen = [], {}
        for w in p["wanted"]:
            s = w["positive_score"]
            if s not in seen:
                fit = (theirs >= -(-low * s // 100)) & (theirs <= high * s // 100)
                seen[s] = best(theirs[fit], other[fit], n_negatives).tolist()
            out += [{"anchor": p["anchor"], "place": w["place"], "negative_id": strip.ids[at + i], "negative_score": int(scores[i]), "mark": strip.mark(at + i)} for i in seen[s]]
        return out

    near = meet(anchors.join(lists, "anchor"), rows, n, scale, "anchor long, place int, negative_id long, negative_score long, mark binary", choose)
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "mark")
    top = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_negatives)
    names = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return top.join(found, ["anchor", "place"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
