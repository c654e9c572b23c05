"""Best-fit-decreasing packing of token ids into windows of fixed size.

Documents are encoded once (public vocabulary, end id appended); a document longer than the window is
first cut into full windows and a rest. Best fit decreasing only looks at lengths, so the whole plan
follows from how many pieces have each length (at most one count per token of the window): lengths are
taken from the longest, a segment tree indexed by remaining capacity finds the tightest open window, and
pieces of one length move into windows of one history together. What comes out is the packing that
piece-by-piece best fit decreasing gives. Pieces are then numbered within their length by counts and
placed by the plan, so only the counts reach the driver, and ids are never shuffled.

Defined results: a null or empty text is one piece with the end id alone; repeated rows and doc_ids are
packed each; null doc_ids are kept; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.llm.text import column, ranges, rows_of, slices, string_buffers, tidy
from cladeloom.llm.tokens import encoder
from cladeloom.session import shared_dir

WINDOW = 2048


class CapacityTree:
    """Number of open windows by remaining capacity; finds the tightest one that still fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """Smallest capacity >= need with an open window."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until a right neighbour has one
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, end, per_window, sequence, offset): pieces of this length numbered first to
    end - 1 go, per_window at a time, into the windows from `sequence` on, from `offset` on."""
    tree, groups = CapacityTree(window), {}  # capacity -> groups (first sequence, windows)
    plan, sequences = [], 0

    def open_(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            groups.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted(counts, reverse=True):
        done, total = 0, counts[length]
        while done < total:
            capacity = tree.tightest(length)
            per = (capacity or window) // length
            if capacity is None:
                capacity, first, n = window, sequences, -(-(total - done) // per)
                sequences += n
            else:
                first, n = groups[capacity].pop()
                tree.add(capacity, -n)
            full = min(n, (total - done) // per)
            rest = min(per - 1, total - done - full * per) if full < n else 0
            plan.append((length, done, done + full * per + rest, per, first, window - capacity))
            open_(capacity - per * length, first, full)
            if rest:
                open_(capacity - rest * length, first + full, 1)
            open_(capacity, first + full + bool(rest), n - full - bool(rest))
            done += full * per + rest
    return plan


def write_pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = 1) -> DataFrame:
    """uid (of the document's row), doc_id, start, length, ids, ids_crc32 and doc_tokens of every piece,
    written once into the shared folder."""
    spark = docs.sparkSession

    @tidy
    def run(batches):
        encode = encoder(vocabulary).encode
        for part in slices(batches):
            buf, offsets = string_buffers(column(part, "text"))
            ids, at = encode(buf, offsets, end)
            tokens = np.diff(at)
            n = -(-tokens // window)
            row, start = rows_of(n), window * ranges(n)
            length = np.minimum(window, tokens[row] - start)
            first = at[row] + start
            small = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(small[4 * a:4 * b]) for a, b in zip(first, first + length)]
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                column(part, "uid").take(pick), column(part, "doc_id").take(pick), pa.array(start), pa.array(length),
                pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids.view(np.int32))), pa.array(crc, pa.int64()), pa.array(tokens[row])],
                ["uid", "doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    path = f"{shared_dir(spark)}/pieces-{uuid.uuid4().hex}"
    (docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
     .mapInArrow(run, f"uid long, doc_id {kind}, start long, length long, ids array<int>, ids_crc32 long, doc_tokens long").write.parquet(path))
    return spark.read.parquet(path)


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces' columns without ids, and sequence_id and offset."""
    spark = pieces.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.drop("ids").withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    totals = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(best_fit_plan(totals, window), "length long, first long, end long, per_window long, sequence long, at long")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "block").orderBy("doc_id", "start", "uid")
    numbered = rows.withColumn("number", F.row_number().over(order)).join(base, ["length", "block"]).withColumn("number", F.col("base") + F.col("number") - 1)
    # the plan's size depends on the window alone, not on the data
    p, n = F.broadcast(plan).alias("p"), numbered.alias("n")
    placed = n.join(p, (F.col("n.length") == F.col("p.length")) & (F.col("number") >= F.col("p.first")) & (F.col("number") < F.col("p.end")))
    index = F.col("number") - F.col("p.first")
    return placed.select(*[F.col(f"n.{c}") for c in ("uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens")],
                         (F.col("p.sequence") + F.floor(index / F.col("p.per_window"))).cast("long").alias("sequence_id"),
                         (F.col("p.at") + index % F.col("p.per_window") * F.col("n.length")).cast("long").alias("offset"))


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = 1) -> tuple[DataFrame, DataFrame]:
    """The placed pieces and the pieces with their ids."""
    pieces = write_pieces(docs, vocabulary, window, end)
    return place(pieces, window), pieces


def sequences(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """sequence_id and ids of every window (at most the window's size, so each group is bounded)."""
    both = placed.select("uid", "start", "sequence_id", "offset").join(pieces.select("uid", "start", "ids"), ["uid", "start"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
