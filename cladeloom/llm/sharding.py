"""Histogram sort of documents into shards of near-equal bytes (DataFrame functions only).

The sort key is a 64-bit hash of the text, so equal texts are neighbours in the order and share a
shard. Texts that weigh more than the tolerance, copies included ("heavy" texts; fewer than
shards / tolerance of them can exist, which bounds the broadcast list), are placed first, largest on the lightest shard. Splitters for all other rows come
from exact byte counts below probe keys: every round counts bytes in the sub-ranges of those ranges
that still hold a splitter, until each splitter is within the tolerance of its target or one key wide.
Rows are then exchanged once and numbered.

Defined results: a null text has no bytes, size 1 and crc 0; repeated rows each get a slot; an empty
table gives an empty result; rows with a null doc_id are sharded like others; extra columns are ignored.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.session import materialize

#: Bits of the key that one round of probes resolves.
ROUND_BITS = 10
KEY_BITS = 60


def _keyed(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit("").cast("binary"))
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                       F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 64 - KEY_BITS).alias("key"))


def _place_heavy(heavy: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """Shard of each heavy key (largest first, on the lightest shard) and the bytes placed on each shard."""
    load, where = [0] * shards, {}
    for key, size in sorted(heavy, key=lambda x: (-x[1], x[0])):
        s = min(range(shards), key=lambda i: (load[i], i))
        where[key], load[s] = s, load[s] + size
    return where, load


def _targets(load: list[int], light: int) -> list[float]:
    """Running byte targets of the light rows, so that heavy and light bytes level out (water filling)."""
    level, order = 0.0, sorted(load)
    for k in range(len(order), 0, -1):
        level = (light + sum(order[:k])) / k
        if level >= order[k - 1]:
            break
    out, at = [], 0.0
    for x in load:
        at += max(0.0, level - x)
        out.append(at)
    return out[:-1]


def splitters(light: DataFrame, targets: list[float], slack: float) -> list[int]:
    """Keys k_i such that the bytes of rows with key < k_i are within `slack` of targets[i] (or as near
    as whole keys allow): rounds of exact counts between probes, at most 2**ROUND_BITS counts per
    splitter and round on the driver."""
    found: dict[int, int] = {}
    open_ = {i: (0, 0) for i in range(len(targets))}  # splitter -> (prefix of the range it lies in, bytes below that range)
    depth = 0
    while open_ and depth < KEY_BITS:
        ranges = sorted({p for p, _ in open_.values()})
        inside = F.shiftrightunsigned("key", KEY_BITS - depth) if depth else F.lit(0)
        depth += ROUND_BITS
        probe = F.shiftrightunsigned("key", KEY_BITS - depth)
        rows = light.where(inside.isin(ranges)).groupBy(probe.alias("probe")).agg(F.sum("size").alias("size")).collect()
        sizes: dict[int, list[tuple[int, int]]] = {p: [] for p in ranges}
        for r in sorted(rows):
            sizes[r["probe"] >> ROUND_BITS].append((r["probe"], r["size"]))
        for i, (prefix, below) in list(open_.items()):
            edge, best, at = None, (abs(below - targets[i]), prefix << (KEY_BITS - depth + ROUND_BITS)), below
            for p, size in sizes[prefix]:
                if edge is None and at + size > targets[i]:
                    edge = (p, at)
                at += size
                best = min(best, (abs(at - targets[i]), (p + 1) << (KEY_BITS - depth)))
            if best[0] <= slack or edge is None or depth >= KEY_BITS:
                found[i] = best[1]
                del open_[i]
            else:
                open_[i] = edge
    return [found[i] for i in range(len(targets))]


def histogram_shards(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of `docs`; see the module text.

    `tolerance` is the share of a shard by which a splitter may miss its target. Slots count from 0 in
    each shard without gaps, in (key, doc_id) order within each of the blocks that a shard is cut into.
    """
    spark = docs.sparkSession
    rows = materialize(_keyed(docs))
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    heavy = [tuple(r) for r in rows.groupBy("key").agg(F.sum("size").alias("size")).where(F.col("size") > slack).collect()]
    where, load = _place_heavy(heavy, shards)
    placed = spark.createDataFrame(list(where.items()), "key long, heavy_shard int")
    rows = rows.join(F.broadcast(placed), "key", "left")
    is_heavy = F.col("heavy_shard").isNotNull()
    cuts = splitters(rows.where(~is_heavy), _targets(load, total - sum(load)), slack)
    light_shard: Column = reduce(lambda a, b: a + b, [(F.col("key") >= c).cast("int") for c in cuts], F.lit(0))
    shard = F.coalesce("heavy_shard", light_shard)
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # blocks follow the key range; the copies of a heavy text are spread over all blocks by doc_id
    light_block = F.floor(F.col("key") / F.lit(2.0 ** KEY_BITS) * blocks).cast("int")
    block = F.when(is_heavy, F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).otherwise(light_block)
    dealt = rows.select("*", shard.cast("int").alias("shard"), block.alias("block"))
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "block").orderBy("key", "doc_id", "text_crc32")
    numbered = dealt.withColumn("at", F.row_number().over(order))
    return (numbered.join(F.broadcast(first) if blocks * shards <= 1_000_000 else first, ["shard", "block"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot")))
