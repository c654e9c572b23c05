"""Exact join of near-duplicate texts in the Jaccard metric space of their word shingles.

d(A, B) = 1 - |A n B| / |A u B| is a metric on sets; texts link when d <= r = 1 - `similarity`. Almost all texts
are at distance 1 from each other, so texts alone, as pivots, would leave one region that triangle
inequalities cannot split. The join therefore screens the texts first and has two kinds of pivots.

* Screen: a set that links to another one shares at least ceil(similarity |A|) of its shingles with it. Of one in
  `SAMPLED[1]` / `SAMPLED[0]` shingles it is counted, by hash, whether a second text has them; a set with more shingles without
  a second text than links allow has none and goes no further. Sets that stay are counted again, with all their shingles, exactly.
* First level: single shingles. A set's nearest such pivots are its own shingles (distance 1 - 1/|A|); ties go
  to the one that the fewest sets have, then to the smaller hash. The window around
  the borders: a set is replicated to its first |A| - ceil(similarity |A|) + 1 shingles in this order, and any two linked sets
  then meet in some region, since a linked set can miss at most |A| - ceil(similarity |A|) of them. In the first region where two sets
  meet, their places in the order bound what they can have in common; sets and pairs beyond that bound leave the region.
* Regions of more than `LEAF` texts (of equal regions one): texts as pivots, the most central first. Every round takes `PIVOTS` of a
  region, measures the exact distances of its texts to them, links what is near, merges components and closes regions that are one
  component. The others are cut into the Voronoi cells of their pivots: x lies in the cell of its nearest pivot p and, as a border text, in
  that of each pivot q with d(x, q) - d(x, p) <= 2 r; cells are regions of the next round. A region that the windows do not
  split (replicas beyond `SPLIT`) stays whole. After `rounds` rounds the texts of a region are joined pair by pair, in
  blocks, except the pairs of one component and those with |d(x, p) - d(y, p)| > r for a pivot p.
* Before texts are shipped for a pair, a profile (how many shingles fall into each of `CLASSES` hash classes) gives a lower bound: two sets differ
  in at least as many shingles as their profiles differ, and linked sets differ in at most (1 - similarity) / (1 + similarity)
  of the sum of their sizes. Every surviving pair is compared by its whole sets.

Equal sets are one class (128-bit digest) with a number of its own before anything is compared. Shingles travel as packed arrays, and
each text that shares a region with another is shipped to the pivots that it is compared with; pivots
with many partners are split over several keys.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; repeated
rows are one class; a null doc_id is ignored when the smallest id of a component is sought; an empty table
gives an empty result; other columns do not matter.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.components import components, release
from cladeloom.llm.shingles import shingle_sets
from cladeloom.llm.text import U64, column, ranges, rows_of, scan, slices, string_buffers, tidy
from cladeloom.session import materialize, shared_dir

#: Bytes of text whose shingles are counted in one bucket, and the least number of buckets.
BUCKET_BYTES = 1 << 26
LEAST_BUCKETS = 64
#: The screen counts shingles whose hash modulo SAMPLED[0] is below SAMPLED[1].
SAMPLED = (8, 3)
#: Texts of a region that are joined pair by pair at once; texts of a block in larger ones.
LEAF = 8
BLOCK = 1000
#: Text pivots of a region in one round, replicas per text up to which a region is split, and classes of a profile.
PIVOTS = 3
SPLIT = 1.5
CLASSES = 128
#: Shingles that a task packs together; partners of a pivot under one key.
PACK = 1 << 20
PARTNERS = 500
#: Bits for each wanted set, and most bits (a power of two), of the filter by which texts are chosen (some others may pass).
FILTER_RATIO = 16
FILTER_MOST = 28


def bucket_count(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_BUCKETS, -(-size // BUCKET_BYTES))


def _rows(names, *columns):
    return pa.RecordBatch.from_arrays(list(columns), names)


def _by_key(batches, name: str):
    """(key, columns of its rows) for the runs of equal keys in sorted batches."""
    key, held = None, []
    for batch in batches:
        keys = column(batch, name).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
        for a, b in zip(edges, [*edges[1:], len(keys)]):
            if held and keys[a] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _deal(df: DataFrame, parts: int, key: str) -> DataFrame:
    return df.repartition(parts, key).sortWithinPartitions(key)


def _chunk_id(first: np.ndarray) -> int:
    """Number of a chunk of classes, from their digests in order."""
    return int(np.sum(first * (np.arange(len(first)).astype(U64) * U64(2) + U64(0x9E3779B97F4A7C15)), dtype=U64).view(np.int64))


def _need(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n has in common with every linked one, at least."""
    return -(-percent * n // 100)


def likely(docs: DataFrame, percent: int, buckets: int) -> DataFrame:
    """digest and second of every set that may have links: its counted shingles that no second text has are not too many."""

    @tidy
    def emit(batches):
        held, size = [], 0
        for part in slices(batches):
            sets = shingle_sets(*string_buffers(column(part, "text")))
            some = sets.hashes % U64(SAMPLED[0]) < U64(SAMPLED[1])
            held.append((sets.first, sets.second, sets.sizes, np.bincount(rows_of(sets.sizes)[some], minlength=len(sets.first)), sets.hashes[some]))
            size += int(some.sum())
            if size >= PACK:
                yield from pack(held)
                held, size = [], 0
        if held:
            yield from pack(held)

    def pack(held):
        first, second, n, m, h = (np.concatenate(x) for x in zip(*held))
        _, keep = np.unique(np.stack([first, second], 1), axis=0, return_index=True)  # copies count once in a chunk
        fresh = np.zeros(len(first), bool)
        fresh[keep] = True
        fresh &= n > 0
        h = h[np.repeat(fresh, m)]
        first, second, n, m = first[fresh], second[fresh], n[fresh], m[fresh]
        if not len(first):
            return
        chunk, row = _chunk_id(first), rows_of(m)
        bucket = ((h >> U64(40)) % U64(buckets)).astype(np.int64)
        order = np.lexsort((row, bucket))
        h, row = h[order], row[order]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        names = ["bucket", "chunk", "heads", "counts", "high", "low"]
        home = chunk % buckets
        for k in np.flatnonzero((np.diff(edges) > 0) | (np.arange(buckets) == home)).tolist():
            s = slice(edges[k], edges[k + 1])
            heads = zlib.compress(first.tobytes() + second.tobytes() + n.astype(np.int64).tobytes(), 1) if k == home else None
            counts = zlib.compress(np.bincount(row[s], minlength=len(first)).astype(np.uint32).tobytes(), 1)
            yield _rows(names, pa.array([k], pa.int32()), pa.array([chunk], pa.int64()), pa.array([heads], pa.binary()), pa.array([counts], pa.binary()),
                        pa.array([(h[s] >> U64(32)).astype(np.uint8).tobytes()], pa.binary()), pa.array([h[s].astype(np.uint32).tobytes()], pa.binary()))

    @tidy
    def count(batches):
        names = ["chunk", "heads", "alone"]
        for _, rows in _by_key(batches, "bucket"):
            parts = [np.frombuffer(b, np.uint8).astype(U64) << U64(32) | np.frombuffer(a, np.uint32).astype(U64) for a, b in zip(rows["low"].to_pylist(), rows["high"].to_pylist())]
            h = np.concatenate(parts)
            order = np.argsort(h)
            h = h[order]
            new = np.concatenate([[True], h[1:] != h[:-1], [True]])[:len(h) + 1]
            alone = np.empty(len(h), bool)
            alone[order] = new[:-1] & new[1:]
            at = 0
            for i, (chunk, heads, counts) in enumerate(zip(rows["chunk"].to_pylist(), rows["heads"].to_pylist(), rows["counts"].to_pylist())):
                m = np.frombuffer(zlib.decompress(counts), np.uint32)
                lone = np.bincount(rows_of(m)[alone[at:at + len(parts[i])]], minlength=len(m)).astype(np.uint32)
                at += len(parts[i])
                yield _rows(names, pa.array([chunk], pa.int64()), pa.array([heads], pa.binary()), pa.array([zlib.compress(lone.tobytes(), 1)], pa.binary()))

    @tidy
    def judge(batches):
        for _, rows in _by_key(batches, "chunk"):
            heads = next(x for x in rows["heads"].to_pylist() if x is not None)
            data = np.frombuffer(zlib.decompress(heads), np.int64).reshape(3, -1)
            lone = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64) for x in rows["alone"].to_pylist())
            keep = lone <= data[2] - _need(data[2], percent)
            yield _rows(["digest", "second"], pa.array(data[0][keep]), pa.array(data[1][keep]))

    packed = docs.where("text is not null").select("text").mapInArrow(emit, "bucket int, chunk long, heads binary, counts binary, high binary, low binary")
    counted = _deal(packed, buckets, "bucket").mapInArrow(count, "chunk long, heads binary, alone binary")
    return materialize(_deal(counted, buckets, "chunk").mapInArrow(judge, "digest long, second long").distinct())


def regions(classes: DataFrame, percent: int, buckets: int) -> DataFrame:
    """kind 0: (a, b) pairs of classes to compare; kind 1: (region, a, n, c) members of regions of more than LEAF classes, c their
    centrality (how common their shingles are)."""

    @tidy
    def emit(batches):
        held, size = [], 0
        for part in slices(batches):
            sets = shingle_sets(*string_buffers(column(part, "text")))
            held.append((column(part, "a").to_numpy(), sets.sizes, sets.hashes))
            size += len(sets.hashes)
            if size >= PACK:
                yield from pack(held)
                held, size = [], 0
        if held:
            yield from pack(held)

    def pack(held):
        a, n, h = (np.concatenate(x) for x in zip(*held))
        chunk, row = _chunk_id(a.view(U64)), rows_of(n).astype(np.uint32)
        bucket = ((h >> U64(40)) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, row = h[order], row[order]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        home = chunk % buckets
        for k in np.flatnonzero((np.diff(edges) > 0) | (np.arange(buckets) == home)).tolist():
            s = slice(edges[k], edges[k + 1])
            heads = a.tobytes() + n.astype(np.int64).tobytes() if k == home else None
            yield _rows(["bucket", "chunk", "heads", "hashes", "row"], pa.array([k], pa.int32()), pa.array([chunk], pa.int64()), pa.array([heads], pa.binary()),
                        pa.array([h[s].tobytes()], pa.binary()), pa.array([row[s].tobytes()], pa.binary()))

    @tidy
    def count(batches):
        for _, rows in _by_key(batches, "bucket"):
            parts = [np.frombuffer(x, U64) for x in rows["hashes"].to_pylist()]
            _, back, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            times = times[back].astype(np.uint32)
            at = 0
            for part, chunk, heads, row in zip(parts, rows["chunk"].to_pylist(), rows["heads"].to_pylist(), rows["row"].to_pylist()):
                n = times[at:at + len(part)]
                at += len(part)
                more = n > 1
                yield _rows(["chunk", "heads", "hashes", "row", "times"], pa.array([chunk], pa.int64()), pa.array([heads], pa.binary()),
                            pa.array([part[more].tobytes()], pa.binary()), pa.array([np.frombuffer(row, np.uint32)[more].tobytes()], pa.binary()), pa.array([n[more].tobytes()], pa.binary()))

    @tidy
    def place(batches):
        for _, rows in _by_key(batches, "chunk"):
            join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in rows[name].to_pylist()])
            a, n = np.frombuffer(next(x for x in rows["heads"].to_pylist() if x is not None), np.int64).reshape(2, -1)
            h, row, times = join("hashes", U64), join("row", np.uint32).astype(np.int64), join("times", np.uint32)
            order = np.lexsort((h, times, row))
            h, row, times = h[order], row[order], times[order]
            shared = np.bincount(row, minlength=len(a))
            central = (100 * np.bincount(row, times, len(a)) / np.maximum(n, 1)).astype(np.int64)
            pos = ranges(shared) + np.repeat(n - shared, shared)  # those that no other set has come first
            keep = pos <= (n - _need(n, percent))[row]
            h, row, pos = h[keep], row[keep], pos[keep]
            bucket = ((h >> U64(40)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, row, pos = h[order], row[order], pos[order]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                s = slice(edges[k], edges[k + 1])
                data = np.stack([h[s].view(np.int64), a[row[s]], n[row[s]], pos[s], central[row[s]]])
                yield _rows(["bucket", "postings"], pa.array([k], pa.int32()), pa.array([data.tobytes()], pa.binary()))

    NAMES = ["kind", "region", "a", "b", "n", "c"]

    @tidy
    def meet(batches):
        for _, rows in _by_key(batches, "bucket"):
            key, a, n, pos, c = np.concatenate([np.frombuffer(x, np.int64).reshape(5, -1) for x in rows["postings"].to_pylist()], 1)
            order = np.lexsort((a, key))
            key, a, n, pos, c = (x[order] for x in (key, a, n, pos, c))
            edges = _edges(key)
            # a partner of at least the region's least size, and at least percent of n, must leave enough in common
            least = np.repeat(np.minimum.reduceat(n, edges[:-1]), np.diff(edges))
            keep = (100 + percent) * (n - pos) >= percent * (n + np.maximum(least, _need(n, percent)))
            key, a, n, pos, c = (x[keep] for x in (key, a, n, pos, c))
            if not len(key):
                continue
            edges = _edges(key)
            size = np.diff(edges)
            pairs = [np.zeros((0, 2), np.int64)]
            for g in range(2, LEAF + 1):
                at = edges[:-1][size == g]
                pairs += [np.stack([at + i, at + j], 1) for i in range(g) for j in range(i + 1, g)]
            x, y = np.concatenate(pairs).T
            common = np.minimum(n[x] - pos[x], n[y] - pos[y])
            fit = ((100 + percent) * common >= percent * (n[x] + n[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            found = np.unique(np.stack([a[x[fit]], a[y[fit]]], 1), axis=0)
            none = pa.nulls(len(found), pa.int64())
            yield _rows(NAMES, pa.array(np.zeros(len(found), np.int8)), none, pa.array(found[:, 0]), pa.array(found[:, 1]), none, none)
            of = np.flatnonzero(np.repeat(size, size) > LEAF)
            for at in range(0, len(of), 100_000):
                x = of[at:at + 100_000]
                yield _rows(NAMES, pa.array(np.ones(len(x), np.int8)), pa.array(key[x]), pa.array(a[x]), pa.nulls(len(x), pa.int64()), pa.array(n[x]), pa.array(c[x]))

    packed = classes.select("a", "text").mapInArrow(emit, "bucket int, chunk long, heads binary, hashes binary, row binary")
    counted = _deal(packed, buckets, "bucket").mapInArrow(count, "chunk long, heads binary, hashes binary, row binary, times binary")
    placed = _deal(counted, buckets, "chunk").mapInArrow(place, "bucket int, postings binary")
    return materialize(_deal(placed, buckets, "bucket").mapInArrow(meet, "kind byte, region long, a long, b long, n long, c long"))


def _edges(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))


def unequal_regions(members: DataFrame) -> DataFrame:
    """Of regions with the same members, one."""
    total = lambda seed: F.sum(F.xxhash64("a", F.lit(seed)).cast("decimal(20,0)"))
    sign = members.groupBy("region").agg(total(1).alias("s"), total(2).alias("t"), F.count("*").alias("k"))
    return members.join(sign.groupBy("s", "t", "k").agg(F.min("region").alias("region")).select("region"), "region", "left_semi")


def classes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """a (a number of its own), digest, second, n, profile and text of each wanted set (digest, second), written once. A filter, built where
    the digests are, chooses the texts that are shipped; the join that follows is exact."""
    spark = docs.sparkSession
    filter_bits = min(max(int(np.ceil(np.log2(FILTER_RATIO * wanted.count() + 1))), 12), FILTER_MOST)
    parts = LEAST_BUCKETS

    @tidy
    def bits(batches):
        mask = np.zeros(1 << filter_bits, bool)
        for batch in batches:
            mask[(column(batch, "digest").to_numpy().view(U64) >> U64(64 - filter_bits)).astype(np.int64)] = True
        for k in range(parts):
            some = mask[k * len(mask) // parts:(k + 1) * len(mask) // parts]
            if some.any():
                yield _rows(["part", "bits"], pa.array([k], pa.int32()), pa.array([zlib.compress(np.packbits(some).tobytes(), 1)], pa.binary()))

    @tidy
    def union(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(column(batch, "part").to_pylist(), column(batch, "bits").to_pylist()):
                add = np.frombuffer(zlib.decompress(packed), np.uint8)
                total[k] = total[k] | add if k in total else add
        for k, m in total.items():
            yield _rows(["part", "bits"], pa.array([k], pa.int32()), pa.array([m.tobytes()], pa.binary()))

    found = {r["part"]: r["bits"] for r in wanted.select("digest").mapInArrow(bits, "part int, bits binary").repartition(parts, "part").mapInArrow(union, "part int, bits binary").collect()}
    empty = bytes((1 << filter_bits) // parts // 8)
    shared = spark.sparkContext.broadcast(np.frombuffer(b"".join(found.get(k, empty) for k in range(parts)), np.uint8))

    @tidy
    def choose(batches):
        mask = shared.value
        seen: set[tuple[int, int]] = set()
        for part in slices(batches):
            texts = column(part, "text")
            sets = shingle_sets(*string_buffers(texts))
            at = (sets.first >> U64(64 - filter_bits)).astype(np.int64)
            hit = np.flatnonzero((mask[at >> 3] >> (7 - (at & 7)) & 1) * (sets.sizes > 0))
            name = lambda i: (sets.first[i].item(), sets.second[i].item())  # noqa: B023, E731
            fresh = [i for i in hit.tolist() if name(i) not in seen and not seen.add(name(i))]
            if len(seen) > 1_000_000:
                seen.clear()
            counts = np.bincount(rows_of(sets.sizes) * CLASSES + (sets.hashes % U64(CLASSES)).astype(np.int64), minlength=len(texts) * CLASSES).reshape(-1, CLASSES)
            profile = np.minimum(counts, 255).astype(np.uint8)  # a count cut off keeps the bound
            yield _rows(["digest", "second", "n", "profile", "text"], pa.array(sets.first[fresh].view(np.int64)), pa.array(sets.second[fresh].view(np.int64)), pa.array(sets.sizes[fresh]),
                        pa.array([profile[i].tobytes() for i in fresh], pa.binary()), texts.take(pa.array(fresh, pa.int64())))

    key = ["digest", "second"]
    rows = docs.where("text is not null").select("text").mapInArrow(choose, "digest long, second long, n long, profile binary, text string").join(wanted, key, "left_semi")
    # copies from several tasks: partial aggregation keeps one of each, without a hot key
    path = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    one = rows.groupBy(*key).agg(F.first("n").alias("n"), F.first("profile").alias("profile"), F.first("text").alias("text"))
    one.select(F.monotonically_increasing_id().alias("a"), "*").write.parquet(path)
    return spark.read.parquet(path)


def near_profiles(p: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Can sets of n and m shingles with these profiles (rows) link?"""
    apart = np.abs(p.astype(np.int16) - q.astype(np.int16)).sum(-1)
    return (100 + percent) * apart <= (100 - percent) * (n + m)


def _profiles(column_: pa.Array) -> np.ndarray:
    return string_buffers(column_)[0].reshape(-1, CLASSES)


def compare(pairs: DataFrame, texts: DataFrame, percent: int, screened: bool = True) -> DataFrame:
    """a, b, common and united (shingles) of every pair (a, b), if `screened` that profiles allow to link, from the whole texts. All partners
    of a meet a under one key, or under several when there are more than PARTNERS."""
    side = lambda c: texts.select(F.col("a").alias(c), F.col("profile").alias(f"{c}_profile"), F.col("n").alias(f"{c}_n"))

    @tidy
    def screen(batches):
        for batch in batches:
            get = lambda c: column(batch, c)
            near = near_profiles(_profiles(get("a_profile")), _profiles(get("b_profile")), get("a_n").to_numpy(), get("b_n").to_numpy(), percent)
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([get("a").filter(keep), get("b").filter(keep)], ["a", "b"])

    pairs = pairs.select("a", "b").distinct()
    if screened:
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(screen, "a long, b long")
    pairs = materialize(pairs)
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("k"))
    keyed = pairs.join(load, "a").select("a", F.pmod(F.xxhash64("b"), "k").cast("int").alias("salt"), F.col("b").alias("x"))
    own = load.select("a", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.col("a").alias("x"))
    asked = keyed.unionByName(own)
    rows = asked.join(texts.select(F.col("a").alias("x"), "text"), "x").select("a", "salt", "x", (F.col("a") != F.col("x")).alias("partner"), "text")

    @tidy
    def run(batches):
        pivot, mine = None, None
        for part in slices(batches):
            keys, xs, partner = column(part, "a").to_numpy(), column(part, "x").to_numpy(), column(part, "partner").to_numpy(zero_copy_only=False)
            sets = shingle_sets(*string_buffers(column(part, "text")))
            out = []
            for i in range(part.num_rows):
                own = sets.hashes[sets.edges[i]:sets.edges[i + 1]]
                if not partner[i]:
                    pivot, mine = keys[i], own.copy()
                else:
                    assert pivot == keys[i]
                    at = np.searchsorted(mine, own)
                    common = int((mine[np.minimum(at, len(mine) - 1)] == own).sum())
                    out.append((keys[i], xs[i], common, len(mine) + len(own) - common))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], ["a", "b", "common", "united"])

    dealt = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "partner")
    return materialize(dealt.mapInArrow(run, "a long, b long, common long, united long"))


def open_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of one region, in blocks: of different components, of fitting sizes and not ruled out by a pivot or by
    profiles. members: region, a, n, label, profile, d (array of distances to the region's pivots, null where unknown)."""
    blocks = members.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    dealt = members.join(blocks, "region").withColumn("i", F.pmod(F.xxhash64("a"), "k").cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("region", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"), (F.col("i") < F.col("j")).alias("left"), (F.col("i") == F.col("j")).alias("same"), "a", "n", "label", "profile", "d")

    def run(table: pa.Table) -> pa.Table:
        a, n, label = (table.column(c).to_numpy() for c in ("a", "n", "label"))
        profile = _profiles(table.column("profile").combine_chunks())
        d = np.array([[np.nan if v is None else v for v in x] for x in table.column("d").to_pylist()]).reshape(len(a), -1)
        left, same = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "same"))
        rows, cols = (np.flatnonzero(same), np.flatnonzero(same)) if same.all() else (np.flatnonzero(left), np.flatnonzero(~left))
        out = []
        for r in rows:
            fit = (label[cols] != label[r]) & (100 * np.minimum(n[cols], n[r]) >= percent * np.maximum(n[cols], n[r]))
            if same.all():
                fit &= a[cols] > a[r]
            for k in range(d.shape[1]):
                with np.errstate(invalid="ignore"):
                    fit &= ~(np.abs(d[cols, k] - d[r, k]) > 1 - percent / 100 + 1e-9)
            c = cols[fit]
            c = c[near_profiles(profile[c], profile[r], n[c], n[r], percent)]
            out.append(np.stack([np.full(len(c), a[r]), a[c]], 1))
        found = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(found.min(1)), "b": pa.array(found.max(1))}) if len(found) else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})

    return dealt.groupBy("region", "low", "high").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, rounds: int = 2, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, n_shingles, digest, second) of every document, and (node, second, label, label_second): the component, named by
    one of its sets, of every set that has links."""
    spark = docs.sparkSession

    def make():
        def work(texts):
            sets = shingle_sets(*string_buffers(texts))
            return [pa.array(sets.sizes), pa.array(sets.first.view(np.int64)), pa.array(sets.second.view(np.int64))]

        return work

    rows = scan(docs, make, "n_shingles long, digest long, second long", carry)
    buckets = bucket_count(docs)
    classes = classes_of(docs, likely(docs, percent, buckets))
    release(spark)
    found = regions(classes, percent, buckets)
    release(spark)
    linked = F.col("common") * 100 >= percent * F.col("united")
    labels = components(compare(found.where("kind = 0"), classes, percent).where(linked).select("a", "b"))
    merge = lambda labels, new: components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(new.where(linked).select("a", "b")))
    members = materialize(unequal_regions(found.where("kind = 1").select("region", "a", "n", "c")).withColumn("d", F.array().cast("array<double>")).withColumn("used", F.lit(False)))

    def still_open(members, labels):
        state = members.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
        mixed = state.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("region")
        return materialize(state.join(mixed, "region", "left_semi"))

    state = still_open(members, labels)
    for k in range(rounds):
        if state.isEmpty():
            break
        state, measured = voronoi_round(state, classes, percent, k)
        labels = merge(labels, measured)
        state = still_open(state.drop("label"), labels)
        release(spark)
    if not state.isEmpty():
        left = state.join(classes.select("a", "profile"), "a")
        labels = merge(labels, compare(materialize(open_pairs(left, percent)), classes, percent))
    name = lambda a, first, second: classes.select(F.col("a").alias(a), F.col("digest").alias(first), F.col("second").alias(second))
    named = labels.withColumnRenamed("label", "root").join(name("node", "digest", "second"), "node").join(name("root", "label", "label_second"), "root")
    return rows, named.select(F.col("digest").alias("node"), "second", "label", "label_second")


def voronoi_round(state: DataFrame, classes: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Members of the regions of the next round, and the distances measured. state: region, a, n, c, d, used (was a pivot), label."""
    fresh = lambda j: F.struct(~F.col("used"), F.col("c") if j == 0 else F.xxhash64("a", F.lit(PIVOTS * k + j)), "a")
    pivots = state.groupBy("region").agg(F.array_distinct(F.array(*[F.max(fresh(j))["a"] for j in range(PIVOTS)])).alias("p"))
    asked = materialize(state.join(pivots, "region"))
    pairs = asked.select("a", F.explode("p").alias("pivot")).where("a <> pivot")
    measured = compare(pairs.select(F.col("pivot").alias("a"), F.col("a").alias("b")), classes, percent, screened=False)
    far = measured.select(F.col("a").alias("pivot"), F.col("b").alias("a"), (1 - F.col("common") / F.col("united")).alias("to"))
    each = asked.select("region", "a", "n", "c", "d", "used", F.size("p").alias("pivots"), F.posexplode("p").alias("j", "pivot")).join(far, ["pivot", "a"], "left")
    each = each.withColumn("to", F.coalesce("to", F.lit(0.0)))  # the pivot itself
    near = each.groupBy("region", "a").agg(F.first("n").alias("n"), F.first("c").alias("c"), F.first("d").alias("d"), F.max(F.col("used") | (F.col("a") == F.col("pivot"))).alias("used"),
                                           F.sort_array(F.collect_list(F.struct("j", "to", "pivot"))).alias("to"))  # PIVOTS entries at most
    near = near.withColumn("d", F.concat("d", F.col("to.to"))).withColumn("least", F.array_min("to.to"))
    near = materialize(near.withColumn("cells", F.filter("to", lambda t: t["to"] - F.col("least") <= 2 * (1 - percent / 100) + 1e-9)))
    split = near.groupBy("region").agg((F.sum(F.size("cells")) <= SPLIT * F.count("*")).alias("split"))
    parted = near.join(split, "region")
    cells = parted.withColumn("cell", F.explode(F.when(F.col("split"), F.col("cells.pivot")).otherwise(F.array(F.lit(None).cast("long")))))
    out = cells.select(F.when(F.col("split"), F.xxhash64("region", "cell")).otherwise(F.col("region")).alias("region"), "a", "n", "c", "d", "used")
    return materialize(out), measured


def with_components(docs: DataFrame, percent: int = 75, carry: list[str] | None = None) -> DataFrame:
    """row, n_shingles, digest, label (of the component; several may share a smallest doc_id) and component_id (the
    smallest doc_id reachable by links) of every document."""
    rows, labels = near_duplicates(docs, percent, carry=carry)
    known = labels.select(F.col("node").alias("digest"), "second", F.struct(F.col("label").alias("digest"), F.col("label_second").alias("second")).alias("label"))
    labelled = rows.join(known, ["digest", "second"], "left").withColumn("label", F.coalesce("label", F.struct("digest", "second")))
    smallest = labelled.where("n_shingles > 0").groupBy("label").agg(F.min("row.doc_id").alias("smallest"))
    out = labelled.join(smallest, "label", "left")
    return out.select("row", "n_shingles", "digest", "label", F.when(F.col("n_shingles") > 0, F.col("smallest")).otherwise(F.col("row.doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The documents that are the first of their component (smallest doc_id; of repeated ids one row), with their own
    columns; texts without a shingle all stay."""
    out = with_components(docs, percent)
    alone = out.where("n_shingles = 0").select("row.*")
    first = out.where((F.col("n_shingles") > 0) & F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    return alone.unionByName(first.groupBy("label").agg(F.min_by("row", "digest").alias("row")).select("row.*"))
