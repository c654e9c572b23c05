"""Exact removal of repeated byte strings: a byte goes when a string of `LENGTH` bytes that covers it also starts
earlier (in a document with a smaller doc_id, or earlier in the same document), judged on the input.

Every string of LENGTH bytes has an anchor: the position of the smallest hash among its `GRAM`-byte
substrings (the last of equals). Equal strings have equal anchors at the same place in them, so only strings whose
anchors' grams are equal need comparing, and there is one anchor for some 35 strings.

1. Each anchor sends the hash of its gram and of its surroundings (all bytes of the strings that may have this anchor,
   96 bits) to the gram's bucket. Where the surroundings of several anchors are equal, all but the first lose all their strings.
2. Where one gram has several surroundings, the bytes of the first of each are fetched, and all their strings become
   suffixes that are dealt by offset and hash of their LENGTH bytes, so that only those that can be equal meet, and sorted by
   merging: two suffixes are compared by binary search for their common extension on prefix polynomial hashes, and by the
   byte after it. Neighbours in the order with a common extension of LENGTH bytes are the same string, which their bytes
   then confirm; all but the first go.
3. The removed ranges meet their documents once.

Copies are reduced in each task before anything is sent, so a string that a third of all documents hold arrives
once per task. Anchors with several surroundings are found again by a filter of fixed size; others that pass it only cost time.

doc_id is an integer. Defined results: null and empty texts have no bytes; a null doc_id comes first; of different texts
with one doc_id the one with the smaller digest comes first; equal rows (same doc_id and text) are one document and get
the same result; an empty table gives an empty result; other columns do not matter.
"""
from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cladeloom.llm.text import BYTE_VALUES, U64, column, mix, powers, prefix_hash, ranges, rows_of, scan, slices, span_hash, string_buffers, tidy
from cladeloom.session import materialize

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM  # an anchor is at most so many bytes after its string's start
OTHER_VALUES = mix(BYTE_VALUES)
#: Anchors that a task packs together, and bits of the filter.
PACK = 1 << 19
FILTER_BITS = 25
FILTER_PARTS = 32
#: Bytes around anchors that a task gathers before it packs them.
FETCH_BYTES = 8 << 20
#: Bytes of text whose anchors are found at once (some 20 arrays of 8 bytes for each), and anchors and strings that are sorted at once.
ANCHOR_BYTES = 1 << 18
SORT_ANCHORS = 2_000
SORT_STRINGS = 1 << 18
FIRST = np.iinfo(np.int64).min  # stands for a null doc_id


def text_digest(buf: np.ndarray, offsets: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """64-bit digest of each whole text."""
    return mix(span_hash(prefix, offsets[:-1], offsets[1:]) + np.diff(offsets).astype(U64) * U64(0x9E3779B97F4A7C15))


def anchors(buf: np.ndarray, offsets: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, row, first and last start of the strings that have it, and the hash of its gram."""
    none = np.zeros(0, np.int64)
    n = len(buf) - LENGTH + 1
    if n <= 0:
        return none, none, none, none, none.view(U64)
    grams = len(buf) - GRAM + 1
    up, down = powers(len(buf) + 1)
    h = mix((prefix[GRAM:] - prefix[:grams]) * down[:grams])
    key = (h >> U64(32) << U64(32)) | (U64(0xFFFFFFFF) - np.arange(grams, dtype=U64))
    width = SPAN + 1  # grams of a string
    blocks = -(-grams // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, U64)
    padded[:grams] = key
    ahead = np.minimum.accumulate(padded.reshape(blocks, width), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(blocks, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (U64(0xFFFFFFFF) - (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & U64(0xFFFFFFFF))).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(n), "right") - 1 if len(offsets) > 2 else np.zeros(n, np.int64)
    start = np.flatnonzero(np.arange(n) + LENGTH <= offsets[row + 1])
    at, row = at[start], row[start]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], row[first], start[first], start[last[:len(first)]], h[at[first]]


def surroundings(offsets: np.ndarray, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all bytes that strings with this anchor may have."""
    return np.maximum(at - SPAN, offsets[row]), np.minimum(at + LENGTH, offsets[row + 1])


def keep_new(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (first key most important) and where a new value of all keys begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new


#: A packed anchor: gram and surroundings (hashes), document, anchor and starts.
ANCHOR = np.dtype([("gram", "<u4"), ("around", "<u8"), ("more", "<u4"), ("doc", "<u4"), ("at", "<u4"), ("low", "u1"), ("high", "u1")])
RANGES = "doc_id long, digest long, start long, end long"


def _ranges(doc_id, digest, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc_id), pa.array(digest.view(np.int64)), pa.array(start), pa.array(end)], ["doc_id", "digest", "start", "end"])


def _documents(batches):
    """Slices of the input: buffers, prefix hashes, doc_ids and digests."""
    for part in slices(batches, limit=ANCHOR_BYTES):
        buf, offsets = string_buffers(column(part, "text"))
        prefix = prefix_hash(buf)
        yield buf, offsets, prefix, column(part, "doc_id").fill_null(FIRST).to_numpy(zero_copy_only=False), text_digest(buf, offsets, prefix)


def _send_anchors(buckets: int):
    """Packed anchors by bucket; of equal surroundings in a task's pack only the first is sent, the others'
    ranges leave under bucket -1."""
    def flush(held):
        docs = np.concatenate([h[0] for h in held])
        digests = np.concatenate([h[1] for h in held])
        base = np.cumsum([0] + [len(h[0]) for h in held])
        rec = np.concatenate([h[2] for h in held])
        rec["doc"] += np.repeat(base[:-1], [len(h[2]) for h in held]).astype(np.uint32)
        bucket = np.concatenate([h[3] for h in held])
        held.clear()
        d = rec["doc"]
        order, new = keep_new([bucket, rec["gram"], rec["around"], rec["more"], docs[d], digests[d], rec["at"].astype(np.int64)])
        rec, bucket = rec[order[new]], bucket[order[new]]  # equal rows are one document
        del order, new, d
        gone = np.zeros(len(rec), bool)
        gone[1:] = (bucket[1:] == bucket[:-1]) & (rec["gram"][1:] == rec["gram"][:-1]) & (rec["around"][1:] == rec["around"][:-1]) & (rec["more"][1:] == rec["more"][:-1])
        yield packed(-1, removed(docs, digests, rec[gone]))
        rec, bucket = rec[~gone], bucket[~gone]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            some = rec[edges[k]:edges[k + 1]].copy()
            used, some["doc"] = np.unique(some["doc"], return_inverse=True)
            yield packed(k, len(used).to_bytes(8, "little") + docs[used].tobytes() + digests[used].tobytes() + some.tobytes())

    def packed(bucket, payload):
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())], ["bucket", "payload"])

    @tidy
    def run(batches):
        held, size = [], 0
        for buf, offsets, prefix, doc_id, digest in _documents(batches):
            at, row, low, high, gram = anchors(buf, offsets, prefix)
            if not len(at):
                continue
            a, b = surroundings(offsets, at, row)
            other = np.zeros(len(buf) + 1, U64)
            np.cumsum(OTHER_VALUES[buf] * powers(len(buf))[0], out=other[1:])
            shape = ((at - a) * 256 + (b - at)).astype(U64) * U64(0xC2B2AE3D27D4EB4F)
            rec = np.zeros(len(at), ANCHOR)
            rec["gram"] = gram & U64(0xFFFFFFFF)
            rec["around"], rec["more"] = mix(span_hash(prefix, a, b) + shape), mix(span_hash(other, a, b) + shape) >> U64(32)
            rec["doc"], rec["at"], rec["low"], rec["high"] = row, at - offsets[row], at - low, at - high
            held.append((doc_id, digest, rec, ((gram >> U64(32)) % U64(buckets)).astype(np.int32)))
            size += len(at)
            if size >= PACK:
                yield from flush(held)
                size = 0
        if held:
            yield from flush(held)

    return run


def removed(docs: np.ndarray, digests: np.ndarray, rec: np.ndarray) -> bytes:
    d, at = rec["doc"], rec["at"].astype(np.int64)
    return b"".join(x.tobytes() for x in (docs[d], digests[d], at - rec["low"], at - rec["high"] + LENGTH))


@tidy
def _meet_anchors(batches):
    """Ranges of anchors with earlier equal surroundings (kind 0), and the grams that have several surroundings (kind 1)."""
    names = ["kind", "doc_id", "digest", "start", "end"]

    def rows(kind, table):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(table[0]), kind, np.int8)), *(pa.array(x) for x in table)], names)

    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for k, payload in zip(column(batch, "bucket").to_pylist(), column(batch, "payload").to_pylist()):
            if k < 0:
                n = len(payload) // 32
                if n:
                    yield rows(0, [np.frombuffer(payload, np.int64, n, 8 * n * j) for j in range(4)])
            else:
                held.setdefault(k, []).append(payload)
    for k in list(held):
        docs, digests, recs, base = [], [], [], 0
        for payload in held.pop(k):
            n = int.from_bytes(payload[:8], "little")
            docs.append(np.frombuffer(payload, np.int64, n, 8))
            digests.append(np.frombuffer(payload, U64, n, 8 + 8 * n))
            rec = np.frombuffer(payload, ANCHOR, -1, 8 + 16 * n).copy()
            rec["doc"] += base
            base += n
            recs.append(rec)
        docs, digests, rec = np.concatenate(docs), np.concatenate(digests), np.concatenate(recs)
        order = np.argsort(rec["gram"], kind="stable")
        rec = rec[order]
        shared = np.zeros(len(rec), bool)
        shared[1:] = rec["gram"][1:] == rec["gram"][:-1]
        shared[:-1] |= shared[1:]
        rec = rec[shared]
        d = rec["doc"]
        order, new = keep_new([rec["gram"], rec["around"], rec["more"], docs[d], digests[d], rec["at"].astype(np.int64)])
        rec = rec[order][new]
        if not len(rec):
            continue
        d = rec["doc"]
        same = (rec["gram"][1:] == rec["gram"][:-1]) & (rec["around"][1:] == rec["around"][:-1]) & (rec["more"][1:] == rec["more"][:-1])
        gone = np.append(False, same)
        at = rec["at"].astype(np.int64)
        yield rows(0, [x[gone] for x in (docs[d], digests[d].view(np.int64), at - rec["low"], at - rec["high"] + LENGTH)])
        several = np.unique(rec["gram"][1:][(rec["gram"][1:] == rec["gram"][:-1]) & ~same]).astype(np.int64)
        yield rows(1, [several, several, several, several])


def fetch_filter(several: DataFrame) -> np.ndarray:
    """Bits (packed) of all grams that have several surroundings."""
    @tidy
    def bits(batches):
        mask = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            mask[column(batch, "start").to_numpy() >> (32 - FILTER_BITS)] = True
        for k, some in enumerate(mask.reshape(FILTER_PARTS, -1)):
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.packbits(some).tobytes(), 1)], pa.binary())], ["part", "bits"])

    def union(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(column(batch, "part").to_pylist(), column(batch, "bits").to_pylist()):
                add = np.frombuffer(zlib.decompress(packed), np.uint8)
                total[k] = total[k] | add if k in total else add
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["part", "bits"])

    parts = {r["part"]: r["bits"] for r in several.select("start").mapInArrow(bits, "part int, bits binary").repartition(FILTER_PARTS, "part").mapInArrow(union, "part int, bits binary").collect()}
    empty = bytes((1 << FILTER_BITS) // FILTER_PARTS // 8)
    return np.frombuffer(b"".join(parts.get(k, empty) for k in range(FILTER_PARTS)), np.uint8)


#: A fetched anchor: gram, document, anchor, starts, and where its bytes lie.
FETCHED = np.dtype([("gram", "<u8"), ("doc_id", "<i8"), ("digest", "<u8"), ("at", "<u4"), ("left", "u1"), ("size", "u1"), ("low", "u1"), ("high", "u1")])


def _fetch(shared, buckets: int):
    """Bytes around the anchors that pass the filter, packed by bucket; of equal bytes in a task's pack only the first,
    the others go by step 1."""
    def flush(held):
        rec, same, text = (np.concatenate(x) for x in zip(*held))
        held.clear()
        size = rec["size"].astype(np.int64)
        begin = np.cumsum(size) - size
        order, _ = keep_new([rec["gram"], same, rec["doc_id"], rec["digest"], rec["at"].astype(np.int64)])
        first = np.ones(len(order), bool)
        first[1:] = (rec["gram"][order][1:] != rec["gram"][order][:-1]) | (same[order][1:] != same[order][:-1])
        pick = order[first]
        bucket = ((rec["gram"][pick] >> U64(32)) % U64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        pick, bucket = pick[by], bucket[by]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            p = pick[edges[k]:edges[k + 1]]
            own = text[np.repeat(begin[p], size[p]) + ranges(size[p])]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(p).to_bytes(8, "little") + rec[p].tobytes() + own.tobytes()], pa.binary())], ["bucket", "payload"])

    @tidy
    def run(batches):
        mask = shared.value
        held, total = [], 0
        for buf, offsets, prefix, doc_id, digest in _documents(batches):
            at, row, low, high, gram = anchors(buf, offsets, prefix)
            slot = ((gram & U64(0xFFFFFFFF)) >> U64(32 - FILTER_BITS)).astype(np.int64)
            of = np.flatnonzero(mask[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
            if not len(of):
                continue
            at, row, low, high, gram = (x[of] for x in (at, row, low, high, gram))
            a, b = surroundings(offsets, at, row)
            rec = np.zeros(len(at), FETCHED)
            rec["gram"], rec["doc_id"], rec["digest"], rec["at"] = gram, doc_id[row], digest[row], at - offsets[row]
            rec["left"], rec["size"], rec["low"], rec["high"] = at - a, b - a, at - low, at - high
            same = mix(span_hash(prefix, a, b) + (rec["left"].astype(U64) << U64(8) | rec["size"]))
            text = buf[np.repeat(a, b - a) + ranges(b - a)]
            held.append((rec, same, text))
            total += len(text)
            if total >= FETCH_BYTES:
                yield from flush(held)
                total = 0
        if held:
            yield from flush(held)

    return run


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length, up to `limit`, of the common beginning of the suffixes at a and b, by binary search on hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), limit)
    on = np.flatnonzero(np.maximum(a, b) + limit < len(prefix))  # most are equal as a whole
    low[on[span_hash(prefix, a[on], a[on] + limit) == span_hash(prefix, b[on], b[on] + limit)]] = limit
    while True:
        on = np.flatnonzero(low < high)
        if not len(on):
            return low
        middle = (low[on] + high[on] + 1) >> 1
        same = span_hash(prefix, a[on], a[on] + middle) == span_hash(prefix, b[on], b[on] + middle)
        low[on[same]] = middle[same]
        high[on[~same]] = middle[~same] - 1


def sort_suffixes(buf: np.ndarray, prefix: np.ndarray, starts: np.ndarray, edges: np.ndarray, limit: int) -> np.ndarray:
    """Stable order of the suffixes within each group (members edges[g] to edges[g + 1]) by their first `limit`
    bytes: bottom-up mergesort of all groups together; each suffix finds its rank in the neighbouring run. Groups of equal
    suffixes are in order as they come."""
    order = np.arange(len(starts))
    size = np.diff(edges)
    group = rows_of(size)
    pair = np.flatnonzero(group[1:] == group[:-1])
    differ = common_extension(prefix, starts[pair], starts[pair + 1], limit) < limit
    size = np.where(np.bincount(group[pair], differ, minlength=len(size)) > 0, size, 0)
    mixed = size[group] > 0
    if not mixed.any():
        return order
    if not mixed.all():
        at = np.flatnonzero(mixed)
        order[at] = at[sort_suffixes(buf, prefix, starts[at], np.concatenate([[0], np.cumsum(size[size > 0])]), limit)]
        return order
    place, total = ranges(size), size[group]

    def less(x, y, or_equal):
        """Is suffix x before suffix y?"""
        n = common_extension(prefix, starts[x], starts[y], limit)
        end = n >= limit
        at = np.minimum(n, limit - 1)
        return np.where(end, or_equal, buf[starts[x] + at] < buf[starts[y] + at])

    width = 1
    while len(place) and width < int(size.max()):
        on = np.flatnonzero((total > width) & (place // (2 * width) * 2 * width + width < total))  # both runs exist
        run = place[on] // width
        left = run % 2 == 0
        base = edges[:-1][group[on]]
        other = base + np.where(left, run + 1, run - 1) * width
        stop = np.minimum(other + width, base + total[on])
        low, high = other.copy(), stop.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            # rank of a left suffix: right ones before it; of a right suffix: left ones before or equal
            before = less(order[middle], order[on[open_]], ~left[open_])
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]
        target = base + run // 2 * 2 * width + place[on] % width + (low - other)
        new = order.copy()
        new[target] = order[on]
        order = new
        width *= 2
    return order


@tidy
def _sort_fetched(batches):
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for k, payload in zip(column(batch, "bucket").to_pylist(), column(batch, "payload").to_pylist()):
            held.setdefault(k, []).append(payload)
    for k in list(held):
        recs, texts, hashes, base = [], [], [], 0
        for payload in held.pop(k):
            n = int.from_bytes(payload[:8], "little")
            rec = np.frombuffer(payload, FETCHED, n, 8)
            text = np.frombuffer(payload, np.uint8, -1, 8 + n * FETCHED.itemsize)
            end = np.cumsum(rec["size"].astype(np.int64))
            begin = end - rec["size"]
            recs.append((rec, begin + base))
            hashes.append(mix(span_hash(prefix_hash(text), begin, end) + (rec["left"].astype(U64) << U64(8) | rec["size"])))
            texts.append(text)
            base += len(text)
        rec, begin = (np.concatenate(x) for x in zip(*recs))
        around, buf = np.concatenate(hashes), np.concatenate(texts)
        del recs, texts, hashes
        order, _ = keep_new([rec["gram"], around, rec["doc_id"], rec["digest"], rec["at"].astype(np.int64)])
        first = np.ones(len(order), bool)
        first[1:] = (rec["gram"][order][1:] != rec["gram"][order][:-1]) | (around[order][1:] != around[order][:-1])
        pick = order[first]
        gram = rec["gram"][pick]
        several = np.zeros(len(pick), bool)
        several[1:] = gram[1:] == gram[:-1]
        several[:-1] |= several[1:]
        pick = pick[several]
        for at, stop in pieces(rec["gram"][pick]):  # prefix hashes for a piece's bytes only
            some = rec[pick[at:stop]]
            size = some["size"].astype(np.int64)
            own = buf[np.repeat(begin[pick[at:stop]], size) + ranges(size)]
            yield from _strings(some, np.cumsum(size) - size, own, prefix_hash(own))


def pieces(gram: np.ndarray, size: int = SORT_ANCHORS):
    """Cuts of about `size` anchors that leave the anchors of one gram together."""
    edges = np.append(np.flatnonzero(np.append(True, gram[1:] != gram[:-1])), len(gram)) if len(gram) else np.zeros(1, np.int64)
    at = 0
    while at < len(gram):
        stop = int(edges[np.searchsorted(edges, min(at + size, len(gram)))])
        yield at, stop
        at = stop


def offsets_at_once(low: np.ndarray, high: np.ndarray, limit: int = SORT_STRINGS):
    """Least and largest offset of strings that are compared at once: about `limit` strings, or those of one offset."""
    ends = np.zeros(SPAN + 2, np.int64)
    np.add.at(ends, high, 1)
    np.add.at(ends, low + 1, -1)
    at, total = 0, 0
    for offset, n in enumerate(np.cumsum(ends)[:-1].tolist()):
        if total and total + n > limit:
            yield at, offset - 1
            at, total = offset, 0
        total += n
    yield at, SPAN


def _later_copies(gram: np.ndarray, of: np.ndarray, back: np.ndarray, start: np.ndarray, buf: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and offset of the strings that an earlier anchor of the same gram has at the same offset."""
    of_string = span_hash(prefix, start, start + LENGTH)
    order = np.lexsort((of, of_string, back, gram[of]))
    of, back, start, of_string = of[order], back[order], start[order], of_string[order]
    new = np.ones(len(of), bool)
    new[1:] = (gram[of][1:] != gram[of][:-1]) | (back[1:] != back[:-1]) | (of_string[1:] != of_string[:-1])
    edges = np.append(np.flatnonzero(new), len(of))
    alone = np.repeat(np.diff(edges), np.diff(edges)) == 1
    of, back, start = of[~alone], back[~alone], start[~alone]
    size = np.diff(edges)[np.diff(edges) > 1]
    edges = np.concatenate([[0], np.cumsum(size)])
    sorted_ = sort_suffixes(buf, prefix, start, edges, LENGTH)
    group = rows_of(size)
    pair = np.flatnonzero(group[1:] == group[:-1])
    a, b = start[sorted_[pair]], start[sorted_[pair + 1]]
    same = common_extension(prefix, a, b, LENGTH) == LENGTH
    pair, a, b = pair[same], a[same], b[same]
    for at in range(0, len(pair), 50_000):  # hashes can collide; bytes cannot
        s = slice(at, at + 50_000)
        step = np.arange(LENGTH)
        if not np.array_equal(buf[a[s, None] + step], buf[b[s, None] + step]):
            raise ArithmeticError("two strings share their hash; change the base of the polynomial")
    gone = sorted_[pair + 1]
    return of[gone], back[gone]


def _strings(rec: np.ndarray, begin: np.ndarray, buf: np.ndarray, prefix: np.ndarray):
    """Ranges of the strings of these anchors (sorted by gram) that an earlier one has."""
    # strings in document order, so that the stable sort puts the first one first
    rec, begin = (x[np.lexsort((rec["at"], rec["digest"], rec["doc_id"], rec["gram"]))] for x in (rec, begin))
    low, high = rec["low"].astype(np.int64), rec["high"].astype(np.int64)
    found = [(np.zeros(0, np.int64),) * 2]
    for near, far in offsets_at_once(low, high):
        some = np.flatnonzero((high <= far) & (low >= near))
        top = np.minimum(low[some], far)
        n = top - np.maximum(high[some], near) + 1
        of = some[rows_of(n)]
        back = np.repeat(top, n) - ranges(n)  # bytes before the anchor
        found.append(_later_copies(rec["gram"], of, back, begin[of] + rec["left"][of] - back, buf, prefix))
    of, back = (np.concatenate(x) for x in zip(*found))
    r = rec[of]
    first = r["at"].astype(np.int64) - back
    # neighbouring strings of one anchor become one range
    order = np.lexsort((first, of))
    r, first, whose = r[order], first[order], of[order]
    new = np.ones(len(first), bool)
    new[1:] = (whose[1:] != whose[:-1]) | (first[1:] != first[:-1] + 1)
    last = np.append(np.flatnonzero(new)[1:], len(first)) - 1
    if len(first):
        yield _ranges(r["doc_id"][new], r["digest"][new].copy(), first[new], first[last] + LENGTH)


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), start and end of removed byte ranges; they may overlap."""
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 32)
    texts = docs.where(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = texts.mapInArrow(_send_anchors(buckets), "bucket int, payload binary")
    # ranges that a task settled by itself go anywhere
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("payload"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    met = materialize(sent.repartition(buckets, spread).mapInArrow(_meet_anchors, "kind byte, " + RANGES))
    whole = met.where("kind = 0").select("doc_id", "digest", "start", "end")
    shared = spark.sparkContext.broadcast(fetch_filter(met.where("kind = 1")))
    fetched = texts.mapInArrow(_fetch(shared, buckets), "bucket int, payload binary")
    return whole.unionByName(fetched.repartition(buckets, "bucket").mapInArrow(_sort_fetched, RANGES))


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, keep_text: bool = True) -> DataFrame:
    """row (struct of the carried columns), n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes) and kept_text (their whole
    characters; null unless `keep_text`) of every document."""
    gone = repeated_ranges(docs).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # at most one per 35 bytes of the text
    carry = docs.columns if carry is None else carry

    def digests():
        def work(texts):
            buf, offsets = string_buffers(texts)
            return [pa.array(text_digest(buf, offsets, prefix_hash(buf)).view(np.int64)), texts.cast(pa.string())]
        return work

    keyed = scan(docs.select(*dict.fromkeys([*carry, "doc_id", "text"])), digests, "digest long, text string", list(dict.fromkeys([*[c for c in carry if c != "text"], "doc_id"])))
    both = keyed.withColumn("doc_id", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(int(FIRST)))).join(gone, ["doc_id", "digest"], "left").select("row", "text", "spans")

    schema = StructType([both.schema["row"], *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string").fields])

    @tidy
    def run(batches):
        for part in slices(batches):
            texts, spans = column(part, "text"), column(part, "spans")
            cols = [[], [], [], [], []]
            for text, span in zip(texts.to_pylist(), spans.to_pylist()):
                raw = (text or "").encode()
                kept, at, n_spans = [], 0, 0
                if span:
                    merged: list[list[int]] = []
                    for s, e in sorted((x["start"], x["end"]) for x in span):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    for s, e in merged:
                        kept.append(raw[at:s])
                        at = e
                    n_spans = len(merged)
                kept.append(raw[at:])
                rest = b"".join(kept)
                for c, v in zip(cols, (len(raw), len(raw) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if keep_text and text is not None else None)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([column(part, "row"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))],
                                             ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return both.mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts, with their own columns; an n_chars column counts the new text.
    A cut may fall inside a character; bytes that are no longer a whole character go too. A document without a byte left
    stays with an empty text; null and empty texts stay as they are."""
    out = remove_repeats(docs)
    changed, rest = F.col("n_removed") > 0, F.col("kept_text")
    columns = {c: F.col(f"row.{c}") for c in docs.columns if c not in ("text", "n_chars")}
    columns["text"] = rest
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(changed, F.length(rest).cast(kind)).otherwise(F.col("row.n_chars"))
    return out.select(*[columns[c].alias(c) for c in docs.columns])

