"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the distinct windows of `width` consecutive words of the benchmark items (an item with
fewer words is one pattern). For each pattern length there is a table of shifts, indexed by the hash of
a block of two words: how far the search may move on when a document's window ends with this block. A
shift of zero leads to the bucket of the patterns that end with the block; the words of these patterns
are compared with the document's, bytes and all. Many windows are searched side by side as arrays.

Benchmarks are test sets, small beside any corpus; their patterns are broadcast in blocks of at most
`block_windows` patterns and searched block by block, so a task holds one block's tables at a time.

Defined results: null and empty texts have no words; items without an id or a word are no items;
repeated items count once by id; repeated documents are searched like others; empty tables work.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.text import LOWER_VALUES, U64, mix, powers, prefix_hash, ranges, rows_of, scan, shingle_hash, span_hash, string_buffers, word_spans

GAP = np.ones(256, bool)
GAP[0x30:0x3A] = GAP[0x41:0x5B] = GAP[0x61:0x7B] = GAP[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Window ends that one cursor of the search covers.
RUN = 256


def item_windows(text: str | None, width: int) -> list[bytes]:
    """Distinct windows of an item, their words joined by a blank."""
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return []
    return list(dict.fromkeys(b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))))


class Patterns:
    """Search tables for patterns of one length in words."""

    def __init__(self, patterns: list[bytes], ids: list[int]):
        words = [p.split(b" ") for p in patterns]
        self.length, self.ids = len(words[0]), np.array(ids)
        self.block = min(2, self.length)
        flat = [w for p in words for w in p]
        self.bytes = np.frombuffer(b"".join(flat), np.uint8)
        self.sizes = np.array([len(w) for w in flat]).reshape(-1, self.length)
        ends = np.cumsum(self.sizes).reshape(self.sizes.shape)
        self.starts = ends - self.sizes
        codes = span_hash(prefix_hash(self.bytes), self.starts.ravel(), ends.ravel()).reshape(self.sizes.shape)
        self.codes = codes
        self.bits = max(16, int(len(patterns) * self.length).bit_length() + 3)
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.int16)
        for j in range(self.length - self.block, -1, -1):  # blocks from the last one; a smaller shift wins
            np.minimum.at(self.shift, self.slot(self.block_hash(codes[:, j:j + self.block])), np.int16(self.length - self.block - j))
        last = self.slot(self.block_hash(codes[:, self.length - self.block:]))
        self.order = np.argsort(last, kind="stable")
        self.sorted = last[self.order]

    def block_hash(self, codes: np.ndarray) -> np.ndarray:
        up = powers(self.block + 1)[0]
        return mix(sum((codes[:, j] * up[j + 1] for j in range(self.block)), np.zeros(len(codes), U64)))

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last word and pattern of every occurrence; first: first word of each row (rows + 1)."""
        m = self.length
        none = np.zeros(0, np.int64)
        slots = self.slot(shingle_hash(codes, self.block))  # slots[i]: block that starts at word i
        n = np.maximum(0, np.diff(first) - (m - 1))
        pieces = -(-n // RUN)
        row = rows_of(pieces)
        at = first[:-1][row] + (m - 1) + RUN * ranges(pieces)
        stop = np.minimum(at + RUN, first[1:][row])
        found = []
        while len(at):
            step = self.shift[slots[at - (self.block - 1)]]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        ends_at = np.concatenate(found) if found else none
        if not len(ends_at):
            return none, none
        key = slots[ends_at - (self.block - 1)]
        low = np.searchsorted(self.sorted, key, "left")
        n = np.searchsorted(self.sorted, key, "right") - low
        ends_at, pattern = np.repeat(ends_at, n), self.order[np.repeat(low, n) + ranges(n)]
        same = np.ones(len(ends_at), bool)
        for j in range(m):  # words' hashes and lengths first, then their bytes
            w = ends_at - (m - 1) + j
            same &= (codes[w] == self.codes[pattern, j]) & (ends[w] - starts[w] == self.sizes[pattern, j])
        ends_at, pattern = ends_at[same], pattern[same]
        same = np.ones(len(ends_at), bool)
        for j in range(m):
            w, size = ends_at - (m - 1) + j, self.sizes[pattern, j]
            step, of = ranges(size), rows_of(size)
            differ = lower[starts[w][of] + step] != self.bytes[self.starts[pattern, j][of] + step]
            same[of[differ]] = False
        return ends_at[same], self.ids[pattern[same]]


def mark_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_windows: int = 1_000_000, carry: list[str] | None = None) -> DataFrame:
    """row (struct of the carried columns), n_words, n_hit (words inside an occurrence), spans (maximal
    runs of hit words, as [first, end) word numbers) and item_ids (of items with an occurrence, as strings in
    string order) for each document."""
    spark = docs.sparkSession
    items = (benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
             .select(F.col("item_id").cast("string").alias("item_id"), "text").distinct().toLocalIterator())
    window_items: dict[bytes, set[str]] = {}
    for item in items:
        for w in item_windows(item["text"], width):
            window_items.setdefault(w, set()).add(item["item_id"])
    windows = sorted(window_items)
    names = sorted({i for s in window_items.values() for i in s})
    number = {n: i for i, n in enumerate(names)}
    owners = [sorted(number[i] for i in window_items[w]) for w in windows]
    counts = np.array([len(o) for o in owners], np.int64)
    owned = spark.sparkContext.broadcast((names, np.cumsum(counts) - counts, counts, np.array([i for o in owners for i in o], np.int64)))
    blocks = [spark.sparkContext.broadcast((windows[i:i + block_windows], i)) for i in range(0, len(windows), block_windows)]

    def tables(block) -> list[Patterns]:
        patterns, offset = block.value
        by_length: dict[int, tuple[list[bytes], list[int]]] = {}
        for k, p in enumerate(patterns):
            group = by_length.setdefault(p.count(b" ") + 1, ([], []))
            group[0].append(p)
            group[1].append(offset + k)
        return [Patterns(*group) for _, group in sorted(by_length.items())]

    def make():
        names, owner_at, owner_n, owner = owned.value
        kept = [tables(b) for b in blocks] if len(blocks) == 1 else None

        def work(texts: pa.Array) -> list[pa.Array]:
            buf, offsets = string_buffers(texts)
            starts, ends, first = word_spans(buf, offsets, GAP)
            codes = span_hash(prefix_hash(buf, LOWER_VALUES), starts, ends)
            lower = LOWER[buf]
            depth = np.zeros(len(starts) + 1, np.int64)
            pairs = [np.zeros((0, 2), np.int64)]
            for block in kept or (tables(b) for b in blocks):
                for p in block:
                    at, window = p.find(codes, first, starts, ends, lower)
                    np.add.at(depth, at - (p.length - 1), 1)
                    np.add.at(depth, at + 1, -1)
                    doc, n = np.searchsorted(first, at, "right") - 1, owner_n[window]
                    pairs.append(np.stack([np.repeat(doc, n), owner[np.repeat(owner_at[window], n) + ranges(n)]], 1))
            hit = np.cumsum(depth)[:-1] > 0
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
            fresh = np.append(False, ~hit)[:len(hit)]  # the word before is not hit
            fresh[first[:-1][first[:-1] < len(hit)]] = True
            begins = np.flatnonzero(hit & fresh)
            doc = np.searchsorted(first, begins, "right") - 1
            stops = np.zeros(len(begins), np.int64)
            if len(begins):
                clear = np.flatnonzero(~np.append(hit, False))
                stops = np.minimum(clear[np.searchsorted(clear, begins)], first[doc + 1])
            of, item = np.unique(np.concatenate(pairs), axis=0).T
            lists = [names[i] for i in item]
            n_rows = len(texts)
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_rows + 1)), pa.int32()), pa.StructArray.from_arrays(
                [pa.array(begins - first[doc]), pa.array(stops - first[doc])], ["first", "end"]))
            return [pa.array(np.diff(first)), pa.array(n_hit), spans,
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n_rows + 1)), pa.int32()), pa.array(lists, pa.string()))]

        return work

    return scan(docs, make, "n_words long, n_hit long, spans array<struct<first: long, end: long>>, item_ids array<string>", carry)


def drop_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """Documents without a hit word, with their own columns."""
    return mark_benchmark(docs, benchmark, width).where("n_hit = 0").select("row.*")
