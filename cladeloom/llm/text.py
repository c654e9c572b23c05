"""Whole-text helpers for Arrow tasks: bounded slices, word spans and polynomial hashes."""
from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that a task works on at once (one longer text is a slice of its own).
SLICE_BYTES = 1 << 20

U64 = np.uint64
#: An odd base; its powers and inverse powers modulo 2**64 turn prefix sums into substring hashes.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: One pseudo-random 64-bit value for each byte value.
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Words of this many bytes or more are known by a BLAKE2 digest.
LONG_BYTES = 64
_LOWER = np.arange(256)
_LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept and grown as needed."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for key, base in (("up", BASE), ("down", INVERSE)):
            out = np.full(size, base, U64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _powers[key] = out
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit (a bijection of 64-bit words)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def prefix_hash(buf: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[buf[k]] * BASE**k over i <= k < j."""
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(values[buf] * powers(len(buf))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of each byte span."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def word_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Position-free hash of each word that may stand for the word. Modulo 2**64 some long spans are equal whatever the
    base (a Thue-Morse word of 1,024 letters and its complement), so long words take a BLAKE2 digest."""
    codes = span_hash(prefix_hash(buf, values), start, end)
    for i in np.flatnonzero(end - start >= LONG_BYTES).tolist():
        word = buf[start[i]:end[i]].tobytes()
        codes[i] = int.from_bytes(hashlib.blake2b(word.lower() if values is LOWER_VALUES else word, digest_size=8).digest(), "little")
    return codes


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a string or binary column; a null has no bytes."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = string_buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = max(end, at + 1)
            yield batch.slice(at, end - at)
            at = end


def release() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """The same task, which leaves no free memory with its Python worker: workers wait for later tasks, and beside them
    others of the same executor work."""
    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return inner


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def word_spans(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (maximal run of bytes outside `gap` within a row), and
    the first word index of each row (rows + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gap[buf]
    first = np.empty(len(buf), bool)
    first[0] = inside[0]
    np.logical_and(inside[1:], ~inside[:-1], out=first[1:])
    last = np.empty(len(buf), bool)
    last[-1] = inside[-1]
    np.logical_and(inside[:-1], ~inside[1:], out=last[:-1])
    edge = np.unique(offsets[(offsets > 0) & (offsets < len(buf))])
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def shingle_hash(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` neighbouring codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    up = powers(width + 1)[0]
    out = np.zeros(n, U64)
    for j in range(width):
        out += codes[j:j + n] * up[j + 1]
    return mix(out)


def rows_of(counts: np.ndarray) -> np.ndarray:
    """Row number of each element when row i has counts[i] of them."""
    return np.repeat(np.arange(len(counts)), counts)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..counts[i]-1 for each i, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def scan(docs: DataFrame, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], schema: str, carry: list[str] | None = None, text: str = "text") -> DataFrame:
    """One output row per input row: `row` (a struct of the carried columns, by default all of them,
    so that no name can clash) and the columns of `schema`.

    `make` runs once per task and gives the function from a slice of texts to the new columns.
    """
    carry = docs.columns if carry is None else carry
    inner = text in carry
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), *([] if inner else [F.col(f"`{text}`").alias("text")]))
    fields = StructType([source.schema["row"], *StructType.fromDDL(schema).fields])
    names = [f.name for f in fields]
    types = to_arrow_schema(fields)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            row = batch.column(0)
            texts = row.field(text) if inner else batch.column(1)
            for part in slices([pa.RecordBatch.from_arrays([row, texts], ["row", "text"])]):
                yield pa.RecordBatch.from_arrays([part.column(0), *(a.cast(types.field(n).type) for a, n in zip(work(part.column(1)), names[1:]))], names)

    return source.mapInArrow(run, fields)
