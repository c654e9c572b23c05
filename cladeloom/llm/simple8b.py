"""Token-id files in Simple-8b: every 64-bit word has a 4-bit selector and 60 bits for as many ids as fit.

File: containers in ascending doc_id order, each followed by a line feed. Container (little-endian):
8 bytes magic; six u64: documents, ids, blocks, words, exceptions, crc32 of all that follows; then
doc_id i64, present u8 (0: the doc_id is null) and token count u64 per document, first word u32 per
block (and one past the last), the words, the exceptions (u64). A block holds `BLOCK` ids (the last one
fewer), starts with a new word and so can be decoded by itself. Selector 0 is the escape: its 60 bits are
the number of an exception, an id of 60 bits or more. Encoding and decoding work on all blocks of a
container side by side.

Defined results: a null or empty text has only the end id; documents are ordered by (doc_id, text), null
doc_ids first, and repeated rows are written again each; an empty table gives empty results; extra columns are
ignored. Spark's own writer commits the files, so lost executors leave no half-written file behind.
"""
from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeloom.llm.text import column, slices, string_buffers
from cladeloom.llm.tokens import encoder
from cladeloom.session import shared_dir

MAGIC = b"S8BIDS01"
BLOCK = 1024
#: Ids per word and bits per id of selectors 1 to 14.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Bytes of text in a container (or one longer text), and containers in a file.
CONTAINER_BYTES = 1 << 20
FILE_CONTAINERS = 32
U64 = np.uint64


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (and the end), exceptions."""
    ids = ids.astype(U64)
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(0, U64), np.zeros(1, np.uint32), np.zeros(0, U64)
    values = np.zeros((n_blocks, BLOCK), U64)
    values.ravel()[:len(ids)] = ids
    size = np.full(n_blocks, BLOCK)
    size[-1] = len(ids) - BLOCK * (n_blocks - 1)
    here = np.arange(BLOCK, dtype=np.int16)
    choice = np.zeros((n_blocks, BLOCK), np.int8)  # escape unless something fits
    for s in range(14, 0, -1):  # fuller words overwrite
        big = np.where(values >> U64(BITS[s]) > 0, here, np.int16(BLOCK))  # the padding is zero and fits everywhere
        clear = np.minimum.accumulate(big[:, ::-1], axis=1)[:, ::-1] - here
        choice[(clear >= COUNTS[s]) | (clear + here == BLOCK)] = s
    at, block = np.zeros(n_blocks, np.int64), np.arange(n_blocks)
    step = np.maximum(COUNTS, 1)
    blocks, starts, selectors = [], [], []
    while len(block):
        s = choice[block, at]
        blocks.append(block)
        starts.append(at)
        selectors.append(s)
        at = at + step[s]
        on = at < size[block]
        block, at = block[on], at[on]
    block, start, selector = np.concatenate(blocks), np.concatenate(starts), np.concatenate(selectors)
    order = np.lexsort((start, block))
    block, start, selector = block[order], start[order], selector[order]
    words = selector.astype(U64)
    flat = np.concatenate([values.ravel(), np.zeros(64, U64)])
    for s in range(1, 15):
        of = np.flatnonzero(selector == s)
        if len(of):
            first = block[of] * BLOCK + start[of]
            room = BLOCK - start[of]
            for j in range(COUNTS[s]):
                words[of] |= np.where(j < room, flat[first + j], U64(0)) << U64(4 + j * BITS[s])
    escaped = np.flatnonzero(selector == 0)
    words[escaped] |= np.arange(len(escaped)).astype(U64) << U64(4)
    return words, np.searchsorted(block, np.arange(n_blocks + 1)).astype(np.uint32), flat[block[escaped] * BLOCK + start[escaped]]


def decode_ids(words: np.ndarray, first: np.ndarray, exceptions: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of all blocks given; n_ids: their number."""
    selector = (words & U64(15)).astype(np.int64)
    count = np.maximum(COUNTS, 1)[selector]
    block = np.repeat(np.arange(len(first) - 1), np.diff(first.astype(np.int64)))
    before = np.cumsum(count) - count
    start = block * BLOCK + before - (before[first[:-1]][block] if len(words) else 0)
    out = np.zeros(n_ids + 64 + BLOCK, U64)
    stop = np.minimum((block + 1) * BLOCK, n_ids)
    for s in range(1, 15):
        of = np.flatnonzero(selector == s)
        if len(of):
            mask = U64((1 << int(BITS[s])) - 1)
            for j in range(COUNTS[s]):
                inside = of[start[of] + j < stop[of]]
                out[start[inside] + j] = words[inside] >> U64(4 + j * BITS[s]) & mask
    of = np.flatnonzero(selector == 0)
    out[start[of]] = exceptions[(words[of] >> U64(4)).astype(np.int64)]
    return out[:n_ids]


def container(doc_ids: np.ndarray, present: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, first, exceptions = encode_ids(ids)
    body = b"".join([doc_ids.astype("<i8").tobytes(), present.astype("u1").tobytes(), counts.astype("<u8").tobytes(),
                     first.astype("<u4").tobytes(), words.astype("<u8").tobytes(), exceptions.astype("<u8").tobytes()])
    head = np.array([len(doc_ids), len(ids), len(first) - 1, len(words), len(exceptions), zlib.crc32(body)], "<u8")
    return MAGIC + head.tobytes() + body


def read_containers(data: memoryview):
    """doc_ids, present, counts and ids of each container of a file."""
    at = 0
    while at < len(data):
        if data[at:at + 8] != MAGIC:
            raise ValueError("not a container")
        docs, n_ids, blocks, n_words, n_exceptions, crc = (int(x) for x in np.frombuffer(data, "<u8", 6, at + 8))
        at += 56
        begin, parts = at, []
        for kind, n in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", blocks + 1), ("<u8", n_words), ("<u8", n_exceptions)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        if zlib.crc32(data[begin:at]) != crc:
            raise ValueError("a container is damaged")
        at += 1  # line feed
        doc_ids, present, counts, first, words, exceptions = parts
        yield doc_ids, present.astype(bool), counts.astype(np.int64), decode_ids(words, first, exceptions, n_ids)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end: int = 1) -> None:
    """Encodes `text` with a vocabulary file and writes doc_id (integer), ids and the end id under `path`."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = F.xxhash64("text")  # copies of one doc_id can fill several partitions
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), rank)
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), rank))

    def run(batches):
        encode = encoder(vocabulary).encode
        for part in slices(batches, limit=CONTAINER_BYTES):
            buf, offsets = string_buffers(column(part, "text"))
            ids, at = encode(buf, offsets, end)
            doc_ids = column(part, "doc_id")
            yield pa.RecordBatch.from_arrays([pa.array([container(doc_ids.fill_null(0).to_numpy(zero_copy_only=False), doc_ids.is_valid().to_numpy(zero_copy_only=False), np.diff(at), ids)], pa.binary())], ["payload"])

    # the text writer copies a string's bytes as they are
    ordered.mapInArrow(run, "payload binary").select(F.col("payload").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_CONTAINERS).text(path)


def read_ids(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids_crc32 (of little-endian u32 ids) and, unless
    told not to, ids for each document in the files under `path`."""

    def run(batches):
        for batch in batches:
            for name, content in zip(column(batch, "path").to_pylist(), column(batch, "content")):
                base = 0
                for doc_ids, present, counts, values in read_containers(memoryview(content.as_buffer())):
                    ends = np.cumsum(counts)
                    starts = ends - counts
                    small = values.astype("<u4").tobytes()
                    cols = [pa.array([name] * len(doc_ids), pa.string()), pa.array(doc_ids, pa.int64(), mask=~present), pa.array(base + starts), pa.array(counts),
                            pa.array([zlib.crc32(small[4 * a:4 * b]) for a, b in zip(starts, ends)], pa.int64())]
                    if ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(values.astype(np.int64))))
                    base += int(counts.sum())
                    yield pa.RecordBatch.from_arrays(cols, ["path", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][:len(cols)])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = files.mapInArrow(run, "path string, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
    # one row per file: how many ids lie in the files before it
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(_sizes, "path string, n long")
    number = [F.regexp_extract("path", r"part-(\d+)", 1).cast("long"), F.regexp_extract("path", r"-c(\d+)[^/]*$", 1).cast("long")]
    before = Window.orderBy(*number).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(base, "path").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def _sizes(batches):
    """Ids in each file, from the containers' heads."""
    for batch in batches:
        totals = []
        for content in column(batch, "content"):
            data, at, total = memoryview(content.as_buffer()), 0, 0
            while at < len(data):
                docs, n_ids, blocks, words, exceptions, _ = (int(x) for x in np.frombuffer(data, "<u8", 6, at + 8))
                total += n_ids
                at += 56 + 17 * docs + 4 * (blocks + 1) + 8 * (words + exceptions) + 1
            totals.append(total)
        yield pa.RecordBatch.from_arrays([column(batch, "path"), pa.array(totals, pa.int64())], ["path", "n"])


def store(docs: DataFrame, vocabulary: str, end: int = 1) -> str:
    """Writes the files into a new folder beside the checkpoints and returns its path."""
    path = f"{shared_dir(docs.sparkSession)}/simple8b-{uuid.uuid4().hex}"
    write_ids(docs, path, vocabulary, end)
    return path
