"""Tokeniser fertility: how well public vocabularies cut a text, with rejection bands per language or script.

Every whole text gives (a) the plain counts of words, word characters, symbols, repeated lines and
repeated words and (b) its fertility: characters per token under a vocabulary with byte fallback and under
a byte-level one, the share of byte-fallback tokens, and the token entropy in bits. Each distinct word is
encoded once per worker (white space ends a token in both kinds of vocabulary).

Bands come from the corpus itself. Documents that pass the plain rules are grouped by language (by
dominant script where the language is null) and by size class (powers of two of the words; entropy depends on length); exact counts
over fine bins give the quartiles of each measure in each group, and a document is rejected when a
measure lies more than `fence` interquartile ranges (at least `floor` wide) outside its group's
quartiles. A group with fewer than `least` documents takes in its neighbouring size classes, as many as it needs; a language
with too few documents in all takes those of its script, a script with too few those of the corpus.

Defined results: null, empty and blank texts have no words and fail the plain rules; repeated rows are
judged each; an empty table gives an empty result; other columns do not matter.
"""
from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.llm.text import SPACE, U64, ranges, rows_of, scan, shingle_hash, string_buffers, word_hash, word_spans
from cladeloom.session import materialize

REPEAT_WORDS = 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
MEMORY_WORDS = 400_000
MEASURES = ["piece_chars", "byte_chars", "fallback", "entropy"]
#: Bins per unit, in which quartiles are resolved, and the least width of an interquartile range.
BINS = 512
FLOOR = {"piece_chars": 0.25, "byte_chars": 0.25, "fallback": 0.01, "entropy": 0.25}
#: Classes on each side from which the slope of entropy over length is taken.
TREND = 2
#: First code point of the ranges by which a text's script is told (fixed values).
SCRIPTS = [(0x41, "Latn"), (0x370, "Grek"), (0x400, "Cyrl"), (0x530, "Armn"), (0x590, "Hebr"), (0x600, "Arab"), (0x900, "Deva"), (0x980, "Indc"), (0xE00, "Thai"),
           (0xE80, "Othr"), (0x10A0, "Geor"), (0x1100, "Hang"), (0x1200, "Othr"), (0x1E00, "Latn"), (0x1F00, "Grek"), (0x2000, "Othr"), (0x3040, "Kana"), (0x3100, "Othr"),
           (0x3400, "Hani"), (0xA000, "Othr"), (0xAC00, "Hang"), (0xD7B0, "Othr"), (0xF900, "Hani"), (0xFB00, "Othr"), (0x20000, "Hani"), (0x30000, "Othr")]
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index("Othr")] + [NAMES.index(n) for _, n in SCRIPTS])


class Vocabularies:
    """Token counts and piece ids of words under the two vocabularies, remembered by word."""

    def __init__(self, piece_path: str, byte_path: str, pattern: str):
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        size = self.piece.vocab_size()
        if any("▁" in self.piece.id_to_piece(i).lstrip("▁") for i in range(size)):
            raise ValueError(f"{piece_path}: a piece spans white space")
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(size)])
        with open(byte_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.n_byte, self.fallback = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def index(self, codes: np.ndarray, word) -> np.ndarray:
        """Numbers of the words with these (distinct) hashes; word(i) gives the i-th one's bytes."""
        new = [i for i, c in enumerate(codes.tolist()) if c not in self.known]
        if new and len(self.known) + len(new) > MEMORY_WORDS:
            self.forget()
            new = list(range(len(codes)))
        if new:
            texts = [word(i).decode("utf-8", "replace") for i in new]
            ids = self.piece.encode(texts, num_threads=1)
            sizes = np.array([len(x) for x in ids], np.int64)
            flat = np.array([t for x in ids for t in x], np.int32)
            self.n_byte = np.append(self.n_byte, [len(self.bytes.encode_ordinary(" " + t)) for t in texts])
            self.fallback = np.append(self.fallback, np.add.reduceat(self.is_byte[flat].astype(np.int32), np.cumsum(sizes) - sizes))
            self.flat = np.append(self.flat, flat)
            self.at = np.append(self.at, self.at[-1] + np.cumsum(sizes))
            at = len(self.known)
            self.known.update((int(codes[i]), at + k) for k, i in enumerate(new))
        return np.fromiter((self.known[c] for c in codes.tolist()), np.int64, len(codes))


_loaded: dict[tuple, Vocabularies] = {}


def vocabularies(*key: str) -> Vocabularies:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabularies(*key)
    return _loaded[key]


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of values[edges[i]:edges[i + 1]] for each i."""
    return np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])[edges])


def repeated_words(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row, the words inside windows of REPEAT_WORDS words that the row has twice or more."""
    n = np.maximum(0, np.diff(first) - (REPEAT_WORDS - 1))
    row = rows_of(n)
    at = first[:-1][row] + ranges(n)
    depth = np.zeros(len(codes) + 1, np.int64)
    if len(at):
        h = shingle_hash(codes, REPEAT_WORDS)[at]
        order = np.lexsort((h, row))
        same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        a, b = at[order][:-1][same], at[order][1:][same]
        for j in range(REPEAT_WORDS):  # equal hashes are told from equal windows
            if not np.array_equal(codes[a + j], codes[b + j]):
                order = np.lexsort([codes[at + k] for k in range(REPEAT_WORDS)] + [row])
                same = (row[order][1:] == row[order][:-1]) & np.all([codes[at + k][order][1:] == codes[at + k][order][:-1] for k in range(REPEAT_WORDS)], axis=0)
                break
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hits = at[order][twice]
        depth[hits] += 1
        np.add.at(depth, hits + REPEAT_WORDS, -1)
    return sums(np.cumsum(depth)[:-1] > 0, first)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def scripts(buf: np.ndarray, edges: np.ndarray) -> list[str]:
    """The script with the most letters in each row (ties: first by name; no letter: Othr)."""
    b = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int32)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    c, x, y, z = b[lead], b[lead + 1] & 63, b[lead + 2] & 63, b[lead + 3] & 63
    code = np.select([c < 0x80, c < 0xE0, c < 0xF0], [c, (c & 31) << 6 | x, (c & 15) << 12 | x << 6 | y], (c & 7) << 18 | x << 12 | y << 6 | z)
    letter = ~((code < 0x41) | (code > 0x5A) & (code < 0x61) | (code > 0x7A) & (code < 0xC0))
    row = np.searchsorted(edges, lead[letter], "right") - 1
    kind = SCRIPT_OF[np.searchsorted(STARTS, code[letter], "right")]
    counts = np.bincount(row * len(NAMES) + kind, minlength=(len(edges) - 1) * len(NAMES)).reshape(-1, len(NAMES))
    best = np.where(counts.sum(1) > 0, counts.argmax(1), NAMES.index("Othr"))
    return [NAMES[i] for i in best]


def measure(docs: DataFrame, piece_path: str, byte_path: str, pattern: str, carry: list[str] | None = None) -> DataFrame:
    """row, the plain counts, the measures (null without a word), n_tokens and script of every text."""

    def make():
        voc = vocabularies(piece_path, byte_path, pattern)
        vocabulary_bits = U64(20)

        def work(texts: pa.Array) -> list[pa.Array]:
            buf, offsets = string_buffers(texts)
            raw = buf.tobytes()
            starts, ends, first = word_spans(buf, offsets)
            codes = word_hash(buf, starts, ends)
            n_words = np.diff(first)
            chars = sums(((buf & 0xC0) != 0x80) & ~SPACE[buf], offsets)
            distinct, at, of = np.unique(codes, return_index=True, return_inverse=True)
            index = voc.index(distinct, lambda i: raw[starts[at[i]]:ends[at[i]]])[of]
            size = voc.at[index + 1] - voc.at[index]
            n_tokens, n_byte, n_fallback = sums(size, first), sums(voc.n_byte[index], first), sums(voc.fallback[index], first)
            ids = voc.flat[np.repeat(voc.at[index], size) + ranges(size)]
            pairs, counts = np.unique(rows_of(n_tokens).astype(U64) << vocabulary_bits | ids.astype(U64), return_counts=True)
            row = (pairs >> vocabulary_bits).astype(np.int64)
            total = np.maximum(n_tokens, 1)
            share = counts / total[row]
            entropy = np.bincount(row, -share * np.log2(share), len(n_words))
            empty = n_tokens == 0
            lines = [repeated_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            return [pa.array(n_words), pa.array(chars), pa.array(sums(SYMBOLS[buf], offsets)), pa.array(lines, pa.int64()), pa.array(repeated_words(codes, first)),
                    pa.array(n_tokens), pa.array(chars / total, mask=empty), pa.array(chars / np.maximum(n_byte, 1), mask=empty), pa.array(n_fallback / total, mask=empty),
                    pa.array(entropy, mask=empty), pa.array(scripts(buf, offsets), pa.string())]

        return work

    return scan(docs, make, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
                            "piece_chars double, byte_chars double, fallback double, entropy double, script string", carry)


def bands(rows: DataFrame, least: int, fence: float) -> DataFrame:
    """low and high of each measure for each group, script and size class of `rows`, from counts over bins of those
    that pass the plain rules. A band takes the fewest neighbouring classes that hold `least` documents: of the group;
    else of the script; else of the corpus (all of it if that is not enough). Entropy grows with length, so that of
    another class is moved along the corpus' slope around the class."""
    passing = rows.where(~F.col("base_failed"))
    cell = ["group", "script", "size_class"]
    scope = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), name.alias("name")) for k, name in enumerate((F.col("group"), F.col("script"), F.lit("")))])).alias("scope")
    long = passing.select(*cell, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) * BINS).alias("bin"), F.lit(FLOOR[m]).alias("floor")) for m in MEASURES])).alias("x"))
    counts = materialize(long.groupBy(*cell, "x.measure", "x.floor", "x.bin").agg(F.count("*").alias("n")))
    held = counts.select(scope, F.col("size_class").alias("other"), "measure", "floor", "bin", "n").groupBy("scope", "other", "measure", "floor", "bin").agg(F.sum("n").alias("n"))
    cells = rows.select(*cell).distinct().select(*cell, scope)
    sizes = held.where(F.col("measure") == MEASURES[0]).groupBy("scope", "other").agg(F.sum("n").alias("n"))
    away = F.abs(F.col("other") - F.col("size_class"))
    near = cells.select("scope", "size_class").distinct().join(sizes, "scope").groupBy("scope", "size_class", away.alias("away")).agg(F.sum("n").alias("n"))
    near = near.withColumn("n", F.sum("n").over(Window.partitionBy("scope", "size_class").orderBy("away")))
    reach = F.min(F.when(F.col("n") >= least, F.col("away")))
    whole = F.when(F.col("scope.rank") == 2, F.max("away"))
    reaches = near.groupBy("scope", "size_class").agg(F.coalesce(reach, whole).alias("reach")).where("reach is not null")
    chosen = materialize(cells.join(reaches, ["scope", "size_class"]).groupBy(*cell).agg(F.min(F.struct("scope", "reach")).alias("of")).select(*cell, "of.scope", "of.reach"))
    joined = chosen.select("scope", "size_class", "reach").distinct().join(held, "scope").where(away <= F.col("reach"))
    x, y = F.log2("n_words"), F.col("entropy")
    sums = materialize(passing.groupBy(F.col("size_class").alias("other")).agg(F.count("*").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy")))
    total = {c: F.sum(c) for c in ("n", "x", "y", "xx", "xy")}
    spread = total["n"] * total["xx"] - total["x"] * total["x"]
    steep = F.when(spread > 0, (total["n"] * total["xy"] - total["x"] * total["y"]) / spread)
    slopes = cells.select("size_class").distinct().join(sums, away <= TREND).groupBy("size_class").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(steep, F.lit(0.0)))).alias("slope"))  # twice the length: 0 to 1 bit
    moved = F.when(F.col("measure") == "entropy", F.round(F.coalesce("slope", F.lit(0.0)) * (F.col("size_class") - F.col("other")) * BINS)).otherwise(0).cast("long")
    joined = joined.join(slopes, "size_class", "left").withColumn("bin", F.col("bin") + moved)
    bins = joined.groupBy("scope", "size_class", "measure", "floor", "bin").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("scope", "size_class", "measure")
    running = bins.withColumn("below", F.sum("n").over(of.orderBy("bin"))).withColumn("total", F.sum("n").over(of))
    quartile = lambda q: F.min(F.when(F.col("below") >= q * F.col("total"), F.col("bin"))) / BINS
    quartiles = running.groupBy("scope", "size_class", "measure", "floor").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    width = fence * F.greatest(F.col("q3") - F.col("q1"), "floor")
    side = quartiles.select("scope", "size_class", "measure", F.struct((F.col("q1") - width).alias("low"), (F.col("q3") + width + 1 / BINS).alias("high")).alias("band"))
    wide = side.groupBy("scope", "size_class").agg(*[F.first(F.when(F.col("measure") == m, F.col("band")), ignorenulls=True).alias(f"{m}_band") for m in MEASURES])
    return chosen.join(wide, ["scope", "size_class"]).drop("scope", "reach")


def judge(docs: DataFrame, piece_path: str, byte_path: str, pattern: str, language: str = "lang", least: int = 30, fence: float = 2.0, carry: list[str] | None = None) -> DataFrame:
    """What `measure` gives, base_failed, fertile (inside all bands) and kept."""
    carry = docs.columns if carry is None else carry
    source = docs.select(*dict.fromkeys([*carry, "text", language]))
    rows = materialize(measure(source, piece_path, byte_path, pattern, list(dict.fromkeys([*carry, language]))))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = (rows.withColumn("base_failed", failed).withColumn("group", F.coalesce(F.col(f"row.{language}").cast("string"), "script"))
            .withColumn("size_class", F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")))
    limits = bands(rows, least, fence)
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"{m}_band.low"), F.col(f"{m}_band.high")), F.lit(True))
    judged = rows.join(limits, ["group", "script", "size_class"], "left").withColumn("fertile", inside)
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("fertile")).drop(*[f"{m}_band" for m in MEASURES], "group", "size_class")
