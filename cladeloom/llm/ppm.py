"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of up to `ORDER` bytes with counts. A byte that a context has
seen n times among N (with D distinct bytes) costs -log2(n / (N + D)); otherwise the escape costs
-log2(D / (N + D)) and the next shorter context is asked, bytes that the longer one has seen being
excluded (the shorter one's distribution is renormalised), down to the uniform distribution over 256 bytes. The statistics are
frozen after training, so the cost of a byte after its context is one number per language. These numbers
are tabled by k-gram; a k-gram that no language has seen adds the escapes of its context and falls to the
table one shorter. A text's code length is the sum over its bytes; the language with the shortest wins.

Training takes at most `train_docs` documents for each language (those with the smallest hash of
doc_id and text), a documented bound on the model; every text is scored whole.

Defined results: null texts, texts without a letter and all texts when nothing could be learned get `und`
and score 0; ties go to the first language by name; repeated rows are scored each; an empty table gives an
empty result; other columns do not matter.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeloom.llm.text import column, scan, slices, string_buffers

ORDER = 3
#: Bytes of texts scored at once.
PIECE = 1 << 20


def grams(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte, itself (low byte) and the `order` bytes before it as one number, and how many of
    these lie in its own text; a text begins as if after line feeds."""
    n = len(buf)
    code = buf.astype(np.uint32)
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    for j in range(1, order + 1):
        before = np.full(n, 10, np.uint32)
        before[j:] = buf[:n - j]
        before[place < j] = 10
        code |= before << np.uint32(8 * j)
    return code, place


class Tree:
    """Costs in bits of one language's contexts: `cost[k]` for seen (k + 1)-grams, `escape[k]` for seen contexts of k bytes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """keys: distinct grams of ORDER + 1 bytes."""
        self.gram, self.cost, self.context, self.escape = [], [], [], []
        for k in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (k + 1)) - 1) if k < 3 else np.uint32(0xFFFFFFFF)
            gram, at = np.unique(keys & mask, return_inverse=True)
            n = np.bincount(at, counts)
            context, of = np.unique(gram >> np.uint32(8), return_inverse=True)  # a gram's last byte is its lowest
            # context k bytes long: the bits above the last byte
            total, distinct = np.bincount(of, n), np.bincount(of)
            shorter = 1 / 256 if k == 0 else 2.0 ** -self.bits(gram, k - 1)
            left = 1 - np.minimum(np.bincount(of, np.broadcast_to(shorter, len(gram))), 1 - 1e-9)
            self.gram.append(gram)
            self.cost.append(-np.log2(n / (total + distinct)[of]))
            self.context.append(context)
            self.escape.append(-np.log2(distinct / (total + distinct) / left))

    def bits(self, gram: np.ndarray, k: int) -> np.ndarray:
        """Cost of the last byte of each gram given the k bytes before it."""
        if k < 0:
            return np.full(len(gram), 8.0)
        gram = gram & np.uint32((1 << 8 * (k + 1)) - 1) if k < 3 else gram
        at = np.minimum(np.searchsorted(self.gram[k], gram), len(self.gram[k]) - 1)
        seen = self.gram[k][at] == gram
        out = np.empty(len(gram))
        out[seen] = self.cost[k][at[seen]]
        rest = gram[~seen]
        if len(rest):
            c = rest >> np.uint32(8)
            at = np.minimum(np.searchsorted(self.context[k], c), len(self.context[k]) - 1)
            out[~seen] = np.where(self.context[k][at] == c, self.escape[k][at], 0.0) + self.bits(rest, k - 1)
        return out


class Table:
    """Rows of costs (one column per language) by key, found in one or a few probes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint32)
        self.row = np.full(1 << self.bits, -1, np.int32)
        self.values = values.astype(np.float32)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        while len(left):  # linear probing for all keys together: one of those that want a free slot gets it
            free = self.row[slot] < 0
            take, first = np.unique(slot[free], return_index=True)
            won = left[free][first]
            self.row[take], self.keys[take] = won, keys[won]
            lost = self.row[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.row) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435769) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is missing."""
        slot = self.slot(keys)
        row = self.row[slot]
        other = np.flatnonzero((row >= 0) & (self.keys[slot] != keys))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.row) - 1)
            row[other] = self.row[slot[other]]
            other = other[(row[other] >= 0) & (self.keys[slot[other]] != keys[other])]
        return row


class Model:
    """The trees of all languages as shared tables."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.languages = languages
        trees = [Tree(*c) for c in counts]
        self.grams, self.contexts = [], []
        for k in range(ORDER + 1):
            keys = np.unique(np.concatenate([t.gram[k] for t in trees]))
            self.grams.append(Table(keys, np.stack([t.bits(keys, k) for t in trees], 1)))
            keys = np.unique(np.concatenate([t.context[k] for t in trees]))
            cost = np.zeros((len(keys), len(trees)))
            for i, t in enumerate(trees):
                cost[np.searchsorted(keys, t.context[k]), i] = t.escape[k]
            self.contexts.append(Table(keys, cost))

    def lengths(self, code: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Code length in bits per row (given for each gram) and language."""
        out = np.zeros((rows, len(self.languages)))

        def add(row: np.ndarray, found: np.ndarray, table: Table) -> None:
            np.add(out, np.stack([np.bincount(row, table.values[found, i], rows) for i in range(len(self.languages))], 1), out=out)

        for k in range(ORDER, -1, -1):
            found = self.grams[k].find(code)
            hit = found >= 0
            add(row[hit], found[hit], self.grams[k])
            code, row = code[~hit], row[~hit]
            context = self.contexts[k].find(code >> np.uint32(8))
            known = context >= 0
            add(row[known], context[known], self.contexts[k])
            if k:
                code = code & np.uint32((1 << 8 * k) - 1)
        out += 8.0 * np.bincount(row, minlength=rows)[:, None]
        return out


def count_grams(batches):
    """Distinct grams with counts of each language in a task's rows."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for part in slices(batches):
        buf, offsets = string_buffers(column(part, "text"))
        code, _ = grams(buf, offsets, ORDER)
        row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
        langs = np.array(column(part, "lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            keys, n = np.unique(code[(langs == lang)[row]], return_counts=True)
            if lang in total:
                a, b = total[lang]
                keys, at = np.unique(np.concatenate([a, keys]), return_inverse=True)
                n = np.bincount(at, np.concatenate([b, n]).astype(float)).astype(np.int64)
            total[lang] = keys, n
    for lang, (keys, n) in sorted(total.items()):
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def sample(learn: DataFrame, train_docs: int) -> DataFrame:
    """At most train_docs rows (lang, text) of each language, those with the smallest hash: a cut of the
    hash range by counts first, so that only about twice as many rows are ordered."""
    rows = learn.select("lang", "text", F.xxhash64("doc_id", "text").alias("rank"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), 2.0 * train_docs / F.col("n"))
    near = rows.join(F.broadcast(counts), "lang").where((F.col("rank") / 2.0 ** 64 + 0.5) < share)
    order = Window.partitionBy("lang").orderBy("rank", "text")
    return near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= train_docs).select("lang", "text")


def train(learn: DataFrame, train_docs: int = 3000) -> Model | None:
    """A model from rows with lang and text; None without any text. Its size is bounded by the sample."""
    counts = (sample(learn.where(F.col("lang").isNotNull() & (F.length("text") > 0)), train_docs).mapInArrow(count_grams, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow())
    if not counts.num_rows:
        return None
    lang = np.array(counts["lang"].to_pylist(), object)
    gram, n = counts["gram"].to_numpy().astype(np.uint32), counts["n"].to_numpy()
    names = sorted(set(lang.tolist()))
    order = np.argsort(gram, kind="stable")
    return Model(names, [(gram[o], n[o]) for o in (order[lang[order] == x] for x in names)])


def predict(docs: DataFrame, model: Model | None, carry: list[str] | None = None) -> DataFrame:
    """row, lang_pred, score (posterior of the winner under equal priors) and bits_per_byte of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = len(texts)
            if model is None:
                return [pa.array(["und"] * rows), pa.array(np.zeros(rows)), pa.nulls(rows, pa.float64())]
            total = np.zeros((rows, len(model.languages)))
            buf, offsets = string_buffers(texts)
            code, _ = grams(buf, offsets, ORDER)
            row = np.repeat(np.arange(rows), np.diff(offsets))
            for at in range(0, len(code), PIECE):
                total += model.lengths(code[at:at + PIECE], row[at:at + PIECE], rows)
            best = total.argmin(1)
            least = total[np.arange(rows), best]
            odds = 2.0 ** np.maximum(least[:, None] - total, -1000)
            empty = np.diff(offsets) == 0
            return [pa.array(np.array(model.languages, object)[best], pa.string()), pa.array(1 / odds.sum(1)), pa.array(least / np.maximum(np.diff(offsets), 1), mask=empty)]

        return work

    out = scan(docs.select("*", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_has_letter")), make,
               "lang_pred string, score double, bits_per_byte double", [*(docs.columns if carry is None else carry), "_has_letter"])
    known: Column = F.col("row._has_letter")
    return out.select(F.col("row").dropFields("_has_letter").alias("row"), F.when(known, F.col("lang_pred")).otherwise("und").alias("lang_pred"),
                      F.when(known, F.col("score")).otherwise(0.0).alias("score"), "bits_per_byte")
