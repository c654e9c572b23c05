"""Toxicity by noisy-channel deobfuscation.

A written word is seen as an intended word that went through a channel which may write a letter as a
look-alike sign (leetspeak, or `*` for any letter), put signs or blanks between letters, or repeat
letters. The readings of a word form a lattice of characters; Viterbi decoding finds the cheapest path
under a character trigram model of the whole corpus and the channel's costs. A word of plain letters
without a doubled one has one path only and is read as it stands. Runs of three or more single characters (letters,
look-alikes, digits, separators) are decoded as one string; longer pieces of a word ('mo ron') are not joined.

Restored words are then scored: the share of toxic documents among the labelled ones that hold the word,
or a beginning of it, shrunk towards the base rate. A logistic model on the strongest words of a document
gives its score. Labelled documents are a bounded sample (`per_class` of each class); a sampled document's
own label is left out when its words are scored for fitting. Character counts cover all documents.

Defined results: null, empty and wordless texts have no evidence and get the model's score for that (0
without labelled documents of both classes); repeated rows are scored each; empty tables work; other
columns do not matter.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeloom.llm.labels import labelled_sample
from cladeloom.llm.text import column, scan, slices, string_buffers, tidy, word_hash, word_spans

#: Symbols of the character model: 26 letters, other letters, blank, digit, other sign.
OTHER, BLANK, DIGIT, SIGN, SIZE = 26, 27, 28, 29, 30
SYMBOL = np.full(256, SIGN, np.int8)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(26)
SYMBOL[48:58] = DIGIT
SYMBOL[[9, 10, 11, 12, 13, 32]] = BLANK
SYMBOL[0xC0:] = OTHER  # the first byte of a longer character; the others are left out
#: Look-alikes (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
        "<": "c", "{": "c", "[": "c", "€": "e", "£": "l", "¡": "i", "µ": "u"}
#: Costs in nats: a look-alike, a hidden letter, a sign or blank put in, a look-alike or star put in, a letter written once more,
#: once more again, and a blank between single letters that was meant.
LOOK, HIDDEN, PUT_IN, PUT_IN_LOOK, TWICE, AGAIN, KEPT_BLANK = 1.0, 1.5, 0.5, 4.0, 4.0, 0.3, 3.0
EDGE = re.compile(r"^(?:[\"'`.,;:?)\]}>\-_/\\~=&#%]|([^\w\s])\1\1+)+|(?:[\"'`.,;:?!(\[{\-_/\\~=&#%*|]|([^\w\s])\2\2+)+$")
DOUBLE = re.compile(r"([^\W\d_])\1")
WORDS = re.compile(r"[^\W_]+")
LIKE_LETTER = re.compile("[^\\W\\d_]|[" + re.escape("".join(LEET)) + "]")
LIKE_WORD = re.compile("[^\\W\\d_]|[" + re.escape("".join(c for c in LEET if not c.isdigit())) + "]")
LETTER = {chr(97 + i): i for i in range(26)}
RUN = re.compile(r"(.)\1*", re.DOTALL)
MEMORY, MEMORY_RESTORED = 700_000, 300_000
#: Readings of a word of letters that are priced one by one.
MAX_READINGS = 64
BEGINNINGS = (4, 5, 6, 7)
#: Characters of a word by which it is known as a whole.
WHOLE = 64
#: Shrinkage (documents at the base rate added to each word) and least toxic documents of a word.
SHRINK, SUPPORT = 4.0, 3
PAIR, TRIPLE_CODES = SIZE * SIZE, SIZE ** 3


def symbols(text: str) -> np.ndarray:
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    return SYMBOL[raw[(raw & 0xC0) != 0x80]].astype(np.int64)


@tidy
def count_characters(batches: Iterable[pa.RecordBatch]):
    total = np.zeros(TRIPLE_CODES, np.int64)
    for part in slices(batches):
        buf, _ = string_buffers(column(part, "text"))
        s = SYMBOL[buf[(buf & 0xC0) != 0x80]].astype(np.int32)
        total += np.bincount(s[:-2] * PAIR + s[1:-1] * SIZE + s[2:], minlength=TRIPLE_CODES) if len(s) > 2 else 0
    code = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code])], ["code", "n"])


def character_costs(docs: DataFrame) -> np.ndarray:
    """-log P(c | a, b) as an array [a, b, c], from all documents, interpolated with the shorter contexts."""
    rows = docs.select("text").mapInArrow(count_characters, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(TRIPLE_CODES)
    for r in rows:
        n[r["code"]] = r["n"]
    n = n.reshape(SIZE, SIZE, SIZE)
    uni = (n.sum((0, 1)) + 1) / (n.sum() + SIZE)
    two = n.sum(0)
    bi = (two + 20 * uni) / (two.sum(1, keepdims=True) + 20)
    tri = (n + 20 * bi[None]) / (n.sum(2, keepdims=True) + 20)
    return -np.log(tri)


def readings(text: str) -> list[list[tuple[int, str, float]]]:
    """Lattice: for every character the ways to read it, as (symbol, letter, cost); symbol -1 reads it as nothing."""
    out, before = [], ""
    for i, c in enumerate(text):
        own = int(symbols(c)[0])
        ways = [(own, c, KEPT_BLANK if own == BLANK else 0.0)]
        ways += [(ord(x) - 97, x, LOOK) for x in LEET.get(c, "")]
        if c == "*":
            ways += [(k, chr(97 + k), HIDDEN + 3.2) for k in range(26)]  # any of 26
        if own in (BLANK, SIGN):
            ways.append((-1, "", PUT_IN_LOOK if c == "*" or c in LEET else PUT_IN))
        elif c == before:
            ways.append((-1, "", AGAIN if i > 1 and text[i - 2] == c else TWICE))
        before = c
        out.append(ways)
    return out


def decode(texts: list[str], costs: np.ndarray) -> list[str]:
    """The cheapest reading of each text, blanks around it being certain. All texts of a length class are
    decoded together; the state is the pair of symbols read last."""
    out = [""] * len(texts)
    classes: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        classes.setdefault(len(t) if len(t) < 32 else 1 << len(t).bit_length(), []).append(i)
    for members in classes.values():
        room = max(1, 40_000 // max(len(texts[i]) for i in members))
        for k in range(0, len(members), min(128, room)):
            group = members[k:k + min(128, room)]
            for i, text in zip(group, _decode([texts[i] for i in group], costs)):
                out[i] = text
    return out


def _decode(texts: list[str], costs: np.ndarray) -> list[str]:
    n, lattices = len(texts), [readings(t) for t in texts]
    state = np.full((n, SIZE, SIZE), np.inf, np.float32)
    state[:, BLANK, BLANK] = 0
    costs = costs.astype(np.float32)
    back = []
    for at in range(max(map(len, texts))):
        ways: dict[int, tuple[list[int], list[float]]] = {}
        for i, lattice in enumerate(lattices):
            for s, _, cost in lattice[at] if at < len(lattice) else [(-1, "", 0.0)]:
                rows = ways.setdefault(s, ([], []))
                rows[0].append(i)
                rows[1].append(cost)
        new = np.full_like(state, np.inf)
        come = np.full(state.shape, -2, np.int8)  # the symbol that left the pair, or -1: nothing was read
        for s, (rows, cost) in ways.items():
            rows, cost = np.array(rows), np.array(cost, np.float32)
            if s < 0:
                value = state[rows] + cost[:, None, None]
                better = value < new[rows]
                new[rows] = np.where(better, value, new[rows])
                come[rows] = np.where(better, -1, come[rows])
            else:
                value = state[rows] + costs[None, :, :, s]
                best = value.argmin(1)
                value = np.take_along_axis(value, best[:, None], 1)[:, 0] + cost[:, None]
                better = value < new[rows, :, s]
                new[rows, :, s] = np.where(better, value, new[rows, :, s])
                come[rows, :, s] = np.where(better, best, come[rows, :, s])
        state = new
        back.append(come)
    end = (state + costs[None, :, :, BLANK]).reshape(n, -1).argmin(1)
    out = []
    for i, lattice in enumerate(lattices):
        a, b = divmod(int(end[i]), SIZE)
        letters = []
        for at in range(len(back) - 1, -1, -1):
            c = int(back[at][i, a, b])
            if c == -1:
                continue
            letters.append(next(x for s, x, _ in sorted(lattice[at], key=lambda w: w[2]) if s == b))
            a, b = c, a
        out.append("".join(reversed(letters)))
    return out


def plain_readings(word: str) -> list[tuple[float, str]] | None:
    """(cost of the letters left out, reading) of a word of letters: of each run of one letter any number may be left
    out, those far from its beginning first, so the lattice's best reading is among these. None if there are too many."""
    twice = [m.end() for m in DOUBLE.finditer(word)]
    if len(twice) == 1 and word[twice[0]:twice[0] + 1] != word[twice[0] - 1]:  # one letter, twice: nearly all words
        return [(0.0, word), (TWICE, word[:twice[0] - 1] + word[twice[0]:])]
    runs = [(m.group(), m.end() - m.start()) for m in RUN.finditer(word)]
    if math.prod(n for _, n in runs) > MAX_READINGS:
        return None
    out = [(0.0, "")]
    for run, n in runs:
        # leaving out k of the n - 1 further letters: all but the second cost AGAIN, the second TWICE
        ways = [(k * AGAIN if k < n - 1 else (n - 2) * AGAIN + TWICE, run[:n - k]) for k in range(n)] if n > 1 else [(0.0, run)]
        out = [(c + w, x + y) for c, x in out for w, y in ways]
    return out


def decode_plain(words: list[str], costs: list[float]) -> list[str | None]:
    """The cheapest reading of words of letters, each reading priced as a whole; None where `decode` has to do it."""
    out: list[str | None] = []
    for word in words:
        ways, best = plain_readings(word), None
        for cost, text in ways or ():
            pair = BLANK * SIZE + BLANK
            for letter in text:
                code = pair * SIZE + LETTER.get(letter, OTHER)
                cost += costs[code]
                pair = code % PAIR
            cost += costs[pair * SIZE + BLANK]
            if best is None or cost < best[0]:
                best = cost, text
        out.append(best and best[1])
    return out


def core_of(word: str) -> str:
    """Lower case, without the signs around it."""
    word = word.lower()
    return word if word.isalpha() else EDGE.sub("", word)


def needs_decoding(core: str) -> bool:
    return (DOUBLE if core.isalpha() else LIKE_LETTER).search(core) is not None


def features(word: str) -> list[str]:
    """A restored word (marked by its end) and its beginnings."""
    return [word[:WHOLE] + "\n", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


class Reader:
    """Restored words of texts, remembered by the written word."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.flat: list[float] = costs.astype(np.float64).ravel().tolist()
        self.known: dict[int, object] = {}
        self.restored: dict[str, str] = {}

    def read(self, texts: list[str]) -> list[list[str]]:
        """Restored words of each written word or run of letters."""
        return self.restore([core_of(t).strip() for t in texts])

    def restore(self, cores: list[str]) -> list[list[str]]:
        """Restored words of each core."""
        hard = [i for i, c in enumerate(cores) if needs_decoding(c)]
        if len(self.restored) > MEMORY_RESTORED:
            self.restored.clear()
        new = list({cores[i] for i in hard}.difference(self.restored))
        letters = [c for c in new if c.isalpha()]
        self.restored.update((c, x) for c, x in zip(letters, decode_plain(letters, self.flat)) if x is not None)
        new = [c for c in new if c not in self.restored]
        self.restored.update(zip(new, decode(new, self.costs)))
        read = list(cores)
        for i in hard:
            read[i] = self.restored[cores[i]]
        return [[c] if c.isalpha() else WORDS.findall(c) for c in read]

    def text_words(self, texts: pa.Array, value) -> tuple[list, np.ndarray, np.ndarray, list[tuple[int, object]]]:
        """`value` of the restored words of each distinct written word; which of these each word of the
        texts is; the first word of each row; and (row, value) for runs of three or more single characters."""
        buf, offsets = string_buffers(texts)
        raw = buf.tobytes()
        starts, ends, first = word_spans(buf, offsets)
        codes = word_hash(buf, starts, ends)
        distinct, at, of = np.unique(codes, return_index=True, return_inverse=True)
        known = self.known
        new = [i for i, c in enumerate(distinct.tolist()) if c not in known]
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = list(range(len(distinct)))
        if new:
            written = [raw[starts[at[i]]:ends[at[i]]].decode("utf-8", "replace") for i in new]
            # a word of letters also counts as it is written, so that a wrong restoration hides nothing
            cores = [core_of(w).strip() for w in written]
            known.update(zip(distinct[new].tolist(), (value([*words, c] if c.isalpha() and c not in words else words) for words, c in zip(self.restore(cores), cores))))
        values = [known[c] for c in distinct.tolist()]
        rows = np.searchsorted(first, np.arange(len(starts)), "right") - 1
        lead = buf[starts] if len(starts) else np.zeros(0, np.uint8)
        single = ends - starts == 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        runs = []
        if single.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2]):
                cut = first[np.searchsorted(first, a, "right"):np.searchsorted(first, b, "left")]
                for x, y in zip([a, *cut], [*cut, b]):
                    if y - x >= 3:
                        runs.append((int(rows[x]), raw[starts[x]:ends[y - 1]].decode("utf-8", "replace")))
        runs = [(row, re.sub(r"\s+", " ", r)) for row, r in runs if LIKE_WORD.search(r)]
        strings = list({r for _, r in runs})
        read = dict(zip(strings, (value(words) for words in self.read(strings))))
        return values, of, first, [(row, read[r]) for row, r in runs]


def document_words(docs: DataFrame, costs: np.ndarray) -> DataFrame:
    """label, feature and n: how many sampled documents of the label hold the feature."""
    shared = docs.sparkSession.sparkContext.broadcast(costs)

    @tidy
    def run(batches):
        reader = Reader(shared.value)
        counts: dict[tuple[int, str], int] = {}
        for part in slices(batches):
            labels = column(part, "label").to_pylist()
            values, of, first, runs = reader.text_words(column(part, "text"), lambda words: [f for w in words if len(w) > 1 for f in features(w)])
            extra: dict[int, set[str]] = {}
            for row, v in runs:
                extra.setdefault(row, set()).update(v)
            for row, label in enumerate(labels):
                seen = extra.get(row, set()).union(*(values[i] for i in set(of[first[row]:first[row + 1]].tolist())))
                for f in seen:
                    counts[label, f] = counts.get((label, f), 0) + 1
            if len(counts) > 1_000_000:
                yield _counts(counts)
                counts.clear()
        yield _counts(counts)

    return docs.select("text", "label").mapInArrow(run, "label int, feature string, n long")


def _counts(counts: dict[tuple[int, str], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["label", "feature", "n"])


class Scorer:
    """Evidence of a document: strongest and second strongest word, and how many words speak for label 1."""

    def __init__(self, costs: np.ndarray, lexicon: dict[str, tuple[int, int]], base: float):
        self.costs, self.lexicon, self.base = costs, lexicon, base
        self.nothing = self.logit(0, 0)
        self.kept: Reader | None = None

    def reader(self) -> Reader:
        """The worker's reader, kept between tasks."""
        if self.kept is None:
            self.kept = Reader(self.costs)
        return self.kept

    def logit(self, toxic: int, clean: int) -> float:
        p = (toxic + SHRINK * self.base) / (toxic + clean + SHRINK)
        return float(np.log(p / (1 - p)))

    def weight(self, words: list[str], label: int | None = None) -> float:
        """The strongest feature's log odds; a labelled document's own count is left out."""
        best, find = self.nothing, self.lexicon.get
        for w in words:
            if len(w) > 1:
                for f in features(w):
                    if n := find(f):
                        best = max(best, self.logit(n[0] - (label == 1), n[1] - (label == 0)))
        return best

    def evidence(self, reader: Reader, texts: pa.Array, value) -> np.ndarray:
        values, of, first, runs = reader.text_words(texts, value)
        weights = np.array(values, float)[of] if len(of) else np.zeros(0)
        out = np.tile([self.nothing, self.nothing, 0.0], (len(texts), 1))
        extra: dict[int, list[float]] = {}
        for row, v in runs:
            extra.setdefault(row, []).append(v)
        strong = np.concatenate([[0], np.cumsum(weights > 0)])
        for row in range(len(texts)):
            own = weights[first[row]:first[row + 1]]
            if row in extra:
                own = np.append(own, extra[row])
            if len(own):
                top = np.partition(own, -2)[-2:] if len(own) > 1 else own
                out[row, :len(top)] = top[::-1]
                out[row, 2] = np.log1p(strong[first[row + 1]] - strong[first[row]] + sum(x > 0 for x in extra.get(row, ())))
        return np.nan_to_num(out)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the constant last, by Newton steps with a ridge penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 6000) -> tuple[Scorer, np.ndarray] | None:
    """Scorer and coefficients; None unless both classes have documents. The lexicon is bounded by the sample."""
    sample = labelled_sample(docs, labels, label, per_class)
    per_label = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(per_label) < 2:
        return None
    costs = character_costs(docs)
    base = per_label[1] / (per_label[0] + per_label[1])
    toxic, clean = (F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)) for k in (1, 0))
    counts = document_words(sample, costs).groupBy("feature").agg(toxic.alias("toxic"), clean.alias("clean")).where(F.col("toxic") >= SUPPORT)
    counts = counts.where((F.col("toxic") + SHRINK * base) / (F.col("toxic") + F.col("clean") + SHRINK) > base)
    table = counts.toArrow()
    lexicon = dict(zip(table["feature"].to_pylist(), zip(table["toxic"].to_pylist(), table["clean"].to_pylist())))
    scorer = Scorer(costs, lexicon, base)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @tidy
    def evidence(batches):
        scorer = shared.value
        reader = Reader(scorer.costs)
        for part in slices(batches):
            found = np.array(column(part, "label").to_pylist())
            texts = column(part, "text")
            for k in (0, 1):
                reader.known.clear()
                x = scorer.evidence(reader, texts.filter(pa.array(found == k)), lambda words: scorer.weight(words, k))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(x), pa.int32()), *(pa.array(x[:, j]) for j in range(3))], ["label", "a", "b", "c"])

    rows = np.array([tuple(r) for r in sample.select("text", "label").mapInArrow(evidence, "label int, a double, b double, c double").collect()])
    return scorer, fit_logistic(rows[:, 1:], rows[:, 0])


def score(docs: DataFrame, model: tuple[Scorer, np.ndarray] | None, carry: list[str] | None = None) -> DataFrame:
    """row and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        if shared.value is None:
            return lambda texts: [pa.array(np.zeros(len(texts)))]
        scorer, b = shared.value
        reader = scorer.reader()

        def work(texts: pa.Array) -> list[pa.Array]:
            z = scorer.evidence(reader, texts, scorer.weight) @ b[:-1] + b[-1]
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))]

        return work

    return scan(docs, make, "score double", carry)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents with a score below the threshold, with their own columns."""
    return score(docs, train(docs, labels)).where(F.col("score") < threshold).select("row.*")
