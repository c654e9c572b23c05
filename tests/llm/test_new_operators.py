"""Token counts by resynchronised chunks, conversation repair and hard negatives against plain versions."""
import hashlib
import heapq
import itertools
import math
import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cladeloom.llm import negatives, repair, resync
from cladeloom.llm.queries import QUERIES, VOCABULARY
from tests.llm import cases

FILES = [VOCABULARY, "byte_bpe_50k.json", "piece_bpe_32k.model"]
ATOMS = ["a", "hello", "World", " ", "  ", "\n", "'s", "don't", "<|endoftext|>", "<|", "|>", "!", "!!", "9", "é", "́", "日本語", "。", "が", "ﬁ", "😀", "İ", "Σ", "각", "\xa0", "\t", "x" * 40, "\x01"]


# 11

def whole_size(vocabulary, text):
    if isinstance(vocabulary, resync.PieceVocabulary):
        return len(vocabulary.pieces.encode(text))
    return len(vocabulary.tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("file", FILES)
def test_chunks_count_as_whole_texts(file):
    vocabulary, rng = resync.vocabulary_of(public_tokenizers.path(file)), random.Random(5)
    assert vocabulary.chunked
    for _ in range(300):
        atoms = rng.sample(ATOMS, rng.randint(1, len(ATOMS)))
        text = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 200)))
        chunk = rng.choice([16, 40, 64])
        whole = whole_size(vocabulary, text)
        assert vocabulary.sizes([text]) == [whole], text
        assert resync.chunked_size(text, vocabulary, chunk, rng.choice([1, 4, 16])) == whole, text
    for text in ("", "x" * 3000, " " * 500, "日本語" * 400, "<|endoftext|>" * 90, "a b " * 400):
        assert resync.chunked_size(text, vocabulary, 64, 8) == whole_size(vocabulary, text)


def test_token_counts(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    rows = cases.rows(cases.odd_texts())
    got = resync.count_tokens(spark.createDataFrame(rows, cases.SCHEMA), public_tokenizers.path(VOCABULARY), limit=100, chunk=256, overlap=32).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r["row"]["text"] or ""
        n = len(tokenizer.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 100)
    assert resync.count_tokens(spark.createDataFrame([], cases.SCHEMA), public_tokenizers.path(VOCABULARY)).count() == 0
    tiny = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    found = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op11_overlap_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert found == {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in tiny}


# 12

def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def plain_cheapest(signs):
    """Least (cost, audit) by a search over (rows done, state); audits of equal cost compare as ASCII."""
    start = (0, "", 0, repair.START)
    heap, done = [start], {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done[i, state] = cost, audit
        for role in "ua":
            if state in repair.STEP[role]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, repair.STEP[role][state]))
        if i < len(signs):
            k = signs[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if k not in repair.MUST_GO:
                extra = k.isupper()
                if state in repair.STEP.get(k.lower(), {}):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, repair.STEP[k.lower()][state]))
                for role in "ua":
                    if state in repair.STEP[role]:
                        heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, repair.STEP[role][state]))
    return min(done[len(signs), q] for q in repair.ACCEPTED if (len(signs), q) in done)


def all_splits(signs):
    """Cell by every split of every span."""
    cells = {(i, i + 1): repair.LEAVES[k] for i, k in enumerate(signs)}
    for width in range(2, len(signs) + 1):
        for i in range(len(signs) - width + 1):
            cell = {}
            for m in range(i + 1, i + width):
                for key, value in repair.join_cells(cells[i, m], cells[m, i + width]).items():
                    cell[key] = min(cell.get(key, value), value)
            cells[i, i + width] = cell
    return cells[0, len(signs)] if signs else repair.EMPTY


def test_cells_equal_every_split_and_a_search():
    kinds = repair.INITIALS + repair.INITIALS.upper() + repair.MUST_GO
    for n in range(3):
        for signs in itertools.product(kinds, repeat=n):
            assert repair.cheapest(repair.parse("".join(signs))) == plain_cheapest("".join(signs))
    rng = random.Random(7)
    for _ in range(120):
        signs = "".join(rng.choice(kinds) for _ in range(rng.randint(3, 22)))
        assert repair.parse(signs) == all_splits(signs)
        assert repair.cheapest(repair.parse(signs)) == plain_cheapest(signs)


def plain_report(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    faults, signs, seen = dict.fromkeys(repair.FAULTS, 0), "", set()
    for _, _, role, text in rows:
        body, i = text.strip(repair.SPACES), "sua".find(role[:1]) if role else -1
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        sign = repair.INITIALS[i]
        signs += repair.MUST_GO[i] if fault in ("blank", "duplicate") else sign.upper() if fault else sign
    turns = {r[1] for r in rows} - {None}
    cost, audit = plain_cheapest(signs)
    lines, k, state = [], 0, repair.START
    for e in audit:
        role, text = (None, "") if e == "I" else rows[k][2:]
        k += e != "I"
        if e == "D":
            continue
        initial = role[0] if e == "K" else "a" if state == repair.USER else "u"
        lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[initial], text))
        state = repair.STEP[initial][state]
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in repair.LEGAL for a, b in itertools.pairwise(initials))
    report = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
              hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return report, lines


def conversations():
    rng = random.Random(11)
    texts = ["yes.", "no", "why?", "", "  \t", None, "yes.", "well! ", "x" * 4000, "so. "]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(c if c else None, rng.choice([None, *range(9)]) if rng.random() < 0.3 else t, rng.choice(roles), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(900, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(700)] + [(901, 5, "user", "same.")] * 30
    return rows + [(1000 + i, 0, "user", "alone.") for i in range(60)]


def test_repair_reports_and_turns(spark, monkeypatch):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, kind string")
    damaged = plain_damage(rows)
    want = {c: plain_report([r for r in damaged if r[0] == c]) for c in {r[0] for r in rows}}
    got = {r[0]: tuple(r)[1:] for r in repair.repair(repair.damage(df)).collect()}
    assert got == {c: w[0] for c, w in want.items()}
    lines = repair.repair(repair.damage(df), turns=True).collect()
    for c, (_, expected) in want.items():
        assert [(r["role"], r["text"]) for r in sorted((r for r in lines if r["conv_id"] == c), key=lambda r: r["place"])] == expected
    none = spark.createDataFrame([], df.schema)
    assert repair.repair(repair.damage(none)).count() == 0 and repair.repair(repair.damage(none), turns=True).count() == 0


def test_blocks_join_like_one_span(spark):
    signs = "".join(random.Random(3).choice("suaxSUAX0123") for _ in range(999))
    whole = repair.parse(signs)
    assert repair.join_all([repair.parse(signs[i:i + 70]) for i in range(0, 999, 70)]) == whole
    assert repair.cheapest(whole) == plain_cheapest(signs)


# 13

def plain_negatives(rows, scale=256):
    e = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if label is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    key = lambda r: (-r[1], r[0] is None, r[0] or 0)
    for k, (a, label, v) in enumerate(e):
        if a is None or a % 50:
            continue
        scored = [(c[0], sum(x * y for x, y in zip(v, c[2])), c[1] == label) for j, c in enumerate(e) if j != k]
        for p, s, _ in sorted((r for r in scored if r[2]), key=key)[:5]:
            fit = sorted((r for r in scored if not r[2] and 50 * s <= 100 * r[1] <= 95 * s), key=key)[:3]
            out += [(a, p, rank, r[0], s, r[1]) for rank, r in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(spark, rows, kind="double"):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, label int, embedding array<{kind}>, anchor int, mark string")
    return sorted((tuple(r) for r in negatives.mine(negatives.participants(df), F.col("vec_id") % 50 == 0).collect()), key=str)


def test_negatives_against_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), [round(rng.uniform(-0.2, 0.6), 2) for _ in range(6)]) for i in range(400)]
    odd = [(None, 1, [0.5] * 6), (500, None, [0.1] * 6), (501, 1, None), (502, 1, [0.1, None]), (503, 1, [float("nan")] * 6), (504, 2, [float("inf")]), (505, 1, []), (550, 2, [0.4, 0.3]), (506, 1, [0.5] * 9), (600, 2, []), *[(100, 1, [0.5] * 6)] * 3]
    assert mined(spark, rows + odd) == plain_negatives(rows + odd)
    monkeypatch.setattr(negatives, "ROWS_AT_ONE", 20)
    monkeypatch.setattr(negatives, "GROUP_ROWS", 3)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 7)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 2)
    assert mined(spark, rows + odd) == plain_negatives(rows + odd)
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [0.5])]) == []


def test_wide_components(spark):
    rng = random.Random(4)
    for top in (1e3, 1e5, 1e6):
        rows = [(i, i % 2, [rng.uniform(-top, top) for _ in range(5)]) for i in range(120)]
        assert mined(spark, rows) == plain_negatives(rows)
    import numpy as np
    wide = np.array([[10**20, -3], [7, 10**18]], object)
    assert negatives.Packed(wide, 10**20 + 10).scores(np.array([[10**20, -10]], object), 10).tolist() == [[10**40 + 30, 7 * 10**20 - 10**19]]
