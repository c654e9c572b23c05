"""Every operator against a plain version or its laws, on odd rows and on the given tables."""
import collections
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cladeloom.llm import decontaminate, fertility, jaccard_join, packing, ppm, quality_knn, sharding, simple8b, suffix_dedup, toxicity
from cladeloom.llm.queries import QUERIES, VOCABULARY
from tests.llm import cases

TINY = "/root/testdata/sf0.001"
VOC = public_tokenizers.path(VOCABULARY)
PIECE = (public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(cases.rows(cases.odd_texts()), cases.SCHEMA)


@pytest.fixture(scope="module")
def plain(spark):
    """The odd texts under distinct ids."""
    docs = list(enumerate(cases.odd_texts()))
    return docs, spark.createDataFrame(docs, "doc_id long, text string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], cases.SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# 1

def test_plain_rules_and_fertility(spark, odd, plain, none):
    docs, df = plain
    got = {r["row"]["doc_id"]: r for r in fertility.measure(df, *PIECE).collect()}
    for i, t in docs:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == cases.plain_rules(t), i
    spp = fertility.vocabularies(*PIECE)
    t = docs[7][1]
    pieces = [p for w in t.split() for p in spp.piece.encode(w)]
    assert got[7]["n_tokens"] == len(pieces)
    share = np.array(list(collections.Counter(pieces).values())) / len(pieces)
    assert got[7]["entropy"] == pytest.approx(-(share * np.log2(share)).sum())
    assert got[20]["fallback"] > 0
    out = fertility.judge(odd, *PIECE)
    assert out.count() == odd.count() and out.where("row.text is null and kept").count() == 0
    assert fertility.judge(none, *PIECE).count() == 0


def test_bands_reject_a_text_unlike_its_group(spark):
    rows = [(i, cases.words(100 + i, 200), "xx") for i in range(60)] + [(99, " ".join(f"☃☂{k}☁" for k in range(200)), "xx")]
    out = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), *PIECE).select("row.doc_id", "base_failed", "kept").collect()}
    assert not out[99]["base_failed"] and not out[99]["kept"]
    assert sum(out[i]["kept"] for i in range(60)) >= 55


def test_small_groups_are_judged_too(spark):
    """Junk in a rare language and in a rare size class goes, clean texts there stay."""
    junk = lambda n: " ".join(f"☃☂{k}☁" for k in range(n))
    rows = [(i, cases.words(100 + i, 40 + 5 * i), "xx") for i in range(60)]
    rows += [(70, cases.words(170, 600), "xx"), (71, cases.words(171, 24), "xx"), (72, cases.words(172, 150), "yy"), (90, junk(600), "xx"), (91, junk(24), "xx"), (92, junk(150), "yy")]
    out = {r["doc_id"]: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), *PIECE).select("row.doc_id", "base_failed", "kept").collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert [out[i]["kept"] for i in (70, 71, 72, 90, 91, 92)] == [True] * 3 + [False] * 3


# 2

def test_language_model_is_a_distribution_and_tables_agree():
    text = b"the cat sat on the mat and the dog sat on the cat"
    code, _ = ppm.grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]), ppm.ORDER)
    keys, n = np.unique(code, return_counts=True)
    tree = ppm.Tree(keys, n)
    for context in (b"the", b"at ", b"zzz", b"zat"):
        base = int.from_bytes(context, "big") << 8
        grams = np.array([base | b for b in range(256)], np.uint32)
        assert (2.0 ** -tree.bits(grams, 3)).sum() == pytest.approx(1, abs=1e-6)
    model = ppm.Model(["a", "b"], [(keys, n), (keys[::2], n[::2])])
    new = np.frombuffer(b"the bat \xff sat", np.uint8)
    code, _ = ppm.grams(new, np.array([0, len(new)]), ppm.ORDER)
    want = [ppm.Tree(k, c).bits(code, 3).sum() for k, c in ((keys, n), (keys[::2], n[::2]))]
    assert model.lengths(code, np.zeros(len(code), np.int64), 1)[0] == pytest.approx(want, rel=1e-5)


def test_language_prediction(spark, odd, none):
    rows = QUERIES["op2_ppm_language"](spark, TINY).join(spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    model = ppm.train(odd.select("doc_id", "text", "lang"))
    out = ppm.predict(odd, model).collect()
    assert len(out) == odd.count()
    assert all((r["lang_pred"] == "und" and r["score"] == 0) == (not any(c.isalpha() for c in r["row"]["text"] or "")) for r in out)
    assert ppm.predict(none, ppm.train(none)).count() == 0
    assert {r["lang_pred"] for r in ppm.predict(odd, None).collect()} == {"und"}


# 3

def test_channel_decoding(spark):
    costs = toxicity.character_costs(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    reader = toxicity.Reader(costs)
    assert reader.read(["idi0t", "stuuuupid", "s.c.u.m", "m o r o n", "plain", "tr@sh!!", "", "***", "12345"]) == [["idiot"], ["stupid"], ["scum"], ["moron"], ["plain"], ["trash"], [], [], ["12345"]]
    [[masked]] = reader.read(["st*pid"])
    assert len(masked) == 6 and masked.isalpha()


def test_channel_combinations(spark):
    """Look-alikes, separators and doubled letters, alone and with blanks between them."""
    reader = toxicity.Reader(toxicity.character_costs(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    assert reader.read(["stuupid", "idiiot", "m0rroon", "2024"]) == [["stupid"], ["idiot"], ["moron"], ["2024"]] and reader.read(["@$$"]) != [[]]
    texts = ["x1x m 0 r 0 n", "well s t u p ! d", "very i d 1 o t here", "the s . c . u . m", "nothing - 1 2 3"]
    _, _, _, runs = reader.text_words(pa.array(texts), lambda words: words)
    assert runs == [(0, ["moron"]), (1, ["stupid"]), (2, ["idiot"]), (3, ["scum"])]


def test_plain_words_are_read_as_by_the_lattice(spark):
    import random
    costs = toxicity.character_costs(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = random.Random(1)
    words = ["letter", "good", "worthless", "stuuupid", "aaaaab", "bookkeeper", "élle", "éé", "llama", "ſſa"]
    words += ["".join(rng.choice("aabeelost") for _ in range(rng.randint(2, 12))) for _ in range(400)]
    words = [w for w in words if toxicity.plain_readings(w) is not None]
    assert toxicity.decode_plain(words, costs.ravel().tolist()) == toxicity.decode(words, costs)
    assert toxicity.plain_readings("aabb" * 9) is None
    seen = []
    toxicity.Reader(costs).text_words(pa.array(["worthless word"]), lambda ws: seen.append(ws))
    assert any("worthless" in ws for ws in seen)


def test_held_out_toxic_documents_are_found(spark):
    got = QUERIES["op3_toxicity_noisy_channel"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    toxic, clean = ([r["predicted"] for r in got if r["toxic"] == k] for k in (1, 0))
    assert len(toxic) >= 4 and sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_decoding_equals_brute_force(spark):
    import itertools
    costs = toxicity.character_costs(spark.read.parquet(f"{TINY}/documents.parquet")).astype(np.float32)
    for text in ("1d0t", "aaab", "s.c", "4*a", "a b c"):
        best = None
        for way in itertools.product(*toxicity.readings(text)):
            symbols = [toxicity.BLANK, toxicity.BLANK, *[s for s, _, _ in way if s >= 0], toxicity.BLANK]
            cost = sum(c for _, _, c in way) + sum(costs[tuple(symbols[k:k + 3])] for k in range(len(symbols) - 2))
            best = min(best or (9e9, ""), (cost, "".join(x for _, x, _ in way)))
        assert toxicity.decode([text], costs) == [best[1]]


def test_toxicity_learns_restores_and_scores(spark, odd, none):
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(240):
        w = cases.words(1000 + i, 40).split()
        if i % 3 == 0:
            for bad in ("idiot", "moron"):
                w[int(rng.integers(40))] = bad
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(i % 3 == 0)))
    hidden = [(1000, f"{cases.words(5000, 20)} 1d10t m.o.r.o.n"), (1001, f"{cases.words(5001, 20)}"), (1002, None), (1003, "")]
    docs = spark.createDataFrame(rows + hidden, "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels(spark, marks))).collect()}
    assert got[1000] > 0.5 and max(got[1001], got[1002], got[1003]) < 0.5 and got[1002] == got[1003]
    assert np.mean([(got[i] >= 0.5) == (t == 1) for i, _, t in marks]) > 0.97
    assert toxicity.score(odd, None).count() == odd.count()
    assert toxicity.train(none, labels(spark, [])) is None
    assert toxicity.drop_toxic(odd, labels(spark, [(None, None, None), (1, None, 1), (2, 0, None)])).columns == odd.columns


def test_long_words_with_equal_polynomial_hashes(spark):
    """A Thue-Morse word of 1,024 letters and its complement are equal modulo 2**64 whatever the base."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate({97: "b", 98: "a"})
    docs = spark.createDataFrame([(1, f"{a} x y z"), (2, f"{b} x y z"), (3, f"{a} c d e f g h i {b} c d e f g h i")], "doc_id long, text string")
    assert [r["n_repeat_words"] for r in sorted(fertility.measure(docs, *PIECE).collect(), key=lambda r: r["row"]["doc_id"])] == [0, 0, 0]
    want = {r["doc_id"]: cases.crc([*Tokenizer.from_file(VOC).encode(r["text"], add_special_tokens=False).ids, 1]) for r in docs.collect()}
    path = simple8b.store(docs, VOC)
    assert {r["doc_id"]: r["ids_crc32"] for r in simple8b.read_ids(spark, path, ids=False).collect()} == want
    placed, _ = packing.pack(docs, VOC)
    assert {r["doc_id"]: r["ids_crc32"] for r in placed.where("length = doc_tokens").collect()} == want
    assert {r["component_id"] for r in jaccard_join.with_components(docs).collect()} == {1, 2, 3}


# 4

@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [65, 20, 64, 33, 10, 65][seed], [500, 1000, 300, 700, 50, 1][seed]).tolist()
    plan = packing.best_fit_plan(collections.Counter(lengths), 64)
    used, places = collections.Counter(), set()
    for length, first, end, per, sequence, offset in plan:
        for k in range(end - first):
            s, at = sequence + k // per, offset + k % per * length
            assert at + length <= 64 and not places & {(s, at + j) for j in range(length)}
            places |= {(s, at + j) for j in range(length)}
            used[s] += length
    assert sorted(64 - used[s] for s in range(len(used))) == sorted(cases.best_fit_decreasing(lengths, 64))


def test_packing_covers_every_id_once(spark, odd, none):
    tokenizer = Tokenizer.from_file(VOC)
    placed, pieces = packing.pack(odd, VOC, window=64)
    rows = placed.collect()
    by_row = collections.defaultdict(list)
    for r in rows:
        by_row[r["uid"]].append(r)
    assert len(by_row) == odd.count()
    encoded = collections.Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])) for r in odd.collect())
    held = pieces.collect()
    assert collections.Counter((u[0]["doc_id"], tuple(x for p in sorted((p for p in held if p["uid"] == uid), key=lambda p: p["start"]) for x in p["ids"])) for uid, u in by_row.items()) == encoded
    sequences = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed, pieces).collect()}
    assert sorted(sequences) == list(range(len(sequences))) and max(map(len, sequences.values())) <= 64
    for r in rows:
        assert cases.crc(sequences[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]]) == r["ids_crc32"]
    assert packing.pack(none, VOC)[0].count() == 0


# 5

@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), rng.integers(0, 2, n), (2.0 ** rng.uniform(0, 63.9, n)).astype(np.uint64), np.full(n, 2 ** 64 - 1, np.uint64), np.zeros(n, np.int64)):
        words, first, exceptions = simple8b.encode_ids(np.asarray(ids))
        assert np.array_equal(simple8b.decode_ids(words, first, exceptions, n), np.asarray(ids).astype(np.uint64))
        if n > 2000:  # one block alone
            part = words[first[1]:first[2]]
            assert np.array_equal(simple8b.decode_ids(part, first[1:3] - first[1], exceptions, 1024), np.asarray(ids).astype(np.uint64)[1024:2048])


def test_id_files(spark, odd, none):
    tokenizer = Tokenizer.from_file(VOC)
    path = simple8b.store(odd, VOC)
    rows = sorted(simple8b.read_ids(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in odd.collect()), key=lambda i: (i is not None, i))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:])) and rows[0]["start"] == 0
    want = collections.Counter((r["doc_id"], *tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1) for r in odd.collect())
    assert collections.Counter((r["doc_id"], *r["ids"]) for r in rows) == want
    assert all(cases.crc(r["ids"]) == r["ids_crc32"] for r in rows)
    assert simple8b.read_ids(spark, simple8b.store(none, VOC)).count() == 0
    with pytest.raises(ValueError):
        list(simple8b.read_containers(memoryview(simple8b.container(np.zeros(1, np.int64), np.ones(1), np.array([3]), np.arange(3))[:-1] + b"\xff\n")))


# 6

def test_jaccard_join_on_odd_texts(spark, odd, plain, none):
    docs, df = plain
    got = {r["row"]["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.with_components(df).collect()}
    assert got == cases.jaccard_components(docs)
    out = jaccard_join.with_components(odd)
    assert out.count() == odd.count() and jaccard_join.with_components(none).count() == 0
    assert jaccard_join.keep_one(odd).columns == odd.columns


def test_keep_one_keeps_every_component(spark):
    """Unlinked texts without an id, or under one repeated id, all stay; of linked ones the smallest id stays."""
    rows = [(None, cases.words(300 + i, 30)) for i in range(20)] + [(7, cases.words(340 + i, 30)) for i in range(5)]
    linked = [(None, cases.words(360, 30)), (9, cases.words(360, 30)), (8, cases.words(360, 30)), (None, cases.words(361, 30)), (None, cases.words(361, 30))]
    out = jaccard_join.keep_one(spark.createDataFrame(rows + linked, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([*rows, linked[2], linked[3]], key=str)


def test_jaccard_join_with_crowded_regions(spark, monkeypatch):
    """Many near copies and a passage that unrelated texts share, with regions beyond LEAF and several blocks and keys."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 5)
    import random
    rng = random.Random(5)
    base, passage, docs = cases.words(50, 60).split(), cases.words(51, 40), []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        docs.append((i, " ".join(w)))
    docs += [(100 + i, f"{passage} {cases.words(60 + i, 5 + i % 9)}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = cases.jaccard_components(docs)
    for rounds in (0, 1, 3):
        rows, labels_ = jaccard_join.near_duplicates(df, rounds=rounds)
        same = {r["node"]: r["label"] for r in labels_.collect()}
        groups = collections.defaultdict(list)
        for r in rows.select("row.doc_id", "digest").collect():
            groups[same.get(r["digest"], r["digest"])].append(r["doc_id"])
        assert {i: min(g) for g in groups.values() for i in g} == {i: c for i, (_, c) in want.items()}, rounds


def test_jaccard_join_by_voronoi_cells(spark, monkeypatch):
    """Crowded regions are always cut into the cells of their pivots, also where windows overlap much; several clusters share one region."""
    monkeypatch.setattr(jaccard_join, "SPLIT", 100)
    monkeypatch.setattr(jaccard_join, "LEAF", 2)
    import random
    rng = random.Random(11)
    passage, docs = cases.words(70, 45), []
    for i in range(48):
        w = cases.words(71 + i % 4, 15).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(5)}"
        docs.append((i, f"{passage} {' '.join(w)}"))
    rounds, cut = [], jaccard_join.voronoi_round

    def watched(state, *rest):
        out = cut(state, *rest)
        regions = lambda df: {r["region"] for r in df.select("region").distinct().collect()}
        rounds.append(bool(regions(out[0]) - regions(state)))
        return out

    monkeypatch.setattr(jaccard_join, "voronoi_round", watched)
    got = {r["row"]["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.with_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == cases.jaccard_components(docs)
    assert any(rounds)


def test_components_of_a_long_chain(spark):
    from cladeloom.llm.components import components
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5000, 5000)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


# 7

def test_wu_manber_on_odd_texts(spark, odd, plain, none):
    docs, df = plain
    base = docs[7][1].split()
    items = [(1, " ".join(base[5:30])), (2, " ".join(base[40:50]).upper()), (3, "two THREE"), (4, None), (5, "!!"), (None, "one"), (10, " ".join(base[5:30])), (6, "w"), (6, "w"), (7, "Ç"), (8, "don't 3.14")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = cases.benchmark_hits(docs, items)
    for windows in (1_000_000, 3):
        got = {r["row"]["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.mark_benchmark(df, bench, block_windows=windows).collect()}
        assert got == want
    for r in decontaminate.mark_benchmark(df, bench).collect():
        assert sum(s["end"] - s["first"] for s in r["spans"]) == r["n_hit"]
    assert decontaminate.mark_benchmark(odd, bench).count() == odd.count()
    assert decontaminate.drop_benchmark(odd, bench).columns == odd.columns
    assert decontaminate.mark_benchmark(none, bench).count() == 0
    assert decontaminate.mark_benchmark(odd, bench.limit(0)).where("n_hit > 0").count() == 0


# 8

def test_quality_votes(spark, odd, none):
    rows = QUERIES["op8_quality_knn"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    space = quality_knn.train(odd, labels(spark, [(i, i % 2, 0) for i in range(4, 12)] + [(None, 1, 1), (12, None, 1)]))
    out = quality_knn.score(odd, space).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert quality_knn.score(odd, None).where("score <> 0").count() == 0
    assert quality_knn.score(none, space).count() == 0


def test_vote_is_an_exact_search(spark):
    texts = pa.array([cases.words(i, 30) for i in range(50)])
    counts = quality_knn.term_counts(texts)
    space = quality_knn.Space(counts, np.arange(50) % 2, {0: 25, 1: 25}, 16, 5)
    x = space.unit(space.weigh(counts) @ space.axes)
    for i, got in enumerate(space.vote(counts)):
        cosine = np.array([x[i] @ v for v in space.vectors])
        near = np.argsort(-cosine)[:5]
        weight = np.maximum(cosine[near], 0) ** 8
        assert got == pytest.approx((weight * (near % 2)).sum() / weight.sum(), abs=1e-4)


# 9

def test_suffix_dedup_on_odd_texts(spark, odd, plain, none):
    docs, df = plain
    want = cases.kept_bytes(docs)
    for r in suffix_dedup.remove_repeats(df).collect():
        kept, size, gone, spans = want[r["row"]["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, gone, spans, cases.sha(kept)), r["row"]["doc_id"]
    out = suffix_dedup.remove_repeats(odd)
    assert out.count() == odd.count()
    rest = suffix_dedup.without_repeats(odd)
    assert rest.columns == odd.columns and rest.count() == odd.count()
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_shared_passages(spark):
    """A passage among many texts with other bytes around it, cut at other places, beside copies."""
    passage = cases.words(70, 60)
    docs = [(i, f"{cases.words(200 + i, 12)} {passage[i % 30:len(passage) - i % 17]} {cases.words(300 + i, 9)}") for i in range(40)] + [(100 + i, passage) for i in range(5)]
    want = cases.kept_bytes(docs)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert {r["row"]["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == {i: (g, s, cases.sha(k)) for i, (k, _, g, s) in want.items()}


def test_suffix_anchors_take_bounded_memory():
    rng = np.random.default_rng(5)
    texts = [rng.integers(97, 123, 4000).astype(np.uint8).tobytes().decode() for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    suffix_dedup.powers(suffix_dedup.LENGTH)  # the table of powers stays
    tracemalloc.start()
    try:
        largest = max(out.nbytes for out in suffix_dedup._send_anchors(8)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert largest < 2e6 and peak < 50e6, (largest, peak)


def test_suffixes_of_a_common_gram_are_sorted_only_where_two_are_equal(monkeypatch):
    """A phrase in many documents, with other text around it in all but two."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 68, dtype=np.uint8) for _ in range(400)]
    phrase = rng.integers(97, 123, suffix_dedup.GRAM, dtype=np.uint8)
    texts[300][:40] = texts[10][:40]
    buf = np.concatenate([np.concatenate([t, phrase, t[::-1]]) for t in texts])
    buf[300 * 168 + 100:300 * 168 + 140] = buf[10 * 168 + 100:10 * 168 + 140]
    buf[300 * 168 + 40:300 * 168 + 68] = buf[10 * 168 + 40:10 * 168 + 68]
    rec = np.zeros(400, suffix_dedup.FETCHED)
    rec["gram"], rec["doc_id"], rec["at"], rec["left"], rec["size"], rec["low"] = 5, np.arange(400), 68, 68, 168, 68
    sorted_, plain = [], suffix_dedup.sort_suffixes
    monkeypatch.setattr(suffix_dedup, "sort_suffixes", lambda buf, prefix, starts, *a: (sorted_.append(len(starts)), plain(buf, prefix, starts, *a))[1])
    seen = {}
    for i in range(400):
        for back in range(69):
            seen.setdefault((back, buf[i * 168 + 68 - back:i * 168 + 168 - back].tobytes()), []).append(i)
    want = {(i, 68 - back) for (back, _), who in seen.items() for i in who[1:]}
    for batch in suffix_dedup._strings(rec, np.arange(400) * 168, buf, suffix_dedup.prefix_hash(buf)):
        got = {(d, x) for d, s, e in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "end"))) for x in range(s, e - suffix_dedup.LENGTH + 1)}
    assert want and got == want and sum(sorted_) == 2 * len(want)
    low, high = rec["low"].astype(int), rec["high"].astype(int)
    cuts = list(suffix_dedup.offsets_at_once(low, high, 2_000))
    assert cuts[0][0] == 0 and cuts[-1][1] == 68 and all(b + 1 == c for (_, b), (c, _) in zip(cuts, cuts[1:])) and all(400 * (b - a + 1) <= 2_000 for a, b in cuts)


def test_suffix_sort_orders_suffixes():
    rng = np.random.default_rng(8)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3800, 700)
    edges = np.array([0, 1, 3, 10, 300, 700])
    order = suffix_dedup.sort_suffixes(buf, suffix_dedup.prefix_hash(buf), starts, edges, 100)
    for a, b in zip(edges[:-1], edges[1:]):
        assert order[a:b].tolist() == sorted(range(a, b), key=lambda i: (buf[starts[i]:starts[i] + 100].tobytes(), i))


# 10

def test_sharding_laws(spark, odd, none):
    big = spark.createDataFrame([(i, cases.words(i % 400, 30)) for i in range(3000)] + [(5000 + i, "copy " * 40) for i in range(900)], "doc_id long, text string")
    rows = sharding.histogram_shards(big, tolerance=0.01).collect()
    size, shard_of = collections.Counter(), collections.defaultdict(set)
    slots = collections.defaultdict(list)
    texts = {r["doc_id"]: r["text"] for r in big.collect()}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        size[r["shard"]] += r["size"]
        shard_of[texts[r["doc_id"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in shard_of.values()) and len(rows) == 3900
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    light = [v for s, v in size.items() if s not in shard_of["copy " * 40]]
    assert max(light) / min(light) < 1.05
    out = sharding.histogram_shards(odd)
    assert out.count() == odd.count() and sharding.histogram_shards(none).count() == 0
    assert out.where("doc_id = 0").first()["size"] == 1 and out.where("doc_id = 0").first()["text_crc32"] == 0


def test_splitters_meet_their_targets(spark):
    rows = spark.range(20000).select(F.shiftrightunsigned(F.xxhash64("id"), 4).alias("key"), (F.col("id") % 7 + 1).alias("size"))
    total = rows.agg(F.sum("size")).first()[0]
    targets = [total * k / 8 for k in range(1, 8)]
    cuts = sharding.splitters(rows, targets, 20)
    for cut, target in zip(cuts, targets):
        assert abs((rows.where(F.col("key") < cut).agg(F.sum("size")).first()[0] or 0) - target) <= 20
