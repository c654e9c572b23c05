"""One query per operator, over the whole tables and with production parameters."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.llm import decontaminate, fertility, jaccard_join, negatives, packing, ppm, quality_knn, repair, resync, sharding, simple8b, suffix_dedup, toxicity
from cladeloom.llm.registry import QUERIES, SQL, query  # noqa: F401
from cladeloom.llm.text import documents, table

VOCABULARY = "word_bpe_49k.json"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op1_token_fertility")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fertility.judge(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carry=["doc_id"])
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *fertility.MEASURES, "script", "fertile")


def remainder(n: int, name: str = "doc_id"):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % n


def held_out(name: str, n: int, value: int):
    return F.coalesce(remainder(n, name) == value, F.lit(False)).alias("held_out")


@query("op2_ppm_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = ppm.train(docs.where(F.coalesce(remainder(3) != 1, F.lit(True))))
    out = ppm.predict(docs, model, carry=["doc_id"])
    return out.select("row.doc_id", held_out("row.doc_id", 3, 1), "lang_pred", "score", "bits_per_byte")


@query("op3_toxicity_noisy_channel")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    out = toxicity.score(docs, toxicity.train(docs, labels), carry=["doc_id"])
    return out.select("row.doc_id", held_out("row.doc_id", 5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = packing.pack(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op5_simple8b_ids")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = simple8b.store(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    return simple8b.read_ids(spark, path, ids=False)


OP6_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT r.node AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.seen) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY r.node
"""


@query("op6_jaccard_metric_join", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.with_components(documents(spark, sf_dir).select("doc_id", "text"), carry=["doc_id"])
    return out.select("row.doc_id", "n_shingles", "component_id")


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT d.doc_id, d.w, ks.k, unnest(range(1, len(d.w) - ks.k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) ks)),
occ AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op7_wu_manber_decontamination", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.mark_benchmark(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select("row.doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op8_quality_knn")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    out = quality_knn.score(docs, quality_knn.train(docs, labels), carry=["doc_id"])
    return out.select("row.doc_id", held_out("row.doc_id", 5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP9_SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d)),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM o WHERE k > 1),
u AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM u GROUP BY 1, 2),
v AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (
  SELECT v.doc_id, count(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(substr(h, (2 * before + 1)::BIGINT, (2 * (a - before))::BIGINT), '' ORDER BY a) AS s
  FROM v JOIN d USING (doc_id) GROUP BY v.doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(k.n, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN k.n IS NULL THEN h ELSE k.s || substr(h, (2 * k.last + 1)::BIGINT) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query("op9_suffix_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(documents(spark, sf_dir), carry=["doc_id"], keep_text=False)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op10_histogram_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.histogram_shards(documents(spark, sf_dir), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op11_overlap_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resync.count_tokens(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), limit=2048, carry=["doc_id"])
    return out.select("row.doc_id", "n_bytes", "n_tokens", "over_limit")


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
dam AS (
  SELECT raw.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda j: ascii(substr(k, j, 1))::BIGINT)),
                                            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS d
  FROM raw, crc),
r AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dam WHERE d <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         right(rtrim(text, E' \t\n\x0B\x0C\r'), 1) AS last, left(role, 1) AS ini
  FROM r),
f AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY n) || ini NOT IN ('su', 'ua', 'au'), false) AS bad
  FROM o),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (bad) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id),
step(ini, p, q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
ins(p, q, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II')),
e AS (
  SELECT conv_id, n, p, q, (fault = 't')::INT AS c, 'K' AS a FROM f JOIN step USING (ini) WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, n, p, q, 2 + (fault = 't')::INT, 'R' FROM f, step WHERE step.ini <> 's' AND fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, n, p, p, 3, 'D' FROM f, (VALUES (0), (1), (2), (3)) x(p)),
m AS (
  SELECT conv_id, n, e.p, ins.q, min(struct_pack(c := e.c + ins.c, a := e.a || ins.a)) AS v FROM e JOIN ins ON ins.p = e.q GROUP BY ALL),
dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, q, struct_pack(c := c, a := a) AS v FROM conversations, ins WHERE p = 0
  UNION ALL
  SELECT dp.conv_id, m.n, m.q, min(struct_pack(c := dp.v.c + m.v.c, a := dp.v.a || m.v.a)) FROM dp JOIN m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.n = dp.n + 1 AND m.p = dp.q GROUP BY dp.conv_id, m.n, m.q),
w AS (
  SELECT c.conv_id, min(dp.v) AS v FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
  JOIN dp ON dp.conv_id IS NOT DISTINCT FROM c.conv_id AND dp.n = coalesce(s.n, 0) AND dp.q IN (0, 3) GROUP BY c.conv_id),
x AS (SELECT conv_id, k, substr(v.a, k::INT, 1) AS a FROM (SELECT *, unnest(range(1, length(v.a) + 1)) AS k FROM w)),
y AS (SELECT *, count(*) FILTER (a <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS n FROM x),
z AS (
  SELECT y.conv_id, y.k, y.a, f.role, CASE WHEN y.a = 'I' THEN '' ELSE f.text END AS text, row_number() OVER (PARTITION BY y.conv_id ORDER BY y.k) AS place,
         bool_or(y.a = 'K' AND f.ini = 's') OVER (PARTITION BY y.conv_id) AS sys
  FROM y LEFT JOIN f ON y.a <> 'I' AND f.conv_id IS NOT DISTINCT FROM y.conv_id AND f.n = y.n WHERE y.a <> 'D'),
h AS (
  SELECT conv_id, string_agg(CASE WHEN a = 'K' THEN role WHEN (place - sys::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS lines
  FROM z GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       w.v.c::BIGINT AS cost, w.v.a AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM w LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM w.conv_id
"""


@query("op12_weighted_cyk_repair", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e a JOIN e c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query("op13_kronecker_negatives", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.participants(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 50 == 0)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the top of the repository; it imports this module

    return corpus_pipeline.run(spark, sf_dir)
