"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberwatch.llm import (
    bpe, decontaminate, embedding_dedup, filter_audit, language, language_model, packing, pii, resampling, simhash,
    token_files, toxicity, word_pieces,
)
from emberwatch.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op6_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_pieces.report(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.report(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_toxicity, op3_embedding_dedup, op4_language_model, op5_simhash, op6_word_pieces, op7_token_files,
        op8_language, op9_decontaminate, op10_bpe, op11_resampling, op12_filter_audit, op13_packing,
    )
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

def _crc_table() -> list[int]:
    """The CRC-32 table, from its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


ORACLE = {
    "op11_resampling": rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, 's' AS kind, doc_id, text FROM documents
  UNION ALL SELECT row_number() OVER (), 't', NULL, text FROM benchmark),
words AS (
  SELECT r, kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feature AS (
  SELECT r, kind, unnest(w || [w[i] || ' ' || w[i + 1] for i in generate_series(1, len(w) - 1)]) AS f FROM words),
hashed AS (
  SELECT f, xor(list_reduce(
    [4294967295::BIGINT] || [('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT for i in generate_series(1, octet_length(encode(f)))],
    lambda a, b: xor(a >> 8, ({_crc_table()})[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM feature)),
cells AS (SELECT bucket, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t FROM feature JOIN hashed USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM cells) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM cells) + 10000)::DOUBLE)))::BIGINT AS g FROM cells),
weighed AS (
  SELECT r, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight
  FROM feature JOIN hashed USING (f) JOIN gain USING (bucket) WHERE kind = 's' GROUP BY r),
scored AS (
  SELECT words.r, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (r) WHERE kind = 's'),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score::BIGINT AS score,
  CASE WHEN rank <= 25 * (SELECT count(*) FROM ranked) // 100 THEN rank END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (r)
""",
    "op12_filter_audit": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM w GROUP BY text),
failed AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(first_id < doc_id, false)] AS f
  FROM w JOIN firsts USING (text)),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
kinds AS (
  SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE instr(o, x) = 0),
steps AS (
  SELECT o AS filter_order, unnest(generate_series(1, 5))::INT AS step, [ascii(c) - 64 for c in string_split(o, '')] AS p
  FROM orders WHERE length(o) = 5),
met AS (
  SELECT filter_order, step, part, n, good, toxic,
    len(list_filter(p[:step - 1], lambda i: f[i])) > 0 AS gone, f[p[step]] AS fails,
    len(list_filter(f, lambda x: x)) = 1 AS once
  FROM steps, kinds),
counted AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS x,
    sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (NOT gone AND fails) AS removed,
    sum(n) FILTER (gone AND fails) AS redundant, sum(n) FILTER (fails AND once) AS unique_fails,
    sum(n) FILTER (NOT gone AND fails AND good) AS good_lost, sum(n) FILTER (NOT gone AND fails AND toxic) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley
FROM counted
""",
    "op3_embedding_dedup": """
WITH RECURSIVE u AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (
  SELECT r, vec_id, label, e, len(e) AS d FROM u
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.label = b.label AND a.d = b.d AND a.r <> b.r
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
c AS (
  SELECT r AS a, r AS b FROM u
  UNION
  SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
m AS (SELECT c.a AS r, min(u.vec_id) AS component_id FROM c JOIN u ON u.r = c.b GROUP BY c.a),
n AS (SELECT a AS r, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM u JOIN m USING (r) LEFT JOIN n USING (r)
""",
    "op9_decontaminate": rf"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id,
         regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark),
win AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS n,
         array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM words WHERE kind = 'b' AND len(w) > 0)),
place AS (
  SELECT id AS doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
  FROM words, (SELECT DISTINCT n FROM win) WHERE kind = 'd' AND len(w) >= n),
hit AS (
  SELECT p.doc_id, p.i, p.n, win.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM place) p JOIN win USING (n, s)),
counts AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN counts ON counts.doc_id = w.id LEFT JOIN items ON items.doc_id = w.id
WHERE w.kind = 'd'
""",
}
