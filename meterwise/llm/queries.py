"""Registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterwise.llm import (chat_format, cover_tree, decontaminate, language_id, lpt_sharding, pii, quality, range_coder,
                           segment_resampling, simhash, spelling, token_counts, vector_packing)
from meterwise.llm.common import table


def tokenizer_path() -> str:
    """The tokenizer file of the registered queries: the public byte-level vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_votes(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op2_lpt_shards(spark: SparkSession, sf: str) -> DataFrame:
    return lpt_sharding.lpt_shards(table(spark, sf, "documents"), 16)


def op3_cover_tree(spark: SparkSession, sf: str) -> DataFrame:
    return cover_tree.near_pairs(table(spark, sf, "embeddings"), 0.93)


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf, "documents"), shingle=3, radius=2)


def op5_vector_packing(spark: SparkSession, sf: str) -> DataFrame:
    return vector_packing.pack_documents(table(spark, sf, "documents"), tokenizer_path())


TRAP = r"\### Assistant: </turn> ok"  # conversation -7: text that looks like an escaped template


def op6_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], rows.schema)
    return chat_format.turn_digests(chat_format.format_turns(rows.union(more)))


def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return range_coder.token_file_digests(table(spark, sf, "documents"), tokenizer_path())


def op8_private_spans(spark: SparkSession, sf: str) -> DataFrame:
    return pii.private_spans(table(spark, sf, "documents"))


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.language_id(table(spark, sf, "documents"))


def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op11_segment_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return segment_resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents"))


def op13_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), tokenizer_path())


QUERIES = {f.__name__: f for f in (
    op1_quality_votes, op2_lpt_shards, op3_cover_tree, op4_simhash, op5_vector_packing, op6_chat_format, op7_token_files,
    op8_private_spans, op9_language_id, op10_decontaminate, op11_segment_resampling, op12_spelling_variants,
    op13_token_counts)}

# crc32 of all keys of the table crc_keys(key), a byte at a time.
CRC32 = """
bits AS (SELECT range AS i FROM range(256)),
crc_step AS (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS t FROM bits),
crc_walk AS (
  SELECT key, hex(encode(key)) AS h, 0 AS p, 4294967295 AS c FROM crc_keys
  UNION ALL
  SELECT key, h, p + 1, xor(c >> 8, t) FROM crc_walk JOIN crc_step ON i = xor(c, ('0x' || substr(h, 2 * p + 1, 2))::BIGINT) & 255
  WHERE p < length(h) // 2),
crc AS (SELECT key, xor(c, 4294967295) AS crc FROM crc_walk WHERE p = length(h) // 2)"""

ORACLE = {
    "op3_cover_tree": """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
   AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id""",
    "op6_chat_format": r"""
WITH source AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
turns AS (
  SELECT *, 6 + length(role) + length(regexp_replace(text, '(\\*)(#{3,}|</turn>)', '\\\1\2', 'g')) + 9 AS chars FROM source)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op11_segment_resampling": r"""
WITH RECURSIVE
texts AS (SELECT doc_id, false AS target, text FROM documents UNION ALL SELECT item_id, true, text FROM benchmark),
words AS (
  SELECT row_number() OVER () AS d, doc_id, target,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feats AS (
  SELECT d, target, unnest(list_concat(list_concat(w,
           list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])),
           list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS key FROM words),
crc_keys AS (SELECT DISTINCT key FROM feats),
""" + CRC32.strip() + r""",
bucketed AS (SELECT d, target, crc % 10000 AS b FROM feats JOIN crc USING (key)),
totals AS (SELECT count(*) FILTER (NOT target) AS s_all, count(*) FILTER (target) AS t_all FROM bucketed),
gains AS (
  SELECT b, floor(1000 * ln((t + 1.0::DOUBLE) * (t_s + 10000) / ((s + 1.0::DOUBLE) * (t_t + 10000))))::BIGINT AS gain
  FROM (SELECT b, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t,
               any_value(s_all) AS t_s, any_value(t_all) AS t_t FROM bucketed, totals GROUP BY b)),
weights AS (SELECT d, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM bucketed JOIN gains USING (b) WHERE NOT target GROUP BY d),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                    / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (d) WHERE NOT target),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id NULLS FIRST) AS r,
         5 * count(*) FILTER (n_words >= 20) OVER () // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= drawn THEN r END AS rank FROM ordered""",
    "op12_spelling_variants": r"""
WITH RECURSIVE
pieces AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents),
counted AS (SELECT id, run, id || ':' || run AS key, count(*) AS k FROM pieces GROUP BY id, run),
crc_keys AS (SELECT DISTINCT key FROM counted),
""" + CRC32.strip() + r""",
made AS (
  SELECT k, CASE WHEN crc % 97 = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word
  FROM counted JOIN crc USING (key)),
words AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) AS u(i)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * w.n THEN top END AS form_n,
         CASE WHEN top >= 2 * w.n THEN (SELECT min(other) FROM near x WHERE x.word = w.word AND x.n = top) END AS form
  FROM words w LEFT JOIN best USING (word)),
way AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT way.word, way.next, f.form FROM way JOIN formed f ON f.word = way.next)
SELECT f.word, f.form, way.at AS root, f.n, f.n_near, f.form_n::BIGINT AS form_n
FROM formed f JOIN way ON way.word = f.word AND way.next IS NULL""",
}
