"""The queries of this subpackage over the tables of a folder, and their SQL."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, chat, debruijn, embeddings, langmix, leaderboard, lines, neardup, packing, quality, toxicity, voronoi


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.links(_table(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents"))


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = toxicity.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "p_low_quality", "p_toxic", "toxic")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return voronoi.negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmix.identified(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op13_leaderboard_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.changes(leaderboard.enriched(*(_table(spark, sf_dir, t) for t in ("sale_lines", "vendors", "items"))))


QUERIES = {f.__name__: f for f in (
    op1_embedding_links, op2_byte_bpe, op3_perspectives, op4_packing, op5_quality_rules, op6_substring_dedup, op7_line_dedup, op8_near_duplicates, op9_brown_lm, op10_toxicity,
    op11_hard_negatives, op12_language_mixtures, op13_leaderboard_changes,
)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL = {
    "op13_leaderboard_changes": """
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab
), k AS (
  SELECT *, coalesce(sale_id::VARCHAR, '') || ',' || coalesce(item_id::VARCHAR, '') || ',' || coalesce(vendor_id::VARCHAR, '')
            || ',' || coalesce(line_no::VARCHAR, '') AS key FROM sale_lines
), h AS (
  SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::BIGINT)),
         lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM k, t
), s AS (
  SELECT *, coalesce(date_diff('day', DATE '1970-01-01', shipped_at::DATE), 19723 + h % 150)::BIGINT AS s FROM h
), a AS (
  SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM s
), b AS (
  SELECT *, least(10, greatest(1, 1 + floor((a - 19723) * 10 / 180)))::INT AS batch FROM a
), m AS (
  SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM b GROUP BY batch
), v AS (SELECT vendor_id, min(nation_id) AS nation_id FROM vendors GROUP BY ALL), i AS (
  SELECT item_id, min(floor(100 * price + 0.5)) AS price FROM items GROUP BY ALL
), d AS (
  SELECT v.nation_id, b.item_id, b.a, sum(CASE WHEN flag = 'returned' THEN -1 ELSE 1 END
         * coalesce(floor(100 * amount + 0.5), quantity * price, 0))::BIGINT AS cents
  FROM b JOIN m ON b.batch = m.batch JOIN v ON b.vendor_id = v.vendor_id JOIN i ON b.item_id = i.item_id
  WHERE v.nation_id IS NOT NULL AND (latest IS NULL OR s + 3 >= latest) GROUP BY ALL
), g AS (
  SELECT n.nation_id, n.a, x.item_id, sum(coalesce(d.cents, 0)) OVER (PARTITION BY n.nation_id, x.item_id ORDER BY n.a) AS revenue
  FROM (SELECT DISTINCT nation_id, a FROM d) AS n JOIN (SELECT DISTINCT nation_id, item_id FROM d) AS x ON n.nation_id = x.nation_id
  LEFT JOIN d ON d.nation_id = n.nation_id AND d.a = n.a AND d.item_id = x.item_id
), p AS (
  SELECT *, CASE WHEN revenue > 0 THEN row_number() OVER (PARTITION BY nation_id, a ORDER BY revenue > 0 DESC, revenue DESC, item_id) END AS place FROM g
), r AS (
  SELECT nation_id, a, item_id, revenue, CASE WHEN place <= 10 THEN place END AS new_rank FROM p
), o AS (SELECT *, lag(new_rank) OVER (PARTITION BY nation_id, item_id ORDER BY a) AS old_rank FROM r)
SELECT nation_id, a::BIGINT AS arrival_day, item_id, least(10, greatest(1, 1 + floor((a - 19723) * 10 / 180)))::INT AS batch,
       CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change,
       old_rank::INT AS old_rank, new_rank::INT AS new_rank, revenue::BIGINT AS revenue
FROM o WHERE old_rank IS DISTINCT FROM new_rank""",
    "op11_hard_negatives": """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id))::INT AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
QUALIFY rank <= 3""",
    "op3_perspectives": """
WITH r AS (
  SELECT DISTINCT conv_id, floor(turn / 64)::BIGINT AS part, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (SELECT DISTINCT conv_id, role AS perspective FROM r WHERE role <> 'system'), h AS (
  SELECT r.*, perspective, CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
         ELSE '<|user:' || role || '|>' END || chr(10) AS head
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, length(head) + coalesce(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, perspective, part
         ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM h
)
SELECT conv_id, perspective, part, count(*) AS n_messages,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered,
       coalesce(string_agg(start::BIGINT || '-' || (start + length(text) + 7)::BIGINT, ' ' ORDER BY turn, role, text)
                FILTER (role = perspective), '') AS mask
FROM o GROUP BY ALL""",
    "op6_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d)
), r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS m FROM g) WHERE m < doc_id), c AS (
  SELECT DISTINCT doc_id, i + j AS i FROM r, (SELECT unnest(generate_series(0, 12)) AS j)
), x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d), s AS (
  SELECT x.doc_id, count(*) AS n_words, count(c.i) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY x.i) FILTER (c.i IS NULL), '') AS t
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id""",
    "op7_line_dedup": """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), w AS (
  SELECT doc_id, p, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS w
  FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) AS p FROM l)
), n AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM w WHERE regexp_matches(w, '[^\\x20\\x09-\\x0D]')
), c AS (SELECT DISTINCT doc_id, p + j AS p FROM n, (VALUES (0), (1), (2)) AS v(j) WHERE k > 1), x AS (
  SELECT l.doc_id, t.i AS i, t.x AS x FROM l, (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i) AS t
), s AS (
  SELECT x.doc_id, string_agg(x, chr(10) ORDER BY i) FILTER (c.p IS NULL) AS text, count(c.p) AS n_removed
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.p GROUP BY x.doc_id
)
SELECT l.doc_id, coalesce(s.text, '') AS text, len(l)::BIGINT AS n_lines, s.n_removed FROM l JOIN s ON l.doc_id = s.doc_id""",
    "op5_quality_rules": f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) AS v(j) GROUP BY doc_id
), s AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]'))) AS n_lettered, length(t) AS n_chars,
         length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits, len(regexp_extract_all(t, '(?:\\.{{3}}|\\x{{2026}})(?:\\n|\\z)')) AS n_ellipses,
         len(regexp_extract_all(t, '(?:\\A|\\n)[ \\t]*[-*\\x{{2022}}]')) AS n_bullets, len(regexp_extract_all(t, 'https?://')) AS n_links
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.1 * n_words
            OR (n_dup_lines > 0.5 * n_lines AND n_lines >= 4) OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR n_lettered < 0.8 * n_words OR n_digits > 0.2 * n_chars OR (n_ellipses > 0.3 * n_lines AND n_lines >= 4)
            OR (n_bullets > 0.9 * n_lines AND n_lines >= 4) OR n_links > 0.2 * n_words) AS kept
FROM s""",
}
