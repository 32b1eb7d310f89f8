"""The numbered queries: each applies its operator to the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, hard_negatives, hidden_markov, line_dedup, merkle, pieces, private_data, simhash, suffix_dedup, token_shards, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score_documents(_table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find_private(_table(spark, sf_dir, "documents")).drop("found")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found).drop("spans")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url", "payload")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels"))).drop("start", "end")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).drop("file")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.remove_repeated(_table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed_chunks", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls are part of a leaf; rows that share a doc_id are leaves of their own; an empty table gives no rows."""
    docs = _table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.without_line_feeds(docs))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without label, vector or finite components take no part; rows that share a vec_id count once; an empty table gives no rows."""
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty ones; equal rows that repeat count once; an empty table gives no rows."""
    clean = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_hidden_markov": op2_hidden_markov,
    "op3_token_shards": op3_token_shards,
    "op4_private_data": op4_private_data,
    "op5_decontamination": op5_decontamination,
    "op6_warc": op6_warc,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle": op11_merkle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + least(10, len(w)) - 1) AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS keeper FROM p),
g AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (bits::BIGINT % 32 + 1)::INT, 1), '' ORDER BY k) AS digest
      FROM (SELECT page_id, k,
                   -- five bits from the bit position 5k on, out of the two hex digits or three around them
                   (('0x' || substr(x || '000', (5 * k) // 4 + 1, 3))::BIGINT >> (7 - (5 * k) % 4)) AS bits
            FROM s, generate_series(0, 31) AS t(k)) GROUP BY page_id)
SELECT s.page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN s.page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN s.page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM s JOIN g ON s.page_id = g.page_id
""",
    "op9_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
n AS (SELECT doc_id, length(body) AS n_chars, regexp_replace(body, '[\x20\x09-\x0D]', '', 'g') AS norm FROM t)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
""",
    "op10_line_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, unnest(string_split(replace(replace(replace(replace(text, chr(10), chr(10) || chr(1)), '. ', '. ' || chr(1)), '! ', '! ' || chr(1)), '? ', '? ' || chr(1)), chr(1))) AS raw,
             generate_subscripts(string_split(replace(replace(replace(replace(text, chr(10), chr(10) || chr(1)), '. ', '. ' || chr(1)), '! ', '! ' || chr(1)), '? ', '? ' || chr(1)), chr(1)), 1) AS i FROM d),
v AS (SELECT doc_id, i, unnest(x) AS raw, generate_subscripts(x, 1) AS j
      FROM (SELECT doc_id, i, CASE WHEN length(raw) > 240 THEN string_split(replace(raw, ', ', ', ' || chr(1)), chr(1)) ELSE [raw] END AS x FROM u)),
k AS (SELECT doc_id, i, j, raw, trim(raw, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS key FROM v),
l AS (SELECT *, key <> '' AS filled, count(*) FILTER (WHERE key <> '') OVER (PARTITION BY doc_id ORDER BY i, j) AS pos FROM k),
w AS (SELECT doc_id, pos, key, lead(key) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM l WHERE filled),
p AS (SELECT doc_id, pos, key, next, row_number() OVER (PARTITION BY key, next ORDER BY doc_id, pos) AS rn FROM w WHERE next IS NOT NULL),
broken AS (SELECT DISTINCT f.key, f.next FROM p f JOIN p o ON o.doc_id = f.doc_id AND o.pos IN (f.pos - 1, f.pos + 1) AND o.rn > 1 WHERE f.rn = 1),
stay AS (SELECT doc_id, unnest([pos, pos + 1]) AS pos FROM p JOIN broken USING (key, next) WHERE rn = 2),
g AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS pos FROM p WHERE rn > 1 EXCEPT SELECT doc_id, pos FROM stay),
m AS (SELECT l.*, filled AND g.pos IS NOT NULL AS gone FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos),
f AS (SELECT doc_id, pos, gone, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM m WHERE filled),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone AND NOT before) AS n_removed_chunks, count(*) FILTER (WHERE gone) AS n_removed_lines FROM f GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(string_agg(raw, '' ORDER BY i, j) FILTER (WHERE NOT gone), '') AS clean FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed_chunks, 0) AS n_removed_chunks, coalesce(n_removed_lines, 0) AS n_removed_lines, sha256(clean) AS clean_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
""",
    "op12_hard_negatives": r"""
WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM q AS a JOIN q AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT s.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY s.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
      FROM s JOIN p ON s.anchor_id = p.anchor_id WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
""",
}
