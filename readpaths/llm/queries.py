"""Registered queries of the subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readpaths.llm import bpe_queue, deleted_interpolation, gnat, html_tree, merkle, quality_kn, raking, simhash_ring, substring_dedup, token_frames, url_markov, vptree, warc
from readpaths.llm.shared import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(_table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_kn.judge(_table(spark, sf_dir, "documents"), whole=True)


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe_queue.encode(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return bpe_queue.decode(ids, vocabulary, public_tokenizers.PATTERN).drop("ids")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.neighbours(_table(spark, sf_dir, "embeddings"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score(_table(spark, sf_dir, "documents"))


# fixed values: the rules of the URL query
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_markov.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, languages and topics raked to tempered shares; half of all tokens drawn."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    text = F.col("text")
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": raking.topic(text)}
    return raking.mix(docs, dims, raking.words(text), budget_share=0.5).select("doc_id", "mix.*")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ring.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-frames")
    token_frames.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_frames.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec, label = F.col("vec_id"), F.col("label").cast("long")
    changed = F.when(vec % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    return gnat.hard_negatives(_table(spark, sf_dir, "embeddings"), changed, F.col("id") % 100 == 0, positives=5, negatives=5, least_percent=80)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh checksum's row is tampered with (one more in ``n_chars``) before its root is folded again."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    other = merkle.leaf([F.try_add(F.col(f).cast("long"), F.lit(1)) if f == "n_chars" else F.col(f) for f in fields])
    made = merkle.manifest(_table(spark, sf_dir, "documents"), fields, "doc_id", "lang", carry={"changed": F.when(tampered, F.unhex(other))})
    text = lambda c: F.lower(F.hex(c))
    folded = merkle.fold(text(F.coalesce("changed", "leaf")), F.col("proof"))
    named = [text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    out = made.select("doc_id", *named, merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_warc_transactions": op4_warc_transactions,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_url_filters": op8_url_filters,
        "op9_mixing_sources": op9_mixing_sources,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_token_frames": op11_token_frames,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = f"""
WITH words AS (SELECT doc_id, {WORDS} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM words WHERE len(ws) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS lowest FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p
  FROM windows JOIN firsts USING (k) WHERE doc_id > lowest
),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM words),
kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS text, count(*) AS n
  FROM placed a LEFT JOIN gone g ON g.doc_id = a.doc_id AND g.p = a.p WHERE g.p IS NULL GROUP BY a.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id"""

_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {1 + 5 * (i // 4)}, 5) AS BIGINT) >> {15 - 5 * (i % 4)}) & 31 AS INTEGER) + 1, 1)"
    for i in range(32))
OP4_SQL = f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
ranked AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM hashed)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM ranked"""


OP12_SQL = """
WITH good AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM good a JOIN good b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 100 = 0
),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5"""


def _leaf(n_chars: str) -> str:
    part = "coalesce(strlen({0}) || ':' || {0}, '-')"
    return "sha256(" + " || ".join(part.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# the checksum bit by bit: SQL has no function for it
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))))"""
OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS own,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM documents
),
nodes AS (
  SELECT lang, 0 AS height, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, height + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lang, height, idx // 2, n
),
langs AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
),
over_nodes AS (
  SELECT 0 AS height, idx, n, subroot AS h FROM langs
  UNION ALL
  SELECT height + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM over_nodes WHERE n > 1 GROUP BY height, idx // 2, n
),
walk AS (
  SELECT l.doc_id, l.lang, l.leaf, 0 AS upper, 0 AS height, l.idx, l.n, l.own AS folded, '' AS proof FROM leaves l
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.upper, w.height + 1, w.idx // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.idx % 2 = 1 THEN s.h || w.folded ELSE w.folded || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
  FROM walk w LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM w.lang AND s.height = w.height AND s.idx = xor(w.idx, 1)
  WHERE w.n > 1
),
over_walk AS (
  SELECT w.doc_id, w.lang, w.leaf, 0 AS height, g.subroot, g.idx, g.n, w.folded, w.proof
  FROM walk w JOIN langs g ON g.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.height + 1, w.subroot, w.idx // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.idx % 2 = 1 THEN s.h || w.folded ELSE w.folded || coalesce(s.h, '') END), w.proof || coalesce(s.h, '')
  FROM over_walk w LEFT JOIN over_nodes s ON s.height = w.height AND s.idx = xor(w.idx, 1)
  WHERE w.n > 1
),
top AS (SELECT h AS root FROM over_nodes WHERE n = 1)
SELECT doc_id, leaf, subroot, (SELECT root FROM top) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT root FROM top) AS verified
FROM over_walk WHERE n = 1"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express the operator: the others rest on hashes, models and codes that SQL lacks."""
    return {"op2_substring_dedup": OP2_SQL, "op4_warc_transactions": OP4_SQL, "op12_hard_negatives": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
