"""Registered queries of the operators: each applies one, with production
parameters, to the whole of its table, and ``ORACLES`` has the same in SQL
where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logwright.llm import bpe, exact_dedup, line_dedup, lm, mixing, quality, sharding, simhash, substring_dedup, warc
from logwright.llm.common import table


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of SimHash fingerprints at most four bits apart."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a mixture of sources, at the least budget that takes every
    document, with no source repeated more than twice as often as another."""
    return mixing.mix(table(spark, sf_dir, "documents"), entropy_share=0.98, max_repeats=2.0)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards of nearly equal bytes."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates; the largest doc_id stays."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 characters in three documents stay in the largest only."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=20, least_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, log perplexity and verdict of each document."""
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of each text by counts and by the network."""
    return lm.score(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each text and the text they decode to, as digests."""
    tokens = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks_path())
    back = bpe.decode(tokens, ranks_path())
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words stay in the smallest doc_id only."""
    kept = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through the index."""
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_mixing, op3_sharding, op4_exact_dedup, op5_line_dedup, op6_quality, op7_lm_score, op8_bpe, op9_substring_dedup, op10_warc)
}

_LINES = """
WITH numbered AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM numbered
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split
), often AS (
  SELECT k, max(doc_id) AS winner FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3
), marked AS (
  SELECT r, doc_id, i, line, winner IS NOT NULL AND winner IS DISTINCT FROM doc_id AS gone FROM keyed LEFT JOIN often USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

_WINDOWS = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), word AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split
), start AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM split)
), again AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) < doc_id AS seen FROM start
), covered AS (
  SELECT doc_id, w, i, coalesce(bool_or(seen) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
  FROM word LEFT JOIN again USING (doc_id, i)
), judged AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM covered GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN judged USING (doc_id)
"""

#: Five hex digits of a digest are four of base32.
_ARCHIVED = """
WITH payload AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), digested AS (
  SELECT page_id, body, sha1(body) AS hex FROM payload
), based AS (
  SELECT page_id, body, list_aggregate(list_transform(range(32), lambda n:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + (n // 4) * 5, 5))::INTEGER >> (15 - 5 * (n % 4))) & 31)::INTEGER, 1)
  ), 'string_agg', '') AS digest FROM digested
), first AS (
  SELECT *, min(page_id) OVER (PARTITION BY body) AS response FROM based
)
SELECT page_id, strlen(body) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, nullif(response, page_id) AS refers_to
FROM first
"""

ORACLES: dict[str, str] = {
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op5_line_dedup": _LINES,
    "op9_substring_dedup": _WINDOWS,
    "op10_warc": _ARCHIVED,
}
