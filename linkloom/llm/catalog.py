"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import oracles as oracles_of
from linkloom.llm import conversations, crosspolytope, decontaminate, language, licenses, mixing, nearcopies, periodic, quality, substrings, urlfilter, warc, wrappers
from linkloom.session import durable

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summarise(decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.join(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(_table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = durable(mixing.measure(_table(spark, sf_dir, "documents").drop("n_chars")).drop("text"))
    shown = [F.round(c, 9).alias(c) if c in ("weight", "probability") else c for c in ("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled")]
    return mixing.sample(measured).select(*shown)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]
    return quality.label(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(licenses.spans(licenses.votes(_table(spark, sf_dir, "documents"))))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.round_trip(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.cut(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.nearest(_table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversations.summarise(conversations.damage(rows), rows)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find(periodic.with_planted_runs(_table(spark, sf_dir, "documents"))))


_QUERIES: tuple[Query, ...] = (op1_decontamination, op2_url_filters, op3_ngram_jaccard_join, op4_html_extraction, op5_mixing, op6_quality_rules, op7_license_scan, op8_language_id, op9_warc, op10_substring_dedup, op11_nearest_neighbours, op12_conversation_repair, op13_periodic_runs)
# DuckDB has no SHA-1 in base32, but the bits can be cut out of its hexadecimal digest.
_WARC_SQL = """WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digests AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(sha1(payload), CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest FROM payloads),
firsts AS (SELECT payload_digest, max(page_id) AS first FROM digests GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM digests JOIN firsts USING (payload_digest)"""

_ORACLES: dict[str, str] = {
    "op1_decontamination": oracles_of.decontamination(),
    "op2_url_filters": urlfilter.oracle(),
    "op3_ngram_jaccard_join": oracles_of.similarity_join(),
    "op5_mixing": mixing.oracle(),
    "op6_quality_rules": oracles_of.quality_rules(),
    "op7_license_scan": oracles_of.license_scan(),
    "op9_warc": _WARC_SQL,
    "op10_substring_dedup": oracles_of.substring_dedup(),
    "op12_conversation_repair": oracles_of.conversation_repair(),
}


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _QUERIES}


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
