"""Registry of the training-data queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, bpe, compact, decontaminate, jaccard, licenses, merkle, pieces, quality, suffixes, urls, warc, wrappers
from . import sql as oracle


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, _read(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrappers.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.selectExpr("row.page_id page_id", "row.url url", "text", "cast(char_length(text) as bigint) n_chars")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.near_passages(_read(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_read(spark, sf_dir, "documents").select("doc_id", "text"), licenses.BASE)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(_read(spark, sf_dir, "pages").select("page_id", "url")).select("row.page_id", "host", "path", "rule", "verdict")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(suffixes.repeated_passages(_read(spark, sf_dir, "documents")))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256")


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.cross_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_html_extraction, op3_quality_rules, op4_substring_dedup, op5_license_scan, op6_warc, op7_url_filter, op8_ngram_jaccard, op9_byte_bpe, op10_suffix_dedup, op11_sentencepiece, op12_cross_tokenizer, op13_merkle_manifest)
}
ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL
