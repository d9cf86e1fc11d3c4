"""The operators over the test tables, with production parameters and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm import (
    conversations, decontaminate, fingerprint, language_id, lexical, license_scan, line_dedup,
    lm_scoring, ngram_join, packing, quality_rules, sharding, url_filters,
)
from panelwright.llm.sql import SQL

RULES = (
    url_filters.UrlRule("org", "/", "allow"),
    url_filters.UrlRule("example.org", "/es/", "block"),
    url_filters.UrlRule("example.org", "/en/1", "block"),
    url_filters.UrlRule("com", "/fr/", "allow"),
    url_filters.UrlRule("com", "/de/", "block"),
)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """File of a public tokenizer that the environment offers."""
    import public_tokenizers
    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality(documents(spark, sf_dir))
    return found.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(documents(spark, sf_dir), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    model = language_id.train(docs.filter(~F.col("held_out")))
    return language_id.identify(docs, model, ["doc_id", "held_out"])


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.kept_lines(documents(spark, sf_dir))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"),
                       F.col("_n_dropped").alias("n_dropped"),
                       F.sha2(F.col("_kept"), 256).alias("kept_sha256"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/thousand/id``; short texts stand for licence files."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    files = documents(spark, sf_dir).withColumn("path", F.concat_ws(
        "/", part("source"), part("lang"), F.floor(F.col("doc_id") / 1000).cast("string"),
        part("doc_id")))
    return license_scan.scan(files, ["doc_id"], F.coalesce(
        F.char_length("text") <= 200, F.lit(False)))


def lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scored(documents(spark, sf_dir), tokenizer_path())


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(documents(spark, sf_dir),
                                       spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("digest")


def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair_report(conversations.damaged(rows), rows)


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.next_likeness(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality,
    "op2_ngram_jaccard_join": ngram,
    "op3_sharding": shards,
    "op4_language_id": language,
    "op5_line_dedup": lines,
    "op6_packing": packed,
    "op7_url_filters": urls,
    "op8_license_scans": licences,
    "op9_lm_scoring": lm,
    "op10_benchmark_decontamination": leaks,
    "op11_conversation_repair": repairs,
    "op12_lexical_search": search,
    "op13_fingerprints": fingerprints,
}

ORACLE_SQL: dict[str, str] = SQL
