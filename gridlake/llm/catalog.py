"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import (
    checks,
    decontaminate,
    exact_dedup,
    fingerprint,
    html_extract,
    licenses,
    mixing,
    near_dedup,
    quality,
    secret_scan,
    token_alignment,
    token_counts,
    token_files,
    whitening,
)
from gridlake.llm.common import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_text(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.with_edits(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def byte_bpe_blocks(documents: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.write_blocks(documents, lambda: token_files.word_encoder(path))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.ids_crc32(token_files.read_blocks(byte_bpe_blocks(read(spark, sf_dir, "documents"))))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.prefix_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_alignment.alignment_scores(read(spark, sf_dir, "documents"), *paths)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_secret_scan": op2_secret_scan,
    "op3_html_extract": op3_html_extract,
    "op4_fingerprint": op4_fingerprint,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_token_files": op6_token_files,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_mix": op9_mix,
    "op10_licenses": op10_licenses,
    "op11_whitening": op11_whitening,
    "op12_token_alignment": op12_token_alignment,
    "op13_exact_dedup": op13_exact_dedup,
}

SQL = {"op1_decontaminate": checks.DECONTAMINATE, "op9_mix": checks.MIX, "op13_exact_dedup": checks.EXACT_DEDUP}
