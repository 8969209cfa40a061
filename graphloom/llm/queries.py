"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import filter_audit, language, lexical, line_dedup, minhash, oracles, packing, pieces, quality, secret_scan, suffix_dedup, toxicity, trie_dedup, url_filter
from graphloom.llm.common import checkpoint, held_out, read_table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie_dedup.exact_groups(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.decisions(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.drop("text_mark").withColumn("kept_lines", F.array_join(F.col("kept_lines").cast("array<string>"), ","))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checkpoint(quality.features(read_table(spark, sf_dir, "documents"), "doc_id", "text", F.col("lang")))
    cutoffs = quality.calibrate(found, read_table(spark, sf_dir, "labels"), "doc_id", "quality")
    return quality.judge(found, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.learn_filter(docs.filter(~held_out(F.col("doc_id"))), "doc_id", "text", "lang")
    return language.identify(docs, model, "doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.learn(docs, "doc_id", "text"), "doc_id", "text")
    counts = [F.size(F.filter("base", lambda s: s["order"] == F.lit(i))).cast("long").alias(f"n_{kind}") for i, (kind, _, _) in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.BagModel:
    labels = read_table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    return toxicity.learn(docs, labels, "doc_id", "text", "toxic")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), "doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_documents(read_table(spark, sf_dir, "documents"), PIECE_MODEL, "doc_id", "text")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes_covered"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), BYTE_TOKENIZER, "doc_id", "text")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), url_filter.contract_rules())


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return found.select("item_id", "rank", "doc_id", "score")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "doc_id", "text", "source", "quality", "toxic")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_line_dedup, op3_near_dedup, op4_quality, op5_language_id, op6_secret_scan, op7_toxicity, op8_sentencepiece, op9_packing, op10_url_filter, op11_lexical_search, op12_suffix_dedup, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": oracles.OP1, "op2_line_dedup": oracles.OP2, "op10_url_filter": oracles.OP10, "op11_lexical_search": oracles.OP11, "op12_suffix_dedup": oracles.OP12, "op13_filter_audit": oracles.OP13}
