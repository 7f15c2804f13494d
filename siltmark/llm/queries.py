"""The text operators over the driver's tables, one query for each."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from siltmark.llm import bpe, classifier, conversation_trie, fingerprint, lines, ngram_join, packing, periodic_runs, quality_rules, spans, token_counts, token_files, url_rules
from siltmark.llm.common import table


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; ``SILTMARK_TOKENIZERS`` names another folder."""
    folder = os.environ.get("SILTMARK_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf, "documents"), size=3, percent=90)


def op2_bpe_encode_decode(spark: SparkSession, sf: str) -> DataFrame:
    made = bpe.encode_decode(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder, written = token_files.write_tokens(table(spark, sf, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)
    return token_files.read_tokens(spark, folder, written).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.compare_versions(table(spark, sf, "documents"))


def op5_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return classifier.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf, "documents"))


def op7_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_rules.judge(table(spark, sf, "pages"))


def op8_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    made = spans.remove_repeats(table(spark, sf, "documents"), window=20)
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.remove_repeated_lines(table(spark, sf, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


def op11_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    conv = F.col("conv_id")
    return conversation_trie.prefix_trie(table(spark, sf, "conversations"), base=conv - conv % 5, head=F.crc32(conv.cast("string")) % 9, most_head=8)


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(table(spark, sf, "documents"), periodic_runs.repeated_tail))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_bpe_encode_decode, op3_token_files, op4_document_fingerprints, op5_quality_classifier,
        op6_quality_rules, op7_url_filters, op8_substring_dedup, op9_line_dedup, op10_best_fit_packing, op11_token_counts, op12_conversation_trie, op13_periodic_runs,
    )
} | {"pipeline": corpus_pipeline.run}
