"""From raw documents to packed training sequences.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and works on all that
the one before kept. All but the last return the columns they were given. ``run`` writes what
each stage returns to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltmark.llm import classifier, lines, ngram_join, packing, spans
from siltmark.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled ones do not vote out."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of three-line windows that also start earlier."""
    return lines.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words under 20-word windows that also start earlier."""
    return spans.without_repeats(docs, window=20)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    from siltmark.llm.queries import tokenizer

    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", pack),
]

#: The classifier cannot be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
