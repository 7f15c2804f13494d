"""Drift between a hand-kept leaf -> class table and the categories of an annotation set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER = "other"


def _leaves(categories: DataFrame) -> DataFrame:
    name = F.trim(F.coalesce("name", F.lit("")))
    group = F.trim(F.coalesce("supercategory", F.lit("")))
    return categories.select(F.col("id"), name.alias("leaf"), group.alias("supercategory")).where("leaf <> ''")


def presence_drift(taxonomy: DataFrame, categories: DataFrame) -> DataFrame:
    """(kind, leaf) for leaves that only one side knows."""
    ours, theirs = taxonomy.select("leaf").distinct(), _leaves(categories).select("leaf").distinct()
    left = theirs.join(ours, "leaf", "left_anti").select(F.lit("missing_in_taxonomy").alias("kind"), "leaf")
    right = ours.join(theirs, "leaf", "left_anti").select(F.lit("missing_in_categories").alias("kind"), "leaf")
    return left.unionByName(right)


def _classes(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select("coarse").where((F.col("coarse") != "") & (F.col("coarse") != OTHER)).distinct()


def coarse_mismatches(taxonomy: DataFrame, categories: DataFrame) -> DataFrame:
    """Leaves whose class is not the one their supercategory implies (its name if a class, else other)."""
    implied = _classes(taxonomy).select(F.col("coarse").alias("implied"))
    low = F.lower("supercategory")
    joined = taxonomy.join(_leaves(categories), "leaf").join(implied, low == F.col("implied"), "left")
    out = joined.withColumn("implied", F.coalesce("implied", F.lit(OTHER)))
    return out.where(F.col("coarse") != F.col("implied")).select("leaf", "coarse", "supercategory", "implied")


def group_inconsistency(taxonomy: DataFrame, categories: DataFrame) -> DataFrame:
    """Leaves that differ from the commonest class of their supercategory (tie: class of the smallest id)."""
    joined = taxonomy.join(_leaves(categories), "leaf")
    counts = joined.groupBy("supercategory", "coarse").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    best = counts.groupBy("supercategory").agg(
        F.max_by("coarse", F.struct("n", -F.col("first"))).alias("consensus"), F.count(F.lit(1)).alias("kinds")
    )
    mixed = joined.join(best.where("kinds > 1"), "supercategory")
    return mixed.where(F.col("coarse") != F.col("consensus")).select("leaf", "coarse", "supercategory", "consensus")


def taxonomy_drift(taxonomy: DataFrame, categories: DataFrame) -> DataFrame:
    """(kind, severity, leaf, have, expected): presence is hard drift, the other two are soft."""
    none = F.lit(None).cast("string")
    hard = presence_drift(taxonomy, categories).select(
        "kind", F.lit("hard").alias("severity"), "leaf", none.alias("have"), none.alias("expected")
    )

    def soft(df: DataFrame, kind: str, expected: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("kind"), F.lit("soft").alias("severity"), "leaf",
            F.col("coarse").alias("have"), F.col(expected).alias("expected"),
        )

    return hard.unionByName(soft(coarse_mismatches(taxonomy, categories), "coarse_mismatch", "implied")).unionByName(
        soft(group_inconsistency(taxonomy, categories), "group_inconsistency", "consensus")
    )


def drift_verdict(drift: DataFrame) -> DataFrame:
    hard = F.count_if(F.col("severity") == "hard")
    soft = F.count_if(F.col("severity") == "soft")
    return drift.agg(hard.alias("n_hard"), soft.alias("n_soft"), (hard == 0).alias("ok"))
