"""Votes of repeated predictions and the majority class of an item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_votes(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, item_id, y_pred, votes, first_rep): how often and since when an item got a class."""
    return pred.groupBy(*by, "item_id", "y_pred").agg(
        F.count(F.lit(1)).alias("votes"), F.min("rep").alias("first_rep")
    )


def majority_vote(votes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class with most votes; a tie goes to the class voted first. Agreement is its share."""
    best = F.max(F.struct("votes", (-F.col("first_rep")).alias("_since"), "y_pred"))
    out = votes.groupBy(*by, "item_id").agg(best.alias("_b"), F.sum("votes").alias("total_votes"))
    return out.select(
        *by,
        "item_id",
        F.col("_b.y_pred").alias("class"),
        F.col("_b.votes").alias("votes"),
        "total_votes",
        F.when(F.col("total_votes") > 0, F.col("_b.votes") / F.col("total_votes")).alias("agreement"),
    )


def vote_agreement(votes: DataFrame) -> DataFrame:
    """Mean over items of the largest vote share; items without votes are skipped, none gives 0."""
    bad = F.when(F.col("votes") < 0, F.raise_error(F.lit("vote counts must be >= 0")).cast("bigint"))
    items = votes.withColumn("votes", F.coalesce(bad, F.col("votes"))).groupBy("item_id").agg(
        F.max("votes").alias("m"), F.sum("votes").alias("t")
    )
    return items.where("t > 0").agg(F.coalesce(F.avg(F.col("m") / F.col("t")), F.lit(0.0)).alias("agreement"))


def vote_map(votes: DataFrame) -> DataFrame:
    """One row per item with its class -> votes map; at most one entry per class."""
    entry = F.array_sort(F.collect_list(F.struct("y_pred", "votes")))
    return votes.groupBy("item_id").agg(F.map_from_entries(entry).alias("votes"))
