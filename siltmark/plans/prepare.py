"""Preparation of a split for a small model, fitted on train rows only and recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ANGLE_WINDOW
from ..operators import features, information, selection, splits

MAX_TRAIN = 128


def prepare_split(
    split: DataFrame, budget: int, seed: int = 42, max_train: int = 48, bins: int = 8, capped_only: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows, record) for every repeat of a split.

    Every train and test row is kept. ``in_fit`` marks the train rows for the small fit,
    at most ``max_train`` of a repeat with two of every class among them. Features are
    ranked by information on all train rows, best first, and scaled to the angle window
    by the train range, unclipped. The record has one row per repeat: what was chosen,
    the scores, the range, how many rows these come from, the population of the fit.

    ``capped_only`` leaves out the other train rows, from the ranking and the range too.
    """
    if not 2 <= max_train <= MAX_TRAIN:
        raise ValueError(f"the cap on train rows must be 2..{MAX_TRAIN}")
    train = features.train_rows(split)
    fit = splits.cap_rows_stratified(train, max_train, seed)
    if capped_only:
        train = fit.withColumn("in_fit", F.lit(True))
    else:
        # at most 128 ids per repeat
        ids = fit.select("rep", "row_id", F.lit(True).alias("_fit")).distinct()
        train = train.join(F.broadcast(ids), ["rep", "row_id"], "left").withColumn("in_fit", F.coalesce("_fit", F.lit(False))).drop("_fit")
    taken = train.unionByName(split.where("is_test").withColumn("in_fit", F.lit(False))).persist()
    width = taken.select(F.max(F.size("features"))).collect()[0][0] or 0
    if not 2 <= budget <= width:
        taken.unpersist()
        raise ValueError(f"budget must be 2..{width}")
    binned = features.quantile_bins(features.train_rows(taken), bins)
    mi = information.mi_label(binned).withColumn("score", F.round("mi", 12))
    ranked = selection.top_k(mi, "score", budget)
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "f", "mi")))
    picked = ranked.groupBy("rep").agg(by_rank.alias("p")).select(
        "rep", F.col("p.f").alias("selected"), F.col("p.mi").alias("scores")
    )
    # at most one row per repeat and one entry per feature in it
    chosen = taken.join(F.broadcast(picked), "rep").withColumn(
        "features", F.transform("selected", lambda i: F.col("features")[i].cast("double"))
    )
    rows = features.minmax_fit_train(chosen, *ANGLE_WINDOW).drop("scores")
    limits = features.per_rep_arrays(features.ranges_train(chosen), "lo", "hi")
    side = lambda which: F.array_sort(F.collect_list(F.when(F.col(which), F.struct("row_id", "grp"))))
    population = taken.groupBy("rep").agg(F.count_if(~F.col("is_test")).alias("n_ranked"), side("in_fit").alias("train"), side("is_test").alias("test"))
    record = (
        picked.join(limits, "rep")
        .join(population, "rep")
        .select(
            "rep", "selected", "scores", F.col("lo").alias("range_min"), F.col("hi").alias("range_max"),
            F.array(*[F.lit(v) for v in ANGLE_WINDOW]).alias("angle_window"), F.lit(False).alias("clipped"),
            F.lit(seed).alias("seed"), F.lit("binned").alias("mi_estimator"), "n_ranked",
            F.col("train.row_id").alias("ids_train"), F.col("train.grp").alias("groups_train"),
            F.col("test.row_id").alias("ids_test"), F.col("test.grp").alias("groups_test"),
        )
    )
    return rows, record
