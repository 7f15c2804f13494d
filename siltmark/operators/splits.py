"""Repeated group-aware splits, seeded row caps and the checks on a split.

A split is never stored per row and joined back: it is one cutoff hash per
repeat, so assigning rows is a per-row comparison that neither shuffles the rows
nor suffers from a group that holds a large share of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import seeded_hash
from ..functions.joins import small
from ..functions.ranking import hash_cutoffs, repeat_cutoffs, repeat_ties


def _rep_array(reps: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(r)) for r in reps])


def fan_out(df: DataFrame, reps: Sequence[int]) -> DataFrame:
    """One copy of every row per repeat, generated in place."""
    return df.withColumn("rep", F.explode(_rep_array(reps)))


def split_cutoffs(df: DataFrame, group: str, reps: Sequence[int], fraction: float, seed: int) -> dict[int, str]:
    """Per repeat the hash up to which a group is on the test side: the ceil(fraction x groups)-th smallest."""
    groups = df.select(F.col(group).alias("_g")).distinct().persist()  # every pass over the hashes would scan the rows again
    try:
        hashed = fan_out(groups, reps).withColumn("_hash", seeded_hash(F.col("rep") + F.lit(seed), F.col("_g")))
        return repeat_cutoffs(hashed, "_hash", lambda total: math.ceil(fraction * total))
    finally:
        groups.unpersist()


def group_split(
    df: DataFrame, group: str, reps: Sequence[int], fraction: float = 0.25, seed: int = 42
) -> DataFrame:
    """Every row once per repeat with ``rep`` and ``is_test``; no group is on both sides."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be inside (0, 1)")
    # one hash per repeat: computed once, then part of the plan, so that using the split needs no join
    cutoffs = split_cutoffs(df, group, reps, fraction, seed)
    copies = F.array(
        *[F.struct(F.lit(int(r)).alias("rep"), F.lit(cutoffs.get(r, "")).alias("_cutoff")) for r in reps]
    )
    rows = df.withColumn("_copy", F.explode(copies)).select(*df.columns, "_copy.rep", "_copy._cutoff")
    side = seeded_hash(F.col("rep") + F.lit(seed), F.col(group)) <= F.col("_cutoff")
    return rows.withColumn("is_test", F.coalesce(side, F.lit(False))).drop("_cutoff")


def group_masks(df: DataFrame, group: str, reps: Sequence[int], fraction: float = 0.25, seed: int = 42) -> DataFrame:
    """The same split as masks: every row once, ``train`` saying for each repeat in order whether the row is on its train side."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must be inside (0, 1)")
    cutoffs = split_cutoffs(df, group, reps, fraction, seed)
    sides = [~F.coalesce(seeded_hash(F.lit(int(r) + seed), F.col(group)) <= F.lit(cutoffs.get(r, "")), F.lit(False)) for r in reps]
    return df.withColumn("train", F.array(*sides))


def cap_rows(df: DataFrame, n: int, seed: int, row_id: str = "row_id", by: str = "rep") -> DataFrame:
    """At most n rows per repeat, chosen by a seeded hash of the id alone, so blind to the label.

    Where only some rows of the last id find room, a seeded hash of their columns decides.
    """
    hashed = df.withColumn("_hash", seeded_hash(F.col(by) + F.lit(seed), F.col(row_id)))
    ties = repeat_ties(hashed, "_hash", lambda total: n, by)
    chosen = hashed.where(_up_to({k: h for k, (h, _, _) in ties.items()}, by))
    short = {k: (h, wanted) for k, (h, wanted, copies) in ties.items() if wanted < copies}
    if not short:
        return chosen.drop("_hash")
    at = lambda i: F.try_element_at(F.create_map(*[F.lit(v) for k, x in short.items() for v in (k, x[i])]), F.col(by))
    tied = F.coalesce(F.col("_hash") == at(0), F.lit(False))
    # the bound by a literal is applied in every task before the rows of an id meet
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), *df.columns)))
    some = chosen.where(tied).withColumn("_place", place).where(F.col("_place") <= max(w for _, w in short.values()))
    some = some.where(F.col("_place") <= at(1)).drop("_place")
    return chosen.where(~tied).unionByName(some).drop("_hash")


def _up_to(cutoffs: dict[int, str], by: str) -> Column:
    if not cutoffs:
        return F.lit(False)
    table = F.create_map(*[F.lit(v) for item in cutoffs.items() for v in item])
    return F.coalesce(F.col("_hash") <= F.try_element_at(table, F.col(by)), F.lit(False))


def cap_rows_stratified(
    df: DataFrame, n: int, seed: int, row_id: str = "row_id", label: str = "label", by: str = "rep"
) -> DataFrame:
    """Like ``cap_rows``, but two rows of every class come first.

    Fails when a class has a single row or when n is under twice the number of classes.
    """
    hashed = df.withColumn("_hash", seeded_hash(F.col(by) + F.lit(seed), F.col(row_id)))
    pair = hash_cutoffs(hashed, [by, label], "_hash", F.lit(2))
    pair = pair.withColumn("_classes", F.count(F.lit(1)).over(Window.partitionBy(by)))
    pair = pair.withColumn(
        "_second",
        F.when(F.col("total") < 2, F.raise_error(F.lit("every class needs two training rows")).cast("string"))
        .when(F.col("_classes") * 2 > n, F.raise_error(F.lit("row cap is under twice the number of classes")).cast("string"))
        .otherwise(F.col("cutoff")),
    ).select(by, label, "_second", "_classes")
    marked = hashed.join(small(pair), [by, label]).withColumn("_must", F.col("_hash") <= F.col("_second"))
    free = marked.where(~F.col("_must"))
    # the same number of places is left for every row of a repeat
    need = F.lit(n) - 2 * F.col("_classes")
    rest = hash_cutoffs(free, [by, "_classes"], "_hash", need).select(by, "cutoff")
    chosen = marked.join(small(rest), by, "left").where(
        F.col("_must") | (F.col("_hash") <= F.col("cutoff"))
    )
    return chosen.drop("_hash", "_second", "_classes", "_must", "cutoff")


def group_overlap(split: DataFrame, group: str = "grp") -> DataFrame:
    """(rep, group) pairs that sit on both sides."""
    sides = F.count_distinct("is_test")
    return split.groupBy("rep", group).agg(sides.alias("sides")).where("sides = 2").select("rep", group)


def shared_groups(split: DataFrame, group: str = "grp") -> DataFrame:
    """Groups common to train and test whatever the repeat."""
    train = split.where(~F.col("is_test")).select(group)
    return train.intersect(split.where("is_test").select(group))


def class_share(split: DataFrame, label: str = "label") -> DataFrame:
    """Share of every class in the held-out side of each repeat."""
    counts = split.where("is_test").groupBy("rep", label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("rep"))
    return counts.withColumn("share", F.round(F.col("n") / total, 3))


def repeats_sharing(split: DataFrame, group: str = "grp") -> DataFrame:
    """Pairs of repeats whose held-out sides have a group in common, with how many.

    The repeats of one group are gathered in one small array (at most one entry
    per repeat) and paired inside the row.
    """
    held = split.where("is_test").groupBy(group).agg(F.array_sort(F.collect_set("rep")).alias("reps"))
    pairs = F.flatten(
        F.transform(
            "reps",
            lambda a: F.transform(F.filter("reps", lambda b: b > a), lambda b: F.struct(a.alias("rep_a"), b.alias("rep_b"))),
        )
    )
    return held.select(F.inline(pairs)).groupBy("rep_a", "rep_b").agg(F.count(F.lit(1)).alias("shared"))


def balanced_weights(df: DataFrame, label: str = "label", by: Sequence[str] = ("rep",)) -> DataFrame:
    """Weight of a class = rows / (classes x rows of the class), one row per (by, class)."""
    by = list(by)
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    weight = F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))
    return counts.withColumn("weight", weight)


def split_violations(
    split: DataFrame,
    row_id: str = "row_id",
    group: str = "grp",
    label: str = "label",
    features: str = "features",
    transform_fit: str = "raw",
) -> DataFrame:
    """Contract of one split, as (code, path, message) rows.

    Identifiers are compared as canonical text. The transform declaration is
    checked first, because data fitted on all rows cannot be repaired here.
    """
    from ..functions.columns import canonical_id
    from .validate import finding, union_violations

    rows = split.select(
        "is_test",
        canonical_id(row_id).alias("id"),
        canonical_id(group).alias("grp"),
        F.col(label).cast("string").alias("label"),
        F.size(features).alias("width"),
        F.exists(features, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad"),
    )
    widths = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n"))
    n_widths = widths.agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    train = rows.where(~F.col("is_test"))
    test = rows.where("is_test")
    ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    both = rows.groupBy("grp").agg(F.count_distinct("is_test").alias("n")).where("n > 1")
    classes = train.agg(F.count_distinct("label").alias("k")).where("k < 2")
    unseen = test.select("label").distinct().join(train.select("label").distinct(), "label", "left_anti")
    empty = rows.where(reduce(Column.__or__, [F.coalesce(c, F.lit("")) == "" for c in ("id", "grp", "label")]))
    declared = rows.limit(1).where(~F.lit(transform_fit).isin("raw", "train_only"))
    return union_violations(
        finding(n_widths, "split_width", F.lit("features"), F.lit("feature vectors differ in width")),
        finding(rows.where("bad"), "split_finite", F.col("id"), F.lit("features must be finite")),
        finding(ids, "split_ids", F.col("id"), F.lit("id must be unique over both sides")),
        finding(both, "split_groups", F.col("grp"), F.lit("group is on both sides")),
        finding(classes, "split_classes", F.lit("label"), F.lit("training needs at least two classes")),
        finding(unseen, "split_labels", F.col("label"), F.lit("test label is absent from training")),
        finding(empty, "split_empty", F.coalesce("id", F.lit("")), F.lit("empty identifier")),
        finding(declared, "split_transform", F.lit("transform_fit"), F.lit("declare raw or train_only")),
    )
