"""Leak audit of a run from its stored predictions and the inventory it drew from.

Lists are compared by length and digest, which add up in partial aggregates. The
train side is never rebuilt row by row. A source group straddles the split
exactly when the inventory has more of its files than the held-out side, so two
grouped counts and one join of the counts decide it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions.joins import small
from .fingerprint import PIECES

REP = ["run_id", "rep"]
ART = ["run_id", "rep", "arm"]


class AuditError(RuntimeError):
    """A run cannot be audited at all."""


def artifact_facts(pred: DataFrame) -> DataFrame:
    """One row per (run, rep, arm, clf): list lengths and a digest of its held-out list.

    The digest adds up 256 bits of hashes of (position, item), so whole lists are compared without shuffling
    their rows: lists are equal exactly when length and digest are. Halves of 64-bit hashes are added as
    plain integers, as every row of every list passes through here.
    """
    rows = pred.withColumns({f"_h{i}": F.when(F.col("item_id").isNotNull(), F.xxhash64(F.lit(i), "pos", "item_id")) for i in range(PIECES)})
    halves = [f(F.col(f"_h{i}")) for i in range(PIECES) for f in (lambda h: F.shiftrightunsigned(h, 32), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    sums = rows.groupBy(*ART, "clf").agg(
        F.count("item_id").alias("n_ids"), F.count("y_true").alias("n_y"),
        F.count("grp").alias("n_g"), F.count("y_pred").alias("n_p"), *[F.sum(h).alias(f"s{i}") for i, h in enumerate(halves)],
    )
    digest = F.concat_ws(":", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("")) for i in range(len(halves))])
    return sums.select(*ART, "clf", "n_ids", "n_y", "n_g", "n_p", F.concat_ws(":", F.col("n_ids").cast("string"), digest).alias("digest"))


def artifact_alignment(facts: DataFrame) -> DataFrame:
    """(run, rep, arm, n_ids, misaligned, digest): label, group and prediction lists not as long as the ids,
    and classifiers of one artifact that do not share one list of ids."""
    off = lambda c: (F.col(c) != F.col("n_ids")).cast("int")
    apart = (F.min("digest") != F.max("digest")).cast("int")
    return facts.groupBy(*ART).agg(
        F.max("n_ids").alias("n_ids"),
        (
            F.max(off("n_y")) + F.max(F.when(F.col("n_g") > 0, off("n_g")).otherwise(0)) + F.sum(off("n_p")) + apart
        ).alias("misaligned"),
        F.min("digest").alias("digest"),
    )


def different_splits(aligned: DataFrame) -> DataFrame:
    """(run, rep, arm) of arms whose held-out list is not the first arm's, position by position."""
    first = aligned.groupBy(*REP).agg(F.min_by("digest", "arm").alias("ref"))
    return aligned.join(first, REP).where("digest <> ref").select(*ART)


def held_out(pred: DataFrame, facts: DataFrame) -> DataFrame:
    """(run, rep, arm, item_id, n, wrong_group): the held-out items of each artifact.

    All classifiers of an artifact share its list, so the rows of one of them are read.
    """
    chosen = facts.groupBy(*ART).agg(F.min("clf").alias("clf"))
    rows = pred.where(F.col("item_id").isNotNull()).join(small(chosen), [*ART, "clf"], "left_semi")
    return rows.groupBy(*ART, "item_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("grp") != fx.group_key("item_id")).alias("wrong_group"),
    )


def audit_repeats(
    pred: DataFrame,
    inventory: DataFrame,
    manifests: DataFrame,
    hash_problems: DataFrame | None = None,
) -> DataFrame:
    """One row per repeat that the manifest says was completed, with a count per kind of fault.

    pred: run_id, rep, arm, clf, pos, item_id, grp, y_true, y_pred (NULL where a list is short).
    inventory: file, one row per file. manifests: run_id, reps_completed, arms.
    hash_problems: run_id, rep, arm, one row per artifact that differs from the record.
    """
    facts = small(artifact_facts(pred))
    return _audit_items(facts, held_out(pred, facts), inventory, manifests, hash_problems)


def _audit_items(
    facts: DataFrame, per_item: DataFrame, inventory: DataFrame, manifests: DataFrame, hash_problems: DataFrame | None
) -> DataFrame:
    expected = (
        manifests.where("reps_completed >= 1")
        .select("run_id", F.explode(F.sequence(F.lit(0), F.col("reps_completed") - 1)).alias("rep"), "arms")
        .select("run_id", F.col("rep").cast("int").alias("rep"), F.explode("arms").alias("arm"))
    )
    aligned = artifact_alignment(facts)
    faults = hash_problems if hash_problems is not None else expected.limit(0)
    faults = faults.groupBy(*ART).agg(F.count(F.lit(1)).alias("_bad"))
    artifacts = (
        expected.join(aligned, ART, "left")
        .join(faults, ART, "left")
        .groupBy(*REP)
        .agg(
            F.sum(F.coalesce("misaligned", F.lit(1))).alias("misaligned_artifacts"),
            # an absent artifact is one that does not match its record
            F.sum(F.when(F.col("n_ids").isNull(), 1).otherwise(F.coalesce("_bad", F.lit(0)))).alias("hash_mismatches"),
            F.min_by("n_ids", F.when(F.col("n_ids").isNotNull(), F.col("arm"))).alias("n_test"),
        )
    )

    names = inventory.select("file", fx.group_key("file").alias("g"))
    found = per_item.withColumn("file", fx.base_name("item_id")).join(
        names.select("file", F.lit(True).alias("there")).distinct(), "file", "left"
    )
    held = found.groupBy(*ART, fx.group_key("item_id").alias("g")).agg(
        F.count_if(F.col("there").isNotNull()).alias("held"),
        F.sum("n").alias("crops"),
        F.sum(F.col("n") - 1).alias("duplicates"),
        F.sum("wrong_group").alias("wrong_group"),
        F.sum(F.when(F.col("there").isNull(), F.col("n")).otherwise(0)).alias("absent"),
    )
    sizes = names.distinct().groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    per_arm = held.join(sizes, "g", "left").groupBy(*ART).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("crops") > 1).alias("multi"),
        F.count_if(F.col("size") > F.col("held")).alias("straddling"),
        *[F.sum(c).alias(c) for c in ("duplicates", "wrong_group", "absent")],
    )
    content = per_arm.groupBy(*REP).agg(
        F.max("duplicates").alias("duplicate_test_ids"),
        F.max("wrong_group").alias("group_label_mismatches"),
        F.max("absent").alias("held_out_missing"),
        F.max("straddling").alias("straddling_groups"),
        F.max("n_groups").alias("n_groups"),
        F.max("multi").alias("groups_with_multiple_crops"),
    )
    odd = different_splits(aligned).groupBy(*REP).agg(F.count(F.lit(1)).alias("arms_with_different_split"))
    out = artifacts.join(content, REP, "left").join(odd, REP, "left")
    counts = [
        "duplicate_test_ids", "misaligned_artifacts", "hash_mismatches", "arms_with_different_split",
        "group_label_mismatches", "held_out_missing", "straddling_groups",
    ]
    out = out.fillna(0, [*counts, "n_test", "n_groups", "groups_with_multiple_crops"])
    clean = sum((F.col(c) for c in counts[1:]), F.col(counts[0])) == 0
    return out.select(
        *REP, *[F.col(c).cast("bigint").alias(c) for c in ("n_test", "n_groups", "groups_with_multiple_crops", *counts)], clean.alias("ok")
    )


def repeats_sharing(per_item: DataFrame) -> DataFrame:
    """(run, repeats_sharing): pairs of repeats whose held-out sides have a source group in common."""
    held = per_item.groupBy("run_id", fx.group_key("item_id").alias("g"))
    reps = held.agg(F.collect_set("rep").alias("reps"))  # at most one entry per repeat
    pairs = F.flatten(
        F.transform(
            "reps",
            lambda a: F.transform(F.filter("reps", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))),
        )
    )
    return reps.select("run_id", F.inline(pairs)).distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("repeats_sharing"))


def audit_runs(
    pred: DataFrame,
    inventory: DataFrame,
    manifests: DataFrame,
    hash_problems: DataFrame | None = None,
) -> DataFrame:
    """Verdict per run. Runs that are not complete, and an empty inventory, are errors, not passes."""
    complete = manifests.where((F.col("status") == "complete") & (F.col("reps_completed") >= 1))
    facts = small(artifact_facts(pred))
    per_item = held_out(pred, facts)
    reps = _audit_items(facts, per_item, inventory, complete, hash_problems)
    per_run = reps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("repeats"),
        F.count_if(~F.col("ok")).alias("failed_repeats"),
        F.sum("straddling_groups").alias("straddling"),
    )
    has_files = inventory.limit(1).agg((F.count(F.lit(1)) > 0)).scalar()
    recorded = F.col("group_overlap_events")
    joined = manifests.join(per_run, "run_id", "left").join(repeats_sharing(per_item), "run_id", "left")
    auditable = F.col("repeats").isNotNull()
    agrees = F.when(auditable & recorded.isNotNull(), recorded == F.col("straddling"))
    error = (
        F.when(~auditable, "not a complete run")
        .when(~has_files, "the inventory is empty")
        .when(F.col("failed_repeats") > 0, "a repeat failed")
        .when(~agrees, "recorded overlap differs")
    )
    return joined.select(
        "run_id",
        "status",
        F.coalesce("repeats", F.lit(0)).alias("repeats"),
        F.coalesce("failed_repeats", F.lit(0)).alias("failed_repeats"),
        F.coalesce("repeats_sharing", F.lit(0)).alias("repeats_sharing"),
        F.col("straddling").alias("recomputed_overlap"),
        recorded.cast("bigint").alias("recorded_overlap"),
        agrees.alias("overlap_agrees"),
        error.alias("error"),
        F.when(error.isNull(), "PASS").otherwise("FAIL").alias("verdict"),
    )
