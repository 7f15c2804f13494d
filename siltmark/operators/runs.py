"""Queries over the catalog of runs: choosing, ranking, listing and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions.ranking import global_rank

MAX_KEEP = 1_000_000  # names of the runs kept by rank are broadcast


def _stamp():
    return F.coalesce("finished_at", "started_at")


def best_run(runs: DataFrame) -> DataFrame:
    """The complete run with most repeats, then the latest finish, then the largest name."""
    done = runs.where(F.col("status") == "complete")
    return done.orderBy(F.coalesce("reps_completed", F.lit(0)).desc(), _stamp().desc(), F.col("run_id").desc()).limit(1)


def _newest_first():
    return [_stamp().desc_nulls_last(), F.col("reps_completed").desc(), F.col("run_id").desc()]


def rank_runs(runs: DataFrame) -> DataFrame:
    """Runs with ``rank``, newest first: time, then repeats, then name."""
    return global_rank(runs, _newest_first())


def newest(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(*_newest_first()).limit(n)


def retention_plan(runs: DataFrame, now: str, keep: int | None = None, max_age_days: float | None = None) -> DataFrame:
    """(run_id, delete, reason). A run goes only when no rule protects it; this is a plan, nothing is removed."""
    if keep is not None and not 0 <= keep <= MAX_KEEP:
        raise ValueError(f"keep must be in 0..{MAX_KEEP}")
    rows = runs
    by_rank = F.lit(False)
    if keep:
        top = newest(runs, keep).select("run_id", F.lit(True).alias("_top"))
        rows = rows.join(F.broadcast(top), "run_id", "left")
        by_rank = F.coalesce("_top", F.lit(False))
    age = fx.age_days(_stamp(), now)
    reason = F.when(F.col("status") == "running", "running").when(by_rank, "recent")
    if max_age_days is not None:
        reason = reason.when(age.isNull(), "no timestamp").when(age <= max_age_days, "young").otherwise("too old")
    else:
        reason = reason.otherwise("outside keep")
    out = rows.select("run_id", "status", F.round(age, 3).alias("age_days"), reason.alias("reason"), "size_bytes")
    return out.withColumn("delete", F.col("reason").isin("too old", "outside keep"))


def retention_totals(plan: DataFrame) -> DataFrame:
    """(delete, runs, size) with the size as text."""
    out = plan.groupBy("delete").agg(F.count(F.lit(1)).alias("runs"), F.sum("size_bytes").alias("bytes"))
    return out.withColumn("size", fx.size_text("bytes"))


def list_runs(runs: DataFrame, pred: DataFrame) -> DataFrame:
    """All runs with their classifiers (those of repeat 0, first arm) and whether one can be selected."""
    heads = (
        pred.where("rep = 0")
        .select("run_id", "arm", "clf")
        .distinct()
        .groupBy("run_id", "arm")
        .agg(F.array_sort(F.collect_list("clf")).alias("_clfs"))
    )
    first = F.when(F.size("arms") > 0, F.col("arms")[0])
    ok = (F.col("status") == "complete") & (F.size("arms") > 0)
    base = runs.withColumn("arm", F.when(ok, first))
    none = F.array().cast("array<string>")
    return base.join(heads, ["run_id", "arm"], "left").select(
        "run_id",
        "status",
        F.coalesce("reps_completed", F.lit(0)).alias("reps_completed"),
        F.coalesce("arms", none).alias("arms"),
        F.when(ok, F.coalesce("_clfs", none)).otherwise(none).alias("clfs"),
        F.coalesce(ok, F.lit(False)).alias("selectable"),
    )
