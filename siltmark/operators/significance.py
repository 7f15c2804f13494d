"""Paired comparison of arms over repeats, and what is decided from it."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import student_p, wilcoxon_p

MAX_ARMS = 64
PAIR = ["clf", "arm_a", "arm_b"]


def arm_names(results: DataFrame) -> list[str]:
    """The arms of a results table; a closed, small set by design, and refused when it is not."""
    names = sorted(r["arm"] for r in results.select("arm").distinct().limit(MAX_ARMS + 1).collect())
    if len(names) > MAX_ARMS:
        raise ValueError(f"more than {MAX_ARMS} arms; is the arm column right?")
    return names


def paired_diffs(results: DataFrame, arms: Sequence[str] | None = None, metric: str = "accuracy") -> DataFrame:
    """(clf, rep, arm_a, arm_b, diff) for arm_a < arm_b, repeats that have both.

    Arms become columns of one row per (clf, rep), and pairs are formed inside the
    row from a fixed list, so there is no self-join.
    """
    arms = sorted(arms) if arms is not None else arm_names(results)
    wide = results.groupBy("clf", "rep").agg(
        *[F.avg(F.when(F.col("arm") == a, F.col(metric))).alias(f"_{i}") for i, a in enumerate(arms)]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("arm_a"), F.lit(b).alias("arm_b"), (F.col(f"_{i}") - F.col(f"_{j}")).alias("diff"))
            for (i, a), (j, b) in combinations(enumerate(arms), 2)
        ]
    )
    return wide.select("clf", "rep", F.inline(pairs)).where(F.col("diff").isNotNull())


def duplicate_results(results: DataFrame) -> DataFrame:
    """(clf, arm, rep) keys with more than one row; averaging them silently would hide a fault."""
    return results.groupBy("clf", "arm", "rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def signed_rank(diffs: DataFrame, by: Sequence[str] = PAIR) -> DataFrame:
    """(by, n, zeros, w_plus, w_minus, ties) with average ranks of |diff|, zero differences dropped.

    ``ties`` is the sum of t^3 - t over groups of equal |diff|.
    """
    by = list(by)
    # differences that agree to 12 digits are equal
    size = F.round(F.abs("diff"), 12)
    rows = diffs.withColumn("_a", size)
    zeros = rows.groupBy(*by).agg(F.count_if(F.col("_a") == 0).alias("zeros"))
    live = rows.where(F.col("_a") > 0)
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, "_a"))
    rank = F.rank().over(Window.partitionBy(*by).orderBy("_a"))
    ranked = live.withColumn("_t", same).withColumn("_r", rank + (F.col("_t") - 1) / 2.0)
    sums = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("diff") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("diff") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"),
        F.sum((F.col("_t") * F.col("_t") - 1).cast("double")).alias("ties"),
    )
    return zeros.join(sums, by, "left").fillna({"n": 0, "w_plus": 0.0, "w_minus": 0.0, "ties": 0.0})


def paired_t(diffs: DataFrame, by: Sequence[str] = PAIR) -> DataFrame:
    """(by, pairs, mean_diff, t); t is NULL with fewer than two pairs or only zero differences."""
    out = diffs.groupBy(*by).agg(
        F.count("diff").alias("pairs"),
        F.avg("diff").alias("mean_diff"),
        F.stddev_samp("diff").alias("_s"),
        F.max(F.abs("diff")).alias("_m"),
    )
    spread = F.col("_s") / F.sqrt(F.col("pairs").cast("double"))
    t = F.when((F.col("pairs") >= 2) & (F.col("_m") > 0) & (F.col("_s") > 0), F.col("mean_diff") / spread)
    return out.withColumn("t", t).drop("_s", "_m")


def holm(df: DataFrame, p: str, name: str, order: Sequence[str], family: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p: running maximum of (m - rank + 1) x p, at most 1.

    The table holds one row per comparison (arms^2 x classifiers), never raw data.
    """
    part = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(1))
    w = part.orderBy(p, *order)
    step = (F.count(F.lit(1)).over(part) - F.row_number().over(w) + 1) * F.col(p)
    staged = df.withColumn("_step", step)
    running = F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return staged.withColumn(name, F.least(F.lit(1.0), running)).drop("_step")


def paired_significance(
    results: DataFrame, arms: Sequence[str] | None = None, family: Sequence[str] = ()
) -> DataFrame:
    """One row per classifier and arm pair, both tests adjusted over all comparisons together.

    The flag uses the unrounded adjusted signed-rank p. ``family`` narrows the
    adjustment, for instance to one classifier.
    """
    diffs = paired_diffs(results, arms)
    both = signed_rank(diffs).join(paired_t(diffs), PAIR)
    raw = both.withColumn("wilcoxon_p", wilcoxon_p("w_plus", "n", "ties", "zeros")).withColumn(
        "paired_t_p",
        F.when(F.col("t").isNull(), F.lit(1.0)).otherwise(student_p("t", (F.col("pairs") - 1).cast("double"))),
    )
    adjusted = holm(raw, "wilcoxon_p", "_w", PAIR, family)
    adjusted = holm(adjusted, "paired_t_p", "_t", PAIR, family)
    exact = (F.col("n") <= 50) & (F.col("ties") == 0) & (F.col("zeros") == 0)
    return adjusted.select(
        *PAIR,
        F.round("mean_diff", 4).alias("mean_diff"),
        F.round("_w", 4).alias("wilcoxon_p_holm"),
        F.round("_t", 4).alias("paired_t_p_holm"),
        (F.col("_w") < 0.05).alias("significant"),
        F.when(exact, F.lit("exact")).otherwise(F.lit("normal")).alias("wilcoxon_method"),
    )


def converged(
    results: DataFrame, arm: str, clf: str, min_reps: int = 10, window: int = 5, tol: float = 0.01
) -> DataFrame:
    """(rep, accuracy, spread, stop): stop from the first repeat whose last ``window`` are within ``tol``."""
    rows = results.where((F.col("arm") == arm) & (F.col("clf") == clf)).select("rep", "accuracy")
    order = Window.partitionBy(F.lit(1)).orderBy("rep")
    frame = order.rowsBetween(-(window - 1), 0)
    spread = F.max("accuracy").over(frame) - F.min("accuracy").over(frame)
    seen = F.row_number().over(order)
    return rows.select(
        "rep", "accuracy", spread.alias("spread"), ((seen >= max(min_reps, window)) & (spread <= tol)).alias("stop")
    )


def before_stop(results: DataFrame, arm: str, clf: str, **rule) -> DataFrame:
    """Results up to and including the repeat at which the early-stop rule fires, else all."""
    first = converged(results, arm, clf, **rule).where("stop").agg(F.min("rep")).scalar()
    return results.where(F.coalesce(F.col("rep") <= first, F.lit(True)))


def separation(results: DataFrame, reference: str, clf: str, gap: float = 0.05) -> DataFrame:
    """(arm, mean_gap, structure): arms whose mean accuracy is further than ``gap`` from the reference arm's."""
    means = results.where(F.col("clf") == clf).groupBy("arm").agg(F.avg("accuracy").alias("m"))
    base = means.where(F.col("arm") == reference).select("m").scalar()
    far = F.abs(F.col("m") - base)
    return means.where(F.col("arm") != reference).select(
        "arm", far.alias("mean_gap"), F.when(far > gap, F.lit("separated")).otherwise(F.lit("tied")).alias("structure")
    )


def metric_violations(results: DataFrame, cells: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Expected (arm, clf) cells without results, and values that are not finite or outside [0, 1]."""
    missing = cells.select("arm", "clf").join(results, ["arm", "clf"], "left_anti").distinct()
    missing = missing.select("arm", "clf", F.lit(None).cast("int").alias("rep"), F.lit("missing").alias("problem"))
    value: Column = F.col(metric)
    broken = value.isNull() | F.isnan(value) | (value < 0) | (value > 1)
    bad = results.where(broken).select("arm", "clf", F.col("rep").cast("int").alias("rep"), F.lit("range").alias("problem"))
    return missing.unionByName(bad)
