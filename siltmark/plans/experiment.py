"""One experiment: embeddings -> splits -> PCA -> arms -> heads -> predictions -> tables.

A repeat is a column throughout, so the number of jobs does not depend on the number of repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ARM_NAMES, ExperimentConfig
from ..functions import columns as fx
from ..operators import features, heads, metrics, selection, significance, splits
from ..sinks import writers


BUCKETS = 4096  # pieces in which a held-out side is numbered


@dataclass(frozen=True)
class ExperimentResult:
    split: DataFrame
    selections: DataFrame
    predictions: DataFrame
    results: DataFrame
    summary: DataFrame
    significance: DataFrame
    explained_pct: dict[int, float]


def build_split(vectors: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Group-aware split of (row_id, grp, label, features) rows for all repeats."""
    return splits.group_split(vectors, "grp", list(cfg.reps), cfg.test_fraction, cfg.seed)


def run_experiment(
    vectors: DataFrame,
    cfg: ExperimentConfig,
    sweeps: int | None = None,
    head_names: tuple[str, ...] | None = None,
) -> ExperimentResult:
    raw = build_split(vectors, cfg)
    model = features.pca_train(raw, cfg.pca_components)
    split = model.transform(raw).persist()
    ctx = selection.SelectionContext(
        split, list(cfg.reps), cfg.pca_components, cfg.seed, cfg.mi_bins, cfg.sa_reads, sweeps or cfg.sa_sweeps
    )
    chosen = selection.run_arms(cfg.arms, ctx, cfg.k)
    names = head_names or tuple(h for h in heads.HEADS if cfg.tune_rbf or h != "rbf_svm_tuned")
    fitted = heads.fit_heads(split, chosen, names, cfg.max_train_rows, cfg.seed)
    pred = fitted.predict(split).persist()
    ctx.release()
    scored = metrics.score(pred)
    times = pred.groupBy("rep", "arm", "clf").agg(F.sum("predict_seconds").alias("predict_seconds"))
    fit_times = fitted.models.select("rep", "arm", "clf", "fit_seconds")
    keys = ["rep", "arm", "clf"]
    results = (
        scored.join(times, keys)
        .join(fit_times, keys)
        .join(chosen, ["rep", "arm"])
        .select(
            "rep",
            (F.col("rep") + F.lit(cfg.seed)).alias("seed"),
            fx.arm_label("arm", cfg.pca_components, cfg.k).alias("arm"),
            F.col("arm").alias("arm_key"),
            "clf", "selected", F.col("seconds").alias("selection_seconds"),
            "accuracy", "macro_f1", "fit_seconds", "predict_seconds",
        )
        .persist()
    )
    if cfg.early_stop and "D_qubo" in cfg.arms:
        results = significance.before_stop(results, display_label("D_qubo", cfg), "rbf_svm")
    labels = [display_label(a, cfg) for a in cfg.arms]
    return ExperimentResult(
        split, chosen, pred, results, metrics.summarise(results),
        significance.paired_significance(results, labels), model.explained_pct,
    )


def display_label(arm: str, cfg: ExperimentConfig) -> str:
    return f"Full-{cfg.pca_components}" if arm == "Z_full" else f"{ARM_NAMES[arm]}-{cfg.k}"


def positioned(pred: DataFrame, run_id: str) -> DataFrame:
    """Prediction rows in the stored form: an order by item that is the same for every arm and head."""
    # one window partition per (repeat, arm, head) would hold a whole test side; the order is local to
    # hash buckets of the items and offset by the sizes of the buckets before
    bucket = F.pmod(F.xxhash64("item_id"), F.lit(BUCKETS)).cast("int")
    keys = ["rep", "arm", "clf"]
    rows = pred.withColumn("_b", bucket)
    sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_n")
    offsets = sizes.select(*keys, "_b", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("item_id"))
    out = rows.withColumn("_local", local).join(offsets, [*keys, "_b"])
    pos = (F.col("_before") + F.col("_local") - 1).cast("int")
    return out.select(
        F.lit(run_id).alias("run_id"), *keys, pos.alias("pos"), "item_id", "grp", "y_true", "y_pred"
    )


def store_experiment(vectors: DataFrame, cfg: ExperimentConfig, root: str, run_id: str, **options) -> ExperimentResult:
    """Run and write: predictions, results, summary and significance first, the manifest last."""
    spark = vectors.sparkSession
    facts = {"seed": cfg.seed, "classes": list(cfg.classes), "arms": list(cfg.arms)}
    with writers.run_context(spark, root, run_id, **facts) as run:
        out = run_experiment(vectors, cfg, **options)
        writers.write_predictions(positioned(out.predictions, run_id), run.table("predictions"))
        writers.write_results(out.results.withColumn("run_id", F.lit(run_id)), run.table("results"))
        writers.write_table(out.summary, run.table("summary"))
        writers.write_table(out.significance, run.table("significance"))
        overlap = splits.group_overlap(out.split).count()
        run.manifest.update(reps_completed=cfg.n_repeats, group_overlap_events=overlap)
    return out
