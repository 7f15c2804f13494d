"""From a stored run to the severity table: verified predictions, votes, zones, figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BANDS, CLEAN_CLASSES, HAZARD_WEIGHTS
from ..functions import columns as fx
from ..operators import fingerprint, runs, validate, votes, zones
from ..sources import runs as run_source


class ProvenanceError(RuntimeError):
    """The predictions of a run cannot be trusted, and there is no fallback to the truth."""


def voted_items(pred: DataFrame, zone_dir: str | None = None) -> DataFrame:
    """Predictions over repeats -> one row per item: class, agreement, zone."""
    voted = votes.majority_vote(votes.count_votes(pred))
    return voted.withColumn("zone", fx.zone_of("item_id", zone_dir))


def severity(
    pred: DataFrame,
    weights: Mapping[str, float] = HAZARD_WEIGHTS,
    clean: Sequence[str] = CLEAN_CLASSES,
    bands: Sequence[tuple[int, str]] = BANDS,
) -> DataFrame:
    """Zone table with bounds and agreement straight from prediction rows (two shuffles of rows)."""
    return zones.zone_table(voted_items(pred), weights, clean, bands)


def predictions_for(
    spark: SparkSession, root: str, arm: str, clf: str, run_id: str | None = None
) -> DataFrame:
    """Prediction rows of one arm and classifier of a complete run, verified against its manifest.

    Without ``run_id`` the run with most repeats is taken. Any doubt raises: status,
    arm, missing or altered documents, lists of different length, repeated items,
    an item with two truths, or no predictions at all.
    """
    catalog = run_source.read_runs(spark, root)
    if run_id is not None:
        catalog = catalog.where(F.col("run_id") == run_id)
    found = runs.best_run(catalog).collect()
    if not found:
        raise ProvenanceError(f"no complete run under {root}" if run_id is None else f"run {run_id!r} is not complete")
    run = found[0]
    if arm not in (run["arms"] or []):
        raise ProvenanceError(f"run {run['run_id']!r} did not run arm {arm!r}")
    if not run["reps_completed"]:
        raise ProvenanceError(f"run {run['run_id']!r} has no completed repeats")
    folder = f"{root}/{run['run_id']}"
    pred, faults = _from_tables(spark, folder, run) if run["tables"] else _from_documents(spark, folder, run, arm)
    bad = faults.limit(5).collect()
    if bad:
        raise ProvenanceError("; ".join(f"{r['artifact']}: {r['problem']}" for r in bad))
    pred = pred.where((F.col("arm") == arm) & (F.col("clf") == clf))
    problems = validate.prediction_report(pred).limit(5).collect()
    if problems:
        raise ProvenanceError("; ".join(f"{r['code']} {r['path']}: {r['message']}" for r in problems))
    return pred


def _from_documents(spark: SparkSession, folder: str, run, arm: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, faults) of a run stored as one document per repeat and arm."""
    listed = [(k, v["sha256"]) for k, v in (run["artifacts"] or {}).items()]
    recorded = spark.createDataFrame(listed, "artifact string, sha256 string")
    names = [(f"rep{r}_{arm}.json",) for r in range(run["reps_completed"])]
    expected = spark.createDataFrame(names, "artifact string")
    actual = fingerprint.artifact_inventory(spark, folder)
    unlisted = expected.join(recorded, "artifact", "left_anti").select("artifact", F.lit("unrecorded").alias("problem"))
    faults = fingerprint.verify_artifacts(recorded, actual, by=()).join(expected, "artifact", "left_semi")
    return run_source.read_predictions(spark, folder), faults.unionByName(unlisted)


def _from_tables(spark: SparkSession, folder: str, run) -> tuple[DataFrame, DataFrame]:
    """(predictions, faults) of a run stored as partitioned tables with a table of hashes."""
    recorded = spark.read.parquet(f"{folder}/{run_source.ARTIFACT_TABLE}")
    actual = fingerprint.table_inventory(spark, folder, run["tables"])
    pred = run_source.read_prediction_table(spark, f"{folder}/predictions")
    return pred, fingerprint.verify_artifacts(recorded, actual, by=())


def city_report(table: DataFrame, weights: Mapping[str, float] = HAZARD_WEIGHTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(figures, weighted agreement, composition) of a zone table."""
    return zones.kpis(table), zones.weighted_agreement(table), zones.composition(table, list(weights))
