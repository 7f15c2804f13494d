"""Live views: the zone table over arriving items, once-only ingest, and runs as they finish."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import BANDS, CLEAN_CLASSES, HAZARD_WEIGHTS
from ..operators.zones import zone_table_from_cells


def live_zone_table(
    items: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    weights: Mapping[str, float] = HAZARD_WEIGHTS,
    clean: Sequence[str] = CLEAN_CLASSES,
    bands: Sequence[tuple[int, str]] = BANDS,
    trigger: Mapping[str, object] | None = None,
):
    """Start a query that hands ``sink`` the whole zone table after every micro-batch.

    The state is the zone x class counts. Complete mode is needed, because every
    zone's index is scaled by the largest cell of all zones.
    """
    counts = items.groupBy("zone", "class").agg(F.count(F.lit(1)).alias("n"))
    empty = {"agreement_sum": F.lit(None).cast("double"), "agreement_n": F.lit(0).cast("bigint")}

    def publish(batch: DataFrame, epoch: int) -> None:
        sink(zone_table_from_cells(batch.withColumns(empty), weights, clean, bands), epoch)

    return (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def ingest_once(
    items: DataFrame,
    path: str,
    checkpoint: str,
    key: str = "item_id",
    trigger: Mapping[str, object] | None = None,
):
    """Append new items to a Parquet table (one folder per batch), each key once ever, however late it comes.

    A batch that is run again after a failure replaces its own folder only. Items without a key are left out.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        try:
            held = spark.read.schema(f"{key} {batch.schema[key].dataType.simpleString()}, epoch long").parquet(path)
            fresh = fresh.join(held.where(F.col("epoch") != epoch).select(key), key, "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        fresh.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        items.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(append)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_runs(spark: SparkSession, root: str, one_per_file: bool = True) -> DataFrame:
    """Complete runs as their manifests appear under ``root``, one per file or one per line."""
    docs = (
        spark.readStream.schema(schemas.MANIFEST)
        .option("multiLine", one_per_file)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(root)
    )
    return docs.where("status = 'complete'").select("run_id", "reps_completed", "arms", "finished_at")
