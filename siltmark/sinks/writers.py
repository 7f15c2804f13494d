"""Writers. A run's data is written first and its manifest last, so a reader never trusts half a run."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators.fingerprint import table_inventory
from ..operators.golden import append_new
from ..sources.runs import ARTIFACT_TABLE, MANIFEST_NAME


def write_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet by key; only the partitions present in ``df`` are replaced.

    The rebalance hint brings the rows of a key together, splits a key that is too
    large for one task, and keeps the number of files near the size of the data.
    """
    writer = df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*keys).parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """Result rows, rewritten repeat by repeat."""
    write_partitions(df, path, ["run_id", "rep"])


def write_predictions(df: DataFrame, path: str) -> None:
    """Ids, groups, truths and predictions side by side, one folder per (run, repeat, arm)."""
    write_partitions(df, path, ["run_id", "rep", "arm"])


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A summary-sized table as a single file."""
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_results_csv(df: DataFrame, path: str) -> None:
    flat = df.withColumn("selected", fx.join_indices("selected")) if "selected" in df.columns else df
    write_table(flat, path, "csv")


def write_zone_table(zones: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_table(zones, path, fmt)


def write_stats(stats: DataFrame, path: str) -> None:
    """Preparation statistics as JSON lines."""
    write_table(stats, path, "json")


def write_new(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Append the rows whose key the stored ledger lacks; returns the keys stored with another payload.

    Nothing stored is ever replaced.
    """
    spark = rows.sparkSession
    try:
        ledger = spark.read.schema(rows.schema).parquet(path)
    except Exception as error:  # the first write has no ledger yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        ledger = spark.createDataFrame([], rows.schema)
    new, conflicts = append_new(rows, ledger, keys)
    clash = conflicts.checkpoint() if spark.sparkContext.getCheckpointDir() else conflicts
    new.write.mode("append").parquet(path)
    return clash


@dataclass
class RunContext:
    """An open run: its folder and what its manifest will say."""

    spark: SparkSession
    root: str
    run_id: str
    manifest: dict = field(default_factory=dict)
    tables: list[str] = field(default_factory=list)

    @property
    def path(self) -> str:
        return f"{self.root}/{self.run_id}"

    def table(self, name: str) -> str:
        """Path of a table of this run, which becomes part of the record."""
        if name not in self.tables:
            self.tables.append(name)
        return f"{self.path}/{name}"

    def save(self, status: str, **more) -> None:
        self.manifest.update(status=status, **more)
        row = json.dumps(self.manifest, sort_keys=True)
        text = self.spark.createDataFrame([(row,)], "value string").coalesce(1)
        text.write.mode("overwrite").text(f"{self.path}/{MANIFEST_NAME}")


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


@contextmanager
def run_context(spark: SparkSession, root: str, run_id: str, **facts) -> Iterator[RunContext]:
    """Manifest ``running`` at the start, ``complete`` after the block, ``failed`` when it raises.

    Before that the hashes of all files of ``run.tables`` are stored beside them.
    """
    if _unsafe_name(run_id):
        raise ValueError(f"unsafe run id {run_id!r}")
    run = RunContext(spark, root, run_id, {"schema_version": 1, "run_id": run_id, "started_at": _now(), **facts})
    run.save("running", finished_at=None)
    try:
        yield run
    except BaseException:
        run.save("failed", finished_at=_now())
        raise
    if run.tables:
        # hashes of the part files are a table of their own; the manifest only names the tables
        listed = table_inventory(spark, run.path, run.tables)
        listed.write.mode("overwrite").parquet(f"{run.path}/{ARTIFACT_TABLE}")
    run.save("complete", finished_at=_now(), tables=run.tables)


def _unsafe_name(name: str) -> bool:
    return not name or name in (".", "..") or any(c in name for c in '/\\:<>"|?*')


def write_documents(pred: DataFrame, selections: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """One JSON document per (repeat, arm), named ``rep<r>_<arm>``, for readers that expect documents.

    A document holds its whole held-out side, so a side of more than ``limit`` rows is
    refused; ``write_predictions`` is the form that scales.
    """
    keys = ["run_id", "rep", "arm"]
    sides = pred.groupBy(*keys, "clf").agg(F.count(F.lit(1)).alias("n"))
    if sides.where(F.col("n") > limit).limit(1).count():
        raise ValueError(f"a held-out side has more than {limit} rows: use write_predictions")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "item_id", "grp", "y_true", "y_pred")))
    heads = pred.groupBy(*keys, "clf").agg(ordered.alias("l"), F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    entry = F.struct("clf", F.struct("accuracy", F.col("l.y_pred").alias("predictions")))
    docs = heads.groupBy(*keys).agg(F.first("l").alias("l"), F.map_from_entries(F.collect_list(entry)).alias("metrics"))
    docs = docs.join(selections.select("rep", "arm", "selected"), ["rep", "arm"], "left")
    out = docs.select(
        *keys, "selected", "metrics",
        F.col("l.item_id").alias("test_ids"), F.col("l.grp").alias("test_groups"), F.col("l.y_true").alias("y_test"),
    )
    out.withColumn("document", F.concat(F.lit("rep"), F.col("rep").cast("string"), F.lit("_"), "arm")).repartition("document").write.mode(
        "overwrite"
    ).partitionBy("document").json(path)
