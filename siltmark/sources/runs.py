"""Stored runs: prediction artifacts and the catalog of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import columns as fx
from ..functions import variants as vx
from ..operators.validate import row_findings, union_violations

MANIFEST_NAME = "run_manifest.json"
ARTIFACT_TABLE = "artifacts"


def read_artifacts(spark: SparkSession, path: str, in_parts: bool = False) -> DataFrame:
    """One row per stored (repeat, arm) document, with the file it came from.

    With ``in_parts`` a document is a folder and every line of its files a part of it: an object with the same keys, the lists of
    some neighbouring entries and ``first``, the position of the first of them. So no row grows with the document.

    Fields are taken one by one: one of another type is NULL, a head that is no object is left out;
    ``artifact_findings`` names both. A document that is not a JSON object fails the job that reads it.
    """
    docs = _documents(spark, path, in_parts)
    why = F.concat(F.lit("not a valid JSON document: "), F.col("artifact"))
    docs = docs.withColumn("doc", F.when(vx.not_a_document(), F.raise_error(why)).otherwise(F.col("doc")))
    heads = F.transform_values(F.map_filter(_heads(), lambda _, v: vx.is_object(v)), lambda _, v: F.struct(*vx.fields(v, schemas.HEAD)))
    fields = f"{schemas.ARTIFACT_FIELDS}, {schemas.ARTIFACT_PART}" if in_parts else schemas.ARTIFACT_FIELDS
    return docs.select(*vx.fields("doc", fields), heads.alias("metrics"), "artifact")


def broken_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Findings: the stored documents that are not JSON objects."""
    return row_findings(_documents(spark, path), [(vx.not_a_document(), "json", F.col("artifact"), "not a valid JSON document")])


def artifact_findings(spark: SparkSession, path: str, in_parts: bool = False) -> DataFrame:
    """Findings on the form of stored documents: not JSON, no run or repeat, no heads, fields of another type.

    What several parts of a document have in common is one finding.
    """
    docs, at = _documents(spark, path, in_parts), lambda name: F.concat(F.col("artifact"), F.lit(f":{name}"))
    there = ~vx.not_a_document()
    rules = [(vx.not_a_document(), "json", F.col("artifact"), "not a valid JSON document")]
    fields, needed = schemas.ARTIFACT_FIELDS, schemas.ARTIFACT_KEYS
    if in_parts:
        fields, needed = f"{fields}, {schemas.ARTIFACT_PART}", (*needed, "first")
    for field in fields.split(", "):
        name, kind = field.split(" ")
        wrong = vx.mistyped("doc", name, kind) | (F.lit(name in needed) & vx.typed("doc", name, kind).isNull())
        rules.append((there & wrong, "schema", at(name), f"the field must be of type {kind}"))
    rules.append((there & F.coalesce(F.size(_heads()) < 1, F.lit(True)), "schema", at("metrics"), "a head and its predictions are needed here"))
    heads = docs.where(there).select("artifact", F.explode(_heads()).alias("clf", "v"))
    path_of = F.concat(at("metrics."), F.col("clf"))
    inner = [(~vx.is_object("v"), "schema", path_of, "the entry is not a JSON object")]
    for field in schemas.HEAD.split(", "):
        name, kind = field.split(" ")
        wrong = vx.mistyped("v", name, kind) | (F.lit(name == "predictions") & vx.is_object("v") & vx.typed("v", name, kind).isNull())
        inner.append((wrong, "schema", F.concat(path_of, F.lit(f".{name}")), f"the field must be of type {kind}"))
    found = union_violations(row_findings(docs, rules), row_findings(heads, inner))
    return found.distinct() if in_parts else found


def _documents(spark: SparkSession, path: str, in_parts: bool = False) -> DataFrame:
    if in_parts:
        folder = F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -2))
        return spark.read.text(path).where("trim(value) <> ''").select(*vx.parsed("value"), folder.alias("artifact"))
    return vx.texts(spark, path).select(*vx.parsed("value"), F.col("file_name").alias("artifact"))


def _heads() -> Column:
    return F.try_variant_get("doc", "$.metrics", "map<string, variant>")


def tidy(artifacts: DataFrame) -> DataFrame:
    """Documents -> one row per (run, rep, arm, clf, position); a list that is short leaves NULLs."""
    first = F.col("first") if "first" in artifacts.columns else F.lit(0)
    per_head = artifacts.select(
        "run_id", "rep", "arm", "test_ids", "test_groups", "y_test", first.alias("first"), F.explode("metrics").alias("clf", "m")
    )
    empty = F.array().cast("array<string>")
    lists = F.arrays_zip(
        *[F.coalesce(c, empty).alias(n) for c, n in (("test_ids", "i"), ("test_groups", "g"), ("y_test", "t"))],
        F.coalesce(F.col("m.predictions"), empty).alias("p"),
    )
    rows = per_head.select("run_id", "rep", "arm", "clf", "first", F.posexplode(lists).alias("pos", "z"))
    return rows.select(
        "run_id", "rep", "arm", "clf", (F.col("first") + F.col("pos")).alias("pos"),
        F.col("z.i").alias("item_id"), F.col("z.g").alias("grp"), F.col("z.t").alias("y_true"), F.col("z.p").alias("y_pred"),
    )


def read_predictions(spark: SparkSession, run_dir: str) -> DataFrame:
    """Tidy predictions of a run folder holding ``rep<r>_<arm>.json`` documents."""
    return tidy(read_artifacts(spark, f"{run_dir}/rep*_*.json"))


def read_prediction_table(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from the partitioned Parquet form, where a repeat is read by partition pruning."""
    return spark.read.schema(schemas.PREDICTION).parquet(path)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per run folder under ``root``; without or with a broken manifest it still has a row."""
    docs = (
        spark.read.schema(schemas.MANIFEST + ", _corrupt_record string")
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(f"{root}/*/{MANIFEST_NAME}")
        .withColumn("_folder", F.regexp_extract(F.input_file_name(), rf"([^/]+)/{MANIFEST_NAME}(?:/[^/]*)?$", 1))
        .withColumn("_folder", F.url_decode("_folder"))
    )
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", "length", "modificationTime")
        .withColumn("_folder", F.regexp_extract("path", _folder_pattern(root), 1))
        .where("_folder <> ''")
    )
    folders = files.groupBy("_folder").agg(
        F.sum("length").alias("size_bytes"), F.max("modificationTime").alias("_mtime")
    )
    joined = folders.join(docs, "_folder", "left")
    found = F.col("_corrupt_record").isNotNull() | F.col("status").isNotNull() | F.col("run_id").isNotNull()
    status = (
        F.when(F.col("_corrupt_record").isNotNull(), "corrupt_manifest")
        .when(~F.coalesce(found, F.lit(False)), "no_manifest")
        .otherwise(F.coalesce("status", F.lit("unknown")))
    )
    finished = fx.iso_timestamp("finished_at")
    return joined.select(
        F.coalesce("run_id", "_folder").alias("run_id"),
        status.alias("status"),
        fx.iso_timestamp("started_at").alias("started_at"),
        # a run without a usable time of its own is as old as its newest file
        F.coalesce(finished, F.when(fx.iso_timestamp("started_at").isNull(), F.col("_mtime"))).alias("finished_at"),
        F.coalesce("reps_completed", F.lit(0)).alias("reps_completed"),
        "arms", "classes", "seed", "group_overlap_events", "artifacts", "tables", "size_bytes",
    )


def _folder_pattern(root: str) -> str:
    tail = root.rstrip("/").rsplit("/", 1)[-1]
    escaped = "".join("\\" + c if not c.isalnum() else c for c in tail)
    return rf"/{escaped}/([^/]+)/"


def recorded_artifacts(runs: DataFrame) -> DataFrame:
    """(run_id, artifact, sha256, bytes) that the manifests list."""
    listed = runs.where(F.col("artifacts").isNotNull()).select("run_id", F.explode("artifacts").alias("artifact", "v"))
    return listed.select("run_id", "artifact", "v.sha256", "v.bytes")
