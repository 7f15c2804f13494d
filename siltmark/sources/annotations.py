"""Annotation documents, the taxonomy file and the folder of crops."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import columns as fx
from ..functions import variants as vx
from ..operators.validate import finding, row_findings, union_violations

RECORDS = {"images": schemas.IMAGE, "categories": schemas.CATEGORY, "annotations": schemas.ANNOTATION}
LISTS = tuple(RECORDS)


def read_annotations(
    spark: SparkSession, path: str, one_per_file: bool = True, skip_broken: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, categories, annotations) of one document, or of a folder or glob of shards.

    One JSON document is one row and so one task; a set that is too large for that
    is stored as shards, each with a part of the lists, one per file or one per line.
    A document is parsed as a variant and its records are taken one by one: a field of another type is NULL
    in its record only, and an entry that is no object is left out. ``document_findings`` names what is wrong.
    A document that is not a JSON object fails the job that reads it; with ``skip_broken`` it has no records.
    Shards may repeat the category list: a category occurs as often as in the shard that has it most often,
    so one that is doubled inside a shard stays doubled for the report.
    """
    docs = _documents(spark, path, one_per_file)
    why = F.concat(F.lit("not a valid JSON document: "), F.col("_file"))
    docs = docs.where(~vx.not_a_document()) if skip_broken else docs.withColumn("doc", F.when(vx.not_a_document(), F.raise_error(why)).otherwise(F.col("doc")))
    images, categories, annotations = (
        _entries(docs, c).where(vx.is_object("v")).select("_doc", *vx.fields("v", schema)) for c, schema in RECORDS.items()
    )
    names = [c for c in categories.columns if c != "_doc"]
    often = categories.groupBy(*categories.columns).agg(F.count(F.lit(1)).alias("_n")).groupBy(*names).agg(F.max("_n").alias("_n"))
    copies = often.select(*names, F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(*names)
    return images.drop("_doc"), copies, annotations.drop("_doc")


def document_findings(spark: SparkSession, path: str, one_per_file: bool = True, required: Sequence[str] = LISTS) -> DataFrame:
    """Findings on the form of the documents: not a JSON object, a list that is not one or is empty, an entry that is no object.

    ``required`` names the lists that every document must hold; a shard of some lists alone may lack the others.
    """
    docs = _documents(spark, path, one_per_file)
    at = lambda name: F.concat(F.col("_file"), F.lit(f":{name}"))
    rules = [(vx.not_a_document(), "json", F.col("_file"), "not a valid JSON document")]
    for name in LISTS:
        wanted = ~vx.not_a_document() & (F.lit(name in required) | vx.has("doc", name))
        rules.append((wanted & F.coalesce(F.size(_list(name)) < 1, F.lit(True)), "schema", at(name), "a list with at least one entry is needed here"))
    entries = reduce(
        DataFrame.unionByName,
        [_entries(docs.where(~vx.not_a_document()), c).where(~vx.is_object("v")).select(F.concat(at(c), F.lit("["), F.col("_pos").cast("string"), F.lit("]")).alias("p")) for c in LISTS],
    )
    return union_violations(row_findings(docs, rules), finding(entries, "schema", F.col("p"), F.lit("the entry is not a JSON object")))


def broken_documents(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Findings: the files with documents that are not JSON objects, once for each document."""
    return row_findings(_documents(spark, path, one_per_file), [(vx.not_a_document(), "json", F.col("_file"), "not a valid JSON document")])


def _documents(spark: SparkSession, path: str, one_per_file: bool) -> DataFrame:
    text = vx.texts(spark, path, one_per_file)
    return text.select(*vx.parsed("value"), F.col("file_name").alias("_file"), F.monotonically_increasing_id().alias("_doc"))


def _entries(docs: DataFrame, name: str) -> DataFrame:
    return docs.select("_file", "_doc", F.posexplode(_list(name)).alias("_pos", "v"))


def _list(name: str) -> Column:
    return F.try_variant_get("doc", f"$.{name}", "array<variant>")


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(leaf, coarse), trimmed, blank leaves dropped; of a repeated leaf the largest class is kept.

    File order does not exist for a distributed reader; ``taxonomy_duplicates`` reports such leaves.
    """
    return _taxonomy_rows(spark, path).groupBy("leaf").agg(F.max("coarse").alias("coarse"))


def _taxonomy_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("leaf string, coarse string").option("header", True).csv(path)
    trimmed = rows.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("leaf", "coarse")])
    return trimmed.where("leaf <> ''")


def taxonomy_duplicates(spark: SparkSession, path: str) -> DataFrame:
    twice = _taxonomy_rows(spark, path).groupBy("leaf").agg(F.count_distinct("coarse").alias("n"), F.count(F.lit(1)).alias("rows"))
    return finding(twice.where("rows > 1"), "duplicate_leaf", F.col("leaf"), F.lit("leaf occurs more than once"))


def read_inventory(spark: SparkSession, root: str, content: bool = False, pattern: str = "*.jpg") -> DataFrame:
    """(class, file, path, bytes[, sha256]) of ``<root>/<class>/*.jpg``; bytes are read only for the hash."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(root)
    )
    out = files.select(
        F.element_at(F.split("path", "/"), -2).alias("class"),
        F.element_at(F.split("path", "/"), -1).alias("file"),
        "path",
        F.col("length").alias("bytes"),
        *([F.sha2("content", 256).alias("sha256")] if content else []),
    )
    return out


def truth_items(inventory: DataFrame) -> DataFrame:
    """Items with their folder as class. Used on request only, never in place of predictions."""
    return inventory.select(F.col("path").alias("item_id"), "class", fx.zone_of("path").alias("zone"))
