"""JSON kept as variants until each field is taken, so a wrong field costs that field only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))"

#: which JSON types a field may have; a number in quotes is no number, true is none either
KINDS = {
    "bigint": "^BIGINT$",
    "int": "^BIGINT$",
    "double": f"^{NUMBER}$",
    "string": "^STRING$",
    "array<double>": f"^ARRAY<(VOID|{NUMBER})>$",
    "array<int>": "^ARRAY<(VOID|BIGINT)>$",
    "array<string>": f"^ARRAY<(VOID|STRING|BOOLEAN|{NUMBER})>$",  # ids and labels may be stored as numbers
}


def texts(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """``value``, a document per file or per line that is not blank, and ``file_name``; Spark passes over files of no bytes."""
    if one_per_file:
        found = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("value"), "_metadata.file_name")
    else:
        found = spark.read.text(path).where("trim(value) <> ''").select("value", "_metadata.file_name")
    return found


def parsed(text: str) -> list[Column]:
    """``doc``, the text as a variant, and ``closed``, whether nothing follows its last brace."""
    end = F.regexp_replace(F.right(text, F.lit(64)), r"\s+$", "")
    return [F.try_parse_json(text).alias("doc"), end.endswith("}").alias("closed")]


def is_object(of: str | Column) -> Column:
    return F.coalesce(F.schema_of_variant(of).startswith("OBJECT"), F.lit(False))


def not_a_document() -> Column:
    """Not JSON, JSON of another kind, a repeated key, or something behind the object."""
    return ~is_object("doc") | ~F.col("closed")


def member(of: str | Column, name: str) -> Column:
    return F.try_variant_get(of, f"$.{name}", "variant")


def has(of: str | Column, name: str) -> Column:
    """Whether the object has the member, be it null."""
    return F.coalesce(F.array_contains(F.map_keys(F.try_variant_get(of, "$", "map<string, variant>")), name), F.lit(False))


def typed(of: str | Column, name: str, kind: str) -> Column:
    """The member as ``kind``; NULL if it is absent or of another type."""
    right = F.schema_of_variant(member(of, name)).rlike(KINDS[kind])
    return F.when(right, F.try_variant_get(of, f"$.{name}", kind))


def mistyped(of: str | Column, name: str, kind: str) -> Column:
    """Whether the member is there, is not null, and has another type than ``kind``."""
    found = F.schema_of_variant(member(of, name))
    return F.coalesce((found != "VOID") & ~found.rlike(KINDS[kind]), F.lit(False))


def fields(of: str | Column, schema: str) -> list[Column]:
    """``typed`` members by a schema of ``name type`` pairs."""
    return [typed(of, name, kind).alias(name) for name, kind in (f.split(" ") for f in schema.split(", "))]
