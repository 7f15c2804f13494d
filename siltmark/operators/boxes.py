"""Annotated boxes: from annotation tables to named, size-filtered crops with counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions.joins import small

CATCH_ALL = "Unlabeled litter"  # leaf an unknown category is mapped to
MARGIN = 0.10
MIN_SIDE = 8


def map_taxonomy(
    annotations: DataFrame, categories: DataFrame, taxonomy: DataFrame, classes: Sequence[str] | None = None
) -> DataFrame:
    """Annotations with ``coarse``; an unknown leaf gets the catch-all. Only listed classes stay.

    Category and taxonomy tables have one row per leaf and are broadcast after a check of their size.
    """
    leaves = categories.select(F.col("id").alias("category_id"), F.col("name").alias("leaf"))
    coarse = F.coalesce("coarse", F.lit(CATCH_ALL))
    named = leaves.join(taxonomy.select("leaf", "coarse"), "leaf", "left").withColumn("coarse", coarse)
    if classes is not None:
        named = named.where(F.col("coarse").isin(*classes))
    return annotations.join(small(named), "category_id")


def unknown_leaves(categories: DataFrame, taxonomy: DataFrame) -> DataFrame:
    names = categories.select(F.col("name").alias("leaf")).distinct()
    return names.join(taxonomy.select("leaf"), "leaf", "left_anti").orderBy("leaf")


def annotate(annotations: DataFrame, categories: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations with category name and image columns (inner)."""
    cats = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    ims = images.select(F.col("id").alias("image_id"), "width", "height", "file_name")
    return annotations.join(small(cats), "category_id").join(ims, "image_id")


def attach_image_status(boxes: DataFrame, files: DataFrame) -> DataFrame:
    """Boxes with actual_width / actual_height and ``reason`` missing_image or unreadable.

    ``files`` has one row per file on disk: file_name, actual_width, actual_height, readable.
    """
    on_disk = files.select("file_name", "actual_width", "actual_height", "readable", F.lit(True).alias("_there"))
    reason = F.when(F.col("_there").isNull(), "missing_image").when(~F.col("readable"), "unreadable")
    return boxes.join(on_disk, "file_name", "left").withColumn("reason", reason).drop("_there", "readable")


def rescale_boxes(boxes: DataFrame) -> DataFrame:
    """Box coordinates x, y, w, h in pixels of the actual image; NULL when a dimension is not positive.

    A box that is not four finite numbers has no coordinates and gets the reason bad_box.
    """
    finite = F.forall("bbox", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.coalesce((F.size("bbox") == 4) & finite, F.lit(False))
    sx = F.when(F.col("width") > 0, F.col("actual_width") / F.col("width"))
    sy = F.when(F.col("height") > 0, F.col("actual_height") / F.col("height"))
    scaled = [F.when(sound, F.get("bbox", F.lit(i))) * s for i, s in enumerate((sx, sy, sx, sy))]
    placed = boxes.select("*", *[c.alias(n) for c, n in zip(scaled, "xywh")])
    return placed.withColumn("reason", F.coalesce("reason", F.when(~sound, "bad_box")))


def expand_boxes(boxes: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Corners x0, y0, x1, y1: margin on each side, truncated toward zero, clamped to the image."""
    x, y, w, h = (F.col(c) for c in "xywh")
    m = F.lit(margin)
    return boxes.select(
        "*",
        F.greatest(F.lit(0), (x - m * w).cast("int")).alias("x0"),
        F.greatest(F.lit(0), (y - m * h).cast("int")).alias("y0"),
        F.least(F.col("actual_width").cast("int"), (x + w * (1 + margin)).cast("int")).alias("x1"),
        F.least(F.col("actual_height").cast("int"), (y + h * (1 + margin)).cast("int")).alias("y1"),
    )


def mark_small(boxes: DataFrame, min_side: int = MIN_SIDE) -> DataFrame:
    small = (F.col("x1") - F.col("x0") < min_side) | (F.col("y1") - F.col("y0") < min_side)
    unplaced = F.col("x").isNull() | F.col("y").isNull()
    why = F.when(unplaced, F.lit("bad_dimension")).when(small, F.lit("too_small"))
    return boxes.withColumn("reason", F.coalesce("reason", why))


def filter_small(boxes: DataFrame, min_side: int = MIN_SIDE) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by the shorter side."""
    marked = mark_small(boxes, min_side)
    return marked.where(F.col("reason").isNull()), marked.where(F.col("reason") == "too_small")


def crop_plan(
    annotations: DataFrame,
    categories: DataFrame,
    images: DataFrame,
    taxonomy: DataFrame,
    files: DataFrame,
    classes: Sequence[str],
) -> DataFrame:
    """One row per box of a listed class: crop corners, crop name, and ``reason`` when it is not kept."""
    mapped = map_taxonomy(annotations, categories, taxonomy, classes)
    located = mapped.join(
        images.select(F.col("id").alias("image_id"), "width", "height", "file_name"), "image_id"
    )
    boxes = mark_small(expand_boxes(rescale_boxes(attach_image_status(located, files))))
    return boxes.withColumn("crop", fx.crop_name("file_name", "id"))


def class_counts(plan: DataFrame) -> DataFrame:
    """Kept boxes per class."""
    return plan.where(F.col("reason").isNull()).groupBy("coarse").agg(F.count(F.lit(1)).alias("n"))


def skip_counts(plan: DataFrame) -> DataFrame:
    return plan.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def prune_classes(counts: DataFrame, classes: Sequence[str], minimum: int) -> DataFrame:
    """(coarse, n, kept) for every configured class; a class without boxes counts 0 and is removed."""
    per = [F.sum(F.when(F.col("coarse") == c, F.col("n")).otherwise(0)).alias(f"_{i}") for i, c in enumerate(classes)]
    rows = F.array(
        *[F.struct(F.lit(c).alias("coarse"), F.coalesce(F.col(f"_{i}"), F.lit(0)).alias("n")) for i, c in enumerate(classes)]
    )
    return counts.agg(*per).select(F.inline(rows)).withColumn("kept", F.col("n") >= minimum)


def retention_ratio(plan: DataFrame) -> DataFrame:
    """(coarse, kept, too_small, ratio) with ratio = kept / (kept + too_small), 4 decimals."""
    kept = F.count_if(F.col("reason").isNull())
    small = F.count_if(F.col("reason") == "too_small")
    out = plan.groupBy("coarse").agg(kept.alias("kept"), small.alias("too_small"))
    out = out.where(F.col("kept") + F.col("too_small") > 0)
    return out.withColumn("ratio", F.round(F.col("kept") / (F.col("kept") + F.col("too_small")), 4))


# ---- the download list's data side ----------------------------------------------


def unsafe_files(images: DataFrame, column: str = "file_name") -> DataFrame:
    return images.where(fx.is_unsafe_path(column))


def refuse_unsafe(images: DataFrame, column: str = "file_name") -> DataFrame:
    """The same rows, failing the job on the first unsafe name: one bad path spoils a snapshot."""
    message = F.concat(F.lit("unsafe file name: "), F.coalesce(F.col(column), F.lit("NULL")))
    return images.where(
        F.when(fx.is_unsafe_path(column), F.raise_error(message).cast("boolean")).otherwise(True)
    )


def worklist(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images without a file on disk."""
    return images.join(files.select("file_name"), "file_name", "left_anti")


def candidate_urls(images: DataFrame, *columns: str) -> DataFrame:
    """Images with ``urls``: their non-empty alternatives in order."""
    options = F.filter(F.array(*columns), lambda u: u.isNotNull() & (u != ""))
    return images.withColumn("urls", options)


def screen_urls(df: DataFrame, column: str, hosts: tuple[str, ...]) -> DataFrame:
    return df.withColumn("problem", fx.url_problem(column, hosts))


def outcome_tally(outcomes: DataFrame) -> DataFrame:
    """One row: failed fetches, those gone for good (404 / 410) and those that may come back."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    gone = F.col("error").contains("404") | F.col("error").contains("410")
    skipped = F.col("error") == "no-640-url"
    return outcomes.agg(
        F.count_if(failed).alias("failed"),
        F.count_if(failed & gone & ~skipped).alias("dead"),
        F.count_if(failed & ~gone & ~skipped).alias("transient"),
    )
