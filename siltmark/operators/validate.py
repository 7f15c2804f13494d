"""Data-contract rules. Each yields (code, path, message) rows; a report is their union.

Rules are lazy and independent, so a report is one job. Duplicates are found by
grouped counts, never by a window over the rows of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions.joins import small
from .fingerprint import multiset_diff, set_diff
from .golden import PARTS

COLUMNS = ("code", "path", "message")


class ValidationError(ValueError):
    """Inputs of a validation do not fit together."""


def finding(df: DataFrame, code: str, path: Column, message: Column) -> DataFrame:
    return df.select(
        F.lit(code).alias("code"), path.cast("string").alias("path"), message.cast("string").alias("message")
    )


def union_violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _at(table: str, key: Column | str, field: str = "") -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"{table}["), F.coalesce(key.cast("string"), F.lit("null")), F.lit("]" + field))


def not_empty(df: DataFrame, table: str) -> DataFrame:
    none = df.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return finding(none, "schema", F.lit(table), F.lit("the table has no rows"))


def corrupt_records(df: DataFrame, table: str, column: str = "_corrupt_record") -> DataFrame:
    return finding(df.where(F.col(column).isNotNull()), "json", F.lit(table), F.lit("not a valid JSON object"))


Rule = tuple[Column, str, Column, "str | Column"]  # condition, code, path, message


def row_findings(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of any number of per-row rules from one scan of the table."""
    hits = [
        F.when(cond, F.struct(F.lit(code).alias("code"), path.cast("string").alias("path"), (text if isinstance(text, Column) else F.lit(text)).alias("message")))
        for cond, code, path, text in rules
    ]
    return df.select(F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))


def id_rules(table: str, key: str = "id") -> list[Rule]:
    bad = F.col(key).isNull() | (F.col(key) < 0)
    return [(bad, "id", _at(table, key), F.concat(F.lit("not an id: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))]


def duplicate_ids(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    twice = df.where(F.col(key) >= 0).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    text = F.concat(F.lit("id occurs "), F.col("n").cast("string"), F.lit(" times"))
    return finding(twice, "duplicate_id", _at(table, key), text)


def ids(df: DataFrame, table: str, key: str = "id") -> DataFrame:
    """Ids are integers >= 0 and unique."""
    return union_violations(row_findings(df, id_rules(table, key)), duplicate_ids(df, table, key))


def name_rules() -> list[Rule]:
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    return [(blank, "schema", _at("categories", "id", ".name"), "the name is blank")]


def category_names(categories: DataFrame) -> DataFrame:
    named = categories.where(F.trim(F.coalesce("name", F.lit(""))) != "")
    twice = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return union_violations(
        row_findings(categories, name_rules()),
        finding(twice, "category", _at("categories", "name"), F.concat(F.col("n").cast("string"), F.lit(" categories have this name"))),
    )


def dimension_rules() -> list[Rule]:
    return [
        (
            F.col(d).isNull() | (F.col(d) < 1), "dimension", _at("images", "id", f".{d}"),
            F.concat(F.lit("must be 1 or more, is "), F.coalesce(F.col(d).cast("string"), F.lit("null"))),
        )
        for d in ("width", "height")
    ]


def dimensions(images: DataFrame) -> DataFrame:
    return row_findings(images, dimension_rules())


def file_name_rules(key: str = "id", column: str = "file_name", table: str = "images") -> list[Rule]:
    return [(fx.is_nonportable_path(column), "path", _at(table, key, f".{column}"), "path is unsafe or not portable")]


def duplicate_files(images: DataFrame, column: str = "file_name", table: str = "images") -> DataFrame:
    good = images.where(~fx.is_nonportable_path(column)).groupBy(fx.portable_key(column).alias("k"))
    twice = good.agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return finding(twice, "duplicate_path", _at(table, "k"), F.lit("duplicate portable path"))


def file_names(images: DataFrame, key: str = "id", column: str = "file_name", table: str = "images") -> DataFrame:
    """Names are portable relative paths and unique when case and separators are ignored."""
    return union_violations(
        row_findings(images, file_name_rules(key, column, table)), duplicate_files(images, column, table)
    )


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Child rows whose reference has no parent."""
    keys = parent.select(F.col(parent_key).alias(key))
    return child.join(small(keys), key, "left_anti")


def references(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    return union_violations(
        *[
            finding(
                orphans(annotations, parent, key), "reference", _at("annotations", "id", f".{key}"),
                F.concat(F.lit(f"no row of {name} has this id: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))),
            )
            for key, name, parent in (("image_id", "images", images), ("category_id", "categories", categories))
        ]
    )


def _four_numbers() -> Column:
    plain = F.forall("bbox", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size("bbox") == 4) & plain, F.lit(False))


def _side(i: int) -> Column:
    return F.get("bbox", F.lit(i))


def box_rules() -> list[Rule]:
    at, four = _at("annotations", "id"), _four_numbers()
    bad = (_side(0) < 0) | (_side(1) < 0) | (_side(2) <= 0) | (_side(3) <= 0)
    return [
        (~four, "bbox", at, F.concat(F.greatest(F.coalesce(F.size("bbox"), F.lit(0)), F.lit(0)).cast("string"), F.lit(" values given, 4 finite numbers needed"))),
        (four & bad, "bbox", at, "bbox needs origin >= 0 and positive extent"),
    ]


def boxes_outside(annotations: DataFrame, images: DataFrame, slack: float = 1e-6) -> DataFrame:
    size = images.select(F.col("id").alias("image_id"), "width", "height").where("width >= 1 and height >= 1")
    over = (_side(0) + _side(2) > F.col("width") + slack) | (_side(1) + _side(3) > F.col("height") + slack)
    outside = annotations.where(_four_numbers()).join(size, "image_id").where(over)
    return finding(outside, "bbox", _at("annotations", "id"), F.lit("bbox exceeds the annotated image"))


def boxes(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Four finite numbers, origin >= 0, positive extent, inside the annotated image."""
    return union_violations(row_findings(annotations, box_rules()), boxes_outside(annotations, images))


def optional_rules() -> list[Rule]:
    area = F.col("area").isNotNull() & (~fx.is_finite("area") | (F.col("area") < 0))
    crowd = F.col("iscrowd").isNotNull() & ~F.col("iscrowd").isin(0, 1)
    return [
        (area, "schema", _at("annotations", "id", ".area"), "expected a finite number >= 0"),
        (crowd, "schema", _at("annotations", "id", ".iscrowd"), "expected 0 or 1"),
    ]


def optional_fields(annotations: DataFrame) -> DataFrame:
    return row_findings(annotations, optional_rules())


def annotation_report(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """All rules on one annotation set; the per-row rules of a table share one scan."""
    tables = {"images": images, "categories": categories, "annotations": annotations}
    own = {
        "images": dimension_rules() + file_name_rules(),
        "categories": name_rules(),
        "annotations": box_rules() + optional_rules(),
    }
    twice_named = category_names(categories).where("code = 'category'")
    return union_violations(
        *[not_empty(df, name) for name, df in tables.items()],
        *[row_findings(df, id_rules(name) + own[name]) for name, df in tables.items()],
        *[duplicate_ids(df, name) for name, df in tables.items()],
        twice_named,
        duplicate_files(images),
        references(annotations, images, categories),
        boxes_outside(annotations, images),
    )


def provenance(record: DataFrame, actual: DataFrame) -> DataFrame:
    """A stored provenance row against the file as it is now (see ``fingerprint.snapshot``)."""
    sha = F.coalesce(F.col("sha256"), F.lit(""))
    zoned = F.coalesce(F.col("file_mtime"), F.lit("")).rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    when = F.coalesce(fx.iso_timestamp("file_mtime").isNotNull() & zoned, F.lit(False))
    now = {c: actual.select(c).scalar() for c in ("sha256", "n_images", "n_annotations")}
    rules = [
        (~sha.rlike("^[0-9a-fA-F]{64}$"), "provenance", "not a SHA-256 digest in hex"),
        (F.trim(F.coalesce("source_url", F.lit(""))) == "", "provenance", "the source has no address"),
        (~when, "provenance", "file_mtime must be a time with zone"),
        (F.lower(sha) != now["sha256"], "provenance_sha256", "recorded sha256 does not match the file"),
    ]
    for c in ("n_images", "n_annotations"):
        low = F.col(c).isNull() | (F.col(c) < 1)
        rules.append((low, "provenance", f"{c} must be a positive integer"))
        rules.append((~low & (F.col(c) != now[c]), "provenance", f"{c} differs from the snapshot"))
    return union_violations(*[finding(record.where(rule), code, F.lit("provenance"), F.lit(text)) for rule, code, text in rules])


# ---- inventory, metadata and cache ---------------------------------------------


def inventory_report(files: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Files (relative path ``rel``): something there, listed class folders only, ``<class>/<name>.jpg``."""
    parts = F.split(fx.slashes("rel"), "/")
    folder = F.get(parts, F.lit(0))
    listed = files.where((F.size(parts) == 2) & folder.isin(*classes))
    none = listed.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    foreign = files.where(F.size(parts) >= 2).select(folder.alias("c")).distinct().where(~F.col("c").isin(*classes))
    layout = files.where((F.size(parts) != 2) | ~F.lower("rel").endswith(".jpg"))
    return union_violations(
        finding(none, "empty_crops", F.lit("crops"), F.lit("no crops for the listed classes")),
        finding(foreign, "crop_class", F.col("c"), F.lit("class folder is not listed")),
        finding(layout, "crop_layout", F.col("rel"), F.lit("expected <class>/<name>.jpg")),
    )


def metadata_report(per_class: DataFrame, kept: DataFrame, removed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Count tables (class, n) of a preparation run against each other and against the disk."""
    both = kept.select("class").intersect(removed.select("class"))
    stated = kept.unionByName(removed).select("class", F.col("n").alias("stated"))
    counted = per_class.select("class", F.col("n").alias("counted"))
    joined = stated.join(counted, "class", "left").where(F.coalesce("counted", F.lit(0)) != F.col("stated"))
    loose = per_class.select("class").join(stated, "class", "left_anti")
    nonzero = on_disk.where("n > 0").select("class", F.col("n").alias("disk"))
    disk = kept.where("n > 0").select("class", "n").join(nonzero, "class", "full_outer")
    disk = disk.where(~F.coalesce(F.col("n") == F.col("disk"), F.lit(False)))
    return union_violations(
        finding(both, "metadata", F.col("class"), F.lit("class is both kept and removed")),
        finding(joined, "metadata", F.col("class"), F.lit("per-class count disagrees")),
        finding(loose, "metadata", F.col("class"), F.lit("class is neither kept nor removed")),
        finding(disk, "crop_counts", F.col("class"), F.lit("kept count differs from the files on disk")),
    )


def cache_vectors(cache: DataFrame, dim: int) -> DataFrame:
    """Vector width and finite values (path, label, features)."""
    odd = F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return union_violations(
        finding(cache.where(F.size("features") != dim), "cache_dimension", F.col("path"), F.lit(f"expected {dim} values")),
        finding(cache.where(odd), "cache_finite", F.col("path"), F.lit("values must be finite")),
    )


def cache_rows(cache: DataFrame, meta: DataFrame) -> DataFrame:
    n = cache.agg(F.count(F.lit(1))).scalar()
    bad = meta.where(F.coalesce(F.col("n_samples") != n, F.lit(True)))
    return finding(bad, "cache_rows", F.lit("n_samples"), F.lit("n_samples differs from the stored rows"))


def cache_labels(cache: DataFrame, inventory: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Labels listed, counts as in the inventory, and label equal to the file's folder."""
    unknown = cache.where(~F.coalesce(F.col("label").isin(*classes), F.lit(False)))
    counts = multiset_diff(
        cache.select("label"),
        inventory.where(F.col("class").isin(*classes)).select(F.col("class").alias("label")),
        "label",
    )
    folder = F.coalesce(F.try_element_at(F.split(fx.slashes("path"), "/"), F.lit(-2)), F.lit(""))
    moved = cache.where(F.col("label") != folder)
    return union_violations(
        finding(unknown, "cache_label", F.col("path"), F.lit("label is not listed")),
        finding(counts, "cache_labels", F.col("label"), F.lit("label count differs from the inventory")),
        finding(moved, "cache_label", F.col("path"), F.lit("label does not match the class folder")),
    )


def cache_paths(cache: DataFrame, inventory: DataFrame) -> DataFrame:
    """Stored paths are unique and are exactly those of the inventory."""
    twice = cache.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    diff = set_diff(cache, inventory, "path")
    gone = diff.where("side = 'left_only'")
    absent = diff.where("side = 'right_only'")
    return union_violations(
        finding(twice, "duplicate_path", F.col("path"), F.lit("duplicate path")),
        finding(gone, "cache_path", F.col("path"), F.lit("stored file does not exist")),
        finding(absent, "cache_paths", F.col("path"), F.lit("file of the inventory is not stored")),
    )


def fingerprints(meta: DataFrame, actual: DataFrame) -> DataFrame:
    """Stored (n_crops, files_hash) has the right form and equals the computed one."""
    form = (F.col("n_crops") >= 1) & F.col("files_hash").rlike("^[0-9a-f]{16}$")
    n, digest = actual.select("n_crops").scalar(), actual.select("files_hash").scalar()
    same = (F.col("n_crops") == n) & (F.col("files_hash") == digest)
    return union_violations(
        finding(meta.where(~F.coalesce(form, F.lit(False))), "fingerprint", F.lit("meta"), F.lit("invalid n_crops or 16-digit hash")),
        finding(meta.where(~F.coalesce(same, F.lit(False))), "fingerprint", F.lit("meta"), F.lit("fingerprint differs from the inventory")),
    )


def prediction_report(pred: DataFrame, arms: Sequence[str] | None = None, parts: int = PARTS) -> DataFrame:
    """Prediction rows (rep, arm, clf, pos, item_id, y_true, y_pred): aligned, unique ids, one truth per item.

    Nearly every row is a key of its own, so rows are dealt by item to ``parts`` tasks first and grouped there: grouping
    before the shuffle would keep all rows of a scan's task in its memory. A hot item is one entry where it is grouped.
    """
    per = pred.groupBy("rep", "arm", "clf").agg(
        F.count("item_id").alias("i"), F.count("y_true").alias("t"), F.count("y_pred").alias("p")
    )
    at = F.concat_ws("/", F.col("rep").cast("string"), "arm", "clf")
    dealt = pred.where(F.col("item_id").isNotNull()).select("rep", "arm", "clf", "item_id").repartition(parts, "item_id")
    twice = dealt.groupBy("rep", "arm", "clf", "item_id").agg(F.count(F.lit(1)).alias("n"))
    told = pred.where(F.col("y_true").isNotNull()).select("item_id", "y_true").repartition(parts, "item_id").distinct()
    truth = told.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    found = [
        finding(per.where("i <> t or i <> p"), "alignment", at, F.lit("ids, labels and predictions differ in length")),
        finding(twice.where("n > 1"), "duplicate_id", F.concat(at, F.lit("/"), F.col("item_id").cast("string")), F.lit("item occurs twice")),
        finding(truth.where("n > 1"), "truth", F.col("item_id").cast("string"), F.lit("true label differs across repeats")),
        finding(pred.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0"), "empty", F.lit("predictions"), F.lit("no held-out predictions")),
    ]
    if arms is not None:
        wanted = pred.sparkSession.createDataFrame([(a,) for a in arms], "arm string")
        absent = wanted.join(pred.select("arm").distinct(), "arm", "left_anti")
        found.append(finding(absent, "arm", F.col("arm"), F.lit("arm has no predictions")))
    return union_violations(*found)


# An input (left) that is of no use without another (right).
COMPANIONS = (
    ("provenance", "annotations"),
    ("crop_meta", "crops"),
    ("cache", "cache_meta"),
    ("cache_meta", "cache"),
    ("cache", "crops"),
)


def check_inputs(given: Mapping[str, object], classes: Sequence[str] = ()) -> list[str]:
    """Problems with a request, found before any job: nothing given, a missing companion, no class list."""
    there = {k for k, v in given.items() if v is not None}
    out = [] if there else ["give at least one input"]
    out += [f"{a} needs {b}" for a, b in COMPANIONS if a in there and b not in there]
    if {"crops", "cache"} & there and not classes:
        out.append("crops and cache need the ordered class list")
    folded = [c.casefold() for c in classes]
    out += [f"duplicate class {c!r}" for i, c in enumerate(classes) if folded[i] in folded[:i]]
    return out


def report_ok(violations: DataFrame) -> DataFrame:
    return violations.agg(F.count(F.lit(1)).alias("n_errors"), (F.count(F.lit(1)) == 0).alias("ok"))
