"""Identity of file sets, splits and artifacts.

A set is identified by sums of pieces of its members' SHA-256 values, per class.
Such a digest does not depend on order, is added up partition by partition, and
still changes when any member, class position or multiplicity changes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PIECES = 4  # of 15 hexadecimal digits each
ORDERED_LIMIT = 1_000_000
LEAF = 4096  # lines in a range of the tree, about


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"), 256)


def digest_sums(hex64: str) -> list[Column]:
    """Aggregates that add up the pieces of a 64-digit hash column."""
    return [
        F.sum(F.conv(F.substring(hex64, 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")).alias(f"s{i}")
        for i in range(PIECES)
    ]


def _per_class(entries: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(pos, class, n, s0..s3) for every listed class, present or not."""
    wanted = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    sums = (
        entries.where(F.col("class").isin(*classes))
        .groupBy("class")
        .agg(F.count(F.lit(1)).alias("n"), *digest_sums("entry"))
    )
    grid = entries.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    zero = {f"s{i}": 0 for i in range(PIECES)}
    return grid.join(sums, "class", "left").fillna({"n": 0, **zero}).withColumn("pos", wanted)


def _set_digest(entries: DataFrame, classes: Sequence[str], name: str) -> DataFrame:
    parts = [F.col("class"), F.col("n").cast("string")] + [F.col(f"s{i}").cast("string") for i in range(PIECES)]
    per = _per_class(entries, classes).withColumn("line", F.concat_ws(":", *parts))
    lines = F.array_sort(F.collect_list(F.struct("pos", "class", "n", "line")))
    out = per.agg(lines.alias("l"))
    return out.select(
        F.map_from_entries(F.transform("l", lambda x: F.struct(x["class"], x["n"]))).alias("per_class"),
        F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n_crops"),
        F.left(sha256_hex(F.array_join(F.transform("l", lambda x: x["line"]), "\n")), F.lit(16)).alias(name),
    )


def name_fingerprint(inventory: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row (per_class, n_crops, files_hash) from (class, file) rows; content-blind."""
    entries = inventory.select("class", sha256_hex(F.concat_ws("/", "class", "file")).alias("entry"))
    return _set_digest(entries, classes, "files_hash")


def content_fingerprint(inventory: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Like ``name_fingerprint`` over names, sizes and full content hashes (class, file, bytes, sha256)."""
    text = F.concat(F.concat_ws("/", "class", "file"), F.lit(":"), F.col("bytes").cast("string"), F.lit(":"), F.col("sha256"))
    return _set_digest(inventory.select("class", sha256_hex(text).alias("entry")), classes, "content_hash")


def ordered_fingerprint(inventory: DataFrame, classes: Sequence[str], limit: int = ORDERED_LIMIT) -> DataFrame:
    """(n_crops, files_hash, kind) of (class, file) rows in class, then name order.

    Up to ``limit`` files the hash is one SHA-256 over the ``class/file`` lines, the form stored by older caches, and the
    lines pass through one row; beyond, it is the root of ``tree_fingerprint``. ``kind`` says which, and must be equal, too.
    """
    inside = inventory.where(F.col("class").isin(*classes))
    if inside.limit(limit + 1).count() > limit:
        return tree_fingerprint(inventory, classes)
    pos = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class"))
    ordered = F.array_sort(F.collect_list(F.struct(pos.alias("p"), F.col("file").alias("f"), "class")))
    lines = F.transform("l", lambda x: F.concat_ws("/", x["class"], x["f"]))
    return inside.agg(ordered.alias("l")).select(
        F.size("l").cast("bigint").alias("n_crops"),
        F.left(sha256_hex(F.array_join(lines, "\n")), F.lit(16)).alias("files_hash"),
        F.lit("stream").alias("kind"),
    )


def tree_fingerprint(inventory: DataFrame, classes: Sequence[str], leaf: int = LEAF) -> DataFrame:
    """(n_crops, files_hash, kind): root of a Merkle tree over any number of (class, file) rows.

    A line is the class's position, ``class/file`` and how often it occurs. Lines are ordered by their SHA-256 and cut into
    ranges by its first digits, as many as leave about ``leaf`` lines a range; a range's hash is that of its lines' hashes in order, and
    sixteen neighbours at a time are hashed up to the root. No group holds more than a range or sixteen hashes,
    whatever the number of files, and where two inventories differ only the hashes above the difference do.
    """
    pos = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("class")).cast("string")
    counted = inventory.where(F.col("class").isin(*classes)).groupBy("class", "file").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat_ws("\t", pos, F.concat_ws("/", "class", "file"), F.col("n").cast("string"))
    lines = counted.select(sha256_hex(line).alias("hash"), "n")
    total, depth = lines.count(), 0
    while total > leaf * 16**depth:
        depth += 1
    joined = lambda c: sha256_hex(F.array_join(F.array_sort(F.collect_list(c)), "\n"))
    node = lines.groupBy(F.left("hash", F.lit(depth)).alias("key")).agg(joined("hash").alias("hash"), F.sum("n").alias("n"))
    for level in range(depth - 1, -1, -1):
        child = F.concat_ws(":", "key", "hash")
        node = node.groupBy(F.left("key", F.lit(level)).alias("up")).agg(joined(child).alias("hash"), F.sum("n").alias("n")).withColumnRenamed("up", "key")
    empty = node.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n_crops"), F.coalesce(F.max("hash"), sha256_hex(F.lit(""))).alias("hash"))
    return empty.select(F.col("n_crops").cast("bigint"), F.left("hash", F.lit(16)).alias("files_hash"), F.lit(f"tree:{leaf}:{depth}").alias("kind"))


def split_fingerprint(
    split: DataFrame,
    transform_fit: str = "raw",
    columns: Sequence[str] = ("row_id", "grp", "label", "is_test", "features"),
) -> DataFrame:
    """(rep, rows, fingerprint) over ids, groups, labels, sides and features of each repeat."""
    row = sha256_hex(F.to_json(F.struct(*columns)))
    sums = split.select("rep", row.alias("entry")).groupBy("rep").agg(F.count(F.lit(1)).alias("rows"), *digest_sums("entry"))
    text = F.concat_ws(":", F.lit(transform_fit), F.col("rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(PIECES)])
    return sums.select("rep", "rows", sha256_hex(text).alias("fingerprint"))


def snapshot(spark: SparkSession, path: str, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Provenance row of an annotation file: sha256, modification time and table sizes."""
    file = spark.read.format("binaryFile").load(path)
    n_images = images.agg(F.count(F.lit(1))).scalar()
    n_annotations = annotations.agg(F.count(F.lit(1))).scalar()
    return file.select(
        F.col("path").alias("source"),
        F.sha2("content", 256).alias("sha256"),
        F.col("modificationTime").alias("file_mtime"),
        n_images.alias("n_images"),
        n_annotations.alias("n_annotations"),
    )


def artifact_inventory(spark: SparkSession, path: str, pattern: str = "rep*_*.json") -> DataFrame:
    """(artifact, sha256, bytes) of the files in a run folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("artifact"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def table_inventory(spark: SparkSession, folder: str, tables: Sequence[str]) -> DataFrame:
    """(artifact, sha256, bytes) of all part files of the named tables, by their path inside the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{folder}/{t}" for t in tables])
    run = folder.rstrip("/").rsplit("/", 1)[-1]
    inside = F.substring_index("path", f"/{run}/", -1)
    return files.select(inside.alias("artifact"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify_artifacts(recorded: DataFrame, actual: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """(by, artifact, problem): recorded files that are missing or differ, and files nobody recorded."""
    keys = [*by, "artifact"]
    left = recorded.select(*keys, F.lower("sha256").alias("_want"), F.lit(True).alias("_rec"))
    right = actual.select(*keys, F.lower("sha256").alias("_have"), F.lit(True).alias("_act"))
    problem = (
        F.when(F.col("_act").isNull(), "missing")
        .when(F.col("_rec").isNull(), "unrecorded")
        .when(F.coalesce(F.col("_want") != F.col("_have"), F.lit(True)), "hash_differs")
    )
    joined = left.join(right, keys, "full_outer").withColumn("problem", problem)
    return joined.where(F.col("problem").isNotNull()).select(*keys, "problem")


def cache_valid(meta: DataFrame, names: DataFrame, contents: DataFrame, n_rows: DataFrame) -> DataFrame:
    """One row (reuse, reason): reuse a cache only if identity, backbone and row counts all agree.

    ``meta`` is the stored record (files_hash, content_hash, n_samples, backbone,
    wanted_backbone); the others are one-row results computed now.
    """
    now_names = names.select("files_hash").scalar()
    now_content = contents.select("content_hash").scalar()
    now_crops = names.select("n_crops").scalar()
    rows = n_rows.scalar()
    reason = (
        F.when((F.col("files_hash") != now_names) | (F.col("content_hash") != now_content), "identity")
        .when(F.col("backbone") != F.col("wanted_backbone"), "backbone")
        .when((rows != F.col("n_samples")) | (rows != now_crops), "rows")
    )
    return meta.select(reason.isNull().alias("reuse"), F.coalesce(reason, F.lit("hit")).alias("reason"))


def pending_rows(inventory: DataFrame, done: DataFrame) -> DataFrame:
    """Inventory rows whose (path, content hash) has no stored result yet."""
    return inventory.join(done.select("path", "sha256"), ["path", "sha256"], "left_anti")


def missing_classes(df: DataFrame, classes: Sequence[str], label: str = "label") -> DataFrame:
    """Configured classes without a single row."""
    wanted = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    present = df.select(F.col(label).cast("string").alias("class")).distinct()
    return wanted.join(present, "class", "left_anti")


def set_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of the members that only one of two sets has."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    joined = left.join(right, key, "full_outer")
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only")
    return joined.select(key, side.alias("side")).where(F.col("side").isNotNull())


def multiset_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, n_left, n_right) of the members whose multiplicities differ."""
    left = a.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    right = b.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    joined = left.join(right, key, "full_outer").fillna(0, ["n_left", "n_right"])
    return joined.where(F.col("n_left") != F.col("n_right"))

