"""Operator inputs derived from the driver's tables. ``oracle.py`` states the same rules in SQL.

Every binding reads whole tables and derives each value from the row itself, so the
work grows with the table. Deliberate faults (a wrong hash, a lost file, a doubled
path) are placed by the key's remainder, so that checks have something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions import columns as fx
from siltmark.operators import splits
from siltmark.sources.tables import spread

SEED = 42
REPS = list(range(5))
FRACTION = 0.4
CLASSES = ["click", "error", "purchase", "signup", "view"]
WEIGHTS = {"error": 3.0, "purchase": 1.0, "signup": 0.8, "click": 0.5, "view": 0.5}
CLEAN = ["purchase", "signup", "click", "view"]
# (arm, classifier, chance in 65,536 that a prediction is moved to the next class)
HEADS = [
    (arm, clf, rate + extra)
    for arm, rate in (("A_random", 26214), ("C_mi", 16384), ("D_qubo", 15729), ("Z_full", 7864))
    for clf, extra in (("rbf_svm", 0), ("linear_svm", 1500))
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def hex4(c: Column) -> Column:
    return F.conv(F.left(F.md5(c.cast("binary")), F.lit(4)), 16, 10).cast("int")


# ---- items, splits and predictions -------------------------------------------


def items(spark, sf) -> DataFrame:
    """events as crops: path, source group, class, zone."""
    u = F.col("user_id")
    prefix = F.when(u % 37 == 0, "scan_").otherwise("batch_")
    stem = _text(prefix, u % 12 + 1, "_", F.lpad(u.cast("string"), 6, "0"))
    path = _text("crops/", F.col("event_type"), "/", stem, "_ann", F.col("event_id"), ".jpg")
    rows = spread(table(spark, sf, "events"), "event_id").select("event_id", "user_id", "ts", F.col("event_type").alias("class"), path.alias("item_id"))
    return rows.withColumn("grp", fx.group_key("item_id")).withColumn("zone", fx.zone_of("item_id"))


def item_split(spark, sf) -> DataFrame:
    return splits.group_split(items(spark, sf), "grp", REPS, FRACTION, SEED)


def predictions(spark, sf, arms=tuple(sorted({a for a, _, _ in HEADS}))) -> DataFrame:
    """Held-out items under every (arm, classifier), or those of some arms, with errors at a fixed rate."""
    heads = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(c).alias("clf"), F.lit(r).alias("rate")) for a, c, r in HEADS if a in arms])
    test = item_split(spark, sf).where("is_test")
    rows = test.withColumn("_h", F.explode(heads)).select("*", "_h.*")
    order = F.array(*[F.lit(c) for c in CLASSES])
    following = F.element_at(order, (F.array_position(order, F.col("class")) % len(CLASSES) + 1).cast("int"))
    draw = hex4(F.concat_ws(":", F.col("event_id").cast("string"), F.col("rep").cast("string"), "arm", "clf"))
    return rows.select(
        "rep", "arm", "clf", "item_id", "grp", "event_id", F.col("class").alias("y_true"),
        F.when(draw < F.col("rate"), following).otherwise(F.col("class")).alias("y_pred"),
    )


def one_head(spark, sf) -> DataFrame:
    return predictions(spark, sf, ("D_qubo",)).where("clf = 'rbf_svm'")


# ---- vectors --------------------------------------------------------------------


def vectors(spark, sf) -> DataFrame:
    rows = spread(table(spark, sf, "embeddings"), "vec_id")
    return rows.select(
        F.col("vec_id").alias("row_id"),
        F.expr("vec_id div 5").alias("grp"),
        _text("c", F.col("label")).alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
    )


VECTOR_REPS = [0, 1]


def vector_split(spark, sf) -> DataFrame:
    return splits.group_split(vectors(spark, sf), "grp", VECTOR_REPS, 0.25, SEED)


def vector_masks(spark, sf) -> DataFrame:
    """The same split with a mask per repeat in place of a copy."""
    return splits.group_masks(vectors(spark, sf), "grp", VECTOR_REPS, 0.25, SEED)


def order_lines(spark, sf) -> DataFrame:
    """lineitem as four wide numeric features, grouped by order."""
    numbers = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return spread(table(spark, sf, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("grp"), F.col("l_returnflag").alias("label"), numbers.alias("features")
    )


LINE_REPS = [0, 1, 2]


def line_split(spark, sf, reps=LINE_REPS) -> DataFrame:
    """A repeat's sides do not depend on which other repeats are asked for."""
    return splits.group_split(order_lines(spark, sf), "grp", reps, 0.25, SEED)


def line_masks(spark, sf) -> DataFrame:
    return splits.group_masks(order_lines(spark, sf), "grp", LINE_REPS, 0.25, SEED)


# ---- annotation set ---------------------------------------------------------------


def images(spark, sf) -> DataFrame:
    c = F.col("c_custkey")

    def name(key: Column, batch="batch_", ext=".jpg") -> Column:
        return _text(batch, key % 14, "/", F.lpad(key.cast("string"), 6, "0"), ext)

    file_name = (
        F.when(c % 97 == 3, _text("../", name(c)))
        .when(c % 89 == 4, _text("C:\\", name(c)))
        .when(c % 83 == 5, name(c - 1, "BATCH_", ".JPG"))
        .otherwise(name(c))
    )
    return table(spark, sf, "customer").select(
        c.alias("id"),
        F.when(c % 211 == 5, F.lit(0)).otherwise(300 + F.col("c_nationkey") * 20).cast("bigint").alias("width"),
        (200 + F.col("c_nationkey") * 10).cast("bigint").alias("height"),
        file_name.alias("file_name"),
        F.when(c % 10 != 0, _text("https://farm", c % 66, ".staticflickr.com/", c, "_z.jpg")).alias("flickr_640_url"),
        F.when(c % 7 == 0, "").when(c % 7 != 1, _text("http://example.org/", c, ".jpg")).alias("flickr_url"),
    )


def files(spark, sf) -> DataFrame:
    """What is on disk for the images: smaller copies, unreadable and missing ones."""
    i = F.col("id")
    rows = images(spark, sf).where(i % 11 != 2)
    half = lambda c: F.when(i % 3 == 0, F.expr(f"{c} div 2")).otherwise(F.col(c))
    return rows.select(
        "file_name", half("width").alias("actual_width"), half("height").alias("actual_height"), (i % 13 != 1).alias("readable")
    )


def categories(spark, sf) -> DataFrame:
    brand = table(spark, sf, "part").select("p_brand").distinct()
    number = F.substring("p_brand", 7, 9).cast("bigint")
    groups = F.array(*[F.lit(g) for g in ("bottle", "can", "Cup", "Bag", "Tube")])
    return brand.select(
        number.alias("id"), F.col("p_brand").alias("name"), F.element_at(groups, (number % 5 + 1).cast("int")).alias("supercategory")
    )


COARSE = ["bottle", "can", "cup", "lid", "other"]


def taxonomy(spark, sf) -> DataFrame:
    """Leaf -> class with a lost leaf (25), an invented one, and two leaves in another class."""
    n = F.col("id")
    coarse = (
        F.when(n == 10, "other").when(n == 11, "lid").when(n % 5 == 0, "bottle").when(n % 5 == 1, "can").when(n % 5 == 2, "cup").otherwise("other")
    )
    leaf = F.when(n == 25, "Ghost leaf").otherwise(F.col("name"))
    return categories(spark, sf).select(leaf.alias("leaf"), coarse.alias("coarse"))


def annotations(spark, sf) -> DataFrame:
    o = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    rows = table(spark, sf, "orders").withColumn("c", cents)
    rows = rows.selectExpr(
        "o_orderkey", "o_custkey", "(c % 20000) / 100e0 as x", "((c div 7) % 10000) / 100e0 as y",
        "((c div 11) % 9000) / 100e0 + 1e0 as w", "((c div 13) % 6000) / 100e0 + 0.5e0 as h",
    )
    width = F.when(o % 151 == 2, -F.col("w")).otherwise(F.col("w"))
    bbox = F.when(o % 149 == 3, F.array("x", "y", "w")).otherwise(F.array(F.col("x"), F.col("y"), width, F.col("h")))
    return rows.select(
        o.alias("id"),
        F.when(o % 173 == 9, o + 1000000000).otherwise(F.col("o_custkey")).alias("image_id"),
        (o % 26 + 1).alias("category_id"),
        bbox.alias("bbox"),
        F.when(o % 311 == 6, F.lit(-1.0)).otherwise(F.col("w") * F.col("h")).alias("area"),
        F.when(o % 307 == 4, F.lit(2)).otherwise(F.lit(0)).alias("iscrowd"),
    )


# ---- runs, artifacts and the stored cache --------------------------------------------


def runs(spark, sf) -> DataFrame:
    o = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "complete").otherwise("running")
    started = F.col("o_orderdate").cast("timestamp")
    finished = F.when(status != "running", F.timestamp_micros(F.unix_micros(started) + (o % 48) * 3600000000))
    return table(spark, sf, "orders").select(
        _text("run_", o).alias("run_id"),
        status.alias("status"),
        F.when(o % 41 != 7, started).alias("started_at"),
        F.when(o % 41 != 7, finished).alias("finished_at"),
        (o % 26).cast("int").alias("reps_completed"),
        F.when(o % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("D_qubo"), F.lit("Z_full"))).alias("arms"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size_bytes"),
    )


def run_heads(spark, sf) -> DataFrame:
    """Classifiers per (run, repeat, arm), from order lines."""
    line = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        _text("run_", F.col("l_orderkey")).alias("run_id"),
        (line % 2).alias("rep"),
        F.when(F.col("l_suppkey") % 2 == 0, "D_qubo").otherwise("Z_full").alias("arm"),
        _text("clf_", F.col("l_returnflag")).alias("clf"),
    )


def _artifact_rows(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    sha = F.sha2(_text(F.col("l_orderkey"), ":", F.col("l_linenumber")).cast("binary"), 256)
    name = _text("rep", F.col("l_linenumber"), "_D_qubo.json")
    return rows.select("l_orderkey", "l_linenumber", _text("run_", F.col("l_orderkey")).alias("run_id"), name.alias("artifact"), sha.alias("sha256"))


def recorded(spark, sf) -> DataFrame:
    return _artifact_rows(spark, sf).where("l_orderkey % 13 <> 1 or l_linenumber <> 2").select("run_id", "artifact", "sha256")


def stored(spark, sf) -> DataFrame:
    rows = _artifact_rows(spark, sf).where("l_orderkey % 11 <> 3")
    altered = (F.col("l_linenumber") == 5) & (F.col("l_orderkey") % 7 == 0)
    return rows.select("run_id", "artifact", F.when(altered, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))


def cache(spark, sf) -> DataFrame:
    """Stored embeddings with a cut vector, a wrong label and a doubled path here and there."""
    v = F.col("vec_id")
    label = _text("c", F.when(v % 73 == 6, F.col("label") + 1).otherwise(F.col("label")))
    key = F.when(v % 79 == 7, v - v % 5).otherwise(v)
    return table(spark, sf, "embeddings").select(
        _text("crops/c", F.col("label"), "/v_", key, ".jpg").alias("path"),
        label.alias("label"),
        F.when(v % 71 == 5, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("features"),
    )


def cache_inventory(spark, sf) -> DataFrame:
    rows = table(spark, sf, "embeddings").where("vec_id % 83 <> 8")
    name = _text("v_", F.col("vec_id"), ".jpg")
    return rows.select(
        _text("c", F.col("label")).alias("class"), name.alias("file"), _text("crops/c", F.col("label"), "/", name).alias("path")
    )


CACHE_CLASSES = [f"c{i}" for i in range(9)]  # one label is left out on purpose


# ---- a run to audit ---------------------------------------------------------------------


def audited(spark, sf) -> DataFrame:
    """Predictions as one run per zone letter, with faults: wrong groups, a short list, lost held-out items."""
    e = F.col("event_id")
    rows = predictions(spark, sf, ("D_qubo", "Z_full"))
    rows = rows.where(~((F.col("rep") == 1) & (e % 50 == 0)))
    return rows.select(
        F.lit("run_events").alias("run_id"), "rep", "arm", "clf", F.col("event_id").cast("int").alias("pos"),
        F.when((F.col("arm") == "Z_full") & (F.col("rep") == 3) & (e % 500 == 1), _text(F.col("item_id"), "x")).otherwise(F.col("item_id")).alias("item_id"),
        F.when((F.col("rep") == 2) & (e % 97 == 0), "elsewhere").otherwise(F.col("grp")).alias("grp"),
        "y_true",
        F.when((F.col("rep") == 0) & (F.col("clf") == "linear_svm") & (e % 101 == 0), None).otherwise(F.col("y_pred")).alias("y_pred"),
    )


def audit_inventory(spark, sf) -> DataFrame:
    return items(spark, sf).where("event_id % 211 <> 4").select(fx.base_name("item_id").alias("file"))


def manifests(spark, sf) -> DataFrame:
    """The catalog rows of the audited run and of one that never finished."""
    arms = ["D_qubo", "Z_full"]
    return spark.createDataFrame(
        [("run_events", "complete", len(REPS), arms, 0), ("run_open", "running", len(REPS), arms, 0)],
        "run_id string, status string, reps_completed int, arms array<string>, group_overlap_events int",
    )


def hash_problems(spark, sf) -> DataFrame:
    return spark.createDataFrame([("run_events", 4, "Z_full")], "run_id string, rep int, arm string")
