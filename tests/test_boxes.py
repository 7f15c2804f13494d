import json

import pytest
from pyspark.sql import functions as F

from conftest import one, rows
from siltmark import schemas
from siltmark.operators import boxes, fingerprint, taxonomy, validate
from siltmark.sources import annotations as source

HOSTS = ("staticflickr.com", "images.example.org")
FILES = "file_name string, actual_width bigint, actual_height bigint, readable boolean"
TAX = "leaf string, coarse string"


def document(**change):
    doc = {
        "images": [{"id": 0, "width": 120, "height": 100, "file_name": "batch_1/source.jpg"}],
        "categories": [{"id": 0, "name": "Glass bottle", "supercategory": "Bottle"}],
        "annotations": [{"id": 1, "image_id": 0, "category_id": 0, "bbox": [10, 5, 40, 30], "area": 1200, "iscrowd": 0}],
    }
    for (table, field), value in change.get("cells", {}).items():
        doc[table][0][field] = value
    for table, extra in change.get("more", {}).items():
        doc[table].append(extra)
    for table in change.get("empty", ()):
        doc[table] = []
    return doc


@pytest.fixture
def load(spark, tmp_path):
    def _load(**change):
        path = tmp_path / "annotations.json"
        path.write_text(json.dumps(document(**change), indent=1))
        return source.read_annotations(spark, str(path))

    return _load


def codes(tables):
    images, categories, annotations = tables
    return {r["code"] for r in validate.annotation_report(images, categories, annotations).collect()}


def test_a_good_document(load):
    images, categories, annotations = load()
    assert one(images)["file_name"] == "batch_1/source.jpg" and one(annotations)["bbox"] == [10.0, 5.0, 40.0, 30.0]
    assert codes((images, categories, annotations)) == set()


@pytest.mark.parametrize(
    "change, code",
    [
        ({"cells": {("images", "id"): -1}}, "id"),
        ({"cells": {("images", "width"): 0}}, "dimension"),
        ({"cells": {("images", "file_name"): "../x.jpg"}}, "path"),
        ({"cells": {("images", "file_name"): "C:\\x.jpg"}}, "path"),
        ({"cells": {("images", "file_name"): "a/CON.jpg"}}, "path"),
        ({"cells": {("categories", "name"): "  "}}, "schema"),
        ({"cells": {("annotations", "bbox"): [1, 2, 3]}}, "bbox"),
        ({"cells": {("annotations", "bbox"): [-1, 2, 3, 4]}}, "bbox"),
        ({"cells": {("annotations", "bbox"): [1, 2, 0, 4]}}, "bbox"),
        ({"cells": {("annotations", "bbox"): [100, 5, 40, 30]}}, "bbox"),
        ({"cells": {("annotations", "image_id"): 5}}, "reference"),
        ({"cells": {("annotations", "category_id"): 5}}, "reference"),
        ({"cells": {("annotations", "area"): -1}}, "schema"),
        ({"cells": {("annotations", "iscrowd"): 2}}, "schema"),
        ({"more": {"images": {"id": 0, "width": 9, "height": 9, "file_name": "z.jpg"}}}, "duplicate_id"),
        ({"more": {"images": {"id": 7, "width": 9, "height": 9, "file_name": "BATCH_1\\SOURCE.JPG"}}}, "duplicate_path"),
        ({"more": {"categories": {"id": 7, "name": "Glass bottle"}}}, "category"),
        ({"empty": ["annotations"]}, "schema"),
    ],
)
def test_one_fault_one_code(load, change, code):
    assert code in codes(load(**change))
    assert len(codes(load(**change)) - {"reference", "bbox", code}) == 0


def test_not_a_number_in_a_box(spark, load):
    images, categories, annotations = load()
    odd = annotations.withColumn("bbox", F.array(F.lit(float("nan")), F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert codes((images, categories, odd)) == {"bbox"}


def test_box_geometry(spark):
    """200 x 100 annotated, 400 x 200 on disk: the box doubles and gains a tenth on each side."""
    df = spark.createDataFrame(
        [(1, [150.0, 25.0, 40.0, 20.0], 200, 100, 400, 200, None), (2, [0.0, 0.0, 2.0, 20.0], 200, 100, 200, 100, None)],
        "id int, bbox array<double>, width int, height int, actual_width int, actual_height int, reason string",
    )
    got = {r["id"]: r for r in boxes.mark_small(boxes.expand_boxes(boxes.rescale_boxes(df))).collect()}
    a = got[1]
    assert (a["x"], a["y"], a["w"], a["h"]) == (300.0, 50.0, 80.0, 40.0)
    assert (a["x1"] - a["x0"], a["y1"] - a["y0"], a["reason"]) == (96, 48, None)
    assert got[2]["reason"] == "too_small"


def test_plan_and_counts(spark, load):
    images, categories, annotations = load()
    tax = spark.createDataFrame([("Glass bottle", "bottle")], TAX)
    disk = spark.createDataFrame([("batch_1/source.jpg", 120, 100, True)], FILES)
    plan = boxes.crop_plan(annotations, categories, images, tax, disk, ["bottle", "can"])
    assert one(plan)["crop"] == "batch_1_source_ann1.jpg" and one(plan)["reason"] is None
    assert rows(boxes.prune_classes(boxes.class_counts(plan), ["bottle", "can"], 1)) == [("bottle", 1, True), ("can", 0, False)]
    assert one(boxes.retention_ratio(plan))["ratio"] == 1.0
    gone = boxes.crop_plan(annotations, categories, images, tax, disk.limit(0), ["bottle"])
    assert one(gone)["reason"] == "missing_image"
    broken = boxes.crop_plan(annotations, categories, images, tax, disk.withColumn("readable", F.lit(False)), ["bottle"])
    assert rows(boxes.skip_counts(broken)) == [("unreadable", 1)]
    lost = boxes.map_taxonomy(annotations, categories, tax.limit(0))
    assert one(lost)["coarse"] == "Unlabeled litter"
    assert boxes.crop_plan(annotations, categories, images, tax.limit(0), disk, ["bottle"]).count() == 0


def test_unsafe_names_fail_the_batch(spark, load):
    images, _, _ = load(cells={("images", "file_name"): "/etc/x"})
    assert boxes.unsafe_files(images).count() == 1
    with pytest.raises(Exception, match="unsafe file name"):
        boxes.refuse_unsafe(images).collect()
    assert boxes.refuse_unsafe(load()[0]).count() == 1


def test_fetch_side(spark):
    images = spark.createDataFrame(
        [(0, "a.jpg", "https://farm1.staticflickr.com/a", None), (1, "b.jpg", "", "http://staticflickr.com/b")],
        "id int, file_name string, flickr_640_url string, flickr_url string",
    )
    disk = spark.createDataFrame([("a.jpg",)], "file_name string")
    assert [r["id"] for r in boxes.worklist(images, disk).collect()] == [1]
    urls = boxes.candidate_urls(images, "flickr_640_url", "flickr_url").orderBy("id").select("urls")
    assert [r[0] for r in urls.collect()] == [["https://farm1.staticflickr.com/a"], ["http://staticflickr.com/b"]]
    flat = boxes.candidate_urls(images, "flickr_640_url", "flickr_url").select(F.explode("urls").alias("u"))
    assert {r["problem"] for r in boxes.screen_urls(flat, "u", HOSTS).collect()} == {None, "scheme"}
    tally = boxes.outcome_tally(spark.createDataFrame([("HTTPError: 404",), ("Timeout",), ("no-640-url",), ("",), (None,)], "error string"))
    assert tuple(one(tally)) == (3, 1, 1)


# ---- taxonomy --------------------------------------------------------------------

CATS = "id bigint, name string, supercategory string"


def drift(spark, tax, cats):
    data = [(i, n, s) for i, (n, s) in enumerate(cats)]
    return taxonomy.taxonomy_drift(spark.createDataFrame(tax, TAX), spark.createDataFrame(data, CATS))


def test_presence_drift_is_hard(spark):
    got = drift(spark, [("Bottle", "bottle"), ("Ghost leaf", "other")], [("Bottle", "Bottle"), ("Can", "Can")])
    assert {(r["kind"], r["leaf"]) for r in got.collect()} == {("missing_in_taxonomy", "Can"), ("missing_in_categories", "Ghost leaf")}
    assert tuple(one(taxonomy.drift_verdict(got))) == (2, 0, False)


def test_class_mismatch_is_soft(spark):
    got = drift(spark, [("Bottle", "other"), ("Flask", "bottle")], [("Bottle", "Bottle"), ("Flask", "Flask")])
    assert {(r["kind"], r["leaf"], r["have"], r["expected"]) for r in got.collect()} == {
        ("coarse_mismatch", "Bottle", "other", "bottle"), ("coarse_mismatch", "Flask", "bottle", "other"),
    }
    assert one(taxonomy.drift_verdict(got))["ok"]


def test_group_outlier_and_tie(spark):
    got = drift(spark, [("Drink can", "can"), ("Aerosol", "other")], [("Drink can", "Can"), ("Aerosol", "Can")])
    outliers = [(r["leaf"], r["expected"]) for r in got.where("kind = 'group_inconsistency'").collect()]
    assert outliers == [("Aerosol", "can")]


def test_taxonomy_file(spark, tmp_path):
    path = tmp_path / "taxonomy.csv"
    path.write_text("leaf,coarse\n Glass bottle ,bottle\n,other\nCan,can\nCan,other\n")
    assert rows(source.read_taxonomy(spark, str(path))) == [("Can", "other"), ("Glass bottle", "bottle")]
    assert rows(source.taxonomy_duplicates(spark, str(path)).select("code", "path")) == [("duplicate_leaf", "Can")]


# ---- inventory and provenance -------------------------------------------------------


@pytest.fixture
def crops(tmp_path):
    root = tmp_path / "crops"
    for cls in ("can", "bottle"):
        (root / cls).mkdir(parents=True)
        for name in ("a.jpg", "b.jpg"):
            (root / cls / name).write_bytes(f"{cls}{name}".encode())
    return root


def test_inventory_and_fingerprints(spark, crops):
    import hashlib

    inventory = source.read_inventory(spark, str(crops), content=True)
    assert rows(inventory.select("class", "file", "bytes")) == [("bottle", "a.jpg", 11), ("bottle", "b.jpg", 11), ("can", "a.jpg", 8), ("can", "b.jpg", 8)]
    order = ["can", "bottle"]
    lines = "\n".join(f"{c}/{f}" for c in order for f in ("a.jpg", "b.jpg"))
    assert one(fingerprint.ordered_fingerprint(inventory, order))["files_hash"] == hashlib.sha256(lines.encode()).hexdigest()[:16]
    assert one(fingerprint.ordered_fingerprint(inventory, order))["kind"] == "stream"
    assert one(fingerprint.ordered_fingerprint(inventory, order, limit=3)) == one(fingerprint.tree_fingerprint(inventory, order))

    def names(df, classes=order):
        return one(fingerprint.name_fingerprint(df, classes))

    base = names(inventory)
    assert base["per_class"] == {"can": 2, "bottle": 2} and base["n_crops"] == 4
    assert names(inventory.repartition(3))["files_hash"] == base["files_hash"]
    assert names(inventory, ["bottle", "can"])["files_hash"] != base["files_hash"]
    assert names(inventory.where("file <> 'a.jpg' or class <> 'can'"))["files_hash"] != base["files_hash"]
    moved = inventory.withColumn("class", F.when((F.col("class") == "can") & (F.col("file") == "a.jpg"), "bottle").otherwise(F.col("class")))
    assert names(moved)["files_hash"] != base["files_hash"]
    done = spark.createDataFrame(inventory.select("path", "sha256").collect(), "path string, sha256 string")
    before = one(fingerprint.content_fingerprint(inventory, order))["content_hash"]
    (crops / "can" / "a.jpg").write_bytes(b"cana.jpX")
    after = source.read_inventory(spark, str(crops), content=True)
    assert one(fingerprint.content_fingerprint(after, order))["content_hash"] != before
    assert names(after)["files_hash"] == base["files_hash"]
    assert [r["file"] for r in fingerprint.pending_rows(after, done).collect()] == ["a.jpg"]
    assert source.truth_items(after).select("zone").distinct().collect()[0][0] == "Unassigned"


def test_inventory_rules(spark):
    def report(*rel):
        df = spark.createDataFrame([(r,) for r in rel], "rel string")
        return {(r["code"], r["path"]) for r in validate.inventory_report(df, ["can", "bottle"]).collect()}

    assert report("can/a.jpg", "bottle/b.JPG") == set()
    assert report("cup/a.jpg") == {("empty_crops", "crops"), ("crop_class", "cup")}
    assert report("can/a.jpg", "can/x/b.jpg", "c.jpg", "can/d.png") == {("crop_layout", "can/x/b.jpg"), ("crop_layout", "c.jpg"), ("crop_layout", "can/d.png")}


PROV = "sha256 string, source_url string, file_mtime string, n_images bigint, n_annotations bigint"


def test_provenance(spark, tmp_path):
    path = tmp_path / "annotations.json"
    path.write_text(json.dumps(document()))
    images, _, annotations = source.read_annotations(spark, str(path))
    now = fingerprint.snapshot(spark, str(path), images, annotations)
    sha = one(now)["sha256"]

    def check(*row):
        return sorted(r["code"] for r in validate.provenance(spark.createDataFrame([row], PROV), now).collect())

    assert check(sha, "https://x", "2024-01-01T00:00:00+00:00", 1, 1) == []
    assert check(sha.upper(), "https://x", "2024-01-01T00:00:00Z", 1, 1) == []
    assert check("00", "https://x", "2024-01-01T00:00:00Z", 1, 1) == ["provenance", "provenance_sha256"]
    assert check("0" * 64, "https://x", "2024-01-01T00:00:00Z", 1, 1) == ["provenance_sha256"]
    assert check(sha, " ", "2024-01-01T00:00:00Z", 1, 1) == ["provenance"]
    assert check(sha, "https://x", "2024-01-01T00:00:00", 1, 1) == ["provenance"]
    assert check(sha, "https://x", "2024-01-01T00:00:00Z", 2, 0) == ["provenance", "provenance"]


# ---- metadata and cache --------------------------------------------------------------------


def counts(spark, **n):
    return spark.createDataFrame([(k, v) for k, v in n.items()], "class string, n bigint")


def test_metadata(spark):
    def report(per, kept, removed, disk):
        return {r["code"] for r in validate.metadata_report(*(counts(spark, **x) for x in (per, kept, removed, disk))).collect()}

    assert report({"can": 2}, {"can": 2}, {"cup": 0}, {"can": 2}) == set()
    assert report({"can": 2}, {"can": 2}, {"can": 2}, {"can": 2}) == {"metadata"}
    assert report({"can": 3}, {"can": 2}, {"cup": 0}, {"can": 2}) == {"metadata"}
    assert report({"can": 2, "lid": 1}, {"can": 2}, {"cup": 0}, {"can": 2}) == {"metadata"}
    assert report({"can": 2}, {"can": 2}, {"cup": 0}, {"can": 2, "cup": 1}) == {"crop_counts"}


CACHE = "path string, label string, features array<float>"


def test_cache_rules(spark):
    good = [(f"c/{k}/{f}.jpg", k, [1.0, 2.0, 3.0]) for k in ("can", "bottle") for f in "ab"]
    inventory = spark.createDataFrame([(k, p) for p, k, _ in good], "class string, path string")

    def report(data):
        cache = spark.createDataFrame(data, CACHE)
        found = validate.union_violations(
            validate.cache_vectors(cache, 3), validate.cache_labels(cache, inventory, ["can", "bottle"]), validate.cache_paths(cache, inventory),
            validate.cache_rows(cache, spark.createDataFrame([(4,)], "n_samples bigint")),
        )
        return {r["code"] for r in found.collect()}

    assert report(good) == set()
    swap = lambda i, row: good[:i] + [row] + good[i + 1 :]
    p, k, v = good[0]
    assert report(swap(0, (p, k, [1.0, 2.0]))) == {"cache_dimension"}
    assert report(swap(0, (p, k, [1.0, 2.0, float("inf")]))) == {"cache_finite"}
    assert report(swap(0, (p, "shoe", v))) == {"cache_label", "cache_labels"}
    assert report(swap(0, (good[1][0], k, v))) == {"duplicate_path", "cache_paths"}
    assert report(swap(0, ("c/can/z.jpg", k, v))) == {"cache_path", "cache_paths"}
    assert report(good[1:]) == {"cache_labels", "cache_paths", "cache_rows"}


def test_stored_fingerprint(spark):
    actual = spark.createDataFrame([(4, "0123456789abcdef")], "n_crops bigint, files_hash string")
    assert validate.fingerprints(actual, actual).count() == 0
    bad = spark.createDataFrame([(4, "XYZ")], "n_crops bigint, files_hash string")
    assert validate.fingerprints(bad, actual).count() == 2


def test_requests_are_checked_first():
    assert validate.check_inputs({}) == ["give at least one input"]
    assert validate.check_inputs({"cache": "x"}) == ["cache needs cache_meta", "cache needs crops", "crops and cache need the ordered class list"]
    assert validate.check_inputs({"annotations": "x"}) == []
    assert validate.check_inputs({"crops": "x"}, ["can", "CAN"]) == ["duplicate class 'CAN'"]


def test_empty_and_corrupt_tables(spark):
    empty = spark.createDataFrame([], schemas.IMAGE)
    assert one(validate.not_empty(empty, "images"))["code"] == "schema"
    broken = spark.createDataFrame([("{",), (None,)], "_corrupt_record string")
    assert validate.corrupt_records(broken, "images").count() == 1
    assert one(validate.report_ok(validate.not_empty(empty, "images")))["ok"] is False


def test_a_cut_off_shard_is_not_lost(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(document()))
    (tmp_path / "b.json").write_text(json.dumps(document())[:-40])
    _, _, annotations = source.read_annotations(spark, str(tmp_path))
    with pytest.raises(Exception, match="not a valid JSON document: b.json"):
        annotations.collect()
    assert rows(source.broken_documents(spark, str(tmp_path))) == [("json", "b.json", "not a valid JSON document")]


def test_doubled_categories_stay_and_repeated_lists_do_not(spark, tmp_path):
    doc = document()
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({"categories": doc["categories"]}))
    assert source.read_annotations(spark, str(tmp_path))[1].count() == len(doc["categories"])
    (tmp_path / "c.json").write_text(json.dumps({"categories": doc["categories"][:1] * 2}))
    _, categories, _ = source.read_annotations(spark, str(tmp_path))
    assert categories.count() == len(doc["categories"]) + 1
    assert {"duplicate_id", "category"} == {r["code"] for r in validate.ids(categories, "categories").union(validate.category_names(categories)).collect()}


def test_boxes_that_are_not_four_numbers_have_a_reason(spark):
    odd = [None, [1.0, 2.0, 3.0], [1.0, 2.0, float("nan"), 9.0], [1.0, 2.0, None, 9.0], [1.0, 2.0, 30.0, 30.0]]
    df = spark.createDataFrame([(i, box, 100, 100, 100, 100, None) for i, box in enumerate(odd)], "id int, bbox array<double>, width int, height int, actual_width int, actual_height int, reason string")
    got = rows(boxes.mark_small(boxes.expand_boxes(boxes.rescale_boxes(df))).select("id", "reason"))
    assert got == [(0, "bad_box"), (1, "bad_box"), (2, "bad_box"), (3, "bad_box"), (4, None)]


@pytest.mark.parametrize("leaf, depth", [(1000, 0), (20, 1), (2, 2)])
def test_tree_of_names(spark, leaf, depth):
    """The root by plain Python; it sees order of classes, names and how often one occurs, not the order of rows."""
    import hashlib
    from collections import Counter

    made = [("can" if i % 3 else "cup", f"n{i % 290}.jpg") for i in range(300)]

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def root(classes):
        counts = Counter(r for r in made if r[0] in classes)
        nodes = {}
        for h in sorted(sha(f"{classes.index(c) + 1}\t{c}/{f}\t{n}") for (c, f), n in counts.items()):
            nodes.setdefault(h[:depth], []).append(h)
        nodes = {k: sha("\n".join(v)) for k, v in nodes.items()}
        for level in range(depth - 1, -1, -1):
            up = {}
            for k, h in sorted(nodes.items()):
                up.setdefault(k[:level], []).append(f"{k}:{h}")
            nodes = {k: sha("\n".join(v)) for k, v in up.items()}
        return nodes[""][:16]

    table = spark.createDataFrame(made, "class string, file string").repartition(5)
    got = one(fingerprint.tree_fingerprint(table, ["can", "cup"], leaf))
    assert got == (300, root(["can", "cup"]), f"tree:{leaf}:{depth}")
    assert one(fingerprint.tree_fingerprint(table, ["cup", "can"], leaf))["files_hash"] != got["files_hash"]
    assert one(fingerprint.tree_fingerprint(table.limit(299), ["can", "cup"], leaf))["files_hash"] != got["files_hash"]
    assert one(fingerprint.tree_fingerprint(table.limit(0), ["can"], leaf)) == (0, sha("")[:16], f"tree:{leaf}:0")
