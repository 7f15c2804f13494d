"""Stored documents record by record: one bad record is one finding, and its neighbours stay."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from siltmark.operators import golden, validate
from siltmark.sources import annotations as source
from siltmark.sources import runs as run_source

IMAGE = {"id": 0, "width": 120, "height": 100, "file_name": "batch_1/source.jpg"}
CATEGORY = {"id": 0, "name": "Glass bottle", "supercategory": "Bottle"}
BOX = {"id": 1, "image_id": 0, "category_id": 0, "bbox": [10, 5, 40.5, 30], "area": 1200, "iscrowd": 0}


def write(folder, name, **change):
    doc = {"images": [IMAGE], "categories": [CATEGORY], "annotations": [BOX, BOX | {"id": 2}, BOX | {"id": 3}]} | change
    (folder / name).write_text(json.dumps({k: v for k, v in doc.items() if v != "absent"}))


def findings(spark, path, **more):
    return rows(source.document_findings(spark, str(path), **more).select("code", "path"))


@pytest.mark.parametrize(
    "entry, kept, found",
    [
        (7, 2, [("schema", "a.json:annotations[1]")]),
        (None, 2, [("schema", "a.json:annotations[1]")]),
        ([BOX], 2, [("schema", "a.json:annotations[1]")]),
        ("text", 2, [("schema", "a.json:annotations[1]")]),
        (BOX | {"id": "two"}, 3, []),
        (BOX | {"id": True}, 3, []),
        (BOX | {"id": 2.5}, 3, []),
        (BOX | {"id": 2, "bbox": [1, "2", 3, 4]}, 3, []),
        (BOX | {"id": 2, "bbox": {"x": 1}}, 3, []),
        ({}, 3, []),
    ],
)
def test_one_bad_record_costs_one_record(spark, tmp_path, entry, kept, found):
    write(tmp_path, "a.json", annotations=[BOX, entry, BOX | {"id": 3}])
    images, categories, annotations = source.read_annotations(spark, str(tmp_path))
    assert annotations.count() == kept and images.count() == categories.count() == 1
    assert findings(spark, tmp_path) == found
    good = rows(annotations.where("id IN (1, 3)").select("id", "bbox", "area"))
    assert good == [(1, [10.0, 5.0, 40.5, 30.0], 1200.0), (3, [10.0, 5.0, 40.5, 30.0], 1200.0)]
    codes = {r["code"] for r in validate.annotation_report(images, categories, annotations).collect()}
    assert codes == (set() if found else {"bbox"} if isinstance(entry, dict) and "bbox" in entry and entry["bbox"] != BOX["bbox"] else codes & {"id", "bbox", "reference"})
    assert bool(codes) == (not found)


@pytest.mark.parametrize("value", ["oops", 7, {}, None, [], "absent"])
def test_a_list_of_another_type_is_a_finding(spark, tmp_path, value):
    write(tmp_path, "a.json", annotations=value)
    write(tmp_path, "b.json")
    images, _, annotations = source.read_annotations(spark, str(tmp_path))
    assert annotations.count() == 3 and images.count() == 2
    assert findings(spark, tmp_path) == [("schema", "a.json:annotations")]
    assert findings(spark, tmp_path, required=["images"]) == ([] if value == "absent" else [("schema", "a.json:annotations")])


@pytest.mark.parametrize("text", ['{"annotations": [{"id": 1}', "[1]", "7", " ", '{"a": 1, "a": 2}', '{"images": [1]} more', '{"images": [NaN]}'])
def test_what_is_no_document_fails_or_is_left_out(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    write(tmp_path, "b.json")
    with pytest.raises(Exception, match="not a valid JSON document: a.json"):
        source.read_annotations(spark, str(tmp_path))[2].collect()
    assert source.read_annotations(spark, str(tmp_path), skip_broken=True)[2].count() == 3
    assert findings(spark, tmp_path) == [("json", "a.json")] == rows(source.broken_documents(spark, str(tmp_path)).select("code", "path"))


def test_documents_by_lines(spark, tmp_path):
    lines = [json.dumps({"annotations": [BOX | {"id": i}, 7]}) for i in range(5)] + ["", '{"annotations":', json.dumps({"annotations": []})]
    (tmp_path / "a.json").write_text("\n".join(lines))
    kept = source.read_annotations(spark, str(tmp_path), one_per_file=False, skip_broken=True)[2]
    assert rows(kept.select("id")) == [(i,) for i in range(5)]
    found = findings(spark, tmp_path, one_per_file=False, required=["annotations"])
    assert sorted(found) == sorted([("json", "a.json"), ("schema", "a.json:annotations")] + [("schema", "a.json:annotations[1]")] * 5)


def test_artifacts_field_by_field(spark, tmp_path):
    good = {"run_id": "r", "rep": 0, "arm": "A", "test_ids": ["x", "y"], "test_groups": ["g", "h"], "y_test": ["a", "b"], "metrics": {"u": {"accuracy": 1, "predictions": ["a", "b"]}}}
    documents = {
        "rep0_A.json": good,
        "rep1_A.json": good | {"rep": 1, "test_ids": {"x": 1}},
        "rep2_A.json": good | {"rep": 2, "metrics": "lost"},
        "rep3_A.json": good | {"rep": "three"},
        "rep4_A.json": good | {"rep": 4, "metrics": good["metrics"] | {"v": 7, "w": {"predictions": "a"}}},
        "rep5_A.json": good | {"rep": 5, "test_ids": [1, 2]},
    }
    for name, doc in documents.items():
        (tmp_path / name).write_text(json.dumps(doc))
    pred = rows(run_source.read_predictions(spark, str(tmp_path)).select("rep", "clf", "pos", "item_id", "y_pred"))
    assert [r for r in pred if r[0] in (0, 1)] == [(0, "u", 0, "x", "a"), (0, "u", 1, "y", "b"), (1, "u", 0, None, "a"), (1, "u", 1, None, "b")]
    assert [r[3] for r in pred if r[0] == 5] == ["1", "2"] and {r[1] for r in pred if r[0] == 4} == {"u", "w"}
    found = rows(run_source.artifact_findings(spark, str(tmp_path / "*.json")).select("code", "path"))
    assert found == sorted(("schema", p) for p in ("rep1_A.json:test_ids", "rep2_A.json:metrics", "rep3_A.json:rep", "rep4_A.json:metrics.v", "rep4_A.json:metrics.w.predictions"))


def test_null_is_a_key_like_any_other(spark):
    schema = "a int, b string, payload string"
    ledger = spark.createDataFrame([(None, "x", "p"), (1, None, "p"), (None, None, "p")], schema)
    more = [(None, "x", "p"), (1, None, "q"), (None, None, "p"), (None, "y", "p"), (2, None, "p"), (2, None, "r"), (None, "y", "p")]
    new, conflicts = golden.append_new(spark.createDataFrame(more, schema), ledger, ["a", "b"])
    assert rows(new) == [(None, "y", "p")]
    assert sorted(rows(conflicts), key=str) == sorted([(1, None), (2, None)], key=str)


def test_new_cells_of_an_exploded_plan_are_never_broadcast(spark):
    """The planner takes an exploded table for as small as its source, so a join of it would broadcast millions of rows."""
    plan = golden.expand_grid(spark.range(50).select("id"), depth=[1, 2], budget=[4, 6]).withColumn("payload", F.lit("n"))
    ledger = plan.where("id < 20").withColumn("payload", F.when(F.col("id") < 5, "o").otherwise("n"))
    for part, n in zip(golden.append_new(plan, ledger, ["id", "depth", "budget"]), (120, 20), strict=True):
        assert part.count() == n
        text = part._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in text and "Broadcast" not in text


def test_a_document_in_parts_is_one_document(spark, tmp_path):
    """Parts of 2 entries: positions go on from part to part, a fault of all parts is one finding, no row holds the document."""
    for arm, ids in (("A", ["a", "b"]), ("B", "lost")):
        (tmp_path / f"0_{arm}").mkdir()
        lines = [
            {"run_id": "r", "rep": 0, "arm": arm, "first": at, "test_ids": ids, "y_test": ["u", "v"], "metrics": {"c": {"predictions": ["u", str(at)]}}}
            for at in (0, 2, 4)
        ]
        (tmp_path / f"0_{arm}" / "part.txt").write_text("\n".join(map(json.dumps, lines)))
    path = str(tmp_path / "*" / "*.txt")
    made = run_source.tidy(run_source.read_artifacts(spark, path, in_parts=True))
    assert rows(made.where("arm = 'A'").select("pos", "item_id", "y_pred")) == [
        (i, "ab"[i % 2], "u" if i % 2 == 0 else str(i - 1)) for i in range(6)
    ]
    assert made.where("arm = 'B' and item_id is null and y_true is not null").count() == 6
    found = run_source.artifact_findings(spark, path, in_parts=True)
    assert rows(found.select("code", "path")) == [("schema", "0_B:test_ids")]
    (tmp_path / "0_A" / "part.txt").write_text('{"run_id": "r", "rep": 0, "arm": "A", "metrics": {"c": {"predictions": []}}}')
    assert ("schema", "0_A:first") in rows(run_source.artifact_findings(spark, path, in_parts=True).select("code", "path"))
