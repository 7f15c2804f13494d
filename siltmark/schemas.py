"""Explicit schemas of everything that is read; nothing is inferred."""

from __future__ import annotations

IMAGE = "id bigint, width bigint, height bigint, file_name string, flickr_640_url string, flickr_url string"
CATEGORY = "id bigint, name string, supercategory string"
ANNOTATION = "id bigint, image_id bigint, category_id bigint, bbox array<double>, area double, iscrowd int"
RESULT = (
    "rep int, seed bigint, arm string, arm_key string, clf string, selected string, "
    "selection_seconds double, accuracy double, macro_f1 double, fit_seconds double, predict_seconds double"
)

ARTIFACT_FIELDS = (
    "run_id string, rep int, arm string, arm_label string, seed bigint, selected array<int>, "
    "classes array<string>, y_test array<string>, test_ids array<string>, test_groups array<string>"
)
#: what a part of a document has besides
ARTIFACT_PART = "first bigint"
#: fields without which the rows of a document belong nowhere
ARTIFACT_KEYS = ("run_id", "rep", "arm")
HEAD = "accuracy double, macro_f1 double, fit_seconds double, predict_seconds double, predictions array<string>"

PREDICTION = (
    "run_id string, rep int, arm string, clf string, pos int, item_id string, grp string, y_true string, y_pred string"
)

MANIFEST = (
    "schema_version int, run_id string, status string, started_at string, finished_at string, config_sha256 string, "
    "seed bigint, classes array<string>, arms array<string>, reps_completed int, group_overlap_events int, "
    "artifacts map<string, struct<sha256: string, bytes: bigint>>, tables array<string>"
)

SPLIT_COLUMNS = ("rep", "row_id", "grp", "label", "is_test", "features")
EMBEDDING_COLUMNS = ("features", "label", "path")
