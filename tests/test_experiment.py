import numpy as np
import pytest

from conftest import one, rows
from siltmark.config import ConfigError, ExperimentConfig, flatten
from siltmark.operators import audit, golden, selection, validate
from siltmark.plans import experiment, severity
from siltmark.sources import runs as run_source

CLASSES = ("bottle", "can", "cigarette")
GOOD = dict(classes=CLASSES, n_repeats=5, pca_components=10, k=4, max_train_rows=60, arms=("A_random", "B_pca", "C_mi", "D_qubo", "F_mrmr", "Z_full"), mi_bins=4)


def vectors(spark, n=96, d=12):
    rng = np.random.default_rng(21)
    data = []
    for i in range(n):
        c = i % 3
        x = rng.normal(size=d)
        x[c] += 5.0
        photo = f"batch_{i // 6 + 1}_{i // 6:04d}"
        data.append((f"crops/{CLASSES[c]}/{photo}_ann{i}.jpg", photo, CLASSES[c], x.tolist()))
    return spark.createDataFrame(data, "row_id string, grp string, label string, features array<double>")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("runs"))
    cfg = ExperimentConfig(**GOOD)
    out = experiment.store_experiment(vectors(spark), cfg, root, "r1", sweeps=60, head_names=("rbf_svm", "linear_svm"))
    return root, cfg, out


def test_end_to_end(spark, stored):
    root, cfg, out = stored
    results = out.results.collect()
    assert len(results) == 5 * 6 * 2
    full = [r["accuracy"] for r in results if r["arm_key"] == "Z_full" and r["clf"] == "rbf_svm"]
    assert np.mean(full) > 0.6
    assert {r["arm"] for r in results} == {"Random-4", "PCA-4", "MI-4", "QUBO-4", "mRMR-4", "Full-10"}
    assert selection.selection_violations(out.selections, 4).count() == 0
    assert out.significance.count() == 2 * 15
    assert all(0 < v <= 100.0001 for v in out.explained_pct.values())
    assert all(r["fit_seconds"] > 0 and r["predict_seconds"] > 0 for r in results)


def test_the_stored_run_passes_its_audit(spark, stored):
    root, cfg, _ = stored
    catalog = run_source.read_runs(spark, root)
    run = one(catalog)
    assert (run["status"], run["reps_completed"], run["group_overlap_events"]) == ("complete", 5, 0)
    pred = run_source.read_prediction_table(spark, f"{root}/r1/predictions")
    files = vectors(spark).selectExpr("substring_index(row_id, '/', -1) as file")
    verdict = one(audit.audit_runs(pred, files, catalog))
    assert verdict["verdict"] == "PASS", verdict
    assert validate.prediction_report(pred, list(cfg.arms)).count() == 0


def test_the_stored_run_can_be_served(spark, stored):
    root, _, _ = stored
    pred = severity.predictions_for(spark, root, "C_mi", "rbf_svm")
    zones = severity.severity(pred, {"cigarette": 3.0, "bottle": 1.0, "can": 1.0}, ["bottle", "can"])
    assert zones.count() <= 6 and zones.agg({"total": "sum"}).collect()[0][0] == pred.select("item_id").distinct().count()


def test_an_altered_part_file_is_noticed(spark, tmp_path):
    from pathlib import Path

    root = str(tmp_path)
    cfg = ExperimentConfig(**{**GOOD, "arms": ("B_pca", "Z_full")})
    experiment.store_experiment(vectors(spark), cfg, root, "r2", head_names=("linear_svm",))
    severity.predictions_for(spark, root, "B_pca", "linear_svm").count()
    part = next(Path(root, "r2", "summary").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    next(Path(root, "r2", "summary").glob(".part-*.crc")).unlink()
    with pytest.raises(severity.ProvenanceError, match="hash_differs"):
        severity.predictions_for(spark, root, "B_pca", "linear_svm")


def test_positions_are_the_same_for_every_arm(spark, stored):
    root, _, _ = stored
    pred = run_source.read_prediction_table(spark, f"{root}/r1/predictions")
    per_spot = pred.groupBy("rep", "pos").agg({"item_id": "min"}).count()
    assert per_spot == pred.select("rep", "pos", "item_id").distinct().count() == pred.select("rep", "item_id").distinct().count()


@pytest.mark.parametrize(
    "change",
    [
        {"seed": -1}, {"classes": ("a",)}, {"classes": ("a", "a")}, {"classes": ("a", "..")}, {"classes": ("a", "b/c")}, {"classes": ("a", " b")},
        {"pca_components": 9}, {"pca_components": 201}, {"k": 1}, {"k": 11}, {"mi_bins": 33}, {"sa_sweeps": 10}, {"sa_reads": 4}, {"max_train_rows": 10},
        {"test_fraction": 0.6}, {"n_repeats": 4}, {"n_repeats": 101}, {"arms": ()}, {"arms": ("C_mi", "C_mi")}, {"arms": ("X",)}, {"early_stop": True},
        {"min_images_per_class": 9}, {"k": 10, "max_qsvm_features": 8},
    ],
)
def test_settings_are_checked(change):
    with pytest.raises(ConfigError):
        ExperimentConfig(**{**GOOD, **change})


def test_settings_drift(spark):
    frozen = flatten(ExperimentConfig(**GOOD).as_dict())
    moved = flatten({**ExperimentConfig(**{**GOOD, "k": 5, "classes": CLASSES[::-1]}).as_dict(), "extra": {"x": 1}})
    frames = [spark.createDataFrame(v, "path string, value string") for v in (frozen, moved)]
    assert rows(golden.config_drift(*frames).select("path", "kind")) == [("classes", "differs"), ("extra.x", "unknown"), ("k", "differs")]


def test_versions(spark):
    pins = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "package string, version string")
    have = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "package string, version string")
    assert rows(golden.version_drift(pins, have).select("package", "kind")) == [("b", "mismatch"), ("c", "not-installed"), ("d", "missing")]
