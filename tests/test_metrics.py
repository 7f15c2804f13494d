import random

import numpy as np
import pytest

from conftest import one, rows
from siltmark.operators import metrics

PRED = "rep int, arm string, clf string, item_id string, y_true string, y_pred string"


def preds(spark, noise, clf="b", reps=3, n=40):
    rng, names = random.Random(7), ["x", "y", "z"]
    out = []
    for r in range(reps):
        for i in range(n):
            t = names[i % 3]
            p = names[(names.index(t) + 1) % 3] if rng.random() < noise else t
            out.append((r, "a", clf, f"i{i}", t, p))
    return spark.createDataFrame(out, PRED)


def test_confusion_of_a_perfect_and_a_noisy_head(spark):
    perfect = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion(preds(spark, 0.0), ["x", "y", "z"]).collect()}
    assert sum(perfect.values()) == 120 and all(n == 0 for (t, p), n in perfect.items() if t != p)
    noisy = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion(preds(spark, 0.125), ["x", "y", "z"]).collect()}
    assert sum(noisy.values()) == 120 and all(noisy[c, c] > 0 for c in "xyz")
    shares = metrics.confusion_normalised(preds(spark, 0.125), ["x", "y", "z"]).groupBy("y_true").sum("share").collect()
    assert all(r[1] == pytest.approx(1.0) for r in shares)


def test_macro_f1_label_sets(spark):
    df = spark.createDataFrame([(0, "a", "b", "1", "x", "x"), (0, "a", "b", "2", "y", "w")], PRED)
    assert one(metrics.macro_f1(df))["macro_f1"] == pytest.approx(1 / 3)
    assert one(metrics.macro_f1(df, labels=["x", "y"]))["macro_f1"] == pytest.approx(0.5)
    assert one(metrics.macro_f1(df, labels=["x", "q"]))["macro_f1"] == pytest.approx(0.5)


def test_per_class(spark):
    df = spark.createDataFrame([(0, "a", "b", str(i), t, p) for i, (t, p) in enumerate(["xx", "xy", "yy"])], PRED)
    got = {r["class"]: tuple(r)[3:] for r in metrics.per_class_metrics(df, ["x", "y", "q"]).collect()}
    assert got["x"] == (1.0, 0.5, pytest.approx(2 / 3), 2) and got["y"] == (0.5, 1.0, pytest.approx(2 / 3), 1) and got["q"] == (0.0, 0.0, 0.0, 0)


def test_parity(spark):
    a = preds(spark, 0.0, reps=1)
    assert one(metrics.label_parity(a, a, "item_id"))["ok"]
    assert not one(metrics.label_parity(a, preds(spark, 0.3, reps=1), "item_id"))["ok"]
    half = one(metrics.label_parity(a, a.limit(1), "item_id"))
    assert half["agreement"] < 1 and not half["ok"]


COUNTS = "i int, j int, bits string, n bigint"


def test_overlap(spark):
    df = spark.createDataFrame([(0, 0, "00", 10), (0, 1, "0 0", 3), (0, 1, "01", 7), (1, 1, "00", 9), (1, 1, "10", 1)], COUNTS)
    assert rows(metrics.overlap_matrix(df)) == [(0, 0, 1.0, 10), (0, 1, 0.3, 10), (1, 0, 0.3, 10), (1, 1, 0.9, 10)]
    for bad in ([(0, 0, "02", 1)], [(0, 0, "", 1)], [(0, 0, "00", -1)], [(0, 0, "00", 0)]):
        with pytest.raises(Exception, match="counts need|no shots"):
            metrics.overlap_matrix(spark.createDataFrame(bad, COUNTS)).collect()


def _alignment(k, labels):
    t = (labels[:, None] == labels[None, :]).astype(float)
    c = lambda m: m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    k, t = c(k), c(t)
    return (k * t).sum() / (np.linalg.norm(k) * np.linalg.norm(t))


def test_alignment_of_a_table_and_of_vectors(spark):
    rng = np.random.default_rng(5)
    labels = np.array(list("aabbbccca"))
    x = rng.normal(size=(9, 4)) + 10 + (labels == "b")[:, None]
    k = x @ x.T
    table = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(9) for j in range(9)], "i int, j int, k double")
    names = spark.createDataFrame([(i, str(v)) for i, v in enumerate(labels)], "row_id int, label string")
    want = _alignment(k, labels)
    assert one(metrics.kernel_alignment(table, names))[0] == pytest.approx(want, rel=1e-9)
    df = spark.createDataFrame([(v.tolist(), str(y)) for v, y in zip(x, labels)], "features array<double>, label string")
    assert one(metrics.linear_alignment(df))[0] == pytest.approx(want, rel=1e-9)
