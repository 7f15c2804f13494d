import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import one
from siltmark.functions import batches as batches_of
from siltmark.operators import features, information, splits

SCHEMA = "rep int, row_id int, grp string, label string, is_test boolean, features array<double>"


def split_of(spark, x, y=None, test=None, reps=1, parts=3):
    n = len(x)
    y = np.asarray(y if y is not None else ["a", "b"] * n)[:n]
    test = test if test is not None else np.zeros(n, bool)
    data = [(r, i, f"g{i // 2}", str(y[i]), bool(test[i]), x[i].tolist()) for r in range(reps) for i in range(n)]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def matrix(df, rep=0, column="features"):
    got = df.where(F.col("rep") == rep).orderBy("row_id").select(column).collect()
    return np.array([r[0] for r in got])


def test_minmax_on_train_only(spark):
    x = np.array([[10.0], [20.0], [30.0], [5.0], [40.0]])
    out = matrix(features.minmax_fit_train(split_of(spark, x, test=np.array([0, 0, 0, 1, 1], bool))))[:, 0]
    assert out[0] == pytest.approx(0.05) and out[2] == pytest.approx(1.52) and out[3] < 0.05 and out[4] > 1.52


def test_standardise_constant_column(spark):
    x = np.column_stack([np.arange(6.0), np.full(6, 3.0)])
    z = matrix(features.standardise_train(split_of(spark, x)))
    assert np.allclose(z[:, 0].std(), 1) and (z[:, 1] == 0).all()


def reference_pca(train, rows, k):
    mean, std = train.mean(0), train.std(0)
    z = (train - mean) / np.where(std > 0, std, 1)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    v = vt[:k]
    v = v * np.sign(v[np.arange(k), np.abs(v).argmax(1)])[:, None]
    return ((rows - mean) / np.where(std > 0, std, 1)) @ v.T, 100 * (s[:k] ** 2).sum() / (s**2).sum()


def test_pca_against_numpy_far_from_zero(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6)) + 1000.0
    test = np.arange(80) % 4 == 0
    split = split_of(spark, x, test=test, reps=2)
    model = features.pca_train(split, 3)
    want, share = reference_pca(x[~test], x, 3)
    out = model.transform(split)
    assert np.allclose(matrix(out), want, atol=1e-8) and np.allclose(matrix(out, 1), want, atol=1e-8)
    assert model.explained_pct[0] == pytest.approx(share) and out.schema["transform_fit"].dataType.simpleString() == "string"


def test_whole_table_features_are_refused(spark):
    x = np.random.default_rng(1).normal(size=(30, 4))
    tagged = features.pca_global(split_of(spark, x), 2).transform(split_of(spark, x))
    with pytest.raises(Exception, match="fitted on all rows"):
        features.quantile_bins(tagged, 4).count()


def columns(rng, n=700):
    return np.column_stack(
        [
            rng.normal(size=n),
            rng.integers(0, 3, n).astype(float),  # heavy ties
            np.full(n, 2.5),  # constant
            np.exp(5 * rng.normal(size=n)),  # far outliers
            np.where(rng.random(n) < 0.4, 7.0, rng.random(n)),  # one value holds 40 % of the rows
            np.arange(n) / 3.0,
        ]
    )


def test_exact_quantiles_equal_numpy(spark):
    x = columns(np.random.default_rng(3))
    split = split_of(spark, x, parts=5)
    for accuracy in (2000, 3):  # a useless sketch must not change the result
        got = features.quantile_edges(split, 16, accuracy=accuracy).collect()
        want = np.quantile(x, np.linspace(0, 1, 17), axis=0)
        assert len(got) == 6
        for r in got:
            assert np.allclose(r["edges"], want[:, r["f"]], rtol=1e-12, atol=0), r["f"]


def binned(x, bins):
    out = np.zeros(x.shape, int)
    for f in range(x.shape[1]):
        e = np.quantile(x[:, f], np.linspace(0, 1, bins + 1))
        e = e[np.concatenate([[True], np.diff(e) > 1e-8])]
        out[:, f] = np.searchsorted(e[1:-1], x[:, f], side="right")
    return out


def mutual(a, b):
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    c = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(c, (a, b), 1)
    p = c / c.sum()
    e = p.sum(1)[:, None] * p.sum(0)[None, :]
    return (p[p > 0] * np.log(p[p > 0] / e[p > 0])).sum()


def test_codes_and_information_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x = columns(rng)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=len(x)) > 0, "p", "q")
    out = features.quantile_bins(split_of(spark, x, y), 8)
    codes = matrix(out, column="codes")
    assert (codes == binned(x, 8)).all()
    mi = {r["f"]: r["mi"] for r in information.mi_label(out).collect()}
    assert all(mi[f] == pytest.approx(mutual(codes[:, f], y), abs=1e-12) for f in range(6))
    pairs = {(r["fi"], r["fj"]): r["mi"] for r in information.mi_pairs(out, 8).collect()}
    assert len(pairs) == 15 and all(v == pytest.approx(mutual(codes[:, a], codes[:, b]), abs=1e-12) for (a, b), v in pairs.items())
    assert {r["f"] for r in information.live_features(out).collect()} == {0, 1, 3, 4, 5}


def test_label_names_do_not_matter(spark):
    x = np.random.default_rng(6).normal(size=(120, 3))
    y = np.array(["a", "b", "c"] * 40)
    renamed = np.array([{"a": "5", "b": "2", "c": "8"}[v] for v in y])
    one_, two = (information.mi_label(features.quantile_bins(split_of(spark, x, v), 4)).orderBy("f").collect() for v in (y, renamed))
    assert [r["mi"] for r in one_] == pytest.approx([r["mi"] for r in two])


def test_held_out_rows_change_nothing(spark):
    rng = np.random.default_rng(8)
    x, test = rng.normal(size=(100, 4)), np.arange(100) % 5 == 0
    other = np.where(test[:, None], x * 100 + 7, x)
    y = np.array(["a", "b"] * 50)

    def fitted(v):
        split = split_of(spark, v, y, test)
        train = features.train_rows(features.quantile_bins(split, 4))
        return (
            features.moments_train(split).orderBy("f").select("f", "n", F.round("mean", 9), F.round("std", 9)).collect(),
            information.mi_label(train).orderBy("f").select("f", F.round("mi", 12)).collect(),
            information.mi_pairs(train, 4).orderBy("fi", "fj").select("fi", "fj", F.round("mi", 12)).collect(),
            features.pca_train(split, 2).components[0].round(9).tolist(),
        )

    assert fitted(x) == fitted(other)


def test_approximate_edges_are_close(spark):
    x = np.arange(2000.0)[:, None]
    got = one(features.quantile_edges(split_of(spark, x), 4, exact=False))["edges"]
    assert np.allclose(got, [0, 500, 1000, 1500, 1999], atol=3)


def test_split_then_bins_by_repeat(spark):
    x = np.random.default_rng(9).normal(size=(60, 2))
    rows = split_of(spark, x).drop("rep", "is_test")
    out = features.quantile_bins(splits.group_split(rows, "grp", [0, 1], 0.25), 4)
    assert out.count() == 120 and out.where(F.exists("codes", lambda c: (c < 0) | (c > 3))).count() == 0


def masked(spark, n=90, d=5, parts=3, reps=(0, 1, 2)):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(n, d)), 2) + 500.0
    rows = spark.createDataFrame([(i, f"g{i % 30}", "a" if i % 2 else "b", x[i].tolist()) for i in range(n)], "row_id int, grp string, label string, features array<double>")
    rows = rows.repartition(parts)
    return splits.group_masks(rows, "grp", reps, 0.3, 7), splits.group_split(rows, "grp", reps, 0.3, 7)


@pytest.mark.parametrize("parts", [3, 70])
def test_masks_give_what_copies_give(spark, monkeypatch, parts):
    """One copy of the rows and a mask per repeat, in blocks of features and through two levels of sums."""
    rows, split = masked(spark, parts=parts)
    reps = [0, 1, 2]
    near = lambda df, *order: [tuple(r) for r in df.orderBy(*order).collect()]
    for a, b in zip(near(features.moments_train(rows, reps), "rep", "f"), near(features.moments_train(split), "rep", "f"), strict=True):
        assert a == pytest.approx(b, rel=1e-12)
    ours, theirs = features.pca_train(rows, 3, reps), features.pca_train(split, 3)
    for r in reps:
        assert np.allclose(ours.components[r], theirs.components[r]) and np.allclose(ours.std[r], theirs.std[r])
    cuts = features.train_cuts(rows, 4, reps=reps)
    binned = features.train_rows(features.quantile_bins(split, 4))
    want = near(information.mi_pairs(binned, 4), "rep", "fi", "fj")
    monkeypatch.setattr(information, "TABLE_BYTES", 8 * 16 * 5 * 3 * 2)  # two features a scan
    got = near(information.mi_pairs(rows, 4, reps, cuts), "rep", "fi", "fj")
    assert len(got) == 3 * 10
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-12)


def test_masked_plans_neither_copy_nor_sort(spark):
    rows, split = masked(spark)
    cuts = features.train_cuts(rows, 4, reps=[0, 1, 2])
    centre = spark.createDataFrame([(f, 500.0) for f in range(5)], "f int, c double")
    for df in (features.moments_train(rows, [0, 1, 2]), features.gram_train(rows, centre, [0, 1, 2]), information.mi_pairs(rows, 4, [0, 1, 2], cuts).where("rep = 0")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Sort" not in plan and "Aggregate" not in plan
    assert "Generate" in split._jdf.queryExecution().optimizedPlan().toString()


def test_masks_of_empty_tables(spark):
    rows, _ = masked(spark)
    none = rows.where("row_id < 0")
    assert features.moments_train(none, [0, 1, 2]).count() == 0
    assert information.mi_pairs(none, 4, [0, 1, 2], {}).count() == 0


def counted(spark, rows):
    """The rows and how many of them any scan has read so far."""
    seen = spark.sparkContext.accumulator(0)

    def task(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(task, rows.schema), seen


def test_exact_quantiles_scan_rows_twice(spark):
    """A sketch, then counts and values at once; a third scan only where the sketch was poor. Held-out rows change no edge."""
    x = columns(np.random.default_rng(12))
    test = np.stack([np.arange(len(x)) % 4 == r for r in range(2)], 1)
    x[test.all(1)] += 1e6
    data = [([bool(not t) for t in side], row.tolist()) for side, row in zip(test, x, strict=True)]
    table = spark.createDataFrame(data, "train array<boolean>, features array<double>").repartition(4)
    for accuracy, scans in ((3, 2), (40, 2), (100_000, 3)):
        rows, seen = counted(spark, table)
        got = features.quantile_edges(rows, 16, accuracy=accuracy, reps=[4, 7]).collect()
        assert seen.value == scans * len(x), accuracy
        assert {(r["rep"], r["f"]) for r in got} == {(rep, f) for rep in (4, 7) for f in range(6)}
        for r in got:
            want = np.quantile(x[~test[:, (4, 7).index(r["rep"])], r["f"]], np.linspace(0, 1, 17))
            assert np.allclose(r["edges"], want, rtol=1e-12, atol=1e-15), (accuracy, r["rep"], r["f"])


def test_values_of_many_batches_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(features, "PICKED", 10)
    x = columns(np.random.default_rng(13))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.zeros(100, np.int32)), batches_of.lists(x[i : i + 100])], names=["rep", "features"]) for i in range(0, 700, 100)]
    bounds = [np.unique(x[:, f])[::40] for f in range(6)]
    found = pa.Table.from_batches(features._picked(iter(batches), bounds, lambda rep, f: np.ones(2 * len(bounds[f]) + 1, bool), None)).to_pandas()
    assert found.groupby(["f", "inside"])["c"].sum().tolist() == [700] * 12
    for f in range(6):
        values = found[(found["f"] == f) & found["inside"]].groupby("x")["c"].sum()
        assert (np.repeat(values.index, values) == np.sort(x[:, f])).all()


def test_code_counts_equal_codes_counted(spark):
    rows, split = masked(spark, parts=5)
    reps = [0, 1, 2]
    out = features.code_counts(rows, features.train_cuts(rows, 4, reps=reps), reps)
    codes = features.quantile_bins(split, 4).select("rep", "is_test", F.posexplode("codes").alias("f", "code"))
    want = codes.groupBy("rep", "is_test", "f", "code").agg(F.count(F.lit(1)).alias("n"))
    assert out.columns == want.columns and [t for _, t in out.dtypes] == [t for _, t in want.dtypes]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    none = rows.where("row_id < 0")
    assert features.code_counts(none, features.train_cuts(none, 4, reps=reps), reps).count() == 0
    # a repeat without train rows has no cuts and so no codes
    one_sided = rows.withColumn("train", F.array(F.lit(False), F.lit(True), F.lit(False)))
    assert {r["rep"] for r in features.code_counts(one_sided, features.train_cuts(one_sided, 4, reps=reps), reps).collect()} == {1}
