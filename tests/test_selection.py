import itertools

import numpy as np
import pytest

from conftest import rows
from siltmark.operators import features, heads, selection
from test_features import split_of

PLANTED = (3, 11, 17, 24, 29)


def planted(n=500, d=32):
    rng = np.random.default_rng(2)
    y = np.array(["a", "b"])[rng.integers(0, 2, n)]
    x = rng.normal(size=(n, d))
    for i, c in enumerate(PLANTED):
        x[:, c] += (0.8 + 0.2 * i) * (y == "b")
    return x, y


@pytest.fixture(scope="module")
def ctx(spark):
    x, y = planted()
    split = split_of(spark, x, y).persist()
    made = selection.SelectionContext(split, [0], 32, seed=1, bins=8, reads=6, sweeps=100)
    yield made
    made.release()


def chosen(df):
    return sorted(r["f"] for r in df.collect())


@pytest.mark.parametrize("arm", ["C_mi", "D_qubo", "F_mrmr", "E_lasso"])
def test_planted_features_are_found(ctx, arm):
    got = chosen(selection.select_features(arm, ctx, 5))
    assert len(got) == len(set(got)) == 5
    assert len(set(got) & set(PLANTED)) >= 3


@pytest.mark.parametrize("arm", ["A_random", "B_pca", "D_qubo", "F_mrmr"])
def test_same_seed_same_set(ctx, arm):
    a, b = (chosen(selection.select_features(arm, ctx, 4)) for _ in range(2))
    assert a == b and len(a) == 4


def test_simple_arms(ctx):
    assert chosen(selection.select_features("B_pca", ctx, 3)) == [0, 1, 2]
    assert chosen(selection.select_features("Z_full", ctx, 3)) == list(range(32))


@pytest.mark.parametrize("k", [0, 33])
@pytest.mark.parametrize("arm", ["A_random", "B_pca", "C_mi", "D_qubo", "E_lasso", "F_mrmr"])
def test_impossible_budgets(ctx, arm, k):
    with pytest.raises(selection.BudgetError):
        selection.select_features(arm, ctx, k)


def test_unknown_arm(ctx):
    with pytest.raises(ValueError, match="unknown arm"):
        selection.select_features("G_other", ctx, 3)


def test_annealing_finds_the_minimum():
    rng = np.random.default_rng(11)
    n = 10
    linear = -rng.random(n)
    pair = np.triu(rng.random((n, n)), 1)
    pair = pair + pair.T
    energy = lambda x: x @ linear + sum(pair[i, j] * x[i] * x[j] for i, j in itertools.combinations(range(n), 2))
    best = min(energy(np.array(x)) for x in itertools.product((0, 1), repeat=n))
    reads = 10
    x, found = selection.anneal(np.tile(linear, (reads, 1)), (np.ones(reads), pair), [np.random.default_rng([3, r]) for r in range(reads)], 200)
    assert found == pytest.approx([energy(v) for v in x]) and found.min() == pytest.approx(best)


def test_qubo_trace_and_exact_budget(ctx):
    out = selection.select_qubo(ctx.mi, ctx.pairs, 32, 6, seed=1, reads=6, sweeps=100)
    trace = out.trace.orderBy("alpha").collect()
    counts = [r["n_selected"] for r in trace]
    assert out.selection.count() == 6 and all(0 < r["alpha"] <= 1 for r in trace)
    assert 6 in counts or trace[0]["nudged"]
    assert counts[0] <= 6 <= counts[-1]
    again = selection.select_qubo(ctx.mi, ctx.pairs, 32, 6, seed=1, reads=6, sweeps=100)
    assert chosen(again.selection) == chosen(out.selection)


def test_a_set_is_resized_by_energy():
    relevance, redundancy = np.array([1.0, 0.9, 0.8, 0.1]), np.zeros((4, 4))
    redundancy[0, 1] = redundancy[1, 0] = 5.0
    assert selection.resized({0, 1, 2}, 2, 0.5, relevance, redundancy) == [0, 2] or selection.resized({0, 1, 2}, 2, 0.5, relevance, redundancy) == [1, 2]
    assert selection.resized({0}, 2, 0.5, relevance, redundancy) == [0, 2]
    assert selection.resized(set(), 1, 1.0, relevance, redundancy) == [0]


def test_constant_features_are_not_candidates(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(200, 1))
    x = np.hstack([base + 0.01 * rng.normal(size=(200, 3)), np.full((200, 1), 1.0)])
    y = np.where(base[:, 0] > 0, "a", "b")
    made = selection.SelectionContext(split_of(spark, x, y), [0], 4, bins=4)
    assert 3 not in chosen(selection.select_features("F_mrmr", made, 3))
    with pytest.raises(Exception, match="only 3 features vary"):
        selection.select_features("F_mrmr", made, 4).collect()
    made.release()


def test_ties_go_to_the_lowest_feature(spark):
    df = spark.createDataFrame([(0, f, s) for f, s in enumerate([0.5, 0.9, 0.5, 0.9, 0.5])], "rep int, f int, mi double")
    assert chosen(selection.select_mi(df, 5, 3)) == [0, 1, 3]


def test_stored_selections(spark):
    df = spark.createDataFrame([(0, "C_mi", [1, 2, 3]), (1, "C_mi", [1, 1, 3]), (2, "C_mi", [1]), (0, "Z_full", list(range(9)))], "rep int, arm string, selected array<int>")
    assert rows(selection.selection_violations(df, 3)) == [(1, "C_mi", 3, 2), (2, "C_mi", 1, 1)]


def test_heads_separate_clean_classes(spark):
    rng = np.random.default_rng(12)
    y = np.array(["a", "b", "c"] * 60)
    x = rng.normal(size=(180, 5)) + 4 * np.eye(5)[[{"a": 0, "b": 1, "c": 2}[v] for v in y]]
    split = split_of(spark, x, y, np.arange(180) % 4 == 0).persist()
    picks = spark.createDataFrame([(0, "Z_full", [0, 1, 2, 3, 4]), (0, "B_pca", [0, 1])], "rep int, arm string, selected array<int>")
    models = heads.fit_heads(split, picks, max_train=60)
    pred = models.predict(split).persist()
    assert pred.count() == 45 * 2 * 3
    right = pred.where("arm = 'Z_full'").groupBy("clf").agg({"*": "count"}).count()
    assert right == 3
    share = pred.where("arm = 'Z_full' and y_true = y_pred").count() / (45 * 3)
    assert share > 0.9
    facts = models.models.select("clf", "method", "n_train").distinct().collect()
    assert {(r["clf"], r["method"]) for r in facts} == {("rbf_svm", "rbf_exact"), ("rbf_svm_tuned", "rbf_exact"), ("linear_svm", "linear_ls")}
    assert {r["n_train"] for r in facts} == {60}
    with pytest.raises(ValueError):
        heads.fit_heads(split, picks, heads=("qsvm",))
    _, linear = heads.linear_head(split, max_iter=20)
    assert linear.where("y_true = y_pred").count() / 45 > 0.9
    _, rbf = heads.rbf_head(split, 5, 0.1, out=64, max_iter=20)
    assert rbf.where("y_true = y_pred").count() / 45 > 0.9
    _, reg = heads.tuned_head(split, regs=(0.01, 10.0), max_iter=10)
    assert reg == 0.01


def test_deployed_head_reproduces_itself(spark, tmp_path):
    rng = np.random.default_rng(13)
    y = np.array(["a", "b"] * 40)
    x = rng.normal(size=(80, 4)) + 3 * (y == "b")[:, None]
    split = split_of(spark, x, y, np.arange(80) % 4 == 0)
    _, parity = heads.deploy_head(split, [0, 1], 3, str(tmp_path / "head"), max_train=40)
    assert parity.collect()[0]["agreement"] == 1.0


def test_arms_in_one_table(ctx):
    got = selection.run_arms(["A_random", "B_pca", "Z_full"], ctx, 4).collect()
    assert {r["arm"]: len(r["selected"]) for r in got} == {"A_random": 4, "B_pca": 4, "Z_full": 32}
    assert next(r for r in got if r["arm"] == "Z_full")["seconds"] == 0.0


def test_bins_are_reused(ctx):
    assert ctx.mi is ctx.mi and isinstance(ctx.pairs, type(ctx.binned)) and features.EDGE_GAP == 1e-8


def test_tuned_head_predicts_every_held_out_row(spark):
    from conftest import SMALL
    from workloads import bindings as b
    from workloads.registry import QUERIES

    got = QUERIES["tuned_head"](spark, SMALL).collect()
    want = {(r.rep, str(r.row_id)): r.label for r in b.vector_split(spark, SMALL).where("is_test").collect()}
    assert len(got) == len(want) and {(r.rep, r.item_id): r.y_true for r in got} == want
    assert {r.reg for r in got} <= {0.001, 0.01, 0.1} and {r.rep for r in got} == set(b.VECTOR_REPS)
    assert {r.y_pred for r in got} <= set(want.values()) and len({r.y_pred for r in got}) > 1


def test_rows_are_lifted_only_to_be_fitted_and_scored(spark):
    """Classes are counted on the rows as they are: a lift, a Python pass over all rows, is in two plans, each with one side."""
    from siltmark.operators import heads

    split = spark.createDataFrame(
        [(0, str(i), str(i), "ab"[i % 2], i % 4 == 3, [float(i % 2), 1.0 * (i % 3)]) for i in range(40)],
        "rep int, row_id string, grp string, label string, is_test boolean, features array<double>",
    )
    sides = []

    def lift(df):
        sides.append({r["is_test"] for r in df.select("is_test").distinct().collect()})
        return heads.fourier_features(df, 2, 0.5, 16)

    _, pred = heads.linear_head(split, lift=lift)
    assert sides == [{False}, {True}]
    _, same = heads.rbf_head(split, 2, 0.5, out=16)
    assert sorted(pred.select("item_id", "y_pred").collect()) == sorted(same.select("item_id", "y_pred").collect())
    assert pred.where("y_true = y_pred").count() == pred.count() == 10


@pytest.mark.parametrize("name", ["linear_head", "rbf_head"])
def test_head_counts_hang_on_fit_and_predictions(spark, monkeypatch, name):
    """Rows of each class were counted whatever the model said of them, so that no row was scored."""
    from conftest import SMALL
    from pyspark.sql import functions as F
    from workloads import registry

    whole, seen = {r["y_true"]: r["n"] for r in registry.QUERIES[name](spark, SMALL).collect()}, []
    fit = getattr(heads, name)

    def other(change):
        def head(*args, **kw):
            fitted, pred = fit(*args, **kw)
            seen.append({(r["y_true"], r["y_pred"]): r["n"] for r in pred.groupBy("y_true", "y_pred").agg(F.count("*").alias("n")).collect()})
            return fitted, change(pred)

        monkeypatch.setattr(heads, name, head)
        return {r["y_true"]: r["n"] for r in registry.QUERIES[name](spark, SMALL).collect()}

    assert other(lambda pred: pred) == whole
    lost = other(lambda pred: pred.where("y_pred <> 'A'"))
    assert len({p for _, p in seen[0]}) == 3 and {t: whole[t] - lost[t] for t in whole} == {t: seen[0][t, "A"] for t in whole}
    assert set(other(lambda pred: pred.withColumn("gap", F.lit(0.1))).values()) == {0}
    monkeypatch.setattr(heads, name, fit)
    plain = heads.lowered
    monkeypatch.setattr(heads, "lowered", lambda fitted: plain(fitted) and seen.append(fitted.stages[1].summary.objectiveHistory))
    assert set(r["n"] for r in registry.QUERIES[name](spark, SMALL).collect()) == {0}
    assert seen[-1][-1] < seen[-1][0]


def test_gaps_of_predictions(spark):
    """The gap by NumPy: none where the best class was given, and how far another is behind; a single class has infinite scores."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    y = np.array(["a", "b", "?"] * 20)
    x = rng.normal(size=(60, 2)) + 1.5 * (y == "b")[:, None]
    split = split_of(spark, x, y, np.arange(60) % 4 == 0)
    fitted, pred = heads.linear_head(split, max_iter=20)
    assert heads.lowered(fitted) and {r["gap"] for r in pred.collect()} == {0.0}
    model, test = fitted.stages[1], split.where("is_test")
    names = [*fitted.stages[0].labels, "?"]
    for k, name in enumerate(names):
        given = test.withColumns({"prediction": F.lit(float(k)), "y_pred": F.lit(name)})
        rows_ = given.select("features", heads._gap(model, names).alias("gap")).collect()
        score = np.array([r["features"] for r in rows_]) @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
        assert [r["gap"] for r in rows_] == pytest.approx((score.max(1) - score[:, k]).tolist(), abs=1e-12)
    wrong = test.withColumns({"prediction": F.lit(0.0), "y_pred": F.lit(names[1])}).select(heads._gap(model, names).alias("gap"))
    assert {r["gap"] for r in wrong.collect()} == {None}
    fitted, pred = heads.linear_head(split_of(spark, x, np.array(["a"] * 60), np.arange(60) % 4 == 0), max_iter=5)
    assert heads.lowered(fitted) and {(r["y_pred"], r["gap"]) for r in pred.collect()} == {("a", 0.0)}
