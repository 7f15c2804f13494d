import itertools
import random

import pytest

from conftest import one, rows
from siltmark.functions import tails
from siltmark.operators import golden, metrics, significance

RESULT = "rep int, arm string, clf string, accuracy double"


def results(spark, per_arm, clf="rbf_svm"):
    return spark.createDataFrame([(i, a, clf, v) for a, vs in per_arm.items() for i, v in enumerate(vs)], RESULT)


def test_exact_tail_by_listing_all_signs():
    for n in (1, 3, 5, 8):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 2 + 1):
            low = min(w, n * (n + 1) // 2 - w)
            want = min(1.0, 2 * sum(s <= low for s in sums) / 2**n)
            assert tails.signed_rank_exact(w, n) == pytest.approx(want)
    assert tails.signed_rank_exact(15, 5) == 0.0625


def test_student_tail_known_values():
    for t, df, p in ((2.776445, 4, 0.05), (2.063899, 24, 0.05), (12.7062047, 1, 0.05), (0.0, 7, 1.0), (3.745, 25, 0.00095)):
        assert tails.student_two_sided(t, df) == pytest.approx(p, rel=2e-2 if p < 0.01 else 1e-5)


def test_identical_or_single_pairs_have_p_one(spark):
    r = results(spark, {"a": [0.4, 0.5, 0.6], "b": [0.4, 0.5, 0.6]})
    got = one(significance.paired_significance(r))
    assert got["wilcoxon_p_holm"] == got["paired_t_p_holm"] == 1.0 and not got["significant"]
    got = one(significance.paired_significance(results(spark, {"a": [0.4], "b": [0.5]})))
    assert got["paired_t_p_holm"] == 1.0 and got["wilcoxon_p_holm"] == 1.0


def test_five_repeats_cannot_be_significant(spark):
    r = results(spark, {"a": [0.51, 0.62, 0.73, 0.84, 0.95], "b": [0.1, 0.2, 0.3, 0.4, 0.5]})
    got = one(significance.paired_significance(r))
    assert got["wilcoxon_p_holm"] == 0.0625 and not got["significant"] and got["wilcoxon_method"] == "exact"


def test_holm_against_a_second_form(spark):
    rng = random.Random(3)
    p = [round(rng.random() ** 3, 6) for _ in range(12)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    got = [r["q"] for r in significance.holm(df, "p", "q", ["i"]).orderBy("i").collect()]
    ranked = sorted(range(12), key=lambda i: p[i])
    for pos, i in enumerate(ranked):
        want = min(1.0, max((12 - k) * p[j] for k, j in enumerate(ranked[: pos + 1])))
        assert got[i] == pytest.approx(want)


def test_all_pairs_and_one_family(spark):
    rng = random.Random(1)
    r = results(spark, {a: [0.4 + 0.01 * i + 0.05 * rng.random() for _ in range(30)] for i, a in enumerate("abcd")})
    got = significance.paired_significance(r).collect()
    assert len(got) == 6
    diffs = significance.paired_diffs(r)
    raw = significance.signed_rank(diffs).withColumn("p", tails.wilcoxon_p("w_plus", "n", "ties", "zeros")).collect()
    p = {(x["arm_a"], x["arm_b"]): x["p"] for x in raw}
    smallest = min(p.values())
    assert min(x["wilcoxon_p_holm"] for x in got) == pytest.approx(min(1.0, 6 * smallest), abs=5e-5)


def test_signed_rank_with_ties_and_zeros(spark):
    df = spark.createDataFrame([("c", "a", "b", d) for d in (0.0, 0.1, -0.1, 0.2, 0.3)], "clf string, arm_a string, arm_b string, diff double")
    got = one(significance.signed_rank(df))
    assert (got["n"], got["zeros"], got["w_plus"], got["w_minus"], got["ties"]) == (4, 1, 8.5, 1.5, 6.0)


def test_duplicates_are_reported(spark):
    r = results(spark, {"a": [0.1, 0.2]})
    assert rows(significance.duplicate_results(r.union(r.where("rep = 1")))) == [("rbf_svm", "a", 1, 2)]


def test_early_stop(spark):
    flat = results(spark, {"q": [0.3, 0.5] * 4 + [0.4] * 6})
    got = [r["rep"] for r in significance.converged(flat, "q", "rbf_svm").orderBy("rep").collect() if r["stop"]]
    assert got == [12, 13]
    assert significance.before_stop(flat, "q", "rbf_svm").count() == 13
    rising = results(spark, {"q": [0.1 + 0.02 * i for i in range(20)]})
    assert significance.before_stop(rising, "q", "rbf_svm").count() == 20
    assert not any(r["stop"] for r in significance.converged(results(spark, {"q": [0.4] * 9}), "q", "rbf_svm").collect())


CELL = "arm string, classifier string, metric string, mean double, std double"


def test_golden_statuses(spark):
    base = spark.createDataFrame(
        [("A", "x", "accuracy", 0.5, 0.02), ("B", "x", "accuracy", 0.5, 0.0), ("C", "x", "accuracy", 0.5, 0.02)], CELL
    )
    made = spark.createDataFrame(
        [("A", "x", "accuracy", 0.525, 0.1), ("B", "x", "accuracy", 0.52, 0.1), ("D", "x", "accuracy", 0.9, 0.1)], CELL
    )
    got = {r["arm"]: (r["status"], r["ok"]) for r in golden.compare_golden(made, base, metrics=["accuracy"]).collect()}
    assert got == {"A": ("OK", True), "B": ("MISMATCH", False), "C": ("MISSING", False), "D": ("NO_BASELINE", None)}
    v = one(golden.verdict(golden.compare_golden(made, base, metrics=["accuracy"])))
    assert (v["comparable"], v["failed"], v["skipped"], v["first_failure"], v["verdict"]) == (3, 2, 1, "B/x/accuracy", "FAIL")
    nothing = golden.compare_golden(made, base.limit(0), metrics=["accuracy"])
    assert one(golden.verdict(nothing))["verdict"] == "FAIL"


def test_single_repeat_has_no_deviation(spark):
    r = spark.createDataFrame([(0, "a", "x", 0.4, 0.3)], "rep int, arm string, clf string, accuracy double, macro_f1 double")
    got = one(metrics.summarise(r))
    assert got["accuracy_mean"] == 0.4 and got["accuracy_std"] is None


def test_grid_and_ledger(spark):
    grid = golden.param_grid(spark, reps=[1, 2, 3], entanglement=["linear", "full"], budget=[4, 6, 8, 12, 4])
    assert grid.count() == 24
    with pytest.raises(ValueError):
        golden.param_grid(spark, reps=[])
    keys = ["reps", "entanglement", "budget"]
    done = grid.where("reps = 1")
    states = {r["state"]: r["count"] for r in golden.pending(grid, done, keys, limit=1).groupBy("state").count().collect()}
    assert states == {"reused": 8, "run": 1, "remaining": 15}
