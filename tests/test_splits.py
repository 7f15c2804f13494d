import hashlib
import math

import pytest

from conftest import one, rows
from siltmark.functions.ranking import global_rank, hash_cutoffs, repeat_cutoffs
from siltmark.operators import features, splits
from pyspark.sql import functions as F


def vectors(spark, n=60, per_group=3, hot=0):
    data = [(f"r{i}", "hot" if i < hot else f"g{i // per_group}", "ab"[i % 2], [float(i), 1.0]) for i in range(n)]
    return spark.createDataFrame(data, "row_id string, grp string, label string, features array<double>")


def test_share_is_of_groups_and_none_is_on_both_sides(spark):
    split = splits.group_split(vectors(spark), "grp", range(4), 0.3, 42)
    sides = split.select("rep", "grp", "is_test").distinct().collect()
    for rep in range(4):
        groups = [r["grp"] for r in sides if r["rep"] == rep]
        assert len(groups) == len(set(groups)) == 20
        test = {r["grp"] for r in sides if r["rep"] == rep and r["is_test"]}
        order = sorted(set(groups), key=lambda g: hashlib.md5(f"{42 + rep}:{g}".encode()).hexdigest())
        assert test == set(order[: math.ceil(0.3 * 20)])
    assert splits.group_overlap(split).count() == 0 and splits.shared_groups(split.where("rep = 0")).count() == 0


def test_a_group_with_a_third_of_all_rows(spark):
    split = splits.group_split(vectors(spark, 300, hot=100), "grp", [0, 1], 0.25, 1)
    assert split.count() == 600
    assert split.where("grp = 'hot'").select("rep", "is_test").distinct().count() == 2


def test_the_plan_of_a_split_has_no_join_and_no_shuffle(spark):
    split = splits.group_split(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey"), "l_orderkey", [0, 1])
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_cutoffs_pick_exactly_n(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    for n in (1, 17, 4999, 5000, 9000):
        cut = one(hash_cutoffs(df, ["k"], "h", F.lit(n)))["cutoff"]
        assert df.where(F.col("h") <= cut).count() == min(n, 5000)
        for enough in (1, 50, 10**6):
            assert repeat_cutoffs(df.withColumnRenamed("k", "rep"), "h", lambda total: n, enough=enough) == {1: cut}
    assert hash_cutoffs(df, ["k"], "h", F.lit(0)).count() == 0
    assert repeat_cutoffs(df, "h", lambda total: 0, "k") == {} == repeat_cutoffs(df.limit(0), "h", lambda total: 5, "k")


def test_hashes_are_made_twice_whatever_the_depth(spark):
    """What shares the first pass's prefix is kept for the passes after it."""
    seen = spark.sparkContext.accumulator(0)

    def task(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(20000).select(F.lit(1).alias("rep"), F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    want = df.orderBy("h").offset(6999).first()["h"]
    assert repeat_cutoffs(df.mapInArrow(task, df.schema), "h", lambda total: 7000, enough=0) == {1: want}
    assert seen.value == 2 * 20000


def test_caps(spark):
    rows_ = vectors(spark, 90).withColumn("rep", F.explode(F.array(F.lit(0), F.lit(1))))
    capped = splits.cap_rows(rows_, 25, 7)
    assert {r["rep"]: r["count"] for r in capped.groupBy("rep").count().collect()} == {0: 25, 1: 25}
    relabelled = splits.cap_rows(rows_.withColumn("label", F.lit("z")), 25, 7)
    assert rows(capped.select("rep", "row_id")) == rows(relabelled.select("rep", "row_id"))
    small = splits.cap_rows_stratified(rows_.withColumn("label", F.substring("row_id", -1, 1)), 30, 7)
    counts = small.groupBy("rep", "label").count().collect()
    assert len(counts) == 20 and min(r["count"] for r in counts) >= 2
    assert splits.cap_rows_stratified(rows_, 500, 7).count() == 180


def test_stratified_cap_refusals(spark):
    base = vectors(spark, 12).withColumn("rep", F.lit(0))
    with pytest.raises(Exception, match="under twice"):
        splits.cap_rows_stratified(base, 3, 1).collect()
    lonely = base.withColumn("label", F.when(F.col("row_id") == "r0", "c").otherwise("a"))
    with pytest.raises(Exception, match="two training rows"):
        splits.cap_rows_stratified(lonely, 8, 1).collect()


def contract(spark, **change):
    train = [(f"t{i}", f"s{i // 2}", "abc"[i % 3], False, [0.0] * 12) for i in range(12)]
    test = [(f"e{i}", f"q{i // 2}", "abc"[i % 3], True, [0.0] * 12) for i in range(6)]
    data = [list(r) for r in train + test]
    for (row, col), value in change.get("cells", {}).items():
        data[row][col] = value
    df = spark.createDataFrame([tuple(r) for r in data], "row_id string, grp string, label string, is_test boolean, features array<double>")
    return {r["code"] for r in splits.split_violations(df, transform_fit=change.get("fit", "raw")).collect()}


def test_split_contract(spark):
    assert contract(spark) == set()
    assert contract(spark, cells={(0, 0): "t1"}) == {"split_ids"}
    assert contract(spark, cells={(12, 1): "s0", (13, 1): "s0"}) == {"split_groups"}
    assert contract(spark, cells={(12, 2): "z"}) == {"split_labels"}
    assert contract(spark, cells={(0, 0): ""}) == {"split_empty"}
    assert contract(spark, cells={(0, 4): [0.0] * 11}) == {"split_width"}
    assert contract(spark, cells={(0, 4): [float("nan")] + [0.0] * 11}) == {"split_finite"}
    assert contract(spark, fit="all_rows") == {"split_transform"}
    assert contract(spark, cells={(i, 2): "a" for i in range(18)}) == {"split_classes"}


def test_shared_repeats(spark):
    df = spark.createDataFrame([(0, "a", True), (1, "a", True), (2, "b", True), (1, "b", True), (2, "a", False)], "rep int, grp string, is_test boolean")
    assert rows(splits.repeats_sharing(df)) == [(0, 1, 1), (1, 2, 1)]


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0, "a")] * 3 + [(0, "b")], "rep int, label string")
    assert {r["label"]: r["weight"] for r in splits.balanced_weights(df).collect()} == {"a": pytest.approx(4 / 6), "b": 2.0}


def test_global_rank_is_a_permutation(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("k")).repartition(6)
    got = {r["id"]: r["rank"] for r in global_rank(df, [F.col("k").desc(), F.col("id").asc()]).collect()}
    want = sorted(range(3000), key=lambda i: (-(i % 7), i))
    assert [got[i] for i in want] == list(range(1, 3001))


def test_fraction_is_checked(spark):
    with pytest.raises(ValueError):
        splits.group_split(vectors(spark), "grp", [0], 1.0)
    assert features.train_rows(splits.group_split(vectors(spark), "grp", [0], 0.5)).count() > 0


def test_prepared_split_and_its_record(spark):
    from siltmark.plans.prepare import prepare_split

    split = splits.group_split(vectors(spark, 60), "grp", [0, 1], 0.3)
    prepared, record = prepare_split(split, 2, max_train=20, bins=4)
    got = one(record.where("rep = 1"))
    assert got["selected"][0] == 0 and len(got["ids_train"]) == len(got["groups_train"]) == 20 and len(got["ids_test"]) == split.where("rep = 1 and is_test").count()
    assert not set(got["groups_train"]) & set(got["groups_test"])
    train = [r["features"] for r in prepared.where("rep = 1 and not is_test").collect()]
    assert min(v[0] for v in train) == pytest.approx(0.05) and max(v[0] for v in train) == pytest.approx(1.52)
    for bad in (dict(budget=1), dict(budget=3), dict(budget=2, max_train=500)):
        with pytest.raises(ValueError):
            prepare_split(split, **bad)


def test_cap_with_an_id_on_a_third_of_the_rows(spark, monkeypatch):
    import hashlib

    ids = ["hot"] * 2000 + [f"r{i}" for i in range(4000)]
    df = spark.createDataFrame([(rep, x, i) for rep in (0, 1) for i, x in enumerate(ids)], "rep int, row_id string, i int")
    fetched, collect = [], type(df).collect

    def counted(self):
        fetched.append(collect(self))
        return fetched[-1]

    for n in (300, 4200):
        order = {rep: sorted(hashlib.md5(f"{rep + 7}:{x}".encode()).hexdigest() for x in ids) for rep in (0, 1)}
        hot = {rep: hashlib.md5(f"{rep + 7}:hot".encode()).hexdigest() for rep in (0, 1)}
        n += max(order[rep].index(hot[rep]) for rep in (0, 1)) if n == 300 else 0
        with monkeypatch.context() as m:
            m.setattr(type(df), "collect", counted)
            capped = splits.cap_rows(df, n, 7)
        assert max(map(len, fetched)) <= 2 * 4096 and len(fetched[-1]) <= 2 * 1000
        got = capped.collect()
        assert len({(r.rep, r.i) for r in got}) == len(got) == 2 * n
        for rep in (0, 1):
            assert sorted(hashlib.md5(f"{rep + 7}:{r.row_id}".encode()).hexdigest() for r in got if r.rep == rep) == order[rep][:n]


def test_preparation_reads_every_train_row(spark):
    """Ranking and range against NumPy, with 14 features of which the capped rows alone would not show the best."""
    import numpy as np
    from siltmark.plans.prepare import prepare_split

    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 14))
    y = rng.integers(0, 2, 600)
    for f in range(14):
        x[:, f] += 0.06 * f * y
    df = spark.createDataFrame([(i, f"g{i % 200}", "ab"[y[i]], x[i].tolist()) for i in range(600)], "row_id int, grp string, label string, features array<double>")
    split = splits.group_split(df, "grp", [0, 1], 0.3)
    prepared, record = prepare_split(split, 13, max_train=20, bins=4)
    found, test = {}, {(r.rep, r.row_id): r.is_test for r in split.select("rep", "row_id", "is_test").collect()}
    for r in prepared.collect():
        found[r.rep, r.row_id] = r
    assert {k: r.is_test for k, r in found.items()} == test
    for rec in record.collect():
        train = np.array(sorted(i for (rep, i), held in test.items() if rep == rec.rep and not held))
        score = []
        for f in range(14):
            code = np.searchsorted(np.quantile(x[train, f], [0.25, 0.5, 0.75]), x[train, f], side="right")
            joint = np.array([[((code == c) & (y[train] == k)).mean() for k in (0, 1)] for c in range(4)])
            flat = np.outer(joint.sum(1), joint.sum(0))
            score.append(float((joint[joint > 0] * np.log(joint[joint > 0] / flat[joint > 0])).sum()))
        want = sorted(range(14), key=lambda f: (-round(score[f], 12), f))[:13]
        low, high = x[train][:, want].min(0), x[train][:, want].max(0)
        assert rec.selected == want and rec.scores == pytest.approx([score[f] for f in want])
        assert rec.range_min == pytest.approx(low) and rec.range_max == pytest.approx(high) and rec.n_ranked == len(train)
        for i in range(600):
            assert found[rec.rep, i].features == pytest.approx(0.05 + (x[i, want] - low) * 1.47 / (high - low))
        assert rec.ids_train == [i for i in range(600) if found[rec.rep, i].in_fit] and len(rec.ids_train) == 20


def test_rows_without_a_group_stay_in_training(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"g{i % 4}") for i in range(40)], "row_id int, grp string")
    got = splits.group_split(df, "grp", [0, 1])
    assert got.count() == 80 and got.where("grp is null and is_test").count() == 0 and got.where("is_test").count() > 0
