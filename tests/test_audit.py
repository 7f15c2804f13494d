import json

import pytest
from pyspark.sql import functions as F

from conftest import one, rows
from siltmark import schemas
from siltmark.operators import audit, fingerprint, runs, validate
from siltmark.plans import severity
from siltmark.sinks import writers
from siltmark.sources import runs as run_source

PHOTOS = [(cls, f"batch_{i + 1}_{cls}{i}") for cls in ("can", "bottle") for i in range(4)]
CROPS = [(cls, f"{photo}_ann{j}.jpg", photo) for cls, photo in PHOTOS for j in (0, 1)]
ARMS = ["D_qubo", "Z_full"]


def documents():
    """2 arms x 2 repeats; a repeat holds out three photos with both of their crops."""
    out = {}
    for rep in range(2):
        held = [p for _, p in PHOTOS[rep : rep + 3]]
        items = [(c, f, p) for c, f, p in CROPS if p in held]
        for arm in ARMS:
            out[rep, arm] = {
                "schema_version": 1, "run_id": "r1", "rep": rep, "arm": arm, "selected": [0, 1],
                "test_ids": [f"crops/{c}/{f}" for c, f, _ in items], "test_groups": [p for _, _, p in items],
                "y_test": [c for c, _, _ in items],
                "metrics": {clf: {"accuracy": 1.0, "predictions": [c for c, _, _ in items]} for clf in ("rbf_svm", "linear_svm")},
            }
    return out


def store(spark, root, docs, run_id="r1", status="complete", overlap=0, tamper=None, **more):
    import hashlib

    folder = root / run_id
    folder.mkdir(parents=True)
    artifacts = {}
    for (rep, arm), doc in docs.items():
        name = f"rep{rep}_{arm}.json"
        (folder / name).write_text(json.dumps(doc, indent=1))
        raw = (folder / name).read_bytes()
        artifacts[name] = {"sha256": hashlib.sha256(raw).hexdigest(), "bytes": len(raw)}
        if tamper == (rep, arm):
            (folder / name).write_bytes(raw + b" ")
    manifest = {
        "run_id": run_id, "status": status, "arms": ARMS, "reps_completed": 2, "group_overlap_events": overlap,
        "started_at": "2024-01-01T00:00:00+00:00", "finished_at": "2024-01-01T01:00:00+00:00", "artifacts": artifacts, **more,
    }
    (folder / "run_manifest.json").write_text(json.dumps(manifest))
    return folder


def audited(spark, root, inventory=None):
    catalog = run_source.read_runs(spark, str(root))
    pred = run_source.read_predictions(spark, str(root / "r1"))
    files = spark.createDataFrame([(f,) for _, f, _ in CROPS] if inventory is None else [(f,) for f in inventory], "file string")
    actual = fingerprint.artifact_inventory(spark, str(root / "r1")).withColumn("run_id", F.lit("r1"))
    wrong = fingerprint.verify_artifacts(run_source.recorded_artifacts(catalog), actual).where("problem = 'hash_differs'")
    parts = F.regexp_extract("artifact", r"^rep(\d+)_(.*)\.json$", 1), F.regexp_extract("artifact", r"^rep(\d+)_(.*)\.json$", 2)
    wrong = wrong.select("run_id", parts[0].cast("int").alias("rep"), parts[1].alias("arm"))
    reps = audit.audit_repeats(pred, files, catalog.where("status = 'complete'"), wrong)
    return reps, audit.audit_runs(pred, files, catalog, wrong)


def faults(reps):
    names = [
        "duplicate_test_ids", "misaligned_artifacts", "hash_mismatches", "arms_with_different_split",
        "group_label_mismatches", "held_out_missing", "straddling_groups",
    ]
    return {n for r in reps.collect() for n in names if r[n]}


def test_a_clean_run(spark, tmp_path):
    store(spark, tmp_path, documents())
    reps, verdict = audited(spark, tmp_path)
    assert faults(reps) == set()
    assert rows(reps.select("rep", "n_test", "n_groups", "groups_with_multiple_crops", "ok")) == [(0, 6, 3, 3, True), (1, 6, 3, 3, True)]
    v = one(verdict)
    assert (v["verdict"], v["repeats"], v["repeats_sharing"], v["overlap_agrees"], v["error"]) == ("PASS", 2, 1, True, None)


def change(docs, where, **edit):
    for key, doc in docs.items():
        if where == "all" or key == where:
            for field, fn in edit.items():
                doc[field] = fn(doc[field])
    return docs


def drop_last(doc):
    doc["test_ids"], doc["test_groups"], doc["y_test"] = doc["test_ids"][:-1], doc["test_groups"][:-1], doc["y_test"][:-1]
    for m in doc["metrics"].values():
        m["predictions"] = m["predictions"][:-1]


def test_straddling(spark, tmp_path):
    docs = documents()
    for doc in docs.values():
        if doc["rep"] == 1:
            drop_last(doc)
    store(spark, tmp_path, docs)
    reps, verdict = audited(spark, tmp_path)
    assert faults(reps) == {"straddling_groups"}
    v = one(verdict)
    assert (v["verdict"], v["recomputed_overlap"], v["overlap_agrees"]) == ("FAIL", 1, False)


@pytest.mark.parametrize(
    "edit, fault",
    [
        (lambda d: change(d, "all", test_groups=lambda g: ["elsewhere"] + g[1:]), {"group_label_mismatches"}),
        (lambda d: change(d, "all", y_test=lambda y: y[:-1]), {"misaligned_artifacts"}),
        (lambda d: change(d, (0, "D_qubo"), metrics=lambda m: {**m, "rbf_svm": {"predictions": m["rbf_svm"]["predictions"][:-1]}}), {"misaligned_artifacts"}),
        (lambda d: change(d, (0, "Z_full"), test_ids=lambda t: t[::-1], test_groups=lambda g: g[::-1]), {"arms_with_different_split"}),
        (lambda d: change(d, "all", test_ids=lambda t: t[:-1] + t[:1], test_groups=lambda g: g[:-1] + g[:1]), {"duplicate_test_ids", "straddling_groups"}),
    ],
)
def test_one_defect_each(spark, tmp_path, edit, fault):
    store(spark, tmp_path, edit(documents()))
    reps, verdict = audited(spark, tmp_path)
    assert faults(reps) == fault
    assert one(verdict)["verdict"] == "FAIL"


def test_tampered_and_missing_artifacts(spark, tmp_path):
    store(spark, tmp_path, documents(), tamper=(1, "Z_full"))
    reps, _ = audited(spark, tmp_path)
    assert faults(reps) == {"hash_mismatches"}
    (tmp_path / "r1" / "rep0_D_qubo.json").unlink()
    reps, _ = audited(spark, tmp_path)
    assert faults(reps) == {"hash_mismatches", "misaligned_artifacts"}


def test_files_gone_from_the_inventory(spark, tmp_path):
    store(spark, tmp_path, documents())
    reps, _ = audited(spark, tmp_path, inventory=[f for _, f, p in CROPS if p != PHOTOS[0][1]])
    assert faults(reps) == {"held_out_missing"}
    _, verdict = audited(spark, tmp_path, inventory=[])
    assert one(verdict)["error"] == "the inventory is empty"


def test_heads_of_one_artifact_share_its_list(spark, tmp_path):
    store(spark, tmp_path, documents())
    pred = run_source.read_predictions(spark, str(tmp_path / "r1"))
    swap = (F.col("rep") == 0) & (F.col("arm") == "Z_full") & (F.col("clf") == "rbf_svm") & F.col("pos").isin(0, 1)
    swapped = pred.withColumn("pos", F.when(swap, 1 - F.col("pos")).otherwise(F.col("pos")))
    facts = audit.artifact_alignment(audit.artifact_facts(swapped)).where("misaligned > 0")
    assert rows(facts.select("rep", "arm")) == [(0, "Z_full")]


def test_unfinished_runs_are_not_evidence(spark, tmp_path):
    store(spark, tmp_path, documents(), status="running")
    _, verdict = audited(spark, tmp_path)
    assert tuple(one(verdict.select("verdict", "error"))) == ("FAIL", "not a complete run")


def test_recorded_overlap_must_agree(spark, tmp_path):
    store(spark, tmp_path, documents(), overlap=2)
    _, verdict = audited(spark, tmp_path)
    assert one(verdict)["error"] == "recorded overlap differs"


# ---- predictions for the severity index -------------------------------------------------------


def test_served_predictions(spark, tmp_path):
    store(spark, tmp_path, documents())
    pred = severity.predictions_for(spark, str(tmp_path), "D_qubo", "rbf_svm")
    assert pred.count() == 12
    zt = severity.severity(pred, {"can": 1.0, "bottle": 1.0}, ["can", "bottle"])
    assert zt.agg(F.sum("total")).collect()[0][0] == 8 and zt.where("vote_agreement < 1").count() == 0


@pytest.mark.parametrize(
    "case, message",
    [
        ("arm", "did not run arm"), ("head", "no held-out"), ("open", "not complete"), ("tamper", "hash_differs"), ("gone", "missing"),
        ("twice", "duplicate_id"), ("short", "alignment"), ("truth", "truth"), ("none", "no complete run"), ("unlisted", "unrecorded"),
    ],
)
def test_doubtful_runs_are_refused(spark, tmp_path, case, message):
    docs, arm, clf, run = documents(), "D_qubo", "rbf_svm", None
    arm = "G" if case == "arm" else arm
    clf = "qsvm" if case == "head" else clf
    if case == "twice":
        change(docs, "all", test_ids=lambda t: t[:-1] + t[:1])
    if case == "short":
        change(docs, "all", y_test=lambda y: y[:-1])
    if case == "truth":
        change(docs, (1, "D_qubo"), y_test=lambda y: ["bottle"] * len(y))
    more = {"reps_completed": 3} if case == "unlisted" else {}
    folder = store(spark, tmp_path, docs, status="running" if case == "open" else "complete", tamper=(0, "D_qubo") if case == "tamper" else None, **more)
    if case == "gone":
        (folder / "rep1_D_qubo.json").unlink()
    if case == "open":
        run = "r1"
    if case == "none":
        (folder / "run_manifest.json").write_text("{broken")
    with pytest.raises(severity.ProvenanceError, match=message):
        severity.predictions_for(spark, str(tmp_path), arm, clf, run)


# ---- catalog ---------------------------------------------------------------------------------------


def test_catalog_lists_broken_and_bare_runs(spark, tmp_path):
    store(spark, tmp_path, documents())
    for name, text in (("bad", "{broken"), ("bare", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "note.txt").write_text("x")
        if text:
            (tmp_path / name / "run_manifest.json").write_text(text)
    catalog = run_source.read_runs(spark, str(tmp_path))
    assert rows(catalog.select("run_id", "status", "reps_completed")) == [("bad", "corrupt_manifest", 0), ("bare", "no_manifest", 0), ("r1", "complete", 2)]
    assert catalog.where("size_bytes > 0 and finished_at is not null").count() == 3
    listed = runs.list_runs(catalog, run_source.read_predictions(spark, str(tmp_path / "r1")))
    assert {r["run_id"]: (r["clfs"], r["selectable"]) for r in listed.collect()} == {
        "bad": ([], False), "bare": ([], False), "r1": (["linear_svm", "rbf_svm"], True),
    }


RUN = "run_id string, status string, started_at timestamp, finished_at timestamp, reps_completed int, size_bytes bigint"


def catalog(spark, *data):
    base = spark.createDataFrame(
        [(n, s, "2024-01-01 00:00:00", f, r, 2048) for n, s, f, r in data],
        "run_id string, status string, started_at string, finished_at string, reps_completed int, size_bytes bigint",
    )
    return base.withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")})


def plan(spark, df, **rule):
    return {r["run_id"]: (r["delete"], r["reason"]) for r in runs.retention_plan(df, "2024-02-01 00:00:00", **rule).collect()}


def test_retention(spark):
    df = catalog(
        spark, ("a", "complete", "2024-01-30 00:00:00", 5), ("b", "complete", "2024-01-10 00:00:00", 25),
        ("c", "complete", "2024-01-10 00:00:00", 5), ("d", "running", None, 0), ("e", "failed", "2023-06-01 00:00:00", 0),
    )
    assert plan(spark, df, keep=2) == {"a": (False, "recent"), "b": (False, "recent"), "c": (True, "outside keep"), "d": (False, "running"), "e": (True, "outside keep")}
    got = plan(spark, df, keep=1, max_age_days=25)
    assert got["b"] == (False, "young") and got["e"] == (True, "too old") and got["a"] == (False, "recent")
    bare = df.withColumns({c: F.lit(None).cast("timestamp") for c in ("started_at", "finished_at")})
    assert plan(spark, bare, max_age_days=1)["a"] == (False, "no timestamp")
    assert [r["run_id"] for r in runs.rank_runs(df).orderBy("rank").collect()] == ["a", "b", "c", "d", "e"]
    assert one(runs.best_run(df))["run_id"] == "b"
    totals = {r["delete"]: r["size"] for r in runs.retention_totals(runs.retention_plan(df, "2024-02-01 00:00:00", keep=2)).collect()}
    assert totals == {False: "6.0 kB", True: "4.0 kB"}
    with pytest.raises(ValueError):
        runs.retention_plan(df, "2024-02-01", keep=-1)


def test_a_run_is_complete_only_at_the_end(spark, tmp_path):
    root = str(tmp_path / "runs")

    def status():
        return rows(run_source.read_runs(spark, root).select("run_id", "status"))

    pred = spark.createDataFrame([("x", r, "D_qubo", "rbf_svm", 0, "crops/can/a_ann1.jpg", "a", "can", "can") for r in (0, 1)], schemas.PREDICTION)
    with writers.run_context(spark, root, "x", arms=["D_qubo"], seed=1) as run:
        assert status() == [("x", "running")]
        writers.write_predictions(pred, run.table("predictions"))
        picks = spark.createDataFrame([(0, "D_qubo", [1]), (1, "D_qubo", [2])], "rep int, arm string, selected array<int>")
        writers.write_documents(pred, picks, f"{run.path}/documents")
        run.manifest.update(reps_completed=2, group_overlap_events=0)
    assert status() == [("x", "complete")]
    back = run_source.read_prediction_table(spark, f"{root}/x/predictions")
    assert rows(back.select(*pred.columns)) == rows(pred)
    with pytest.raises(RuntimeError, match="stop"):
        with writers.run_context(spark, root, "y"):
            raise RuntimeError("stop")
    assert ("y", "failed") in status()
    with pytest.raises(ValueError):
        with writers.run_context(spark, root, "../z"):
            pass


def test_stored_documents_read_back(spark, tmp_path):
    pred = spark.createDataFrame(
        [("x", r, a, c, i, f"crops/can/p{i}_ann1.jpg", f"p{i}", "can", "can") for r in (0, 1) for a in ARMS for c in ("u", "v") for i in range(3)], schemas.PREDICTION
    )
    picks = spark.createDataFrame([(r, a, [0]) for r in (0, 1) for a in ARMS], "rep int, arm string, selected array<int>")
    writers.write_documents(pred, picks, str(tmp_path / "documents"))
    back = run_source.tidy(run_source.read_artifacts(spark, str(tmp_path / "documents" / "*" / "*.json")))
    assert rows(back) == rows(pred)
    assert validate.prediction_report(back).count() == 0
    with pytest.raises(ValueError, match="write_predictions"):
        writers.write_documents(pred, picks, str(tmp_path / "more"), limit=2)


def test_tables_and_statistics(spark, tmp_path):
    from siltmark.sources import tables

    result = spark.createDataFrame([(0, 42, "QUBO-2", "D_qubo", "rbf_svm", [1, 7], 0.1, 0.5, 0.4, 0.1, 0.1)], schemas.RESULT.replace("selected string", "selected array<int>"))
    writers.write_results_csv(result, str(tmp_path / "results"))
    assert rows(tables.read_results(spark, str(tmp_path / "results"))) == rows(result)
    writers.write_zone_table(spark.createDataFrame([("Zone A", 1)], "zone string, total bigint"), str(tmp_path / "zones"))
    writers.write_stats(spark.createDataFrame([("can", 1)], "class string, n bigint"), str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).count() == spark.read.parquet(str(tmp_path / "zones")).count() == 1
    with pytest.raises(tables.SchemaError):
        tables.read_split(spark, str(tmp_path / "zones"))


def test_ledger_never_replaces(spark, tmp_path):
    path, schema = str(tmp_path / "ledger"), "key string, value int"
    writers.write_new(spark.createDataFrame([("a", 1)], schema), path, ["key"])
    clash = writers.write_new(spark.createDataFrame([("a", 2), ("b", 3)], schema), path, ["key"])
    assert rows(clash) == [("a",)] and rows(spark.read.parquet(path)) == [("a", 1), ("b", 3)]


def test_a_cut_off_artifact_is_not_lost(spark, tmp_path):
    (tmp_path / "rep0_A.json").write_text('{"run_id": "x", "rep": 0, "metrics": {"u": {"predic')
    path = str(tmp_path / "rep*_*.json")
    with pytest.raises(Exception, match="not a valid JSON document: rep0_A.json"):
        run_source.read_predictions(spark, str(tmp_path)).collect()
    assert rows(run_source.broken_artifacts(spark, path)) == [("json", "rep0_A.json", "not a valid JSON document")]


def test_the_prediction_report_groups_items_behind_their_shuffle(spark):
    """Keys are nearly as many as rows: grouped before the shuffle, a task would hold all rows of its scan."""
    pred = spark.createDataFrame([(0, "A", "c", i % 9, "x") for i in range(12)] + [(1, "A", "c", 0, "y"), (0, "A", "c", None, None)], "rep int, arm string, clf string, item_id int, y_true string")
    found = validate.prediction_report(pred.withColumn("y_pred", F.col("y_true")))
    assert rows(found.select("code", "path")) == [("duplicate_id", f"0/A/c/{i}") for i in range(3)] + [("truth", "0")]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_lists_are_compared_by_plain_integers(spark):
    """A swap, another item and a doubled entry each change the digest; no decimal is added up per row."""
    lists = {"a": "pqr", "b": "pqr", "c": "qpr", "d": "pqs", "e": "pq", "f": "pqrr"}
    data = [("r", 0, arm, "c", pos, item, "g", "y", "y") for arm, items in lists.items() for pos, item in enumerate(items)]
    facts = audit.artifact_facts(spark.createDataFrame(data, schemas.PREDICTION))
    digests = {r["arm"]: r["digest"] for r in facts.collect()}
    assert digests["a"] == digests["b"] and len(set(digests.values())) == 5
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal" not in plan and "sha2" not in plan


def test_document_parts_are_dealt_once_and_stored_small(spark, tmp_path, monkeypatch):
    """Rows dealt again for each group, and plain text, took five times the disk."""
    from conftest import SMALL
    from workloads import registry

    ids = [0, 1, 1, 999, 1000, 2500, None]
    data = [(rep, "A", clf, i, f"i{i}", "y", "z" if clf == "u" else None) for rep in range(3) for clf in "uv" for i in ids]
    pred = spark.createDataFrame(data, "rep int, arm string, clf string, event_id bigint, item_id string, y_true string, y_pred string")
    parts = registry._document_parts(pred, 1000)
    assert parts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    parts.write.partitionBy("d").text(str(tmp_path / "own"))
    back = run_source.tidy(run_source.read_artifacts(spark, str(tmp_path / "own" / "*" / "*.txt"), in_parts=True))
    kept = back.where("rep = 0").select("run_id", "clf", "pos", "item_id", "y_true", "y_pred")
    want = [(0, "i0"), (1, "i1"), (2, "i1"), (3, "i999"), (1000, "i1000"), (2000, "i2500"), (None, "iNone")]
    assert rows(kept) == sorted((("r", clf, pos, i, "y", "z" if clf == "u" else None) for clf in "uv" for pos, i in want), key=lambda t: tuple((v is None, str(v)) for v in t))
    monkeypatch.setattr(registry, "scratch", lambda _: str(tmp_path / "whole"))
    registry.broken_artifacts(spark, SMALL).collect()
    stored = [f.name for f in (tmp_path / "whole").glob("*/*") if not f.name.startswith((".", "_"))]
    assert stored and all(n.endswith(".gz") for n in stored)
