from pyspark.sql import functions as F

from conftest import rows
from siltmark.operators import zones
from siltmark.streaming import live

ITEM = "item_id string, zone string, class string, ts timestamp"


def batches(spark, folder):
    """Three files, one micro-batch each; the second repeats an item of the first."""
    parts = [
        [("a", "Zone A", "can"), ("b", "Zone A", "cigarette")],
        [("b", "Zone A", "cigarette"), ("c", "Zone B", "cup")],
        [("d", "Zone B", "cup"), ("e", "Zone C", "bottle"), ("f", "Zone C", "bottle")],
    ]
    for i, part in enumerate(parts):
        df = spark.createDataFrame([(*r, None) for r in part], "item_id string, zone string, class string, ts timestamp")
        df = df.withColumn("ts", F.lit(f"2024-01-0{i + 1} 00:00:00").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder), spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 1).parquet(folder)


def test_live_table_equals_the_batch_table(spark, tmp_path):
    stored, stream = batches(spark, str(tmp_path / "in"))
    seen = []
    run = live.live_zone_table(stream, lambda df, epoch: seen.append(rows(df)), str(tmp_path / "state"))
    run.awaitTermination()
    assert len(seen) == 3
    assert seen[-1] == rows(zones.zone_table(stored))
    assert len(seen[0]) == 1


def test_an_item_is_ingested_once(spark, tmp_path):
    stored, stream = batches(spark, str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    live.ingest_once(stream, out, state).awaitTermination()
    assert rows(spark.read.parquet(out).select("item_id")) == [(c,) for c in "abcdef"]
    # a restart from the checkpoint reads no file twice, and takes up a new one
    again = spark.readStream.schema(ITEM).parquet(str(tmp_path / "in"))
    stored.where("item_id = 'a'").withColumns({"item_id": F.lit("z"), "ts": F.lit("2020-01-04").cast("timestamp")}).write.mode("append").parquet(str(tmp_path / "in"))
    live.ingest_once(again, out, state).awaitTermination()
    assert rows(spark.read.parquet(out).select("item_id")) == [(c,) for c in "abcdefz"]


def test_complete_runs_appear(spark, tmp_path):
    for name, status in (("a", "complete"), ("b", "running")):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "run_manifest.json").write_text(f'{{\n "run_id": "{name}", "status": "{status}", "reps_completed": 3, "arms": ["C_mi"]\n}}')
    found = live.stream_runs(spark, str(tmp_path / "runs"))
    run = found.writeStream.format("memory").queryName("complete_runs").trigger(availableNow=True).start()
    run.awaitTermination()
    assert rows(spark.table("complete_runs").select("run_id", "reps_completed")) == [("a", 3)]
