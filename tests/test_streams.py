"""Streams over several triggers: results equal a batch job, and nothing grows with what was done before."""

import random
import uuid

import pytest

from voxloom.session import shared_dir
from voxloom.streaming import jobs


@pytest.fixture()
def folder(spark):
    return f"{shared_dir(spark)}/stream-tests/{uuid.uuid4().hex}"


EVENTS = "job_id long, stage string, segment_id string, status string, event_ms long, seq long"


def test_progress_keeps_no_state(spark, folder):
    rng = random.Random(5)
    hot = lambda: 1 if rng.random() < 0.5 else rng.randrange(2, 9)
    rows = [(hot(), "tts", f"s{rng.randrange(20)}", rng.choice(["completed", "failed", "pending"]), rng.randrange(1000), n) for n in range(600)]
    for part in range(3):  # event times are mixed over the triggers, so later batches hold late events
        spark.createDataFrame(rows[part::3], EVENTS).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        reports = jobs.progress_stream(stream, f"{folder}/out", f"{folder}/cp")
        assert all(not p["stateOperators"] for p in reports)
    want = sorted(map(tuple, jobs.progress(jobs.latest_status(spark.createDataFrame(rows, EVENTS))).collect()))
    assert sorted(map(tuple, jobs.stream_result(spark, f"{folder}/out").collect())) == want
    jobs.compact(spark, f"{folder}/out", f"{folder}/short")
    assert sorted(map(tuple, jobs.stream_result(spark, f"{folder}/short").collect())) == want
    assert spark.read.parquet(f"{folder}/short").count() == len({r[:3] for r in rows})


def test_units_are_done_once_and_results_are_not_read_again(spark, folder):
    schema = "job_id long, segment_id string, n long"
    reports, seen = [], set()
    for part in range(4):
        rows = [(1, f"s{k}", k) for k in range(part * 50, part * 50 + 100)]  # half of each part came before
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        reports += jobs.incremental_units(stream, f"{folder}/out", f"{folder}/cp", ["job_id", "segment_id"], lambda b: b.selectExpr("job_id", "segment_id", "n * 2 AS r"))
        seen |= {r[:2] for r in rows}
    done = spark.read.parquet(f"{folder}/out")
    assert done.count() == len(seen) == done.select("job_id", "segment_id").distinct().count()
    # a batch reads its own input only
    read = [p["numInputRows"] for p in reports if p["numInputRows"]]
    assert read and max(read) <= 100


def test_progress_stream_deals_out_no_large_tables(spark, tmp_path, monkeypatch):
    """all events were moved into three files, so that a task's share grew with the table."""
    import glob

    from voxloom.catalog import QUERIES, state
    from voxloom.sources import derive

    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    li.repartition(7).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(state, "_scratch", lambda spark, what: f"{tmp_path}/{what}")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a file is a task
    try:
        n = derive.table(spark, str(tmp_path), "manifest").rdd.getNumPartitions()
        got = QUERIES["progress_stream"](spark, str(tmp_path)).orderBy("job_id", "stage").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert n > 3 and len(glob.glob(f"{tmp_path}/events/*.parquet")) == n
    assert 1 < len(glob.glob(f"{tmp_path}/status/epoch_no=*")) <= 3
    want = jobs.progress(jobs.latest_status(state._status_events(spark, str(tmp_path)))).orderBy("job_id", "stage").collect()
    assert got == want and got
