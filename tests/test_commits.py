"""Publication in one step: what readers see after good, failed and repeated writes."""

import pytest
from pyspark.sql import functions as F

from voxloom.operators import state as st
from voxloom.sources import commits as cm

SCHEMA = "job_id long, cue_id string, text string"
ART = {"name": "cues", "version": 2}
KEY = ["job_id", "name", "version"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_publish(spark, tmp_path):
    root = str(tmp_path)
    big = [(1, f"c{i}", "x" * (i % 7)) for i in range(900)]
    first = big + [(j, "c", "old") for j in range(2, 40)] + [(None, "c", None), (5, "c", "old")]
    df = spark.createDataFrame(first, SCHEMA)
    read = lambda: rows(cm.read(spark, root, df.schema, **ART))
    assert cm.manifest(spark, root).collect() == []
    # small partitions stay apart, so that the spread of one job shows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    m = cm.publish(df, root, created_by="translation", buckets=8, **ART)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.job_id: r.rows for r in m.collect()} == {1: 900, None: 1, 5: 2, **{j: 1 for j in range(2, 40) if j != 5}}
    assert read() == sorted(first, key=repr)
    # folders are buckets, not jobs, and one job lies in several files
    data = list((tmp_path / "data" / "cues.2").glob("commit=*/bucket=*"))
    assert 1 < len(data) <= 8 and max(len(list(b.glob("*.parquet"))) for b in data) > 1
    # a write that fails on its way, and one that ends before its commit, change nothing
    broken = df.withColumn("text", F.when(F.col("cue_id") == "c800", F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="lost"):
        cm.publish(broken, root, created_by="translation", **ART)
    new = spark.createDataFrame([(2, "c", "new"), (2, "d", "new"), (77, "c", "new")], SCHEMA)
    left = cm.stage(new, root, created_by="translation", **ART)
    assert read() == sorted(first, key=repr) and left not in {r.commit for r in cm.manifest(spark, root).collect()}
    cm.publish(df.limit(0), root, created_by="translation", **ART)
    assert read() == sorted(first, key=repr)
    # a good one replaces its own jobs only
    p = cm.publish(new, root, created_by="translation", **ART)
    want = [r for r in first if r[0] != 2] + [(2, "c", "new"), (2, "d", "new"), (77, "c", "new")]
    assert read() == sorted(want, key=repr)
    # what lies there agrees with the manifest; a manifest of other content does not
    found, now = cm.found(spark, root, df.schema, **ART).where("job_id IS NOT NULL"), cm.manifest(spark, root).where("job_id IS NOT NULL")
    assert st.invalid_artifacts(now, found, KEY).collect() == []
    other = now.withColumn("sha256", F.when(F.col("job_id") == 2, m.where("job_id = 2").first().sha256).otherwise(F.col("sha256")))
    assert [tuple(r) for r in st.invalid_artifacts(other, found, KEY).collect()] == [(2, "cues", 2, "checksum")]
    # the stage's progress
    old = spark.createDataFrame([(2, "translation", "running", 0, 9), (2, "asr", "completed", None, None)], "job_id long, stage string, status string, done long, total long")
    assert rows(cm.stage_progress(old, p)) == [(2, "asr", "completed", None, None), (2, "translation", "completed", 2, 2), (77, "translation", "completed", 1, 1)]
    with pytest.raises(ValueError):
        cm.publish(new, root, name="../cues", created_by="translation")
    with pytest.raises(ValueError):
        cm.publish(new.withColumn("bucket", F.lit(1)), root, created_by="translation", **ART)


def test_artifact_folders_do_not_grow_with_jobs(spark, tmp_path):
    import os

    from voxloom.sources import artifacts as ar

    rows = [(f"{j:04}" if j else None, i, f"text {j} {i}") for j in range(300) for i in range(j % 4 + 1)]
    df = spark.createDataFrame(rows, "job_id string, n long, t string")
    path = str(tmp_path / "cues")
    for _ in range(2):  # the second write takes the place of the first
        got = {r.job_id: r for r in ar.publish_artifact(df, path, name="cues", stage="s", buckets=8).collect()}
    assert len([d for d in os.listdir(path) if "=" in d]) == 8
    assert {j: r.rows for j, r in got.items()} == {(f"{j:04}" if j else None): j % 4 + 1 for j in range(300)}
    assert {j: r.sha256 for j, r in got.items()} == {r.job_id: r.sha256 for r in ar.content_checksum(df, ["job_id"]).collect()}
    held = spark.read.parquet(got["0007"].path).where("job_id = '0007'")
    assert held.count() == 4 and got["0007"].path.startswith(path)
