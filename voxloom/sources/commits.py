"""Artifacts published in one step.

Rows are first written under the name of a new commit, in buckets of jobs; then their checksums, one manifest row per job; and at last one row that
names the commit. Readers take only commits that are named, so a write that fails at any point leaves the last version as it was, and a repeated one
starts under a new name. A job shows the rows of its latest commit; jobs that a commit does not hold keep theirs.

Edge cases: an empty table publishes nothing and changes nothing; rows with a null job id are a job of their own; repeated rows are kept and counted;
of commits within one millisecond the greater name counts.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.sources.artifacts import content_checksum

MANIFEST = "job_id {}, name string, version int, sha256 string, created_by_stage string, rows bigint, commit string"
COMMITS = "commit string, name string, version int, committed_ms bigint"


def _folder(root: str, name: str, version: int) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
        raise ValueError(f"an artifact's name has letters, digits and _ . - only: {name!r}")
    return f"{root}/data/{name}.{int(version)}"


def stage(df: DataFrame, root: str, *, name: str, created_by: str, version: int = 1, buckets: int = 64, spread: int = 32) -> str:
    """Write rows and their manifest under a new commit, which is returned; nobody reads it before ``commit``.

    A bucket holds many jobs, so the number of folders does not grow with them; a job's rows are dealt to ``spread`` tasks by their content.
    """
    if {"bucket", "commit"} & set(df.columns):
        raise ValueError("columns named bucket or commit clash with the folders")
    spark, new = df.sparkSession, uuid.uuid4().hex
    path = f"{_folder(root, name, version)}/commit={new}"
    rows = df.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64(*df.columns), F.lit(spread))).write.partitionBy("bucket").parquet(path)
    # checksums are taken from what was written
    back = spark.read.schema(df.schema).parquet(path).select(df.columns)
    m = content_checksum(back, ["job_id"]).select(
        "job_id", F.lit(name).alias("name"), F.lit(int(version)).alias("version"), "sha256", F.lit(created_by).alias("created_by_stage"), "rows", F.lit(new).alias("commit")
    )
    m.write.mode("append").parquet(f"{root}/manifest")
    return new


def commit(spark: SparkSession, root: str, new: str, *, name: str, version: int = 1) -> None:
    """Make a staged commit visible: one row in one file, so it is there as a whole or not at all."""
    row = spark.range(1).select(
        F.lit(new).alias("commit"), F.lit(name).alias("name"), F.lit(int(version)).alias("version"), F.unix_millis(F.current_timestamp()).alias("committed_ms")
    )
    row.coalesce(1).write.mode("append").parquet(f"{root}/commits")


def publish(df: DataFrame, root: str, *, name: str, created_by: str, version: int = 1, buckets: int = 64, spread: int = 32) -> DataFrame:
    """Stage and commit; the manifest rows of the new commit."""
    new = stage(df, root, name=name, created_by=created_by, version=version, buckets=buckets, spread=spread)
    commit(df.sparkSession, root, new, name=name, version=version)
    job = df.schema["job_id"].dataType.simpleString()
    return df.sparkSession.read.schema(MANIFEST.format(job)).parquet(f"{root}/manifest").where(F.col("commit") == new)


def manifest(spark: SparkSession, root: str, job_type: str = "bigint") -> DataFrame:
    """The valid manifest row of each (job, name, version): the one of its latest commit."""
    schema = MANIFEST.format(job_type)
    try:
        c = spark.read.schema(COMMITS).parquet(f"{root}/commits")
        m = spark.read.schema(schema).parquet(f"{root}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema + ", committed_ms bigint")
    m = m.join(c.select("commit", "committed_ms"), "commit")
    key, rest = ["job_id", "name", "version"], ["sha256", "created_by_stage", "rows", "commit", "committed_ms"]
    latest = m.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("committed_ms", "commit")).alias("m"))
    return latest.select(*key, "m.*")


def _valid_rows(spark: SparkSession, root: str, name: str, version: int, schema) -> DataFrame:
    m = manifest(spark, root, schema["job_id"].dataType.simpleString()).where((F.col("name") == name) & (F.col("version") == int(version)))
    m = m.select(F.col("job_id").alias("_job"), F.col("commit").alias("_commit"))
    folder = _folder(root, name, version)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    d = spark.read.schema(f"{columns}, commit string, bucket int").parquet(folder)
    return d.join(m, d["job_id"].eqNullSafe(m["_job"]) & (d["commit"] == m["_commit"]), "left_semi")


def read(spark: SparkSession, root: str, schema, *, name: str, version: int = 1) -> DataFrame:
    """Every job's rows as of its latest commit, in the columns of ``schema``."""
    return _valid_rows(spark, root, name, version, schema).select([f.name for f in schema.fields])


def found(spark: SparkSession, root: str, schema, *, name: str, version: int = 1) -> DataFrame:
    """Checksums of the rows that lie in the folders now, to compare with the manifest (``operators.state.invalid_artifacts``)."""
    columns = [f.name for f in schema.fields]
    rows = _valid_rows(spark, root, name, version, schema).select(columns)
    return content_checksum(rows, ["job_id"]).select("job_id", F.lit(name).alias("name"), F.lit(int(version)).alias("version"), "sha256", "rows")


def stage_progress(progress: DataFrame, published: DataFrame, *, status: str = "completed") -> DataFrame:
    """(job_id, stage, status, done, total) after a publication: the publishing stage of each job has ``status`` and counts its rows."""
    new = published.groupBy("job_id", F.col("created_by_stage").alias("stage")).agg(F.sum("rows").alias("total"))
    new = new.select("job_id", "stage", F.lit(status).alias("status"), F.col("total").alias("done"), "total")
    p = progress.select("job_id", "stage", "status", F.col("done").cast("long").alias("done"), F.col("total").cast("long").alias("total"))
    same = p["job_id"].eqNullSafe(new["job_id"]) & (p["stage"] == new["stage"])
    return p.join(new, same, "left_anti").unionByName(new)
