"""Session settings and the two ways this package cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "voxloom") -> SparkSession:
    """A small local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, so that a folder of this machine is a shared one."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as ``spark.checkpoint.dir`` names it; a temporary one only in a local session."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = sc.getCheckpointDir()
    return current


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver was started from; once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "voxloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("voxloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


_HEAVY = ("Join", "Window", "Aggregate", "Sort", "Union", "Pandas", "EvalPython", "Distinct", "Deduplicate")


def cut(df: DataFrame) -> DataFrame:
    """Write a frame that several later steps read to the shared folder, so none of them recomputes it.

    A columnar table keeps column pruning and true sizes for the planner, and outlives lost executors.
    A frame that only scans, filters and projects is returned as it is: reading it again is cheaper.
    """
    plan = df._jdf.queryExecution().analyzed().toString()
    if not any(word in plan for word in _HEAVY):
        return df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/steps/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
