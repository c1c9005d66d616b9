"""Progress and speech as streams. Sinks are files, so nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["job_id", "stage", "segment_id"]


def latest_status(events: DataFrame) -> DataFrame:
    """Latest status per unit, by event time and then sequence, with the two that decided it.

    Latest statuses of parts of the events merge to the latest status of all, in any order of the parts.
    """
    order = F.struct("event_ms", "seq")
    last = events.groupBy(*KEY).agg(F.max_by(F.struct("status", "event_ms", "seq"), order).alias("s"))
    return last.select(*KEY, "s.status", "s.event_ms", "s.seq")


def progress(units: DataFrame) -> DataFrame:
    return units.groupBy("job_id", "stage").agg(
        F.count_if(F.col("status") == "completed").alias("done"), F.count("*").alias("total")
    )


def progress_stream(events: DataFrame, out: str, checkpoint: str) -> list[dict]:
    """Run the status stream over what is there and append each batch's latest status of the units it touches.

    The stream keeps no state, however many jobs it has seen: what a batch writes carries its event time, so a late event
    loses where results are read. A rewritten epoch replaces itself, so a retry after a failure leaves no duplicates.
    Returns the progress reports of the batches.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        latest_status(batch).withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{out}/epoch_no={epoch}")

    q = events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return list(q.recentProgress)


def stream_units(spark: SparkSession, out: str) -> DataFrame:
    """Newest status of every unit the stream has written."""
    return latest_status(spark.read.parquet(out))


def compact(spark: SparkSession, out: str, to: str) -> None:
    """Write one row per unit of all epochs so far to a new place; it is read like an epoch."""
    stream_units(spark, out).withColumn("epoch", F.lit(-1).cast("long")).write.parquet(f"{to}/epoch_no=-1")


def stream_result(spark: SparkSession, out: str) -> DataFrame:
    """Progress from the newest status of every unit the stream has written."""
    return progress(stream_units(spark, out))


def speech_sessions(words: DataFrame, *, pause_threshold_ms: int = 250, late: str = "10 minutes") -> DataFrame:
    """Speech intervals of a word stream (job_id, recorded_at, start_ms, end_ms).

    Event time is the wall clock, the recording's start plus the word's offset: a recording that begins after another one ended
    is not late, whatever its offsets. A word is late when the stream has seen words more than ``late`` after it.
    A session ends when nothing starts before its last end plus the threshold. Spark also joins
    sessions that only touch, hence one millisecond less.
    """
    gap = F.concat((F.col("end_ms") - F.col("start_ms") + (pause_threshold_ms - 1)).cast("string"), F.lit(" milliseconds"))
    ts = F.timestamp_micros(F.unix_micros("recorded_at") + F.col("start_ms") * 1000)
    w = words.withColumn("ts", ts).withWatermark("ts", late)
    s = w.groupBy("job_id", F.session_window("ts", gap).alias("s")).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("word_count")
    )
    return s.drop("s")


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> None:
    q = (
        stream.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def incremental_units(units: DataFrame, done_path: str, checkpoint: str, key: list[str], work) -> list[dict]:
    """Process only units not done before.

    Done keys are the state of a streaming de-duplication, kept in RocksDB beside the checkpoint: a batch looks up its own keys and reads no
    results. A batch that fails is run again from the state before it. ``work(batch) -> DataFrame`` must keep the key columns. Results go
    to one folder per epoch, so a repeated epoch replaces itself. Returns the progress reports of the batches.
    """
    spark = units.sparkSession
    setting, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def step(batch: DataFrame, epoch: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{done_path}/epoch_no={epoch}")

    before = spark.conf.get(setting, None)
    spark.conf.set(setting, store)
    try:
        q = units.dropDuplicates(key).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    return list(q.recentProgress)
