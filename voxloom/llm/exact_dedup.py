"""Exact duplicates by content sort.

The text without ASCII blanks is the key. Rows are ordered by the key's first ``HEAD`` characters, its hash, the whole key,
longer text first, smaller id first. ``repartitionByRange`` samples splitters over that order without the whole key, so a
splitter is short however long texts are, and even one text that makes up a third of all rows is spread over many partitions;
each partition is sorted by Spark's external sort, which puts equal keys side by side, and a row is a copy when its whole
key equals the key of the row before it. Runs that go on in the next partition are joined by the key's SHA-256.

Edge cases: null text counts as empty, and all empty texts are equal; rows with equal ids and equal texts are copies like any
other; a null id sorts after all ids; an empty table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import BLANKS, in_slices, keep, partitions

HEAD = 64


def _mark(batches: Iterator) -> Iterator:
    """Add the number of the run of equal keys within the partition, and whether the row starts it."""
    import pyarrow as pa

    last, run = None, -1
    for batch in in_slices(batches, 4096):
        key = batch.column("_key")
        runs, firsts = [], []
        for value in key:
            value = value.as_buffer() if hasattr(value, "as_buffer") else value.as_py()
            new = last is None or not value.equals(last)
            run += new
            last = value
            runs.append(run)
            firsts.append(new)
        names = [n for n in batch.schema.names if n != "_key"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names] + [pa.array(runs, pa.int64()), pa.array(firsts, pa.bool_())], [*names, "_run", "_first"]
        )
        last = pa.py_buffer(last.to_pybytes()) if last is not None else None


def sorted_runs(df: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """The rows in content order: id, length, SHA-256 of the key, ``carry`` columns, partition, run in it, and first of the run."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.regexp_replace("_text", BLANKS, "")
    order = [F.length("_text").desc(), F.col("_id").asc_nulls_last()]
    dealt = df.select(F.col(id_col).alias("_id"), text.alias("_text"), *[F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)])
    dealt = dealt.repartitionByRange(partitions(df.sparkSession), F.substring(plain, 1, HEAD), F.xxhash64(plain), *order)
    rows = dealt.select(
        "_id", F.length("_text").cast("long").alias("_size"), plain.alias("_plain"), F.spark_partition_id().alias("_part"), *[f"c_{i}" for i in range(len(carry))]
    ).sortWithinPartitions(F.substring("_plain", 1, HEAD), F.xxhash64("_plain"), "_plain", F.col("_size").desc(), F.col("_id").asc_nulls_last())
    rows = rows.withColumn("_sha", F.sha2("_plain", 256)).withColumn("_key", F.col("_plain").cast("binary")).drop("_plain")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_key"] + [T.StructField("_run", T.LongType()), T.StructField("_first", T.BooleanType())])
    return keep(rows.mapInArrow(_mark, schema))


def _groups(marked: DataFrame) -> DataFrame:
    """Per (partition, run): size of the whole group of equal texts and the row that stays, over all partitions it reaches into."""
    best = F.min(F.struct((-F.col("_size")).alias("s"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i")))
    runs = marked.groupBy("_part", "_run").agg(F.first("_sha").alias("_sha"), F.count(F.lit(1)).alias("_n"), best.alias("_best"))
    groups = runs.groupBy("_sha").agg(F.sum("_n").alias("_total"), F.min("_best").alias("_least"), F.min(F.struct("_part", "_run")).alias("_lead"))
    return runs.join(groups, "_sha").select(
        "_part", "_run", F.col("_total").alias("group_size"), F.col("_least.i").alias("keep_id"),
        (F.struct("_part", "_run") == F.col("_lead")).alias("_leads"),
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of the text without blanks.

    Of equal texts the row with the most code points stays, then the smallest id; exactly one row of a group is kept.
    """
    marked = sorted_runs(df, id_col, text_col, [])
    return marked.join(_groups(marked), ["_part", "_run"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_first") & F.col("_leads")).alias("kept"), F.col("_sha").alias("text_sha256")
    )


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever they are called."""
    marked = sorted_runs(df, id_col, text_col, df.columns)
    kept = marked.where("_first").join(_groups(marked).where("_leads"), ["_part", "_run"], "left_semi")
    return kept.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(df.columns)])
