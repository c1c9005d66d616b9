"""Source sentences: words grouped at sentence marks and safe pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import rules
from voxloom.functions import text as tx
from voxloom.plans import sequences as seq


def source_sentences(words: DataFrame, *, natural_pause_ms: int = 700, width: int = seq.HOUR_MS) -> DataFrame:
    """words(job_id, start_ms, end_ms, text, segment_id) -> one row per sentence.

    A sentence ends after terminal punctuation, or before a pause of at least ``natural_pause_ms``
    unless the words on either side belong together.
    """
    token = tx.bare_token("text")
    w = (
        words.withColumn("_term", tx.ends_with_any(F.rtrim("text"), rules.TERMINAL))
        .withColumn("_left", token.isin(*rules.SENTENCE_LEFT))
        .withColumn("_right", token.isin(*rules.SENTENCE_RIGHT))
    )

    def starts(p, c):
        pause = (c["start_ms"] - p["end_ms"] >= natural_pause_ms) & ~p["_left"] & ~c["_right"]
        return p["_term"] | pause

    order = ["start_ms", "end_ms", "pos"]
    w = seq.pieces(
        w, ["job_id"], order, ["text", "segment_id", "_term", "_left", "_right"], starts, "sentence_no", width=width
    )
    first, last = F.col("items")[0], F.element_at("items", -1)
    w = w.select(
        "job_id",
        (F.col("sentence_no") + 1).alias("sentence_no"),
        F.struct(
            "_blk",
            first["start_ms"].alias("start_ms"),
            last["end_ms"].alias("end_ms"),
            last["_term"].alias("term"),
            tx.join_tokens(F.col("items.text")).alias("text"),
            F.array_distinct("items.segment_id").alias("segment_ids"),
            F.size("items").cast("long").alias("n"),
        ).alias("p"),
    )
    # most sentences lie in one block; only whole texts move here, no words
    out = w.groupBy("job_id", "sentence_no").agg(F.array_sort(F.collect_list("p")).alias("p"))
    last = F.element_at("p", -1)
    return out.select(
        "job_id",
        "sentence_no",
        F.format_string("sentence_%06d", "sentence_no").alias("segment_id"),
        F.col("p")[0]["start_ms"].alias("start_ms"),
        last["end_ms"].alias("end_ms"),
        F.when(F.size("p") == 1, F.col("p")[0]["text"]).otherwise(tx.join_tokens(F.col("p.text"))).alias("source_text"),
        F.array_distinct(F.flatten("p.segment_ids")).alias("parent_segment_ids"),
        F.when(last["term"], "sentence_punctuation").otherwise("natural_pause_or_end").alias("boundary_reason"),
        F.aggregate("p.n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_words"),
    )
