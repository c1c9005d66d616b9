"""Queries on recognition responses and word chunks."""

from pyspark.sql import functions as F

from voxloom.catalog.base import cte, query
from voxloom.operators import recognition as rec
from voxloom.sources.derive import table

cte("asr", ("words",), """
SELECT w.*, c.chunk_start_ms, (w.start_ms-c.chunk_start_ms-CASE WHEN pos%29=0 THEN 40 ELSE 0 END) AS s_ms,
 CASE WHEN w.chunk_id%6=5 AND pos%97=0 THEN NULL WHEN pos%23=0 THEN w.start_ms-c.chunk_start_ms-CASE WHEN pos%29=0 THEN 40 ELSE 0 END
  ELSE w.end_ms-c.chunk_start_ms END AS e_ms
FROM words w JOIN (SELECT job_id, chunk_id, min(start_ms) AS chunk_start_ms FROM words GROUP BY ALL) c USING (job_id, chunk_id)""")
cte("asr_abs", ("asr",), """
SELECT job_id, chunk_id, pos, text, chunk_start_ms+CAST(trunc(s_ms/1000.0::DOUBLE*1000) AS BIGINT) AS s,
 chunk_start_ms+CAST(trunc(e_ms/1000.0::DOUBLE*1000) AS BIGINT) AS e FROM asr""")


def _responses(spark, sf):
    """Recognition responses with segments: two halves of the chunk, the second without an end in some."""
    r = table(spark, sf, "asr_raw")
    mid = F.expr("(chunk_end_ms - chunk_start_ms) div 2") / F.lit(1000.0)
    end = (F.col("chunk_end_ms") - F.col("chunk_start_ms")) / F.lit(1000.0)
    seg = F.array(
        F.struct(F.lit("first").alias("text"), F.lit(0.0).alias("start"), mid.alias("end")),
        F.struct(
            F.lit("second").alias("text"), mid.alias("start"),
            F.when(F.col("chunk_id") % 2 == 1, end).alias("end"),
        ),
    )
    none = F.array().cast("array<struct<text:string,start:double,end:double>>")
    return r.withColumn("segments", F.when(F.col("job_id") % 4 == 3, none).otherwise(seg)).withColumn("text", F.lit(" heard "))


@query("absolute_ms", ("asr_abs",), "SELECT job_id, chunk_id, pos, s AS start_ms, e AS end_ms FROM asr_abs")
def absolute_ms(spark, sf):
    w = table(spark, sf, "asr_raw").select("job_id", "chunk_id", "chunk_start_ms", F.inline("words"))
    c = F.col("chunk_start_ms")
    return w.select(
        "job_id", "chunk_id", "pos", rec.absolute_ms(F.col("start"), c).alias("start_ms"),
        rec.absolute_ms(F.col("end"), c).alias("end_ms"),
    )


@query("valid_words", ("asr_abs",), """
SELECT job_id, chunk_id, pos, text, s AS start_ms, e AS end_ms FROM asr_abs WHERE trim(text)<>'' AND e>s""")
def valid_words(spark, sf):
    w = table(spark, sf, "asr_raw").select("job_id", "chunk_id", "chunk_start_ms", F.inline("words"))
    c = F.col("chunk_start_ms")
    w = w.select(
        "job_id", "chunk_id", "pos", F.lit(" ").alias("text"), "word", rec.absolute_ms(F.col("start"), c).alias("start_ms"),
        rec.absolute_ms(F.col("end"), c).alias("end_ms"),
    )
    return rec.valid_words(w).drop("word")


@query("timestamp_gate", ("asr_abs",), """
SELECT job_id, chunk_id, count(*) AS n_words, CAST(count(*) FILTER (s IS NULL OR e IS NULL) AS BIGINT) AS missing_times,
 CASE WHEN count(*) FILTER (s IS NULL OR e IS NULL)>0 THEN 'incomplete' ELSE 'usable' END AS gate FROM asr_abs GROUP BY ALL""")
def timestamp_gate(spark, sf):
    return rec.timestamp_gate(table(spark, sf, "asr_raw"))


cte("asr_dirty", ("asr_abs",), """
SELECT job_id, chunk_id, bool_or(s IS NULL OR e IS NULL) AS bad, bool_or(e<=s OR s<pe) AS dirty
FROM (SELECT *, lag(e) OVER (PARTITION BY job_id, chunk_id ORDER BY pos) AS pe FROM asr_abs) GROUP BY ALL""")


@query("clean_word_times", ("asr_abs", "asr_dirty"), """
SELECT a.job_id, a.chunk_id, a.pos, a.text, a.s AS start_ms, a.e AS end_ms, FALSE AS repaired FROM asr_abs a JOIN asr_dirty d USING (job_id, chunk_id)
WHERE NOT coalesce(bad,FALSE) AND NOT coalesce(dirty,FALSE)""")
def clean_word_times(spark, sf):
    return rec.repair_word_times(table(spark, sf, "asr_raw")).where("NOT repaired")


@query("repair_word_times")
def repair_word_times(spark, sf):
    return rec.repair_word_times(table(spark, sf, "asr_raw"))


@query("segment_units", ("asr_abs",), """
WITH b AS (SELECT job_id, chunk_id, min(start_ms) AS a, max(end_ms) AS z FROM words GROUP BY ALL)
SELECT job_id, chunk_id, CAST(0 AS BIGINT) AS pos, 'first' AS text, a AS start_ms, a+CAST(trunc(((z-a)//2)/1000.0::DOUBLE*1000) AS BIGINT) AS end_ms FROM b WHERE job_id%4<>3
UNION ALL SELECT job_id, chunk_id, 1, 'second', a+CAST(trunc(((z-a)//2)/1000.0::DOUBLE*1000) AS BIGINT), a+CAST(trunc((z-a)/1000.0::DOUBLE*1000) AS BIGINT) FROM b WHERE job_id%4<>3 AND chunk_id%2=1
""".replace("WITH b AS", "SELECT * FROM (WITH b AS") + ")")
def segment_units(spark, sf):
    return rec.segment_units(_responses(spark, sf))


@query("timestamp_ladder", ("asr_abs", "asr_dirty"), """
SELECT job_id, chunk_id, source, CASE WHEN source='chunk' THEN 'chunk_fallback' ELSE source END AS quality,
 CAST(CASE source WHEN 'word' THEN n WHEN 'segment' THEN 1+chunk_id%2 ELSE 1 END AS BIGINT) AS units,
 CASE WHEN source='word' AND dirty THEN 'word_timestamp_repaired' WHEN source='segment' THEN 'word_timestamps_missing'
  WHEN source='chunk' THEN 'timestamps_missing|chunk_text_fallback' ELSE '' END AS risk_flags
FROM (SELECT d.*, n, CASE WHEN NOT coalesce(bad,FALSE) THEN 'word' WHEN d.job_id%4<>3 THEN 'segment' ELSE 'chunk' END AS source
 FROM asr_dirty d JOIN (SELECT job_id, chunk_id, count(*) AS n FROM asr_abs GROUP BY ALL) c USING (job_id, chunk_id))""")
def timestamp_ladder(spark, sf):
    return rec.timestamp_ladder(_responses(spark, sf))


# thresholds: every candidate tried on all words
cte("thr", ("words",), """
SELECT job_id, CAST(coalesce(max(t) FILTER (span<=60000), 500) AS BIGINT) AS threshold_ms, bool_or(span<=60000) AS all_fit FROM (
 SELECT job_id, t, max(span) AS span FROM (
  SELECT job_id, t, isl, max_by(end_ms,start_ms)-min(start_ms) AS span FROM (
   SELECT *, sum(CASE WHEN start_ms-pe>=t THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, t ORDER BY start_ms) AS isl FROM (
    SELECT *, lag(end_ms) OVER (PARTITION BY job_id, t ORDER BY start_ms) AS pe FROM words, (SELECT unnest(range(500,5001,500)) AS t)))
  GROUP BY ALL) GROUP BY ALL) GROUP BY job_id""")


@query("silence_chunks", ("thr",), "SELECT * FROM thr")
def silence_chunks(spark, sf):
    return rec.silence_thresholds(table(spark, sf, "words"))


@query("hard_split")
def hard_split(spark, sf):
    w = rec._gap_runs(table(spark, sf, "words").drop("text"), ["job_id"], 500, rec.seq.HOUR_MS).withColumnRenamed("run", "isl")
    return rec.hard_split(w, max_chunk_ms=12_000).select("job_id", "chunk_id", "pos", "isl", "piece", "hard")


def _chunks(spark, sf):
    # a maximum that every recording can meet at some threshold keeps the SQL check possible
    return rec.word_chunks(table(spark, sf, "words"), max_chunk_ms=10_000_000, initial_ms=1200, min_ms=500, step_ms=100)


cte("wchunks", ("words",), """
SELECT job_id, CAST(isl+1 AS BIGINT) AS chunk_no, min(start_ms) AS start_ms, max_by(end_ms,start_ms) AS word_end_ms, count(*) AS n_words FROM (
 SELECT *, sum(CASE WHEN start_ms-pe>=1200 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY start_ms) AS isl FROM (
  SELECT *, lag(end_ms) OVER (PARTITION BY job_id ORDER BY start_ms) AS pe FROM words)) GROUP BY job_id, isl""")
cte("wbounds", ("wchunks",), """
SELECT *, end_ms-word_end_ms AS trailing_silence_ms FROM (SELECT job_id, chunk_no, start_ms,
 greatest(word_end_ms, least(word_end_ms+5000, coalesce(ns, greatest(tot,word_end_ms)))) AS end_ms,
 word_end_ms, CAST(1200 AS BIGINT) AS split_threshold_ms, FALSE AS hard_split, n_words FROM (
 SELECT *, lead(start_ms) OVER (PARTITION BY job_id ORDER BY start_ms) AS ns, max(word_end_ms) OVER (PARTITION BY job_id)+job_id%3*3000 AS tot FROM wchunks))""")


def _totals(w):
    return w.groupBy("job_id").agg(F.max("end_ms").alias("m")).select(
        "job_id", (F.col("m") + F.col("job_id") % 3 * 3000).alias("total_duration_ms")
    )


@query("chunk_bounds", ("wbounds",), "SELECT * FROM wbounds")
def chunk_bounds(spark, sf):
    w = _chunks(spark, sf)
    return rec.chunk_bounds(w, _totals(w))


@query("word_chunks")
def word_chunks(spark, sf):
    return rec.word_chunks(table(spark, sf, "words"))


@query("word_chunk_table", ("wbounds", "words"), """
SELECT b.*, 'wchunk_'||lpad(b.chunk_no::VARCHAR,6,'0') AS chunk_name, a.* EXCLUDE (job_id, chunk_no) FROM wbounds b JOIN (
 SELECT c.job_id, c.chunk_no, min(50+w.chunk_id*7%50) AS confidence_pct, min_by(w.chunk_id*100, w.start_ms) AS silence_before_ms,
  count(DISTINCT w.chunk_id) AS n_sources FROM wchunks c JOIN words w ON c.job_id=w.job_id AND w.start_ms>=c.start_ms AND w.end_ms<=c.word_end_ms
 GROUP BY ALL) a ON a.job_id=b.job_id AND a.chunk_no=b.chunk_no""")
def word_chunk_table(spark, sf):
    w = _chunks(spark, sf)
    src = table(spark, sf, "segments").select(
        "job_id", "chunk_id", (50 + F.col("chunk_id") * 7 % 50).alias("confidence_pct"),
        (F.col("chunk_id") * 100).alias("silence_before_ms"),
    )
    return rec.word_chunk_table(w, src, rec.chunk_bounds(w, _totals(w)))


@query("ordered_distinct", ("words",), """
SELECT job_id, token, CAST(row_number() OVER (PARTITION BY job_id ORDER BY f, token) AS BIGINT) AS seen_rank FROM (
 SELECT job_id, lower(text) AS token, min(start_ms) AS f FROM words GROUP BY ALL)""")
def ordered_distinct(spark, sf):
    w = table(spark, sf, "words").withColumn("token", F.lower("text"))
    return rec.ordered_distinct(w, ["job_id"], "token", ["start_ms"])


@query("word_timeline", ("words",), """
SELECT job_id, segment_id, text, start_ms, end_ms, CAST(row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, segment_id) AS BIGINT) AS word_rank
FROM (SELECT *, 'seg_'||lpad((chunk_id+1)::VARCHAR,6,'0') AS segment_id FROM words)""")
def word_timeline(spark, sf):
    from voxloom.operators.transcript import word_timeline as op

    w = table(spark, sf, "words").withColumn("segment_id", F.format_string("seg_%06d", F.col("chunk_id") + 1))
    return op(w).select("job_id", "segment_id", "text", "start_ms", "end_ms", "word_rank")
