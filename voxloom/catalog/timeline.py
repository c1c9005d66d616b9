"""Queries on words, islands, silences, gaps and cues."""

from pyspark.sql import functions as F

from voxloom.catalog.base import query
from voxloom.operators import timeline as tl
from voxloom.operators import tts
from voxloom.session import cut
from voxloom.sources.derive import table

SILENCES = r"""
SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY start_ms)-1 AS BIGINT) AS silence_no, position, start_ms, end_ms,
 end_ms-start_ms AS duration_ms FROM (
 SELECT job_id, 'before_first' AS position, CAST(0 AS BIGINT) AS start_ms, min(start_ms) AS end_ms FROM islands GROUP BY job_id HAVING min(start_ms)>0
 UNION ALL SELECT job_id, 'between_speech', end_ms, ns FROM (SELECT *, lead(start_ms) OVER (PARTITION BY job_id ORDER BY start_ms) AS ns FROM islands) WHERE ns>end_ms
 UNION ALL SELECT job_id, 'after_last', max(end_ms), max(end_ms)+job_id%3*1000 FROM islands GROUP BY job_id HAVING job_id%3>0)"""


def totals(islands):
    return islands.groupBy("job_id").agg(F.max("end_ms").alias("m")).select(
        "job_id", (F.col("m") + F.col("job_id") % 3 * 1000).alias("total_duration_ms")
    )


@query("source_speech_islands", ("islands",), "SELECT * FROM islands")
def source_speech_islands(spark, sf):
    return tl.source_speech_islands(table(spark, sf, "words"))


@query("source_speech_fallback", ("islands", "cues"), """
SELECT *, 'word' AS quality FROM islands WHERE job_id%4<>0 UNION ALL
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, cue_id)-1, start_ms, end_ms, 0, 'cue_fallback' FROM cues WHERE job_id%4=0""")
def source_speech_fallback(spark, sf):
    """Words of every fourth recording lost their times."""
    w = table(spark, sf, "words").withColumn("end_ms", F.when(F.col("job_id") % 4 == 0, F.col("start_ms")).otherwise(F.col("end_ms")))
    return tl.with_cue_fallback(cut(tl.source_speech_islands(w)), table(spark, sf, "cues"))


@query("source_silences", ("islands",), SILENCES)
def source_silences(spark, sf):
    i = cut(tl.source_speech_islands(table(spark, sf, "words")))
    return tl.source_silences(i, totals(i))


@query("speech_summary", ("islands",), f"""
SELECT s.*, coalesce(silence_ms,0) AS silence_ms, coalesce(longest_pause_ms,0) AS longest_pause_ms,
 CAST(speech_ms*10000//greatest(1,last_end) AS BIGINT) AS speech_share_e4 FROM (
 SELECT job_id, count(*) AS islands, CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(end_ms-start_ms) AS BIGINT) AS speech_ms,
  FROM islands GROUP BY job_id) s JOIN (SELECT job_id, max(end_ms) AS last_end FROM islands GROUP BY job_id) e USING (job_id)
 LEFT JOIN (SELECT job_id, CAST(sum(duration_ms) AS BIGINT) AS silence_ms, max(duration_ms) AS longest_pause_ms FROM ({SILENCES}) GROUP BY job_id) q USING (job_id)
""".replace("SELECT s.*,", "SELECT s.job_id, s.islands, s.words, s.speech_ms,"))
def speech_summary(spark, sf):
    i = cut(tl.source_speech_islands(table(spark, sf, "words")))
    return tl.speech_summary(i, tl.silence_spans(i, totals(i)))


@query("source_sentences", ("cues",), """
SELECT job_id, sentence_no, 'sentence_'||lpad(sentence_no::VARCHAR,6,'0') AS segment_id, start_ms, end_ms, source_text, parents,
 CASE WHEN term THEN 'sentence_punctuation' ELSE 'natural_pause_or_end' END AS boundary_reason, n_words FROM cues""")
def source_sentences(spark, sf):
    from voxloom.operators.sentences import source_sentences as op

    w = table(spark, sf, "words").withColumn("segment_id", F.format_string("seg_%06d", F.col("chunk_id") + 1))
    return op(w).withColumn("parents", F.array_join("parent_segment_ids", "|")).drop("parent_segment_ids")


@query("cue_id", ("cues",), "SELECT job_id, sentence_no, cue_id FROM cues")
def cue_id(spark, sf):
    from voxloom.operators.sentences import source_sentences as op

    w = table(spark, sf, "words").withColumn("segment_id", F.format_string("seg_%06d", F.col("chunk_id") + 1))
    c = F.col
    return op(w).select(
        "job_id", "sentence_no",
        tl.cue_id(c("start_ms"), c("end_ms"), c("parent_segment_ids"), c("source_text")).alias("cue_id"),
    )




@query("speech_gaps", ("gaps",), "SELECT * FROM gaps")
def speech_gaps(spark, sf):
    c = table(spark, sf, "cues")
    return tl.speech_gaps(c, totals(c))


@query("preserve_pause", ("gaps",), "SELECT job_id, start_ms, duration_ms, preserve_pause_ms, usable_overflow_ms FROM gaps WHERE position='between_speech'")
def preserve_pause(spark, sf):
    g = table(spark, sf, "cue_gaps").where("position = 'between_speech'")
    d = F.col("duration_ms")
    return g.select(
        "job_id", "start_ms", "duration_ms", tl.preserve_pause_ms(d).alias("preserve_pause_ms"),
        tl.usable_overflow_ms(d).alias("usable_overflow_ms"),
    )


@query("preserve_all_pauses", ("gaps",), "SELECT job_id, position, start_ms, duration_ms, preserve_pause_ms, usable_overflow_ms FROM gaps")
def preserve_all_pauses(spark, sf):
    """The rule on every gap: before, between and after speech."""
    c, d = table(spark, sf, "cues"), F.col("duration_ms")
    return tl.speech_gaps(c, totals(c)).select(
        "job_id", "position", "start_ms", "duration_ms", tl.preserve_pause_ms(d).alias("preserve_pause_ms"),
        tl.usable_overflow_ms(d).alias("usable_overflow_ms"),
    )


@query("overflow_by_cue", ("gaps",), """
SELECT c.job_id, c.cue_id, coalesce(m,0) AS timeline_usable_overflow_ms FROM cues c LEFT JOIN (
 SELECT job_id, preceding_cue_id, max(usable_overflow_ms) AS m FROM gaps WHERE preceding_cue_id IS NOT NULL GROUP BY ALL) g
 ON c.job_id=g.job_id AND c.cue_id=g.preceding_cue_id""")
def overflow_by_cue(spark, sf):
    c = table(spark, sf, "cues")
    return tl.overflow_by_cue(c.select("job_id", "cue_id"), tl.speech_gaps(c, totals(c)))


@query("interval_overlap", ("cues", "islands"), """
SELECT i.job_id, i.interval_no, c.cue_id, c.start_ms FROM islands i JOIN cues c
 ON c.job_id=i.job_id AND c.end_ms>i.start_ms AND c.start_ms<i.end_ms""")
def interval_overlap(spark, sf):
    return tl.interval_overlap(table(spark, sf, "cues"), tl.source_speech_islands(table(spark, sf, "words")))


@query("tts_timing_risk", ("nb",), f"""
SELECT job_id, cue_id, est AS estimate_ms, avail AS available_ms, CAST((est*20000+greatest(1,avail))//(2*greatest(1,avail)) AS BIGINT) AS ratio_e4,
 est/greatest(1,avail)>1.3::DOUBLE AS dense FROM ( SELECT job_id, cue_id, CAST(len(regexp_extract_all(source_text,'[\\p{{L}}\\p{{N}}_]+'))*300 AS BIGINT) AS est,
  greatest(end_ms-start_ms, coalesce(ns,end_ms)-start_ms-100) AS avail FROM nb) WHERE est>0""")
def tts_timing_risk(spark, sf):
    return tts.timing_risk(table(spark, sf, "cues").withColumn("spoken_text", F.col("source_text")))


@query("neighbour_cues", ("nb",), "SELECT job_id, cue_id, pid AS previous_cue_id, nid AS next_cue_id, ptext AS previous_text, ntext AS next_text FROM nb")
def neighbour_cues(spark, sf):
    return tts.neighbour_cues(table(spark, sf, "cues"))


@query("chronological_review", ("cues",), "SELECT job_id, cue_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, cue_id) AS BIGINT) AS review_rank FROM cues")
def chronological_review(spark, sf):
    from voxloom.plans.sequences import ranked

    return ranked(table(spark, sf, "cues"), ["job_id"], ["start_ms", "end_ms", "cue_id"], "review_rank").select(
        "job_id", "cue_id", "review_rank"
    )
