"""Speech and silence on the source timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.plans import sequences as seq

JOB = ["job_id"]


def cue_id(start_ms: Column, end_ms: Column, parents: Column, source_text: Column) -> Column:
    """Stable id from the cue's times, parents and text."""
    identity = F.concat_ws(":", start_ms.cast("string"), end_ms.cast("string"), F.array_join(parents, "|"), source_text)
    return F.concat(F.lit("cue_"), F.substring(F.sha2(identity, 256), 1, 12))


def preserve_pause_ms(duration: Column) -> Column:
    """Part of a pause kept silent; fractions are cut off, not rounded."""

    def share(factor: float, least: int) -> Column:
        return F.greatest(F.lit(least).cast("long"), (duration * F.lit(factor)).cast("long"))

    return (
        F.when(duration < 250, duration)
        .when(duration < 600, share(0.60, 150))
        .when(duration < 1200, share(0.45, 250))
        .otherwise(share(0.30, 350))
    )


def usable_overflow_ms(duration: Column, guard_ms: int = 100) -> Column:
    return F.greatest(F.lit(0).cast("long"), duration - max(0, guard_ms) - preserve_pause_ms(duration))


def source_speech_islands(
    words: DataFrame, *, pause_threshold_ms: int = 250, width: int = seq.HOUR_MS
) -> DataFrame:
    """Words whose gap to the previous word is below the threshold form one speech interval."""
    thr = max(0, pause_threshold_ms)
    w = words.where("end_ms > start_ms")
    w = seq.islands(
        w, JOB, ["start_ms", "end_ms", "pos"], ["start_ms", "end_ms"],
        lambda p, c: c["start_ms"] - p["end_ms"] >= thr, "interval_no", width=width,
    )
    return w.groupBy("job_id", "interval_no").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("word_count")
    )


def with_cue_fallback(islands: DataFrame, cues: DataFrame) -> DataFrame:
    """Recordings without timed words use their cues as speech intervals."""
    without = cues.join(islands.select("job_id").distinct(), "job_id", "left_anti")
    ranked = seq.ranked(without, JOB, ["start_ms", "end_ms", "cue_id"], "n")
    fallback = ranked.select(
        "job_id", (F.col("n") - 1).alias("interval_no"), "start_ms", "end_ms", F.lit(0).cast("long").alias("word_count"),
        F.lit("cue_fallback").alias("quality"),
    )
    return islands.withColumn("quality", F.lit("word")).unionByName(fallback)


def silence_spans(islands: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Gaps between speech intervals, before the first and (with totals) after the last."""
    n = seq.neighbours(islands, JOB, ["start_ms", "interval_no"], ["start_ms", "end_ms"], prev="p", nxt="n")
    if totals is not None:
        n = n.join(totals.select("job_id", "total_duration_ms"), "job_id", "left")
    else:
        n = n.withColumn("total_duration_ms", F.lit(None).cast("long"))

    def gap(position: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(position).alias("position"), a.alias("start_ms"), b.alias("end_ms"))

    zero = F.lit(0).cast("long")
    found = F.array(
        F.when(F.col("p").isNull() & (F.col("start_ms") > 0), gap("before_first", zero, F.col("start_ms"))),
        F.when(F.col("n.start_ms") > F.col("end_ms"), gap("between_speech", F.col("end_ms"), F.col("n.start_ms"))),
        F.when(
            F.col("n").isNull() & (F.col("total_duration_ms") > F.col("end_ms")),
            gap("after_last", F.col("end_ms"), F.col("total_duration_ms")),
        ),
    )
    g = n.select("job_id", F.inline(F.filter(found, lambda x: x.isNotNull())))
    return g.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def source_silences(islands: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Silence spans numbered densely per recording."""
    g = seq.ranked(silence_spans(islands, totals), JOB, ["start_ms", "end_ms"], "silence_no")
    return g.withColumn("silence_no", F.col("silence_no") - 1)


def speech_gaps(
    cues: DataFrame, totals: DataFrame | None = None, *, guard_ms: int = 100, width: int = seq.HOUR_MS
) -> DataFrame:
    """Silence around cues, with the neighbours, the pause to keep and the usable overflow.

    ``totals`` (job_id, total_duration_ms) adds the tail gap and full-track gaps of jobs without cues.
    """
    n = seq.neighbours(
        cues, JOB, ["start_ms", "end_ms", "cue_id"], ["start_ms", "cue_id"], prev="p", nxt="n", width=width
    )
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")

    def gap(position: str, a: Column, b: Column, before: Column, after: Column) -> Column:
        return F.struct(
            F.lit(position).alias("position"), a.alias("start_ms"), b.alias("end_ms"),
            before.alias("preceding_cue_id"), after.alias("following_cue_id"),
        )

    me = F.col("cue_id")
    found = F.array(
        F.when(F.col("p").isNull() & (F.col("start_ms") > 0), gap("before_first", zero, F.col("start_ms"), none, me)),
        F.when(
            F.col("n.start_ms") > F.col("end_ms"),
            gap("between_speech", F.col("end_ms"), F.col("n.start_ms"), me, F.col("n.cue_id")),
        ),
    )
    g = n.select("job_id", F.inline(F.filter(found, lambda x: x.isNotNull())))
    if totals is not None:
        # totals meet one row per job, so the cues do not move for them
        last = cues.groupBy("job_id").agg(F.max(F.struct("start_ms", "end_ms", "cue_id")).alias("c"))
        t, total = totals.select("job_id", "total_duration_ms").join(last, "job_id", "left"), F.col("total_duration_ms")
        found = F.when(F.col("c").isNull(), F.when(total > 0, gap("full_track", zero, total, none, none)))
        found = found.otherwise(F.when(total > F.col("c.end_ms"), gap("after_last", F.col("c.end_ms"), total, F.col("c.cue_id"), none)))
        g = g.unionByName(t.select("job_id", F.inline(F.filter(F.array(found), lambda x: x.isNotNull()))))
    dur = F.col("end_ms") - F.col("start_ms")
    return g.select(
        "*", dur.alias("duration_ms"), preserve_pause_ms(dur).alias("preserve_pause_ms"),
        usable_overflow_ms(dur, guard_ms).alias("usable_overflow_ms"),
    )


def interval_overlap(
    cues: DataFrame, intervals: DataFrame, *, bucket_ms: int = 60_000, interval_key: str = "interval_no"
) -> DataFrame:
    """Pairs (cue, interval) of one recording that overlap in time.

    Both sides are cut into time buckets and joined on (job, bucket); a pair is reported only in the
    bucket where the later of the two starts, so nothing is compared twice and no distinct is needed.
    """

    def spread(df: DataFrame, a: str, b: str) -> DataFrame:
        last = F.greatest(F.col(a), F.col(b) - 1)
        buckets = F.sequence(F.floor(F.col(a) / bucket_ms), F.floor(last / bucket_ms))
        return df.withColumn("_b", F.explode(buckets))

    c = spread(cues.select("job_id", "cue_id", F.col("start_ms").alias("cs"), F.col("end_ms").alias("ce")), "cs", "ce")
    i = spread(
        intervals.select("job_id", interval_key, F.col("start_ms").alias("vs"), F.col("end_ms").alias("ve")), "vs", "ve"
    )
    hit = c.join(i, ["job_id", "_b"]).where("ce > vs AND cs < ve")
    hit = hit.where(F.floor(F.greatest("cs", "vs") / bucket_ms) == F.col("_b"))
    return hit.select("job_id", interval_key, "cue_id", F.col("cs").alias("start_ms"))


def speech_summary(islands: DataFrame, silences: DataFrame) -> DataFrame:
    """Per recording: speech and silence totals, longest pause, share of speech in ten-thousandths."""
    s = islands.groupBy("job_id").agg(
        F.count("*").alias("islands"),
        F.sum("word_count").alias("words"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"),
        F.max("end_ms").alias("last_end_ms"),
    )
    q = silences.groupBy("job_id").agg(
        F.sum("duration_ms").alias("silence_ms"), F.max("duration_ms").alias("longest_pause_ms")
    )
    zero = F.lit(0).cast("long")
    return s.join(q, "job_id", "left").select(
        "job_id", "islands", "words", "speech_ms",
        F.coalesce("silence_ms", zero).alias("silence_ms"),
        F.coalesce("longest_pause_ms", zero).alias("longest_pause_ms"),
        F.expr("(speech_ms * 10000) div greatest(1, last_end_ms)").alias("speech_share_e4"),
    )


def overflow_by_cue(cues: DataFrame, gaps: DataFrame) -> DataFrame:
    """The largest usable overflow in the gap after each cue, 0 where there is none."""
    best = gaps.where("preceding_cue_id IS NOT NULL").groupBy("job_id", F.col("preceding_cue_id").alias("cue_id"))
    best = best.agg(F.max(F.greatest(F.lit(0).cast("long"), "usable_overflow_ms")).alias("m"))
    return cues.join(best, ["job_id", "cue_id"], "left").select(
        *cues.columns, F.coalesce("m", F.lit(0).cast("long")).alias("timeline_usable_overflow_ms")
    )
