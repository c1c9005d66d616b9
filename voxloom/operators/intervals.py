"""Speech intervals from frame levels or window probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.plans import sequences as seq
from voxloom.session import cut

JOB = ["job_id"]
ORDER = ["start_ms", "end_ms"]


def pcm_frames(clips: DataFrame, *, frame_ms: int = 100, channels: str | None = None) -> DataFrame:
    """Clips (clip_id, sample_rate, samples[]) as fixed frames with integer RMS of the first channel."""
    c = clips.withColumn("ch", F.col(channels) if channels else F.lit(1))
    c = c.withColumn("first", F.filter("samples", lambda x, i: i % F.col("ch") == 0))
    c = c.withColumn("n", F.greatest(F.lit(1), F.floor(F.col("sample_rate") * frame_ms / 1000)).cast("int"))
    c = c.where(F.size("first") > 0)
    c = c.withColumn("f", F.explode(F.sequence(F.lit(0), F.ceil(F.size("first") / F.col("n")).cast("int") - 1)))
    part = F.slice("first", F.col("f") * F.col("n") + 1, F.col("n"))
    square = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    c = c.withColumn("part_n", F.size(part)).withColumn("rms", F.sqrt(square / F.size(part)).cast("long"))
    at = F.col("f") * F.col("n")
    return c.select(
        "clip_id", F.col("f").cast("long").alias("frame"),
        F.floor(at * 1000 / F.col("sample_rate")).cast("long").alias("start_ms"),
        F.floor((at + F.col("part_n")) * 1000 / F.col("sample_rate")).cast("long").alias("end_ms"), "rms",
    )


def speech_threshold(frames: DataFrame, *, ratio: float = 0.08) -> DataFrame:
    m = frames.groupBy("job_id").agg(F.max("rms").alias("max_rms"), F.max("end_ms").alias("duration_ms"))
    return m.select("job_id", "max_rms", (F.col("max_rms") * F.lit(ratio)).alias("threshold"), "duration_ms")


def _frame_runs(frames: DataFrame, width: int) -> DataFrame:
    r = seq.islands(frames, JOB, ["i"], ["i"], lambda p, c: c["i"] - p["i"] > 1, "run", width=width)
    return r.groupBy("job_id", "run").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def energy_islands(frames: DataFrame, *, ratio: float = 0.08, width: int = seq.ROWS) -> DataFrame:
    """Runs of frames at or above a share of the loudest; silent recordings give one flagged interval."""
    t = speech_threshold(frames, ratio=ratio)
    speech = frames.select("job_id", "i", "start_ms", "end_ms", "rms").join(t, "job_id").where("max_rms > 0 AND rms >= threshold")
    runs = _frame_runs(speech, width).select("job_id", "start_ms", "end_ms", F.lit("vad_energy").alias("reason"))
    silent = t.where("max_rms <= 0").select(
        "job_id", F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"), F.lit("vad_fallback_full_audio").alias("reason")
    )
    return runs.unionByName(silent)


def silence_gaps(frames: DataFrame, *, ratio: float = 0.08, width: int = seq.ROWS) -> DataFrame:
    """Runs of frames below the speech threshold."""
    quiet = frames.join(speech_threshold(frames, ratio=ratio), "job_id").where("rms < threshold")
    return _frame_runs(quiet, width).select("job_id", "start_ms", "end_ms")


def merge_intervals(intervals: DataFrame, *, gap_ms: int, width: int = seq.HOUR_MS) -> DataFrame:
    """Intervals whose gap to everything before is at most ``gap_ms`` become one."""
    order = [*ORDER, "_id"] if "_id" in intervals.columns else ORDER
    r = seq.running(cut(intervals.select("job_id", *order)), JOB, order, {"_reach": ("max", "end_ms")}, width=width)
    r = seq.islands(r, JOB, order, ["start_ms", "_reach"], lambda p, c: c["start_ms"] - p["_reach"] > gap_ms, "grp", width=width)
    return r.groupBy("job_id", "grp").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("grp")


def pad_intervals(
    intervals: DataFrame, totals: DataFrame, *, padding_ms: int = 1_500, merge_gap_ms: int | None = None, width: int = seq.HOUR_MS
) -> DataFrame:
    """Widen, clamp to the track (``duration_ms``) and merge again."""
    if padding_ms > 0:
        p = intervals.join(totals.select("job_id", "duration_ms"), "job_id")
        intervals = p.select(
            "job_id", F.greatest(F.lit(0).cast("long"), F.col("start_ms") - padding_ms).alias("start_ms"),
            F.least("duration_ms", F.col("end_ms") + padding_ms).alias("end_ms"),
        )
    elif merge_gap_ms is None:
        return intervals
    return merge_intervals(intervals, gap_ms=padding_ms if merge_gap_ms is None else merge_gap_ms, width=width)


def keep_long(intervals: DataFrame, totals: DataFrame, *, min_ms: int = 700) -> DataFrame:
    """Drop short intervals; a recording left with none gets its full track, flagged."""
    kept = intervals.where(F.col("end_ms") - F.col("start_ms") >= min_ms).select("job_id", "start_ms", "end_ms", F.lit("speech").alias("reason"))
    empty = totals.join(kept.select("job_id").distinct(), "job_id", "left_anti").select(
        "job_id", F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"), F.lit("vad_fallback_full_audio").alias("reason")
    )
    return kept.unionByName(empty)


def absorb_short(
    intervals: DataFrame, *, target_min_ms: int = 20_000, hard_max_ms: int | None = None, width: int = seq.HOUR_MS
) -> DataFrame:
    """Intervals shorter than the target absorb the following ones (within ``hard_max_ms`` if given)."""
    order = ORDER
    if target_min_ms <= 0:
        return intervals.withColumn("members", F.lit(1).cast("long"))
    r = seq.ranked(cut(intervals.select("job_id", *ORDER)), JOB, order, "rn", width=width)
    r = cut(r.withColumn("pos", F.col("rn") - 1).drop("rn"))
    marks = r.select("job_id", "pos", F.col("end_ms").alias("level"))
    reach = seq.first_beyond(
        r.select("job_id", "pos", (F.col("start_ms") + target_min_ms - 1).alias("threshold")), marks, JOB, "stop", width=width
    )
    nxt = F.col("stop") + 1
    e = reach
    if hard_max_ms is not None:
        over = seq.first_beyond(
            r.select("job_id", "pos", (F.col("start_ms") + hard_max_ms).alias("threshold")), marks, JOB, "over", width=width
        )
        e = e.join(over, ["job_id", "pos"])
        nxt = F.least(nxt, F.when(F.col("over").isNotNull(), F.greatest(F.col("over"), F.col("pos") + 1)))
    last = r.groupBy("job_id").agg(F.max("pos").alias("last"))
    e = e.join(last, "job_id").select("job_id", "pos", F.when(nxt <= F.col("last"), nxt).alias("nxt"))
    g = seq.spans_from_starts(r, seq.chase(e, JOB), JOB, "grp")
    return g.groupBy("job_id", "grp").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"), F.count("*").alias("members")
    ).drop("grp")


def _inside(gaps: DataFrame, intervals: DataFrame, bucket_ms: int, whole: bool) -> DataFrame:
    """(job, iv, a, b): parts of gaps inside intervals, joined by time bucket; with ``whole`` only gaps that begin and end inside."""
    def spread(df: DataFrame, a: str, b: str) -> DataFrame:
        last = F.greatest(F.col(a), F.col(b) - 1)
        return df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / bucket_ms), F.floor(last / bucket_ms))))

    g = spread(gaps.select("job_id", F.col("start_ms").alias("gs"), F.col("end_ms").alias("ge")), "gs", "ge")
    v = spread(intervals.select("job_id", "iv", F.col("start_ms").alias("vs"), F.col("end_ms").alias("ve")), "vs", "ve")
    hit = g.join(v, ["job_id", "_b"]).where("gs >= vs AND ge <= ve" if whole else "ge > vs AND gs < ve")
    hit = hit.where(F.floor(F.greatest("gs", "vs") / bucket_ms) == F.col("_b"))
    return hit.select("job_id", "iv", F.greatest("gs", "vs").alias("a"), F.least("ge", "ve").alias("b"))


def split_long(
    intervals: DataFrame,
    gaps: DataFrame,
    *,
    midpoints: bool,
    target_min_ms: int = 20_000,
    preferred_ms: int = 45_000,
    hard_ms: int = 90_000,
    hard_cuts: bool | None = None,
    width: int = seq.HOUR_MS,
) -> DataFrame:
    """Cut long intervals at pauses.

    ``midpoints=False`` (frame levels): intervals over the preferred length are cut at the end of the
    pause closest to it; without one the rest stays whole and is flagged, unless ``hard_cuts``.
    ``midpoints=True`` (probabilities): intervals over the hard maximum are cut in the middle of the
    pause closest to the preferred length, else at the hard maximum.

    The next cut depends only on where a piece starts. Possible starts are the interval's start, the
    pauses' cut points, and points behind a run of hard cuts; each is looked up in one scan, and the
    path from the interval's start is followed. New starts behind hard cuts are looked up in turn
    until none is left.
    """
    hard_cuts = midpoints if hard_cuts is None else hard_cuts
    preferred_ms = min(preferred_ms, hard_ms)
    limit = hard_ms if midpoints else preferred_ms
    early = max(1, min(target_min_ms, preferred_ms))
    v = seq.ranked(cut(intervals.select("job_id", *ORDER)), JOB, ORDER, "iv", width=width)
    v = cut(v.withColumn("long", F.col("end_ms") - F.col("start_ms") > limit))
    key = ["job_id", "iv"]
    long = v.where("long")
    g = _inside(gaps, long, width, whole=midpoints)
    g = g.withColumn("t", F.floor((F.col("a") + F.col("b")) / 2) if midpoints else F.col("b"))
    g = cut(seq.ranked(g, key, ["t", "a"], "k", width=width))
    ends = long.select(*key, F.col("end_ms").alias("ve"))
    last = g.groupBy(*key).agg(F.max("k").alias("last_k"))
    marks = g.select(*key, F.col("k").alias("pos"), F.col("t").alias("level"))
    gk = g.select(*key, "k", "a", "b", "t")

    def side(name: str) -> DataFrame:
        return gk.select(*key, F.col("k").alias(name), F.struct("a", "b", "t").alias(f"{name}_g"))

    def look(nodes: DataFrame) -> DataFrame:
        """Next cut for each start t: (key, t, nt, hards) with nt null where the piece stays whole."""
        def probe(ms: int) -> DataFrame:
            return nodes.select(*key, F.col("t").alias("pos"), (F.col("t") + ms).alias("threshold"))

        n = seq.first_beyond(probe(preferred_ms), marks, key, "succ", width=width)
        if hard_cuts:
            n = n.join(seq.first_beyond(probe(early - 1), marks, key, "due", width=width), [*key, "pos"])
        else:
            n = n.withColumn("due", F.lit(None).cast("long"))
        n = n.withColumnRenamed("pos", "t").join(ends, key).join(last, key, "left")
        n = n.withColumn("pred", F.coalesce(F.col("succ") - 1, F.col("last_k")))
        for s in ("succ", "pred", "due"):
            n = n.join(side(s), [*key, s], "left")
        t, end = F.col("t"), F.col("ve")
        want, first, latest = t + preferred_ms, t + early, F.least(t + hard_ms, end)

        def offer(s: str, ok: Column) -> Column:
            length = F.col(f"{s}_g.b") - F.greatest(F.col(f"{s}_g.a"), t)
            tie = F.lit(0).cast("long") if midpoints else -length
            return F.when(
                ok, F.struct(F.abs(F.col(f"{s}_g.t") - want).alias("off"), tie.alias("tie"), F.col(f"{s}_g.t").alias("t"))
            )

        p_ok = F.col("pred_g.t") >= first
        if midpoints:
            s_ok = F.col("succ_g.t") <= t + hard_ms
            late = F.lit(None)
        else:
            s_ok = (F.col("succ_g.a") <= want) & (F.col("succ_g.a") < latest)
            late = F.when((F.col("succ_g.a") < latest) & (first < latest), F.col("succ_g.t"))
        best = F.array_min(F.filter(F.array(offer("pred", p_ok), offer("succ", s_ok)), lambda x: x.isNotNull()))["t"]
        chosen = F.coalesce(F.when(first < latest, best), late)
        chosen = F.when((chosen > t) & (chosen < end), chosen)
        n = n.withColumn("active", end - t > limit).withColumn("chosen", F.when(F.col("active"), chosen))
        room = F.ceil((end - t) / hard_ms) - 1
        upto = F.floor((F.coalesce("due_g.t" if midpoints else "due_g.a", end) - t) / hard_ms)
        hards = F.when(
            F.col("active") & F.col("chosen").isNull() & F.lit(hard_cuts), F.greatest(F.lit(1), F.least(room, upto))
        )
        n = n.withColumn("hards", F.when(room >= 1, hards).cast("long"))
        return n.select(*key, "t", F.coalesce("chosen", t + F.col("hards") * hard_ms).alias("nt"), "hards", "active")

    starts = long.select(*key, F.col("start_ms").alias("t")).unionByName(g.select(*key, "t")).distinct()
    table = cut(look(starts))
    if hard_cuts:
        new = table
        while True:
            fresh = cut(new.where("hards > 0").select(*key, F.col("nt").alias("t")).distinct().join(table, [*key, "t"], "left_anti"))
            if fresh.limit(1).count() == 0:
                break
            new = cut(look(fresh))
            table = cut(table.unionByName(new))
    nodes = cut(seq.ranked(table, key, ["t"], "rn", width=width).withColumn("pos", F.col("rn") - 1))
    target = nodes.select(*key, F.col("t").alias("nt"), F.col("pos").alias("npos"))
    edges = nodes.join(target, [*key, "nt"], "left").select(*key, "pos", F.col("npos").alias("nxt"))
    path = seq.chase(edges, key).join(nodes, [*key, "pos"])
    soft = "vad_silero_pause_split" if midpoints else "vad_silence_split"
    hard = "vad_silero_hard_split" if midpoints else "vad_hard_split"
    rest, uncut = ("vad_silero", "vad_silero") if midpoints else ("rest", "whole")
    # a run of hard cuts becomes that many pieces
    step = F.when(F.col("hards") > 0, F.sequence(F.lit(0).cast("long"), F.col("hards") - 1)).otherwise(F.array(F.lit(0).cast("long")))
    p = path.join(ends, key).withColumn("h", F.explode(step))
    at = F.col("t") + F.col("h") * hard_ms
    stop = F.when(F.col("hards") > 0, at + hard_ms).otherwise(F.coalesce("nt", "ve"))
    whole = F.col("nt").isNull()
    pieces = p.select(
        "job_id", at.alias("start_ms"), stop.alias("end_ms"),
        F.when(F.col("hards") > 0, hard).when(whole, rest).otherwise(soft).alias("reason"),
        F.when(F.col("hards") > 0, "hard_split").when(whole & F.col("active"), "segment_over_hard_max").otherwise("").alias("flag"),
    )
    short = v.where("NOT long").select("job_id", *ORDER, F.lit(uncut).alias("reason"), F.lit("").alias("flag"))
    return short.unionByName(pieces.where("end_ms > start_ms"))


def interval_neighbours(intervals: DataFrame, totals: DataFrame | None = None, *, width: int = seq.HOUR_MS) -> DataFrame:
    """Number intervals and add the silence before and after each."""
    n = seq.neighbours(cut(intervals.select("job_id", *ORDER)), JOB, ORDER, ORDER, prev="p", nxt="n", width=width)
    n = seq.ranked(n, JOB, ORDER, "no", width=width)
    zero = F.lit(0).cast("long")
    if totals is not None:
        n = n.join(totals.select("job_id", "duration_ms"), "job_id", "left")
        tail = F.greatest(zero, F.col("duration_ms") - F.col("end_ms"))
    else:
        tail = zero
    return n.select(
        "job_id", F.format_string("seg_%06d", "no").alias("segment_id"), *ORDER,
        (F.col("start_ms") - F.coalesce("p.end_ms", zero)).alias("silence_before_ms"),
        F.when(F.col("n").isNotNull(), F.col("n.start_ms") - F.col("end_ms")).otherwise(F.coalesce(tail, zero)).alias("silence_after_ms"),
    )


def probability_islands(windows: DataFrame, *, threshold: float = 0.5, window_ms: int = 500, width: int = seq.ROWS) -> DataFrame:
    """Windows (job_id, i 1-based, probability) at or above the threshold, as intervals."""
    s = windows.where(F.col("probability") >= threshold)
    s = s.withColumn("start_ms", (F.col("i") - 1) * window_ms).withColumn("end_ms", F.col("i") * window_ms)
    return _frame_runs(s, width).drop("run")


def context_chunks(
    frames: DataFrame,
    *,
    ratio: float = 0.08,
    merge_gap_ms: int = 2_500,
    padding_ms: int = 1_500,
    min_speech_ms: int = 700,
    target_min_ms: int = 20_000,
    preferred_ms: int = 45_000,
    hard_ms: int = 90_000,
) -> DataFrame:
    """The whole way from frame levels to numbered context chunks."""
    totals = cut(speech_threshold(frames, ratio=ratio))
    iv = merge_intervals(energy_islands(frames, ratio=ratio), gap_ms=merge_gap_ms)
    iv = cut(keep_long(pad_intervals(iv, totals, padding_ms=padding_ms), totals, min_ms=min_speech_ms))
    iv = cut(absorb_short(iv, target_min_ms=target_min_ms))
    iv = split_long(
        iv, silence_gaps(frames, ratio=ratio), midpoints=False, target_min_ms=target_min_ms, preferred_ms=preferred_ms, hard_ms=hard_ms
    )
    return interval_neighbours(cut(iv), totals)


def post_process_speech(
    intervals: DataFrame,
    totals: DataFrame,
    *,
    min_speech_ms: int = 700,
    min_silence_ms: int = 500,
    padding_ms: int = 250,
    target_min_ms: int = 20_000,
    preferred_ms: int = 45_000,
    hard_ms: int = 90_000,
    merge_gap_ms: int = 300,
    width: int = seq.HOUR_MS,
) -> DataFrame:
    """Probability intervals filtered, merged, padded, merged, absorbed and split."""
    iv = intervals.join(totals.select("job_id", "duration_ms"), "job_id")
    iv = iv.where((F.col("end_ms") > F.col("start_ms")) & (F.col("end_ms") - F.col("start_ms") >= min_speech_ms))
    speech = cut(
        iv.select("job_id", F.greatest(F.lit(0).cast("long"), "start_ms").alias("start_ms"), F.least("duration_ms", "end_ms").alias("end_ms"))
    )
    m = merge_intervals(speech, gap_ms=max(merge_gap_ms, min_silence_ms), width=width)
    m = cut(pad_intervals(m, totals, padding_ms=padding_ms, merge_gap_ms=merge_gap_ms, width=width))
    m = cut(absorb_short(m, target_min_ms=target_min_ms, hard_max_ms=hard_ms, width=width))
    n = seq.neighbours(speech, JOB, ORDER, ["start_ms"], nxt="n", width=width)
    gaps = n.where("n.start_ms > end_ms").select("job_id", F.col("end_ms").alias("start_ms"), F.col("n.start_ms").alias("end_ms"))
    out = split_long(
        m, gaps, midpoints=True, target_min_ms=target_min_ms, preferred_ms=preferred_ms, hard_ms=hard_ms, width=width
    )
    empty = totals.join(speech.select("job_id").distinct(), "job_id", "left_anti").select(
        "job_id", F.lit(0).cast("long").alias("start_ms"), F.col("duration_ms").alias("end_ms"),
        F.lit("vad_fallback_full_audio").alias("reason"), F.lit("no_speech_detected").alias("flag"),
    )
    return out.unionByName(empty)
