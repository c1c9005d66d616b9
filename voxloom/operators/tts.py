"""Fitting synthesised speech into its time slot, and the per-recording quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import rules
from voxloom.plans import sequences as seq

JOB = ["job_id"]
CUE_ORDER = ["start_ms", "end_ms", "cue_id"]


def _ratio_e4(a: str, b: str) -> Column:
    """a/b in ten-thousandths, rounded half up, in integers."""
    return F.expr(f"(({a}) * 20000 + ({b})) div (2 * ({b}))")


def overflow_budget(
    cues: DataFrame,
    totals: DataFrame | None = None,
    *,
    max_overflow_ms: int = 6000,
    overflow_reserve_ms: int = 120,
    start_delay_ms: int = 0,
    width: int = seq.HOUR_MS,
) -> DataFrame:
    """Slack between a cue and the next start (the last: the track end), capped and minus the reserve."""
    n = seq.neighbours(cues, JOB, CUE_ORDER, ["start_ms"], nxt="_n", width=width)
    if totals is not None:
        n = n.join(totals.select("job_id", "total_duration_ms"), "job_id", "left")
        nxt = F.coalesce(F.col("_n.start_ms") + start_delay_ms, F.col("total_duration_ms"))
    else:
        nxt = F.col("_n.start_ms") + start_delay_ms
    zero = F.lit(0).cast("long")
    slack = F.greatest(zero, nxt - F.col("start_ms") - start_delay_ms - max(0, overflow_reserve_ms))
    budget = F.least(F.lit(max(0, max_overflow_ms)).cast("long"), F.greatest(zero, slack - F.col("duration_ms")))
    out = n.withColumn("overflow_budget_ms", F.when(nxt.isNull(), zero).otherwise(budget)).drop("_n")
    return out.drop("total_duration_ms") if totals is not None else out


def duration_plan(
    *,
    orig: str = "duration_ms",
    tts: str = "tts_duration_ms",
    overflow: str = "overflow_budget_ms",
    soft_limit_e4: int = 12000,
    hard_limit_e4: int = 13000,
) -> Column:
    """Struct (action, stretch_ratio_e3, overflow_ms, warnings). Limits are ten-thousandths.

    Tested in order: shorter, equal, fits the overflow, overflow plus stretch, soft limit, hard
    limit, rephrase. Non-positive durations give a null plan.
    """
    ratio, both = _ratio_e4(tts, orig), _ratio_e4(tts, f"{orig} + {overflow}")
    over = F.col(tts) - F.col(orig)

    def plan(action: str, stretch_e3: Column | int, overflow_ms: Column | int, *warnings: str) -> Column:
        def col(v):
            return (v if isinstance(v, Column) else F.lit(v)).cast("long")

        warn = F.array(*[F.lit(w) for w in warnings]) if warnings else F.array().cast("array<string>")
        return F.struct(
            F.lit(action).alias("action"), col(stretch_e3).alias("stretch_ratio_e3"),
            col(overflow_ms).alias("overflow_ms"), warn.alias("warnings"),
        )

    combined = F.expr(f"(({_sql_ratio(tts, f'{orig} + {overflow}')}) + 9) div 10")
    hundredth = F.expr(f"((({_sql_ratio(tts, orig)}) + 50) div 100) * 10")
    shared = "tts_duration_uses_source_silence_and_time_stretch"
    near = "tts_duration_near_hard_limit"
    return (
        F.when((F.col(orig) <= 0) | (F.col(tts) <= 0), F.lit(None))
        .when(ratio < 10000, plan("pad_silence", 1000, 0, "tts_duration_shorter_than_source"))
        .when(ratio == 10000, plan("pad_silence", 1000, 0))
        .when(over <= F.col(overflow), plan("overflow", 1000, over, "tts_duration_overflow_into_source_silence"))
        .when(
            (F.col(overflow) > 0) & (both <= min(soft_limit_e4, hard_limit_e4)),
            plan("time_stretch_overflow", combined, F.col(overflow), shared),
        )
        .when(
            (F.col(overflow) > 0) & (both <= hard_limit_e4),
            plan("time_stretch_overflow", combined, F.col(overflow), shared, near),
        )
        .when(ratio <= soft_limit_e4, plan("time_stretch", hundredth, 0))
        .when(ratio <= hard_limit_e4, plan("time_stretch", hundredth, 0, near))
        .otherwise(plan("rephrase", 1000, 0, "tts_duration_exceeds_hard_limit"))
    )


def _sql_ratio(a: str, b: str) -> str:
    return f"(({a}) * 20000 + ({b})) div (2 * ({b}))"


def target_end_ms(start_delay_ms: int = 0) -> Column:
    """End on the output track by action."""
    start = F.col("start_ms") + start_delay_ms
    action = F.col("plan.action")
    return (
        F.when(action == "overflow", start + F.col("tts_duration_ms"))
        .when(action == "time_stretch_overflow", start + F.col("duration_ms") + F.col("plan.overflow_ms"))
        .otherwise(start + F.col("duration_ms"))
    )


def alignment_rows(cues: DataFrame, *, start_delay_ms: int = 0, hard_limit_e4: int = 13000) -> DataFrame:
    """Timing columns of every cue that has a synthesised duration and an overflow budget."""
    p = cues.withColumn("plan", duration_plan(hard_limit_e4=hard_limit_e4))
    return p.select(
        "job_id",
        "cue_id",
        "sentence_no",
        (F.col("start_ms") + start_delay_ms).alias("target_start_ms"),
        target_end_ms(start_delay_ms).alias("target_end_ms"),
        F.col("start_ms").alias("original_start_ms"),
        F.col("end_ms").alias("original_end_ms"),
        F.col("duration_ms").alias("orig_duration_ms"),
        "tts_duration_ms",
        F.col("plan.action").alias("alignment_action"),
        F.col("plan.stretch_ratio_e3").alias("stretch_ratio_e3"),
        F.col("plan.overflow_ms").alias("overflow_ms"),
        F.col("overflow_budget_ms").alias("available_overflow_ms"),
        (F.col("duration_ms") + F.col("overflow_budget_ms")).alias("target_window_ms"),
        F.col("plan.warnings").alias("warnings"),
        "source_text",
    )


def compression_budget(rows: DataFrame, *, max_speedup: float = 1.3) -> DataFrame:
    """Required speed-up (ten-thousandths, cut) and how many characters a shorter text may have."""
    share = F.least(F.lit(1.0), F.col("target_window_ms") * F.lit(max_speedup) / F.greatest(F.lit(1), F.col("tts_duration_ms")))
    return rows.select(
        "job_id",
        "cue_id",
        F.expr("greatest(10000, (tts_duration_ms * 10000) div target_window_ms)").alias("required_speedup_e4"),
        F.greatest(F.lit(1), F.ceil(F.length("source_text") * share)).cast("long").alias("max_chars"),
        (F.col("tts_duration_ms") / F.col("target_window_ms") > max_speedup).alias("needs_shorter_text"),
    )


def slot_fit(rows: DataFrame, *, max_speedup: float = 1.3, width: int = seq.HOUR_MS) -> DataFrame:
    """Compare each clip with the slot to the next start: fits, stretch, or violation."""
    r = rows.withColumn("start_ms", F.col("target_start_ms"))
    n = seq.neighbours(r, JOB, ["start_ms", "cue_id"], ["start_ms"], nxt="_n", width=width)
    slot = F.greatest(F.lit(1).cast("long"), F.col("_n.start_ms") - F.col("start_ms"))
    ratio = F.col("tts_duration_ms") / slot
    state = (
        F.when(F.col("_n").isNull() | (F.col("tts_duration_ms") <= slot), "fits")
        .when(ratio <= max_speedup, "stretch")
        .otherwise("tts_segment_exceeds_max_speedup")
    )
    return n.select(
        "job_id", "cue_id", "target_start_ms", "tts_duration_ms",
        F.when(F.col("_n").isNotNull(), slot).alias("slot_ms"), state.alias("slot_state"),
    )


def effective_tts_text(segments: DataFrame) -> DataFrame:
    """Text to speak: silence gives '', a present spoken text wins even if empty, else the translation."""

    def pick(own: str) -> Column:
        return F.when(F.col("tts_manual_action") == "silence", "").otherwise(
            F.coalesce(F.col(own), F.col("translated_text"), F.lit(""))
        )

    return segments.select(
        "job_id", "segment_id", pick("spoken_text").alias("tts_text"), pick("display_text").alias("tts_display_text")
    )


def timing_risk(
    cues: DataFrame, *, max_speedup: float = 1.3, token_ms: int = 300, guard_ms: int = 100, width: int = seq.HOUR_MS
) -> DataFrame:
    """Estimated speaking time against the room to the next cue; dense cues get a risk flag."""
    n = seq.neighbours(cues, JOB, CUE_ORDER, ["start_ms"], nxt="_n", width=width)
    tokens = F.size(F.regexp_extract_all("spoken_text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).cast("long")
    room = F.coalesce(F.col("_n.start_ms"), F.col("end_ms")) - F.col("start_ms") - guard_ms
    n = n.withColumn("estimate_ms", tokens * token_ms).withColumn(
        "available_ms", F.greatest(F.col("end_ms") - F.col("start_ms"), room)
    )
    n = n.where("estimate_ms > 0")
    return n.select(
        "job_id", "cue_id", "estimate_ms", "available_ms",
        F.expr("(estimate_ms * 20000 + greatest(1, available_ms)) div (2 * greatest(1, available_ms))").alias("ratio_e4"),
        (F.col("estimate_ms") / F.greatest(F.lit(1), F.col("available_ms")) > max_speedup).alias("dense"),
    )


def neighbour_cues(cues: DataFrame, *, width: int = seq.HOUR_MS) -> DataFrame:
    n = seq.neighbours(cues, JOB, CUE_ORDER, ["cue_id", "source_text"], prev="p", nxt="n", width=width)
    return n.select(
        "job_id", "cue_id", F.col("p.cue_id").alias("previous_cue_id"), F.col("n.cue_id").alias("next_cue_id"),
        F.col("p.source_text").alias("previous_text"), F.col("n.source_text").alias("next_text"),
    )


def nearest_rank(df: DataFrame, key: list[str], value: str, q: float, name: str) -> DataFrame:
    """Element at position ceil(n*q) of the ordered values, from value counts instead of value lists."""
    counts = df.groupBy(*key, value).agg(F.count("*").alias("_n"))
    cum = seq.running(counts, key, [value], {"_cum": ("sum", "_n")}, width=seq.ROWS)
    total = counts.groupBy(*key).agg(F.sum("_n").alias("_total"))
    need = F.greatest(F.lit(1), F.ceil(F.col("_total") * F.lit(q)))
    return cum.join(total, key).where(F.col("_cum") >= need).groupBy(*key).agg(F.min(value).alias(name))


def qa_report(rows: DataFrame) -> DataFrame:
    """One row per recording; CER and recall are integers in millionths.

    Needs the alignment columns plus leading_silence_ms, cer_e6, recall_e6, rephrase_attempts,
    semantic_retries. Percentiles come from value counts, so a long recording is no hot group.
    """
    speed = F.greatest(F.lit(1.0), F.col("stretch_ratio_e3") / 1000)
    r = rows.withColumn(
        "drift_ms",
        F.greatest(
            F.abs(F.col("target_start_ms") + F.col("leading_silence_ms") - F.col("original_start_ms")),
            F.greatest(F.lit(0).cast("long"), F.col("target_end_ms") - F.col("original_end_ms")),
        ),
    ).withColumn(
        "unused_ms",
        F.greatest(F.lit(0).cast("long"), F.col("target_window_ms") - (F.col("tts_duration_ms") / speed).cast("long")),
    )
    sums = r.groupBy("job_id").agg(
        F.count("*").alias("cues_total"),
        F.count_if(F.col("overflow_ms") > 0).alias("tts_overflow_segments"),
        F.max("overflow_ms").alias("max_overflow_ms"),
        F.sum("overflow_ms").alias("overflow_total_ms"),
        F.count_if(F.col("rephrase_attempts") > 0).alias("rephrased_cues"),
        F.sum("semantic_retries").alias("semantic_retries"),
        F.count_if(F.col("cer_e6").isNull()).alias("semantic_failures"),
        F.min(F.coalesce("recall_e6", F.lit(1_000_000).cast("long"))).alias("semantic_token_recall_min_e6"),
        F.sum("unused_ms").alias("unused_window_total_ms"),
    )
    drift = nearest_rank(r, JOB, "drift_ms", 0.95, "sync_drift_p95_ms")
    cer = nearest_rank(
        r.withColumn("cer", F.coalesce("cer_e6", F.lit(0).cast("long"))), JOB, "cer", 0.95, "semantic_cer_p95_e6"
    )
    return sums.join(drift, "job_id").join(cer, "job_id")


def manual_review_errors(rows: DataFrame) -> DataFrame:
    """Failure texts a reviewer can settle, with the limits they name and a hint."""
    t = F.col("error")

    def number(key: str) -> Column:
        hit = F.regexp_extract(t, rf"(?:^|\s){key}=(\d+)(?:\s|$)", 1)
        return F.when(hit != "", hit.cast("long"))

    code = F.coalesce(*[F.when(F.contains(t, F.lit(c)), F.lit(c)) for c in rules.MANUAL_CODES])
    max_chars, actual = number("max_chars"), number("actual_chars")
    shorten = F.concat(F.lit("shorten to "), max_chars.cast("string"), F.lit(" characters or fewer"))
    hint = (
        F.when(code == "tts_duration_exceeds_max_speedup", "audio too long: shorten spoken text or silence")
        .when(code == "tts_semantic_quality_failed", "heard text differs: correct text or silence")
        .when(code == "tts_rephrase_empty", "shortening returned nothing: provide shorter text or silence")
        .when(max_chars.isNotNull() & actual.isNotNull(), F.concat(shorten, F.lit(", now "), actual.cast("string")))
        .when(max_chars.isNotNull(), shorten)
        .when(code.isNotNull(), "still too long: shorten text or silence")
    )
    return rows.select(
        "job_id", "cue_id", code.isNotNull().alias("manual"), code.alias("code"), max_chars.alias("max_chars"),
        actual.alias("actual_chars"), hint.alias("hint"),
    )


def db_to_linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def review_time_label(ms: Column) -> Column:
    """[hh:]mm:ss.mmm"""
    s = F.greatest(F.lit(0).cast("long"), ms)
    h, m, sec, milli = F.floor(s / 3_600_000), F.floor(s / 60_000) % 60, F.floor(s / 1000) % 60, s % 1000
    short = F.format_string("%02d:%02d.%03d", m, sec, milli)
    return F.when(h > 0, F.concat(F.format_string("%02d:", h), short)).otherwise(short)
