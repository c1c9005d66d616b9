"""Review: which cues need it, locks and overrides coming back, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import rules
from voxloom.plans import sequences as seq
from voxloom.session import cut

JOB = ["job_id"]
CUE = ["job_id", "cue_id"]
ORDER = ["start_ms", "end_ms", "cue_id"]


def _text(*cols: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit(""))


def cue_projection_v2(cues: DataFrame) -> DataFrame:
    """Fixed output columns with text fallbacks."""
    return cues.select(
        "job_id", "cue_id", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        F.coalesce("source_text", F.lit("")).alias("source_text"),
        F.coalesce("source_text_raw", "source_text", F.lit("")).alias("source_text_raw"),
        _text("display_text", "translated_text").alias("display_text"),
        _text("spoken_text", "translated_text").alias("spoken_text"),
        F.coalesce("risk_flags", F.array().cast("array<string>")).alias("risk_flags"),
    )


def review_required(cues: DataFrame) -> DataFrame:
    """Unlocked cues with edits, suggestions, high-risk flags or errors, and the strongest reason.

    Needs n_edits, n_suggestions, risk_flags[], protected_errors[], spoken_errors[], review_status.
    """
    high = F.array_intersect("risk_flags", F.array(*[F.lit(x) for x in rules.HIGH_RISK]))
    pe = F.filter("protected_errors", lambda x: F.trim(x) != "")
    se = F.filter("spoken_errors", lambda x: F.trim(x) != "")
    edits = (F.col("n_edits") > 0) | (F.col("n_suggestions") > 0)
    reason = (
        F.when(F.size(pe) > 0, "translation_protected_span_review_required")
        .when(F.size(se) > 0, "translation_spoken_text_review_required")
        .when(edits, "source_normalization_review_required")
        .when(F.size(high) > 0, "asr_timeline_review_required")
    )
    error = F.when(F.size(pe) > 0, F.array_join(pe, "; ")).when(F.size(se) > 0, F.array_join(se, "; "))
    c = cues.where("NOT review_status <=> 'locked'")
    return c.select(
        "job_id", "cue_id", "start_ms", "end_ms", reason.alias("reason"), error.alias("error"),
        F.array_join(high, "|").alias("high_risk_flags"),
    ).where("reason IS NOT NULL")


def timing_violations(cues: DataFrame, overrides: DataFrame, *, width: int = seq.HOUR_MS) -> DataFrame:
    """Overrides whose times are negative, reversed, or reach into the original neighbours."""
    n = seq.neighbours(cues, JOB, ORDER, ["start_ms", "end_ms"], prev="p", nxt="n", width=width)
    o = n.join(overrides.select(*CUE, F.col("start_ms").alias("os"), F.col("end_ms").alias("oe")), CUE)
    s, e = F.coalesce("os", "start_ms"), F.coalesce("oe", "end_ms")
    bad = (
        F.when((s < 0) | (e < 0), "must be a non-negative integer")
        .when(e <= s, "must satisfy start_ms < end_ms")
        .when(s < F.col("p.end_ms"), "overlaps previous cue")
        .when(e > F.col("n.start_ms"), "overlaps next cue")
    )
    return o.select(*CUE, bad.alias("violation")).where("violation IS NOT NULL")


def apply_review_lock(
    cues: DataFrame, locks: DataFrame, overrides: DataFrame, *, domain_profile: str = "", require_checksum: bool = False
) -> DataFrame:
    """Cues with reviewed texts and times.

    ``locks`` (job_id, domain_profile, cue_set_checksum, current_checksum) decides per recording
    whether its overrides count: a different profile or checksum drops them all. An absent checksum
    is accepted unless ``require_checksum``. Overrides with a timing violation keep the old times.
    """
    profile = F.coalesce(F.trim("domain_profile"), F.lit(""))
    check = F.coalesce(F.trim("cue_set_checksum"), F.lit(""))
    valid = (profile == "") | F.lit(domain_profile == "") | (profile == domain_profile)
    same = check == F.coalesce("current_checksum", F.lit(""))
    good = locks.where(valid & (same if require_checksum else (check == "") | same)).select("job_id")
    o = overrides.join(good, "job_id", "left_semi").groupBy(*CUE).agg(
        F.max_by(F.struct("source_text", "display_text", "spoken_text", "start_ms", "end_ms"), "arrival").alias("o")
    )
    bad = timing_violations(cues, o.select(*CUE, "o.start_ms", "o.end_ms"))
    j = cues.join(o, CUE, "left").join(bad, CUE, "left")
    fine = F.col("violation").isNull()
    return j.select(
        *CUE,
        F.when(fine, F.coalesce("o.start_ms", "start_ms")).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(fine, F.coalesce("o.end_ms", "end_ms")).otherwise(F.col("end_ms")).alias("end_ms"),
        F.coalesce("o.source_text", "source_text").alias("source_text"),
        F.coalesce("o.display_text", "display_text").alias("display_text"),
        F.coalesce("o.spoken_text", "spoken_text").alias("spoken_text"),
        F.when(F.col("o").isNotNull(), "locked").alias("review_status"),
        "violation",
    )


def apply_tts_overrides(cues: DataFrame, overrides: DataFrame) -> DataFrame:
    """Last override per cue (``updated_at``) replaces both texts; absent texts become ''."""
    o = overrides.groupBy(*CUE).agg(F.max_by(F.struct("action", "display_text", "spoken_text"), "updated_at").alias("o"))
    hit = F.col("o").isNotNull()

    def pick(c: str) -> Column:
        return F.when(hit, F.coalesce(F.col(f"o.{c}"), F.lit(""))).otherwise(F.col(c))

    return cues.join(o, CUE, "left").select(
        *CUE,
        F.when(hit, _nonblank("o.action", "edit")).alias("tts_manual_action"),
        pick("display_text").alias("display_text"),
        pick("spoken_text").alias("spoken_text"),
    )


def _nonblank(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def timing_backfill(review: DataFrame, cues: DataFrame, *, width: int = seq.HOUR_MS) -> DataFrame:
    """Fill absent review times from the cues and number the rows chronologically."""
    t = cues.select(*CUE, F.col("start_ms").alias("cs"), F.col("end_ms").alias("ce"))
    r = review.join(t, CUE, "left").select(
        *CUE, F.coalesce("start_ms", "cs", F.lit(0)).alias("start_ms"), F.coalesce("end_ms", "ce", "start_ms", F.lit(0)).alias("end_ms")
    )
    return seq.ranked(r, JOB, ORDER, "review_rank", width=width)


def accepted_suggestions(suggestions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Suggestions whose candidate id and whose segment id were both asked for."""
    s = suggestions.join(candidates.select("job_id", "candidate_id").distinct(), ["job_id", "candidate_id"], "left_semi")
    return s.join(candidates.select("job_id", "segment_id").distinct(), ["job_id", "segment_id"], "left_semi")


def attach_suggestions(segments: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Join suggestions per segment, after those it already carries, and flag the segment once.

    Suggestions keep their original words, reason and rule where either side has such columns; null on the side without.
    """
    carried = segments.schema["normalization_suggestions"].dataType.elementType.names if "normalization_suggestions" in segments.columns else []
    base = ["candidate_id", "suggested_normalized", "confidence"]
    more = [c for c in ("original", "reason", "rule_id") if c in suggestions.columns or c in carried]
    own = [F.col(c) if c in suggestions.columns else F.lit(None).cast("string").alias(c) for c in more]
    s = suggestions.where("trim(segment_id) <> ''").groupBy("job_id", "segment_id").agg(
        # answers to one segment's few candidates
        F.array_sort(F.collect_list(F.struct(*base, *own))).alias("_new")
    )
    flag = F.array(F.lit("source_normalization_llm_suggestion"))
    j = segments.join(s, ["job_id", "segment_id"], "left")
    has = F.col("_new").isNotNull()
    if carried:
        fill = lambda x: F.struct(*[(x[c] if c in carried else F.lit(None).cast("string")).alias(c) for c in base + more])
        j = j.withColumn("normalization_suggestions", F.transform("normalization_suggestions", fill))
    old = F.coalesce("normalization_suggestions", F.array().cast(s.schema["_new"].dataType)) if "normalization_suggestions" in segments.columns else None
    got = F.col("_new") if old is None else F.when(has, F.concat(old, "_new")).otherwise(F.col("normalization_suggestions"))
    flags = F.when(has, F.array_union("risk_flags", flag)).otherwise(F.col("risk_flags"))
    return j.withColumns({"normalization_suggestions": got, "risk_flags": flags}).drop("_new")


def cue_set_checksum(cues: DataFrame, columns: list[str], *, width: int = seq.HOUR_MS, fan_in: int = 1024) -> DataFrame:
    """One checksum per recording over its cues in order: hashes of rows, of runs of rows, of runs of runs.

    Hashing by levels keeps every step to ``fan_in`` hashes, however long the recording is. A recording is done when one hash is left,
    so its checksum does not depend on the others of the table.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    r = seq.ranked(cues, JOB, ORDER, "rn", width=width).select("job_id", (F.col("rn") - 1).alias("i"), row.alias("h"))
    total = r.groupBy("job_id").agg(F.count("*").alias("cues"))
    done = None
    while True:
        r = r.groupBy("job_id", F.expr(f"i div {fan_in}").alias("i2")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("i", "h")))["h"], ""), 256).alias("h")
        ).withColumnRenamed("i2", "i")
        r = cut(r)
        longer = r.where("i > 0").select("job_id").distinct()
        if longer.isEmpty():
            break
        whole = r.join(longer, "job_id", "left_anti")
        done = whole if done is None else done.unionByName(whole)
        r = r.join(longer, "job_id", "left_semi")
    top = (r if done is None else done.unionByName(r)).groupBy("job_id").agg(F.max("h").alias("cue_set_checksum"))
    return top.join(total, "job_id").select("job_id", "cue_set_checksum", "cues")
