"""Checks and edits of sample arrays. One clip is one cell, so all work stays inside its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.plans.sequences import pin

WINDOW_MS = 20


def _square_sum(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))


def with_windows(clips: DataFrame, *, silence_threshold: int = 120) -> DataFrame:
    """Add window size, overall RMS, the adaptive threshold and ``voiced`` (one flag per 20 ms window)."""
    c = clips if "channels" in clips.columns else clips.withColumn("channels", F.lit(1))
    c = c.withColumn("frames", F.floor(F.size("samples") / F.col("channels")).cast("int"))
    c = c.withColumn("win", F.greatest(F.lit(1), (F.col("sample_rate") * WINDOW_MS / 1000).cast("int")))
    c = pin(c, rms=F.when(F.size("samples") > 0, F.sqrt(_square_sum(F.col("samples")) / F.size("samples"))).otherwise(0.0))
    c = pin(c, limit=F.greatest(F.lit(silence_threshold), F.least(F.lit(1000), (F.col("rms") * 0.25).cast("int"))))
    at = F.when(
        F.col("frames") > 0, F.sequence(F.lit(0), F.ceil(F.col("frames") / F.col("win")).cast("int") - 1)
    ).otherwise(F.array().cast("array<int>"))

    def level(i: Column) -> Column:
        part = F.slice("samples", i * F.col("win") * F.col("channels") + 1, F.col("win") * F.col("channels"))
        return F.sqrt(_square_sum(part) / F.size(part)) > F.col("limit")

    return pin(c, voiced=F.transform(at, level))


def _first_voiced() -> Column:
    return F.array_position("voiced", True).cast("int")


def edge_silence(windows: DataFrame) -> DataFrame:
    """Leading and trailing silence in whole windows; a silent clip counts fully at both ends."""
    n = F.size("voiced")
    lead = F.when(_first_voiced() > 0, _first_voiced() - 1).otherwise(n)
    tail_at = F.array_position(F.reverse("voiced"), True).cast("int")
    tail = F.when(tail_at > 0, tail_at - 1).otherwise(n)
    return windows.withColumn("leading_silence_ms", (lead * WINDOW_MS).cast("long")).withColumn(
        "trailing_silence_ms", (tail * WINDOW_MS).cast("long")
    )


def with_internal_runs(windows: DataFrame) -> DataFrame:
    """Add ``runs``: silent stretches (start, end in frames) between the first and last voiced window."""
    first = _first_voiced() - 1
    last = F.size("voiced") - F.array_position(F.reverse("voiced"), True).cast("int")
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc: Column, i: Column) -> Column:
        silent = ~F.get("voiced", i)
        tail = F.try_element_at(acc, F.lit(-1))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(tail["a"].alias("a"), (i + 1).alias("b"))))
        return (
            F.when(silent & (tail["b"] == i), grown)
            .when(silent, F.concat(acc, F.array(F.struct(i.alias("a"), (i + 1).alias("b")))))
            .otherwise(acc)
        )

    runs = F.when(last > first, F.aggregate(F.sequence(first, last), empty, step)).otherwise(empty)
    in_frames = F.transform(
        runs, lambda r: F.struct((r["a"] * F.col("win")).alias("a"), F.least("frames", r["b"] * F.col("win")).alias("b"))
    )
    return pin(windows, runs=F.when(F.array_contains("voiced", True), in_frames).otherwise(empty))


def clip_stats(
    clips: DataFrame,
    *,
    min_rms: float = 500,
    silence_threshold: int = 120,
    max_edge_ms: int = 1200,
    max_internal_ms: int = 2500,
    clip_peak: int = 32760,
    max_clipped_ratio: float = 0.001,
) -> DataFrame:
    """Peak, RMS (hundredths), clipped share (millionths), silences, warnings and verdict per clip."""
    w = with_internal_runs(edge_silence(with_windows(clips, silence_threshold=silence_threshold)))
    n = F.size("samples")
    duration = F.when(F.col("sample_rate") > 0, F.floor(F.col("frames") * 1000 / F.col("sample_rate"))).otherwise(0).cast("long")
    peak = F.coalesce(F.array_max(F.transform("samples", lambda x: F.abs(x))), F.lit(0))
    clipped = F.size(F.filter("samples", lambda x: F.abs(x) >= clip_peak))
    internal = F.coalesce(
        F.array_max(F.transform("runs", lambda r: F.floor((r["b"] - r["a"]) * 1000 / F.col("sample_rate")))), F.lit(0)
    ).cast("long")
    w = w.withColumn("duration_ms", duration).withColumn("peak", peak).withColumn("clipped", clipped)
    w = w.withColumn("max_internal_silence_ms", internal)
    for edge in ("leading", "trailing"):
        name = f"{edge}_silence_ms"
        w = w.withColumn(name, F.when(n == 0, F.col("duration_ms")).otherwise(F.col(name)))
    flags = F.array(
        F.when(F.col("rms") < min_rms, F.lit("tts_audio_near_silent")),
        F.when((n > 0) & (F.col("leading_silence_ms") > max_edge_ms), F.lit("tts_audio_leading_silence")),
        F.when((n > 0) & (F.col("trailing_silence_ms") > max_edge_ms), F.lit("tts_audio_trailing_silence")),
        F.when(F.col("max_internal_silence_ms") > max_internal_ms, F.lit("tts_audio_internal_silence")),
        F.when((F.col("peak") >= clip_peak) & (F.col("clipped") / n > max_clipped_ratio), F.lit("tts_audio_clipping")),
    )
    warnings = F.filter(flags, lambda x: x.isNotNull())
    return w.select(
        "clip_id", "duration_ms", F.col("peak").cast("long").alias("peak"), F.floor(F.col("rms") * 100 + 0.5).cast("long").alias("rms_e2"),
        F.coalesce(F.floor(F.col("clipped") * 1_000_000 / F.nullif(n, F.lit(0))), F.lit(0)).cast("long").alias("clipped_e6"),
        "leading_silence_ms", "trailing_silence_ms", "max_internal_silence_ms",
        warnings.alias("warnings"), (F.size(warnings) == 0).alias("ok"),
    )


def trim_edges(clips: DataFrame, *, silence_threshold: int = 120, retained_ms: int = 200) -> DataFrame:
    """Edge silence beyond the retained length cut off; ``changed`` is false where nothing applies."""
    e = edge_silence(with_windows(clips, silence_threshold=silence_threshold))
    keep = F.floor(F.col("sample_rate") * retained_ms / 1000)

    def cut(col: str) -> Column:
        return F.greatest(F.lit(0), F.floor(F.col("sample_rate") * F.col(col) / 1000) - keep).cast("int")

    a, b = cut("leading_silence_ms"), cut("trailing_silence_ms")
    start = F.least(a, "frames")
    stop = F.greatest(start, F.col("frames") - b)
    part = F.slice("samples", start * F.col("channels") + 1, (stop - start) * F.col("channels"))
    changed = ((a > 0) | (b > 0)) & (F.size(part) > 0)
    return e.select(
        "clip_id", "sample_rate", "channels", F.when(changed, part).otherwise(F.col("samples")).alias("samples"), changed.alias("changed")
    )


def compact_silence(
    clips: DataFrame, *, silence_threshold: int = 120, max_internal_ms: int = 2500, retained_ms: int = 500
) -> DataFrame:
    """Internal silence over the maximum shrunk to the retained length, half kept at each side."""
    w = with_internal_runs(with_windows(clips, silence_threshold=silence_threshold))
    keep = F.greatest(F.lit(0), F.floor(F.col("sample_rate") * retained_ms / 1000)).cast("int")
    over = F.filter("runs", lambda r: (r["b"] - r["a"]) * 1000 / F.col("sample_rate") > max_internal_ms)

    def gone(r: Column) -> Column:
        k = F.least(r["b"] - r["a"], keep)
        half = F.floor(k / 2).cast("int")
        return F.struct(((r["a"] + half) * F.col("channels")).alias("a"), ((r["b"] - (k - half)) * F.col("channels")).alias("b"))

    w = pin(w, cuts=F.transform(over, gone))
    kept = F.filter("samples", lambda x, i: ~F.exists("cuts", lambda c: (i >= c["a"]) & (i < c["b"])))
    changed = F.size("cuts") > 0
    return w.select(
        "clip_id", "sample_rate", "channels", F.when(changed, kept).otherwise(F.col("samples")).alias("samples"), changed.alias("changed")
    )
