"""Spoken clauses, merged fragments and subtitle lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import rules
from voxloom.functions import text as tx
from voxloom.plans import sequences as seq
from voxloom.session import cut

JOB = ["job_id"]
SEG = ["job_id", "segment_id"]
WORDS = ["start_ms", "end_ms", "pos"]


def pause_clauses(words: DataFrame, translations: DataFrame, *, min_pause_ms: int = 700, width: int = seq.HOUR_MS) -> DataFrame:
    """Word groups between pauses paired with translated sentences, where their counts agree.

    Other segments give one clause with the whole text.
    """
    w = seq.islands(
        words, SEG, WORDS, ["start_ms", "end_ms"], lambda p, c: c["start_ms"] - p["end_ms"] >= min_pause_ms, "grp", width=width
    )
    # a group is a part of one segment cell
    g = cut(
        w.groupBy(*SEG, "grp").agg(
            F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct(*WORDS)).alias("end_ms"),
            F.array_sort(F.collect_list(F.struct(*WORDS, "text"))).alias("w"),
        ).withColumn("source_text", F.array_join("w.text", " ")).drop("w")
    )
    whole = words.groupBy(*SEG).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.array_join(F.array_sort(F.collect_list(F.struct(*WORDS, "text")))["text"], " ").alias("source_text"),
    )
    n = g.groupBy(*SEG).agg(F.count("*").alias("n"))
    t = translations.select(*SEG, "vi_text", tx.split_sentences(F.col("vi_text")).alias("parts")).join(n, SEG)
    t = t.withColumn("split", (F.col("n") > 1) & (F.size("parts") == F.col("n")))
    split = g.join(t.where("split"), SEG).select(
        *SEG, F.concat("segment_id", F.lit("__clause_"), F.format_string("%03d", F.col("grp") + 1)).alias("clause_id"),
        "start_ms", "end_ms", "source_text", F.get("parts", F.col("grp").cast("int")).alias("translated_text"),
    )
    single = whole.join(t.where("NOT split"), SEG).select(
        *SEG, F.col("segment_id").alias("clause_id"), "start_ms", "end_ms", "source_text", F.col("vi_text").alias("translated_text")
    )
    return split.unionByName(single)


def merge_short_fragments(
    segments: DataFrame, *, min_segment_ms: int = 1_500, max_gap_ms: int = 700, width: int = seq.HOUR_MS
) -> DataFrame:
    """Fragments below the minimum absorb the next ones until a sentence ends or a pause intervenes.

    ``segments`` (job_id, segment_id, start_ms, end_ms, source_text, vi_text) -> one row per work item.
    """
    order = ["start_ms", "end_ms", "segment_id"]
    s = segments.withColumn("ends", tx.ends_with_any(F.rtrim("source_text"), rules.SEGMENT_ENDINGS))

    def apart(p: Column, c: Column) -> Column:
        return p["ends"] | ~(c["start_ms"] - p["end_ms"]).between(0, max_gap_ms)

    s = seq.islands(s, JOB, order, ["start_ms", "end_ms", "ends"], apart, "isl", width=width)
    key = ["job_id", "isl"]
    s = cut(seq.ranked(s, key, order, "rn", width=width).withColumn("pos", F.col("rn") - 1).drop("rn"))
    marks = s.select(*key, "pos", F.col("end_ms").alias("level"))
    probes = s.select(*key, "pos", (F.col("start_ms") + min_segment_ms - 1).alias("threshold"))
    last = s.groupBy(*key).agg(F.max("pos").alias("last"))
    e = seq.first_beyond(probes, marks, key, "stop", width=width).join(last, key)
    e = e.select(*key, "pos", F.when(F.col("stop") < F.col("last"), F.col("stop") + 1).alias("nxt"))
    g = seq.spans_from_starts(s, seq.chase(e, key), key, "grp")
    # a work item is a run of fragments below the minimum length and one more
    m = g.groupBy(*key, "grp").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", "pos").alias("end_ms"),
        F.array_sort(F.collect_list(F.struct("pos", "segment_id", "source_text", "vi_text"))).alias("m"),
    )
    parts = F.filter(F.transform("m.vi_text", lambda x: F.trim(x)), lambda x: x != "")
    return m.select(
        "job_id", F.array_join("m.segment_id", "__merged__").alias("segment_id"), "start_ms", "end_ms",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.trim(F.array_join("m.source_text", " ")).alias("source_text"),
        F.array_join(parts, " ").alias("translated_text"), F.size("m").cast("long").alias("members"),
    )


def subtitle_split(
    segments: DataFrame, words: DataFrame, *, max_cue_ms: int = 4_000, min_cue_ms: int = 700, width: int = seq.HOUR_MS
) -> DataFrame:
    """Segments longer than a cue cut at word ends; a piece is cut once the next word would pass the
    maximum and the piece has the minimum length. Translations are shared out over the pieces.

    ``segments`` carries start_ms, end_ms, source_text, display_text.
    """
    s = segments.withColumn("end_ms", F.greatest(F.col("start_ms") + min_cue_ms, "end_ms"))
    w = words.where("trim(text) <> '' AND end_ms > start_ms")
    sized = s.join(w.select(*SEG).distinct().withColumn("has", F.lit(True)), SEG, "left")
    cuttable = F.coalesce("has", F.lit(False)) & (F.col("end_ms") - F.col("start_ms") > max_cue_ms)
    sized = cut(sized.withColumn("cut", cuttable).drop("has"))
    whole = sized.where("NOT cut AND (trim(source_text) <> '' OR trim(display_text) <> '')").select(
        *SEG, F.lit(1).cast("long").alias("part"), "start_ms", "end_ms", "source_text", F.col("display_text").alias("translation_text")
    )
    long = sized.where("cut")
    w = cut(seq.ranked(w.join(long.select(*SEG), SEG, "left_semi"), SEG, WORDS, "rn", width=width))
    at = (F.col("rn") - 1).alias("pos")
    marks = w.select(*SEG, at, F.col("end_ms").alias("level"))

    def probe(ms: int) -> DataFrame:
        return w.select(*SEG, at, (F.col("start_ms") + ms).alias("threshold"))

    over = seq.first_beyond(probe(max_cue_ms), marks, SEG, "over", width=width)
    enough = seq.first_beyond(probe(min_cue_ms - 1), marks, SEG, "enough", width=width)
    last = w.groupBy(*SEG).agg((F.max("rn") - 1).alias("last"))
    e = over.join(enough, [*SEG, "pos"]).join(last, SEG)
    nxt = F.when(F.col("over").isNotNull() & F.col("enough").isNotNull(), F.greatest("over", F.col("enough") + 1, F.col("pos") + 1))
    e = e.select(*SEG, "pos", F.when(nxt <= F.col("last"), nxt).alias("nxt"))
    g = seq.spans_from_starts(w.drop("pos").withColumn("pos", F.col("rn") - 1), seq.chase(e, SEG), SEG, "grp")
    g = g.groupBy(*SEG, "grp").agg(
        F.min("start_ms").alias("ws"), F.max_by("end_ms", "pos").alias("we"), F.count("*").alias("nw"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.trim(x["text"])), " ").alias("gtext"),
    )
    # pieces of one segment cell
    p = g.groupBy(*SEG).agg(F.array_sort(F.collect_list(F.struct("grp", "ws", "we", "nw", "gtext"))).alias("g")).join(long, SEG)
    p = distribute_words(p.withColumn("sizes", F.col("g.nw")), "display_text", "sizes", "shares")
    p = p.select(*SEG, "end_ms", "shares", F.posexplode("g").alias("k", "x"))
    return whole.unionByName(
        p.select(
            *SEG, (F.col("k") + 1).cast("long").alias("part"), F.col("x.ws").alias("start_ms"),
            F.least("end_ms", F.greatest(F.col("x.ws") + min_cue_ms, "x.we")).alias("end_ms"),
            F.col("x.gtext").alias("source_text"), F.coalesce(F.get("shares", "k"), F.lit("")).alias("translation_text"),
        )
    )


def distribute_words(rows: DataFrame, text: str, sizes: str, name: str) -> DataFrame:
    """Add ``name``: text shared out over groups, sentence by sentence if the counts agree, else by size.

    Every group but the last gets at least one word and leaves one for each group after it.
    """
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    rows = seq.pin(
        rows, _toks=tx.tokens(text), _total=F.greatest(F.lit(1), total), _n=F.size(sizes),
        _parts=tx.split_sentences(F.col(text), cjk=True),
    )
    toks, n = F.col("_toks"), F.col("_n")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, size: Column) -> Column:
        k, at = F.size(acc["out"]), acc["at"]
        share = F.greatest(F.lit(1), F.rint(F.size(toks) * (size / F.col("_total"))).cast("int"))
        take = F.least(share, F.greatest(F.lit(1), F.size(toks) - at - (n - k - 1)))
        take = F.when(k == n - 1, F.greatest(F.lit(0), F.size(toks) - at)).otherwise(take)
        piece = F.when(at < F.size(toks), F.array_join(F.slice(toks, at + 1, take), " ")).otherwise("")
        return F.struct((at + take).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    shared = F.aggregate(sizes, start, step, lambda acc: acc["out"])
    rows = rows.withColumn(
        name,
        F.when(F.trim(text) == "", F.array_repeat(F.lit(""), n))
        .when(F.size("_parts") == n, F.col("_parts"))
        .when(n == 1, F.array(F.trim(text)))
        .otherwise(shared),
    )
    return rows.drop("_toks", "_total", "_n", "_parts")


def subtitle_time(ms: Column) -> Column:
    """h:mm:ss.cc"""
    cs = F.floor(F.greatest(F.lit(0).cast("long"), ms) / 10)
    return F.format_string(
        "%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100
    )


def subtitle_alpha(opacity: float) -> str:
    """Opacity as the style's alpha byte on black."""
    return f"&H{int(round((1.0 - min(1.0, max(0.0, opacity))) * 255)):02X}000000"


def subtitle_lines(
    cues: DataFrame,
    *,
    max_chars: int = 48,
    video_width: int = 1920,
    video_height: int = 1080,
    bottom_margin: float = 0.035,
    width: int = seq.HOUR_MS,
) -> DataFrame:
    """One script line per cue, numbered per recording: (job_id, line_no, line).

    Kept as rows, so a recording of any length is written from many tasks; write sorted by line_no.
    """
    margin = max(4, int(video_height * bottom_margin))
    src = F.when(F.trim("source_text") != "", tx.wrap_text(F.col("source_text"), max_chars)).otherwise(F.array().cast("array<string>"))
    tra = F.when(F.trim("translation_text") != "", tx.wrap_text(F.col("translation_text"), max_chars)).otherwise(F.array().cast("array<string>"))
    c = cues.withColumn("ls", F.concat(src, tra)).where(F.size("ls") > 0)
    c = seq.ranked(c, JOB, ["start_ms", "end_ms", "segment_id", "part"], "line_no", width=width)
    body = F.array_join(F.transform("ls", tx.subtitle_escape), "\\N")
    head = f",Bilingual,,0,0,0,,{{\\an2\\q2\\pos({video_width // 2},{video_height - margin})\\pbo0}}"
    line = F.concat(
        F.lit("Dialogue: 0,"), subtitle_time(F.col("start_ms")), F.lit(","), subtitle_time(F.col("end_ms")), F.lit(head), body
    )
    return c.select("job_id", "line_no", line.alias("line"))


def script_header(
    *,
    video_width: int = 1920,
    video_height: int = 1080,
    font: str = "Arial",
    font_ratio: float = 0.026,
    bottom_margin: float = 0.035,
    opacity: float = 0.5,
) -> list[str]:
    """The fixed lines before a recording's first cue."""
    size = max(10, int(video_height * font_ratio))
    margin = max(4, int(video_height * bottom_margin))
    style = (
        f"Style: Bilingual,{font},{size},&H00FFFFFF,&H00FFFFFF,&H80000000,{subtitle_alpha(opacity)},0,0,0,0,100,100,0,0,3,"
        f"{max(1, int(size * 0.10))},{max(0, int(size * 0.08))},2,24,24,{margin},1"
    )
    return [
        "[Script Info]", "ScriptType: v4.00+", f"PlayResX: {video_width}", f"PlayResY: {video_height}",
        "ScaledBorderAndShadow: yes", "WrapStyle: 0", "", "[V4+ Styles]",
        "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, "
        "Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding",
        style, "", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text",
    ]
