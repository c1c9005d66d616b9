"""Translations: attaching answers, warnings, compression, repeated prefixes, context blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions import text as tx
from voxloom.operators import glossary as gl
from voxloom.operators import transcript as tr
from voxloom.plans import sequences as seq
from voxloom.session import cut

JOB = ["job_id"]
SEG = ["job_id", "segment_id"]


def attach_translations(segments: DataFrame, responses: DataFrame) -> DataFrame:
    """Left join; of several answers for one id the last (``arrival``) wins; absent gives ''."""
    last = responses.groupBy(*SEG).agg(F.max_by(F.struct("vi_text"), "arrival").alias("r"))
    return segments.join(last, SEG, "left").select(
        *segments.columns, F.coalesce("r.vi_text", F.lit("")).alias("vi_text"), F.col("r").isNotNull().alias("answered")
    )


def missing_targets(targets: DataFrame, responses: DataFrame) -> DataFrame:
    """Required ids without an answer. Answers to ids that were not asked for are not counted."""
    return targets.join(responses.select(*SEG).distinct(), SEG, "left_anti")


def first_k_errors(missing: DataFrame, *, k: int = 5, width: int = seq.ROWS) -> DataFrame:
    """Per recording how many are missing and the first ``k`` ids in order (``ord``)."""
    total = missing.groupBy("job_id").agg(F.count("*").alias("n_missing"))
    head = seq.ranked(missing, JOB, ["ord", "segment_id"], "rn", width=width).where(f"rn <= {k}")
    head = head.groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rn", "segment_id")))["segment_id"], ", ").alias("first_ids"))
    return total.join(head, "job_id")


def id_set_mismatch(source: DataFrame, translated: DataFrame) -> DataFrame:
    """Positions of a recording where the ordered id lists differ (``ord`` 0-based on both sides)."""
    a = source.select("job_id", "ord", F.col("segment_id").alias("source_id"))
    b = translated.select("job_id", "ord", F.col("segment_id").alias("translated_id"))
    return a.join(b, ["job_id", "ord"], "full_outer").where("NOT source_id <=> translated_id")


def length_ratios(pairs: DataFrame) -> DataFrame:
    return pairs.select(*SEG, tx.length_ratio_scaled(F.col("source_text"), F.col("vi_text")).alias("ratio_e4"))


def protected_errors(spans: DataFrame, translations: DataFrame) -> DataFrame:
    """Rows per violated span: a forbidden rendering present, or the spoken form absent.

    ``spans``: canonical, spoken, forbidden[]; ``translations``: display_text, spoken_text.
    """
    p = spans.join(translations.select(*SEG, "display_text", "spoken_text"), SEG)
    name = F.trim("canonical")
    bad = p.select(*SEG, name.alias("c"), "display_text", F.explode("forbidden").alias("f")).where(
        "trim(f) <> '' AND contains(lower(display_text), lower(f))"
    )
    bad = bad.select(*SEG, F.concat(F.lit("protected span "), "c", F.lit(" was translated as forbidden term "), F.lower("f")).alias("error"))
    want = F.lower(F.trim("spoken"))
    absent = p.where((want != "") & ~F.contains(F.lower("spoken_text"), want)).select(
        *SEG, F.concat(F.lit("protected span "), name, F.lit(" must be represented as "), want).alias("error")
    )
    return bad.unionByName(absent)


def span_texts(spans: DataFrame, translations: DataFrame) -> DataFrame:
    """Translations as (display_text, spoken_text): the spoken one has the notation of the segment's own spans, then the fixed one, spelled out.

    A translation without spans is not looked at. ``translations``: job_id, segment_id, vi_text; null counts as empty.
    """
    # one segment's spans, bounded by its text
    own = spans.groupBy(*SEG).agg(F.collect_set(F.struct("canonical", "spoken", "display")).alias("own"))
    t = translations.select(*SEG, F.coalesce("vi_text", F.lit("")).alias("display_text")).join(own, SEG)
    return t.select(*SEG, "display_text", tx.normalize_spoken(F.col("display_text"), F.array_sort("own")).alias("spoken_text"))


def span_errors(segments: DataFrame, translations: DataFrame, *, rule_table: DataFrame | None = None) -> DataFrame:
    """Violated notation of whole segments: spans found in the source text, checked against the spelled-out translation."""
    spans = cut(tr.protected_spans(segments, rule_table=rule_table))
    return protected_errors(spans, span_texts(spans, translations))


def spoken_text_errors(spans: DataFrame, translations: DataFrame) -> DataFrame:
    """Checks of separate spoken texts: present at all, no forbidden word in either text, span spoken."""
    t = translations.where("trim(display_text) <> ''")
    none = t.where("trim(spoken_text) = ''").select(
        *SEG, F.lit("spoken_text is required when display_text is not empty").alias("error")
    )
    p = spans.join(t.select(*SEG, "display_text", "spoken_text"), SEG)
    f = p.select(*SEG, F.trim("canonical").alias("c"), "display_text", "spoken_text", F.explode("forbidden").alias("f")).where("trim(f) <> ''")
    sides = F.array(
        *[F.struct(F.lit(n).alias("side"), F.lower(n).alias("txt")) for n in ("display_text", "spoken_text")]
    )
    f = f.select(*SEG, "c", F.lower("f").alias("f"), F.inline(sides)).where("contains(txt, f)")
    f = f.select(
        *SEG,
        F.concat(F.lit("protected span "), "c", F.lit(" was translated as forbidden term "), "f", F.lit(" in "), "side").alias("error"),
    )
    want = F.lower(F.trim("spoken"))
    absent = p.where((want != "") & ~F.contains(F.lower("spoken_text"), want)).select(
        *SEG, F.concat(F.lit("protected span "), F.trim("canonical"), F.lit(" must appear in spoken_text as "), want).alias("error")
    )
    return none.unionByName(f).unionByName(absent)


def translation_warnings(
    segments: DataFrame,
    translations: DataFrame,
    terms: DataFrame,
    span_errors: DataFrame,
    *,
    max_length_ratio: float = 1.15,
    used: DataFrame | None = None,
) -> DataFrame:
    """One row per warning; what would stop a run (an empty translation) becomes an error row."""
    p = segments.select(*SEG, "source_text").join(translations.select(*SEG, "vi_text"), SEG)
    src, vi = F.trim("source_text"), F.trim("vi_text")
    ratio = F.length(vi) / F.greatest(F.lit(1), F.length(src))
    kind = (
        F.when((src == "") & (vi != ""), "empty_source_segment_translated")
        .when((src != "") & (vi == ""), "empty_translation")
        .when((src != "") & (ratio > max_length_ratio), "length_ratio_exceeded")
    )
    own = p.select(*SEG, kind.alias("warning"), F.lit("").alias("detail")).where("warning IS NOT NULL")
    live = p.where("trim(source_text) <> '' AND trim(vi_text) <> ''")
    spans = span_errors.join(live.select(*SEG), SEG, "left_semi").select(
        *SEG, F.lit("translation_protected_span_violation").alias("warning"), F.col("error").alias("detail")
    )
    missing = gl.locked_terms_missing(live, live, terms, used=used).select(
        *SEG, F.lit("locked_glossary_term_missing").alias("warning"), F.col("original").alias("detail")
    )
    return own.unionByName(spans).unionByName(missing)


def compress_translations(pairs: DataFrame, terms: DataFrame, *, max_length_ratio: float = 1.15, used: DataFrame | None = None) -> DataFrame:
    """Drop filler phrases where a translation is too long or lacks a locked term; never truncate."""
    p = pairs.select(*SEG, F.trim("source_text").alias("source_text"), F.trim("vi_text").alias("vi_text"))
    p = p.withColumn("short_text", tx.compress_fillers(F.col("vi_text")))
    locked = terms.where("locked AND trim(original) <> '' AND trim(vietnamese) <> ''").select("term_id", "original", "vietnamese")
    need = gl.applicable_terms(p, locked, used=used).select(*SEG, F.lower(F.trim("vietnamese")).alias("r"))
    lack = need.join(p.select(*SEG, "vi_text", "short_text"), SEG).groupBy(*SEG).agg(
        F.bool_or(~F.contains(F.lower("vi_text"), F.col("r"))).alias("before"),
        F.bool_or(~F.contains(F.lower("short_text"), F.col("r"))).alias("after"),
    )
    p = p.join(lack, SEG, "left").fillna(False, ["before", "after"])
    limit = F.greatest(F.lit(1), (F.greatest(F.lit(1), F.length("source_text")) * F.lit(max_length_ratio)).cast("int"))
    fine = (F.length("vi_text") <= limit) & ~F.col("before")
    flags = F.array(
        F.when(F.col("short_text") != F.col("vi_text"), F.lit("compressed_for_length")),
        F.when(F.length("short_text") > limit, F.lit("length_compression_required")),
        F.when(F.col("after"), F.lit("locked_glossary_missing")),
    )
    none = F.array().cast("array<string>")
    return p.select(
        *SEG,
        F.when(fine, F.col("vi_text")).otherwise(F.col("short_text")).alias("vi_text"),
        F.when(fine, none).otherwise(F.filter(flags, lambda x: x.isNotNull())).alias("warnings"),
    )


# --- repeated prefixes -----------------------------------------------------------------------

_BOUNDARY = rf"({tx.WORD}+)"


def _shared_prefix(prev: list[str], cur: list[str]) -> int:
    """Words to drop from ``cur``: the common prefix, if at least five words and ``cur`` is longer."""
    if len(prev) < 5 or len(cur) < 5 or len(cur) <= len(prev):
        return 0
    n = 0
    while n < len(prev) and prev[n] == cur[n]:
        n += 1
    return n if n >= 5 else 0


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _dropped(chains: pa.Array) -> pa.Array:
    """Per chain of cues (lists of words) the words each cue loses to the one before, itself trimmed; many chains a batch."""
    out = []
    for chain in chains.to_pylist():
        prev, drop = [], []
        for w in chain:
            drop.append(_shared_prefix(prev, w))
            prev = w[drop[-1] :]
        out.append(drop)
    return pa.array(out, pa.list_(pa.int32()))


def trim_boundary_repeats(cues: DataFrame, *, width: int = seq.HOUR_MS) -> DataFrame:
    """Cues that repeat at least five leading words of the (already trimmed) previous cue lose them.

    Whether a cue is trimmed depends on its predecessor's trimming only if its first five words occur
    in the predecessor at the start or after a possible cut. Chains of such cues are folded; all
    other cues are certain.
    """
    order = ["start_ms", "end_ms", "cue_id"]
    c = cues.select("job_id", *order, F.trim("display_text").alias("t"))
    c = c.withColumn("w", F.regexp_extract_all(F.lower("t"), F.lit(_BOUNDARY), F.lit(1)))
    c = cut(seq.neighbours(c, JOB, order, ["w", "t"], prev="p", width=width))
    c = seq.pin(c, head=F.array_join(F.slice("w", 1, 5), " "), n=F.size("w"), m=F.size("p.w"), pw=F.col("p.w"))
    head, n, m = F.col("head"), F.col("n"), F.col("m")
    spots = F.filter(
        F.sequence(F.lit(0), F.greatest(m - 5, F.lit(0))),
        lambda k: (F.array_join(F.slice(F.col("pw"), k + 1, 5), " ") == head) & (n > m - k) & ((k == 0) | (k >= 5)),
    )
    linked = (n >= 5) & (m >= 5) & (F.size(spots) > 0)
    c = c.withColumn("linked", F.coalesce(linked, F.lit(False)))
    c = seq.islands(c, JOB, order, ["linked"], lambda p, x: ~x["linked"], "chain", width=width)
    c = cut(c.select("job_id", *order, "t", "w", "linked", "chain"))
    busy = c.where("linked").select("job_id", "chain").distinct()
    chains = c.join(busy, ["job_id", "chain"], "left_semi").groupBy("job_id", "chain").agg(F.array_sort(F.collect_list(F.struct(*order, "w"))).alias("e"))
    chained = chains.select("job_id", F.inline(F.arrays_zip(F.col("e.cue_id").alias("cue_id"), _dropped(F.col("e.w")).alias("drop_words"))))
    r = c.join(chained, ["job_id", "cue_id"], "left").withColumn("drop_words", F.coalesce("drop_words", F.lit(0)))
    # cut the text behind the n-th word, then leading blanks and marks
    pattern = F.concat(
        F.lit(f"^(?:[^\\p{{L}}\\p{{N}}_]*{tx.WORD}+){{"), F.col("drop_words").cast("string"), F.lit("}"),
    )
    rest = F.regexp_replace(F.regexp_replace("t", pattern, F.lit("")), r"^[ \t\r\n,;:!?—–-]+", "")
    trimmed = F.col("drop_words") > 0
    return r.select(
        "job_id", "cue_id", F.when(trimmed, rest).otherwise(F.col("t")).alias("display_text"), trimmed.alias("trimmed")
    )


# --- blocks ----------------------------------------------------------------------------------


def overlap_blocks(segments: DataFrame, *, block_size: int, overlap: int, order: list[str], width: int = seq.HOUR_MS) -> DataFrame:
    """Fixed blocks with overlap: (job, block_no, place, segment_id); stops when a block reaches the end."""
    if block_size < 1 or overlap < 0 or overlap >= block_size:
        raise ValueError("need block_size >= 1 and 0 <= overlap < block_size")
    step = block_size - overlap
    s = seq.ranked(segments, JOB, order, "rn", width=width).withColumn("pos", F.col("rn") - 1)
    n = s.groupBy("job_id").agg(F.max("rn").alias("n"))
    s = s.join(n, "job_id")
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - block_size) / step)).cast("long")
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - block_size + 1) / step)).cast("long")
    high = F.least(F.floor(F.col("pos") / step), last)
    s = s.withColumn("block_no", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    return s.select("job_id", "block_no", (F.col("pos") - F.col("block_no") * step).alias("place"), "segment_id")


def context_blocks(
    segments: DataFrame,
    *,
    order: list[str],
    min_words: int = 120,
    max_words: int = 350,
    context_words: int = 40,
    max_segments: int = 6,
    width: int = seq.HOUR_MS,
) -> DataFrame:
    """Greedy blocks by word count with context before and after, as position ranges per block.

    A block takes segments until it has ``min_words`` or ``max_segments``, never passing ``max_words``
    unless with its first. Context reaches out until it holds ``context_words``.
    """
    s = segments.withColumn("wc", tx.word_count("source_text"))
    s = seq.running(s, JOB, order, {"cum": ("sum", "wc"), "rn": ("count", F.lit(1))}, width=width)
    s = cut(s.select("job_id", "segment_id", (F.col("rn") - 1).alias("pos"), "wc", "cum"))
    ahead = seq.following(s.select("job_id", "pos", "wc"), JOB, "pos", "wc", max_segments, "a")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("words"), F.lit(False).alias("stop"))

    def take(acc: Column, x: Column) -> Column:
        stop = (
            acc["stop"] | (acc["n"] >= max_segments) | (acc["words"] >= min_words)
            | ((acc["n"] > 0) & (acc["words"] + x > max_words))
        )
        return F.when(stop, acc.withField("stop", F.lit(True))).otherwise(
            F.struct((acc["n"] + 1).alias("n"), (acc["words"] + x).alias("words"), F.lit(False).alias("stop"))
        )

    # words >= min is checked before the next segment; an empty block takes its first in any case
    first = F.get("a", F.lit(0))
    seed = zero.withField("n", F.lit(1).cast("long")).withField("words", first)
    taken = F.aggregate(F.slice("a", 2, max_segments), seed, take)
    size = s.groupBy("job_id").agg(F.max("pos").alias("last"))
    edges = ahead.select("job_id", "pos", (F.col("pos") + taken["n"]).alias("nxt"))
    edges = cut(edges.join(size, "job_id"))
    starts = cut(seq.chase(edges.select("job_id", "pos", F.when(F.col("nxt") <= F.col("last"), F.col("nxt")).alias("nxt")), JOB))
    b = starts.join(edges, ["job_id", "pos"]).withColumn("stop", F.col("nxt") - 1)
    base = s.select("job_id", "pos", (F.col("cum") - F.col("wc")).alias("before_words"))
    endw = s.select("job_id", F.col("pos").alias("stop"), F.col("cum").alias("upto_words"))
    b = cut(b.join(base, ["job_id", "pos"]).join(endw, ["job_id", "stop"]))
    marks = s.select("job_id", "pos", F.col("cum").alias("level"))
    lo = seq.first_beyond(
        b.select("job_id", "pos", (F.col("before_words") - context_words).alias("threshold")), marks, JOB, "lo", width=seq.ROWS
    )
    hi = seq.first_beyond(
        b.select("job_id", "pos", (F.col("upto_words") + context_words - 1).alias("threshold")), marks, JOB, "hi", width=seq.ROWS
    )
    b = b.join(lo, ["job_id", "pos"]).join(hi, ["job_id", "pos"])
    b = seq.ranked(b, JOB, ["pos"], "block_no", width=seq.ROWS)
    wanted = F.lit(context_words > 0)
    return b.select(
        "job_id", "block_no", F.col("pos").alias("first_pos"), F.col("stop").alias("last_pos"),
        F.when(wanted, F.least("lo", "pos")).otherwise(F.col("pos")).alias("context_from"),
        F.when(wanted, F.coalesce("hi", "last")).otherwise(F.col("stop")).alias("context_to"),
        (F.col("upto_words") - F.col("before_words")).alias("words"),
    )


def segment_from_cues(segments: DataFrame, cues: DataFrame) -> DataFrame:
    """Segment texts rebuilt from cues: each cue goes to its first owning segment; a segment left with
    none repeats the cues it shares. ``segments`` has ``ord``; cues have parent_segment_ids[]."""
    link = cues.select("job_id", "cue_id", "start_ms", "display_text", F.explode("parent_segment_ids").alias("segment_id"))
    link = link.join(segments.select(*SEG, "ord"), SEG)
    own = link.groupBy("job_id", "cue_id").agg(F.min("ord").alias("owner"))
    link = link.join(own, ["job_id", "cue_id"]).withColumn("mine", F.col("ord") == F.col("owner"))
    has = link.groupBy(*SEG).agg(F.bool_or("mine").alias("any_mine"))
    used = link.join(has, SEG).where("mine OR NOT any_mine")
    txt = used.groupBy(*SEG).agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "cue_id", "display_text"))), lambda x: F.trim(x["display_text"])), " ")).alias("display_text"),
        F.count("*").alias("n_cues"),
    )
    return segments.select(*SEG).join(txt, SEG, "left").select(
        *SEG, F.coalesce("display_text", F.lit("")).alias("display_text"), F.coalesce("n_cues", F.lit(0).cast("long")).alias("n_cues")
    )


def cue_parent_enrich(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """Edits and suggestions a cue inherits from its parents (if they concern its text), least
    confidence, and flags in first-seen order. Unknown parent ids are dropped."""
    link = cues.select(
        "job_id", "cue_id", F.lower("source_text_raw").alias("rawt"), F.lower("source_text").alias("txt"),
        F.posexplode("parent_segment_ids").alias("k", "segment_id"),
    )
    cols = ["normalization_edits", "normalization_suggestions", "normalization_confidence", "risk_flags"]
    p = link.join(segments.select(*SEG, *[F.col(c).alias(f"s_{c}") for c in cols]), SEG)

    def applies(x: Column) -> Column:
        o, n = F.lower(F.trim(x["original"])), F.lower(F.trim(x["normalized"]))
        return ((o == "") & (n == "")) | ((o != "") & F.contains(F.col("rawt"), o)) | ((n != "") & F.contains(F.col("txt"), n))

    for c in cols[:2]:
        p = p.withColumn(f"s_{c}", F.filter(f"s_{c}", applies))
    # a cue has only the parents its own words came from
    g = p.groupBy("job_id", "cue_id").agg(
        F.array_sort(F.collect_list(F.struct("k", *[f"s_{c}" for c in cols]))).alias("ps")
    )
    c = cues.join(g, ["job_id", "cue_id"], "left")

    def all_of(col: str) -> Column:
        return F.coalesce(F.flatten(F.col(f"ps.s_{col}")), F.array())

    return c.select(
        "job_id", "cue_id",
        all_of(cols[0]).alias(cols[0]),
        all_of(cols[1]).alias(cols[1]),
        F.coalesce(F.array_min(F.col(f"ps.s_{cols[2]}")), F.lit(1.0)).alias(cols[2]),
        F.array_distinct(F.concat("risk_flags", F.coalesce(F.flatten("ps.s_risk_flags"), F.array().cast("array<string>")))).alias("risk_flags"),
    )
