"""Transcript segments, word timeline, notation repair and repeated passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import rules
from voxloom.functions import text as tx
from voxloom.plans import sequences as seq
from voxloom.session import cut

ORDER = ["start_ms", "end_ms", "pos"]
JOB = ["job_id"]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_timeline(words: DataFrame, *, width: int = seq.HOUR_MS) -> DataFrame:
    return seq.ranked(words, JOB, ["start_ms", "end_ms", "segment_id", "pos"], "word_rank", width=width)


def transcript_segments(
    words: DataFrame,
    *,
    chunk: str = "chunk_id",
    target_min_ms: int = 8_000,
    max_ms: int = 45_000,
    min_pause_ms: int = 600,
    punctuation: bool = True,
    width: int = seq.HOUR_MS,
) -> DataFrame:
    """Words of each chunk cut into segments; adds nothing to words, returns one row per segment.

    From any first word the segment ends at the first word that reaches the maximum length, or that
    reaches the target length and ends a sentence or precedes a pause; the last word always ends one.
    """
    key = ["job_id", chunk]
    w = seq.neighbours(words, key, ORDER, ["start_ms"], nxt="_n", width=width)
    w = cut(seq.ranked(w, key, ORDER, "rn", width=width))
    pause = F.greatest(F.lit(0).cast("long"), F.col("_n.start_ms") - F.col("end_ms"))
    mark = tx.ends_with_any(F.rtrim("text"), rules.SEGMENT_ENDINGS) if punctuation else F.lit(False)
    pos = (F.col("rn") - 1).alias("pos")
    level = w.select(*key, pos, F.col("end_ms").alias("level"))
    stops = w.where(mark | (pause >= min_pause_ms)).select(*key, pos, F.col("end_ms").alias("level"))

    def probe(ms: int) -> DataFrame:
        return w.select(*key, pos, (F.col("start_ms") + ms - 1).alias("threshold"))

    by_max = seq.first_beyond(probe(max_ms), level, key, "a", width=width)
    by_stop = seq.first_beyond(probe(target_min_ms), stops, key, "b", width=width)
    last = w.groupBy(*key).agg((F.max("rn") - 1).alias("last"))
    edges = by_max.join(by_stop, [*key, "pos"]).join(last, key)
    stop = F.least("a", "b", "last")
    edges = edges.select(*key, "pos", F.when(stop < F.col("last"), stop + 1).alias("nxt"))
    starts = seq.chase(edges, key)
    rows = seq.spans_from_starts(w.drop("pos", "_n").withColumn("pos", F.col("rn") - 1), starts, key, "piece")
    seg = rows.groupBy(*key, "piece").agg(
        F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", "pos").alias("end_ms"),
        # a segment is at most the maximum length plus one word
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: F.trim(x["text"])), " ").alias(
            "source_text"
        ),
        F.count("*").alias("n_words"),
    )
    seg = seq.ranked(seg, JOB, ["start_ms", "end_ms", chunk, "piece"], "n", width=width)
    return seg.select(
        "job_id", chunk, F.format_string("seg_%06d", "n").alias("segment_id"), "start_ms", "end_ms",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), "source_text", "n_words",
    )


def context_window_text(segments: DataFrame, *, radius: int = 1, text: str = "source_text") -> DataFrame:
    """Text of each segment with its neighbours up to ``radius`` away, in order."""
    r = seq.ranked(segments, JOB, ["start_ms", "end_ms", "segment_id"], "rn")
    spread = r.select(
        "job_id", F.col("rn").alias("src"), text, F.explode(F.array(*[F.lit(d) for d in range(-radius, radius + 1)])).alias("d")
    )
    near = spread.groupBy("job_id", (F.col("src") + F.col("d")).alias("rn")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("src", text)))[text], " ").alias("context_text")
    )
    return r.join(near, ["job_id", "rn"]).drop("rn")


def confusable_rewrite(segments: DataFrame, *, radius: int = 1) -> DataFrame:
    """Rewrite 'doctor' to 'dr' where the surrounding text speaks of calculus, with the edits made."""
    s = context_window_text(segments, radius=radius)
    low = F.lower("context_text")
    domain = F.lit(False)
    for term in rules.CONTEXT_TERMS:
        domain = domain | F.contains(low, F.lit(term))
    pattern = f"(?i){rules.CONFUSABLE}"
    empty = F.array().cast("array<struct<m:string,start:int,end:int>>")
    s = s.withColumn("edits", F.when(domain, tx.match_spans(F.col("source_text"), pattern)).otherwise(empty))
    changed = F.size("edits") > 0
    s = s.withColumn("source_text_raw", F.col("source_text")).withColumn(
        "source_text", F.when(changed, F.regexp_replace("source_text", pattern, "dr")).otherwise(F.col("source_text"))
    )
    flag = F.array(F.lit("source_normalized_calculus_notation"))
    return s.withColumn("normalization_confidence", F.when(changed, 0.92).otherwise(1.0)).withColumn(
        "risk_flags", F.when(changed, F.array_union("risk_flags", flag)).otherwise(F.col("risk_flags"))
    ).drop("context_text")


def rewrite_words(words: Column) -> Column:
    """The same rewrite on an array of word structs (text, raw_text, start_ms, end_ms)."""
    return F.transform(
        words,
        lambda w: w.withField("raw_text", F.coalesce(w["raw_text"], w["text"])).withField(
            "text", F.regexp_replace(w["text"], f"(?i){rules.CONFUSABLE}", "dr")
        ),
    )


def normalization_candidates(segments: DataFrame) -> DataFrame:
    """Occurrences of the confusable word that no edit at the same offset covers, numbered per segment."""
    s = segments.select(
        "job_id", "segment_id", "source_text_raw", "edits",
        F.posexplode(tx.match_spans(F.col("source_text_raw"), f"(?i){rules.CONFUSABLE}")).alias("n", "hit"),
    )
    s = s.where(~F.exists("edits", lambda e: e["start"] == F.col("hit.start")))
    return s.select(
        "job_id", "segment_id",
        F.concat_ws(":", "segment_id", F.lit("doctor"), (F.col("n") + 1).cast("string")).alias("candidate_id"),
        F.col("hit.m").alias("original"), F.col("hit.start").alias("start_char"), F.col("hit.end").alias("end_char"),
        F.lit("dr").alias("suggested_normalized"),
    )


def protected_spans(segments: DataFrame, *, text: str = "source_text", rule_table: DataFrame | None = None) -> DataFrame:
    """One row per notation span found in the whole text, with its rule's forbidden renderings.

    ``rule_table`` (``tx.RULE_SCHEMA``) names another domain's rules; a null text has no spans.
    """
    s = segments.select("job_id", "segment_id", F.inline(tx.protected_spans(F.col(text), tx.read_rules(rule_table))))
    return s.drop("neg_len", "rule")


def align_raw_tokens(segments: DataFrame) -> DataFrame:
    """Pair words with raw tokens by position where their counts agree, else with themselves."""
    toks = tx.tokens("source_text_raw")
    pairs = F.when(
        F.size(toks) == F.size("words"),
        F.zip_with("words", toks, lambda w, r: F.struct(w.alias("text"), r.alias("raw_text"))),
    ).otherwise(F.transform("words", lambda w: F.struct(w.alias("text"), w.alias("raw_text"))))
    return segments.select("job_id", "segment_id", F.posexplode(pairs).alias("p", "w")).select(
        "job_id", "segment_id", (F.col("p") + 1).cast("long").alias("pos"), "w.text", "w.raw_text"
    )


def units_without_words(segments: DataFrame, *, max_duration_ms: int = 6_000) -> DataFrame:
    """Segments lacking words, cut into ceil(duration/max) proportional parts of time and text."""
    s = segments.withColumn("t", tx.tokens("source_text")).withColumn("d", F.col("end_ms") - F.col("start_ms"))
    s = s.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("d") / max_duration_ms)).cast("long"))
    s = s.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    s = s.withColumn("w0", F.expr("cast((size(t) * part) div parts as int)")).withColumn(
        "w1", F.expr("cast((size(t) * (part + 1)) div parts as int)")
    )
    return s.select(
        "job_id", "segment_id", "part",
        F.expr("start_ms + (d * part) div parts").alias("start_ms"),
        F.expr("start_ms + (d * (part + 1)) div parts").alias("end_ms"),
        F.array_join(F.slice("t", F.col("w0") + 1, F.col("w1") - F.col("w0")), " ").alias("text"),
    )


# --- repeated passages -----------------------------------------------------------------------


def repeat_islands(words: DataFrame, *, min_words: int = 8, width: int = seq.HOUR_MS) -> DataFrame:
    """Words with ``rn`` (rank among words with letters or digits) and ``island`` for repeat candidates.

    Any passage repeated at once consists of ``min_words``-word shingles that occur at least twice in
    the recording. Words not covered by such a shingle can never be removed, so they separate the
    islands, and each island can be rewritten on its own. ``island`` is null outside.
    """
    w = words.withColumn("tok", tx.comparison_token("text"))
    w = cut(seq.running(w, JOB, ORDER, {"rn": ("count", F.nullif(F.col("tok"), F.lit("")))}, width=width))
    content = w.where("tok <> ''").select("job_id", "rn", "tok")
    shingle = seq.following(content, JOB, "rn", "tok", min_words - 1, "s")
    shingle = shingle.where(F.size("s") == min_words).select(
        "job_id", "rn", F.xxhash64(F.array_join("s", " ")).alias("h")
    )
    shingle = cut(shingle)
    often = shingle.groupBy("job_id", "h").agg(F.count("*").alias("n")).where("n > 1").select("job_id", "h")
    begins = shingle.join(often, ["job_id", "h"], "left_semi").select("job_id", "rn", F.col("rn").alias("b"))
    c = content.select("job_id", "rn").join(begins, ["job_id", "rn"], "left")
    c = seq.running(c, JOB, ["rn"], {"last_b": ("max", "b")}, width=seq.ROWS).where(f"rn - last_b < {min_words}")
    c = seq.islands(
        c.select("job_id", "rn"), JOB, ["rn"], ["rn"], lambda p, x: x["rn"] - p["rn"] > 1, "island", width=seq.ROWS
    )
    return w.join(c, ["job_id", "rn"], "left")


def _shingles(tokens: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of ``n`` tokens (a polynomial of their hashes)."""
    out = np.zeros(max(len(tokens) - n + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n if len(out) else 0):
            out = out * _STEP + tokens[k : k + len(out)].view(np.uint64)
    return out


def _collapse(tokens: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Kept indexes, and edits (first kept, first removed, last removed, copies) in the order made.

    Each round takes the shortest phrase that is followed by itself, then the earliest one. A phrase of
    ``size`` words and its copy share ``size - least + 1`` shingles in a row, so of those only every such
    one is compared, and the words only where one agrees.
    """
    kept, edits = np.arange(len(tokens)), []
    while True:
        seen, found = tokens[kept], None
        shingle = _shingles(seen, least)
        for size in range(least, len(seen) // 2 + 1):
            step = size - least + 1
            if not (shingle[:-size:step] == shingle[size::step]).any():
                continue
            same = np.concatenate(([0], (seen[:-size] == seen[size:]).astype(np.int8), [0]))
            edge = np.flatnonzero(np.diff(same))
            begin, length = edge[::2], edge[1::2] - edge[::2]
            hit = np.flatnonzero(length >= size)
            if len(hit):
                found = (int(begin[hit[0]]), size, int(length[hit[0]]) // size)
                break
        if found is None:
            return kept, edits
        at, size, extra = found
        a, b = at + size, at + size * (extra + 1)
        edits.append((int(kept[at]), int(kept[a]), int(kept[b - 1]), extra + 1))
        kept = np.delete(kept, np.arange(a, b))


def _islands(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of words that shingles found more than once cover."""
    shingle = _shingles(tokens, least)
    order = np.sort(shingle)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return twice.view(np.int64), twice.view(np.int64)
    begin = np.flatnonzero(np.isin(shingle, twice))
    gap = np.flatnonzero(np.diff(begin) > least)
    return begin[np.concatenate(([0], gap + 1))], begin[np.concatenate((gap, [len(begin) - 1]))] + least - 1


def _recordings(words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row of an Arrow column of segments of word hashes (0: no letter or digit): hashes, and words of each segment."""
    flat = words.flatten()
    hashes = flat.flatten().to_numpy(zero_copy_only=False)
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False)
    segment = at = 0
    for n in words.value_lengths().to_pylist():
        own = sizes[segment : segment + (n or 0)]
        total = int(own.sum())
        yield hashes[at : at + total], own
        segment, at = segment + (n or 0), at + total


def _cell(segments: Column) -> Column:
    """Hashes of the words of each segment, as they are compared."""

    def compared(word: Column) -> Column:
        tok = tx.comparison_token(word)
        return F.when(tok == "", F.lit(0).cast("long")).otherwise(F.xxhash64(tok))

    return F.transform(segments, lambda s: F.transform(s, compared))


def islands_in_cells(recordings: DataFrame, segments: Column, *, min_words: int = 8) -> DataFrame:
    """``repeat_islands`` of recordings that are one row each: (job_id, island, first_rank, last_rank), without a shuffle.

    ``segments`` holds the words of each segment in order (array of arrays). A row with its words is one cell of
    the input and stays in its task. Words are compared by 64-bit hashes. A null row has no islands.
    """

    @F.arrow_udf("array<struct<first_rank:bigint,last_rank:bigint>>")
    def find(words: pa.Array) -> pa.Array:
        rows = []
        for hashes, _ in _recordings(words):
            first, last = _islands(hashes[hashes != 0], min_words)
            rows.append([{"first_rank": a + 1, "last_rank": b + 1} for a, b in zip(first.tolist(), last.tolist())])
        return pa.array(rows, pa.list_(pa.struct([("first_rank", pa.int64()), ("last_rank", pa.int64())])))

    found = recordings.select("job_id", F.posexplode(find(_cell(segments))).alias("island", "i"))
    return found.select("job_id", F.col("island").cast("long").alias("island"), "i.first_rank", "i.last_rank")


_PLACE = "struct<segment:int,word:int>"
_EDIT = (
    f"struct<retained_rn:bigint,edit_no:int,copies:int,phrase_words:int,retained:{_PLACE},first:{_PLACE},last:{_PLACE},"
    "segments:array<int>>"
)


def collapse_in_cells(recordings: DataFrame, segments: Column, *, min_words: int = 8) -> DataFrame:
    """``collapse_repeats`` of recordings that are one row each: their rows with ``edits`` and ``gone``, without a shuffle.

    Places are numbers of a segment and of a word in it, from 0. ``edits`` say what was removed, ``gone`` lists per
    segment the words removed; both are null where nothing repeats. Input as for ``islands_in_cells``.
    """
    place = pa.struct([("segment", pa.int32()), ("word", pa.int32())])
    edit = pa.struct(
        [("retained_rn", pa.int64()), ("edit_no", pa.int32()), ("copies", pa.int32()), ("phrase_words", pa.int32()),
         ("retained", place), ("first", place), ("last", place), ("segments", pa.list_(pa.int32()))]
    )
    result = pa.struct([("edits", pa.list_(edit)), ("gone", pa.list_(pa.list_(pa.int32())))])

    def rewrite(hashes: np.ndarray, sizes: np.ndarray) -> dict | None:
        place = np.flatnonzero(hashes)
        content = hashes[place]
        edits, gone = [], np.zeros(len(content) + 1, bool)
        ends = np.cumsum(sizes)
        segment = np.searchsorted(ends, place, "right")
        word = place - (ends - sizes)[segment]
        at = lambda i: {"segment": int(segment[i]), "word": int(word[i])}
        for lo, hi in zip(*_islands(content, min_words)):
            alive = np.ones(hi - lo + 1, bool)
            for n, (first, a, b, copies) in enumerate(_collapse(content[lo : hi + 1], min_words)[1], start=1):
                span = a + np.flatnonzero(alive[a : b + 1])
                alive[span] = False
                edits.append(
                    {"retained_rn": int(lo + first + 1), "edit_no": n, "copies": copies, "phrase_words": len(span) // (copies - 1),
                     "retained": at(lo + first), "first": at(lo + a), "last": at(lo + b), "segments": np.unique(segment[lo + span]).tolist()}
                )
            gone[lo + 1 : hi + 2] = ~alive
        if not edits:
            return None
        # marks without letters go with the word before them
        out = np.flatnonzero(gone[np.cumsum(hashes != 0)])
        owner = np.searchsorted(ends, out, "right")
        cut_at = np.searchsorted(owner, np.arange(len(sizes) + 1))
        inside = (out - (ends - sizes)[owner]).tolist()
        return {"edits": edits, "gone": [inside[a:b] for a, b in zip(cut_at[:-1].tolist(), cut_at[1:].tolist())]}

    @F.arrow_udf(f"struct<edits:array<{_EDIT}>,gone:array<array<int>>>")
    def find(words: pa.Array) -> pa.Array:
        return pa.array([rewrite(*r) for r in _recordings(words)], result)

    return recordings.withColumn("_r", find(_cell(segments))).select("*", "_r.edits", "_r.gone").drop("_r")


def collapse_repeats(words: DataFrame, *, min_words: int = 8, width: int = seq.HOUR_MS) -> tuple[DataFrame, DataFrame]:
    """(kept words, edits): immediate repeats of a passage of at least ``min_words`` words removed.

    Edits carry the retained and removed time ranges and the copies dropped.
    """
    tagged = cut(repeat_islands(words, min_words=min_words, width=width))
    inside = tagged.where("island IS NOT NULL AND tok <> ''").select(
        "job_id", "island", "rn", "tok", "start_ms", "end_ms", "segment_id"
    )
    job_type = tagged.schema["job_id"].dataType.simpleString()
    out = (
        f"job_id {job_type}, rn bigint, edit_no int, copies int, phrase_words int, retained_segment_id string, "
        "removed_segment_ids string, retained_start_ms bigint, removed_start_ms bigint, removed_end_ms bigint"
    )

    def rewrite(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn").reset_index(drop=True)
        kept, edits = _collapse(pd.factorize(pdf["tok"])[0], min_words)
        gone = np.setdiff1d(np.arange(len(pdf)), kept)
        rows = [(pdf["job_id"].iloc[0], int(pdf["rn"].iloc[i]), None, None, None, None, None, None, None, None) for i in gone]
        alive = np.ones(len(pdf), dtype=bool)
        for n, (first, a, b, copies) in enumerate(edits, start=1):
            span = np.flatnonzero(alive[: b + 1])
            span = span[span >= a]
            alive[span] = False
            ids = list(dict.fromkeys(pdf["segment_id"].iloc[span]))
            rows.append(
                (
                    pdf["job_id"].iloc[0], int(pdf["rn"].iloc[first]), n, copies, len(span) // (copies - 1),
                    pdf["segment_id"].iloc[first], "|".join(ids), int(pdf["start_ms"].iloc[first]),
                    int(pdf["start_ms"].iloc[a]), int(pdf["end_ms"].iloc[b]),
                )
            )
        return pd.DataFrame(rows, columns=[f.split()[0] for f in out.split(", ")])

    done = cut(inside.groupBy("job_id", "island").applyInPandas(rewrite, out))
    gone = done.where("edit_no IS NULL").select("job_id", "rn")
    kept = tagged.join(gone, ["job_id", "rn"], "left_anti").drop("tok", "island")
    return kept, done.where("edit_no IS NOT NULL").withColumnRenamed("rn", "retained_rn")


def segments_from_words(words: DataFrame) -> DataFrame:
    """Segment times and text recomputed from the words left; emptied segments disappear."""
    s = words.groupBy("job_id", "segment_id").agg(
        F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", F.struct(*ORDER)).alias("end_ms"),
        F.array_sort(F.collect_list(F.struct(*ORDER, "text"))).alias("w"),
    )
    return s.select(
        "job_id", "segment_id", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        tx.join_tokens(F.col("w.text")).alias("source_text"),
    )
