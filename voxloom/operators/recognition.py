"""Recognised words: absolute times, timestamp checks and repair, fallbacks, silence chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.plans import sequences as seq
from voxloom.session import cut

CHUNK = ["job_id", "chunk_id"]
ORDER = ["start_ms", "end_ms", "pos"]


def absolute_ms(seconds: Column, chunk_start_ms: Column) -> Column:
    """chunk start + whole milliseconds, cut off; null where the value is not a number."""
    return chunk_start_ms + (seconds.try_cast("double") * 1000).cast("long")


def valid_words(words: DataFrame) -> DataFrame:
    """Words with non-blank text (falling back to ``word``) and positive length."""
    t = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.trim("word"))
    return words.withColumn("text", t).where("text <> '' AND end_ms > start_ms")


def timed_entries(raw: DataFrame) -> DataFrame:
    """Chunk responses with ``words`` reduced to non-blank entries (pos, text, s, e) in absolute ms."""
    def entry(w: Column, i: Column) -> Column:
        return F.struct(
            (i + 1).cast("long").alias("pos"),
            F.trim(w["word"]).alias("text"),
            absolute_ms(w["start"], F.col("chunk_start_ms")).alias("s"),
            absolute_ms(w["end"], F.col("chunk_start_ms")).alias("e"),
        )

    return seq.pin(raw, entries=F.filter(F.transform("words", entry), lambda x: x["text"] != ""))


def timestamp_gate(raw: DataFrame) -> DataFrame:
    """Per chunk: entries, how many lack a time, and whether word times can be used at all."""
    bad = F.size(F.filter("entries", lambda x: x["s"].isNull() | x["e"].isNull())).cast("long")
    n = F.size("entries").cast("long")
    return timed_entries(raw).select(
        *CHUNK, n.alias("n_words"), bad.alias("missing_times"),
        F.when(n == 0, "missing").when(bad > 0, "incomplete").otherwise("usable").alias("gate"),
    )


def repair_word_times(raw: DataFrame) -> DataFrame:
    """Word rows with starts pushed past the previous end and empty words given up to 20 ms.

    Only chunks that break the rule are folded; clean chunks pass through. A chunk is one response
    document, so the fold is bounded by that cell.
    """
    t = timed_entries(raw).where(
        (F.size("entries") > 0) & ~F.exists("entries", lambda x: x["s"].isNull() | x["e"].isNull())
    )
    later = F.slice("entries", 2, F.greatest(F.size("entries") - 1, F.lit(0)))
    clean = F.forall("entries", lambda x: x["e"] > x["s"]) & F.forall(
        F.zip_with(F.slice("entries", 1, F.greatest(F.size("entries") - 1, F.lit(0))), later, lambda a, b: b["s"] >= a["e"]),
        lambda ok: ok,
    )
    unit = "array<struct<pos:bigint,text:string,start_ms:bigint,end_ms:bigint,raw_s:bigint,raw_e:bigint>>"
    # (position of each time value in reading order) -> next later time above the start
    t = seq.pin(t, times=F.flatten(F.transform("entries", lambda x: F.array(x["s"], x["e"]))))
    times = F.col("times")

    def step(done: Column, x: Column) -> Column:
        start = F.when(F.size(done) > 0, F.greatest(x["s"], F.element_at(done, -1)["end_ms"])).otherwise(x["s"])
        ahead = F.slice(times, 2 * F.size(done) + 3, F.greatest(F.size(times) - 2 * F.size(done) - 2, F.lit(0)))
        bound = F.get(F.filter(ahead, lambda v: v > start), F.lit(0))
        end = F.when(x["e"] > start, x["e"]).otherwise(F.coalesce(F.least(start + 20, bound), start + 20))
        return F.concat(
            done,
            F.array(
                F.struct(
                    x["pos"].alias("pos"), x["text"].alias("text"), start.alias("start_ms"), end.alias("end_ms"),
                    x["s"].alias("raw_s"), x["e"].alias("raw_e"),
                )
            ),
        )

    folded = F.aggregate("entries", F.array().cast(unit), step)
    plain = F.transform(
        "entries",
        lambda x: F.struct(
            x["pos"].alias("pos"), x["text"].alias("text"), x["s"].alias("start_ms"), x["e"].alias("end_ms"),
            x["s"].alias("raw_s"), x["e"].alias("raw_e"),
        ),
    ).cast(unit)
    u = seq.pin(t, units=F.when(clean, plain).otherwise(folded))
    moved = F.exists("units", lambda x: (x["start_ms"] != x["raw_s"]) | (x["end_ms"] != x["raw_e"]))
    u = u.select(*CHUNK, moved.alias("repaired"), F.inline("units"))
    return u.select(*CHUNK, "pos", "text", "start_ms", "end_ms", "repaired")


def segment_units(raw: DataFrame) -> DataFrame:
    """Segment-level units with usable times."""
    s = raw.select(*CHUNK, "chunk_start_ms", F.posexplode("segments").alias("pos", "seg"))
    s = s.select(
        *CHUNK,
        F.col("pos").cast("long").alias("pos"),
        F.trim("seg.text").alias("text"),
        absolute_ms(F.col("seg.start"), F.col("chunk_start_ms")).alias("start_ms"),
        absolute_ms(F.col("seg.end"), F.col("chunk_start_ms")).alias("end_ms"),
    )
    return s.where("text <> '' AND end_ms > start_ms")


def timestamp_ladder(raw: DataFrame, *, require_words: bool = False, allow_chunk_text: bool = True) -> DataFrame:
    """Best time source per chunk: word, segment, whole chunk or none, with quality and risk flags."""
    words = repair_word_times(raw).groupBy(*CHUNK).agg(
        F.count("*").alias("w_units"), F.bool_or("repaired").alias("w_repaired")
    )
    segs = segment_units(raw).groupBy(*CHUNK).agg(F.count("*").alias("s_units"))
    d = raw.select(*CHUNK, F.trim("text").alias("text"), "chunk_end_ms").join(words, CHUNK, "left").join(segs, CHUNK, "left")
    has_text = (F.col("text") != "") & F.col("chunk_end_ms").isNotNull() & F.lit(allow_chunk_text)
    level = (
        F.when(F.col("w_units") > 0, "word")
        .when(F.lit(require_words), "error")
        .when(F.col("s_units") > 0, "segment")
        .when(has_text, "chunk")
        .otherwise("none")
    )
    flags = (
        F.when((level == "word") & F.col("w_repaired"), "word_timestamp_repaired")
        .when(level == "segment", "word_timestamps_missing")
        .when(level == "chunk", "timestamps_missing|chunk_text_fallback")
        .when(level == "none", "timestamps_missing")
        .otherwise("")
    )
    units = (
        F.when(level == "word", F.col("w_units")).when(level == "segment", F.col("s_units")).when(level == "chunk", 1)
    )
    return d.select(
        *CHUNK,
        level.alias("source"),
        F.when(level == "chunk", "chunk_fallback").otherwise(level).alias("quality"),
        F.coalesce(units, F.lit(0)).cast("long").alias("units"),
        flags.alias("risk_flags"),
    )


# --- word chunks -----------------------------------------------------------------------------


def silence_thresholds(
    words: DataFrame,
    *,
    max_chunk_ms: int = 60_000,
    initial_ms: int = 5_000,
    min_ms: int = 500,
    step_ms: int = 500,
    width: int = seq.HOUR_MS,
) -> DataFrame:
    """Per recording the largest silence threshold whose islands all fit ``max_chunk_ms``, else the least.

    Words are first merged at the least threshold; only those coarse runs are tried at every threshold.
    """
    runs = _gap_runs(words, ["job_id"], min_ms, width).groupBy("job_id", "run").agg(
        F.min("start_ms").alias("start_ms"), F.max_by("end_ms", F.struct(*ORDER)).alias("end_ms")
    )
    steps = F.array_distinct(F.concat(F.sequence(F.lit(initial_ms), F.lit(min_ms), F.lit(-step_ms)), F.array(F.lit(min_ms))))
    tried = cut(runs).withColumn("threshold_ms", F.explode(steps))
    isl = seq.islands(
        tried, ["job_id", "threshold_ms"], ["start_ms", "run"], ["start_ms", "end_ms", "threshold_ms"],
        lambda p, c: c["start_ms"] - p["end_ms"] >= c["threshold_ms"], "isl", width=width,
    )
    spans = isl.groupBy("job_id", "threshold_ms", "isl").agg(
        (F.max_by("end_ms", F.struct("start_ms", "run")) - F.min("start_ms")).alias("span")
    )
    fits = spans.groupBy("job_id", "threshold_ms").agg((F.max("span") <= max_chunk_ms).alias("fits"))
    return fits.groupBy("job_id").agg(
        F.coalesce(F.max(F.when(F.col("fits"), F.col("threshold_ms"))), F.lit(min_ms)).cast("long").alias("threshold_ms"),
        F.max("fits").alias("all_fit"),
    )


def _gap_runs(words: DataFrame, key: list[str], threshold: int, width: int) -> DataFrame:
    return seq.islands(
        words, key, ORDER, ["start_ms", "end_ms"], lambda p, c: c["start_ms"] - p["end_ms"] >= threshold, "run", width=width
    )


def _cuts(start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """Piece of each word of an island in order: a piece ends before the first word that ends more than ``most`` after its start."""
    piece, upto, i, n = np.zeros(len(start), np.int64), np.maximum.accumulate(end), 0, 0
    while i < len(start):
        # the first word of a piece always stays, however long it is
        to = max(int(np.searchsorted(upto, start[i] + most, "right")), i + 1)
        piece[i:to], i, n = n, to, n + 1
    return piece


def _split_cells(words: DataFrame, islands: str, max_chunk_ms: int, width: int) -> DataFrame:
    """Words with ``hard`` and ``piece`` as far as a block of their recording tells, and ``_edge``: their island is its first or last and may go on in another."""
    rows = words.withColumn("_blk", F.expr(f"start_ms div {width}")).dropna(subset=["job_id", islands, "_blk"])
    rows = rows.repartition("job_id", "_blk").sortWithinPartitions("job_id", "_blk", *ORDER).select("_blk", *words.columns)
    schema = T.StructType([*words.schema.fields, T.StructField("hard", T.BooleanType()), T.StructField("piece", T.LongType()), T.StructField("_edge", T.BooleanType())])

    cell_key = ("job_id", "_blk")

    def begins(table: pa.Table, *columns: str) -> np.ndarray:
        new = np.ones(len(table), bool)
        if len(table) > 1:
            new[1:] = np.logical_or.reduce([pc.not_equal(table[c][1:], table[c][:-1]).to_numpy() for c in columns])
        return new

    def split(table: pa.Table) -> pa.RecordBatch:
        cell, run = begins(table, *cell_key), begins(table, *cell_key, islands)
        first = np.flatnonzero(run)
        last = np.append(first[1:], len(table))
        edge = cell[first] | np.append(cell[first[1:]], True)
        untimed = pc.is_null(table["end_ms"]).to_numpy()
        edge |= np.logical_or.reduceat(untimed, first)
        start, end = table["start_ms"].to_numpy(), pc.fill_null(table["end_ms"], 0).to_numpy()
        hard, piece = end[last - 1] - start[first] > max_chunk_ms, np.zeros(len(table), np.int64)
        for k in np.flatnonzero(hard & ~edge):
            piece[first[k] : last[k]] = _cuts(start[first[k] : last[k]], end[first[k] : last[k]], max_chunk_ms)
        of = np.repeat(np.arange(len(first)), last - first)
        out = table.drop_columns("_blk").append_column("hard", pa.array(hard[of])).append_column("piece", pa.array(piece)).append_column("_edge", pa.array(edge[of]))
        return out.combine_chunks().to_batches()[0]

    def whole_cells(batches: Iterator) -> Iterator:
        waits: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([batch])
            # the last cell may go on in the next batch
            k = int(np.flatnonzero(begins(batch, *cell_key))[-1])
            if waits and not k and not begins(pa.concat_tables([waits[-1][-1:], batch[:1]]), *cell_key)[1]:
                waits.append(batch)
                continue
            if waits or k:
                yield split(pa.concat_tables([*waits, batch[:k]]))
            waits = [batch[k:]]
        if waits:
            yield split(pa.concat_tables(waits))

    return rows.mapInArrow(whole_cells, schema)


def _split_paths(words: DataFrame, islands: str, max_chunk_ms: int, width: int) -> DataFrame:
    """Islands of any length cut by paths: the next cut depends only on where the piece starts, so cuts are found for every word by one
    scan and the path from each island's first word is followed."""
    key = ["job_id", islands]
    rank = F.max_by("end_ms", F.struct(*ORDER)) - F.min("start_ms")
    size = words.groupBy(*key).agg((rank > max_chunk_ms).alias("hard"))
    w = cut(words.join(size.hint("merge"), key))
    whole = w.where("NOT hard").withColumn("piece", F.lit(0).cast("long"))
    over = cut(seq.ranked(w.where("hard"), key, ORDER, "rn", width=width).withColumn("pos0", F.col("rn") - 1))
    p = over.select(*key, F.col("pos0").alias("pos"), (F.col("start_ms") + max_chunk_ms).alias("threshold"))
    m = over.select(*key, F.col("pos0").alias("pos"), F.col("end_ms").alias("level"))
    # the first word of a piece always stays, however long it is
    edges = seq.first_beyond(p, m, key, "nxt", width=width).withColumn(
        "nxt", F.when(F.col("nxt").isNotNull(), F.greatest("nxt", F.col("pos") + 1))
    )
    starts = seq.chase(edges, key)
    renamed = over.withColumnRenamed("pos", "word_pos").withColumnRenamed("pos0", "pos")
    pieces = seq.spans_from_starts(renamed, starts, key, "piece")
    pieces = pieces.drop("pos", "rn").withColumnRenamed("word_pos", "pos")
    return whole.unionByName(pieces)


def hard_split(words: DataFrame, islands: str = "isl", *, max_chunk_ms: int = 60_000, width: int = seq.HOUR_MS) -> DataFrame:
    """Cut islands longer than ``max_chunk_ms`` greedily; adds ``piece`` (0-based in the island) and ``hard``.

    Islands are runs of a recording's words in order. Most lie within one block of their recording and are cut where its words lie; only
    the first and last of each block, which may go on in another, are followed as paths. Words without recording, island or start are left out.
    """
    near = cut(_split_cells(words, islands, max_chunk_ms, width))
    within = near.where("NOT _edge").drop("_edge")
    return within.unionByName(_split_paths(near.where("_edge").drop("hard", "piece", "_edge"), islands, max_chunk_ms, width))


def word_chunks(
    words: DataFrame,
    *,
    max_chunk_ms: int = 60_000,
    initial_ms: int = 5_000,
    min_ms: int = 500,
    step_ms: int = 500,
    width: int = seq.HOUR_MS,
) -> DataFrame:
    """Words with their chunk number (1-based per recording), the threshold used, and ``hard``."""
    words = cut(words)
    thr = silence_thresholds(
        words, max_chunk_ms=max_chunk_ms, initial_ms=initial_ms, min_ms=min_ms, step_ms=step_ms, width=width
    )
    w = cut(words.join(thr.select("job_id", "threshold_ms"), "job_id"))
    w = seq.islands(
        w, ["job_id"], ORDER, ["start_ms", "end_ms", "threshold_ms"],
        lambda p, c: c["start_ms"] - p["end_ms"] >= c["threshold_ms"], "isl", width=width,
    )
    w = cut(hard_split(cut(w), max_chunk_ms=max_chunk_ms, width=width))
    w = seq.islands(
        w, ["job_id"], ORDER, ["isl", "piece"],
        lambda p, c: (p["isl"] != c["isl"]) | (p["piece"] != c["piece"]), "chunk_no", width=width,
    )
    return cut(w.withColumn("chunk_no", F.col("chunk_no") + 1).drop("isl", "piece"))


def chunk_bounds(chunk_words: DataFrame, totals: DataFrame | None = None, *, trailing_cap_ms: int = 5_000) -> DataFrame:
    """Bounds of each chunk: trailing silence up to the cap, the track end and the next chunk's start."""
    c = chunk_words.groupBy("job_id", "chunk_no").agg(
        F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", F.struct(*ORDER)).alias("word_end_ms"),
        F.first("threshold_ms").alias("split_threshold_ms"),
        F.bool_or("hard").alias("hard_split"),
        F.count("*").alias("n_words"),
    )
    c = seq.neighbours(c, ["job_id"], ["start_ms", "chunk_no"], ["start_ms"], nxt="_n")
    if totals is not None:
        c = c.join(totals.select("job_id", "total_duration_ms"), "job_id", "left")
    else:
        c = c.withColumn("total_duration_ms", F.lit(None).cast("long"))
    word_end = F.col("word_end_ms")
    end = F.least(F.greatest(word_end, "total_duration_ms"), word_end + trailing_cap_ms, F.col("_n.start_ms"))
    c = c.withColumn("end_ms", F.greatest(word_end, end))
    return c.select(
        "job_id", "chunk_no", "start_ms", "end_ms", "word_end_ms", "split_threshold_ms",
        (F.col("end_ms") - word_end).alias("trailing_silence_ms"), "hard_split", "n_words",
    )


def ordered_distinct(df: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Distinct values of each key in first-seen order, one row per value with its 1-based rank.

    Kept long instead of as one array, so a group with very many values stays distributed.
    """
    first = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*key, value).agg(
        F.min(F.struct(*order)).alias("_o")
    )
    first = first.select(*key, value, *[F.col("_o")[o].alias(o) for o in order])
    return seq.ranked(first, key, [*order, value], "seen_rank").select(*key, value, "seen_rank")


def word_chunk_table(chunk_words: DataFrame, sources: DataFrame, bounds: DataFrame) -> DataFrame:
    """Chunks joined to what their source responses said: least confidence, first leading silence,
    distinct source ids and flags. A chunk spans at most the maximum chunk length."""
    w = chunk_words.join(sources, CHUNK)
    order = F.struct(*ORDER)
    agg = w.groupBy("job_id", "chunk_no").agg(
        F.min("confidence_pct").alias("confidence_pct"),
        F.min_by("silence_before_ms", order).alias("silence_before_ms"),
        F.countDistinct("chunk_id").alias("n_sources"),
    )
    return bounds.join(agg, ["job_id", "chunk_no"]).withColumn(
        "chunk_name", F.format_string("wchunk_%06d", "chunk_no")
    )
