"""Packing token lists into sequences of at most ``window`` tokens by a histogram and non-negative least squares.

A document's ids are whole windows and a tail. Tails are counted in bins of ``window / BINS`` tokens (a tail belongs to the least
multiple that holds it). Shallow combinations of bins that fill a window exactly (up to ``DEPTH`` bins, or one bin many times and one
other) are the columns of a matrix; non-negative least squares finds how often to use each so that the bins' counts come out, and the
counts are rounded down to what the bins hold. Each tail takes the slot that its rank in its bin names.

A tail is shorter than its slot, so planned sequences keep gaps, and the plan leaves tails over. The plan covers only so large a share of
the tails that the rest can close the gaps: left-over tails are laid end to end on one axis and the gaps on the same axis, and
where an end of either falls, a tail is cut; what is left after the last gap fills further windows. So at most the last sequence
is padded, and gaps for which no tails are left.

Ranks and places are sums of counters per task, so no bin, sequence of equal lengths or hot document comes into one task; the histogram
(``BINS`` rows) is all that reaches the driver. Only the ids of cut tails move.

Edge cases: ids are kept as they are, of any type; null texts count as empty and hold only the end id; without an end id they have no
pieces; repeated rows and ids are documents of their own; an empty table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import in_slices, keep
from voxloom.llm.token_file import word_ids

BINS = 64
DEPTH = 3
#: Share of the tails that is kept back beyond what the gaps are expected to take.
SPARE = 0.02
#: Left-over tails come from the last of so many lots, so that the ids of few documents move.
LOTS = 16
#: Tokens of the common axis that one window function sees.
STRETCH = 1 << 18
GROUP = 4_096


class Packed(NamedTuple):
    pieces: DataFrame
    documents: DataFrame


# ---- the plan: small arrays on the driver, the same size for any table


def combinations(bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """Columns: how often each bin (1 to ``bins``) occurs in a combination that fills ``bins`` exactly."""
    found = set()
    for k in range(1, depth):
        for some in combinations_with_replacement(range(1, bins + 1), k):
            last = bins - sum(some)
            if last == 0:
                found.add(some)
            elif last >= some[-1] and k + 1 <= depth:
                found.add((*some, last))
    for a in range(1, bins + 1):
        for n in range(1, bins // a + 1):
            rest = bins - n * a
            found.add(tuple(sorted([a] * n + [rest] * (rest > 0))))
    out = np.zeros((bins, len(found)), np.int64)
    for j, members in enumerate(sorted(found)):
        np.add.at(out[:, j], np.array(members) - 1, 1)
    return out


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets: free the most promising variable, step back where one turns negative."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    scale = max(float(np.abs(b).max(initial=0.0)), 1.0)
    for _ in range(6 * n):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        j = int(slope.argmax())
        if not slope[j] > 1e-9 * scale:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            want = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (want > 0).all():
                x[:] = 0
                x[at] = want
                break
            low = want <= 0
            part = np.min(x[at][low] / np.maximum(x[at][low] - want[low], 1e-300))
            x[at] += part * (want - x[at])
            gone = at[(x[at] <= 1e-12 * scale) & low]
            x[gone] = 0
            free[gone] = False
    return x


def repeats(counts: np.ndarray, tokens: np.ndarray, grain: int, table: np.ndarray) -> np.ndarray:
    """Whole repeat counts of the combinations, none beyond what the bins hold, with tails left over for the gaps."""
    gaps = float((counts * grain * np.arange(1, len(counts) + 1) - tokens).sum())
    share = max(0.0, float(tokens.sum()) / max(float(tokens.sum()) + gaps, 1.0) - SPARE)
    wanted = np.floor(nnls(table.astype(float), share * counts) + 1e-6).astype(np.int64)
    left, out = counts.astype(np.int64).copy(), np.zeros(table.shape[1], np.int64)
    for j in np.argsort(-wanted, kind="stable"):
        uses = table[:, j]
        out[j] = min(int(wanted[j]), int((left[uses > 0] // uses[uses > 0]).min()))
        left -= out[j] * uses
    return out


def slots(table: np.ndarray, times: np.ndarray) -> list[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """Per bin: (first rank, end rank, copies in a sequence, first sequence, first slot) of each combination that uses it."""
    bins, begin, per = np.zeros(len(table), np.int64), 0, {}
    for j in np.flatnonzero(times):
        slot = 0
        for b in np.flatnonzero(table[:, j]):
            m = int(table[b, j])
            end = int(bins[b] + times[j] * m)
            per.setdefault(int(b) + 1, []).append((int(bins[b]), end, m, begin, slot))
            bins[b], slot = end, slot + m
        begin += int(times[j])
    return sorted(per.items())


# ---- documents


def _encode(path: str, last: int | None, window: int, grain: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        tok, task = word_ids(path), TaskContext.get().partitionId()
        kind = "<u2" if tok.lib.get_vocab_size() <= 1 << 16 and (last or 0) < 1 << 16 else "<u4"
        seen, before = np.zeros((BINS + 2) * LOTS, np.int64), 0
        done = 0
        for batch in in_slices(batches, 1 << 20, 8 << 20):
            values, offsets = tok.encode(batch.column(1), last)
            raw = memoryview(values.astype("<u4")).cast("B")
            short = values.astype(kind)
            n = np.diff(offsets)
            whole, tail = n // window, n % window
            bins = -(-tail // grain)
            seq = done + np.arange(len(n))
            lot = seq % LOTS
            # how many tails of the same bin and lot this task has met before
            key = bins * LOTS + lot
            order = np.argsort(key, kind="stable")
            heads = np.flatnonzero(np.diff(key[order], prepend=-1))
            runs = np.diff(heads, append=len(key))
            nth = np.empty(len(key), np.int64)
            nth[order] = np.arange(len(key)) - np.repeat(heads, runs) + seen[key[order]]
            seen[key[order][heads]] += runs
            earlier = before + np.cumsum(whole) - whole
            windows, tails, parts = [], [], []
            width = short.itemsize
            flat = memoryview(short).cast("B") if len(short) else memoryview(b"")
            for a, b, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), whole.tolist(), strict=True):
                windows.append([zlib.crc32(raw[4 * (a + i * window) : 4 * (a + (i + 1) * window)]) for i in range(k)])
                tails.append(zlib.crc32(raw[4 * (a + k * window) : 4 * b]))
                parts.append(bytes(flat[width * a : width * b]))
            done, before = done + len(n), before + int(whole.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.full(len(n), task), pa.int32()), pa.array(seq, pa.int64()), pa.array(n, pa.int64()), pa.array(lot, pa.int32()),
                    pa.array(tail, pa.int64()), pa.array(bins, pa.int32()), pa.array(nth, pa.int64()), pa.array(earlier, pa.int64()),
                    pa.array(windows, pa.list_(pa.int64())), pa.array(tails, pa.int64()), pa.array(parts, pa.binary()), pa.array(np.full(len(n), width), pa.int32()),
                ],
                ["doc_id", "task", "seq", "n", "lot", "tail", "bin", "nth", "earlier", "windows", "tail_crc", "ids", "width"],
            )

    return run


def encode(df: DataFrame, tokenizer_path: str, window: int, last: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per document: its ids, the checksums of its whole windows and tail, and its place among its task's documents."""
    slim = df.select(F.col(id_col).alias("doc_id"), text_col)
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, task int, seq long, n long, lot int, tail long, bin int, nth long, earlier long, windows array<long>, tail_crc long, ids binary, width int"
    return keep(slim.mapInArrow(_encode(tokenizer_path, last, window, -(-window // BINS)), schema))


# ---- places


def laid(df: DataFrame, group: str, order: list, size: str) -> DataFrame:
    """Add ``pos``, the sum of ``size`` over all rows before (by group, then ``order``); one row per group meets in one task."""
    first = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    bases = df.groupBy(group).agg(F.sum(size).alias("_sum")).select(group, F.coalesce(F.sum("_sum").over(first), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(bases, group)
    return rows.withColumn("pos", F.col("_base") + F.col("_in")).drop("_base", "_in")


def _spread(df: DataFrame, start: str, end: str, size: int = STRETCH) -> DataFrame:
    """A row for each stretch of the axis that an interval touches, and where it begins there (``at``)."""
    per = F.lit(size)
    cells = F.sequence(F.floor(F.col(start) / per), F.floor((F.col(end) - 1) / per))
    return df.withColumn("stretch", F.explode(cells)).withColumn("at", F.greatest(F.col(start), F.col("stretch") * per))


def crossings(left: DataFrame, right: DataFrame) -> DataFrame:
    """(``at``, ``stop``, ``f``, ``g``) of each stretch of the axis on which one interval of each side lies.

    Both sides are gapless intervals ``pos`` to ``end`` from 0; ``f`` and ``g`` hold their rows. Ends are merged in order, no pairs are formed.
    """
    a = _spread(left, "pos", "end").select("stretch", "at", F.lit(0).alias("side"), F.struct(*left.columns).alias("f"))
    b = _spread(right, "pos", "end").select("stretch", "at", F.lit(1).alias("side"), F.struct(*right.columns).alias("g"))
    both = a.unionByName(b, allowMissingColumns=True)
    here = Window.partitionBy("stretch").orderBy("at", "side")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    both = both.select(
        "at", F.lead("at").over(here).alias("next"), ((F.col("stretch") + 1) * F.lit(STRETCH)).alias("edge"),
        F.last("f", ignorenulls=True).over(so_far).alias("f"), F.last("g", ignorenulls=True).over(so_far).alias("g"),
    )
    stop = F.least(F.coalesce("next", "edge"), F.col("f.end"), F.col("g.end"))
    return both.where("f IS NOT NULL AND g IS NOT NULL").withColumn("stop", stop).where("at < stop").select("at", "stop", "f", "g")


def _cut_crc(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in in_slices(batches, 1 << 16, 8 << 20):
        rows = zip(batch.column("ids"), batch.column("width").to_pylist(), batch.column("start").to_pylist(), batch.column("length").to_pylist(), strict=True)
        crc = [zlib.crc32(np.frombuffer(ids.as_buffer(), f"<u{w}")[a : a + k].astype("<u4").tobytes()) for ids, w, a, k in rows]
        kept = ["doc_id", "task", "seq", "start", "length", "n", "sequence", "offset"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(crc, pa.int64())], [*kept, "crc"])


def pack(
    df: DataFrame, tokenizer_path: str, window: int = 4096, last: int | None = 2, id_col: str = "doc_id", text_col: str = "text"
) -> Packed:
    """Pieces (``doc_id``, ``task``, ``seq``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``) and the encoded documents.

    (``task``, ``seq``) tells documents of equal ids apart. Sequences are numbered from 0 without gaps.
    """
    spark = df.sparkSession
    encoded = encode(df, tokenizer_path, window, last, id_col, text_col)
    grain = -(-window // BINS)
    bins = -(-window // grain)
    docs = encoded.drop("ids")
    names = ["doc_id", "task", "seq", "start", "length", "crc", "n", "sequence", "offset"]

    counts = keep(docs.where("bin > 0").groupBy("bin", "lot", "task").agg(F.count(F.lit(1)).alias("m"), F.sum("tail").alias("t")))
    have, tokens = np.zeros(bins), np.zeros(bins)
    for r in counts.groupBy("bin").agg(F.sum("m").alias("m"), F.sum("t").alias("t")).collect():  # one row per bin
        have[r["bin"] - 1], tokens[r["bin"] - 1] = r["m"], r["t"]
    table = combinations(bins)
    times = repeats(have, tokens, grain, table)
    planned = int(times.sum())

    earlier = Window.partitionBy("bin").orderBy("lot", "task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bin", "lot", "task", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    places = spark.createDataFrame(slots(table, times), "bin int, places array<struct<lo: long, hi: long, m: long, first: long, slot: long>>")
    rank = F.col("base") + F.col("nth")
    ranked = docs.where("bin > 0").join(bases, ["bin", "lot", "task"]).withColumn("rank", rank).join(F.broadcast(places), "bin", "left")
    ranked = ranked.withColumn("p", F.get(F.filter("places", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"])), F.lit(0)))
    past = F.col("rank") - F.col("p.lo")
    tails = keep(
        ranked.select(
            "doc_id", "task", "seq", "n", "tail", "tail_crc", "lot", (F.col("p.first") + F.floor(past / F.col("p.m"))).alias("sequence"), (F.col("p.slot") + past % F.col("p.m")).alias("slot")
        )
    )

    # planned tails, side by side: a sequence has as many members as its combination
    inside = Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    fixed = tails.where("sequence IS NOT NULL").withColumn("offset", F.coalesce(F.sum("tail").over(inside), F.lit(0)))
    fixed = fixed.select("doc_id", "task", "seq", (F.col("n") - F.col("tail")).alias("start"), F.col("tail").alias("length"), F.col("tail_crc").alias("crc"), "n", "sequence", "offset")

    # whole windows
    runs = docs.groupBy("task").agg(F.sum(F.size("windows")).alias("w"))
    in_order = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    runs = keep(runs.select("task", "w", F.coalesce(F.sum("w").over(in_order), F.lit(0)).alias("ahead")))
    full = runs.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    long_ = docs.where(F.size("windows") > 0).join(runs.select("task", "ahead"), "task")
    long_ = long_.select("doc_id", "task", "seq", "n", (F.col("ahead") + F.col("earlier") + F.lit(planned)).alias("first"), F.posexplode("windows").alias("i", "crc"))
    long_ = long_.select(
        "doc_id", "task", "seq", (F.col("i") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), "crc", "n", (F.col("first") + F.col("i")).alias("sequence"), F.lit(0).cast("long").alias("offset")
    )

    # gaps of planned sequences and the tails that are left over, on one axis
    used = tails.where("sequence IS NOT NULL").groupBy("sequence").agg(F.sum("tail").alias("used"))
    gaps = used.where(F.col("used") < window).select("sequence", "used", (F.lit(window) - F.col("used")).alias("size"), F.floor(F.col("sequence") / F.lit(GROUP)).alias("g"))
    gaps = keep(laid(gaps, "g", ["sequence"], "size").select("sequence", "used", "pos", (F.col("pos") + F.col("size")).alias("end")))
    room = gaps.agg(F.coalesce(F.max("end"), F.lit(0))).first()[0]
    rest = laid(tails.where("sequence IS NULL").drop("sequence", "slot"), "task", ["seq"], "tail").withColumn("end", F.col("pos") + F.col("tail"))
    rest = keep(rest)
    lowest = rest.agg(F.min("lot")).first()[0]
    closing = rest.where(F.col("pos") < room).withColumn("tail_end", F.col("end")).withColumn("end", F.least(F.col("end"), F.lit(room)))
    closed = crossings(closing, gaps).select(
        "f.doc_id", "f.task", "f.seq", "f.n", "f.tail", "f.tail_crc", "f.pos", "at", "stop", "g.sequence", (F.col("g.used") + F.col("at") - F.col("g.pos")).alias("offset")
    )
    w, base = F.lit(window), F.lit(room)
    after = rest.where(F.col("end") > room).withColumn("from", F.greatest(F.col("pos"), base))
    after = after.withColumn("k", F.explode(F.sequence(F.floor((F.col("from") - base) / w), F.floor((F.col("end") - 1 - base) / w))))
    after = after.withColumn("at", F.greatest(F.col("from"), base + F.col("k") * w)).withColumn("stop", F.least(F.col("end"), base + (F.col("k") + 1) * w))
    after = after.select(
        "doc_id", "task", "seq", "n", "tail", "tail_crc", "pos", "at", "stop", (F.lit(planned + full) + F.col("k")).alias("sequence"), (F.col("at") - base - F.col("k") * w).alias("offset")
    )
    moved = closed.unionByName(after).withColumn("length", F.col("stop") - F.col("at")).withColumn("start", F.col("n") - F.col("tail") + F.col("at") - F.col("pos"))
    moved = keep(moved)
    uncut = moved.where("length = tail").withColumn("crc", F.col("tail_crc")).select(*names)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = encoded.where(F.col("lot") >= F.lit(lowest)).select("task", "seq", "ids", "width")
    cut = moved.where("length < tail").select("doc_id", "task", "seq", "start", "length", "n", "sequence", "offset").join(ids, ["task", "seq"])
    crc = cut.mapInArrow(_cut_crc, f"doc_id {kind}, task int, seq long, start long, length long, n long, sequence long, offset long, crc long").select(*names)

    pieces = fixed.select(*names).unionByName(long_.select(*names)).unionByName(uncut).unionByName(crc)
    pieces = pieces.withColumnsRenamed({"crc": "ids_crc32", "n": "doc_tokens", "sequence": "sequence_id"})
    return Packed(pieces, encoded)


def _slices(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in in_slices(batches, 1 << 16, 8 << 20):
        rows = zip(batch.column("ids"), batch.column("width").to_pylist(), batch.column("start").to_pylist(), batch.column("length").to_pylist(), strict=True)
        parts = [np.frombuffer(ids.as_buffer(), f"<u{w}")[a : a + k].astype(np.int64) for ids, w, a, k in rows]
        ends = np.cumsum([0, *map(len, parts)])
        flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("offset"), flat], ["sequence_id", "offset", "ids"])


def sequences(packed: Packed, window: int = 4096, pad: int = 0) -> DataFrame:
    """(``sequence_id``, ``ids``): the packed sequences, padded to ``window`` unless their length is a power of two."""
    rows = packed.pieces.join(packed.documents.select("task", "seq", "ids", "width"), ["task", "seq"]).select("sequence_id", "offset", "start", "length", "ids", "width")
    parts = rows.mapInArrow(_slices, "sequence_id long, offset long, ids array<long>")
    whole = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    is_power = F.expr("bit_count(size(ids)) = 1")
    return whole.select("sequence_id", F.when(is_power | (n >= window), F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad).cast("long"), F.lit(window) - n))).alias("ids"))
