"""Shards of near-equal bytes: minimax contiguous partition over ordered groups of equal texts, with built-in functions only.

Groups (all rows of one text) are atomic and ordered by the hash of their text. The smallest capacity with which a greedy pass
needs no more than the wanted number of shards is found by binary search. The greedy pass over a capacity asks, once per
shard, for the last group that ends at or before a byte position; a histogram of group ends (at most ``BINS`` bins) bounds
every such answer from below and above, and only bins that some undecided answer may lie in are looked at again, more
finely, until every group end that can matter is known. So the driver holds at most ``BINS`` numbers at a time, whatever
the size of the table, and the capacity is exact.

Edge cases: null text counts as empty (one group with the empty texts); a single group larger than all others together sets
the capacity; fewer groups than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import keep

BINS = 65_536
#: Hexadecimal digits of the group key that name its slice, and the parts a group's rows are ranked in.
SLICE_DIGITS, PARTS = 3, 1_024


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.substring(F.sha2(text, 256), 1, 40).alias("_group"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(PARTS)).cast("int").alias("_bit"),
    )


def _ends(rows: DataFrame) -> DataFrame:
    """Per (group, part of its rows): bytes through the whole group and rows through this part, over all groups in order."""
    parts = rows.groupBy("_group", "_bit").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_bytes"))
    parts = parts.withColumn("_slice", F.substring("_group", 1, SLICE_DIGITS))
    slices = parts.groupBy("_slice").agg(F.sum("_n").alias("_sn"), F.sum("_bytes").alias("_sb"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        "_slice", F.coalesce(F.sum("_sn").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sb").over(earlier), F.lit(0)).alias("_b0")
    )
    by_part = Window.partitionBy("_slice").orderBy("_group", "_bit").rowsBetween(Window.unboundedPreceding, 0)
    by_group = Window.partitionBy("_slice").orderBy("_group").rangeBetween(Window.unboundedPreceding, 0)
    inside = parts.select(
        "_slice", "_group", "_bit", F.sum("_n").over(by_part).alias("_rows"), F.sum("_bytes").over(by_group).alias("_end"), "_n", "_bytes"
    )
    return inside.join(slices, "_slice").select(
        "_group", "_bit", "_n", "_bytes", (F.col("_rows") + F.col("_n0") - F.col("_n")).alias("_first"), (F.col("_end") + F.col("_b0")).alias("_end")
    )


def _histogram(ends: DataFrame, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(least end, greatest end, distinct ends) per bin of the spans, in order; at most ``BINS`` bins in all."""
    each = max(1, BINS // len(spans))
    parts = []
    for k, (lo, hi) in enumerate(spans):
        width = max(1, -(-(hi - lo) // each))
        here = ends.where((F.col("_end") > lo) & (F.col("_end") <= hi))
        parts.append(here.select(F.lit(k).alias("k"), F.floor((F.col("_end") - lo - 1) / F.lit(width)).alias("b"), "_end"))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    bins = union.groupBy("k", "b").agg(F.min("_end").alias("lo"), F.max("_end").alias("hi"))
    return sorted((r["lo"], r["hi"]) for r in bins.collect())


def least_capacity(ends: DataFrame, shards: int, total: int, largest: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and where the greedy pass with it ends each shard.

    ``known`` are bins as (least end, greatest end); a bin with both equal is one exact group end.
    """
    known = _histogram(ends, [(0, total)])
    low, high = max(largest, -(-total // shards)), largest + -(-total // shards)
    while True:
        tops = [b[1] for b in known]
        lows = [b[0] for b in known]

        def passes(capacity: int, hopeful: bool) -> list[int]:
            """Ends of the shards; within an open bin the answer is its greatest (hopeful) or least possible one."""
            at, cuts = 0, []
            for _ in range(shards):
                k = bisect_right(tops, at + capacity)
                best = tops[k - 1] if k else 0
                if k < len(tops) and lows[k] <= at + capacity:
                    best = min(at + capacity, tops[k]) if hopeful else lows[k]
                at = max(at, best)
                cuts.append(at)
            return cuts

        def smallest(hopeful: bool) -> int:
            a, b = low, high
            while a < b:
                m = (a + b) // 2
                a, b = (a, m) if passes(m, hopeful)[-1] >= total else (m + 1, b)
            return a

        least, most = smallest(True), smallest(False)
        first, last = passes(least, False), passes(most, True)
        open_ = [(lo, hi) for lo, hi in known if lo < hi and any(a < hi and lo <= b for a, b in zip(first, last, strict=True))]
        if not open_:
            return most, passes(most, False)
        low, high = least, most
        spans: list[list[int]] = []
        for lo, hi in open_:
            if spans and spans[-1][1] == lo - 1:
                spans[-1][1] = hi
            else:
                spans.append([lo - 1, hi])
        finer = _histogram(ends, [(a, b) for a, b in _merged(spans)])
        inside = [tuple(s) for s in _merged(spans)]
        known = sorted([b for b in known if not any(a < b[0] and b[1] <= z for a, z in inside)] + finer)


def _merged(spans: list[list[int]], most: int = 64) -> list[list[int]]:
    """At most ``most`` spans: the ones with the smallest gaps between them become one."""
    spans = [list(s) for s in spans]
    while len(spans) > most:
        gaps = [spans[i + 1][0] - spans[i][1] for i in range(len(spans) - 1)]
        i = gaps.index(min(gaps))
        spans[i][1] = spans.pop(i + 1)[1]
    return spans


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard, group after group).

    A row's size is the UTF-8 length of its text plus one. No shard is larger than the least capacity that any cut of the ordered groups allows.
    """
    rows = keep(_hashed(df, id_col, text_col))
    ends = keep(_ends(rows))
    facts = ends.groupBy("_end").agg(F.sum("_bytes").alias("g")).agg(F.max("g").alias("largest"), F.max("_end").alias("total")).first()
    if facts["total"] is None:
        cuts: list[int] = []
    else:
        cuts = least_capacity(ends, shards, facts["total"], facts["largest"])[1][:-1]
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("_end") > F.lit(c)).cast("int")
    placed = ends.select("_group", "_bit", "_first", number.cast("int").alias("shard"))
    bases = placed.groupBy("shard").agg(F.min("_first").alias("_base"))
    placed = placed.join(F.broadcast(bases), "shard")  # one row per shard
    rank = F.row_number().over(Window.partitionBy("_group", "_bit").orderBy(F.col("_id").asc_nulls_last()))
    return rows.withColumn("_rank", rank - 1).join(placed, ["_group", "_bit"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_first") - F.col("_base") + F.col("_rank")).cast("long").alias("slot")
    )
