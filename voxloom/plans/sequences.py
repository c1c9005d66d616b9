"""Ordered per-recording operations that hold when one recording has a third of all rows.

A plain window over ``job_id`` sorts a whole recording in one task. Everything here works on
*blocks* instead: rows are grouped by (key, first order column div width), a window runs inside
each block, and one small summary row per block carries what crosses the block edges. The wide
rows are shuffled once, by (key, block); only block summaries are ordered by key alone, which is
one row per hour of audio (``HOUR_MS``) or per ``ROWS`` records.

``order`` must be a total order within the key and its first column an integer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.session import cut

HOUR_MS = 3_600_000
ROWS = 4096

_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def _blocked(df: DataFrame, order: Sequence[str], width: int) -> DataFrame:
    return df.withColumn("_blk", F.expr(f"`{order[0]}` div {width}"))


def _inside(key: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*key, "_blk").orderBy(*order)


def _across(key: Sequence[str]):
    return Window.partitionBy(*key).orderBy("_blk")


def _attach(rows: DataFrame, summary: DataFrame, key: Sequence[str]) -> DataFrame:
    """Join block summaries to their rows. The window has already placed the rows by (key, block), so
    only the summaries move, and each task hashes just its own few."""
    return rows.join(summary.hint("shuffle_hash"), [*key, "_blk"])


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    The optimiser folds a plain projection into the expressions that use it; inside a lambda that
    means once per element. A one-row generator keeps the value.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def neighbours(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    *,
    prev: str | None = None,
    nxt: str | None = None,
    width: int = HOUR_MS,
) -> DataFrame:
    """Add struct columns holding ``fields`` of the previous and/or next row of the key."""
    rows = _blocked(cut(df), order, width)
    payload, rank = F.struct(*fields), F.struct(*order)
    inside, across = _inside(key, order), _across(key)
    edges = rows.groupBy(*key, "_blk").agg(
        F.min_by(payload, rank).alias("_first"), F.max_by(payload, rank).alias("_last")
    )
    edges = edges.select(
        *key,
        "_blk",
        F.lag("_last").over(across).alias("_before"),
        F.lead("_first").over(across).alias("_after"),
    )
    if prev:
        rows = rows.withColumn(prev, F.lag(payload).over(inside))
    if nxt:
        rows = rows.withColumn(nxt, F.lead(payload).over(inside))
    rows = _attach(rows, edges, key)
    if prev:
        rows = rows.withColumn(prev, F.coalesce(prev, "_before"))
    if nxt:
        rows = rows.withColumn(nxt, F.coalesce(nxt, "_after"))
    return rows.drop("_blk", "_before", "_after")


def running(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    aggs: dict[str, tuple[str, str | Column]],
    *,
    width: int = HOUR_MS,
) -> DataFrame:
    """Add inclusive running aggregates: ``{new_column: ("sum"|"max"|"min"|"count", column)}``."""
    return _running(cut(df), key, order, aggs, width=width)


def _running(df: DataFrame, key: Sequence[str], order: Sequence[str], aggs: dict, *, width: int) -> DataFrame:
    rows = _blocked(df, order, width)
    upto = _inside(key, order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = _across(key).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key, "_blk").agg(*[_AGG[fn](c).alias(n) for n, (fn, c) in aggs.items()])
    combine = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    carry = totals.select(
        *key, "_blk", *[combine[fn](n).over(earlier).alias(f"_c_{n}") for n, (fn, _) in aggs.items()]
    )
    for n, (fn, c) in aggs.items():
        rows = rows.withColumn(n, _AGG[fn](c).over(upto))
    rows = _attach(rows, carry, key)
    for n, (fn, _) in aggs.items():
        c = f"_c_{n}"
        if fn in ("sum", "count"):
            value = F.coalesce(c, F.lit(0)) + F.coalesce(n, F.lit(0))
        else:
            value = (F.greatest if fn == "max" else F.least)(c, n)
        rows = rows.withColumn(n, value)
    return rows.drop("_blk", *[f"_c_{n}" for n in aggs])


def ranked(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str, *, width: int = HOUR_MS) -> DataFrame:
    """Add the 1-based row number within the key."""
    return running(df, key, order, {name: ("count", F.lit(1))}, width=width)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add the 1-based place of each row in the order of the whole table: a range sort, then one summary row per task."""
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    rows = placed.withColumn(name, inside).join(counts, "_part")
    return rows.withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before")


def islands(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    starts: Callable[[Column, Column], Column],
    name: str,
    *,
    width: int = HOUR_MS,
) -> DataFrame:
    """Number maximal runs (0-based) per key; ``starts(previous, current)`` says where a new run begins."""
    rows = _blocked(cut(df), order, width)
    inside = _inside(key, order)
    payload, rank = F.struct(*fields), F.struct(*order)
    rows = rows.withColumn("_cur", payload).withColumn("_prev", F.lag(payload).over(inside))
    rows = rows.withColumn(
        "_brk", F.when(F.col("_prev").isNull(), 0).otherwise(starts(F.col("_prev"), F.col("_cur")).cast("long"))
    )
    edges = rows.groupBy(*key, "_blk").agg(
        F.sum("_brk").alias("_inner"),
        F.min_by("_cur", rank).alias("_first"),
        F.max_by("_cur", rank).alias("_last"),
    )
    across = _across(key)
    edges = edges.withColumn("_before", F.lag("_last").over(across)).withColumn(
        "_edge",
        F.when(F.col("_before").isNull(), 0).otherwise(starts(F.col("_before"), F.col("_first")).cast("long")),
    )
    edges = edges.select(
        *key,
        "_blk",
        (
            F.sum("_edge").over(across.rowsBetween(Window.unboundedPreceding, 0))
            + F.coalesce(F.sum("_inner").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ).alias("_base"),
    )
    rows = rows.withColumn("_run", F.sum("_brk").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = _attach(rows, edges, key).withColumn(name, F.col("_base") + F.col("_run"))
    return rows.drop("_blk", "_cur", "_prev", "_brk", "_run", "_base")


def pieces(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    starts: Callable[[Column, Column], Column],
    name: str,
    *,
    width: int = HOUR_MS,
) -> DataFrame:
    """Maximal runs per key, numbered from 0 as by ``islands``, as rows (key, name, _blk, items): a run's items within one block.

    ``fields`` are the items' columns besides ``order``. A block is one cell, and rows move once; a run that crosses block
    edges gives a row in each block, in the order of ``_blk``. Rows without key or place in the order are left out.
    """
    rows = _blocked(df, order, width).where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*key, "_blk"]))
    item = F.struct(*order, *[f for f in fields if f not in order])
    # rows move unpacked: lists of all keys at once would spill before the shuffle. Both uses below read the same cells, so Spark shuffles them once
    cells = rows.repartition(*key, "_blk").groupBy(*key, "_blk").agg(F.array_sort(F.collect_list(item)).alias("_w"))
    at = lambda i: F.get(F.col("_w"), i)
    begin = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: (i == 0) | F.coalesce(starts(at(i - 1), at(i)), F.lit(False)))
    cells = pin(cells, _begin=begin)
    edges = cells.select(*key, "_blk", (F.size("_begin") - 1).alias("_inner"), at(F.lit(0)).alias("_first"), at(F.size("_w") - 1).alias("_last"))
    across = _across(key)
    edges = edges.withColumn("_before", F.lag("_last").over(across))
    # an edge that is null starts nothing, as inside a block
    edges = edges.withColumn("_edge", F.when(F.col("_before").isNull(), 0).otherwise(starts(F.col("_before"), F.col("_first")).cast("long")))
    inner = F.coalesce(F.sum("_inner").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(*key, "_blk", (F.sum("_edge").over(across.rowsBetween(Window.unboundedPreceding, 0)) + inner).alias("_base"))
    end = lambda k: F.coalesce(F.get("_begin", k + 1), F.size("_w"))
    runs = F.transform("_begin", lambda b, k: F.slice("_w", b + 1, end(k) - b))
    out = _attach(cells, edges, key).select(*key, "_blk", "_base", F.posexplode(runs).alias("_k", "items"))
    return out.select(*key, (F.col("_base") + F.col("_k")).alias(name), "_blk", "items")


def lookahead(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    span: int,
    name: str,
    *,
    width: int = HOUR_MS,
) -> DataFrame:
    """Add an ordered array of structs: this row and the rows starting at most ``span`` later.

    Rows near a block's start are also copied into the block before, so every frame is complete.
    """
    if span > width:
        raise ValueError("span must not exceed the block width")
    first = order[0]
    rows = _blocked(df, order, width).withColumn("_home", F.col("_blk"))
    near = F.col(first) - F.col("_blk") * width < span
    rows = rows.withColumn(
        "_blk", F.explode(F.when(near, F.array("_blk", F.col("_blk") - 1)).otherwise(F.array("_blk")))
    )
    frame = Window.partitionBy(*key, "_blk").orderBy(first).rangeBetween(0, span)
    item = F.struct(*order, *[f for f in fields if f not in order])
    rows = rows.withColumn(name, F.collect_list(item).over(frame)).where("_blk = _home")
    own = F.struct(*order)
    rows = rows.withColumn(
        name, F.filter(F.array_sort(name), lambda x: F.struct(*[x[o].alias(o) for o in order]) >= own)
    )
    return rows.drop("_blk", "_home")


def following(
    df: DataFrame, key: Sequence[str], rank: str, field: str, n: int, name: str, *, width: int = ROWS
) -> DataFrame:
    """Add an array of ``field`` of this row and the next ``n`` by dense ``rank``; shorter at the end."""
    rows = _blocked(df, [rank], width).withColumn("_home", F.col("_blk"))
    near = F.col(rank) - F.col("_blk") * width < n
    rows = rows.withColumn(
        "_blk", F.explode(F.when(near, F.array("_blk", F.col("_blk") - 1)).otherwise(F.array("_blk")))
    )
    inside = _inside(key, [rank])
    ahead = F.array(field, *[F.lead(field, i).over(inside) for i in range(1, n + 1)])
    rows = rows.withColumn(name, ahead).where("_blk = _home")
    return rows.withColumn(name, F.filter(name, lambda x: x.isNotNull())).drop("_blk", "_home")


def first_beyond(probes: DataFrame, marks: DataFrame, key: Sequence[str], name: str, *, width: int = HOUR_MS) -> DataFrame:
    """For each probe (key, pos, threshold) the smallest mark pos whose level is greater than the threshold.

    ``marks`` is (key, pos, level) with level rising with pos. Both sides are merged on one axis and
    scanned once from the high end, so no pairs are formed.
    """
    probes, marks = cut(probes), cut(marks)
    axis = probes.select(
        *key, (-F.col("threshold")).alias("_o"), F.lit(0).alias("_k"), F.col("pos").alias("_id"),
        F.lit(None).cast("long").alias("_m"),
    ).unionByName(
        marks.select(
            *key, (-F.col("level")).alias("_o"), F.lit(1).alias("_k"), F.lit(None).cast("long").alias("_id"),
            F.col("pos").cast("long").alias("_m"),
        )
    )
    seen = _running(axis, key, ["_o", "_k"], {name: ("min", "_m")}, width=width)
    return seen.where("_k = 0").select(*key, F.col("_id").alias("pos"), name)


def _follow(entry: int, pos: np.ndarray, nxt: np.ndarray) -> list[int]:
    """Positions visited from ``entry`` while they stay inside the sorted array ``pos``."""
    jump = np.searchsorted(pos, nxt)
    jump[(jump < len(pos)) & (pos[np.minimum(jump, len(pos) - 1)] != nxt)] = len(pos)
    path, i = [], int(np.searchsorted(pos, entry))
    while i < len(pos):
        path.append(i)
        i = int(jump[i])
    return path


def _exits(pos: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Where a walk from each position leaves the array, by pointer doubling."""
    n = len(pos)
    out = nxt.copy()
    jump = np.searchsorted(pos, out)
    inside = (jump < n) & (pos[np.minimum(jump, n - 1)] == out)
    while inside.any():
        out[inside] = out[jump[inside]]
        jump = np.searchsorted(pos, out)
        inside = (jump < n) & (pos[np.minimum(jump, n - 1)] == out)
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _walk_dense(nxt: pd.Series) -> pd.Series:
    def walk(jump: np.ndarray) -> list[int]:
        path, i = [], 0
        while 0 <= i < len(jump):
            path.append(i)
            i = int(jump[i])
        return path

    return nxt.map(walk)


def chase(edges: DataFrame, key: Sequence[str], *, block: int = ROWS) -> DataFrame:
    """Rows (key, pos) on the path 0 -> nxt(0) -> nxt(nxt(0)) ... of each key.

    ``edges`` is (key, pos, nxt) with pos dense from 0 and nxt > pos; a null nxt ends the path. Keys of up to ``block``
    rows are walked directly. Longer ones are walked by levels: each block of positions is reduced
    to where a walk leaves it, the same again on the few surviving positions, and the path is then
    refined downwards, so no task ever holds more than about ``block`` positions of a key.
    """
    key = list(key)
    edges = cut(edges.select(*key, F.col("pos").cast("long"), F.coalesce("nxt", F.lit(-1)).cast("long").alias("nxt")))
    schema = edges.schema
    path_schema = T.StructType([*[schema[k] for k in key], T.StructField("pos", T.LongType())])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        entry = int(pdf["entry"].iloc[0])
        return pdf.iloc[_follow(entry, pdf["pos"].to_numpy(), pdf["nxt"].to_numpy())][[*key, "pos"]]

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pdf.assign(nxt=_exits(pdf["pos"].to_numpy(), pdf["nxt"].to_numpy()))[[*key, "pos", "nxt"]]

    size = edges.groupBy(*key).agg((F.max("pos") >= block).alias("_long"))
    # written tables look small, as their files are packed: none of them is to be broadcast, which the driver would have to hold
    tagged = edges.join(size.hint("merge"), key)
    # a short key's edges fit one small array; many of them share an Arrow batch
    short = tagged.where("NOT _long").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "nxt"))).alias("e"))
    done = short.select(*key, F.explode(_walk_dense(F.col("e.nxt"))).alias("pos"))
    long = tagged.where("_long").select(*key, "pos", "nxt")
    if not long.limit(1).count():
        return done

    def reduce_blocks(level: DataFrame, span: int) -> DataFrame:
        out = level.withColumn("_b", F.expr(f"pos div {span}")).groupBy(*key, "_b").applyInPandas(leave, schema)
        out = cut(out)
        roots = out.groupBy(*key).agg(F.min("pos").alias("pos"))
        nodes = out.select(*key, F.col("nxt").alias("pos")).where("pos >= 0").unionByName(roots).distinct()
        return cut(nodes.join(out.hint("merge"), [*key, "pos"]).select(*key, "pos", "nxt"))

    def refine(level: DataFrame, entries: DataFrame, span: int) -> DataFrame:
        first = entries.withColumn("_b", F.expr(f"pos div {span}")).groupBy(*key, "_b").agg(F.min("pos").alias("entry"))
        rows = level.withColumn("_b", F.expr(f"pos div {span}")).join(first.hint("merge"), [*key, "_b"])
        return rows.groupBy(*key, "_b").applyInPandas(walk, path_schema)

    nodes = reduce_blocks(long, block)
    hubs = reduce_blocks(nodes, block * block)
    top = hubs.withColumn("entry", F.lit(0).cast("long")).groupBy(*key).applyInPandas(walk, path_schema)
    mid = refine(nodes, top, block * block)
    return done.unionByName(refine(long, mid, block))


def spans_from_starts(rows: DataFrame, starts: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Number rows (key, pos) by the latest path start at or before them (0-based)."""
    # starts meet the rows on one axis, so no pairs are formed and rows move once
    marks = cut(starts).select(*key, "pos").withColumn("_s", F.lit(1))
    axis = rows.withColumn("_s", F.lit(0)).unionByName(marks, allowMissingColumns=True).withColumn("_first", -F.col("_s"))
    seen = _running(axis, key, ["pos", "_first"], {name: ("sum", "_s")}, width=ROWS)
    return seen.where("_s = 0").withColumn(name, F.col(name) - 1).drop("_s", "_first")
