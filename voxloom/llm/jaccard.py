"""N-gram Jaccard join with count-vector R-trees.

A text is the set of its distinct word shingles (64-bit hashes). Shingles are hashed into ``GROUPS`` groups; the numbers of a
set's shingles per group are its point. Two sets share at most the sum over groups of the smaller count, so a pair (or two
boxes of an R-tree) whose bound is below what the threshold asks for is dropped, and the pairs that survive are verified on the sets.

Points in that many dimensions spread too evenly for one tree over a corpus to prune anything, so the join first deals
the sets to cells without losing a pair: sets of like size are cut into more hash groups than two linked sets can differ in.
A group's shingles name a cell. Cells have one order for all sets, those of most shingles first; two linked sets differ
in at most d groups, so the first cell that they share is among the first d + 1 of both, and a set goes to these only.
A set with too few groups for that argument (only small ones) also goes to the cells of its first shingles in hash order,
as many as prefix filtering needs.

Only components are asked for, so a cell is not expanded into pairs: its sets are first verified against the cell's hub, the
set that shares the most cells with others (the text that copies were made from agrees with each of them more than they do with
one another), which joins most copies in linear work: each set first against the hub that it meets most often, then against
those hubs that are not yet in its component. A tree is built only in cells that still hold several components, in
blocks of at most ``BLOCK`` points, and looks only for pairs of different components. Sets of more shingles than ``GROUPS`` are also
counted in about as many groups as they have shingles; pairs that the tree finds must pass that closer bound too. Cells first
name a forest of their likeliest pairs, fewer than their sets; then every pair above the bound that still lies in two components is verified,
so no link between components is lost.

Edge cases: null texts and texts without words have no shingles and no links; a text with fewer words than a shingle is one
shingle; equal sets are one set (their documents are one component); repeated ids keep their rows; a null id counts as larger
than all ids; an empty table gives an empty result; extra columns are not touched.
Sets are named by 64-bit hashes: for 10**9 distinct sets the chance of any collision is about 3 in 100.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import in_slices, keep, mix, powers, utf8, words
from voxloom.llm.components import components

GROUPS = 128
LEAF = 16
BLOCK = 1_024
#: Names of sets that a task remembers.
REMEMBER = 200_000


def shingle_sets(column, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raw, offsets = utf8(column)
    _, _, row, hashes = words(raw, offsets, lower=True)
    ends = np.searchsorted(row, np.arange(len(offsets)))
    weights = powers(size + 1)
    with np.errstate(over="ignore"):
        n = max(len(hashes) - size + 1, 0)
        shingles = np.zeros(n, np.uint64)
        for k in range(size):
            shingles += hashes[k : n + k] * weights[k + 1]
        shingles = mix(shingles)
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a >= size:
                out.append(np.unique(shingles[a : b - size + 1]))
            elif b > a:
                out.append(mix(np.array([np.sum(hashes[a:b] * powers(size + 1)[1 : b - a + 1]) + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def name_of(s: np.ndarray) -> int:
    """64-bit name of a set, whatever the order of its members."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


class Schemes:
    """Size classes and, per class, the number of groups that two linked sets cannot differ in all of.

    Class k starts at ``starts[k]``; linked sets lie in one class or in neighbouring ones. Scheme k serves the pairs whose
    smaller set is in class k; its sets are those of class k and the sets of class k + 1 that a set of class k may be linked with.
    """

    def __init__(self, percent: int, largest: int):
        self.percent = percent
        self.starts = [1]
        while self.starts[-1] <= largest:
            self.starts.append(self.above(self.above(self.starts[-1])))
        self.starts.append(self.above(self.above(self.starts[-1])))

    def above(self, n: int) -> int:
        """The least size that no set of size n is linked with."""
        return n * 100 // self.percent + 1

    def apart(self, a: int, b: int) -> int:
        """Most shingles in which linked sets of these sizes can differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def groups(self, k: int) -> int:
        small = self.starts[k + 1] - 1
        most = self.apart(small, self.above(small) - 1)
        return most + 3 + most // 16

    def of(self, n: int) -> list[tuple[int, int]]:
        """The schemes of a set of n shingles, each with the number of groups in which a linked set can differ from it."""
        k = int(np.searchsorted(self.starts, n, "right")) - 1
        own = [(k, self.apart(n, self.above(n) - 1))]
        below = self.starts[k] - 1
        return [*own, (k - 1, self.apart(n, below))] if k and below * 100 >= self.percent * n else own


def cell_keys(s: np.ndarray, schemes: Schemes) -> np.ndarray:
    """Names of all cells of a set."""
    n = len(s)
    # no other set is linked with so small a one
    if not n or (n - 1) * 100 < schemes.percent * n and n * 100 < schemes.percent * (n + 1):
        return np.zeros(0, np.uint64)
    keys, weak = [], False
    with np.errstate(over="ignore"):
        content = mix(s ^ np.uint64(0x14057B7EF767814F))
        for k, differ in schemes.of(n):
            group = ((s >> np.uint64(8)) % np.uint64(schemes.groups(k))).astype(np.int64)
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            weak |= len(starts) <= differ
            name = mix(np.array([k * 0x9E3779B1 + 1], np.uint64)) + group[order][starts].astype(np.uint64)
            cells = mix(np.add.reduceat(content[order], starts) + mix(name))
            keys.append(cells[np.lexsort((cells, -np.diff(starts, append=n)))[: differ + 1]])
        if weak:
            first = n - (schemes.percent * n + 99) // 100 + 1
            keys.append(mix(s[:first] + np.uint64(0x2545F4914F6CDD1D)))
    return np.concatenate(keys)


def fine_groups(n: int) -> int:
    """Groups of the fine point of a set of n shingles: the more shingles, the more groups; always a multiple of ``GROUPS``."""
    return max(GROUPS, 1 << (max(n, 1).bit_length() - 1))


def fine_point(s: np.ndarray) -> bytes:
    """Counts of a set's shingles in ``fine_groups`` groups, one byte each, or two where one is too short."""
    counts = np.bincount((s % np.uint64(fine_groups(len(s)))).astype(np.int64), minlength=fine_groups(len(s)))
    return counts.astype("<u1" if counts.max(initial=0) < 256 else "<u2").tobytes()


def unfold(points: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Fine points as rows, folded to the least number of groups among them (a group of fewer is a sum of groups of more)."""
    least = fine_groups(int(sizes.min()))
    out = np.empty((len(points), least), np.uint16 if sizes.max() < 1 << 16 else np.int32)
    for k, (raw, n) in enumerate(zip(points, sizes.tolist(), strict=True)):
        groups = fine_groups(n)
        out[k] = np.frombuffer(raw, "<u1" if len(raw) == groups else "<u2").reshape(-1, least).sum(0)
    return out


def _frame(columns: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _lists(parts: list[np.ndarray], kind):
    import pyarrow as pa

    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


def _read(what: str, size: int, percent: int):
    """A function of Arrow batches (id, text) that gives names and sizes, cells, texts by name, or points."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schemes, seen = Schemes(percent, 1), set()
        for batch in in_slices(batches, 1 << 20):
            sets = shingle_sets(batch.column(1), size)
            names = pa.array([name_of(s) for s in sets], pa.int64())
            counts = pa.array([len(s) for s in sets], pa.int64())
            if what == "names":
                yield _frame({"_id": batch.column(0), "sid": names, "n": counts})
            elif what == "cells":
                longest = max(map(len, sets), default=1)
                if schemes.starts[-2] <= longest:
                    schemes = Schemes(percent, longest)
                # a task sends the cells of equal sets once, as long as it remembers them
                fresh = []
                for k, name in enumerate(names.to_pylist()):
                    if name not in seen:
                        seen.add(name)
                        fresh.append(k)
                if len(seen) > REMEMBER:
                    seen.clear()
                yield _frame({"sid": names.take(pa.array(fresh, pa.int64())), "cells": _lists([cell_keys(sets[k], schemes) for k in fresh], pa.int64())})
            elif what == "texts":
                yield _frame({"sid": names, "text": batch.column(1)})
            else:
                points = [np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS) for s in sets]
                fine = pa.array([fine_point(s) for s in sets], pa.binary())
                yield _frame({"sid": names, "n": counts, "point": _lists(points, pa.int32()), "fine": fine, "text": batch.column(1)})

    return run


def _linked(size: int, percent: int):
    """A function of Arrow batches (a, text of a, b, text of b) that gives the linked pairs (a, b)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in in_slices(batches, size=4 << 20):
            # rows come in runs of one b
            b = batch.column(2).to_numpy()
            heads = np.flatnonzero(np.concatenate([np.ones(1, bool), b[1:] != b[:-1]]))
            right = shingle_sets(batch.column(3).take(pa.array(heads)), size)
            of = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(b)))
            good = []
            for x, k in zip(shingle_sets(batch.column(1), size), of, strict=True):
                y = right[k]
                good.append(len(np.intersect1d(x, y, assume_unique=True)) * (100 + percent) >= (len(x) + len(y)) * percent)
            yield _frame({"a": batch.column(0), "b": batch.column(2)}).filter(pa.array(good))

    return run


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set names whose points' bound allows a link."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))
    bound = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    points = pairs.join(left, "a").join(right, "b")
    return points.where(bound * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs that are linked. Texts are moved, as they are smaller than their sets of hashes."""
    left = sets.select(F.col("sid").alias("a"), F.col("text").alias("ta"))
    right = sets.select(F.col("sid").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "ta", "b", "tb")
    return both.mapInArrow(_linked(size, percent), "a long, b long")


def tree_pairs(points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j whose bound allows a link, by a join of a packed R-tree over the points with itself."""
    order = np.lexsort((points.argmax(1), sizes))
    points, sizes = points[order], sizes[order]
    levels = [(points, points, sizes, sizes)]
    while len(levels[-1][0]) > 1:
        low, high, least, most = levels[-1]
        cut = np.arange(0, len(low), LEAF)
        levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)))
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for depth in range(len(levels) - 2, -1, -1):
        _, high, least, most = levels[depth]
        n = len(high)
        child = np.arange(LEAF)
        nexts = []
        for at in range(0, len(i), 256):
            a, b = (i[at : at + 256, None, None] * LEAF + child[None, :, None]), (j[at : at + 256, None, None] * LEAF + child[None, None, :])
            a, b = np.broadcast_arrays(a, b)
            a, b = a.ravel(), b.ravel()
            fit = (a < n) & (b < n) & ((a < b) if depth == 0 else (a <= b))
            a, b = a[fit], b[fit]
            fit = most[a] * 100 >= least[b] * percent
            a, b = a[fit], b[fit]
            bound = np.minimum(high[a], high[b]).sum(1)
            fit = bound * (100 + percent) >= (least[a] + least[b]) * percent
            nexts.append((a[fit], b[fit]))
        i, j = np.concatenate([x for x, _ in nexts]), np.concatenate([x for _, x in nexts])
    if len(levels) == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[i], order[j]


def cell_pairs(points: np.ndarray, sizes: np.ndarray, roots: np.ndarray, allowed, percent: int, forest: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of different roots whose bound on the fine points allows a link; as a ``forest``, only pairs that join roots not yet joined by
    pairs before them, those of the greatest bound first; and whether that left any out."""
    coarse = points.reshape(len(points), -1, GROUPS).sum(1, dtype=np.int32)
    i, j = tree_pairs(coarse, sizes, percent)
    good = (roots[i] != roots[j]) & allowed(i, j)
    i, j = i[good], j[good]
    step = max(1, (4 << 20) // points.shape[1])
    bound = np.concatenate([np.zeros(0, np.int64), *[np.minimum(points[i[k : k + step]], points[j[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(i), step)]])
    good = bound * (100 + percent) >= (sizes[i] + sizes[j]) * percent
    i, j, bound = i[good], j[good], bound[good]
    if not forest or not len(i):
        return i, j, False
    names, of = np.unique(roots, return_inverse=True)
    up = np.arange(len(names))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    kept = []
    for k in np.argsort(-bound * 2 / (sizes[i] + sizes[j]), kind="stable").tolist():
        x, y = top(of[i[k]]), top(of[j[k]])
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(k)
    return i[kept], j[kept], len(kept) < len(i)


def _search(percent: int, forest: bool):
    def run(key, frame):
        import pandas as pd

        frame = frame.drop_duplicates("sid")
        root, block, sid, n = (frame[c].to_numpy() for c in ("root", "block", "sid", "n"))
        # pairs of one block are looked for where that block stands alone
        allowed = lambda i, j: (block[i] != block[j]) | (key[1] == key[2])
        i, j, more = cell_pairs(unfold(frame["fine"].tolist(), n), n, root, allowed, percent, forest)
        i, j = sid[i], sid[j]
        found = pd.DataFrame({"a": np.maximum(i, j), "b": np.minimum(i, j)}, dtype="Int64").assign(open=pd.array([None] * len(i), "Int64"))
        # a cell that held more pairs than its forest is looked at again
        return pd.concat([found, pd.DataFrame({"a": [None], "b": [None], "open": [int(key[0])]}, dtype="Int64")]) if more else found

    return run


def _rest(cells: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs of different components that cells still hold, from R-trees over blocks of their points; a forest of them is fewer than the sets."""
    rows = cells.join(roots, cells["sid"] == roots["node"], "left").select("cell", "sid", F.coalesce("root", "sid").alias("root")).distinct()
    facts = rows.groupBy("cell").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum(F.shiftright(F.xxhash64("sid"), 24)).alias("h1"), F.bit_xor(F.xxhash64("sid")).alias("h2")
    )
    # cells with the same members need one look
    facts = facts.where("lo <> hi").groupBy("m", "h1", "h2").agg(F.min("cell").alias("cell"))
    blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    rows = rows.join(facts.select("cell", blocks.alias("blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cell", "sid", "root", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    rows = rows.join(sets.select("sid", "n", "fine"), "sid")
    return rows.groupBy("cell", "x", "y").applyInPandas(_search(percent, forest), "a long, b long, open long").distinct()


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    if links.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links))


def jaccard_components(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_shingles`` and ``component_id``, the smallest id reachable by links, itself included.

    Two texts are linked when 100 * shared shingles >= ``percent`` * all their shingles.
    """
    slim = df.select(F.col(id_col).alias("_id"), text_col)
    kind = slim.schema["_id"].dataType.simpleString()
    docs = keep(slim.mapInArrow(_read("names", size, percent), f"_id {kind}, sid long, n long"))
    cells = slim.mapInArrow(_read("cells", size, percent), "sid long, cells array<long>").select(F.explode("cells").alias("cell"), "sid")
    one = Window.partitionBy("cell")
    cells = keep(cells.withColumn("low", F.min("sid").over(one)).withColumn("top", F.max("sid").over(one)).where("low <> top").select("cell", "sid").distinct())

    # sets in cells with others: one text of each
    texts = slim.mapInArrow(_read("texts", size, percent), "sid long, text string").dropDuplicates(["sid"])
    texts = texts.join(cells.select("sid").distinct(), "sid", "left_semi").select("sid", "text")
    sets = keep(texts.mapInArrow(_read("sets", size, percent), "sid long, n long, point array<int>, fine binary, text string"))

    shared = cells.groupBy("sid").agg(F.count(F.lit(1)).alias("shared"))
    hubs = cells.join(shared, "sid").groupBy("cell").agg(F.max(F.struct("shared", "sid")).alias("hub")).select("cell", F.col("hub.sid").alias("hub"))
    stars = cells.join(hubs, "cell").where("sid <> hub")
    stars = keep(stars.groupBy(F.col("sid").alias("a"), F.col("hub").alias("b")).agg(F.count(F.lit(1)).alias("times")))
    # first the hub that a set meets most often, then the others that are not joined with it by now: most texts move once
    best = keep(stars.groupBy("a").agg(F.max(F.struct("times", "b")).alias("best")).select("a", F.col("best.b").alias("b")))
    roots = components(keep(_verified(_likely(best, sets, percent), sets, size, percent)))
    ra, rb = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    others = stars.select("a", "b").join(best, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left")
    others = others.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    roots = _joined(roots, keep(_verified(_likely(others, sets, percent), sets, size, percent)))
    # what the hubs left: first the likeliest links of each cell, then every pair that they did not join
    first = keep(_rest(cells, roots, sets, percent, True))
    roots = _joined(roots, keep(_verified(first.where("open IS NULL").select("a", "b"), sets, size, percent)))
    left = cells.join(first.where("open IS NOT NULL").select(F.col("open").alias("cell")).distinct(), "cell", "left_semi")
    roots = _joined(roots, keep(_verified(_rest(left, roots, sets, percent, False).select("a", "b"), sets, size, percent)))

    named = docs.join(roots, docs["sid"] == roots["node"], "left").select("_id", "n", F.coalesce("root", "sid").alias("root"))
    linked = named.where("n > 0")
    least = linked.groupBy("root").agg(F.min("_id").alias("least"))
    done = linked.join(least, "root").select("_id", "n", "least").unionAll(named.where("n = 0").select("_id", "n", F.col("_id").alias("least")))
    return done.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "_id").alias("component_id"))


def one_of_each(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: of each component the row with the smallest id. Rows without id stay.

    Rows that share an id go only if all of them would, so that no text is lost with another that has its id.
    """
    found = jaccard_components(df, size, percent, id_col, text_col)
    gone = found.groupBy(F.col(id_col).alias("_gone")).agg(F.bool_and(F.col(id_col) != F.col("component_id")).alias("_all")).where("_all").select("_gone")
    return df.join(gone, df[id_col] == gone["_gone"], "left_anti")
