"""Centroid clustering of integer vectors with ns-bounds.

Every vector carries its distance to its own centroid and a lower bound of its distance to each other one, each with the round in which
it was computed. The history of all centroids is kept, so a bound of an earlier round is loosened by the norm of the centroid's total
displacement since then; that norm is never larger than the sum of the per-round drifts. A vector whose loosened own distance is
below all its loosened lower bounds keeps its centroid unseen. Otherwise its own distance is computed exactly, and then the
distance to each centroid whose bound still fails. Bounds are floating-point numbers with a margin; every decision that they leave
open is taken on exact integers.

A round is one pass over the written vectors and their bounds. Centroids move by the vectors that changed only: tasks add up
their components, Spark adds the tasks' sums, and ``clusters x components`` numbers reach the driver, whatever the table's size.

Edge cases: vectors of another length, null vectors and vectors with null or non-finite components are left out; repeated rows count as
often as they occur; a null id is taken as the empty text where ids are hashed; equal hashes are ordered by the vector; with fewer vectors
than clusters there are as many centroids as vectors; an empty table gives an empty result; a distance or inertia beyond 64 bits is
null (clusters stay exact: such batches are computed with Python's integers); extra columns are not touched.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import keep

SCALE = 64
#: Components below this are computed with 64-bit integers: 4,096 squares of their differences stay below 2**63.
FAST = 1 << 24
LIMB = 60
#: Relative and absolute margin of the floating-point bounds.
EPS = 1e-9
_MOST = 2**63 - 1


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles, as 64-bit integers or, where those are too short, as Python's."""
    if not len(values) or np.abs(values).max() * SCALE < FAST:
        return np.floor(SCALE * values).astype(np.int64)
    # from 2**53 on a double is an integer itself
    whole = [int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(SCALE * v) for v in values.ravel().tolist()]
    return np.array(whole, object).reshape(values.shape)


def _table(centroids: list[list[int]]) -> np.ndarray:
    big = any(abs(v) >= FAST for c in centroids for v in c)
    return np.array(centroids, object if big else np.int64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return (d * d).sum(-1) if d.dtype == object else np.einsum("...i,...i->...", d, d)


def _root(exact: np.ndarray) -> np.ndarray:
    if exact.dtype != object:
        return np.sqrt(exact.astype(np.float64))
    out = []
    for v in exact.ravel().tolist():
        try:
            out.append(float(math.isqrt(v)))
        except OverflowError:
            out.append(math.inf)
    return np.array(out).reshape(exact.shape)


def moved(history: list[list[list[int]]]) -> np.ndarray:
    """Norm of each centroid's total displacement from each round of the history to the last: [round, centroid]."""
    last = _table(history[-1])
    return np.stack([_root(squares(_table(h), last)) for h in history])


def nearest(x: np.ndarray, centroids: np.ndarray, shift: np.ndarray, state: dict | None) -> tuple[dict, int]:
    """State of a batch after the last round of the history, and how many distances were computed for it.

    ``shift`` is what ``moved`` gives; the state holds ``cluster``, ``upper`` of round ``at``, ``lower`` of rounds ``since``.
    """
    n, k, now = len(x), len(centroids), len(shift) - 1
    if state is None:
        exact = np.stack([squares(x, c) for c in centroids], 1) if n else np.zeros((0, k), np.int64)
        own = exact.argmin(1) if n else np.zeros(0, np.int64)
        roots = _root(exact)
        return {"cluster": own, "upper": roots[np.arange(n), own], "at": np.full(n, now), "lower": roots, "since": np.full((n, k), now)}, n * k
    own, rows, cols = state["cluster"].copy(), np.arange(n), np.arange(k)
    upper, at, lower, since = state["upper"].copy(), state["at"].copy(), state["lower"].copy(), state["since"].copy()
    above = (upper + shift[at, own]) * (1 + EPS) + EPS
    below = (lower - shift[since, cols]) * (1 - EPS) - EPS
    below[rows, own] = np.inf
    bad = np.flatnonzero(~(above[:, None] < below).all(1))
    if not len(bad):
        return {"cluster": own, "upper": upper, "at": at, "lower": lower, "since": since}, 0
    mine = squares(x[bad], centroids[own[bad]])
    upper[bad], at[bad] = _root(mine), now
    open_ = ~((upper[bad] * (1 + EPS) + EPS)[:, None] < below[bad])
    r, c = np.nonzero(open_)
    exact = squares(x[bad[r]], centroids[c])
    lower[bad[r], c], since[bad[r], c] = _root(exact), now
    # what was not computed is farther than the own centroid
    best = np.full((len(bad), k), None if exact.dtype == object or mine.dtype == object else _MOST, object if exact.dtype == object or mine.dtype == object else np.int64)
    best[r, c] = exact
    best[np.arange(len(bad)), own[bad]] = mine
    if best.dtype == object:
        new = np.array([min((d, j) for j, d in enumerate(row) if d is not None)[1] for row in best], np.int64)
    else:
        new = best.argmin(1)
    old = own[bad]
    lower[bad, old], since[bad, old] = upper[bad], now
    own[bad] = new
    upper[bad] = _root(best[np.arange(len(bad)), new])
    return {"cluster": own, "upper": upper, "at": at, "lower": lower, "since": since}, len(bad) + len(r)


def _matrix(column, dim: int, kind=np.float64) -> np.ndarray:
    return np.asarray(column.flatten(), kind).reshape(len(column), dim)


def _lists(values: np.ndarray, kind):
    import pyarrow as pa

    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(values.ravel(), kind))


def _round(history: list, dim: int, first: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        centroids, shift = _table(history[-1]), moved(history)
        k = len(centroids)
        for b in batches:
            x, state = integers(_matrix(b.column("x"), dim)), None
            was = np.full(len(x), -1)
            if not first:
                was = np.asarray(b.column("cluster")).astype(np.int64)
                state = {
                    "cluster": was, "upper": np.asarray(b.column("upper")), "at": np.asarray(b.column("at")).astype(np.int64),
                    "lower": _matrix(b.column("lower"), k), "since": _matrix(b.column("since"), k, np.int64),
                }
            s, looked = nearest(x, centroids, shift, state)
            share = np.zeros(len(x), np.int64)
            share[:1] = looked
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id"), b.column("x"), pa.array(s["cluster"], pa.int32()), pa.array(was, pa.int32()), pa.array(s["upper"], pa.float64()),
                    pa.array(s["at"], pa.int32()), _lists(s["lower"], pa.float64()), _lists(s["since"], pa.int32()), pa.array(share, pa.int64()),
                ],
                ["vec_id", "x", "cluster", "was", "upper", "at", "lower", "since", "looked"],
            )

    return run


def _sums(dim: int):
    """Per task: component sums of the vectors that a cluster won less those that it lost, in limbs of ``LIMB`` bits; component -1 counts them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict = defaultdict(lambda: np.zeros(dim + 1, object))
        for b in batches:
            x = integers(_matrix(b.column("x"), dim))
            for name, sign in (("cluster", 1), ("was", -1)):
                of = np.asarray(b.column(name))
                for j in np.unique(of[of >= 0]).tolist():
                    got = x[of == j]
                    total[j][:dim] += sign * got.sum(0).astype(object)
                    total[j][dim] += sign * len(got)
        rows = []
        for j, values in total.items():
            for i, v in enumerate(values.tolist()):
                limb, v = 0, int(v)
                while True:
                    last = -(1 << LIMB) <= v < 1 << LIMB
                    rows.append((j, i if i < dim else -1, limb, v if last else v & ((1 << LIMB) - 1)))
                    if last:
                        break
                    limb, v = limb + 1, v >> LIMB
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "i", "limb", "v"])

    return run


def _distance(centroids: list, dim: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = _table(centroids)
        for b in batches:
            own = np.asarray(b.column("cluster"))
            exact = squares(integers(_matrix(b.column("x"), dim)), table[own])
            values = [v if v <= _MOST else None for v in exact.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("cluster"), pa.array(values, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def vectors(df: DataFrame, dim: int, id_col: str, vec_col: str) -> DataFrame:
    """(``vec_id``, ``x``) of the rows that count, components as doubles."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dim)).where(~bad).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def cluster(
    df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, seed: str = "1", id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(``vec_id``, ``cluster``, ``distance``) of every vector, the final centroids, and the distances computed per assignment.

    Centroids start as the ``k`` vectors of smallest SHA-256 of ``seed:id``; ``rounds`` rounds and one more assignment follow.
    """
    base = keep(vectors(df, dim, id_col, vec_col))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = base.select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    kind = base.schema["vec_id"].dataType.simpleString()
    if not start:
        return base.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), [], []
    history = [[list(map(int, integers(np.array([r["x"]]))[0].tolist())) for r in start]]
    schema = f"vec_id {kind}, x array<double>, cluster int, was int, upper double, at int, lower array<double>, since array<int>, looked long"
    state, looked = base, []
    sums, sizes = defaultdict(int), defaultdict(int)
    for r in range(rounds + 1):
        state = keep(state.mapInArrow(_round(history, dim, r == 0), schema))
        looked.append(state.agg(F.sum("looked")).first()[0])
        if r == rounds:
            break
        parts = state.where("cluster <> was").select("x", "cluster", "was").mapInArrow(_sums(dim), "cluster int, i int, limb int, v long")
        for c, i, limb, v in parts.groupBy("cluster", "i", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect():  # k x components numbers
            if i < 0:
                sizes[c] += int(v) << (LIMB * limb)
            else:
                sums[c, i] += int(v) << (LIMB * limb)
        history.append([[sums[j, i] // sizes[j] for i in range(dim)] if sizes[j] else c for j, c in enumerate(history[-1])])
    out = state.select("vec_id", "x", "cluster").mapInArrow(_distance(history[-1], dim), f"vec_id {kind}, cluster int, distance long")
    return out, history[-1], looked


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Add ``cluster_inertia``, ``inertia`` and ``centroid_sha256``; a sum that holds a distance beyond 64 bits is null."""
    found = keep(found)
    whole = F.when(F.count(F.when(F.col("distance").isNull(), 1)) == 0, F.sum(F.col("distance").cast("decimal(38,0)")))
    per = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(whole.alias("s")).collect()}  # one row per cluster
    fits = lambda v: int(v) if v is not None and v <= _MOST else None
    total = None if None in per.values() else sum(per.values())
    rows = [(j, fits(per[j]), fits(total), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j in per]
    facts = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """The same in SQL, every centroid looked at in every round."""
    parts = [
        f"""v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT rid, arg_min(j, (d, j)) AS j, min(d) AS d FROM
  (SELECT rid, c.j, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r} c) GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT j, i, sum(e) AS s, count(*) AS n FROM (SELECT j, unnest(range(1, {dim + 1})) AS i, unnest(x) AS e FROM v JOIN a{r} USING (rid)) GROUP BY j, i),
m{r} AS (SELECT j, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY j),
c{r + 1} AS (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (j))""")
    r = rounds
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM v JOIN a{r} USING (rid) JOIN c{r} c USING (j)"""
    )
