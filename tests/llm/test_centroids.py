"""Clustering with ns-bounds against plain rounds over Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from voxloom.llm import centroids


def rounds_by_hand(rows, k, rounds):
    """{(id, vector): cluster}, final centroids; every distance looked at in every round."""
    x = [tuple(math.floor(64 * v) if abs(v) < 2**53 else int(v) * 64 for v in v_) for _, v_ in rows]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"1:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    c = [list(x[i]) for i in order[:k]]
    near = lambda p: min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(p, c[j])), j))
    for _ in range(rounds):
        own = [near(p) for p in x]
        for j in range(len(c)):
            mine = [p for p, o in zip(x, own) if o == j]
            if mine:
                c[j] = [sum(v) // len(mine) for v in zip(*mine)]
    own = [near(p) for p in x]
    return own, c, [sum((a - b) ** 2 for a, b in zip(p, c[o])) for p, o in zip(x, own)]


def run(spark, rows, k, rounds, dim):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, x int").repartition(3)
    found, middles, looked = centroids.cluster(df, k, rounds, dim)
    return [(r.vec_id, r.cluster, r.distance) for r in found.collect()], middles, looked


@pytest.mark.parametrize("kind", ["plain", "grid", "huge"])
def test_clusters_equal_plain_rounds(spark, kind):
    rng = random.Random(len(kind))
    draw = {"plain": lambda: rng.gauss(0, 1), "grid": lambda: rng.randrange(3) / 64, "huge": lambda: rng.choice([1e30, -3e38, 2.0**60, 0.3])}[kind]
    good = [(i, tuple(draw() for _ in range(4))) for i in range(300)]
    good += good[:5] + [(None, (0.1, 0.2, 0.3, 0.4))] + [(1000 + i, (0.5, 0.5, 0.5, 0.5)) for i in range(150)]
    bad = [(5000, None), (5001, (1.0,)), (5002, (1.0, None, 1.0, 1.0)), (5003, (1.0, float("nan"), 1.0, 1.0)), (5004, (float("inf"),) * 4), (5005, ())]
    got, middles, looked = run(spark, [(i, list(v) if v is not None else None, "c", 7) for i, v in good + bad], 8, 4, 4)
    own, c, d = rounds_by_hand(good, 8, 4)
    assert middles == c
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    want = [(i, o, e if e < 2**63 else None) for (i, _), o, e in zip(good, own, d)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert looked[0] == 8 * len(good)
    if kind == "plain":
        assert all(n < looked[0] for n in looked[1:])


def test_bounds_use_total_displacement():
    # a centroid that goes forth and back has moved by nothing, whatever the sum of its drifts
    history = [[[0, 0], [100, 0]], [[30, 0], [100, 0]], [[0, 0], [100, 0]]]
    shift = centroids.moved(history)
    assert shift[0].tolist() == [0, 0] and shift[1].tolist() == [30, 0]
    x = np.array([[10, 0], [45, 0]])
    state, _ = centroids.nearest(x, np.array(history[0]), centroids.moved(history[:1]), None)
    after, looked = centroids.nearest(x, np.array(history[2]), shift, state)
    assert looked == 0 and after["cluster"].tolist() == [0, 0]
    # one round earlier the second vector's bounds fail; its own exact distance settles it
    after, looked = centroids.nearest(x, np.array(history[1]), centroids.moved(history[:2]), state)
    assert looked == 1 and after["cluster"].tolist() == [0, 0]


def test_few_and_no_vectors(spark):
    got, middles, _ = run(spark, [(1, [0.5, 0.5], None, None), (2, [0.1, 0.1], None, None)], 5, 2, 2)
    assert sorted(got) == sorted((i, next(j for j, m in enumerate(middles) if m == v), 0) for i, v in ((1, [32, 32]), (2, [6, 6])))
    got, middles, _ = run(spark, [], 5, 2, 2)
    assert got == [] and middles == []
