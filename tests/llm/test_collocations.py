"""Phrases against counting all n-grams in Python, and the index against scanning the text."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from voxloom.llm import collocations

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def by_hand(rows, least, cover, most):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = lambda s, o: any(o[i : i + len(s)] == s for i in range(len(o) - len(s) + 1))
    out = {}
    for (lang, g), a in cand.items():
        if any(lang == lo and len(o) > len(g) and 100 * b >= cover * a and inside(g, o) for (lo, o), b in cand.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:most]))


def rows_of(seed, n=250):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "sat", "on", "a", "mat", "é", "É", "x\x01", "x", "日本", "b\x00c", "rare1", "rare2"]
    fixed = ["the cat sat on a mat", "new york city hall", "a b a b a b a", "x x x x x x"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 6))]
        rows.append((rng.choice([". ", " ", ", ", "\n", "\t", "?!", " \x0b"]).join(parts), rng.choice(["en", "de", None, "und", ""])))
    return [*rows, (None, "en"), ("", None), (" \t.,", "de"), rows[0], rows[0]]


@pytest.mark.parametrize("bits", [28, 15])
@pytest.mark.parametrize(("seed", "least", "cover", "most", "shard"), [(1, 5, 80, 2000, 300), (2, 3, 80, 7, 50), (3, 30, 60, 2000, 10**6)])
def test_phrases_equal_counting(spark, monkeypatch, bits, seed, least, cover, most, shard):
    monkeypatch.setattr(collocations, "MOST_BITS", bits)
    rows = rows_of(seed)
    df = spark.createDataFrame([(t, lang, "s", 1) for t, lang in rows], "text string, lang string, shard string, n int").repartition(3)
    got = collocations.top(df, most, least=least, cover=cover, shard_words=shard).collect()
    want = by_hand(rows, least, cover, most)
    assert sorted(tuple(r)[:8] for r in got) == want
    assert len(want) > 5


def test_no_documents(spark):
    for rows in ([], [(None, None)], [("only once here", "en")]):
        assert collocations.top(spark.createDataFrame(rows, "text string, lang string")).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_intervals_hold_all_occurrences(seed):
    rng = np.random.default_rng(seed)
    width = int(rng.integers(3, 9))
    t = np.append(rng.integers(0, width, 400), 0)
    index = collocations.Index.__new__(collocations.Index)
    index.t, index.width, index.numbers = t, width, np.arange(width)
    index.bwt, index.step = collocations.transform(t, width)
    counts = np.bincount(t, minlength=width)
    index.low, index.count = (np.cumsum(counts) - counts)[1:], counts[1:]
    grams = lambda m: Counter(tuple(t[i : i + m].tolist()) for i in range(len(t) - m + 1) if t[i : i + m].all())
    a, b, n, _, _ = index.pairs()
    assert dict(zip(zip(a.tolist(), b.tolist()), n.tolist())) == grams(2)
    three, n3, four, n4 = index.longer(np.sort(a * width + b))
    assert dict(zip(map(tuple, three.tolist()), n3.tolist())) == grams(3)
    assert dict(zip(map(tuple, four.tolist()), n4.tolist())) == grams(4)
    index.bwt, index.step = collocations.transform(t, width)
    often = np.flatnonzero(n >= 4)
    known = set(zip(a[often].tolist(), b[often].tolist()))
    three, n3, four, n4 = index.longer(np.sort((a * width + b)[often]))
    held = lambda m: {g: c for g, c in grams(m).items() if all(g[i : i + 2] in known for i in range(m - 1))}
    assert dict(zip(map(tuple, three.tolist()), n3.tolist())) == held(3) and dict(zip(map(tuple, four.tolist()), n4.tolist())) == held(4)
