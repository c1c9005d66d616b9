"""Packing: every id in exactly one place, little padding, and the least-squares plan by its optimality conditions."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxloom.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(spark, df, window, last=2):
    lib = Tokenizer.from_file(WORDS)
    packed = packing.pack(df, WORDS, window, last)
    pieces = [r.asDict() for r in packed.pieces.collect()]
    keyed = {(r.task, r.seq): r for r in packed.documents.collect()}
    ids = {k: np.frombuffer(r.ids, f"<u{r.width}").tolist() for k, r in keyed.items()}
    want = sorted((r.doc_id is None, r.doc_id, tuple(lib.encode(r.text or "", add_special_tokens=False).ids + ([last] if last is not None else []))) for r in df.select("doc_id", "text").collect())
    assert sorted((keyed[k].doc_id is None, keyed[k].doc_id, tuple(v)) for k, v in ids.items()) == want
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        key = p["task"], p["seq"]
        assert p["doc_id"] == keyed[key].doc_id and p["doc_tokens"] == len(ids[key]) and p["length"] > 0
        assert p["ids_crc32"] == crc(ids[key][p["start"] : p["start"] + p["length"]])
        by_doc[key].append((p["start"], p["start"] + p["length"]))
        by_seq[p["sequence_id"]].append((p["offset"], p["offset"] + p["length"], ids[key][p["start"] : p["start"] + p["length"]]))
    for key, v in ids.items():
        spans = sorted(by_doc[key])
        assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]][: len(spans)] and (spans[-1][1] if spans else 0) == len(v)
    sizes = []
    for spans in by_seq.values():
        spans.sort(key=lambda s: s[:2])
        assert [s[0] for s in spans] == [0, *[s[1] for s in spans[:-1]]] and spans[-1][1] <= window
        sizes.append(spans[-1][1])
    assert sorted(by_seq) == list(range(len(by_seq)))
    got = {r.sequence_id: r.ids for r in packing.sequences(packed, window, -1).collect()}
    for k, spans in by_seq.items():
        flat = [i for s in spans for i in s[2]]
        power = len(flat) & (len(flat) - 1) == 0
        assert got[k] == flat + [-1] * (0 if power else window - len(flat))
    padding = sum(window - s for s in sizes if s & (s - 1))
    return padding, sum(sizes), len(sizes)


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    for window in (4096, 256):
        padding, tokens, n = check(spark, df, window)
        assert padding <= max(window, 0.02 * tokens) and n >= tokens / window


def test_equal_short_and_awkward_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 128)
    monkeypatch.setattr(packing, "GROUP", 2)
    rows = [(i, "one two three four five six seven eight nine", 1, "x", 5) for i in range(400)]
    rows += [(1000, None, 1, "x", 5), (1001, "", 2, None, 5), (1002, "word " * 3000, 2, "", 5), (1002, "word " * 3000, 2, "", 5), (None, "no id", 3, "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, task int, sequence string, bin int").repartition(3)
    padding, tokens, _ = check(spark, df, 64)
    assert padding <= 0.05 * tokens
    check(spark, df, 64, None)
    assert packing.pack(df.limit(0), WORDS, 64).pieces.collect() == []
    check(spark, df.where("doc_id = 1001"), 64)


@pytest.mark.parametrize("seed", range(4))
def test_least_squares(seed):
    rng = np.random.default_rng(seed)
    table = packing.combinations(16)
    assert (table.T @ np.arange(1, 17) == 16).all() and len(set(map(tuple, table.T))) == table.shape[1]
    b = rng.integers(0, 1000, 16).astype(float)
    x = packing.nnls(table.astype(float), b)
    slope = table.T @ (b - table @ x)
    # optimal: no improvement in any direction that is allowed
    assert (x >= 0).all() and (slope <= 1e-6 * b.max()).all() and np.abs(slope[x > 0]).max(initial=0) <= 1e-6 * b.max()
    counts = rng.integers(0, 50, 16)
    tokens = counts * (np.arange(1, 17) * 4 - 2)
    times = packing.repeats(counts, tokens, 4, table)
    assert (times >= 0).all() and (table @ times <= counts).all()
