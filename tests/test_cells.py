"""Recordings that are one row each: repeats against the operators on rows of words, and what the queries on them move."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.catalog import QUERIES
from voxloom.functions import text as tx
from voxloom.operators import timeline as tl
from voxloom.operators import transcript as tr
from voxloom.session import shared_dir
from voxloom.sources.derive import doc_lines, line_words

SF = "/root/testdata/sf0.001"
MS = 1_000_000


def texts():
    rng = random.Random(5)
    vocab = ["the", "Area", "is", "--", "2", "pi", "r²,", "(known)", "as", "word", "!", "so"]
    out = [None, "", " \n\n ", "... -- !", "a b c d e f g h\na b c d e f g h"]
    for _ in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randrange(1, 40))]
        for _ in range(rng.randrange(4)):
            at, n = rng.randrange(len(words)), rng.randrange(1, 25)
            words[at:at] = words[at : at + n] * rng.randrange(1, 4)
        out.append("".join(w + rng.choice([" ", " ", "  ", "\t", "\n", "\n\n"]) for w in words))
    return list(enumerate(out))


def plain_collapse(tokens, least):
    kept, edits = list(range(len(tokens))), []
    while True:
        for size in range(least, len(kept) // 2 + 1):
            same = lambda i, j: [tokens[k] for k in kept[i : i + size]] == [tokens[k] for k in kept[j : j + size]]
            at = next((i for i in range(len(kept) - 2 * size + 1) if same(i, i + size)), None)
            if at is not None:
                break
        else:
            return kept, edits
        copies = 2
        while at + size * (copies + 1) <= len(kept) and same(at, at + size * copies):
            copies += 1
        a, b = at + size, at + size * copies
        edits.append((kept[at], kept[a], kept[b - 1], copies))
        del kept[a:b]


def test_cells_equal_rows(spark):
    d = spark.createDataFrame(texts(), "job_id long, text string").repartition(3)
    w = d.select("job_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    w = w.select("job_id", "line", F.posexplode(tx.tokens("t")).alias("p", "text"))
    start = F.col("line").cast("long") * MS + 100 * (F.col("p") + 1)
    w = w.select("job_id", F.col("line").cast("string").alias("segment_id"), F.col("p").cast("long").alias("pos"), "text", start.alias("start_ms"), (start + 80).alias("end_ms"))
    rows = tr.repeat_islands(w, width=4 * MS).where("island IS NOT NULL AND tok <> ''")
    rows = rows.groupBy("job_id", "island").agg(F.min("rn").alias("first_rank"), F.max("rn").alias("last_rank"))
    cells = tr.islands_in_cells(d, line_words("text"))
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, rows.collect())) and cells.count() > 20
    kept, edits = tr.collapse_repeats(w, width=4 * MS)
    got = tr.collapse_in_cells(d, line_words("text"))
    e = got.select("job_id", F.inline("edits")).select(
        "job_id", "retained_rn", "edit_no", "copies", "phrase_words", F.array_join(F.col("segments").cast("array<string>"), "|").alias("s"), "first", "last"
    )
    e = {(*r[:6], r.first.segment * MS + 100 * (r.first.word + 1), r.last.segment * MS + 100 * (r.last.word + 1) + 80) for r in e.collect()}
    want = edits.select("job_id", "retained_rn", "edit_no", "copies", "phrase_words", "removed_segment_ids", "removed_start_ms", "removed_end_ms")
    assert e == set(map(tuple, want.collect())) and len(e) > 20
    gone = got.select("job_id", F.posexplode("gone").alias("segment_id", "g")).select("job_id", F.col("segment_id").cast("string"), F.explode(F.col("g").cast("array<long>")).alias("pos"))
    removed = w.select("job_id", "segment_id", "pos").exceptAll(kept.select("job_id", "segment_id", "pos"))
    assert sorted(map(tuple, gone.collect())) == sorted(map(tuple, removed.collect()))


def test_collapse_equals_plain_loop():
    rng = np.random.default_rng(3)
    for n in (0, 5, 16, 30, 60, 90):
        for k in range(20):
            tokens = rng.integers(1, 4, n)
            tokens = np.tile(tokens, 3)[rng.integers(0, 5) :] if k % 2 else tokens
            kept, edits = tr._collapse(tokens, 4)
            assert (kept.tolist(), edits) == plain_collapse(tokens.tolist(), 4)


@pytest.mark.parametrize("name", ["repeat_islands", "collapse_repeats", "collapsed_segments"])
def test_repeats_move_no_words(spark, name):
    before = {d for d, _, _ in os.walk(shared_dir(spark).removeprefix("file:"))}
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # only whole documents of a single file are dealt out, and nothing is written on the way
    assert plan.count("Exchange") <= 1 and "Join" not in plan and "Window" not in plan
    assert {d for d, _, _ in os.walk(shared_dir(spark).removeprefix("file:"))} == before


def test_lines_need_no_groups(spark):
    plan = doc_lines(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") <= 1 and "RoundRobin" not in plan


def test_tables_are_dealt_out_without_sorting_words(spark, monkeypatch, tmp_path):
    from voxloom.sources import derive

    turns = [(c, t, " ".join(["so,", "word", "end."][: t % 4] * (1 + c))) for c in range(3) for t in range(9)]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").withColumn("role", F.lit("user")).write.parquet(f"{tmp_path}/conversations.parquet")
    w = derive._BUILDERS["words"](spark, str(tmp_path))
    plan = w._jdf.queryExecution().executedPlan().toString()
    # turns move, words do not: nothing above the step that makes words of turns
    assert "Exchange" not in plan[: plan.index("Generate")] and "RoundRobin" not in plan
    got = {(r.job_id, r.chunk_id, r.pos): (r.text, r.start_ms, r.end_ms) for r in w.collect()}
    want = {}
    for c in range(3):
        base = 0
        for t in range(9):
            at = base + 3000 * t
            for pos, x in enumerate(turns[9 * c + t][2].split(), start=1):
                want[c, t, pos] = (x, at, at + 60 * len(x) + 40)
                gap = 600 + 150 * (pos % 7) if x.endswith(".") else 280 if x.endswith(",") else 900 if pos % 41 == 0 else 20 * (pos % 4)
                at, base = at + 60 * len(x) + 40 + gap, base + 60 * len(x) + 40 + gap
    assert got == want


def test_documents_in_almost_as_many_splits_as_cores_are_not_moved(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    d = spark.createDataFrame([(k, f"one {k}\ntwo") for k in range(cores * 2)], "doc_id long, text string")
    for files, moves in ((cores - 1, False), (cores, False), (1, True)):
        d.repartitionByRange(files, "doc_id").write.parquet(f"{tmp_path}/{files}/documents.parquet")
        out = QUERIES["normalize_spoken"](spark, f"{tmp_path}/{files}")
        assert ("Exchange" in out._jdf.queryExecution().executedPlan().toString()) == moves
        assert out.count() == cores * 4


def test_totals_of_recordings_move_no_cues(spark):
    cues = spark.createDataFrame([(1, 100, 200, "a"), (1, 300, 400, "b"), (2, 0, 50, "c"), (4, 0, 9, "e"), (None, 0, 5, "d")], "job_id long, start_ms long, end_ms long, cue_id string")
    totals = spark.createDataFrame([(1, 450), (2, 50), (3, 70), (5, 0), (None, 80)], "job_id long, total_duration_ms long")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        moved = [tl.speech_gaps(cues, t)._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") for t in (None, totals)]
        assert moved[1] - moved[0] == 1
        got = {tuple(r) for r in tl.speech_gaps(cues, totals).select("job_id", "position", "start_ms", "end_ms", "preceding_cue_id", "following_cue_id").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {
        (1, "before_first", 0, 100, None, "a"), (1, "between_speech", 200, 300, "a", "b"), (1, "after_last", 400, 450, "b", None),
        (3, "full_track", 0, 70, None, None), (None, "full_track", 0, 80, None, None),
    }
