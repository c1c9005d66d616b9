"""Block-wise primitives against plain loops, with one key holding most rows and tiny blocks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from voxloom.plans import sequences as seq

K = ["job_id"]
ORDER = ["start_ms", "pos"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for job, n in ((1, 300), (2, 7), (3, 1), (4, 60)):
        t = 0
        for pos in range(n):
            t += rng.choice([0, 1, 2, 5, 40, 200])
            out.append((job, t, pos, t + rng.randint(1, 9)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "job_id long, start_ms long, pos long, end_ms long").repartition(5)


def by_job(rows):
    d = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        d[r[0]].append(r)
    return d


@pytest.mark.parametrize("width", [13, 100_000])
def test_rank_running_neighbours_islands(df, rows, width):
    got = seq.ranked(df, K, ORDER, "rn", width=width)
    got = seq.running(got, K, ORDER, {"top": ("max", "end_ms"), "sum": ("sum", "end_ms")}, width=width)
    got = seq.neighbours(got, K, ORDER, ["start_ms", "end_ms"], prev="p", nxt="n", width=width)
    got = seq.islands(got, K, ORDER, ["start_ms", "end_ms"], lambda p, c: c["start_ms"] - p["end_ms"] > 20, "isl", width=width)
    got = {(r.job_id, r.pos): (r.rn, r.top, r.sum, r.p and r.p.end_ms, r.n and r.n.start_ms, r.isl) for r in got.collect()}
    want = {}
    for job, rs in by_job(rows).items():
        isl, top, total = 0, 0, 0
        for i, r in enumerate(rs):
            if i and r[1] - rs[i - 1][3] > 20:
                isl += 1
            top, total = max(top, r[3]), total + r[3]
            want[(job, r[2])] = (
                i + 1, top, total, rs[i - 1][3] if i else None, rs[i + 1][1] if i + 1 < len(rs) else None, isl
            )
    assert got == want


@pytest.mark.parametrize("width", [13, 60, 100_000])
def test_pieces_are_islands_cut_at_blocks(df, rows, width):
    odd = df.unionByName(df.limit(1).withColumn("job_id", F.lit(None).cast("long"))).unionByName(df.limit(1).withColumn("start_ms", F.lit(None).cast("long")))
    got = seq.pieces(odd, K, ORDER, ["end_ms"], lambda p, c: c["start_ms"] - p["end_ms"] > 20, "isl", width=width).collect()
    assert all(i.start_ms // width == r._blk for r in got for i in r["items"])
    assert len({(r.job_id, r.isl, r._blk) for r in got}) == len(got)
    runs = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.job_id, r.isl, r._blk)):
        runs[r.job_id, r.isl] += [(r.job_id, i.start_ms, i.pos, i.end_ms) for i in r["items"]]
    want = {}
    for job, rs in by_job(rows).items():
        isl = 0
        for i, r in enumerate(rs):
            isl += bool(i and r[1] - rs[i - 1][3] > 20)
            want.setdefault((job, isl), []).append(r)
    assert runs == want


@pytest.mark.parametrize("width", [60, 100_000])
def test_lookahead(df, rows, width):
    got = {(r.job_id, r.pos): [x.pos for x in r.a] for r in seq.lookahead(df, K, ORDER, ["end_ms"], 50, "a", width=width).collect()}
    for job, rs in by_job(rows).items():
        for i, r in enumerate(rs):
            assert got[(job, r[2])] == [x[2] for x in rs[i:] if x[1] - r[1] <= 50]


def test_following(df, rows):
    got = {(r.job_id, r.pos): r.a for r in seq.following(df, K, "pos", "end_ms", 3, "a", width=8).collect()}
    for job, rs in by_job(rows).items():
        for i, r in enumerate(rs):
            assert got[(job, r[2])] == [x[3] for x in rs[i : i + 4]]


@pytest.mark.parametrize("width", [17, 100_000])
def test_first_beyond(df, rows, width):
    marks = df.select(*K, "pos", F.col("start_ms").alias("level"))
    probes = df.select(*K, "pos", (F.col("start_ms") + 30).alias("threshold"))
    got = {(r.job_id, r.pos): r.x for r in seq.first_beyond(probes, marks, K, "x", width=width).collect()}
    for job, rs in by_job(rows).items():
        for r in rs:
            assert got[(job, r[2])] == next((x[2] for x in rs if x[1] > r[1] + 30), None)


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_chase_by_levels(spark, block):
    rng = random.Random(block)
    edges, want = [], set()
    for job, n in ((1, 500), (2, 3), (3, 1), (4, 90)):
        nxt = [i + rng.choice([1, 1, 2, 3, 9]) for i in range(n)]
        edges += [(job, i, v if v < n else None) for i, v in enumerate(nxt)]
        i = 0
        while i < n:
            want.add((job, i))
            i = nxt[i]
    e = spark.createDataFrame(edges, "job_id long, pos long, nxt long").repartition(4)
    got = seq.chase(e, K, block=block).collect()
    assert len(got) == len(want) and {(r.job_id, r.pos) for r in got} == want


def test_sessions_of_recordings_that_arrive_in_different_triggers(spark, tmp_path):
    from pyspark.sql import functions as F

    from voxloom.streaming import jobs as sj

    schema = "job_id long, recorded_at timestamp, start_ms long, end_ms long"
    for job in (1, 2, 3):
        w = spark.range(6).select(
            F.lit(job).cast("long").alias("job_id"), F.timestamp_millis(F.lit(job * 7_200_000)).alias("recorded_at"),
            (F.col("id") * 1_000_000).alias("start_ms"), (F.col("id") * 1_000_000 + 300).alias("end_ms"),
        )
        w.write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sj.run_to_files(sj.speech_sessions(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("job_id").count().collect()
    assert {r["job_id"]: r["count"] for r in got} == {1: 6, 2: 6, 3: 5}  # the last session is still open


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    import types

    import pytest as pt

    from voxloom import session

    assert session.is_local("local[4]") and session.is_local("local") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("yarn")
    context = types.SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pt.raises(RuntimeError):
        session.shared_dir(types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d: d)))


def test_embedded_json_is_found_beside_other_brackets(spark):
    from voxloom.operators import glossary as gl

    rows = [(1, 0, 'Here {note}: [{"original":"dx"}] done {ok}'), (1, 1, 'see {"terms":[{"original":"a}b"}]} end')]
    got = gl.response_terms(spark.createDataFrame(rows, "job_id long, block_index long, content string")).collect()
    assert {(r.block_index, r.way, r.term) for r in got} == {(0, "embedded", '{"original":"dx"}'), (1, "embedded", '{"original":"a}b"}')}


def test_suggestions_are_appended(spark):
    from voxloom.operators import review as rv

    segs = spark.createDataFrame([(1, "s1", []), (1, "s2", ["x"])], "job_id long, segment_id string, risk_flags array<string>")
    new = lambda c, s: spark.createDataFrame([(1, s, c, "n", 0.5)], "job_id long, segment_id string, candidate_id string, suggested_normalized string, confidence double")
    got = {r.segment_id: r for r in rv.attach_suggestions(rv.attach_suggestions(segs, new("c1", "s1")), new("c2", "s1")).collect()}
    assert [x.candidate_id for x in got["s1"].normalization_suggestions] == ["c1", "c2"]
    assert got["s2"].normalization_suggestions is None and got["s2"].risk_flags == ["x"]
