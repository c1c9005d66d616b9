"""Term search by places and JSON inside answers, against plain regular expressions and the standard decoder."""

import json
import random
import re
import time

from voxloom.operators import glossary as gl

WORDS = ["we", "add", "½", "cup", "Cup", "fine", "a", "a_b", "é", "x+y", "+", "(c)", "don't", "“½", "3.5", "b"]


def test_terms_equal_regular_expressions(spark):
    rng = random.Random(3)
    line = lambda n: "".join(rng.choice(WORDS) + rng.choice([" ", " ", ", ", "", "  "]) for _ in range(n))
    texts = [(1, f"s{i}", line(rng.randrange(0, 14))) for i in range(60)] + [(1, "blank", " "), (2, "s0", "we add “½ cup, fine")]
    terms = [(k, f"t{k}", t, "r") for k, t in enumerate({line(rng.randrange(1, 4)) for _ in range(80)} | {" ", "", "½", "½ cup", "A", "+y", "x+", "zzz"})]
    used = [(1, "s1", " ½ "), (1, "s2", "A"), (2, "s0", "½"), (9, "s9", "½")]
    segments = spark.createDataFrame(texts, "job_id long, segment_id string, source_text string")
    found = gl.applicable_terms(
        segments, spark.createDataFrame(terms, "n long, term_id string, original string, vietnamese string"), used=spark.createDataFrame(used, "job_id long, segment_id string, used_term string")
    )
    got = sorted((r.job_id, r.segment_id, r.term_id) for r in found.collect())
    listed = {(j, s, u.strip().lower()) for j, s, u in used}
    want = []
    for j, s, text in texts:
        for _, name, term, _ in terms:
            t = term.strip()
            if len(t) > 1 and re.search(rf"(?<![\w]){re.escape(t)}(?![\w])", text, re.I) or len(t) == 1 and (j, s, t.lower()) in listed:
                want.append((j, s, name))
    assert got == sorted(want) and len(want) > 60


def test_no_piece_is_shared_by_all_segments(spark):
    segments = spark.createDataFrame([(1, f"s{i}", f"the word{i} of, the line") for i in range(50)], "job_id long, segment_id string, source_text string")
    terms = spark.createDataFrame([("t", "word7 of, the", "r")], "term_id string, original string, vietnamese string")
    assert [r.segment_id for r in gl.applicable_terms(segments, terms).collect()] == ["s7"]


def plain_first(text):
    for i, c in enumerate(text):
        if c in "[{":
            try:
                return text[i : json.JSONDecoder().raw_decode(text[i:])[1] + i]
            except json.JSONDecodeError:
                pass
    return None


def test_first_json_equals_trying_every_bracket():
    rng = random.Random(4)
    bits = ["[", "]", "{", "}", '"', '"a"', ":", ",", "1", '{"a":1}', '["]"]', "\\", '"\\""', " x ", "null", "[[", '{"a":[', "]}"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 14)))
        assert gl.first_json(text) == plain_first(text), text


def test_long_answers_take_little_time():
    many = json.dumps([{"original": f"term {i}"} for i in range(1000)])
    t = time.time()
    assert gl.first_json("see [x {y " * 200 + many + " end }") == many
    assert gl.first_json("[" * 800 + "x") is None and gl.first_json('{"a":' * 300 + '"' + "[" * 20_000) is None
    assert time.time() - t < 2


def test_only_stretches_that_are_terms_move(spark):
    from pyspark.sql import functions as F

    from voxloom.operators import phrases as ph

    rng = random.Random(5)
    texts = [(1, f"s{i}", " ".join(f"w{rng.randrange(3000)}" for _ in range(200)) + ", É Ôte-w7 É") for i in range(50)]
    terms = [(t,) for t in {"ôte-w7", "é", "w7 é", "te-w7", "w1 w2", "w5", "w6"} | {f"none {k}" for k in range(500)}]
    segments = spark.createDataFrame(texts, "job_id long, segment_id string, source_text string")
    found = ph.stretches(segments, ["job_id", "segment_id"], "source_text", ph.Marks(spark.createDataFrame(terms, "k string"), "k"))
    got = {(r.segment_id, r._key) for r in found.collect()}
    want = {(s, t) for _, s, text in texts for (t,) in terms if re.search(rf"(?<!\w){re.escape(t)}(?!\w)", text.lower())}
    assert want <= got and len(got) < len(want) + 50 * 200 * 0.05 and found.count() == len(got)
    # a stretch that is no term, as marks may have it, gives no pair; rows of one id are one segment
    pairs = gl.applicable_terms(segments.unionByName(segments).withColumn("source_text", F.upper("source_text")), spark.createDataFrame([("w5", "W5", "r"), ("o", "Ôte-w7", "r")], "term_id string, original string, vietnamese string"))
    assert sorted((r.segment_id, r.term_id) for r in pairs.collect()) == sorted([(s, "w5") for s, t in want if t == "w5"] + [(s, "o") for s, t in want if t == "ôte-w7"])
