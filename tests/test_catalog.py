"""Registered queries against their SQL on the smallest tables."""

import pytest

from voxloom.catalog import ORACLES, QUERIES
from tests.harness import compare, duck

SF = "/root/testdata/sf0.001"
QUICK = [
    "source_speech_islands", "speech_gaps", "interval_overlap", "absolute_ms", "timestamp_gate", "merge_glossary",
    "locked_terms_missing", "review_required", "apply_review_lock", "energy_islands", "merge_intervals",
    "clip_level_stats", "alignment_row", "qa_report", "token_recall", "subtitle_lines", "latest_manifest",
    "resume_plan", "progress_stream", "speech_session_stream", "incremental_units",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and set(QUICK) <= set(ORACLES)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF).startswith("ok")


def test_segments_from_whole_cues(spark, con):
    assert compare(spark, con, "segment_from_whole_cues", SF).startswith("ok")
    got = QUERIES["segment_from_whole_cues"](spark, SF).toPandas()["display_text"]
    assert got.str.contains("[A-Z]").any() and got.str.contains("[a-z]").any() and got.str.contains("[.,?!]").any()
