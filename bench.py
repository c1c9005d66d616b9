"""Headline queries as one JSON line: one warm-up run, then the median of BENCH_RUNS (default 1)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voxloom.catalog import QUERIES  # noqa: E402
from voxloom.session import local_session  # noqa: E402

HEADLINE = (
    "speech_summary", "source_sentences", "speech_gaps", "interval_overlap", "repair_word_times", "word_chunks",
    "dubbing_cues", "repeat_islands", "context_blocks", "merge_glossary", "locked_terms_missing",
    "translation_warnings", "alignment_row", "qa_report", "energy_islands", "clip_level_stats",
    "token_recall", "subtitle_lines", "latest_manifest", "resume_plan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        seen = []
        for i in range(runs + 1):
            t = time.perf_counter()
            # every row is produced, none is brought to the driver
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                seen.append(time.perf_counter() - t)
        times[name] = round(statistics.median(seen), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
