"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Byte ``GRAM``-grams are hashed into ``BUCKETS`` counters. Two multinomials are counted over whole texts with add-``SMOOTH`` smoothing: one is
counted over every trusted document, one over every document of the corpus. Trusted ids come in hash slices of about ``SLICE``, each broadcast
to a pass of its own over the texts, which so need not move; the slices' counters add up. A document's score is the mean over its
n-grams of log p_target - log p_raw; it is kept when the score is at least ``threshold``. Nothing is drawn at random.
Two tables of ``BUCKETS`` numbers and one slice of ids at a time reach the driver and the tasks, whatever the size of the corpus.

Beside the score stand counts of plain rules: words, characters in words, symbols, repeated lines and words in repeated 8-word
windows; a document with fewer than ``MIN_WORDS`` words or over ``MAX_REPEAT`` percent repeated words is rejected without a look at its score.

Edge cases: null text counts as empty, has score 0 and fails by its words; without trusted documents all scores are 0 and only
the plain rules decide; repeated rows get equal results; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import code_points, in_slices, keep, mix, powers, sums, utf8, words

GRAM = 3
BUCKETS = 1 << 16
SMOOTH = 1.0
#: Trusted ids broadcast at a time.
SLICE = 1_000_000
MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
THRESHOLD = -0.35
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each byte, and 1 where the n-gram lies within one text."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    code = np.zeros(n, np.uint64)
    for k in range(GRAM):
        code = (code << np.uint64(8)) | raw[k : n + k]
    bucket = np.zeros(len(raw), np.int64)
    with np.errstate(over="ignore"):
        bucket[:n] = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)).astype(np.int64)
    valid = np.ones(len(raw), np.int64)
    for k in range(1, GRAM):
        last = offsets[1:] - k
        valid[last[last >= offsets[:-1]]] = 0
    return bucket, valid


def _counts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    total = np.zeros(BUCKETS, np.int64)
    for batch in in_slices(batches, 1 << 20):
        bucket, valid = grams(*utf8(batch.column(0)))
        total += np.bincount(bucket[valid == 1], minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["bucket", "n"])


def gram_counts(df: DataFrame, text_col: str) -> np.ndarray:
    """Counts of all n-grams of all texts by bucket."""
    parts = df.select(text_col).mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per bucket, log p_target - log p_raw; zeros when the target is empty."""
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda c: np.log((c + SMOOTH) / (c.sum() + SMOOTH * BUCKETS))
    return share(target) - share(raw)


def repeated_words(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Per text, words that lie in a window of ``WINDOW`` words found twice or more in it."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(rows, np.int64)
    weights = powers(WINDOW + 1)
    with np.errstate(over="ignore"):
        window = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            window += hashes[k : n + k] * weights[k + 1]
        whole = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
        key = mix(window[whole] + mix(row[whole].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    twice = whole[order[same[:-1] | same[1:]]]
    covered = np.zeros(len(hashes), bool)
    for k in range(WINDOW):
        covered[twice + k] = True
    return np.bincount(row[covered], minlength=rows)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip()]
    return len(lines) - len(set(lines))


def measure(column, table: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """All measures of a batch of texts, one array each."""
    raw, offsets = utf8(column)
    rows = len(offsets) - 1
    starts, ends, row, hashes = words(raw, offsets)
    n_words = np.bincount(row, minlength=rows)
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum(code_points(raw))])
    chars = np.bincount(row, weights=points[ends] - points[starts], minlength=rows).astype(np.int64)
    repeats = repeated_words(row, hashes, rows)
    whole = raw.tobytes()
    lines = np.array([repeated_lines(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
    bucket, valid = grams(raw, offsets)
    n_grams = sums(valid, offsets)
    # whole micro-units, so that a score does not depend on the batch its document came in
    units = np.round(table * 1e6).astype(np.int64)
    score = sums(np.where(valid == 1, units[bucket], 0), offsets) / np.maximum(n_grams, 1) / 1e6
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT * n_words)
    return {
        "n_words": n_words.astype(np.int64), "word_chars": chars, "n_symbols": sums(SYMBOLS[raw], offsets), "n_dup_lines": lines, "n_repeat_words": repeats.astype(np.int64),
        "base_failed": failed, "score": score, "kept": ~failed & (score >= threshold),
    }


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def target_counts(df: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Counts of all n-grams of all trusted documents; the ids are broadcast by hash slices, so texts stay where they lie."""
    ids = trusted.select(F.col(trusted.columns[0]).alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    slices = max(1, -(-ids.count() // SLICE))
    if slices > 1:
        ids = keep(ids)
    out = np.zeros(BUCKETS, np.int64)
    for k in range(slices):
        part = ids.where(F.pmod(F.xxhash64(id_col), F.lit(slices)) == k)
        out += gram_counts(df.select(id_col, text_col).join(F.broadcast(part), id_col, "left_semi"), text_col)
    return out


def ratio_table(df: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """The log ratio, the target counted over all trusted documents, the raw side over all documents."""
    return log_ratio(target_counts(df, trusted, id_col, text_col), gram_counts(df, text_col))


def quality(df: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and all measures. ``trusted`` holds the ids of the target documents in its first column."""
    table = ratio_table(df, trusted, id_col, text_col)

    def run(batches):
        import pyarrow as pa

        for batch in in_slices(batches, 1 << 20):
            got = measure(batch.column(1), table, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v) for v in got.values()]], [id_col, *got])

    slim = df.select(id_col, text_col)
    return slim.mapInArrow(run, T.StructType([slim.schema[id_col], *T._parse_datatype_string(MEASURES).fields]))


def keep_good(df: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    table = ratio_table(df, trusted, id_col, text_col)
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in in_slices(batches, 1 << 20):
            yield batch.filter(pa.array(measure(batch.column(at), table, threshold)["kept"]))

    return df.mapInArrow(run, df.schema)
