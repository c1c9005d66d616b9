"""What the operators of this subpackage share: reading tables, cutting lineage, byte-level word splitting.

Word separators are the six ASCII blanks (space, tab, line feed, vertical tab, form feed, carriage return);
no other character separates words.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from voxloom.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Write a frame to the folder all executors share and read it back: it survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/steps/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column laid end to end, and the offset of each row (one more than rows); null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_rng = np.random.default_rng(20240229)
#: One odd 64-bit number per byte value: the letters of the word hash.
LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), STEP)]))


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and 64-bit hash of every word of a batch of texts, without making a Python object per word.

    The hash is a polynomial in the word's bytes modulo 2**64, mixed; equal words have equal hashes and two different
    words collide with a chance of about 2**-64. ``lower`` maps A-Z to a-z first.
    """
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([np.zeros(1, bool), inside[:-1]]) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], np.zeros(1, bool)]) if len(raw) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    if not len(starts):
        return starts, ends, row, np.zeros(0, np.uint64)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    lengths = ends - starts
    table_ = powers(int(lengths.max()))
    with np.errstate(over="ignore"):
        place = np.zeros(len(raw), np.int64)
        first = starts[0]
        place[first:] = np.arange(first, len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
        terms = np.where(inside, LETTER[raw] * table_[np.minimum(place, len(table_) - 1)], np.uint64(0))
        return starts, ends, row, mix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64))


def code_points(raw: np.ndarray) -> np.ndarray:
    """One where a character starts, zero on the bytes that continue one."""
    return ((raw & 0xC0) != 0x80).astype(np.int64)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def in_slices(batches, rows: int = 256, size: int = 2 << 20):
    """Cut Arrow batches into pieces of at most ``rows`` rows and, unless one row is larger, about ``size`` bytes."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        take = max(1, min(rows, int(n * size / max(batch.nbytes, 1))))
        while at < n:
            yield batch.slice(at, take)
            at += take
