"""Stretches of texts that may be one of many phrases, found where the texts lie.

A text is cut into pieces: words, and other characters one by one. A phrase can only stand where a piece begins, on as many pieces as it has
itself, with no word going on before or after it. Every such stretch is hashed and looked up in marks of all phrases, a table of at most
``SLOTS`` numbers. So only what is a phrase, and a few of a hundred other stretches (more of them beyond some 30 million phrases), has to move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions import text as tx

#: Numbers of 64 bits that mark the phrases, at most.
SLOTS = 1 << 22
#: A run of word characters, or any other character alone.
PIECE = rf"{tx.WORD}+|(?s:.)"
#: Bytes of text looked at together.
_BYTES = 2 << 20

_U = np.uint64
_LETTER = np.random.default_rng(20261203).integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_STEP = 0x9E3779B97F4A7C15
_ASCII_WORD = np.array([chr(c).isalnum() and c < 128 or c == 95 for c in range(256)])


def lowered(c: Column | str) -> tuple[Column, Column]:
    """The text in lower case and, unless it is ASCII, the same with a w for each of its word characters."""
    low = F.lower(c)
    return low.alias("_low"), F.when(F.rlike(low, F.lit(r"[^\p{ASCII}]")), F.regexp_replace(low, tx.WORD, "w")).alias("_marked")


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column laid end to end and the offset of each row (one more than rows); null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(low: pa.Array, marked: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes of the texts; of every piece its first byte, its row and whether it is a word."""
    raw, offsets = _utf8(low)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    row = np.searchsorted(offsets, at, "right") - 1
    word = _ASCII_WORD[raw[at]]
    other = marked.is_valid().to_numpy(zero_copy_only=False)[row]
    if other.any():
        marks = _utf8(marked)[0]
        word[other] = marks[(marks & 0xC0) != 0x80] == ord("w")
    begins = np.ones(len(at), bool)
    begins[1:] = ~(word[1:] & word[:-1] & (row[1:] == row[:-1]))
    return raw, at[begins], row[begins], word[begins]


def _mix(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class _Hashes:
    """64-bit numbers of stretches of bytes; equal stretches have equal ones, wherever they stand."""

    def __init__(self, raw: np.ndarray) -> None:
        powers = lambda step: np.cumprod(np.concatenate([np.ones(1, _U), np.full(len(raw), step, _U)]), dtype=_U)
        with np.errstate(over="ignore"):
            up, self.down = powers(_STEP), powers(pow(_STEP, -1, 2**64))
            self.upto = np.concatenate([np.zeros(1, _U), np.cumsum(_LETTER[raw] * up[:-1], dtype=_U)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.upto[end] - self.upto[start]) * self.down[start] + (end - start).astype(_U) * _U(_STEP))


def _place(hashes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a phrase is marked: which number, and which three bits of it."""
    bits = np.zeros(len(hashes), _U)
    for k in (0, 6, 12):
        bits |= _U(1) << ((hashes >> _U(k)) & _U(63))
    return ((hashes >> _U(20)) % _U(slots)).astype(np.int64), bits


def _slices(batches: Iterator) -> Iterator:
    for batch in batches:
        take = max(1, int(batch.num_rows * _BYTES / max(batch.nbytes, 1)))
        yield from (batch.slice(k, take) for k in range(0, batch.num_rows, take))


class Marks:
    """Marks of the phrases of a table (column ``key``, in lower case): how many pieces they have, how many they are, and the numbers."""

    def __init__(self, phrases: DataFrame, key: str) -> None:
        sizes = phrases.groupBy(F.regexp_count(key, F.lit(PIECE)).alias("n")).agg(F.count("*").alias("c")).collect()
        self.sizes, self.count = sorted(r.n for r in sizes), sum(r.c for r in sizes)
        slots = min(SLOTS, max(64, self.count // 4))

        def mark(batches: Iterator) -> Iterator:
            for batch in _slices(batches):
                raw, offsets = _utf8(batch.column(0))
                slot, bits = _place(_Hashes(raw).of(offsets[:-1], offsets[1:]), slots)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits.view(np.int64))], ["slot", "bits"])

        table = np.zeros(slots, _U)
        if self.count:
            found = phrases.select(key).mapInArrow(mark, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
            table[found["slot"].to_numpy()] = found["bits"].to_numpy().view(_U)
        self.table = phrases.sparkSession.sparkContext.broadcast(table)


def _strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = raw[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])


def stretches(texts: DataFrame, keys: list[str], column: str, marks: Marks) -> DataFrame:
    """(*keys, _key): different stretches of each text that are marked, in lower case, once a row of ``texts``; they neither begin nor end with a blank."""
    sizes, table = marks.sizes, marks.table
    schema = T.StructType([*[texts.schema[k] for k in keys], T.StructField("_key", T.StringType())])

    def look(batches: Iterator) -> Iterator:
        marked = table.value
        for batch in _slices(batches):
            raw, start, row, word = _pieces(*batch.columns[-2:])
            end, same = np.append(start[1:], len(raw)), row[1:] == row[:-1]
            first, last = raw[start] != 32, raw[start] != 32
            first[1:] &= ~(same & word[:-1])
            last[:-1] &= ~(same & word[1:])
            hashes, found = _Hashes(raw), []
            for n in sizes:
                if 0 < n <= len(start):
                    m = len(start) - n + 1
                    i = np.flatnonzero(first[:m] & last[n - 1 :] & (row[:m] == row[n - 1 :]))
                    h = hashes.of(start[i], end[i + n - 1])
                    slot, bits = _place(h, len(marked))
                    hit = (marked[slot] & bits) == bits
                    found.append((row[i[hit]], h[hit], start[i[hit]], end[i[hit] + n - 1]))
            if not found:
                continue
            at, h, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((h, at))
            at, h, s, e = at[order], h[order], s[order], e[order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (h[1:] != h[:-1])
            rows = pa.array(at[new])
            yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:-2]), _strings(raw, s[new], e[new])], [*keys, "_key"])

    return texts.select(*keys, *lowered(column)).mapInArrow(look, schema)
