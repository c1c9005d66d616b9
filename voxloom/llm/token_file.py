"""Token-id files with Simple-8b word-aligned coding.

Ids are packed into 64-bit words: the top four bits select how many ids of what width the other 60 bits hold. A document is cut into
blocks of ``BLOCK`` ids that start at whole words; offsets of the blocks are stored, so any block decodes alone and all blocks
of a batch decode as array operations. An id of 60 bits or more is an escape: the selector alone, then the id in a word of its own.

A file is one partition of a Parquet table in the shared folder, one row per document in ascending id order (files in the
same order): ``doc_id``, ``first`` (ids before it in the file), ``n_tokens``, ``offsets`` (32-bit word offsets of its blocks) and
``words`` (little-endian). Documents go to files by splitters of the ids, so texts are encoded where they are read and only packed ids move.

Edge cases: ids are integers (other ids stop with a cast error); null texts count as empty and hold only the end id; a null id sorts after all ids; repeated ids lie side by side in the
order of their packed ids; an empty table gives an empty file set and result; extra columns are not touched.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.common import in_slices, partitions, utf8
from voxloom.session import shared_dir

#: Ids in a word by selector, fixed by the format; the width is 60 // count, selector 15 is the escape.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
ESCAPE = 15
BLOCK = 256
REMEMBER = 300_000
_U = np.uint64
#: Parts words that are encoded together; words that hold it are encoded alone.
PART = "\x01"
#: Units of simple letters, one digit, or marks.
PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: Byte-level vocabularies spell a byte that is no printable Latin-1 character as the next character from U+0100 on.
SPELLING = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
BLANK, LETTER, DIGIT, MARK, OTHER = range(5)
#: Kind of each byte: blank and line feed, ASCII letters, digits and marks but the apostrophe; two-byte Latin letters are found by pairs.
KIND = np.full(256, OTHER, np.uint8)
KIND[[32, 10]] = BLANK
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[[k for k in range(33, 127) if not chr(k).isalnum() and k != 39]] = MARK


#: Bits of the numbers below 65536, at least 1.
_SHORT_WIDTHS = np.maximum(1, np.ceil(np.log2(np.arange(1 << 16) + 1.0))).astype(np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, at least 1."""
    out = _SHORT_WIDTHS[(values & _U(0xFFFF)).astype(np.int64)]
    for k in (16, 32, 48):
        part = (values >> _U(k)) & _U(0xFFFF)
        if part.any():
            out = np.where(part > 0, _SHORT_WIDTHS[part.astype(np.int64)] + np.uint8(k), out)
    return out


def pack(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all lists laid end to end, word offset of each list, and block offsets within their lists with each list's first block.

    List k is ``values[offsets[k]:offsets[k + 1]]``.
    """
    values = values.astype(np.uint64)
    n = len(values)
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    of = np.repeat(np.arange(len(lengths)), blocks)
    start = offsets[of] + (np.arange(first[-1]) - first[of]) * BLOCK
    end = np.minimum(start + BLOCK, offsets[of + 1])
    widths = _widths(values)
    left = np.repeat(end, end - start) - np.arange(n)
    chosen = np.full(n, 14, np.uint8)
    chosen[widths > 60] = ESCAPE
    # a run that fits a selector fits all of lower counts, so each selector is tried only where the one before it fitted
    here, most, reach = np.arange(n), widths.copy(), 1
    for sel in range(13, 0, -1):
        count = int(COUNTS[sel])
        fit = left[here] >= count
        here, most = here[fit], most[fit]
        for k in range(reach, count):
            np.maximum(most, widths[here + k], out=most)
        fit = most <= 60 // count
        here, most, reach = here[fit], most[fit], count
        if not len(here):
            break
        chosen[here] = sel
    at, starts = start, []
    while len(at):
        starts.append(at)
        at = at + COUNTS[chosen[at]]
        keep = at < end
        at, end = at[keep], end[keep]
    mark = np.zeros(n, bool)
    for s in starts:
        mark[s] = True
    pos = np.flatnonzero(mark)
    sel = chosen[pos]
    size = 1 + (sel == ESCAPE)
    place = np.concatenate([[0], np.cumsum(size)])
    words = np.zeros(place[-1], np.uint64)
    for s in np.unique(sel):
        here = np.flatnonzero(sel == s)
        if s == ESCAPE:
            words[place[here]] = _U(ESCAPE) << _U(60)
            words[place[here] + 1] = values[pos[here]]
            continue
        count = int(COUNTS[s])
        word = np.full(len(here), _U(s) << _U(60), np.uint64)
        for k in range(count):
            word |= values[pos[here] + k] << _U(k * (60 // count))
        words[place[here]] = word
    word_of = place[np.searchsorted(pos, np.append(start, n))]
    lists = np.append(word_of, place[-1])[np.minimum(first, len(start))]
    lists[-1] = place[-1]
    return words, lists, word_of[:-1] - lists[of], first


def unpack(words: np.ndarray) -> np.ndarray:
    """All values of packed words."""
    sel = (words >> _U(60)).astype(np.int64)
    if (sel == ESCAPE).any():  # the word after an escape is no selector
        raw, k = np.zeros(len(words), bool), 0
        for k in np.flatnonzero(sel == ESCAPE):
            if not raw[k]:
                raw[k + 1] = True
    else:
        raw = None
    count = COUNTS[sel]
    if raw is not None:
        count = np.where(raw, 0, count)
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(at[-1], np.uint64)
    for s in np.unique(sel if raw is None else sel[~raw]):
        here = np.flatnonzero(sel == s) if raw is None else np.flatnonzero((sel == s) & ~raw)
        if s == ESCAPE:
            out[at[here]] = words[here + 1]
            continue
        n = int(COUNTS[s])
        width = 60 // n
        mask = _U((1 << width) - 1)
        for k in range(n):
            out[at[here] + k] = (words[here] >> _U(k * width)) & mask
    return out


def _units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every unit of texts laid end to end, and the bytes with simple letters in lower case.

    A unit is a run of simple letters, one digit, a run of marks, or a whole word (between blanks and line ends) that holds anything else.
    The tokenizer treats units alone.
    """
    kind = KIND[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), raw
    after = np.append(raw[1:], np.uint8(0))
    accented = (raw == 0xC3) & ((after & 0xC0) == 0x80) & (after != 0x97) & (after != 0xB7)
    at = np.flatnonzero(accented)
    kind[at] = kind[at + 1] = LETTER
    kind[(raw == 0x3C) & (after == 0x7C)] = OTHER  # begins the name of a special id
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    inside = kind != BLANK
    before = np.concatenate([np.zeros(1, bool), inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.append(inside[1:], False) | edge[1:])) + 1
    odd = np.unique(np.searchsorted(starts, np.flatnonzero(kind == OTHER), "right") - 1)
    if len(odd):
        step = np.zeros(len(raw) + 1, np.int8)
        np.add.at(step, starts[odd], 1)
        np.add.at(step, ends[odd], -1)
        kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = OTHER
    low = raw.copy()
    low[(kind == LETTER) & (raw >= 65) & (raw <= 90)] += 32
    at = at[(kind[at] == LETTER) & (raw[at + 1] <= 0x9E)]
    low[at + 1] += 32
    begins = inside & (edge[:-1] | (kind == DIGIT) | np.concatenate([np.ones(1, bool), kind[1:] != kind[:-1]]))
    starts = np.flatnonzero(begins)
    # a unit ends where the next begins or where a blank or the text's end comes first
    closes = inside & np.append(begins[1:] | ~inside[1:], True)
    return starts, np.flatnonzero(closes) + 1, low


class WordIds:
    """Ids of whole texts by a tokenizer whose words do not depend on the ASCII blanks and line ends around them.

    Texts are cut into units by array passes; each distinct unit is given to the library once and remembered by its text, about
    two times ``REMEMBER`` units per process.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        (self.part_id,) = self.lib.encode(PART, add_special_tokens=False).ids
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # whether this tokenizer spells bytes as expected
        self.direct = all(self._merged(w) == np.array(self.lib.encode(w, add_special_tokens=False).ids, np.uint32).tobytes() for w in ("plain", "7", "#!?", "garçon", "ßàíÿ"))

    def look_up(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units. When ``REMEMBER`` units are known, those not met since the last time this happened are forgotten."""
        if len(self.seen) > REMEMBER:
            self.older, self.seen = self.seen, {}
        seen, older = self.seen, self.older
        found = [seen.get(w) for w in units]
        new = []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            w = units[k]
            if w in older:
                seen[w] = older[w]
            elif PART in w or "<|" in w:
                seen[w] = np.array(self.lib.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()
            elif self.direct and PLAIN.fullmatch(w):
                seen[w] = self._merged(w)
            else:
                new.append(w)
        self._ask(new)
        return [seen[w] if ids is None else ids for w, ids in zip(units, found, strict=True)]

    def _merged(self, unit: str) -> bytes:
        """Ids of a unit that is cut no further: its merges alone, without the library's passes over text."""
        spelled = unit if unit.isascii() else unit.encode().decode("latin-1").translate(SPELLING)
        got = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(got)}I", *got)

    def _ask(self, texts: list[str], step: int = 512) -> None:
        """Many texts in one call, parted by a character that is a word of its own."""
        for at in range(0, len(texts), step):
            part = texts[at : at + step]
            (got,) = self.lib.encode_batch_fast([f" {PART} ".join(part)], add_special_tokens=False)
            ids = np.array(got.ids, np.uint32)
            cuts, flat = 4 * np.flatnonzero(ids == self.part_id), ids.tobytes()
            edges = zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(flat)], strict=True)
            self.seen.update(zip(part, [flat[a:b] for a, b in edges], strict=True))

    def encode(self, column, last: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow column of texts laid end to end, and the offset of each text; ``last`` is appended to each."""
        import pyarrow as pa

        raw, bounds = utf8(column)
        starts, ends, low = _units(raw, bounds)
        sizes = ends - starts
        body = np.zeros(len(raw) + 1, np.int8)
        body[starts] += 1
        body[ends] -= 1
        data = low[np.cumsum(body[:-1], dtype=np.int8) > 0]
        marks = np.concatenate([[0], np.cumsum(sizes)])
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(marks.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        parts = self.look_up(distinct)
        table, sizes = np.frombuffer(b"".join(parts), np.uint32), np.array([len(p) // 4 for p in parts], np.int64)
        first = np.cumsum(sizes) - sizes
        counts = sizes[index]
        total = np.concatenate([[0], np.cumsum(counts)])
        flat = table[np.arange(total[-1]) + np.repeat(first[index] - total[:-1], counts)] if len(table) else np.zeros(0, np.uint32)
        offsets = total[np.searchsorted(starts, bounds)]
        if last is None:
            return flat, offsets
        more = offsets + np.arange(len(offsets))
        out = np.full(more[-1], last, np.uint32)
        body = np.ones(more[-1], bool)
        body[more[1:] - 1] = False
        out[body] = flat
        return out, more


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _binary(parts: list[bytes]):
    import pyarrow as pa

    return pa.array(parts, pa.binary())


def _encode(path: str, last: int | None, splits: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tok = word_ids(path)
        for batch in in_slices(batches, 1 << 20, 8 << 20):
            values, offsets = tok.encode(batch.column(1), last)
            words, lists, blocks, first = pack(values, offsets)
            raw, marks = words.astype("<u8").tobytes(), blocks.astype("<u4").tobytes()
            ids = batch.column(0)
            plain = np.asarray(ids.fill_null(0))
            part = np.where(np.asarray(ids.is_null()), len(splits), np.searchsorted(splits, plain, "left"))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(part, pa.int32()), pa.array(np.diff(offsets), pa.int64()),
                    _binary([marks[4 * a : 4 * b] for a, b in zip(first[:-1], first[1:], strict=True)]),
                    _binary([raw[8 * a : 8 * b] for a, b in zip(lists[:-1], lists[1:], strict=True)]),
                ],
                ["doc_id", "part", "n_tokens", "offsets", "words"],
            )

    return run


def _place(batches: Iterator) -> Iterator:
    """Add to each document of a file the number of ids before it in the file."""
    import pyarrow as pa

    before = 0
    for batch in batches:
        n = np.asarray(batch.column("n_tokens"))
        ends = before + np.cumsum(n)
        first = pa.array(ends - n, pa.int64())
        before = int(ends[-1]) if len(n) else before
        yield pa.RecordBatch.from_arrays([*batch.columns, first], [*batch.schema.names, "first"])


def write_ids(df: DataFrame, tokenizer_path: str, path: str, last: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write the file set to ``path``. ``last`` is the id appended to each document."""
    spark = df.sparkSession
    n = partitions(spark)
    # n numbers at most: where the files begin
    got = df.select(F.percentile_approx(F.col(id_col).cast("long"), [(k + 1) / n for k in range(n - 1)] or [1.0], 10_000)).first()[0] or []
    splits = np.unique(np.array(got, np.int64))
    packed = df.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(
        _encode(tokenizer_path, last, splits), "doc_id long, part int, n_tokens long, offsets binary, words binary"
    )
    files = packed.repartitionById(len(splits) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "words")
    files.mapInArrow(_place, "doc_id long, part int, n_tokens long, offsets binary, words binary, first long").write.parquet(path)


def _decode(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in in_slices(batches, 1 << 20):
        words = batch.column("words")
        raw = b"".join(x.as_py() for x in words)
        ids = unpack(np.frombuffer(raw, "<u8")).astype("<u4")
        ends = np.cumsum(np.asarray(batch.column("n_tokens")))
        if len(ids) != ends[-1]:
            raise ValueError("a file holds another number of ids than it says")
        view = memoryview(ids).cast("B")
        cuts = zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in cuts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("first"), batch.column("n_tokens"), pa.array(crc, pa.int64())],
            ["doc_id", "part", "first", "n_tokens", "ids_crc32"],
        )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decode every document of a file set: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    files = spark.read.parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    docs = files.mapInArrow(_decode, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def through_files(df: DataFrame, tokenizer_path: str, last: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to files in the shared folder and read them back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tokens/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    write_ids(df, tokenizer_path, path, last, id_col, text_col)
    return read_ids(spark, path)
