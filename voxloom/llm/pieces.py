"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For every prefix of a stretch of text the table stores the one last token of the prefix's encoding. Candidates are the pieces
that end there, from an Aho-Corasick automaton over the vocabulary; a candidate is right when it is compatible with the last token of
the prefix before it, that is, when merging the two pieces' characters by the model's scores gives back exactly the two. Ids are
then read backwards from the end. A stretch costs one step per match, whatever its length.

No piece has the blank mark after another character, and characters outside the vocabulary never merge, so a text falls into
independent stretches (one per word); the results of short stretches are remembered, in two generations of ``REMEMBER`` per process.

Edge cases: null texts count as empty and have no ids; blanks, line ends, unknown characters (byte pieces), NUL and texts without
a blank are encoded like any other; repeated rows get equal results; an empty table gives an empty result; extra columns pass by.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxloom.llm.common import in_slices

MARK = "▁"
REMEMBER = 300_000
#: Longest stretch whose result is remembered.
SHORT = 48


class PieceModel:
    """Vocabulary of a SentencePiece BPE model with byte fallback, identity normalisation and a leading blank."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        special = [i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)]
        self.bytes_ = {int(self.pieces[i][3:5], 16): i for i in special if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes_.items()}
        self.silent = set(special) - set(self.byte_of)
        self.unknown = lib.unk_id()
        self.score = {p: lib.get_score(i) for i, p in enumerate(self.pieces) if i not in set(special)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in set(special)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a blank inside: texts cannot be cut at blanks")
        self.letters = {c for p in self.ids for c in p}
        if self.letters - set(self.ids):
            raise ValueError("a piece has a character that is no piece of its own")
        # pieces that their own characters do not merge to never occur in an encoding
        self.reachable = {p for p in self.ids if self.merge(p) == [p]}
        self.matches = ahocorasick.Automaton()
        for p in self.reachable:
            self.matches.add_word(p, p)
        self.matches.make_automaton()
        self.compatible_: dict[tuple[str, str], bool] = {}
        self.seen: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Characters merged pair by pair, best score first, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        got = self.compatible_.get((a, b))
        if got is None:
            if len(self.compatible_) > REMEMBER:
                self.compatible_.clear()
            got = self.compatible_[a, b] = self.merge(a + b) == [a, b]
        return got

    def known(self, text: str) -> list[int]:
        """Ids of a stretch of characters of the vocabulary."""
        n = len(text)
        last: list[str | None] = [None] * (n + 1)
        ends: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.matches.iter(text):
            ends[end].append(piece)
        for end in range(n):
            for piece in ends[end]:  # longest first
                before = end + 1 - len(piece)
                if not before or (last[before] is not None and self.compatible(last[before], piece)):
                    last[end + 1] = piece
                    break
        out, at = [], n
        while at:
            piece = last[at]
            out.append(self.ids[piece])
            at -= len(piece)
        return out[::-1]

    def stretch(self, text: str) -> list[int]:
        out, at = [], 0
        for k, c in enumerate(text):
            if c not in self.letters:
                if k > at:
                    out += self.known(text[at:k])
                out += [self.bytes_[b] for b in c.encode("utf-8", "surrogatepass")]
                at = k + 1
        return out + self.known(text[at:]) if at < len(text) else out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces with blanks for the mark, runs of byte pieces as UTF-8, without the leading blank."""
        out = self._text(ids)
        return out[1:] if out.startswith(" ") else out

    def _text(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            out.append("" if i in self.silent and i != self.unknown else " ⁇ " if i == self.unknown else self.pieces[i].replace(MARK, " "))
        out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def remember(self, part: str) -> tuple[str, str]:
        """Decimal ids of a stretch joined by commas, and their text."""
        got = self.older.get(part)
        if got is None:
            ids = self.stretch(part)
            got = (",".join(map(str, ids)), self._text(ids))
        if len(part) <= SHORT:
            self.seen[part] = got
        return got

    def both(self, text: str) -> tuple[str, str]:
        """Decimal ids of a whole text joined by commas, and the text that they decode to."""
        if not text:
            return "", ""
        marked = (MARK + text).replace(" ", MARK)
        if MARK + MARK in marked:
            parts = _PARTS.findall(marked)
        else:
            parts = filter(None, marked.replace(MARK, " " + MARK).replace("\n", " \n ").split(" "))
        if len(self.seen) >= REMEMBER:
            self.older, self.seen = self.seen, {}
        seen, remember = self.seen, self.remember
        pairs = [seen.get(p) or remember(p) for p in parts]
        back = "".join([b for _, b in pairs])
        return ",".join([a for a, _ in pairs]), back[1:] if back.startswith(" ") else back

    def encode(self, text: str) -> list[int]:
        got = self.both(text)[0]
        return [int(x) for x in got.split(",")] if got else []


_PARTS = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


@functools.cache
def model(path: str) -> PieceModel:
    """One model per process."""
    return PieceModel(path)


def _run(path: str, with_ids: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = model(path)
        for batch in in_slices(batches, 1 << 20):
            cols: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                ids, back = m.both(text or "")
                cols[0].append(ids.count(",") + 1 if ids else 0)
                cols[1].append(hashlib.sha256(ids.encode()).hexdigest())
                cols[2].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                cols[3].append([int(x) for x in ids.split(",")] if ids and with_ids else [])
            arrays = [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = [batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(cols[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, ``n_tokens``, SHA-256 of the decimal ids and of the text they decode to, and the ids if asked for.

    ``model_path`` is a file that every worker has.
    """
    slim = df.select(id_col, text_col)
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return slim.mapInArrow(_run(model_path, with_ids), T.StructType([slim.schema[id_col], *T._parse_datatype_string(more).fields]))
