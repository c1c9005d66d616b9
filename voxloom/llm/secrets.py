"""Secret scans with structural confirmation.

Plain rules find assignments, access keys and long hexadecimal runs. The method adds what it can prove by decoding: runs of base64 or
hexadecimal characters whose bytes are a DER sequence with all nested lengths in order and a key's integers inside, OpenSSH private
keys whose length-prefixed fields fill the blob (base64 may go on over lines, indented or not, broken by line ends or by a literal \\n; the
lengths inside tell where a key ends, which must be the end of a run), and signed tokens (three dotted base64url parts) whose header is a JSON object naming an algorithm.

Offsets are code points, the end exclusive. Candidate texts are found by array passes over the bytes of a batch (runs long
enough, or a keyword); only these are searched with patterns, whole.

Edge cases: null texts count as empty; an empty list of spans is an empty string; equal starts are ordered by kind as listed in
``KINDS``; repeated rows get equal results; an empty table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxloom.llm.common import in_slices, utf8

KINDS = ("assign", "access", "hex", "der", "openssh", "token")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{32,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LONG_HEX = re.compile(rb"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
LEAST_64 = 39
RUN_64 = re.compile(rb"[A-Za-z0-9+/]++")
# how a DER sequence and an OpenSSH key begin in base64
START_64 = re.compile(rb"(?<![A-Za-z0-9+/])(?:M[B-I]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/]")
BREAK = re.compile(rb"[ \t]*+\r?\n[ \t]*+")
ESCAPED_BREAK = re.compile(rb"(?:\\++r)?\\++n|\\++r")
DOTTED = re.compile(rb"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")

_BYTE = np.arange(256)
_HEX = np.isin(_BYTE, np.frombuffer(b"0123456789abcdef", np.uint8))
_CODED = np.isin(_BYTE, np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-.", np.uint8))


def _with_run(raw: np.ndarray, offsets: np.ndarray, allowed: np.ndarray, least: int) -> np.ndarray:
    """Rows with a run of at least ``least`` allowed bytes; runs that cross rows only name rows that need no look."""
    inside = np.concatenate([[False], allowed[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    starts = starts[ends - starts >= least]
    ends = ends[ends - edges[::2] >= least]
    first, last = np.searchsorted(offsets, starts, "right") - 1, np.searchsorted(offsets, ends, "left") - 1
    rows = [np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]
    return np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)


def _with_word(raw: bytes, offsets: np.ndarray, word: bytes) -> set[int]:
    out, at = set(), raw.find(word)
    while at >= 0:
        row = int(np.searchsorted(offsets, at, "right")) - 1
        out.add(row)
        at = raw.find(word, max(at + 1, int(offsets[row + 1]) - len(word)))
    return out


def der_fields(data: bytes, depth: int = 0) -> list[int] | None:
    """Tags of a run of DER values that fills ``data`` exactly, nested ones included; None if a length does not fit."""
    at, tags = 0, []
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            n = int.from_bytes(data[at : at + size], "big")
            at += size
        if at + n > len(data):
            return None
        tags.append(tag)
        if tag & 0x20:
            inner = der_fields(data[at : at + n], depth + 1) if depth < 8 else None
            if inner is None:
                return None
            tags += inner
        at += n
    return tags


def is_der_key(data: bytes) -> bool:
    """One DER sequence, nothing after it, with an integer and either more integers or an object id and a bit or octet string."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    tags = der_fields(data)
    if not tags or tags[0] != 0x30 or data[1] == 0:
        return False
    body = tags[1:]
    return body.count(2) >= 2 or 6 in body and (3 in body or 4 in body) or 2 in body and 4 in body


def openssh_length(data: bytes) -> int | None:
    """Bytes of the OpenSSH key that ``data`` begins with, by its fields; None if there is none."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic):
        return None
    at, fields = len(magic), 0
    while at + 4 <= len(data) and fields < 3:  # cipher, key derivation, its options
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        fields += 1
    if fields < 3 or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for _ in range(min(keys, 16) + 1):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if keys > 0 else None


def der_length(data: bytes) -> int | None:
    """Bytes of the DER sequence that ``data`` begins with, by its outer length; None if there is none."""
    if len(data) < 6 or data[0] != 0x30:
        return None
    if not data[1] & 0x80:
        return 2 + data[1]
    size = data[1] & 0x7F
    return 2 + size + int.from_bytes(data[2 : 2 + size], "big") if 1 <= size <= 4 else None


def is_token_header(part: bytes) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _decoded(run: bytes) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + b"=" * (-len(run) % 4))


def base64_keys(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of keys in base64, on one line or over consecutive lines that hold nothing else."""
    if b"\\" in text:
        text = ESCAPED_BREAK.sub(lambda m: b"\n".rjust(len(m[0])), text)
    out: list[tuple[int, int, int]] = []
    starts, ends, total, chars, done = [], [], [0], b"", 0
    for m in START_64.finditer(text):
        at = m.start()
        if at < done:
            continue
        if not ends or at >= ends[-1]:
            # the run that begins here and all that go on with it at the next line's beginning
            starts, ends, total, parts, to = [], [], [0], [], at
            while run := RUN_64.match(text, to):
                starts.append(run.start())
                ends.append(run.end())
                parts.append(run[0])
                total.append(total[-1] + len(run[0]))
                if not (line := BREAK.match(text, run.end())):
                    break
                to = line.end()
            chars = b"".join(parts)
        first = bisect.bisect_left(starts, at)
        begin = total[first]
        if chars[begin : begin + 1] == b"M":
            kind, n = 3, der_length(_decoded(chars[begin : begin + 8]))
        else:
            kind, n = 4, openssh_length(_decoded(chars[begin:]))
        if n is None:
            continue
        need = (n * 4 + 2) // 3
        last = bisect.bisect_left(total, begin + need)
        if need < LEAST_64 or last == len(total) or total[last] != begin + need:
            continue  # more than there is, or an end within a run
        data = _decoded(chars[begin : begin + need])
        if len(data) == n and (kind == 4 or is_der_key(data)):
            end = ends[last - 1]
            line, pad = BREAK.match(text, end), b"=" * (-need % 4)
            if pad and line and text.startswith(pad, line.end()):
                end = line.end()
            done = end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip(b"="))
            out.append((at, kind, done))
    return out


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the plain rules."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of what decodes to a key or a signed token."""
    out = []
    for m in LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0].decode())):
            out.append((m.start(), 3, m.end()))
    return out + base64_keys(text) + [(m.start(), 5, m.end()) for m in DOTTED.finditer(text) if is_token_header(m[1])]


def _told(spans: list[tuple[int, int, int]], points: np.ndarray | None) -> str:
    if points is not None:
        spans = [(int(points[a]), k, int(points[b])) for a, k, b in spans]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _scan(batches: Iterator) -> Iterator:
    import pyarrow as pa

    nothing = hashlib.sha256(b"").hexdigest()
    for batch in in_slices(batches, 1 << 20):
        raw, offsets = utf8(batch.column(1))
        whole = raw.tobytes()
        low = whole.lower()
        look = set().union(*[_with_word(low, offsets, w) for w in KEYWORDS], _with_word(whole, offsets, b"AKIA"))
        look |= set(_with_run(raw, offsets, _HEX, 32).tolist())
        coded = set(_with_run(raw, offsets, _CODED, 20).tolist())
        n = len(offsets) - 1
        counts, sha, told = np.zeros((3, n), np.int64), [nothing] * n, [""] * n
        for k in sorted(look | coded):
            text = whole[offsets[k] : offsets[k + 1]]
            base, more = base_spans(text) if k in look else [], confirmed_spans(text) if k in coded else []
            if not base and not more:
                continue
            points = None if text.isascii() else np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            for _, kind, _ in base:
                counts[kind, k] += 1
            sha[k] = hashlib.sha256(_told(base, points).encode()).hexdigest()
            told[k] = _told(base + more, points)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c) for c in counts], pa.array(sha, pa.string()), pa.array(told, pa.string())],
            [batch.schema.names[0], "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the plain rules' spans, SHA-256 of their list, and the list of all spans as ``kind:start:end``."""
    slim = df.select(id_col, text_col)
    more = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return slim.mapInArrow(_scan, T.StructType([slim.schema[id_col], *T._parse_datatype_string(more).fields]))
