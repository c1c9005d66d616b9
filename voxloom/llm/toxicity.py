"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function of its distinct words and their beginnings, hashed; a document's is their
noisy-or, 1 - prod(1 - p). Only document labels are known; fitting the noisy-or to them teaches the model which sentences offend,
and ``locate`` returns those. The model is fitted on at most ``FIT_ROWS`` labelled documents, the ones with the smallest hash of their
id (a documented bound: Spark counts their words and picks the telling ones; the fit runs on the driver over those, a few numbers a sentence);
every document is scored whole.

Edge cases: null texts and texts without words have one sentence without words and get the model's floor as score; without
labels of both kinds the score is the share of label 1 (0 without any); repeated rows get equal scores; an empty table gives
an empty result; extra columns are not touched.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import in_slices, keep

BUCKETS = 1 << 18
FIT_ROWS = 8_000
#: A word of fewer fitted documents has no weight of its own.
LEAST_DOCS = 5
EPOCHS, RATE, DECAY = 400, 0.1, 1e-3
BEGINNINGS = (3, 4, 5, 6, 7)
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_`~"


def features(word: str) -> list[int]:
    """Buckets of a word without case and edge punctuation, and of its beginnings: compounds of a word share them."""
    word = word.lower().strip(EDGES)
    if not word:
        return []
    parts = [word + "$", *[word[:n] for n in BEGINNINGS if len(word) >= n]]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s.strip()] or [""]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    floor: float

    def __post_init__(self):
        self.words: dict[str, float] = {}

    def weight(self, word: str) -> float:
        got = float(sum(self.weights[k] for k in features(word)))
        if len(self.words) > 500_000:
            self.words.clear()
        self.words[word] = got
        return got

    def scores(self, text: str) -> list[float]:
        """Logits of a text's sentences."""
        get, weight, out = self.words.get, self.weight, []
        for s in sentences(text):
            total = self.bias
            for w in set(s.split()):
                x = get(w)
                total += weight(w) if x is None else x
            out.append(total)
        return out

    def document(self, text: str) -> float:
        z = np.minimum(np.array(self.scores(text)), 30.0)
        p = -np.expm1(-np.logaddexp(0, z).sum())
        return float(self.floor + (1 - self.floor) * p)


def telling(docs: np.ndarray, positive: np.ndarray, rows: int, share: float) -> np.ndarray:
    """Buckets whose share of label 1 stands out, by the normal approximation of the binomial, from ``LEAST_DOCS`` documents on."""
    z = (positive - docs * share) / np.sqrt(np.maximum(docs, 1) * max(share * (1 - share), 1e-12))
    return np.flatnonzero((docs >= LEAST_DOCS) & (np.abs(z) > 4)) if rows else np.zeros(0, np.int64)


def fit(bags: list[bytes], labels: np.ndarray, chosen: np.ndarray = np.zeros(0, np.int64)) -> Model:  # noqa: B008
    """Fit sentence weights to document labels: full-gradient Adam on the noisy-or's log-likelihood.

    A bag is a document's sentences as 32-bit numbers: places in ``chosen``, and -1 at the end of each sentence.
    ``floor`` is the chance of label 1 without any offending sentence (label noise): it keeps such documents from bending the weights.
    """
    y = labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), -30.0, float(y.mean()) if len(y) else 0.0)
    flat = np.frombuffer(b"".join(bags), np.int32)
    ends = flat == -1
    sentence_of = np.repeat(np.arange(len(bags)), [len(b) // 4 for b in bags])[ends]
    col, row = flat[~ends], np.cumsum(ends)[~ends]
    n_sent, n_docs = len(sentence_of), len(bags)
    w, b, f = np.zeros(len(chosen)), -6.0, np.log(0.05)
    m, v = np.zeros(len(chosen) + 2), np.zeros(len(chosen) + 2)
    for step in range(1, EPOCHS + 1):
        logit = np.minimum(b + np.bincount(row, weights=w[col], minlength=n_sent), 30.0)
        p = 1 / (1 + np.exp(-logit))
        quiet = np.bincount(sentence_of, weights=np.logaddexp(0, logit), minlength=n_docs)  # -log prod(1 - p)
        floor = 1 / (1 + np.exp(-f))
        calm = np.exp(-quiet)
        score = np.clip(1 - (1 - floor) * calm, 1e-9, 1 - 1e-9)
        slope = (score - y) / (score * (1 - score))  # of the loss by the score
        by_quiet = slope * (1 - floor) * calm
        by_logit = by_quiet[sentence_of] * p
        grad = np.concatenate([np.bincount(col, weights=by_logit[row], minlength=len(chosen)), [by_logit.sum(), (slope * calm).sum() * floor * (1 - floor)]]) / n_docs
        grad[:-2] += DECAY * w / max(1, len(chosen)) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b, f = w - move[:-2], b - move[-2], f - move[-1]
    weights = np.zeros(BUCKETS, np.float32)
    weights[chosen] = w
    return Model(weights, float(b), float(1 / (1 + np.exp(-f))))


def _tally(batches: Iterator) -> Iterator:
    """Documents, and documents of label 1, that each bucket occurs in; the last bucket counts all documents."""
    import pyarrow as pa

    docs, positive = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    for batch in in_slices(batches, 1 << 20):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = list({k for w in set((text or "").split()) for k in features(w)}) + [BUCKETS]
            docs[seen] += 1
            positive[seen] += label
    seen = np.flatnonzero(docs)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(docs[seen]), pa.array(positive[seen])], ["bucket", "docs", "positive"])


def _bags(chosen: np.ndarray):
    """Bags of the chosen buckets only, as ``fit`` takes them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        place = {int(k): i for i, k in enumerate(chosen)}
        for batch in in_slices(batches, 1 << 20):
            out = []
            for text in batch.column(0).to_pylist():
                said = ([place[k] for w in sorted(set(s.split())) for k in features(w) if k in place] for s in sentences(text or ""))
                out.append(np.array([k for s in said for k in (*s, -1)], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1), batch.column(2)], ["bag", "label", "place"])

    return run


def train(df: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``rows`` labelled documents. Rows without id or label are left out of the fit.

    Word counts are added up by Spark; the driver gets ``BUCKETS`` sums and, per document, only the buckets that tell labels apart.
    """
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    sample = df.join(F.broadcast(picked), df[id_col] == picked["_id"])  # at most `rows` rows of two numbers
    sample = keep(sample.select(df[text_col].alias("_text"), F.col("_label").alias("label"), F.xxhash64(df[id_col]).alias("place")))
    parts = sample.mapInArrow(_tally, "bucket int, docs long, positive long").groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("positive").alias("positive"))
    sums = parts.toArrow()  # at most BUCKETS + 1 rows
    docs, positive = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    for out, name in ((docs, "docs"), (positive, "positive")):
        out[sums.column("bucket").to_numpy()] = sums.column(name).to_numpy()
    n = int(docs[-1])
    chosen = telling(docs[:-1], positive[:-1], n, positive[-1] / max(n, 1))
    got = sample.mapInArrow(_bags(chosen), "bag binary, label int, place long").collect()
    got.sort(key=lambda r: (r["place"], r["bag"], r["label"]))  # the order of summation, whatever the partitions
    return fit([bytes(r["bag"]) for r in got], np.array([r["label"] for r in got], np.int64), chosen)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``score``."""
    slim = df.select(id_col, text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in in_slices(batches, 1 << 20):
            got = [model.document(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], [id_col, "score"])

    return slim.mapInArrow(run, T.StructType([slim.schema[id_col], T.StructField("score", T.DoubleType())]))


def locate(df: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The offending sentences: id, number of the sentence in its document, sentence and its score, for scores of at least ``least``."""
    slim = df.select(id_col, text_col)
    edge = float(np.log(least / (1 - least)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in in_slices(batches, 1 << 20):
            ids, at, said, how = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for i, (s, z) in enumerate(zip(sentences(text or ""), model.scores(text or ""), strict=True)):
                    if z >= edge:
                        ids.append(k)
                        at.append(i)
                        said.append(s)
                        how.append(1 / (1 + float(np.exp(-z))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(at, pa.int32()), pa.array(said, pa.string()), pa.array(how, pa.float64())],
                [id_col, "sentence_no", "sentence", "score"],
            )

    return slim.mapInArrow(run, T.StructType([slim.schema[id_col], *T._parse_datatype_string("sentence_no int, sentence string, score double").fields]))
