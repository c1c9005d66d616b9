"""A corpus made ready for training: quality rules, exact copies, near copies, mix of sources, token ids.

Each stage takes the table that the stage before kept and returns the columns of ``documents``; the last returns one row per
remaining document with its token count and the digests of its ids and of the text they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import exact_dedup, jaccard, mixing, pieces, quality
from voxloom.llm.common import keep, table

#: Near copies: shingles of five words, at least 80 percent shared.
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and the likelihood ratio against documents labelled good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for blanks."""
    return exact_dedup.drop_exact(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join."""
    return jaccard.one_of_each(docs, SHINGLE, PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix of sources takes it. Rows of one id but different texts are documents of their own."""
    taken = mixing.mix(docs).where("copies > 0").select(F.col("doc_id").alias("_taken"), F.col("text_hash").alias("_hash"), F.col("copies").cast("int").alias("_copies"))
    # the row travels as one column, so that none of its own columns can clash with the ones joined to it
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    same_text = F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))) == F.col("_hash")
    rows = row.join(taken, F.col("row.doc_id").eqNullSafe(F.col("_taken")) & same_text)
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", token_ids),
]
#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
