"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import centroids, collocations, exact_dedup, jaccard, mixing, packing, pages, pieces, quality, secrets, shards, token_file, toxicity
from voxloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_entropy_mix")
def op1(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query(
    "op5_content_sort",
    r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain FROM documents),
g AS (SELECT plain, arg_min(doc_id, (-len, doc_id)) AS keep_id, count(*) AS group_size FROM n GROUP BY plain)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM n JOIN g USING (plain)
""",
)
def op5(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op9_minimax_shards")
def op9(spark, sf_dir):
    out = shards.shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_quality_rules")
def op2(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.quality(table(spark, sf_dir, "documents"), trusted)


@query("op3_jaccard_join")
def op3(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


@query("op4_page_text")
def op4(spark, sf_dir):
    out = pages.page_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeats")


@query("op6_toxicity")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 4
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(part != 2))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (part == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op7_sentencepiece")
def op7(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_secret_scan")
def op8(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op10_token_files")
def op10(spark, sf_dir):
    return token_file.through_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op11_ns_bounds", centroids.sql())
def op11(spark, sf_dir):
    found, middles, _ = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(found, middles)


@query("op13_nnls_packing")
def op13(spark, sf_dir):
    got = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return got.pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op12_fm_phrases", collocations.sql())
def op12(spark, sf_dir):
    return collocations.top(table(spark, sf_dir, "documents"))
