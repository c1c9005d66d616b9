"""Expected against heard speech: character error rate and token recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import text as tx
from voxloom.plans.sequences import pin

SEG = ["job_id", "segment_id"]


def normalized(pairs: DataFrame) -> DataFrame:
    """Both texts reduced to comparable tokens."""
    p = pairs.select(*SEG, *[tx.nfc_casefold(c).alias(c) for c in ("expected", "heard")])
    p = pin(p, e=tx.spell_notation(F.col("expected")), h=tx.spell_notation(F.col("heard")))
    return p.select(
        *SEG,
        F.array_join(tx.semantic_tokens(F.col("e")), " ").alias("expected"),
        F.array_join(tx.semantic_tokens(F.col("h")), " ").alias("heard"),
    )


def char_error_rate(pairs: DataFrame) -> DataFrame:
    """Edit distance without blanks over the expected length, in millionths rounded half up."""
    e, h = F.replace("expected", F.lit(" ")), F.replace("heard", F.lit(" "))
    p = pairs.select(*SEG, F.levenshtein(e, h).cast("long").alias("d"), F.greatest(F.lit(1), F.length(e)).cast("long").alias("n"))
    return p.select(*SEG, F.col("d").alias("distance"), F.expr("(d * 2000000 + n) div (2 * n)").alias("cer_e6"))


def _counts(pairs: DataFrame, col: str) -> DataFrame:
    return pairs.select(*SEG, F.explode(tx.tokens(col)).alias("tok")).groupBy(*SEG, "tok").agg(F.count("*").alias(f"n_{col}"))


def token_recall(pairs: DataFrame) -> DataFrame:
    """Share of expected tokens heard, counted with multiplicity, in millionths rounded half up."""
    both = _counts(pairs, "expected").join(_counts(pairs, "heard"), [*SEG, "tok"], "full_outer").fillna(0, ["n_expected", "n_heard"])
    g = both.groupBy(*SEG).agg(
        F.sum(F.least("n_expected", "n_heard")).alias("hit"), F.sum("n_expected").alias("n"), F.sum("n_heard").alias("m")
    )
    g = pairs.select(*SEG).join(g, SEG, "left").fillna(0, ["hit", "n", "m"])
    recall = F.when(F.col("n") > 0, F.expr("(hit * 2000000 + n) div (2 * greatest(n, 1))")).otherwise(
        F.when(F.col("m") == 0, 1_000_000).otherwise(0)
    )
    return g.select(*SEG, recall.cast("long").alias("recall_e6"))


def multiset_intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersectAll(right)
