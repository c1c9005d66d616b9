"""Mixing sources to target weights by entropy balancing.

Every document gets a rate; among all rates whose tokens add up to each source's target and that stay at most ``cap``, the ones closest to 1 in
relative entropy over documents are the exponential tilts ``min(cap, exp(lambda * size))``, with one multiplier lambda per source. The dual is convex
and is solved by Newton iterations: the constraint needs a document's size only, so documents are read once and counted by (source, size), and
each step is one distributed aggregate of these counts for all sources at once. A step takes the logarithm of the sum, which is nearly straight in lambda,
and is held inside a bracket that closes. Sums are decimal, so they do not depend on the order of rows.

Rates are then rounded to whole copies: documents of a source are ranked by size, longest first (a sampled range sort), and a document's copies are
the whole numbers that ``phase + sum of rates`` passes at it. The sum is a start per (source, size) plus a multiple of the rate, as equal sizes share a rate.
Neighbours in that order are of nearly equal size, so the tokens taken differ from what the rates ask for by less than the longest document. A source's sizes
are dealt to two such rows by their hash, and of all pairs of ``PHASES`` phases the one is taken that comes nearest to the target.

Edge cases: null text and texts of blanks have size 0 and a rate of 1, which takes no tokens; a null source is a source of its own, after all others;
a source without words has target 0 and takes nothing; a source whose target is ``cap`` times its size has the rate ``cap`` throughout; repeated rows are
rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import WORD, keep, partitions

#: Bits of the fixed-point rates.
BITS = 40
ONE = 1 << BITS
PHASES = 32
#: Newton steps stop when every source's tokens are this near to its target, or after so many steps (bisection alone would get there).
NEAR = 1e-9
NEWTON_STEPS = 100


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Per source (``_source``): ``source_size`` and ``target``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share all tokens; a target stops at ``cap`` times its
    source's size and the excess goes to the others by weight, until none is above. The level at which the shares stop
    follows from the order of size to weight, so no rounds are needed.
    """
    totals = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    filled = Window.orderBy(F.col("limit") / F.col("weight"), F.col("_source").asc_nulls_last())
    before, through = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(through)
    ranked = totals.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap))).withColumn("level", level)
    # the level at the first source that it leaves below its limit holds for all after it
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    ranked = ranked.withColumn("stop", F.first(open_, ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return ranked.select("_source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("stop"), F.lit(0.0)) * F.col("weight")).alias("target"))


def dual(counts: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """Add ``lambda`` to ``targets`` (``_source``, ``source_size``, ``target``); ``counts`` has (``_source``, ``size``, ``n``).

    Solves sum(n * size * min(cap, exp(lambda * size))) = target per source. Only the number of sources that are not near yet
    reaches the driver in a step.
    """
    words = counts.where("size > 0")
    least = words.groupBy("_source").agg(F.min("size").alias("_least"))
    tokens, goal = F.col("source_size").cast("double"), F.col("target")
    state = targets.join(least, targets["_source"].eqNullSafe(least["_source"]), "left").drop(least["_source"])
    # no words, or every document at the cap: nothing to solve
    state = state.withColumn("_full", goal >= tokens * F.lit(float(cap)) * F.lit(1 - 1e-12)).withColumn("_done", F.col("_full") | F.col("_least").isNull() | (goal <= 0))
    # at lo the sum is at most the target, at hi at least
    below = F.when((goal > 0) & (goal < tokens), F.log(F.try_divide(goal, tokens)) / F.col("_least"))
    above = F.when(goal > tokens, F.log(F.lit(float(cap))) / F.col("_least"))
    state = keep(
        state.select(
            "_source", "source_size", "target", "_full", "_done", F.coalesce(below, F.lit(0.0)).alias("_lo"), F.coalesce(above, F.lit(0.0)).alias("_hi"), F.lit(0.0).alias("lambda")
        )
    )
    exact = "decimal(38,6)"
    for _ in range(NEWTON_STEPS):
        if not state.where("NOT _done").limit(1).count():
            break
        open_ = state.where("NOT _done").select(F.col("_source").alias("_of"), "lambda")
        tilt = F.exp(F.col("lambda") * F.col("size"))
        mass = F.col("n") * F.col("size").cast("double")
        sums = words.join(open_, words["_source"].eqNullSafe(open_["_of"])).groupBy("_of").agg(
            F.sum((mass * F.least(F.lit(float(cap)), tilt)).cast(exact)).cast("double").alias("_sum"),
            F.sum(F.when(tilt < cap, mass * F.col("size") * tilt).otherwise(F.lit(0.0)).cast(exact)).cast("double").alias("_slope"),
        )
        s = state.join(sums, state["_source"].eqNullSafe(sums["_of"]), "left").drop("_of")
        s = s.withColumn("_lo", F.when(F.col("_sum") < goal, F.col("lambda")).otherwise(F.col("_lo")))
        s = s.withColumn("_hi", F.when(F.col("_sum") > goal, F.col("lambda")).otherwise(F.col("_hi")))
        middle = (F.col("_lo") + F.col("_hi")) / 2
        newton = F.col("lambda") - F.try_divide((F.log("_sum") - F.log("target")) * F.col("_sum"), F.col("_slope"))
        inside = F.when((newton > F.col("_lo")) & (newton < F.col("_hi")), newton).otherwise(middle)
        closed = (middle <= F.col("_lo")) | (middle >= F.col("_hi"))
        near = (F.abs(F.col("_sum") - goal) <= goal * NEAR) | closed
        done = F.col("_done") | near
        step = F.when(done, F.col("lambda")).otherwise(inside)
        state = keep(s.select("_source", "source_size", "target", "_full", done.alias("_done"), "_lo", "_hi", step.alias("lambda")))
    return state.drop("_done", "_lo", "_hi")


def rates(counts: DataFrame, solved: DataFrame, cap: float) -> DataFrame:
    """Per (``_source``, ``size``): the rate, in units of ``ONE`` too, and what longer sizes hold: the
    documents of the source, and the units (modulo ``ONE``) of the same half of its sizes."""
    s = solved.select(F.col("_source").alias("_of"), "source_size", "target", "_full", "lambda")
    tilt = F.least(F.lit(float(cap)), F.exp(F.col("lambda") * F.col("size")))
    r = counts.join(s, counts["_source"].eqNullSafe(s["_of"])).drop("_of")
    r = r.withColumn("rate", F.when(F.col("target") <= 0, F.lit(0.0)).when(F.col("_full"), F.lit(float(cap))).otherwise(tilt))
    r = r.withColumn("_unit", F.round(F.col("rate") * F.lit(float(ONE))).cast("long"))
    # one row per length that occurs: a source's window is bounded by its longest document
    r = r.withColumn("_half", F.pmod(F.xxhash64("size"), F.lit(2)).cast("int"))
    longer = Window.partitionBy("_source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    of_half = Window.partitionBy("_source", "_half").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    units = F.sum(F.col("n").cast("decimal(19,0)") * F.col("_unit").cast("decimal(19,0)")).over(of_half)
    return r.select(
        "_source", "size", "source_size", "target", "rate", "_unit", "_half", F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("_docs"),
        F.pmod(F.coalesce(units, F.lit(0)).cast("decimal(38,0)"), F.lit(ONE)).cast("long").alias("_from"),
    )


def _ranked(sizes: DataFrame) -> DataFrame:
    """Rank of each document in its source, longest first, without bringing a source into one task."""
    order = [F.col("size").desc(), F.col("_id").asc_nulls_last(), F.col("_tie")]
    placed = keep(
        sizes.repartitionByRange(partitions(sizes.sparkSession), F.col("_source").asc_nulls_last(), *order).withColumn("_part", F.spark_partition_id())
    )
    counts = placed.groupBy("_source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_source", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_source", "_part").orderBy(*order))
    rows = placed.withColumn("_rank", rank)
    same = rows["_source"].eqNullSafe(counts["_source"]) & (rows["_part"] == counts["_part"])
    return rows.join(counts, same).select(rows["_id"], rows["_source"], "size", "_tie", (F.col("_rank") + F.col("_before")).alias("_rank"))


def copies(start, unit, phase):
    """Whole numbers passed by ``unit`` from ``start``, both in units of ``ONE``."""
    at = start + F.lit(phase) if isinstance(phase, int) else start + phase
    return F.shiftright(at + unit, BITS) - F.shiftright(at, BITS)


def mix(
    df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per document: id, ``source``, ``size`` (words), ``source_size``, ``target``, ``rate``, ``copies``, ``taken`` (copies * size) and ``text_hash``.

    ``text_hash`` (``xxhash64`` of the text, null as empty) tells rows of equal ids apart.

    ``cap`` bounds a source's target and, with it, a document's copies (rounded up). Nothing is random: reruns agree.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = keep(
        df.select(
            F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("_tie")
        )
    )
    counts = keep(sizes.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("n")))
    solved = dual(counts, source_targets(sizes, weights, cap), cap)
    rate = keep(rates(counts, solved, cap)).withColumnRenamed("_source", "_of").withColumnRenamed("size", "_size")
    rows = _ranked(sizes)
    rows = rows.join(rate, rows["_source"].eqNullSafe(rate["_of"]) & (rows["size"] == rate["_size"])).drop("_of", "_size")
    passed = (F.col("_rank") - F.col("_docs") - 1).cast("decimal(19,0)") * F.col("_unit").cast("decimal(19,0)") + F.col("_from")
    rows = keep(rows.withColumn("_at", F.pmod(passed, F.lit(ONE)).cast("long")).drop("_rank", "_docs", "_from"))
    phases = [ONE * (2 * k + 1) // (2 * PHASES) for k in range(PHASES)]
    sums = F.array(*[F.sum(copies(F.col("_at"), F.col("_unit"), p) * F.col("size")) for p in phases])
    near = rows.groupBy("_source", "_half").agg(F.first("target").alias("_goal"), sums.alias("_sums"))
    half = lambda k: F.coalesce(F.max(F.when(F.col("_half") == k, F.col("_sums"))), F.array_repeat(F.lit(0).cast("long"), PHASES))
    near = near.groupBy("_source").agg(F.first("_goal").alias("_goal"), half(0).alias("_a"), half(1).alias("_b"))
    pairs = F.flatten(
        F.transform("_a", lambda x, i: F.transform("_b", lambda y, k: F.struct(F.abs(x + y - F.col("_goal")).alias("off"), F.array(i, k).alias("pair"))))
    )
    chosen = F.transform(F.array_min(pairs)["pair"], lambda k: F.element_at(F.array(*[F.lit(p).cast("long") for p in phases]), k + 1))
    near = near.select("_source", chosen.alias("_phases"))
    done = rows.join(near, rows["_source"].eqNullSafe(near["_source"])).drop(near["_source"])
    done = done.withColumn("copies", copies(F.col("_at"), F.col("_unit"), F.element_at("_phases", F.col("_half") + 1)).cast("long"))
    return done.select(
        F.col("_id").alias(id_col), F.col("_source").alias("source"), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.col("_tie").alias("text_hash"),
    )
