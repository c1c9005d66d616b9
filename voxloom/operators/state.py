"""Work left and progress: checkpoints, artifact manifests, batches, resume plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import rules
from voxloom.operators import glossary as gl


def latest_manifest(manifest: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One entry per artifact, the last written wins; partial aggregates travel, not all versions.

    Where the order names every column beside the key, the greatest order is the entry, and no column travels twice.
    """
    rest = [c for c in manifest.columns if c not in key]
    last = F.max(F.struct(*order)) if set(rest) <= set(order) else F.max_by(F.struct(*rest), F.struct(*order))
    m = manifest.groupBy(*key).agg(last.alias("m"))
    return m.select(*key, *[F.col("m")[c].alias(c) for c in rest])


def invalid_artifacts(manifest: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Manifest entries whose file is missing or differs."""
    f = files.select(*key, F.col("sha256").alias("found"))
    j = manifest.join(f, key, "left")
    reason = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "checksum")
    return j.select(*key, reason.alias("reason")).where("reason IS NOT NULL")


def invalid_checkpoints(checkpoints: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Completed units fall back to pending without a valid file; a null checksum is accepted."""
    f = files.select(*key, F.col("sha256").alias("found"))
    j = checkpoints.join(f, key, "left")
    broken = F.col("found").isNull() | (F.col("sha256").isNotNull() & (F.col("sha256") != F.col("found")))
    return j.withColumn("status", F.when((F.col("status") == "completed") & broken, "pending").otherwise(F.col("status"))).drop("found")


def reconcile_checkpoints(units: DataFrame, checkpoints: DataFrame, key: list[str]) -> DataFrame:
    """Current units with their old status; new ones pending, vanished ones dropped."""
    c = checkpoints.select(*key, "status", "error")
    return units.select(*key).join(c, key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def pending_units(units: DataFrame, checkpoints: DataFrame, key: list[str]) -> DataFrame:
    """Units without a completed checkpoint that has an artifact."""
    return units.join(_done(checkpoints, key), key, "left_anti")


def reusable_units(units: DataFrame, checkpoints: DataFrame, key: list[str]) -> DataFrame:
    return units.join(_done(checkpoints, key), key, "left_semi")


def _done(checkpoints: DataFrame, key: list[str]) -> DataFrame:
    return checkpoints.where("status = 'completed' AND artifact IS NOT NULL").select(*key)


def unknown_ids(requested: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    return requested.join(known.select(*key), key, "left_anti").select(*key).distinct()


def checkpoint_progress(checkpoints: DataFrame, key: list[str]) -> DataFrame:
    return checkpoints.groupBy(*key).agg(
        F.count_if(F.col("status") == "completed").alias("done"), F.count("*").alias("total"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def incomplete_units(checkpoints: DataFrame, key: list[str]) -> DataFrame:
    """One row per unit that is not completed, with its status; a unit without a status counts as pending."""
    status = F.coalesce("status", F.lit("pending"))
    return checkpoints.where(status != "completed").select(*key, status.alias("status"))


def batch_status(jobs: DataFrame) -> DataFrame:
    """Per batch: jobs per status as a map, and the batch's own status."""
    per = jobs.groupBy("batch_id", "status").agg(F.count("*").alias("n"))
    # at most one entry per status
    b = per.groupBy("batch_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"), F.sum("n").alias("jobs"))

    def n(status: str) -> Column:
        return F.coalesce(F.try_element_at("counts", F.lit(status)), F.lit(0))

    final = (
        F.when(n("completed") == F.col("jobs"), "completed")
        .when(n("failed") == F.col("jobs"), "failed")
        .when(n("failed") > 0, "partial_failed")
        .when(n("waiting_review") > 0, "waiting_review")
        .otherwise("running")
    )
    return b.select("batch_id", "jobs", "counts", final.alias("status"))


def job_progress(jobs: DataFrame, progress: DataFrame) -> DataFrame:
    """'stage done/total', 'stage status', the bare stage, or '-' per job (``current_stage``)."""
    p = progress.select("job_id", F.col("stage").alias("current_stage"), F.col("status").alias("s"), "done", "total")
    j = jobs.join(p, ["job_id", "current_stage"], "left")
    stage = F.col("current_stage")
    label = (
        F.when(stage.isNull() | (stage == ""), "-")
        .when(F.col("done").isNotNull() & F.col("total").isNotNull(), F.format_string("%s %d/%d", stage, "done", "total"))
        .when(F.col("s").isNotNull() & (F.col("s") != ""), F.concat_ws(" ", stage, "s"))
        .otherwise(stage)
    )
    return j.select("job_id", label.alias("progress"))


def batch_summary(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("batch_id").agg(F.count("*").alias("jobs"), F.max("updated_ms").alias("updated_ms"))


def resume_plan(
    progress: DataFrame, artifacts: DataFrame, files: DataFrame, *, from_stage: str | None = None, no_cache: bool = False
) -> DataFrame:
    """Where each job resumes: the first stage that waits, is not completed, or lacks a valid artifact.

    ``progress`` (job_id, stage, status), ``artifacts`` (job_id, name, version, path, sha256) and
    ``files`` (job_id, path, sha256). The stage and requirement lists are fixed and tiny.
    """
    if from_stage is not None:
        keep = from_stage == "tts" and not no_cache
        return progress.select("job_id").distinct().select(
            "job_id", F.lit(from_stage).alias("start_stage"), F.lit(False).alias("already_completed"),
            F.lit(keep).alias("preserve_checkpoints"), F.lit("from_stage_requested").alias("reason"),
        )
    # of each row only which stages or artifacts it speaks of moves on, as bits
    zero = F.lit(0).cast("long")
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(len(rules.STAGES))])
    bit = F.coalesce(F.get(bits, (_ordinal(F.col("stage")) - 1).cast("int")), zero)
    wrong = F.when(F.col("status").eqNullSafe("completed"), zero).otherwise(bit)
    told = progress.select("job_id", F.lit(True).alias("job"), bit.alias("seen"), wrong.alias("wrong"), zero.alias("has"))
    needs = [(F.lit(1 << i).cast("long"), (F.col("name") == n) & (F.col("version") == v)) for i, (_, n, v) in enumerate(rules.REQUIRED_ARTIFACTS)]
    has = sum((F.when(same, b).otherwise(zero) for b, same in needs), zero)
    valid = artifacts.select("job_id", "path", "sha256", has.alias("has")).where("has > 0").join(files, ["job_id", "path", "sha256"], "left_semi")
    told = told.unionByName(valid.select("job_id", F.lit(False).alias("job"), zero.alias("seen"), zero.alias("wrong"), "has"))
    p = told.groupBy("job_id").agg(F.max("job").alias("job"), *[F.bit_or(c).alias(c) for c in ("seen", "wrong", "has")]).where("job")

    def bad(i: int, stage: str) -> Column:
        must = sum(1 << k for k, (s, _, _) in enumerate(rules.REQUIRED_ARTIFACTS) if s == stage)
        done = (F.getbit("seen", F.lit(i)) == 1) & (F.getbit("wrong", F.lit(i)) == 0) & (F.col("has").bitwiseAND(F.lit(must).cast("long")) == must)
        return F.when(~done, F.lit(stage))

    # rows without a job belong to no job, so none of them is invalid
    p = p.withColumn("first_bad", F.when(F.col("job_id").isNotNull(), F.coalesce(*[bad(i, s) for i, s in enumerate(rules.STAGES)])))
    none = F.col("first_bad").isNull()
    if no_cache:
        start = F.coalesce("first_bad", F.lit("tts"))
        reason = F.when(none, "completed_job_no_cache_defaults_to_tts").otherwise("first_invalid_stage")
        complete = F.lit(False)
    else:
        start, complete = F.col("first_bad"), none
        reason = F.when(none, "all_stages_valid").otherwise("first_invalid_stage")
    return p.select(
        "job_id", start.alias("start_stage"), complete.alias("already_completed"),
        (~none & F.lit(not no_cache)).alias("preserve_checkpoints"), reason.alias("reason"),
    )


def _ordinal(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in rules.STAGES]), stage)


def reset_progress(progress: DataFrame, resets: DataFrame) -> DataFrame:
    """Every stage at or after the job's ``from_stage`` becomes pending."""
    r = resets.select("job_id", _ordinal(F.col("from_stage")).alias("_from"))
    p = progress.join(r, "job_id", "left")
    hit = F.coalesce(_ordinal(F.col("stage")) >= F.col("_from"), F.lit(False))
    return p.select("job_id", "stage", F.when(hit, "pending").otherwise(F.col("status")).alias("status"))


def drop_artifacts(artifacts: DataFrame, resets: DataFrame, *, preserve_checkpoints: bool = False) -> DataFrame:
    """Artifacts left after a reset; the reset stage's own checkpoint table may be kept."""
    names = F.create_map(*[F.lit(x) for kv in rules.CHECKPOINT_ARTIFACTS.items() for x in kv])
    r = resets.select("job_id", _ordinal(F.col("from_stage")).alias("_from"), F.try_element_at(names, F.col("from_stage")).alias("_keep"))
    a = artifacts.join(r, "job_id", "left")
    gone = F.coalesce(_ordinal(F.col("stage")) >= F.col("_from"), F.lit(False))
    kept = F.coalesce(F.col("name") == F.col("_keep"), F.lit(False)) & F.lit(preserve_checkpoints)
    return a.where(~gone | kept).drop("_from", "_keep")


def shared_glossary(terms: DataFrame) -> DataFrame:
    """Terms of all recordings of a batch merged once, one row per batch and term; recordings find them by their batch."""
    merged = gl.merge_glossary(terms, ["batch_id"])
    spread = terms.select("batch_id", "job_id", F.lower(F.trim("original")).alias("term_key")).distinct()
    n = spread.groupBy("batch_id", "term_key").agg(F.count("*").alias("n_jobs"))
    return merged.join(n, ["batch_id", "term_key"]).select("batch_id", "term_key", "term_id", "locked", "n_jobs")


def batch_recordings(terms: DataFrame) -> DataFrame:
    """Which recordings share a batch's terms."""
    return terms.select("batch_id", "job_id").distinct()


def union_transcripts(parts: list[DataFrame]) -> DataFrame:
    """Segments of several recordings in one table, ids prefixed by the recording."""
    out = None
    for p in parts:
        k = p.withColumn("segment_id", F.concat_ws("::", F.col("job_id").cast("string"), "segment_id"))
        out = k if out is None else out.unionByName(k)
    return out
