"""Queries on manifests, checkpoints, batches, stored artifacts and streams."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.catalog.base import cte, query
from voxloom.functions import rules
from voxloom.operators import state as st
from voxloom.operators import units as un
from voxloom.session import shared_dir
from voxloom.sources import artifacts as ar
from voxloom.sources import commits as cm
from voxloom.sources import media
from voxloom.sources.derive import raw, table
from voxloom.streaming import jobs as sj

ORDER = ["created_ms", "partkey", "suppkey", "cents", "returnflag", "linestatus", "tax_pct"]
KEY = ["job_id", "name"]


def _scratch(spark, what):
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _latest(spark, sf):
    return table(spark, sf, "latest")


def _files(latest):
    sha = F.when(F.col("tax_pct") >= 7, F.md5("sha256")).otherwise(F.col("sha256"))
    return latest.where("returnflag <> 'R'").select(*KEY, sha.alias("sha256"))


def _checkpoints(latest):
    s = (
        F.when(F.col("linestatus") == "F", "completed").when(F.col("returnflag") == "A", "failed").otherwise("pending")
    )
    k = F.col("partkey") % 6
    return latest.select(
        *KEY, s.alias("status"), F.when(k > 0, F.col("sha256")).alias("sha256"), F.when(k != 1, F.lit("file")).alias("artifact"),
        F.when(s == "failed", F.lit("boom")).alias("error"),
    )


cte("latest", ("manifest",), """
SELECT m.job_id, m.name, r.* FROM (SELECT job_id, name, arg_max({'created_ms':created_ms,'partkey':partkey,'suppkey':suppkey,'cents':cents,'sha256':sha256,'returnflag':returnflag,'linestatus':linestatus,'tax_pct':tax_pct},
 row(created_ms,partkey,suppkey,cents,returnflag,linestatus,tax_pct)) AS r FROM manifest GROUP BY job_id, name) m""")
cte("files", ("latest",), "SELECT job_id, name, CASE WHEN tax_pct>=7 THEN md5(sha256) ELSE sha256 END AS sha256 FROM latest WHERE returnflag<>'R'")
cte("cps", ("latest",), """
SELECT job_id, name, CASE WHEN linestatus='F' THEN 'completed' WHEN returnflag='A' THEN 'failed' ELSE 'pending' END AS status, CASE WHEN partkey%6>0 THEN sha256 END AS sha256,
 CASE WHEN partkey%6<>1 THEN 'file' END AS artifact, CASE WHEN linestatus<>'F' AND returnflag='A' THEN 'boom' END AS error FROM latest""")


@query("latest_manifest", ("latest",), "SELECT * FROM latest")
def latest_manifest(spark, sf):
    return st.latest_manifest(table(spark, sf, "manifest"), KEY, ORDER)


@query("invalid_artifacts", ("latest", "files"), """
SELECT l.job_id, l.name, CASE WHEN f.sha256 IS NULL THEN 'missing' ELSE 'checksum' END AS reason FROM latest l LEFT JOIN files f ON l.job_id=f.job_id AND l.name=f.name WHERE f.sha256 IS NULL OR f.sha256<>l.sha256""")
def invalid_artifacts(spark, sf):
    m = _latest(spark, sf)
    return st.invalid_artifacts(m, _files(m), KEY)


@query("invalid_checkpoints", ("cps", "files"), """
SELECT c.job_id, c.name, CASE WHEN c.status='completed' AND (f.sha256 IS NULL OR (c.sha256 IS NOT NULL AND c.sha256<>f.sha256)) THEN 'pending' ELSE c.status END AS status, c.sha256, c.artifact, c.error
FROM cps c LEFT JOIN files f ON c.job_id=f.job_id AND c.name=f.name""")
def invalid_checkpoints(spark, sf):
    m = _latest(spark, sf)
    return st.invalid_checkpoints(_checkpoints(m), _files(m), KEY)


def _units(spark, sf):
    """Units 1..4 of every order, whether or not they were ever started."""
    o = raw(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"))
    return o.select("job_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("name"))


cte("units", (), "SELECT o_orderkey AS job_id, unnest([1,2,3,4])::BIGINT AS name FROM orders")


@query("reconcile_checkpoints", ("units", "cps"), "SELECT u.job_id, u.name, coalesce(status,'pending') AS status, error FROM units u LEFT JOIN cps c ON u.job_id=c.job_id AND u.name=c.name")
def reconcile_checkpoints(spark, sf):
    return st.reconcile_checkpoints(_units(spark, sf), _checkpoints(_latest(spark, sf)), KEY)


@query("pending_units", ("units", "cps"), "SELECT * FROM units u WHERE NOT EXISTS (SELECT 1 FROM cps c WHERE c.job_id=u.job_id AND c.name=u.name AND status='completed' AND artifact IS NOT NULL)")
def pending_units(spark, sf):
    return st.pending_units(_units(spark, sf), _checkpoints(_latest(spark, sf)), KEY)


@query("reusable_units", ("units", "cps"), "SELECT * FROM units u WHERE EXISTS (SELECT 1 FROM cps c WHERE c.job_id=u.job_id AND c.name=u.name AND status='completed' AND artifact IS NOT NULL)")
def reusable_units(spark, sf):
    return st.reusable_units(_units(spark, sf), _checkpoints(_latest(spark, sf)), KEY)


@query("unknown_ids", (), "SELECT DISTINCT o_custkey AS batch_id, o_orderkey+o_orderkey%2*10000000 AS job_id FROM orders WHERE o_orderkey%2=1")
def unknown_ids(spark, sf):
    o = raw(spark, sf, "orders").select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("job_id"))
    asked = o.withColumn("job_id", F.col("job_id") + F.col("job_id") % 2 * 10_000_000)
    return st.unknown_ids(asked, o, ["batch_id", "job_id"])


@query("id_difference", (), "SELECT o_custkey AS id FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus='F'")
def id_difference(spark, sf):
    o = raw(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("id")).subtract(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("checkpoint_progress", ("cps",), """
SELECT job_id, count(*) FILTER (status='completed') AS done, count(*) AS total, count(*) FILTER (status='failed') AS failed FROM cps GROUP BY job_id""")
def checkpoint_progress(spark, sf):
    return st.checkpoint_progress(_checkpoints(_latest(spark, sf)), ["job_id"])


@query("incomplete_units", ("cps",), "SELECT job_id, name, status FROM cps WHERE status<>'completed'")
def incomplete_units(spark, sf):
    return st.incomplete_units(_checkpoints(_latest(spark, sf)), ["job_id", "name"])


def _batch_jobs(spark, sf):
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed")
        .when(F.col("o_orderkey") % 2 == 0, "waiting_review").otherwise("running")
    )
    return raw(spark, sf, "orders").select(
        F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("job_id"), status.alias("status"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("updated_ms"),
    )


cte("bjobs", (), """
SELECT o_custkey AS batch_id, o_orderkey AS job_id, CASE WHEN o_orderstatus='F' THEN 'completed' WHEN o_orderstatus='P' THEN 'failed' WHEN o_orderkey%2=0 THEN 'waiting_review' ELSE 'running' END AS status, CAST(round(o_totalprice*100) AS BIGINT) AS updated_ms FROM orders""")


@query("batch_status", ("bjobs",), """
SELECT batch_id, n AS jobs, CASE WHEN c=n THEN 'completed' WHEN f=n THEN 'failed' WHEN f>0 THEN 'partial_failed' WHEN w>0 THEN 'waiting_review' ELSE 'running' END AS status, c AS n_completed, f AS n_failed FROM (
 SELECT batch_id, count(*) AS n, count(*) FILTER (status='completed') AS c, count(*) FILTER (status='failed') AS f, count(*) FILTER (status='waiting_review') AS w FROM bjobs GROUP BY 1)""")
def batch_status(spark, sf):
    b = st.batch_status(_batch_jobs(spark, sf))

    def n(s):
        return F.coalesce(F.try_element_at("counts", F.lit(s)), F.lit(0))

    return b.select("batch_id", "jobs", "status", n("completed").alias("n_completed"), n("failed").alias("n_failed"))


@query("batch_summary", ("bjobs",), "SELECT batch_id, count(*) AS jobs, max(updated_ms) AS updated_ms FROM bjobs GROUP BY 1")
def batch_summary(spark, sf):
    return st.batch_summary(_batch_jobs(spark, sf))


def _progress(spark, sf):
    """Stage rows: the first seven stages from manifest entries, the last from the order's status."""
    m = _latest(spark, sf)
    names = F.array(*[F.lit(s) for s in rules.STAGES])
    done = (
        F.when(F.col("linestatus") == "F", "completed").when(F.col("returnflag") == "R", "waiting_review").otherwise("pending")
    )
    p = m.select(
        "job_id", F.get(names, (F.col("name") - 1).cast("int")).alias("stage"), done.alias("status"),
        F.when(F.col("tax_pct") > 2, F.col("tax_pct")).alias("done"), F.lit(8).cast("long").alias("total"),
    )
    none = F.lit(None).cast("long")
    o = raw(spark, sf, "orders").where("o_orderstatus = 'F'")
    return p.unionByName(
        o.select(F.col("o_orderkey").alias("job_id"), F.lit("mixing").alias("stage"), F.lit("completed").alias("status"), none.alias("done"), none.alias("total"))
    )


STAGE_LIST = "['job_init','audio_extract','vad','asr','glossary','translation','tts','mixing']"
cte("prog", ("latest",), f"""
SELECT job_id, {STAGE_LIST}[name] AS stage, name AS ord, CASE WHEN linestatus='F' THEN 'completed' WHEN returnflag='R' THEN 'waiting_review' ELSE 'pending' END AS status,
 CASE WHEN tax_pct>2 THEN tax_pct END AS done, 8 AS total FROM latest UNION ALL SELECT o_orderkey, 'mixing', 8, 'completed', NULL, NULL FROM orders WHERE o_orderstatus='F'""")


@query("job_progress", ("prog",), f"""
SELECT o.o_orderkey AS job_id, CASE WHEN k=0 THEN '-' WHEN p.done IS NOT NULL AND p.total IS NOT NULL THEN s||' '||p.done||'/'||p.total WHEN p.status IS NOT NULL THEN s||' '||p.status ELSE s END AS progress
FROM (SELECT *, o_orderkey%9 AS k, {STAGE_LIST}[CAST(o_orderkey%9 AS BIGINT)] AS s FROM orders) o LEFT JOIN prog p ON p.job_id=o.o_orderkey AND p.stage=o.s""")
def job_progress(spark, sf):
    names = F.array(*[F.lit(s) for s in rules.STAGES])
    k = (F.col("o_orderkey") % 9).cast("int")
    j = raw(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(k > 0, F.get(names, k - 1)).alias("current_stage"))
    return st.job_progress(j, _progress(spark, sf))


def _named(spark, sf):
    """Every required artifact of a stage, carried by that stage's manifest entry, and the files found."""
    names = F.array(*[F.lit(s) for s in rules.STAGES])
    need = F.array(*[F.struct(F.lit(s).alias("st"), F.lit(n).alias("art"), F.lit(v).alias("version")) for s, n, v in rules.REQUIRED_ARTIFACTS])
    m = _latest(spark, sf).withColumn("stage", F.get(names, (F.col("name") - 1).cast("int")))
    a = m.select("job_id", "stage", "sha256", "returnflag", "tax_pct", F.inline(need)).where("st = stage")
    a = a.withColumn("path", F.concat_ws(".", "art", F.col("version").cast("string"))).withColumnRenamed("art", "name").drop("st")
    o = raw(spark, sf, "orders").where("o_orderkey % 3 = 0")
    mix = o.select(
        F.col("o_orderkey").alias("job_id"), F.lit("mixing").alias("stage"), F.lit("x").alias("sha256"), F.lit("N").alias("returnflag"),
        F.lit(0).cast("long").alias("tax_pct"), F.lit("output_video").alias("name"), F.lit(1).alias("version"), F.lit("output_video.1").alias("path"),
    )
    a = a.unionByName(mix)
    sha = F.when(F.col("tax_pct") >= 7, F.md5("sha256")).otherwise(F.col("sha256"))
    files = a.where("returnflag <> 'R'").select("job_id", "path", sha.alias("sha256"))
    return a.drop("returnflag", "tax_pct"), files


cte("badst", ("prog", "latest"), f"""
SELECT j.job_id, j.ord, j.stage FROM (SELECT job_id, unnest(range(1,9)) AS ord, unnest({STAGE_LIST}) AS stage FROM (SELECT DISTINCT job_id FROM prog)) j
LEFT JOIN prog p ON p.job_id=j.job_id AND p.ord=j.ord LEFT JOIN (SELECT job_id, name, returnflag<>'R' AND tax_pct<7 AS good FROM latest UNION ALL SELECT o_orderkey, 8, TRUE FROM orders WHERE o_orderkey%3=0) g ON g.job_id=j.job_id AND g.name=j.ord
WHERE coalesce(p.status,'')<>'completed' OR NOT coalesce(g.good,FALSE)""")


@query("resume_plan", ("badst", "prog"), """
SELECT j.job_id, f AS start_stage, f IS NULL AS already_completed, f IS NOT NULL AS preserve_checkpoints, CASE WHEN f IS NULL THEN 'all_stages_valid' ELSE 'first_invalid_stage' END AS reason
FROM (SELECT DISTINCT job_id FROM prog) j LEFT JOIN (SELECT job_id, min_by(stage, ord) AS f FROM badst GROUP BY 1) b ON j.job_id=b.job_id""")
def resume_plan(spark, sf):
    a, files = _named(spark, sf)
    return st.resume_plan(_progress(spark, sf), a, files)


@query("resume_plan_no_cache", ("badst", "prog"), """
SELECT j.job_id, coalesce(f,'tts') AS start_stage, FALSE AS already_completed, FALSE AS preserve_checkpoints, CASE WHEN f IS NULL THEN 'completed_job_no_cache_defaults_to_tts' ELSE 'first_invalid_stage' END AS reason
FROM (SELECT DISTINCT job_id FROM prog) j LEFT JOIN (SELECT job_id, min_by(stage, ord) AS f FROM badst GROUP BY 1) b ON j.job_id=b.job_id""")
def resume_plan_no_cache(spark, sf):
    a, files = _named(spark, sf)
    return st.resume_plan(_progress(spark, sf), a, files, no_cache=True)


def _resets(spark, sf):
    names = F.array(*[F.lit(s) for s in rules.STAGES])
    o = raw(spark, sf, "orders").where("o_orderkey % 4 <> 0")
    return o.select(F.col("o_orderkey").alias("job_id"), F.get(names, (F.col("o_orderkey") % 8).cast("int")).alias("from_stage"))


@query("invalidate_downstream", ("prog",), """
SELECT job_id, stage, CASE WHEN job_id%4<>0 AND ord>=job_id%8+1 AND job_id IN (SELECT o_orderkey FROM orders) THEN 'pending' ELSE status END AS status FROM prog""")
def invalidate_downstream(spark, sf):
    return st.reset_progress(_progress(spark, sf), _resets(spark, sf))


NEEDED = ", ".join(f"({rules.STAGES.index(s) + 1}, '{s}', '{n}', {v})" for s, n, v in rules.REQUIRED_ARTIFACTS)
CHECKPOINTED = " ".join(f"WHEN {rules.STAGES.index(s) + 1} THEN '{n}'" for s, n in rules.CHECKPOINT_ARTIFACTS.items())


@query("drop_artifacts", ("latest",), f"""
SELECT a.* EXCLUDE (ord) FROM (
 SELECT l.job_id, d.stage, l.sha256, d.art AS name, CAST(d.ver AS INTEGER) AS version, d.art||'.'||d.ver::VARCHAR AS path, d.ord FROM latest l JOIN (VALUES {NEEDED}) d(ord, stage, art, ver) ON l.name=d.ord
 UNION ALL SELECT o_orderkey, 'mixing', 'x', 'output_video', CAST(1 AS INTEGER), 'output_video.1', 8 FROM orders WHERE o_orderkey%3=0) a
LEFT JOIN (SELECT o_orderkey AS job_id, o_orderkey%8+1 AS f FROM orders WHERE o_orderkey%4<>0) r ON a.job_id=r.job_id
WHERE NOT coalesce(ord>=f, FALSE) OR coalesce(name = CASE f {CHECKPOINTED} END, FALSE)""")
def drop_artifacts(spark, sf):
    a, _ = _named(spark, sf)
    return st.drop_artifacts(a, _resets(spark, sf), preserve_checkpoints=True)


@query("union_transcripts", ("segments",), "SELECT job_id, job_id||'::'||segment_id AS segment_id, source_text FROM segments")
def union_transcripts(spark, sf):
    s = table(spark, sf, "segments").select("job_id", "segment_id", "source_text")
    return st.union_transcripts([s.where("job_id % 2 = 0"), s.where("job_id % 2 <> 0")])


# --- stored artifacts ------------------------------------------------------------------------

DOCUMENT = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField(
            "segments",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("segment_id", T.StringType()),
                        T.StructField("start_ms", T.LongType()),
                        T.StructField("end_ms", T.LongType()),
                        T.StructField("source_text", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def _write_documents(spark, sf):
    path = _scratch(spark, "documents")
    s = table(spark, sf, "segments")
    one = F.array(F.struct("segment_id", "start_ms", "end_ms", "source_text"))
    s.select("job_id", F.lit("1.0").alias("schema_version"), one.alias("segments")).repartition("job_id").write.partitionBy(
        "job_id"
    ).json(path)
    return path


@query("read_artifacts", ("segments",), "SELECT job_id::VARCHAR AS job_id, '1.0' AS schema_version, segment_id, start_ms, end_ms, source_text FROM segments")
def read_artifacts(spark, sf):
    d = ar.read_artifacts(spark, _write_documents(spark, sf), DOCUMENT, "segments", multi_line=False)
    return d.drop("_corrupt_record")


@query("publish_artifact", ("cues",), "SELECT job_id::BIGINT AS job_id, 'dubbing_cues' AS name, 2 AS version, 'translation' AS created_by_stage, count(*) AS rows FROM cues GROUP BY 1")
def publish_artifact(spark, sf):
    c = table(spark, sf, "cues").select("job_id", "cue_id", "start_ms", "end_ms", "source_text")
    m = ar.publish_artifact(c, _scratch(spark, "cues"), name="dubbing_cues", stage="translation", version=2)
    return m.select(F.col("job_id").cast("long").alias("job_id"), "name", "version", "created_by_stage", "rows")


def _published(spark, sf):
    """Cues published twice: all of them, then the changed ones of some jobs."""
    c = table(spark, sf, "cues").select("job_id", "cue_id", "start_ms", "end_ms", "source_text")
    root = _scratch(spark, "published")
    art = {"name": "dubbing_cues", "version": 2}
    cm.publish(c, root, created_by="translation", **art)
    changed = c.where("job_id % 3 = 0").withColumn("source_text", F.concat("source_text", F.lit(" v2")))
    return root, c.schema, art, cm.publish(changed, root, created_by="translation", **art)


@query("publish_commits", ("cues",), """
SELECT job_id, cue_id, start_ms, end_ms, CASE WHEN job_id%3=0 THEN source_text||' v2' ELSE source_text END AS source_text FROM cues""")
def publish_commits(spark, sf):
    root, schema, art, _ = _published(spark, sf)
    return cm.read(spark, root, schema, **art)


@query("publish_progress", ("cues",), """
SELECT job_id, 'translation' AS stage, CASE WHEN job_id%3=0 THEN 'completed' ELSE 'running' END AS status, CASE WHEN job_id%3=0 THEN count(*) ELSE 0 END AS done, count(*) AS total FROM cues GROUP BY job_id""")
def publish_progress(spark, sf):
    _, _, _, last = _published(spark, sf)
    p = table(spark, sf, "cues").groupBy("job_id").agg(F.count("*").alias("total"))
    p = p.where("job_id % 2 = 0 OR job_id % 3 <> 0").select("job_id", F.lit("translation").alias("stage"), F.lit("running").alias("status"), F.lit(0).alias("done"), "total")
    return cm.stage_progress(p, last)


@query("publish_valid", ("cues",), """
SELECT job_id, 'dubbing_cues' AS name, CAST(2 AS INTEGER) AS version, count(*) AS rows, TRUE AS valid FROM cues GROUP BY job_id""")
def publish_valid(spark, sf):
    root, schema, art, _ = _published(spark, sf)
    key = ["job_id", "name", "version"]
    now = cm.manifest(spark, root)
    bad = st.invalid_artifacts(now, cm.found(spark, root, schema, **art), key)
    return now.join(bad, key, "left").select(*key, "rows", F.col("reason").isNull().alias("valid"))


@query("scan_inputs")
def scan_inputs(spark, sf):
    path = _scratch(spark, "inputs")
    table(spark, sf, "segments").select("job_id", "source_text").repartition("job_id").write.json(path)
    return media.scan_inputs(spark, path, (".json",)).select("length", "problem")


@query("workspace_index", ("bjobs",), """
SELECT CASE WHEN batch_id%2=0 THEN 'batch_'||batch_id%50 END AS batch_id, job_id::VARCHAR AS job_id, status, 'tts' AS current_stage, updated_ms::VARCHAR AS updated_at FROM bjobs""")
def workspace_index(spark, sf):
    root = _scratch(spark, "workspace")
    j = _batch_jobs(spark, sf).select(
        (F.col("batch_id") % 50).alias("b"), F.col("job_id").cast("string").alias("job_id"), "status",
        F.lit("tts").alias("current_stage"), F.col("updated_ms").cast("string").alias("updated_at"),
    )
    single = j.where("b % 2 = 1").withColumn("part", F.col("b") % 5).drop("b")
    single.write.mode("append").partitionBy("part").json(f"{root}/single")
    nested = j.where("b % 2 = 0").withColumn("batch", F.concat(F.lit("batch_"), F.col("b").cast("string"))).drop("b")
    nested.write.mode("append").partitionBy("batch").json(f"{root}/batches")
    return ar.workspace_index(spark, root, single="single/part=*/*.json", nested="batches/batch=batch_*/*.json", multi_line=False)


@query("run_units", ("segments",), """
SELECT job_id, segment_id, CASE WHEN n_words%5<>0 THEN n_words::VARCHAR END AS result, CASE WHEN n_words%5<>0 THEN 'completed' ELSE 'failed' END AS status FROM segments""")
def run_units(spark, sf):
    def count(text):
        n = len(text.split())
        if n % 5 == 0:
            raise ValueError("refused")
        return str(n)

    r = un.run_units(table(spark, sf, "segments"), ["job_id", "segment_id"], "source_text", count)
    return r.drop("error")


# --- streams ---------------------------------------------------------------------------------

EVENTS = "job_id bigint, stage bigint, segment_id bigint, status string, event_ms bigint, seq bigint"


def _status_events(spark, sf):
    m = table(spark, sf, "manifest")
    s = F.when(F.col("linestatus") == "F", "completed").when(F.col("returnflag") == "A", "failed").otherwise("pending")
    return m.select(
        (F.col("job_id") % 500).alias("job_id"), F.col("name").alias("stage"), F.col("job_id").alias("segment_id"), s.alias("status"),
        F.col("created_ms").alias("event_ms"), (F.col("partkey") * 10_000_000_000 + F.col("cents")).alias("seq"),
    )


@query("progress_stream", ("manifest",), """
SELECT job_id, stage, count(*) FILTER (status='completed') AS done, count(*) AS total FROM (
 SELECT job_id%500 AS job_id, name AS stage, job_id AS segment_id, arg_max(CASE WHEN linestatus='F' THEN 'completed' WHEN returnflag='A' THEN 'failed' ELSE 'pending' END, row(created_ms, partkey*10000000000+cents)) AS status
 FROM manifest GROUP BY ALL) GROUP BY ALL""")
def progress_stream(spark, sf):
    src, out, cp = _scratch(spark, "events"), _scratch(spark, "status"), _scratch(spark, "cp")
    s = _status_events(spark, sf)
    # events lie as they were read, in files that do not grow; three triggers take them all
    if s.rdd.getNumPartitions() < 3:
        s = s.repartition(3, *s.columns)
    s.write.parquet(src)
    files = len(spark.read.schema(EVENTS).parquet(src).inputFiles())
    e = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max(1, -(-files // 3))).parquet(src)
    sj.progress_stream(e, out, cp)
    return sj.stream_result(spark, out)


@query("speech_session_stream", ("islands",), "SELECT job_id, start_ms, end_ms, word_count FROM islands")
def speech_session_stream(spark, sf):
    src, out, cp = _scratch(spark, "words"), _scratch(spark, "sessions"), _scratch(spark, "cp")
    # one recording a day, in the order of their ids
    day = F.timestamp_millis(F.col("job_id") * 86_400_000)
    w = table(spark, sf, "words").select("job_id", day.alias("recorded_at"), "start_ms", "end_ms")
    # a last word far in the future lets the watermark pass every real session
    far = spark.range(1).select(
        F.lit(-1).cast("long").alias("job_id"), F.timestamp_millis(F.lit(10**14)).alias("recorded_at"),
        F.lit(0).cast("long").alias("start_ms"), F.lit(1).cast("long").alias("end_ms"),
    )
    # recordings arrive in three triggers, the closing marker in a fourth
    parts = w.agg(F.percentile_approx("job_id", [1 / 3, 2 / 3])).first()[0] or [0, 0]
    one, two = parts
    rows = [w.where(f"job_id <= {one}"), w.where(f"job_id > {one} AND job_id <= {two}"), w.where(f"job_id > {two}"), far]
    for batch in rows:
        batch.write.mode("append").parquet(src)
        s = spark.readStream.schema("job_id bigint, recorded_at timestamp, start_ms bigint, end_ms bigint").parquet(src)
        sj.run_to_files(sj.speech_sessions(s), out, cp)
    return spark.read.parquet(out).where("job_id >= 0")


@query("incremental_units", ("segments",), "SELECT job_id, segment_id, n_words AS result FROM segments")
def incremental_units(spark, sf):
    src, out, cp = _scratch(spark, "units"), _scratch(spark, "done"), _scratch(spark, "cp")
    s = table(spark, sf, "segments").select("job_id", "segment_id", "n_words")
    s.where("n_words % 2 = 0").write.parquet(src)

    def run():
        stream = spark.readStream.schema(s.schema).parquet(src)
        sj.incremental_units(
            stream, out, cp, ["job_id", "segment_id"], lambda b: b.select("job_id", "segment_id", F.col("n_words").alias("result"))
        )

    run()
    s.write.mode("append").parquet(src)
    run()
    return spark.read.parquet(out).drop("epoch_no")

