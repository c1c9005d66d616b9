"""Queries on intervals, clips, alignment, heard speech and subtitles."""

from pyspark.sql import functions as F

from voxloom.catalog.base import cte, query
from voxloom.functions import text as tx
from voxloom.operators import audio as au
from voxloom.operators import heard as hd
from voxloom.operators import intervals as iv
from voxloom.operators import subtitles as sb
from voxloom.operators import tts
from voxloom.sources.derive import raw, table

# --- intervals -------------------------------------------------------------------------------

RATIO = 0.3

cte("thresholds", ("frames",), "SELECT job_id, max(rms) AS max_rms, max(rms)*0.3::DOUBLE AS threshold, max(end_ms) AS duration_ms FROM frames GROUP BY job_id")
cte("energy", ("frames", "thresholds"), """
SELECT job_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
 SELECT f.*, f.i-row_number() OVER (PARTITION BY f.job_id ORDER BY i) AS g FROM frames f JOIN thresholds t ON f.job_id=t.job_id WHERE rms>=threshold AND max_rms>0)
GROUP BY job_id, g""")


def merged_sql(src: str, gap: str, cols: str = "job_id") -> str:
    return f"""SELECT job_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
 SELECT *, sum(CASE WHEN start_ms-reach>{gap} THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, max(end_ms) OVER (PARTITION BY job_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src})) GROUP BY job_id, g"""


cte("energy_m", ("energy",), merged_sql("energy", "500"))
cte("padded", ("energy_m", "thresholds"), merged_sql(
    "(SELECT job_id, greatest(0,start_ms-300) AS start_ms, least(duration_ms,end_ms+300) AS end_ms FROM energy_m JOIN thresholds USING (job_id))", "300"))
cte("kept", ("padded", "thresholds"), """
SELECT job_id, start_ms, end_ms, 'speech' AS reason FROM padded WHERE end_ms-start_ms>=2000 UNION ALL
SELECT job_id, 0, duration_ms, 'vad_fallback_full_audio' FROM thresholds WHERE job_id NOT IN (SELECT job_id FROM padded WHERE end_ms-start_ms>=2000)""")


def _energy(spark, sf):
    return iv.energy_islands(table(spark, sf, "frames"), ratio=RATIO)


@query("energy_islands", ("energy",), "SELECT *, 'vad_energy' AS reason FROM energy")
def energy_islands(spark, sf):
    return _energy(spark, sf)


@query("merge_intervals", ("intervals",), merged_sql("intervals", "20000"))
def merge_intervals(spark, sf):
    return iv.merge_intervals(table(spark, sf, "intervals").withColumnRenamed("interval_id", "_id"), gap_ms=20_000)


@query("pad_intervals", ("kept",), "SELECT * FROM kept")
def pad_intervals(spark, sf):
    t = iv.speech_threshold(table(spark, sf, "frames"), ratio=RATIO)
    m = iv.merge_intervals(_energy(spark, sf), gap_ms=500)
    return iv.keep_long(iv.pad_intervals(m, t, padding_ms=300), t, min_ms=2000)


@query("interval_neighbours", ("energy_m", "thresholds"), """
SELECT job_id, 'seg_'||lpad((row_number() OVER w)::VARCHAR,6,'0') AS segment_id, start_ms, end_ms, start_ms-coalesce(lag(end_ms) OVER w,0) AS silence_before_ms,
 coalesce(lead(start_ms) OVER w-end_ms, greatest(0,duration_ms-end_ms)) AS silence_after_ms FROM energy_m JOIN thresholds USING (job_id) WINDOW w AS (PARTITION BY job_id ORDER BY start_ms, end_ms)""")
def interval_neighbours(spark, sf):
    t = iv.speech_threshold(table(spark, sf, "frames"), ratio=RATIO)
    return iv.interval_neighbours(iv.merge_intervals(_energy(spark, sf), gap_ms=500), t)


@query("absorb_short_intervals")
def absorb_short_intervals(spark, sf):
    return iv.absorb_short(iv.merge_intervals(_energy(spark, sf), gap_ms=500), target_min_ms=6_000)


@query("absorb_short_bounded")
def absorb_short_bounded(spark, sf):
    return iv.absorb_short(iv.merge_intervals(_energy(spark, sf), gap_ms=500), target_min_ms=6_000, hard_max_ms=9_000)


@query("split_long_intervals")
def split_long_intervals(spark, sf):
    f = table(spark, sf, "frames")
    m = iv.merge_intervals(_energy(spark, sf), gap_ms=4_000)
    return iv.split_long(
        m, iv.silence_gaps(f, ratio=RATIO), midpoints=False, target_min_ms=4_000, preferred_ms=9_000, hard_ms=18_000
    )


@query("split_long_speech")
def split_long_speech(spark, sf):
    f = table(spark, sf, "frames")
    m = iv.merge_intervals(_energy(spark, sf), gap_ms=4_000)
    return iv.split_long(
        m, iv.silence_gaps(f, ratio=RATIO), midpoints=True, target_min_ms=3_000, preferred_ms=5_000, hard_ms=6_000
    )


@query("context_chunks")
def context_chunks(spark, sf):
    return iv.context_chunks(table(spark, sf, "frames"), ratio=RATIO, merge_gap_ms=1000, padding_ms=500)


cte("prob", ("frames",), "SELECT job_id, i, least(value,100)/100 AS probability FROM frames")
cte("prob_iv", ("prob",), """
SELECT job_id, (min(i)-1)*500 AS start_ms, max(i)*500 AS end_ms FROM (
 SELECT *, i-row_number() OVER (PARTITION BY job_id ORDER BY i) AS g FROM prob WHERE probability>=0.2::DOUBLE) GROUP BY job_id, g""")


def _prob(spark, sf):
    f = table(spark, sf, "frames")
    return iv.probability_islands(
        f.select("job_id", "i", (F.least(F.col("value"), F.lit(100.0)) / 100).alias("probability")), threshold=0.2
    )


@query("probability_islands", ("prob_iv",), "SELECT * FROM prob_iv")
def probability_islands(spark, sf):
    return _prob(spark, sf)


@query("post_process_speech")
def post_process_speech(spark, sf):
    t = iv.speech_threshold(table(spark, sf, "frames"))
    return iv.post_process_speech(_prob(spark, sf), t, target_min_ms=5_000, preferred_ms=9_000, hard_ms=15_000)


@query("flag_union", ("segments",), """
SELECT job_id, segment_id, array_to_string(CASE WHEN list_contains(risk_flags,'hard_split') THEN risk_flags ELSE list_append(risk_flags,'hard_split') END,'|') AS risk_flags FROM segments""")
def flag_union(spark, sf):
    return table(spark, sf, "segments").select(
        "job_id", "segment_id", F.array_join(F.array_union("risk_flags", F.array(F.lit("hard_split"))), "|").alias("risk_flags")
    )


# --- clips -----------------------------------------------------------------------------------

cte("clip_len", ("audio",), "SELECT clip_id, count(*) AS n, sqrt(sum(s*s)/count(*)) AS rms, max(abs(s)) AS peak FROM audio GROUP BY clip_id")
cte("clip_win", ("audio", "clip_len"), """
SELECT a.clip_id, a.i//2 AS win, sqrt(sum(a.s*a.s)/count(*)) > greatest(120, least(1000, CAST(trunc(any_value(c.rms)*0.25::DOUBLE) AS BIGINT))) AS voiced
FROM audio a JOIN clip_len c ON a.clip_id=c.clip_id GROUP BY a.clip_id, a.i//2""")
cte("clip_edge", ("clip_win",), """
SELECT clip_id, count(*) AS wins, coalesce(min(win) FILTER (voiced), count(*)) AS lead, coalesce(count(*)-1-max(win) FILTER (voiced), count(*)) AS tail,
 min(win) FILTER (voiced) AS fv, max(win) FILTER (voiced) AS lv FROM clip_win GROUP BY clip_id""")
cte("clip_runs", ("clip_win", "clip_edge", "clip_len"), """
SELECT clip_id, min(win)*2 AS a, least(any_value(n), (max(win)+1)*2) AS b FROM (
 SELECT w.clip_id, w.win, w.win-row_number() OVER (PARTITION BY w.clip_id ORDER BY w.win) AS g FROM clip_win w JOIN clip_edge e ON w.clip_id=e.clip_id WHERE NOT voiced AND win BETWEEN fv AND lv) r
 JOIN clip_len USING (clip_id) GROUP BY clip_id, g""")


@query("read_pcm_frames", ("audio",), """
SELECT clip_id, frame, frame*100 AS start_ms, (frame*10+n)*10 AS end_ms, CAST(trunc(sqrt(q/n)) AS BIGINT) AS rms FROM (
 SELECT clip_id, i//10 AS frame, count(*) AS n, sum(s*s) AS q FROM audio GROUP BY ALL)""")
def read_pcm_frames(spark, sf):
    from voxloom.sources import media

    wav = media.encode_wav(table(spark, sf, "audio"))
    return iv.pcm_frames(media.decode_wav(wav), frame_ms=100, channels="channels")


@query("clip_level_stats", ("clip_len", "clip_edge", "clip_runs", "audio"), """
SELECT c.clip_id, c.n*10 AS duration_ms, peak, CAST(floor(c.rms*100+0.5::DOUBLE) AS BIGINT) AS rms_e2, CAST(cl*1000000//c.n AS BIGINT) AS clipped_e6, lead*20 AS leading_silence_ms, tail*20 AS trailing_silence_ms,
 coalesce(m,0) AS max_internal_silence_ms, array_to_string(w,'|') AS warnings, len(w)=0 AS ok FROM (
 SELECT c.*, e.lead, e.tail, r.m, x.cl, list_filter([CASE WHEN c.rms<500 THEN 'tts_audio_near_silent' END, CASE WHEN lead*20>100 THEN 'tts_audio_leading_silence' END, CASE WHEN tail*20>100 THEN 'tts_audio_trailing_silence' END,
  CASE WHEN m>150 THEN 'tts_audio_internal_silence' END, CASE WHEN peak>=12000 AND cl/c.n>0.001::DOUBLE THEN 'tts_audio_clipping' END], lambda x: x IS NOT NULL) AS w
 FROM clip_len c JOIN clip_edge e ON c.clip_id=e.clip_id LEFT JOIN (SELECT clip_id, max((b-a)*10) AS m FROM clip_runs GROUP BY 1) r ON c.clip_id=r.clip_id
 JOIN (SELECT clip_id, count(*) FILTER (abs(s)>=12000) AS cl FROM audio GROUP BY 1) x ON c.clip_id=x.clip_id) c""")
def clip_level_stats(spark, sf):
    r = au.clip_stats(table(spark, sf, "audio"), max_edge_ms=100, max_internal_ms=150, clip_peak=12_000)
    return r.withColumn("warnings", F.array_join("warnings", "|"))


@query("silence_runs", ("clip_runs",), "SELECT clip_id, a AS start_frame, b AS end_frame FROM clip_runs")
def silence_runs(spark, sf):
    r = au.with_internal_runs(au.with_windows(table(spark, sf, "audio")))
    return r.select("clip_id", F.inline("runs")).select(
        "clip_id", F.col("a").cast("long").alias("start_frame"), F.col("b").cast("long").alias("end_frame")
    )


@query("trim_edges", ("audio", "clip_edge", "clip_len"), """
SELECT a.clip_id, count(*) AS n, CAST(sum((a.i-c0+1)*s) AS BIGINT) AS fingerprint, any_value(c0>0 OR c1>0) AS changed FROM audio a JOIN (
 SELECT e.clip_id, n, CASE WHEN n-greatest(0,tail*2-5)>greatest(0,lead*2-5) THEN greatest(0,lead*2-5) ELSE 0 END AS c0, CASE WHEN n-greatest(0,tail*2-5)>greatest(0,lead*2-5) THEN greatest(0,tail*2-5) ELSE 0 END AS c1
 FROM clip_edge e JOIN clip_len l ON e.clip_id=l.clip_id) e ON a.clip_id=e.clip_id WHERE a.i>=c0 AND a.i<e.n-c1 GROUP BY a.clip_id""")
def trim_edges(spark, sf):
    return _fingerprint(au.trim_edges(table(spark, sf, "audio"), retained_ms=50))


def _fingerprint(r):
    f = F.aggregate(
        F.transform("samples", lambda x, i: (i + 1).cast("long") * x), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return r.select("clip_id", F.size("samples").cast("long").alias("n"), f.alias("fingerprint"), "changed")


@query("compact_silence", ("audio", "clip_runs"), """
SELECT clip_id, count(*) AS n, CAST(sum(rn*s) AS BIGINT) AS fingerprint, bool_or(ch) AS changed FROM (
 SELECT a.clip_id, a.s, row_number() OVER (PARTITION BY a.clip_id ORDER BY a.i) AS rn, EXISTS (SELECT 1 FROM clip_runs r WHERE r.clip_id=a.clip_id AND (r.b-r.a)*10>100) AS ch
 FROM audio a WHERE NOT EXISTS (SELECT 1 FROM clip_runs r WHERE r.clip_id=a.clip_id AND (r.b-r.a)*10>100 AND a.i>=r.a+2 AND a.i<r.b-3)) GROUP BY clip_id""")
def compact_silence(spark, sf):
    return _fingerprint(au.compact_silence(table(spark, sf, "audio"), max_internal_ms=100, retained_ms=50))


@query("db_to_linear", (), """
SELECT event_id, CAST(round(pow(10.0::DOUBLE, (value%80-50)/20)*1000) AS BIGINT) AS gain_e3 FROM events""")
def db_to_linear(spark, sf):
    return raw(spark, sf, "events").select(
        "event_id", F.round(tts.db_to_linear(F.col("value") % 80 - 50) * 1000).cast("long").alias("gain_e3")
    )


# --- alignment -------------------------------------------------------------------------------

cte("budget", ("nb",), """
SELECT *, end_ms-start_ms AS duration_ms, n_words*(280+(job_id*3+sentence_no)%160) AS tts_duration_ms,
 CASE WHEN ns IS NULL THEN 0 ELSE least(6000, greatest(0, greatest(0, ns-start_ms-120)-(end_ms-start_ms))) END AS overflow_budget_ms FROM nb""")
cte("plan", ("budget",), """
SELECT *, CASE action WHEN 'overflow' THEN over WHEN 'time_stretch_overflow' THEN overflow_budget_ms ELSE 0 END AS overflow_ms,
 CASE action WHEN 'time_stretch_overflow' THEN (comb+9)//10 WHEN 'time_stretch' THEN ((ratio+50)//100)*10 ELSE 1000 END AS stretch_ratio_e3,
 CASE WHEN action='pad_silence' AND ratio<10000 THEN 'tts_duration_shorter_than_source' WHEN action='overflow' THEN 'tts_duration_overflow_into_source_silence'
  WHEN action='time_stretch_overflow' THEN 'tts_duration_uses_source_silence_and_time_stretch'||CASE WHEN comb>12000 THEN '|tts_duration_near_hard_limit' ELSE '' END
  WHEN action='time_stretch' AND ratio>12000 THEN 'tts_duration_near_hard_limit' WHEN action='rephrase' THEN 'tts_duration_exceeds_hard_limit' ELSE '' END AS warnings FROM (
 SELECT *, CASE WHEN ratio<=10000 THEN 'pad_silence' WHEN over<=overflow_budget_ms THEN 'overflow' WHEN overflow_budget_ms>0 AND comb<=13000 THEN 'time_stretch_overflow' WHEN ratio<=13000 THEN 'time_stretch' ELSE 'rephrase' END AS action FROM (
  SELECT *, tts_duration_ms-duration_ms AS over, (tts_duration_ms*20000+duration_ms)//(2*duration_ms) AS ratio,
   (tts_duration_ms*20000+duration_ms+overflow_budget_ms)//(2*(duration_ms+overflow_budget_ms)) AS comb FROM budget))""")
cte("rows", ("plan",), """
SELECT job_id, cue_id, sentence_no, start_ms AS target_start_ms, CASE action WHEN 'overflow' THEN start_ms+tts_duration_ms WHEN 'time_stretch_overflow' THEN end_ms+overflow_ms ELSE end_ms END AS target_end_ms,
 start_ms AS original_start_ms, end_ms AS original_end_ms, duration_ms AS orig_duration_ms, tts_duration_ms, action AS alignment_action, stretch_ratio_e3, overflow_ms,
 overflow_budget_ms AS available_overflow_ms, duration_ms+overflow_budget_ms AS target_window_ms, warnings, source_text FROM plan""")


def _timed(spark, sf):
    c = table(spark, sf, "cues").withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    return c.withColumn("tts_duration_ms", F.col("n_words") * (280 + (F.col("job_id") * 3 + F.col("sentence_no")) % 160))


@query("overflow_budget", ("budget",), "SELECT job_id, cue_id, CAST(overflow_budget_ms AS BIGINT) AS overflow_budget_ms FROM budget")
def overflow_budget(spark, sf):
    return tts.overflow_budget(_timed(spark, sf)).select("job_id", "cue_id", "overflow_budget_ms")


@query("duration_plan", ("plan",), "SELECT job_id, cue_id, action, CAST(stretch_ratio_e3 AS BIGINT) AS stretch_ratio_e3, CAST(overflow_ms AS BIGINT) AS overflow_ms, warnings FROM plan")
def duration_plan(spark, sf):
    p = tts.overflow_budget(_timed(spark, sf)).select("job_id", "cue_id", tts.duration_plan().alias("p"))
    return p.select(
        "job_id", "cue_id", "p.action", "p.stretch_ratio_e3", "p.overflow_ms", F.array_join("p.warnings", "|").alias("warnings")
    )


@query("target_end", ("rows",), "SELECT job_id, cue_id, CAST(target_end_ms AS BIGINT) AS target_end_ms FROM rows")
def target_end(spark, sf):
    p = tts.overflow_budget(_timed(spark, sf)).withColumn("plan", tts.duration_plan())
    return p.select("job_id", "cue_id", tts.target_end_ms().alias("target_end_ms"))


@query("alignment_row", ("rows",), """
SELECT job_id, cue_id, sentence_no, target_start_ms, CAST(target_end_ms AS BIGINT) AS target_end_ms, original_start_ms, original_end_ms, orig_duration_ms, tts_duration_ms, alignment_action,
 CAST(stretch_ratio_e3 AS BIGINT) AS stretch_ratio_e3, CAST(overflow_ms AS BIGINT) AS overflow_ms, CAST(available_overflow_ms AS BIGINT) AS available_overflow_ms, CAST(target_window_ms AS BIGINT) AS target_window_ms, warnings, source_text FROM rows""")
def alignment_row(spark, sf):
    return tts.alignment_rows(tts.overflow_budget(_timed(spark, sf))).withColumn("warnings", F.array_join("warnings", "|"))


@query("compression_budget", ("rows",), """
SELECT job_id, cue_id, CAST(greatest(10000, tts_duration_ms*10000//target_window_ms) AS BIGINT) AS required_speedup_e4,
 CAST(greatest(1, ceil(length(source_text)*least(1.0::DOUBLE, target_window_ms*1.3::DOUBLE/greatest(1,tts_duration_ms)))) AS BIGINT) AS max_chars, tts_duration_ms/target_window_ms>1.3::DOUBLE AS needs_shorter_text FROM rows""")
def compression_budget(spark, sf):
    return tts.compression_budget(table(spark, sf, "tts_rows"))


@query("slot_fit", ("rows",), """
SELECT job_id, cue_id, target_start_ms, tts_duration_ms, slot AS slot_ms, CASE WHEN slot IS NULL OR tts_duration_ms<=slot THEN 'fits' WHEN tts_duration_ms/slot<=1.3::DOUBLE THEN 'stretch' ELSE 'tts_segment_exceeds_max_speedup' END AS slot_state FROM (
 SELECT *, CASE WHEN ns IS NOT NULL THEN greatest(1,ns-target_start_ms) END AS slot FROM (SELECT *, lead(target_start_ms) OVER (PARTITION BY job_id ORDER BY target_start_ms, cue_id) AS ns FROM rows))""")
def slot_fit(spark, sf):
    return tts.slot_fit(table(spark, sf, "tts_rows"))


def _qa_rows(spark, sf):
    r = table(spark, sf, "tts_rows")
    n = F.col("sentence_no")
    return r.select(
        "*", (n % 4 * 50).alias("leading_silence_ms"), F.when(n % 9 > 0, n * 7919 % 400_000).alias("cer_e6"),
        F.when(n % 9 > 0, 1_000_000 - n * 7919 % 300_000).alias("recall_e6"), (n % 3).alias("rephrase_attempts"),
        F.when(n % 5 == 0, 2).otherwise(0).cast("long").alias("semantic_retries"),
    )


cte("qa", ("rows",), """
SELECT *, greatest(abs(target_start_ms+lead_ms-original_start_ms), greatest(0,target_end_ms-original_end_ms)) AS drift, coalesce(cer0,0) AS cer,
 greatest(0, target_window_ms-trunc(tts_duration_ms/greatest(1.0::DOUBLE, stretch_ratio_e3/1000))) AS unused FROM (
 SELECT *, n%4*50 AS lead_ms, CASE WHEN n%9>0 THEN n*7919%400000 END AS cer0, CASE WHEN n%9>0 THEN 1000000-n*7919%300000 ELSE 1000000 END AS rec, n%3 AS reph, CASE WHEN n%5=0 THEN 2 ELSE 0 END AS retr FROM (SELECT *, sentence_no AS n FROM rows))""")


@query("qa_report", ("qa",), """
SELECT q.job_id, count(*) AS cues_total, count(*) FILTER (overflow_ms>0) AS tts_overflow_segments, CAST(max(overflow_ms) AS BIGINT) AS max_overflow_ms, CAST(sum(overflow_ms) AS BIGINT) AS overflow_total_ms,
 count(*) FILTER (reph>0) AS rephrased_cues, CAST(sum(retr) AS BIGINT) AS semantic_retries, count(*) FILTER (cer0 IS NULL) AS semantic_failures, min(rec) AS semantic_token_recall_min_e6, CAST(sum(unused) AS BIGINT) AS unused_window_total_ms,
 CAST(any_value(d) AS BIGINT) AS sync_drift_p95_ms, any_value(c) AS semantic_cer_p95_e6 FROM qa q
 JOIN (SELECT job_id, min(drift) AS d FROM (SELECT job_id, drift, row_number() OVER (PARTITION BY job_id ORDER BY drift) AS r, count(*) OVER (PARTITION BY job_id) AS n FROM qa) WHERE r>=ceil(n*0.95::DOUBLE) GROUP BY 1) x ON q.job_id=x.job_id
 JOIN (SELECT job_id, min(cer) AS c FROM (SELECT job_id, cer, row_number() OVER (PARTITION BY job_id ORDER BY cer) AS r, count(*) OVER (PARTITION BY job_id) AS n FROM qa) WHERE r>=ceil(n*0.95::DOUBLE) GROUP BY 1) y ON q.job_id=y.job_id GROUP BY q.job_id""")
def qa_report(spark, sf):
    return tts.qa_report(_qa_rows(spark, sf))


@query("nearest_rank_percentile", (), """
SELECT user_id, min(v) AS p95 FROM (SELECT user_id, CAST(round(value*100) AS BIGINT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
WHERE r>=ceil(n*0.95::DOUBLE) GROUP BY user_id""")
def nearest_rank_percentile(spark, sf):
    e = raw(spark, sf, "events").select("user_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    return tts.nearest_rank(e, ["user_id"], "v", 0.95, "p95")


@query("effective_tts_text", ("cues",), """
SELECT job_id, cue_id AS segment_id, CASE WHEN n%6=0 THEN '' WHEN n%4=0 THEN '' WHEN n%4=1 THEN 'said' ELSE source_text END AS tts_text, CASE WHEN n%6=0 THEN '' ELSE source_text END AS tts_display_text FROM (SELECT *, sentence_no AS n FROM cues)""")
def effective_tts_text(spark, sf):
    n = F.col("sentence_no")
    c = table(spark, sf, "cues").select(
        "job_id", F.col("cue_id").alias("segment_id"), F.when(n % 6 == 0, "silence").alias("tts_manual_action"),
        F.when(n % 4 == 0, "").when(n % 4 == 1, "said").alias("spoken_text"), F.col("source_text").alias("translated_text"),
        F.lit(None).cast("string").alias("display_text"),
    )
    return tts.effective_tts_text(c)


def _failures(spark, sf):
    r = table(spark, sf, "tts_rows")
    k = F.col("sentence_no") % 6
    error = (
        F.when(k == 0, F.concat_ws("", "cue_id", F.lit(": tts_duration_exceeds_max_speedup duration_ms="), F.col("tts_duration_ms").cast("string")))
        .when(k == 1, F.lit("tts_semantic_quality_failed cer=0.4"))
        .when(k == 2, F.lit("tts_rephrase_empty"))
        .when(k == 3, F.concat_ws("", F.lit("tts_rephrase_exceeds_char_limit max_chars="), F.length("source_text").cast("string"), F.lit(" actual_chars="), (F.length("source_text") + 5).cast("string")))
        .when(k == 4, F.concat_ws("", F.lit("tts_rephrase_exceeds_char_limit max_chars="), F.length("source_text").cast("string")))
        .otherwise(F.lit("network down"))
    )
    return r.select("job_id", "cue_id", error.alias("error"))


@query("manual_review_errors", ("rows",), """
SELECT job_id, cue_id, k<5 AS manual, CASE k WHEN 0 THEN 'tts_duration_exceeds_max_speedup' WHEN 1 THEN 'tts_semantic_quality_failed' WHEN 2 THEN 'tts_rephrase_empty' WHEN 5 THEN NULL ELSE 'tts_rephrase_exceeds_char_limit' END AS code,
 CASE WHEN k IN (3,4) THEN l END AS max_chars, CASE WHEN k=3 THEN l+5 END AS actual_chars, CASE k WHEN 0 THEN 'audio too long: shorten spoken text or silence' WHEN 1 THEN 'heard text differs: correct text or silence'
 WHEN 2 THEN 'shortening returned nothing: provide shorter text or silence' WHEN 3 THEN 'shorten to '||l||' characters or fewer, now '||(l+5) WHEN 4 THEN 'shorten to '||l||' characters or fewer' END AS hint
FROM (SELECT *, sentence_no%6 AS k, CAST(length(source_text) AS BIGINT) AS l FROM rows)""")
def manual_review_errors(spark, sf):
    return tts.manual_review_errors(_failures(spark, sf))


@query("review_time_label", ("cues",), """
SELECT job_id, cue_id, CASE WHEN t//3600000>0 THEN lpad((t//3600000)::VARCHAR,2,'0')||':' ELSE '' END||lpad((t//60000%60)::VARCHAR,2,'0')||':'||lpad((t//1000%60)::VARCHAR,2,'0')||'.'||lpad((t%1000)::VARCHAR,3,'0') AS label
FROM (SELECT *, start_ms*20 AS t FROM cues)""")
def review_time_label(spark, sf):
    return table(spark, sf, "cues").select("job_id", "cue_id", tts.review_time_label(F.col("start_ms") * 20).alias("label"))


# --- heard speech ----------------------------------------------------------------------------

cte("heard", ("segments", "words"), r"""
SELECT s.job_id, s.segment_id, any_value(s.source_text) AS expected,
 coalesce(string_agg(CASE WHEN pos%13=0 THEN w.text||' '||w.text ELSE w.text END,' ' ORDER BY pos) FILTER (pos%11<>0),'') AS heard
FROM segments s JOIN words w ON s.job_id=w.job_id AND s.chunk_id=w.chunk_id GROUP BY s.job_id, s.segment_id""")


def _heard(spark, sf):
    s = table(spark, sf, "segments")
    t = F.transform(
        tx.tokens("source_text"),
        lambda x, i: F.when((i + 1) % 11 == 0, F.lit(None)).when((i + 1) % 13 == 0, F.concat_ws(" ", x, x)).otherwise(x),
    )
    h = F.array_join(F.filter(t, lambda x: x.isNotNull()), " ")
    return s.select("job_id", "segment_id", F.col("source_text").alias("expected"), h.alias("heard"))


# the check's edit distance counts bytes, so each letter beyond ASCII stands as one unused byte there
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_BYTES = "||".join(f"chr({k})" for k in [*range(1, 9), *range(14, 14 + len(LETTERS) - 8)])


@query("char_error_rate", ("heard",), f"""
SELECT job_id, segment_id, d AS distance, CAST((d*2000000+n)//(2*n) AS BIGINT) AS cer_e6 FROM (
 SELECT *, levenshtein(translate(replace(expected,' ',''),'{LETTERS}',{_BYTES}),translate(replace(heard,' ',''),'{LETTERS}',{_BYTES})) AS d,
  greatest(1,length(replace(expected,' ',''))) AS n FROM heard)""")
def char_error_rate(spark, sf):
    return hd.char_error_rate(_heard(spark, sf))


@query("token_recall", ("heard",), """
SELECT h.job_id, h.segment_id, CAST(CASE WHEN n>0 THEN (hit*2000000+n)//(2*n) WHEN coalesce(m,0)=0 THEN 1000000 ELSE 0 END AS BIGINT) AS recall_e6 FROM heard h LEFT JOIN (
 SELECT job_id, segment_id, sum(least(a,b)) AS hit, sum(a) AS n, sum(b) AS m FROM (
  SELECT job_id, segment_id, tok, count(*) FILTER (side=1) AS a, count(*) FILTER (side=2) AS b FROM (
   SELECT job_id, segment_id, 1 AS side, unnest(string_split(expected,' ')) AS tok FROM heard UNION ALL SELECT job_id, segment_id, 2, unnest(string_split(heard,' ')) FROM heard) WHERE tok<>'' GROUP BY ALL)
 GROUP BY ALL) g ON h.job_id=g.job_id AND h.segment_id=g.segment_id""")
def token_recall(spark, sf):
    return hd.token_recall(_heard(spark, sf))


@query("multiset_intersect", ("heard",), """
SELECT job_id, segment_id, unnest(string_split(expected,' ')) AS tok FROM heard INTERSECT ALL SELECT job_id, segment_id, unnest(string_split(heard,' ')) FROM heard""")
def multiset_intersect(spark, sf):
    h = _heard(spark, sf)
    a, b = (h.select("job_id", "segment_id", F.explode(F.split(c, " ")).alias("tok")) for c in ("expected", "heard"))
    return hd.multiset_intersect(a, b)


@query("semantic_normalize")
def semantic_normalize(spark, sf):
    return hd.normalized(_heard(spark, sf).withColumn("heard", F.concat("heard", F.lit(" 2PR doctor ½ x² 3m"))))


# --- clauses and subtitles -------------------------------------------------------------------


def _seg_words(spark, sf):
    return table(spark, sf, "words").withColumn("segment_id", F.format_string("seg_%06d", F.col("chunk_id") + 1))


cte("seg_words", ("words",), "SELECT *, 'seg_'||lpad((chunk_id+1)::VARCHAR,6,'0') AS segment_id FROM words")


@query("pause_clauses", ("seg_words", "segments"), r"""
WITH g AS (SELECT job_id, segment_id, grp, min(start_ms) AS start_ms, max_by(end_ms,start_ms) AS end_ms, string_agg(text,' ' ORDER BY start_ms) AS source_text FROM (
  SELECT *, sum(CASE WHEN start_ms-pe>=700 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, segment_id ORDER BY start_ms) AS grp FROM (
   SELECT *, lag(end_ms) OVER (PARTITION BY job_id, segment_id ORDER BY start_ms) AS pe FROM seg_words)) GROUP BY ALL),
t AS (SELECT job_id, segment_id, source_text AS vi, list_filter(list_transform(string_split(regexp_replace(trim(source_text),'([.!?])[\t\n\f\r ]+','\1'||chr(1),'g'),chr(1)), lambda x: trim(x)), lambda x: x<>'') AS parts, start_ms, end_ms FROM segments),
n AS (SELECT job_id, segment_id, count(*) AS n FROM g GROUP BY ALL)
SELECT g.job_id, g.segment_id, g.segment_id||'__clause_'||lpad((grp+1)::VARCHAR,3,'0') AS clause_id, g.start_ms, g.end_ms, g.source_text, parts[CAST(grp+1 AS BIGINT)] AS translated_text FROM g JOIN n USING (job_id, segment_id) JOIN t USING (job_id, segment_id) WHERE n>1 AND n=len(parts)
UNION ALL SELECT t.job_id, t.segment_id, t.segment_id, t.start_ms, t.end_ms, vi, vi FROM t JOIN n USING (job_id, segment_id) WHERE NOT (n>1 AND n=len(parts))
""".replace("WITH g AS", "SELECT * FROM (WITH g AS") + ")")
def pause_clauses(spark, sf):
    t = table(spark, sf, "segments").select("job_id", "segment_id", F.col("source_text").alias("vi_text"))
    return sb.pause_clauses(_seg_words(spark, sf), t)


@query("merge_short_fragments")
def merge_short_fragments(spark, sf):
    c = table(spark, sf, "cues").select(
        "job_id", F.col("cue_id").alias("segment_id"), "start_ms", "end_ms",
        F.regexp_replace("source_text", r"\.$", "").alias("source_text"), F.col("source_text").alias("vi_text"),
    )
    return sb.merge_short_fragments(c, max_gap_ms=1_500)


def _subtitles(spark, sf):
    s = table(spark, sf, "segments").withColumn("display_text", F.concat_ws(" ", F.lit("So"), "source_text"))
    return sb.subtitle_split(s, _seg_words(spark, sf))


@query("subtitle_split")
def subtitle_split(spark, sf):
    return _subtitles(spark, sf)


@query("distribute_words")
def distribute_words(spark, sf):
    s = table(spark, sf, "segments").withColumn("sizes", F.array(F.lit(3), F.col("n_words") % 5 + 1, F.lit(4)))
    d = sb.distribute_words(s, "source_text", "sizes", "parts")
    return d.select("job_id", "segment_id", F.posexplode("parts").alias("part", "text"))


@query("wrap_text")
def wrap_text(spark, sf):
    return table(spark, sf, "segments").select("job_id", "segment_id", F.posexplode(tx.wrap_text(F.col("source_text"))).alias("n", "line"))


@query("subtitle_lines", ("cues",), r"""
SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, cue_id) AS BIGINT) AS line_no,
 'Dialogue: 0,'||a||','||b||',Bilingual,,0,0,0,,{\an2\q2\pos(960,1043)\pbo0}'||t||'\N'||upper(t) AS line FROM (SELECT *,
 start_ms//3600000||':'||lpad((start_ms//60000%60)::VARCHAR,2,'0')||':'||lpad((start_ms//1000%60)::VARCHAR,2,'0')||'.'||lpad((start_ms//10%100)::VARCHAR,2,'0') AS a,
 end_ms//3600000||':'||lpad((end_ms//60000%60)::VARCHAR,2,'0')||':'||lpad((end_ms//1000%60)::VARCHAR,2,'0')||'.'||lpad((end_ms//10%100)::VARCHAR,2,'0') AS b, '('||left(cue_id,12)||')' AS t FROM cues)""")
def subtitle_lines(spark, sf):
    label = F.concat(F.lit("{"), F.substring("cue_id", 1, 12), F.lit("}"))
    c = table(spark, sf, "cues").select(
        "job_id", "start_ms", "end_ms", F.col("cue_id").alias("segment_id"), F.lit(1).alias("part"), label.alias("source_text"),
        F.upper(label).alias("translation_text"),
    )
    return sb.subtitle_lines(c)


@query("subtitle_script")
def subtitle_script(spark, sf):
    return sb.subtitle_lines(_subtitles(spark, sf))



