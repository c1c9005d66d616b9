"""Registry of runnable queries, each kept next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], sql: str) -> None:
    CTES[name] = (deps, sql)


def with_ctes(deps: tuple[str, ...], body: str) -> str:
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for d in deps:
        visit(d)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    return f"WITH {head}\n{body}" if head else body


def query(name: str, deps: tuple[str, ...] = (), sql: str | None = None):
    """Register a query; with ``sql`` also its DuckDB check over the derived-table CTEs ``deps``."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(deps, sql)
        return fn

    return add


cte("turns", (), r"""
SELECT conv_id AS job_id, turn AS chunk_id, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS ctext FROM conversations""")
cte("timed", ("turns",), r"""
SELECT *, CAST(60*length(text)+40 AS BIGINT) AS dur,
 CAST(CASE WHEN right(text,1) IN ('.','?','!') THEN 600+150*(pos%7) WHEN right(text,1)=',' THEN 280
  WHEN pos%41=0 THEN 900 ELSE 20*(pos%4) END AS BIGINT) AS gap
FROM (SELECT job_id, chunk_id, unnest(string_split(ctext,' ')) AS text,
  CAST(generate_subscripts(string_split(ctext,' '),1) AS BIGINT) AS pos FROM turns WHERE ctext<>'')""")
cte("turn_base", ("timed",), r"""
SELECT job_id, chunk_id, 3000*chunk_id + coalesce(sum(total) OVER (PARTITION BY job_id ORDER BY chunk_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS base
FROM (SELECT job_id, chunk_id, sum(dur+gap) AS total FROM timed GROUP BY job_id, chunk_id)""")
cte("words", ("timed", "turn_base"), r"""
SELECT job_id, chunk_id, pos, text, CAST(s AS BIGINT) AS start_ms, CAST(s+dur AS BIGINT) AS end_ms FROM (
 SELECT t.*, b.base + sum(dur+gap) OVER (PARTITION BY t.job_id, t.chunk_id ORDER BY pos) - dur - gap AS s
 FROM timed t JOIN turn_base b ON t.job_id=b.job_id AND t.chunk_id=b.chunk_id)""")
cte("segments", ("turns", "words"), r"""
SELECT t.job_id, t.chunk_id, 'seg_'||lpad(CAST(t.chunk_id+1 AS VARCHAR),6,'0') AS segment_id, w.start_ms, w.end_ms,
 t.ctext AS source_text, w.n_words,
 CASE t.chunk_id%5 WHEN 1 THEN ['word_timestamp_repaired'] WHEN 2 THEN ['hard_split']
  WHEN 3 THEN ['timestamps_missing','chunk_text_fallback'] WHEN 4 THEN ['short_context_merged','hard_split']
  ELSE CAST([] AS VARCHAR[]) END AS risk_flags
FROM turns t JOIN (SELECT job_id, chunk_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words
 FROM words GROUP BY job_id, chunk_id) w ON t.job_id=w.job_id AND t.chunk_id=w.chunk_id""")
cte("sent_words", ("words",), r"""
SELECT *, sum(brk) OVER (PARTITION BY job_id ORDER BY start_ms) AS sno FROM (
 SELECT *, CASE WHEN pe IS NULL THEN 0 WHEN pterm THEN 1
   WHEN start_ms-pe>=700 AND NOT pleft AND NOT rightd THEN 1 ELSE 0 END AS brk FROM (
  SELECT *, lag(end_ms) OVER w AS pe, lag(term) OVER w AS pterm, lag(leftd) OVER w AS pleft FROM (
   SELECT *, right(text,1) IN ('.','?','!',';',':','。','？','！') AS term,
    regexp_replace(lower(text),'^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$','','g') IN ('a','an','the','and','or','but','of','to','for','with','by','as','that','which','who','whose','what','when','where','how','will','would','could','should','can','may','might','must','is','are','was','were','be','been','being') AS leftd,
    regexp_replace(lower(text),'^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$','','g') IN ('of','to','for','with','by','as','than','from') AS rightd
   FROM words) WINDOW w AS (PARTITION BY job_id ORDER BY start_ms)))""")
cte("cues", ("sent_words",), r"""
SELECT *, 'cue_'||substr(sha256(start_ms::VARCHAR||':'||end_ms::VARCHAR||':'||parents||':'||source_text),1,12) AS cue_id FROM (
 SELECT job_id, CAST(sno+1 AS BIGINT) AS sentence_no, min(start_ms) AS start_ms, max_by(end_ms,start_ms) AS end_ms,
  regexp_replace(string_agg(text,' ' ORDER BY start_ms),'\s+([,.;:!?])','\1','g') AS source_text,
  array_to_string(list_sort(list_distinct(list('seg_'||lpad(CAST(chunk_id+1 AS VARCHAR),6,'0')))),'|') AS parents,
  count(*) AS n_words, max_by(term,start_ms) AS term
 FROM sent_words GROUP BY job_id, sno)""")
cte("islands", ("words",), r"""
SELECT job_id, CAST(isl AS BIGINT) AS interval_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS word_count FROM (
 SELECT *, sum(CASE WHEN start_ms-pe>=250 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY start_ms) AS isl FROM (
  SELECT *, lag(end_ms) OVER (PARTITION BY job_id ORDER BY start_ms) AS pe FROM words)) GROUP BY job_id, isl""")
cte("glossary_raw", ("words",), r"""
SELECT 'term_'||printf('%04d',pos) AS term_id, *, 'term' AS category FROM (
 SELECT CASE WHEN k=1 THEN token ELSE upper(token) END AS original,
  CASE WHEN k=1 THEN (40+rank%50)/100.0::DOUBLE ELSE (30+rank%70)/100.0::DOUBLE END AS confidence, 2*rank-2+k AS pos,
  reverse(token) AS vietnamese, rank%9=0 AS protected, rank%4<>0 AS locked, rank
 FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rank FROM (
   SELECT lower(text) AS token, count(*) AS n FROM words WHERE regexp_matches(lower(text),'^[a-z]{4,}$') GROUP BY 1
   )), (VALUES (1),(2)) v(k))""")
cte("terms", ("glossary_raw",), "SELECT * FROM glossary_raw WHERE pos%2=1")
cte("translations", ("segments",), r"""
SELECT job_id, chunk_id, segment_id, CASE WHEN k=0 THEN '' WHEN k=1 THEN concat_ws(' ',t,t,t,t) WHEN k=2 THEN '   '
 WHEN k<6 THEN replace(t,'e','E') ELSE replace(t,'the','eht') END AS vi_text
FROM (SELECT *, (job_id*7+chunk_id)%10 AS k, source_text AS t FROM segments)""")
cte("frames", (), r"""
SELECT user_id AS job_id, i, 500*(i-1) AS start_ms, 500*i AS end_ms, CAST(floor(value) AS BIGINT) AS rms, value FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)""")
cte("intervals", (), r"""
SELECT user_id AS job_id, event_id AS interval_id, ms - min(ms) OVER (PARTITION BY user_id) AS start_ms,
 ms - min(ms) OVER (PARTITION BY user_id) + CAST(floor(value*1000) AS BIGINT) AS end_ms
FROM (SELECT *, CAST(floor(epoch_us(ts)/1000) AS BIGINT) AS ms FROM events)""")
cte("audio", (), r"""
SELECT vec_id AS clip_id, 100 AS sample_rate, CAST(i AS BIGINT) AS i,
 CAST(CASE WHEN vec_id%5=0 AND i BETWEEN 20 AND 40 THEN 0 WHEN vec_id%7=0 AND i<12 THEN 0
  ELSE floor(x::DOUBLE * 30000) END AS BIGINT) AS s
FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding,1)-1 AS i FROM embeddings)""")
cte("manifest", (), r"""
SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS name, epoch_ms(l_shipdate) AS created_ms, l_partkey AS partkey,
 l_suppkey AS suppkey, CAST(round(l_extendedprice*100) AS BIGINT) AS cents, md5(l_partkey::VARCHAR) AS sha256,
 l_returnflag AS returnflag, l_linestatus AS linestatus, CAST(round(l_tax*100) AS BIGINT) AS tax_pct FROM lineitem""")
cte("nb", ("cues",), """
SELECT *, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns, lead(cue_id) OVER w AS nid, lag(cue_id) OVER w AS pid,
 lag(source_text) OVER w AS ptext, lead(source_text) OVER w AS ntext
 FROM cues WINDOW w AS (PARTITION BY job_id ORDER BY start_ms, end_ms, cue_id)""")
cte("gaps", ("nb",), """
SELECT * EXCLUDE (keep), end_ms-start_ms AS duration_ms, CAST(keep AS BIGINT) AS preserve_pause_ms,
 CAST(greatest(0, end_ms-start_ms-100-keep) AS BIGINT) AS usable_overflow_ms FROM (
 SELECT *, CASE WHEN end_ms-start_ms<250 THEN end_ms-start_ms WHEN end_ms-start_ms<600 THEN greatest(150,trunc((end_ms-start_ms)*0.60::DOUBLE))
  WHEN end_ms-start_ms<1200 THEN greatest(250,trunc((end_ms-start_ms)*0.45::DOUBLE)) ELSE greatest(350,trunc((end_ms-start_ms)*0.30::DOUBLE)) END AS keep
 FROM (
 SELECT job_id, 'before_first' AS position, CAST(0 AS BIGINT) AS start_ms, start_ms AS end_ms, NULL AS preceding_cue_id, cue_id AS following_cue_id
  FROM nb WHERE pe IS NULL AND start_ms>0
 UNION ALL SELECT job_id,'between_speech', end_ms, ns, cue_id, nid FROM nb WHERE ns>end_ms
 UNION ALL SELECT job_id,'after_last', end_ms, end_ms+job_id%3*1000, cue_id, NULL FROM nb WHERE ns IS NULL AND job_id%3>0))""")
cte("doc_words", (), r"""
SELECT job_id, chunk_id, 'line_'||lpad(chunk_id::VARCHAR,6,'0') AS segment_id, pos, text, chunk_id*1000000+100*pos AS start_ms, chunk_id*1000000+100*pos+80 AS end_ms FROM (
 SELECT job_id, chunk_id, unnest(string_split(t,' ')) AS text, CAST(generate_subscripts(string_split(t,' '),1) AS BIGINT) AS pos FROM (
  SELECT job_id, chunk_id, trim(regexp_replace(l,'\s+',' ','g')) AS t FROM (
   SELECT doc_id AS job_id, unnest(string_split(text, chr(10))) AS l, CAST(generate_subscripts(string_split(text, chr(10)),1)-1 AS BIGINT) AS chunk_id FROM documents)) WHERE t<>'')""")
cte("doc_lines", ("doc_words",), """
SELECT job_id, chunk_id, segment_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words, string_agg(text,' ' ORDER BY pos) AS source_text
FROM doc_words GROUP BY ALL""")
