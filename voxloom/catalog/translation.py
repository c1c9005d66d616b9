"""Queries on glossary terms, translations and review."""

from pyspark.sql import functions as F

from voxloom.catalog.base import cte, query
from voxloom.functions import text as tx
from voxloom.operators import glossary as gl
from voxloom.operators import review as rv
from voxloom.operators import transcript as tr
from voxloom.operators import translation as tn
from voxloom.sources.derive import doc_lines, table

W = r"[\p{L}\p{N}_]"

# --- glossary --------------------------------------------------------------------------------


def _scoped_terms(spark, sf):
    """Raw terms as proposed by every recording that uses the token."""
    g = table(spark, sf, "glossary_raw")
    w = table(spark, sf, "words").select("job_id", "chunk_id", F.lower("text").alias("k")).distinct()
    t = g.withColumn("k", F.lower("original")).join(w, "k")
    return t.withColumn("source_segments", F.array(F.format_string("seg_%06d", F.col("chunk_id") + 1))).withColumn(
        "forbidden", F.array(F.reverse("original"), F.col("vietnamese"))
    ).withColumn("pos", F.col("pos") + 1000 * F.col("chunk_id")).withColumn("batch_id", F.col("job_id") % 7)


cte("scoped", ("glossary_raw", "words"), """
SELECT g.* EXCLUDE (pos), g.pos+1000*w.chunk_id AS pos, w.job_id, w.chunk_id, w.job_id%7 AS batch_id, 'seg_'||lpad((w.chunk_id+1)::VARCHAR,6,'0') AS seg FROM glossary_raw g
JOIN (SELECT DISTINCT job_id, chunk_id, lower(text) AS k FROM words) w ON lower(g.original)=w.k""")


@query("merge_glossary", ("scoped",), """
SELECT job_id, lower(original) AS term_key, w.term_id, w.original, w.vietnamese, w.category, w.confidence, w.protected, locked, first_pos, copies FROM (
 SELECT job_id, lower(original) AS original, arg_max({'term_id':term_id,'original':original,'vietnamese':vietnamese,'category':category,'confidence':confidence,'protected':protected},
  row(protected,confidence,-pos)) AS w, bool_or(locked) AS locked, min(pos) AS first_pos, count(*) AS copies FROM scoped GROUP BY job_id, lower(original))""")
def merge_glossary(spark, sf):
    return gl.merge_glossary(_scoped_terms(spark, sf), ["job_id"])


@query("merge_glossary_segments", ("scoped",), "SELECT DISTINCT job_id, lower(original) AS term_key, seg AS source_segments FROM scoped")
def merge_glossary_segments(spark, sf):
    return gl.glossary_links(_scoped_terms(spark, sf), ["job_id"], "source_segments")


@query("merge_glossary_forbidden", ("scoped",), """
SELECT DISTINCT job_id, lower(original) AS term_key, unnest([reverse(original), vietnamese]) AS forbidden FROM scoped""")
def merge_glossary_forbidden(spark, sf):
    return gl.glossary_links(_scoped_terms(spark, sf), ["job_id"], "forbidden")


@query("shared_glossary", ("scoped",), """
SELECT batch_id, lower(original) AS term_key, arg_max(term_id, row(protected,confidence,-pos2)) AS term_id, bool_or(locked) AS locked, count(DISTINCT job_id) AS n_jobs
 FROM (SELECT *, pos+job_id*100000 AS pos2 FROM scoped) GROUP BY ALL""")
def shared_glossary(spark, sf):
    from voxloom.operators import state as st

    t = _scoped_terms(spark, sf).withColumn("pos", F.col("pos") + F.col("job_id") * 100000)
    return st.shared_glossary(t)


@query("batch_recordings", ("scoped",), "SELECT DISTINCT batch_id, job_id FROM scoped")
def batch_recordings(spark, sf):
    from voxloom.operators import state as st

    return st.batch_recordings(_scoped_terms(spark, sf))


def _span_rows(spark, sf):
    """Two-letter words as stand-in notation spans, found the same way in both engines."""
    w = table(spark, sf, "words").where(F.rlike("text", F.lit("^[A-Za-z]{2}$")))
    return w.select(
        "job_id", F.format_string("seg_%06d", F.col("chunk_id") + 1).alias("segment_id"), F.col("text").alias("canonical"),
        F.concat_ws(" ", F.substring("text", 1, 1), F.substring("text", 2, 1)).alias("spoken"), F.col("text").alias("display"),
        F.lit("pair").alias("kind"), F.lit("pair.rule").alias("rule_id"), "start_ms",
        F.array(F.lower(F.reverse("text"))).alias("forbidden"),
    )


cte("spans", ("words",), """
SELECT job_id, 'seg_'||lpad((chunk_id+1)::VARCHAR,6,'0') AS segment_id, text AS canonical, text[1]||' '||text[2] AS spoken, start_ms, lower(reverse(text)) AS forbidden
FROM words WHERE regexp_full_match(text,'[A-Za-z]{2}')""")


@query("glossary_from_spans", ("spans",), """
SELECT job_id, 'protected_'||lower(c) AS term_id, c AS original, s AS vietnamese, 'pair' AS category, TRUE AS locked, TRUE AS protected,
 'Domain protected span generated by pair.rule.' AS notes FROM (SELECT job_id, min_by(canonical,start_ms) AS c, min_by(spoken,start_ms) AS s FROM spans GROUP BY job_id, lower(canonical))""")
def glossary_from_spans(spark, sf):
    return gl.glossary_from_spans(_span_rows(spark, sf), ["job_id"], ["start_ms"])


# a second domain, as a table of rules: (priority, rule, pattern, canonical, spoken, display, kind, forbidden)
PLAIN_RULES = [
    (0, "plain.number", r"(?<!\S)([0-9]+)(?!\S)", "{1}", "", "no. {1}", "number", ["."]),
    (1, "plain.pair", r"(?<!\S)([A-Za-z])([A-Za-z])(?!\S)", "{1}{2}", "{1} {2}", "{1}{2}", "pair", ["eht", " "]),
]


def _plain_rules(spark):
    return spark.createDataFrame(PLAIN_RULES, tx.RULE_SCHEMA)


cte("plain_spans", ("words",), """
SELECT job_id, segment_id, start_ms, CAST(ch AS INTEGER) AS start_char, CAST(ch+length(text) AS INTEGER) AS end_char, text AS source_text, text AS canonical, k AS kind, 'plain.'||k AS rule_id,
 CASE k WHEN 'pair' THEN text[1]||' '||text[2] ELSE '' END AS spoken, CASE k WHEN 'pair' THEN text ELSE 'no. '||text END AS display,
 CASE k WHEN 'pair' THEN ['eht',' '] ELSE ['.'] END AS forbidden FROM (
 SELECT job_id, 'seg_'||lpad((chunk_id+1)::VARCHAR,6,'0') AS segment_id, min(start_ms) OVER (PARTITION BY job_id, chunk_id) AS start_ms, text,
  sum(length(text)+1) OVER (PARTITION BY job_id, chunk_id ORDER BY pos)-length(text)-1 AS ch,
  CASE WHEN regexp_full_match(text,'[A-Za-z]{2}') THEN 'pair' WHEN regexp_full_match(text,'[0-9]+') THEN 'number' END AS k FROM words) WHERE k IS NOT NULL""")


@query("domain_spans", ("plain_spans",), "SELECT * EXCLUDE (start_ms, forbidden), array_to_string(forbidden,'|') AS forbidden FROM plain_spans")
def domain_spans(spark, sf):
    s = tr.protected_spans(table(spark, sf, "segments"), rule_table=_plain_rules(spark))
    return s.withColumn("forbidden", F.array_join("forbidden", "|"))


@query("domain_glossary", ("plain_spans",), """
SELECT job_id, 'protected_'||lower(s.canonical) AS term_id, s.canonical AS original, s.spoken AS vietnamese, s.kind AS category, TRUE AS locked, TRUE AS protected,
 'Domain protected span generated by '||s.rule_id||'.' AS notes, s.spoken AS spoken, s.display AS display, array_to_string(s.forbidden,'|') AS forbidden FROM (
 SELECT job_id, arg_min(p, (start_ms, segment_id, start_char)) AS s FROM plain_spans p GROUP BY job_id, lower(canonical))""")
def domain_glossary(spark, sf):
    s = table(spark, sf, "segments")
    spans = tr.protected_spans(s, rule_table=_plain_rules(spark)).join(s.select("job_id", "segment_id", "start_ms"), ["job_id", "segment_id"])
    g = gl.glossary_from_spans(spans, ["job_id"], ["start_ms", "segment_id", "start_char"], full=True)
    return g.withColumn("forbidden", F.array_join("forbidden", "|"))


@query("domain_span_errors", ("plain_spans", "translations"), r"""
, said AS (SELECT job_id, segment_id, vi_text, trim(regexp_replace(list_reduce(list_concat([vi_text], own),
  lambda acc, x: regexp_replace(acc, x, x[1]||' '||x[2], 'gi')), '\s+', ' ', 'g')) AS spoken_text
 FROM (SELECT job_id, segment_id, list_sort(list_distinct(coalesce(list(canonical) FILTER (kind='pair'), []))) AS own FROM plain_spans GROUP BY ALL) JOIN translations USING (job_id, segment_id))
SELECT job_id, segment_id, unnest(list_filter(list_concat(list_transform(forbidden, lambda f: CASE WHEN trim(f)<>'' AND contains(lower(vi_text), f)
   THEN 'protected span '||canonical||' was translated as forbidden term '||f END),
  [CASE WHEN spoken<>'' AND NOT contains(lower(spoken_text), lower(spoken)) THEN 'protected span '||canonical||' must be represented as '||lower(spoken) END]), lambda x: x IS NOT NULL)) AS error
FROM plain_spans JOIN said USING (job_id, segment_id)""")
def domain_span_errors(spark, sf):
    return tn.span_errors(table(spark, sf, "segments"), table(spark, sf, "translations"), rule_table=_plain_rules(spark))


@query("seed_terms", ("scoped",), None)
def seed_terms(spark, sf):
    s = gl.seed_terms(_scoped_terms(spark, sf))
    return s.withColumn("forbidden", F.array_join("forbidden", "|"))


def _raw_terms(spark, sf):
    g = table(spark, sf, "glossary_raw")
    k = F.col("pos") % 4
    obj = F.to_json(F.struct("original", "vietnamese", "confidence"))
    term = (
        F.when(k == 0, F.concat(F.lit('"'), "original", F.lit('"')))
        .when(k == 1, obj)
        .when(k == 2, F.lit('{"original": "  ", "notes": "blank"}'))
        .otherwise(F.to_json(F.struct("original", "term_id", F.lit("name").alias("category"))))
    )
    return g.select(
        (F.col("pos") % 5).alias("job_id"), (F.col("pos") % 3).alias("block_index"), F.col("pos").alias("term_index"),
        term.alias("term"),
    )


@query("normalize_terms", ("glossary_raw",), """
SELECT pos%5 AS job_id, pos%3 AS block_index, pos AS term_index, CASE WHEN pos%4=3 THEN term_id ELSE 'term_'||lpad((pos%3)::VARCHAR,2,'0')||'_'||printf('%04d',pos) END AS term_id,
 original, CASE WHEN pos%4=1 THEN vietnamese ELSE '' END AS vietnamese, CASE WHEN pos%4=3 THEN 'name' ELSE 'term' END AS category,
 CASE pos%4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN confidence ELSE 1.0::DOUBLE END AS confidence, TRUE AS locked FROM glossary_raw WHERE pos%4<>2""")
def normalize_terms(spark, sf):
    return gl.normalize_terms(_raw_terms(spark, sf))


def _answers(spark, sf):
    """Model answers about each turn's first two words, in four shapes."""
    s = table(spark, sf, "segments")
    t = tx.tokens(F.regexp_replace("source_text", r"[^\p{L}\p{N} ]", ""))
    a, b = F.coalesce(F.get(t, F.lit(0)), F.lit("x")), F.coalesce(F.get(t, F.lit(1)), F.lit("y"))
    arr = F.concat(F.lit('[{"original":"'), a, F.lit('"},{"original":"'), b, F.lit('"}]'))
    obj = F.concat(F.lit('{"terms":'), arr, F.lit("}"))
    k = (F.col("job_id") + F.col("chunk_id")) % 4
    content = (
        F.when(k == 0, obj)
        .when(k == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
        .when(k == 2, arr)
        .otherwise(F.concat(F.lit("Terms:\n* "), a, F.lit(": first one\n- **"), b, F.lit("** second\nend")))
    )
    return s.select("job_id", F.col("chunk_id").alias("block_index"), content.alias("content"))


@query("response_terms", ("segments",), r"""
SELECT job_id, chunk_id AS block_index, CAST(i AS BIGINT) AS term_index, CASE (job_id+chunk_id)%4 WHEN 1 THEN 'fenced' WHEN 3 THEN 'bullets' ELSE 'json' END AS way,
 CASE WHEN (job_id+chunk_id)%4=3 THEN '{"original":"'||o||'","confidence":0.4}' ELSE '{"original":"'||o||'"}' END AS term FROM (
 SELECT job_id, chunk_id, i, coalesce(t[i], CASE i WHEN 1 THEN 'x' ELSE 'y' END) AS o FROM (
  SELECT *, list_filter(string_split(regexp_replace(source_text,'[^\p{L}\p{N} ]','','g'),' '), lambda x: x<>'') AS t FROM segments), (VALUES (1),(2)) v(i))""")
def response_terms(spark, sf):
    return gl.response_terms(_answers(spark, sf))


def _long_answers(spark, sf):
    """Answers that hold a list of all words of a turn between other brackets."""
    s = table(spark, sf, "segments").withColumn("t", F.regexp_replace("source_text", r'[\[\]{}"\\\\]', ""))
    listed = F.transform(tx.tokens("t"), lambda w: F.concat(F.lit('{"original":"'), w, F.lit('"}')))
    text = F.concat(F.lit("Note {see [x "), "t", F.lit(']} and "[y", then: ['), F.array_join(listed, ", "), F.lit("] {end ]"))
    return s.select("job_id", F.col("chunk_id").alias("block_index"), text.alias("content"))


@query("embedded_terms", ("segments",), r"""
SELECT job_id, chunk_id AS block_index, CAST(i AS BIGINT) AS term_index, 'embedded' AS way, '{"original":"'||w||'"}' AS term FROM (
 SELECT job_id, chunk_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (
  SELECT job_id, chunk_id, list_filter(string_split(regexp_replace(source_text,'[\[\]{}"\\]','','g'),' '), lambda x: x<>'') AS t FROM segments))""")
def embedded_terms(spark, sf):
    return gl.response_terms(_long_answers(spark, sf))


# every term is one whole word of letters, so it applies where it is a word of the text
cte("applies", ("segments", "terms"), r"""
SELECT s.job_id, s.segment_id, t.term_id, t.original, t.vietnamese, t.locked FROM (
 SELECT DISTINCT job_id, segment_id, unnest(regexp_extract_all(lower(source_text), '[\p{L}\p{N}_]+')) AS tok FROM segments) s JOIN terms t ON t.original=s.tok""")
cte("lacking", ("applies", "translations"), """
SELECT a.job_id, a.segment_id, a.term_id, a.original FROM applies a JOIN translations t ON a.job_id=t.job_id AND a.segment_id=t.segment_id
WHERE a.locked AND NOT contains(lower(t.vi_text), a.vietnamese)""")


@query("term_applies", ("applies",), "SELECT job_id, segment_id, term_id FROM applies")
def term_applies(spark, sf):
    return gl.applicable_terms(table(spark, sf, "segments"), table(spark, sf, "terms")).select("job_id", "segment_id", "term_id")


@query("locked_terms_missing", ("lacking",), "SELECT * FROM lacking")
def locked_terms_missing(spark, sf):
    return gl.locked_terms_missing(table(spark, sf, "segments"), table(spark, sf, "translations"), table(spark, sf, "terms"))


# --- translations ----------------------------------------------------------------------------


def _arrivals(spark, sf):
    """Answers in order of arrival: some ids twice, some never, some nobody asked for."""
    t = table(spark, sf, "translations").where("chunk_id % 5 <> 4")
    first = t.select("job_id", "segment_id", "vi_text", F.lit(1).alias("arrival"))
    again = t.where("chunk_id % 3 = 1").select("job_id", "segment_id", F.concat("vi_text", F.lit(" (again)")).alias("vi_text"), F.lit(2).alias("arrival"))
    alien = t.where("chunk_id = 0").select("job_id", F.lit("seg_999999").alias("segment_id"), "vi_text", F.lit(3).alias("arrival"))
    return first.unionByName(again).unionByName(alien)


cte("answers", ("translations",), """
SELECT job_id, segment_id, CASE WHEN chunk_id%3=1 THEN vi_text||' (again)' ELSE vi_text END AS vi_text FROM translations WHERE chunk_id%5<>4""")


@query("attach_translations", ("segments", "answers"), """
SELECT s.job_id, s.segment_id, s.source_text, coalesce(a.vi_text,'') AS vi_text, a.job_id IS NOT NULL AS answered FROM segments s LEFT JOIN answers a ON s.job_id=a.job_id AND s.segment_id=a.segment_id""")
def attach_translations(spark, sf):
    return tn.attach_translations(table(spark, sf, "segments").select("job_id", "segment_id", "source_text"), _arrivals(spark, sf))


@query("missing_targets", ("segments",), "SELECT job_id, segment_id FROM segments WHERE chunk_id%5=4")
def missing_targets(spark, sf):
    return tn.missing_targets(table(spark, sf, "segments").select("job_id", "segment_id"), _arrivals(spark, sf))


@query("first_k_errors", ("segments",), """
SELECT job_id, count(*) AS n_missing, string_agg(segment_id, ', ' ORDER BY chunk_id) FILTER (rn<=5) AS first_ids FROM (
 SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY chunk_id) AS rn FROM segments WHERE chunk_id%2=1) GROUP BY job_id""")
def first_k_errors(spark, sf):
    s = table(spark, sf, "segments").where("chunk_id % 2 = 1")
    return tn.first_k_errors(s.select("job_id", "segment_id", F.col("chunk_id").alias("ord")))


@query("id_set_mismatch", ("segments",), """
SELECT job_id, chunk_id AS ord, segment_id AS source_id, CASE WHEN chunk_id%4<>3 THEN CASE WHEN job_id%3=0 AND chunk_id%4=1 THEN 'seg_x' ELSE segment_id END END AS translated_id
FROM segments WHERE chunk_id%4=3 OR (job_id%3=0 AND chunk_id%4=1)""")
def id_set_mismatch(spark, sf):
    s = table(spark, sf, "segments").select("job_id", "segment_id", F.col("chunk_id").alias("ord"))
    other = F.when((F.col("job_id") % 3 == 0) & (F.col("ord") % 4 == 1), F.lit("seg_x")).otherwise(F.col("segment_id"))
    return tn.id_set_mismatch(s, s.where("ord % 4 <> 3").withColumn("segment_id", other))


@query("length_ratio", ("segments", "translations"), """
SELECT s.job_id, s.segment_id, CAST(length(trim(t.vi_text))*10000//greatest(1,length(trim(s.source_text))) AS BIGINT) AS ratio_e4 FROM segments s JOIN translations t ON s.job_id=t.job_id AND s.segment_id=t.segment_id""")
def length_ratio(spark, sf):
    p = table(spark, sf, "segments").select("job_id", "segment_id", "source_text").join(table(spark, sf, "translations"), ["job_id", "segment_id"])
    return tn.length_ratios(p)


cte("perr", ("spans", "translations"), """
SELECT s.job_id, s.segment_id, unnest(list_filter([CASE WHEN contains(lower(vi_text), forbidden) THEN 'protected span '||canonical||' was translated as forbidden term '||forbidden END,
 CASE WHEN NOT contains(lower(vi_text), lower(spoken)) THEN 'protected span '||canonical||' must be represented as '||lower(spoken) END], lambda x: x IS NOT NULL)) AS error
FROM spans s JOIN translations t ON s.job_id=t.job_id AND s.segment_id=t.segment_id""")


def _texts(spark, sf):
    return table(spark, sf, "translations").select(
        "job_id", "segment_id", F.col("vi_text").alias("display_text"), F.lower("vi_text").alias("spoken_text")
    )


@query("protected_errors", ("perr",), "SELECT * FROM perr")
def protected_errors(spark, sf):
    return tn.protected_errors(_span_rows(spark, sf), _texts(spark, sf))


@query("spoken_text_errors", ("spans", "translations"), """
SELECT job_id, segment_id, 'spoken_text is required when display_text is not empty' AS error FROM translations WHERE trim(vi_text)<>'' AND chunk_id%3=0
UNION ALL SELECT s.job_id, s.segment_id, unnest(list_filter([CASE WHEN contains(lower(vi_text), forbidden) THEN 'protected span '||canonical||' was translated as forbidden term '||forbidden||' in display_text' END,
 CASE WHEN chunk_id%3<>0 AND contains(lower(vi_text), forbidden) THEN 'protected span '||canonical||' was translated as forbidden term '||forbidden||' in spoken_text' END,
 CASE WHEN chunk_id%3=0 OR NOT contains(lower(vi_text), lower(spoken)) THEN 'protected span '||canonical||' must appear in spoken_text as '||lower(spoken) END], lambda x: x IS NOT NULL))
FROM spans s JOIN translations t ON s.job_id=t.job_id AND s.segment_id=t.segment_id WHERE trim(vi_text)<>''""")
def spoken_text_errors(spark, sf):
    t = table(spark, sf, "translations")
    spoken = F.when(F.col("chunk_id") % 3 == 0, F.lit(" ")).otherwise(F.lower("vi_text"))
    t = t.select("job_id", "segment_id", F.col("vi_text").alias("display_text"), spoken.alias("spoken_text"))
    return tn.spoken_text_errors(_span_rows(spark, sf), t)


@query("translation_warnings", ("segments", "lacking", "perr"), """
WITH p AS (SELECT s.job_id, s.segment_id, CASE WHEN s.chunk_id%6=3 THEN '' ELSE source_text END AS src, t.vi_text FROM segments s JOIN translations t ON s.job_id=t.job_id AND s.segment_id=t.segment_id),
live AS (SELECT * FROM p WHERE trim(src)<>'' AND trim(vi_text)<>'')
SELECT job_id, segment_id, CASE WHEN trim(src)='' THEN 'empty_source_segment_translated' WHEN trim(vi_text)='' THEN 'empty_translation' ELSE 'length_ratio_exceeded' END AS warning, '' AS detail
 FROM p WHERE (trim(src)='' AND trim(vi_text)<>'') OR (trim(src)<>'' AND trim(vi_text)='') OR (trim(src)<>'' AND length(trim(vi_text))/greatest(1,length(trim(src)))>1.15::DOUBLE)
UNION ALL SELECT e.job_id, e.segment_id, 'translation_protected_span_violation', error FROM perr e JOIN live USING (job_id, segment_id)
UNION ALL SELECT l.job_id, l.segment_id, 'locked_glossary_term_missing', original FROM lacking l JOIN live USING (job_id, segment_id)
""".replace("WITH p AS", "SELECT * FROM (WITH p AS") + ")")
def translation_warnings(spark, sf):
    src = F.when(F.col("chunk_id") % 6 == 3, F.lit("")).otherwise(F.col("source_text"))
    s = table(spark, sf, "segments").withColumn("source_text", src)
    errors = tn.protected_errors(_span_rows(spark, sf), _texts(spark, sf))
    return tn.translation_warnings(s, table(spark, sf, "translations"), table(spark, sf, "terms"), errors)


@query("compress_text", ("segments", "translations", "applies"), r"""
SELECT job_id, segment_id, CASE WHEN fine THEN vi ELSE sh END AS vi_text, CASE WHEN fine THEN '' ELSE
 array_to_string(list_filter([CASE WHEN sh<>vi THEN 'compressed_for_length' END, CASE WHEN length(sh)>lim THEN 'length_compression_required' END, CASE WHEN aft THEN 'locked_glossary_missing' END], lambda x: x IS NOT NULL),'|') END AS warnings FROM (
 SELECT p.*, coalesce(aft,FALSE) AS aft, length(vi)<=lim AND NOT coalesce(bef,FALSE) AS fine FROM (
  SELECT *, trim(regexp_replace(replace(replace(replace(vi,'bây giờ ',''),'một cách ',''),'rất ',''),'\s+',' ','g')) AS sh FROM (
   SELECT s.job_id, s.segment_id, trim(t.vi_text||CASE WHEN s.chunk_id%2=0 THEN ' bây giờ rất  một cách end' ELSE '' END) AS vi, CAST(greatest(1,trunc(greatest(1,length(trim(source_text)))*1.15::DOUBLE)) AS BIGINT) AS lim
   FROM segments s JOIN translations t ON s.job_id=t.job_id AND s.segment_id=t.segment_id)) p
 LEFT JOIN (SELECT a.job_id, a.segment_id, bool_or(NOT contains(lower(t.vi_text), a.vietnamese)) AS bef, bool_or(NOT contains(lower(t.vi_text), a.vietnamese)) AS aft
  FROM applies a JOIN translations t ON a.job_id=t.job_id AND a.segment_id=t.segment_id WHERE a.locked GROUP BY ALL) m ON p.job_id=m.job_id AND p.segment_id=m.segment_id)""")
def compress_text(spark, sf):
    t = table(spark, sf, "translations")
    vi = F.when(F.col("chunk_id") % 2 == 0, F.concat("vi_text", F.lit(" bây giờ rất  một cách end"))).otherwise(F.col("vi_text"))
    p = table(spark, sf, "segments").select("job_id", "segment_id", "source_text").join(
        t.select("job_id", "segment_id", vi.alias("vi_text")), ["job_id", "segment_id"]
    )
    r = tn.compress_translations(p, table(spark, sf, "terms"))
    return r.withColumn("warnings", F.array_join("warnings", "|"))


def _phrase_terms(spark, sf):
    """The glossary, stretches of three words of every third turn as they stand in the text, and single characters."""
    s = table(spark, sf, "segments").where("chunk_id % 3 = 0")
    words = F.slice(tx.tokens("source_text"), 2, 3)
    some = s.select(F.array_join(words, " ").alias("original")).unionByName(s.select(F.upper(F.substring("source_text", 1, 1)).alias("original")))
    some = some.where("original <> ''").distinct()
    made = some.select(F.concat(F.lit("phrase "), "original").alias("term_id"), "original", F.concat(F.lower("original"), F.lit(" x")).alias("vietnamese"), F.lit(True).alias("locked"))
    return table(spark, sf, "terms").select("term_id", "original", "vietnamese", "locked").unionByName(made)


def _used(spark, sf):
    """Terms that a translation says it used: the turn's first character, in its other case."""
    s = table(spark, sf, "segments").where("chunk_id % 2 = 0")
    return s.select("job_id", "segment_id", F.concat(F.lit(" "), F.lower(F.substring("source_text", 1, 1)), F.lit(" ")).alias("used_term"))


cte("all_terms", ("segments", "terms"), """
SELECT term_id, original, vietnamese, locked FROM terms UNION ALL SELECT 'phrase '||original, original, lower(original)||' x', TRUE FROM (
 SELECT array_to_string(list_filter(string_split(source_text,' '), lambda x: x<>'')[2:4],' ') AS original FROM segments WHERE chunk_id%3=0
 UNION SELECT upper(substring(source_text,1,1)) FROM segments WHERE chunk_id%3=0) WHERE original<>''""")
cte("some_pairs", ("segments", "all_terms"), r"""
SELECT job_id, segment_id, low, term_id, original, vietnamese, locked FROM (SELECT DISTINCT job_id, segment_id, lower(source_text) AS low, unnest(regexp_extract_all(lower(source_text), '[\p{L}\p{N}_]+')) AS tok FROM segments) s
JOIN (SELECT *, regexp_extract(lower(original), '[\p{L}\p{N}_]+') AS tok FROM all_terms WHERE length(trim(original))>1) t USING (tok)
UNION ALL SELECT job_id, segment_id, low, term_id, original, vietnamese, locked FROM (SELECT job_id, segment_id, lower(source_text) AS low FROM segments) s
JOIN (SELECT * FROM all_terms WHERE length(trim(original))>1 AND regexp_extract(lower(original), '[\p{L}\p{N}_]+')='') t ON contains(s.low, lower(trim(t.original)))""")
cte("all_apply", ("segments", "all_terms", "some_pairs"), r"""
SELECT job_id, segment_id, term_id, original, vietnamese, locked FROM (SELECT * FROM some_pairs WHERE contains(low, lower(trim(original))))
WHERE regexp_full_match(original, '[a-z]+') OR regexp_matches(low, '(^|[^\p{L}\p{N}_])'||regexp_escape(lower(trim(original)))||'($|[^\p{L}\p{N}_])')
UNION ALL SELECT s.job_id, s.segment_id, t.* FROM segments s JOIN (SELECT * FROM all_terms WHERE length(trim(original))=1) t ON lower(trim(t.original))=lower(substring(s.source_text,1,1)) WHERE s.chunk_id%2=0""")


@query("phrase_terms", ("all_apply",), "SELECT job_id, segment_id, term_id FROM all_apply")
def phrase_terms(spark, sf):
    found = gl.applicable_terms(table(spark, sf, "segments"), _phrase_terms(spark, sf), used=_used(spark, sf))
    return found.select("job_id", "segment_id", "term_id")


@query("used_terms_missing", ("all_apply", "translations"), """
SELECT a.job_id, a.segment_id, a.term_id, a.original FROM all_apply a JOIN translations t ON a.job_id=t.job_id AND a.segment_id=t.segment_id
WHERE a.locked AND NOT contains(lower(t.vi_text), lower(trim(a.vietnamese)))""")
def used_terms_missing(spark, sf):
    return gl.locked_terms_missing(table(spark, sf, "segments"), table(spark, sf, "translations"), _phrase_terms(spark, sf), used=_used(spark, sf))


@query("compress_text_used", ("segments", "translations", "all_apply"), r"""
SELECT job_id, segment_id, CASE WHEN fine THEN vi ELSE sh END AS vi_text, CASE WHEN fine THEN '' ELSE
 array_to_string(list_filter([CASE WHEN sh<>vi THEN 'compressed_for_length' END, CASE WHEN length(sh)>lim THEN 'length_compression_required' END, CASE WHEN aft THEN 'locked_glossary_missing' END], lambda x: x IS NOT NULL),'|') END AS warnings FROM (
 SELECT p.*, coalesce(aft,FALSE) AS aft, length(vi)<=lim AND NOT coalesce(bef,FALSE) AS fine FROM (
  SELECT *, trim(regexp_replace(replace(replace(replace(vi,'bây giờ ',''),'một cách ',''),'rất ',''),'\s+',' ','g')) AS sh FROM (
   SELECT s.job_id, s.segment_id, trim(t.vi_text) AS vi, CAST(greatest(1,trunc(greatest(1,length(trim(source_text)))*1.15::DOUBLE)) AS BIGINT) AS lim
   FROM segments s JOIN translations t ON s.job_id=t.job_id AND s.segment_id=t.segment_id)) p
 LEFT JOIN (SELECT a.job_id, a.segment_id, bool_or(NOT contains(lower(trim(t.vi_text)), lower(trim(a.vietnamese)))) AS bef,
   bool_or(NOT contains(lower(trim(regexp_replace(replace(replace(replace(trim(t.vi_text),'bây giờ ',''),'một cách ',''),'rất ',''),'\s+',' ','g'))), lower(trim(a.vietnamese)))) AS aft
  FROM all_apply a JOIN translations t ON a.job_id=t.job_id AND a.segment_id=t.segment_id WHERE a.locked GROUP BY ALL) m ON p.job_id=m.job_id AND p.segment_id=m.segment_id)""")
def compress_text_used(spark, sf):
    t = table(spark, sf, "translations").select("job_id", "segment_id", "vi_text")
    p = table(spark, sf, "segments").select("job_id", "segment_id", "source_text").join(t, ["job_id", "segment_id"])
    r = tn.compress_translations(p, _phrase_terms(spark, sf), used=_used(spark, sf))
    return r.withColumn("warnings", F.array_join("warnings", "|"))


def _echo_cues(spark, sf):
    """Cues of which some repeat the previous cue's words before their own."""
    from voxloom.plans.sequences import neighbours

    c = neighbours(table(spark, sf, "cues"), ["job_id"], ["start_ms", "end_ms", "cue_id"], ["source_text"], prev="p")
    echo = F.concat_ws(" ", "p.source_text", F.lit("—"), "source_text")
    return c.withColumn("display_text", F.when(F.col("sentence_no") % 3 == 0, echo).otherwise(F.col("source_text")))


@query("trim_boundary_repeats")
def trim_boundary_repeats(spark, sf):
    return tn.trim_boundary_repeats(_echo_cues(spark, sf))


@query("overlap_blocks", ("doc_lines",), """
SELECT job_id, CAST(b AS BIGINT) AS block_no, rn-b*5 AS place, segment_id FROM (
 SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY chunk_id)-1 AS rn, count(*) OVER (PARTITION BY job_id) AS n FROM doc_lines) d,
 LATERAL (SELECT unnest(range(0, CAST(greatest(0,ceil((n-8)/5.0)) AS BIGINT)+1)) AS b) WHERE rn>=b*5 AND rn<b*5+8""")
def overlap_blocks(spark, sf):
    return tn.overlap_blocks(doc_lines(spark, sf), block_size=8, overlap=3, order=["chunk_id"], width=4096)


@query("context_blocks")
def context_blocks(spark, sf):
    return tn.context_blocks(doc_lines(spark, sf), order=["chunk_id"], width=4096)


def _linked(spark, sf):
    """Cues that also name the following segment as a parent now and then."""
    c = table(spark, sf, "cues").withColumn("display_text", F.upper(F.regexp_replace("source_text", "[^a-z ]", "")))
    last = F.element_at("parent_segment_ids", -1)
    nxt = F.format_string("seg_%06d", F.substring(last, 5, 6).cast("long") + 1)
    return c.withColumn(
        "parent_segment_ids",
        F.when(F.col("sentence_no") % 4 == 0, F.array_union("parent_segment_ids", F.array(nxt))).otherwise(F.col("parent_segment_ids")),
    )


cte("cue_link", ("cues", "segments"), """
SELECT l.*, s.chunk_id AS ord, min(s.chunk_id) OVER (PARTITION BY l.job_id, l.cue_id) AS owner, k FROM (
 SELECT job_id, cue_id, start_ms, upper(regexp_replace(source_text,'[^a-z ]','','g')) AS display_text, source_text, unnest(ps) AS segment_id, generate_subscripts(ps,1) AS k FROM (
  SELECT *, CASE WHEN sentence_no%4=0 THEN list_append(p, 'seg_'||lpad((CAST(p[-1][5:] AS BIGINT)+1)::VARCHAR,6,'0')) ELSE p END AS ps FROM (SELECT *, string_split(parents,'|') AS p FROM cues))) l
JOIN segments s ON s.job_id=l.job_id AND s.segment_id=l.segment_id""")


@query("segment_from_cues", ("cue_link", "segments"), """
SELECT s.job_id, s.segment_id, coalesce(t,'') AS display_text, coalesce(n,0) AS n_cues FROM segments s LEFT JOIN (
 SELECT job_id, segment_id, trim(string_agg(trim(display_text),' ' ORDER BY start_ms, cue_id)) AS t, count(*) AS n FROM (
  SELECT *, bool_or(ord=owner) OVER (PARTITION BY job_id, segment_id) AS has FROM cue_link) WHERE ord=owner OR NOT has GROUP BY ALL) g ON s.job_id=g.job_id AND s.segment_id=g.segment_id""")
def segment_from_cues(spark, sf):
    s = table(spark, sf, "segments").withColumn("ord", F.col("chunk_id"))
    return tn.segment_from_cues(s, _linked(spark, sf))


cte("whole_link", ("cue_link", "cues"), """
SELECT l.* EXCLUDE (display_text), c.source_text AS display_text FROM cue_link l JOIN cues c ON l.job_id=c.job_id AND l.cue_id=c.cue_id""")


@query("segment_from_whole_cues", ("whole_link", "segments"), """
SELECT s.job_id, s.segment_id, coalesce(t,'') AS display_text, coalesce(n,0) AS n_cues FROM segments s LEFT JOIN (
 SELECT job_id, segment_id, trim(string_agg(trim(display_text),' ' ORDER BY start_ms, cue_id)) AS t, count(*) AS n FROM (
  SELECT *, bool_or(ord=owner) OVER (PARTITION BY job_id, segment_id) AS has FROM whole_link) WHERE ord=owner OR NOT has GROUP BY ALL) g ON s.job_id=g.job_id AND s.segment_id=g.segment_id""")
def segment_from_whole_cues(spark, sf):
    """As ``segment_from_cues``, the cues' texts whole: capitals, digits, points and all letters."""
    s = table(spark, sf, "segments").withColumn("ord", F.col("chunk_id"))
    return tn.segment_from_cues(s, _linked(spark, sf).withColumn("display_text", F.col("source_text")))


def _edited_segments(spark, sf):
    """Segments with an edit of their first word and a suggestion on every second one."""
    s = table(spark, sf, "segments")
    w = F.substring_index("source_text", " ", 1)
    item = F.struct(w.alias("original"), F.reverse(w).alias("normalized"))
    none = F.array().cast("array<struct<original:string,normalized:string>>")
    k = F.col("chunk_id") % 2
    return s.select(
        "job_id", "segment_id", F.array(item).alias("normalization_edits"),
        F.when(k == 0, F.array(item)).otherwise(none).alias("normalization_suggestions"),
        (0.5 + k / 4).alias("normalization_confidence"), "risk_flags", "chunk_id", "source_text",
    )


@query("cue_parent_enrich", ("cue_link", "segments"), """
SELECT c.job_id, c.cue_id, coalesce(e,0) AS n_edits, coalesce(g,0) AS n_suggestions, coalesce(conf,1.0::DOUBLE) AS normalization_confidence, f AS risk_flags FROM cues c LEFT JOIN (
 SELECT l.job_id, l.cue_id, CAST(sum(a) AS BIGINT) AS e, CAST(sum(a*(1-ord%2)) AS BIGINT) AS g, min(0.5::DOUBLE+(ord%2)/4::DOUBLE) AS conf, string_agg(array_to_string(fl,'|'),'#' ORDER BY k) AS f0, 
  array_to_string(list_filter(flatten(list(fl ORDER BY k)), lambda x,i: list_position(flatten(list(fl ORDER BY k)),x)=i),'|') AS f FROM (
  SELECT l.*, s.risk_flags AS fl, CASE WHEN contains(lower(l.source_text), lower(split_part(s.source_text,' ',1))) OR contains(lower(l.source_text), lower(reverse(split_part(s.source_text,' ',1)))) THEN 1 ELSE 0 END AS a
  FROM cue_link l JOIN segments s ON l.job_id=s.job_id AND l.segment_id=s.segment_id) l GROUP BY ALL) x ON c.job_id=x.job_id AND c.cue_id=x.cue_id""")
def cue_parent_enrich(spark, sf):
    c = _linked(spark, sf).withColumn("source_text_raw", F.col("source_text")).withColumn("risk_flags", F.array().cast("array<string>"))
    r = tn.cue_parent_enrich(c, _edited_segments(spark, sf))
    return r.select(
        "job_id", "cue_id", F.size("normalization_edits").cast("long").alias("n_edits"),
        F.size("normalization_suggestions").cast("long").alias("n_suggestions"), "normalization_confidence",
        F.array_join("risk_flags", "|").alias("risk_flags"),
    )


# --- review ----------------------------------------------------------------------------------


def _review_cues(spark, sf):
    c = table(spark, sf, "cues")
    n = F.col("sentence_no")
    flag = F.when(n % 4 == 1, F.array(F.lit("hard_split"), F.lit("short_context_merged"))).otherwise(F.array(F.lit("short_context_merged")))
    none = F.array().cast("array<string>")
    return c.select(
        "job_id", "cue_id", "start_ms", "end_ms", "source_text", F.when(n % 7 == 0, 1).otherwise(0).alias("n_edits"),
        F.when(n % 11 == 0, 1).otherwise(0).alias("n_suggestions"), flag.alias("risk_flags"),
        F.when(n % 13 == 0, F.array(F.lit("bad span"), F.lit(" "))).otherwise(none).alias("protected_errors"),
        F.when(n % 17 == 0, F.array(F.lit("bad voice"))).otherwise(none).alias("spoken_errors"),
        F.when(n % 5 == 0, F.lit("locked")).alias("review_status"),
    )


@query("review_required", ("cues",), """
SELECT * FROM (SELECT job_id, cue_id, start_ms, end_ms, CASE WHEN n%13=0 THEN 'translation_protected_span_review_required' WHEN n%17=0 THEN 'translation_spoken_text_review_required'
 WHEN n%7=0 OR n%11=0 THEN 'source_normalization_review_required' WHEN n%4=1 THEN 'asr_timeline_review_required' END AS reason,
 CASE WHEN n%13=0 THEN 'bad span' WHEN n%17=0 THEN 'bad voice' END AS error, CASE WHEN n%4=1 THEN 'hard_split' ELSE '' END AS high_risk_flags
FROM (SELECT *, sentence_no AS n FROM cues) WHERE n%5<>0) WHERE reason IS NOT NULL""")
def review_required(spark, sf):
    return rv.review_required(_review_cues(spark, sf))


def _overrides(spark, sf):
    c = table(spark, sf, "cues").where("sentence_no % 2 = 0 AND job_id % 3 <> 1")
    n = F.col("sentence_no")
    start = F.when(n % 8 == 0, F.col("start_ms") - 5000).when(n % 8 == 2, F.col("start_ms") + 10).when(n % 8 == 4, F.lit(-1))
    end = F.when(n % 8 == 6, F.col("end_ms") + 100_000).when(n % 8 == 2, F.col("end_ms") - 10)
    o = c.select(
        "job_id", "cue_id", F.lit(1).alias("arrival"), start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"),
        F.lit(None).cast("string").alias("source_text"), F.concat(F.lit("reviewed "), "source_text").alias("display_text"),
        F.when(n % 4 == 0, F.lit("")).alias("spoken_text"),
    )
    alien = c.where("sentence_no = 2").withColumn("cue_id", F.lit("cue_unknown"))
    return o.unionByName(alien.select(
        "job_id", "cue_id", F.lit(1).alias("arrival"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"),
        F.lit(None).cast("string").alias("source_text"), F.lit("x").alias("display_text"), F.lit("x").alias("spoken_text"),
    ))


cte("viol", ("nb",), """
SELECT job_id, cue_id, n, os, oe, start_ms, end_ms, source_text, CASE WHEN s<0 OR e<0 THEN 'must be a non-negative integer' WHEN e<=s THEN 'must satisfy start_ms < end_ms' WHEN s<pe THEN 'overlaps previous cue' WHEN e>ns THEN 'overlaps next cue' END AS violation FROM (
 SELECT *, coalesce(os,start_ms) AS s, coalesce(oe,end_ms) AS e FROM (SELECT *, sentence_no AS n, CASE sentence_no%8 WHEN 0 THEN start_ms-5000 WHEN 2 THEN start_ms+10 WHEN 4 THEN -1 END AS os,
  CASE sentence_no%8 WHEN 6 THEN end_ms+100000 WHEN 2 THEN end_ms-10 END AS oe FROM nb WHERE sentence_no%2=0 AND job_id%3<>1))""")


@query("review_timing_violations", ("viol",), "SELECT job_id, cue_id, violation FROM viol WHERE violation IS NOT NULL")
def review_timing_violations(spark, sf):
    return rv.timing_violations(table(spark, sf, "cues"), _overrides(spark, sf))


@query("apply_review_lock", ("viol", "cues"), """
SELECT c.job_id, c.cue_id, CASE WHEN v.violation IS NULL THEN coalesce(v.os,c.start_ms) ELSE c.start_ms END AS start_ms, CASE WHEN v.violation IS NULL THEN coalesce(v.oe,c.end_ms) ELSE c.end_ms END AS end_ms,
 c.source_text, CASE WHEN v.job_id IS NOT NULL THEN 'reviewed '||c.source_text ELSE c.source_text END AS display_text, CASE WHEN v.n%4=0 THEN '' ELSE c.source_text END AS spoken_text,
 CASE WHEN v.job_id IS NOT NULL THEN 'locked' END AS review_status, v.violation FROM cues c LEFT JOIN (SELECT * FROM viol WHERE job_id%5 NOT IN (2,3)) v ON c.job_id=v.job_id AND c.cue_id=v.cue_id""")
def apply_review_lock(spark, sf):
    c = table(spark, sf, "cues").withColumn("display_text", F.col("source_text")).withColumn("spoken_text", F.col("source_text"))
    k = F.col("job_id") % 5
    locks = c.select("job_id").distinct().select(
        "job_id", F.when(k == 2, "other@1").when(k == 0, "calculus@1").otherwise("").alias("domain_profile"),
        F.when(k == 3, "stale").when(k == 1, "now").alias("cue_set_checksum"), F.lit("now").alias("current_checksum"),
    )
    return rv.apply_review_lock(c, locks, _overrides(spark, sf), domain_profile="calculus@1")


@query("apply_tts_overrides", ("cues",), """
SELECT job_id, cue_id, CASE WHEN n%2=0 AND j THEN CASE WHEN n%6=0 THEN 'silence' ELSE 'edit' END END AS tts_manual_action,
 CASE WHEN n%2=0 AND j THEN CASE WHEN n%6=0 THEN '' ELSE 'new '||source_text END ELSE source_text END AS display_text,
 CASE WHEN n%2=0 AND j THEN CASE WHEN n%6=0 THEN '' ELSE 'say '||source_text END ELSE source_text END AS spoken_text FROM (SELECT *, sentence_no AS n, job_id%3=0 AS j FROM cues)""")
def apply_tts_overrides(spark, sf):
    c = table(spark, sf, "cues").withColumn("display_text", F.col("source_text")).withColumn("spoken_text", F.col("source_text"))
    o = c.where("sentence_no % 2 = 0 AND job_id % 3 = 0")
    old = o.select("job_id", "cue_id", F.lit("edit").alias("action"), F.lit("old").alias("display_text"), F.lit("old").alias("spoken_text"), F.lit(1).alias("updated_at"))
    quiet = F.col("sentence_no") % 6 == 0
    new = o.select(
        "job_id", "cue_id", F.when(quiet, "silence").otherwise("").alias("action"), F.when(~quiet, F.concat(F.lit("new "), "source_text")).alias("display_text"),
        F.when(~quiet, F.concat(F.lit("say "), "source_text")).alias("spoken_text"), F.lit(2).alias("updated_at"),
    )
    return rv.apply_tts_overrides(c, old.unionByName(new))


@query("review_timing_backfill", ("cues",), """
SELECT job_id, cue_id, start_ms, end_ms, CAST(row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, cue_id) AS BIGINT) AS review_rank FROM (
 SELECT job_id, cue_id, CASE WHEN sentence_no%3=0 THEN start_ms+5 ELSE start_ms END AS start_ms, end_ms FROM cues WHERE sentence_no%2=1
 UNION ALL SELECT job_id, 'cue_gone', 0, 0 FROM cues WHERE sentence_no=1)""")
def review_timing_backfill(spark, sf):
    c = table(spark, sf, "cues")
    none = F.lit(None).cast("long")
    r = c.where("sentence_no % 2 = 1").select(
        "job_id", "cue_id", F.when(F.col("sentence_no") % 3 == 0, F.col("start_ms") + 5).alias("start_ms"), none.alias("end_ms")
    )
    gone = c.where("sentence_no = 1").select("job_id", F.lit("cue_gone").alias("cue_id"), none.alias("start_ms"), none.alias("end_ms"))
    return rv.timing_backfill(r.unionByName(gone), c)


def _suggestions(spark, sf):
    s = table(spark, sf, "segments").where("job_id % 3 = 0")
    cand = s.select("job_id", "segment_id", F.concat("segment_id", F.lit(":doctor:1")).alias("candidate_id"))
    k = F.col("chunk_id") % 4
    got = s.select(
        "job_id", F.when(k == 3, F.lit("seg_none")).otherwise(F.col("segment_id")).alias("segment_id"),
        F.concat("segment_id", F.when(k == 2, F.lit(":doctor:9")).otherwise(F.lit(":doctor:1"))).alias("candidate_id"),
        F.lit("dr").alias("suggested_normalized"), F.lit(0.5).alias("confidence"),
    )
    return got, cand


@query("accepted_suggestions", ("segments",), """
SELECT job_id, segment_id, segment_id||':doctor:1' AS candidate_id, 'dr' AS suggested_normalized, 0.5::DOUBLE AS confidence FROM segments WHERE job_id%3=0 AND chunk_id%4<2""")
def accepted_suggestions(spark, sf):
    got, cand = _suggestions(spark, sf)
    return rv.accepted_suggestions(got, cand)


@query("attach_suggestions", ("segments",), """
SELECT job_id, segment_id, CASE WHEN job_id%3=0 AND chunk_id%4<2 THEN 1 ELSE 0 END AS n_suggestions,
 array_to_string(CASE WHEN job_id%3=0 AND chunk_id%4<2 THEN list_append(risk_flags,'source_normalization_llm_suggestion') ELSE risk_flags END,'|') AS risk_flags FROM segments""")
def attach_suggestions(spark, sf):
    got, cand = _suggestions(spark, sf)
    r = rv.attach_suggestions(table(spark, sf, "segments"), rv.accepted_suggestions(got, cand))
    n = F.coalesce(F.size("normalization_suggestions"), F.lit(0))
    return r.select("job_id", "segment_id", F.greatest(n, F.lit(0)).alias("n_suggestions"), F.array_join("risk_flags", "|").alias("risk_flags"))


@query("attached_suggestions", ("segments",), """
SELECT job_id, segment_id, segment_id||':doctor:1' AS candidate_id, 'dr' AS suggested_normalized, 0.5::DOUBLE AS confidence, source_text AS original, 'reads '||n_words::VARCHAR AS reason, 'calculus.dr' AS rule_id
FROM segments WHERE job_id%3=0 AND chunk_id%4<2""")
def attached_suggestions(spark, sf):
    """Whole records of the suggestions that segments carry."""
    got, cand = _suggestions(spark, sf)
    s = table(spark, sf, "segments")
    why = s.select("job_id", "segment_id", F.col("source_text").alias("original"), F.concat(F.lit("reads "), F.col("n_words").cast("string")).alias("reason"), F.lit("calculus.dr").alias("rule_id"))
    r = rv.attach_suggestions(s, rv.accepted_suggestions(got, cand).join(why, ["job_id", "segment_id"]))
    return r.select("job_id", "segment_id", F.inline("normalization_suggestions"))


@query("cue_projection_v2", ("cues",), """
SELECT job_id, cue_id, start_ms, end_ms, end_ms-start_ms AS duration_ms, source_text, source_text AS source_text_raw, CASE WHEN sentence_no%3=0 THEN 'said' ELSE source_text END AS display_text,
 'said' AS spoken_text, '' AS risk_flags FROM cues""")
def cue_projection_v2(spark, sf):
    c = table(spark, sf, "cues").select(
        "*", F.when(F.col("sentence_no") % 3 == 0, F.lit("")).otherwise(F.col("source_text")).alias("display_text"),
        F.lit(None).cast("string").alias("spoken_text"), F.lit("said").alias("translated_text"),
        F.lit(None).cast("string").alias("source_text_raw"), F.lit(None).cast("array<string>").alias("risk_flags"),
    )
    return rv.cue_projection_v2(c).withColumn("risk_flags", F.array_join("risk_flags", "|"))


cte("cue_runs", ("cues",), """
SELECT job_id, i//1024 AS run, sha256(string_agg(h, '' ORDER BY i)) AS h, count(*) AS n FROM (
 SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, cue_id)-1 AS i,
  sha256(to_json({'cue_id':cue_id,'end_ms':end_ms,'source_text':source_text,'start_ms':start_ms})::VARCHAR) AS h FROM cues) GROUP BY ALL""")


@query("cue_set_checksum", ("cue_runs",), """
SELECT job_id, CASE WHEN count(*)>1 THEN sha256(string_agg(h, '' ORDER BY run)) ELSE max(h) END AS cue_set_checksum, CAST(sum(n) AS BIGINT) AS cues FROM cue_runs GROUP BY job_id""")
def cue_set_checksum(spark, sf):
    return rv.cue_set_checksum(table(spark, sf, "cues"), ["cue_id", "start_ms", "end_ms", "source_text"])

