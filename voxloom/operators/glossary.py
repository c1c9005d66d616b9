"""Glossary terms: reading model answers, merging, seeding and applying terms."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions import rules
from voxloom.operators import phrases as ph
from voxloom.session import cut


def _blank(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def merge_glossary(terms: DataFrame, scope: list[str]) -> DataFrame:
    """One row per term and scope: protected first, then higher confidence, then earliest wins.

    ``locked`` is true if any copy was locked. Source segments and forbidden renderings stay in their
    own link tables (``glossary_links``), so a term found everywhere does not become one huge cell.
    """
    t = terms.withColumn("original", F.trim("original")).where("original <> ''")
    order = F.struct("protected", "confidence", (-F.col("pos")).alias("p"))
    pick = F.struct("term_id", "original", F.trim("vietnamese").alias("vietnamese"), "category", "confidence", "protected")
    m = t.groupBy(*scope, F.lower("original").alias("term_key")).agg(
        F.max_by(pick, order).alias("w"), F.bool_or("locked").alias("locked"), F.min("pos").alias("first_pos"),
        F.count("*").alias("copies"),
    )
    return m.select(*scope, "term_key", "w.*", "locked", "first_pos", "copies")


def glossary_links(terms: DataFrame, scope: list[str], column: str) -> DataFrame:
    """Distinct (scope, term_key, value) of an array column such as source_segments or forbidden."""
    t = terms.withColumn("original", F.trim("original")).where("original <> ''")
    return t.select(*scope, F.lower("original").alias("term_key"), F.explode(column).alias(column)).distinct()


def glossary_from_spans(spans: DataFrame, scope: list[str], order: list[str], *, full: bool = False) -> DataFrame:
    """First span per canonical form becomes a protected, locked term; ``full`` adds its spoken and displayed form and forbidden renderings."""
    own = ("spoken", "display", "forbidden") if full else ("spoken", "display")
    first = spans.groupBy(*scope, F.lower("canonical").alias("k")).agg(
        F.min_by(F.struct("canonical", "kind", "rule_id", *own), F.struct(*order)).alias("s")
    )
    safe = F.regexp_replace(F.regexp_replace(F.lower("s.canonical"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return first.select(
        *scope,
        F.concat(F.lit("protected_"), F.when(safe == "", "span").otherwise(safe)).alias("term_id"),
        F.col("s.canonical").alias("original"),
        F.col("s.spoken").alias("vietnamese"),
        F.col("s.kind").alias("category"),
        F.lit(True).alias("locked"),
        F.lit(True).alias("protected"),
        F.concat(F.lit("Domain protected span generated by "), F.col("s.rule_id"), F.lit(".")).alias("notes"),
        *([F.col(f"s.{c}").alias(c) for c in own] if full else []),
    )


def seed_terms(terms: DataFrame) -> DataFrame:
    """Add the domain's seed terms to every scope of ``terms`` rows (batch_id)."""
    seeds = F.array(
        *[
            F.struct(
                F.lit(o).alias("original"), F.lit(v).alias("vietnamese"), F.lit(c).alias("category"),
                F.lit(s).alias("spoken"), F.lit(d).alias("display"),
                F.array(*[F.lit(x) for x in rules.FORBIDDEN.get(o, ())]).cast("array<string>").alias("forbidden"),
            )
            for o, v, c, s, d in rules.GLOSSARY_SEEDS
        ]
    )
    return terms.select("batch_id").distinct().select("batch_id", F.inline(seeds))


def normalize_terms(raw: DataFrame, *, review: bool = False) -> DataFrame:
    """Raw JSON terms, a plain string or an object, as typed rows with defaults; blanks dropped.

    ``raw``: job_id, block_index, term_index, term (JSON text).
    """
    v = F.try_parse_json("term")
    is_text = F.schema_of_variant(v) == "STRING"
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))

    def field(name: str, kind: str = "string") -> Column:
        return F.try_variant_get(v, f"$.{name}", kind)

    fallback = F.format_string("term_%02d_%04d", "block_index", "term_index")
    original = F.trim(F.when(is_text, F.try_variant_get(v, "$", "string")).when(is_object, field("original")))
    return raw.select(
        "job_id",
        "block_index",
        "term_index",
        F.coalesce(F.when(is_object, field("term_id")), fallback).alias("term_id"),
        original.alias("original"),
        _blank(F.when(is_object, field("vietnamese"))).alias("vietnamese"),
        _blank(F.when(is_object, field("category")), "term").alias("category"),
        F.when(is_text, 0.5).otherwise(F.coalesce(F.when(is_object, field("confidence", "double")), F.lit(1.0))).alias("confidence"),
        F.lit(not review).alias("locked"),
    ).where("original <> ''")


_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{}]', re.S)
_JSON = json.JSONDecoder()


def first_json(text: str) -> str | None:
    """The JSON value that begins at the first bracket that begins any.

    Where a value fails, the brackets that it had opened and not closed by then fail at the same place and are not tried again.
    """
    dead: set[int] = set()
    for m in re.finditer(r"[\[{]", text):
        i = m.start()
        if i in dead:
            continue
        try:
            return text[i : _JSON.raw_decode(text, i)[1]]
        except json.JSONDecodeError as e:
            fails, still = e.pos, []
        except RecursionError:
            fails, still = len(text), []
        for mark in _MARKS.finditer(text, i, max(fails, i + 1)):
            if mark[0] in "[{":
                still.append(mark.start())
            elif mark[0] in "]}" and still:
                still.pop()
        dead.update(still)
    return None


@F.pandas_udf(T.StringType())
def _embedded(answers: pd.Series) -> pd.Series:
    return answers.map(lambda t: None if t is None else first_json(t))


def response_terms(responses: DataFrame) -> DataFrame:
    """Terms out of raw model answers: JSON, fenced JSON, JSON inside text, else bullet lines.

    ``responses``: job_id, block_index, content. Returns JSON term text per row with the way found.
    """
    c = F.trim("content")
    fenced = F.regexp_extract(c, r"(?s)^```[^\n]*\n(?:json)?\s*(.*?)\s*\n[^\n]*```$", 1)
    direct, inner = F.try_parse_json(c), F.try_parse_json(F.nullif(fenced, F.lit("")))
    embedded = F.coalesce(_embedded(F.when(direct.isNull() & inner.isNull() & F.rlike(c, F.lit(r"[\[{]")), c)), F.lit(""))
    parsed = F.coalesce(F.try_parse_json(c), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(embedded, F.lit(""))))
    way = (
        F.when(F.try_parse_json(c).isNotNull(), "json")
        .when(F.try_parse_json(F.nullif(fenced, F.lit(""))).isNotNull(), "fenced")
        .when(F.try_parse_json(F.nullif(embedded, F.lit(""))).isNotNull(), "embedded")
        .otherwise("bullets")
    )
    r = responses.select("job_id", "block_index", c.alias("content"), parsed.alias("v"), way.alias("way"))
    listed = F.coalesce(F.try_variant_get("v", "$.terms", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    found = r.where("way <> 'bullets'").select(
        "job_id", "block_index", "way", F.posexplode(F.transform(listed, lambda x: F.to_json(x))).alias("i", "term")
    )
    found = found.select("job_id", "block_index", (F.col("i") + 1).cast("long").alias("term_index"), "way", "term")
    # bullets: "* name: note" or "**name** note"
    lines = r.where("way = 'bullets'").select("job_id", "block_index", F.posexplode(F.split("content", r"\R")).alias("i", "l"))
    lines = lines.withColumn("l", F.trim("l"))
    bullet = F.rlike("l", F.lit(r"^[*-]"))
    body = F.trim(F.regexp_replace("l", r"^[-* ]+", ""))
    bold = F.regexp_extract("l", r"^(?:[*-] *)?\*\*(.+?)\*\*", 1)
    name = F.when(bold != "", F.regexp_replace(bold, "^[ :.-]+|[ :.-]+$", "")).when(
        bullet & F.contains(body, F.lit(":")), F.regexp_replace(F.substring_index(body, ":", 1), "^[ *`.-]+|[ *`.-]+$", "")
    )
    named = lines.withColumn("name", name).where("name <> '' AND length(name) <= 120")
    # lines of one answer, one cell
    named = named.groupBy("job_id", "block_index").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("n"))
    named = named.select("job_id", "block_index", F.posexplode("n").alias("k", "x")).select(
        "job_id", "block_index", (F.col("k") + 1).cast("long").alias("term_index"), F.lit("bullets").alias("way"),
        F.to_json(F.struct(F.col("x.name").alias("original"), F.lit(0.4).alias("confidence"))).alias("term"),
    )
    return found.unionByName(named)


#: Glossaries of up to so many terms may be broadcast; of larger ones each task hashes its own.
_FEW = 50_000


def applicable_terms(segments: DataFrame, terms: DataFrame, scope: list[str] | None = None, used: DataFrame | None = None) -> DataFrame:
    """(segment, term) pairs where the term occurs in the segment as a whole phrase, with the term's columns.

    Texts and terms are cut into pieces: words, and other characters one by one. A term applies where its pieces stand one after the other
    and no word goes on before or after them. Stretches of a text that may be a term are found where the text lies (``phrases``) and meet
    the terms by the whole phrase, so no word moves that begins or belongs to no term's phrase, and no text moves.

    A term of one character applies where it is listed as used, whatever the text: ``used`` is (*scope or job_id, segment_id, used_term).
    Case is that of ``lower``; blank terms apply nowhere; terms repeated in ``terms`` are terms of their own; segments without id have none.
    """
    scope = scope or []
    seg = ["job_id", "segment_id"]
    keys = [*seg, *[k for k in scope if k not in seg]]
    own = [c for c in terms.columns if c not in scope]
    t = terms.withColumn("_clean", F.trim("original")).where("_clean <> ''")
    t = cut(t.select(*scope, F.lower("_clean").alias("_key"), (F.length("_clean") > 1).alias("_long"), F.struct(*own).alias("_term")))
    long_ = t.where("_long").drop("_long")
    marks = ph.Marks(long_, "_key")
    texts = segments.dropna(subset=keys)
    found = ph.stretches(texts, keys, "source_text", marks)
    # rows of one id are one segment
    if texts.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").limit(1).count():
        found = found.distinct()
    pairs = found.join(long_ if marks.count <= _FEW else long_.hint("shuffle_hash"), [*scope, "_key"]).select(*keys, "_term")
    if used is not None:
        short = t.where("NOT _long").drop("_long")
        given = [k for k in keys if k in used.columns]
        listed = used.select(*given, F.lower(F.trim("used_term")).alias("_key")).distinct().join(segments.select(*keys).distinct(), given)
        pairs = pairs.unionByName(listed.join(short, [*scope, "_key"]).select(*keys, "_term"))
    return pairs.select(*keys, "_term.*")


def locked_terms_missing(
    segments: DataFrame, translations: DataFrame, terms: DataFrame, scope: list[str] | None = None, used: DataFrame | None = None
) -> DataFrame:
    """Locked terms of a segment whose rendering does not occur in its translation."""
    locked = terms.where("locked AND trim(original) <> '' AND trim(vietnamese) <> ''").select(
        *(scope or []), "term_id", "original", "vietnamese"
    )
    pairs = applicable_terms(segments, locked, scope, used).select("job_id", "segment_id", "term_id", "original", "vietnamese")
    p = pairs.join(translations.select("job_id", "segment_id", "vi_text"), ["job_id", "segment_id"])
    return p.where(~F.contains(F.lower("vi_text"), F.lower(F.trim("vietnamese")))).drop("vi_text", "vietnamese")
