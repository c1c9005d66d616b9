"""Column expressions on text. All JVM-side except ``nfc_casefold``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions import rules

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def squeeze(c: Column | str) -> Column:
    """Collapse runs of blanks to one and trim."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column | str) -> Column:
    """Blank-separated tokens; empty array for blank text."""
    return F.filter(F.split(F.regexp_replace(c, r"\s+", " "), " "), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    return F.size(tokens(c)).cast("long")


def ends_with_any(c: Column, endings: tuple[str, ...]) -> Column:
    cond = F.lit(False)
    for e in endings:
        cond = cond | F.endswith(c, F.lit(e))
    return cond


def bare_token(c: Column | str) -> Column:
    """Lower-cased token without leading and trailing non-word characters."""
    return F.regexp_replace(F.lower(c), f"^{NOT_WORD}+|{NOT_WORD}+$", "")


def comparison_token(c: Column | str) -> Column:
    """Lower-cased token with every non-word character removed."""
    return F.regexp_replace(F.lower(c), f"{NOT_WORD}+", "")


def cue_token(c: Column | str) -> Column:
    """Lower-cased token without surrounding quotes, brackets and sentence marks; π spelled pi."""
    marks = r"[\"'“”‘’()\[\]{}.,!?;:]"
    return F.replace(F.regexp_replace(F.lower(F.trim(c)), f"^{marks}+|{marks}+$", ""), F.lit("π"), F.lit("pi"))


def join_tokens(c: Column) -> Column:
    """Join an array of tokens with blanks, none before ``,.;:!?``."""
    kept = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    return F.regexp_replace(F.array_join(kept, " "), r"\s+([,.;:!?])", "$1")


def split_sentences(c: Column | str, *, cjk: bool = False) -> Column:
    """Split after sentence marks followed by blanks."""
    marks = "[.!?。！？]" if cjk else "[.!?]"
    parts = F.split(F.trim(c), rf"(?<={marks})\s+")
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.trim(c)))


def term_applies(text: Column, term: Column, used_terms: Column | None = None) -> Column:
    """Whether a glossary term occurs as a whole phrase; one-character terms only if listed as used."""
    clean = F.trim(term)
    quoted = F.concat(F.lit(r"\Q"), F.replace(clean, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(rf"(?iu)(?<!{WORD})"), quoted, F.lit(rf"(?!{WORD})"))
    listed = F.lit(False)
    if used_terms is not None:
        listed = F.coalesce(
            F.array_contains(F.transform(used_terms, lambda x: F.lower(F.trim(x))), F.lower(clean)), F.lit(False)
        )
    return F.when(clean == "", False).when(F.length(clean) == 1, listed).otherwise(F.rlike(text, pattern))


def length_ratio_scaled(source: Column, target: Column) -> Column:
    """Trimmed target length over trimmed source length, in ten-thousandths (integer, truncated)."""
    return F.floor(F.length(F.trim(target)) * 10000 / F.greatest(F.lit(1), F.length(F.trim(source)))).cast("long")


def wrap_text(c: Column, max_chars: int = 48) -> Column:
    """Greedy line wrap; words longer than the line stay whole."""
    width = max(8, int(max_chars))

    def step(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = F.length(last) + 1 + F.length(word) <= width
        return (
            F.when(F.size(lines) == 0, F.array(word))
            .when(fits, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), word))))
            .otherwise(F.concat(lines, F.array(word)))
        )

    lines = F.aggregate(tokens(c), F.array().cast("array<string>"), step)
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.trim(c)))


def subtitle_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for old, new in (("{", "("), ("}", ")"), ("\n", " ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def foreign_scripts(c: Column) -> Column:
    """Sorted names of non-Latin scripts present in the text."""
    hits = [F.when(F.rlike(c, F.lit(p)), F.lit(name)) for name, p in rules.SCRIPTS]
    return F.array_sort(F.filter(F.array(*hits), lambda x: x.isNotNull()))


def compress_fillers(c: Column) -> Column:
    out = c
    for phrase in rules.FILLERS:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return squeeze(out)


def squared_words(c: Column) -> Column:
    for mark, word in (("²", "bình phương"), ("³", "lập phương")):
        c = F.regexp_replace(c, rf"([A-Za-zÀ-ỹ]){mark}", f"$1 {word}")
    return c


def normalize_spoken(c: Column, spans: Column | None = None) -> Column:
    """Replace notation by its spoken form, longest notation first, then letter pairs and powers.

    ``spans`` is an optional array of structs (canonical, spoken, display).
    """
    fixed = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in rules.SPOKEN])
    pairs = fixed
    if spans is not None:
        own = F.flatten(
            F.transform(
                spans,
                lambda s: F.array(
                    F.struct(s["display"].alias("old"), s["spoken"].alias("new")),
                    F.struct(s["canonical"].alias("old"), s["spoken"].alias("new")),
                ),
            )
        )
        own = F.filter(own, lambda p: (p["old"] != "") & (p["new"] != "") & (p["old"] != p["new"]))
        pairs = F.concat(F.coalesce(own, F.array().cast("array<struct<old:string,new:string>>")), fixed)
    ordered = F.transform(
        F.array_sort(
            F.transform(pairs, lambda p, i: F.struct((-F.length(p["old"])).alias("n"), i.alias("i"), p.alias("p")))
        ),
        lambda x: x["p"],
    )
    text = F.aggregate(
        ordered,
        c,
        lambda acc, p: F.regexp_replace(acc, F.concat(F.lit(r"(?iu)\Q"), p["old"], F.lit(r"\E")), p["new"]),
    )
    for pair in rules.DIFFERENTIALS:
        text = F.regexp_replace(text, rf"(?i){rules.NO_LETTER_BEFORE}{pair}{rules.NO_LETTER_AFTER}", f"d {pair[1]}")
    return squeeze(squared_words(text))


@F.pandas_udf(T.StringType())
def nfc_casefold(texts: pd.Series) -> pd.Series:
    """Canonical composition and full case folding; Spark has neither."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold())


def match_spans(c: Column, pattern: str) -> Column:
    """All matches of a pattern as structs (m, start, end) with 0-based code-point offsets.

    Text between matches and the matches themselves alternate, so offsets are running lengths.
    """
    found = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    pairs = F.zip_with(F.split(c, pattern, -1), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    pairs = F.filter(pairs, lambda p: p["m"].isNotNull())
    empty = F.array().cast("array<struct<m:string,start:int,end:int>>")

    def step(acc: Column, p: Column) -> Column:
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + F.length(p["gap"])
        return F.concat(acc, F.array(F.struct(p["m"].alias("m"), at.alias("start"), (at + F.length(p["m"])).alias("end"))))

    return F.aggregate(pairs, empty, step)


SPAN_TYPE = (
    "array<struct<start_char:int,neg_len:int,rule:int,end_char:int,rule_id:string,kind:string,source_text:string,"
    "canonical:string,spoken:string,display:string,forbidden:array<string>>>"
)

#: Columns of a rule table. ``{1}`` and ``{2}`` in the three forms stand for the pattern's groups; ``forbidden`` may be null.
RULE_SCHEMA = "priority int, rule_id string, pattern string, canonical string, spoken string, display string, kind string, forbidden array<string>"
#: A rule table is settings, not data: each rule is an expression of the plan, so a larger table is refused.
MAX_RULES = 256


def rule_table(spark) -> DataFrame:
    """The built-in notation rules as a rule table."""
    rows = [(n, *r, list(rules.FORBIDDEN.get(r[2], ()))) for n, r in enumerate(rules.SPAN_RULES)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def read_rules(table: DataFrame | None) -> list[tuple]:
    """(rule_id, pattern, canonical, spoken, display, kind, forbidden) of a rule table in its order; the built-in ones for None.

    Rules without a pattern, and ones that match the empty text, cannot mark anything and are refused, as are repeated ids.
    """
    if table is None:
        return [(*r, rules.FORBIDDEN.get(r[2], ())) for r in rules.SPAN_RULES]
    empty = F.coalesce(F.col("pattern"), F.lit("")) == ""
    head = table.withColumn("_blank", empty | F.rlike(F.lit(""), F.when(empty, "x").otherwise(F.col("pattern"))))
    found = head.orderBy("priority", "rule_id").limit(MAX_RULES + 1).collect()
    if len(found) > MAX_RULES:
        raise ValueError(f"a rule table has at most {MAX_RULES} rules")
    if len({r["rule_id"] for r in found}) < len(found):
        raise ValueError("rule ids must differ")
    bad = [r["rule_id"] for r in found if r["_blank"]]
    if bad:
        raise ValueError(f"rules that match the empty text: {bad}")
    return [tuple(r[c] or "" for c in ("rule_id", "pattern", "canonical", "spoken", "display", "kind")) + (tuple(r["forbidden"] or ()),) for r in found]


def _span_struct(n: int, rule: tuple[str, ...]):
    rule_id, pattern, canonical, spoken, display, kind, forbidden = rule
    bare = pattern.replace(rules.NO_LETTER_BEFORE, "").replace(rules.NO_LETTER_AFTER, "")

    def fill(template: str, m: Column) -> Column:
        out = F.lit(template)
        for g in (1, 2):
            if f"{{{g}}}" in template:
                out = F.replace(out, F.lit(f"{{{g}}}"), F.regexp_extract(m, bare, g))
        return out

    def build(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start_char"), (s["start"] - s["end"]).alias("neg_len"), F.lit(n).alias("rule"),
            s["end"].alias("end_char"), F.lit(rule_id).alias("rule_id"), F.lit(kind).alias("kind"),
            s["m"].alias("source_text"), fill(canonical, s["m"]).alias("canonical"),
            fill(spoken, s["m"]).alias("spoken"), fill(display, s["m"]).alias("display"),
            F.array(*[F.lit(x) for x in forbidden]).cast("array<string>").alias("forbidden"),
        )

    return build


def protected_spans(c: Column, found_rules: list[tuple] | None = None) -> Column:
    """Notation spans by the rules; overlaps go to the earlier, then longer, then first rule.

    One search for any rule's pattern decides whether a text is looked at rule by rule, so texts without notation are read once.
    """
    table = read_rules(None) if found_rules is None else found_rules
    none = F.array().cast(SPAN_TYPE)
    if not table:
        return none
    any_rule = "|".join(f"(?:{r[1]})" for r in table)
    parts = [F.transform(match_spans(c, r[1]), _span_struct(n, r)).cast(SPAN_TYPE) for n, r in enumerate(table)]
    ordered = F.when(F.rlike(c, F.lit(any_rule)), F.array_sort(F.concat(*parts))).otherwise(none)

    def keep(acc: Column, s: Column) -> Column:
        taken = F.coalesce(F.try_element_at(acc, F.lit(-1))["end_char"], F.lit(0))
        return F.when(s["start_char"] >= taken, F.concat(acc, F.array(s))).otherwise(acc)

    return F.aggregate(ordered, F.array().cast(SPAN_TYPE), keep)


def spell_notation(c: Column) -> Column:
    """Tokens of case-folded text with notation spelled out and marks dropped."""
    t = c
    for old, new in (("½", " một phần hai "), ("×", " nhân "), ("/", " trên ")):
        t = F.replace(t, F.lit(old), F.lit(new))
    for mark, word in (("²", "bình phương"), ("³", "lập phương")):
        t = F.regexp_replace(t, rf"([a-zà-ỹ]){mark}", f"$1 {word}")
        t = F.regexp_replace(t, rf"((?U)\d+){mark}", f"$1 {word}")
    t = F.regexp_replace(t, r"(?U)(\d+)m\b", "$1 m")
    return tokens(F.regexp_replace(t, r"[\p{P}\p{S}]", " "))


def semantic_tokens(toks: Column) -> Column:
    """Digits, letter pairs and common mishearings unified, looking at the tokens on either side."""

    def words(*xs: str) -> Column:
        return F.array(*[F.lit(x) for x in xs])

    def digit(d: Column) -> Column:
        out = F.when(d == "0", rules.DIGIT_WORDS[0])
        for i in range(1, 10):
            out = out.when(d == str(i), rules.DIGIT_WORDS[i])
        return out.otherwise(d)

    def one(tok: Column, i: Column) -> Column:
        prev = F.coalesce(F.get(toks, i - 1), F.lit(""))
        nxt = F.coalesce(F.get(toks, i + 1), F.lit(""))
        num = F.regexp_extract(tok, r"^(\d+)", 1)
        out = (
            F.when((tok == "sắp") & (nxt == "xỉ"), words("xấp"))
            .when(F.rlike(tok, F.lit(r"^\d+pr$")), F.concat(F.array(digit(num)), words("pi", "r")))
            .when(F.rlike(tok, F.lit(r"^\d+p$")), F.concat(F.array(digit(num)), words("pi")))
            .when(tok == "pr", words("pi", "r"))
            .when(tok.isin("drx", "trx"), words("d", "r", "ít"))
            .when(
                (tok == "x") & F.rlike(prev, F.lit(rules.FACTOR_TOKEN)) & F.rlike(nxt, F.lit(rules.FACTOR_TOKEN)),
                words("nhân"),
            )
            .when(F.rlike(tok, F.lit(r"^\d+$")), F.array(digit(tok)))
        )
        for alias, repl in rules.TOKEN_ALIASES.items():
            out = out.when(tok == alias, words(*repl))
        return out.otherwise(F.array(tok))

    return F.flatten(F.transform(toks, one))
