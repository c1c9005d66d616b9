"""Main text of web pages: a suffix array over each host's text, and marked-up structure.

A page is cut into blocks of text. All blocks of every page go to the suffix array of its host, be they menus, footers, adverts, text of
a marked main part or of a page that marks none. Every stretch of at least ``RUN`` tokens of a block that other pages of the host
have there too is repeated, and so is a shorter whole block on ``SHORT_PAGES`` pages of the host; their number is given per page. Structure says
what this decides: blocks in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go by their
element, class, id or role, repeated or not; blocks of a marked article or main part stay, as a passage that several articles share is text,
however often it repeats. All others are in doubt: the text of pages whose main part is not marked or has no text, and blocks in elements whose
name only may mean boilerplate (``entry-header``). What is repeated in doubt is removed from them and the runs between stay. What menus,
adverts and marked main parts say too is no evidence against a text, as teasers do.

The array: a task sorts the suffixes of a slice of pages by their first ``RUN`` tokens and keeps of equal beginnings as many as tell on how many
pages they are; Spark deals these sorted runs out by ranges of (host, suffix) and sorts each range, where neighbours are compared. A host is in
as many ranges as it needs. Suffixes in which fewer than ``RUN`` tokens of their block are left begin no repeat and are left out, as is
all order beyond ``RUN`` tokens: a longer repeat is covered by the suffixes that begin in it. Pages with the same token stream of text are copies and
count as one page, as do rows of one id: a stretch is repeated if it is in two different token streams and under two different ids.

Edge cases: null or empty html gives an empty text; unclosed tags, comments and quotes end with the page; a null url is a host of its
own; rows without id count as one page for repetition; an empty table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import in_slices, keep, mix, powers, utf8, words

RUN = 8
#: Whole blocks shorter than RUN tokens are boilerplate from so many pages on.
SHORT_PAGES = 3

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# rules of this operator
GONE_TAGS = frozenset("head nav footer aside form button select dialog menu svg canvas object audio video fieldset".split()) | RAW
GONE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
GONE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices"
    " alert alerts popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars"
    " widget widgets footer header masthead toolbar share sharing social related recommended recommendations comment comments commentlist disqus reply replies"
    " respond pagination pager skip".split()
)
LAYOUT = re.compile(r"(?:no|not|has|have|with|without|is|hide|show)[-_]")
SOCIAL_PARTS = frozenset("link links icon icons button buttons bar box list block area media menu nav wrap wrapper container inner post page site top bottom left right".split())
#: Words that also name parts of an article: with another word beside them in a name, repetition decides.
DOUBTFUL = frozenset("header social share notice notices alert alerts promotion subscription".split())
NAMED = frozenset("div section ul ol dl p span table li figure a details article aside center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# what becomes of an element's text
STAYS, IN_DOUBT, GOES = range(3)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if "=" in text else {}


def _verdict(tag: str, attributes: str, in_main: bool) -> int:
    """Whether an element and all in it are main text, as far as its tag and names tell."""
    if tag in GONE_TAGS or tag == "header" and not in_main:
        return GOES
    if not attributes or tag not in NAMED:
        return STAYS
    got = _attributes(attributes)
    # "no-sidebar", "has-sidebar" say how the page is laid out, not what the element is
    said = [t for t in f"{got.get('class', '')} {got.get('id', '')}".lower().split() if not LAYOUT.match(t)]
    if tag == "article":
        # of an article only a name by itself counts, and any that speaks of comments
        names = {"comment" if t.startswith("comment") else t for t in said}
        names -= {"header", "footer", "banner", "promo", "promoted", "sponsored", "social", "share", "notice", "notices"}
    else:
        names = {w for t in said for w in re.split(r"[^a-z0-9]+", t)}
        if names & GONE_NAMES == {"social"} and names - {"social", ""} - SOCIAL_PARTS:
            names = set()  # a subject, such as social science
    style = got.get("style", "").replace(" ", "").lower()
    if got.get("role", "").lower() in GONE_ROLES or "display:none" in style or got.get("aria-hidden") == "true":
        return GOES
    if not names & GONE_NAMES:
        return STAYS
    doubtful = tag in BLOCK and names & GONE_NAMES <= DOUBTFUL and names - DOUBTFUL - SOCIAL_PARTS - {""} and not GONE_NAMES.intersection(said)
    return IN_DOUBT if doubtful else GOES


def parts(page: str) -> list[tuple[str, int, bool]]:
    """Blocks of text in page order, each with what structure says of it and whether it lies in a marked main part."""
    found: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # element, verdict, main
    held: list[str] = []
    dropped: list[str] = []
    at = 0

    def flush() -> None:
        verdict, main = stack[-1][1:] if stack else (STAYS, False)
        verdict = STAYS if verdict == GOES else verdict  # what is held was said before an inline element that goes
        for texts, says, inside in ((held, verdict, main), (dropped, GOES, False)):
            text = " ".join(html.unescape("".join(texts)).split()) if texts else ""
            if text:
                found.append((text, says, inside))
            texts.clear()

    while at < len(page):
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        verdict, main = stack[-1][1:] if stack else (STAYS, False)
        if text:
            (dropped if verdict == GOES or main and stack[-1][0] == "header" else held).append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        attributes = (m[3] or m[6] or "").strip()
        if tag in BLOCK:
            flush()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break  # an inline end tag closes nothing outside its block
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK and stack:
            # an open paragraph, with the inline elements left open in it, ends where a block begins
            k = max((i for i in range(len(stack)) if stack[i][0] in BLOCK), default=-1)
            if k >= 0 and stack[k][0] == "p":
                del stack[k:]
                verdict, main = stack[-1][1:] if stack else (STAYS, False)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if (tag == "main" or 'role="main"' in attributes.lower()) and not any(s[0] in GONE_TAGS for s in stack):
            verdict = STAYS  # what holds the main part is no sidebar, whatever its name
        verdict = max(verdict, _verdict(tag, attributes, main))
        is_main = tag in ("article", "main") or "articlebody" in attributes.lower() or 'role="main"' in attributes.lower()
        stack.append((tag, verdict, verdict != GOES and (main or is_main)))
    flush()
    return found


def blocks(page: str) -> tuple[list[str], bool]:
    """Blocks that stay by structure alone, in page order, and whether the page marks its main part (then they are that part's)."""
    found = [(t, inside) for t, verdict, inside in parts(page) if verdict == STAYS]
    main = [t for t, inside in found if inside]
    return (main, True) if main else ([t for t, _ in found], False)


def beginnings(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow column of lists of blocks: the hashed tokens that begin every suffix of ``RUN`` tokens or more within a block and every
    whole shorter block (a row each, zeros after a short block's end), the tokens each row has, its page and block in the batch and its first
    token's place in the block."""
    flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    page = np.repeat(np.arange(len(sizes)), sizes)
    _, _, row, hashes = words(*utf8(flat))
    n_tokens = np.bincount(row, minlength=len(page))
    first = np.cumsum(n_tokens) - n_tokens
    place = np.arange(len(row)) - first[row]
    at = np.flatnonzero((place == 0) | (place + RUN <= n_tokens[row]))
    block = row[at]
    size = np.minimum(n_tokens[block], RUN)
    ends = at[:, None] + np.arange(RUN)
    inside = np.arange(RUN) < size[:, None]
    return np.where(inside, hashes[np.where(inside, ends, 0)] if len(hashes) else 0, 0).astype(np.uint64), size, page[block], block, place[at]


def _judged(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Beginnings in the blocks that structure decides on and in those in doubt (the last two columns): tokens, sizes, pages, and which are in doubt."""
    tokens, size, page = zip(*(beginnings(c)[:3] for c in batch.columns[-2:]), strict=True)
    return np.concatenate(tokens), np.concatenate(size), np.concatenate(page), np.repeat([False, True], [len(size[0]), len(size[1])])


def names(tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit number for each beginning; two different ones collide with a chance of about 2**-64."""
    with np.errstate(over="ignore"):
        return mix((tokens * powers(RUN + 1)[1:]).sum(1, dtype=np.uint64) + mix(size.astype(np.uint64))).view(np.int64)


def _new(equal: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows by class and value, and which of them in that order are the first of their class and value."""
    order = np.lexsort((values, equal))
    e, v = equal[order], values[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (v[1:] != v[:-1])
    return order, new


def _few(equal: np.ndarray, stream: np.ndarray, page: np.ndarray, doubt: np.ndarray) -> np.ndarray:
    """Of rows numbered by class, those that show up to ``SHORT_PAGES`` different streams and pages of each class, in doubt and not."""
    stays = np.zeros(len(equal), bool)
    equal = 2 * equal + doubt
    for values in (stream, page):
        order, new = _new(equal, values)
        e, seen = equal[order], np.cumsum(new)
        stays[order[new & (seen - seen[np.searchsorted(e, e)] < SHORT_PAGES)]] = True
    return stays


def _suffixes(batches: Iterator) -> Iterator:
    """Sorted runs of suffixes of pages (host, stream, page, blocks decided on, blocks in doubt): equal ones only as often as it takes to tell how many pages have them."""
    for batch in in_slices(batches, 4_096, 1 << 20):
        tokens, size, at, doubt = _judged(batch)
        if not len(at):
            continue
        host, stream, page = (batch.column(c).to_numpy()[at] for c in range(3))
        order = np.lexsort((size, *tokens.T[::-1], host))
        tokens, size, host, stream, page, doubt = tokens[order], size[order], host[order], stream[order], page[order], doubt[order]
        new = np.ones(len(order), bool)
        new[1:] = (host[1:] != host[:-1]) | (size[1:] != size[:-1]) | (tokens[1:] != tokens[:-1]).any(1)
        few = np.flatnonzero(_few(np.cumsum(new), stream, page, doubt))
        # 32 bits a token are enough where there are RUN of them; a shorter block has 64 and an end
        text = np.zeros((len(few), 8 * RUN), np.uint8)
        whole = size[few] == RUN
        text[whole, : 4 * RUN] = (tokens[few][whole] >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4 * RUN)
        text[~whole] = tokens[few][~whole].astype(">u8").view(np.uint8).reshape(-1, 8 * RUN)
        length = np.where(whole, 4 * RUN, 8 * size[few] + 1)
        text = text[np.arange(8 * RUN) < length[:, None]].tobytes()
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        suffix = pa.Array.from_buffers(pa.binary(), len(few), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
        columns = [pa.array(host[few]), suffix, pa.array(names(tokens[few], size[few])), pa.array(stream[few]), pa.array(page[few]), pa.array(doubt[few])]
        yield pa.RecordBatch.from_arrays(columns, ["_host", "suffix", "key", "stream", "_page", "in_doubt"])


def _shared(batches: Iterator) -> Iterator:
    """Host and key of the beginnings on enough pages, and whether they are in doubt on enough, from a range of the array in its order. Equal
    neighbours are one class; the last class of a batch waits for the next batch, thinned out."""

    def found(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table]:
        host, suffix, stream, page, doubt = (t.column(c).to_numpy() for c in ("_host", "suffix", "stream", "_page", "in_doubt"))
        new = np.ones(len(t), bool)
        new[1:] = (host[1:] != host[:-1]) | (suffix[1:] != suffix[:-1])
        start, equal = np.flatnonzero(new), np.cumsum(new) - 1
        least = np.array([2 if len(suffix[k]) == 4 * RUN else SHORT_PAGES for k in start])
        enough = []
        for rows in (np.arange(len(t)), np.flatnonzero(doubt)):
            n = np.full(len(start), len(t))
            for values in (stream, page):
                order, first = _new(equal[rows], values[rows])
                n = np.minimum(n, np.bincount(equal[rows][order[first]], minlength=len(start)))
            enough.append(n >= least)
        hit = np.flatnonzero(enough[0][: None if last else -1])
        got = t.take(pa.array(start[hit])).select(["_host", "key"]).combine_chunks()
        left = start[-1] + np.flatnonzero(_few(equal[start[-1] :], stream[start[-1] :], page[start[-1] :], doubt[start[-1] :]))
        columns = [*(pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in got.columns), pa.array(enough[1][hit])]
        return pa.RecordBatch.from_arrays(columns, ["_host", "key", "of_text"]), t.take(pa.array(left))

    waits = None
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch])
            out, waits = found(t if waits is None else pa.concat_tables([waits, t]), False)
            yield out
    if waits is not None:
        yield found(waits, True)[0]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _parse(batches: Iterator) -> Iterator:
    """Per page its text or, if repeats decide on some of it, the blocks that may stay with the verdict on each; the blocks that
    structure decides on, those of a marked main part among them, and those in doubt; digests of its layout and of its token stream."""
    types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64()]
    for batch in in_slices(batches, 1 << 20):
        rows = []
        for page in batch.column(2).to_pylist():
            found = parts(page or "")
            marked = any(inside and says == STAYS for _, says, inside in found)
            # beside a marked main part nothing is text, without one all is in doubt that does not go
            found = [(t, (says if inside else GOES) if marked else max(says, IN_DOUBT)) for t, says, inside in found]
            left = [(t, says) for t, says in found if says != GOES]
            doubt = any(says == IN_DOUBT for _, says in left)
            rows.append((
                None if doubt else "\n".join(t for t, _ in left), [t for t, _ in left] if doubt else None, [says for _, says in left] if doubt else None,
                [t for t, says in found if says != IN_DOUBT], [t for t, says in found if says == IN_DOUBT], _digest("\n".join(f"{says} {t}" for t, says in found)), _digest(" ".join(t for t, _ in left)),
            ))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["_id", "url", "text", "blocks", "verdicts", "decided", "in_doubt", "layout", "stream"])


def _keys(batches: Iterator) -> Iterator:
    """Different beginnings of each page (host, row, blocks decided on, blocks in doubt)."""
    for batch in in_slices(batches):
        tokens, size, page, _ = _judged(batch)
        if len(page):
            at, keys = np.unique(np.stack([page, names(tokens, size)]), axis=1)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[:2]), pa.array(keys)], ["_host", "_row", "key"])


@F.arrow_udf(T.StringType())
def _cut(blocks: pa.Array, verdicts: pa.Array, hits: pa.Array) -> pa.Array:
    """Texts of pages (lists of blocks) without what repeated beginnings cover of the blocks in doubt; null without blocks."""
    texts = []
    for batch in in_slices([pa.RecordBatch.from_arrays([blocks, verdicts, hits], ["blocks", "verdicts", "hits"])]):
        lists = batch.column(0)
        tokens, size, page, block, place = beginnings(lists)
        keys, ends, hit = names(tokens, size), np.searchsorted(page, np.arange(batch.num_rows + 1)), batch.column(2)
        gone: dict[int, set[int]] = {}
        for k in range(batch.num_rows):
            if hit[k].is_valid:
                for i in ends[k] + np.flatnonzero(np.isin(keys[ends[k] : ends[k + 1]], hit[k].values.to_numpy())):
                    gone.setdefault(int(block[i]), set()).update(range(place[i], place[i] + size[i]))
        at = 0
        for got, says in zip(lists.to_pylist(), batch.column(1).to_pylist(), strict=True):
            kept = []
            for b, verdict in zip(got or (), says or (), strict=True):
                kept.append(" ".join(w for i, w in enumerate(b.split()) if i not in gone[at]) if verdict == IN_DOUBT and at in gone else b)
                at += 1
            texts.append(None if got is None else "\n".join(filter(None, kept)))
    return pa.array(texts, pa.string())


def shared(pages: DataFrame) -> DataFrame:
    """Host and key of the beginnings that the host's pages (``_host``, ``stream``, ``_page``, ``decided``, ``in_doubt``) share, and whether they
    share them in doubt (``of_text``): a suffix array dealt out by ranges."""
    runs = pages.mapInArrow(_suffixes, "_host long, suffix binary, key long, stream long, _page long, in_doubt boolean")
    array = runs.repartitionByRange("_host", "suffix").sortWithinPartitions("_host", "suffix")
    return array.mapInArrow(_shared, "_host long, key long, of_text boolean")


def page_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text``, the main text's blocks joined by line ends (empty if there is none), and ``n_repeats``, how many
    different beginnings of the page's blocks are repeated on its host."""
    slim = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), html_col)
    ident = slim.schema["_id"].dataType
    more = T._parse_datatype_string("text string, blocks array<string>, verdicts array<tinyint>, decided array<string>, in_doubt array<string>, layout long, stream long").fields
    parsed = slim.mapInArrow(_parse, T.StructType([T.StructField("_id", ident), T.StructField("url", T.StringType()), *more]))
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    # rows of one number are alike in all but rare cases, where one is looked at for the other's repeats too
    parsed = parsed.withColumns({"_host": F.xxhash64(host), "_row": F.xxhash64(host, "_id", "layout")})
    # pages are parsed twice: once for the array and once when texts meet what it found
    known = keep(parsed.select("_host", "stream", F.xxhash64("_id").alias("_page"), "decided", "in_doubt", "_row"))
    found = known.select("_host", "_row", "decided", "in_doubt").mapInArrow(_keys, "_host long, _row long, key long")
    found = found.join(shared(known.drop("_row")), ["_host", "key"])
    key = F.col("key")
    hits = found.groupBy("_row").agg(F.collect_set(key).alias("repeats"), F.collect_set(F.when(F.col("of_text"), key)).alias("hits"))
    hits = hits.select("_row", "hits", F.size("repeats").cast("long").alias("n"))
    out = parsed.select("_id", "url", "text", "blocks", "verdicts", "_row").join(hits, "_row", "left")
    text = F.coalesce("text", _cut("blocks", "verdicts", "hits"))
    return out.select(F.col("_id").alias(id_col), F.col("url").alias(url_col), text.alias("text"), F.coalesce("n", F.lit(0)).cast("long").alias("n_repeats"))
