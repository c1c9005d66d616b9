"""Phrases whose words occur together more often than apart, mined with an FM-index per shard of documents.

A scan task cuts its texts into pieces and words and writes a shard as one row: the words as numbers, 0 between pieces, and a row per
distinct word. Spark adds up the words of all shards; words below the least count become separators, as no candidate holds them.
Each shard then builds the Burrows-Wheeler transforms of its numbers and of their reverse. An n-gram is an interval in both: the words in
the first transform's interval are its left extensions, those in the second's its right extensions, each with its count, and either
extension gives the longer n-gram's interval in both. As n-grams have at most four words, rows are sorted by their first four words only.

Two rounds are enough. First every shard extends words to pairs, and Spark sums them. Then shards extend their pairs to the left, and
the three words found so to the right, dropping n-grams that hold a rarer pair, and Spark sums again. Which pairs reach the least count is
broadcast as hashed marks of a fixed size at most: where the marks are too few, shards send more n-grams that the sum then drops, and the
result is the same. Shards send counts, never texts, and a frequent word is one row per shard.

A candidate is dropped for a longer one that holds it and occurs nearly as often. It is enough to look at candidates longer by one word:
one between the two occurs at least as often as the longest.

Edge cases: null text counts as empty, null language as ``und``; texts without words add nothing; repeated rows count as often as they occur;
an empty table gives an empty result; equal scores and counts are ordered by the phrase's bytes; extra columns are not touched.
At most 2**31 different words may reach the least count (checked).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import in_slices, keep, mix, partitions, utf8

#: A task holds about a dozen numbers a word while it builds a shard's index.
SHARD_WORDS = 1_250_000
DEPTH = 4
#: 32 MB of marks at most.
MOST_BITS = 28
LEAST = 30
#: Per cent of a phrase's occurrences that a longer one must reach to replace it.
COVER = 80
UNIT = 2_000_000
UNKNOWN = "und"
#: Two word numbers stand in 64 bits; this one is no word's.
LOW = (1 << 32) - 1

INSIDE, BLANK, BREAK = range(3)
KIND = np.full(256, INSIDE, np.uint8)
KIND[[9, 32]] = BLANK
KIND[[*b".,;:!?", 10, 11, 12, 13]] = BREAK


# ---- shards


def cut_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: the words' bytes in lower case, their lengths, whether each begins a piece, and its text."""
    kind = KIND[raw]
    inside = kind == INSIDE
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([np.zeros(1, bool), inside])[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.append(inside, False)[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(kind == BREAK)])
    first = np.ones(len(starts), bool)
    first[1:] = (row[1:] != row[:-1]) | (breaks[starts[1:]] != breaks[starts[:-1]])
    data = raw[inside]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return data, ends - starts, first, row


def _shards(size: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["shard", "stream", "size", "code", "lang", "word", "n"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()]
        shard = TaskContext.get().partitionId() << 20

        def closed(parts: list) -> Iterator:
            data, lengths, first, lang = (np.concatenate([p[k] for p in parts]) for k in range(4))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            words = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())).dictionary_encode()
            wide = len(words.dictionary)
            kinds, number, counts = np.unique(lang * wide + np.asarray(words.indices).astype(np.int64), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            code = np.empty(len(order), np.int64)
            code[order] = np.arange(1, len(order) + 1)
            stream = np.zeros(len(number) + int(first.sum()) + 1, "<u4")
            stream[np.arange(len(number)) + np.cumsum(first)] = code[number]
            none = lambda k, n: pa.nulls(n, types[k])
            packed = pa.compress(stream.tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([shard], types[0]), pa.array([packed], types[1]), pa.array([len(stream)], types[2]), *[none(k, 1) for k in range(3, 7)]], names)
            n = len(kinds)
            where = pa.array(kinds // wide)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard), types[0]), none(1, n), none(2, n), pa.array(code, types[3]), pa.array(langs, types[4]).take(where),
                    words.dictionary.take(pa.array(kinds % wide)).cast(types[5]), pa.array(counts, types[6]),
                ],
                names,
            )

        parts, have, langs, known = [], 0, [], {}
        for batch in in_slices(batches, 1 << 20, 4 << 20):
            raw, offsets = utf8(batch.column(0))
            data, lengths, first, row = cut_words(raw, offsets)
            if not len(lengths):
                continue
            coded = batch.column(1).fill_null(UNKNOWN).dictionary_encode()
            for name in coded.dictionary.to_pylist():
                if name not in known:
                    known[name] = len(langs)
                    langs.append(name)
            local = np.array([known[name] for name in coded.dictionary.to_pylist()], np.int64)[np.asarray(coded.indices)]
            parts.append((data, lengths, first, local[row]))
            have += len(lengths)
            if have >= size:
                yield from closed(parts)
                shard, parts, have = shard + 1, [], 0
        if parts:
            yield from closed(parts)

    return run


# ---- the index of one shard


def order_of(key: np.ndarray, bound: int) -> np.ndarray:
    """Stable order of numbers below ``bound``."""
    bits = max(len(key), 1).bit_length()
    if bound << bits >= 1 << 63:
        return np.argsort(key, kind="stable")
    both = key << bits
    both |= np.arange(len(key))
    both.sort()
    both &= (1 << bits) - 1
    return both


def transform(t: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of numbers below ``width`` in the order of their first four, and the step from each row to the one that its number leads."""
    n = len(t)
    ahead = np.append(t[1:], 0)
    key = t * width + ahead
    order = order_of(key, width * width)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
    del key, ahead, order
    top = int(rank.max()) + 1
    both = rank * top
    both[: n - 2] += rank[2:]
    del rank
    bwt = t[order_of(both, top * top) - 1]
    del both
    step = np.empty(n, np.int64)
    step[order_of(bwt, width)] = np.arange(n)
    return bwt, step


def extend(low: np.ndarray, count: np.ndarray, other: np.ndarray, bwt: np.ndarray, step: np.ndarray, width: int):
    """All one-word extensions of intervals: owner, word, count, interval in this index and in the other. Separators extend nothing."""
    begin = np.cumsum(count) - count
    rows = np.arange(int(count.sum())) + np.repeat(low - begin, count)
    owner = np.repeat(np.arange(len(low)), count)
    key = owner * width + bwt[rows]
    order = order_of(key, max(len(low), 1) * width)
    key = key[order]
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    size = np.diff(heads, append=len(key))
    owner, word = key[heads] // width, key[heads] % width
    real = word > 0
    heads, size, owner, word = heads[real], size[real], owner[real], word[real]
    # rows of smaller words stand before a word's own in the other index
    return owner, word, size, step[rows[order[heads]]], other[owner] + heads - begin[owner]


class Index:
    """Both transforms of a shard whose words are numbered in the order of their global numbers."""

    def __init__(self, stream: bytes, size: int, codes: np.ndarray, numbers: np.ndarray):
        import pyarrow as pa

        raw = np.frombuffer(pa.decompress(stream, decompressed_size=4 * size, codec="zstd", asbytes=True), "<u4")
        order = np.argsort(numbers)
        self.numbers = np.concatenate([[-1], numbers[order]])
        self.width = len(self.numbers)
        local = np.zeros(int(raw.max(initial=0)) + 1, np.int64)
        local[codes[order]] = np.arange(1, self.width)
        t = local[raw]
        # neighbouring separators say no more than one
        t = t[np.append(True, (t[1:] != 0) | (t[:-1] != 0))]
        self.bwt, self.step = transform(t, self.width)
        self.t = t
        counts = np.bincount(t, minlength=self.width)
        self.low, self.count = (np.cumsum(counts) - counts)[1:], counts[1:]

    def pairs(self):
        """Of every pair of words: first and second word, count, interval in the index and in the reverse one."""
        owner, word, count, low, other = extend(self.low, self.count, self.low, self.bwt, self.step, self.width)
        return word, owner + 1, count, low, other

    def longer(self, known: np.ndarray):
        """Three and four words, without those that hold a pair that is not known (first * width + second): words in columns, and counts."""
        first, second, count, low, other = self.pairs()
        here = np.isin(first * self.width + second, known)
        first, second, count, low, other = (x[here] for x in (first, second, count, low, other))
        is_known = lambda a, b: np.isin(a * self.width + b, known)
        owner, word, n, at, back = extend(low, count, other, self.bwt, self.step, self.width)
        good = is_known(word, first[owner])
        owner, word, n, at, back = (x[good] for x in (owner, word, n, at, back))
        three = np.stack([word, first[owner], second[owner]], 1)
        del self.bwt, self.step, first, low, other
        bwt, step = transform(self.t[::-1].copy(), self.width)
        owner, word, m, _, _ = extend(back, n, at, bwt, step, self.width)
        good = is_known(three[owner, 2], word)
        owner, word, m = owner[good], word[good], m[good]
        return three, n, np.concatenate([three[owner], word[:, None]], 1), m


def _index(left, right) -> Index | None:
    words = right.filter(right.column("code").is_valid()).combine_chunks() if right.num_rows else right
    if not left.num_rows or not words.num_rows:
        return None
    return Index(left.column("stream")[0].as_py(), left.column("size")[0].as_py(), words.column("code").to_numpy(), words.column("number").to_numpy())


def _pairs(left, right):
    import pyarrow as pa

    index = _index(left, right)
    if index is None:
        a = b = n = np.zeros(0, np.int64)
    else:
        a, b, n, _, _ = index.pairs()
        a, b = index.numbers[a], index.numbers[b]
    return pa.table([pa.array((a << 32) | b), pa.array(n)], ["pair", "n"])


def place(pairs: np.ndarray, bits: int) -> np.ndarray:
    """Where pairs are marked among 2 ** ``bits`` marks."""
    return (mix(pairs.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def marked(pairs: DataFrame):
    """Marks of all pairs (``pair``) as a broadcast: eight bytes of marks for each few pairs, up to 2 ** ``MOST_BITS`` bits for any table.

    A pair that is not marked is not among them; one that is marked may be another's.
    """
    bits = max(15, min(MOST_BITS, (16 * max(pairs.count(), 1)).bit_length()))

    def positions(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = place(batch.column("pair").to_numpy(), bits)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 15).astype(np.int32)), pa.array((at & 0x7FFF).astype(np.int32))], ["block", "bit"])

    def block(table):
        import pyarrow as pa

        marks = np.zeros(1 << 15, bool)
        marks[table.column("bit").to_numpy()] = True
        return pa.table([table.column("block")[:1], pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], ["block", "marks"])

    found = pairs.select("pair").mapInArrow(positions, "block int, bit int").distinct()
    out = np.zeros((1 << (bits - 15), 1 << 12), np.uint8)
    for r in found.groupBy("block").applyInArrow(block, "block int, marks binary").collect():  # one row per 2**15 marks, a fixed number at most
        out[r["block"]] = np.frombuffer(r["marks"], np.uint8)
    return pairs.sparkSession.sparkContext.broadcast((bits, out.ravel()))


def _longer(marks):
    def run(left, right):
        import pyarrow as pa

        index = _index(left, right)
        x = y = counts = np.zeros(0, np.int64)
        if index is not None:
            bits, flat = marks.value
            a, b, _, _, _ = index.pairs()
            at = place((index.numbers[a] << 32) | index.numbers[b], bits)
            often = (flat[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            three, n, four, m = index.longer(np.sort((a * index.width + b)[often]))
            three, four = index.numbers[three], index.numbers[four]
            x = np.concatenate([three[:, 0] << 32 | three[:, 1], four[:, 0] << 32 | four[:, 1]])
            y = np.concatenate([three[:, 2] << 32 | LOW, four[:, 2] << 32 | four[:, 3]])
            counts = np.concatenate([n, m])
        return pa.table([pa.array(x), pa.array(y), pa.array(counts)], ["x", "y", "n"])

    return run


# ---- all shards


def counted(df: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(``g``, ``f``) of all n-grams of one to four words that occur ``least`` times or more, the words' numbers, and all words per language.

    ``g`` is an array of word numbers; the words are (``number``, ``lang``, ``word``).
    """
    shards = df.select(F.col(text_col), F.col(lang_col).cast("string"))
    shards = keep(shards.mapInArrow(_shards(shard_words), "shard long, stream binary, size long, code int, lang string, word string, n long"))
    streams, local = shards.where("stream IS NOT NULL").select("shard", "stream", "size"), shards.where("code IS NOT NULL")
    totals = local.groupBy("lang").agg(F.sum("n").alias("total"))

    # a word is named by its least (shard, code), whose row stands for it: one row per shard and word moves once
    same = Window.partitionBy("lang", "word")
    local = local.withColumn("f", F.sum("n").over(same)).withColumn("name", F.min(F.struct("shard", "code")).over(same)).where(F.col("f") >= least)
    local = keep(local.withColumn("id", F.monotonically_increasing_id()))
    words = local.where((F.col("shard") == F.col("name.shard")) & (F.col("code") == F.col("name.code")))
    part = F.shiftright("id", 33)
    words = keep(words.withColumn("place", F.row_number().over(Window.partitionBy(part).orderBy("id")) - 1).withColumn("part", part))
    sizes = words.groupBy("part").agg(F.count(F.lit(1)).alias("m"))  # one row per task
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("base"))
    if words.count() >= LOW >> 1:
        raise ValueError("more than 2**31 words reach the least count")
    words = keep(words.join(F.broadcast(sizes), "part").select("name", "lang", "word", "f", (F.col("base") + F.col("place")).alias("number")))
    mine = keep(local.select("shard", "code", "name").join(words.select("name", "number"), "name").select("shard", "code", "number"))
    words = words.drop("name")

    left = streams.groupBy("shard")
    pairs = left.cogroup(mine.groupBy("shard")).applyInArrow(_pairs, "pair long, n long")
    pairs = keep(pairs.groupBy("pair").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    longer = left.cogroup(mine.groupBy("shard")).applyInArrow(_longer(marked(pairs)), "x long, y long, n long")
    high, low = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(LOW))
    longer = longer.groupBy("x", "y").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    three = F.array(high("x"), low("x"), high("y"))
    longer = longer.select(F.when(low("y") == LOW, three).otherwise(F.concat(three, F.array(low("y")))).alias("g"), "f")
    two = pairs.select(F.array(high("pair"), low("pair")).alias("g"), "f")
    one = words.select(F.array("number").alias("g"), "f")
    return keep(one.unionByName(two).unionByName(longer)), words, totals


def phrases(
    df: DataFrame, least: int = LEAST, cover: int = COVER, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS
) -> tuple[DataFrame, DataFrame]:
    """Candidates that stay (``g``, ``a``, ``l``, ``r``, ``score``, ``left_most``, ``right_most``, ``lang``, ``n``) and the words' numbers.

    ``left_most`` and ``right_most`` count the most frequent candidate that is longer by one word to the left and to the right (0 if none).
    """
    grams, words, totals = counted(df, least, text_col, lang_col, shard_words)
    size = F.size("g")
    many = grams.where(size > 1)
    # the least-scoring cut
    cuts = many.select("g", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("x", F.slice("g", F.lit(1), F.col("k"))).withColumn("y", F.slice("g", F.col("k") + 1, size - F.col("k")))
    left, right = grams.select(F.col("g").alias("x"), F.col("f").alias("l")), grams.select(F.col("g").alias("y"), F.col("f").alias("r"))
    cuts = cuts.join(left, "x").join(right, "y")
    score = F.expr(f"(cast(a as decimal(19,0)) * {UNIT}) div (cast(l as decimal(19,0)) + r)")
    best = cuts.groupBy("g").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    # one word more on either side
    longer = many.where(size > 2)
    inner = longer.select(F.slice("g", F.lit(2), size - 1).alias("g"), F.col("f").alias("le"), F.lit(0).cast("long").alias("ri"))
    inner = inner.unionByName(longer.select(F.slice("g", F.lit(1), size - 1).alias("g"), F.lit(0).cast("long").alias("le"), F.col("f").alias("ri")))
    inner = inner.groupBy("g").agg(F.max("le").alias("left_most"), F.max("ri").alias("right_most"))
    kept = best.join(inner, "g", "left").na.fill(0, ["left_most", "right_most"])
    kept = kept.where(100 * F.greatest("left_most", "right_most") < cover * F.col("a"))
    kept = kept.join(words.select(F.col("number").alias("_first"), "lang"), F.col("g")[0] == F.col("_first")).join(totals.withColumnRenamed("total", "n"), "lang")
    return kept.select("g", "a", "best.l", "best.r", "best.score", "left_most", "right_most", "lang", "n"), words


def top(df: DataFrame, most: int = 2000, **options) -> DataFrame:
    """Each language's first ``most`` phrases by score, then count, then bytes."""
    kept, words = phrases(df, **options)
    kept = keep(kept)
    order = [F.col("score").desc(), F.col("a").desc()]
    salt = F.pmod(F.xxhash64("g"), F.lit(max(64, partitions(df.sparkSession))))
    # what is not among the first of its part is not among the first of all; ties stay for now
    near = kept.withColumn("salt", salt).withColumn("place", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= most)
    near = keep(near.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= most).drop("salt", "place"))
    spelled = near.select("g", F.posexplode("g").alias("i", "number")).join(words.select("number", "word"), "number")
    spelled = spelled.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    done = near.join(spelled, "g").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return done.where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "left_most", "right_most")


def sql(least: int = LEAST, cover: int = COVER, most: int = 2000) -> str:
    """The same by counting all n-grams."""
    nexts = ", ".join(f"lead(w, {k}) OVER p AS w{k}" for k in range(1, DEPTH))
    grams = " UNION ALL ".join(
        "SELECT lang, " + " || ' ' || ".join(["w", *[f"w{j}" for j in range(1, k)]]) + f" AS g, {k} AS m, count(*) AS f FROM t WHERE " + (f"w{k - 1} IS NOT NULL" if k > 1 else "true") + " GROUP BY 1, 2"
        for k in range(1, DEPTH + 1)
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
p AS (SELECT rid, lang, unnest(s) AS piece, generate_subscripts(s, 1) AS pn FROM (SELECT rid, lang, string_split_regex(x, '[.,;:!?\x0A-\x0D]') AS s FROM d)),
w AS (SELECT rid, lang, pn, unnest(s) AS w, generate_subscripts(s, 1) AS i FROM (SELECT rid, lang, pn, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda e: e <> '') AS s FROM p)),
t AS (SELECT lang, w, {nexts} FROM w WINDOW p AS (PARTITION BY rid, pn ORDER BY i)),
g AS ({grams}),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, g, m, f, string_split(g, ' ') AS s FROM g WHERE f >= {least} AND m > 1),
k AS (SELECT lang, g, f, s, m, unnest(range(1, m)) AS k FROM c),
q AS (SELECT k.lang, k.g, k.f AS a, k.k, x.f AS l, y.f AS r, CAST(CAST(k.f AS HUGEINT) * {UNIT} // (x.f + y.f) AS BIGINT) AS score FROM k
  JOIN g x ON x.lang = k.lang AND x.m = k.k AND x.g = array_to_string(k.s[1:k.k], ' ') JOIN g y ON y.lang = k.lang AND y.m = k.m - k.k AND y.g = array_to_string(k.s[k.k + 1:], ' ')),
b AS (SELECT lang, g, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM q GROUP BY lang, g, a),
le AS (SELECT lang, array_to_string(s[2:], ' ') AS g, max(f) AS f FROM c WHERE m > 2 GROUP BY 1, 2),
ri AS (SELECT lang, array_to_string(s[1:m - 1], ' ') AS g, max(f) AS f FROM c WHERE m > 2 GROUP BY 1, 2),
z AS (SELECT b.*, coalesce(le.f, 0) AS left_most, coalesce(ri.f, 0) AS right_most FROM b LEFT JOIN le USING (lang, g) LEFT JOIN ri USING (lang, g)),
v AS (SELECT s.lang, s.g, bool_or(100 * o.f >= {cover} * s.f) AS covered FROM c s JOIN c o ON s.lang = o.lang AND o.m > s.m AND contains(' ' || o.g || ' ', ' ' || s.g || ' ') GROUP BY 1, 2),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score, left_most, right_most
  FROM z JOIN n USING (lang) LEFT JOIN v USING (lang, g) WHERE NOT coalesce(covered, false))
SELECT * FROM r WHERE rank <= {most}
"""
