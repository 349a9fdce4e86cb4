"""Phrase collocations by suffix-sigma.

Texts are split into pieces and words. Every word of a piece begins a suffix, cut after
max_n words. Suffixes are counted in the map task, shuffled by language and first word
and sorted in reverse lexicographic order, so that one stack, which holds the open
prefixes of the current suffix with their counts, counts all prefixes: a prefix leaves
the stack, complete, where the next suffix differs from it. Phrases that are frequent
enough are joined with the counts of their parts afterwards.

A phrase is no more frequent than its words. So the words are counted first, and
suffixes are cut before words that are too rare, which a filter of bounded size tells
(`bits`); what it wrongly lets pass is dropped by its count. First words that hold more
than a quarter of a partition's share of all words, of which there are four times as many
as partitions at most, are split by a hash of the other words; the counts of their
prefixes are summed afterwards.

Defined results: null texts are empty, texts of null language belong to `und`. Words are
bytes without regard to Unicode case; only A-Z are lower-cased. Texts of any length are
read in windows that look ahead max_n - 1 words. Repeated rows count as often as they
occur; doc_id isn't read, so null and repeated ones don't matter, nor do other columns,
whatever their names. Scores are exact for counts up to 10^15. Ties are ordered by phrase.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textvec as tv
from tidemark.llm.bits import Filter, filter_of
from tidemark.llm.session import discard, lean, partitions, stored

MAX_N = 3
LEAST = 10
PERCENT = 50
TOP = 2000
#: Bytes of text whose suffixes are counted together in the map task.
SEGMENT = 4 << 20

# What ends a piece, [.,;:!?\x0A-\x0D], and what separates words, [\x20\x09].
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
SEPARATOR = BREAK.copy()
SEPARATOR[[0x20, 0x09]] = True


class Tokens:
    """Words of some texts: number of the row, number of the word in `words`, whether the next one follows in the same piece; `own`: those that are counted here."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, low: int, high: int, spans: tuple[np.ndarray, np.ndarray] | None = None):
        starts, ends = spans or tv.spans(data, offsets, SEPARATOR)
        self.row = np.searchsorted(offsets, starts, "right") - 1 + first
        self.own = (starts >= low) & (starts < high)
        breaks = np.concatenate([[0], np.cumsum(BREAK[data], dtype=np.int32)])
        self.followed = np.zeros(len(starts), bool)
        if len(starts):
            self.followed[:-1] = (breaks[starts[1:]] == breaks[ends[:-1]]) & (self.row[1:] == self.row[:-1])
        between = np.empty(2 * len(starts), np.int64)
        between[::2], between[1::2] = starts, ends
        runs = pa.LargeStringArray.from_buffers(max(0, len(between) - 1), pa.py_buffer(between if len(between) else np.zeros(1, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = runs.dictionary_encode()  # words, and what stands between them
        self.word = np.asarray(coded.indices, np.int64)[::2]
        self.words = coded.dictionary


def _long(data: np.ndarray, row: int, ahead: int, segment: int) -> Iterator[Tokens]:
    """A long text in windows that reach `ahead` whole words beyond those that are counted."""
    for at in range(0, len(data), segment):
        to, begin, look = min(len(data), at + segment), max(0, at - 1), max(16, segment >> 6)
        while True:
            stop = min(len(data), to + look)
            part = tv.lower_ascii(data[begin:stop])
            offsets = np.array([0, len(part)])
            starts, ends = tv.spans(part, offsets, SEPARATOR)
            if stop == len(data) or ((starts >= to - begin) & (ends < len(part))).sum() >= ahead:
                break
            look *= 4
        yield Tokens(part, offsets, row, at - begin, to - begin, (starts, ends))


def tokens(column: pa.Array, ahead: int, segment: int) -> Iterator[Tokens]:
    """The words of texts, those of about `segment` bytes at once, with `ahead` words more where a text goes on."""
    data, offsets = tv.buffers(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + segment, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        if len(part) > segment:
            yield from _long(part, at, ahead, segment)
        else:
            yield Tokens(tv.lower_ascii(part), offsets[at : to + 1] - offsets[at], at, 0, len(part))
        at = to
    tv.release()


def _hashes(words: pa.Array) -> np.ndarray:
    data, offsets = tv.buffers(words)
    out = np.zeros(len(words), np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    out[some] = tv.hash_spans(data, offsets[:-1][some], offsets[1:][some])
    return out


def _keys(langs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of words within languages, from the hashes of both."""
    return tv.mix(words + tv.mix(langs ^ np.uint64(0xA0761D6478BD642F)))


def _counted(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the first of equal rows, and how many are equal."""
    key, size = columns[0], int(columns[0].max(initial=0)).bit_length()
    for c in columns[1:]:
        more = int(c.max(initial=0)).bit_length()
        if size + more > 63:
            u, key = np.unique(key, return_inverse=True)
            size = len(u).bit_length()
        key, size = (key << more) | c, size + more
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return first, count


def _languages(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    coded = batch.column(0).dictionary_encode()
    return np.asarray(coded.indices, np.int64), coded.dictionary


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n, key of every word."""
    segment = SEGMENT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, names = _languages(batch)
            for t in tokens(batch.column(1), 1, segment):
                word, lang = t.word[t.own], langs[t.row[t.own]]
                first, n = _counted([lang, word])
                word, lang = word[first], lang[first]
                key = _keys(_hashes(names)[lang], _hashes(t.words)[word]) if len(word) else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)).cast(pa.string()), t.words.take(pa.array(word)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(key.view(np.int64))], names=["lang", "word", "n", "key"])

    parts = docs.mapInArrow(count, "lang string, word string, n long, key long")
    return parts.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def suffixes(docs: DataFrame, max_n: int, known: Filter) -> DataFrame:
    """lang, w1 to w<max_n> (null beyond the suffix's end), n: suffixes, counted in each map task, that begin with a word of the filter and end before the first that isn't of it."""
    names, segment = [f"w{i + 1}" for i in range(max_n)], SEGMENT

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, languages = _languages(batch)
            own_hash = _hashes(languages)
            for t in tokens(batch.column(1), max(1, max_n - 1), segment):
                lang = langs[t.row]
                frequent = known.has(_keys(own_hash[lang], _hashes(t.words)[t.word])) if len(lang) else np.empty(0, bool)
                at = np.flatnonzero(frequent & t.own)
                columns, on, here = [lang[at], t.word[at]], np.ones(len(at), bool), at
                for _ in range(max_n - 1):
                    on = on & t.followed[here]
                    here = np.minimum(here + 1, len(lang) - 1)
                    on = on & frequent[here]
                    columns.append(np.where(on, t.word[here] + 1, 0))
                first, n = _counted(columns)
                for a in range(0, len(first), 1 << 16):
                    rows = first[a : a + (1 << 16)]
                    words = [t.words.take(pa.array(columns[1][rows]))] + [t.words.take(pa.array(c[rows] - 1, mask=c[rows] == 0)) for c in columns[2:]]
                    yield pa.RecordBatch.from_arrays([languages.take(pa.array(columns[0][rows])).cast(pa.string()), *(w.cast(pa.string()) for w in words), pa.array(n[a : a + (1 << 16)], pa.int64())], names=["lang", *names, "n"])

    return docs.mapInArrow(cut, f"lang string, {', '.join(f'{w} string' for w in names)}, n long")


class Stack:
    """The open prefixes of the suffix read last, with their counts; rows come in batches."""

    def __init__(self, max_n: int):
        self.max_n = max_n
        self.words: list[str | None] = []  # lang and words of the suffix read last
        self.open = [0] * (max_n + 1)  # by number of words

    def read(self, columns: list[pa.Array], n: np.ndarray, hot: np.ndarray) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
        """Depth, words, counts and hotness of the prefixes that a batch closes. columns: lang and words."""
        rows = len(n)
        new = np.zeros(rows, bool)
        for depth, column in enumerate(columns):
            code = np.asarray(pc.fill_null(column.dictionary_encode().indices, -1))
            new[1:] |= code[1:] != code[:-1]
            new[0] |= not self.words or column[0].as_py() != self.words[depth]
            if not depth:
                continue
            begin = np.flatnonzero(new)
            sums = np.add.reduceat(n, np.append(0, begin[begin > 0]))
            if not new[0]:  # the first run goes on with what is open
                sums[0] += self.open[depth]
            elif self.words and self.words[depth] is not None:
                yield depth, [pa.array([w], pa.string()) for w in self.words[: depth + 1]], np.array([self.open[depth]]), np.array([self.hot])
            last = np.append(begin[begin > 0], rows) - 1  # the last rows of the runs
            closed = np.flatnonzero((code[last] >= 0) & (np.arange(len(last)) < len(last) - 1))
            take = pa.array(last[closed])
            yield depth, [c.take(take) for c in columns[: depth + 1]], sums[closed], hot[last[closed]]
            self.open[depth] = int(sums[-1])
        self.words, self.hot = [c[rows - 1].as_py() for c in columns], bool(hot[-1])

    def close(self) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
        for depth in range(1, self.max_n + 1):
            if self.words and self.words[depth] is not None:
                yield depth, [pa.array([w], pa.string()) for w in self.words[: depth + 1]], np.array([self.open[depth]]), np.array([self.hot])


def frequencies(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n): all phrases of up to max_n words that occur `least` times in their language; (lang, total): words of each language. Both are tables in the shared folder."""
    spark = lean(docs.sparkSession)
    parts = partitions(spark)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts = stored(word_counts(docs), "words")
    totals = stored(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    share = max(1, (totals.agg(F.sum("total")).first()[0] or 0) // (4 * parts))
    hot = counts.where(F.col("n") > share).select("lang", F.col("word").alias("w1"), F.ceil(F.col("n") / share).cast("int").alias("salts"))  # fewer than 4 rows a partition
    names = [f"w{i + 1}" for i in range(max_n)]
    known = filter_of(counts.where(F.col("n") >= least))
    rest = [*names[1:], F.lit(0)]
    dealt = suffixes(docs, max_n, known).join(F.broadcast(hot), ["lang", "w1"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*rest), "salts"), F.lit(-1)))
    order = [F.col(c).desc() for c in ("w1", "lang", *names[1:])]
    sorted_ = dealt.select("lang", *names, "n", "salt").repartition(parts, "lang", "w1", "salt").sortWithinPartitions(*order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(max_n)

        def rows(found) -> Iterator[pa.RecordBatch]:
            for depth, words, n, hot in found:
                partial = hot & (depth < max_n)
                keep = pa.array((n >= least) | partial)
                words = [w.filter(keep) for w in words]
                if len(words[0]):
                    phrase = pc.binary_join_element_wise(*words[1:], " ")
                    yield pa.RecordBatch.from_arrays([words[0], phrase, pa.array(np.full(len(phrase), depth, np.int32)), pa.array(n).filter(keep), pa.array(partial).filter(keep)], names=["lang", "phrase", "k", "n", "partial"])

        for batch in batches:
            if batch.num_rows:
                yield from rows(stack.read([batch.column(i) for i in range(max_n + 1)], np.asarray(batch.column(max_n + 1)), np.asarray(batch.column(max_n + 2)) >= 0))
        yield from rows(stack.close())

    raw = stored(sorted_.mapInArrow(count, "lang string, phrase string, k int, n long, partial boolean"), "prefixes")
    summed = raw.where("partial").groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = stored(raw.where("NOT partial").drop("partial").unionByName(summed), "phrases")
    discard(spark, raw)
    discard(spark, counts)
    return found, totals


def scored(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """lang, phrase, a, l, r, cut, score of the phrases of two words or more that no longer one takes in: those are left out whose words lie inside a longer phrase with at least `percent` % of their occurrences."""
    phrases = found.where("k > 1")
    cuts = phrases.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).select("lang", "phrase", F.col("n").alias("a"), "cut", F.expr("substring_index(phrase, ' ', cut)").alias("left"), F.expr("substring_index(phrase, ' ', cut - k)").alias("right"))
    left = found.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    right = found.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    with_parts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    # a * a * 1000000 has up to 37 digits for counts of 10^15
    score = F.expr("cast((cast(a AS decimal(15)) * cast(a AS decimal(15)) * cast(1000000 AS decimal(7))) div (cast(l AS decimal(18)) * cast(r AS decimal(18))) AS long)")
    best = with_parts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = found.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    free = best.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < percent * F.col("a")))
    return free.select("lang", "phrase", "a", "best.l", "best.r", "best.cut", "best.score")


def top(rows: DataFrame, most: int = TOP) -> DataFrame:
    """The first `most` of each language with their rank, by a tournament: within parts of a language, then parts of those left, then all of them."""
    parts = partitions(rows.sparkSession)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for n in (parts, isqrt(parts)):
        by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(max(1, n)))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).drop("rank")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, percent: int = PERCENT, most: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, cut of each language's best phrases of 2 to max_n words."""
    found, totals = frequencies(docs, max_n, least)
    ranked = top(scored(found, percent), most).join(totals, "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score", "cut")


def run(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cut")


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), split AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
    SELECT lang, k, list_aggregate(w[i : i + k - 1], 'string_agg', ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k)
), f AS (
    SELECT lang, k, phrase, count(*)::HUGEINT AS n FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10
), cuts AS (
    SELECT lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') AS part1, array_to_string(w[cut + 1 : k], ' ') AS part2
    FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
), rated AS (
    SELECT c.lang, c.phrase, c.a, l.n AS l, r.n AS r, (1000000 * c.a * c.a) // (l.n * r.n) AS score, row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000000 * c.a * c.a) // (l.n * r.n), cut) AS nth
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.part1 JOIN f r ON r.lang = c.lang AND r.phrase = c.part2
), longer AS (
    SELECT lang, part AS phrase, max(a) AS a
    FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS part FROM candidates WHERE k = 3) GROUP BY lang, part
), ranked AS (
    SELECT x.lang, x.phrase, x.a, x.l, x.r, x.score, row_number() OVER (PARTITION BY x.lang ORDER BY x.score DESC, x.a DESC, x.phrase) AS rank
    FROM rated x LEFT JOIN longer y ON y.lang = x.lang AND y.phrase = x.phrase WHERE nth = 1 AND (y.a IS NULL OR 100 * y.a < 50 * x.a)
)
SELECT r.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r.r::BIGINT AS r, t.n, score::BIGINT AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
