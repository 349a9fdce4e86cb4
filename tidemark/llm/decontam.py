"""Benchmark decontamination: a BM25 index of test items, queried by every passage.

The test items are the indexed side. Impacts (BM25 weights) are divided by what the
item scores against itself, so one threshold holds for all items, and posting lists
are cut into blocks of BLOCK items with the largest impact of each block. Every
document is cut into units of UNIT words; a passage is WIDTH neighbouring units, and
every passage is a query. Items of more than (WIDTH - 1) * UNIT words have units of
twice that length, of more than twice as many words of four times, and so on (levels), so
some passage holds the whole of any copied item. The postings of a passage's terms give
block-max bounds of those blocks that it meets at all: the frequent terms whose block
maxima together stay below SLACK of the threshold only count by that sum (so a block
that no other term meets can't reach it), the others add their block maxima. Blocks that
can still reach the threshold are searched by WAND, which returns every item at or above
it. A hit counts once the question and the answer of the item both overlap with the text
around the passage (share of word 3-grams; of a question or answer of fewer words,
whether the text has that run of words).

The index is small by construction: items are dealt over as many passes as it takes
to keep each one's text below INDEX_BYTES, and each pass goes over all documents. How many
items there are, their mean length and how many have a term is counted over all items, so
scores don't depend on the passes. The driver sends a pass's items and its terms'
frequencies on and keeps none; each Python worker builds the index, once a pass.

Defined results: documents or items without words (null, empty) match nothing; two
equal items are both reported, and so are all rows that repeat a document; no items, no
hits. Ties: of passages in which an item scores the same the first counts. A very long
text is searched run by run of its units and takes some 100 bytes for each word. Of
documents `hits` reads doc_id and text only, `clean` passes all columns through untouched;
of the benchmark item_id and text are read.
Question and answer of an item: before and after its last question mark or
`answer:` (a word that goes on behind the mark belongs to both), else its first two
thirds of words and the rest.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textvec as tv
from tidemark.llm.session import lean

UNIT, WIDTH, BLOCK = 32, 3, 2
THRESHOLD = 0.6
SLACK = 0.5
OVERLAP = 0.5
K1, BETA = 1.2, 0.75
INDEX_BYTES = 8 << 20
CELLS = 1 << 20
_CUT = re.compile(r"(?is)^(.*(?:\?|\banswer\s*:))\s*(\S.*)$")


def _words(text: str | None) -> np.ndarray:
    return tv.words(pa.array([text or ""]))[0]


def parts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of question and answer."""
    m = _CUT.match(text)
    w = _words(text)
    if m:
        at = len(_words(m[1]))
        return w[:at], w[at if text[m.end(1)] in " \t\n\v\f\r" else at - 1 :]
    at = max(1, len(w) * 2 // 3)
    return w[:at], w[at:]


def overlap(part: np.ndarray, around: np.ndarray) -> float:
    """Share of a part's word 3-grams, or of its one shorter run, that the text has; 1 of an empty part."""
    if not len(part):
        return 1.0
    width = min(3, len(part))
    return float(np.isin(tv.shingles(part, width), tv.shingles(around, width), assume_unique=True).mean())


def levels_of(lengths: np.ndarray) -> np.ndarray:
    """How often UNIT is doubled for items of these lengths, so that WIDTH - 1 units hold them."""
    units = -(-lengths.astype(np.int64) // ((WIDTH - 1) * UNIT))
    return np.array([max(0, int(n) - 1).bit_length() for n in units], np.int64)


class Level:
    """Blocks of the items of one level, numbered from `first`: block maxima as runs of (term, block), and the frequent terms' bounds."""

    def __init__(self, unit: int, first: int, blocks: int, terms: int, run_term: np.ndarray, run_block: np.ndarray, run_max: np.ndarray, most: float):
        self.unit, self.first, self.blocks = unit, first, blocks
        self.run_block, self.run_max = run_block - first, run_max
        self.run_begin = np.searchsorted(run_term, np.arange(terms + 1))
        # Frequent terms whose maxima together stay below `most` in every block.
        self.rest = np.zeros(blocks)
        self.heavy = np.ones(terms, bool)
        for t in np.argsort(-np.diff(self.run_begin), kind="stable"):
            more = self.rest.copy()
            s = slice(self.run_begin[t], self.run_begin[t + 1])
            more[self.run_block[s]] += self.run_max[s]
            if more.max() > most:
                break
            self.rest = more
            self.heavy[t] = False


class Statistics:
    """Of all items with words: how many there are, their mean length, and how many have each term (of a pass's terms, ascending)."""

    def __init__(self, items: int, length: float, terms: np.ndarray, frequency: np.ndarray):
        self.items, self.length, self.terms, self.frequency = items, length, terms, frequency

    def of(self, terms: np.ndarray) -> np.ndarray:
        return self.frequency[np.searchsorted(self.terms, terms)]


class Index:
    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, all_items: Statistics | None = None):
        """all_items: statistics of all items, if these are a part of them."""
        own = [(i, t, w) for i, t in items if len(w := _words(t))]
        level = levels_of(np.array([len(w) for _, _, w in own]))
        order = np.argsort(level, kind="stable")
        own, level = [own[i] for i in order], level[order]
        self.ids = np.array([i for i, _, _ in own], np.int64)
        self.threshold = threshold
        self.questions, self.answers = zip(*(parts(t) for _, t, _ in own), strict=True) if own else ((), ())
        n = len(own)
        lengths = np.array([len(w) for _, _, w in own], float)
        self.terms, flat = np.unique(np.concatenate([w for _, _, w in own]) if own else np.empty(0, np.uint64), return_inverse=True)
        item = np.repeat(np.arange(n), lengths.astype(int))
        pairs, tf = np.unique(flat.astype(np.int64) * max(n, 1) + item, return_counts=True)
        self.post_term, self.post_item = pairs // max(n, 1), pairs % max(n, 1)
        known = all_items or Statistics(n, lengths.mean() if n else 1, self.terms, np.bincount(self.post_term, minlength=len(self.terms)))
        df = known.of(self.terms) if n else np.empty(0)
        idf = np.log1p((known.items - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - BETA + BETA * lengths / max(known.length, 1))
        weight = idf[self.post_term] * tf * (K1 + 1) / (tf + norm[self.post_item])
        self.impact = weight / np.maximum(np.bincount(self.post_item, weight, n)[self.post_item], 1e-12)
        self.begin = np.searchsorted(self.post_term, np.arange(len(self.terms) + 1))
        # Blocks hold items of one level only.
        steps, start, count = np.unique(level, return_index=True, return_counts=True)
        blocks = -(-count // BLOCK)
        first = np.cumsum(blocks) - blocks
        k = np.searchsorted(steps, level)
        self.block = first[k] + (np.arange(n) - start[k]) // BLOCK
        self.blocks = int(blocks.sum())
        key = self.post_term * max(self.blocks, 1) + self.block[self.post_item]
        order = np.argsort(key, kind="stable")
        runs, begin = np.unique(key[order], return_index=True)
        run_max = np.maximum.reduceat(self.impact[order], begin) if len(begin) else np.empty(0)
        run_term, run_block = runs // max(self.blocks, 1), runs % max(self.blocks, 1)
        self.levels = []
        for step, f, m in zip(steps.tolist(), first.tolist(), blocks.tolist(), strict=True):
            mine = (run_block >= f) & (run_block < f + m)
            self.levels.append(Level(UNIT << step, f, m, len(self.terms), run_term[mine], run_block[mine], run_max[mine], SLACK * threshold))

    def term_ids(self, h: np.ndarray) -> np.ndarray:
        """Number of each word's term, or -1."""
        if not len(self.terms):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def wand(self, terms: np.ndarray, blocks: set[int]) -> list[tuple[int, float]]:
        """(item, score) of all items in these blocks that the distinct terms score at or above the threshold."""
        # Postings of these terms within these blocks, and each list's own largest impact there.
        n = self.begin[terms + 1] - self.begin[terms]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[terms], n)
        at = at[np.isin(self.block[self.post_item[at]], list(blocks))]
        cut = np.flatnonzero(np.diff(self.post_term[at])) + 1
        lists = [(float(self.impact[x].max()), self.post_item[x].tolist(), self.impact[x].tolist()) for x in np.split(at, cut) if len(x)]
        heap = [(items[0], k, 0) for k, (_, items, _) in enumerate(lists)]
        heapq.heapify(heap)
        out = []
        while heap:
            # The lists in order of their next item; the pivot is where the sum of bounds reaches the threshold.
            order, bound, pivot = sorted(heap), 0.0, None
            for item, k, _ in order:
                bound += lists[k][0]
                if bound >= self.threshold - 1e-9:
                    pivot = item
                    break
            if pivot is None:
                break
            score, heap = 0.0, []
            for item, k, at in order:
                _, items, impacts = lists[k]
                while at < len(items) and items[at] < pivot:
                    at += 1
                if at < len(items) and items[at] == pivot:
                    score += impacts[at]
                    at += 1
                if at < len(items):
                    heap.append((items[at], k, at))
            if score >= self.threshold - 1e-9:
                out.append((pivot, score))
        return out

    def search(self, h: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(row, item_id, score, question overlap, answer overlap) of each verified hit; row i has words h[bounds[i]:bounds[i+1]]."""
        if not len(self.ids) or not len(h):
            return []
        term = self.term_ids(h)
        out: dict[tuple[int, int], tuple[int, int, float, float, float]] = {}
        for level in self.levels:
            self._search(level, h, bounds, term, out)
        return sorted(out.values())

    def _search(self, level: Level, h: np.ndarray, bounds: np.ndarray, term: np.ndarray, out: dict[tuple[int, int], tuple[int, int, float, float, float]]) -> None:
        """Adds the verified hits on items of one level."""
        rows = len(bounds) - 1
        counts = np.diff(bounds)
        units = -(-counts // level.unit)
        base = np.concatenate([[0], np.cumsum(units)])
        row = np.repeat(np.arange(rows), counts)
        unit = base[row] + (np.arange(len(h)) - bounds[row]) // level.unit
        owner = np.repeat(np.arange(rows), units)
        on = np.flatnonzero(term >= 0)
        on = on[level.heavy[term[on]]]
        distinct = np.unique(unit[on] * np.int64(len(self.terms)) + term[on])
        unit, t = distinct // len(self.terms), distinct % len(self.terms)
        reps = level.run_begin[t + 1] - level.run_begin[t]
        done = np.cumsum(reps)
        start = high = 0
        while start < len(unit):
            # Passages that begin at units `low` to `high`, with the postings of their units: CELLS of them, or those of one passage.
            low = max(high, int(unit[start]) - WIDTH + 1)
            stop = int(np.searchsorted(done, (done[start] - reps[start]) + CELLS, "right"))
            high = max(int(unit[stop]) - WIDTH + 1, low + 1) if stop < len(unit) else int(base[-1])
            stop = int(np.searchsorted(unit, high + WIDTH - 1))
            if stop > start:
                found = self._blocks(level, low, high, owner, unit[start:stop], t[start:stop], reps[start:stop])
                for p, blocks in found:
                    self._verify(level, p, blocks, h, bounds, base, owner, term, out)
            start = int(np.searchsorted(unit, high))

    def _blocks(self, level: Level, low: int, high: int, owner: np.ndarray, unit: np.ndarray, t: np.ndarray, reps: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(passage, its blocks whose bound reaches the threshold); a passage begins at each unit and takes WIDTH units of the same row."""
        at = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(level.run_begin[t], reps)
        cell, value = np.repeat(unit, reps) * np.int64(level.blocks) + level.run_block[at], level.run_max[at]
        cell, inverse = np.unique(cell, return_inverse=True)
        value = np.bincount(inverse, value, len(cell))
        unit, block = cell // level.blocks, cell % level.blocks
        keys, values = [], []
        for j in range(WIDTH):
            p = unit - j
            ok = (p >= low) & (p < high)
            ok[ok] = owner[p[ok]] == owner[unit[ok]]
            keys.append(p[ok] * np.int64(level.blocks) + block[ok])
            values.append(value[ok])
        keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        bound = np.bincount(inverse, np.concatenate(values), len(keys))
        keys = keys[bound + level.rest[keys % level.blocks] >= self.threshold - 1e-9]
        return [(int(own[0] // level.blocks), own % level.blocks) for own in np.split(keys, np.flatnonzero(np.diff(keys // level.blocks)) + 1) if len(own)]

    def _verify(self, level: Level, p: int, blocks: np.ndarray, h: np.ndarray, bounds: np.ndarray, base: np.ndarray, owner: np.ndarray, term: np.ndarray, out: dict) -> None:
        """Searches these blocks for a passage and adds its verified hits."""
        length = WIDTH * level.unit
        r = int(owner[p])
        lo = int(bounds[r] + (p - base[r]) * level.unit)
        hi = int(min(bounds[r + 1], lo + length))
        mine = np.unique(term[lo:hi])
        for item, score in self.wand(mine[mine >= 0], set((level.first + blocks).tolist())):
            if (r, item) in out and out[r, item][2] >= score:
                continue
            around = h[max(bounds[r], lo - length) : min(bounds[r + 1], hi + length)]
            q, a = overlap(self.questions[item], around), overlap(self.answers[item], around)
            if q >= OVERLAP and a >= OVERLAP:
                out[r, item] = (r, int(self.ids[item]), score, q, a)


_built: dict[str, Index] = {}


class Pass:
    """The items of one pass, on their way to the workers; the index is built where it is first asked for."""

    def __init__(self, spark, items: list[tuple[int, str]], threshold: float, all_items: Statistics):
        self.name, self.threshold = uuid.uuid4().hex, threshold
        self.items = spark.sparkContext.broadcast((items, all_items))  # INDEX_BYTES of text at most, and its terms

    def index(self) -> Index:
        if self.name not in _built:
            _built.clear()
            items, all_items = self.items.value
            _built[self.name] = Index(items, self.threshold, all_items)
        return _built[self.name]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different terms of each item (pass, text), and a row without a term that has its number of words."""
    for batch in batches:
        for part in tv.slices(batch):
            h, bounds = tv.words(part.column(1))
            size = np.diff(bounds)
            row = np.repeat(np.arange(part.num_rows), size)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            row = row[new]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(h[new].view(np.int64)), pa.array(np.ones(len(row), np.int64))], names=["pass", "term", "words"])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.nulls(part.num_rows, pa.int64()), pa.array(size)], names=["pass", "term", "words"])


def passes(benchmark: DataFrame, threshold: float = THRESHOLD) -> Iterator[Pass]:
    """The items of a pass hold about INDEX_BYTES of text."""
    lean(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / INDEX_BYTES))
    dealt = items.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).cast("int"))
    terms = dealt.select("pass", "text").mapInArrow(_terms, "pass int, term long, words long")
    items_, words = terms.where("term IS NULL").agg(F.count_if(F.col("words") > 0), F.coalesce(F.sum("words"), F.lit(0))).first()
    have = terms.where("term IS NOT NULL")
    frequency = have.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    for k in range(count):
        own = frequency.join(have.where(F.col("pass") == k).select("term"), "term", "left_semi").toArrow()  # the terms of INDEX_BYTES of text
        term, n = (np.asarray(own.column(c).combine_chunks()) for c in ("term", "n"))
        order = np.argsort(term.view(np.uint64))
        known = Statistics(items_, words / max(1, items_), term.view(np.uint64)[order], n[order])
        yield Pass(benchmark.sparkSession, [tuple(r) for r in dealt.where(F.col("pass") == k).select("item_id", "text").orderBy("item_id", "text").collect()], threshold, known)


_HIT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def hits(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each (document row, item) that it contains."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for sent in passes(benchmark, threshold):

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.index()
            for batch in batches:
                for part in tv.slices(batch):
                    found = index.search(*tv.words(part.column(1)))
                    ids = part.column(0).take(pa.array([r for r, *_ in found], pa.int64()))
                    rest = list(zip(*(x[1:] for x in found), strict=True)) or [(), (), (), ()]
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        one = docs.mapInArrow(work, _HIT)
        out = one if out is None else out.unionByName(one)
    return out


def clean(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents without the rows that contain an item; all columns pass through."""
    for sent in passes(benchmark, threshold):
        at = documents.columns.index("text")

        def work(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            index = sent.index()
            for batch in batches:
                for part in tv.slices(batch):
                    ok = np.ones(part.num_rows, bool)
                    ok[[r for r, *_ in index.search(*tv.words(part.column(at)))]] = False
                    yield part.filter(pa.array(ok))

        documents = documents.mapInArrow(work, documents.schema)
    return documents


def run(spark, sf_dir: str) -> DataFrame:
    return hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
