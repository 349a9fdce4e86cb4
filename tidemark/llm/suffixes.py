"""Suffix-array dedup: repeated byte strings found by hash-compared suffix sorts at anchors.

A byte goes if a string of `least` bytes that covers it also starts earlier. Every such
window has an anchor: of its GRAMS[0]-byte grams the one of the smallest hash, the first
of equal ones. Equal windows have equal anchors at equal places, so windows can only be
equal where anchors are. Neighbouring windows of one anchor are a run; its context is the
bytes that they cover. Contexts are what is shuffled, by anchor, and sorted.

Within the occurrences of an anchor two suffix sorts are made, of what follows the
anchor's begin and, reversed, of what stands before it: mergesorts, all groups at once,
whose comparisons find the common extension of two suffixes by binary search on
polynomial prefix hashes. The common extensions of neighbours are verified byte by byte;
where a collision shows, the group is sorted by its bytes instead. Two windows that begin
d bytes before their anchors are equal if no neighbour between them has an extension of
less than `least` - d on the right, nor of less than d on the left. The first of each
class of equal windows stays, the others are spans that go.

What saves work: equal contexts of one piece of a map task are sent once (compared byte by
byte), so a group of copies costs a row for each piece. Anchors that occur in one row only
have no second window; a filter of bounded size (`bits`) leaves out most of them. An
anchor that holds more rows than a quarter of a partition's share, and than HOT, is split: its
windows get anchors anew, from longer grams, in the end whole windows (GRAMS).

Defined results: null texts are empty. Rows with the same doc_id and text are one document
and get the same result; rows of one doc_id with different texts are documents of their own, in an order given by a
hash of the text, and a null doc_id comes last. Texts of any length are read in pieces that
overlap. Kept bytes need not be whole characters, and so are binary. Other columns aren't
read, so none can clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textvec as tv
from tidemark.llm.arrow import whole_groups
from tidemark.llm.bits import Filter, filter_of
from tidemark.llm.session import discard, lean, partitions, stored

LEAST = 100
GRAMS = (16, 64, 100)
#: Bytes of text that a map task works on at once.
PIECE = 2 << 20
#: Rows of an anchor that one task may hold in any case.
HOT = 20_000
#: Rows of contexts that are sorted together.
ROWS = 1 << 14
_PLACE = 24  # bits of a place in a piece

_BYTE = tv.mix(np.arange(1, 257, dtype=np.uint64))


class Hashed:
    """Bytes with polynomial prefix hashes modulo 2^64."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.powers, self.inverse = tv._pow(max(len(data) + 1, 1 << 16))
        self.prefix = np.empty(len(data) + 1, np.uint64)
        self.prefix[0] = 0
        np.cumsum(_BYTE[data] * self.powers[: len(data)], out=self.prefix[1:])

    def of(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the strings of these sizes."""
        return (self.prefix[begin + size] - self.prefix[begin]) * self.inverse[begin]

    def grams(self, k: int) -> np.ndarray:
        n = len(self.data) - k + 1
        return tv.mix((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n])

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes at a and b, `most` at most, by binary search; too long where hashes collide."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.of(a, middle) == self.of(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the strings are equal, byte by byte."""
        out = np.ones(len(a), bool)
        done = np.cumsum(size)
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(done, (done[at] - size[at]) + (1 << 19), "right")))
            n = size[at:to]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            bad = self.data[np.repeat(a[at:to], n) + step] != self.data[np.repeat(b[at:to], n) + step]
            out[at:to] = np.bincount(np.repeat(np.arange(to - at), n), bad, to - at) == 0
            at = to
        return out


class Suffixes:
    """Suffixes of some bytes: where they begin and how far they reach, in groups that are sorted one by one."""

    def __init__(self, text: Hashed, begin: np.ndarray, size: np.ndarray, group: np.ndarray):
        self.text, self.begin, self.size = text, begin.astype(np.int64), size.astype(np.int64)
        first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
        count = np.diff(first, append=len(group))
        self.first, self.count = np.repeat(first, count), np.repeat(count, count)  # of each suffix's group
        self.order = self._sorted()
        self.extension = self._extensions()

    def _before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether a sorts before b; where or_equal, also if they are equal."""
        most = np.minimum(self.size[a], self.size[b])
        n = self.text.common(self.begin[a], self.begin[b], most)
        inside = n < most
        end = len(self.text.data) - 1
        x, y = self.text.data[np.minimum(self.begin[a] + n, end)], self.text.data[np.minimum(self.begin[b] + n, end)]
        return np.where(inside, x < y, (self.size[a] < self.size[b]) | (or_equal & (self.size[a] == self.size[b])))

    def _sorted(self) -> np.ndarray:
        """Bottom-up mergesort of all groups at once: each suffix's place is its own place in its run and the number of those before it in the other run, by binary search."""
        order = np.arange(len(self.begin))
        within = order - self.first
        width = 1
        while len(order) and width < self.count.max():
            side = (within // width) & 1
            start = within - within % width + np.where(side == 1, -width, width)  # of the other run
            other = np.clip(self.count - start, 0, width)
            low, high = np.zeros(len(order), np.int64), other.copy()
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) >> 1
                rival = order[self.first[open_] + start[open_] + middle]
                before = self._before(rival, order[open_], side[open_] == 1)
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
                open_ = open_[low[open_] < high[open_]]
            place = self.first + within - within % width - np.where(side == 1, width, 0) + within % width + low
            new = np.empty_like(order)
            new[place] = order
            order = new
            width *= 2
        return order

    def _extensions(self) -> np.ndarray:
        """Common extension of each suffix with the one before it in the order, 0 for the first of a group; verified, and mended where hashes collided."""
        out = np.zeros(len(self.order), np.int64)
        at = np.flatnonzero(np.arange(len(self.order)) > self.first)
        if not len(at):
            return out
        a, b = self.order[at - 1], self.order[at]
        most = np.minimum(self.size[a], self.size[b])
        out[at] = n = self.text.common(self.begin[a], self.begin[b], most)
        right = self.text.equal(self.begin[a], self.begin[b], n) & self._before(a, b, np.ones(len(a), bool))
        for first in np.unique(self.first[at[~right]]).tolist():
            self._by_bytes(first, out)
        return out

    def _by_bytes(self, first: int, out: np.ndarray) -> None:
        rows = slice(first, first + int(self.count[first]))
        strings = {i: self.text.data[self.begin[i] : self.begin[i] + self.size[i]].tobytes() for i in sorted(self.order[rows].tolist())}
        order = sorted(strings, key=cmp_to_key(lambda x, y: (strings[x] > strings[y]) - (strings[x] < strings[y])))
        self.order[rows] = order
        for k, (x, y) in enumerate(zip(order, order[1:], strict=False)):
            s, t = strings[x], strings[y]
            out[first + k + 1] = next((i for i, (u, v) in enumerate(zip(s, t, strict=False)) if u != v), min(len(s), len(t)))

    def classes(self, least: int) -> np.ndarray:
        """For each suffix a number that it shares with those of its group that begin with the same `least` bytes (of suffixes that are long enough)."""
        new = (self.extension < least) | (np.arange(len(self.order)) == self.first)
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(new)
        return out


class Runs:
    """Runs of windows that share an anchor: first and last window, and the anchor with its hash."""

    def __init__(self, text: Hashed, valid: np.ndarray, k: int, least: int):
        n = len(text.data) - least + 1
        grams = text.grams(k)
        key = (grams & np.uint64(~((1 << _PLACE) - 1) & (1 << 64) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width, size = least - k + 1, 1
        while size * 2 <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        anchor = (np.minimum(key[:n], key[width - size : width - size + n]) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        self.first = np.flatnonzero(new)
        end = valid.copy()
        end[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
        self.last = np.flatnonzero(end)
        self.anchor = anchor[self.first]
        self.key = tv.mix(grams[self.anchor] + np.uint64(k))

    def keep(self, which: np.ndarray) -> None:
        self.first, self.last, self.anchor, self.key = (x[which] for x in (self.first, self.last, self.anchor, self.key))

    def repeats(self, text: Hashed, least: int) -> np.ndarray:
        """Runs whose context, with the anchor at the same place, stands earlier in the text, in another document or at another place: byte by byte."""
        size = self.last - self.first + least
        mark = tv.mix(text.of(self.first, size) + tv.mix((size << 32 | (self.anchor - self.first)).astype(np.uint64)))
        _, begin, which = np.unique(mark, return_index=True, return_inverse=True)
        model = begin[which]
        later = np.flatnonzero(model != np.arange(len(which)))
        same = (size[later] == size[model[later]]) & (self.anchor[later] - self.first[later] == self.anchor[model[later]] - self.first[model[later]])
        later = later[same]
        out = np.zeros(len(which), bool)
        out[later[text.equal(self.first[later], self.first[model[later]], size[later])]] = True
        return out


def _valid(offsets: np.ndarray, least: int) -> np.ndarray:
    """Windows that lie in one row."""
    n = int(offsets[-1])
    step = np.zeros(n + 1, np.int64)
    begin, end = offsets[:-1], offsets[1:]
    np.add.at(step, np.maximum(begin, end - least + 1), 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:n])[: max(0, n - least + 1)] == 0


def _pieces(batch: pa.RecordBatch, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, row bounds, row numbers and places of the rows' begin in their texts. Rows ascend by document, so what stands first is earlier; equal rows come once; long texts in pieces that overlap by less than a window."""
    order = pc.sort_indices(pa.Table.from_batches([batch]), sort_keys=[(batch.schema.names[0], "ascending"), (batch.schema.names[1], "ascending")])
    doc, mark = (np.asarray(batch.column(i).take(order)) for i in (0, 1))
    order = order.filter(pa.array(np.append(True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])))) if len(doc) else order
    data, offsets = tv.buffers(batch.column(2).take(order))
    rows, at = np.asarray(order), 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        part = data[offsets[at] : offsets[to]]
        if to == at + 1:
            for begin in range(0, max(1, len(part) - least + 1), most):
                piece = part[begin : begin + most + least - 1]
                yield piece, np.array([0, len(piece)]), rows[at:to], np.array([begin])
        else:
            yield part, offsets[at : to + 1] - offsets[at], rows[at:to], np.zeros(to - at, np.int64)
        at = to
    tv.release()


def _levels(data: np.ndarray, offsets: np.ndarray, least: int, grams: tuple[int, ...], hot: list[np.ndarray]) -> Iterator[tuple[int, Hashed, Runs]]:
    """Runs by the anchors of each level; windows of hot anchors go on to the next one."""
    if len(data) < least or not (valid := _valid(offsets, least)).any():
        return
    text = Hashed(data)
    for level, k in enumerate(grams):
        runs = Runs(text, valid, k, least)
        over = np.isin(runs.key.view(np.int64), hot[level]) if level < len(hot) else np.zeros(len(runs.key), bool)
        step = np.zeros(len(valid) + 1, np.int64)
        np.add.at(step, runs.first[over], 1)
        np.add.at(step, runs.last[over] + 1, -1)
        valid = np.cumsum(step)[:-1] > 0
        if level < len(hot):
            runs.keep(~over)
        yield level, text, runs
        if not valid.any():
            return


def _merged(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of ranges that touch; sorted by owner and begin, ends ascending."""
    new = np.ones(len(begin), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (begin[1:] > end[:-1])
    at = np.flatnonzero(new)
    return owner[at], begin[at], end[np.append(at[1:], len(end)) - 1] if len(at) else end[:0]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc (a null key as the largest number), mark (a hash of the text), text."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def _counts(keyed: DataFrame, least: int, grams: tuple[int, ...], hot: list[np.ndarray]) -> DataFrame:
    """(key, n): anchors of the level after the hot ones that more than one row would hold."""
    level, piece = len(hot), PIECE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, _, _ in _pieces(batch, least, piece):
                for at, text, runs in _levels(data, offsets, least, grams[: level + 1], hot):
                    if at == level:
                        keys, n = np.unique(runs.key[~runs.repeats(text, least)], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    return keyed.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def contexts(keyed: DataFrame, least: int, grams: tuple[int, ...], hot: list[np.ndarray], known: Filter) -> DataFrame:
    """key, doc, mark, place, anchor, size, bytes: contexts by anchor (place: where they begin, anchor: where in them), and spans of known repeats (without bytes)."""
    piece = PIECE

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for data, offsets, rows, begin in _pieces(batch, least, piece):
                spans = []
                for level, text, runs in _levels(data, offsets, least, grams, hot):
                    again = runs.repeats(text, least)
                    row = np.searchsorted(offsets, runs.first, "right") - 1
                    spans.append((row[again], runs.first[again], runs.last[again] + least))
                    at = np.flatnonzero(~again & (known.has(runs.key) if not level else True))
                    for a in range(0, len(at), 1 << 14):
                        i = at[a : a + (1 << 14)]
                        size = runs.last[i] - runs.first[i] + least
                        bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                        taken = data[np.repeat(runs.first[i] - bounds[:-1], size) + np.arange(bounds[-1])]
                        yield _rows(runs.key[i], doc[rows[row[i]]], mark[rows[row[i]]], runs.first[i] - offsets[row[i]] + begin[row[i]], runs.anchor[i] - runs.first[i], size, pa.BinaryArray.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(bounds), pa.py_buffer(taken)]))
                if spans:
                    row, a, b = (np.concatenate(x) for x in zip(*spans, strict=True))
                    order = np.argsort(a, kind="stable")
                    row, a, b = _merged(row[order], a[order], np.maximum.accumulate(b[order]))
                    yield _rows(tv.mix(doc[rows[row]].view(np.uint64) + a.astype(np.uint64)), doc[rows[row]], mark[rows[row]], a - offsets[row] + begin[row], np.full(len(row), -1), b - a, pa.nulls(len(row), pa.binary()))

    return keyed.mapInArrow(send, "key long, doc long, mark long, place long, anchor int, size long, bytes binary")


def _rows(key: np.ndarray, doc: np.ndarray, mark: np.ndarray, place: np.ndarray, anchor: np.ndarray, size: np.ndarray, data: pa.Array) -> pa.RecordBatch:
    columns = [pa.array(key.view(np.int64)), pa.array(doc), pa.array(mark), pa.array(place), pa.array(anchor.astype(np.int32)), pa.array(size.astype(np.int64)), data]
    return pa.RecordBatch.from_arrays(columns, names=["key", "doc", "mark", "place", "anchor", "size", "bytes"])


def repeated(table: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, begins and ends (in the context) of the spans whose windows have an earlier equal one in the table, which holds whole groups of anchors, sorted."""
    key, doc, mark, place, anchor = (np.asarray(table.column(i)) for i in range(5))
    column = table.column(6).combine_chunks()
    bounds = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    begin, end = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
    anchor = anchor.astype(np.int64)
    order = np.lexsort((place + anchor, mark, doc))
    rank = np.empty(len(order), np.int64)
    same = np.zeros(len(order), bool)
    same[1:] = (doc[order][1:] == doc[order][:-1]) & (mark[order][1:] == mark[order][:-1]) & ((place + anchor)[order][1:] == (place + anchor)[order][:-1])
    rank[order] = np.cumsum(~same)  # of the anchor in the corpus; one of a row that is repeated counts once
    after = Suffixes(Hashed(data), begin + anchor, end - begin - anchor, key)
    before = Suffixes(Hashed(np.ascontiguousarray(data[::-1])), len(data) - begin - anchor, anchor, key)
    windows = end - begin - least + 1
    at = np.concatenate([[0], np.cumsum(windows)])
    gone = np.zeros(int(at[-1]), bool)
    for d in range(int(anchor.max(initial=-1)) + 1):
        mine = np.flatnonzero((anchor >= d) & (anchor - d < windows))
        if len(mine) < 2:
            continue
        kind = after.classes(least - d)[mine] << 32 | before.classes(d)[mine]
        by = np.lexsort((rank[mine], kind))
        kind, mine = kind[by], mine[by]
        head = np.diff(kind, prepend=kind[:1] - 1) != 0
        first = rank[mine][np.flatnonzero(head)[np.cumsum(head) - 1]]
        later = mine[rank[mine] > first]
        gone[at[later] + anchor[later] - d] = True
    where = np.flatnonzero(gone)
    row = np.searchsorted(at, where, "right") - 1
    window = where - at[row]
    return _merged(row, window, window + least)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, grams: tuple[int, ...] | None = None) -> DataFrame:
    """doc, mark, begins, ends: spans of bytes to remove of each document that has any; they may overlap. A table in the shared folder."""
    spark = lean(docs.sparkSession)
    grams = grams or tuple(min(k, least) for k in GRAMS)
    parts, at_once = partitions(spark), ROWS
    keyed = _keyed(docs, key, text)
    hot: list[np.ndarray] = []
    known = None
    for level in range(max(1, len(grams) - 1)):
        counts = stored(_counts(keyed, least, grams, hot), "anchors")
        share = max(HOT, (counts.agg(F.sum("n")).first()[0] or 0) // (4 * parts))
        over = counts.where(F.col("n") > share).select("key").toArrow().column("key")  # fewer than 4 a partition
        known = known or filter_of(counts)
        discard(spark, counts)
        if level + 1 < len(grams):
            hot.append(np.sort(np.asarray(over.combine_chunks(), np.int64)))
        if not len(over):
            break
    sent = contexts(keyed, least, grams, hot, known).repartition(parts, "key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1, most=at_once):
            told = pc.is_null(table.column(6))
            ready = table.filter(told)
            if ready.num_rows:
                yield _spans(ready, np.arange(ready.num_rows), np.asarray(ready.column(3)), np.asarray(ready.column(3)) + np.asarray(ready.column(5)))
            table = table.filter(pc.invert(told))
            group = np.asarray(table.column(0))
            alone = np.ones(len(group), bool)
            alone[1:] &= group[1:] != group[:-1]
            alone[:-1] &= group[1:] != group[:-1]
            table = table.filter(pa.array(~alone))
            if table.num_rows:
                row, a, b = repeated(table, least)
                place = np.asarray(table.column(3))[row]
                yield _spans(table, row, a + place, b + place)
            tv.release()

    def _spans(table: pa.Table, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        own = table.select([1, 2]).take(pa.array(row)).combine_chunks()
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in own.columns), pa.array(begin), pa.array(end)], names=["doc", "mark", "begin", "end"])

    found = sent.mapInArrow(compare, "doc long, mark long, begin long, end long")
    return stored(found.groupBy("doc", "mark").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends")), "spans")


def _union(begins: pa.Scalar, ends: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    if not begins.is_valid:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.asarray(begins.values), np.asarray(ends.values)
    order = np.argsort(a, kind="stable")
    _, a, b = _merged(np.zeros(len(a), np.int8), a[order], np.maximum.accumulate(b[order]))
    return a, b


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, digests: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, then begins and ends of the spans and the kept bytes; with digests=True kept_sha256 instead of these."""
    found = spans(docs, key, text, least)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    joined = rows.join(found, ["doc", "mark"], "left").select("text", "begins", "ends", "id")
    more = "kept_sha256 string" if digests else "begins array<long>, ends array<long>, kept binary"
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tv.slices(whole):
                data, offsets = tv.buffers(batch.column(0))
                gone, count, out = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
                for i in range(batch.num_rows):
                    a, b = _union(batch.column(1)[i], batch.column(2)[i])
                    gone[i], count[i] = (b - a).sum(), len(a)
                    own = memoryview(data[offsets[i] : offsets[i + 1]])
                    left = [own[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(own)], strict=True)]
                    if digests:
                        digest = hashlib.sha256()
                        for part in left:
                            digest.update(part)
                        out.append(digest.hexdigest())
                    else:
                        out.append((a.tolist(), b.tolist(), b"".join(left)))
                columns = [pa.array(out, pa.string())] if digests else [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))]
                names = ["kept_sha256"] if digests else ["begins", "ends", "kept"]
                yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(np.diff(offsets)), pa.array(gone), pa.array(count), *columns], names=["id", "n_bytes", "n_removed", "n_spans", *names])

    return joined.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, {more}").withColumnRenamed("id", key)


def run(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
