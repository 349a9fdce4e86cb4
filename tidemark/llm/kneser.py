"""Interpolated modified Kneser-Ney language model (trigrams), counted in Spark.

The model is a set of sorted hash arrays in the cluster's shared folder: words and counts,
trigrams and counts, bigrams and the number of their left neighbours, totals of contexts,
each cut into shards. Shards are built by the executors from packed, locally summed counts
and written under a temporary name first, so a task that runs twice or whose executor is
lost does no harm. Workers memory-map the shards and look up whole slices of text at once.
Nothing is pruned or capped. The driver sees totals by shard and counts of counts only.

P(w|uv) = max(c(uvw) - D(c), 0) / c(uv) + g(uv) P(w|v), with
P(w|v) = max(k(vw) - E(k), 0) / k(v) + g(v) P(w) and
P(w) = max(k(w) - F(k), 0) / K + g / (V + 1): k(vw) is the number of words that stand
before vw (at the begin of a text, which nothing precedes, the count of vw), k(w) that of
words before w, k(v) and K their sums; D, E and F are the discounts for counts of 1, 2, 3
and more, V is the number of distinct tokens and one more for what isn't known. Two marks
for the begin of a text are contexts. A context seen once needs no entry: that its bigram
is known tells its total.

A trigram's three ids go to the shard of their context, and from there the bigrams and the
words to theirs, in one job of three exchanges. Trigrams whose two context words both have
more than a quarter of a shard's share are dealt one by one, and only the totals of such
contexts are summed again.

Hash arrays keep 32 bits of a key beside the place that its first bits give, so an n-gram
that was never seen is taken for another one with a probability below 1e-8.

Defined results: a null or empty text is its end token alone. Rows that repeat (ids or
texts) count and are scored each. Ties can't arise. With no training text all words are
unknown, N and V are 0 and the score is that of the uniform distribution over one token.
A very long text is looked up in windows of its tokens and takes some 60 bytes for each.
Only doc_id and text are read, so other columns can't clash. The shared folder must be
mounted (file://); fewer than 2^32 - 1 distinct tokens.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import grams
from tidemark.llm import textvec as tv
from tidemark.llm.session import lean, mounted, partitions, stored

END = np.uint64(1)  # hash of the token that is no word
FLUSH = 3_000_000
STEP = 1 << 18
SHARD_BYTES = 32 << 20
# Kinds of packed rows: counts of words; trigrams of whole contexts, and dealt ones; totals of dealt contexts; bigrams; totals of words as contexts; left neighbours of words; statistics.
WORD, WHOLE, DEALT, CONTEXT, BIGRAM, FOLLOWED, PRECEDED, STATS = range(8)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of tokens, and each row's first token."""
    h, bounds = tv.words(column)
    first = bounds + np.arange(len(bounds))  # every row before has one end token
    out = np.full(len(h) + len(bounds) - 1, END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = h
    return out, first


def _before(x: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    """What stands before each token; `begin` at the begin of a row."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[first[:-1]] = begin
    return out


def _sum(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values (numbers or rows of them)."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    begin = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.empty(0, np.int64)
    return keys[begin], np.add.reduceat(values, begin) if len(begin) else values[:0]


def _triples(pair: np.ndarray, word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (pair, word), ascending, the sums of their counts, and of each an example among the given ones."""
    order = np.argsort(pair)
    p = pair[order]
    rank = np.cumsum(np.diff(p, prepend=p[:1]) != 0).astype(np.uint64)
    key = (rank << np.uint64(32)) | word[order].astype(np.uint64)
    inner = np.argsort(key)
    key, order = key[inner], order[inner]
    begin = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.empty(0, np.int64)
    example = order[begin]
    return pair[example], word[example], np.add.reduceat(counts[order], begin) if len(begin) else counts[:0], example


def _planes(x: np.ndarray) -> bytes:
    """The numbers, all lowest bytes first, compressed."""
    raw = np.ascontiguousarray(x).reshape(-1).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unplanes(buffer: pa.Buffer, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.Codec("zstd").decompress(buffer[8:], int.from_bytes(buffer[:8].to_pybytes(), "little"))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


_PACKED = "kind byte, shard int, keys binary, words binary, counts binary"


def _rows(kind: int, shard: np.ndarray, keys: np.ndarray, counts: np.ndarray, words: np.ndarray | None, shards: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard with its keys, which ascend."""
    narrow = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    cuts = np.searchsorted(shard[narrow], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        own = narrow[cuts[s] : cuts[s + 1]]
        yield _row(kind, s, _planes(np.diff(keys[own], prepend=np.uint64(0))), _planes(counts[own].astype(np.uint64)), _planes(words[own]) if words is not None else b"")


def _row(kind: int, shard: int, keys: bytes, counts: bytes, words: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int8()), pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in (keys, words, counts))], names=["kind", "shard", "keys", "words", "counts"])


def _stats(shard: int, order: int, counts: np.ndarray) -> pa.RecordBatch:
    """Of the counts of n-grams of an order: how many are 1, 2, 3, 4, 3 and more, and their sum."""
    return _row(STATS, shard, b"", _planes(np.array([order, *((counts == k).sum() for k in (1, 2, 3, 4)), (counts >= 3).sum(), counts.sum()], np.int64)))


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]], list[pa.RecordBatch]]]:
    """For each shard of a partition (which is sorted by it) the pieces (keys, words, counts) of each kind, and the rows of statistics."""
    held, done, at = {}, [], None
    for batch in batches:
        for i, (kind, shard) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if at is not None and shard != at:
                yield at, held, done
                held, done = {}, []
            at = shard
            if kind == STATS:
                done.append(batch.slice(i, 1))
                continue
            keys, words, counts = (batch.column(c)[i].as_buffer() for c in (2, 3, 4))
            held.setdefault(kind, []).append((np.cumsum(_unplanes(keys, np.uint64), dtype=np.uint64), _unplanes(words, np.uint32) if words.size else np.empty(0, np.uint32), _unplanes(counts, np.uint64).astype(np.int64)))
    if at is not None:
        yield at, held, done


def _joined(pieces: list[tuple[np.ndarray, ...]] | None, wide: bool = False) -> tuple[np.ndarray, ...]:
    if not pieces:
        return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty((0, 4) if wide else 0, np.int64)
    keys, words, counts = (np.concatenate(x) for x in zip(*pieces, strict=True))
    return keys, words, counts.reshape(-1, 4) if wide else counts


def _exchanged(packed: DataFrame, shards: int) -> DataFrame:
    return packed.repartition(shards, "shard").sortWithinPartitions("shard")


def _save(folder: str, name: str, x: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with open(part, "wb") as f:
        np.save(f, x)
    os.replace(part, f"{folder}/{name}.npy")


_mapped: dict[tuple[str, str], np.ndarray | None] = {}


def _load(folder: str, name: str) -> np.ndarray | None:
    """A mapped array, None where there is none. Arrays of other models are let go."""
    if (folder, name) not in _mapped:
        if _mapped and next(iter(_mapped))[0] != folder:
            _mapped.clear()
        path = f"{folder}/{name}.npy"
        _mapped[folder, name] = np.load(path, mmap_mode="r").view(np.ndarray) if os.path.exists(path) else None
    return _mapped[folder, name]


def save_table(folder: str, name: str, keys: np.ndarray, values: np.ndarray) -> None:
    """A sorted hash array: distinct keys that are hashes, and their values (numbers or rows of them) in one byte each; rows with larger ones are kept apart, by place."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    values = values if values.ndim == 2 else values[:, None]
    bits = max(0, len(keys).bit_length() - 4)
    _save(folder, f"{name}-begin", np.searchsorted(keys >> np.uint64(63 - bits), np.arange((1 << bits + 1) + 1, dtype=np.uint64)).astype(np.uint32 if len(keys) < 1 << 32 else np.int64))
    _save(folder, f"{name}-low", ((keys >> np.uint64(31 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    big = np.flatnonzero((values >= 255).any(axis=1))
    _save(folder, f"{name}-value", np.minimum(values, 255).astype(np.uint8))
    if len(big):
        _save(folder, f"{name}-place", big)
        _save(folder, f"{name}-large", values[big])


def find(folder: str, name: str, keys: np.ndarray, width: int) -> np.ndarray:
    """The values of each key, a row of `width`; zeros where the table doesn't have it."""
    out = np.zeros((len(keys), width), np.int64)
    begin, low, value = (_load(folder, f"{name}-{x}") for x in ("begin", "low", "value"))
    if low is None or not len(low):
        return out
    bits = (len(begin) - 1).bit_length() - 2
    slot = (keys >> np.uint64(63 - bits)).astype(np.int64)
    want = ((keys >> np.uint64(31 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    lo, hi = begin[slot].astype(np.int64), begin[slot + 1].astype(np.int64)
    end = hi.copy()
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = (lo < hi) & (low[np.minimum(mid, len(low) - 1)] < want)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.minimum(mid, hi))
    hit = np.flatnonzero((lo < end) & (low[np.minimum(lo, len(low) - 1)] == want))
    found = value[lo[hit]].astype(np.int64)
    big = np.flatnonzero((found == 255).any(axis=1))
    if len(big):
        place = _load(folder, f"{name}-place")
        found[big] = _load(folder, f"{name}-large")[np.searchsorted(place, lo[hit[big]])]
    out[hit] = found
    return out


def _range_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _hash_shard(x: np.ndarray, shards: int) -> np.ndarray:
    return _range_shard(tv.mix(x + np.uint64(0x51ED270B)), shards)


def _trigram(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tv.mix(tv.mix(pair) + word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _per_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    if len(order):
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            yield int(shard[own[0]]), own


def discounts(n: list[int]) -> np.ndarray:
    """Of counts 0, 1, 2, 3 and more, from the numbers of n-grams seen 1, 2, 3, 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.05), k) for k, x in enumerate(d, 1))])


class Model:
    """Totals and discounts; the arrays are in `folder`. A token's id is its place in the order of hashes; the begin of a text is the id after the last."""

    def __init__(self, folder: str, shards: int, base: np.ndarray, total: int):
        self.folder, self.shards, self.base, self.total = folder, shards, base, total
        self.types = int(base[-1])
        self.discount = {order: discounts([0, 0, 0, 0]) for order in (1, 2, 3)}
        self.left = 1.0  # the weight of the uniform distribution
        self.preceded = 0

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and training counts of token hashes."""
        names, inverse = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(names), -1), np.zeros(len(names), np.int64)
        for s, own in _per_shard(_range_shard(names, self.shards)):
            words = _load(self.folder, f"word-{s}")
            if words is None:
                continue
            at = np.minimum(np.searchsorted(words, names[own]), len(words) - 1)
            hit = words[at] == names[own]
            ids[own[hit]] = self.base[s] + at[hit]
            counts[own[hit]] = _load(self.folder, f"count-{s}")[at[hit]]
        return ids[inverse], counts[inverse]

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of ids; of the begin of a text more than all tokens."""
        out = np.full(len(ids), self.total + 1, np.int64)
        real = np.flatnonzero(ids < self.types)
        for s, own in _per_shard(np.searchsorted(self.base, ids[real], "right") - 1):
            out[real[own]] = _load(self.folder, f"count-{s}")[ids[real[own]] - self.base[s]]
        return out

    def is_hot(self, counts: np.ndarray) -> np.ndarray:
        return counts * 4 * self.shards > self.total

    def id_shard(self, ids: np.ndarray) -> np.ndarray:
        return ids.astype(np.int64) * self.shards // (self.types + 1)

    def by_id(self, name: str, ids: np.ndarray, width: int) -> np.ndarray:
        """Rows of a dense array over ids; zeros for unknown ones."""
        names, inverse = np.unique(ids, return_inverse=True)
        out = np.zeros((len(names), width), np.int64)
        real = np.flatnonzero(names >= 0)
        for s, own in _per_shard(self.id_shard(names[real])):
            if (have := _load(self.folder, f"{name}-{s}")) is not None:
                out[real[own]] = have[names[real[own]] - -(-s * (self.types + 1) // self.shards)]
        return out[inverse]

    def in_tables(self, name: str, keys: np.ndarray, shard: np.ndarray, width: int) -> np.ndarray:
        """Rows of the hash arrays `name` of each key's shard."""
        names, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        out = np.zeros((len(names), width), np.int64)
        for s, own in _per_shard(shard[at]):
            out[own] = find(self.folder, f"{name}-{s}", names[own], width)
        return out[inverse]

    def _step(self, order: int, times: np.ndarray, stats: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of an order from the n-grams' counts, their contexts' stats (total, and how many n-grams count 1, 2, 3 and more) and the lower order."""
        d = self.discount[order]
        total = np.maximum(stats[:, 0], 1)
        return np.where(stats[:, 0] > 0, np.maximum(times - d[np.minimum(times, 3)], 0) / total + stats[:, 1:] @ d[1:] / total * lower, lower)

    def probabilities(self, w: np.ndarray, v: np.ndarray, u: np.ndarray, vc: np.ndarray, uc: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """P(w|uv) of tokens in their order, by ids and counts; the first one only serves as context of the next unless it begins a text."""
        word = lambda x: x.astype(np.uint64)
        seen = np.flatnonzero((w >= 0) & (v >= 0))
        pair = (word(v[seen]) << np.uint64(32)) | word(w[seen])
        k = np.zeros(len(w), np.int64)
        k[seen] = self.in_tables("bigram", tv.mix(pair), np.where(self.is_hot(vc[seen]), _hash_shard(pair, self.shards), _hash_shard(word(v[seen]), self.shards)), 1)[:, 0]
        n = self.by_id("preceded", w, 1)[:, 0]
        p = np.maximum(n - self.discount[1][np.minimum(n, 3)], 0) / max(self.preceded, 1) + self.left / (self.types + 1)
        p = self._step(2, k, self.by_id("followed", v, 4), p)
        # A context that a bigram of the training text made, but that has no entry, was seen once.
        there = np.zeros(len(w), bool)
        there[1:] = k[:-1] > 0
        there[begins] = self.total > 0
        stats = np.zeros((len(w), 4), np.int64)
        stats[there] = [1, 1, 0, 0]
        at = np.flatnonzero(there & (u >= 0) & (v >= 0))
        context = (word(u[at]) << np.uint64(32)) | word(v[at])
        hot = self.is_hot(uc[at]) & self.is_hot(vc[at])
        home = _hash_shard(context, self.shards)
        for name, own in (("context", ~hot), ("dealt", hot)):
            found = self.in_tables(name, tv.mix(context[own]), home[own], 4)
            have = found[:, 0] > 0
            stats[at[own][have]] = found[have]
        times = np.zeros(len(w), np.int64)
        ok = w[at] >= 0
        at, context, hot = at[ok], context[ok], hot[ok]
        h = _trigram(context, w[at])
        times[at] = self.in_tables("trigram", h, np.where(hot, _hash_shard(h, self.shards), home[ok]), 1)[:, 0]
        return self._step(3, times, stats, p)

    def score(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base score and score of each row."""
        token, first = _tokens(column)
        w, c = self.known(token)
        v, vc = _before(w, first, self.types), _before(c, first, self.total + 1)
        u, uc = _before(v, first, self.types), _before(vc, first, self.total + 1)
        begins = np.zeros(len(w), bool)
        begins[first[:-1]] = True
        log = np.empty(len(w))
        for at in range(0, len(w), STEP):
            x = slice(max(0, at - 1), at + STEP)  # with the token before, whose bigram is the next one's context
            with np.errstate(divide="ignore"):
                log[at : at + STEP] = np.log10(self.probabilities(w[x], v[x], u[x], vc[x], uc[x], begins[x]))[min(at, 1) :]
        base = np.log10((c + 1) / (self.total + self.types + 1))
        return np.diff(first), *(np.add.reduceat(x, first[:-1]) for x in ((c > 0).astype(np.int64), base, log))

    def remove(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def _words(docs: DataFrame, folder: str, shards: int) -> Model:
    """Counts of tokens, written by shard of the hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = _sum(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield from _rows(WORD, _range_shard(keys, shards), keys, counts, None, shards)

        for batch in batches:
            for part in tv.slices(batch):
                held.append(np.unique(_tokens(part.column(0))[0], return_counts=True))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, held, _ in _by_shard(batches):
            keys, _, counts = _joined(held[WORD])
            keys, counts = _sum(keys, counts)
            _save(folder, f"word-{s}", keys)
            _save(folder, f"count-{s}", counts)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (s, len(keys), int(counts.sum()))], names=["shard", "types", "total"])

    sizes = _exchanged(docs.mapInArrow(count, _PACKED), shards).mapInArrow(write, "shard long, types long, total long").collect()  # a row for each shard
    base = np.zeros(shards + 1, np.int64)
    for r in sizes:
        base[r.shard + 1] = r.types
    model = Model(folder, shards, np.cumsum(base), sum(r.total for r in sizes))
    if model.types >= (1 << 32) - 1:
        raise ValueError("a model holds fewer than 2^32 - 1 distinct tokens")
    return model


def _grams(docs: DataFrame, model: Model) -> None:
    """Writes the arrays of trigrams, bigrams and words, and gives the model their statistics."""
    folder, shards, types = model.folder, model.shards, model.types
    begin = np.uint64(types)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            pair, word, hot = (np.concatenate(x) for x in zip(*held, strict=True))
            pair, word, counts, example = _triples(pair, word, np.ones(len(pair), np.int64))
            hot = hot[example]
            for kind, own, shard in ((WHOLE, ~hot, _hash_shard), (DEALT, hot, None)):
                p, w = pair[own], word[own]
                yield from _rows(kind, shard(p, shards) if shard else _hash_shard(_trigram(p, w), shards), p, counts[own], w, shards)

        for batch in batches:
            for part in tv.slices(batch):
                token, first = _tokens(part.column(0))
                w, c = model.known(token)
                v, vc = _before(w, first, types), _before(c, first, model.total + 1)
                u, uc = _before(v, first, types), _before(vc, first, model.total + 1)
                held.append(((u.astype(np.uint64) << np.uint64(32)) | v.astype(np.uint64), w.astype(np.uint32), model.is_hot(uc) & model.is_hot(vc)))
                size += len(w)
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
                    tv.release()
        if held:
            yield from flush()
        held.clear()
        tv.release()

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, held, done in _by_shard(batches):
            yield from done
            table, below = [], []
            for kind in (WHOLE, DEALT):
                pair, word, counts, _ = _triples(*_joined(held.pop(kind, None)))
                table.append((_trigram(pair, word), counts))
                v = pair & np.uint64(0xFFFFFFFF)
                below.append(_sum((v << np.uint64(32)) | word.astype(np.uint64), np.where(v == begin, counts, 1)))
                at = np.flatnonzero(np.diff(pair, prepend=~pair[:1])) if len(pair) else np.empty(0, np.int64)
                stats = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1) if len(at) else np.empty((0, 4), np.int64)
                pair = pair[at]
                if kind == WHOLE:
                    more = stats[:, 0] > 1
                    save_table(folder, f"context-{s}", tv.mix(pair[more]), stats[more])
                else:
                    yield from _rows(CONTEXT, _hash_shard(pair, shards), pair, stats, None, shards)
            keys, counts = (np.concatenate(x) for x in zip(*table, strict=True))
            save_table(folder, f"trigram-{s}", keys, counts)
            yield _stats(s, 3, counts)
            keys, counts = _sum(*(np.concatenate(x) for x in zip(*below, strict=True)))
            v = keys >> np.uint64(32)
            at = np.flatnonzero(np.diff(v, prepend=~v[:1])) if len(v) else np.empty(0, np.int64)
            hot = np.repeat(model.is_hot(model.counts_of(v[at].astype(np.int64))), np.diff(at, append=len(v)))
            yield from _rows(BIGRAM, np.where(hot, _hash_shard(keys, shards), _hash_shard(v, shards)), keys, counts, None, shards)
            tv.release()

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, held, done in _by_shard(batches):
            yield from done
            pair, _, stats = _joined(held.pop(CONTEXT, None), True)
            pair, stats = _sum(pair, stats)
            save_table(folder, f"dealt-{s}", tv.mix(pair), stats)
            keys, _, counts = _joined(held.pop(BIGRAM, None))
            keys, counts = _sum(keys, counts)
            save_table(folder, f"bigram-{s}", tv.mix(keys), counts)
            yield _stats(s, 2, counts)
            v = keys >> np.uint64(32)
            at = np.flatnonzero(np.diff(v, prepend=~v[:1])) if len(v) else np.empty(0, np.int64)
            if len(at):
                stats = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (counts, counts == 1, counts == 2, counts >= 3)], axis=1)
                yield from _rows(FOLLOWED, model.id_shard(v[at]), v[at], stats, None, shards)
                ids, left = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
                yield from _rows(PRECEDED, model.id_shard(ids), ids, left, None, shards)
            tv.release()

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, held, done in _by_shard(batches):
            yield from done
            low, high = (-(-x * (types + 1) // shards) for x in (s, s + 1))
            for name, kind, wide in (("followed", FOLLOWED, True), ("preceded", PRECEDED, False)):
                ids, _, counts = _joined(held.pop(kind, None), wide)
                ids, counts = _sum(ids, counts)
                out = np.zeros((high - low, 4 if wide else 1), np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64)
                out[ids.astype(np.int64) - low] = counts.reshape(len(ids), -1)
                _save(folder, f"{name}-{s}", out)
                if not wide:
                    yield _stats(s, 1, counts)

    packed = docs.mapInArrow(count, _PACKED)
    for stage in (trigrams, bigrams, words):
        packed = _exchanged(packed, shards).mapInArrow(stage, _PACKED)
    sums = {order: np.zeros(6, np.int64) for order in (1, 2, 3)}
    for r in packed.where(F.col("kind") == STATS).select("counts").collect():  # three rows for each shard
        order, *numbers = _unplanes(pa.py_buffer(bytes(r.counts)), np.int64)
        sums[int(order)] += np.array(numbers)
    model.discount = {order: discounts(x[:4]) for order, x in sums.items()}
    n1, n2, _, _, more, model.preceded = (int(x) for x in sums[1])
    model.left = float(model.discount[1][1:] @ np.array([n1, n2, more]) / model.preceded) if model.preceded else 1.0


def fit(documents: DataFrame, where: Column | None = None, shards: int | None = None) -> Model:
    """Counts the texts of documents (of the rows where `where` holds) into a new model, in shards of SHARD_BYTES of text at most."""
    spark = lean(documents.sparkSession)
    docs = documents.where(where) if where is not None else documents
    docs = docs.select(F.col("text").cast("string").alias("text"))
    folder = mounted(spark, "kneser")
    os.makedirs(folder, exist_ok=True)
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(partitions(spark), -(-size // SHARD_BYTES))
    model = _words(docs, folder, shards)
    if model.types:
        _grams(docs, model)
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch):
                n, known, base, full = model.score(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.total), pa.int64()), pa.array(base), pa.array(full)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    lean(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(work, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def run(spark, sf_dir: str) -> DataFrame:
    """The scores are a table in the shared folder, so the model, which is larger than the texts, can go."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(grams.fold("doc_id", 7) == 2, F.lit(False))
    model = fit(documents, ~held)
    found = stored(score(documents, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"), "scores")
    model.remove()
    return found
