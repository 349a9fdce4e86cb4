"""N-gram Jaccard self-join by parity sketches.

A document is its set of distinct word shingles. In each size band a set has a bit
sketch: every shingle toggles (XOR) one bit, so shingles that two sets share cancel in
the XOR of their sketches and the Hamming distance is at most the symmetric difference.
Sets with Jaccard similarity s or more differ in at most (|A|+|B|)(1-s)/(1+s) shingles.
The sketch is cut into more blocks than that, so by the pigeonhole principle some block
is equal in both. Blocks (through a 64-bit signature of their bits, which is itself a
XOR over the shingles) are the join keys.

A set takes part in its own band and, where its partners can be in it, in the next one;
two sets meet in the band of the larger. It sends its first D + T non-empty blocks,
D being the most by which a partner can differ, so at least T of the keys of a
similar pair are equal (all blocks, empty ones too, where too few are filled).

1. Copies: equal sets are one class, found by a 128-bit sum over the set.
2. Hubs: in each bucket of equal keys every set is paired with the smallest doc_id; of
   its hubs a set is verified against the one with which it shares most keys. Links give
   first components.
3. Rest: buckets that still hold several components give the pairs across them. In
   buckets of up to LARGE members all such pairs are counted, and those with too few equal
   keys go (a similar pair has T, less those that can be in larger buckets). A set with
   fewer than T larger buckets meets its partners in the small ones; the others are
   compared within the larger buckets, tile by tile, by the Hamming distance of parity
   sketches of two bits or more a shingle: first each set is verified against the CLOSEST
   sets of other components, which joins almost all that belongs together, then all pairs
   that are still in different components and near enough. What is left is verified on the
   sets, so no link that could join two components is missed.

Keys that are frequent within one task of the first step are dealt over the shards by
task, with their smallest doc_id in the key's own shard, so a bucket's hubs form a tree
and no shard gets the whole of a hot bucket. The number of shards follows the number of
shingles. The buckets of one hub are dealt to as many places as it has PLACE_ROWS rows in
them, so that a large group isn't one task's however it grows, and a pair that meets in
many buckets of a hub still is given once for each place at most.

Defined results: null, empty and blank texts have no shingles and link with nothing.
Rows that repeat a doc_id are one document, which links by the texts of all of them; each
row is returned with its own n_shingles. doc_id must not be null (such rows are returned
unlinked). Ties: a component's id is its smallest doc_id, a hub is the smallest of its
bucket, and of pairs equally close all are tried. A very long text's set is held whole by
one task, some 150 bytes for each of its words while it is made. Other columns aren't
read, so none can clash; `keep` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textvec as tv
from tidemark.llm.components import stars
from tidemark.llm.session import discard, fresh, lean, named, partitions, stored

WORDS = 5
NUM, DEN = 80, 100
RATIO = 1.6
BLOCKS = 1.8
SPARE = 0.1
HOT = 64
LARGE = 8
TILE = 1024
CLOSEST = 2
SLOTS = 1 << 21
FEWER = 1 << 30  # marks a set that has too few blocks to promise the T keys of its band
FLUSH = 1_000_000
SEEN = 200_000
KEYS = 1_000_000
PLACE_ROWS = 8192
PAIR_WORDS = 1 << 21  # of sketches, compared at once
_C = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


class Bands:
    """Sizes and block counts of the bands, for a similarity of num/den."""

    def __init__(self, num: int = NUM, den: int = DEN):
        self.s = Fraction(num, den)
        self.lo = [1]

    def _grow(self, n: int) -> None:
        while self.lo[-1] <= n * 4:
            self.lo.append(max(self.lo[-1] + 1, int(self.lo[-1] * RATIO)))

    def differ(self, a: int, b: int) -> int:
        """The most shingles in which similar sets of these sizes can differ."""
        return int((a + b) * (1 - self.s) / (1 + self.s))

    def of(self, n: int) -> list[tuple[int, int, int, int]]:
        """(band, blocks, the most by which a partner met there can differ, equal keys wanted of a pair) for each band that a set of n shingles takes part in."""
        self._grow(n)
        own = int(np.searchsorted(self.lo, n, "right")) - 1
        most = int(n / self.s)  # the largest partner
        out = []
        for band in (own, own + 1):
            if self.lo[band] <= most or band == own:
                high = self.lo[band + 1] - 1
                widest = self.differ(high, high)
                out.append((band, 4 + int(widest * BLOCKS), self.differ(n, min(high, most)), 1 + int(self.lo[band] * SPARE)))
        return out


def keys_of(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of a set (sorted distinct hashes), their lowest byte the band, and for each how many keys of the band a similar set has at least."""
    out, least = [], []
    n = len(s)
    for band, blocks, differ, wanted in bands.of(n):
        block = ((s >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # ascends with s
        begin = np.flatnonzero(np.diff(block, prepend=np.uint64(1 << 63)))
        filled = block[begin]
        parity = np.bitwise_xor.reduceat(tv.mix(s * _C[2]), begin)
        spare = min(len(filled) - differ, wanted)
        if spare >= 1:
            filled, parity = filled[: differ + spare], parity[: differ + spare]
        else:
            every = np.zeros(blocks, np.uint64)
            every[filled.astype(np.int64)] = parity
            filled, parity, spare = np.arange(blocks, dtype=np.uint64), every, 1
        key = tv.mix(parity ^ tv.mix(filled * _C[3] + np.uint64((band + 1) * int(_C[1]) % (1 << 64))))
        out.append((key & ~np.uint64(255)) | np.uint64(band))
        least.append(np.full(len(key), spare if spare >= wanted else spare | FEWER, np.uint32))
    return np.concatenate(out), np.concatenate(least)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    h, bounds = tv.words(batch.column(1))
    for i, doc in enumerate(batch.column(0).to_pylist()):
        yield doc, tv.shingles(h[bounds[i] : bounds[i + 1]], k)


def _print(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit sum over a set, as two signed numbers."""
    return tuple(int(np.add.reduce(tv.mix(s ^ c)).astype(np.int64)) for c in _C[:2])


def _docs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketch(s: np.ndarray) -> bytes:
    """Parity bits of a set, a power of two of them and at least two a shingle."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    at = np.bincount((tv.mix(s ^ _C[3]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(at.astype(bool), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all as long as the shortest: halves are XORed, as if there had been fewer bits."""
    words = min(len(x) for x in sketches) // 8
    out = np.empty((len(sketches), words), np.uint64)
    for i, x in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, words), axis=0)
    return out


def sizes(documents: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n (set size), the 128-bit print f, g and the parity sketch of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch):
                rows = [(doc, len(s), *_print(s), sketch(s) if len(s) else b"") for doc, s in _sets(part, k)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i == 4 else pa.int64()) for i, x in enumerate(zip(*rows, strict=True))], names=["doc_id", "n", "f", "g", "sketch"])

    return _docs(documents).mapInArrow(work, "doc_id long, n long, f long, g long, sketch binary")


def _packed(documents: DataFrame, k: int, shards: int, num: int, den: int) -> DataFrame:
    """Keys of all sets, dealt to shards as packed arrays; of equal sets in one task only the first sends any (as far as SEEN sets are remembered)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(num, den), set()
        task = np.uint64(TaskContext.get().partitionId() if TaskContext.get() else 0)
        held: list[tuple[np.ndarray, int, np.ndarray]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([x for x, _, _ in held])
            n = [len(x) for x, _, _ in held]
            docs, least = np.repeat(np.array([d for _, d, _ in held], np.int64), n), np.concatenate([t for _, _, t in held])
            shard = (keys % np.uint64(shards)).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            begin = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
            size = np.diff(begin, append=len(order))
            for b, z in zip(begin[size > HOT].tolist(), size[size > HOT].tolist(), strict=True):
                own = order[b : b + z]
                own = own[np.argsort(docs[own], kind="stable")]
                shard[own[1:]] = int(tv.mix(keys[own[:1]] + np.uint64((int(task) + 1) * int(_C[0]) % (1 << 64)))[0] % np.uint64(shards))
                keys, docs, least = np.append(keys, keys[own[0]]), np.append(docs, docs[own[0]]), np.append(least, least[own[0]])
                shard = np.append(shard, shard[own[1]])
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cut))
            pack = lambda x: pa.array([x[order[cut[i] : cut[i + 1]]].tobytes() for i in full], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pack(keys), pack(docs), pack(least)], names=["shard", "keys", "docs", "least"])

        for batch in batches:
            for part in tv.slices(batch):
                for doc, s in _sets(part, k):
                    if not len(s) or doc is None or (p := (len(s), *_print(s))) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(p)
                    keys, least = keys_of(s, bands)
                    held.append((keys, doc, least))
                    count += len(keys)
                if count > FLUSH:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    return _docs(documents).mapInArrow(work, "shard int, keys binary, docs binary, least binary")


def _buckets(packed: DataFrame, shards: int) -> DataFrame:
    """kind 0: (a, b) a hub and a member of its bucket, `c` equal keys, `t` needed at least; kind 1: `a` is a member of bucket `key`, needing `t`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.frombuffer(x, t) for b in ([*map(bytes, batch.column(c).to_pylist())],) for x in b] for batch in batches for c, t in ((1, np.uint64), (2, np.int64), (3, np.uint32))]
        if not got:
            return
        keys, docs, least = (np.concatenate([x for part in got[i::3] for x in part]) for i in range(3))
        order = np.lexsort((docs, keys))
        keys, docs, least = keys[order], docs[order], least[order]
        new = np.empty(len(keys), bool)
        new[0] = True
        new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        keys, docs, least = keys[new], docs[new], least[new]
        begin = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        size = np.diff(begin, append=len(keys))
        many = np.repeat(size > 1, size)
        hub, need = np.repeat(docs[begin], size)[many], np.minimum(np.repeat(least[begin], size)[many] % FEWER, least[many] % FEWER)
        keys, docs, least = keys[many], docs[many], least[many]
        other = hub != docs
        # Hubs are only where to begin: of sets with many keys an eighth stands for all, so the rows don't grow with the shards.
        weight = np.where(need < 8, 1, 8)
        other &= (weight == 1) | ((keys >> np.uint64(8)) % np.uint64(8) == 0)
        a, b, t, weight = hub[other], docs[other], need[other], weight[other]
        order = np.lexsort((b, a))
        a, b, t, weight = a[order], b[order], t[order], weight[order]
        first = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0)) if len(a) else np.empty(0, np.int64)
        c = np.add.reduceat(weight, first) if len(first) else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(first), np.int8)), pa.nulls(len(first), pa.int64()), pa.array(a[first]), pa.array(b[first]), pa.array(c.astype(np.int32)), pa.array(t[first].astype(np.int32))], names=["kind", "key", "a", "b", "c", "t"])
        del got, order, new, hub, need, other, weight, a, b, c, t, first, many, size, begin
        x = None
        for at in range(0, len(keys), 20_000):
            x = slice(at, at + 20_000)
            m = len(keys[x])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), pa.array(keys[x].astype(np.int64)), pa.array(docs[x]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array(least[x].astype(np.int32))], names=["kind", "key", "a", "b", "c", "t"])
        del keys, docs, least, x
        tv.release()

    return packed.repartition(shards, "shard").mapInArrow(work, "kind byte, key long, a long, b long, c int, t int")


def _sieve(ids: DataFrame) -> np.ndarray:
    """A bit for each of SLOTS hashes, set where some doc_id has it: what is left out of a shuffle by it is surely not needed. Its size is fixed; on large inputs it fills up and lets more pass."""
    bits = np.zeros(SLOTS, bool)
    found = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow()
    bits[found.column(0).to_numpy()] = True
    return np.packbits(bits)


def _verified(pairs: DataFrame, documents: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough, by the sets themselves."""
    needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    sieve = _sieve(needed)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(sieve).astype(bool)
        for batch in batches:
            kept = batch.filter(pa.array(bits[np.asarray(batch.column(2))]))
            for part in tv.slices(kept):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for _, s in _sets(part, k)], pa.binary())], names=["doc_id", "s"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int").alias("slot")
    sets = _docs(documents).where("doc_id IS NOT NULL").select("doc_id", "text", slot).mapInArrow(build, "doc_id long, s binary")
    with_a = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a")
    both = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(test, "a long, b long")


def _mapped(df: DataFrame, column: str, table: DataFrame, node: str, to: str) -> DataFrame:
    """df with `column` replaced by what `table` maps it to, where it does."""
    t = table.select(F.col(node).alias(column), F.col(to).alias("_to"))
    return df.join(t, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def _near(rows: DataFrame, parts: int, num: int, den: int, closest: bool = False) -> DataFrame:
    """Pairs (a, b) of different components within a bucket whose sketches allow them to be similar, and the sketches' distance d.

    rows: key, size, hub (smallest a), places (of the hub), a, component, n, sketch. closest: of each a only its closest b of a
    bucket; otherwise a < b. A hub's buckets are dealt over its places; a task doesn't repeat a pair that it has given.
    """
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    tiled = rows.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("a"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    grouped = tiled.select(F.concat_ws("-", "key", low, high).alias("grp"), F.xxhash64("hub", low, high, F.pmod(F.shiftright("key", 8), F.col("places"))).alias("place"), "own", "other", "a", "component", "n", "sketch")

    def pairs(table: pa.Table) -> pa.RecordBatch:
        own, other, a, component, n = (np.asarray(table.column(c)) for c in ("own", "other", "a", "component", "n"))
        words = folded(table.column("sketch").to_pylist())
        left, right = np.flatnonzero(own <= other), np.flatnonzero(own >= other)
        out = []
        for x, y in ((left, right), (right, left)) if closest and not np.array_equal(left, right) else ((left, right),):
            step = max(1, min(128, PAIR_WORDS // max(1, len(y) * words.shape[1])))
            for at in range(0, len(x), step):
                i = x[at : at + step]
                apart = component[i][:, None] != component[y]
                if not apart.any():
                    continue
                total = n[i][:, None] + n[y]
                distance = np.bitwise_count(words[i][:, None, :] ^ words[y][None, :, :]).sum(axis=2, dtype=np.int64)
                close = den * np.minimum(n[i][:, None], n[y]) >= num * np.maximum(n[i][:, None], n[y])
                distance[~(apart & close & (distance * (den + num) <= total * (den - num)))] = 1 << 40
                if closest:
                    q = distance.argmin(axis=1)
                    p = np.flatnonzero(distance[np.arange(len(i)), q] < 1 << 40)
                    q = q[p]
                else:
                    p, q = np.nonzero(distance < 1 << 40)
                out.append(np.stack([a[i[p]], a[y[q]], distance[p, q]]))
        x = np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)
        if not closest:
            x = np.stack([x[:2].min(axis=0), x[:2].max(axis=0), x[2]])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["a", "b", "d"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seen: set[tuple[int, int]] = set()

        def done() -> pa.RecordBatch:
            got = pairs(pa.Table.from_batches(held))
            new = [i for i, x in enumerate(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True)) if x not in seen and not seen.add(x)]
            if len(seen) > 200_000:
                seen.clear()
            return got.take(pa.array(new, pa.int64()))

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0)
            change = np.flatnonzero(np.asarray(pc.not_equal(names[1:], names[:-1]))) + 1
            for x, y in zip([0, *change], [*change, batch.num_rows], strict=True):
                if held and held[-1].column(0)[0] != names[int(x)]:
                    yield done()
                    held = []
                held.append(batch.slice(x, y - x))
        if held:
            yield done()
        tv.release()

    return grouped.repartition(parts, "place").sortWithinPartitions("grp").mapInArrow(work, "a long, b long, d long")


def join(documents: DataFrame, k: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id for each row; links are pairs with 100 * intersection >= 100 * num/den * union."""
    spark = lean(documents.sparkSession)
    made: list[DataFrame] = []  # tables that aren't needed any more at the end

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    docs = stored(sizes(documents, k), "sizes")
    some = docs.where("n > 0 AND doc_id IS NOT NULL")
    shards = max(partitions(spark), -(-(some.agg(F.sum("n")).first()[0] or 0) // KEYS))
    classes = some.groupBy("n", "f", "g").agg(F.min("doc_id").alias("rep"))
    # Of each row its class representative; only rows that aren't one themselves are kept.
    copies = stored(some.join(classes, ["n", "f", "g"]).where("doc_id <> rep").select("doc_id", "rep").distinct(), "copies")
    found = stored(_buckets(_packed(documents, k, shards, num, den), shards), "buckets")
    hubs = found.where("kind = 0").groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("t").alias("t")).where("c >= t")
    hubs = hubs.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    hubs = _mapped(_mapped(hubs, "a", copies, "doc_id", "rep"), "b", copies, "doc_id", "rep").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = kept(_verified(kept(hubs, "pairs"), documents, k, num, den), "links")
    made.append(first := stars(links))

    members = kept(_mapped(found.where("kind = 1").select("key", "a", "t"), "a", copies, "doc_id", "rep").groupBy("key", "a").agg(F.min("t").alias("t")), "members")
    discard(spark, found)
    sketches = some.groupBy("doc_id").agg(F.max_by("sketch", "n").alias("sketch"), F.max("n").alias("n")).withColumnRenamed("doc_id", "a")

    def still_open(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of the buckets with several components, with the number of large ones among their buckets of the band; and the places of the hubs that need several."""
        own = members.join(parts.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
        keys = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"), F.max("t").alias("_t"), F.min("a").alias("hub")).where("lo <> hi")
        rest = own.join(keys.select("key", "size", "hub", (F.col("_t") >= FEWER).alias("fewer")), "key")
        rest = kept(rest.withColumn("t", F.col("t") % FEWER).withColumn("band", F.pmod("key", F.lit(256)).cast("int")), "rest")
        large = rest.where(F.col("size") > LARGE).groupBy("a", "band").agg(F.count(F.lit(1)).alias("large"))
        places = rest.where(F.col("size") > LARGE).groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / PLACE_ROWS).alias("places")).where("places > 1")
        return rest.join(large, ["a", "band"], "left").withColumn("large", F.coalesce("large", F.lit(0))), places

    def within_large(rest: DataFrame, places: DataFrame, closest: bool) -> DataFrame:
        wide = rest.where((F.col("size") > LARGE) & (F.col("fewer") | (F.col("large") >= F.col("t"))))
        wide = wide.join(places, "hub", "left").withColumn("places", F.coalesce("places", F.lit(1))).join(sketches, "a")
        return _near(wide.select("key", "size", "hub", "places", "a", "component", "n", "sketch"), shards, num, den, closest)

    def grown(parts: DataFrame, links: DataFrame) -> DataFrame:
        if links.isEmpty():
            return parts
        made.append(out := stars(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)))
        return out

    best = within_large(*still_open(first), True).groupBy("a").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "b"))), 1, CLOSEST).alias("best")).select("a", F.explode("best.b").alias("b"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = grown(first, kept(_verified(kept(best, "pairs"), documents, k, num, den), "links"))

    rest, places = still_open(second)
    x, y = (rest.where(F.col("size") <= LARGE).select("key", "band", *(F.col(c).alias(f"{c}{i}") for c in ("a", "t", "component", "large"))) for i in (1, 2))
    counted = x.join(y.drop("band"), "key").where("a1 < a2 AND component1 <> component2").groupBy(F.col("a1").alias("a"), F.col("a2").alias("b"), "band").agg(F.count(F.lit(1)).alias("c"), F.min(F.expr("least(t1, t2) - least(large1, large2)")).alias("t"))
    across = counted.where("c >= t").select("a", "b").unionByName(within_large(rest, places, False).select("a", "b")).distinct()
    final = grown(second, kept(_verified(kept(across, "pairs"), documents, k, num, den), "links"))
    for table in made:
        if table is not final:
            discard(spark, table)
    out = _mapped(docs.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")), "component_id", copies, "doc_id", "rep")
    return _mapped(out, "component_id", final, "node", "component").select("doc_id", "n_shingles", "component_id")


def run(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep(spark, docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component; unlinked documents all stay.

    Of rows equal in doc_id and text one stays, the one with the smallest hash of all its columns; rows that give a kept doc_id
    another text stay, too, as no text is a copy of them. Rows without a doc_id all stay.
    """
    chosen = join(docs).where("doc_id = component_id").select("doc_id").distinct()
    ours = docs.where(F.col("doc_id").isNotNull()).join(chosen, "doc_id", "left_semi")
    name = fresh(docs.columns, "others")
    others = named(docs, ("doc_id", "text"))
    one = ours.groupBy("doc_id", "text").agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias(name)) if others else ours.dropDuplicates()
    columns = [x if c in ("doc_id", "text") else F.col(name)[c].alias(c) for c, x in zip(docs.columns, named(docs), strict=True)]
    return one.select(*columns).unionByName(docs.where(F.col("doc_id").isNull()))
