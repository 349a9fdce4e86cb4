"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Rotations are learned, each from another start, on a bounded sample of vectors (SAMPLE; it
only shapes the codes, every row is indexed): vectors are centred, then rotation and binary
codes are improved in turn (iterative quantisation), which gives balanced bits. The bits of
all rotations make a vector's code, and its code is cut into chunks; each chunk is the key
of one Hamming table. A chunk has about as many bits as leave BUCKET vectors to a key. There
are as many tables, and rotations to make them, as it takes until, of pairs made from the
sample that are just as similar as asked for, the share TARGET shares a key; where TABLES
don't reach that, chunks get shorter, in the end so short that all pairs are compared. So
recall doesn't depend on how the vectors are spread.

Equal vectors are one class with a weight. Tables hold ids and codes only. Within a bucket
pairs whose whole codes are near enough (SURE of the sample's pairs are) make their two
vectors members of that bucket's comparison; members alone are sent with their original
components, and compared in double precision. A pair is counted in the first table where
its chunks are equal, so nothing has to be made distinct. Only each vector's number of
links and one edge to its part of the bucket leave a task. A bucket of more than TILE
vectors is split into tiles, each pair of tiles a group of its own.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, nor do vectors of different lengths (each length has codes of
its own). Rows with a null vec_id are returned unlinked and take part in nothing. Rows that
repeat a vec_id are vectors of their own, each with its own number of links, and share the
component. Ties: a component's id is its smallest vec_id. Other columns aren't read, so
none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import whole_groups
from tidemark.llm.components import components
from tidemark.llm.session import discard, lean, partitions, stored

SAMPLE = 4000
ROUNDS = 30
TABLES = 256
WIDTH = 256
BUCKET = 64
WIDEST = 24
TARGET = 0.985
SURE = 0.999
TILE = 1024
PAIR_BYTES = 8 << 20
THRESHOLD = 0.95


def _bits(count: int) -> int:
    """Bits that leave about BUCKET of so many vectors to a key."""
    return max(0, min(WIDEST, int(np.log2(max(1, count / BUCKET)))))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Centre and rotations for vectors of one length, how their bits are cut into tables, and how far apart the codes of similar vectors are at most."""

    def __init__(self, sample: np.ndarray, count: int, threshold: float = THRESHOLD, seed: int = 3):
        self.chunk, self.tables, self.apart = _bits(count), 1, 0
        if not self.chunk:
            return
        rng = np.random.default_rng(seed)
        x = _unit(sample)
        near = self._similar(x, threshold, rng)
        self.centre = x.mean(axis=0)
        self.rotations: list[np.ndarray] = []
        while self.chunk and not self._enough(x, near, rng):
            self.chunk -= min(2, self.chunk)
        if self.chunk:
            apart = np.bitwise_count(self.codes(x) ^ self.codes(near)).sum(axis=1, dtype=np.int64)
            self.apart = int(np.quantile(apart, SURE)) + 2

    def _enough(self, x: np.ndarray, near: np.ndarray, rng: np.random.Generator) -> bool:
        """Sets the number of tables that find the share TARGET of pairs, and adds the rotations that they need; false if TABLES don't."""
        while True:
            self.tables = min(TABLES, sum(r.shape[1] for r in self.rotations) // self.chunk)
            if self.tables:
                met = np.logical_or.accumulate(self.codes(x) == self.codes(near), axis=1).mean(axis=0)
                if met[-1] >= TARGET:
                    self.tables = int(np.argmax(met >= TARGET)) + 1
                    return True
                if self.tables == TABLES:
                    self.tables = 1
                    return False
            self.rotations.append(self._rotation(x - self.centre, rng))

    @staticmethod
    def _similar(x: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
        """For each vector one whose cosine with it is the threshold: half of them away into any direction, half into that of another vector of the sample."""
        away = rng.normal(size=x.shape)
        other = x[rng.permutation(len(x))] - x
        away[::2] = np.where(np.linalg.norm(other, axis=1, keepdims=True) > 1e-9, other, away)[::2]
        away -= (away * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(away, axis=1, keepdims=True)
        return _unit(threshold * x + np.sqrt(1 - threshold**2) * np.where(size > 1e-12, away / np.maximum(size, 1e-12), 0))

    @staticmethod
    def _rotation(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Of long vectors to WIDTH dimensions."""
        d = x.shape[1]
        r = np.linalg.qr(rng.normal(size=(d, min(d, WIDTH))))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0), full_matrices=False)
            r = u @ v
        return r

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Rows by tables of numbers, the chunks of unit vectors."""
        kind = np.uint16 if self.chunk <= 16 else np.uint32
        if not self.chunk:
            return np.zeros((len(x), 1), kind)
        bits = np.concatenate([(x - self.centre) @ r >= 0 for r in self.rotations], axis=1)[:, : self.tables * self.chunk]
        return bits.reshape(len(x), self.tables, self.chunk) @ (1 << np.arange(self.chunk)).astype(kind)


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and components (in proportion) of the usable vectors of this length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    rows = np.flatnonzero(length == size)
    flat = column.take(pa.array(rows)).flatten()
    x = np.asarray(pc.fill_null(flat.cast(pa.float64()), np.nan), np.float64).reshape(-1, size)
    most = np.abs(x).max(axis=1)
    ok = np.isfinite(most) & (most > 0)
    return rows[ok], x[ok] / most[ok, None]  # so that no norm overflows


def _within(bucket: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with the same number, which ascends, about `most` at once."""
    begin = np.flatnonzero(np.diff(bucket, prepend=~bucket[:1]))
    end = np.repeat(np.append(begin[1:], len(bucket)), np.diff(begin, append=len(bucket)))
    after = end - np.arange(len(bucket)) - 1
    done = np.cumsum(after)
    at = 0
    while at < len(bucket):
        to = max(at + 1, int(np.searchsorted(done, (done[at] - after[at]) + most, "right")))
        n = after[at:to]
        p = np.repeat(np.arange(at, to), n)
        yield p, p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _compare(ids: np.ndarray, weight: np.ndarray, codes: np.ndarray, x: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of one group: numbers, weights of the links counted here, and the smallest id of their part (ids may repeat). left and right: rows of the two tiles (the same for a tile by itself)."""
    n = len(ids)
    links = np.zeros(n, np.int64)
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    same = np.array_equal(a, b)
    edges = []
    for at in range(0, len(a), 512):
        i = a[at : at + 512]
        p, q = np.nonzero(x[i] @ x[b].T >= threshold)
        p, q = i[p], b[q]
        keep = p != q
        p, q = p[keep], q[keep]
        if table:
            keep = ~(codes[p, :table] == codes[q, :table]).any(axis=1)
            p, q = p[keep], q[keep]
        np.add.at(links, p, weight[q])
        if not same:
            np.add.at(links, q, weight[p])
        edges.append((p, q))
    p, q = (np.concatenate(z) for z in zip(*edges, strict=True)) if edges else (np.empty(0, int), np.empty(0, int))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    low = rank.copy()
    while len(p):
        new = low.copy()
        np.minimum.at(new, p, low[q])
        np.minimum.at(new, q, low[p])
        new = np.minimum(new, new[order[new]])
        if (new == low).all():
            break
        low = new
    root = ids[order[low]]
    linked = np.unique(np.concatenate([p, q]))
    return linked, links[linked], root[linked]


def models(classes: DataFrame, threshold: float) -> dict[int, Codes]:
    """Codes of each length, from at most SAMPLE vectors of each (of all, where there are few lengths) by a hash of the vectors, so that ids have no part in it."""
    counts = {r.size: r["count"] for r in classes.groupBy("size").count().collect()}  # a row for each length
    each = max(64, SAMPLE // max(1, len(counts)))
    out = {}
    for size, count in sorted(counts.items()):
        if not _bits(count):  # one key for all
            out[size] = Codes(np.empty((0, size)), count)
            continue
        own = classes.where(F.col("size") == size)
        share = min(1.0, 3 * each / count)  # few enough rows to sort
        picked = own.where(F.pmod("f", F.lit(1 << 40)) < int(share * (1 << 40))) if count > 4 * each else own
        sample = _matrix(picked.orderBy("g", "f").limit(each).select("v").toArrow().column("v"), size)[1]
        if not len(sample):
            raise ValueError(f"no sample of {count} vectors of length {size}")  # thousands are expected; without codes their links would be lost
        out[size] = Codes(sample, count, threshold)
    return out


def _classes(rows: DataFrame) -> DataFrame:
    """cls (a number), rep (the smallest vec_id, which other classes may have, too), weight (rows), size and v of each distinct vector; f, g: a hash of it."""
    found = rows.groupBy("f", "g").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.max("size").alias("size"), F.first("v").alias("v"))
    return found.withColumn("cls", F.monotonically_increasing_id())


def links(embeddings: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    spark = lean(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"))
    usable = F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.select("vec_id", "v", F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64("v").alias("f"), F.xxhash64(F.lit(7), "v").alias("g"), F.size("v").alias("size"))
    classes = stored(_classes(rows.where("usable")), "classes")
    found = _found(classes, models(classes, threshold), threshold, partitions(spark))
    nodes = stored(rows.select("vec_id", F.when(F.col("usable"), F.col("f")).alias("f"), F.when(F.col("usable"), F.col("g")).alias("g")).join(classes.select("f", "g", "cls", "rep", "weight"), ["f", "g"], "left").select("vec_id", "cls", "rep", "weight"), "nodes")
    # Classes that rows of one vec_id belong to are one component.
    shared = nodes.where("rep IS NOT NULL").groupBy("vec_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    bridges = nodes.join(shared, "vec_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(bridges))
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    joined = nodes.join(counts, "cls", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return joined.select("vec_id", F.coalesce(F.coalesce("n", F.lit(0)) + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _found(classes: DataFrame, known: dict[int, Codes], threshold: float, parts: int) -> DataFrame:
    """(cls, rep, n, root): weights of the links counted in one group of one bucket, and the smallest rep of the part."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                for size in np.unique(np.asarray(part.column(1))).tolist():
                    own, x = _matrix(part.column(2), size)
                    c = known[size].codes(_unit(x))
                    keys = (np.int64(size) << 34) | (np.arange(c.shape[1], dtype=np.int64) << 24) | c.astype(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]), pa.array(keys.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array([r.tobytes() for r in c], pa.binary()), lists], names=["cls", "code", "buckets"])

    coded = stored(classes.select("cls", "size", "v").mapInArrow(index, "cls long, code binary, buckets array<long>"), "codes")
    entries = coded.select("cls", "code", F.explode("buckets").alias("bucket"))
    hot = entries.groupBy("bucket").count().where(F.col("count") > TILE).select("bucket", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    tiles = F.coalesce("tiles", F.lit(1))
    tiled = entries.join(hot, "bucket", "left").withColumn("own", F.pmod(F.xxhash64("cls"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    dealt = tiled.select("bucket", low, high, "own", "cls", "code").repartition(parts, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    apart, kinds = ({size: f(codes) for size, codes in known.items()} for f in (lambda c: c.apart, lambda c: np.uint16 if c.chunk <= 16 else np.uint32))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that some other row of their group is near enough to by its code, in the first table where the two meet."""
        for table in whole_groups(batches, 3):
            bucket, low, high, own = (np.asarray(table.column(i)) for i in range(4))
            group = np.cumsum(np.any([np.diff(x, prepend=x[:1]) != 0 for x in (bucket, low, high)], axis=0))
            size, at = bucket >> 34, (bucket >> 24) & 1023
            code = table.column(5).to_pylist()
            hit = np.zeros(len(bucket), bool)
            for d in np.unique(size).tolist():
                mine = np.flatnonzero(size == d)
                c = np.frombuffer(b"".join(code[i] for i in mine.tolist()), kinds[d]).reshape(len(mine), -1)
                for p, q in _within(group[mine], PAIR_BYTES // c[0].nbytes):
                    a, b = mine[p], mine[q]
                    ok = np.flatnonzero((own[a] != own[b]) | (low[a] == high[a]))  # of two tiles only pairs across
                    p, q = p[ok], q[ok]
                    ok = np.flatnonzero(np.bitwise_count(c[p] ^ c[q]).sum(axis=1, dtype=np.int64) <= apart[d])
                    p, q = p[ok], q[ok]
                    ok = (c[p] == c[q]).argmax(axis=1) == at[mine[p]]
                    hit[mine[p[ok]]] = True
                    hit[mine[q[ok]]] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([table.column(i).combine_chunks().filter(pa.array(hit)) for i in range(5)], names=["bucket", "low", "high", "own", "cls"])

    near = stored(dealt.mapInArrow(members, "bucket long, low int, high int, own int, cls long"), "members")
    sent = near.join(coded.select("cls", "code"), "cls").join(classes.select("cls", "rep", "weight", "v"), "cls")
    sent = sent.select("bucket", "low", "high", "own", "rep", "code", "weight", "v", "cls").repartition(parts, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3, alone=True):
            bucket, low, high = (table.column(i)[0].as_py() for i in range(3))
            rows, x = _matrix(table.column(7), bucket >> 34)
            table = table.take(pa.array(rows))
            own, ids, weight = (np.asarray(table.column(i)) for i in (3, 4, 6))
            code = np.frombuffer(b"".join(table.column(5).to_pylist()), kinds[bucket >> 34]).reshape(len(ids), -1)
            who, count, root = _compare(ids, weight, code, _unit(x), (bucket >> 24) & 1023, own == low, own == high, threshold)
            if len(who):
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(table.column(8))[who]), pa.array(ids[who]), pa.array(count), pa.array(root)], names=["cls", "rep", "n", "root"])

    out = stored(sent.mapInArrow(compare, "cls long, rep long, n long, root long"), "links")
    for table in (near, coded):
        discard(classes.sparkSession, table)
    return out


def run(spark, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
