"""Vector code compression: integer codebooks a part position, nearest entries by ball trees.

Vectors become integers (floor(1024 * x)) and are cut into PARTS equal parts. Each round
assigns every part to the nearest entry of its position's codebook and moves the entries
to their parts' floored means: a task adds up what it assigned, Spark adds up the tasks'
sums by part and entry, and the driver sees the ENTRIES new entries of each part only.

The nearest entry is found by metric branch-and-bound in a ball tree of the entries,
which each task builds anew: a ball is an entry with a radius that reaches all entries
below it. All queries of a batch walk the tree together, each its nearer ball first. Radii
are rounded up and lower bounds down; a ball is visited wherever its bound is not above
the best distance, so equally near entries of lower index are met; and what counts in a
leaf are exact integer distances.

Defined results: rows whose vector is null or holds null or non-finite components are
dropped. The codebooks start from the smallest vec_ids, a null vec_id counting as the largest and
equal ones ordered by vector; fewer rows than ENTRIES make as many entries. Rows that
repeat a vec_id are vectors of their own. Vectors of another length than the first entry's,
or all, if that isn't a multiple of PARTS, have null as code and error. Components of any size are
exact (in arbitrary precision beyond 64 bits, row by row); an error above 2^63 - 1 is
given as that. An empty table gives no rows. No column but vec_id, the vector and the
label is read, so none can clash.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textvec as tv
from tidemark.llm.session import lean, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LEAF = 16
#: Rows that walk a tree together.
BATCH = 8192
#: By how much rounding can move a distance, with room to spare.
SLACK = 1e-12
_MOST = (1 << 63) - 1


def _float(x: np.ndarray) -> np.ndarray:
    """As doubles, infinite where there is none."""
    if x.dtype != object:
        return x.astype(np.float64)
    return np.array([float(v) if v < 1 << 1000 else np.inf for v in x.ravel().tolist()]).reshape(x.shape)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def _whole(x: np.ndarray) -> bool:
    """Whether all sums that make up squared distances of such vectors are below 2^53, and so are exact in doubles, too."""
    return x.dtype != object and x.shape[-1] * (2 * int(np.abs(x).max(initial=0))) ** 2 < 1 << 53


class Ball:
    """A centre that is an entry, a radius, and either two balls or the entries themselves."""

    def __init__(self, entries: np.ndarray, members: np.ndarray):
        self.members = members
        mine = entries[members]
        middle = mine[np.argmin(_float(_squares(mine, mine.sum(axis=0) // len(mine))))]
        self.centre, away = middle, _squares(mine, middle)
        self.radius = float(np.sqrt(_float(away)).max()) * (1 + SLACK)
        self.balls: list[Ball] = []
        if len(members) > LEAF:
            a = mine[np.argmax(away)]
            to_a = _squares(mine, a)
            order = np.argsort(to_a - _squares(mine, mine[np.argmax(to_a)]), kind="stable")  # halves, so that the tree is no deeper than it must be
            self.balls = [Ball(entries, np.sort(members[half])) for half in (order[: len(order) // 2], order[len(order) // 2 :])]

    def bound(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the centre, and what no distance to an entry inside is below."""
        d = np.sqrt(_float(_squares(q, self.centre)))
        with np.errstate(invalid="ignore"):
            low = d * (1 - SLACK) - self.radius
        return d, np.where(np.isnan(low), -np.inf, low)


class Search:
    """Nearest entries of many queries; `met`: how many distances to entries it took."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.top = Ball(entries, np.arange(len(entries)))
        self.met = 0
        self.whole = _whole(entries)
        self.doubles = entries.astype(np.float64) if self.whole else entries
        self.lengths = (self.doubles**2).sum(axis=1) if self.whole else None

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance, exact; the lower index of equally near ones."""
        self.q, self.at = q, np.full(len(q), -1)
        self.best = np.zeros(len(q), object if q.dtype == object else np.int64)
        self.reach = np.full(len(q), np.inf)
        self.products = self.whole and _whole(q)  # then matrix products give the distances as exactly
        self.q_doubles = q.astype(np.float64) if self.products else q
        self.q_lengths = (self.q_doubles**2).sum(axis=1) if self.products else None
        self._visit(self.top, np.arange(len(q)))
        return self.at, self.best

    def _visit(self, ball: Ball, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if not ball.balls:
            self._leaf(ball.members, rows)
            return
        (near_d, near_low), (far_d, far_low) = (b.bound(self.q[rows]) for b in ball.balls)
        first = near_d <= far_d
        one, two = ball.balls
        self._visit(one, self._open(rows[first], near_low[first]))
        self._visit(two, self._open(rows[~first], far_low[~first]))
        self._visit(two, self._open(rows[first], far_low[first]))
        self._visit(one, self._open(rows[~first], near_low[~first]))

    def _open(self, rows: np.ndarray, low: np.ndarray) -> np.ndarray:
        return rows[low <= self.reach[rows]]

    def _leaf(self, members: np.ndarray, rows: np.ndarray) -> None:
        self.met += len(rows) * len(members)
        if self.products:
            squares = (self.q_lengths[rows, None] + self.lengths[members] - 2 * (self.q_doubles[rows] @ self.doubles[members].T)).astype(np.int64)
        else:
            squares = _squares(self.q[rows][:, None, :], self.entries[members][None])
        k = squares.argmin(axis=1)  # members ascend, so the lowest index of equal ones
        found, index = squares[np.arange(len(rows)), k], members[k]
        at, best = self.at[rows], self.best[rows]
        better = (at < 0) | (found < best) | ((found == best) & (index < at))
        won = rows[better.astype(bool)]
        self.at[won], self.best[won] = index[better.astype(bool)], found[better.astype(bool)]
        self.reach[won] = np.sqrt(_float(self.best[won])) * (1 + SLACK)


def _limit(size: int) -> int:
    """Vectors of this length whose integers are below it have squared distances of 64 bits, by part and in all."""
    return 1 << (61 - 2 - max(1, size).bit_length()) // 2


def integers(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer vectors of the usable vectors of this length: those of 64 bits together, then those of arbitrary precision."""
    length = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    rows = np.flatnonzero(length == size)
    flat = column.take(pa.array(rows)).flatten()
    x = np.asarray(pc.fill_null(flat.cast(pa.float64()), np.nan), np.float64).reshape(len(rows), size)
    ok = np.isfinite(x).all(axis=1)
    rows, x = rows[ok], x[ok]
    small = np.abs(x).max(axis=1, initial=0) < _limit(size) // SCALE
    if small.any():
        yield rows[small], np.floor(x[small] * SCALE).astype(np.int64)
    if not small.all():
        large = [[int(v) * SCALE if abs(v) >= 1 << 53 else int(np.floor(v * SCALE)) for v in r] for r in x[~small].tolist()]
        yield rows[~small], np.array(large, object)


class Books:
    """Codebooks of all part positions: lists of entries of Python integers."""

    def __init__(self, entries: list[list[list[int]]], size: int):
        self.entries, self.size = entries, size
        self.plain = max((abs(v) for part in entries for e in part for v in e), default=0) < _limit(size)
        self._built: dict[bool, list[Search]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_built": {}}  # tasks build their own trees

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by parts: entries and squared distances."""
        exact = x.dtype == object or not self.plain
        if exact not in self._built:
            self._built[exact] = [Search(np.array(part, object if exact else np.int64).reshape(len(part), -1)) for part in self.entries]
        x = x.astype(object) if exact else x
        found = [s.nearest(part) for s, part in zip(self._built[exact], np.split(x, PARTS, axis=1), strict=True)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Books:
        """Each entry replaced by the floored mean of its parts; entries without parts stay."""
        return Books([[[v // sums[p, e][0] for v in sums[p, e][1]] if (p, e) in sums else entry for e, entry in enumerate(part)] for p, part in enumerate(self.entries)], self.size)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for e in part for v in e).encode()).hexdigest()


def _chunks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, BATCH):
        part = batch.slice(at, BATCH)
        for rows, x in integers(part.column(0), size):
            yield part, rows, x


def _round(rows: DataFrame, books: Books) -> Books:
    size, width = books.size, books.size // PARTS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(part), np.int64) for part in books.entries]
        plain = [np.zeros((len(part), width), np.int64) for part in books.entries]
        exact: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for _, _, x in _chunks(batch, size):
                at, _ = books.assign(x)
                for p in range(len(books.entries)):
                    part = x[:, p * width : (p + 1) * width]
                    count[p] += np.bincount(at[:, p], minlength=len(count[p]))
                    if x.dtype != object:
                        np.add.at(plain[p], at[:, p], part)
                        continue
                    for e, v in zip(at[:, p].tolist(), part.tolist(), strict=True):
                        exact[p, e] = [a + b for a, b in zip(exact.get((p, e), [0] * len(v)), v, strict=True)]
        keys = [(p, e) for p, c in enumerate(count) for e in np.flatnonzero(c).tolist()]
        sums = [pickle.dumps([a + b for a, b in zip(plain[p][e].tolist(), exact.get((p, e), [0] * width), strict=True)]) for p, e in keys]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()), pa.array([int(count[p][e]) for p, e in keys], pa.int64()), pa.array(sums, pa.binary())], names=["part", "entry", "n", "sums"])
        tv.release()

    def total(group):
        vectors = [pickle.loads(s) for s in group["sums"]]
        return group.head(1)[["part", "entry"]].assign(n=group["n"].sum(), sums=pickle.dumps([sum(v) for v in zip(*vectors, strict=True)]))

    shape = "part int, entry int, n long, sums binary"
    found = rows.select("v").mapInArrow(add, shape).groupBy("part", "entry").applyInPandas(total, shape).collect()  # a row for each entry
    return books.moved({(r.part, r.entry): (r.n, pickle.loads(r.sums)) for r in found})


def _usable(embeddings: DataFrame, vector: str, label: str) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return rows.where(sound)


def trained(rows: DataFrame, rounds: int = ROUNDS) -> Books:
    """Codebooks of the usable vectors (vec_id, v)."""
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).toArrow()  # the rows that the codebooks start from
    if not first.num_rows:
        return Books([], -1)
    column = first.column("v").combine_chunks()
    size = len(column[0])
    if size % PARTS or not size:
        return Books([], -1)
    found = {int(i): x for rows_, many in integers(column, size) for i, x in zip(rows_, many.tolist(), strict=True)}
    start = [found[i] for i in sorted(found)]
    width = size // PARTS
    books = Books([[v[p * width : (p + 1) * width] for v in start] for p in range(PARTS)], size)
    for _ in range(rounds):
        books = _round(rows, books)
    return books


def compressed(embeddings: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code (bytes), error, label_error, codebooks_sha256 of each usable row."""
    lean(embeddings.sparkSession)
    rows = _usable(embeddings, vector, label)
    books = trained(rows)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                codes, errors = np.full(part.num_rows, None, object), np.full(part.num_rows, None, object)
                for own, x in integers(part.column(0), books.size) if books.size > 0 else ():
                    index, squares = books.assign(x)
                    codes[own] = [bytes(r) for r in index.astype(np.uint8).tolist()]
                    errors[own] = [min(int(e), _MOST) for e in squares.sum(axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(codes, pa.binary()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])
        tv.release()

    kind = rows.schema["label"].dataType.simpleString()
    coded = stored(rows.select("v", "vec_id", "label").mapInArrow(code, f"vec_id long, label {kind}, code binary, error long"), "codes")
    by_label = coded.groupBy(F.col("label").alias("_of")).agg(F.least(F.sum(F.col("error").cast("decimal(38)")), F.lit(_MOST).cast("decimal(38)")).cast("long").alias("label_error"))
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["_of"])).drop("_of")
    return joined.withColumn("codebooks_sha256", F.lit(books.digest()))


def run(spark, sf_dir: str) -> DataFrame:
    rows = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def _oracle(rounds: int = ROUNDS) -> str:
    """The rounds as a chain of tables; all numbers are whole and below 2^53, so that inner products of doubles are exact."""
    steps = ["""kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, label, p, w, list_dot_product(w, w) AS ww
    FROM (SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS w FROM kept, range(4) AS r(p))
), book0 AS MATERIALIZED (
    SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1) AS e, w FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)
)"""]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
    SELECT vec_id, label, p, w, least_ % 256 AS e, least_ // 256 AS d
    FROM (SELECT a.vec_id, a.label, a.p, a.w, min(((a.ww + list_dot_product(b.w, b.w) - 2 * list_dot_product(a.w, b.w))::BIGINT) * 256 + b.e) AS least_ FROM parts a JOIN book{i} b ON a.p = b.p GROUP BY ALL)
)""")
        if i < rounds:
            steps.append(f"""book{i + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM book{i} b LEFT JOIN (
        SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS w
        FROM (SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(w)::BIGINT AS x, generate_subscripts(w, 1) AS i FROM near{i}) GROUP BY p, e, i) GROUP BY p, e
    ) m ON m.p = b.p AND m.e = b.e
)""")
    last = f"""coded AS (
    SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded"""
    return "WITH " + ", ".join([*steps, last])


ORACLE_SQL = _oracle()
