"""Exact nearest neighbours by a metric index: pivots with a cell each, and bounds that tell which cells a row has to visit.

Equal vectors are one class; it answers with its k + 1 smallest keys, however many it has. Each
class lies in the cell of its nearest pivot. A first round compares the classes of one tile of
a cell, which gives every class a distance within which its neighbours lie. By the triangle
inequality no vector of a cell is nearer than the distance to its pivot less the cell's radius,
and by the cell's border (its vectors are no nearer to another pivot) no nearer than
(d(x, other)^2 - d(x, own)^2) / (2 d(own, other)). In a second round classes of cells beside each other
ask as a group. A task compares a group with a share of the cells that any of it visits, each class
with the cells whose bounds are within the distance that it has by then, and keeps its best k + 1.
So a vector is sent once for each group or share, not for each visit. Products of matrices in single
precision, with a bound of their rounding, leave few pairs, whose distances are found from the
differences in double precision. Nothing depends on the pivots but the number of distances.

The pivots (PIVOTS at most, about the square root of the number of classes) and a line of statistics
for each are all that the driver and every task hold. Tiles have about TILE rows, groups about VISITS and
shares about SHARE; smaller tables have smaller ones, so that there is work for all cores. Where vectors are
spread evenly in many dimensions the work is the square of the table's rows, in more tasks, not larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import Tables

PIVOTS = 2048
TILE = 1024
VISITS = 1 << 15
SHARE = 1 << 16
#: Numbers of one block of products.
BLOCK = 1 << 19
#: By how much rounding can move a distance, with room to spare.
SLACK = 1e-9


def _off(x: np.ndarray, y: np.ndarray | float, size: int, kind: type = np.float64) -> np.ndarray:
    """By how much squared distances found from products of vectors of these norms may be off, with room to spare."""
    return (4 * size + 16) * np.finfo(kind).eps * (x + y) ** 2 + 1e-35 * (1 + x + y)


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows of x by rows of y, and by how much they may be off."""
    with np.errstate(invalid="ignore", over="ignore"):
        xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        return xx[:, None] + yy - 2 * (x @ y.T), _off(np.sqrt(xx)[:, None], np.sqrt(yy), x.shape[1])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x to that of y."""
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def _matrix(column: pa.Array | pa.ChunkedArray, rows: np.ndarray | None = None) -> np.ndarray:
    """Vectors of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column if rows is None else column.take(pa.array(rows))
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def _sizes(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    size = np.asarray(pc.list_value_length(column))
    for d in np.unique(size).tolist():
        yield d, np.flatnonzero(size == d)


class Pivots:
    """Pivots by length of vector. A cell's number is its pivot's; vectors of a length without a pivot share the cell -length."""

    def __init__(self, vectors: list[list[float]]):
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in sorted({len(v) for v in vectors}):
            own = [i for i, v in enumerate(vectors) if len(v) == d]
            self.by_size[d] = np.array(own), np.array([vectors[i] for i in own], np.float64)
        self.radius: dict[int, float] = {}
        self._between: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_between": {}}  # as large as the square of the pivots; each task finds it again

    def between(self, size: int) -> np.ndarray:
        """Distances of the pivots, none too short."""
        if size not in self._between:
            d, off = _squares(self.by_size[size][1], self.by_size[size][1])
            self._between[size] = np.sqrt(np.maximum(d, 0) + off)
        return self._between[size]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its distance to the pivot."""
        if x.shape[1] not in self.by_size:
            return np.full(len(x), -x.shape[1]), np.zeros(len(x))
        number, pivots = self.by_size[x.shape[1]]
        at = np.empty(len(x), np.int64)
        step = max(1, BLOCK // len(pivots))
        for i in range(0, len(x), step):
            at[i : i + step] = np.nan_to_num(_squares(x[i : i + step], pivots)[0], nan=np.inf).argmin(axis=1)
        return number[at], distances(x, pivots[at])

    def away(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Distances to the pivots of their own cells."""
        if x.shape[1] not in self.by_size:
            return np.zeros(len(x))
        number, pivots = self.by_size[x.shape[1]]
        return distances(x, pivots[np.searchsorted(number, own)])

    def visits(self, x: np.ndarray, own: np.ndarray, away: np.ndarray, reach: np.ndarray, cells: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the cells (all, or one of these) that may hold a vector within reach of a row, whose own cell and distance to its pivot are given."""
        size = x.shape[1]
        if size not in self.by_size:
            return np.arange(len(x)), np.full(len(x), -size)
        number, pivots = self.by_size[size]
        used = np.flatnonzero(np.isin(number, list(self.radius) if cells is None else cells))
        home = np.searchsorted(number, own)
        radius, norm = np.array([self.radius[i] for i in number[used].tolist()]), np.sqrt(np.einsum("ij,ij->i", pivots, pivots))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            d, off = _squares(x, pivots[used])
            low = np.sqrt(np.maximum(d - off, 0)) - radius
            # rounding may have put a vector of the cell beyond its border, too
            beyond = 2 * _off(2 * norm[used] + radius, norm[home][:, None], size)
            far = d - off - away[:, None] ** 2 - beyond
            border = np.where(number[used] == own[:, None], 0, far / (2 * self.between(size)[:, used][home]))
            row, cell = np.nonzero(~((low > (reach + SLACK * (1 + reach))[:, None]) | (border > (reach + SLACK * (1 + reach))[:, None])))
        return row, number[used][cell]

    def in_order(self) -> list[list[int]]:
        """The cells that have rows, by length of vector, each followed by the nearest one that isn't there yet."""
        out = [[c] for c in sorted(self.radius) if c < 0]
        for size, (number, _) in self.by_size.items():
            left = np.isin(number, list(self.radius))
            at, order = int(left.argmax()), []
            for _ in range(int(left.sum())):
                left[at] = False
                order.append(int(number[at]))
                at = int(np.where(left, np.nan_to_num(self.between(size)[at], nan=np.finfo(float).max, posinf=np.finfo(float).max), np.inf).argmin())
            out.append(order)
        return out


def packed(cells: list[list[int]], rows: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """cell, the first of its bins and how many it has, bins being numbered and of about `most` rows: small cells of a list share one, a large cell has several."""
    out, at = [], 0
    for one in cells:
        held = 0
        for cell in one:
            bins = -(-rows[cell] // most)
            if held and (bins > 1 or held + rows[cell] > most):
                at, held = at + 1, 0
            out.append((cell, at, bins))
            held += rows[cell]
            if bins > 1:
                at, held = at + bins, 0
        at += held > 0
    return out


class Asking:
    """The classes of a group, what is nearest to each of what it has met, and how far it still has to look."""

    def __init__(self, pivots: Pivots, x: np.ndarray, own: np.ndarray, reach: np.ndarray, k: int):
        self.pivots, self.x, self.own, self.reach, self.k = pivots, x, own, reach.copy(), k
        self.away = pivots.away(x, own)
        self.distance, self.key = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
        self.found, self.met = np.zeros((len(x), k), bool), np.zeros(len(x), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def meet(self, cell: int, y: np.ndarray, keys: np.ndarray) -> None:
        """Vectors of a cell and the smallest key of each."""
        step = max(1, BLOCK // max(y.shape))
        middle = y[0] if cell < 0 else self.pivots.by_size[y.shape[1]][1][np.searchsorted(self.pivots.by_size[y.shape[1]][0], cell)]
        with np.errstate(invalid="ignore", over="ignore"):
            b = y - middle
            bb = np.einsum("ij,ij->i", b, b)
            b, widest = np.column_stack([b, -bb / 2]).astype(np.float32).T, np.sqrt(bb.max())
            rows = self.pivots.visits(self.x, self.own, self.away, self.reach, np.array([cell]))[0]
            self.met[rows] += len(y)
            for at in range(0, len(rows), step):
                r = rows[at : at + step]
                a = self.x[r] - middle
                aa = np.einsum("ij,ij->i", a, a)
                least = (aa - self.reach[r] ** 2 * (1 + SLACK) - _off(np.sqrt(aa), widest, y.shape[1], np.float32)) / 2
                a = np.column_stack([a, np.ones(len(a))]).astype(np.float32)
                flat = np.flatnonzero(~(a @ b < least.astype(np.float32)[:, None]))  # what isn't a number stays
                for i in range(0, len(flat), step):
                    row, column = r[flat[i : i + step] // len(y)], flat[i : i + step] % len(y)
                    d = distances(self.x[row], y[column])
                    near = d <= self.reach[row]
                    self.waiting.append((row[near], d[near], keys[column[near]]))
                    self.n += int(near.sum())
                    if self.n > 4 * len(self.x) + step:
                        self.settle()

    def settle(self) -> None:
        """The best k of those so far and of those that wait, by distance and key."""
        if not self.n:
            return
        row, d, key = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.n = [], 0
        rows, at = np.unique(row, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        d, key = np.concatenate([self.distance[rows].ravel(), d]), np.concatenate([self.key[rows].ravel(), key])
        found = np.concatenate([self.found[rows].ravel(), np.ones(len(row), bool)])
        order = np.lexsort((~found, key, d, at))
        count = np.bincount(at)
        kept = order[np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count) < self.k]
        self.distance[rows], self.key[rows], self.found[rows] = (x[kept].reshape(-1, self.k) for x in (d, key, found))
        self.reach[rows] = np.minimum(self.reach[rows], self.distance[rows, -1])


def nearest(df: DataFrame, key: str, vector: str, k: int = 100, include_self: bool = False) -> DataFrame:
    """key, neighbour, distance, rank, compared: the k nearest other rows of each row by Euclidean distance, of equals the smaller key. Exact.

    compared: with how many different vectors and pivots the row's vector was compared. Rows whose vector is null, empty or
    holds null or non-finite components take no part; vectors of different lengths aren't compared. Keys are whole numbers
    and each stands for one row. Intermediate tables go to the shared folder.
    """
    spark = df.sparkSession
    tables, parts = Tables(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    sound = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull() & sound)
    rows = rows.withColumn("f", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v"))
    first = Window.partitionBy("f", "g").orderBy("key")
    few = rows.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1)  # Spark keeps as few in each map task already
    classes = tables.stored(few.groupBy("f", "g").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("key")).alias("keys")), "classes")
    n = classes.count()
    wanted = min(PIVOTS, int(n**0.5) + 1)
    # 4 times as many as wanted by their hash, then the first of these
    drawn = classes.where(F.pmod("f", F.lit(1 << 40)) < int(min(1.0, 4 * wanted / max(1, n)) * (1 << 40))).orderBy("g", "f").limit(wanted).select("v").collect()
    pivots = Pivots([r.v for r in drawn])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows)
            for _, own in _sizes(batch.column(2)):
                cell[own], away[own] = pivots.cells(_matrix(batch.column(2), own))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    cells = tables.stored(classes.select("f", "g", "v", "keys").mapInArrow(place, "f long, g long, v array<double>, keys array<long>, cell long, away double"), "cells")
    held = {}
    for r in cells.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # a row for each pivot
        pivots.radius[r.cell], held[r.cell] = r.radius, r.n
    order, side = pivots.in_order(), int((4 * spark.sparkContext.defaultParallelism) ** 0.5) + 1  # some tasks for each core
    groups, shares = (packed(order, held, min(most, max(TILE, -(-n // side)))) for most in (VISITS, SHARE))
    tasks = (1 + max((a + b for _, a, b in groups), default=0)) * (1 + max((a + b for _, a, b in shares), default=0))
    places = spark.createDataFrame([(c, -(-held[c] // TILE), g, gs, s, ss) for (c, g, gs), (_, s, ss) in zip(groups, shares, strict=True)], "cell long, tiles int, g0 int, gn int, s0 int, sn int")
    tiled = cells.join(F.broadcast(places), "cell").select(
        "f", "g", "v", "keys", "cell", F.pmod("g", "tiles").cast("int").alias("tile"),
        (F.col("g0") + F.pmod("f", "gn")).cast("int").alias("group"), (F.col("s0") + F.pmod(F.pmod("g", "tiles"), "sn")).cast("int").alias("share"),
    )

    def bound(table: pa.Table) -> pa.Table:
        """Within a tile: how far the k nearest keys besides one of its own reach at most."""
        x = _matrix(table.column("v"))
        count = np.asarray(pc.list_value_length(table.column("keys")))
        with np.errstate(invalid="ignore", over="ignore"):
            d, off = _squares(x - x[0], x - x[0])
            d = np.nan_to_num(np.maximum(d, 0) + off, nan=np.inf)
        np.fill_diagonal(d, 0)
        order = np.argpartition(d, k, axis=1)[:, : k + 1] if len(x) > k + 1 else np.broadcast_to(np.arange(len(x)), d.shape)
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(d, order, 1), axis=1), 1)
        enough = np.cumsum(count[order], axis=1) > k
        at = np.where(enough.any(axis=1), enough.argmax(axis=1), 0)
        reach = np.where(enough.any(axis=1), np.sqrt(np.take_along_axis(d, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]), np.inf)
        return pa.table([*(table.column(c) for c in ("f", "g", "v", "cell", "group")), pa.array(reach), pa.array(np.full(len(x), len(x), np.int64))], names=["f", "g", "v", "cell", "group", "reach", "met"])

    bounded = tables.stored(tiled.groupBy("cell", "tile").applyInArrow(bound, "f long, g long, v array<double>, cell long, group int, reach double, met long"), "reach")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that a batch's rows visit, once for each group."""
        for batch in batches:
            own, group, reach = (np.asarray(batch.column(i)) for i in (1, 2, 3))
            for d, at in _sizes(batch.column(0)):
                step = max(1, BLOCK // max(1, len(pivots.by_size.get(d, ([],))[0])))
                for i in range(0, len(at), step):
                    part = at[i : i + step]
                    x = _matrix(batch.column(0), part)
                    row, cell = pivots.visits(x, own[part], pivots.away(x, own[part]), reach[part])
                    pair = np.unique(np.stack([group[part][row], cell]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0].astype(np.int32)), pa.array(pair[1])], names=["group", "cell"])

    calls = tables.stored(bounded.select("v", "cell", "group", "reach").mapInArrow(visits, "group int, cell long").distinct(), "visits")
    shared = calls.join(F.broadcast(places), "cell").select("group", F.explode(F.sequence(F.col("s0"), F.col("s0") + F.col("sn") - 1)).alias("share")).distinct()
    asking = shared.groupBy("group").agg(F.collect_list("share").alias("shares"))
    visited = calls.groupBy("cell").agg(F.collect_list("group").alias("groups"))
    asked = bounded.join(F.broadcast(asking), "group").select("group", F.explode("shares").alias("share"), F.lit(0).alias("turn"), "cell", "f", "g", "v", "reach", F.lit(None).cast("long").alias("first"))
    met = tiled.join(F.broadcast(visited), "cell").select(F.explode("groups").alias("group"), "share", F.lit(1).alias("turn"), "cell", "f", "g", "v", F.lit(None).cast("double").alias("reach"), F.element_at("keys", 1).alias("first"))
    dealt = asked.unionByName(met).repartition(max(parts, min(4 * tasks, 2048)), "group", "share").sortWithinPartitions("group", "share", "turn", "cell")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group comes first and is held; those that it meets pass by."""

        def told() -> Iterator[pa.RecordBatch]:
            asks.settle()
            for at in range(0, len(asks.x), 4096):
                found = asks.found[at : at + 4096].copy()
                none = ~found.any(axis=1)
                found[none, 0] = True  # for the number of comparisons alone
                row, column = np.nonzero(found)
                count = np.where(np.diff(row, prepend=-1) > 0, asks.met[at + row], 0)
                yield pa.RecordBatch.from_arrays([pa.array(f[at + row]), pa.array(g[at + row]), pa.array(asks.key[at + row, column], mask=none[row]), pa.array(asks.distance[at + row, column], mask=none[row]), pa.array(count)], names=["f", "g", "neighbour", "distance", "met"])

        here, held, asks, f, g = None, [], None, None, None
        for batch in batches:
            marks = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(4)], axis=1)
            marks[marks[:, 2] == 0, 3] = 0  # those that ask are taken together
            new = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(axis=1))) if len(marks) else np.empty(0, int)
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(marks)], strict=True):
                part, pair = batch.slice(a, b - a), tuple(marks[a, :2].tolist())
                if not marks[a, 2]:
                    if pair != here:
                        if asks is not None:
                            yield from told()
                        here, held, asks = pair, [], None
                    held.append([np.asarray(part.column(3)), np.asarray(part.column(4)), np.asarray(part.column(5)), _matrix(part.column(6)), np.asarray(part.column(7))])
                    continue
                if asks is None:
                    own, f, g, x, reach = (np.concatenate(c) for c in zip(*held, strict=True))
                    asks, held = Asking(pivots, x, own, reach, k + 1), []
                y, keys = _matrix(part.column(6)), part.column(8).to_numpy(zero_copy_only=False).astype(np.int64)
                for at in range(0, len(y), 2 * TILE):
                    asks.meet(int(marks[a, 3]), y[at : at + 2 * TILE], keys[at : at + 2 * TILE])
        if asks is not None:
            yield from told()

    answers = tables.stored(dealt.mapInArrow(answer, "f long, g long, neighbour long, distance double, met long"), "answers")
    cost = answers.select("f", "g", "met").unionByName(bounded.select("f", "g", "met")).groupBy("f", "g").agg((F.sum("met") + len(drawn) * 3).alias("compared"))
    near = Window.partitionBy("f", "g").orderBy("distance", "neighbour")
    best = answers.where("neighbour IS NOT NULL").withColumn("i", F.row_number().over(near)).where(F.col("i") <= k + 1)
    # classes became their smallest keys, the others follow here
    best = best.join(classes.select(F.element_at("keys", 1).alias("neighbour"), "keys"), "neighbour").select("f", "g", F.explode("keys").alias("neighbour"), "distance")
    best = best.withColumn("i", F.row_number().over(near)).where(F.col("i") <= k + 1)
    each = rows.select("key", "f", "g").join(best.select("f", "g", "neighbour", "distance"), ["f", "g"])
    each = each if include_self else each.where("key <> neighbour")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)
    out = ranked.join(cost, ["f", "g"]).select("key", "neighbour", "distance", "rank", "compared")
    result = tables.stored(out, "neighbours")
    tables.drop(classes, cells, bounded, calls, answers)
    return result
