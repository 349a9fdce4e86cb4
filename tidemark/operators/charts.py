"""Data of charts as tables: grouped bars, radars, heatmaps, and the layout of vectors in the plane; nothing is drawn here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.neighbours import nearest
from tidemark.shared import Tables

SEED = 1024


def _places(cells: DataFrame, column: str, place: str) -> DataFrame:
    """The values of a column of categories by name, numbered from 1; categories are few, so one window numbers them."""
    return cells.select(column).distinct().withColumn(place, F.row_number().over(Window.orderBy(column)))


def _cells(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """The mean of each cell of two categories; rows without a category or a value are left out, NaN counts as none."""
    v = F.col(value).cast("double")
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & v.isNotNull() & ~F.isnan(v)).groupBy(a, b).agg(F.avg(v).alias(value))


def bars(df: DataFrame, group: str, series: str, value: str, width: float = 0.8) -> DataFrame:
    """group, series, value (mean), at and width of each bar: groups are at 1, 2, .., their series side by side within `width`, also where one is missing."""
    cells = _cells(df, group, series, value)
    groups, rows = _places(cells, group, "_g"), _places(cells, series, "_s")
    count = rows.agg(F.count(F.lit(1)).alias("_n"))
    one = F.lit(float(width)) / F.col("_n")
    at = F.col("_g") + (F.col("_s") - (F.col("_n") + 1) / 2) * one
    return cells.join(groups, group).join(rows, series).crossJoin(F.broadcast(count)).select(group, series, value, at.alias("at"), one.alias("width"))


def radar(df: DataFrame, line: str, axis: str, value: str) -> DataFrame:
    """line, axis, point (from 1), angle, x, y: a closed line over the axes, which share the circle evenly; the first axis comes again as the last point."""
    cells = _cells(df, line, axis, value)
    places = _places(cells, axis, "_i")
    count = places.agg(F.count(F.lit(1)).alias("_n"))
    placed = cells.join(places, axis).crossJoin(F.broadcast(count))
    points = placed.withColumn("point", F.explode(F.when(F.col("_i") == 1, F.array(F.col("_i"), (F.col("_n") + 1).cast("int"))).otherwise(F.array("_i"))))
    angle = (F.col("point") - 1) * (2 * np.pi) / F.col("_n")
    return points.select(line, axis, F.col("point").cast("long").alias("point"), angle.alias("angle"), (F.col(value) * F.cos(angle)).alias("x"), (F.col(value) * F.sin(angle)).alias("y"))


def heatmap(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """row, column, i, j (their places from 1), value (mean) and shade, its place between the least (0) and the greatest (1) cell; 0 where all are equal."""
    cells = _cells(df, row, column, value)
    ends = cells.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    shade = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    out = cells.join(_places(cells, row, "i"), row).join(_places(cells, column, "j"), column).crossJoin(F.broadcast(ends))
    return out.select(row, column, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), value, shade.alias("shade"))


def _affinities(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Of squared distances (rows by neighbours, inf where there is none) the shares by Gaussian kernels as wide as the perplexity wants, found by halving."""
    d = d - np.min(d, axis=1, keepdims=True, initial=np.inf, where=np.isfinite(d)).clip(max=1e300)
    low, high = np.full(len(d), 0.0), np.full(len(d), np.inf)
    beta = np.ones(len(d))
    for _ in range(60):
        p = np.exp(-d * beta[:, None])
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return p


def _embedded(p: np.ndarray, iterations: int) -> np.ndarray:
    """Places in the plane whose heavy-tailed affinities follow p (symmetric, of sum 1): gradient descent with momentum, p exaggerated at first."""
    n = len(p)
    y = np.random.default_rng(SEED).normal(0, 1e-2, (n, 2))
    step, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 12, 20.0)
    for i in range(iterations):
        early = i < iterations // 4
        apart = ((y[:, None, :] - y[None]) ** 2).sum(axis=2)
        q = 1 / (1 + apart)
        np.fill_diagonal(q, 0)
        pull = ((12 if early else 1) * p - q / max(q.sum(), 1e-300)) * q
        gradient = 4 * (pull.sum(axis=1)[:, None] * y - pull @ y)
        gain = np.where((gradient > 0) != (step > 0), gain + 0.2, gain * 0.8).clip(0.01)
        step = (0.5 if early else 0.8) * step - rate * gain * gradient
        y = y + step
        y -= y.mean(axis=0)
    return y


def plane(df: DataFrame, key: str, vector: str, most: int = 1000, perplexity: float = 20.0, iterations: int = 300) -> DataFrame:
    """key, x, y: a layout in the plane (t-SNE) of a sample of `most` rows, the first by a hash of their keys; neighbours stay neighbours.

    Keys are whole numbers, one a row. The neighbour graph (3 * perplexity a row) comes from `neighbours.nearest`, whose rules
    for unsound vectors hold: they have no place. The descent is one task's, over `most` rows squared. A row without
    neighbours lies where the descent pushes it; one row alone is at 0, 0; without rows the result is empty.
    """
    tables = Tables(df.sparkSession)
    keyed = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    sample = tables.stored(keyed.where(F.col("key").isNotNull()).orderBy(F.xxhash64("key"), "key").limit(most), "sample")
    near = nearest(sample, "key", "v", k=max(1, int(3 * perplexity)), include_self=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        a, b, d = (np.asarray(pa.Table.from_batches(held).column(c)) for c in ("key", "neighbour", "distance"))
        keys = np.unique(a)
        i, j = np.searchsorted(keys, a), np.searchsorted(keys, b)
        squared = np.full((len(keys), len(keys)), np.inf)
        other = i != j
        squared[i[other], j[other]] = d[other] ** 2
        p = _affinities(squared, min(perplexity, max(1.0, (len(keys) - 1) / 3))) if len(keys) > 1 else np.zeros((1, 1))
        p = (p + p.T) / max((p + p.T).sum(), 1e-300)
        y = _embedded(p, iterations) if len(keys) > 1 else np.zeros((1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(y[:, 0]), pa.array(y[:, 1])], names=["key", "x", "y"])

    return near.select("key", "neighbour", "distance").coalesce(1).mapInArrow(work, "key long, x double, y double")
