"""Hashed character grams over byte buffers, scored against small weight tables."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa

from tidemark.llm import textvec as tv
from tidemark.llm.session import lean, stored


_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


def buckets(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n bytes at each position; the last n-1 positions are left out."""
    m = len(data) - n + 1
    if m <= 0:
        return np.empty(0, np.uint32)
    g = data[:m].astype(np.uint32)
    for j in range(1, min(n, 4)):
        g |= data[j : j + m].astype(np.uint32) << np.uint32(8 * j)
    for j in range(4, n):
        g = g * np.uint32(_ODD[3]) + data[j : j + m]
    g *= np.uint32(_ODD[n % 5])
    g ^= g >> np.uint32(15)
    g *= np.uint32(_ODD[(n + 1) % 5])
    return g >> np.uint32(32 - bits)


def inside(offsets: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the positions where an n-gram of the row begins: [from, to)."""
    top = max(0, total - n + 1)
    begin = np.minimum(offsets[:-1], top)
    return begin, np.minimum(np.maximum(offsets[1:] - n + 1, begin), top)


def row_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    c = np.empty(len(values) + 1, np.float64)
    c[0] = 0
    np.cumsum(values, out=c[1:])
    return c[end] - c[begin]


def letters(data: np.ndarray) -> np.ndarray:
    """Lower-case letters, everything else as a space."""
    low = tv.lower_letters(data)
    low[tv.NOT_LETTER[low]] = 32
    return low


def totals(data: np.ndarray, offsets: np.ndarray, n: int, bits: int, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tables by rows the sums of the weights of each row's n-grams, and each row's number of n-grams; long buffers go in windows."""
    begin, end = inside(offsets, n, len(data))
    out = np.zeros((len(tables), len(begin)))
    for at in range(0, max(0, len(data) - n + 1), tv.WINDOW):
        ids = buckets(data[at : at + tv.WINDOW + n - 1], n, bits)
        b, e = np.clip(begin - at, 0, len(ids)), np.clip(end - at, 0, len(ids))
        for k, weights in enumerate(tables):
            out[k] += row_sums(weights[ids], b, e)
    return out, end - begin


def packed(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers as a bag of three bytes for each different one: the gap to the one before and the count. Gaps over 255 go through numbers that count 0."""
    ids, counts = np.unique(found, return_counts=True)
    gaps = np.diff(ids.astype(np.int64), prepend=-1)
    between = (gaps - 1) // 255
    at = np.cumsum(between + 1) - 1
    gap, count = np.full(at[-1] + 1 if len(at) else 0, 255, np.uint8), np.zeros(at[-1] + 1 if len(at) else 0, np.uint16)
    gap[at], count[at] = gaps - 255 * between, np.minimum(counts, 65535)  # of a text of LONGEST characters none is larger
    return gap, count


def unpacked(bag: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and their shares of the text."""
    gap, count = bag
    return np.cumsum(gap, dtype=np.int64) - 1, count / max(1, int(count.sum()))


def sample(df, key: str, label: str, each: int, total: int, salt: str = ""):
    """At most about `each` keys of each label and `total` in all: those whose hash is below a threshold. Only key and label travel.

    A key counts once; one with several labels is left out. The threshold of a label follows from its number of keys, such
    that `each` lies four standard deviations above the expected number; of a label with no more keys all are taken.
    """
    from pyspark.sql import functions as F

    known = df.select(F.col(key), F.col(label)).where(F.col(label).isNotNull() & F.col(key).isNotNull())
    keys = stored(known.groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("_other")).where(F.col(label) == F.col("_other")).drop("_other"), "keys")
    counts = {r[0]: r[1] for r in keys.groupBy(label).count().collect()}  # a row for each label
    while len(counts) and sum(min(n, each) for n in counts.values()) > total:
        each = each * 9 // 10
    share = {x: 1.0 if n <= each else max(each - 4 * each**0.5, 1) / n for x, n in counts.items()}
    kind = keys.schema[label].dataType.simpleString()
    cuts = df.sparkSession.createDataFrame([(x, int(s * (1 << 40))) for x, s in share.items()], f"`{label}` {kind}, _cut long")
    place = F.pmod(F.xxhash64(F.lit(salt), F.col(key).cast("string")), F.lit(1 << 40))
    return keys.join(F.broadcast(cuts), label).where(place < F.col("_cut")).select(key, label)


def training(documents, label: str, each: int, total: int, longest: int, salt: str, least: int = 0, labels=None):
    """doc_id, text and label of the sample that a model is trained on.

    The labels are a column of documents, or rows (doc_id, label) of the table `labels`. Only texts of `least` to `longest`
    characters take part; of several such texts of one doc_id the smallest.
    """
    from pyspark.sql import functions as F

    fit = documents.where(F.coalesce(F.length("text"), F.lit(0)).between(least, longest))
    known = fit.select("doc_id", label) if labels is None else labels.join(fit.select("doc_id"), "doc_id", "left_semi")
    chosen = sample(known, "doc_id", label, each, total, salt)
    texts = fit.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min(label).alias(label))


def in_one_task(rows, train):
    """train(table) of all rows, in the order of doc_id, by one task of an executor (so neither the rows nor the work burden the driver). rows is a bounded sample; train(None) where there are none."""

    def work(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(pa.Table.from_batches(held).sort_by("doc_id")))], pa.binary())], names=["model"])
            held.clear()
            tv.release()

    lean(rows.sparkSession)
    found = rows.repartition(1).mapInArrow(work, "model binary").collect()
    return pickle.loads(found[0][0]) if found else train(None)


def fold(key: str, modulus: int):
    """crc32 of the key as text, modulo; the contracts' held-out folds are of this kind."""
    from pyspark.sql import functions as F

    return F.crc32(F.col(key).cast("string")) % modulus
