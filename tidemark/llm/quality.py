"""Quality classifier: supervised subword embeddings.

Every word and every character 3- to 5-gram of a text is hashed to a learned
vector; a document is the mean of its vectors, a softmax layer turns the mean into
class probabilities. A word equal to the one before it counts as one more feature.
Vectors and output layer are trained by numpy stochastic gradient descent on at
most EACH labelled documents of each class, drawn from those of LONGEST characters
at most (the documented bound of the training sample; scoring reads whole texts).
Training is one task of an executor. For scoring, the output layer is folded into the
vectors, so each feature costs one table look-up.

Defined results: a null or empty text has no features and gets the bias's score.
Labels that are null, ids whose labels differ, and documents without a label don't
train; where no label of one class is known the score is the share of label 1 (0.5
without any). Rows that repeat a doc_id train once, by the smallest of their texts,
and are scored each. Ties can't arise: a score depends on the row's text alone, and the
sample is ordered by a hash and the id. A very long text is scored in windows and takes
some 12 bytes for each of its own. Only doc_id and text are read from documents, doc_id
and the label from labels; in `keep` no name of a column can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.llm import grams
from tidemark.llm import textvec as tv
from tidemark.llm.session import fresh, lean, named

BITS = 17
DIM = 8
ORDERS = (3, 4, 5)
EACH = 2500
LONGEST = 20_000
EPOCHS = 4
RATE = 0.25


def words(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, first, end) of the words, and of whether they repeat the one before; row i has buckets[first[i]:end[i]]."""
    starts, ends = tv.spans(data, offsets)
    h = tv.hash_spans(data, starts, ends)
    bounds = tv.rows_of(starts, offsets)
    word = (h >> np.uint64(64 - BITS)).astype(np.uint32)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[bounds[:-1][bounds[:-1] < len(h)]] = False
    again = same.astype(np.uint32)  # buckets 0 and 1 double as "other word" and "same word"
    return [(word, bounds[:-1], bounds[1:]), (again, bounds[:-1], bounds[1:])]


def features(text: str) -> np.ndarray:
    """The buckets of all features of one text."""
    data, offsets = tv.buffers(pa.array([text]))
    return np.concatenate([*(grams.buckets(data, n, BITS) for n in ORDERS), *(x for x, _, _ in words(data, offsets))])


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """Per bucket the difference of the logits that it adds to a mean, and the bias."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean() if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))
    docs = [grams.packed(features(text)) for text in texts]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (1 << BITS, DIM))
    out = rng.normal(0, 0.1, (2, DIM))
    bias = np.zeros(2)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(docs)):
            ids, share = grams.unpacked(docs[i])
            mean = share @ vectors[ids] if len(ids) else np.zeros(DIM)
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            if len(ids):  # the step is scaled so that the mean moves by rate times its gradient, however long the text
                vectors[ids] -= (share / (share @ share) * rate)[:, None] * (p @ out)
            out -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def score_batch(batch: pa.RecordBatch, weights: np.ndarray, bias: float) -> np.ndarray:
    data, offsets = tv.buffers(batch.column(batch.schema.get_field_index("text")))
    total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
    for n in ORDERS:
        (more,), number = grams.totals(data, offsets, n, BITS, [weights])
        total += more
        count += number
    for found, begin, end in words(data, offsets):
        total += grams.row_sums(weights[found], begin, end)
        count += end - begin
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", each: int = EACH, where=None) -> tuple[np.ndarray, float]:
    """Trains on at most `each` labelled documents of each class; `where` restricts the rows that may train."""
    known = labels.where(where) if where is not None else labels
    known = known.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    rows = grams.training(documents, "label", each, 2 * each, LONGEST, "quality", labels=known)
    return grams.in_one_task(rows, lambda t: train(t.column("text").to_pylist(), t.column("label").to_pylist()) if t else train([], []))


def score(documents: DataFrame, model: tuple[np.ndarray, float], columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """documents' columns (or those named) and the score as `name`, which replaces a column of that name."""
    lean(documents.sparkSession)
    weights, bias = model
    kept = [c for c in columns or documents.columns if c != name]
    docs = documents.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, "text"])))
    schema = StructType([*(f for f in docs.schema if f.name in kept), StructField(name, DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(score_batch(part, weights, bias))], names=[*kept, name])

    return docs.mapInArrow(work, schema)


def run(spark, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(documents, fit(documents, labels, where=grams.fold("doc_id", 3) != 1), ["doc_id"])
    return scored.select("doc_id", (grams.fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(spark, docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of docs that score at least threshold, with their columns."""
    name = fresh(docs.columns, "quality_score")
    return score(docs, fit(docs, labels), name=name).where(F.col(name) >= threshold).select(*named(docs))
