"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of up to `chunk` characters is one chunk. A longer one is cut into chunks
that overlap by `overlap` characters; chunks are dealt over the tasks and each is
pre-tokenised and encoded by itself. Two neighbours are stitched at the first
place of their overlap where both have a pre-token boundary: matching runs left to
right, so from a common boundary on both find the same pre-tokens. Where an overlap
holds no common boundary (one pre-token longer than the overlap), what follows the
last stitch is pre-tokenised again together with one more chunk, then two, four and so
on, until a boundary is common; so the ids never depend on the chunk size, and the work
is in proportion to the text. Decoding concatenates the raw bytes of the ids.

Defined results: a null text counts as empty; an empty text has no ids. Repeated
rows and doc_ids are kept apart (each row gets its own key). Ties can't arise: the ids
follow from the text alone. A very long text is cut and encoded by many tasks and
stitched by one, which holds its text and ids. Of the input only doc_id and text are
read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import lean

CHUNK = 1 << 15
OVERLAP = 1 << 10


@lru_cache(maxsize=4)
def tables(path: str, pattern: str):
    """tiktoken's encoder for a rank file, the pre-token pattern, and each id's bytes."""
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    vocabulary = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        vocabulary[rank] = piece
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return enc, regex.compile(pattern), vocabulary


def whole(text: str, path: str, pattern: str) -> np.ndarray:
    return np.asarray(tables(path, pattern)[0].encode_ordinary(text), dtype="<u4")


def pieces(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-token boundaries of text (its end included), where each one's ids begin, and the ids."""
    enc, pat, _ = tables(path, pattern)
    one = enc._core_bpe.encode_single_piece
    known: dict[str, list[int]] = {}
    bounds, begins, ids = [], [], []
    end = 0
    for m in pat.finditer(text):
        piece = m.group()
        if piece not in known:
            known[piece] = one(piece.encode())
        bounds.append(m.start())
        begins.append(len(ids))
        ids += known[piece]
        end = m.end()
    return np.array([*bounds, end], np.int64), np.array([*begins, len(ids)], np.int64), np.array(ids, "<u4")


def cuts(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(start, chunk of text) such that each chunk holds the `overlap` characters after the next one's start."""
    starts = range(0, max(1, len(text) - overlap), chunk)
    return [(s, text[s : s + chunk + overlap]) for s in starts]


def stitch(parts: list[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]], path: str, pattern: str) -> np.ndarray:
    """Ids of a text from (start, chunk, *pieces(chunk)) in order of start."""
    out = []
    at, text, bounds, begins, ids = parts[0]
    first = 0  # the first pre-token of this chunk that isn't output yet
    k, more = 1, 1
    while k < len(parts):
        start = parts[k][0]
        mine = bounds[:-2] + at  # without the last pre-token, which the chunk's end may have cut, and without its end
        both = np.intersect1d(mine[mine >= max(start, bounds[first] + at)], parts[k][2][:-1] + start)
        # A pre-token run cut by the chunk's end can also shift the white space before it, hence the last two are left out.
        both = both[both <= (mine[-2] if len(mine) > 1 else -1)]
        if len(both):
            to = int(np.searchsorted(bounds, both[0] - at))
            out.append(ids[begins[first] : begins[to]])
            at, text, bounds, begins, ids = parts[k]
            first = int(np.searchsorted(bounds, both[0] - at))
            k, more = k + 1, 1
        else:
            kept, pieces_of = int(bounds[first]), [text]
            end = at + len(text)
            for s, chunk, *_ in parts[k : k + more]:
                pieces_of.append(chunk[end - s :])
                end = s + len(chunk)
            text = "".join(pieces_of)[kept:]
            bounds, begins, ids = pieces(text, path, pattern)
            at, first = at + kept, 0
            k, more = k + more, more * 2
    out.append(ids[begins[first] :])
    return np.concatenate(out)


def digest(ids: np.ndarray, vocabulary: list[bytes]) -> tuple[str, str]:
    raw = b"".join(map(vocabulary.__getitem__, ids.tolist()))
    return hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()


def decode(ids, path: str, pattern: str) -> bytes:
    """Raw bytes of ids, which need not be whole characters."""
    return b"".join(map(tables(path, pattern)[2].__getitem__, ids))


def _default() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


_PART = "row string, doc_id long, start long, chunk string, bounds binary, begins binary, ids binary"


def encode(df: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, digests: bool = False, ids: bool = True) -> DataFrame:
    """doc_id, n_tokens and, per row of df, its `ids` (binary, little-endian unsigned 32-bit); with digests=True ids_sha256 and, of the text decoded from the ids, decoded_sha256."""
    lean(df.sparkSession)
    path, pattern = (path, pattern) if path and pattern else _default()
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64()} | ({"ids": pa.binary()} if ids else {}) | ({"ids_sha256": pa.string(), "decoded_sha256": pa.string()} if digests else {})
    out = ", ".join(f"{name} {({pa.int64(): 'long', pa.binary(): 'binary'}).get(kind, 'string')}" for name, kind in kinds.items())
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    longer = F.length("text") > chunk + overlap

    def rows(doc_ids: list, found: list[np.ndarray]) -> pa.RecordBatch:
        columns = [doc_ids, [len(x) for x in found]]
        if ids:
            columns.append([x.tobytes() for x in found])
        if digests:
            vocabulary = tables(path, pattern)[2]
            done = [digest(x, vocabulary) for x in found]
            columns += [[x for x, _ in done], [x for _, x in done]]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield rows(part.column(0).to_pylist(), [whole(x, path, pattern) for x in part.column(1).to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts, chunks = zip(*cuts(text, chunk, overlap), strict=True)
                n = len(starts)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n), pa.array([doc_id] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array(chunks)], names=["row", "doc_id", "start", "chunk"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                got = [pa.array([x.tobytes()], pa.binary()) for x in pieces(one.column(3)[0].as_py(), path, pattern)]
                yield pa.RecordBatch.from_arrays([*one.columns, *got], names=["row", "doc_id", "start", "chunk", "bounds", "begins", "ids"])

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        parts = [(s, c, np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(i, "<u4")) for s, c, a, b, i in zip(*(table.column(x).to_pylist() for x in ("start", "chunk", "bounds", "begins", "ids")), strict=True)]
        return pa.Table.from_batches([rows([table.column("doc_id")[0].as_py()], [stitch(parts, path, pattern)])])

    alone = docs.where(~longer).mapInArrow(short, out)
    chunks = (
        docs.where(longer)
        .select(F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id(), F.md5("text")).alias("row"), "doc_id", "text")
        .mapInArrow(cut, "row string, doc_id long, start long, chunk string")
        .repartition("row", "start")
        .mapInArrow(split, _PART)
    )
    return alone.unionByName(chunks.groupBy("row").applyInArrow(join, out))


def run(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True, ids=False)
