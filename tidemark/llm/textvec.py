"""Vectorised text kernels over Arrow string buffers.

Word, shingle and character-gram hashing work on whole buffers with numpy, so
the Python cost per document is a few array slices instead of a loop over words.
All hashes are 64-bit and depend on nothing but the bytes hashed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; temporaries take some 60 times as much.
WINDOW = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"p": np.empty(0, np.uint64), "i": np.empty(0, np.uint64)}

# The separators of the word contracts, [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For letter runs every ASCII byte that isn't a letter separates; bytes of longer characters count as letters.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _frugal() -> None:
    """Has this process give large freed arrays back to the system at once; by itself glibc comes to keep blocks of up to 32 MB."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        for option, value in ((-3, 4 << 20), (-1, 16 << 20)):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
            ctypes.CDLL(None).mallopt(option, value)
    except (AttributeError, OSError):  # another C library
        pass


_frugal()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of a 64-bit value."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        for k, base in (("p", _P), ("i", _PINV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"], _powers["i"]


def release() -> None:
    """Gives freed memory back to the system, as workers live on between tasks and would keep their peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold about `most` bytes of text (WINDOW); a longer row comes alone."""
    most = most or WINDOW
    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def cut(column: pa.Array | pa.ChunkedArray, ends: bytes, most: int | None = None) -> pa.RecordBatch:
    """row, text: the texts, those of more than `most` bytes (WINDOW) cut after one of the bytes `ends` into pieces of about that size; a run without such a byte stays whole."""
    most = most or WINDOW
    data, offsets = buffers(column)
    size = np.diff(offsets)
    rows, bounds = [], [0]
    for i in np.flatnonzero(size > most).tolist():
        stops = np.flatnonzero(np.isin(data[offsets[i] : offsets[i + 1]], np.frombuffer(ends, np.uint8))) + 1
        at = 0
        while (k := int(np.searchsorted(stops, at + most))) < len(stops) and stops[k] < size[i]:
            at = int(stops[k])
            rows.append(i)
            bounds.append(int(offsets[i]) + at)
    rows, bounds = np.array(rows + list(range(len(size))), np.int64), np.array(bounds[1:] + offsets[1:].tolist(), np.int64)
    order = np.lexsort((bounds, rows))
    bounds = np.concatenate([[0], bounds[order]]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(order), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    return pa.RecordBatch.from_arrays([pa.array(rows[order]), text], names=["row", "text"])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def lower_letters(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, on UTF-8 bytes."""
    out = _LOWER[data]
    lead = np.flatnonzero(out[:-1] == 0xC3) + 1 if len(out) else np.empty(0, np.int64)
    tail = out[lead]
    up = (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
    out[lead[up]] += 0x20
    return out


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without a separator; a run never crosses rows."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~separators[data]
    cut = np.empty(len(data) + 1, bool)
    cut[0] = cut[-1] = True
    np.logical_not(inside[:-1], out=cut[1:-1])
    rows = offsets[(offsets < len(data))]
    starts_at = cut[:-1].copy()
    starts_at[rows] = True
    starts = np.flatnonzero(inside & starts_at)
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    ends_at = offsets[(offsets > 0) & (offsets <= len(data))] - 1
    after[ends_at] = True
    return starts, np.flatnonzero(inside & after) + 1


def _long(data: np.ndarray) -> np.ndarray:
    """The sum that hash_spans forms, of one long span, in windows."""
    p, _ = _pow(WINDOW + 1)
    total, power = 0, 1
    for at in range(0, len(data), WINDOW):
        part = data[at : at + WINDOW].astype(np.uint64) + np.uint64(1)
        total += int((part * p[: len(part)]).sum(dtype=np.uint64)) * power
        power = power * int(p[WINDOW]) % (1 << 64)
    return np.array([total % (1 << 64)], np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; spans ascend and don't overlap. Long buffers go in windows cut between spans, longer spans in windows of their own."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + WINDOW, "right")))
        s, e = starts[at:to] - base, ends[at:to] - base
        n = int(e[-1])
        if n > WINDOW:
            out[at] = mix(_long(data[base : base + n]))[0]
            at += 1
            continue
        p, inv = _pow(max(n + 1, 1 << 16))
        c = np.empty(n + 1, np.uint64)
        c[0] = 0
        np.cumsum((data[base : base + n].astype(np.uint64) + np.uint64(1)) * p[:n], out=c[1:])
        out[at:to] = mix((c[e] - c[s]) * inv[s])
        at = to
    return out


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row the number of the first span that starts in it, and the total at the end."""
    return np.searchsorted(starts, offsets, "left")


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of each text, A-Z lower-cased, and each row's first word."""
    data, offsets = buffers(column)
    low = lower_ascii(data)
    starts, ends = spans(low, offsets)
    return hash_spans(low, starts, ends), rows_of(starts, offsets)


def shingles(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct hashes of the k-word runs of one text; a shorter text is one run; sorted."""
    if not len(h):
        return np.empty(0, np.uint64)
    n = max(1, len(h) - k + 1)
    width = min(k, len(h))
    acc = np.zeros(n, np.uint64)
    for j in range(width):
        acc = mix(acc + h[j : j + n] + np.uint64(0x632BE59BD9B4E019 + j))
    return np.unique(acc)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i."""
    c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return c[bounds[1:]] - c[bounds[:-1]]
