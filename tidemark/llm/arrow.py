"""Arrow batches of sorted rows, whole groups at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, alone: bool = False, most: int = 1 << 16) -> Iterator[pa.Table]:
    """Rows of whole groups (of equal values in the first `keys` columns, sorted): about `most` rows, or each group by itself."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        begins = np.any([np.diff(x, prepend=~x[:1]) != 0 for x in columns], axis=0)
        if held:
            last = [held[-1].column(i)[-1].as_py() for i in range(keys)]
            begins[0] = any(x[0] != y for x, y in zip(columns, last, strict=True))
        cuts = np.flatnonzero(begins)
        at = 0
        for k in [*cuts.tolist(), batch.num_rows]:
            if k > at:
                held.append(batch.slice(at, k - at))
                count += k - at
                at = k
            if k < batch.num_rows and held and (alone or count >= most):
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)
