"""State by key over a stream: early stopping, and the first row of a key within a time, with timers that clear what is no longer needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType, _parse_datatype_string

from tidemark.operators.series import stop_after

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def on_disk(spark: SparkSession) -> SparkSession:
    """Keeps the state of the session's streams in RocksDB: on the executors' disks, copied to the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def early_stop(stream: DataFrame, by: list[str], order: str, score: str, patience: int = 5, delta: float = -0.001) -> DataFrame:
    """A stream of metrics with best, counter and stop after each row, as `series.early_stop` has for a table; the state is three values a series, however long that is.

    Rows of a series must come in order from batch to batch; within a batch they are sorted. State comes and goes with the rows of many keys at once.
    """
    on_disk(stream.sparkSession)
    schema = StructType([*stream.schema, *_parse_datatype_string("best double, counter int, stop boolean")])

    def work(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = _sorted(rows, order)
        steps = stop_after(frame[score].astype(float).tolist(), patience, delta, state.getOption)
        state.update(steps[-1])
        yield frame.assign(best=[x for x, _, _ in steps], counter=np.array([x for _, x, _ in steps], np.int32), stop=[x for _, _, x in steps])

    return stream.groupBy(*by).applyInPandasWithState(work, schema, "best double, counter int, stop boolean", "append", GroupStateTimeout.NoTimeout)


def first_within(stream: DataFrame, keys: list[str], at: str = "at", keep_seconds: int = 86_400, delay: str = "1 hour") -> DataFrame:
    """The first row of equal keys and each that comes `keep_seconds` or more of event time after the one given last. A key's state goes when the watermark has passed that time; rows later than the watermark are left out."""
    on_disk(stream.sparkSession)

    def work(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frame = _sorted(rows, at)
        until = state.get[0] if state.exists else None
        keep = []
        for i, moment in enumerate(frame[at]):
            now = int(moment.timestamp() * 1000)
            if until is None or now >= until:
                until = now + keep_seconds * 1000
                keep.append(i)
        state.update((until,))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if keep:
            yield frame.iloc[keep]

    return stream.withWatermark(at, delay).groupBy(*keys).applyInPandasWithState(work, stream.schema, "until long", "append", GroupStateTimeout.EventTimeTimeout)


def _sorted(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """The rows of one key and one micro-batch."""
    frames = list(rows)
    return (frames[0] if len(frames) == 1 else pd.concat(frames)).sort_values(by, kind="stable")
