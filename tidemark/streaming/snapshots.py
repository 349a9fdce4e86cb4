"""Engagement snapshots as a stream: one row a post and poll, appended, repeats within the watermark left out."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.schemas import SNAPSHOTS


def source(spark: SparkSession, path: str, schema: str = SNAPSHOTS, kind: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def with_event_time(df: DataFrame, seconds: str = "snapshot_utc", name: str = "at") -> DataFrame:
    """Event time as a timestamp with zone; a watermark doesn't take any other kind."""
    kind = dict(df.dtypes)[seconds]
    at = F.timestamp_micros((F.col(seconds) * 1_000_000).cast("long")) if kind in ("double", "float", "int", "bigint") else F.col(seconds).cast("timestamp")
    return df.withColumn(name, at)


def deduplicated(df: DataFrame, keys: list[str], at: str = "at", delay: str | None = "1 hour") -> DataFrame:
    """The first row of equal keys, as far back as the watermark reaches; on a batch or without a delay, of all: no row is late, and all keys are kept as state."""
    if not df.isStreaming or delay is None:
        return df.dropDuplicates(keys)
    return df.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def of_targets(df: DataFrame, targets: Callable[[], DataFrame] | DataFrame, key: str = "posting_id") -> DataFrame:
    """Rows of tracked posts. A table of targets that a reader lists anew for each micro-batch makes the targets follow their file."""
    table = targets() if callable(targets) else targets
    return df.join(table.select(key).distinct(), key, "left_semi")


def rates(df: DataFrame, key: str = "posting_id", at: str = "at", width: str = "1 hour", delay: str = "1 hour", values: tuple[str, ...] = ("score", "num_comments")) -> DataFrame:
    """Per post and window: snapshots, and the rise of each value."""
    rows = df.withWatermark(at, delay) if df.isStreaming else df
    return rows.groupBy(key, F.window(at, width)).agg(F.count(F.lit(1)).alias("snapshots"), *((F.max(v) - F.min(v)).alias(f"{v}_rise") for v in values))


def sessions(df: DataFrame, key: str = "posting_id", at: str = "at", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Per post its runs of snapshots without a gap."""
    rows = df.withWatermark(at, delay) if df.isStreaming else df
    return rows.groupBy(key, F.session_window(at, gap).alias("session")).agg(F.count(F.lit(1)).alias("snapshots"))


def append(df: DataFrame, path: str, checkpoint: str, interval: str | None = None, kind: str = "parquet") -> StreamingQuery:
    """Starts appending to a table: every interval, or once through what is there."""
    writer = df.writeStream.format(kind).outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Calls work(batch, number); it must bear being called again with a number it has had."""
    writer = df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def following(df: DataFrame, targets: Callable[[], DataFrame], key: str, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Appends the rows of tracked keys, the table of targets being read anew for each batch; a batch that comes again replaces what it wrote."""

    def work(batch: DataFrame, number: int) -> None:
        of_targets(batch, targets, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each_batch(df, work, checkpoint, interval)


def poll(cycle: Callable[[int], None], interval: float, jitter: float = 0.0, cycles: int = 0, stop: Callable[[], bool] | None = None, seed: int = 0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> int:
    """Calls cycle(number) every `interval` seconds, give or take `jitter`, a second apart at least, `cycles` times (0: without end) or until stop() is true after a cycle. Returns the number of cycles."""
    rng = random.Random(seed)
    done = 0
    while not cycles or done < cycles:
        began = clock()
        done += 1
        cycle(done)
        if (stop and stop()) or done == cycles:
            break
        sleep(max(1.0, max(interval - (clock() - began), 1.0) + rng.uniform(-jitter, jitter)))
    return done


def throttled(work: Callable[[object], None], items: list, pause: float = 1.0, failed: Callable[[object, Exception], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Calls work(item) with a pause after each; one that fails is reported and doesn't stop the rest. Returns how many succeeded."""
    ok = 0
    for item in items:
        try:
            work(item)
            ok += 1
        except Exception as e:  # any failure of a single request
            if failed:
                failed(item, e)
        finally:
            sleep(pause)
    return ok


def run_until(query: StreamingQuery, stop: Callable[[], bool] | None = None, poll: float = 1.0) -> None:
    """Waits for the query; where stop() says so it ends after the current batch. The query is stopped in any case."""
    try:
        while query.isActive and not (stop and stop()):
            query.awaitTermination(poll)
        error = query.exception()
        if error is not None:
            raise error
    finally:
        query.stop()
