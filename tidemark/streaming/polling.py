"""Polling as a streaming source: a row for each cycle, with offsets, so that a query that starts again goes on after the last cycle it finished."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Cycles(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class PollingReader(DataSourceStreamReader):
    """An offset is the number of cycles that have begun. Each micro-batch takes `cyclesPerTrigger` cycles more, until there have been `iterations` (0: without end)."""

    def __init__(self, options: dict):
        self.limit = int(options.get("iterations", 0))
        self.step = max(1, int(options.get("cyclesPerTrigger", 1)))
        self.at: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"cycles": 0}

    def latestOffset(self, start: dict | None = None, limit: object = None) -> dict:  # noqa: N802  Spark's name; newer versions tell where the batch starts
        done = start["cycles"] if isinstance(start, dict) else self.at or 0
        self.at = done + self.step if not self.limit else max(done, min(self.limit, done + self.step))
        return {"cycles": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at or 0, end["cycles"])  # after a start anew, too
        return [Cycles(start["cycles"], end["cycles"])]

    def read(self, partition: Cycles) -> Iterator[tuple[int]]:
        for cycle in range(partition.first, partition.last):
            yield (cycle,)

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["cycles"])


class Polling(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polling"

    def schema(self) -> str:
        return "cycle long"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return PollingReader(self.options)


def cycles(spark: SparkSession, iterations: int = 0, per_trigger: int = 1) -> DataFrame:
    """A stream of cycle numbers from 0, `per_trigger` a micro-batch, that ends after `iterations` (0: never)."""
    spark.dataSource.register(Polling)
    return spark.readStream.format("polling").option("iterations", iterations).option("cyclesPerTrigger", per_trigger).load()


def recorded(polls: DataFrame, snapshots: DataFrame, cycle: str = "cycle") -> DataFrame:
    """The snapshots that were taken in the cycles of a stream. A table that is partitioned by the cycle is read no further than that."""
    return snapshots.join(F.broadcast(polls.withColumnRenamed("cycle", "_cycle")), F.col(cycle) == F.col("_cycle")).drop("_cycle")
