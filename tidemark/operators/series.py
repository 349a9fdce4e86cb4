"""Series of metric values: rolling statistics, best so far, early stopping, flushes. Windows are by series, never over a whole table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType


def rolling(df: DataFrame, by: list[str], order: str, value: str, width: int) -> DataFrame:
    """df with the median and mean of the last `width` values, and the mean of all so far (global_mean)."""
    w = Window.partitionBy(*by).orderBy(order)
    last, all_ = w.rowsBetween(1 - width, 0), w.rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", F.percentile(value, F.lit(0.5)).over(last).alias("median"), F.avg(value).over(last).alias("mean"), F.avg(value).over(all_).alias("global_mean"))


def best_so_far(df: DataFrame, by: list[str], order: str, value: str, smaller: bool = False) -> DataFrame:
    """df with the best value before each row (null at first) and whether the row is strictly better; smaller: less is better."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = (F.min if smaller else F.max)(value).over(w)
    out = df.withColumn("best_before", best)
    better = F.col(value) < F.col("best_before") if smaller else F.col(value) > F.col("best_before")
    return out.withColumn("improved", F.col("best_before").isNull() | better)


def stop_after(scores: list[float], patience: int, delta: float, before: tuple[float, int, bool] | None = None) -> list[tuple[float, int, bool]]:
    """Best, counter and stop after each score; before: those of the scores so far."""
    best, counter, stop = before or (None, 0, False)
    out = []
    for x in scores:
        if best is not None and x < best + delta:
            counter += 1
        else:
            best, counter = x, 0
        stop = stop or counter >= patience
        out.append((best, counter, stop))
    return out


def early_stop(df: DataFrame, by: list[str], order: str, score: str, patience: int = 5, delta: float = -0.001) -> DataFrame:
    """df with counter, best and stop after each row.

    A score below best + delta counts up, any other becomes the best and sets the count to 0; with a negative delta
    so does one slightly below the best. stop is true from the row on where the count has reached the patience. A series is
    read by one task, in order, and held in its memory: for series of some millions of rows at most. `streaming.keyed.early_stop`
    keeps three values a series instead.
    """
    schema = StructType([*df.schema, StructField("best", DoubleType()), StructField("counter", IntegerType()), StructField("stop", BooleanType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable")
        steps = stop_after(frame[score].astype(float).tolist(), patience, delta)
        return frame.assign(best=[x for x, _, _ in steps], counter=[x for _, x, _ in steps], stop=[x for _, _, x in steps])

    return df.groupBy(*by).applyInPandas(run, schema)


def flushes(df: DataFrame, by: list[str], iteration: str, values: list[str], every: int = 300) -> DataFrame:
    """Means of each run of iterations between flushes; iteration 0 is flushed alone."""
    return df.groupBy(*by, F.ceil(F.col(iteration) / every).alias("flush")).agg(*(F.avg(v).alias(v) for v in values), F.max(iteration).alias("at"))


def changes(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """df with the change of each value since the row before."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.select("*", *((F.col(v) - F.lag(v).over(w)).alias(f"{v}_change") for v in values))
