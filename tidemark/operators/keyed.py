"""Keyed tables: which of several rows of a key counts. Order is always an explicit column, as a DataFrame has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: list[str], order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    return _one(df, keys, [F.col(position).asc()])


def last_wins(df: DataFrame, keys: list[str], position: str, keep_first_place: bool = True) -> DataFrame:
    """The last row of each key; with keep_first_place, `position` is that of the key's first row."""
    if not keep_first_place:
        return _one(df, keys, [F.col(position).desc()])
    out = df.withColumn("_first", F.min(position).over(Window.partitionBy(*keys)))
    return _one(out, keys, [F.col(position).desc()]).withColumn(position, F.col("_first")).drop("_first")


def union_priority(sources: list[DataFrame], keys: list[str], position: str | None = None) -> DataFrame:
    """Rows of all sources; of a key only that of the earliest source counts (and the first of it, by position)."""
    tagged = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    both = tagged[0]
    for df in tagged[1:]:
        both = both.unionByName(df, allowMissingColumns=True)
    return _one(both, keys, [F.col("_source"), *([F.col(position)] if position else [])]).drop("_source")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their `rows`."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def lookup(df: DataFrame, table: DataFrame, key: str, normal, value: str = "value") -> DataFrame:
    """`value` of the row of table with the same key, else of the first (by key) whose normalised key equals df's normalised key. normal: key column -> normalised key column."""
    exact = last_wins(table.withColumn("_p", F.lit(0)), [key], "_p", False).select(F.col(key), F.col(value).alias("_exact"))
    near = table.select(normal(F.col(key)).alias("_normal"), F.col(key).alias("_raw"), F.col(value)).groupBy("_normal").agg(F.min_by(value, "_raw").alias("_near"))
    out = df.withColumn("_normal", normal(F.col(key))).join(exact, key, "left").join(near, "_normal", "left")
    return out.withColumn(value, F.coalesce("_exact", "_near")).drop("_exact", "_near", "_normal")


def mapped(df: DataFrame, column: str, names: dict[str, object], to: str | None = None) -> DataFrame:
    """column looked up in a small driver-side table; a value that isn't in it raises."""
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    hit = F.try_element_at(pairs, F.col(column))
    miss = F.raise_error(F.concat(F.lit(f"{column} has no entry for "), F.coalesce(F.col(column), F.lit("null"))))
    return df.withColumn(to or column, F.when(hit.isNotNull(), hit).otherwise(miss.cast(df.select(hit.alias("x")).schema["x"].dataType)))


def with_known(df: DataFrame, known: DataFrame, key: str, needed: list[str]) -> DataFrame:
    """Rows of df whose key `known` has, with all of `needed` filled; the others are skipped."""
    full = known
    for c in needed:
        full = full.where(F.col(c).isNotNull() & (F.col(c) != ""))
    return df.join(full.select(key).distinct(), key, "left_semi")
