"""A key-value table in the order of its keys: range-partitioned, sorted files with a table of each file's first and last key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def put(df: DataFrame, key: str, path: str, files: int | None = None) -> None:
    """Writes rows as files whose key ranges don't overlap, each sorted, and the index of the files. Equal keys are in one file; rows without a key are left out.

    Keys are dealt by a sample of their order, so a file holds about as many rows as another, unless one key has more.
    """
    spark = df.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where(F.col(key).isNotNull())
    rows.repartitionByRange(n, key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows").select(F.col("_metadata.file_path").alias("file"), key)
    stored.groupBy("file").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def index(spark: SparkSession, path: str) -> DataFrame:
    """file, first, last, rows."""
    return spark.read.parquet(f"{path}/index")


def between(spark: SparkSession, path: str, key: str, low, high=None) -> DataFrame:
    """Rows from key low up to high (without it; None: to the end), from the files alone that may have any."""
    inside = F.col("last") >= F.lit(low) if high is None else (F.col("last") >= F.lit(low)) & (F.col("first") < F.lit(high))
    files = [r.file for r in index(spark, path).where(inside).select("file").collect()]  # names of the files that are opened
    schema = spark.read.parquet(f"{path}/rows").schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.where(F.col(key) >= F.lit(low)) if high is None else rows.where((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high)))


def with_prefix(spark: SparkSession, path: str, key: str, prefix: str) -> DataFrame:
    """Rows whose key, a text, begins with a prefix; keys up to the next text of its length are looked through."""
    last = prefix.rstrip("\U0010ffff")
    return between(spark, path, key, prefix, last[:-1] + _after(last[-1]) if last else None).where(F.col(key).startswith(prefix))


def _after(c: str) -> str:
    return chr(0xE000 if ord(c) == 0xD7FF else ord(c) + 1)  # between these two there are no characters


def cursor(spark: SparkSession, path: str, key: str, name: str = "place") -> DataFrame:
    """All rows with their place in the order of keys, from 1: rows are numbered within their file, behind the rows of the files before it. No row is moved to another file's task but by its file."""
    before = F.coalesce(F.sum("rows").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of files
    offsets = index(spark, path).select("file", before.alias("_before"))
    rows = spark.read.parquet(f"{path}/rows").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.join(F.broadcast(offsets.withColumnRenamed("file", "_file")), "_file").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")
