"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import fixed6


def csv(df: DataFrame, path: str, fields: list[str] | None = None, mode: str = "overwrite") -> None:
    """Columns `fields` in their order; one that df doesn't have is empty."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields or df.columns]
    df.select(*cols).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def all_columns(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables with the columns of any; what a table lacks is null."""
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def csv_append(df: DataFrame, path: str) -> None:
    """Appends rows to a CSV table that plain readers take with header=True: every file has the header of the table.

    The first append fixes the columns and their order; later ones are brought into it by name, columns that the table hasn't are
    dropped and those that the rows haven't are empty. Spark's commit makes an append's files appear together, and one that
    fails leaves none.
    """
    spark = df.sparkSession
    home = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(home):
        name = lambda c: F.col(f"`{c.replace('`', '``')}`")
        df = df.select(*(name(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in spark.read.csv(path, header=True).columns))
    df.write.mode("append").option("header", True).csv(path)


def features_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Numbers with six decimals, without trailing zeros; nothing is quoted."""
    cols = [fixed6(c).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes]
    df.select(*cols).write.mode(mode).option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def predictions(df: DataFrame, path: str, append: bool = False) -> None:
    """dataset, image, label, prob in a folder for each dataset."""
    df.select("dataset", "image", "label", "prob").write.mode("append" if append else "overwrite").partitionBy("dataset").option("header", True).csv(path)


def report(df: DataFrame, path: str) -> None:
    """A table of one row as a JSON object."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def scalars(df: DataFrame, path: str) -> None:
    """Appends (phase, dataset, metric, step, value)."""
    df.select("phase", "dataset", "metric", "step", "value").write.mode("append").parquet(path)


def table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)
