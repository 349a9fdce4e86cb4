"""Readers. Tables of strings stay strings until they are used; parse with functions.numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import strip
from tidemark.operators.keyed import last_wins, union_priority
from tidemark.sources.schemas import POSTS, WEBMETA


def csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, position: str | None = None) -> DataFrame:
    """A CSV with a header, all strings. columns: its header, if it should not be read from the file. position: name of a column with the order of rows (that of files and places in them)."""
    reader = spark.read.option("header", True).option("multiLine", False)
    df = (reader.schema(", ".join(f"`{c}` string" for c in columns)) if columns else reader).csv(path)
    if not position:
        return df
    # Numbers ascend with the file's name, the place of the split in the file and the row within the split, whatever order Spark reads splits in.
    rows = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    return rows.withColumn(position, F.struct("_f", "_b", "_i")).drop("_f", "_b", "_i")


def keyed_csv(spark: SparkSession, path: str, key: str = "image", columns: list[str] | None = None) -> DataFrame:
    """One row a key: the last one's values. Raises where the table has no such column."""
    df = csv(spark, path, columns, "_position")
    if key not in df.columns:
        raise KeyError(f"{path} has no column {key}")
    return last_wins(df, [key], "_position").drop("_position")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines and those that are no JSON object are left out. A field of another type than the schema's is null, the rest of its record stays."""
    lines_ = spark.read.text(path).where(F.trim("value") != "")
    whole = F.try_parse_json("value") if hasattr(F, "try_parse_json") else None
    ok = F.schema_of_variant(whole).startswith("OBJECT") if whole is not None else strip("value").rlike(r"^\{.*\}$")
    return lines_.where(F.coalesce(ok, F.lit(False))).select(F.from_json("value", schema).alias("r")).select("r.*")


def webmeta(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, WEBMETA)


def posts(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, POSTS)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: lines without white space at their ends, blank ones left out."""
    return spark.read.text(path).select(strip("value").alias("value")).where("value <> ''")


def manifest_text(spark: SparkSession, path: str) -> DataFrame:
    """value: each file as one text."""
    return spark.read.text(path, wholetext=True)


def listing(spark: SparkSession, path: str, must_contain: str = "", extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "bmp"), second_token: bool = True) -> DataFrame:
    """path, length of files below a folder, contents unread. second_token: a name's extension is what follows its first dot (so a.b.png has `b`), else what follows its last one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    parts = F.split(name, r"\.")
    ext = F.when(F.size(parts) > 1, F.element_at(parts, 2)) if second_token else F.when(F.size(parts) > 1, F.element_at(parts, -1))
    return files.where(F.col("path").contains(must_contain) & F.lower(ext).isin([e.lower() for e in extensions]))


def blobs(spark: SparkSession, path: str, root: str, skip_containing: str | None = None) -> DataFrame:
    """key (path below root), value: a folder as a key-value table; skip_containing: leave out folders whose whole path has this in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    key = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.rstrip("/").replace("+", r"\+") + "/", "")
    rows = files.select(key.alias("key"), F.col("content").alias("value"), "path")
    return (rows.where(~F.col("path").contains(skip_containing)) if skip_containing else rows).drop("path")


def single_level(spark: SparkSession, pattern: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "bmp")) -> DataFrame:
    """path, length of the files in the folders of a glob, not below them, in the order of their paths."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin([e.lower() for e in extensions])).orderBy("path")


def file_list(spark: SparkSession, path: str, must_contain: str = "") -> DataFrame:
    """path: the lines of a list of files (a text; never a pickle) that have must_contain in them."""
    return lines(spark, path).where(F.col("value").contains(must_contain)).select(F.col("value").alias("path"))


def ordered(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A table in the order of its keys."""
    return spark.read.parquet(path).orderBy(key)


def metric_series(spark: SparkSession, pattern: str, folders: bool = False) -> DataFrame:
    """detector, dataset, Step, Value from files <detector>/test_<dataset>_auc.csv below a glob. folders: what is named so are folders of part files."""
    df = spark.read.option("header", True).schema("Step int, Value double").csv(pattern).withColumn("_path", F.col("_metadata.file_path"))
    parts = F.split("_path", "/")
    parts = F.slice(parts, 1, F.size(parts) - 1) if folders else parts
    return df.select(F.element_at(parts, -2).alias("detector"), F.regexp_extract(F.element_at(parts, -1), r"^test_(.*)_[^_]*\.csv$", 1).alias("dataset"), "Step", "Value")


def boxes(spark: SparkSession, path: str, whitelist: list[int] | None = None) -> DataFrame:
    """key (`video,second` with four digits), action_id, x1..y2, score (1 where the file has none) from a table without header."""
    df = spark.read.schema("video string, ts string, x1 double, y1 double, x2 double, y2 double, action_id int, score double").csv(path)
    out = df.select(F.concat_ws(",", "video", F.format_string("%04d", F.col("ts").cast("double").cast("int"))).alias("key"), "action_id", "x1", "y1", "x2", "y2", F.coalesce("score", F.lit(1.0)).alias("score"))
    return out.where(F.col("action_id").isin(whitelist)) if whitelist is not None else out


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """id, name of a text of blocks with a name: line and an id: or label_id: line each."""
    text = spark.read.text(path, wholetext=True)
    pattern = r'name:\s*"([^"]*)"\s*(?:label_)?id:\s*(\d+)'
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("id"), F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("name"))
    return text.select(F.inline(pairs)).select(F.col("id").cast("int").alias("id"), "name")


def merged_settings(*layers: dict, fill_in: dict | None = None) -> dict:
    """Settings of later layers over those of earlier ones; nested ones too. fill_in only adds what is missing."""

    def over(a: dict, b: dict) -> dict:
        return a | {k: over(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    out: dict = {}
    for layer in layers:
        out = over(out, layer)
    return over(fill_in, out) if fill_in else out


def resolved(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of several readers, the earlier reader first."""
    return union_priority(sources, [key])
