"""Result tables: best values, pivots, differences, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_mean(df: DataFrame, by: list[str], value: str, k: int = 3, name: str = "top_mean") -> DataFrame:
    """Mean of the k largest values of each group, of fewer where there are fewer; NaN and null are left out."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value)))).where(F.col("_r") <= k)
    return ranked.groupBy(*by).agg(F.avg(value).alias(name))


def pivoted(df: DataFrame, index: list[str], column: str, value: str, values: list[str], strict: bool = True, row_mean: str | None = None) -> DataFrame:
    """One column for each of values; strict: two rows of one cell raise, otherwise their mean counts. row_mean: name of a column with the mean of those that aren't null."""
    one = F.when(F.count(value) > 1, F.raise_error(F.lit("two values of one cell")).cast("double")).otherwise(F.max(value)) if strict else F.avg(value)
    out = df.groupBy(*index).pivot(column, values).agg(one)
    if row_mean:
        total = sum((F.coalesce(F.col(f"`{v}`"), F.lit(0.0)) for v in values), F.lit(0.0))
        count = sum((F.col(f"`{v}`").isNotNull().cast("int") for v in values), F.lit(0))
        out = out.withColumn(row_mean, total / F.nullif(count, F.lit(0)))
    return out


def transposed(df: DataFrame, key: str, keys: list[str], name: str = "name") -> DataFrame:
    """Columns to rows; keys: values of the column `key`, which become columns (of a key that repeats the largest value)."""
    cols = [c for c in df.columns if c != key]
    return df.unpivot([key], cols, name, "_v").groupBy(name).pivot(key, keys).agg(F.max("_v"))


def baseline_delta(df: DataFrame, by: list[str], variant: str, baseline: str, value: str, name: str = "delta") -> DataFrame:
    """value less that of the group's baseline row; null without one."""
    base = df.where(F.col(variant) == baseline).select(*by, F.col(value).alias("_b"))
    return df.join(base, by, "left").withColumn(name, F.col(value) - F.col("_b")).drop("_b")


def with_average(df: DataFrame, by: list[str], over: str, values: list[str], name: str = "avg") -> DataFrame:
    """df and, per group, a row `name` with the plain means of the values."""
    mean = df.groupBy(*by).agg(*(F.avg(v).alias(v) for v in values)).withColumn(over, F.lit(name))
    return df.select(*by, over, *values).unionByName(mean)


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows in the order of a list; what isn't in it comes last."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), column)


def places(df: DataFrame, column: str, order: list[str], name: str = "place") -> DataFrame:
    """The different values of a column with their place: those of a list in its order, then the others by name. Of a table of categories, which a task can hold."""
    listed = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(column))
    first = F.when(listed > 0, listed).otherwise(len(order) + 1)
    return df.select(column).distinct().withColumn(name, F.row_number().over(Window.orderBy(first, column)).cast("long"))


def mean_by_frames(df: DataFrame, path: str = "path", value: str = "Value") -> DataFrame:
    """frames, mean: per file named ..._<number>frames, in the order of that number."""
    frames = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"_(\d+)frames", 1).try_cast("int")
    return df.groupBy(frames.alias("frames")).agg(F.avg(value).alias("mean")).orderBy("frames")


def weighted_mean(value: Column | str, count: Column | str) -> Column:
    """Mean of values by their counts; nulls are left out, null without any."""
    v, n = (F.col(x) if isinstance(x, str) else x for x in (value, count))
    return F.sum(v * n) / F.nullif(F.sum(F.when(v.isNotNull(), n)), F.lit(0))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def scraped_log(lines: DataFrame, position: str = "position", text: str = "value", case_sensitive: bool = True, by: tuple[str, ...] = (), slice_lines: int = 100_000) -> DataFrame:
    """dataset, AUC, EER, ACC, AP of each `dataset: ...` block of a log; what is said last counts. Case-sensitive, a log that writes auc: gives no AUC. by: columns that tell several logs apart.

    position is a line's number. A log is read in slices of `slice_lines` numbers: the last header of each slice is carried into the
    next ones, within a slice each line takes the header before it. So a task holds a slice at most, and one row for each slice.
    """
    flag = "" if case_sensitive else "(?i)"
    name = F.nullif(F.regexp_extract(text, r"^\s*dataset:\s*(\S+)", 1), F.lit(""))
    named = lines.select(*by, F.col(position).alias("_at"), F.col(text).alias("_text"), name.alias("_name"), F.floor(F.col(position) / slice_lines).alias("_slice"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = named.groupBy(*by, "_slice").agg(F.max_by("_name", F.when(F.col("_name").isNotNull(), F.col("_at"))).alias("_last"))
    heads = heads.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_slice").alias("_slice2"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    same = F.col("_slice") == F.col("_slice2")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    own = F.last("_name", ignorenulls=True).over(Window.partitionBy(*by, "_slice").orderBy("_at"))
    tagged = named.withColumn("_own", own).join(heads, same).withColumn("dataset", F.coalesce("_own", "_carried"))

    def last(m: str) -> Column:
        value = F.nullif(F.regexp_extract("_text", rf"{flag}\b{m}:\s*([0-9.]+)", 1), F.lit("")).try_cast("double")
        return F.max_by(value, F.when(value.isNotNull(), F.col("_at"))).alias(m)

    return tagged.where("dataset IS NOT NULL").groupBy(*by, "dataset").agg(*(last(m) for m in ("AUC", "EER", "ACC", "AP")))


def zipped(parts: list[DataFrame], position: str) -> DataFrame:
    """Lists of values brought together by an explicit position; positions that a list lacks are left out."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, position)
    return out
