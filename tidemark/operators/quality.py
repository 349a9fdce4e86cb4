"""Checks of tables: columns, ranges, keys, coverage, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import parse_double
from tidemark.operators.keyed import duplicates
from tidemark.operators.metrics import auc_if_labelled


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df; raises if a column is missing or there is no row."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def range_check(df: DataFrame, column: str, key: str, low: float = 0.0, high: float = 1.0, examples: int = 10) -> DataFrame:
    """One row: rows, missing, not_float, nan_or_inf, out_of_range, bad (any of them) and the first keys of bad rows."""
    text, x = F.col(column).cast("string"), parse_double(column)
    missing = text.isNull() | (text == "")
    odd = F.isnan(x) | x.isin(float("inf"), float("-inf"))
    kind = F.when(missing, "missing").when(x.isNull(), "not_float").when(odd, "nan_or_inf").when((x < low) | (x > high), "out_of_range")
    rows = df.select(F.col(key).cast("string").alias("k"), kind.alias("kind"))
    first = rows.where("kind IS NOT NULL").orderBy("k").limit(examples).agg(F.array_sort(F.collect_list("k")).alias("examples"))
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "not_float", "nan_or_inf", "out_of_range")), F.count("kind").alias("bad"))
    return counts.crossJoin(F.broadcast(first))


def unique_check(df: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """One row: keys that occur more than once, and the first of them."""
    d = duplicates(df, [key])
    first = d.orderBy(key).limit(examples).agg(F.array_sort(F.collect_list(F.col(key).cast("string"))).alias("examples"))
    return d.agg(F.count(F.lit(1)).alias("duplicate_keys")).crossJoin(F.broadcast(first))


def join_coverage(base: DataFrame, other: DataFrame, key: str, examples: int = 10) -> DataFrame:
    """One row: distinct keys of both, of base only, of other only, coverage of base, and first examples of either remainder."""
    a, b = base.select(key).where(F.col(key).isNotNull()).distinct(), other.select(key).where(F.col(key).isNotNull()).distinct()
    less, more = a.join(b, key, "left_anti"), b.join(a, key, "left_anti")
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    eg = lambda df, name: df.orderBy(key).limit(examples).agg(F.array_sort(F.collect_list(F.col(key).cast("string"))).alias(name))
    out = n(a, "base_keys")
    for part in (n(b, "other_keys"), n(less, "missing"), n(more, "extra"), eg(less, "missing_examples"), eg(more, "extra_examples")):
        out = out.crossJoin(F.broadcast(part))
    return out.withColumn("coverage", (F.col("base_keys") - F.col("missing")) / F.greatest("base_keys", F.lit(1)))


def report(content: DataFrame, provenance: DataFrame, propagation: DataFrame, aggregate: DataFrame) -> DataFrame:
    """One row of structs: range and key checks of each table, coverage of content by each other one, and the AUC of the risk if all rows are labelled."""
    tables = {"content": (content, "content_score"), "provenance": (provenance, "cred_score"), "propagation": (propagation, "early_risk"), "aggregate": (aggregate, "p2p_risk")}
    out = auc_if_labelled(aggregate, "p2p_risk_raw" if "p2p_risk_raw" in aggregate.columns else "p2p_risk").select("auc")
    for name, (df, column) in tables.items():
        require(df, ["image", column])
        checks = range_check(df, column, "image").crossJoin(unique_check(df, "image").withColumnRenamed("examples", "duplicate_examples"))
        out = out.crossJoin(F.broadcast(checks.select(F.struct("*").alias(name))))
    for name in ("provenance", "propagation", "aggregate"):
        out = out.crossJoin(F.broadcast(join_coverage(content, tables[name][0], "image").select(F.struct("*").alias(f"{name}_coverage"))))
    return out


def require_classes(df: DataFrame, label: str = "label", least: int = 2) -> DataFrame:
    """df; raises if it has fewer than `least` classes."""
    n = df.select(label).where(F.col(label).isNotNull()).distinct().limit(least).count()
    if n < least:
        raise ValueError(f"{label} has {n} class(es); {least} are needed")
    return df


def usable_features(df: DataFrame, path: str = "path", label: str = "label", failed: str = "failed") -> DataFrame:
    """df without failed rows; if fewer than two classes are left, labels are told from the paths (/0_real/, /1_fake/, then fake, then real)."""
    rows = df.where(~F.coalesce(F.col(failed), F.lit(False))) if failed in df.columns else df
    several = rows.agg((F.count_distinct(label) >= 2).alias("_s"))
    p = F.lower(path)
    told = F.when(p.contains("/0_real/"), 0).when(p.contains("/1_fake/"), 1).when(p.contains("fake"), 1).when(p.contains("real"), 0).otherwise(F.col(label))
    return rows.crossJoin(F.broadcast(several)).withColumn(label, F.when(F.col("_s"), F.col(label)).otherwise(told)).drop("_s")
