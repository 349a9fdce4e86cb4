"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Nothing is collected: each step is an aggregation and a join, its result a table in
the shared folder. The driver only sees a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import discard, stored


def _large(edges: DataFrame) -> DataFrame:
    """May repeat edges; an edge gives one at most."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and checksums. (Not by an Observation: a session that has had one can't be serialised, which models of MLlib need.)"""
    table = stored(edges, "edges")
    return table, tuple(table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge but those that are the smallest of their component, as a table. Loops and repeated edges don't matter; null ends are no edge."""
    spark = edges.sparkSession
    low, high = F.least(a, b), F.greatest(a, b)
    now, state = _kept(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(high.cast("long").alias("u"), low.cast("long").alias("v")).where("u <> v").distinct())
    while state[0]:
        new, after = _kept(_small(_large(now)))
        discard(spark, now)
        now, before, state = new, state, after
        if state == before:
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found.stored_at = now.stored_at
    return found


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; a component's id is its smallest node."""
    now = stars(edges, a, b)
    return now.unionByName(now.select(F.col("component").alias("node"), "component").distinct())
