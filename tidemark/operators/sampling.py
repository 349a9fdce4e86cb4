"""Frames, clips, samples, folds. Every random choice is an order by md5 of a seed and a key, so it can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import numbered, shuffle_slice


def shuffle_key(key: Column | str, seed: int | str = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def shuffled(df: DataFrame, by: list[str], key: str, seed: int | str, name: str) -> DataFrame:
    """df with the number of each row in the shuffled order of its group, from 1."""
    return numbered(df, by, [shuffle_key(key, seed), F.col(key)], name, shuffle_slice(shuffle_key(key, seed)))


def numeric_order(frames: Column) -> Column:
    """Frame names by the number before their extension; what has none comes last, by name."""
    number = lambda x: F.coalesce(F.regexp_extract(x, r"(\d+)\.[^./\\]*$", 1).try_cast("long"), F.lit((1 << 62)))
    return F.transform(F.array_sort(F.transform(frames, lambda x: F.struct(number(x).alias("n"), x.alias("f")))), lambda x: x["f"])


def first_frames(frames: Column, n: int, evenly: bool = False) -> Column:
    """The first n frames. evenly: every (total // n)-th instead, which is what the name of this step promises elsewhere."""
    if not evenly:
        return F.slice(frames, 1, n)
    step = F.greatest(F.floor(F.size(frames) / n), F.lit(1))
    return F.slice(F.filter(frames, lambda x, i: i % step == 0), 1, n)


def clips(frames: Column, length: int) -> Column:
    """Clips of `length` frames as an array of (clip, start, frames); starts spread evenly over the video, none where it is shorter than one clip."""
    total = F.size(frames)
    k = F.floor(total / length).cast("int")
    step = F.when(k > 1, F.floor((total - length) / F.nullif(k - 1, F.lit(0)))).otherwise(F.lit(0)).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.struct(i.alias("clip"), (i * step).alias("start"), F.slice(frames, i * step + 1, length).alias("frames")))
    return F.when(k >= 1, made).otherwise(F.slice(made, 1, 0))


def picked_frames(total: Column, k: int) -> Column:
    """Numbers of at most k frames, evenly from first to last, cut to integers; repeated ones once."""
    at = lambda i: F.floor(i * (total - 1) / F.lit(float(max(k - 1, 1)))).cast("long")
    return F.when(total > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), at))).otherwise(F.expr("array()").cast("array<bigint>"))


def balanced_first(df: DataFrame, label: str, position: str) -> DataFrame:
    """Of each class its first rows by position, as many as the smallest class has."""
    counted = numbered(df, [label], [F.col(position)], "_r")
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("_m"))
    return counted.crossJoin(F.broadcast(least)).where("_r <= _m").drop("_r", "_m")


def sample_per_class(df: DataFrame, label: str, key: str, most: int | None = None, fallback: int = 100, seed: int | str = 0) -> DataFrame:
    """`most` rows of each class in shuffled order; where some class has fewer, `fallback` of each; without `most`, as many as the smallest class has."""
    ranked = shuffled(df, [label], key, seed, "_r")
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("_m"))
    n = F.col("_m") if most is None else F.when(F.col("_m") < most, F.lit(fallback)).otherwise(F.lit(most))
    return ranked.crossJoin(F.broadcast(least)).where(F.col("_r") <= n).drop("_r", "_m")


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int | str = 418, name: str = "fold") -> DataFrame:
    """df with a fold from 0 to k-1, dealt within each class in shuffled order."""
    return shuffled(df, [label], key, seed, "_r").withColumn(name, (F.col("_r") - 1) % k).drop("_r")


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    return df.join(df.groupBy(label).agg((1 / F.count(F.lit(1))).alias(name)), label)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int | str = 0) -> DataFrame:
    """n rows, drawn without replacement by their weights: those with the smallest -ln(u) / weight, where u is a hash of the key between 0 and 1. Rows without a positive weight are never drawn."""
    u = (F.conv(F.substring(shuffle_key(key, seed), 1, 12), 16, 10).cast("double") + 1) / F.lit(float((1 << 48) + 1))
    return df.where(F.col(weight) > 0).withColumn("_u", -F.ln(u) / F.col(weight)).orderBy("_u", key).limit(n).drop("_u")


def resampled(df: DataFrame, group: str, key: str, seed: int | str = 418) -> DataFrame:
    """Every group repeated to the size of the largest one: whole copies, then a shuffled remainder."""
    size = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    size = size.crossJoin(F.broadcast(size.agg(F.max("_n").alias("_top"))))
    ranked = shuffled(df, [group], key, seed, "_r").join(size, group)
    copies = F.floor(F.col("_top") / F.col("_n")) + F.when(F.col("_r") <= F.col("_top") % F.col("_n"), 1).otherwise(0)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_r", "_n", "_top")


def swapped_within_class(df: DataFrame, label: str, key: str, seed: int | str = 0, name: str = "partner") -> DataFrame:
    """df with the key of another row of the class (or the same), a permutation within the class."""
    a = numbered(df, [label], [F.col(key)], "_r")
    b = shuffled(df.select(label, key), [label], key, seed, "_r").withColumnRenamed(key, name)
    return a.join(b, [label, "_r"]).drop("_r")


def random_pairs(fake: DataFrame, real: DataFrame, key: str, seed: int | str = 0) -> DataFrame:
    """fake, each row with the key of one real row as `pair`, picked by a hash; real's rows are numbered in shuffled order."""
    numbers = shuffled(real.select(F.col(key).alias("pair")), [], "pair", seed, "_i").withColumn("_i", F.col("_i") - 1)
    n = real.agg(F.count(F.lit(1)).alias("_n"))
    pick = F.pmod(F.conv(F.substring(shuffle_key(key, f"{seed}p"), 1, 12), 16, 10).cast("long"), F.nullif("_n", F.lit(0)))
    return fake.crossJoin(F.broadcast(n)).withColumn("_i", pick).join(numbers, "_i", "left").drop("_i", "_n")


def limited(df: DataFrame, source: str, position: str, limit: int, sources: int, least: int = 5) -> DataFrame:
    """At most max(least, ceil(limit / sources)) rows of each source, then at most `limit` in the order of the sources."""
    per = max(least, -(-limit // max(sources, 1)))
    own = df.withColumn("_r", F.row_number().over(Window.partitionBy(source).orderBy(position))).where(F.col("_r") <= per).drop("_r")
    return own.orderBy(source, position).limit(limit)


def group_frames(pairs: DataFrame, methods: list[str], n: int, seed: int | str = 0) -> DataFrame:
    """Per pair of videos one frame number below n, shared by the real one and its fakes of each method: (a, b, frame, method), method 'real' first."""
    frame = F.pmod(F.conv(F.substring(shuffle_key(F.concat_ws("_", "a", "b"), seed), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
    names = F.array(*(F.struct(F.lit(i).alias("slot"), F.lit(m).alias("method")) for i, m in enumerate(["real", *methods])))
    return pairs.select("a", "b", frame.alias("frame"), F.inline(names))
