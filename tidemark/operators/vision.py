"""Predictions of clips and boxes, as tables: ensembles, detection precision, curve fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import curve


def ensemble(df: DataFrame, clip: str, preds: str, num_clips: int, how: str = "sum", multi_label: bool = False) -> DataFrame:
    """video, preds, clips: predictions of all clips of a video by class, summed or at their largest. video = clip // num_clips.

    Sums and maxima begin at 0 (of several labels at -1e10, which then is part of the sum).
    """
    start = -1e10 if multi_label else 0.0
    long = df.select(F.floor(F.col(clip) / num_clips).cast("long").alias("video"), F.col(clip).alias("_c"), F.posexplode(preds).alias("cls", "p"))
    value = {"sum": F.sum("p") + F.lit(start), "max": F.greatest(F.max("p"), F.lit(start))}[how]
    per = long.groupBy("video", "cls").agg(value.cast("double").alias("p"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "p"))), lambda x: x["p"]).alias("preds"), F.max("n").alias("clips"))


def incomplete(videos: DataFrame, num_clips: int) -> DataFrame:
    """Videos of which not every clip is there."""
    return videos.where(F.col("clips") != num_clips)


def iou(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2)."""
    (ax, ay, az, aw), (bx, by, bz, bw) = (tuple(F.col(c) for c in t) for t in (a, b))
    inter = F.greatest(F.least(az, bz) - F.greatest(ax, bx), F.lit(0.0)) * F.greatest(F.least(aw, bw) - F.greatest(ay, by), F.lit(0.0))
    return F.try_divide(inter, (az - ax) * (aw - ay) + (bz - bx) * (bw - by) - inter)


def detection_precision(truth: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """action_id, ap, positives by the usual rule: of detections in order of score each takes the best true box of its image and class if no better-scored one has; what takes none is false. Of equals, boxes further left, then higher up, come first.

    truth: key, action_id, x1, y1, x2, y2; found: the same and score.
    """
    t = truth.select("key", "action_id", *(F.col(c).cast("double").alias(f"t{c}") for c in ("x1", "y1", "x2", "y2"))).withColumn("_t", F.monotonically_increasing_id())
    d = found.select("key", "action_id", "score", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))).withColumn("_d", F.monotonically_increasing_id())
    overlap = d.join(t, ["key", "action_id"]).withColumn("iou", iou(("x1", "y1", "x2", "y2"), ("tx1", "ty1", "tx2", "ty2"))).where(F.col("iou") >= threshold)
    best = overlap.groupBy("_d").agg(F.max_by("_t", F.struct("iou", *((-F.col(c)).alias(c) for c in ("tx1", "ty1", "tx2", "ty2", "_t")))).alias("_t"))
    taken = d.drop("key", "action_id").join(best, "_d").withColumn("_r", F.row_number().over(Window.partitionBy("_t").orderBy(F.desc("score"), "x1", "y1", "x2", "y2", "_d"))).where("_r = 1").select("_d", F.lit(1).alias("hit"))
    labelled = d.join(taken, "_d", "left").select("action_id", F.col("score").alias("prob"), F.coalesce("hit", F.lit(0)).alias("label"))
    c = curve(labelled, by=("action_id",))
    # The curve's precision at each score, but recall by all true boxes, found or not.
    positives = truth.groupBy("action_id").agg(F.count(F.lit(1)).alias("positives"))
    ap = c.groupBy("action_id").agg(F.sum(F.col("tp") * F.col("ctp") / (F.col("ctp") + F.col("cfp"))).alias("s"))
    return positives.join(ap, "action_id", "left").select("action_id", (F.coalesce("s", F.lit(0.0)) / F.col("positives")).alias("ap"), "positives")


def sampled_truth(df: DataFrame, key: str = "key", every: int = 4) -> DataFrame:
    """Rows whose key's second is a multiple of `every`; keys are `video,second`."""
    return df.where(F.try_element_at(F.split(key, ","), F.lit(2)).try_cast("int") % every == 0)


def without_excluded(df: DataFrame, excluded: DataFrame, key: str = "key") -> DataFrame:
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def quadratic_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, a, b, c, r2 of the least-squares parabola a x^2 + b x + c by normal equations; with fewer than three different x a line (a = 0), with one a constant."""
    x_, y_ = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(x_.isNotNull() & y_.isNotNull())
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_distinct(x_).alias("k"), *(F.sum(F.pow(x_, i)).alias(f"s{i}") for i in (1, 2, 3, 4)),
        F.sum(y_).alias("t0"), F.sum(x_ * y_).alias("t1"), F.sum(x_ * x_ * y_).alias("t2"), F.sum(y_ * y_).alias("yy"),
    )
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    det = F.nullif(s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2), F.lit(0.0))
    a = (t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / det
    b = (s4 * (t1 * n - t0 * s1) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / det
    c = (s4 * (s2 * t0 - s1 * t1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2)) / det
    line = F.nullif(n * s2 - s1 * s1, F.lit(0.0))
    pick = lambda q, l, k0: F.when(F.col("k") >= 3, q).when(F.col("k") == 2, l).otherwise(k0)  # noqa: E731, E741
    fit = s.select("*", pick(a, F.lit(0.0), F.lit(0.0)).alias("a"), pick(b, (n * t1 - s1 * t0) / line, F.lit(0.0)).alias("b"), pick(c, (s2 * t0 - s1 * t1) / line, t0 / n).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    rest = F.col("yy") - 2 * (a * t2 + b * t1 + c * t0) + a * a * s4 + 2 * a * b * s3 + (b * b + 2 * a * c) * s2 + 2 * b * c * s1 + c * c * n
    total = F.col("yy") - t0 * t0 / n
    return fit.select(*by, "a", "b", "c", F.when(total > 0, 1 - rest / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0)).alias("r2"))


def probe_grid(df: DataFrame, noises: list[str], strengths: list[float]) -> DataFrame:
    """Each row with every noise and strength that it is to be probed with."""
    steps = F.array(*(F.struct(F.lit(n).alias("noise"), F.lit(s).alias("strength")) for n in noises for s in strengths))
    return df.select("*", F.inline(steps))
