"""Ranking-quality metrics from one curve.

`curve` collapses equal scores first, then forms running counts in two steps: scores are
cut into ranges at approximate quantiles (at most RANGES a table), the ranges' totals are
summed in order, and each range runs its own window with what lies above as an offset.
So no window holds a whole table, whatever the number of distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import quantiles

RANGES = 64


def binary(label: Column | str, above: int | None = None) -> Column:
    """1 for any label but 0; with above, 1 for labels from `above` on."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c >= above, 1).otherwise(0) if above is not None else F.when(c != 0, 1).otherwise(0)


def curve(df: DataFrame, score: str = "prob", label: str = "label", by: tuple[str, ...] = (), ranges: int = RANGES) -> DataFrame:
    """by, score, tp, fp (rows with exactly this score), ctp, cfp (with this or a higher one), p, n (all), next_tp, next_fp (of the next lower score). Labels other than 0 and 1 and null scores are left out."""
    by = list(by)
    rows = df.select(*by, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("_y")).where(F.col("score").isNotNull() & F.col("_y").isin(0, 1))
    rows = rows.groupBy(*by, "score").agg(F.sum("_y").alias("tp"), F.sum(1 - F.col("_y")).alias("fp"))
    cuts = rows.agg(F.percentile_approx("score", F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(1000)).alias("_cuts"))
    rows = rows.crossJoin(F.broadcast(cuts)).withColumn("_r", F.size(F.filter(F.coalesce("_cuts", F.expr("array()").cast("array<double>")), lambda c: c > F.col("score")))).drop("_cuts")
    totals = rows.groupBy(*by, "_r").agg(F.sum("tp").alias("_tp"), F.sum("fp").alias("_fp"), F.max_by(F.struct("tp", "fp"), "score").alias("_head"))
    order = Window.partitionBy(*by).orderBy("_r")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    totals = totals.select(
        *by, "_r",
        F.coalesce(F.sum("_tp").over(before), F.lit(0)).alias("_tp0"), F.coalesce(F.sum("_fp").over(before), F.lit(0)).alias("_fp0"),
        F.sum("_tp").over(every).alias("p"), F.sum("_fp").over(every).alias("n"), F.lead("_head").over(order).alias("_next"),
    )
    rows = rows.join(totals, [*by, "_r"])
    inner = Window.partitionBy(*by, "_r").orderBy(F.desc("score"))
    run = inner.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        *by, "score", "tp", "fp",
        (F.col("_tp0") + F.sum("tp").over(run)).alias("ctp"), (F.col("_fp0") + F.sum("fp").over(run)).alias("cfp"), "p", "n",
        F.coalesce(F.lead("tp").over(inner), F.col("_next.tp")).alias("next_tp"), F.coalesce(F.lead("fp").over(inner), F.col("_next.fp")).alias("next_fp"),
    )


def roc_points(c: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, score, fpr, tpr from a curve; null where a class has no rows."""
    return c.select(*by, "score", (F.col("cfp") / F.nullif("n", F.lit(0))).alias("fpr"), (F.col("ctp") / F.nullif("p", F.lit(0))).alias("tpr"))


def _auc() -> Column:
    return F.try_divide(F.sum(F.col("fp") * (F.col("ctp") - F.col("tp") + F.col("tp") / 2)), F.max("p") * F.max("n"))


def _ap() -> Column:
    return F.try_divide(F.sum(F.col("tp") * F.col("ctp") / (F.col("ctp") + F.col("cfp"))), F.max("p"))


def _eer(prune: bool) -> Column:
    fpr, fnr = F.try_divide("cfp", "n"), 1 - F.try_divide("ctp", "p")
    # A point between two equal steps lies on a line with its neighbours; first and last point always stay.
    kept = (F.col("next_tp").isNull() | (F.col("ctp") + F.col("cfp") == F.col("tp") + F.col("fp")) | (F.col("next_tp") != F.col("tp")) | (F.col("next_fp") != F.col("fp"))) if prune else F.lit(True)
    best = F.min(F.when(kept & fpr.isNotNull() & fnr.isNotNull(), F.struct(F.abs(fnr - fpr).alias("gap"), (-F.col("score")).alias("o"), fpr.alias("fpr"))))
    return F.when(best["gap"] >= 1, F.lit(0.0)).otherwise(best["fpr"])  # the curve begins at (0, 0), where the gap is 1


def summary(c: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, auc, ap, eer (on the pruned curve), eer_unpruned, positives, negatives from a curve."""
    out = c.groupBy(*by) if by else c
    return out.agg(_auc().alias("auc"), _ap().alias("ap"), _eer(True).alias("eer"), _eer(False).alias("eer_unpruned"), F.max("p").alias("positives"), F.max("n").alias("negatives"))


def auc_if_labelled(df: DataFrame, score: str = "prob", label: str = "label", skip_unlabelled: bool = False) -> DataFrame:
    """auc; null if any label is neither 0, 1 nor null (so one -1 turns it off), unless those rows are to be skipped."""
    odd = df.agg(F.count_if(~F.col(label).isin(0, 1)).alias("odd"))
    out = summary(curve(df, score, label)).select("auc").crossJoin(F.broadcast(odd))
    return out.select((F.col("auc") if skip_unlabelled else F.when(F.col("odd") == 0, F.col("auc"))).alias("auc"))


def accuracy(df: DataFrame, score: str = "prob", label: str = "label", threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """by, accuracy and the accuracies within label 0 and label 1 of `score > threshold`."""
    hit = ((F.col(score) > threshold).cast("int") == F.col(label)).cast("double")
    return df.groupBy(*by).agg(F.avg(hit).alias("acc"), F.avg(F.when(F.col(label) == 0, hit)).alias("r_acc"), F.avg(F.when(F.col(label) == 1, hit)).alias("f_acc"))


def best_threshold(df: DataFrame, score: str = "prob", label: str = "label", position: str = "position") -> DataFrame:
    """threshold and accuracy: the score that as a lower bound of class 1 is right most often, of equals that of the last row; where the classes are separate, the middle between them."""
    c = curve(df, score, label).select("score", ((F.col("ctp") + F.col("n") - F.col("cfp")) / (F.col("p") + F.col("n"))).alias("acc"))
    last = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.max(position).alias("last"))
    best = c.join(last, "score").agg(F.max(F.struct("acc", "last", "score")).alias("b"))
    ends = df.agg(F.max(F.when(F.col(label) == 0, F.col(score))).alias("a"), F.min(F.when(F.col(label) == 1, F.col(score))).alias("z"))
    apart = F.col("a") <= F.col("z")
    return best.crossJoin(F.broadcast(ends)).select(F.when(apart, (F.col("a") + F.col("z")) / 2).otherwise(F.col("b.score")).alias("threshold"), F.when(apart, F.lit(1.0)).otherwise(F.col("b.acc")).alias("acc"))


def by_group(df: DataFrame, group: Column, score: str = "prob", label: str = "label") -> DataFrame:
    """group, prob (mean) and label (mean cut to an integer, so a mixed group is 0): frames to videos."""
    return df.groupBy(group.alias("group")).agg(F.avg(score).alias("prob"), F.floor(F.avg(label)).cast("int").alias("label"))


def top_k(df: DataFrame, scores: str, label: str, k: int) -> DataFrame:
    """hits, rows, accuracy, error: whether the label's class (from 0) is among the k highest scores, of equals the lower class first."""
    mine = F.try_element_at(F.col(scores), F.col(label).cast("int") + 1)
    pairs = F.arrays_zip(F.col(scores).alias("s"), F.sequence(F.lit(0), F.size(scores) - 1).alias("i"))
    above = F.size(F.filter(pairs, lambda x: (x["s"] > mine) | ((x["s"] == mine) & (x["i"] < F.col(label)))))
    hit = F.coalesce(above < k, F.lit(False)).cast("int")
    return df.agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("rows"), F.avg(hit).alias("accuracy"), (1 - F.avg(hit)).alias("error"))


def mean_average_precision(df: DataFrame, label: str = "label", score: str = "prob", by: str = "class") -> DataFrame:
    """map: mean over the classes that have a positive of their average precision; classes counted."""
    per = summary(curve(df, score, label, (by,)), (by,)).where("positives > 0")
    return per.agg(F.avg("ap").alias("map"), F.count(F.lit(1)).alias("classes"))


def mean_roc(c: DataFrame, by: str, points: int = 100) -> DataFrame:
    """fpr, tpr: true-positive rates of all groups' curves, interpolated at evenly spaced false-positive rates and averaged; the first is 0, the last 1."""
    steps = roc_points(c, (by,)).groupBy(by, "fpr").agg(F.max("tpr").alias("hi"), F.min("tpr").alias("lo"))
    w = Window.partitionBy(by).orderBy("fpr")
    # The curve begins at (0, 0); between two rates it goes from the highest value at the lower to the lowest value at the upper one.
    spans = steps.select(by, F.coalesce(F.lag("fpr").over(w), F.lit(0.0)).alias("x0"), F.coalesce(F.lag("hi").over(w), F.lit(0.0)).alias("y0"), F.col("fpr").alias("x1"), F.col("lo").alias("y1"), F.col("hi").alias("top"))
    last = points - 1
    # Both ends count, so that 0 has a value where every score has false positives; where spans meet, the higher value is taken below.
    grid = spans.withColumn("i", F.explode(F.filter(F.sequence(F.floor(F.col("x0") * last), F.ceil(F.col("x1") * last)), lambda i: (i / last).between(F.col("x0"), F.col("x1")))))
    x = F.col("i") / last
    at = F.when(x >= F.col("x1"), F.col("top")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (x - F.col("x0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0)))
    mean = grid.groupBy(by, "i").agg(F.max(at).alias("y")).groupBy("i").agg(F.avg("y").alias("y"))
    return mean.select(x.alias("fpr"), F.when(F.col("i") == 0, F.lit(0.0)).when(F.col("i") == last, F.lit(1.0)).otherwise(F.col("y")).alias("tpr"))


def trapezoid(df: DataFrame, x: str = "fpr", y: str = "tpr") -> DataFrame:
    """area under a short list of points (a grid); all in one task."""
    w = Window.orderBy(x)
    return df.select((F.col(x) - F.lag(x).over(w)).alias("dx"), ((F.col(y) + F.lag(y).over(w)) / 2).alias("m")).agg(F.sum(F.col("dx") * F.col("m")).alias("area"))


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """bin (from 1), n: equal widths from minimum to maximum, the maximum in the last bin."""
    rows = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    ends = rows.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    place = F.when(F.col("b") == F.col("a"), F.lit(bins // 2 + 1)).otherwise(F.least(F.floor((F.col("x") - F.col("a")) / F.nullif(width, F.lit(0.0))) + 1, F.lit(bins)))
    return rows.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def branches(df: DataFrame, scores: list[str], label: str = "label") -> DataFrame:
    """branch, ap, acc for each of several score columns."""
    long = df.select(label, F.explode(F.array(*(F.struct(F.lit(s).alias("branch"), F.col(s).cast("double").alias("prob")) for s in scores))).alias("b")).select(F.col(label).alias("label"), "b.*")
    ap = summary(curve(long, by=("branch",)), ("branch",)).select("branch", "ap")
    return ap.join(accuracy(long, by=("branch",)).select("branch", "acc"), "branch")


def median_threshold(df: DataFrame, score: str = "prob", label: str = "label") -> DataFrame:
    """threshold (the median score of label 0, as of a model of real items only) and the accuracy of `score >= threshold`; one row."""
    middle = quantiles(df.where(F.col(label) == 0), score, [0.5]).select(F.col("q0").alias("threshold"))
    hit = ((F.col(score) >= F.col("threshold")).cast("int") == F.col(label)).cast("double")
    return df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull()).crossJoin(F.broadcast(middle)).agg(F.max("threshold").alias("threshold"), F.avg(hit).alias("acc"))
