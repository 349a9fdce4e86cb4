"""Engagement: growth features of posts, aggregates of their media, consolidation, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions.stats import two_sided
from tidemark.functions.text import posting_id
from tidemark.operators.ranking import mean_ranks

HOURS = (1, 6, 24)


def propagation_features(posts: DataFrame, snapshot: float | None = None, min_age_minutes: float = 1.0, multiplier: float = 1.5) -> DataFrame:
    """The 31 growth features of each post that has an id.

    posts: posting_id or platform and post_id, created_utc, score, num_comments, upvote_ratio. The snapshot is by
    default an hour after the latest creation. A post without a creation time is as old as the least age.
    """
    has = set(posts.columns)
    get = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in has else F.lit(0.0)
    text = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    least = min_age_minutes / 60 if min_age_minutes > 0 else 1 / 60
    base = posts.select(posting_id(text("posting_id"), text("platform"), text("post_id")).alias("posting_id"), F.nullif(get("created_utc"), F.lit(0.0)).alias("created"), get("score").alias("score"), get("num_comments").alias("num_comments"), get("upvote_ratio").alias("ratio"))
    base = base.where(F.col("posting_id").isNotNull())
    if snapshot is None:
        base = base.crossJoin(F.broadcast(base.agg((F.max("created") + 3600).alias("_at"))))
    else:
        base = base.withColumn("_at", F.lit(float(snapshot)))
    base = base.withColumn("age", F.greatest((F.col("_at") - F.coalesce("created", "_at")) / 3600, F.lit(least)))
    s, c, age = F.col("score"), F.col("num_comments"), F.col("age")
    fit = base.select(
        "*", N.capacity(s, multiplier).alias("top"), N.logistic_rate(s, age, multiplier).alias("lr"), N.gompertz_rate(s, age, multiplier).alias("gr"),
        N.branching_ratio(s, c).alias("br"), N.hawkes_base(s, age, N.branching_ratio(s, c)).alias("mu"),
    )
    until = {h: F.least(F.lit(float(h)), age) for h in HOURS}
    logistic = {h: N.logistic_at(F.col("top"), F.col("lr"), until[h]) for h in HOURS}
    gompertz = {h: N.gompertz_at(F.col("top"), F.col("gr"), until[h]) for h in HOURS}
    hawkes = {h: N.hawkes_expected(F.col("mu"), F.col("br"), until[h]) for h in (6, 24)}
    return fit.select(
        "posting_id", F.round(age, 6).alias("age_hours"), "score", "num_comments", N.clamp("ratio", 0.0, 1.0).alias("upvote_ratio"), (s + c).alias("engagement_total"),
        (s / age).alias("score_rate_per_hour"), (c / age).alias("comment_rate_per_hour"), ((s + c) / age).alias("engagement_rate_per_hour"),
        F.col("top").alias("logistic_carrying_capacity"), F.col("lr").alias("logistic_growth_rate"),
        *(logistic[h].alias(f"logistic_pred_{h}h") for h in HOURS), *(N.early_fraction(logistic[h], s).alias(f"logistic_early_frac_{h}h") for h in HOURS),
        F.col("gr").alias("gompertz_growth_rate"),
        *(gompertz[h].alias(f"gompertz_pred_{h}h") for h in HOURS), *(N.early_fraction(gompertz[h], s).alias(f"gompertz_early_frac_{h}h") for h in HOURS),
        F.col("mu").alias("hawkes_base_mu"), F.col("br").alias("hawkes_branching_ratio"), N.hawkes_expected(F.col("mu"), F.col("br"), 1.0).alias("hawkes_peak_intensity"),
        *(hawkes[h].alias(f"hawkes_expected_count_{h}h") for h in (6, 24)), *(N.early_fraction(hawkes[h], s).alias(f"hawkes_early_frac_{h}h") for h in (6, 24)),
    )


def provenance_aggregate(rows: DataFrame) -> DataFrame:
    """Per posting_id: total, sums of the flags that are exactly '1', mean and maximum of vpdq_frames. Rows without an id are left out."""
    flag = lambda c: F.count_if(F.col(c) == "1")
    frames = N.parse_double("vpdq_frames", none_word=True)
    return rows.where("posting_id IS NOT NULL AND posting_id <> ''").groupBy("posting_id").agg(
        F.count(F.lit(1)).alias("total"), flag("c2pa_present").alias("c2pa_present_sum"), flag("c2pa_valid").alias("c2pa_valid_sum"), flag("pdq_available").alias("pdq_present_sum"),
        F.avg(frames).alias("vpdq_frames_mean"), F.max(frames).alias("vpdq_frames_max"),
    )


def upper_median(column: str) -> Column:
    """The middle value of a column, of an even number the upper one of the two; nulls are left out. Values are counted before they are sorted."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)")


def inventory_aggregate(rows: DataFrame) -> DataFrame:
    """Per posting_id: number of items, sizes (mean, upper median, maximum, minimum), shares of kinds, errors."""
    size, kind, n = N.parse_double("size_bytes", none_word=True), F.lower(F.trim(F.coalesce("kind", F.lit("")))), F.count(F.lit(1))
    errors = F.count_if(F.coalesce("errors", F.lit("")) != "")
    share = lambda k: (F.count_if(kind == k) / n)
    own = rows.where("posting_id IS NOT NULL AND posting_id <> ''").withColumn("_size", size)
    return own.groupBy("posting_id").agg(
        n.alias("media_item_count"), F.avg(size).alias("size_bytes_mean"), upper_median("_size").alias("size_bytes_median"), F.max(size).alias("size_bytes_max"), F.min(size).alias("size_bytes_min"),
        share("video_mp4").alias("share_video"), share("gif").alias("share_gif"), share("image").alias("share_image"), errors.alias("has_errors_sum"), (errors / n).alias("error_rate"),
    )


def post_features(posts: DataFrame, provenance: DataFrame, inventory: DataFrame, propagation: DataFrame | None = None) -> DataFrame:
    """posts with the aggregates of the other tables; columns that propagation has, too, are overwritten where it has a row of the post.

    A post without provenance has null ratios but sums of 0; posts without an id go, posts that repeat stay.
    """
    out = posts.where("posting_id IS NOT NULL AND posting_id <> ''")
    out = out.join(provenance, "posting_id", "left").join(inventory, "posting_id", "left")
    any_ = lambda c: F.when(F.col("total").isNotNull(), (F.col(c) > 0).cast("int"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select(
        *posts.columns,
        *((F.col(f"{c}_sum") / F.col("total")).alias(f"{c}_ratio") for c in ("c2pa_present", "c2pa_valid", "pdq_present")),
        any_("c2pa_present_sum").alias("c2pa_present_any"), any_("c2pa_valid_sum").alias("c2pa_valid_any"),
        *(zero(f"{c}_sum").alias(f"{c}_sum") for c in ("c2pa_present", "c2pa_valid", "pdq_present")), "vpdq_frames_mean", "vpdq_frames_max",
        *(f"size_bytes_{c}" for c in ("mean", "median", "max", "min")), zero("media_item_count").alias("media_item_count"), "share_video", "share_gif", "share_image", zero("has_errors_sum").alias("has_errors_sum"), "error_rate",
    )
    if propagation is None:
        return out
    new = propagation.select("posting_id", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_p_{c}") for c in propagation.columns if c != "posting_id"))
    both = out.join(new, "posting_id", "left")
    cols = [F.when(F.col("_hit"), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in propagation.columns and c != "posting_id" else F.col(c) for c in out.columns]
    return both.select(*cols, *(F.col(f"_p_{c}").alias(c) for c in propagation.columns if c not in out.columns))


def numeric_columns(df: DataFrame, leave_out: tuple[str, ...] = ()) -> list[str]:
    """Columns in which any value parses as a number, by one pass."""
    names = [c for c in df.columns if c not in leave_out]
    row = df.agg(*(F.coalesce(F.bool_or(N.parse_double(c, none_word=True).isNotNull()), F.lit(False)).alias(c) for c in names)).first()
    return [c for c in names if row[c]]


def correlations(df: DataFrame, features: list[str], metrics: list[str], least: int = 30) -> DataFrame:
    """feature, detector_metric, n, pearson_r, spearman_r over the rows in which both are numbers; pairs with fewer than `least` rows are left out.

    Ranks are formed within each pair, after such rows are gone; ties get their mean rank.
    """
    entry = lambda c, name, value: F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value))
    long = df.select(F.explode(F.array(*(entry(c, "feature", "x") for c in features))).alias("f"), F.array(*(entry(c, "detector_metric", "y") for c in metrics)).alias("ms"))
    long = long.where("f.x IS NOT NULL").select("f.*", F.explode("ms").alias("m")).where("m.y IS NOT NULL").select("feature", "x", "m.*").where("feature <> detector_metric")
    pair = ["feature", "detector_metric"]
    ranked = mean_ranks(long, pair, {"x": "rx", "y": "ry"})
    return ranked.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson_r"), F.corr("rx", "ry").alias("spearman_r")).where(F.col("n") >= least)


def p_values(df: DataFrame) -> DataFrame:
    """df of `correlations` with two-sided p-values, by Student's t with n - 2 degrees of freedom, and absolute values."""
    p = {r: two_sided(F.col(r), F.col("n")) for r in ("pearson_r", "spearman_r")}
    return df.select("feature", "detector_metric", "n", "pearson_r", p["pearson_r"].alias("pearson_p"), "spearman_r", p["spearman_r"].alias("spearman_p"), F.abs("pearson_r").alias("abs_pearson"), F.abs("spearman_r").alias("abs_spearman"))


def top_correlations(df: DataFrame, k: int = 20) -> DataFrame:
    """The k rows with the largest absolute rank correlation, then the largest absolute correlation; NaN counts as missing, missing comes last."""
    size = lambda c: F.nanvl(F.abs(c), F.lit(None).cast("double"))
    return df.orderBy(size("spearman_r").desc_nulls_last(), size("pearson_r").desc_nulls_last(), "feature", "detector_metric").limit(k)


# How the names of propagation features begin.
PREFIXES = ["age_hours", "engagement", "score_rate", "comment_rate", "logistic", "gompertz", "hawkes"]


def best_propagation_feature(df: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    hit = F.lit(False)
    for p in prefixes if prefixes is not None else PREFIXES:
        hit = hit | F.col("feature").startswith(p)
    return top_correlations(df.where(hit), 1)
