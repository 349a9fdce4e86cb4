"""Posts: which ones carry media, where they are, which targets are tracked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import bare_id, first_filled, strip, with_platform
from tidemark.operators.keyed import union_priority

# What tells that a post carries an image or video.
EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp"]
VIDEO_HOSTS = ["v.redd.it", "redgifs.com", "gfycat.com", "streamable.com", "youtube.com", "youtu.be"]
IMAGE_HOSTS = ["i.redd.it", "i.imgur.com", "imgur.com"]
HINTS = ["image", "hosted:video", "rich:video"]


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def is_media_post(df: DataFrame, has_preview: str = "has_preview") -> Column:
    """For a table of posts: not adult, removed or banned, and with a hint, a gallery, media, a preview, a media extension or a known host within the domain. has_preview: a flag that the post has the key at all."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    no = yes(_has(df, "over_18", "boolean")) | yes(_has(df, "removed_by_category") != "") | yes(_has(df, "removed", "boolean")) | yes(_has(df, "banned_at_utc", "double") != 0)
    url = F.lower(F.coalesce(first_filled(_has(df, "url_overridden_by_dest"), _has(df, "url")), F.lit("")))
    domain = F.lower(F.coalesce(_has(df, "domain"), F.lit("")))
    found = yes(_has(df, "post_hint").isin(HINTS)) | yes(_has(df, "is_gallery", "boolean")) | _has(df, "media").isNotNull() | yes(_has(df, has_preview, "boolean"))
    for e in EXTENSIONS:
        found = found | url.endswith(e)
    for h in [*IMAGE_HOSTS, *VIDEO_HOSTS]:
        found = found | domain.contains(h)
    return ~no & found


def created_within(created: Column | str, days: float, now: float) -> Column:
    """Not older than `days` at the time `now`; a post without a time passes."""
    c = F.col(created) if isinstance(created, str) else created
    return c.isNull() | (c >= F.lit(now - days * 86400.0))


def scored_at_least(score: Column | str, least: float) -> Column:
    return F.coalesce(F.col(score) if isinstance(score, str) else score, F.lit(0)) >= least


def post_url(permalink: Column | str, url: Column | str, overridden: Column | str | None = None) -> Column:
    """The permalink on the site, else a url that begins with /r/ on the site, else an absolute url, else an empty string."""
    site = "https://www.reddit.com"
    perm = F.coalesce(strip(permalink), F.lit(""))
    u = F.coalesce(strip(first_filled(*([overridden] if overridden is not None else []), url)), F.lit(""))
    return F.when(perm != "", F.concat(F.lit(f"{site}/"), F.regexp_replace(perm, "^/+", ""))).when(u.startswith("/r/"), F.concat(F.lit(site), u)).when(u.rlike("^https?://"), u).otherwise("")


def targets(jsonl: DataFrame, summary: DataFrame, ids: DataFrame) -> DataFrame:
    """posting_id, post_id of all targets; of a post the record in jsonl beats that in summary, which beats the bare id. Rows of jsonl without a post_id go."""
    a = jsonl.where("post_id IS NOT NULL AND post_id <> ''").select(F.concat(first_filled("platform", F.lit("reddit")), F.lit(":"), F.col("post_id")).alias("posting_id"), "post_id", F.lit("jsonl").alias("origin"))
    b = summary.where("posting_id IS NOT NULL AND posting_id <> ''").select("posting_id", bare_id("posting_id").alias("post_id"), F.lit("summary").alias("origin"))
    c = ids.select(with_platform("id").alias("posting_id"), bare_id("id").alias("post_id"), F.lit("ids").alias("origin"))
    return union_priority([a, b, c], ["posting_id"], "post_id")
