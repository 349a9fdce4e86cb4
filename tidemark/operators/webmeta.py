"""Url metadata: nested records to flat tables, and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import parse_int
from tidemark.functions.text import first_filled, platform, post_id, scheme
from tidemark.operators.keyed import first_wins


def flattened(df: DataFrame) -> DataFrame:
    """The 25 columns of a record of sources.schemas.WEBMETA; every other column passes through behind them.

    Requested and final url take the first filled of their names (an empty string counts as missing); first and latest
    sighting take the first that isn't null.
    """
    c = F.col
    known = ["url", "domain", "ts_collected", "rdap", "wayback", "http", "tls", "errors"]
    plain = lambda group, names: [c(f"{group}.{n}").alias(f"{group}_{n}") for n in names]
    return df.select(
        "url", "domain", "ts_collected", scheme("url").alias("scheme"),
        first_filled("http.url_requested", "http.request_url", "url").alias("http_url_requested"), first_filled("http.final_url", "http.response_url", "url").alias("http_final_url"),
        parse_int("http.status_code").alias("status_code"), c("http.content_type").alias("content_type"), parse_int("http.content_length").alias("content_length"),
        c("http.server").alias("server"), c("http.via").alias("via"),
        *plain("tls", ["issuer", "subject", "not_before", "not_after", "serial_number", "sig_hash_alg"]),
        c("rdap.registry").alias("rdap_registry"), F.coalesce(F.array_join("rdap.domain_status", "|"), F.lit("")).alias("rdap_domain_status"),
        F.try_element_at("rdap.events", F.lit("registration")).alias("rdap_registration"), F.try_element_at("rdap.events", F.lit("expiration")).alias("rdap_expiration"),
        F.coalesce("wayback.first_seen_ts", "wayback.first_ts").alias("wayback_first_seen_ts"), F.coalesce("wayback.latest_seen_ts", "wayback.last_ts").alias("wayback_latest_seen_ts"),
        F.coalesce("wayback.snapshots", "wayback.count").cast("int").alias("wayback_snapshots"), F.coalesce(F.size("errors"), F.lit(0)).alias("error_count"),
        *(x for x in df.columns if x not in known),
    )


def is_media(content_type: Column | str, status: Column | str, url: Column | str) -> Column:
    """An image or video, by its content type in any case and with spaces around, that answered 200 and has a url."""
    ct, st, u = (F.col(x) if isinstance(x, str) else x for x in (content_type, status, url))
    return F.coalesce(F.lower(F.trim(ct)).rlike("^(image|video)/") & (st.try_cast("int") == 200) & (u != ""), F.lit(False))


def media_manifest(webmeta: DataFrame, position: str) -> DataFrame:
    """media_url, content_type (as it came), local_path (empty): the first row of each url."""
    rows = webmeta.where(is_media("content_type", "status_code", "http_final_url"))
    return first_wins(rows.select(F.col("http_final_url").alias("media_url"), "content_type", F.lit("").alias("local_path"), position), ["media_url"], position).drop(position)


def post_table(webmeta: DataFrame, position: str, url: str = "http_final_url") -> DataFrame:
    """posting_id, platform, post_id, url: the first row of each post; a blank url is the post `unknown:`."""
    u = F.coalesce(F.col(url), F.lit(""))
    rows = webmeta.select(F.concat(platform(u), F.lit(":"), post_id(u)).alias("posting_id"), platform(u).alias("platform"), post_id(u).alias("post_id"), u.alias("url"), position)
    return first_wins(rows, ["posting_id"], position).drop(position)


def post_map(webmeta: DataFrame, position: str, url: str = "http_final_url") -> DataFrame:
    """canonical_url, posting_id: each pair once, without blank urls."""
    rows = webmeta.where(F.coalesce(F.col(url), F.lit("")) != "")
    return rows.select(F.col(url).alias("canonical_url"), F.concat(platform(url), F.lit(":"), post_id(url)).alias("posting_id")).distinct()


def tables(webmeta: DataFrame, position: str) -> dict[str, DataFrame]:
    return {"webmeta": webmeta.drop(position), "post_table": post_table(webmeta, position), "media_manifest": media_manifest(webmeta, position), "post_map": post_map(webmeta, position)}


def wayback_summary(rows: DataFrame, url: str = "url", ts: str = "timestamp") -> DataFrame:
    """Per url its first and latest snapshot (timestamps are compared as text) and their number; one row or none counts as none."""
    n = F.count(ts)
    return rows.groupBy(url).agg(F.when(n > 1, F.min(ts)).alias("first_seen_ts"), F.when(n > 1, F.max(ts)).alias("latest_seen_ts"), F.when(n > 1, n).otherwise(0).cast("int").alias("snapshots"))
