"""Stand-ins for the library's tables, made from generic ones (documents, orders, events ...), once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        "doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("image"), ((F.col("n_chars") % 97) / 97.0).alias("content_score"),
        F.col("quality").alias("label"), "toxic", "n_chars",
    )


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0")
    return docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("image"), ((F.col("doc_id") % 89) / 89.0).alias("cred_score"))


def propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0")
    return docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("image"), ((F.col("n_chars") % 83) / 83.0).alias("early_risk"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("num_comments"))
    return table(spark, sf_dir, "orders").join(items, "o_orderkey", "left").select(
        F.concat(F.lit("reddit:"), F.col("o_orderkey").cast("string")).alias("posting_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("created_utc"),
        F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.col("o_totalprice") % 1000).alias("score"), F.coalesce(F.col("num_comments"), F.lit(0)).cast("double").alias("num_comments"),
        (((F.col("o_orderkey") % 97) + 3) / 97.0).alias("upvote_ratio"),
    )


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of posts with their provenance flags, all strings."""
    key, num = F.col("l_orderkey"), F.col("l_linenumber")
    size = F.when((key + num) % 9 == 0, "None").otherwise(F.round(F.col("l_extendedprice"), 0).cast("long").cast("string"))
    flag = lambda m: F.when((key * 3 + num) % m == 0, "1").when((key + num) % m == 1, "True").otherwise("0")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("reddit:"), key.cast("string")).alias("posting_id"), size.alias("size_bytes"),
        F.when(F.col("l_returnflag") == "A", " GIF").when(F.col("l_returnflag") == "R", "video_mp4").otherwise("image").alias("kind"), F.when(F.col("l_linestatus") == "O", "").otherwise("timeout").alias("errors"),
        flag(3).alias("c2pa_present"), flag(4).alias("c2pa_valid"), flag(2).alias("pdq_available"), F.when(num % 3 == 0, "").otherwise((key % 50 + num).cast("string")).alias("vpdq_frames"),
    )


def webmeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Url records of pages; every fourth one is a post of a platform."""
    p = F.col("page_id")
    post = (
        F.when(p % 12 == 0, F.concat(F.lit("https://youtu.be/abcDEF"), p.cast("string")))
        .when(p % 12 == 4, F.concat(F.lit("https://www.reddit.com/r/pics/comments/1ab"), p.cast("string"), F.lit("x/t/")))
        .when(p % 12 == 8, F.concat(F.lit("https://t.me/c/123/"), (p % 40).cast("string")))
        .otherwise(F.col("url"))
    )
    s = lambda c: c.cast("string")
    return table(spark, sf_dir, "pages").select(
        F.col("url"), F.lit("example").alias("domain"), (p * 1.5).alias("ts_collected"),
        F.struct(s(F.lit("reg")).alias("registry"), F.array(F.lit("ok"), s(p % 3)).alias("domain_status"), F.create_map(F.lit("registration"), s(p)).alias("events")).alias("rdap"),
        F.struct(F.when(p % 2 == 0, F.lit("")).otherwise(s(p)).alias("first_seen_ts"), F.lit("old").alias("first_ts"), F.lit(None).cast("string").alias("latest_seen_ts"), s(p + 1).alias("last_ts"), F.lit(None).cast("int").alias("snapshots"), (p % 5).cast("int").alias("count")).alias("wayback"),
        F.struct(
            F.lit(None).cast("string").alias("url_requested"), F.lit(None).cast("string").alias("request_url"), F.when(p % 3 == 0, "").otherwise(post).alias("final_url"), post.alias("response_url"),
            F.when(p % 7 == 0, "200.0").when(p % 5 == 0, "404").otherwise("200").alias("status_code"), F.when(p % 2 == 0, " Image/PNG").otherwise("text/html").alias("content_type"), F.lit(None).cast("string").alias("content_length"),
            F.lit("nginx").alias("server"), F.lit(None).cast("string").alias("via"),
        ).alias("http"),
        F.struct(*(F.lit("x").alias(n) for n in ("issuer", "subject", "not_before", "not_after", "serial_number", "sig_hash_alg"))).alias("tls"),
        F.when(p % 6 == 0, F.array(F.lit("e"))).alias("errors"), p.alias("position"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detector, dataset (the hour of day by sixes), step, value."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("detector"), F.concat(F.lit("d"), F.floor(F.hour("ts") / 6).cast("string")).alias("dataset"), F.col("event_id").alias("step"), F.col("value").cast("double").alias("value"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, frames: conversations as videos, turns as frames, their names not in order of their numbers as text."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return c.groupBy(F.col("conv_id").alias("video")).agg(F.collect_list(F.concat(F.lit("v/"), (F.col("turn") * 3 + 1).cast("string"), F.lit(".png"))).alias("frames"))


SQL = {
    "content": "content AS (SELECT d.doc_id, concat_ws('/', source, lang, d.doc_id) AS image, (n_chars % 97) / 97.0::DOUBLE AS content_score, quality AS label, toxic, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id)",
    "provenance": "provenance AS (SELECT concat_ws('/', source, lang, doc_id) AS image, (doc_id % 89) / 89.0::DOUBLE AS cred_score FROM documents WHERE doc_id % 5 <> 0)",
    "propagation": "propagation AS (SELECT concat_ws('/', source, lang, doc_id) AS image, (n_chars % 83) / 83.0::DOUBLE AS early_risk FROM documents WHERE doc_id % 7 <> 0)",
    "posts": "posts AS (SELECT 'reddit:' || o_orderkey AS posting_id, epoch(o_orderdate)::DOUBLE AS created_utc, CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE o_totalprice % 1000 END::DOUBLE AS score, coalesce(n, 0)::DOUBLE AS num_comments, ((o_orderkey % 97) + 3) / 97.0::DOUBLE AS upvote_ratio FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)",
    "media": """media AS (SELECT 'reddit:' || l_orderkey AS posting_id, CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN NULL ELSE round(l_extendedprice, 0) END::DOUBLE AS size_bytes,
  CASE l_returnflag WHEN 'A' THEN 'gif' WHEN 'R' THEN 'video_mp4' ELSE 'image' END AS kind, l_linestatus <> 'O' AS err,
  ((l_orderkey * 3 + l_linenumber) % 3 = 0)::INT AS c2pa_present, ((l_orderkey * 3 + l_linenumber) % 4 = 0)::INT AS c2pa_valid, ((l_orderkey * 3 + l_linenumber) % 2 = 0)::INT AS pdq_available,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_orderkey % 50 + l_linenumber END::DOUBLE AS vpdq_frames FROM lineitem)""",
    "series": "series AS (SELECT event_type AS detector, 'd' || (hour(ts) // 6) AS dataset, event_id AS step, value::DOUBLE AS value FROM events)",
    "frames": "frames AS (SELECT conv_id AS video, list('v/' || (turn * 3 + 1) || '.png' ORDER BY turn) AS frames FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY 1)",
    "web": """web AS (SELECT *, page_id AS p, CASE page_id % 12 WHEN 0 THEN 'https://youtu.be/abcDEF' || page_id WHEN 4 THEN 'https://www.reddit.com/r/pics/comments/1ab' || page_id || 'x/t/' WHEN 8 THEN 'https://t.me/c/123/' || (page_id % 40) ELSE url END AS post FROM pages)""",
}
SQL["assembled"] = "assembled AS (SELECT c.image, label, content_score, coalesce(cred_score, 0.5) AS cred_score, coalesce(early_risk, 0.5) AS early_risk FROM content c LEFT JOIN provenance USING (image) LEFT JOIN propagation USING (image))"
SQL["risk"] = "risk AS (SELECT *, 1 / (1 + exp(-5.0 * (0.33 * (1 - cred_score) + 0.33 * content_score + 0.34 * early_risk - 0.5))) AS raw FROM assembled)"
SQL["scaled"] = """q AS (SELECT min(raw) a, max(raw) b, quantile_cont(raw, 0.2) l, quantile_cont(raw, 0.8) h FROM risk),
scaled AS (SELECT risk.*, CASE WHEN raw <= l THEN 0.05 + (raw - a) * 0.30 / (l - a) WHEN raw <= h THEN 0.35 + (raw - l) * 0.40 / (h - l) ELSE 0.75 + (raw - h) * 0.23 / (b - h) END AS p2p_risk FROM risk, q)"""
SQL["curve"] = """tied AS (SELECT content_score AS score, sum(label) AS tp, sum(1 - label) AS fp FROM content GROUP BY 1),
curve AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, (SELECT sum(tp) FROM tied) AS p, (SELECT sum(fp) FROM tied) AS n FROM tied WINDOW w AS (ORDER BY score DESC))"""


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
