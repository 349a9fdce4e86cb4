"""Named queries over the proxies, one or more an operator, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import numbers as N
from tidemark.functions import text as X
from tidemark.operators import engagement, keyed, learn, manifest, metrics, neighbours, posts, quality, risk, sampling, series, simulate, tables, vision, webmeta
from tidemark.plans import more, studies  # noqa: F401
from tidemark.plans import proxies as P
from tidemark.plans.proxies import table, with_
from tidemark.plans.registered import ORACLE_SQL, QUERIES, query  # noqa: F401
from tidemark.plans.registered import rounded as _r
from tidemark.streaming import snapshots


# Risk ------------------------------------------------------------------------------------------------------------------

_RISK = ("content", "provenance", "propagation", "assembled", "risk")


def _assembled(spark, d):
    return risk.assembled(P.content(spark, d), P.provenance(spark, d), P.propagation(spark, d))


@query("risk_pipeline_policy_counts", with_(*_RISK, "scaled") + "SELECT CASE WHEN p2p_risk > 0.8 THEN 'limit' WHEN p2p_risk > 0.6 THEN 'label' ELSE 'none' END AS policy, count(*) AS n FROM scaled GROUP BY 1")
def policy_counts(spark, d):
    return risk.policy_counts(risk.policy(risk.fused(_assembled(spark, d), rescale="quantile")))


@query("risk_fusion_raw", with_(*_RISK) + "SELECT image, label, round(raw, 6) AS p2p_risk_raw FROM risk")
def fusion_raw(spark, d):
    return risk.fused(_assembled(spark, d)).select("image", "label", *_r("p2p_risk_raw"))


@query("risk_rescale_linear", with_(*_RISK) + "SELECT image, round(0.1 + (raw - (SELECT min(raw) FROM risk)) * 0.8 / (SELECT max(raw) - min(raw) FROM risk), 6) AS p2p_risk FROM risk")
def rescale_linear(spark, d):
    return risk.fused(_assembled(spark, d), rescale="linear", expand_lo=0.1, expand_hi=0.9).select("image", *_r("p2p_risk"))


@query("risk_rescale_quantile", with_(*_RISK, "scaled") + "SELECT image, round(p2p_risk, 6) AS p2p_risk FROM scaled")
def rescale_quantile(spark, d):
    return risk.fused(_assembled(spark, d), rescale="quantile").select("image", *_r("p2p_risk"))


@query("policy_assignment", with_(*_RISK) + "SELECT image, round(raw, 6) AS p2p_risk, CASE WHEN raw > 0.8 THEN 'limit' WHEN raw > 0.6 THEN 'label' ELSE 'none' END AS policy, CASE WHEN raw > 0.8 THEN 0.3 WHEN raw > 0.6 THEN 0.6 ELSE 1.0 END::DOUBLE AS factor FROM risk")
def policy_assignment(spark, d):
    return risk.policy(risk.fused(_assembled(spark, d))).select("image", *_r("p2p_risk"), "policy", "factor")


@query("content_from_strings", with_("content") + "SELECT image, CASE WHEN doc_id % 7 = 0 THEN 0.0 ELSE round(content_score, 6) END::DOUBLE AS content_score, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE label END AS label FROM content")
def content_from_strings(spark, d):
    c = P.content(spark, d)
    raw = c.select("image", F.when(F.col("doc_id") % 7 == 0, "1d").otherwise(F.round("content_score", 6).cast("string")).alias("prob"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("label").cast("string")).alias("label"))
    return risk.content_scores(raw)


# Keys ------------------------------------------------------------------------------------------------------------------


@query("keyed_last_wins", "SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1")
def keyed_last_wins(spark, d):
    return keyed.last_wins(table(spark, d, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type", *_r("value"))


@query("first_wins_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_wins_dedup(spark, d):
    return keyed.first_wins(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("union_priority", "SELECT user_id, origin, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k, event_id) AS r FROM (SELECT user_id, event_id, event_id % 3 AS k, ['jsonl', 'summary', 'ids'][event_id % 3 + 1] AS origin FROM events)) WHERE r = 1")
def union_priority(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    parts = [e.where(F.col("event_id") % 3 == i).withColumn("origin", F.lit(o)) for i, o in enumerate(("jsonl", "summary", "ids"))]
    return keyed.union_priority(parts, ["user_id"], "event_id").select("user_id", "origin", "event_id")


@query("tracked_targets", "SELECT 'reddit:' || k AS posting_id, k::VARCHAR AS post_id, CASE WHEN k % 2 = 0 THEN 'jsonl' WHEN k % 3 = 0 THEN 'summary' ELSE 'ids' END AS origin FROM (SELECT DISTINCT user_id AS k FROM events) WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0")
def tracked_targets(spark, d):
    k = table(spark, d, "events").select(F.col("user_id").alias("k")).distinct()
    s = F.col("k").cast("string")
    a = k.where("k % 2 = 0").select(F.lit("reddit").alias("platform"), s.alias("post_id")).unionByName(k.where("k % 7 = 0").select(F.lit("").alias("platform"), F.lit("").alias("post_id")))
    b = k.where("k % 3 = 0").select(F.concat(F.lit("reddit:"), s).alias("posting_id"))
    c = k.where("k % 5 = 0").select(F.when(F.col("k") % 10 == 0, F.concat(F.lit("reddit:"), s)).otherwise(s).alias("id"))
    return posts.targets(a, b, c)


@query("lookup_cascade", "SELECT d.doc_id, coalesce(a.doc_id, b.doc_id) AS value FROM (SELECT *, 'Root/' || source || '/' || doc_id AS key FROM documents) d LEFT JOIN (SELECT doc_id, 'Root/' || source || '/' || doc_id AS key FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 > 0) a ON a.key = d.key LEFT JOIN (SELECT doc_id, lower('Root/' || source || '/' || doc_id) AS key FROM documents WHERE doc_id % 3 > 0 AND doc_id % 5 > 0) b ON b.key = lower(d.key)")
def lookup_cascade(spark, d):
    docs = table(spark, d, "documents")
    key = F.concat(F.lit("Root/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    store = docs.where("doc_id % 5 > 0").select(F.when(F.col("doc_id") % 3 == 0, key).otherwise(F.upper(key)).alias("key"), F.col("doc_id").alias("value"))
    return keyed.lookup(docs.select("doc_id", key.alias("key")), store, "key", F.lower).select("doc_id", "value")


# Checks ----------------------------------------------------------------------------------------------------------------

_STRINGS = "CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 = 0 THEN 'abc' WHEN doc_id % 19 = 0 THEN 'nan' WHEN doc_id % 23 = 0 THEN '1.5' ELSE '0.5' END"


@query("dq_range_check", f"WITH s AS (SELECT doc_id, {_STRINGS} AS v FROM documents) SELECT count(*) AS rows, count_if(v = '') AS missing, count_if(v = 'abc') AS not_float, count_if(v = 'nan') AS nan_or_inf, count_if(v = '1.5') AS out_of_range, count_if(v <> '0.5') AS bad, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT doc_id::VARCHAR AS k FROM s WHERE v <> '0.5' ORDER BY k LIMIT 10)) AS examples FROM s")
def dq_range(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.expr(_STRINGS).alias("v"))
    return quality.range_check(s, "v", "doc_id").withColumn("examples", F.array_join("examples", ","))


@query("dq_unique_key", "WITH k AS (SELECT n_chars FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS duplicate_keys, (SELECT string_agg(n::VARCHAR, ',' ORDER BY n::VARCHAR) FROM (SELECT n_chars AS n FROM k ORDER BY n LIMIT 5)) AS examples FROM k")
def dq_unique(spark, d):
    return quality.unique_check(table(spark, d, "documents"), "n_chars").withColumn("examples", F.array_join("examples", ","))


@query("dq_join_coverage", "WITH a AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 7 <> 0), x AS (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b), y AS (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM a) SELECT (SELECT count(*) FROM a) AS base_keys, (SELECT count(*) FROM b) AS other_keys, (SELECT count(*) FROM x) AS missing, (SELECT count(*) FROM y) AS extra, round(1 - (SELECT count(*) FROM x) / (SELECT count(*) FROM a), 6) AS coverage")
def dq_coverage(spark, d):
    out = quality.join_coverage(table(spark, d, "labels"), table(spark, d, "documents").where("doc_id % 7 <> 0"), "doc_id")
    return out.select("base_keys", "other_keys", "missing", "extra", *_r("coverage"))


@query("dq_report", with_(*_RISK, "curve") + "SELECT round((SELECT sum(fp * (ctp - tp / 2)) FROM (SELECT sum(label) AS tp, sum(1 - label) AS fp, sum(sum(label)) OVER (ORDER BY raw DESC) AS ctp FROM risk GROUP BY raw)) / (SELECT sum(label) * sum(1 - label) FROM risk), 6) AS auc, (SELECT count(*) FROM content) AS content_rows, 0::BIGINT AS aggregate_bad, (SELECT count(*) FROM content LEFT JOIN provenance USING (image) WHERE cred_score IS NULL) AS provenance_missing")
def dq_report(spark, d):
    c, v, g = P.content(spark, d), P.provenance(spark, d), P.propagation(spark, d)
    r = quality.report(c, v, g, risk.fused(risk.assembled(c, v, g)))
    return r.select(*_r("auc"), F.col("content.rows").alias("content_rows"), F.col("aggregate.bad").alias("aggregate_bad"), F.col("provenance_coverage.missing").alias("provenance_missing"))


# Ranking metrics -------------------------------------------------------------------------------------------------------


def _curve(spark, d):
    return metrics.curve(P.content(spark, d), "content_score", "label")


@query("roc_points", with_("content", "curve") + "SELECT round(score, 6) AS score, round(cfp / n, 6) AS fpr, round(ctp / p, 6) AS tpr FROM curve")
def roc_points(spark, d):
    return metrics.roc_points(_curve(spark, d)).select(*_r("score", "fpr", "tpr"))


@query("auc", with_("content", "curve") + "SELECT round(sum(fp * (ctp - tp / 2)) / (any_value(p) * any_value(n)), 6) AS auc FROM curve")
def auc(spark, d):
    return metrics.auc_if_labelled(P.content(spark, d), "content_score").select(*_r("auc"))


@query("average_precision", with_("content", "curve") + "SELECT round(sum(tp * ctp / (ctp + cfp)) / any_value(p), 6) AS ap FROM curve")
def average_precision(spark, d):
    return metrics.summary(_curve(spark, d)).select(*_r("ap"))


_EER = "SELECT round(arg_min(fpr, (gap, -score)), 6) AS {0} FROM (SELECT score, cfp / n AS fpr, abs(1 - ctp / p - cfp / n) AS gap FROM {1})"
_PRUNED = "kept AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC) AS i, lead(tp) OVER (ORDER BY score DESC) AS ntp, lead(fp) OVER (ORDER BY score DESC) AS nfp FROM curve) WHERE i = 1 OR ntp IS NULL OR ntp <> tp OR nfp <> fp)"


@query("eer_unpruned", with_("content", "curve") + _EER.format("eer", "curve"))
def eer_unpruned(spark, d):
    return metrics.summary(_curve(spark, d)).select(F.round("eer_unpruned", 6).alias("eer"))


@query("eer_pruned", with_("content", "curve").rstrip() + ",\n" + _PRUNED + "\n" + _EER.format("eer", "kept"))
def eer_pruned(spark, d):
    return metrics.summary(_curve(spark, d)).select(*_r("eer"))


@query("best_threshold", with_("content", "curve") + "SELECT round(arg_max(score, (acc, last)), 6) AS threshold, round(max(acc), 6) AS acc FROM (SELECT score, (ctp + n - cfp) / (p + n) AS acc, (SELECT max(doc_id) FROM content c WHERE c.content_score = score) AS last FROM curve)")
def best_threshold(spark, d):
    return metrics.best_threshold(P.content(spark, d), "content_score", "label", "doc_id").select(*_r("threshold", "acc"))


@query("group_level_auc", with_("content").rstrip() + """,
g AS (SELECT avg(content_score) AS s, floor(avg(label)) AS y FROM content GROUP BY doc_id // 4),
t AS (SELECT s, sum(y) AS tp, sum(1 - y) AS fp FROM g GROUP BY 1), c AS (SELECT *, sum(tp) OVER (ORDER BY s DESC) AS ctp FROM t)
SELECT round(sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp)), 6) AS auc FROM c""")
def group_level_auc(spark, d):
    g = metrics.by_group(P.content(spark, d), F.floor(F.col("doc_id") / 4), "content_score", "label")
    return metrics.summary(metrics.curve(g)).select(*_r("auc"))


@query("frames_to_videos", with_("content") + "SELECT lang AS \"group\", round(avg(content_score), 6) AS prob, floor(avg(label))::INT AS label FROM (SELECT *, string_split(image, '/')[-2] AS lang FROM content) GROUP BY 1")
def frames_to_videos(spark, d):
    return metrics.by_group(P.content(spark, d), X.parent_folder("image"), "content_score", "label").select("group", *_r("prob"), "label")


@query("class_accuracy", with_("content") + "SELECT round(avg(h), 6) AS acc, round(avg(h) FILTER (label = 0), 6) AS r_acc, round(avg(h) FILTER (label = 1), 6) AS f_acc FROM (SELECT label, ((content_score > 0.5)::INT = label)::INT AS h FROM content)")
def class_accuracy(spark, d):
    return metrics.accuracy(P.content(spark, d), "content_score").select(*_r("acc", "r_acc", "f_acc"))


@query("topk_accuracy", "WITH s AS (SELECT embedding AS v, vec_id % 64 AS y FROM embeddings), h AS (SELECT (len(list_filter(v, lambda x: x > v[y + 1])) < 2)::INT AS hit FROM s) SELECT sum(hit)::BIGINT AS hits, count(*) AS rows, round(avg(hit), 6) AS accuracy, round(1 - avg(hit), 6) AS error FROM h")
def topk_accuracy(spark, d):
    e = table(spark, d, "embeddings").select(F.col("embedding").alias("v"), (F.col("vec_id") % 64).cast("int").alias("y"))
    return metrics.top_k(e, "v", "y", 2).select("hits", "rows", *_r("accuracy", "error"))


@query("mean_average_precision", with_("content").rstrip() + """,
t AS (SELECT doc_id % 6 AS k, content_score AS s, sum(label) AS tp, count(*) AS m FROM content GROUP BY 1, 2),
c AS (SELECT *, sum(tp) OVER w AS ctp, sum(m) OVER w AS cm FROM t WINDOW w AS (PARTITION BY k ORDER BY s DESC)),
a AS (SELECT k, sum(tp * ctp / cm) / sum(tp) AS ap FROM c GROUP BY 1 HAVING sum(tp) > 0)
SELECT round(avg(ap), 6) AS map, count(*) AS classes FROM a""")
def mean_ap(spark, d):
    c = P.content(spark, d).select((F.col("doc_id") % 6).alias("class"), F.col("content_score").alias("prob"), "label")
    return metrics.mean_average_precision(c).select(*_r("map"), "classes")


@query("branch_metrics", with_("content").rstrip() + """,
b AS (SELECT 'one' AS branch, content_score AS s, label FROM content UNION ALL SELECT 'two', (n_chars % 31) / 31.0::DOUBLE, label FROM content),
t AS (SELECT branch, s, sum(label) AS tp, count(*) AS m FROM b GROUP BY 1, 2), c AS (SELECT *, sum(tp) OVER w AS ctp, sum(m) OVER w AS cm FROM t WINDOW w AS (PARTITION BY branch ORDER BY s DESC))
SELECT branch, round(sum(tp * ctp / cm) / sum(tp), 6) AS ap, (SELECT round(avg(((s > 0.5)::INT = label)::INT), 6) FROM b WHERE b.branch = c.branch) AS acc FROM c GROUP BY 1""")
def branch_metrics(spark, d):
    c = P.content(spark, d).select("label", F.col("content_score").alias("one"), ((F.col("n_chars") % 31) / 31.0).alias("two"))
    return metrics.branches(c, ["one", "two"]).select("branch", *_r("ap", "acc"))


@query("mean_roc_grid", with_("content").rstrip() + """,
t AS (SELECT doc_id % 3 AS k, content_score AS s, sum(label) AS tp, sum(1 - label) AS fp FROM content GROUP BY 1, 2),
c AS (SELECT k, sum(tp) OVER w / sum(tp) OVER (PARTITION BY k) AS tpr, sum(fp) OVER w / sum(fp) OVER (PARTITION BY k) AS fpr FROM t WINDOW w AS (PARTITION BY k ORDER BY s DESC)),
h AS (SELECT k, fpr, max(tpr) AS hi, min(tpr) AS lo FROM c GROUP BY 1, 2),
p AS (SELECT k, fpr AS x1, lo AS y1, hi, coalesce(lag(fpr) OVER v, 0.0) AS x0, coalesce(lag(hi) OVER v, 0.0) AS y0 FROM h WINDOW v AS (PARTITION BY k ORDER BY fpr)),
g AS (SELECT i, k, max(CASE WHEN i / 99.0::DOUBLE >= x1 THEN hi ELSE y0 + (y1 - y0) * (i / 99.0::DOUBLE - x0) / nullif(x1 - x0, 0) END) AS y FROM p, (SELECT unnest(range(100)) AS i) WHERE i / 99.0::DOUBLE BETWEEN x0 AND x1 GROUP BY 1, 2)
SELECT round(i / 99.0::DOUBLE, 6) AS fpr, round(CASE i WHEN 0 THEN 0.0 WHEN 99 THEN 1.0 ELSE avg(y) END, 6) AS tpr FROM g GROUP BY i""")
def mean_roc_grid(spark, d):
    c = metrics.curve(P.content(spark, d).withColumn("batch", F.col("doc_id") % 3), "content_score", "label", ("batch",))
    return metrics.mean_roc(c, "batch").select(*_r("fpr", "tpr"))


@query("histogram_50", "WITH e AS (SELECT min(value) a, max(value) b FROM events) SELECT least(floor((value - a) / ((b - a) / 50)) + 1, 50)::INT AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1")
def histogram_50(spark, d):
    return metrics.histogram(table(spark, d, "events"), "value")


@query("resample_global_ap", with_("content").rstrip() + """,
r AS (SELECT *, doc_id % 3 AS g, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY md5('418:' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY doc_id % 3) AS m FROM content),
x AS (SELECT content_score AS s, label, unnest(range(1, (top // m + CASE WHEN i <= top % m THEN 1 ELSE 0 END + 1)::BIGINT)) AS copy FROM r, (SELECT max(m) AS top FROM r)),
t AS (SELECT s, sum(label) AS tp, count(*) AS n FROM x GROUP BY 1), c AS (SELECT *, sum(tp) OVER (ORDER BY s DESC) AS ctp, sum(n) OVER (ORDER BY s DESC) AS cn FROM t)
SELECT round(sum(tp * ctp / cn) / sum(tp), 6) AS ap FROM c""")
def resample_global_ap(spark, d):
    r = sampling.resampled(P.content(spark, d).withColumn("g", F.col("doc_id") % 3), "g", "doc_id")
    return metrics.summary(metrics.curve(r, "content_score", "label")).select(*_r("ap"))


@query("detection_precision", """WITH b AS (SELECT l_orderkey AS key, l_linenumber AS ln, l_partkey % 4 AS act, (l_partkey % 10)::DOUBLE AS x1, (l_partkey % 7)::DOUBLE AS y1, (l_partkey % 101) / 101.0::DOUBLE AS score FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)),
t AS (SELECT * FROM b WHERE ln % 2 = 1), f AS (SELECT * FROM b WHERE ln % 2 = 0),
o AS (SELECT f.key, f.ln, f.act, f.score, f.x1, f.y1, t.ln AS tn, t.x1 AS tx, t.y1 AS ty, greatest(6 - abs(f.x1 - t.x1), 0) * greatest(6 - abs(f.y1 - t.y1), 0) AS i FROM f JOIN t ON f.key = t.key AND f.act = t.act),
m AS (SELECT key, ln, act, score, x1, y1, arg_max((tx, ty), (i / (72 - i), -tx, -ty)) AS tn FROM o WHERE i / (72 - i) >= 0.5 GROUP BY 1, 2, 3, 4, 5, 6),
h AS (SELECT key, ln FROM (SELECT *, row_number() OVER (PARTITION BY key, act, tn ORDER BY score DESC, x1, y1, ln) AS r FROM m) WHERE r = 1),
s AS (SELECT act, score, sum((h.ln IS NOT NULL)::INT) AS tp, count(*) AS n FROM f LEFT JOIN h ON f.key = h.key AND f.ln = h.ln GROUP BY 1, 2),
c AS (SELECT act, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM s WINDOW w AS (PARTITION BY act ORDER BY score DESC)),
a AS (SELECT act, sum(tp * ctp / cn) AS s FROM c GROUP BY 1)
SELECT p.act::INT AS action_id, round(coalesce(a.s, 0) / p.n, 6) AS ap, p.n AS positives FROM (SELECT act, count(*) AS n FROM t GROUP BY 1) p LEFT JOIN a ON a.act = p.act""")
def detection_precision(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    box = [(F.col("l_partkey") % 10).cast("double").alias("x1"), (F.col("l_partkey") % 7).cast("double").alias("y1"), (F.col("l_partkey") % 10 + 6).cast("double").alias("x2"), (F.col("l_partkey") % 7 + 6).cast("double").alias("y2")]
    truth = li.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("key"), (F.col("l_partkey") % 4).cast("int").alias("action_id"), *box)
    found = li.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("key"), (F.col("l_partkey") % 4).cast("int").alias("action_id"), *box, ((F.col("l_partkey") % 101) / 101.0).alias("score"))
    return vision.detection_precision(truth, found).select("action_id", *_r("ap"), "positives")


# Engagement ------------------------------------------------------------------------------------------------------------

_AGE = """f AS (SELECT *, greatest((snap - created_utc) / 3600, 1 / 60::DOUBLE) AS age, greatest(score * 1.5 + 1, 2.0) AS k FROM posts, (SELECT max(created_utc) + 3600 AS snap FROM posts))"""


def _features(spark, d):
    return engagement.propagation_features(P.posts(spark, d))


@query("growth_logistic", with_("posts").rstrip() + ",\n" + _AGE + """,
r AS (SELECT *, greatest(0.0, -ln(least(greatest((k - score) / greatest(score * (k - 1), 1e-6), 1e-6), 1e6)) / age) AS r FROM f)
SELECT posting_id, round(age, 6) AS age_hours, round(k, 6) AS logistic_carrying_capacity, round(r, 6) AS logistic_growth_rate, round(k / (1 + (k - 1) * exp(-r * least(6.0, age))), 4) AS logistic_pred_6h,
  round(CASE WHEN score > 0 THEN least(k / (1 + (k - 1) * exp(-r * least(24.0, age))) / score, 1.5) ELSE 0.0 END, 6) AS logistic_early_frac_24h FROM r""")
def growth_logistic(spark, d):
    return _features(spark, d).select("posting_id", "age_hours", *_r("logistic_carrying_capacity", "logistic_growth_rate"), *_r("logistic_pred_6h", digits=4), *_r("logistic_early_frac_24h"))


@query("growth_gompertz", with_("posts").rstrip() + ",\n" + _AGE + """,
r AS (SELECT *, greatest(0.0, -ln(least(greatest(-ln(least(greatest(score / k, 1e-9), 1 - 1e-6)) / ln(k), 1e-6), 0.999999)) / age) AS g FROM f)
SELECT posting_id, round(g, 6) AS gompertz_growth_rate, round(k * exp(-ln(k) * exp(-g * least(1.0, age))), 4) AS gompertz_pred_1h,
  round(CASE WHEN score > 0 THEN least(k * exp(-ln(k) * exp(-g * least(24.0, age))) / score, 1.5) ELSE 0.0 END, 6) AS gompertz_early_frac_24h FROM r""")
def growth_gompertz(spark, d):
    return _features(spark, d).select("posting_id", *_r("gompertz_growth_rate"), *_r("gompertz_pred_1h", digits=4), *_r("gompertz_early_frac_24h"))


@query("hawkes_proxy", with_("posts").rstrip() + ",\n" + _AGE + """,
r AS (SELECT *, least(greatest(num_comments / greatest(score + num_comments, 1e-6), 0.0), 0.95) AS a FROM f), m AS (SELECT *, greatest(score / age * (1 - a), 0.0) AS mu FROM r)
SELECT posting_id, round(mu, 6) AS hawkes_base_mu, round(a, 6) AS hawkes_branching_ratio, round(mu / (1 - a), 6) AS hawkes_peak_intensity, round(mu * least(24.0, age) / (1 - a), 4) AS hawkes_expected_count_24h,
  round(CASE WHEN score > 0 THEN least(mu * least(6.0, age) / (1 - a) / score, 1.5) ELSE 0.0 END, 6) AS hawkes_early_frac_6h, round(score / age, 6) AS score_rate_per_hour, round(least(upvote_ratio, 1.0), 6) AS upvote_ratio FROM m""")
def hawkes_proxy(spark, d):
    return _features(spark, d).select("posting_id", *_r("hawkes_base_mu", "hawkes_branching_ratio", "hawkes_peak_intensity"), *_r("hawkes_expected_count_24h", digits=4), *_r("hawkes_early_frac_6h", "score_rate_per_hour", "upvote_ratio"))


_PROV = "prov AS (SELECT posting_id, count(*) AS total, sum(c2pa_present) AS c2pa_present_sum, sum(c2pa_valid) AS c2pa_valid_sum, sum(pdq_available) AS pdq_present_sum, avg(vpdq_frames) AS vpdq_frames_mean, max(vpdq_frames) AS vpdq_frames_max FROM media GROUP BY 1)"
_INV = "inv AS (SELECT posting_id, count(*) AS media_item_count, avg(size_bytes) AS size_bytes_mean, list_sort(list(size_bytes) FILTER (size_bytes IS NOT NULL))[count(size_bytes) // 2 + 1] AS size_bytes_median, max(size_bytes) AS size_bytes_max, min(size_bytes) AS size_bytes_min, avg((kind = 'video_mp4')::INT) AS share_video, avg((kind = 'gif')::INT) AS share_gif, avg((kind = 'image')::INT) AS share_image, count_if(err) AS has_errors_sum, avg(err::INT) AS error_rate FROM media GROUP BY 1)"


@query("provenance_aggregate", with_("media").rstrip() + ",\n" + _PROV + " SELECT posting_id, total, c2pa_present_sum::BIGINT AS c2pa_present_sum, c2pa_valid_sum::BIGINT AS c2pa_valid_sum, pdq_present_sum::BIGINT AS pdq_present_sum, round(vpdq_frames_mean, 6) AS vpdq_frames_mean, vpdq_frames_max FROM prov")
def provenance_aggregate(spark, d):
    return engagement.provenance_aggregate(P.media(spark, d)).withColumn("vpdq_frames_mean", F.round("vpdq_frames_mean", 6))


_INVC = ["size_bytes_mean", "size_bytes_median", "size_bytes_max", "size_bytes_min", "share_video", "share_gif", "share_image", "error_rate"]


@query("inventory_aggregate", with_("media").rstrip() + ",\n" + _INV + " SELECT posting_id, media_item_count, has_errors_sum, " + ", ".join(f"round({c}, 6) AS {c}" for c in _INVC) + " FROM inv")
def inventory_aggregate(spark, d):
    return engagement.inventory_aggregate(P.media(spark, d)).select("posting_id", "media_item_count", "has_errors_sum", *_r(*_INVC))


@query("post_features", with_("posts", "media").rstrip() + ",\n" + _PROV + ",\n" + _INV + """
SELECT posting_id, round(CASE WHEN k % 3 = 0 THEN 2 * score ELSE score END, 6) AS score, CASE WHEN k % 3 = 0 THEN 7.0 END::DOUBLE AS fresh, round(c2pa_present_sum / total, 6) AS c2pa_present_ratio, (c2pa_present_sum > 0)::INT::DOUBLE AS c2pa_present_any,
  coalesce(c2pa_valid_sum, 0)::BIGINT AS c2pa_valid_sum, size_bytes_median, coalesce(media_item_count, 0) AS media_item_count, round(share_gif, 6) AS share_gif
FROM (SELECT *, replace(posting_id, 'reddit:', '')::BIGINT AS k FROM posts) LEFT JOIN (SELECT * FROM prov WHERE replace(posting_id, 'reddit:', '')::BIGINT % 4 > 0) USING (posting_id) LEFT JOIN inv USING (posting_id)""")
def post_features(spark, d):
    p, m = P.posts(spark, d), P.media(spark, d)
    k = F.replace("posting_id", F.lit("reddit:"), F.lit("")).cast("long")
    spread = p.where(k % 3 == 0).select("posting_id", (F.col("score") * 2).alias("score"), F.lit(7.0).alias("fresh"))
    out = engagement.post_features(p, engagement.provenance_aggregate(m.where(k % 4 > 0)), engagement.inventory_aggregate(m), spread)
    return out.select("posting_id", *_r("score"), "fresh", *_r("c2pa_present_ratio"), F.col("c2pa_present_any").cast("double").alias("c2pa_present_any"), "c2pa_valid_sum", "size_bytes_median", "media_item_count", *_r("share_gif"))


def _pairs(spark, d):
    f = P.posts(spark, d).withColumn("age", F.col("created_utc") / 86400).withColumn("part", F.when(F.col("num_comments") > 2, F.col("num_comments")))
    return engagement.correlations(f, ["score", "part", "age"], ["upvote_ratio", "created_utc"])


_LONG = with_("posts").rstrip() + """,
l AS (SELECT f.feature, f.x, m.metric AS detector_metric, m.y FROM posts, LATERAL (SELECT unnest(['score', 'part', 'age']) AS feature, unnest([score, CASE WHEN num_comments > 2 THEN num_comments END, created_utc / 86400]) AS x) f,
  LATERAL (SELECT unnest(['upvote_ratio', 'created_utc']) AS metric, unnest([upvote_ratio, created_utc]) AS y) m WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY feature, detector_metric ORDER BY x) + (count(*) OVER (PARTITION BY feature, detector_metric, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature, detector_metric ORDER BY y) + (count(*) OVER (PARTITION BY feature, detector_metric, y) - 1) / 2 AS ry FROM l),
c AS (SELECT feature, detector_metric, count(*) AS n, corr(x, y) AS pr, corr(rx, ry) AS sr FROM k GROUP BY 1, 2)
"""


@query("pearson_pairs", _LONG + "SELECT feature, detector_metric, n, round(pr, 6) AS pearson_r FROM c")
def pearson_pairs(spark, d):
    return _pairs(spark, d).select("feature", "detector_metric", "n", *_r("pearson_r"))


@query("spearman_pairs", _LONG + "SELECT feature, detector_metric, n, round(sr, 6) AS spearman_r FROM c")
def spearman_pairs(spark, d):
    return _pairs(spark, d).select("feature", "detector_metric", "n", *_r("spearman_r"))


def _student_sql(r: str) -> str:
    """The two-sided p-value by the finite series for whole degrees of freedom."""
    even = f"abs({r}) * list_sum([exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0) + k * ln(1 - {r} * {r})) for k in range((n - 2) // 2)])"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r}) * coalesce(list_sum([exp(lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5) + k * ln(1 - {r} * {r})) for k in range((n - 3) // 2)]), 0))"
    return f"round(1 - CASE WHEN abs({r}) > 1 - 1e-12 THEN 1.0 WHEN n % 2 = 0 THEN {even} ELSE {odd} END, 6)"


@query("correlation_pvalues", _LONG + f"SELECT feature, detector_metric, n, round(pr, 6) AS pearson_r, {_student_sql('pr')} AS pearson_p, round(sr, 6) AS spearman_r, {_student_sql('sr')} AS spearman_p, round(abs(pr), 6) AS abs_pearson, round(abs(sr), 6) AS abs_spearman FROM c")
def correlation_pvalues(spark, d):
    return engagement.p_values(_pairs(spark, d)).select("feature", "detector_metric", "n", *_r("pearson_r", "pearson_p", "spearman_r", "spearman_p", "abs_pearson", "abs_spearman"))


@query("top_correlations", _LONG + "SELECT feature, detector_metric, round(sr, 6) AS spearman_r FROM c ORDER BY abs(sr) DESC, abs(pr) DESC, feature, detector_metric LIMIT 3")
def top_correlations(spark, d):
    return engagement.top_correlations(_pairs(spark, d), 3).select("feature", "detector_metric", *_r("spearman_r"))


# Url metadata ----------------------------------------------------------------------------------------------------------


def _web(spark, d):
    return webmeta.flattened(P.webmeta(spark, d))


@query("webmeta_flatten", with_("web") + "SELECT url, string_split(url, ':')[1] AS scheme, url AS http_url_requested, post AS http_final_url, CASE WHEN p % 7 = 0 THEN NULL WHEN p % 5 = 0 THEN 404 ELSE 200 END::DOUBLE AS status_code, 'ok|' || (p % 3) AS rdap_domain_status, p::VARCHAR AS rdap_registration, NULL::VARCHAR AS rdap_expiration, CASE WHEN p % 2 = 0 THEN '' ELSE p::VARCHAR END AS wayback_first_seen_ts, (p + 1)::VARCHAR AS wayback_latest_seen_ts, (p % 5)::INT AS wayback_snapshots, CASE WHEN p % 6 = 0 THEN 1 ELSE 0 END AS error_count FROM web")
def webmeta_flatten(spark, d):
    return _web(spark, d).select("url", "scheme", "http_url_requested", "http_final_url", F.col("status_code").cast("double").alias("status_code"), "rdap_domain_status", "rdap_registration", "rdap_expiration", "wayback_first_seen_ts", "wayback_latest_seen_ts", "wayback_snapshots", "error_count")


_IDS = r"""ids AS (SELECT p, post, CASE WHEN regexp_matches(post, 'youtu\.be/[A-Za-z0-9_-]{6,}') THEN 'youtube' WHEN regexp_matches(post, 'reddit\.com/r/[^/]+/comments/[a-z0-9]{5,10}') THEN 'reddit' WHEN regexp_matches(post, 't\.me/(?:c/)?[^/]+/\d+') THEN 'telegram' ELSE 'unknown' END AS platform,
  CASE WHEN regexp_matches(post, 'youtu\.be/[A-Za-z0-9_-]{6,}') THEN regexp_extract(post, 'youtu\.be/([A-Za-z0-9_-]{6,})', 1) WHEN regexp_matches(post, 'reddit\.com/r/[^/]+/comments/[a-z0-9]{5,10}') THEN regexp_extract(post, 'comments/([a-z0-9]{5,10})', 1) WHEN regexp_matches(post, 't\.me/(?:c/)?[^/]+/\d+') THEN regexp_extract(post, 't\.me/(?:c/)?[^/]+/(\d+)', 1) ELSE post END AS post_id FROM web)
"""


@query("post_table", with_("web").rstrip() + ",\n" + _IDS + "SELECT platform || ':' || post_id AS posting_id, any_value(platform) AS platform, any_value(post_id) AS post_id, arg_min(post, p) AS url FROM ids GROUP BY 1")
def post_table(spark, d):
    return webmeta.post_table(_web(spark, d), "position")


@query("post_map", with_("web").rstrip() + ",\n" + _IDS + "SELECT DISTINCT post AS canonical_url, platform || ':' || post_id AS posting_id FROM ids WHERE post <> ''")
def post_map(spark, d):
    return webmeta.post_map(_web(spark, d), "position")


@query("media_manifest", with_("web") + "SELECT post AS media_url, ' Image/PNG' AS content_type, '' AS local_path FROM web WHERE p % 2 = 0 AND p % 7 <> 0 AND p % 5 <> 0 GROUP BY 1")
def media_manifest(spark, d):
    return webmeta.media_manifest(_web(spark, d), "position")


@query("wayback_summary", "SELECT user_id AS url, CASE WHEN count(*) > 1 THEN min(strftime(ts, '%Y%m%d%H%M%S')) END AS first_seen_ts, CASE WHEN count(*) > 1 THEN max(strftime(ts, '%Y%m%d%H%M%S')) END AS latest_seen_ts, CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END::INT AS snapshots FROM events GROUP BY 1")
def wayback_summary(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("url"), F.date_format("ts", "yyyyMMddHHmmss").alias("timestamp"))
    return webmeta.wayback_summary(e)


@query("hosts_and_domains", r"SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '([^./]+\.[^./]+)(?:[/?#]|$)', 1) AS domain FROM pages WHERE url LIKE '%://%'")
def hosts_and_domains(spark, d):
    p = table(spark, d, "pages").where("url LIKE '%://%'")
    return p.select("page_id", X.host("url").alias("host"), X.registrable_domain(X.host("url")).alias("domain"))


@query("key_normalise", "WITH k AS (SELECT page_id AS i, CASE page_id % 4 WHEN 0 THEN '/data/Celeb-DF-v2/a/' || page_id || '.png' WHEN 1 THEN 'Celeb-DF-v2/x/' || page_id WHEN 2 THEN 'p/q/r/s/t/' || page_id ELSE '/x/FaceForensics++/u/Celeb-DF-v2/' || page_id END AS path FROM pages) SELECT i, CASE i % 4 WHEN 0 THEN 'a/' || i || '.png' WHEN 1 THEN i::VARCHAR WHEN 2 THEN 'r/s/t/' || i ELSE i::VARCHAR END AS key FROM k")
def key_normalise(spark, d):
    i = F.col("page_id")
    s = i.cast("string")
    path = F.when(i % 4 == 0, F.concat(F.lit("/data/Celeb-DF-v2/a/"), s, F.lit(".png"))).when(i % 4 == 1, F.concat(F.lit("Celeb-DF-v2/x/"), s)).when(i % 4 == 2, F.concat(F.lit("p/q/r/s/t/"), s)).otherwise(F.concat(F.lit("/x/FaceForensics++/u/Celeb-DF-v2/"), s))
    return table(spark, d, "pages").select(i.alias("i"), X.normal_key(path).alias("key"))


@query("media_posts", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.reddit.com/r/x/' || page_id WHEN 1 THEN 'https://www.reddit.com/r/y' WHEN 2 THEN url ELSE '' END AS post_url FROM pages WHERE page_id % 9 <> 0 AND (page_id % 2 = 0 OR page_id % 3 = 0) AND coalesce(nullif(page_id % 4, 0), 100) >= 2")
def media_posts(spark, d):
    i = F.col("page_id")
    p = table(spark, d, "pages").select(
        "page_id", (i % 9 == 0).alias("over_18"), F.when(i % 2 == 0, "http://h/a.JPG").otherwise("http://h/a").alias("url"), F.when(i % 3 == 0, "i.imgur.com.x").alias("domain"),
        F.when(i % 5 == 0, F.concat(F.lit("/r/x/"), i.cast("string"))).alias("permalink"), F.when(i % 5 == 1, "/r/y").when(i % 5 == 2, F.col("url")).otherwise("ftp://z").alias("link"), F.when(i % 4 == 0, None).otherwise((i % 4).cast("double")).alias("created_utc"),
    )
    return p.where(posts.is_media_post(p) & posts.created_within("created_utc", 1.0, 86402.0)).select("page_id", posts.post_url("permalink", "link").alias("post_url"))


# Manifests and samples -------------------------------------------------------------------------------------------------


@query("manifest_frames", with_("frames") + "SELECT video, 'v/' || (turn * 3 + 1) || '.png' AS frame, (row_number() OVER (PARTITION BY video ORDER BY turn) - 1)::INT AS place, (video % 2)::INT AS label_id FROM (SELECT DISTINCT conv_id AS video, turn FROM conversations)")
def manifest_frames(spark, d):
    v = P.frames(spark, d).select("video", F.when(F.col("video") % 2 == 0, "real").otherwise("fake").alias("label_name"), sampling.numeric_order(F.col("frames")).alias("frames"))
    return manifest.frames(v, {"real": 0, "fake": 1}).select("video", "frame", "place", "label_id")


@query("frame_first_n", with_("frames") + "SELECT video, array_to_string(frames[1:3], ',') AS frames FROM frames")
def frame_first_n(spark, d):
    return P.frames(spark, d).select("video", F.array_join(sampling.first_frames(sampling.numeric_order(F.col("frames")), 3), ",").alias("frames"))


@query("clip_windows", with_("frames").rstrip() + ", s AS (SELECT *, len(frames) AS n, len(frames) // 2 AS k FROM frames WHERE len(frames) >= 2), c AS (SELECT *, unnest(range(k)) AS clip FROM s), w AS (SELECT *, clip * CASE WHEN k > 1 THEN (n - 2) // (k - 1) ELSE 0 END AS st FROM c) SELECT video, clip::INT AS clip, st::INT AS start, array_to_string(frames[st + 1 : st + 2], ',') AS frames FROM w")
def clip_windows(spark, d):
    v = P.frames(spark, d).select("video", F.inline(sampling.clips(sampling.numeric_order(F.col("frames")), 2)))
    return v.select("video", "clip", "start", F.array_join("frames", ",").alias("frames"))


@query("frame_linspace", with_("frames") + "SELECT video, array_to_string(list_sort(list_distinct([floor(i * (len(frames) - 1) / 4.0)::BIGINT for i in range(5)])), ',') AS picked FROM frames")
def frame_linspace(spark, d):
    return P.frames(spark, d).select("video", F.array_join(sampling.picked_frames(F.size("frames"), 5), ",").alias("picked"))


@query("split_assignment", "WITH c AS (SELECT DISTINCT conv_id AS v FROM conversations), s AS (SELECT v, CASE WHEN v % 10 = 0 THEN NULL WHEN v % 3 = 0 THEN ['test'] WHEN v % 3 = 1 THEN ['val'] ELSE ['train'] END AS t FROM c) SELECT v, unnest(coalesce(t, ['train', 'val', 'test'])) AS split FROM s")
def split_assignment(spark, d):
    v = table(spark, d, "conversations").select(F.col("conv_id").alias("v")).distinct()
    known = v.where("v % 10 <> 0")
    pairs = known.select(F.col("v").cast("string").alias("a"), F.concat(F.lit("x"), F.col("v").cast("string")).alias("b"), F.element_at(F.array(F.lit("test"), F.lit("val"), F.lit("train")), (F.col("v") % 3 + 1).cast("int")).alias("split"))
    pairs = pairs.unionByName(pairs.withColumn("split", F.lit("train")))
    items = v.select(F.col("v"), F.col("v").cast("string").alias("name"), F.lit(True).alias("fake"))
    return manifest.assigned(items, manifest.split_keys(pairs), "name").select("v", "split")


@query("balanced_first_m", "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels) SELECT doc_id, quality FROM r WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY quality))")
def balanced_first_m(spark, d):
    return sampling.balanced_first(table(spark, d, "labels"), "quality", "doc_id").select("doc_id", "quality")


@query("sample_per_class_md5", "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || doc_id), doc_id) AS r FROM labels) SELECT doc_id, quality FROM r WHERE r <= CASE WHEN (SELECT min(c) FROM (SELECT count(*) AS c FROM labels GROUP BY quality)) < 50 THEN 7 ELSE 50 END")
def sample_per_class(spark, d):
    return sampling.sample_per_class(table(spark, d, "labels"), "quality", "doc_id", 50, 7).select("doc_id", "quality")


@query("stratified_folds", "SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY md5('418:' || doc_id), doc_id) - 1) % 5)::INT AS fold FROM labels")
def stratified_folds(spark, d):
    return sampling.folds(table(spark, d, "labels"), "quality", "doc_id").select("doc_id", "quality", F.col("fold").cast("int").alias("fold"))


@query("swap_within_class", "SELECT a.doc_id, b.doc_id AS partner FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS r FROM labels) a JOIN (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || doc_id), doc_id) AS r FROM labels) b USING (quality, r)")
def swap_within_class(spark, d):
    return sampling.swapped_within_class(table(spark, d, "labels"), "quality", "doc_id").select("doc_id", "partner")


_PICK = "('0x' || substr(md5('{0}:' || {1}), 1, {2}))::UBIGINT"


@query("random_pairs", "WITH r AS (SELECT doc_id AS pair, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM labels WHERE quality = 0) SELECT f.doc_id, r.pair FROM (SELECT doc_id FROM labels WHERE quality <> 0) f LEFT JOIN r ON r.i = " + _PICK.format("0p", "f.doc_id", 12) + " % (SELECT count(*) FROM labels WHERE quality = 0)")
def random_pairs(spark, d):
    labels = table(spark, d, "labels")
    return sampling.random_pairs(labels.where("quality <> 0").select("doc_id"), labels.where("quality = 0").select("doc_id"), "doc_id")


@query("limit_per_source", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT doc_id, source FROM r WHERE r <= greatest(5, ceil(60 / 20)) ORDER BY source, doc_id LIMIT 60")
def limit_per_source(spark, d):
    return sampling.limited(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 60, 20)


@query("group_frames", "SELECT a, b, (" + _PICK.format("0", "a || '_' || b", 8) + " % 32)::INT AS frame, slot, method FROM (SELECT DISTINCT conv_id AS a, conv_id + 1 AS b FROM conversations), (SELECT unnest([0, 1, 2, 3, 4])::INT AS slot, unnest(['real', 'df', 'f2f', 'fs', 'nt']) AS method)")
def group_frames(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("a"), (F.col("conv_id") + 1).alias("b")).distinct()
    return sampling.group_frames(c, ["df", "f2f", "fs", "nt"], 32)


# Result tables ---------------------------------------------------------------------------------------------------------

_DS = ["d0", "d1", "d2", "d3"]
_TOP = "top AS (SELECT detector, dataset, avg(value) AS v FROM (SELECT *, row_number() OVER (PARTITION BY detector, dataset ORDER BY value DESC) AS r FROM series WHERE value IS NOT NULL) WHERE r <= 3 GROUP BY 1, 2)"


def _top(spark, d):
    return tables.top_mean(P.series(spark, d), ["detector", "dataset"], "value", 3, "v")


@query("metric_top3_mean", with_("series").rstrip() + ",\n" + _TOP + " SELECT detector, dataset, round(v, 6) AS v FROM top")
def metric_top3(spark, d):
    return _top(spark, d).select("detector", "dataset", *_r("v"))


@query("metric_pivot", with_("series").rstrip() + ",\n" + _TOP + " SELECT detector, " + ", ".join(f"round(max(v) FILTER (dataset = '{x}'), 6) AS {x}" for x in _DS) + ", round(avg(v), 6) AS mean FROM top GROUP BY 1")
def metric_pivot(spark, d):
    return tables.pivoted(_top(spark, d), ["detector"], "dataset", "v", _DS, True, "mean").select("detector", *_r(*_DS, "mean"))


@query("pivot_mean", with_("series") + "SELECT detector, " + ", ".join(f"round(avg(value) FILTER (dataset = '{x}'), 6) AS {x}" for x in _DS) + " FROM series GROUP BY 1")
def pivot_mean(spark, d):
    return tables.pivoted(P.series(spark, d), ["detector"], "dataset", "value", _DS, False).select("detector", *_r(*_DS))


@query("transpose_table", with_("series").rstrip() + ",\n" + _TOP + " SELECT dataset AS name, " + ", ".join(f"round(max(v) FILTER (detector = '{x}'), 6) AS {x}" for x in ("click", "purchase", "view")) + " FROM top GROUP BY 1")
def transpose_table(spark, d):
    wide = tables.pivoted(_top(spark, d), ["detector"], "dataset", "v", _DS)
    return tables.transposed(wide, "detector", ["click", "purchase", "view"]).select("name", *_r("click", "purchase", "view"))


@query("baseline_delta", with_("series").rstrip() + ",\n" + _TOP + " SELECT detector, t.dataset, round(t.v - b.v, 6) AS delta FROM top t LEFT JOIN (SELECT detector, v FROM top WHERE dataset = 'd0') b USING (detector)")
def baseline_delta(spark, d):
    return tables.baseline_delta(_top(spark, d), ["detector"], "dataset", "d0", "v").select("detector", "dataset", *_r("delta"))


@query("avg_total_row", with_("series").rstrip() + ",\n" + _TOP + " SELECT detector, dataset, round(v, 6) AS v FROM top UNION ALL SELECT detector, 'avg', round(avg(v), 6) FROM top GROUP BY 1")
def avg_total_row(spark, d):
    return tables.with_average(_top(spark, d), ["detector"], "dataset", ["v"]).select("detector", "dataset", *_r("v"))


@query("weighted_mean", with_("series") + "SELECT detector, round(sum(value * (step % 7)) / nullif(sum(step % 7) FILTER (value IS NOT NULL), 0), 6) AS mean FROM series GROUP BY 1")
def weighted_mean(spark, d):
    return P.series(spark, d).groupBy("detector").agg(F.round(tables.weighted_mean("value", F.col("step") % 7), 6).alias("mean"))


@query("class_counts", "SELECT quality, count(*) AS n FROM labels GROUP BY 1")
def class_counts(spark, d):
    return tables.class_counts(table(spark, d, "labels"), "quality")


@query("rolling_mean_median", with_("series") + "SELECT step, round(median(value) OVER w + 1e-7, 4) AS median, round(avg(value) OVER w + 1e-7, 4) AS mean, round(avg(value) OVER (PARTITION BY detector, dataset ORDER BY step) + 1e-7, 4) AS global_mean FROM series WINDOW w AS (PARTITION BY detector, dataset ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def rolling_mean_median(spark, d):
    return series.rolling(P.series(spark, d), ["detector", "dataset"], "step", "value", 10).select("step", *(F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("median", "mean", "global_mean")))  # the shift keeps exact ties off the rounding


@query("best_so_far", with_("series") + "SELECT step, round(b, 6) AS best_before, b IS NULL OR value > b AS improved FROM (SELECT *, max(value) OVER (PARTITION BY detector, dataset ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM series)")
def best_so_far(spark, d):
    return series.best_so_far(P.series(spark, d), ["detector", "dataset"], "step", "value").select("step", *_r("best_before"), "improved")


@query("early_stop_state", with_("series").rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """,
d AS (SELECT detector, step // 200 AS epoch, avg(value) AS score, row_number() OVER (PARTITION BY detector ORDER BY step // 200) AS i FROM series GROUP BY 1, 2),
w AS (SELECT detector, epoch, i, score AS best, 0 AS counter, false AS stop FROM d WHERE i = 1
  UNION ALL SELECT d.detector, d.epoch, d.i, CASE WHEN d.score < w.best - 0.001 THEN w.best ELSE d.score END, CASE WHEN d.score < w.best - 0.001 THEN w.counter + 1 ELSE 0 END, w.stop OR (d.score < w.best - 0.001 AND w.counter + 1 >= 5) FROM w JOIN d ON d.detector = w.detector AND d.i = w.i + 1)
SELECT detector, epoch, round(best, 6) AS best, counter::INT AS counter, stop FROM w""")
def early_stop_state(spark, d):
    daily = P.series(spark, d).groupBy("detector", (F.floor(F.col("step") / 200)).alias("epoch")).agg(F.avg("value").alias("score"))
    return series.early_stop(daily, ["detector"], "epoch", "score").select("detector", "epoch", *_r("best"), "counter", "stop")


@query("metric_flush", with_("series") + "SELECT detector, ceil(step / 300)::BIGINT AS flush, round(avg(value), 6) AS value, max(step) AS \"at\" FROM series GROUP BY 1, 2")
def metric_flush(spark, d):
    return series.flushes(P.series(spark, d), ["detector"], "step", ["value"]).select("detector", "flush", *_r("value"), "at")


# Vectors, curves, spread, streams --------------------------------------------------------------------------------------

_ENS = "WITH p AS (SELECT vec_id // 4 AS video, unnest(range(64)) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings), g AS (SELECT video, c, {0} AS v, count(*) AS n FROM p GROUP BY 1, 2) SELECT video, round(max(v) FILTER (c = 0), 5) AS p0, round(max(v) FILTER (c = 1), 5) AS p1, round(max(v) FILTER (c = 2), 5) AS p2, round(max(v), 5) AS highest, max(n) AS clips FROM g GROUP BY 1"


def _ensemble(spark, d, how):
    e = vision.ensemble(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "vec_id", "v", 4, how)
    return e.select("video", *(F.round(F.element_at("preds", i + 1), 5).alias(f"p{i}") for i in range(3)), F.round(F.array_max("preds"), 5).alias("highest"), "clips")


@query("ensemble_clip_sum", _ENS.format("sum(v)"))
def ensemble_sum(spark, d):
    return _ensemble(spark, d, "sum")


@query("ensemble_clip_max", _ENS.format("greatest(max(v), 0.0)"))
def ensemble_max(spark, d):
    return _ensemble(spark, d, "max")


@query("incomplete_videos", "SELECT vec_id // 4 AS video, count(*) AS clips FROM embeddings WHERE vec_id % 11 <> 0 GROUP BY 1 HAVING count(*) <> 4")
def incomplete_videos(spark, d):
    e = table(spark, d, "embeddings").where("vec_id % 11 <> 0").select("vec_id", F.col("embedding").alias("v"))
    return vision.incomplete(vision.ensemble(e, "vec_id", "v", 4), 4).select("video", "clips")


@query("quadratic_fit", """WITH r AS (SELECT user_id AS u, (event_id % 7)::DOUBLE AS x, value::DOUBLE AS y FROM events), s AS (SELECT u, count(*)::DOUBLE AS n, count(DISTINCT x) AS k, sum(x) AS s1, sum(x * x) AS s2, sum(x ** 3) AS s3, sum(x ** 4) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2 FROM r GROUP BY 1 HAVING count(DISTINCT x) >= 3),
t AS (SELECT *, s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS det FROM s)
SELECT u, round((t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0)) / det, 4) AS a, round((s4 * (t1 * n - t0 * s1) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - t1 * s2)) / det, 4) AS b FROM t""")
def quadratic_fit(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("u"), (F.col("event_id") % 7).alias("x"), "value")
    enough = e.groupBy("u").agg(F.count_distinct("x").alias("k")).where("k >= 3").select("u")
    return vision.quadratic_fit(e.join(enough, "u"), ["u"], "x", "value").select("u", *_r("a", "b", digits=4))


@query("knn_top10", "WITH p AS (SELECT a.vec_id AS key, b.vec_id AS neighbour, sqrt(list_sum([power(x[1]::DOUBLE - x[2]::DOUBLE, 2) for x in list_zip(a.embedding, b.embedding)])) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist, neighbour) AS rank FROM p) SELECT key, neighbour, round(dist, 5) AS distance, rank FROM r WHERE rank <= 10")
def knn_top10(spark, d):
    return neighbours.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 10).select("key", "neighbour", *_r("distance", digits=5), "rank")


@query("hamming_similarity", "SELECT doc_id, round(1 - bit_count(xor(h, h2)) / 64.0, 6) AS similarity FROM (SELECT doc_id, doc_id * 2654435761 % 4294967296 AS h, n_chars * 40503 % 4294967296 AS h2 FROM documents)")
def hamming_similarity(spark, d):
    a, b = F.col("doc_id") * 2654435761 % 4294967296, F.col("n_chars") * 40503 % 4294967296
    return table(spark, d, "documents").select("doc_id", F.round(N.hamming_similarity(a, b), 6).alias("similarity"))


@query("hash_stability", "SELECT source AS image, round(avg(1 - bit_count(xor(doc_id * 2654435761 % 4294967296, n_chars * 40503 % 4294967296)) / 64.0), 6) AS cred_score FROM documents GROUP BY 1")
def hash_stability(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("image"), (F.col("doc_id") * 2654435761 % 4294967296).alias("base_hash"), (F.col("n_chars") * 40503 % 4294967296).alias("trial_hash"))
    return risk.stability_or_default(rows).select("image", *_r("cred_score"))


@query("vector_distances", "SELECT vec_id, round(sqrt(list_sum([x::DOUBLE * x for x in embedding])), 5) AS norm, round(list_sum([x[1]::DOUBLE * x[2] for x in list_zip(embedding[1:32], embedding[33:64])]) / sqrt(list_sum([x::DOUBLE * x for x in embedding[1:32]])) / sqrt(list_sum([x::DOUBLE * x for x in embedding[33:64]])), 5) AS cosine FROM embeddings")
def vector_distances(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(N.l2_norm("embedding"), 5).alias("norm"), F.round(N.cosine(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), 5).alias("cosine"))


@query("softmax_scores", "SELECT vec_id, round(exp(embedding[2]::DOUBLE) / list_sum([exp(x::DOUBLE) for x in embedding]), 5) AS prob FROM embeddings")
def softmax_scores(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.element_at(N.softmax(F.col("embedding").cast("array<double>")), 2), 5).alias("prob"))


@query("infection_probability", with_("content") + "SELECT image, round(least(greatest(0.05 + 0.6 * content_score * (1 - (doc_id % 10) / 10.0) + 0.3 * (doc_id % 3), 0.0), 1.0), 6) AS p FROM content")
def infection_probability(spark, d):
    i = F.col("doc_id")
    return P.content(spark, d).select("image", F.round(N.infection_probability(F.col("content_score"), (i % 10) / 10.0, 0.05, 0.6, F.lit(0.3) * (i % 3)), 6).alias("p"))


@query("rate_schedules", "SELECT s AS step, count(*) AS events, round(0.1 * (cos(pi() * s / 50.0) + 1) / 2, 6) AS cosine, CASE WHEN s >= 30 THEN 0.001 WHEN s >= 10 THEN 0.01 ELSE 0.1 END::DOUBLE AS stepped, round(CASE WHEN s <= 20 THEN 0.1 ELSE greatest(0.1 * (1 - (s - 20) / 30.0), 0.0) END, 6) AS linear FROM (SELECT event_id % 60 AS s FROM events) GROUP BY s")
def rate_schedules(spark, d):
    """Rates of the steps that events fall into."""
    s = F.col("step")
    steps = table(spark, d, "events").groupBy((F.col("event_id") % 60).alias("step")).agg(F.count(F.lit(1)).alias("events"))
    return steps.select("step", "events", F.round(N.cosine_rate(s, 50, 0.1), 6).alias("cosine"), N.step_rate(s, [0, 10, 30], [0.1, 0.01, 0.001]).alias("stepped"), F.round(N.linear_decay(s, 50, 20, 0.1), 6).alias("linear"))


@query("props_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("cascade_simulation")
def cascade_simulation(spark, d):
    return simulate.cascade(risk.with_provenance(P.content(spark, d), P.provenance(spark, d)))


@query("stream_snapshots_equals_batch", "SELECT user_id, event_id, round(value, 6) AS value FROM events")
def stream_snapshots(spark, d):
    """The stream reads events, leaves out repeats, however late, and appends; what it wrote is the result."""
    place = more.place(spark, "stream")
    schema = table(spark, d, "events").schema
    rows = snapshots.source(spark, f"{d}/events.parquet*", schema, "parquet")
    rows = snapshots.deduplicated(snapshots.with_event_time(rows, "ts"), ["user_id", "event_id"], delay=None).select("user_id", "event_id", F.round("value", 6).alias("value"))
    snapshots.run_until(snapshots.append(rows, f"{place}/out", f"{place}/state"))
    return spark.read.schema("user_id long, event_id long, value double").parquet(f"{place}/out")


@query("cv_logreg_auc")
def cv_logreg_auc(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.element_at("embedding", 1) > 0).cast("int").alias("y"))
    return learn.scores(learn.cross_validated(e, "v", "y", "vec_id", "logistic", 3))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: risks of all items, their policies and how many of each."""
    return policy_counts(spark, sf_dir)

