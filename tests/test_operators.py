"""Traps of single operators, with results worked out by hand."""

import json
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import numbers as N
from tidemark.functions import text as X
from tidemark.functions.stats import incomplete_beta, student_two_sided
from tidemark.operators import engagement, keyed, learn, manifest, metrics, neighbours, posts, quality, ranking, risk, sampling, series, simulate, tables, vision, webmeta
from tidemark.sources import readers, sinks
from tidemark.sources.schemas import SNAPSHOTS
from tidemark.streaming import snapshots


def one(df):
    return df.collect()[0]


def test_parse_double(spark):
    df = spark.createDataFrame([("1",), ("1d",), ("1_000",), (" 2.5 ",), ("nan",), ("None",), ("",), (None,), ("1e3",)], "s string")
    got = [r.x for r in df.select(N.parse_double("s", none_word=True).alias("x")).collect()]
    assert got[0] == 1 and got[1] is None and got[2] == 1000 and got[3] == 2.5 and math.isnan(got[4]) and got[5:8] == [None] * 3 and got[8] == 1000


def test_parse_int(spark):
    df = spark.createDataFrame([("200",), ("200.0",), ("",)], "s string")
    assert [r.x for r in df.select(N.parse_int("s").alias("x")).collect()] == [200, None, None]


def test_content_scores(spark):
    df = spark.createDataFrame([("a", "", "0.5", "0.9"), ("b", "1", "", "0.9"), ("c", None, "x", "1")], "image string, label string, prob string, score string")
    got = {r.image: (r.content_score, r.label) for r in risk.content_scores(df).collect()}
    assert got == {"a": (0.5, -1), "b": (0.0, 1), "c": (0.0, -1)}
    assert one(risk.content_scores(df.drop("prob").where("image = 'a'"))).content_score == 0.9
    with pytest.raises(Exception, match="label is no integer"):
        risk.content_scores(spark.createDataFrame([("a", "1.0", "0")], "image string, label string, prob string")).collect()


def test_fusion_by_hand(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0), (0.0, 1.0, 1.0), (0.5, 0.5, 0.5)], "cred_score double, content_score double, early_risk double")
    got = [round(r.p2p_risk_raw, 6) for r in risk.fused(df).collect()]
    assert got == [0.075858, 0.924142, 0.5]


def test_rescale_gates(spark):
    df = spark.createDataFrame([("a", 0.4), ("b", 0.4), ("c", 0.4), ("d", 0.4)], "image string, raw double")
    assert {round(r.y, 9) for r in risk.rescaled(df, "raw", "y", "quantile").collect()} == {0.2}
    assert {round(r.y, 9) for r in risk.rescaled(df, "raw", "y", "linear", expand_lo=0.2, expand_hi=0.8).collect()} == {0.5}
    assert {r.y for r in risk.rescaled(df.limit(3), "raw", "y", "quantile").collect()} == {0.4}
    assert {r.y for r in risk.rescaled(df, "raw", "y", "linear").collect()} == {0.4}


def test_policy_is_strict(spark):
    df = spark.createDataFrame([("a", 0.8), ("b", 0.8000001), ("c", 0.6)], "image string, p2p_risk double")
    assert [r.policy for r in risk.policy(df).orderBy("image").collect()] == ["label", "limit", "none"]


def test_joins_default_and_drop(spark):
    c = spark.createDataFrame([("a", 0.1, 1), ("b", 0.2, None)], "image string, content_score double, label int")
    p = spark.createDataFrame([("a", 0.9), ("x", 0.3)], "image string, cred_score double")
    g = spark.createDataFrame([("b", 0.7)], "image string, early_risk double")
    got = {r.image: (r.label, r.cred_score, r.early_risk) for r in risk.assembled(c, p, g).collect()}
    assert got == {"a": (1, 0.9, 0.5), "b": (-1, 0.5, 0.7)}


def test_last_wins_keeps_the_first_place(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("j", 2, "x"), ("k", 3, "new")], "key string, pos int, v string")
    assert sorted((r.key, r.pos, r.v) for r in keyed.last_wins(df, ["key"], "pos").collect()) == [("j", 2, "x"), ("k", 1, "new")]
    first = keyed.first_wins(df, ["key"], "pos")
    assert sorted(map(tuple, keyed.first_wins(first, ["key"], "pos").collect())) == sorted(map(tuple, first.collect()))


def test_mapped_raises_on_a_miss(spark):
    df = spark.createDataFrame([("a",), ("z",)], "c string")
    with pytest.raises(Exception, match="no entry for z"):
        keyed.mapped(df, "c", {"a": 1}).collect()


@pytest.mark.parametrize("labels,probs,auc,ap", [([1, 1, 0, 0], [4, 3, 2, 1], 1.0, 1.0), ([0, 0, 1, 1], [4, 3, 2, 1], 0.0, (1 / 3 + 2 / 4) / 2), ([1, 0, 1, 0], [1, 1, 1, 1], 0.5, 0.5), ([1, 1], [2, 1], None, 1.0)])
def test_ranking_metrics(spark, labels, probs, auc, ap):
    df = spark.createDataFrame(list(zip(labels, map(float, probs), strict=True)), "label int, prob double")
    got = one(metrics.summary(metrics.curve(df)))
    assert (got.auc is None) == (auc is None) and (auc is None or abs(got.auc - auc) < 1e-12) and abs(got.ap - ap) < 1e-12


def test_eer_depends_on_pruning(spark):
    rows = [(y, 1 - i / 100) for i in range(8) for y in (0, 1)] + [(0, 0.5), (0, 0.4)]
    got = one(metrics.summary(metrics.curve(spark.createDataFrame(rows, "label int, prob double"))))
    assert abs(got.eer_unpruned - 0.4) < 1e-12 and abs(got.eer - 0.1) < 1e-12


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 3000), np.round(rng.random(3000), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "label int, prob double")
    pos, neg = s[y == 1], s[y == 0]
    auc = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
    ap = sum(((s == t) & (y == 1)).sum() * ((s >= t) & (y == 1)).sum() / (s >= t).sum() for t in np.unique(s)) / (y == 1).sum()
    got = one(metrics.summary(metrics.curve(df, ranges=8)))
    assert abs(got.auc - auc) < 1e-12 and abs(got.ap - ap) < 1e-12
    flipped = one(metrics.summary(metrics.curve(df.withColumn("prob", 1 - F.col("prob")))))
    assert abs(flipped.auc + got.auc - 1) < 1e-12


def test_unlabelled_row_turns_auc_off(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (-1, 0.5)], "label int, prob double")
    assert one(metrics.auc_if_labelled(df)).auc is None and one(metrics.auc_if_labelled(df, skip_unlabelled=True)).auc == 1.0


def test_best_threshold(spark):
    df = spark.createDataFrame([(0, 0.1, 0), (1, 0.4, 1), (0, 0.6, 2), (1, 0.9, 3)], "label int, prob double, position int")
    assert tuple(one(metrics.best_threshold(df))) == (0.9, 0.75)
    apart = spark.createDataFrame([(0, 0.2, 0), (1, 0.6, 1)], "label int, prob double, position int")
    assert abs(one(metrics.best_threshold(apart)).threshold - 0.4) < 1e-12


def test_groups_by_folder_and_mixed_label(spark):
    df = spark.createDataFrame([("x\\v1\\1.png", 0.2, 1), ("y/v1/2.png", 0.6, 0), ("y/v2/1.png", 0.5, 1)], "image string, prob double, label int")
    got = {r.group: (r.prob, r.label) for r in metrics.by_group(df, X.parent_folder("image")).collect()}
    assert got == {"v1": (0.4, 0), "v2": (0.5, 1)}
    assert one(metrics.accuracy(spark.createDataFrame([(0.5, 0)], "prob double, label int"))).acc == 1.0


def test_mean_roc(spark):
    df = spark.createDataFrame([(b, y, s) for b in (0, 1) for y, s in ((1, 0.9), (0, 0.5), (1, 0.4), (0, 0.1))], "batch int, label int, prob double")
    got = metrics.mean_roc(metrics.curve(df, by=("batch",)), "batch", 5).orderBy("fpr").collect()
    assert [round(r.tpr, 6) for r in got] == [0.0, 0.5, 1.0, 1.0, 1.0] and one(metrics.trapezoid(metrics.mean_roc(metrics.curve(df, by=("batch",)), "batch", 5))).area > 0.7


def test_mean_roc_has_zero_where_every_score_has_false_positives(spark):
    df = spark.createDataFrame([(b, p, y) for b in (0, 1) for p in (0.9, 0.5) for y in (0, 1)], "batch int, prob double, label int")
    got = metrics.mean_roc(metrics.curve(df, by=("batch",)), "batch", 5).orderBy("fpr").collect()
    assert [(r.fpr, round(r.tpr, 6)) for r in got] == [(0.0, 0.0), (0.25, 0.25), (0.5, 0.5), (0.75, 0.75), (1.0, 1.0)]


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    got = {r.bin: r.n for r in metrics.histogram(df, "x").collect()}
    assert got[50] == 3 and sum(got.values()) == 101 and max(got) == 50


def test_propagation_features_by_hand(spark):
    df = spark.createDataFrame([("p", 0.0, 100.0, 25.0, 0.9), ("q", None, -5.0, 0.0, 2.0)], "posting_id string, created_utc double, score double, num_comments double, upvote_ratio double")
    got = {r.posting_id: r for r in engagement.propagation_features(df.withColumn("created_utc", F.when(F.col("posting_id") == "p", 1000.0)), snapshot=8200.0).collect()}
    p, q = got["p"], got["q"]
    assert len(p) == 31 and (p.engagement_total, p.score_rate_per_hour, p.comment_rate_per_hour, p.logistic_carrying_capacity) == (125, 50, 12.5, 151)
    assert (p.hawkes_branching_ratio, round(p.hawkes_base_mu, 9), round(p.hawkes_peak_intensity, 9), round(p.hawkes_expected_count_6h, 9)) == (0.2, 40, 50, 100)
    assert abs(p.hawkes_early_frac_24h - 1) < 1e-9 and abs(p.logistic_pred_6h - 100) < 1e-6 and abs(p.gompertz_pred_24h - 100) < 1e-6
    assert q.age_hours == round(1 / 60, 6) and q.logistic_early_frac_1h == 0 and q.upvote_ratio == 1.0


def test_inventory_upper_median_and_flags(spark):
    rows = [("e", str(i), "GIF ", "") for i in (1, 2, 3, 4)] + [("o", str(i), "other", "x") for i in (1, 2, 3)] + [("n", "None", "image", None), ("", "1", "gif", "")]
    got = {r.posting_id: r for r in engagement.inventory_aggregate(spark.createDataFrame(rows, "posting_id string, size_bytes string, kind string, errors string")).collect()}
    assert got["e"].size_bytes_median == 3 and got["o"].size_bytes_median == 2 and got["n"].size_bytes_median is None and got["e"].share_gif == 1 and got["o"].error_rate == 1 and "" not in got
    prov = spark.createDataFrame([("a", "1", "True", "1.0", "3"), ("a", "0", "1", "", "None")], "posting_id string, c2pa_present string, c2pa_valid string, pdq_available string, vpdq_frames string")
    r = one(engagement.provenance_aggregate(prov))
    assert (r.total, r.c2pa_present_sum, r.c2pa_valid_sum, r.pdq_present_sum, r.vpdq_frames_mean) == (2, 1, 1, 0, 3.0)


def test_p_values():
    assert abs(incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-10
    assert abs(student_two_sided(0.5, 4) - 0.5) < 1e-12 and student_two_sided(1.0, 30) == 0 and student_two_sided(None, 30) is None and abs(student_two_sided(0.0, 30) - 1) < 1e-12


def test_top_correlations_put_nan_last(spark):
    df = spark.createDataFrame([("a", "m", float("nan"), 0.1), ("b", "m", 0.2, 0.1), ("c", "m", -0.9, 0.0)], "feature string, detector_metric string, spearman_r double, pearson_r double")
    assert [r.feature for r in engagement.top_correlations(df).collect()] == ["c", "b", "a"]


def test_numeric_columns(spark):
    df = spark.createDataFrame([("x", "", "a"), ("1", None, "b")], "p string, q string, r string")
    assert engagement.numeric_columns(df) == ["p"]


def test_urls(spark):
    urls = ["https://youtu.be/abcDEF12_-", "https://www.reddit.com/r/pics/comments/1abc2d/x/", "https://t.me/c/123/77", "http://x.y/z", ""]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [tuple(r) for r in df.select(X.platform("u"), X.post_id("u")).collect()]
    assert got == [("youtube", "abcDEF12_-"), ("reddit", "1abc2d"), ("telegram", "77"), ("unknown", "http://x.y/z"), ("unknown", "")]
    assert one(spark.sql("SELECT 'https://a.b.co.uk/x' AS u").select(X.registrable_domain(X.host("u")).alias("d"))).d == "b.co.uk"


def test_hash_lines_take_digits_of_the_hash(spark):
    text = "ab12" + "f" * 60 + " 3.5 80\nno hash 1 2\n" + "A" * 64
    got = one(spark.createDataFrame([(text,)], "t string").select(X.hash_lines("t").alias("f"))).f
    assert [(r.ts, r.quality) for r in got] == [(12.0, 80.0), (0.0, 0.0)] and got[1].hash == "a" * 64


def test_provenance_report(spark):
    good = json.dumps({"manifests": [{"claimGenerator": "g", "assertions": [{"a": 1}, {"b": 2}], "vendor": "v"}], "verification": {"overall": "OK"}})
    got = [r.r for r in spark.createDataFrame([(good,), ("[1]",), ("x",)], "t string").select(X.provenance_report("t").alias("r")).collect()]
    assert (got[0].claim_generator, got[0].assertions_count, got[0].valid, got[0].vendor) == ("g", 2, True, "v") and got[1].valid is None and got[2].claim_generator is None


def test_small_texts(spark):
    df = spark.createDataFrame([(0.125, "  a\t", [("k", "1"), ("k", "2")])], "x double, s string, e array<struct<k:string,v:string>>")
    r = one(df.select(X.fixed6("x").alias("x"), X.strip("s").alias("s"), X.last_wins_map("e", "k", "v").alias("m"), X.image_format(F.unhex(F.lit("FFD8FF00"))).alias("f"), X.distinguished_name(F.lit("a"), F.lit(""), F.lit("c")).alias("d")))
    assert (r.x, r.s, r.m, r.f, r.d) == ("0.125", "a", {"k": "2"}, "jpeg", "CN=a; C=c")


def test_flattened_records(spark, tmp_path):
    (tmp_path / "w.jsonl").write_text('{"url": "https://a.b/c", "http": {"final_url": "", "response_url": "r", "status_code": "200.0"}, "wayback": {"first_seen_ts": "", "first_ts": "1", "last_ts": "2", "count": 3}}\nbroken\n\n{"url": "nocolon", "http": null}\n')
    got = webmeta.flattened(readers.webmeta(spark, str(tmp_path / "w.jsonl"))).orderBy("url").collect()
    assert len(got) == 2 and len(got[0]) == 25
    a, b = got
    assert (a.http_final_url, a.status_code, a.wayback_first_seen_ts, a.wayback_latest_seen_ts, a.wayback_snapshots, a.scheme, a.error_count) == ("r", None, "", "2", 3, "https", 0)
    assert (b.scheme, b.http_requested if "http_requested" in b else b.http_url_requested, b.rdap_domain_status) == (None, "nocolon", "")


def test_media_posts(spark):
    df = spark.createDataFrame([("http://x/a.PNG", None, False), ("http://x/a", "my.youtube.com.evil", False), ("http://x/a.png", None, True), ("http://x/a", None, False)], "url string, domain string, over_18 boolean")
    assert [r.m for r in df.select(posts.is_media_post(df).alias("m")).collect()] == [True, True, False, False]


def test_frames(spark):
    df = spark.createDataFrame([(["2.png", "10.png", "1.png"],)], "f array<string>")
    assert one(df.select(sampling.numeric_order(F.col("f")).alias("f"))).f == ["1.png", "2.png", "10.png"]
    forty = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda x: x.cast("string")).alias("f"))
    assert one(forty.select(sampling.first_frames(F.col("f"), 32).alias("f"))).f[-1] == "32"
    assert one(forty.select(sampling.first_frames(F.col("f"), 20, evenly=True).alias("f"))).f[-1] == "39"
    ten = spark.range(1).select(F.sequence(F.lit(0), F.lit(9)).alias("f"))
    assert [c.start for c in one(ten.select(sampling.clips(F.col("f"), 4).alias("c"))).c] == [0, 6]
    assert one(ten.select(sampling.clips(F.col("f"), 11).alias("c"))).c == []
    assert one(spark.range(1).select(sampling.picked_frames(F.lit(3), 5).alias("p"))).p == [0, 1, 2]


def test_balancing(spark):
    df = spark.createDataFrame([(i, int(i >= 5)) for i in range(7)], "i int, label int")
    assert sorted(r.i for r in sampling.balanced_first(df, "label", "i").collect()) == [0, 1, 5, 6]
    counts = {(r.fold, r.label): r["count"] for r in sampling.folds(df, "label", "i", 2).groupBy("fold", "label").count().collect()}
    assert counts[0, 0] + counts[1, 0] == 5 and abs(counts[0, 0] - counts[1, 0]) <= 1
    again = sampling.resampled(df, "label", "i").groupBy("label").count().collect()
    assert {r["count"] for r in again} == {5}
    swapped = sampling.swapped_within_class(df, "label", "i").collect()
    assert sorted(r.partner for r in swapped) == list(range(7)) and all((r.i >= 5) == (r.partner >= 5) for r in swapped)
    frames = sampling.group_frames(spark.createDataFrame([(1, 2), (3, 4)], "a int, b int"), ["m", "n"], 10).groupBy("a").agg(F.count_distinct("frame").alias("k"), F.count("*").alias("n")).collect()
    assert all(r.k == 1 and r.n == 3 for r in frames)


def test_manifest_round_trip(spark):
    rows = spark.createDataFrame([("real", "train", "v1", ["b/v1/2.png", "b/v1/10.png"])], "label string, split string, video string, frames array<string>")
    text = manifest.manifest_json(rows, "D")
    got = one(manifest.videos(text))
    assert (got.dataset, got.label, got.split, got.video, got.label_name, got.frames) == ("D", "real", "train", "v1", "real", ["b/v1/2.png", "b/v1/10.png"])
    assert [r.label_id for r in manifest.frames(manifest.videos(text), {"real": 0}).collect()] == [0, 0]
    pairs = spark.createDataFrame([("000", "003", "train"), ("000", "004", "test")], "a string, b string, split string")
    keys = {r.key: r.split for r in manifest.split_keys(pairs).collect()}
    assert keys["000"] == "test" and keys["003_000"] == "train" and len(keys) == 7
    items = spark.createDataFrame([("009", True), ("003", False)], "name string, fake boolean")
    assert sorted(r.split for r in manifest.assigned(items, manifest.split_keys(pairs), "name").collect()) == ["test", "train", "train", "val"]


def test_tables(spark):
    df = spark.createDataFrame([("a", "x", 0.9), ("a", "x", 0.8), ("a", "x", 0.7), ("a", "x", 0.6), ("a", "y", 0.5), ("a", "y", float("nan"))], "d string, s string, v double")
    got = {r.s: round(r.top_mean, 9) for r in tables.top_mean(df, ["d", "s"], "v").collect()}
    assert got == {"x": 0.8, "y": 0.5}
    with pytest.raises(Exception, match="two values of one cell"):
        tables.pivoted(df, ["d"], "s", "v", ["x", "y"]).collect()
    log = spark.createDataFrame(list(enumerate(["dataset: A", "acc: 0.5", "auc: 0.7", "dataset: B", "acc: 0.6"])), "position int, value string")
    assert {r.dataset: (r.AUC, r.ACC) for r in tables.scraped_log(log).collect()} == {"A": (None, None), "B": (None, None)}
    assert {r.dataset: (r.AUC, r.ACC) for r in tables.scraped_log(log, case_sensitive=False).collect()} == {"A": (0.7, 0.5), "B": (None, 0.6)}
    assert [r.d for r in tables.in_order(spark.createDataFrame([("b",), ("z",), ("a",)], "d string"), "d", ["b", "a"]).collect()] == ["b", "a", "z"]


def test_early_stop(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.8995), (2, 0.89)], "epoch int, score double")
    got = series.early_stop(df, [], "epoch", "score").orderBy("epoch").collect()
    assert [(r.best, r.counter) for r in got] == [(0.9, 0), (0.8995, 0), (0.8995, 1)]
    assert [r.stop for r in series.early_stop(df.unionByName(spark.createDataFrame([(3, 0.1)], df.schema)), [], "epoch", "score", patience=2).orderBy("epoch").collect()] == [False, False, False, True]


def test_quadratic_fit(spark):
    df = spark.createDataFrame([("q", 0.0, 1.0), ("q", 1.0, 2.0), ("q", 2.0, 5.0), ("l", 0.0, 1.0), ("l", 1.0, 3.0)], "g string, x double, y double")
    got = {r.g: tuple(round(x, 9) for x in (r.a, r.b, r.c, r.r2)) for r in vision.quadratic_fit(df, ["g"], "x", "y").collect()}
    assert got == {"q": (1.0, 0.0, 1.0, 1.0), "l": (0.0, 2.0, 1.0, 1.0)}


def test_nearest_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.random((60, 3))
    x[7] = x[3]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    monkeypatch.setattr(neighbours, "TILE", 7)
    monkeypatch.setattr(neighbours, "PIVOTS", 5)
    monkeypatch.setattr(neighbours, "VISITS", 20)
    got = {}
    for r in neighbours.nearest(df, "id", "v", 4).orderBy("rank").collect():
        got.setdefault(r.key, []).append(r.neighbour)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    for i in range(60):
        assert got[i] == sorted((j for j in range(60) if j != i), key=lambda j: (d[i, j], j))[:4]


def test_detection_precision(spark):
    truth = spark.createDataFrame([("k", 1, 0.0, 0.0, 10.0, 10.0), ("k", 1, 20.0, 20.0, 30.0, 30.0)], "key string, action_id int, x1 double, y1 double, x2 double, y2 double")
    found = spark.createDataFrame([("k", 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("k", 1, 0.8, 0.0, 0.0, 10.0, 9.0), ("k", 1, 0.7, 20.0, 20.0, 30.0, 30.0)], "key string, action_id int, score double, x1 double, y1 double, x2 double, y2 double")
    assert abs(one(vision.detection_precision(truth, found)).ap - (1 + 2 / 3) / 2) < 1e-12


def test_cascade_bounds(spark):
    near = simulate.preferential_graph(300, 3)
    assert (near == near.T).all() and near.sum() // 2 == 3 + 296 * 3
    df = spark.createDataFrame([("a", 0.0, 1.0), ("b", 1.0, 0.0)], "image string, content_score double, cred_score double")
    assert {r.early_risk for r in simulate.cascade(df, base=0, coefficient=0, noise=0).collect()} == {1 / 300}
    ball = np.linalg.matrix_power(near.astype(int) + np.eye(300, dtype=int), 2) > 0
    many = spark.createDataFrame([(f"i{i}", 1.0, 0.0) for i in range(200)], "image string, content_score double, cred_score double")
    sure = simulate.cascade(many, base=1, steps=2).collect()
    assert all(r.early_risk == ball[r.start].sum() / 300 for r in sure) and len({r.start for r in sure}) > 100
    low = many.withColumn("content_score", F.lit(0.0))
    mean = {k: one(simulate.cascade(x).agg(F.avg("early_risk").alias("m"))).m for k, x in (("low", low), ("high", many))}
    assert 1 / 300 <= mean["low"] < mean["high"] <= 1


def test_checks(spark):
    df = spark.createDataFrame([("a", "0.5"), ("b", ""), ("c", "nan"), ("d", "2"), ("e", "x"), ("a", None)], "k string, v string")
    r = one(quality.range_check(df, "v", "k"))
    assert (r.rows, r.missing, r.nan_or_inf, r.out_of_range, r.not_float, r.bad, r.examples) == (6, 2, 1, 1, 1, 5, ["a", "b", "c", "d", "e"])
    assert one(quality.unique_check(df, "k")).duplicate_keys == 1
    with pytest.raises(ValueError, match="missing"):
        quality.require(df, ["zz"])
    with pytest.raises(ValueError, match="no rows"):
        quality.require(df.limit(0), ["k"])


def test_registry(spark):
    assert registry.names("policy") == ["simple_threshold"] and "p2p_sigmoid" in registry.names("aggregator") and registry.names("provenance") == ["phash_stability", "phash_stability_enhanced"]
    df = spark.createDataFrame([("a", 0.9)], "image string, p2p_risk double")
    assert one(registry.apply("policy", "simple_threshold", df, hi=0.95, unknown=1)).policy == "label"
    with pytest.raises(KeyError, match="no policy plugin"):
        registry.plugin("policy", "nope")


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("image,v\na,1\nb,2\na,3\n")
    assert sorted(map(tuple, readers.keyed_csv(spark, str(tmp_path / "t.csv")).collect())) == [("a", "3"), ("b", "2")]
    with pytest.raises(KeyError):
        readers.keyed_csv(spark, str(tmp_path / "t.csv"), "zz")
    (tmp_path / "l.txt").write_text("  one \n\n two\n")
    assert sorted(r.value for r in readers.lines(spark, str(tmp_path / "l.txt")).collect()) == ["one", "two"]
    sinks.features_csv(spark.createDataFrame([("a", 1.5, None)], "k string, x double, y double").coalesce(1), str(tmp_path / "f"))
    assert "".join(p.read_text() for p in (tmp_path / "f").glob("part-*")).split() == ["k,x,y", "a,1.5,"]
    sinks.csv(spark.createDataFrame([("a",)], "k string").coalesce(1), str(tmp_path / "g"), ["k", "zz"])
    assert "".join(p.read_text() for p in (tmp_path / "g").glob("part-*")).split() == ["k,zz", "a,"]
    (tmp_path / "m" / "det").mkdir(parents=True)
    (tmp_path / "m" / "det" / "test_DS_auc.csv").write_text("Step,Value\n1,0.5\n")
    assert tuple(one(readers.metric_series(spark, str(tmp_path / "m" / "*" / "*.csv")))) == ("det", "DS", 1, 0.5)
    (tmp_path / "i").mkdir()
    for n in ("a.png", "a.b.png", "c"):
        (tmp_path / "i" / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in readers.listing(spark, str(tmp_path / "i")).collect()] == ["a.png"]
    (tmp_path / "b.csv").write_text("v,902,1,2,3,4,7\n")
    r = one(readers.boxes(spark, str(tmp_path / "b.csv")))
    assert (r.key, r.score) == ("v,0902", 1.0)
    assert readers.merged_settings({"a": 1, "n": {"x": 1}}, {"n": {"y": 2}}, fill_in={"a": 9, "b": 3}) == {"a": 1, "b": 3, "n": {"x": 1, "y": 2}}
    sinks.report(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "r"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "r").glob("part-*"))) == {"a": 1, "b": None}


def test_stream_equals_batch(spark, tmp_path):
    rows = [json.dumps({"snapshot_utc": 1000.0 + i // 2, "posting_id": f"p{i % 3}", "score": float(i)}) for i in range(12)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(rows + rows))
    stream = snapshots.deduplicated(snapshots.with_event_time(snapshots.source(spark, str(tmp_path / "in"))), ["posting_id", "snapshot_utc"])
    targets = spark.createDataFrame([("p0",), ("p1",)], "posting_id string")
    snapshots.run_until(snapshots.append(snapshots.of_targets(stream, targets), str(tmp_path / "out"), str(tmp_path / "state")))
    got = {(r.posting_id, r.snapshot_utc) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = snapshots.of_targets(snapshots.deduplicated(spark.read.schema(SNAPSHOTS).json(str(tmp_path / "in")), ["posting_id", "snapshot_utc"]), targets)
    assert got == {(r.posting_id, r.snapshot_utc) for r in batch.collect()} and spark.read.parquet(str(tmp_path / "out")).count() == len(got)
    timed = snapshots.with_event_time(batch)
    assert snapshots.rates(timed).count() == 2 and snapshots.sessions(timed).count() == 2


def test_stream_query_takes_late_rows_of_many_files(spark, sf_dir, tmp_path):
    from tidemark.plans.queries import QUERIES

    events = pq.read_table(f"{sf_dir}/events.parquet").sort_by("ts")
    step = len(events) // 250
    (tmp_path / "events.parquet").mkdir()
    order = list(range(250))  # of three batches of 100, as rows are late from the third one on
    random.Random(9).shuffle(order)
    for name, k in enumerate(order):
        pq.write_table(events.slice(k * step, step), tmp_path / "events.parquet" / f"{name:03}.parquet")
    got = sorted((r.user_id, r.event_id) for r in QUERIES["stream_snapshots_equals_batch"](spark, str(tmp_path)).collect())
    assert got == sorted(set(zip(events["user_id"].to_pylist()[: step * 250], events["event_id"].to_pylist()[: step * 250], strict=True)))


def test_numbers_within_groups_equal_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randint(0, 40), i) for i in range(600)] + [(None, 5, 900), ("a", None, 901)]
    df = spark.createDataFrame(rows, "g string, x int, i int")
    got = {r.i: r.n for r in ranking.numbered(df, ["g"], [F.col("x"), F.col("i")], "n").collect()}
    for g in ("a", "b", "c", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    ranks = {(r.g, r.x): r.r for r in ranking.mean_ranks(df.where("g IS NOT NULL AND x IS NOT NULL"), ["g"], {"x": "r"}).collect()}
    for g in "abc":
        xs = sorted(r[1] for r in rows if r[0] == g and r[1] is not None)
        assert all(ranks[g, x] == np.mean([k + 1 for k, y in enumerate(xs) if y == x]) for x in set(xs))


def test_mean_ranks_with_a_hot_value_nulls_and_nan(spark):
    rng = random.Random(2)
    nan = float("nan")
    rows = [(rng.choice(["a", None]), rng.choice([5.0, rng.random() * 9, -0.0, 0.0]), rng.choice([nan, None, float(i), 7.0]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x double, y double, i int").repartition(5)
    got = {r.i: (r.rx, r.ry) for r in ranking.mean_ranks(df, ["g"], {"x": "rx", "y": "ry"}, slices=8).collect()}
    assert len(got) == len(rows)
    for g in ("a", None):
        for at in (1, 2):
            keys = [float("inf") if r[at] != r[at] else r[at] for r in rows if r[0] == g and r[at] is not None]
            for r in rows:
                if r[0] == g:
                    v = float("inf") if r[at] is not None and r[at] != r[at] else r[at]
                    assert got[r[3]][at - 1] == (None if v is None else sum(k < v for k in keys) + (sum(k == v for k in keys) + 1) / 2)


@pytest.mark.parametrize("n", [1, 2, 5, 87, 1000])
def test_quantiles_equal_numpy(spark, n):
    x = np.round(np.random.default_rng(n).normal(size=n), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    shares = [0.0, 0.2, 0.5, 0.77, 1.0]
    assert np.allclose(list(one(ranking.quantiles(df, "x", shares))), np.quantile(x, shares))
    assert list(one(ranking.quantiles(df.where("x > 100"), "x", [0.5]))) == [None]


def test_weighted_sample(spark):
    df = spark.createDataFrame([(i, 5.0 if i < 50 else 0.01 if i < 99 else 0.0) for i in range(100)], "k int, w double")
    got = [r.k for r in sampling.weighted_sample(df, "k", "w", 40).collect()]
    assert len(set(got)) == 40 and sum(k < 50 for k in got) >= 38 and 99 not in got
    assert got == [r.k for r in sampling.weighted_sample(df.repartition(5), "k", "w", 40).collect()]


def test_layouts(spark):
    def made(dataset, paths, **more):
        df = spark.createDataFrame([(p,) for p in paths], "path string")
        return sorted((r.label, r.split, r.compression, r.video, len(r.frames)) for r in manifest.by_layout(df, dataset, **more).collect())

    tested = spark.createDataFrame([("v2",)], "video string")
    celeb = ["/d/Celeb-DF-v1/YouTube-real/frames/v1/0.png", "/d/Celeb-DF-v1/Celeb-synthesis/frames/v2/0.png", "/d/Celeb-DF-v1/Celeb-synthesis/frames/v2/1.png", "/d/Celeb-DF-v1/List.txt"]
    assert made("Celeb-DF-v1", celeb, tested=tested) == [("CelebDFv1_fake", s, None, "v2", 2) for s in ("test", "train", "val")] + [("CelebDFv1_real", "train", None, "v1", 1)]
    splits = spark.createDataFrame([("000", "train"), ("000_003", "test")], "video string, split string")
    ff = [f"/d/FaceForensics++/original_sequences/youtube/{c}/frames/000/1.png" for c in ("c23", "c40")] + ["/d/FaceForensics++/manipulated_sequences/Deepfakes/c23/frames/000_003/1.png"]
    assert made("FaceForensics++", ff, splits=splits) == [("FF-DF", "test", "c23", "000_003", 1), ("FF-real", "train", "c23", "000", 1), ("FF-real", "train", "c40", "000", 1)]
    with pytest.raises(Exception, match="no split for 9"):
        made("FaceForensics++", ["/d/x/manipulated_sequences/FaceSwap/raw/frames/9/1.png"], splits=splits)
    told = spark.createDataFrame([("a", "test", "DFDC_Fake"), ("b", "train", "DFDC_Real")], "video string, split string, label string")
    assert made("DFDC", ["/d/DFDC/test/frames/a/0.png", "/d/DFDC/train/p1/frames/b/0.png"], splits=told) == [("DFDC_Fake", "test", None, "a", 1), ("DFDC_Real", "train", None, "b", 1)]


def test_rows_of_several_files_in_order(spark, tmp_path):
    for name, rows in (("a.csv", range(5)), ("b.csv", range(100, 3000))):  # Spark reads the larger file first
        (tmp_path / name).write_text("image,v\n" + "".join(f"k{i % 3},{i}\n" for i in rows))
    got = readers.keyed_csv(spark, str(tmp_path)).collect()
    assert {r.image: r.v for r in got} == {"k0": "2997", "k1": "2998", "k2": "2999"}
    turned = tmp_path / "turned"
    turned.mkdir()
    (turned / "a.csv").write_text("image,v\n" + "".join(f"k,{i}\n" for i in range(3000)))
    (turned / "b.csv").write_text("image,v\nk,last\n")
    assert one(readers.keyed_csv(spark, str(turned))).v == "last"


def test_texts_are_read_whole(spark, tmp_path):
    (tmp_path / "map.txt").write_text('item {\n  name: "walk"\n  id: 3\n}\nitem {\n  name: "run"\n  label_id: 5\n}\n')
    assert sorted(map(tuple, readers.label_map(spark, str(tmp_path / "map.txt")).collect())) == [(3, "walk"), (5, "run")]
    (tmp_path / "m.json").write_text('{"D":\n {"real": {"train": {"v": {"label": "real", "frames": ["1.png"]}}}}}\n')
    assert one(manifest.videos(readers.manifest_text(spark, str(tmp_path / "m.json")))).video == "v"


def test_polling():
    now, slept, seen, failures = [0.0], [], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    assert snapshots.poll(seen.append, 10, 0, 3, sleep=sleep, clock=lambda: now[0]) == 3 and seen == [1, 2, 3] and slept == [10, 10]
    assert snapshots.poll(seen.append, 0.1, 5, 50, sleep=sleep, clock=lambda: now[0]) == 50 and min(slept) >= 1
    assert snapshots.poll(lambda n: None, 1, stop=lambda: True, sleep=sleep) == 1
    del slept[:]

    def work(x):
        if x == 2:
            raise OSError("refused")

    assert snapshots.throttled(work, [1, 2, 3], 1.0, lambda x, e: failures.append(x), sleep) == 2 and failures == [2] and slept == [1.0] * 3


def test_stream_reads_targets_anew(spark, tmp_path):
    for i in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"posting_id": f"p{k}", "score": float(i)}) for k in range(3)))
    asked = []

    def targets():
        asked.append(1)
        return spark.createDataFrame([(f"p{len(asked) - 1}",)], "posting_id string")

    rows = snapshots.source(spark, str(tmp_path / "in"), SNAPSHOTS, files_per_batch=1)
    snapshots.run_until(snapshots.following(rows, targets, "posting_id", str(tmp_path / "out"), str(tmp_path / "state")))
    got = sorted((r.batch, r.posting_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [p for _, p in got] == ["p0", "p1"] and len({b for b, _ in got}) == 2


def test_hold_out_and_cross_validation_leave_nothing_cached(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3) + 2 * (i % 2)], i % 2) for i in range(200)], "k int, v array<double>, y int")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    r = one(learn.held_out(df, "v", "y", "k"))
    assert 50 <= r.rows <= 70 and r.auc > 0.9
    with pytest.raises(KeyError):
        learn.cross_validated(df, "v", "y", "k", "no such model", 2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_registrable_domains_by_rules(spark):
    rules = spark.createDataFrame([("com",), ("co.uk",), ("uk",), ("*.ck",), ("!www.ck",)], "rule string")
    hosts = {"a.b.com": "b.com", "com": None, "x.co.uk": "x.co.uk", "co.uk": None, "a.x.uk": "x.uk", "a.b.c.ck": "b.c.ck", "c.ck": None, "www.ck": "www.ck", "z.www.ck": "www.ck", "a.example": "a.example", "A.B.COM.": "b.com", None: None}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: r.domain for r in X.registrable_domains(df, rules, "h").collect()} == hosts
