"""More named queries: readers and writers by round trips through the shared folder, text functions, samples, layouts, streams; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import registry, shared
from tidemark.functions import numbers as N
from tidemark.functions import text as X
from tidemark.operators import engagement, keyed, learn, manifest, metrics, posts, quality, risk, sampling, tables, vision
from tidemark.plans import proxies as P
from tidemark.plans.proxies import table, with_
from tidemark.plans.registered import query, rounded
from tidemark.sources import readers, sinks
from tidemark.streaming import snapshots


place = shared.folder


# Writers and readers ---------------------------------------------------------------------------------------------------


@query("csv_round_trip", "SELECT doc_id::VARCHAR AS doc_id, source, lang, '' AS missing FROM documents")
def csv_round_trip(spark, d):
    at = place(spark, "csv")
    sinks.csv(table(spark, d, "documents").select("source", "lang", "doc_id"), at, ["doc_id", "source", "lang", "missing"])
    return readers.csv(spark, at).select("doc_id", "source", "lang", F.coalesce("missing", F.lit("")).alias("missing"))


@query("keyed_csv_last_row", "SELECT user_id::VARCHAR AS image, max(event_id)::VARCHAR AS event FROM events GROUP BY 1")
def keyed_csv(spark, d):
    at = place(spark, "keyed")
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("image"), "event_id")
    for i in (0, 1):  # two files; in each the rows in order, all of the first before those of the second
        cut = F.col("event_id") > rows.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
        sinks.csv(rows.where(cut if i else ~cut).orderBy("event_id").select("image", F.col("event_id").alias("event")).coalesce(1), f"{at}/part={i}")
    return readers.keyed_csv(spark, [f"{at}/part={i}" for i in (0, 1)], "image").select("image", "event")


@query("jsonl_round_trip", with_("posts") + "SELECT posting_id, created_utc, round(score, 6) AS score, num_comments FROM posts")
def jsonl_round_trip(spark, d):
    at = place(spark, "jsonl")
    p = P.posts(spark, d)
    half = F.col("num_comments") % 2 == 0
    sinks.jsonl(p.where(half), at)
    sinks.jsonl(p.where(~half), at, append=True)
    return readers.posts(spark, at).select("posting_id", "created_utc", *rounded("score"), "num_comments")


@query("jsonl_broken_lines", "SELECT page_id::VARCHAR AS posting_id, CASE WHEN page_id % 3 = 1 THEN NULL ELSE page_id::DOUBLE END AS score FROM pages WHERE page_id % 3 < 2")
def jsonl_broken_lines(spark, d):
    """Lines that are no JSON are left out; of a record with a field of another type only the field is."""
    at = place(spark, "broken")
    i = F.col("page_id").cast("string")
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('{"posting_id": "'), i, F.lit('", "score": '), i, F.lit("}"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit('{"posting_id": "'), i, F.lit('", "score": "many"}'))).otherwise(F.concat(F.lit('{"posting_id": '), i, F.lit(", broken")))
    table(spark, d, "pages").select(line.alias("value")).write.text(at)
    return readers.posts(spark, at).select("posting_id", "score")


@query("lines_round_trip", "SELECT source || ' ' || doc_id AS value FROM documents WHERE doc_id % 4 > 0")
def lines_round_trip(spark, d):
    at = place(spark, "lines")
    table(spark, d, "documents").select(F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.concat(F.lit("\t "), F.concat_ws(" ", "source", "doc_id"), F.lit(" 　"))).alias("value")).write.text(at)
    return readers.lines(spark, at)


@query("features_csv", "SELECT vec_id::VARCHAR AS vec_id, (vec_id / 8.0)::DOUBLE AS x, '' AS nothing FROM embeddings")
def features_csv(spark, d):
    """Numbers come back as they were written, as eighths have three decimals."""
    at = place(spark, "features")
    sinks.features_csv(table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") / 8.0).alias("x"), F.lit(None).cast("double").alias("nothing")), at)
    return readers.csv(spark, at).select("vec_id", N.parse_double("x").alias("x"), F.coalesce("nothing", F.lit("")).alias("nothing"))


@query("union_csv", "SELECT doc_id::VARCHAR AS a, source AS b, '' AS c FROM documents UNION ALL SELECT page_id::VARCHAR, '', url FROM pages")
def union_csv(spark, d):
    """A table whose columns are those of all rows."""
    at = place(spark, "union")
    s = lambda c: F.col(c).cast("string")
    sinks.csv(sinks.all_columns([table(spark, d, "documents").select(s("doc_id").alias("a"), F.col("source").alias("b")), table(spark, d, "pages").select(s("page_id").alias("a"), F.col("url").alias("c"))]), at)
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return readers.csv(spark, at).select("a", empty("b"), empty("c"))


@query("csv_appended", "SELECT event_id::VARCHAR AS event_id, CASE WHEN event_id % 3 < 2 THEN user_id::VARCHAR END AS \"user, id\" FROM events")
def csv_appended(spark, d):
    """Appends to one table that any CSV reader takes: the columns are those of the first, in its order, whatever the others have more or less."""
    at = place(spark, "appended")
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("user, id"), "value")
    sinks.csv_append(e.where("event_id % 3 = 0").drop("value"), at)
    sinks.csv_append(e.where("event_id % 3 = 1").select("value", "user, id", "event_id"), at)
    sinks.csv_append(e.where("event_id % 3 = 2").select("event_id"), at)
    return spark.read.csv(at, header=True)


@query("predictions_by_dataset", with_("content") + "SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, image, label, round(content_score, 6) AS prob FROM content")
def predictions_by_dataset(spark, d):
    at = place(spark, "predictions")
    c = P.content(spark, d).select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("dataset"), "image", "label", F.col("content_score").alias("prob"))
    sinks.predictions(c, at)
    return spark.read.option("header", True).schema("image string, label int, prob double, dataset string").csv(at).select("dataset", "image", "label", *rounded("prob"))


@query("json_report", "SELECT count(*) AS rows, max(length(text)) AS longest, NULL::VARCHAR AS nothing FROM documents")
def json_report(spark, d):
    at = place(spark, "report")
    sinks.report(table(spark, d, "documents").agg(F.count(F.lit(1)).alias("rows"), F.max(F.length("text")).alias("longest"), F.lit(None).cast("string").alias("nothing")), at)
    return spark.read.schema("rows long, longest long, nothing string").json(at)


@query("scalars_and_metric_series", with_("series") + "SELECT detector, 'd' || (step % 2) AS dataset, step::INT AS \"Step\", round(value, 6) AS \"Value\" FROM series")
def scalars_and_series(spark, d):
    """Scalars are appended as a table, then written as one file a detector and dataset, whose names tell both."""
    at = place(spark, "scalars")
    s = P.series(spark, d).select(F.col("detector").alias("phase"), F.concat(F.lit("d"), (F.col("step") % 2).cast("string")).alias("dataset"), F.lit("auc").alias("metric"), "step", "value")
    for i in (0, 1):
        sinks.scalars(s.where(F.col("step") % 2 == i), f"{at}/table")
    t = spark.read.parquet(f"{at}/table")
    found = None
    for r in t.select("phase", "dataset").distinct().orderBy("phase", "dataset").collect():  # a file each, as the tools that write them do
        own = t.where((F.col("phase") == r.phase) & (F.col("dataset") == r.dataset)).select(F.col("step").alias("Step"), F.col("value").alias("Value"))
        sinks.csv(own, f"{at}/files/{r.phase}/test_{r.dataset}_auc.csv")
    found = readers.metric_series(spark, f"{at}/files/*/*.csv", folders=True)
    return found.select("detector", "dataset", "Step", *rounded("Value"))


@query("parquet_table", "SELECT vec_id, label FROM embeddings ORDER BY vec_id")
def parquet_table(spark, d):
    """A key-value store as a table, scanned in the order of its keys."""
    at = place(spark, "store")
    sinks.table(table(spark, d, "embeddings").select("vec_id", "label"), at)
    return readers.ordered(spark, at, "vec_id")


@query("manifest_round_trip", with_("frames") + "SELECT video::VARCHAR AS video, CASE WHEN video % 2 = 0 THEN 'real' ELSE 'fake' END AS label, 'train' AS split, array_to_string(frames, ',') AS frames FROM frames")
def manifest_round_trip(spark, d):
    at = place(spark, "manifest")
    v = P.frames(spark, d).select(F.when(F.col("video") % 2 == 0, "real").otherwise("fake").alias("label"), F.lit("train").alias("split"), F.col("video").cast("string").alias("video"), sampling.numeric_order(F.col("frames")).alias("frames"))
    manifest.manifest_json(v, "DS").write.text(at)
    return manifest.videos(readers.manifest_text(spark, at)).select("video", "label", "split", F.array_join("frames", ",").alias("frames"))


@query("file_listing", "SELECT source AS folder, count(DISTINCT lang) AS files FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def file_listing(spark, d):
    """Files below folders, by their extension, without their contents."""
    at = place(spark, "files")
    docs = table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    docs.select("source", "lang").distinct().select("source", "lang", F.lit("x").alias("value")).repartition("source", "lang").write.partitionBy("source", "lang").text(at)
    files = readers.listing(spark, at, extensions=("txt",), second_token=False)
    flat = readers.single_level(spark, f"{at}/*/*", ("txt",)).select("path")
    both = files.select("path").join(flat, "path")
    return both.groupBy(F.regexp_extract("path", "source=([^/]*)", 1).alias("folder")).agg(F.count_distinct(F.regexp_extract("path", "lang=([^/]*)", 1)).alias("files"))


@query("file_list", "SELECT 'Root/' || source || '/' || doc_id AS path FROM documents WHERE source LIKE '%1%'")
def file_list(spark, d):
    at = place(spark, "list")
    key = F.concat(F.lit("Root/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    table(spark, d, "documents").where("source IS NOT NULL").select(key.alias("value")).write.text(at)
    listed = readers.file_list(spark, at, "1")
    return listed.where(F.regexp_extract("path", "(?s)^Root/(.*)/[^/]*$", 1).contains("1"))  # in the folder's name, not only in the file's


@query("boxes_and_labels", "SELECT 'v' || (l_orderkey % 50) || ',' || lpad((l_partkey % 1000)::VARCHAR, 4, '0') AS key, (l_linenumber % 4)::INT AS action_id, 'act' || (l_linenumber % 4) AS name, l_linenumber::DOUBLE AS x1, (l_linenumber + 2)::DOUBLE AS x2, CASE WHEN l_partkey % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM lineitem WHERE l_linenumber % 4 IN (1, 2)")
def boxes_and_labels(spark, d):
    at = place(spark, "boxes")
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("v"), (F.col("l_orderkey") % 50).cast("string")).alias("video"), (F.col("l_partkey") % 1000).alias("ts"), n.alias("x1"), n.alias("y1"), (n + 2).alias("x2"), (n + 2).alias("y2"), (n % 4).alias("action"), F.when(F.col("l_partkey") % 2 == 1, 0.5).alias("score"))
    rows.write.csv(f"{at}/boxes")
    spark.createDataFrame([(f'item {{\n  name: "act{i}"\n  id: {i}\n}}',) for i in range(4)], "value string").coalesce(1).write.text(f"{at}/labels")
    return readers.boxes(spark, f"{at}/boxes", [1, 2]).join(readers.label_map(spark, f"{at}/labels").withColumnRenamed("id", "action_id"), "action_id").select("key", "action_id", "name", "x1", "x2", "score")


@query("blob_store", "SELECT 'source=' || source AS folder, count(DISTINCT lang) AS keys FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def blob_store(spark, d):
    at = place(spark, "blobs")
    docs = table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select("source", "lang").distinct()
    docs.withColumn("value", F.lit("x")).repartition("source", "lang").write.partitionBy("source", "lang").text(at)
    root = at.removeprefix("file://")
    return readers.blobs(spark, at, root).where("length(value) > 0").select(F.split("key", "/")[0].alias("folder"), F.split("key", "/")[1].alias("k")).groupBy("folder").agg(F.count_distinct("k").alias("keys"))


@query("settings_layers", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'test' ELSE 'base' END AS a, CASE WHEN page_id % 2 = 0 THEN 'own' ELSE 'fill' END AS b FROM pages")
def settings_layers(spark, d):
    """Later settings win, missing ones are filled in: once for each of the six cases."""
    cases = []
    for i in range(6):
        s = readers.merged_settings({"a": "base"} | ({"b": "own"} if i % 2 == 0 else {}), {"a": "test"} if i % 3 == 0 else {}, fill_in={"a": "never", "b": "fill"})
        cases.append((i, s["a"], s["b"]))
    p = table(spark, d, "pages").select("page_id", (F.col("page_id") % 6).cast("int").alias("case"))
    return p.join(F.broadcast(spark.createDataFrame(cases, "case int, a string, b string")), "case").select("page_id", "a", "b")


@query("scraped_logs", """WITH h AS (SELECT doc_id, n_chars, max(CASE WHEN doc_id % 3 > 0 THEN 'D' || lpad(doc_id::VARCHAR, 12, '0') END) OVER (ORDER BY doc_id) AS dataset FROM documents)
SELECT dataset, max_by((n_chars % 1000) / 1000.0, doc_id)::DOUBLE AS "AUC", max_by((n_chars % 100) / 100.0, doc_id) FILTER (doc_id % 2 = 0)::DOUBLE AS "ACC" FROM h WHERE dataset IS NOT NULL GROUP BY 1""")
def scraped_logs(spark, d):
    """One large log in many slices: blocks of documents, of which every third has no header of its own, with their lines between."""
    i, n = F.col("doc_id"), F.col("n_chars")
    line = lambda k, text: F.struct((i * 4 + k).alias("position"), text.alias("value"))
    header = F.when(i % 3 > 0, F.concat(F.lit("dataset: D"), F.lpad(i.cast("string"), 12, "0"))).otherwise("no header")
    own = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?i)dataset:|\\b(auc|eer|acc|ap):", " ")
    acc = F.when(i % 2 == 0, F.concat(F.lit("acc: "), (n % 100 / 100).cast("string"))).otherwise("-")
    block = F.array(line(0, header), line(1, F.concat(F.lit("auc: "), (n % 1000 / 1000).cast("string"))), line(2, own), line(3, acc))
    lines = table(spark, d, "documents").select(F.explode(block).alias("l")).select("l.*")
    return tables.scraped_log(lines, case_sensitive=False, slice_lines=500).select("dataset", "AUC", "ACC")


# Filters and checks ----------------------------------------------------------------------------------------------------


@query("scored_posts", with_("posts") + "SELECT posting_id FROM posts WHERE CASE WHEN num_comments > 2 THEN score ELSE 0 END >= 500")
def scored_posts(spark, d):
    p = P.posts(spark, d).withColumn("score", F.when(F.col("num_comments") > 2, F.col("score")))
    return p.where(posts.scored_at_least("score", 500)).select("posting_id")


@query("usable_features", with_("content") + "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 1 ELSE 7 END AS label FROM content WHERE doc_id % 5 > 0")
def usable_features(spark, d):
    i = F.col("doc_id")
    c = P.content(spark, d).select("doc_id", F.when(i % 3 == 0, "x/0_real/fake").when(i % 3 == 1, "y/Fake").otherwise("z").alias("path"), F.lit(7).alias("label"), (i % 5 == 0).alias("failed"))
    return quality.usable_features(c).select("doc_id", F.col("label").cast("int").alias("label"))


@query("numeric_columns", "SELECT unnest(['a', 'c']) AS name")
def numeric_columns(spark, d):
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select(i.cast("string").alias("a"), F.concat(F.lit("x"), i.cast("string")).alias("b"), F.when(i == 0, "1e3").otherwise("None").alias("c"), F.lit("").alias("d"))
    return spark.createDataFrame([(c,) for c in engagement.numeric_columns(docs)], "name string")


@query("sampled_truth", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey % 1000) % 4 = 0 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0)")
def sampled_truth(spark, d):
    """Keys whose second is a multiple of 4, without those that are excluded."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("v,"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 4, "0")).alias("key"))
    out = table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return vision.without_excluded(vision.sampled_truth(li), out, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("known_detectors", "SELECT event_type AS detector, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def known_detectors(spark, d):
    """Detectors that have a configuration and a file of weights; others are skipped."""
    known = spark.createDataFrame([("click", "c.yaml", "c.pth"), ("view", "v.yaml", "v.pth"), ("purchase", "p.yaml", None), ("unused", "u.yaml", "u.pth")], "detector string, config string, weights string")
    e = table(spark, d, "events").withColumnRenamed("event_type", "detector")
    return keyed.with_known(e, known, "detector", ["config", "weights"]).groupBy("detector").agg(F.count(F.lit(1)).alias("n"))


@query("require_classes", "SELECT quality, count(*) AS n FROM labels GROUP BY 1")
def require_classes(spark, d):
    return tables.class_counts(quality.require_classes(table(spark, d, "labels"), "quality"), "quality")


@query("median_threshold", with_("content") + "SELECT round((SELECT median(content_score) FROM content WHERE label = 0), 6) AS threshold, round(avg(((content_score >= (SELECT median(content_score) FROM content WHERE label = 0))::INT = label)::INT), 6) AS acc FROM content")
def median_threshold(spark, d):
    return metrics.median_threshold(P.content(spark, d), "content_score").select(*rounded("threshold", "acc"))


# Projections -----------------------------------------------------------------------------------------------------------


@query("path_forms", "SELECT page_id, 'a/b' || page_id AS clean, 'x/masks/masks_' || page_id || '.png' AS mask, 'x/landmarks/landmarks_' || page_id || '.npy' AS landmark, 'DS' || (page_id % 3) AS dataset FROM pages")
def path_forms(spark, d):
    s = F.col("page_id").cast("string")
    frame = F.concat(F.lit("x/frames/frames_"), s, F.lit(".png"))
    full = F.concat(F.lit("/data/rgb/DS"), (F.col("page_id") % 3).cast("string"), F.lit("//v/"), s)
    return table(spark, d, "pages").select("page_id", X.clean_path(F.concat(F.lit(".\\a\\b"), s)).alias("clean"), X.mask_path(frame).alias("mask"), X.landmark_path(frame).alias("landmark"), X.dataset_name(full, "/data/rgb/").alias("dataset"))


@query("resolved_paths", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/abs/' || page_id WHEN 1 THEN 'datasets/rgb/f/' || page_id ELSE NULL END AS path FROM pages")
def resolved_paths(spark, d):
    """Where a file is: as given if that exists, else below the folder of images, without naming that folder twice."""
    s, m = F.col("page_id").cast("string"), F.col("page_id") % 3
    p = table(spark, d, "pages").select("page_id", F.when(m == 0, F.concat(F.lit("/abs/"), s)).when(F.col("page_id") % 2 == 0, F.concat(F.lit("./datasets/rgb/f/"), s)).otherwise(F.concat(F.lit("f//"), s)).alias("given"))
    there = table(spark, d, "pages").where("page_id % 3 < 2").select(F.when(m == 0, F.concat(F.lit("/abs/"), s)).otherwise(F.concat(F.lit("datasets/rgb/f/"), s)).alias("path"))
    return manifest.resolved_paths(p, there, "given", "datasets/rgb").select("page_id", "path")


@query("display_names", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Zero' WHEN 1 THEN 'One' ELSE 'Two' END AS name FROM pages")
def display_names(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("k"), (F.col("page_id") % 3).cast("string")).alias("name"))
    return keyed.mapped(p, "name", {"k0": "Zero", "k1": "One", "k2": "Two"})


@query("dataset_aliases", "SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'FF_raw' ELSE 'FF' END AS dataset, CASE page_id % 4 WHEN 0 THEN 'c23' WHEN 1 THEN 'c40' END AS compression FROM pages")
def dataset_aliases(spark, d):
    m = F.col("page_id") % 4
    p = table(spark, d, "pages").select("page_id", manifest.without_alias(F.when(m == 0, "FF_c23").when(m == 1, "FF_c40").when(m == 2, "FF").otherwise("FF_raw")).alias("x"))
    return p.select("page_id", "x.dataset", "x.compression")


@query("registrable_domains", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'b.co.uk' WHEN 1 THEN 'b.com' WHEN 2 THEN 'b.c.ck' WHEN 3 THEN 'www.ck' ELSE NULL END AS domain FROM pages")
def registrable_domains(spark, d):
    """By a table of public suffixes, with a wildcard and its exception; a suffix by itself has no such domain."""
    rules = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("*.ck",), ("!www.ck",)], "rule string")
    m = F.col("page_id") % 5
    h = F.when(m == 0, "a.b.co.uk").when(m == 1, "a.b.com").when(m == 2, "a.b.c.ck").when(m == 3, "x.www.ck").otherwise("co.uk")
    return X.registrable_domains(table(spark, d, "pages").select("page_id", h.alias("host")), rules, "host").select("page_id", "domain")


@query("hash_file_frames", "SELECT page_id, 80.0::DOUBLE AS quality, count(*) AS frames FROM pages, range(3) GROUP BY 1")
def hash_file_frames(spark, d):
    h = F.sha2(F.col("url"), 256)
    text = F.concat_ws("\n", *(F.concat(h, F.lit(f" {i}.5 80")) for i in range(3)), F.lit("no hash 1"))
    p = table(spark, d, "pages").select("page_id", F.explode(X.hash_lines(text)).alias("f"))
    return p.groupBy("page_id").agg(F.max("f.quality").alias("quality"), F.count(F.lit(1)).alias("frames"))


@query("mask_of_stem", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'm/' || page_id || '.png' END AS mask FROM pages")
def mask_of_stem(spark, d):
    s = F.col("page_id").cast("string")
    items = table(spark, d, "pages").select("page_id", F.concat(F.lit("v/"), s, F.lit(".mp4")).alias("path"))
    found = table(spark, d, "pages").where("page_id % 2 = 0").select(F.explode(F.array(F.concat(F.lit("m/"), s, F.lit(".png")), F.concat(F.lit("n/"), s, F.lit(".png")))).alias("path"))
    return manifest.masks(items, found).select("page_id", "mask")


@query("positional_zip", with_("content") + "SELECT image, label, round(content_score, 6) AS prob FROM content")
def positional_zip(spark, d):
    """Images, labels and scores as three lists, brought together by their positions."""
    c = P.content(spark, d).withColumnRenamed("doc_id", "position")
    return tables.zipped([c.select("position", "image"), c.select("position", "label"), c.select("position", F.col("content_score").alias("prob"))], "position").select("image", "label", *rounded("prob"))


@query("scatter_points", with_("content", "provenance", "propagation") + "SELECT image, round(content_score, 6) AS x, round(cred_score, 6) AS y, label FROM content JOIN provenance USING (image) JOIN propagation USING (image)")
def scatter_points(spark, d):
    return risk.scatter_points(P.propagation(spark, d), P.content(spark, d), P.provenance(spark, d)).select("image", *rounded("x", "y"), "label")


# Tables and samples ----------------------------------------------------------------------------------------------------


@query("mean_by_frames", with_("series") + "SELECT (step % 5 * 8)::INT AS frames, round(avg(value), 6) AS mean FROM series GROUP BY 1")
def mean_by_frames(spark, d):
    s = P.series(spark, d).select(F.concat(F.lit("a/xception_"), (F.col("step") % 5 * 8).cast("string"), F.lit("frames.csv")).alias("path"), F.col("value").alias("Value"))
    return tables.mean_by_frames(s).select("frames", *rounded("mean"))


@query("category_order", "SELECT event_type, row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END, event_type) AS place FROM (SELECT DISTINCT event_type FROM events)")
def category_order(spark, d):
    return tables.places(table(spark, d, "events"), "event_type", ["view", "purchase"])


@query("balanced_weights", "SELECT doc_id, round(1.0 / count(*) OVER (PARTITION BY quality), 9) AS weight FROM labels")
def balanced_weights(spark, d):
    return sampling.balanced_weights(table(spark, d, "labels"), "quality").select("doc_id", *rounded("weight", digits=9))


_U = "(('0x' || substr(md5('5:' || doc_id), 1, 12))::UBIGINT + 1) / 281474976710657.0"


@query("weighted_sample", f"WITH w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY quality) AS weight FROM labels) SELECT doc_id FROM w ORDER BY -ln({_U}::DOUBLE) / weight, doc_id LIMIT 40")
def weighted_sample(spark, d):
    return sampling.weighted_sample(sampling.balanced_weights(table(spark, d, "labels"), "quality"), "doc_id", "weight", 40, 5).select("doc_id")


@query("js_divergence", "WITH s AS (SELECT vec_id, (vec_id % 7 + 1) / 10.0::DOUBLE AS a, (vec_id % 5 + 2) / 10.0::DOUBLE AS b FROM embeddings), m AS (SELECT *, (a + b) / 2 AS m1, 1 - (a + b) / 2 AS m2 FROM s) SELECT vec_id, round((m1 * (ln(m1) - ln(a)) + m2 * (ln(m2) - ln(1 - a)) + m1 * (ln(m1) - ln(b)) + m2 * (ln(m2) - ln(1 - b))) / 2, 6) AS js FROM m")
def js_divergence(spark, d):
    a, b = (F.col("vec_id") % 7 + 1) / 10.0, (F.col("vec_id") % 5 + 2) / 10.0
    return table(spark, d, "embeddings").select("vec_id", F.round(N.js_divergence(F.array(a, 1 - a), F.array(b, 1 - b)), 6).alias("js"))


@query("small_text_functions", "SELECT page_id, (page_id / 4.0)::DOUBLE AS number, lower(sha256(url)) AS hash, 'CN=' || page_id || '; C=x' AS name, page_id::VARCHAR AS server, 'last' || page_id AS event FROM pages")
def small_text_functions(spark, d):
    """Numbers without trailing zeros, hashes within text, distinguished names, headers in any case, maps in which the last entry wins."""
    s, h = F.col("page_id").cast("string"), F.sha2(F.col("url"), 256)
    names = F.when(F.col("page_id") % 3 == 0, "server").when(F.col("page_id") % 3 == 1, "Server").otherwise("SERVER")
    events = F.array(F.struct(F.lit("registration").alias("key"), F.lit("first").alias("value")), F.struct(F.lit("registration").alias("key"), F.concat(F.lit("last"), s).alias("value")))
    return table(spark, d, "pages").select(
        "page_id", N.parse_double(X.fixed6(F.col("page_id") / 4.0)).alias("number"), X.hash256(F.concat(F.lit("hash "), F.upper(h), F.lit(" 3.5"))).alias("hash"),
        X.distinguished_name(s, F.lit(""), F.lit("x")).alias("name"), X.header(F.create_map(names, s), "SERVER").alias("server"), X.last_wins_map(events)["registration"].alias("event"),
    )


@query("provenance_reports", "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'tool' || page_id END AS claim_generator, CASE WHEN page_id % 3 < 2 THEN 2 END AS assertions_count, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS valid FROM pages")
def provenance_reports(spark, d):
    i, m = F.col("page_id").cast("string"), F.col("page_id") % 3
    good = F.concat(F.lit('{"manifests": [{"claimGenerator": "tool'), i, F.lit('", "assertions": [{"a": 1}, 2]}], "verification": {"overall": "'), F.when(m == 0, "VALID").otherwise("BAD"), F.lit('"}}'))
    r = table(spark, d, "pages").select("page_id", X.provenance_report(F.when(m < 2, good).otherwise(F.concat(F.lit("[1, "), i, F.lit("]")))).alias("r"))
    return r.select("page_id", "r.claim_generator", "r.assertions_count", "r.valid")


@query("probe_grid", "SELECT vec_id, noise, strength FROM embeddings, (SELECT unnest(['gauss', 'blur']) AS noise), (SELECT unnest([0.2, 0.4, 0.6])::DOUBLE AS strength)")
def probe_grid(spark, d):
    return vision.probe_grid(table(spark, d, "embeddings").select("vec_id"), ["gauss", "blur"], [0.2, 0.4, 0.6])


@query("image_formats", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'pickle' ELSE 'unknown' END AS format FROM pages")
def image_formats(spark, d):
    m = F.col("page_id") % 4
    head = F.when(m == 0, "FFD8FFE000").when(m == 1, "89504E470D0A1A0A00").when(m == 2, "8004952A").otherwise("00112233")
    return table(spark, d, "pages").select("page_id", X.image_format(F.unhex(F.concat(head, F.hex("url")))).alias("format"))


_LAYOUT = "SELECT 'Fake' AS l UNION ALL SELECT 'Real'"


@query("layout_manifest", "SELECT CASE WHEN conv_id % 2 = 0 THEN 'UADFV_Real' ELSE 'UADFV_Fake' END AS label, split, conv_id::VARCHAR AS video, count(DISTINCT turn) AS frames FROM conversations, (SELECT unnest(['train', 'val', 'test']) AS split) GROUP BY 1, 2, 3")
def layout_manifest(spark, d):
    """Frame paths to a manifest by the rules of a dataset's folders."""
    c = table(spark, d, "conversations").select(F.concat(F.lit("/d/UADFV/"), F.when(F.col("conv_id") % 2 == 0, "real").otherwise("fake"), F.lit("/frames/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".png")).alias("path")).distinct()
    return manifest.by_layout(c, "UADFV").select("label", "split", "video", F.size("frames").cast("long").alias("frames"))


@query("layout_with_split_list", "SELECT CASE WHEN conv_id % 2 = 0 THEN 'CelebDFv2_real' ELSE 'CelebDFv2_fake' END AS label, s AS split, conv_id::VARCHAR AS video FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT unnest(['train', 'val', 'test']) AS s) WHERE s = 'train' OR conv_id % 3 = 0")
def layout_with_split_list(spark, d):
    """All videos train; those in the list of test videos are in val and test, too."""
    v = table(spark, d, "conversations").select("conv_id").distinct()
    folder = F.when(F.col("conv_id") % 2 == 0, "Celeb-real").otherwise("Celeb-synthesis")
    s = F.col("conv_id").cast("string")
    paths = v.select(F.concat(F.lit("/d/Celeb-DF-v2/"), folder, F.lit("/frames/"), s, F.lit("/0.png")).alias("path"))
    listed = v.where("conv_id % 3 = 0").select(s.alias("video"))
    return manifest.by_layout(paths, "Celeb-DF-v2", tested=listed).select("label", "split", "video")


# Correlation, validation, plugins, streams ------------------------------------------------------------------------------


@query("best_propagation_feature", with_("posts").rstrip() + """,
l AS (SELECT f.feature, f.x, m.metric AS detector_metric, m.y FROM posts, LATERAL (SELECT unnest(['age_hours', 'engagement_total', 'score']) AS feature, unnest([created_utc / 3600, score + num_comments, score]) AS x) f, LATERAL (SELECT unnest(['upvote_ratio', 'num_comments']) AS metric, unnest([upvote_ratio, num_comments]) AS y) m),
k AS (SELECT *, rank() OVER (PARTITION BY feature, detector_metric ORDER BY x) + (count(*) OVER (PARTITION BY feature, detector_metric, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature, detector_metric ORDER BY y) + (count(*) OVER (PARTITION BY feature, detector_metric, y) - 1) / 2 AS ry FROM l)
SELECT feature, detector_metric, round(corr(rx, ry), 6) AS spearman_r FROM k WHERE feature LIKE 'age\\_hours%' ESCAPE '\\' OR feature LIKE 'engagement%' GROUP BY 1, 2 ORDER BY abs(corr(rx, ry)) DESC, abs(corr(x, y)) DESC, 1, 2 LIMIT 1""")
def best_propagation_feature(spark, d):
    """Of the features whose names begin as those of propagation, the one that goes with a metric best."""
    f = P.posts(spark, d).withColumn("age_hours", F.col("created_utc") / 3600).withColumn("engagement_total", F.col("score") + F.col("num_comments"))
    return engagement.best_propagation_feature(engagement.correlations(f, ["age_hours", "engagement_total", "score"], ["upvote_ratio", "num_comments"])).select("feature", "detector_metric", *rounded("spearman_r"))


@query("plugins_by_name", with_("content", "provenance", "propagation", "assembled", "risk") + "SELECT image, CASE WHEN raw > 0.7 THEN 'limit' WHEN raw > 0.6 THEN 'label' ELSE 'none' END AS policy FROM risk")
def plugins_by_name(spark, d):
    """Stages looked up by their names; settings that a plugin doesn't take are left out."""
    rows = registry.apply("aggregator", "p2p_sigmoid", risk.assembled(P.content(spark, d), P.provenance(spark, d), P.propagation(spark, d)), alpha=0.33)
    return registry.apply("policy", "simple_threshold", rows, hi=0.7, nothing=1).select("image", "policy")


@query("stream_each_batch", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_each_batch(spark, d):
    """Each batch of a stream is handled by a function; a batch that comes again takes the place of its first results."""
    at = place(spark, "batches")
    rows = snapshots.source(spark, f"{d}/events.parquet*", table(spark, d, "events").schema, "parquet", 1)

    def work(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    snapshots.run_until(snapshots.each_batch(rows, work, f"{at}/state"))
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("stream_following_targets", "SELECT user_id, event_id FROM events WHERE user_id % 2 = 0")
def stream_following_targets(spark, d):
    """Rows of tracked keys; the list of targets is read anew for each batch."""
    at = place(spark, "following")
    table(spark, d, "events").select("user_id").distinct().where("user_id % 2 = 0").write.parquet(f"{at}/targets")
    rows = snapshots.source(spark, f"{d}/events.parquet*", table(spark, d, "events").schema, "parquet", 1)
    snapshots.run_until(snapshots.following(rows, lambda: spark.read.parquet(f"{at}/targets"), "user_id", f"{at}/out", f"{at}/state"))
    return spark.read.parquet(f"{at}/out").select("user_id", "event_id")


@query("held_out_classifier")
def held_out_classifier(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.element_at("embedding", 1) > 0).cast("int").alias("y"))
    return learn.held_out(e, "v", "y", "vec_id", "logistic")
