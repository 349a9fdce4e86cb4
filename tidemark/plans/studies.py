"""Named queries of spreads over graphs, machines on random features, keyed stream state, ordered stores, data of charts and split lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import shared
from tidemark.operators import charts, learn, manifest, metrics, risk, simulate
from tidemark.plans import proxies as P
from tidemark.plans.proxies import table, with_
from tidemark.plans.registered import query, rounded
from tidemark.sources import ordered
from tidemark.streaming import keyed, polling, snapshots

# Spreads over a graph -------------------------------------------------------------------------------------------------

_NODES = "e0 AS (SELECT 'p' || l_partkey AS u, 's' || l_suppkey AS v FROM lineitem), e AS MATERIALIZED (SELECT u, v FROM e0 UNION SELECT v, u FROM e0), nodes AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY md5(node), node) AS number FROM (SELECT DISTINCT u AS node FROM e))"


def _uniform(*names: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{simulate.SEED}', {', '.join(names)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


def _spread_sql(steps: int, chance: str) -> str:
    """The rounds as a chain of tables, draws by md5 as in the plan."""
    noise = ", ".join(_uniform("image", f"'noise{i}'") for i in range(6))
    parts = [
        _NODES,
        f"items AS (SELECT c.image, max(content_score) AS cs, max(coalesce(cred_score, 0.5)) AS cr, (list_sort([{noise}]))[2] AS noise FROM content c LEFT JOIN provenance USING (image) GROUP BY c.image)",
        f"r0 AS MATERIALIZED (SELECT image, n.node AS start, n.node, least(greatest({chance}, 0.0), 1.0) AS p FROM items JOIN nodes n ON n.number = floor({_uniform('image', repr('start'))} * (SELECT count(*) FROM nodes)) + 1)",
    ]
    for k in range(steps):
        parts.append(f"t{k} AS (SELECT image, start, v AS node, p, count(*) AS tries FROM r{k} JOIN e ON e.u = r{k}.node GROUP BY ALL)")
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT * FROM r{k} UNION ALL SELECT image, start, t.node, p FROM t{k} t JOIN nodes ON nodes.node = t.node WHERE (image, t.node) NOT IN (SELECT image, node FROM r{k}) AND {_uniform('image', repr(str(k)), 'nodes.number')} < 1 - pow(1 - p, tries))")
    return with_("content", "provenance").rstrip() + ",\n" + ",\n".join(parts) + f"\nSELECT image, start, count(*) AS reached, round(count(*) / (SELECT count(*) FROM nodes)::DOUBLE, 9) AS early_risk FROM r{steps} GROUP BY 1, 2"


def _graph(spark, d):
    """Parts and their suppliers."""
    return table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("u"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("v"))


def _spread(spark, d, **settings):
    return simulate.spread(risk.with_provenance(P.content(spark, d), P.provenance(spark, d)), _graph(spark, d), **settings).select("image", "start", "reached", *rounded("early_risk", digits=9))


@query("spread_over_edges", _spread_sql(simulate.STEPS, f"{simulate.BASE}::DOUBLE + {simulate.COEFFICIENT}::DOUBLE * cs * (1 - cr) + {simulate.NOISE}::DOUBLE * noise"))
def spread_over_edges(spark, d):
    """Items spread over a graph that is a table, from a drawn start, by the chances of their scores."""
    return _spread(spark, d)


@query("spread_certain", with_("content", "provenance").rstrip() + f""",
{_NODES}, items AS (SELECT DISTINCT image FROM content), s AS (SELECT image, node AS start FROM items JOIN nodes ON number = floor({_uniform('image', repr('start'))} * (SELECT count(*) FROM nodes)) + 1),
one AS (SELECT u AS a, v AS b FROM e UNION SELECT node, node FROM nodes), balls AS (SELECT start, x.b AS node FROM (SELECT DISTINCT start FROM s) JOIN one w ON w.a = start JOIN one x ON x.a = w.b GROUP BY 1, 2)
SELECT image, start, count(*) AS reached, round(count(*) / (SELECT count(*) FROM nodes)::DOUBLE, 9) AS early_risk FROM s JOIN balls USING (start) GROUP BY 1, 2""")
def spread_certain(spark, d):
    """A certain spread of two rounds reaches the ball of two steps around the drawn start."""
    return _spread(spark, d, base=1.0, steps=2)


# Keyed state over polled snapshots ------------------------------------------------------------------------------------

_CYCLES = 8


def _snapshots(spark, d):
    """events as recorded by _CYCLES polls, in order."""
    events = table(spark, d, "events")
    each = F.ceil(F.count(F.lit(1)) / _CYCLES).alias("each")
    return events.crossJoin(F.broadcast(events.agg(each))).select("event_id", "user_id", "ts", F.col("value").cast("double").alias("value"), F.floor(F.col("event_id") / F.col("each")).alias("cycle"))


def _polled(spark, d, name, work):
    """What a stream over the recorded polls appends: stopped after a few cycles and started again from its checkpoint."""
    at = shared.folder(spark, name)
    for iterations in (3, _CYCLES + 1):
        polls = polling.cycles(spark, iterations)
        rows = work(polling.recorded(polls, _snapshots(spark, d)))
        stream = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").trigger(processingTime="0 seconds").start()
        try:
            stream.processAllAvailable()  # the source has no more after its iterations
        finally:
            stream.stop()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


@query("polled_snapshots", "SELECT event_id, user_id, least(event_id // ((SELECT ceil(count(*) / 8.0) FROM events)::BIGINT), 8) AS cycle FROM events WHERE event_id // ((SELECT ceil(count(*) / 8.0) FROM events)::BIGINT) <= 8")
def polled_snapshots(spark, d):
    """Polls as a stream that ends at its limit of cycles, over a stop and a start anew."""
    return _polled(spark, d, "polled", lambda rows: rows.select("event_id", "user_id", "cycle"))


@query("stream_early_stop", """WITH RECURSIVE d AS (SELECT user_id, event_id, value::DOUBLE AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, value AS best, 0 AS counter, false AS stop FROM d WHERE i = 1
  UNION ALL SELECT d.user_id, d.event_id, d.i, CASE WHEN d.value < w.best - 0.001 THEN w.best ELSE d.value END, CASE WHEN d.value < w.best - 0.001 THEN w.counter + 1 ELSE 0 END, w.stop OR (d.value < w.best - 0.001 AND w.counter + 1 >= 5) FROM w JOIN d ON d.user_id = w.user_id AND d.i = w.i + 1)
SELECT user_id, event_id, round(best, 6) AS best, counter::INT AS counter, stop FROM w""")
def stream_early_stop(spark, d):
    """Early stopping of each user's series over many micro-batches, three values of state a series."""
    return _polled(spark, d, "early", lambda rows: keyed.early_stop(rows.select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")).select("user_id", "event_id", *rounded("best"), "counter", "stop")


@query("stream_first_within", """WITH RECURSIVE d AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, ts, i, ts AS last_, true AS given FROM d WHERE i = 1
  UNION ALL SELECT d.user_id, d.event_id, d.ts, d.i, CASE WHEN epoch_ms(d.ts) >= epoch_ms(w.last_) + 21600000 THEN d.ts ELSE w.last_ END, epoch_ms(d.ts) >= epoch_ms(w.last_) + 21600000 FROM w JOIN d ON d.user_id = w.user_id AND d.i = w.i + 1)
SELECT user_id, event_id FROM w WHERE given""")
def stream_first_within(spark, d):
    """A user's event at most every six hours of event time; what is older than that isn't kept."""
    return _polled(spark, d, "within", lambda rows: keyed.first_within(snapshots.with_event_time(rows, "ts").select("user_id", "event_id", "at"), ["user_id"], "at", 21_600, "1 minute")).select("user_id", "event_id")


# Machines on random features ------------------------------------------------------------------------------------------


def _curved(spark, d):
    """vec_id, q (means of the four quarters of each vector), y: whether it is far from the middle, which no linear boundary tells."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.array(*(F.slice("embedding", 16 * i + 1, 16) for i in range(4))), lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / 16).alias("q"))
    far = F.aggregate(F.transform("q", lambda x: x * x), F.lit(0.0), lambda s, v: s + v)
    middle = e.select(far.alias("far")).agg(F.expr("percentile_approx(far, 0.5)").alias("middle"))
    return e.withColumn("far", far).crossJoin(F.broadcast(middle)).select("vec_id", "q", (F.col("far") > F.col("middle")).cast("int").alias("y"))


@query("rbf_machine_nested")
def rbf_machine_nested(spark, d):
    """AUC, accuracy and calibration error of grid-searched machines with a Gaussian kernel, of rows that none of them was trained on."""
    scored = learn.nested(_curved(spark, d), "q", "y", "vec_id", [0.1, 0.5], [0.01], 2, 96)
    auc = metrics.summary(metrics.curve(scored.select("label", "prob"))).select("auc")
    rest = scored.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("acc"))
    return auc.crossJoin(F.broadcast(rest)).crossJoin(F.broadcast(learn.calibration_error(scored)))


@query("one_class_machine")
def one_class_machine(spark, d):
    """AUC of a one-class machine, accuracy at the median score of label 0, and the share of label 0 beyond the machine's own boundary."""
    scored = learn.one_class(_curved(spark, d), "q", "y", "vec_id", nu=0.1)
    auc = metrics.summary(metrics.curve(scored.select("label", F.col("score").alias("prob")))).select("auc")
    beyond = scored.where("label = 0").agg(F.avg((F.col("score") > 0).cast("double")).alias("beyond"))
    return auc.crossJoin(F.broadcast(metrics.median_threshold(scored, "score"))).crossJoin(F.broadcast(beyond))


# Ordered stores -------------------------------------------------------------------------------------------------------

_KEYED = "SELECT 'Root/' || coalesce(source, '') || '/' || lpad(doc_id::VARCHAR, 12, '0') AS key, n_chars FROM documents"


def _store(spark, d):
    at = shared.folder(spark, "ordered")
    key = F.concat(F.lit("Root/"), F.coalesce("source", F.lit("")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    ordered.put(table(spark, d, "documents").select(key.alias("key"), "n_chars"), "key", at)
    return at


@query("store_cursor", f"SELECT key, n_chars, row_number() OVER (ORDER BY key) AS place FROM ({_KEYED})")
def store_cursor(spark, d):
    """A scan of a key-value store in the order of its keys, which each row's place proves."""
    return ordered.cursor(spark, _store(spark, d), "key")


@query("store_prefix", f"SELECT key, n_chars FROM ({_KEYED}) WHERE starts_with(key, 'Root/src1')")
def store_prefix(spark, d):
    """Keys with a prefix, from the files that may have any."""
    return ordered.with_prefix(spark, _store(spark, d), "key", "Root/src1")


# Data of charts -------------------------------------------------------------------------------------------------------


@query("chart_bars", with_("series").rstrip() + """,
m AS (SELECT dataset, detector, avg(value) AS v FROM series WHERE value IS NOT NULL GROUP BY 1, 2),
g AS (SELECT dataset, row_number() OVER (ORDER BY dataset) AS g FROM (SELECT DISTINCT dataset FROM m)), s AS (SELECT detector, row_number() OVER (ORDER BY detector) AS s, count(*) OVER () AS n FROM (SELECT DISTINCT detector FROM m))
SELECT dataset, detector, round(v, 6) AS value, round(g + (s - (n + 1) / 2) * 0.8::DOUBLE / n, 6) AS at, round(0.8::DOUBLE / n, 6) AS width FROM m JOIN g USING (dataset) JOIN s USING (detector)""")
def chart_bars(spark, d):
    """Mean value of each detector, side by side for each dataset."""
    return charts.bars(P.series(spark, d), "dataset", "detector", "value").select("dataset", "detector", *rounded("value", "at", "width"))


@query("chart_radar", with_("series").rstrip() + """,
m AS (SELECT dataset, detector, avg(value) AS v FROM series WHERE value IS NOT NULL GROUP BY 1, 2), c AS (SELECT dataset, row_number() OVER (ORDER BY dataset) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT dataset FROM m)),
p AS (SELECT detector, dataset, v, i AS point, n FROM m JOIN c USING (dataset) UNION ALL SELECT detector, dataset, v, n + 1, n FROM m JOIN c USING (dataset) WHERE i = 1),
k AS (SELECT detector, dataset, point, 2 * pi() * (point - 1) / n AS angle, v FROM p)
SELECT detector, dataset, point, round(angle, 6) AS angle, CASE WHEN abs(v * cos(angle)) < 5e-7 THEN 0 ELSE round(v * cos(angle), 6) END AS x, CASE WHEN abs(v * sin(angle)) < 5e-7 THEN 0 ELSE round(v * sin(angle), 6) END AS y FROM k""")
def chart_radar(spark, d):
    """A closed line for each detector over the datasets as axes."""
    return charts.radar(P.series(spark, d), "detector", "dataset", "value").select("detector", "dataset", "point", *rounded("angle", "x", "y"))


@query("chart_heatmap", with_("series").rstrip() + """,
m AS (SELECT dataset, detector, avg(value) AS v FROM series WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT detector, dataset, dense_rank() OVER (ORDER BY detector) AS i, dense_rank() OVER (ORDER BY dataset) AS j, round(v, 6) AS value, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS shade FROM m""")
def chart_heatmap(spark, d):
    """Cells of detectors by datasets with their places and shades."""
    return charts.heatmap(P.series(spark, d), "detector", "dataset", "value").select("detector", "dataset", "i", "j", *rounded("value", "shade"))


@query("chart_plane")
def chart_plane(spark, d):
    """A layout in the plane of a sample of the vectors, neighbours beside each other."""
    return charts.plane(table(spark, d, "embeddings"), "vec_id", "embedding")


# Folders with lists of splits -----------------------------------------------------------------------------------------

_SPLIT = "CASE WHEN doc_id % 7 < 4 THEN 'train' WHEN doc_id % 7 < 6 THEN 'val' ELSE 'test' END"
_FOLDERS = ["original_sequences/youtube", "manipulated_sequences/Deepfakes", "manipulated_sequences/Face2Face", "manipulated_sequences/FaceSwap", "manipulated_sequences/NeuralTextures"]


@query("layout_compressed", f"""SELECT label, split, compression, doc_id::VARCHAR AS video, frames FROM (SELECT doc_id, {_SPLIT} AS own, doc_id % 10 = 0 AS unlisted, 1 + coalesce(n_chars, 0) % 3 AS frames,
  CASE doc_id % 5 WHEN 0 THEN 'FF-real' WHEN 1 THEN 'FF-DF' WHEN 2 THEN 'FF-F2F' WHEN 3 THEN 'FF-FS' ELSE 'FF-NT' END AS label, CASE doc_id % 3 WHEN 0 THEN 'c23' WHEN 1 THEN 'c40' ELSE 'raw' END AS compression FROM documents)
JOIN (SELECT unnest(['train', 'val', 'test']) AS split) ON unlisted OR split = own""")
def layout_compressed(spark, d):
    """Frames below folders of a manipulation and a compression, with a list of splits; real videos that it leaves out are in all of them."""
    docs = table(spark, d, "documents")
    at = lambda names, n: F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % n).cast("int"))
    video = F.col("doc_id").cast("string")
    frame = F.explode(F.sequence(F.lit(1), (1 + F.coalesce("n_chars", F.lit(0)) % 3).cast("int")))
    paths = docs.select(at(_FOLDERS, 5).alias("f"), at(["c23", "c40", "raw"], 3).alias("c"), video.alias("v"), frame.alias("i")).select(F.concat_ws("/", F.lit("/d/FaceForensics++"), "f", "c", F.lit("frames"), "v", F.concat(F.col("i").cast("string"), F.lit(".png"))).alias("path"))
    splits = docs.where("doc_id % 10 <> 0").select(video.alias("video"), F.expr(_SPLIT).alias("split"))
    return manifest.by_layout(paths, "FaceForensics++", splits=splits).select("label", "split", "compression", "video", F.size("frames").cast("long").alias("frames"))


@query("layout_labels_listed", f"SELECT CASE WHEN toxic = 1 THEN 'DFDC_Fake' ELSE 'DFDC_Real' END AS label, {_SPLIT} AS split, doc_id::VARCHAR AS video FROM (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1)")
def layout_labels_listed(spark, d):
    """Folders that don't tell the label, which the list of splits does."""
    rows = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    video = F.col("doc_id").cast("string")
    paths = rows.select(F.concat(F.lit("/d/DFDC/test/frames/"), video, F.lit("/0.png")).alias("path"))
    splits = rows.select(video.alias("video"), F.expr(_SPLIT).alias("split"), F.when(F.col("toxic") == 1, "DFDC_Fake").otherwise("DFDC_Real").alias("label"))
    return manifest.by_layout(paths, "DFDC", splits=splits).select("label", "split", "video")
