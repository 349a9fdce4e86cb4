"""Neighbour index, spreads over edges, machines on random features, keyed stream state, ordered stores, expressions: traps and brute force."""

import glob
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions.stats import student_two_sided, two_sided
from tidemark.operators import charts, engagement, learn, metrics, neighbours, ranking, series, simulate, tables
from tidemark.shared import Tables
from tidemark.sources import ordered, sinks
from tidemark.streaming import keyed, polling


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "id long, v array<double>")


def brute_neighbours(x, k):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return {i: np.lexsort((np.arange(len(x)), d[i]))[:k].tolist() for i in range(len(x))}


def lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r.key, []).append(r.neighbour)
    return out


def test_neighbours_with_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 16)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(80, 3)), np.ones((40, 3)), rng.integers(0, 2, (60, 3))])
    assert lists(neighbours.nearest(vectors(spark, x), "id", "v", 5).collect()) == brute_neighbours(x, 5)
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [3.0, 4.0]), (None, [0.0, 0.0])], "id long, v array<double>")
    assert [(r.key, r.neighbour, r.distance) for r in neighbours.nearest(odd, "id", "v", 3).orderBy("key").collect()] == [(1, 7, 5.0), (7, 1, 5.0)]
    assert neighbours.nearest(odd.limit(0), "id", "v", 3).count() == 0
    assert [(r.neighbour, r["rank"]) for r in neighbours.nearest(odd, "id", "v", 2, include_self=True).where("key = 1").orderBy("rank").collect()] == [(1, 1), (7, 2)]


def test_neighbours_take_fewer_distances_than_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 64)
    rng = np.random.default_rng(2)
    share = []
    for n in (500, 4000):
        centres = rng.normal(size=(40, 5)) * 20
        got = neighbours.nearest(vectors(spark, centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 5))), "id", "v", 5)
        share.append(got.select("key", "compared").distinct().agg(F.sum("compared")).first()[0] / n**2)
    assert share[1] < share[0] / 2 and share[1] < 0.25


def test_neighbours_send_a_vector_once_a_group_not_once_a_visit(spark, monkeypatch):
    rows = {}

    class Counted(neighbours.Tables):
        def stored(self, df, name):
            table = super().stored(df, name)
            rows[name] = table.count()
            return table

    monkeypatch.setattr(neighbours, "Tables", Counted)
    x = np.random.default_rng(4).normal(size=(600, 32))  # nothing to skip
    assert lists(neighbours.nearest(vectors(spark, x), "id", "v", 3).collect()) == brute_neighbours(x, 3)
    assert rows["visits"] <= 600 and rows["answers"] <= 600 * 4


def test_neighbours_where_single_precision_is_too_coarse(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for name, value in (("TILE", 16), ("VISITS", 40), ("SHARE", 30), ("BLOCK", 256)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    far = 1e6 * rng.integers(0, 3, (90, 4)) + rng.normal(size=(90, 4)) * 1e-3
    x = np.concatenate([far, far[:20], rng.normal(size=(30, 4)) * 1e-30, np.full((12, 4), 1e200) * rng.integers(1, 3, (12, 1))])
    with np.errstate(over="ignore"):
        assert lists(neighbours.nearest(vectors(spark, x), "id", "v", 4).collect()) == brute_neighbours(x, 4)


def draw(*names):
    return int(hashlib.md5(":".join(map(str, names)).encode()).hexdigest()[:13], 16) / (1 << 52)


def test_spread_equals_brute_force(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)] + [("n1", "n1"), (None, "n2"), ("n1", "n2"), ("n2", "n1")]
    near = {}
    for u, v in edges:
        if u and v and u != v:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)
    number = {x: i + 1 for i, x in enumerate(sorted(near, key=lambda x: hashlib.md5(x.encode()).hexdigest()))}
    by_number = {i: x for x, i in number.items()}
    items = [(f"i{i}", rng.random(), rng.random() if i % 4 else None) for i in range(30)]
    want = {}
    for image, content, cred in items:
        noise = sorted(draw(7, image, f"noise{i}") for i in range(6))[1]
        p = min(1, 0.1 + 0.3 * content * (1 - (0.5 if cred is None else cred)) + 0.15 * noise)
        start = by_number[int(draw(7, image, "start") * len(number)) + 1]
        reached = {start}
        for k in range(3):
            reached |= {v for v in near if v not in reached and (tries := len(near[v] & reached)) and draw(7, image, k, number[v]) < 1 - (1 - p) ** tries}
        want[image] = (start, len(reached), len(reached) / len(number))
    df = spark.createDataFrame(items, "image string, content_score double, cred_score double")
    graph = spark.createDataFrame(edges, "u string, v string")
    assert {r.image: (r.start, r.reached, r.early_risk) for r in simulate.spread(df, graph, 3, 0.1, seed=7).collect()} == want
    assert simulate.spread(df, graph.limit(0), 2).count() == 0


def test_spread_within_packed_components_equals_spread_by_joins(spark, monkeypatch):
    monkeypatch.setattr(simulate, "POOL", 40)
    monkeypatch.setattr(simulate, "SHARE", 8)
    rng = random.Random(5)
    edges = [(f"c{c}n{rng.randrange(12)}", f"c{c}n{rng.randrange(12)}") for c in range(6) for _ in range(9 + 6 * c)] + [(f"chain{i}", f"chain{i + 1}") for i in range(40)]
    graph = spark.createDataFrame(edges, "u string, v string")
    df = spark.createDataFrame([(f"é{i}" * (1 + i % 30), rng.random(), rng.random()) for i in range(120)], "image string, content_score double, cred_score double")
    found = [{tuple(r) for r in simulate.spread(df, graph, 4, base, bin_edges=most).collect()} for base in (0.1, 1.0) for most in (0, 60, 1 << 20)]
    assert len(found[0]) == 120 and found[0] == found[1] == found[2] and found[3] == found[4] == found[5] != found[0]


def stages(spark):
    """Rows that each stage so far has written to shuffles."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}


def test_spread_sends_each_edge_twice(spark):
    """Not once for each round of finding components, nor both ways."""
    rng = np.random.default_rng(2)
    graph = spark.createDataFrame([(f"c{c}u{u}", f"c{c}v{v}") for c in range(3) for u, v in rng.integers(0, (400, 50), (20_000, 2)).tolist()], "u string, v string").repartition(6).cache()
    df = spark.createDataFrame([(f"i{i}", rng.random(), rng.random()) for i in range(50)], "image string, content_score double, cred_score double")
    assert graph.count() == 60_000
    before = max(stages(spark))
    assert simulate.spread(df, graph, 2, 1.0).count() == 50
    assert 60_000 < sum(n for i, n in stages(spark).items() if i > before) < 3 * 60_000


def test_components_in_pieces_and_by_rounds_of_joins(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(f"c{c}n{rng.randrange(9)}", f"c{c}n{rng.randrange(9)}") for c in range(30) for _ in range(12)] + [(f"chain{i}", f"chain{i + 1}") for i in range(60)]
    rng.shuffle(edges)
    edges = [(u, v) for u, v in edges if u != v]
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    degree = {x: sum(u == x for u, _ in edges) for x in label}
    want = {frozenset((x, degree[x]) for x in label if label[x] == of) for of in set(label.values())}
    monkeypatch.setattr(simulate, "JOINED", 8)
    monkeypatch.setattr(simulate, "HELD", 20)
    batches = [simulate.pa.record_batch({"a": [u for u, _ in edges[i : i + 5]], "to": [v for _, v in edges[i : i + 5]], "n": [1] * len(edges[i : i + 5])}) for i in range(0, len(edges), 5)]
    assert sum(map(len, simulate._pieces(iter(batches)))) > len(label)  # given in several pieces
    for alone in (0, 1 << 19):
        monkeypatch.setattr(simulate, "ALONE", alone)
        found = {}
        for r in simulate._components(Tables(spark), spark.createDataFrame(edges, "u string, v string").repartition(5)).collect():
            found.setdefault(r.label, set()).add((r.node, r.n))
        assert {frozenset(x) for x in found.values()} == want


def test_items_spread_together_equal_items_alone(monkeypatch):
    rng = np.random.default_rng(4)
    n = 1300  # numbers of one to four digits
    edges = {(int(u), int(v)) for u, v in rng.integers(1, n + 1, (9 * n, 2)) if u != v} | {(i, i + 1) for i in range(1, n)} | {(7, i) for i in range(8, n + 1)}
    near = np.zeros((n, n), bool)
    for u, v in edges:
        near[u - 1, v - 1] = near[v - 1, u - 1] = True
    numbers = rng.permutation(n) + 1
    table = simulate._pack(
        simulate.pa.table({"bin": [5] * len(edges), "a": [u for u, _ in edges], "v": [f"n{v}" for _, v in edges]}),
        simulate.pa.table({"home": [5] * n, "node": [f"n{x}" for x in numbers], "number": numbers}),
    )
    items = [("x" * (1 + 3 * i), 0.02 + 0.02 * (i % 9), 1 + 61 * i) for i in range(20)] + [("certain", 1.0, 3), ("none", 0.0, 4)]
    want = []
    for image, p, number in items:
        done = np.arange(n) == number - 1
        for k in range(4):
            tries = near[:, done].sum(axis=1)
            done |= [not d and t > 0 and draw(9, image, k, i + 1) < 1 - (1 - p) ** t for i, (d, t) in enumerate(zip(done.tolist(), tries.tolist(), strict=True))]
        want.append(int(done.sum()))
    passes, inner = [], simulate._compressed
    monkeypatch.setattr(simulate, "_compressed", lambda *x: passes.append(1) or inner(*x))
    graph = simulate._Bin(*(table.column(c)[0].as_py() for c in ("nodes", "begins", "ends")))
    assert graph.reached(items, 4, 9) == want and len(set(want)) > 9
    assert len(passes) <= 16  # a pass for each item, round and number of digits would be hundreds
    graph.lane = np.uint32
    assert graph.reached(items, 4, 9) == want
    monkeypatch.setattr(simulate, "WORDS", 100)
    assert simulate._Bin(*(table.column(c)[0].as_py() for c in ("nodes", "begins", "ends"))).reached(items, 4, 9) == want


def test_md5_of_many_texts(spark):
    digits = np.random.default_rng(0).integers(48, 58, (4, 9)).astype(np.uint8)
    for n in range(0, 130, 3):
        start = ("é:" * 70).encode()[:n]
        assert simulate.hashed(start, digits).tolist() == [int(hashlib.md5(start + bytes(r)).hexdigest()[:13], 16) / (1 << 52) for r in digits]


def ring(spark, n, seed, share=0.5):
    """label 1 outside a ring, which no linear boundary tells."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    far = (x**2).sum(axis=1)
    return spark.createDataFrame([(i, [float(z) for z in v], int(f > np.quantile(far, share))) for i, (v, f) in enumerate(zip(x, far, strict=True))], "k long, v array<double>, y int").coalesce(2)


def test_random_features_tell_what_is_not_linear(spark):
    df = ring(spark, 300, 4)
    scored = learn.nested(df, "v", "y", "k", [0.02, 0.5], [0.01], 2, 64).cache()
    assert scored.count() == 300 and {r.gamma for r in scored.select("gamma").distinct().collect()} <= {0.02, 0.5}
    assert metrics.summary(metrics.curve(scored.select("label", "prob"))).first()["auc"] > 0.95
    assert learn.calibration_error(scored).first().ece < 0.12
    assert scored.where("prob < 0 OR prob > 1").count() == 0
    linear = learn.held_out(df, "v", "y", "k", "linear_svm").first()
    assert linear.auc < 0.7


def test_features_approximate_the_kernel(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 4))
    df = vectors(spark, x).withColumn("scaled", array_to_vector("v"))
    z = np.array([r.z for r in learn.FourierFeatures(gamma=0.3, size=4096).transform(df).select("id", vector_to_array("features").alias("z")).orderBy("id").collect()])
    want = np.exp(-0.3 * ((x[:, None] - x) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.08


def test_nested_trains_over_few_partitions_and_each_machine_once(spark, monkeypatch):
    parts, fit = [], learn.LinearSVC._fit

    def counted(self, dataset):
        parts.append(dataset.rdd.getNumPartitions())
        return fit(self, dataset)

    monkeypatch.setattr(learn.LinearSVC, "_fit", counted)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 2))
    df = spark.createDataFrame([(i, [float(a) for a in v], int((v**2).sum() > 1.4)) for i, v in enumerate(x)], "k long, v array<double>, y int")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        assert learn.nested(df, "v", "y", "k", [0.1, 0.5], [0.01], 2, 16).count() == 120
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(parts) == 2 * (2 * 2 + 1) and max(parts) <= spark.sparkContext.defaultParallelism


def test_platt_follows_the_chance(spark):
    rng = np.random.default_rng(6)
    m = rng.normal(size=4000) * 2
    y = rng.random(4000) < 1 / (1 + np.exp(-(1.5 * m - 0.5)))
    a, b = learn.platt(spark.createDataFrame([(float(p), float(q)) for p, q in zip(m, y, strict=True)], "margin double, label double"))
    assert abs(a - 1.5) < 0.15 and abs(b + 0.5) < 0.15


def test_one_class_machine(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(200, 3)), rng.normal(size=(40, 3)) * 0.5 + 5])
    df = spark.createDataFrame([(i, [float(z) for z in v], int(i >= 200)) for i, v in enumerate(x)], "k long, v array<double>, y int").coalesce(2)
    out = learn.one_class(df, "v", "y", "k", nu=0.15, size=64, rounds=10).cache()
    beyond = {r.label: r.share for r in out.groupBy("label").agg(F.avg((F.col("score") > 0).cast("double")).alias("share")).collect()}
    assert abs(beyond[0] - 0.15) < 0.02 and beyond[1] > 0.9


def streamed(spark, tmp_path, rows, schema, work, limits):
    """What a stream over polls appends, over starts anew with these limits of cycles; rows have a column cycle."""
    table = spark.createDataFrame(rows, schema)
    for n in limits:
        out = work(polling.recorded(polling.cycles(spark, n), table))
        stream = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(processingTime="0 seconds").start()
        try:
            stream.processAllAvailable()
            batches = stream.lastProgress["batchId"]
        finally:
            stream.stop()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")), batches


def test_early_stopping_as_stream_state(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"s{i % 3}", i, rng.random(), i // 12) for i in range(60)]
    got, batches = streamed(spark, tmp_path, rows, "s string, i long, x double, cycle long", lambda r: keyed.early_stop(r.drop("cycle"), ["s"], "i", "x", 3), (2, 5))
    want = series.early_stop(spark.createDataFrame([r[:3] for r in rows], "s string, i long, x double"), ["s"], "i", "x", 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and batches >= 4


def test_a_polling_source_ends_at_its_limit():
    reader = polling.PollingReader({"iterations": "5", "cyclesPerTrigger": "2"})
    at, seen = reader.initialOffset(), []
    for _ in range(5):
        end = reader.latestOffset()
        for part in reader.partitions(at, end):
            seen += [c for (c,) in reader.read(part)]
        at = end
    assert seen == [0, 1, 2, 3, 4] and at == {"cycles": 5}
    again = polling.PollingReader({"iterations": "7", "cyclesPerTrigger": "2"})
    again.partitions({"cycles": 4}, {"cycles": 5})  # a start anew repeats the last batch
    assert again.latestOffset() == {"cycles": 7}


def test_appended_csv_has_one_header(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.csv_append(spark.createDataFrame([(1, "x,y")], "`a, b` int, c string"), at)
    sinks.csv_append(spark.createDataFrame([("z", 9, 2)], "c string, extra int, `a, b` int"), at)
    failing = spark.range(3).select(F.when(F.col("id") < 2, "ok").otherwise(F.raise_error(F.lit("stop")).cast("string")).alias("c"))
    with pytest.raises(Exception, match="stop"):
        sinks.csv_append(failing, at)
    df = spark.read.csv(at, header=True)
    assert df.columns == ["a, b", "c"] and sorted(map(tuple, df.collect())) == [("1", "x,y"), ("2", "z")]


def test_ordered_store_opens_only_the_files_it_needs(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    rows = [(f"k{i:04}", i) for i in range(500)] + [("k0100", -1), (None, 0), ("é", 1), ("kz", 2)]
    random.Random(9).shuffle(rows)
    ordered.put(spark.createDataFrame(rows, "key string, v long").repartition(4), "key", at, 10)
    whole = [r for r in rows if r[0] is not None]
    assert len(glob.glob(f"{tmp_path}/s/rows/part-*")) > 5
    places = ordered.cursor(spark, at, "key").orderBy("place").collect()
    assert [r.place for r in places] == list(range(1, len(whole) + 1)) and [r.key for r in places] == sorted(r[0] for r in whole)
    part = ordered.between(spark, at, "key", "k0100", "k0110")
    assert sorted(r.v for r in part.collect()) == [-1, *range(100, 110)] and len(part.inputFiles()) <= 2
    assert sorted(r.key for r in ordered.with_prefix(spark, at, "key", "k00").collect()) == [f"k{i:04}" for i in range(100)]
    assert ordered.with_prefix(spark, at, "key", "é").count() == 1 and ordered.between(spark, at, "key", "zz").count() == 1 and ordered.between(spark, at, "key", "a", "b").count() == 0


def test_contracts_of_stages(spark):
    df = spark.createDataFrame([("a", 0.5)], "image string, content_score double")
    with pytest.raises(ValueError, match="needs cred_score, early_risk"):
        registry.apply("aggregator", "p2p_sigmoid", df)

    @registry.register("policy", "broken")
    def broken(df):
        return df.select("image")

    try:
        with pytest.raises(ValueError, match="must give policy"):
            registry.apply("policy", "broken", df)
    finally:
        del registry._plugins["policy"]["broken"]


def test_p_values_as_expressions(spark):
    rows = [(r, n) for r in (0.0, 1e-4, 0.01, -0.3, 0.5, 0.9, -0.999, 0.99999, 1.0, -1.0, None, float("nan")) for n in (2, 3, 4, 5, 10, 101, 5000, 100_000)]
    got = spark.createDataFrame(rows, "r double, n long").select("r", "n", two_sided(F.col("r"), F.col("n")).alias("p")).collect()
    for x in got:
        want = student_two_sided(x.r, x.n)
        assert (x.p is None) == (want is None) and (want is None or math.isclose(x.p, want, rel_tol=1e-8, abs_tol=1e-12)), (x, want)
    tiny = spark.createDataFrame([(1e-9, 5000)], "r double, n long").select(two_sided(F.col("r"), F.col("n"))).first()[0]
    assert math.isclose(1 - tiny, math.sqrt(2 / math.pi * 4998) * 1e-9, rel_tol=1e-3)  # where 1 - r * r is 1
    df = spark.createDataFrame([("f", "m", 50, 0.3, -0.2)], "feature string, detector_metric string, n long, pearson_r double, spearman_r double")
    assert abs(engagement.p_values(df).first().pearson_p - student_two_sided(0.3, 50)) < 1e-10


@pytest.mark.parametrize("values", [[1.0], [2.0, 1.0], list(range(10)), [3.0] * 50 + [1.0], [float(x) for x in np.random.default_rng(1).normal(size=3000)], [float(x) for x in np.random.default_rng(2).integers(0, 5, 999)]])
def test_quantiles_equal_numpy(spark, values):
    shares = [0.0, 0.2, 0.25, 0.5, 0.8, 0.999, 1.0]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
    for accuracy in (100_000, 200):
        got = ranking.quantiles(df, "x", shares, accuracy).first()
        assert np.allclose(list(got), np.quantile(values, shares), atol=1e-12), accuracy
    assert list(ranking.quantiles(df.limit(0), "x", shares).first()) == [None] * len(shares)


def test_scraped_log_carries_headers_over_slices(spark):
    rng = random.Random(10)
    rows, want, now = [], {}, {}
    for log in ("a", None):
        now[log] = None
        for i in range(300):
            kind = rng.random()
            if kind < 0.05:
                now[log] = f"D{rng.randint(0, 9)}"
                rows.append((log, i, f"dataset: {now[log]}"))
            elif kind < 0.2:
                rows.append((log, i, f"AUC: 0.{i}"))
            else:
                rows.append((log, i, "noise"))
            if now[log]:
                cell = want.setdefault((log, now[log]), [None])
                if rows[-1][2].startswith("AUC"):
                    cell[0] = float(f"0.{i}")
    df = spark.createDataFrame(rows, "log string, position long, value string").repartition(5)
    for width in (7, 100_000):
        assert {(r.log, r.dataset): [r.AUC] for r in tables.scraped_log(df, by=("log",), slice_lines=width).collect()} == want


def test_tables_are_removed(spark):
    made = Tables(spark)
    t = made.stored(spark.range(3).toDF("x"), "gone")
    assert t.count() == 3
    path = t.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    made.drop(t)
    assert not glob.glob(f"/{path.lstrip('/')}/*")


def test_plane_keeps_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 4
    v = centres[np.arange(240) % 8] + rng.normal(size=(240, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [float("nan")] * 16)], "k long, v array<double>")
    got = charts.plane(df, "k", "v", perplexity=10.0, iterations=250).toPandas().sort_values("key")
    assert got.key.tolist() == list(range(240))
    y = got[["x", "y"]].to_numpy()
    near = lambda m: np.argsort(((m[:, None] - m[None]) ** 2).sum(axis=2) + np.diag(np.full(240, np.inf)), axis=1)[:, :10]
    high, low = near(v), near(y)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(high, low, strict=True)]) > 0.4  # 0.04 by chance
    assert np.mean(low % 8 == np.arange(240)[:, None] % 8) > 0.95
    assert len(charts.plane(df.where("k = 3"), "k", "v").collect()) == 1 and not charts.plane(df.where("k > 400"), "k", "v").collect()


def test_charts_of_odd_rows(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("b", "y", 2.0), (None, "x", 9.0), ("a", None, 9.0), ("b", "x", None), ("b", "x", float("nan"))], "s string, g string, v double")
    assert sorted((r.g, r.s, r.v, round(r.at, 6), r.width) for r in charts.bars(df, "g", "s", "v").collect()) == [("x", "a", 2.0, 0.8, 0.4), ("y", "b", 2.0, 2.2, 0.4)]
    assert {r.shade for r in charts.heatmap(df, "s", "g", "v").collect()} == {0.0}
    assert sorted((r.s, r.g, r.point) for r in charts.radar(df, "s", "g", "v").collect()) == [("a", "x", 1), ("a", "x", 3), ("b", "y", 2)]
    assert not charts.heatmap(df.where("v > 99"), "s", "g", "v").collect()


def test_quantiles_of_many_partitions(spark):
    x = np.random.default_rng(4).normal(size=40_000).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(16)
    got = ranking.quantiles(df, "x", [0.0, 0.2, 0.5, 0.8, 1.0], accuracy=100).first()
    assert np.allclose(list(got), np.quantile(x, [0.0, 0.2, 0.5, 0.8, 1.0]), atol=1e-12)


def test_file_list_takes_every_folder_with_the_text_in_its_name(spark, tmp_path):
    from tidemark.plans import queries

    rows = [(1, "src1"), (2, "src10"), (3, "1/a"), (10, "src2"), (4, None), (5, "x/1y")]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.path for r in queries.QUERIES["file_list"](spark, str(tmp_path)).collect()} == {"Root/src1/1", "Root/src10/2", "Root/1/a/3", "Root/x/1y/5"}
