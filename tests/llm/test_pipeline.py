"""The pipeline's stages, each held against a brute-force version on what the stage before it kept."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_groups import brute_components, shingle_sets
from test_texts import brute_quality, brute_search, prose

import corpus_pipeline
from tidemark.llm import bpe, decontam, linededup, quality


@pytest.fixture(scope="module")
def place(spark, table, tmp_path_factory):
    """A folder of tables: good and bad texts, lines of many sites, copies and near copies, benchmark passages, nulls, repeated rows."""
    rng = random.Random(31)
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, prose(rng, rng.randint(10, 40)) + ("? " + prose(rng, 2) if i % 2 else "")) for i in range(6)]
    rows, labels = [], []
    for i in range(150):
        own = prose(rng, rng.randint(30, 90)).split()
        if i % 5 == 1:
            own[10:10] = items[i % 6][1].replace("?", "").split()
        text = " ".join(own)
        if i % 3 == 0:
            text += "\nsubscribe to our letter"
        if i % 10 == 9:
            text = " | ".join(own)
        rows.append((i, text, "en", f"s{i % 17}"))
        if i % 2:
            labels.append((i, int(i % 10 != 9), 0))
    for k in range(30):  # near copies: one or two words differ
        own = rows[k][1].split(" ")
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = prose(rng, 1)
        rows.append((200 + k, " ".join(own), "en", "copies"))
    rows += [(300, None), (301, ""), (302, " "), (303, "subscribe to our letter"), (0, rows[0][1], "en", "s0")]
    table(rows, extra=False).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def brute_lines(rows):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            sites[line].add(site or "")
            first[line] = min(i, first.get(line, i))
    out = []
    for i, text, _ in rows:
        lines = [] if text is None else text.split("\n")
        left = [x for x in lines if not x or len(sites[x]) < linededup.SITES or first[x] == i]
        if len(left) == len(lines) or left:
            out.append((i, text if text is None else "\n".join(left)))
    return out


def plain(rows):
    return sorted((r[0], r[1] is not None, r[1] or "") for r in rows)


def test_stages_equal_brute_force(spark, place):
    docs = spark.read.parquet(f"{place}/documents.parquet")
    labels, bench = spark.read.parquet(f"{place}/labels.parquet"), spark.read.parquet(f"{place}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = rows_of(docs)

    weights, bias = quality.fit(docs, labels)
    kept = stages["quality classifier"](spark, docs, place).cache()
    want = [r for r in rows if brute_quality(r[1], weights, bias) >= 0.5]
    assert plain(rows_of(kept)) == plain(want) and 100 < len(want) < len(rows) and kept.columns == docs.columns
    bad = {i for i, *_ in rows if i % 10 == 9 and i < 200}
    assert not bad & {i for i, *_ in want}

    docs, rows = kept, rows_of(kept)
    kept = stages["line dedup"](spark, docs, place).cache()
    want = brute_lines(rows)
    assert plain(rows_of(kept)) == plain(want) and kept.columns == docs.columns
    assert sum("subscribe" in (t or "") for _, t in want) < sum("subscribe" in (t or "") for _, t, _ in rows)

    docs, rows = kept, rows_of(kept)
    kept = stages["n-gram Jaccard join"](spark, docs, place).cache()
    sets = shingle_sets([(i, t) for i, t, _ in rows])
    ids = [i for i in sets if sets[i]]
    part = brute_components(sets, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    want = {(i, t) for i, t, _ in rows if part[i] == i}
    assert plain(rows_of(kept)) == plain(want) and len(want) < len({i for i, *_ in rows}) and kept.columns == docs.columns

    docs, rows = kept, rows_of(kept)
    kept = stages["benchmark decontamination"](spark, docs, place).cache()
    index = decontam.Index([(r.item_id, r.text) for r in bench.where(F.col("text").isNotNull()).orderBy("item_id", "text").collect()])
    hit = {r for r, _ in brute_search(index, [t or "" for _, t, _ in rows])}
    want = [r for k, r in enumerate(rows) if k not in hit]
    assert plain(rows_of(kept)) == plain(want) and 0 < len(hit) < len(rows) and kept.columns == docs.columns

    encoder = bpe.tables(*bpe._default())[0]
    found = sorted(stages["byte-level BPE"](spark, kept, place).collect(), key=lambda r: r.doc_id)
    texts = sorted((i, t or "") for i, t, _ in rows_of(kept))
    assert [r.doc_id for r in found] == [i for i, _ in texts]
    for r, (_, t) in zip(found, texts, strict=True):
        assert np.frombuffer(r.ids, "<u4").tolist() == encoder.encode_ordinary(t) and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    whole = corpus_pipeline.run(spark, place).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in whole) == [(r.doc_id, r.ids_sha256) for r in found]


def test_pipeline_of_empty_tables(spark, table, tmp_path):
    table([], extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
