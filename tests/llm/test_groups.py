"""Operators over many texts or vectors: line dedup, URL rules, language model, similarity joins, components, the pipeline."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, spark_rows, sql_rows
from pyspark.sql import functions as F
from test_texts import prose

from tidemark.llm import jaccard, kneser, linededup, queries, urlfilter, vectors
from tidemark.llm.components import components


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(connect(sf_dir), queries.ORACLE_SQL[name])


def test_line_dedup(spark, table, odd, empty):
    rows = [(i, f"own {i}\nshared" + ("\nnear" if i < 9 else "") + ("\nown %d" % i), "en", f"s{i}") for i in range(12)]
    rows += [(100 + i, f"many on one site\nx {i}", "en", "s0") for i in range(30)]
    got = {r.doc_id: r for r in linededup.clean(table(rows)).collect()}
    assert got[0].text.split("\n") == ["own 0", "shared", "near", "own 0"] and got[0].n_removed == 0
    assert got[5].text.split("\n") == ["own 5", "near", "own 5"] and got[5].n_removed == 1 and got[5].n_chars == len(got[5].text)
    assert all(got[100 + i].n_removed == 0 for i in range(30))
    copies = table([(i, "a\nb", "en", f"s{i}") for i in range(11)])
    kept = linededup.keep(spark, copies)
    assert [r.doc_id for r in kept.collect()] == [0] and kept.columns == copies.columns
    out = {r.doc_id: r for r in linededup.clean(odd).collect()}
    assert out[0].text is None and out[0].n_lines == 0 and out[1].n_lines == 1 and linededup.clean(odd).count() == odd.count()
    assert linededup.clean(empty).count() == 0
    null_site = table([(i, "l", "en", None if i % 2 else f"s{i}") for i in range(20)])
    assert {r.n_removed for r in linededup.clean(null_site).collect()} == {0, 1}


def brute_rule(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("#")[0].split("?")[0]
    fit = [r for r in rules if r[1] and (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fit, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(0)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "net", "a.net", "É.com", "A.COM", "", "a..com", "com."]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/7/x", "/EN/", "?q=/en/", "#/en/"]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in paths] + [None, "", "nothing", "a.com/en/", "x://y://a.com/en/"] + ["http://a.com/en/7"] * 50
    rules = [("block" if rng.random() < 0.5 else "allow", h, p) for h in ("com", "a.com", "b.a.com", "net") for p in ("", "/en", "/en/", "/en/7") if rng.random() < 0.7]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rules_frame(spark, rules)).collect()}
    assert got == {i: brute_rule(u, rules) for i, u in enumerate(urls)}
    assert {r.verdict for r in urlfilter.judge(pages, urlfilter.rules_frame(spark, [])).collect()} == {"allow"}
    twice = urlfilter.rules_frame(spark, [("allow", "com", "/en/"), ("block", "com", "/en/")])
    assert urlfilter.judge(pages.where("url = 'http://a.com/en/7'").limit(1), twice).first().verdict == "block"
    assert urlfilter.judge(pages.limit(0), twice).count() == 0


def test_url_rules_of_the_contract(spark, tmp_path):
    urls = ["http://a.com/en/1", "http://example.com/en/7", "http://www.example.com/en/71", "http://a.net/de/1", "http://example.net/de/8", "http://example.net/de/7", "http://a.org/es/", "http://a.org/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {urls[r.page_id]: (r.rule, r.verdict) for r in urlfilter.run(spark, str(tmp_path)).collect()}
    contract = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    assert got == {u: brute_rule(u, contract)[2:] for u in urls}


def brute_kneser(train, order=3):
    """P(w | context) of an interpolated modified Kneser-Ney model by counters, and the number of distinct tokens."""
    grams = Counter()
    for v in train:
        v = ["<s>"] * (order - 1) + v
        grams.update(zip(*(v[i:] for i in range(order)), strict=False))
    levels = [grams]  # of shorter grams: how many different words stand before them, the count at the begin of a text
    while len(next(iter(levels[-1]))) > 1:
        below = Counter()
        for g, n in levels[-1].items():
            below[g[1:]] += n if len(g) > 2 and g[1] == "<s>" else 1
        levels.append(below)
    levels = levels[::-1]
    size = len(levels[0])
    models = []
    for counts in levels:
        m = Counter(counts.values())
        y = m[1] / (m[1] + 2 * m[2]) if m[1] else 0
        raw = [1 - 2 * y * m[2] / m[1] if m[1] else 0.5, 2 - 3 * y * m[3] / m[2] if m[2] else 1.0, 3 - 4 * y * m[4] / m[3] if m[3] else 1.5]
        d = [0, *(min(max(x, 0.05), i) for i, x in enumerate(raw, 1))]
        total, back = Counter(), defaultdict(float)
        for g, n in counts.items():
            total[g[:-1]] += n
            back[g[:-1]] += d[min(n, 3)]
        models.append((counts, d, total, back))

    def p(w, context):
        counts, d, total, back = models[len(context)]
        low = p(w, context[1:]) if context else 1 / (size + 1)
        if context not in total:
            return low
        n = counts[*context, w]
        return max(n - d[min(n, 3)], 0) / total[context] + back[context] / total[context] * low

    return p, size


def log_score(p, tokens, order=3):
    padded = ["<s>"] * (order - 1) + tokens
    return sum(math.log10(p(w, tuple(padded[i : i + order - 1]))) for i, w in enumerate(tokens))


def test_kneser_ney_equals_brute_force(spark, table, odd, empty, monkeypatch):
    rng = random.Random(1)
    vocab = prose(rng, 80).split()
    rows = [(i, " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(len(vocab))], k=rng.randint(0, 60)))) for i in range(150)] + [(200, None), (201, "")]
    rows += [(210 + i, "the same Words again") for i in range(300)]  # counts of more than a byte
    docs = table(rows)
    monkeypatch.setattr(kneser, "FLUSH", 500)
    monkeypatch.setattr(kneser, "STEP", 16)
    model = kneser.fit(docs, F.col("doc_id") % 7 != 2, shards=3)
    text = {i: (t or "").lower().split() + ["</s>"] for i, t in rows}
    train = [v for i, v in text.items() if i % 7 != 2]
    c = Counter(w for v in train for w in v)
    n = sum(c.values())
    p, v = brute_kneser(train)
    for context in (("<s>", "<s>"), ("<s>", train[0][0]), tuple(train[0][:2]), ("never", "seen")):
        assert abs(sum(p(w, context) for w in c) + p("never seen", context) - 1) < 1e-9
    held, short = 0.0, 0.0
    two, _ = brute_kneser(train, 2)
    for r in kneser.score(docs, model).collect():
        own = text[r.doc_id]
        assert abs(r.score - log_score(p, own)) < 1e-6
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in c for w in own), n)
        if r.doc_id % 7 == 2:
            held, short = held + r.score, short + log_score(two, own, 2)
    assert held != short
    assert kneser.score(odd, model).count() == odd.count() and kneser.score(empty, model).count() == 0
    model.remove()
    assert {r.score for r in kneser.score(docs.limit(3), kneser.fit(empty)).collect()} == {0.0}


def test_kneser_ney_over_a_long_text(table, monkeypatch):
    rng = random.Random(8)
    long = " ".join(rng.choices(prose(rng, 500).split(), k=300_000))
    docs = table([(0, long), (1, "a b c")])
    model = kneser.fit(docs, shards=2)
    whole = {r.doc_id: r.score for r in kneser.score(docs, model).collect()}
    monkeypatch.setattr(kneser, "STEP", 1 << 22)
    column = docs.select("text").toArrow().column(0).combine_chunks()
    assert np.allclose(model.score(column)[3], [whole[0], whole[1]])
    assert model.score(column)[0].tolist() == [300_001, 4]


def test_hash_arrays_give_back_what_they_hold(tmp_path):
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 17, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        values = rng.integers(1, 400, (len(keys), 4))
        kneser.save_table(str(tmp_path), f"t{n}", keys, values)
        assert (kneser.find(str(tmp_path), f"t{n}", keys, 4) == values).all()
        assert not kneser.find(str(tmp_path), f"t{n}", rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1), 4).any()
    assert not kneser.find(str(tmp_path), "none", np.arange(3, dtype=np.uint64), 2).any()


def brute_components(sets, links):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in sets}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(250)] + [(5, 5), (None, 3)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute_components({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").lower().split()
        out[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def test_jaccard_join_equals_brute_force(table, odd, empty, monkeypatch):
    rng = random.Random(3)
    rows, passage = [], prose(rng, 60)
    for g in range(25):
        base = prose(rng, rng.choice([3, 5, 8, 20, 60, 300])).split()
        for _ in range(rng.choice([1, 2, 5, 30])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = prose(rng, 1)
            rows.append((len(rows) * 3, " ".join(own) + (" " + passage if g % 3 == 0 else "")))
    rows += [(5000 + i, t) for i, (_, t) in enumerate(rows[:40])] + [(6000, None), (6001, ""), (6002, " \n")]
    rows += [(7000 + i, passage + " " + prose(rng, 30)) for i in range(40)]
    monkeypatch.setattr(jaccard, "TILE", 16)
    sets = shingle_sets(rows)
    ids = [d for d in sets if sets[d]]
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    docs = table(rows).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}
    kept = jaccard.keep(None, docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d in sets if want[d] == d)
    assert jaccard.join(odd).count() == odd.count() and jaccard.join(empty).count() == 0


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(4)
    for n in (1, 5, 70, 400):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 4], rng.integers(0, 1 << 63, n // 4 + 1).astype(np.uint64)]))
        x = jaccard.folded([jaccard.sketch(a), jaccard.sketch(b)])
        assert int(np.bitwise_count(x[0] ^ x[1]).sum()) <= len(np.setxor1d(a, b))


def test_similar_sets_share_enough_keys():
    rng = np.random.default_rng(5)
    bands = jaccard.Bands()
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        drop = int(rng.integers(0, n // 8 + 1))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1))).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < 80 * (len(a) + len(b) - shared):
            continue
        (ka, ta), (kb, tb) = jaccard.keys_of(a, bands), jaccard.keys_of(b, bands)
        band = int(np.searchsorted(bands.lo, max(len(a), len(b)), "right")) - 1
        both = np.intersect1d(ka, kb)
        least = min(int(t[(k & np.uint64(255)) == band].min()) % jaccard.FEWER for k, t in ((ka, ta), (kb, tb)))
        assert ((both & np.uint64(255)) == band).sum() >= least


def test_keys_of_very_large_sets():
    rng = np.random.default_rng(7)
    bands = jaccard.Bands()
    for n in (330_000, 540_000, 1_000_000):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        other = np.unique(np.concatenate([s[n // 20 :], rng.integers(0, 1 << 63, n // 20).astype(np.uint64)]))
        (ka, ta), (kb, tb) = jaccard.keys_of(s, bands), jaccard.keys_of(other, bands)
        for band, _, _, wanted in bands.of(len(s)):
            mine, both = (ka & np.uint64(255)) == band, np.intersect1d(ka, kb)
            least = int(ta[mine].min())
            assert 0 < least % jaccard.FEWER <= wanted and (least < jaccard.FEWER) == (least == wanted)
            assert ((both & np.uint64(255)) == band).sum() >= least % jaccard.FEWER


def spread(rng, n, d, mean):
    """n vectors of d dimensions whose cosines are `mean` on average; a third of them have a partner at 0.95 to 0.97."""
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(mean) * unit(rng.normal(size=d)) + np.sqrt(1 - mean) * unit(rng.normal(size=(n, d))))
    m = n // 3
    away = rng.normal(size=(m, d))
    away = unit(away - (away * x[:m]).sum(axis=1, keepdims=True) * x[:m])
    c = rng.uniform(0.95, 0.97, (m, 1))
    x[-m:] = c * x[:m] + np.sqrt(1 - c**2) * away
    return x


@pytest.mark.parametrize("d,mean", [(16, 0.0), (32, 0.5), (64, 0.0), (64, 0.5), (64, 0.8)])
def test_vectors_recall(spark, d, mean):
    x = spread(np.random.default_rng(d + int(10 * mean)), 2400, d, mean)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r for r in vectors.links(df).collect()}
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= near.sum(axis=1)).all() and n.sum() >= 0.95 * near.sum() > 0


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for g in range(12):
        c = rng.normal(size=64)
        for _ in range(int(rng.choice([1, 2, 60]))):
            rows.append((len(rows), [float(np.float32(x)) for x in c + rng.normal(size=64) * rng.uniform(0.01, 0.2)]))
    rows += [(900 + i, [float(x) for x in rng.normal(size=64)]) for i in range(200)]
    rows += [(3000 + i, rows[5][1]) for i in range(70)] + [(4000, [x * 3 for x in rows[5][1]])]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [1.0] * 63 + [None]), (2004, [float("nan")] * 64), (2005, [float("inf")] * 64), (2007, [float("inf")] * 64), (2006, rows[0][1][:32]), (None, rows[0][1])]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    monkeypatch.setattr(vectors, "TILE", 20)
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("n", F.lit("clash")).withColumn("rep", F.lit(1)).withColumn("size", F.lit(2))
    got = {r.vec_id: r for r in vectors.links(df).collect()}
    assert len(got) == len(rows) + len(bad) and all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in bad)
    found = sum(got[i].n_links for i, _ in rows)
    assert found >= 0.98 * near.sum() and all(got[rows[k][0]].n_links <= near[k].sum() for k in range(len(rows)))
    want = brute_components({i: 0 for i, _ in rows}, [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(near), strict=True)])
    assert np.mean([got[i].component_id == want[i] for i, _ in rows]) > 0.98
    assert vectors.links(df.limit(0)).count() == 0


def test_vectors_of_many_lengths_and_repeated_ids(spark):
    rows = [(10 * d + k, [1.0] * d) for d in range(1, 30) for k in (0, 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (1, i - i % 10) for i, _ in rows}
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0]), (5, [1e300, 1e300]), (6, [1e-310, 1e-310])]
    got = sorted(tuple(r) for r in vectors.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("vec_id", "n_links", "component_id").collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4), (5, 1, 5), (6, 1, 5)]


def test_jaccard_join_of_very_long_texts(table):
    rng = np.random.default_rng(11)
    words = rng.integers(0, 1 << 40, 700_000).astype(str)
    near = words.copy()
    near[rng.integers(0, len(near), 5000)] = "x"
    far = words.copy()
    far[rng.integers(0, len(far), 60_000)] = "y"
    docs = table([(3, " ".join(words)), (5, " ".join(near)), (7, " ".join(words)), (9, " ".join(far)), (1, "a b c")])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert {i: c for i, (_, c) in got.items()} == {3: 3, 5: 3, 7: 3, 9: 9, 1: 1} and got[3][0] == 700_000 - 4


def test_jaccard_places_of_a_large_hub(table, monkeypatch):
    rng = random.Random(12)
    base = prose(rng, 120).split()
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = prose(rng, 1)
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "SEEN", 10)
    monkeypatch.setattr(jaccard, "KEYS", 500)
    monkeypatch.setattr(jaccard, "PLACE_ROWS", 50)
    sets = shingle_sets(rows)
    links = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    assert {r.doc_id: r.component_id for r in jaccard.join(table(rows).repartition(3)).collect()} == want


def test_jaccard_keep_of_repeated_ids(spark, table):
    a, b = prose(random.Random(13), 30), prose(random.Random(14), 30)
    docs = table([(1, a), (1, a), (1, b), (2, b), (3, a + " more"), (4, None), (4, None), (None, a), (None, a)]).withColumn("others", F.lit(5)).withColumn("rep", F.monotonically_increasing_id())
    kept = jaccard.keep(spark, docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, a), (0, a), (1, a), (1, b), (4, "")])


@pytest.mark.parametrize("name", ["gone", "own", "every", "place", "_gone", "Gone", "lines", "removed", "h", "salt", "site", "first_doc"])
def test_line_dedup_bears_clashing_names(spark, table, name):
    docs = table([(i, f"shared\nown {i}", "en", f"s{i}") for i in range(11)], extra=False).withColumn(name, F.lit("x"))
    kept = linededup.keep(spark, docs)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert rows[0].text == "shared\nown 0" and rows[10].text == "own 10" and all(r[name] == "x" for r in rows.values())


def test_line_dedup_ties_and_long_texts(spark, table):
    long = "\n".join(f"line {i}" for i in range(50_000))
    rows = [(1, "same", "en", "a"), (1, "same\nsame", "en", "a")] + [(i, "same\nx", "en", f"s{i}") for i in range(2, 12)] + [(50, long + "\nsame", "en", "z")]
    out = sorted((r.doc_id, r.n_removed, len(r.text)) for r in linededup.clean(table(rows)).collect())
    assert [x[:2] for x in out if x[0] == 1] == [(1, 0), (1, 0)] and (50, 1, len(long)) in out


def test_line_dedup_of_repeated_ids_and_many_shared_lines(table):
    shared = [f"shared {i}" for i in range(5000)]
    rows = [(i, "\n".join(shared), "en", f"s{i}") for i in range(12)]
    rows += [(50, "\n".join(x for i, s in enumerate(shared) for x in (s, f"own {i}", "")), "en", "s0")] * 2 + [(50, "shared 1\nnothing else\nshared 1", "en", "s1"), (50, None, "en", "s1"), (50, "", "en", "s1")]
    out = sorted((r.n_lines, r.n_removed, r.text) for r in linededup.clean(table(rows)).where("doc_id = 50").collect() if r.text is not None)
    own = "\n".join(x for i in range(5000) for x in (f"own {i}", ""))
    assert out == [(1, 0, ""), (3, 2, "nothing else"), (15000, 5000, own), (15000, 5000, own)]


def test_models_of_mllib_still_work_afterwards(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    assert components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).count() == 3
    df = spark.createDataFrame([([float(i), 1.0], i % 2) for i in range(20)], "x array<double>, label int").select(array_to_vector("x").alias("features"), "label")
    assert LogisticRegression(maxIter=2).fit(df).transform(df).select("prediction").count() == 20
    assert len(LogisticRegression(maxIter=2).fit(df).transform(df).groupBy("prediction").count().collect()) >= 1
