"""Operators over single texts: encoding, classifiers, language, toxicity, decontamination."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, grams, language, quality, toxicity
from tidemark.llm import textvec as tv

VOWELS = "aeiou"


def prose(rng, n, letters="bcdfglmnprst"):
    return " ".join("".join(rng.choice(letters) + rng.choice(VOWELS) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    rng = random.Random(0)
    texts = [prose(rng, 40).upper() if i % 2 else prose(random.Random(i), 30) for i in range(50)] + [None, ""]
    h, bounds = tv.words(pa.array(texts))
    monkeypatch.setattr(tv, "WINDOW", 64)
    again, _ = tv.words(pa.array(texts))
    assert (h == again).all()
    known = {}
    for i, t in enumerate(texts):
        own = (t or "").lower().split()
        assert bounds[i + 1] - bounds[i] == len(own)
        for w, x in zip(own, h[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("chunk,overlap", [(7, 3), (16, 8), (4, 20), (1, 1), (30, 10)])
def test_stitching_equals_whole_texts(chunk, overlap):
    path, pattern = bpe._default()
    rng = random.Random(chunk)
    for k in range(200):
        t = "".join(rng.choice("ab \n\t'sé!1 日  ") for _ in range(rng.randint(0, 150))) + ("x" * rng.choice([60, 300]) if k % 5 == 0 else "") + "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 40)))
        parts = [(s, c, *bpe.pieces(c, path, pattern)) for s, c in bpe.cuts(t, chunk, overlap)]
        assert bpe.stitch(parts, path, pattern).tolist() == bpe.whole(t, path, pattern).tolist()


def test_stitching_one_very_long_pre_token():
    path, pattern = bpe._default()
    t = "a b " + "x" * 700_000 + " c"
    parts = [(s, c, *bpe.pieces(c, path, pattern)) for s, c in bpe.cuts(t, bpe.CHUNK, bpe.OVERLAP)]
    read = []
    pieces = bpe.pieces
    try:
        bpe.pieces = lambda text, *x: read.append(len(text)) or pieces(text, *x)
        assert bpe.stitch(parts, path, pattern).tolist() == bpe.whole(t, path, pattern).tolist()
    finally:
        bpe.pieces = pieces
    assert sum(read) < 3 * len(t)


def test_encoding_round_trip(odd, empty):
    path, pattern = bpe._default()
    rows = bpe.encode(odd, chunk=1000, overlap=50, digests=True).collect()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert ids.tolist() == bpe.tables(path, pattern)[0].encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(ids)
        assert bpe.decode(ids.tolist(), path, pattern).decode() == texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest()
    assert bpe.encode(empty).count() == 0


def labelled(spark, table, name, make, n=240):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        y = i % 2
        rows.append((i, make(rng, y)))
        labels.append((i, y))
    return table(rows), spark.createDataFrame(labels, f"doc_id long, {name} int")


def test_quality_on_held_out_documents(spark, table, odd, empty):
    docs, labels = labelled(spark, table, "quality", lambda rng, y: prose(rng, 40) if y else " | ".join(prose(rng, 40).split()))
    model = quality.fit(docs, labels, where=grams.fold("doc_id", 3) != 1)
    got = quality.score(docs, model, ["doc_id"]).where(grams.fold("doc_id", 3) == 1).collect()
    assert len(got) > 50 and np.mean([(r.score >= 0.5) == (r.doc_id % 2) for r in got]) > 0.95
    scores = quality.score(odd, model, ["doc_id"]).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality.score(empty, model, ["doc_id"]).count() == 0
    kept = quality.keep(spark, docs, labels)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {1}
    none = quality.fit(docs, labels.limit(0))
    assert {round(r.score, 6) for r in quality.score(docs, none, ["doc_id"]).collect()} == {0.5}


def brute_quality(text, weights, bias):
    """The score by single features, one after the other."""
    data, total, count = (text or "").encode(), 0.0, 0
    for n in quality.ORDERS:
        for i in range(len(data) - n + 1):
            total += weights[grams.buckets(np.frombuffer(data[i : i + n], np.uint8), n, quality.BITS)[0]]
            count += 1
    before = None
    for word in re.findall(rb"[^\x20\x09-\x0D]+", data):
        h = tv.hash_spans(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))
        total += weights[int(h[0] >> np.uint64(64 - quality.BITS))] + weights[int(word == before)]
        count, before = count + 2, word
    return 1 / (1 + math.exp(-(total / max(count, 1) + bias)))


def test_quality_scores_equal_brute_force(monkeypatch):
    rng = random.Random(23)
    texts = [prose(rng, rng.randint(0, 50)) for _ in range(30)] + ["a a a b", "", None, "É é\té", "xx", " ".join(["same"] * 9)]
    weights = np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32)
    batch = pa.record_batch({"text": pa.array(texts)})
    want = [brute_quality(t, weights, 0.3) for t in texts]
    assert np.allclose(quality.score_batch(batch, weights, 0.3), want)
    monkeypatch.setattr(tv, "WINDOW", 16)
    assert np.allclose(quality.score_batch(batch, weights, 0.3), want)


def brute_language(model, text):
    clean = bytes(grams.letters(np.frombuffer(text.encode(), np.uint8)))
    ids = [int(grams.buckets(np.frombuffer(clean[i : i + n], np.uint8), n, language.BITS)[0]) for n in language.ORDERS for i in range(len(clean) - n + 1)]

    def decide(machines, names):
        votes, sums, least = Counter(), Counter(), {}
        for i, j, w, b in machines:
            m = sum(float(w[x]) for x in ids) / max(len(ids), 1) + b
            votes[i if m >= 0 else j] += 1
            for k, s in ((i, m), (j, -m)):
                sums[k] += s
                least[k] = min(least.get(k, math.inf), s)
        best = max(range(len(names)), key=lambda k: (votes[k], sums[k], -k))
        return names[best], least.get(best, math.inf)

    f, a = decide(model.machines[0], model.families)
    lang, b = decide(model.machines[1 + model.families.index(f)], model.members[f])
    return lang, 1 / (1 + math.exp(-max(-30, min(30, a, b))))


def test_language_equals_brute_force(monkeypatch):
    rng = random.Random(24)
    letters = {"en": "thwsh", "de": "schkz", "fr": "quxjv", "es": "ñllrr", "xx": "ppyyb", "pt": "mnvrq"}
    langs = list(letters) * 20
    model = language.Model([prose(rng, 20, letters[x]) for x in langs], langs)
    texts = [prose(rng, rng.randint(1, 12), rng.choice(list(letters.values()))) for _ in range(40)] + ["é", "a", "ж日 x"]
    want = [brute_language(model, t) for t in texts]
    for window in (tv.WINDOW, 16):
        monkeypatch.setattr(tv, "WINDOW", window)
        got, score = model.predict(pa.record_batch({"text": pa.array(texts)}))
        assert got == [x for x, _ in want] and np.allclose(score, [y for _, y in want])


@pytest.mark.parametrize("name", ["quality_score", "quality_score_", "Quality_Score", "score", "label", "_h", "model"])
def test_quality_keep_bears_clashing_names(spark, table, name):
    docs, labels = labelled(spark, table, "quality", lambda rng, y: prose(rng, 40) if y else " | ".join(prose(rng, 40).split()), 60)
    docs = docs.drop("score").withColumn(name, F.lit("x"))
    kept = quality.keep(spark, docs, labels.withColumn("text", F.lit("y")).withColumn("label", F.lit(7)).withColumn("lang", F.lit(1)))
    rows = kept.collect()
    assert kept.columns == docs.columns and {r[name] for r in rows} == {"x"} and {r.doc_id % 2 for r in rows} == {1}


def test_samples_are_the_same_whatever_the_order(spark):
    rows = [(i, i % 3) for i in range(500)] + [(i, 9) for i in range(0, 500, 50)] + [(i, i % 3) for i in range(100)] + [(None, 1), (7, None)]
    df = spark.createDataFrame(rows, "k long, y int")
    picked = [sorted(tuple(r) for r in grams.sample(x, "k", "y", 90, 1000).collect()) for x in (df.repartition(5), df.orderBy(F.desc("k")).coalesce(1))]
    assert picked[0] == picked[1]
    counts = Counter(y for _, y in picked[0])
    assert set(counts) == {0, 1, 2} and all(20 < n <= 90 for n in counts.values())
    assert all(k % 50 for k, _ in picked[0])
    assert 0 < grams.sample(df, "k", "y", 400, 200).count() <= 200
    every = grams.sample(df, "k", "y", 10_000, 10_000).collect()
    assert sorted(r.k for r in every) == [k for k in range(500) if k % 50]
    assert grams.sample(df.limit(0), "k", "y", 10, 10).count() == 0


def test_training_rows(spark, table):
    docs = table([(1, "bb"), (1, "aa"), (1, "x" * 50), (2, "y" * 50), (3, None), (4, "c"), (5, "d")] + [(6, "same")] * 200)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (4, 1), (6, 1), (9, 1)], "doc_id long, label int")
    rows = grams.training(docs, "label", 10, 20, 10, "", labels=labels)
    assert sorted(map(tuple, rows.collect())) == [(1, "aa", 1), (3, "", 0), (6, "same", 1)]
    assert sorted(r.doc_id for r in grams.training(docs, "lang", 10, 20, 10, "", 1).collect()) == [1, 4, 5, 6]


def test_hashes_of_very_long_words_and_texts(monkeypatch):
    rng = random.Random(25)
    words = ["a" * n for n in (10, 63, 64, 65, 200, 1000)] + ["".join(rng.choice("abc") for _ in range(500))]
    want = tv.words(pa.array([" ".join(words)]))[0]
    monkeypatch.setattr(tv, "WINDOW", 64)
    assert (tv.words(pa.array([" ".join(words)]))[0] == want).all()
    text = "one. two; " * 30 + "z" * 300 + "." + "end"
    got = tv.cut(pa.array(["a.b", text, None, ""]), b".;")
    assert "".join(t for r, t in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True) if r == 1) == text
    assert got.column(0).to_pylist().count(1) > 3 and [r for r in got.column(0).to_pylist() if r != 1] == [0, 2, 3]


def test_very_long_texts_are_scored(spark, table):
    rng = random.Random(26)
    text = prose(rng, 2000)
    docs = table([(0, (text + " ") * 400), (1, text), (2, "q" * 3_000_000)])
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.fit(table([(1, text), (5, "| " * 50)]), labels), ["doc_id"]).collect()}
    assert len(got) == 3 and abs(got[0] - got[1]) < 1e-3
    assert toxicity.score(docs, toxicity.Grammar()).count() == 3
    langs = language.predict(docs, language.Model(["bcd ", "fgl "] * 4, ["en", "de"] * 4)).collect()
    assert len(langs) == 3 and len({r.lang_pred for r in langs if r.doc_id < 2}) == 1


def test_language_in_two_steps(spark, table, odd, empty):
    letters = {"en": "thwsh", "de": "schkz", "fr": "quxjv", "es": "ñllrr", "xx": "ppyyb"}
    rng = random.Random(1)
    docs = table([(i, prose(rng, 25, letters[lang]), lang) for i, lang in enumerate(list(letters) * 60)])
    model = language.fit(docs, grams.fold("doc_id", 3) != 1)
    assert model.families == ["germanic", "romance", "xx"] and model.members["romance"] == ["es", "fr"]
    got = docs.select("doc_id", "lang").join(language.predict(docs, model), "doc_id").where(grams.fold("doc_id", 3) == 1).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    by_id = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert by_id[0].lang_pred == by_id[1].lang_pred == by_id[3].lang_pred == "und" and by_id[0].score == 0 and by_id[8].lang_pred != "und"
    assert language.predict(empty, model).count() == 0 and language.predict(docs, language.fit(empty)).first().lang_pred == "und"


def test_texts_without_a_letter_have_no_language():
    model = language.Model(["thwsh thsh", "schkz schk"], ["en", "de"])
    none = ["123 – 456 €", "…", "\N{GRINNING FACE}\N{WHITE SMILING FACE}", "。", "\N{COMBINING ACUTE ACCENT}", "٣", "–", "", None, "12 !"]
    some = ["é", "日", "ж 1", "ª", "x", "– a", "ʰ", "ǅ"]
    got, score = model.predict(pa.record_batch({"text": pa.array(none + some)}))
    assert got[: len(none)] == ["und"] * len(none) and (score[: len(none)] == 0).all()
    assert set(got[len(none) :]) <= {"en", "de"} and (score[len(none) :] > 0).all()


def test_grammar():
    read = toxicity.reader()
    insult, at_target, heaped, negated, told, violence, intended, no_violence = range(8)
    assert read("...I..") == (insult,) and read("G..I") == read("I..G") == (insult, at_target) and read("EI") == read("I.I") == (insult, heaped)
    assert read("GEI") == (insult, at_target, heaped) and read("NI") == (negated,) and read("N....I") == (insult,) and read("R..I") == read("Q.I.Q") == (told,)
    assert read("V.G") == (violence,) and read("M..V.G") == (violence, intended) and read("V") == read("MV") == read("...") == () and read("NVG") == (no_violence,)
    assert toxicity.reader(("negation",))("NI") == (insult,) and toxicity.reader(("target",))("GI") == (insult,) and toxicity.reader(("threat",))("MVG") == (violence,)
    g = toxicity.Grammar()
    a, b, c, d, e = g.score(pa.array(["you are an IDIOT", "He said: you idiot", "you are not an idiot.", "a fine day", None]))
    assert a > b > d and a > c > d and d == e
    assert g.counts(pa.array(["nice. idiot"]))[0, 0] == 1
    for text in ("You don't idiot", "He isn't idiot", "He isn\N{RIGHT SINGLE QUOTATION MARK}t idiot", "you can\N{RIGHT SINGLE QUOTATION MARK}t idiot", "You cannot idiot"):
        assert g.counts(pa.array([text]))[0].tolist() == [0, 0, 0, 1, 0, 0, 0, 0], text
    assert g.counts(pa.array(["shirt idiot", "on' t idiot", "t idiot", "'t idiot", "n", "'t idiot"]))[:, 3].tolist() == [0] * 6
    assert g.counts(pa.array(["so \N{LEFT DOUBLE QUOTATION MARK}you idiot\N{RIGHT DOUBLE QUOTATION MARK}", "\N{LEFT-POINTING DOUBLE ANGLE QUOTATION MARK}idiot\N{RIGHT-POINTING DOUBLE ANGLE QUOTATION MARK} fool"])).tolist() == [[0, 0, 0, 0, 1, 0, 0, 0], [1, 0, 1, 0, 0, 0, 0, 0]]


def test_quotations_and_negations_that_reach_far():
    g = toxicity.Grammar()
    told, at_target, negated = [0, 0, 0, 0, 1, 0, 0, 0], [1, 1, 0, 0, 0, 0, 0, 0], [0, 0, 0, 1, 0, 0, 0, 0]
    left, right = "\N{LEFT SINGLE QUOTATION MARK}", "\N{RIGHT SINGLE QUOTATION MARK}"
    want = {
        'She said: "You are dumb. You are an idiot" and left': [2 * x for x in told],  # the quotation goes on over the clause
        'He wrote "nice. fine" you idiot': at_target,  # and has ended here
        f"{left}you are an idiot{right} is what he was told": told,
        "'you are an idiot' is what he was told": told,
        f"he didn{right}t know that you are an idiot": at_target,
        "the dogs' owner, you idiot, isn't here": at_target,
        '"he is \'an idiot\'" it read': told,
        "I do not think that you are an idiot": negated,
        "I think that you are an idiot": at_target,
        '6" long\nyou idiot': at_target,  # a mark that isn't closed ends with its line
        "'twas you idiot": at_target,
    }
    assert {t: g.counts(pa.array([t]))[0].tolist() for t in want} == want
    assert g.counts(pa.array(list(want))).tolist() == list(want.values())  # no row reaches into the next


def brute_paths(words):
    """Of a clause's (word, kind of word or None, whether it is between quotation marks), which paths it takes: by looking around each insult and violent verb."""
    found = []

    def denied(i):
        return any(words[j][0] == "N" and i - j <= 3 or words[j][0] == "K" and i - j <= 6 and denied(j) for j in range(max(0, i - 6), i))

    for i, (kind, quoted) in enumerate(words):
        near = lambda k, what, i=i: any((words[j][0] or "-") in what for j in range(max(0, i - k), i))
        if kind not in ("I", "V"):
            continue
        told = quoted or any(x == "R" for x, _ in words[:i])
        target = near(4, "G") or any(x == "G" for x, _ in words[i + 1 : i + 5])
        strong = near(2, "IE") if kind == "I" else near(4, "M")
        if denied(i):
            found.append((7, (3,)) if kind == "I" else (8, (7,)))
        elif told:
            found.append((6, (4,)) if kind == "I" else (8, (7,)))
        elif kind == "I":
            found.append((0, (0, 1, 2)) if target and strong else (1, (0, 1)) if target else (4, (0, 2)) if strong else (5, (0,)))
        elif target:
            found.append((2, (5, 6)) if strong else (3, (5,)))
    return min(found)[1] if found else ()


def test_grammar_equals_brute_force(monkeypatch):
    rng = random.Random(21)
    kinds = {w: k for k in toxicity._SYMBOLS[::-1] for w in toxicity.WORDS[k].split()}
    texts, want = [], []
    for _ in range(400):
        parts, counts = [], np.zeros(len(toxicity.PATHS))
        for _ in range(rng.randint(0, 5)):
            words = [rng.choice(list(kinds)) if rng.random() < 0.5 else "zu" for _ in range(rng.randint(1, 12))]
            at = rng.randrange(len(words)) if rng.random() < 0.2 else None
            quoted = [at is not None and at <= i < at + 3 for i in range(len(words))]
            spoken = [w if not q else ('"' + w if i == at else w) + ('"' if i == min(at + 2, len(words) - 1) else "") for i, (w, q) in enumerate(zip(words, quoted, strict=True))]
            parts.append(" ".join(spoken) + rng.choice(".!?;\n"))
            # A quotation mark takes the place of a word for the distances.
            seen = []
            for i, (w, q) in enumerate(zip(words, quoted, strict=True)):
                if i == at:
                    seen.append(("Q", False))
                seen.append((kinds.get(w), q))
                if at is not None and i == at + 2 and i + 1 < len(words):
                    seen.append(("Q", False))
            counts[list(brute_paths(seen))] += 1
        texts.append(" ".join(parts))
        want.append(counts)
    g = toxicity.Grammar()
    assert g.counts(pa.array(texts)).tolist() == np.array(want).tolist()
    monkeypatch.setattr(tv, "WINDOW", 40)
    whole = [" ".join(texts[i : i + 40]) for i in range(0, 400, 40)]
    assert g.counts(pa.array(whole)).tolist() == np.array(want).reshape(10, 40, -1).sum(axis=1).tolist()


def test_the_grammar_tells_what_words_alone_do_not():
    """Insults that are denied or quoted are as frequent in clean texts as plain ones in toxic texts."""
    rng = random.Random(22)
    bad, good = ["you are such an {}", "{} , you and they", "what a {}", "you {} , they {}"], ["you are not an {}", "he said you are an {}", "it isn't {} of you", 'the sign reads "{}" to you']
    texts, y = [], []
    for i in range(400):
        form = rng.choice(bad if i % 2 else good)
        insult = rng.choice(toxicity.WORDS["I"].split())
        texts.append(prose(rng, 12) + ". " + form.replace("{}", insult) + ". " + prose(rng, 12))
        y.append(i % 2)
    y = np.array(y, float)

    def errors(without):
        g = toxicity.Grammar(without=without)
        g.fit(g.counts(pa.array(texts[:200])), y[:200])
        return float(np.mean((g.score(pa.array(texts[200:])) >= 0.5) != y[200:]))

    assert errors(()) < 0.02 and errors(("negation", "reported")) > 0.1 and errors(tuple(toxicity.MACHINES)) > 0.3


def test_toxicity_learns_words(spark, table, odd, empty):
    rng = random.Random(2)
    bad = ["zorgal", "zorgum", "zorgit", "blaxt"]
    docs, labels = labelled(spark, table, "toxic", lambda r, y: prose(r, 30) + (f" {rng.choice(bad)} {rng.choice(bad)} " if y else " ") + prose(r, 10))
    grammar = toxicity.fit(docs, labels, grams.fold("doc_id", 4) != 2)
    got = toxicity.score(docs, grammar).where(grams.fold("doc_id", 4) == 2).collect()
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 2) for r in got]) > 0.97
    assert toxicity.score(odd, grammar).count() == odd.count() and toxicity.score(empty, grammar).count() == 0
    assert toxicity.score(table([(1, "unseen zorgex thing")]), grammar).first().score >= 0.3
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == docs.count()


def brute_bm25(index, h):
    """Scores of all items by the postings, without blocks or bounds."""
    t = index.term_ids(h)
    here = np.unique(t[t >= 0])
    out = np.zeros(len(index.ids))
    for x in here:
        s = slice(index.begin[x], index.begin[x + 1])
        np.add.at(out, index.post_item[s], index.impact[s])
    return out


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(3)
    words = prose(rng, 300).split()
    items = [(i, " ".join(rng.choices(words, k=rng.randint(5, 40)))) for i in range(60)]
    index = decontam.Index(items, 0.3)
    for _ in range(100):
        h = tv.words(pa.array([" ".join(rng.choices(words, k=80))]))[0]
        t = np.unique(index.term_ids(h))
        want = brute_bm25(index, h)
        got = dict(index.wand(t[t >= 0], set(range(index.blocks))))
        assert set(got) == set(np.flatnonzero(want >= 0.3 - 1e-9).tolist())
        assert all(abs(want[i] - s) < 1e-9 for i, s in got.items())


def test_decontamination(spark, table, odd, empty):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(12, 60))) for i in range(30)] + [(30, None), (31, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for i in range(120):
        text = prose(rng, rng.randint(1, 400)).split()
        if i % 4 == 0:
            at, item = rng.randint(0, len(text)), rng.randint(0, 29)
            text[at:at] = items[item][1].upper().split()
            want.add((i, item))
        rows.append((i, " ".join(text)))
    docs = table(rows)
    assert {(r.doc_id, r.item_id) for r in decontam.hits(docs, bench).collect()} == want
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.hits(odd, bench).count() == 0 and decontam.hits(empty, bench).count() == 0
    assert decontam.hits(docs, bench.limit(0)).count() == 0 and decontam.clean(odd, bench.limit(0)).count() == odd.count()


def brute_search(index, texts):
    """(row, item) of all hits, by the scores of all items against every passage."""
    out = set()
    for r, text in enumerate(texts):
        h = tv.words(pa.array([text]))[0]
        for level in index.levels:
            length = decontam.WIDTH * level.unit
            for lo in range(0, len(h), level.unit):
                scores = brute_bm25(index, h[lo : lo + length])
                around = h[max(0, lo - length) : lo + 2 * length]
                for i in np.flatnonzero(scores >= index.threshold - 1e-9).tolist():
                    if level.first <= index.block[i] < level.first + level.blocks and min(decontam.overlap(index.questions[i], around), decontam.overlap(index.answers[i], around)) >= decontam.OVERLAP:
                        out.add((r, int(index.ids[i])))
    return out


@pytest.mark.parametrize("cells", [1, 50, 1 << 20])
def test_search_equals_brute_force(monkeypatch, cells):
    monkeypatch.setattr(decontam, "CELLS", cells)
    rng = random.Random(10)
    vocab = list(dict.fromkeys(prose(rng, 400).split()))
    some = lambda n: " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(len(vocab))], k=n))
    items = [some(rng.choice([6, 15, 40, 90, 200])) + ("? " + some(2) if k % 3 == 0 else "") for k in range(60)]
    index = decontam.Index(list(enumerate(items)))
    rows = []
    for k in range(60):
        own = items[rng.randrange(60)].replace("?", "").split()
        for _ in range(rng.randint(0, len(own) // 3)):
            own[rng.randrange(len(own))] = rng.choice(vocab)
        rows.append(" ".join([some(rng.randint(0, 200)), *own, some(rng.randint(0, 200))]))
    want = brute_search(index, rows)
    assert {(r, i) for r, i, *_ in index.search(*tv.words(pa.array(rows)))} == want and len(want) > 20


def test_decontamination_bears_clashing_names(spark, table):
    rng = random.Random(11)
    item = prose(rng, 30)
    bench = spark.createDataFrame([(1, item, 5), (1, item, 6), (2, None, 7)], "item_id long, text string, doc_id long").withColumn("score", F.lit("x"))
    docs = table([(7, item + " and more"), (7, item), (8, "nothing of it"), (None, item)]).withColumn("item_id", F.lit("clash"))
    assert sorted((r.doc_id or 0, r.item_id) for r in decontam.hits(docs, bench).collect()) == sorted([(7, 1), (7, 1), (0, 1)] * 2)
    left = decontam.clean(docs, bench)
    assert left.columns == docs.columns and [(r.doc_id, r.item_id) for r in left.collect()] == [(8, "clash")]


def test_several_passes_over_a_large_benchmark(spark, table, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, 30)) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table([(i, prose(rng, 50) + " " + items[i][1]) for i in range(20)])
    monkeypatch.setattr(decontam, "INDEX_BYTES", 500)
    assert len(list(decontam.passes(bench))) > 3
    assert {(r.doc_id, r.item_id) for r in decontam.hits(docs, bench).collect()} == {(i, i) for i in range(20)}
    assert decontam.clean(docs, bench).count() == 0


def test_short_questions_and_answers_are_found(spark, table):
    rng = random.Random(7)
    questions = [prose(rng, 9) for _ in range(6)]
    texts = [f"{questions[0]} ? Bedu", f"{questions[1]} Answer: Bedu cora", f"{questions[2]}? b", f"Q: {questions[3]}?Bedu", "Why bolu? " + prose(rng, 12), "Bolu? " + prose(rng, 8)]
    texts += [prose(rng, n) for n in (4, 5, 6)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(i, prose(rng, 70) + f" {t.upper()} " + prose(rng, 50)) for i, t in enumerate(texts)]
    other = [(100 + i, f"{q}? " + prose(rng, 60, "vwxz")) for i, q in enumerate(questions[:3])]
    docs = table(rows + other)
    want = {(i, i) for i in range(len(texts))}
    # Brute force: the copied runs of words, whole.
    for i, text in rows:
        assert {k for k, t in enumerate(texts) if f" {t.lower()} " in f" {text.lower()} "} == {i}
    assert {(r.doc_id, r.item_id) for r in decontam.hits(docs, bench).collect()} == want
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {i for i, _ in other}


def test_long_items_are_found():
    rng = random.Random(8)
    vocab = list(dict.fromkeys(prose(rng, 6000).split()))
    zipf = [1 / (k + 1) for k in range(len(vocab))]

    def some(n):
        return " ".join(rng.choices(vocab, weights=zipf, k=n))

    items = [some(n) for n in (5, 64, 65, 100, 128, 129, 160, 200, 300, 500, 1000, 1024, 1025, 3000) for _ in range(3)]
    index = decontam.Index(list(enumerate(items)))
    rows = [some(rng.randint(0, 300)) + " " + t + " " + some(rng.randint(0, 300)) for t in items] + [some(4000), items[-1][: len(items[-1]) // 3]]
    found = {(r, i) for r, i, *_ in index.search(*tv.words(pa.array(rows)))}
    assert found == {(i, i) for i in range(len(items))}
    alone = {(r, i) for r, i, *_ in index.search(*tv.words(pa.array(items)))}
    assert alone == {(i, i) for i in range(len(items))}


def test_scores_do_not_depend_on_the_passes(spark, table, monkeypatch):
    rng = random.Random(31)
    items = [(i, prose(rng, 25) + "? " + prose(rng, 8)) for i in range(60)]

    def altered(text):
        return " ".join(w if rng.random() < 0.85 else prose(rng, 1) for w in text.split())

    docs = table([(i, prose(rng, 20) + " " + altered(t) + " " + prose(rng, 20)) for i, t in items] + [(100 + i, prose(rng, 60)) for i in range(20)])
    bench = spark.createDataFrame([*items, (60, None), (61, " ")], "item_id long, text string")
    one = {(r.doc_id, r.item_id): round(r.score, 12) for r in decontam.hits(docs, bench).collect()}
    monkeypatch.setattr(decontam, "INDEX_BYTES", 1500)
    assert len(list(decontam.passes(bench))) > 5
    assert {(r.doc_id, r.item_id): round(r.score, 12) for r in decontam.hits(docs, bench).collect()} == one and len(one) > 30
