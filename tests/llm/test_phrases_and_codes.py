"""Collocations, suffix dedup and vector codes against brute force, of odd rows, long texts and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_texts import prose

from tidemark.llm import bits, codes, collocation, suffixes, vectors

# Collocations ---------------------------------------------------------------------------------------------------------


def brute_collocations(rows, max_n=3, least=10, percent=50, most=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, max_n + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    longer = defaultdict(int)
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    out = defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * longer[lang, w] >= percent * a:
            continue
        score, _, l, r = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))  # noqa: E741
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:most])}  # noqa: E741


def corpus(seed, rows=300):
    rng = random.Random(seed)
    words = ["a", "b", "the", "The", "É", "x\x01y", "x", "\x00", "long" * 9, " "]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"]
    out = [("".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(rows)]
    return [*out, (None, "en"), ("", "fr"), (" .,", "fr"), ("one", "it"), *[("of the end of the end of the end", "en")] * 12]


def got_collocations(spark, rows, **settings):
    df = spark.createDataFrame([(i, t, x, 1, "c") for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, n long, word string")
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocation.collocations(df, **settings).collect()}


def test_collocations_equal_brute_force(spark):
    rows = corpus(1)
    want = brute_collocations(rows)
    assert got_collocations(spark, rows) == want and len(want) > 100
    assert got_collocations(spark, rows, max_n=4, least=3, percent=80, most=20) == brute_collocations(rows, 4, 3, 80, 20)


def test_collocations_of_long_texts_and_hot_words(spark, monkeypatch):
    """Texts that are read in windows, in which words and phrases cross the bounds, and a word that holds a third of all."""
    rng = random.Random(2)
    rows = [((t or "") + " the" * rng.randint(0, 30) + " " + "q" * 300, x) for t, x in corpus(3, 60)]
    rows.append((" ".join(rng.choice(["the", "end", "of", "x" * 70]) for _ in range(3000)), "en"))
    monkeypatch.setattr(collocation, "SEGMENT", 100)
    assert got_collocations(spark, rows) == brute_collocations(rows)
    for most in (7, 64, 1 << 20):
        tokens = list(collocation.tokens(pa.array([r[0] for r in rows]), 2, most))
        assert sum(int(t.own.sum()) for t in tokens) == sum(len([w for w in re.split(r"[\x20\x09.,;:!?\x0A-\x0D]+", t or "") if w]) for t, _ in rows)


def test_collocations_of_nothing(spark, odd, empty):
    assert collocation.collocations(empty).count() == 0
    assert collocation.collocations(odd).count() == 0
    assert collocation.collocations(odd.withColumn("rank", F.lit("clash")), least=1).count() > 0


def test_scores_are_exact(spark):
    big = 3_037_000_507  # its square passes 63 bits
    found = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 2), ("en", "a b", 2, big - 1)], "lang string, phrase string, k int, n long")
    r = collocation.scored(found).collect()[0]
    assert r.score == 1000000 * (big - 1) ** 2 // (big * (big + 2)) and (r.a, r.l, r.r) == (big - 1, big, big + 2)


def test_a_filter_holds_back_nothing_it_was_given(spark):
    keys = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 3000)
    known = bits.filter_of(spark.createDataFrame([(int(k),) for k in keys[:1500]], "key long"))
    assert known.has(keys[:1500].view(np.uint64)).all() and known.has(keys[1500:].view(np.uint64)).mean() < 0.01
    assert not bits.filter_of(spark.createDataFrame([], "key long")).has(keys.view(np.uint64)).any()


# Suffix dedup ---------------------------------------------------------------------------------------------------------


def brute_spans(rows, least):
    """Of (key, text), in order: bytes, removed bytes, spans and the kept bytes."""
    seen, out = set(), {}
    for key, text in sorted({(k, t or "") for k, t in rows}, key=lambda x: x[0]):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - least + 1):
            if data[i : i + least] in seen:
                gone[i : i + least] = True
            seen.add(data[i : i + least])
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out[key] = (len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes())
    return out


def shared_texts(seed, n=80, letters="ab é"):
    rng = random.Random(seed)
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 90))) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for i in range(n)]
    rows += [(100 + i, rows[i % 5][1]) for i in range(30)]  # copies
    rows += [(200, "z" * 500), (201, "z" * 300), (202, "xyz" * 200), (203, "zzz" + "xyz" * 50), (204, None), (205, ""), (206, "ß" * 99)]
    return rows


@pytest.mark.parametrize(("least", "grams", "hot"), [(20, (4, 12, 20), 3), (20, (20,), 1000), (33, (7, 33), 2), (100, None, 20_000)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, least, grams, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)  # small: anchors of many rows are split over longer grams
    if grams:
        monkeypatch.setattr(suffixes, "GRAMS", grams)
    rows = shared_texts(least)
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, bytes string, doc int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup(docs, least=least).collect()}
    assert got == brute_spans(rows, least)
    digests = {r.doc_id: r.kept_sha256 for r in suffixes.dedup(docs, least=least, digests=True).collect()}
    assert digests == {k: hashlib.sha256(v[3]).hexdigest() for k, v in got.items()}


def test_suffix_dedup_in_small_pieces(spark, monkeypatch):
    """Texts longer than a piece, and groups of rows that are sorted a few at a time."""
    monkeypatch.setattr(suffixes, "PIECE", 150)
    monkeypatch.setattr(suffixes, "ROWS", 10)
    rows = [(k, t) for k, t in shared_texts(5)] + [(300, " ".join(t for _, t in shared_texts(5) if t))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup(docs, least=25).collect()}
    assert got == brute_spans(rows, 25)


def test_suffix_dedup_of_odd_rows(spark, odd, empty):
    assert suffixes.dedup(empty).count() == 0
    out = suffixes.dedup(odd).collect()
    assert len(out) == odd.count() and {r.n_removed for r in out if (r.n_bytes or 0) < 100} == {0}
    long = next(r for r in out if r.n_bytes == 50_000)
    assert long.n_removed == 49_999 and long.n_spans == 1 and (long.begins, long.ends) == ([1], [50_000])
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    twice = spark.createDataFrame([(1, text), (1, text), (1, text + "x"), (None, text), (None, None), (2, text)], "doc_id long, text string")
    removed = sorted(((r.doc_id or 99), r.n_removed) for r in suffixes.dedup(twice).collect())
    # Rows that are equal are one document; of two versions of one document the one whose text's hash is smaller stays.
    one = [r for d, r in removed if d == 1]
    assert sorted(one) in ([0, 0, 300], [0, 300, 300]) and [r for d, r in removed if d == 2] == [300] and sorted(r for d, r in removed if d == 99) == [0, 300]


def test_suffixes_are_sorted_whatever_their_hashes(monkeypatch):
    rng = random.Random(8)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(400)).encode(), np.uint8)
    begin = np.array(rng.sample(range(380), 120))
    size = np.array([rng.randint(0, 20) for _ in begin])
    group = np.sort(np.array([rng.randint(0, 5) for _ in begin]))
    strings = [data[b : b + n].tobytes() for b, n in zip(begin, size, strict=True)]

    def check():
        found = suffixes.Suffixes(suffixes.Hashed(data), begin, size, group)
        for g in range(6):
            own = np.flatnonzero(group == g)
            order = found.order[own]
            assert sorted(order.tolist()) == own.tolist() and [strings[i] for i in order] == sorted(strings[i] for i in own)
        for least in range(6):
            kind = found.classes(least)
            for i in range(len(begin)):
                for j in range(i):
                    if size[i] >= least and size[j] >= least:
                        assert (kind[i] == kind[j]) == (group[i] == group[j] and strings[i][:least] == strings[j][:least])

    check()
    monkeypatch.setattr(suffixes, "_BYTE", np.ones(256, np.uint64))  # all strings of one length collide
    check()


# Vector codes ---------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [int(math.floor(x * 1024)) if abs(x) < 1e15 else int(x) * 1024 for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in sorted(kept)[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(own[k]) for x in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    found = [(i, y, [nearest(cut(v, p), books[p]) for p in range(parts)]) for i, v, y in kept]
    error = {n: sum(d for d, _ in f) for n, (_, _, f) in enumerate(found)}
    by_label = defaultdict(int)
    for n, (_, y, _) in enumerate(found):
        by_label[y] += error[n]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in f), error[n], by_label[y], digest) for n, (i, y, f) in enumerate(found))


def got_codes(spark, rows, kind="double"):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, error int").repartition(3)
    return sorted((r.vec_id, bytes(r.code).hex(), r.error, r.label_error, r.codebooks_sha256) for r in codes.compressed(df).collect())


@pytest.mark.parametrize("scale", [1.0, 0.002, 1e6, 1e13, 3e30])
def test_codes_equal_brute_force(spark, monkeypatch, scale):
    """From components that make ties to such that pass 64 bits."""
    monkeypatch.setattr(codes, "ENTRIES", 40)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8) * scale], int(rng.integers(3)) if i % 7 else None) for i in range(150)]
    rows += [(200 + i, rows[i][1], 1) for i in range(20)] + [(300, None, 1), (301, [float("nan")] + [0.0] * 7, 1), (302, [None] + [0.0] * 7, 1), (303, [float("-inf")] + [0.0] * 7, 1), (304, [0.0] * 8, 2)]
    want = brute_codes(rows, entries=40)
    assert got_codes(spark, rows) == [(i, c, min(e, (1 << 63) - 1), min(y, (1 << 63) - 1), d) for i, c, e, y, d in want]


def test_the_tree_finds_what_all_distances_find():
    rng = np.random.default_rng(6)
    for entries in (rng.integers(-50, 50, (256, 3)), np.zeros((256, 3), np.int64), rng.integers(0, 2, (200, 4)), rng.normal(size=(256, 2)).cumsum(axis=0).astype(np.int64) * 100):
        search = codes.Search(entries)
        q = np.concatenate([rng.integers(-60, 60, (300, entries.shape[1])), entries])
        at, best = search.nearest(q)
        d = ((q[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        assert search.met <= d.size
    assert search.met < d.size / 2  # entries along a line


def test_codes_of_odd_rows(spark):
    rows = [(None, [1.0] * 8, None), (5, [2.0] * 8, None), (5, [3.0] * 8, 1), (6, [1.0] * 4, 1), (7, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(codes.compressed(df).collect(), key=lambda r: (r.vec_id or 99, r.code is None, r.code))
    assert [(r.vec_id, r.code and bytes(r.code).hex(), r.error) for r in got] == [(5, "00000000", 0), (5, "01010101", 0), (6, None, None), (7, None, None), (None, "02020202", 0)]
    assert codes.compressed(df.limit(0)).count() == 0
    assert {r.code for r in codes.compressed(df.where("vec_id = 7")).collect()} == {None}


# Embedding near-dedup -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ids", [1, 7, 40_000])
def test_links_do_not_depend_on_how_ids_repeat(spark, ids):
    """20,000 vectors, pairs of near ones: all under one id, under few, under ids of their own."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(10_000, 16))
    both = np.concatenate([x, x + rng.normal(size=x.shape) * 0.02])
    table = pa.table({"vec_id": np.arange(len(both)) % ids, "embedding": pa.FixedSizeListArray.from_arrays(pa.array(both.reshape(-1)), 16).cast(pa.list_(pa.float64()))})
    links = vectors.links(spark.createDataFrame(table.to_pandas())).agg(F.sum("n_links")).first()[0]
    assert 20_000 * 0.97 <= links <= 20_100
