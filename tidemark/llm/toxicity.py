"""Toxicity by a weighted finite-state pattern grammar.

A clause (words up to . ! ? ; or a line end) is read as a string of symbols: insult,
violent verb, intensifier, intent, target, negation, verb of opinion, reported speech,
quotation mark, other. A quotation goes on over clauses until its mark closes or the line ends. Transducers composed over it rewrite the insults and violent verbs. The insult
machine marks an insult that follows an intensifier or another insult as heaped; the
threat machine marks a violent verb that follows a word of intent as a threat; one
machine marks those within NEGATION words after a negation (twice as many after a negated
verb of opinion), one those after a verb of speech or between quotation marks, two (left to right, right to left) those within
TARGET words of a target. What comes out of a clause is its strongest symbol, which
stands for a path through the machines and counts for the PATHS that it took; a
document's score is a logistic function of how many clauses took each path. A violent
verb without a target gives nothing.

The weights of the paths and part of the lexicon are learned: from at most EACH labelled
documents of each class, drawn from those of LONGEST characters at most (the documented
bound), words and word beginnings of 4 to 6 bytes that toxic documents have and others
hardly ever do are chosen greedily until each toxic document holds COVER of them; near
copies count once in that. Weights start from the grammar's own and are fitted by
gradient descent, all in one task of an executor. Scoring reads whole texts.

Words are runs of letters, with one exception: the `t` after an apostrophe and an n
(don't, isn't) is read as a negation. Single quotation marks, curled or straight, count in pairs
within a line, an opening one before and a closing one not before a letter; others are apostrophes.

Defined results: a null or empty text has no clause and gets the bias's score. Without
labels the grammar's own weights and fixed words decide. Ids whose labels differ don't
train; of texts that repeat an id the smallest trains; all rows are scored. Ties: of words
that as many toxic documents hold, whole words come first, then longer beginnings, then
the smaller hash. A very long text is cut at clause ends and read in windows, where a quotation ends, too. Only doc_id
and text are read (of labels doc_id and toxic), so other columns can't clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import grams
from tidemark.llm import textvec as tv
from tidemark.llm.session import lean

EACH = 5000
LONGEST = 20_000
COVER = 3
LEAST = 5
NEGATION, TARGET, HEAPED, INTENT = 3, 4, 2, 4
BEGINNINGS = (4, 5, 6)
ENDS = b".!?;\n"

# The grammar's own words by symbol: insults, violent verbs, targets, negations, verbs of speech, intensifiers, intent, verbs of opinion.
WORDS = {
    "I": "bastard clown creep cretin dimwit disgusting dumb dumbass fool freak garbage idiot idiotic imbecile jerk loser lunatic moron moronic pathetic pig rat scum stupid trash vermin worthless "
    "arschloch blödmann depp dreckig dummkopf trottel abschaum connard crétin débile imbécile salaud ordure basura cabrón estúpido gilipollas idiota imbécil inútil",
    "V": "kill hurt murder stab shoot destroy strangle töten umbringen erschießen verletzen tuer frapper égorger matar golpear",
    "G": "you your yours yourself u he she they them him du dich dir euch ihr tu toi te vous tú ti usted ustedes",
    "N": "not never no none cannot nicht kein keine nie niemals ne pas jamais nunca jamás tampoco",
    "R": "said says say claims claimed wrote writes reported quoted called alleged sagte sagt behauptet schrieb dit disait affirme dijo dice afirma",
    "E": "such total complete utter absolute fucking bloody damn so völlig total absolut verdammt tellement complètement sacré tan completo maldito",
    "M": "will ll gonna going shall should must want hope werde werden soll muss vais va doit faut voy vas debe quiero",
    "K": "think believe feel suppose consider mean suggest imply denke glaube finde meine pense crois trouve pienso creo considero",
}
_SYMBOLS = "IVGNREMK"  # an earlier symbol wins over a later one

# The paths that clauses are counted for, and the weight of log(1 + clauses) for each before any fitting.
PATHS = {"insult": 4.0, "insult at target": 1.0, "insult heaped": 0.5, "insult negated": 0.5, "insult reported": 1.0, "violence at target": 3.0, "violence intended": 1.0, "violence negated or reported": 0.5}
BIAS = -3.0

Machine = Callable[[int, str], tuple[int, str]]


def insult(state: int, symbol: str) -> tuple[int, str]:
    """I becomes S (heaped) behind an intensifier or another insult."""
    out = "S" if symbol == "I" and state else symbol
    return (HEAPED if symbol in "IE" else max(0, state - 1)), out


def threat(state: int, symbol: str) -> tuple[int, str]:
    """V becomes T behind a word of intent."""
    out = "T" if symbol == "V" and state else symbol
    return (INTENT if symbol == "M" else max(0, state - 1)), out


def negation(state: int, symbol: str) -> tuple[int, str]:
    out = {"I": "i", "S": "i", "V": "t", "T": "t"}.get(symbol, symbol) if state else symbol
    return (max(NEGATION, state - 1) if symbol == "N" else 2 * NEGATION if symbol == "K" and state else max(0, state - 1)), out


def reported(state: int, symbol: str) -> tuple[int, str]:
    """State bit 1: after a verb of speech; bits 0 and 2: between double and single quotation marks."""
    out = {"I": "J", "S": "J", "V": "t", "T": "t"}.get(symbol, symbol) if state else symbol
    return (state | 2 if symbol == "R" else state ^ 1 if symbol == "Q" else state ^ 4 if symbol == "q" else state), out


def target(state: int, symbol: str) -> tuple[int, str]:
    out = {"I": "A", "S": "Z", "V": "B", "T": "C"}.get(symbol, symbol) if state else symbol
    return (TARGET if symbol == "G" else max(0, state - 1)), out


MACHINES = {"insult": insult, "threat": threat, "negation": negation, "reported": reported, "target": target}


def compose(*machines: Machine) -> Callable[[str], str]:
    """Each machine's output feeds the next one, symbol by symbol."""

    def apply(symbols: str) -> str:
        states, out = [0] * len(machines), []
        for s in symbols:
            for k, machine in enumerate(machines):
                states[k], s = machine(states[k], s)
            out.append(s)
        return "".join(out)

    return apply


# What a clause may amount to, strongest first, and the numbers of the PATHS that it then counts for.
_STRONGEST = {"Z": (0, 1, 2), "A": (0, 1), "C": (5, 6), "B": (5,), "S": (0, 2), "I": (0,), "J": (4,), "i": (3,), "t": (7,)}


def reader(without: tuple[str, ...] = ()) -> Callable[[str], tuple[int, ...]]:
    """From a clause's symbols to the numbers of its paths, by the composition of all machines but those named."""
    forward = compose(*(m for name, m in MACHINES.items() if name not in without))
    backward = compose(*(() if "target" in without else (target,)))

    def read(symbols: str) -> tuple[int, ...]:
        found = backward(forward(symbols)[::-1])
        return next((paths for s, paths in _STRONGEST.items() if s in found), ())

    return read


def _hash(words: list[str]) -> np.ndarray:
    data, offsets = tv.buffers(pa.array([" ".join(words)]))
    return tv.hash_spans(data, *tv.spans(data, offsets))


# Bytes of the quotation marks and apostrophes of more than one byte.
_CURLED = {b"\xe2\x80\x98": 39, b"\xe2\x80\x99": 39, b"\xe2\x80\x9c": 34, b"\xe2\x80\x9d": 34, b"\xc2\xab": 34, b"\xc2\xbb": 34}


class Text:
    """The words of a slice of documents: letter runs in lower case, with their clauses. In `data` curled marks are straight ones and spaces."""

    def __init__(self, column: pa.Array):
        data, offsets = tv.buffers(column)
        data = data.copy()
        self.curled = np.zeros(len(data), bool)
        for mark, plain in _CURLED.items():
            n = len(mark)
            at = np.flatnonzero(data[: max(0, len(data) - n + 1)] == mark[0])
            for k in range(1, n):
                at = at[data[at + k] == mark[k]]
            for k in range(n):
                data[at + k] = plain if k == n - 1 else 32
            self.curled[at + n - 1] = True
        self.clean = grams.letters(data)
        self.starts, self.ends = tv.spans(self.clean, offsets)
        self.hashes = tv.hash_spans(self.clean, self.starts, self.ends)
        self.bounds = tv.rows_of(self.starts, offsets)
        self.data, self.offsets = data, offsets
        self.single = self._single()

    def _single(self) -> np.ndarray:
        """Where single quotation marks stand in pairs: an opening mark whose next mark in its line is a closing one, and that one."""
        out = np.zeros(len(self.data), bool)
        at = np.flatnonzero(self.data == 39)
        if not len(at):
            return out
        spaced = np.append(self.clean, 32)  # no letter behind the end
        last = self.offsets[np.searchsorted(self.offsets, at, "right") - 1]
        back = at - 1
        for _ in range(2):  # a curled mark has spaces of its own before it
            back = np.where((back >= last) & (self.data[np.maximum(back, 0)] == 32) & self.curled[at], back - 1, back)
        before = np.where(back >= last, spaced[back], 32) != 32
        after = (spaced[at + 1] != 32) & ~np.isin(at + 1, self.offsets)
        opens, closes = ~before & after, ~after
        kept = opens | closes
        at, opens = at[kept], opens[kept]
        line = np.cumsum(self.data == 10)[at] + np.searchsorted(self.offsets, at, "right")
        first = np.flatnonzero(opens[:-1] & ~opens[1:] & (line[1:] == line[:-1]))
        out[at[first]] = out[at[first + 1]] = True
        return out

    def contracted(self) -> np.ndarray:
        """Whether each word is the t of a negation such as don't."""
        at = np.flatnonzero((self.ends - self.starts == 1) & (self.clean[self.starts] == 116) & (self.starts > 1))
        before = self.starts[at] - 1
        ok = (self.data[before] == 39) & (before > self.offsets[np.searchsorted(self.offsets, self.starts[at], "right") - 1])
        at, before = at[ok], before[ok] - 1
        for _ in range(2):  # a curled apostrophe has spaces before it
            before = np.where((self.data[before] == 32) & (before > 0), before - 1, before)
        out = np.zeros(len(self.starts), bool)
        out[at[self.clean[before] == 110]] = True
        return out

    def beginnings(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word, 0 where it is no longer."""
        long = np.flatnonzero(self.ends - self.starts > n)
        out = np.zeros(len(self.starts), np.uint64)
        out[long] = tv.hash_spans(self.clean, self.starts[long], self.starts[long] + n)
        return out


class Grammar:
    def __init__(self, insults: dict[int, np.ndarray] | None = None, without: tuple[str, ...] = ()):
        """insults: learned hashes by length of the word beginning, 0 for whole words. without: names of machines to leave out."""
        insults = insults or {}
        whole = {s: _hash(WORDS[s].split()) for s in WORDS}
        self.whole = {s: np.unique(np.concatenate([whole[s], insults.get(0, np.empty(0, np.uint64))]) if s == "I" else whole[s]) for s in _SYMBOLS}
        self.begin = {n: np.unique(x) for n, x in insults.items() if n and len(x)}
        self.weights, self.bias = np.array(list(PATHS.values())), BIAS
        self.without = without

    def symbols(self, text: Text) -> np.ndarray:
        """For each word the number of its symbol in _SYMBOLS, or -1."""
        out = np.full(len(text.hashes), -1, np.int8)

        def mark(h: np.ndarray, known: np.ndarray, k: int) -> None:
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                out[(known[at] == h) & (out < 0)] = k

        mark(text.hashes, self.whole["I"], 0)
        for n, known in self.begin.items():
            mark(text.beginnings(n), known, 0)
        for k, s in enumerate(_SYMBOLS[1:], 1):
            mark(text.hashes, self.whole[s], k)
        out[text.contracted() & (out < 0)] = _SYMBOLS.index("N")
        return out

    def counts(self, column: pa.Array) -> np.ndarray:
        """Rows by PATHS: how many clauses took each. Long texts are read in pieces, cut where clauses end."""
        out = np.zeros((len(column), len(PATHS)))
        for part in tv.slices(tv.cut(column, ENDS)):
            np.add.at(out, np.asarray(part.column(0)), self._counts(part.column(1)))
        return out

    def _counts(self, column: pa.Array) -> np.ndarray:
        text = Text(column)
        out = np.zeros((len(column), len(PATHS)))
        code = self.symbols(text)
        hits = np.flatnonzero((code == 0) | (code == 1))
        if not len(hits):
            return out
        stop = np.isin(text.data, np.frombuffer(ENDS, np.uint8))
        clause = np.cumsum(stop)[text.starts]
        row = np.repeat(np.arange(len(column)), np.diff(text.bounds))
        clause = clause + row.astype(np.int64)  # a new row begins a new clause, and both numbers ascend
        fresh = np.flatnonzero(np.diff(clause, prepend=-1) | np.diff(row, prepend=-1))
        # Marks since the line of each clause began, or its row, so that a quotation goes on over clauses.
        lines = np.flatnonzero(text.data == 10)
        before = np.searchsorted(lines, text.starts[fresh])
        begin = np.maximum(np.append(lines, -1)[before - 1] + 1, text.offsets[row[fresh]])
        marks = {}
        for symbol, where in (("Q", text.data == 34), ("q", text.single)):
            total = np.concatenate([[0], np.cumsum(where)])
            marks[symbol] = total[begin].tolist(), total[text.starts]
        first = np.unique(np.searchsorted(fresh, hits, "right") - 1)
        ends = np.append(fresh[1:], len(clause))
        read = reader(self.without)
        for c in first.tolist():
            a, b = int(fresh[c]), int(ends[c])
            symbols = []
            double, single = marks["Q"][0][c], marks["q"][0][c]
            for x, two, one in zip(code[a:b].tolist(), marks["Q"][1][a:b].tolist(), marks["q"][1][a:b].tolist(), strict=True):
                symbols += ["Q"] * ((two - double) % 2) + ["q"] * ((one - single) % 2)
                double, single = two, one
                symbols.append(_SYMBOLS[x] if x >= 0 else ".")
            out[row[a], list(read("".join(symbols)))] += 1
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log1p(self.counts(column)) @ self.weights + self.bias, -30, 30)))

    def fit(self, counts: np.ndarray, y: np.ndarray, rounds: int = 1500, rate: float = 0.5, pull: float = 0.002) -> None:
        """Logistic regression by gradient descent, pulled towards the grammar's own weights."""
        x, w0 = np.log1p(counts), self.weights.copy()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(x @ self.weights + self.bias)))
            self.weights = self.weights - rate * (x.T @ (p - y) / len(y) + pull * (self.weights - w0))
            self.bias -= rate * float((p - y).mean())


def _copies(words: list[np.ndarray]) -> np.ndarray:
    """For each text the first one that looks like a copy of it, by any of four pairs of smallest word hashes."""
    parent = np.arange(len(words))
    seen: dict[tuple, int] = {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, w in enumerate(words):
        for salt in range(4):
            if len(w) < 8:
                continue
            h = tv.mix(w + np.uint64(salt * 7919 + 1))
            key = (salt, *np.sort(np.partition(h, 2)[:3]).tolist())
            a, b = root(i), root(seen.setdefault(key, i))
            parent[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(len(words))])


def _sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Of each text its different word beginnings of n bytes (0: whole words), as hashes."""
    out = []
    for at in range(0, len(texts), 200):
        read = Text(pa.array(texts[at : at + 200]))
        h = read.beginnings(n) if n else read.hashes
        out += [np.unique(h[a:b]) for a, b in zip(read.bounds[:-1], read.bounds[1:], strict=True)]
    return out


def learn_words(texts: list[str], y: np.ndarray) -> dict[int, np.ndarray]:
    """Insults that the labels show: by length of word beginning (0: whole words), hashes."""
    first = _copies(_sets(texts, 0))
    own = [i for i in range(len(texts)) if first[i] == i or y[i] != y[first[i]]]
    bad = [i for i in own if y[i] == 1]
    good = [i for i in own if y[i] == 0]
    holders: dict[tuple[int, int], np.ndarray] = {}
    for n in (0, *BEGINNINGS):
        sets = _sets(texts, n)
        pos = [sets[i] for i in bad]
        neg = np.concatenate([sets[i] for i in good]) if good else np.empty(0, np.uint64)
        flat, doc = (np.concatenate(pos), np.repeat(np.arange(len(bad)), [len(p) for p in pos])) if bad else (np.empty(0, np.uint64), np.empty(0, int))
        names, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
        other, odf = np.unique(neg, return_counts=True)
        at = np.minimum(np.searchsorted(other, names), max(len(other) - 1, 0))
        against = np.where(other[at] == names, odf[at], 0) if len(other) else np.zeros(len(names), int)
        ok = (df >= LEAST) & (against * 20 * len(bad) <= df * len(good)) & (against * 50 <= df) & (names != 0)
        order = np.argsort(inverse, kind="stable")
        order = order[ok[inverse[order]]]
        if len(order):
            for docs in np.split(order, np.flatnonzero(np.diff(inverse[order])) + 1):
                holders[n, int(names[inverse[docs[0]]])] = doc[docs]
    need = np.full(len(bad), COVER)
    heap = [(-len(d), -(n or 99), n, h) for (n, h), d in holders.items()]
    heapq.heapify(heap)
    chosen: dict[int, list[int]] = {}
    while heap:
        gain, size, n, h = heapq.heappop(heap)
        docs = holders[n, h]
        now = int((need[docs] > 0).sum())
        if now < LEAST:
            continue
        if now < -gain:
            heapq.heappush(heap, (-now, size, n, h))
            continue
        chosen.setdefault(n, []).append(h)
        need[docs] -= 1
    return {n: np.array(x, np.uint64) for n, x in chosen.items()}


def train(texts: list[str], y: np.ndarray, without: tuple[str, ...] = ()) -> Grammar:
    grammar = Grammar(learn_words(texts, y), without)
    if len(y) and y.min() < y.max():
        grammar.fit(np.concatenate([grammar.counts(pa.array(texts[i : i + 200])) for i in range(0, len(texts), 200)]), y)
    return grammar


def fit(documents: DataFrame, labels: DataFrame, where=None, each: int = EACH) -> Grammar:
    known = labels.where(where) if where is not None else labels
    known = known.select("doc_id", F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1))
    rows = grams.training(documents, "label", each, 2 * each, LONGEST, "toxicity", labels=known)
    return grams.in_one_task(rows, lambda t: train(t.column("text").to_pylist(), t.column("label").to_numpy().astype(float)) if t else train([], np.empty(0)))


def score(documents: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score."""
    lean(documents.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grammar.score(part.column(1)))], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")


def run(spark, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(documents, fit(documents, labels, grams.fold("doc_id", 4) != 2))
    return scored.select("doc_id", (grams.fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
