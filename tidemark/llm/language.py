"""Language identification by hierarchical discrimination.

A first layer tells language families apart, a second one the languages within the
family. Both are one-versus-one linear support vector machines over hashed character
grams (2 to 4 bytes, lower case, ASCII letters and all longer characters) and predict by votes, ties by summed
margins. Trained by averaged sub-gradient descent in numpy on at most EACH documents
a language and TOTAL in all, drawn from those of LONGEST characters at most; scoring reads
whole texts. Training is one task of an executor.

Defined results: `und` with score 0 where the text is null or has no letter (Unicode
category L; or no language was learned). The score is the logistic value of the smallest
margin that the winner had, families and languages together. Ties: of languages equal in
votes and margins the first by name. Ids whose rows differ in language don't train; of
texts that repeat an id the smallest trains; all rows are scored. A very long text is
scored in windows and takes a few bytes for each of its own. Only doc_id, text and (for
training) lang are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import grams
from tidemark.llm import textvec as tv
from tidemark.llm.session import lean

BITS = 16
ORDERS = (2, 3, 4)
EACH = 1200
TOTAL = 12_000
LONGEST = 20_000
EPOCHS = 6

# Members of language families, by ISO 639-1 code. Any other code is a family by itself.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "pa", "ur"],
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def _features(text: str) -> np.ndarray:
    clean = grams.letters(tv.buffers(pa.array([text]))[0])
    return np.concatenate([grams.buckets(clean, n, BITS) for n in ORDERS])


def _machine(docs: list, y: np.ndarray, seed: int) -> np.ndarray:
    """Weights of a linear machine for y = +1 or -1; the last one is the bias."""
    rng = np.random.default_rng(seed)
    w, mean = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            step += 1
            ids, share = grams.unpacked(docs[i])
            margin = y[i] * (share @ w[ids] + w[-1])
            if margin < 1:
                rate = 1 / (1 + 0.002 * step)
                w[ids] += rate * y[i] * share / (share @ share)
                w[-1] += 0.05 * rate * y[i]
        mean += w
    return mean / EPOCHS


class Model:
    """nodes: (labels, [(a, b, weights)]) for the families and for each family of several languages."""

    def __init__(self, texts: list[str], langs: list[str], seed: int = 11):
        docs = [grams.packed(_features(text)) for text in texts]
        self.families = sorted({family(x) for x in langs})
        self.members = {f: sorted({x for x in langs if family(x) == f}) for f in self.families}
        self.machines = [self._pairs(docs, [family(x) for x in langs], self.families, seed)]
        self.machines += [self._pairs(docs, langs, self.members[f], seed) for f in self.families]

    @staticmethod
    def _pairs(docs, labels, names, seed):
        out = []
        for i, j in combinations(range(len(names)), 2):
            own = [k for k, x in enumerate(labels) if x in (names[i], names[j])]
            y = np.array([1.0 if labels[k] == names[i] else -1.0 for k in own])
            w = _machine([docs[k] for k in own], y, seed)
            out.append((i, j, w[:-1].astype(np.float32), float(w[-1])))
        return out

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Machines (the families' first) by rows: mean weight of a row's grams, and the bias."""
        machines = [m for group in self.machines for m in group]
        clean = grams.letters(data)
        total, count = np.zeros((len(machines), len(offsets) - 1)), np.zeros(len(offsets) - 1)
        for n in ORDERS:
            more, number = grams.totals(clean, offsets, n, BITS, [w for _, _, w, _ in machines])
            total += more
            count += number
        return total / np.maximum(count, 1) + np.array([b for *_, b in machines]).reshape(-1, 1)

    def predict(self, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        text = batch.column(batch.schema.get_field_index("text"))
        data, offsets = tv.buffers(text)
        rows = batch.num_rows
        has = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)
        if not self.families:
            return ["und"] * rows, np.zeros(rows)
        margins = iter(self.margins(data, offsets))

        def decide(machines, n):
            votes, sums, least = np.zeros((rows, n)), np.zeros((rows, n)), np.full((rows, n), np.inf)
            for i, j, _, _ in machines:
                m = next(margins)
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                for k, s in ((i, m), (j, -m)):
                    sums[:, k] += s
                    least[:, k] = np.minimum(least[:, k], s)
            best = np.lexsort((-np.arange(n) * np.ones((rows, 1)), sums, votes), axis=1)[:, -1]
            return best, least[np.arange(rows), best]

        fam, margin = decide(self.machines[0], len(self.families))
        langs = np.empty(rows, object)
        for k, f in enumerate(self.families):
            names = self.members[f]
            best, least = decide(self.machines[1 + k], len(names)) if len(names) > 1 else (np.zeros(rows, int), np.full(rows, np.inf))
            mine = np.flatnonzero(fam == k)
            langs[mine] = [names[x] for x in best[mine]]
            margin[mine] = np.minimum(margin[mine], least[mine])
        score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        langs[~has] = "und"
        return langs.tolist(), np.where(has, score, 0.0)


def fit(documents: DataFrame, where=None, each: int = EACH, total: int = TOTAL) -> Model:
    known = documents.where(where) if where is not None else documents
    rows = grams.training(known, "lang", each, total, LONGEST, "language", 1)
    return grams.in_one_task(rows, lambda t: Model(t.column("text").to_pylist(), t.column("lang").to_pylist()) if t else Model([], []))


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    lean(documents.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.slices(batch):
                langs, score = model.predict(part)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")


def run(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(documents, fit(documents, grams.fold("doc_id", 3) != 1))
    return found.select("doc_id", (grams.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
