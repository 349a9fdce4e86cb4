"""Cross-validated classifiers over feature tables by MLlib: linear ones and trees, machines with a Gaussian kernel by random features, calibration, and a one-class machine."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.metrics import curve, summary
from tidemark.operators.ranking import quantiles
from tidemark.operators.sampling import folds
from tidemark.shared import Tables

PART = 1 << 17

MODELS = {
    "logistic": lambda: LogisticRegression(maxIter=50),
    "linear_svm": lambda: LinearSVC(maxIter=50),
    "random_forest": lambda: RandomForestClassifier(numTrees=50, seed=418),
}


def _prepared(df: DataFrame, features: str | list[str], label: str, key: str, more: list[str]) -> DataFrame:
    data = df.where(F.col(label).isin(0, 1))
    data = data.withColumn("raw", array_to_vector(F.col(features).cast("array<double>"))) if isinstance(features, str) else VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(data)
    return data.select(key, F.col(label).cast("double").alias("label"), "raw", *more)


def _kept(tables: Tables, data: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """data as a table in the shared folder, and cached: in a partition for each core, in more where these would pass PART rows. Each round of a training is a task for every partition."""
    rows = tables.stored(data, "rows")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART))
    return rows, rows.repartition(parts, key).persist()


def _scored(train: DataFrame, test: DataFrame, model: str) -> tuple[float | None, float | None]:
    """AUC and accuracy on test of a model trained on train, features scaled on train."""
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    fitted = MODELS[model]().fit(scale.transform(train))
    out = fitted.transform(scale.transform(test)).select("label", "prediction", F.element_at(vector_to_array("rawPrediction"), 2).alias("prob"))
    return summary(curve(out)).first()["auc"], out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]


def cross_validated(df: DataFrame, features: str | list[str], label: str, key: str, model: str = "logistic", k: int = 5, seed: int = 418) -> DataFrame:
    """fold, auc, acc of a model trained on the other folds (labels 0 and 1, features scaled on the training folds). Trains k models when it is called; the table is cached until then."""
    tables = Tables(df.sparkSession)
    rows, data = _kept(tables, _prepared(folds(df.where(F.col(label).isin(0, 1)), label, key, k, seed), features, label, key, ["fold"]), key)
    try:
        out = [(i, *_scored(data.where(F.col("fold") != i), data.where(F.col("fold") == i), model)) for i in range(k)]
    finally:
        data.unpersist()
        tables.drop(rows)
    return df.sparkSession.createDataFrame(out, "fold int, auc double, acc double")


def held_out(df: DataFrame, features: str | list[str], label: str, key: str, model: str = "logistic", share: float = 0.3, seed: int = 418) -> DataFrame:
    """One row: auc, acc, rows of a stratified part of the rows (share, in tenths) that the model wasn't trained on."""
    tables = Tables(df.sparkSession)
    rows, data = _kept(tables, _prepared(folds(df.where(F.col(label).isin(0, 1)), label, key, 10, seed, "_part"), features, label, key, ["_part"]), key)
    try:
        test = data.where(F.col("_part") < round(10 * share))
        auc, acc = _scored(data.where(F.col("_part") >= round(10 * share)), test, model)
        return df.sparkSession.createDataFrame([(auc, acc, test.count())], "auc double, acc double, rows long")
    finally:
        data.unpersist()
        tables.drop(rows)


def scores(df: DataFrame) -> DataFrame:
    """Means and population deviations over the folds."""
    return df.agg(F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"), F.avg("acc").alias("acc_mean"), F.stddev_pop("acc").alias("acc_std"))


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features: sqrt(2 / size) cos(w x + b), whose inner products approximate exp(-gamma |x - y|^2). gamma 0: one over the number of components (for scaled ones the usual choice)."""

    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the directions", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol: str = "scaled", outputCol: str = "features", gamma: float = 0.0, size: int = 256, seed: int = 418):  # noqa: N803  Spark's names
        super().__init__()
        self._setDefault(inputCol="scaled", outputCol="features", gamma=0.0, size=256, seed=418)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, size, seed = (self.getOrDefault(p) for p in (self.gamma, self.size, self.seed))

        @F.pandas_udf("array<double>")
        def features(vectors: pd.Series) -> pd.Series:
            x = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
            rng = np.random.default_rng(seed)  # the same directions in every task
            w = rng.normal(size=(x.shape[1], size)) * np.sqrt(2 * (gamma or 1 / max(1, x.shape[1])))
            return pd.Series(list(np.sqrt(2 / size) * np.cos(x @ w + rng.uniform(0, 2 * np.pi, size))))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(features(vector_to_array(self.getInputCol()))))


def rbf_machine(gamma: float = 0.0, strength: float = 1.0, size: int = 256) -> Pipeline:
    """A support vector machine with an (approximated) Gaussian kernel: scaled components, random features, a linear machine. strength: one over the number of rows and the weight of an error."""
    return Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), FourierFeatures(gamma=gamma, size=size), LinearSVC(maxIter=20, tol=1e-4, regParam=strength)])


def _searched(train: DataFrame, gammas: list[float], strengths: list[float], k: int, size: int, seed: int, fold: str = "") -> tuple[PipelineModel, float, float, list[PipelineModel]]:
    """The machine with the best mean AUC over k inner folds (by a column of their numbers, or at random), trained on all rows, its gamma and strength, and the machines of that setting that were trained without each fold."""
    machine = rbf_machine(size=size)
    grid = ParamGridBuilder().addGrid(machine.getStages()[1].gamma, gammas).addGrid(machine.getStages()[2].regParam, strengths).build()
    found = CrossValidator(estimator=machine, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(), numFolds=k, seed=seed, parallelism=4, collectSubModels=True, foldCol=fold).fit(train)
    best = int(np.argmax(found.avgMetrics))
    values = {p.name: v for p, v in grid[best].items()}
    return found.bestModel, values["gamma"], values["regParam"], [models[best] for models in found.subModels]


def grid_searched(train: DataFrame, gammas: list[float], strengths: list[float], k: int = 3, size: int = 256, seed: int = 418) -> tuple[PipelineModel, float, float]:
    """The machine with the best mean AUC over k inner folds, trained on all rows, and its gamma and strength."""
    return _searched(train, gammas, strengths, k, size, seed)[:3]


def margins(model, rows: DataFrame) -> DataFrame:
    """rows with prediction and margin, the machine's decision value."""
    return model.transform(rows).withColumn("margin", F.element_at(vector_to_array("rawPrediction"), 2))


def platt(rows: DataFrame, margin: str = "margin", label: str = "label") -> tuple[float, float]:
    """a, b such that 1 / (1 + exp(-(a margin + b))) is the chance of label 1. Fitted on margins of rows that the machine wasn't trained on, towards (n1 + 1) / (n1 + 2) and 1 / (n0 + 2) instead of 1 and 0."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # two rows
    high, low = (counts.get(1.0, 0) + 1) / (counts.get(1.0, 0) + 2), 1 / (counts.get(0.0, 0) + 2)
    share = F.when(F.col(label) == 1, F.lit(high)).otherwise(F.lit(low))
    sides = F.explode(F.array(*(F.struct(F.lit(y).alias("label"), w.alias("weight")) for y, w in ((1.0, share), (0.0, 1 - share)))))
    both = rows.select(array_to_vector(F.array(F.col(margin))).alias("features"), sides.alias("side")).select("features", "side.*")
    fitted = LogisticRegression(weightCol="weight", maxIter=100, standardization=False).fit(both)
    return float(fitted.coefficients[0]), float(fitted.intercept)


def calibration(rows: DataFrame, prob: str = "prob", label: str = "label", bins: int = 10) -> DataFrame:
    """bin, n, mean_prob, share of label 1 for each tenth (bins) of the probabilities that has rows."""
    at = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("mean_prob"), F.avg(label).alias("share"))


def calibration_error(rows: DataFrame, prob: str = "prob", label: str = "label", bins: int = 10) -> DataFrame:
    """One row: ece, the mean distance of probability and share over the bins, by their rows."""
    return calibration(rows, prob, label, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("share"))) / F.sum("n")).alias("ece"))


def nested(df: DataFrame, features: str | list[str], label: str, key: str, gammas: list[float], strengths: list[float], k: int = 3, size: int = 256, seed: int = 418) -> DataFrame:
    """Grid search within cross-validation: of each row by the machine that was chosen and trained without it (a fold of k): key, label, fold, gamma, strength, margin, prediction, prob.

    prob is calibrated on the margins of the other folds' rows, each by a machine of the same setting that didn't have the row in its training: the
    search's own, whose inner folds go by a hash of the key. Trains (k inner folds x grid + 1) machines a fold when it is called; the features are
    cached meanwhile, the scores are a table in the shared folder.
    """
    tables = Tables(df.sparkSession)
    dealt = _prepared(folds(df.where(F.col(label).isin(0, 1)), label, key, k, seed), features, label, key, ["fold"])
    stored, data = _kept(tables, dealt.withColumn("inner", F.pmod(F.xxhash64(key), F.lit(k)).cast("int")), key)
    try:
        scored = []
        for i in range(k):
            train, test = data.where(F.col("fold") != i), data.where(F.col("fold") == i)
            model, gamma, strength, others = _searched(train, gammas, strengths, k, size, seed, "inner")
            apart = [margins(other, train.where(F.col("inner") == j)).select("label", "margin") for j, other in enumerate(others)]
            out = apart[0]
            for other in apart[1:]:
                out = out.unionByName(other)
            out = out.persist()
            a, b = platt(out)
            out.unpersist()
            rows = margins(model, test).select(F.col(key), F.col("label").cast("int").alias("label"), "fold", F.lit(gamma).alias("gamma"), F.lit(strength).alias("strength"), "margin", F.col("prediction").cast("int").alias("prediction"), (1 / (1 + F.exp(-(a * F.col("margin") + b)))).alias("prob"))
            scored.append(tables.stored(rows, "scores"))
        out = scored[0]
        for other in scored[1:]:
            out = out.unionByName(other)
        return out
    finally:
        data.unpersist()
        tables.drop(stored)


def one_class(df: DataFrame, features: str | list[str], label: str, key: str, nu: float = 0.1, gamma: float = 0.0, size: int = 256, rounds: int = 25, seed: int = 418) -> DataFrame:
    """key, label, score (larger: less like label 0) by a one-class machine with a Gaussian kernel, trained on rows of label 0 alone.

    The nu one-class objective |w|^2 / 2 - rho + mean(max(0, rho - w z)) / nu over random features z, by sub-gradient steps of
    1 / round: each round is one aggregate of all rows, of which the driver sees a vector as long as a row. rho is the share nu of the
    training rows' values w z in the end, so that this share has a score above 0. The features are cached meanwhile.
    """
    tables = Tables(df.sparkSession)
    stored, data = _kept(tables, _prepared(df, features, label, key, []), key)
    scale = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(data.where("label = 0"))
    rows = FourierFeatures(gamma=gamma, size=size, seed=seed).transform(scale.transform(data)).select(key, F.col("label").cast("int").alias("label"), vector_to_array("features").alias("z")).persist()
    try:
        normal = rows.where("label = 0")
        n = max(1, normal.count())
        w = _sums(normal.select("z"), np.zeros(size), np.inf) / n  # the mean direction, at which all rows are beyond rho
        for k in range(1, rounds + 1):
            rho = quantiles(_along(normal, w), "x", [nu]).first()[0] or 0.0
            w = w - (w - _sums(normal.select("z"), w, rho) / (nu * n)) / (k + 1)
        rho = quantiles(_along(normal, w), "x", [nu]).first()[0] or 0.0
        return tables.stored(_along(rows, w, key, "label").select(key, "label", (F.lit(rho) - F.col("x")).alias("score")), "scores")
    finally:
        rows.unpersist()
        data.unpersist()
        tables.drop(stored)


def _along(rows: DataFrame, w: np.ndarray, *more: str) -> DataFrame:
    """x, the inner product of z and w."""
    return rows.select(*more, F.aggregate(F.zip_with("z", F.array(*(F.lit(float(v)) for v in w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("x"))


def _sums(rows: DataFrame, w: np.ndarray, rho: float) -> np.ndarray:
    """Sum of the vectors z whose inner product with w is below rho: each task sends one vector."""

    def add(batches):
        total = np.zeros(len(w))
        for batch in batches:
            z = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            total += z[z @ w < rho].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w))), pa.array(total)], names=["i", "x"])

    found = rows.mapInArrow(add, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # as long as a row
    out = np.zeros(len(w))
    for r in found:
        out[r.i] = r.x
    return out
