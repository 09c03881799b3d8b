"""Topic and churn classifiers: balanced logistic regressions, fitted for all topics together.

A fit reads the labelled rows once per Newton step, whatever the number of topics: tasks
add losses, gradients and curvatures of every topic, one more exchange adds those, and the driver
solves one small system per topic. The features are a dense array (embeddings, or the
hashed n-grams of `encoders.NgramEncoder`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasMaxIter, HasProbabilityCol, HasRegParam, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.seeded import seeded_uniform
from feedloom.operators.encoders import NgramEncoder
from feedloom.session import cut_lineage

THRESHOLD = 0.5
TRAINING_ROWS = 200_000     # labelled rows that a fit reads, about
FEATURES = "features"
CERTAIN = 1e6               # intercept of a topic that all rows have, or none: the probability is exactly 1 or 0
POSITIVE = "positive"


def text_encoder(text: str = "review_text", n_features: int = 1024) -> Pipeline:
    """Default encoder as a pipeline, to which further stages may be added."""
    return Pipeline(stages=[NgramEncoder(inputCol=text, outputCol=FEATURES, numFeatures=n_features)])


def encode_text(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df)


def use_embeddings(df: DataFrame, column: str) -> DataFrame:
    """Precomputed array<float> embeddings as the feature array."""
    return df.withColumn(FEATURES, F.col(column).cast("array<double>"))


def assemble_training(parts: list[DataFrame], test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of the training parts, and a check that no test review is among them."""
    train = parts[0]
    for part in parts[1:]:
        train = train.unionByName(part)
    leaked = train.join(test.select("review_id"), "review_id", "left_semi").agg(F.count(F.lit(1)).alias("n_leaked"))
    return train, leaked.withColumn("passed", F.col("n_leaked") == 0)


def bounded(train: DataFrame, key: str, size: int = TRAINING_ROWS, seed: int = 11) -> DataFrame:
    """About `size` labelled rows at most: a row stays if the seeded draw of its key is below size / n."""
    n = train.agg(F.count(F.lit(1))).scalar()
    return train.filter(seeded_uniform(seed, F.col(key)) * n <= size)


# ---------------------------------------------------------------- fit

def sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)


def topic_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Per topic: loss, gradient and curvature of some rows, one after another.

    x (rows, 1 + dimensions) starts with ones, y (rows, topics) is 0 or 1, weight (2, topics)
    holds the class weights, theta (topics, 1 + dimensions) the coefficients.
    """
    z = x @ theta.T
    p = sigmoid(z)
    w = np.where(y > 0, weight[1], weight[0])
    loss = (w * (np.logaddexp(0.0, z) - y * z)).sum(0)
    gradient = (w * (p - y)).T @ x
    curvature = [(x.T * c) @ x for c in (w * p * (1.0 - p)).T]
    return np.column_stack([loss, gradient, np.reshape(curvature, (len(theta), -1))])


def _passes(rows: DataFrame, weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """`topic_sums` over all rows, in one job."""
    schema = pa.schema([("topic", pa.int32()), ("sums", pa.list_(pa.float64()))])
    dims = theta.shape[1] - 1

    def partial(batches):
        total = 0.0
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, dims)
            y = np.asarray(batch.column(1).flatten()).reshape(-1, len(theta))
            total = total + topic_sums(np.column_stack([np.ones(len(x)), x]), y, weight, theta)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(theta)), pa.int32()), pa.array(total.tolist(), schema.field(1).type)], schema=schema)

    def add(part: pa.Table) -> pa.Table:
        values = np.asarray(part.column("sums").combine_chunks().flatten()).reshape(part.num_rows, -1)
        return pa.table([part.column("topic").slice(0, 1), pa.array([values.sum(0)], schema.field(1).type)], schema=schema)

    fields = "topic int, sums array<double>"
    found = {r.topic: r.sums for r in rows.mapInArrow(partial, fields).groupBy("topic").applyInArrow(add, fields).collect()}   # a small matrix per topic
    return np.array([found[t] for t in range(len(theta))])


def newton(rows: DataFrame, n: int, positives: np.ndarray, dims: int, penalty: float, tol: float, max_iter: int) -> tuple[np.ndarray, float]:
    """Coefficients of all topics, intercept first, and the largest gradient entry per row at the last but one step.

    Minimises weighted log loss plus penalty * |coefficients|^2 / 2, intercept left out. A step that
    raises a topic's objective is halved until it doesn't.
    """
    weight = np.array([n / (2.0 * (n - positives)), n / (2.0 * positives)])
    ridge = np.full(dims + 1, penalty)
    ridge[0] = 0.0
    theta = np.zeros((len(positives), dims + 1))
    kept, best = theta.copy(), np.full(len(positives), np.inf)
    steepest = np.inf
    for _ in range(max_iter):
        sums = _passes(rows, weight, theta)
        objective = sums[:, 0] + (ridge * theta * theta).sum(1) / 2
        gradient = sums[:, 1:dims + 2] + ridge * theta
        curvature = sums[:, dims + 2:].reshape(-1, dims + 1, dims + 1) + np.diag(ridge)
        worse = objective > best + 1e-9 * np.abs(best)
        steepest = float(np.abs(gradient[~worse]).max(initial=0.0)) / n if not worse.all() else np.inf
        step = np.linalg.solve(curvature, gradient[:, :, None])[:, :, 0]
        kept, best, theta = (np.where(worse[:, None], kept, theta), np.where(worse, best, objective),
                             np.where(worse[:, None], (kept + theta) / 2, theta - step))
        if not worse.any() and steepest <= tol:
            break
    return theta, steepest


class TopicClassifier(Estimator, HasFeaturesCol, HasProbabilityCol, HasRegParam, HasTol, HasMaxIter, DefaultParamsReadable, DefaultParamsWritable):
    """Fits one balanced logistic regression per topic of an array<string> column.

    Class weights are n / (2 * rows of the class). `regParam` is the penalty beside the
    plain sum of losses, `tol` the bound of the largest gradient entry per row, after which one
    more step is taken. Rows without features are left out.
    """

    topics = Param(Params._dummy(), "topics", "vocabulary", TypeConverters.toListString)
    labelsCol = Param(Params._dummy(), "labelsCol", "column of the topics of a row", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, topics=None, labelsCol=None, featuresCol=None, probabilityCol=None, regParam=None, tol=None, maxIter=None):
        super().__init__()
        self._setDefault(topics=[], labelsCol="topics", featuresCol=FEATURES, probabilityCol="probabilities", regParam=1.0, tol=1e-10, maxIter=100)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> TopicClassifierModel:
        topics = self.getOrDefault("topics")
        names = F.array(*[F.lit(t) for t in topics]).cast("array<string>")
        own = F.coalesce(F.col(self.getOrDefault("labelsCol")), F.array().cast("array<string>"))
        rows = cut_lineage(dataset.select(as_array(dataset, self.getFeaturesCol()).alias("x"), F.transform(names, lambda t: F.coalesce(F.array_contains(own, t), F.lit(False)).cast("double")).alias("y"))
                           .where("x is not null"))
        n, dims, *counts = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0)), *[F.coalesce(F.sum(F.col("y")[i]), F.lit(0.0)) for i in range(len(topics))]).first()
        counts = np.array(counts, float)
        mixed = np.flatnonzero((counts > 0) & (counts < n))
        theta = np.zeros((len(topics), dims + 1))
        theta[:, 0] = np.where((counts == n) & (n > 0), CERTAIN, -CERTAIN)
        steepest = 0.0
        if len(mixed):
            used = rows.select("x", F.array(*[F.col("y")[int(i)] for i in mixed]).alias("y"))
            theta[mixed], steepest = newton(used, n, counts[mixed], dims, self.getRegParam(), self.getTol(), self.getMaxIter())
        return TopicClassifierModel(topics=topics, coefficients=theta[:, 1:].tolist(), intercepts=theta[:, 0].tolist(), gradientNorm=steepest,
                                    featuresCol=self.getFeaturesCol(), probabilityCol=self.getProbabilityCol())


def as_array(df: DataFrame, column: str) -> Column:
    """A feature column, vector or array, as array<double>."""
    if df.schema[column].dataType.typeName() == "array":
        return F.col(column).cast("array<double>")
    return vector_to_array(column)


class TopicClassifierModel(Model, HasFeaturesCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the topics' probabilities as an array in vocabulary order; null where there are no features."""

    topics = Param(Params._dummy(), "topics", "vocabulary", TypeConverters.toListString)
    coefficients = Param(Params._dummy(), "coefficients", "one row per topic", TypeConverters.toListListFloat)
    intercepts = Param(Params._dummy(), "intercepts", "one per topic", TypeConverters.toListFloat)
    gradientNorm = Param(Params._dummy(), "gradientNorm", "largest gradient entry per row before the last step", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, topics=None, coefficients=None, intercepts=None, gradientNorm=None, featuresCol=None, probabilityCol=None):
        super().__init__()
        self._setDefault(featuresCol=FEATURES, probabilityCol="probabilities")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def vocabulary(self) -> list[str]:
        return list(self.getOrDefault("topics"))

    def theta(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.getOrDefault("coefficients")), np.array(self.getOrDefault("intercepts"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, bias = self.theta()

        @F.arrow_udf("array<double>")
        def score(features: pa.Array) -> pa.Array:
            given = np.asarray(features.is_valid())
            x = np.asarray(features.drop_null().flatten()).reshape(given.sum(), weights.shape[1])
            p = sigmoid(x @ weights.T + bias)
            ends = np.r_[0, np.cumsum(given)] * len(bias)
            mask = pa.array(np.r_[~given, False]) if not given.all() else None
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=None if mask is None else np.asarray(mask)), pa.array(p.ravel()))

        return dataset.withColumn(self.getProbabilityCol(), score(as_array(dataset, self.getFeaturesCol())))


def fit_topics(train: DataFrame, vocabulary: list[str], topics: str = "topics", **params) -> TopicClassifierModel:
    """All topics together; a topic that all rows or no rows have gets the probability 1 or 0."""
    return TopicClassifier(topics=vocabulary, labelsCol=topics, **params).fit(train)


def fit_binary(train: DataFrame, label: Column, **params) -> TopicClassifierModel:
    """A single yes/no label as a model with the one topic `positive`."""
    marked = train.withColumn("_topics", F.when(label.cast("boolean"), F.array(F.lit(POSITIVE))))
    return TopicClassifier(topics=[POSITIVE], labelsCol="_topics", **params).fit(marked)


# ---------------------------------------------------------------- scores

def topic_probabilities(model: TopicClassifierModel, df: DataFrame, keep: tuple[str, ...] = ("review_id",)) -> DataFrame:
    """Long (keep..., topic, probability): every topic of each row from one pass; rows without features have none."""
    names = F.array(*[F.lit(t) for t in model.vocabulary()])
    cells = F.arrays_zip(names.alias("topic"), F.col(model.getProbabilityCol()).alias("probability"))
    scored = model.transform(df).select(*keep, model.getProbabilityCol()).where(F.col(model.getProbabilityCol()).isNotNull())
    return scored.select(*keep, F.explode(cells).alias("c")).select(*keep, F.col("c.topic"), F.col("c.probability"))


def positive_topics(probabilities: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return probabilities.filter(F.col("probability") >= threshold)


def churn_flags(model: TopicClassifierModel, df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    scored = model.transform(df).select("review_id", F.col(model.getProbabilityCol())[0].alias("churn_probability"))
    return scored.select("review_id", (F.col("churn_probability") >= threshold).alias("churn_intent"), "churn_probability")


# ---------------------------------------------------------------- saved models

VERSIONS = "version int, path string, n_rows long, gradient_norm double"


def save_version(spark: SparkSession, model: PipelineModel, folder: str, n_rows: int) -> int:
    """Save a fitted pipeline as the next version below `folder`; it counts once its row is in `versions`."""
    known = saved_versions(spark, folder)
    version = max([r.version for r in known.collect()], default=0) + 1      # a row per fit
    path = f"{folder}/v{version:05d}"
    model.write().overwrite().save(path)
    norms = [s.getOrDefault("gradientNorm") for s in model.stages if isinstance(s, TopicClassifierModel)]
    spark.createDataFrame([(version, path, n_rows, max(norms, default=0.0))], VERSIONS).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return version


def saved_versions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per saved version."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(VERSIONS).parquet(f"{folder}/versions")
    except AnalysisException:      # no version yet
        return spark.createDataFrame([], VERSIONS)


def load_version(spark: SparkSession, folder: str, version: int | None = None) -> PipelineModel:
    """The given version, or the latest."""
    known = {r.version: r.path for r in saved_versions(spark, folder).collect()}      # a row per fit
    wanted = version if version is not None else max(known, default=None)
    if wanted not in known:
        raise ValueError(f"no version {wanted} below {folder}")
    return PipelineModel.load(known[wanted])
