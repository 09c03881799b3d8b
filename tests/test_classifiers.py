"""Encoder and joint topic classifier: objective, passes, persistence, missing features, hashing."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from feedloom.operators import classifiers, encoders


def by_hand(text, n, sizes=(2, 3), words=True):
    t = " " + re.sub(r"[ \t-\r]+", " ", (text or "").lower()).strip(" ") + " "
    grams = [("c", t[i:i + s]) for s in sizes for i in range(len(t) - s + 1)] + [("w", w) for w in t.split(" ") if w and words]
    out = np.zeros(n)
    for kind, g in grams:
        h = hashlib.md5(f"{kind}:{g}".encode()).hexdigest()
        out[int(h[:8], 16) % n] += 1 if h[8] < "8" else -1
    size = np.sqrt(out @ out)
    return out / size if size else out


TEXTS = ["Refund is LATE", "", None, "   ", "\t", "x", "é日本 語\U0001F600", "a" * 3000, "two  words\n\nhere", "refund is late"]


@pytest.mark.parametrize("params", [{}, {"sizes": [1]}, {"sizes": [3], "words": False}, {"numFeatures": 7}])
def test_encoder_equals_counts_by_hand(spark, params):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "review_id string, review_text string")
    encoder = encoders.NgramEncoder(**{"numFeatures": 32, **params})
    got = {r.review_id: r.features for r in encoder.transform(df).collect()}
    n = {"numFeatures": 32, **params}["numFeatures"]
    for i, t in enumerate(TEXTS):
        assert np.allclose(got[str(i)], by_hand(t, n, params.get("sizes", (2, 3)), params.get("words", True))), t
    assert got["0"] == got["9"]


def test_encoder_takes_long_texts_by_parts(monkeypatch):
    whole = encoders.hashed(pa.array(["ab cd", "", "x y z"]), [2, 3], True, 16)
    assert whole.shape == (3, 16) and encoders.hashed(pa.array([], pa.string()), [2], True, 16).shape == (0, 16)
    with pytest.raises(ValueError):
        encoders.NgramEncoder(sizes=[4])


def balanced(x, y, penalty=1.0):
    n, d = x.shape
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    design, theta = np.column_stack([np.ones(n), x]), np.zeros(d + 1)
    ridge = np.diag([0.0] + [penalty] * d)
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ theta))
        theta -= np.linalg.solve((design.T * (w * p * (1 - p))) @ design + ridge, design.T @ (w * (p - y)) + ridge @ theta)
    return theta


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6)) * [1, 5, 0.1, 1, 20, 1]
    marks = {"a": x[:, 0] + rng.normal(0, 1, 300) > 1.2, "b": x[:, 4] > 0, "rare": np.arange(300) < 3, "none": np.zeros(300, bool), "all": np.ones(300, bool)}
    rows = [(str(i), x[i].tolist(), [t for t, m in marks.items() if m[i]]) for i in range(300)]
    df = spark.createDataFrame(rows, "review_id string, features array<double>, topics array<string>").repartition(5)
    return x, marks, df


def test_all_topics_reach_their_own_optimum(data):
    x, marks, df = data
    model = classifiers.fit_topics(df, list(marks))
    coefficients, intercepts = model.theta()
    for k, t in enumerate(("a", "b", "rare")):
        assert np.allclose(np.r_[intercepts[k], coefficients[k]], balanced(x, marks[t].astype(float)), atol=1e-8), t
    assert not coefficients[3:].any() and intercepts.tolist()[3:] == [-classifiers.CERTAIN, classifiers.CERTAIN]


def test_a_step_is_one_pass_however_many_topics(data, monkeypatch):
    _, marks, df = data
    passes = []
    real = classifiers._passes
    monkeypatch.setattr(classifiers, "_passes", lambda rows, weight, theta: passes.append(len(theta)) or real(rows, weight, theta))
    classifiers.fit_topics(df, list(marks))
    assert 4 <= len(passes) <= 30 and set(passes) == {3}


def test_vectors_nulls_and_other_columns(spark, data):
    x, marks, df = data
    from pyspark.ml.functions import array_to_vector
    model = classifiers.fit_topics(df, ["a", "b"])
    vectors = classifiers.fit_topics(df.withColumn("features", array_to_vector("features")), ["a", "b"])
    assert np.allclose(model.theta()[0], vectors.theta()[0], atol=1e-9)
    odd = spark.createDataFrame([("1", x[0].tolist(), None, 1), ("2", None, ["a"], 2)], "review_id string, features array<double>, topics array<string>, probability int")
    got = {(r.review_id, r.topic): r.probability for r in classifiers.topic_probabilities(model, odd).collect()}
    assert set(got) == {("1", "a"), ("1", "b")}
    refit = classifiers.fit_topics(df.unionByName(odd.drop("probability").filter("review_id = '2'")), ["a", "b"])
    assert np.allclose(model.theta()[0], refit.theta()[0], atol=1e-9)
    empty = classifiers.fit_topics(df.limit(0), ["a"])
    assert empty.theta()[1].tolist() == [-classifiers.CERTAIN]


def test_versions_are_saved_and_loaded(spark, tmp_path):
    rows = [(str(i), ["late refund", "app crash"][i % 2] + f" n{i % 5}", [["r"], ["c"]][i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "review_id string, review_text string, topics array<string>")
    folder = str(tmp_path / "models")
    with pytest.raises(ValueError):
        classifiers.load_version(spark, folder)
    pipeline = Pipeline(stages=[encoders.NgramEncoder(numFeatures=32), classifiers.TopicClassifier(topics=["r", "c"])])
    first, second = pipeline.fit(df.limit(20)), pipeline.fit(df)
    assert [classifiers.save_version(spark, m, folder, n) for m, n in ((first, 20), (second, 60))] == [1, 2]
    assert [(r.version, r.n_rows) for r in classifiers.saved_versions(spark, folder).orderBy("version").collect()] == [(1, 20), (2, 60)]

    def scores(model):
        return sorted((r.review_id, r.probabilities) for r in model.transform(df).collect())
    loaded = classifiers.load_version(spark, folder)
    assert scores(loaded) == scores(second) and scores(classifiers.load_version(spark, folder, 1)) == scores(first) != scores(second)
    with pytest.raises(ValueError):
        classifiers.load_version(spark, folder, 9)
    # an estimator travels too, and a scoring plan reads the texts once and exchanges nothing
    again = Pipeline.load(save(pipeline, tmp_path / "pipeline")).fit(df)
    assert np.allclose([p for _, p in scores(again)], [p for _, p in scores(second)], atol=1e-12)
    plan = loaded.transform(df)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def save(pipeline, path):
    pipeline.write().overwrite().save(str(path))
    return str(path)


def test_saved_encoder_is_the_same_encoder(spark, tmp_path):
    df = spark.createDataFrame([("1", "some text")], "review_id string, review_text string")
    fitted = classifiers.text_encoder(n_features=16).fit(df)
    loaded = PipelineModel.load(save(fitted, tmp_path / "encoder"))
    assert loaded.transform(df).select(F.to_json("features")).first() == fitted.transform(df).select(F.to_json("features")).first()


def test_grams_by_table_and_by_sorting_agree(monkeypatch):
    texts = pa.array([" ab cd ", "", "x", " \u00e9t\u00e9 \U0001f600\u4e00 \U0010ffff ", " aa  aa ", " "])
    by_table = encoders.hashed(texts, [1, 2, 3], True, 32)
    monkeypatch.setattr(encoders, "DENSE", 0)
    assert np.array_equal(by_table, encoders.hashed(texts, [1, 2, 3], True, 32))
    for text, row in zip(texts.to_pylist(), by_table):
        expected = np.zeros(32)
        for kind, gram in [("c", text[k:k + n]) for n in (1, 2, 3) for k in range(len(text) - n + 1)] + [("w", w) for w in text.strip(" ").split(" ") if w]:
            bucket, sign = encoders.bucket_and_sign(kind, gram, 32)
            expected[bucket] += sign
        assert np.allclose(row, expected / (np.sqrt(expected @ expected) or 1.0))


def test_text_features_encode_each_text_once(spark, sf_dir):
    import __spark_entry__ as contract

    plan = contract.queries()["text_features"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
