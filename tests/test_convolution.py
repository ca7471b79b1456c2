"""The convolutional classifier: gradients, pooling over blocks, and what it learns."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.operators import convolution
from weftline.operators.convolution import TextConvolution
from weftline.operators.training import Plan


def test_gradients_and_pooling(monkeypatch):
    model = TextConvolution(tuple("abcdef"), ("x", "y", "z"), filters=5, embedding=4, nodes=6)
    weights = model.first() + np.random.default_rng(1).normal(0, 0.1, len(model.first()))
    texts = [np.array(t, np.int64) for t in ([1, 2, 3, 4, 1, 2], [], [5], [6, 6, 6, 0, 2, 2, 1, 1, 1], [3, 3])]
    labels, gradient = np.array([0, 1, 2, 0, 1]), np.zeros_like(weights)
    logs = model.logs(weights, texts, gradient, labels)
    loss = lambda w: -model.logs(w, texts)[np.arange(5), labels].sum()
    for k in range(len(weights)):
        step = np.zeros_like(weights)
        step[k] = 1e-6
        assert (loss(weights + step) - loss(weights - step)) / 2e-6 == pytest.approx(gradient[k], abs=1e-5)
    w = model.views(weights)
    for t, words in enumerate(texts):  # the pool against plain loops
        words = list(words) + [0] * (3 - len(words))
        answers = [sum(w["words"][words[i + k]] @ w["window"][k] for k in range(3)) + w["window_bias"] for i in range(len(words) - 2)]
        assert model._pooled(w, texts)[1][t] == pytest.approx(np.max(answers, 0))
    for size in (1, 2, 5):  # blocks of windows change nothing
        monkeypatch.setattr(convolution, "WINDOWS", size)
        assert model.logs(weights, texts) == pytest.approx(logs)
        again = np.zeros_like(weights)
        model.logs(weights, texts, again, labels)
        assert again == pytest.approx(gradient)


def test_learns_order_of_words(spark, tmp_path):
    """Labels that hang on the order of two words, which no count of words tells."""
    r = np.random.default_rng(2)
    rows = []
    for k in range(240):
        noise = [f"w{r.integers(20)}" for _ in range(int(r.integers(4, 30)))]
        at = int(r.integers(len(noise)))
        rows.append((k, noise[:at] + (["hot", "cold"] if k % 2 else ["cold", "hot"]) + noise[at:], None if k % 40 == 7 else ("up", "down")[k % 2]))
    texts = spark.createDataFrame(rows, "id long, words array<string>, label string")
    model = convolution.text_convolution(texts.where("id < 200"), "words", "label", filters=16, embedding=8, nodes=10)
    assert model.labels == ("down", "up") and len(model.vocabulary) == 22
    found = convolution.train_classifier(texts.where("id < 200"), "id", "words", "label", model, f"{tmp_path}/model", Plan(25, 1, 0.05))
    said = {x["id"]: x for x in convolution.classify(texts, "id", "words", model, found.weights).collect()}
    assert len(said) == 240 and np.mean([said[k]["predicted"] == ("up", "down")[k % 2] for k in range(200, 240)]) > 0.9
    assert found.history[-1][1] < 0.2


def test_edges(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, [], "b"), (2, ["never seen"], None), (3, ["x"] * 5000, "c")]
    texts = spark.createDataFrame(rows, "id long, words array<string>, label string")
    model = convolution.text_convolution(texts, "words", "label", filters=4, embedding=3, nodes=4)
    got = convolution.classify(texts, "id", "words", model, model.first()).collect()
    assert sorted(str(x["id"]) for x in got) == ["1", "1", "2", "3", "None"] and all(1 / 3 <= x["score"] <= 1 for x in got)
    assert convolution.encoded(texts, "id", "words", model, "label").count() == 4
    assert convolution.classify(texts.limit(0), "id", "words", model, model.first()).count() == 0
    for bad in (texts.limit(0), texts.withColumn("label", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            convolution.text_convolution(bad, "words", "label")
