"""The ordinal regression against a plain optimiser of its likelihood, and on ratings it has not seen."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.queries import rated

FOLDER = "/root/testdata/sf0.01"


def loss(weights, thresholds, x, y):
    """Mean negative log-likelihood and its gradients."""
    z = (x @ weights)[:, None] - thresholds[None, :]
    tail = 1 / (1 + np.exp(-z))
    bounds = np.concatenate([np.ones((len(x), 1)), tail, np.zeros((len(x), 1))], axis=1)
    rows = np.arange(len(x))
    likely = bounds[rows, y] - bounds[rows, y + 1]
    slopes = np.concatenate([np.zeros((len(x), 1)), tail * (1 - tail), np.zeros((len(x), 1))], axis=1)
    by_score = -(slopes[rows, y] - slopes[rows, y + 1]) / likely
    by_threshold = np.zeros((len(x), len(thresholds) + 2))
    np.add.at(by_threshold, (rows, y), slopes[rows, y] / likely)
    np.add.at(by_threshold, (rows, y + 1), -slopes[rows, y + 1] / likely)
    return -np.log(likely).mean(), x.T @ by_score / len(x), by_threshold[:, 1:-1].mean(axis=0)


@pytest.mark.parametrize("n_grades", [2, 3, 5])
def test_fit_comes_near_the_greatest_likelihood(n_grades):
    rng = np.random.default_rng(n_grades)
    x = (rng.random((3000, 24)) < 0.3).astype(float)
    true = rng.normal(0, 1.2, 24)
    cuts = np.quantile(x @ true, np.linspace(0, 1, n_grades + 1)[1:-1])
    y = ((x @ true + rng.logistic(size=3000))[:, None] > cuts[None, :]).sum(axis=1)
    weights, thresholds = np.zeros(24), np.linspace(-1, 1, n_grades - 1)
    for step in range(3000):
        value, dw, dt = loss(weights, thresholds, x, y)
        weights, thresholds = weights - 1.0 * dw, thresholds - 1.0 * dt
    best = loss(weights, thresholds, x, y)[0]
    model = quality.fit([np.flatnonzero(r) for r in x], y.tolist(), n_grades, epochs=12, l1=0.0, l2=0.0)
    own = model.weights[:24].astype(float)
    assert best <= loss(own, model.thresholds, x, y)[0] < best + 0.03
    assert np.corrcoef(own, weights)[0, 1] > 0.98
    assert (np.diff(model.thresholds) >= 0).all()
    tails = model.tails(x @ own)
    assert (np.diff(tails, axis=1) <= 0).all()
    grades = [np.mean(tails.sum(axis=1)[y == g]) for g in range(n_grades)]
    assert grades == sorted(grades)


def test_unseen_ratings(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables not present")
    docs, ratings = spark.read.parquet(f"{FOLDER}/documents.parquet"), rated(spark, FOLDER)
    model = quality.train(docs, ratings.where("doc_id % 5 != 0"))
    found = quality.grade_documents(docs, model).join(ratings.where("doc_id % 5 = 0"), "doc_id").where("grade is not null")
    right, always, n = found.agg(
        F.avg((F.col("selected") == (F.col("grade") == 2)).cast("int")), F.avg((F.col("grade") == 2).cast("int")), F.count("*")
    ).first()
    # Some 300 ratings to learn from, of which a fifth stays unseen.
    assert n > 50 and right > always + 0.08


def test_no_ratings():
    model = quality.fit([], [])
    assert (model.tails(np.zeros(3)) > 0.99).all()
