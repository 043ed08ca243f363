"""Training on counted pairs against Spark's perceptron on the repeated rows."""

from collections import Counter

import numpy as np
from pyspark.ml.linalg import Vectors

from labelsense.operators import network
from labelsense.plans import models


def _pairs(spark, factor=1):
    counted = [(0, 5, 9), (1, 5, 3), (1, 4, 4), (2, 4, 11), (3, 4, 1), (3, 5, 2), (4, 4, 2), (5, 5, 2)]
    return spark.createDataFrame([(w, float(c), n * factor) for w, c, n in counted], "word int, label double, n long")


def test_counted_pairs_give_sparks_network(spark):
    pairs = _pairs(spark)
    rows = [(Vectors.sparse(6, {r.word: 1.0}), r.label) for r in pairs.collect() for _ in range(r.n)]
    repeated = spark.createDataFrame(rows, ["features", "label"]).coalesce(1)
    for epochs in (1, 4, 15):
        classifier = models.bottleneck(6, 6, hidden=4, epochs=epochs, seed=3, blockSize=1000)
        expected, found = classifier.fit(repeated), network.fit_counted(classifier, pairs)
        assert np.allclose(expected.weights.toArray(), found.weights.toArray(), atol=1e-6)
        assert [r.prediction for r in found.transform(repeated).collect()] == [
            r.prediction for r in expected.transform(repeated).collect()
        ]


def test_a_million_repetitions_are_as_many_rows(spark):
    classifier = models.bottleneck(6, 6, hidden=4, epochs=5, seed=3)
    few, many = (network.fit_counted(classifier, _pairs(spark, factor)) for factor in (1, 1_000_000_000))
    assert np.allclose(few.weights.toArray(), many.weights.toArray(), atol=1e-6)


def test_distinct_pairs_are_counted(spark):
    df = spark.createDataFrame([(["a", "b"], "x"), (["a"], "x"), (["a"], "y"), ([], "y")], "words array<string>, lang string")
    index, pairs = models.pair_index(df, "words", "lang")
    counted = models.counted_pairs(index, df, "words", "lang").collect()
    repeated = Counter((r.label, str(r.features)) for r in pairs.collect())
    assert {(r.label, str(r.features)): r.n for r in counted} == repeated
    other = spark.createDataFrame([(["a", "new"], "x"), (["b"], "unknown")], "words array<string>, lang string")
    assert [r.n for r in models.counted_pairs(index, other, "words", "lang").collect()] == [1]
