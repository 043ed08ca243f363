"""Boosted trees of all labels grown together, against Spark's own."""

import random

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.linalg import DenseVector, SparseVector
from pyspark.sql import functions as F

from labelsense.operators import boosting
from labelsense.plans import models, registry

WIDTH = 10


def _rows(spark, n, seed=3):
    draw, rows = random.Random(seed), []
    for i in range(n):
        held = [p for p in range(WIDTH) if draw.random() < 0.4]
        label = (2 * (0 in held) + (1 in held) + (4 in held and 5 not in held)) if draw.random() < 0.8 else draw.randrange(6)
        vector = SparseVector(WIDTH, held, [1.0] * len(held)) if i % 3 else DenseVector([float(p in held) for p in range(WIDTH)])
        rows.append((f"label{label}", vector))
    table = spark.createDataFrame(rows, ["name", "features"])
    return StringIndexer(inputCol="name", outputCol="label", handleInvalid="keep").fit(table).transform(table)


def _told(model, rows):
    return [(r.prediction, [round(m, 6) for m in r.rawPrediction]) for r in model.transform(rows).select("prediction", "rawPrediction").collect()]


def test_trees_are_those_of_spark(spark):
    rows = _rows(spark, 400).persist()
    for params in ({"depth": 4, "maxIter": 3}, {"depth": 3, "maxIter": 2, "minInstancesPerNode": 9, "minInfoGain": 0.01, "stepSize": 0.3}, {"depth": 0, "maxIter": 2}):
        one = models.boosted(seed=1, **params)
        ours, theirs = _told(boosting.BoostedTogether(one).fit(rows), rows), _told(one.fit(rows), rows)
        assert [p for p, _ in ours] == [p for p, _ in theirs]
        assert all(a == pytest.approx(b, abs=1e-5) for (_, a), (_, b) in zip(ours, theirs, strict=True)), params


def test_passes_do_not_grow_with_labels(spark, monkeypatch):
    rows, boosted = _rows(spark, 200), models.boosted
    monkeypatch.setattr(registry, "_features", lambda *_: (rows, rows))
    monkeypatch.setattr(models, "boosted", lambda **o: boosted(depth=3, maxIter=2, **o))
    jobs = []
    for group, run in (("all", lambda: registry.boosted_metrics(spark, "").collect()), ("each", lambda: boosted(depth=3, maxIter=2).fit(rows))):
        spark.sparkContext.setJobGroup(group, group)
        run()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] < jobs[1]


def test_dealing_and_pieces_change_nothing(spark, monkeypatch):
    rows = _rows(spark, 300)
    one = models.boosted(depth=4, maxIter=3, maxMemoryInMB=1)
    expected = boosting.BoostedTogether(one).fit(rows).getOrDefault("trees")
    monkeypatch.setattr(boosting, "PIECE_CELLS", 1)
    monkeypatch.setattr(boosting, "_parts", lambda open_, most, parts=boosting._parts: parts(open_, 3))
    again = boosting.BoostedTogether(one).fit(rows.repartition(5, F.rand(2)))
    assert again.getOrDefault("trees") == expected


def test_model_is_saved_and_odd_input_refused(spark, tmp_path):
    rows = _rows(spark, 60)
    model = boosting.BoostedTogether(models.boosted(depth=2, maxIter=2)).fit(rows)
    models.save(model, str(tmp_path / "m"))
    assert _told(boosting.BoostedTreesModel.load(str(tmp_path / "m")), rows) == _told(model, rows)
    with pytest.raises(ValueError, match="subsamplingRate"):
        boosting.BoostedTogether(models.boosted(subsamplingRate=0.5))
    with pytest.raises(ValueError, match="0 or 1"):
        boosting.BoostedTogether(models.boosted()).fit(spark.createDataFrame([(0.0, DenseVector([2.0]))], ["label", "features"]))
    with pytest.raises(ValueError, match="no row"):
        boosting.BoostedTogether(models.boosted()).fit(rows.filter("false"))


def test_only_words_that_may_be_tracked_are_lemmatised(spark, tmp_path, monkeypatch):
    draw = random.Random(5)
    base = ["walk", "talk", "jump", "river", "stone", "cloud", "house", "tree", "light", "grass"]
    words = [w + e for w in base for e in ("", "s", "ed", "ing")]
    rows = [(i, " ".join(draw.choices(words[: 20 + i % 20], k=i % 9)), ["en", "de", None][i % 3]) for i in range(200)]
    spark.createDataFrame(rows, "doc_id int, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    train, test = registry._prepared(spark, str(tmp_path))
    plain = registry.WordSetEstimator(inputCol="words", outputCol="features", limitTo=4).fit(train)
    expected = [sorted((r.doc_id, r.label, r.features) for r in plain.transform(part).collect()) for part in (train, test)]
    forms, told = registry.wordsets.forms_of_common, []
    monkeypatch.setattr(registry.wordsets, "forms_of_common", lambda *a: told.append(forms(*a)) or told[-1])
    for most in (2000, 1):
        if most == 1:
            monkeypatch.setattr(registry.wordsets, "forms_of_common", lambda *a: told.append(forms(*a, most)) or told[-1])
        found = [sorted((r.doc_id, r.label, r.features) for r in part.collect()) for part in registry._features(spark, str(tmp_path), 1)]
        assert found == expected
    assert set(told[0]) < set(words)
    assert told[1] is None
