"""Findings of round 3: work that grew with the rows more than it had to."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from labelsense.functions.text import lemmatised
from labelsense.operators import grid
from labelsense.plans import models, registry


def _rows(spark, times):
    rows = [
        (t * 100 + i, i % 2, [w for k, w in enumerate(["a", "b", "c"]) if (i + k) % 3 != i % 2], i % 3, 0.5 + i % 2)
        for t in range(times) for i in range(12)
    ]
    return spark.createDataFrame(rows, "id long, label int, words array<string>, fold int, weight double")


def test_rows_alike_for_a_set_are_counted(spark):
    sets = {"all": ["a", "b", "c"], "one": ["b"]}
    once, often = (grid.encoded(_rows(spark, times), "id", "words", sets) for times in (1, 5))
    assert often.rows.count() == once.rows.count()
    assert {r.s: r.n for r in often.rows.groupBy("s").agg(F.sum("n").alias("n")).collect()} == {0: 60, 1: 60}
    points = [grid.Point("all", 3), grid.Point("all", 1, 0.1, 0.5), grid.Point("one", 1)]
    assert grid.statistics(often).classes.tolist() == (grid.statistics(once).classes * 5).tolist()
    a, b = (grid.scored(d, grid.bayes(d, points, smoothing=0.0001), points).collect() for d in (once, often))
    rounded = [sorted([(*r[:5], *[round(m, 9) for m in r[5:]]) for r in found]) for found in (a, b)]
    assert rounded[0] == rounded[1]


def test_pipeline_fitted_by_steps_is_that_of_one_fit(spark):
    texts = [(f"river walks {'stone' if i % 2 else 'hill'} walk number {'x' * (i % 3 + 1)}", "en" if i % 2 else "de") for i in range(30)]
    docs = spark.createDataFrame(texts, "text string, lang string")
    train = registry._split_texts(docs).withColumnRenamed("words", "plain")
    read = []

    class Watched(LogisticRegression):
        def _fit(self, dataset):
            read.append(dataset.columns)
            return super()._fit(dataset)

    stages = models.pipeline("plain", "lang", models.logistic(), limit=5).getStages()
    by_steps = registry._fitted_by_steps(Pipeline(stages=[*stages[:3], Watched(regParam=0.01, elasticNetParam=0.01)]), train)
    at_once = Pipeline(stages=stages).fit(train)
    assert read == [["label", "features"]]
    assert by_steps.stages[-1].numClasses == at_once.stages[-1].numClasses
    a, b = (m.transform(train).select("prediction").collect() for m in (by_steps, at_once))
    assert a == b


def test_words_of_letters_are_not_matched_again(spark):
    df = spark.createDataFrame([(["walks", "walk", "talks"],)], "words array<string>")
    plain = df.select(lemmatised(F.col("words"), lemmas={"walks": "walk"}).alias("w"))
    assert plain.first().w == ["walk", "talks"]
    assert "RLIKE" not in plain._jdf.queryExecution().toString().upper()
    assert df.select(lemmatised(F.col("words"), lemmas={"walks": "w-1"}).alias("w")).first().w == ["walk", "talks"]


def test_model_is_looked_up_once_a_batch():
    import public_tokenizers

    from labelsense.llm import packing

    class Watched:
        def __init__(self, own):
            self.own, self.looks = own, 0

        def __getattr__(self, name):
            self.looks += name == "model"
            return getattr(self.own, name)

    known = packing.Words(Watched(packing.tokenizer(public_tokenizers.path(packing.VOCABULARY))))
    names = ["walk", "straße", "ΟΔΟΣ", "ёлка", "Walk", "a1", "don't", "漢字", "İ", "ét", "ﬁn"] * 3
    before = known.model.looks
    assert known._encode_words(names) == known.encode(names)
    assert known.model.looks - before == 1
