import pytest
from pyspark.ml import Pipeline
from pyspark.ml.linalg import SparseVector, Vectors
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import functions as F

from labelsense.operators import embeddings, evaluate
from labelsense.plans import models
from labelsense.plans.stages import (
    CanonicalWords,
    LemmaEstimator,
    MajorityEstimator,
    MajorityModel,
    SharedIndexer,
    SharedOneHot,
    WordSetEstimator,
    WordSetModel,
)
from labelsense.sources import tables


@pytest.fixture(scope="module")
def two_labels(spark):
    return spark.createDataFrame([(0, "a", "b"), (1, "b", "c"), (2, "c", "e"), (3, "d", "f")], "id long, l1 string, l2 string")


def test_shared_index_and_one_hot(two_labels):
    stages = [
        SharedIndexer(inputCols=["l1", "l2"], outputCols=["i1", "i2"]),
        SharedOneHot(inputCols=["i1", "i2"], outputCols=["e1", "e2"]),
    ]
    model = Pipeline(stages=stages).fit(two_labels)
    rows = model.transform(two_labels).orderBy("id").collect()
    assert [(r.i1, r.i2) for r in rows] == [(2, 0), (0, 1), (1, 4), (3, 5)]
    assert rows[3].e2 == SparseVector(6, [5], [1.0])
    assert rows[0].e1 == SparseVector(6, [2], [1.0])
    assert list(model.stages[0].labelsArray[0]) == ["b", "c", "a", "d", "e", "f"]


def test_majority(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (0.0,), (0.0,), (1.0,), (2.0,), (None,)], "label double")
    model = MajorityEstimator().fit(df)
    assert model.getTopLabel() == 0.0
    models.save(model, str(tmp_path / "m"))
    assert MajorityModel.load(str(tmp_path / "m")).transform(df).filter("prediction = 0").count() == 6


@pytest.fixture(scope="module")
def word_rows(spark):
    rows = [(1, ["red", "dry", "red"]), (2, ["red", "oak"]), (3, ["oak", "dry", "lime"]), (4, ["red"]), (5, [])]
    return spark.createDataFrame(rows, "id long, words array<string>")


def test_word_set_learned(word_rows, tmp_path):
    model = WordSetEstimator(limitTo=3).fit(word_rows)
    assert model.getWordSet() == ["red", "dry", "oak"]
    assert model.getWordCount() == [3, 2, 2]
    rows = {r.id: r.features for r in model.transform(word_rows).collect()}
    assert rows[1] == Vectors.sparse(3, [0, 1], [1.0, 1.0])
    assert rows[5] == Vectors.sparse(3, [], [])
    models.save(model, str(tmp_path / "w"))
    loaded = WordSetModel.load(str(tmp_path / "w"))
    assert {r.id: r.features for r in loaded.transform(word_rows).collect()} == rows


def test_word_set_without_limit(word_rows):
    assert WordSetEstimator().fit(word_rows).getWordSet() == ["red", "dry", "oak", "lime"]


def test_word_set_given_as_list(word_rows):
    model = WordSetEstimator(wordSet=["lime", "red", "lime", "dry", "oak"], limitTo=3, indexWords=False, outputCol="t")
    rows = {r.id: r.t for r in model.fit(word_rows).transform(word_rows).collect()}
    assert rows == {1: ["red", "dry"], 2: ["red"], 3: ["lime", "dry"], 4: ["red"], 5: []}


REVIEWS = [
    ("Tastes of blackberry and oak", "syrah"), ("dark blackberry, oak", "syrah"), ("blackberry tasting dark", "syrah"),
    ("lime and grass", "riesling"), ("crisp lime, grassy", "riesling"), ("crisp taste of grass", "riesling"),
    ("Oak oak blackberry", "syrah"),
] * 4


@pytest.fixture(scope="module")
def review_rows(spark):
    rows = [(i, text, label) for i, (text, label) in enumerate(REVIEWS)]
    return spark.createDataFrame(rows, "id long, description string, variety string")


def test_lemma_estimator(review_rows, tmp_path):
    model = LemmaEstimator(inputCol="description", stopWords=["and", "of"], lower=True).fit(review_rows)
    assert model.getLemmas() == {"tastes": "taste", "tasting": "taste"}
    models.save(model, str(tmp_path / "l"))
    loaded = CanonicalWords.load(str(tmp_path / "l"))
    assert set(loaded.transform(review_rows).filter("id = 0").first().words) == {"taste", "blackberry", "oak"}


def test_pipeline_to_scorer(spark, review_rows, tmp_path):
    pipeline = models.pipeline("description", "variety", models.logistic(), limit=20, stop=["and", "of"])
    fitted = pipeline.fit(review_rows)
    assert fitted.stages[0].labels == ["syrah", "riesling"]
    assert evaluate.scores(fitted.transform(review_rows)).first().accuracy == 1.0
    models.save(fitted, str(tmp_path / "fitted"))
    models.save(models.deployable(models.load(str(tmp_path / "fitted"))), str(tmp_path / "common"))
    scorer = models.load_scorer("common", str(tmp_path))(inputCol="review", outputCol="prediction")
    reviews = spark.createDataFrame([("Lime and grass.",), ("Dark BLACKBERRY",)], "review string")
    assert [r.prediction for r in scorer.transform(reviews).select("review", "prediction").collect()] == ["riesling", "syrah"]


def test_scorer_runs_on_a_stream(spark, review_rows, tmp_path):
    fitted = models.pipeline("description", "variety", models.logistic(), limit=20, stop=["and"]).fit(review_rows)
    models.save(models.deployable(fitted), str(tmp_path / "similar"))
    review_rows.select(F.col("description").alias("review")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("review string").parquet(str(tmp_path / "in"))
    scorer = models.load_scorer("similar", str(tmp_path))(outputCol="grape")
    run = scorer.transform(stream).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("scored").filter("grape is not null").count() == len(REVIEWS)


def test_majority_pipeline_is_deployable(review_rows, tmp_path):
    fitted = models.majority_pipeline("variety").fit(review_rows)
    models.save(models.deployable(fitted), str(tmp_path / "majority"))
    scorer = models.load_scorer("majority", str(tmp_path))(inputCol="description", outputCol="guess")
    assert {r.guess for r in scorer.transform(review_rows.drop("variety")).collect()} == {"syrah"}


def test_scorer_needs_a_model(tmp_path):
    with pytest.raises(NotImplementedError):
        models.Scorer()
    with pytest.raises(KeyError):
        models.load_scorer("unknown", str(tmp_path))


def test_variants_train_and_save(review_rows, tmp_path):
    sets = {"common": ["blackberry", "lime"], "rare": ["dark", "crisp"]}
    pipelines = models.variants("description", "variety", sets, 2, stop=["and"], learn_lemmas=False)
    fitted, table = models.train_all(pipelines, review_rows, review_rows, str(tmp_path))
    assert set(fitted) == set(sets)
    assert table.count() == 4
    assert models.load(str(tmp_path / "rare")).stages[2].getWordSet() == ["dark", "crisp"]


def test_all_classifiers(review_rows):
    prepared = models.pipeline("description", "variety", models.logistic(), limit=20).getStages()[:-1]
    features = Pipeline(stages=prepared).fit(review_rows).transform(review_rows)
    chosen = {
        "logistic": models.logistic(), "bayes": models.bayes(), "forest": models.forest(trees=5, seed=1),
        "boosted": models.boosted(depth=2, maxIter=2, seed=1),
    }
    table = models.compare_models(features, features, chosen)
    assert {r.name for r in table.collect()} == set(chosen)
    assert table.filter("accuracy < 0.9").count() == 0


def test_grid_and_metric_table(spark, review_rows, tmp_path):
    words = CanonicalWords(inputCol="description", lower=True).transform(review_rows)
    rows = evaluate.folds(words, "id").withColumn("label", (F.col("variety") == "syrah").cast("double"))
    rows = evaluate.with_class_weight(rows, "variety").persist()
    stage = WordSetEstimator()
    sets = {"common": ["blackberry", "lime", "oak"], "poor": ["and", "of"]}
    grid = {stage.limitTo: [1, 3], stage.wordSet: list(sets.values())}
    pipeline = Pipeline(stages=[stage, models.bayes()])
    tuned = {m: evaluate.grid_search(rows, pipeline, grid, m, weight="weight", fold_col="fold") for m in ("accuracy", "f1")}
    models.save(tuned["f1"], str(tmp_path / "tuned"))
    tuned["f1"] = CrossValidatorModel.load(str(tmp_path / "tuned"))
    table = evaluate.metric_table(spark, tuned, sets)
    evaluate.save_metrics(table, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 4
    found = {(r.limitTo, r.wordSet): r.accuracy for r in table.collect()}
    assert len(found) == 4
    assert found[3, "common"] > found[3, "poor"]
    best = evaluate.metric_slice(table, "wordSet", "accuracy", limitTo=3).collect()
    assert [r.wordSet for r in best] == ["common", "poor"]
    assert evaluate.holdout(tuned["accuracy"].bestModel, rows, "weight").first().accuracy > 0.8


def test_word2vec_and_bottleneck(spark, review_rows, tmp_path):
    words = CanonicalWords(inputCol="description", lower=True).transform(review_rows)
    model = embeddings.train(words, "words", "variety", vector_size=5, min_count=1, partitions=1)
    vectors = embeddings.word_vectors(model)
    names = spark.createDataFrame([("syrah",), ("riesling",), ("unseen",)], "label string")
    label_vectors = embeddings.label_vectors(vectors, names)
    assert label_vectors.count() == 2
    near = embeddings.nearest(vectors, label_vectors, 3)
    assert near.count() == 6
    assert near.filter("word = label").count() == 0
    pairs = models.index_pairs(words, "words", "variety").persist()
    width = pairs.first().features.size
    fitted = models.bottleneck(width, width, hidden=4, epochs=5, seed=1).fit(pairs)
    assert fitted.transform(pairs).count() == pairs.count()
    tables.write_table(evaluate.sample(pairs.withColumn("id", F.monotonically_increasing_id()), "id", 0.5), str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).first().features.size == width
