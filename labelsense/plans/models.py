"""Classifiers, the named pipelines, their training and their use on new rows."""

from functools import partial

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from labelsense.functions.stopwords import ENGLISH, REVIEW_BLACKLIST, stop_words
from labelsense.operators.evaluate import scores
from labelsense.operators.wordsets import exploded_words
from labelsense.plans.stages import (
    CanonicalWords,
    LemmaEstimator,
    MajorityEstimator,
    SharedIndexer,
    SharedOneHot,
    WordSetEstimator,
)

STRATEGIES = ["common", "similar", "dissimilar", "extremes", "low_entropy"]
SCORERS = ["majority", *STRATEGIES]
FEATURES_PER_LABEL = 14
NUMBER = "label_number"


def logistic(reg_param: float = 0.01, elastic_net: float = 0.01, **params) -> LogisticRegression:
    return LogisticRegression(regParam=reg_param, elasticNetParam=elastic_net, **params)


def forest(trees: int = 250, depth: int = 10, memory_mb: int = 256, **params) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, maxMemoryInMB=memory_mb, **params)


def boosted(depth: int = 10, parallelism: int = 2, **params) -> OneVsRest:
    return OneVsRest(classifier=GBTClassifier(maxDepth=depth, **params), parallelism=parallelism)


def bayes(smoothing: float = 1.0, **params) -> NaiveBayes:
    return NaiveBayes(smoothing=smoothing, modelType="bernoulli", **params)


def bottleneck(n_words: int, n_labels: int, hidden: int = 50, epochs: int = 15, **params) -> MultilayerPerceptronClassifier:
    """Network from a one-hot word through a narrow layer to the label."""
    return MultilayerPerceptronClassifier(layers=[n_words, n_words, hidden, n_labels], maxIter=epochs, **params)


def pipeline(
    text: str,
    label: str,
    classifier: Estimator,
    word_set: list[str] | None = None,
    limit: int | None = None,
    stop: list[str] | None = None,
    learn_lemmas: bool = True,
    lower: bool = True,
) -> Pipeline:
    """Label index, words, tracked words, classifier."""
    stop = stop_words(REVIEW_BLACKLIST, base=ENGLISH) if stop is None else stop
    stage = LemmaEstimator if learn_lemmas else CanonicalWords
    return Pipeline(
        stages=[
            # A label that only new rows have gets a number of its own, and can't be predicted.
            StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep"),
            stage(inputCol=text, outputCol="words", stopWords=stop, lower=lower),
            WordSetEstimator(inputCol="words", outputCol="features", wordSet=word_set, limitTo=limit),
            classifier,
        ]
    )


def majority_pipeline(label: str) -> Pipeline:
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep"), MajorityEstimator()])


def prepared_variants(word_sets: dict[str, list[str]], n_labels: int, **params) -> dict[str, Pipeline]:
    """The last two stages of ``variants``, for rows that have ``label`` and ``words`` already."""
    limit = FEATURES_PER_LABEL * n_labels
    return {
        name: Pipeline(stages=[WordSetEstimator(wordSet=words, limitTo=limit), logistic(**params)])
        for name, words in word_sets.items()
    }


def variants(text: str, label: str, word_sets: dict[str, list[str]], n_labels: int, **options) -> dict[str, Pipeline]:
    """One logistic pipeline per word-set strategy, with 14 words per label."""
    limit = FEATURES_PER_LABEL * n_labels
    return {
        name: pipeline(text, label, logistic(), word_set=words, limit=limit, **options)
        for name, words in word_sets.items()
    }


def train_all(pipelines: dict[str, Pipeline], train: DataFrame, test: DataFrame, path: str | None = None):
    """Fit every pipeline, score it on both tables, save it if a path is given.

    Returns the fitted models and a table (name, rows, accuracy, f1).
    """
    models, table = {}, []
    for name, stages in pipelines.items():
        models[name] = stages.fit(train)
        for rows, df in (("train", train), ("test", test)):
            accuracy, f1 = scores(models[name].transform(df)).first()
            table.append(Row(name=name, rows=rows, accuracy=accuracy, f1=f1))
        if path is not None:
            save(models[name], f"{path}/{name}")
    return models, train.sparkSession.createDataFrame(table)


def compare_models(features: DataFrame, test: DataFrame, classifiers: dict[str, Estimator]) -> DataFrame:
    """(name, accuracy, f1) of several classifiers on the same features.

    All tables of one row each; the features are kept for the duration of the loop.
    """
    features = features.persist()
    try:
        rows = []
        for name, classifier in classifiers.items():
            accuracy, f1 = scores(classifier.fit(features).transform(test)).first()
            rows.append(Row(name=name, accuracy=accuracy, f1=f1))
    finally:
        features.unpersist()
    return test.sparkSession.createDataFrame(rows)


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def deployable(model: PipelineModel, out: str = "predicted_label") -> PipelineModel:
    """A fitted pipeline without its label index, ending in the name of the predicted label."""
    index, *rest = model.stages
    back = IndexToString(inputCol=rest[-1].getPredictionCol(), outputCol=out, labels=index.labels)
    return PipelineModel([*rest, back])


class Scorer(PipelineModel):
    """A saved, deployable pipeline bound to the columns of the caller.

    It is a ``PipelineModel``: it can be saved, and be a stage of another pipeline. The first stage
    reads ``inputCol`` and the last one writes ``outputCol``; the classifier's own number goes to
    ``label_number``, so that the caller may ask for any name.
    """

    def __init__(self, inputCol: str = "review", outputCol: str = "prediction", modelPath: str | None = None):
        if modelPath is None:
            raise NotImplementedError("only trained models can score: give a modelPath")
        stages = load(modelPath).stages
        stages[0].setInputCol(inputCol)
        classifier, back = stages[-2], stages[-1]
        if classifier.hasParam("predictionCol"):
            classifier.setPredictionCol(NUMBER)
        else:
            classifier.setOutputCol(NUMBER)
        back.setInputCol(NUMBER).setOutputCol(outputCol)
        super().__init__(stages)


def load_scorer(name: str, folder: str):
    """Constructor of the named scorer: call it with input and output column."""
    if name not in SCORERS:
        raise KeyError(f"unknown scorer {name}; one of {', '.join(SCORERS)}")
    return partial(Scorer, modelPath=f"{folder}/{name}")


def unindex(df: DataFrame, labels: list[str], index_col: str = "prediction", out: str = "predicted_label") -> DataFrame:
    return IndexToString(inputCol=index_col, outputCol=out, labels=labels).transform(df)


def _pairs(df: DataFrame, words: str, label: str) -> DataFrame:
    return exploded_words(df, words, F.col(label).alias("_label")).withColumnRenamed("word", "_word")


def pair_index(df: DataFrame, words: str, label: str) -> tuple[PipelineModel, DataFrame]:
    """One index over the words and labels of all rows, and its pairs (label, features).

    The index lives on the driver: track a word set of limited size first.
    """
    rows = _pairs(df, words, label)
    indexer = SharedIndexer(inputCols=["_label", "_word"], outputCols=["label", "word_index"]).fit(rows)
    # The width of the vectors is told by the distinct words.
    places = indexer.transform(rows.groupBy("_label", "_word").agg(F.count(F.lit(1))))
    fitted = PipelineModel([indexer, SharedOneHot(inputCols=["word_index"], outputCols=["features"]).fit(places)])
    return fitted, fitted.transform(rows).select("label", "features")


def indexed_pairs(index: PipelineModel, df: DataFrame, words: str, label: str) -> DataFrame:
    """The pairs (label, features) of other rows; those with a word or label unknown are left out."""
    index.stages[0].setHandleInvalid("skip")
    return index.transform(_pairs(df, words, label)).select("label", "features")


def counted_pairs(index: PipelineModel, df: DataFrame, words: str, label: str) -> DataFrame:
    """The distinct pairs (label, word_index, features, n) of rows, n times each; those with a word or label unknown are left out."""
    index.stages[0].setHandleInvalid("skip")
    counted = _pairs(df, words, label).groupBy("_label", "_word").agg(F.count(F.lit(1)).alias("n"))
    return index.transform(counted).select("label", "word_index", "features", "n")


def index_pairs(df: DataFrame, words: str, label: str) -> DataFrame:
    """One row per word of each review with word and label on one shared index (label, features)."""
    return pair_index(df, words, label)[1]
