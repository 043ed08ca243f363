"""Splits, weights, scores and tuning."""

from collections import Counter

from pyspark.ml import Estimator
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsense.functions.buckets import hash_bucket
from labelsense.operators.scale import lookup_join


def split(df: DataFrame, id_col: str, train_share: float = 0.9, seed: str = "split") -> tuple[DataFrame, DataFrame]:
    """Training and test rows by the hash of the id: the same rows on every run and retry."""
    is_train = hash_bucket(id_col, 1000, seed) < round(train_share * 1000)
    return df.filter(is_train), df.filter(~is_train)


def folds(df: DataFrame, id_col: str, n: int = 3, seed: str = "fold", out: str = "fold") -> DataFrame:
    """Fold number 0..n-1 by the hash of the id."""
    return df.withColumn(out, hash_bucket(id_col, n, seed).cast("int"))


def sample(df: DataFrame, id_col: str, share: float, seed: str = "sample") -> DataFrame:
    """A share of the rows, chosen by the hash of the id."""
    return df.filter(hash_bucket(id_col, 1_000_000, seed) < round(share * 1_000_000))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): 1 / (number of labels * rows of the label), so all labels weigh the same."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_rows"))
    n_labels = counts.agg(F.count(F.lit(1))).scalar()
    return counts.select(label, (1 / (n_labels * F.col("_rows"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, weights: DataFrame | None = None) -> DataFrame:
    """Add the weight of the row's label; rows without a label, or with one that has no weight, are left out."""
    weights = class_weights(df, label) if weights is None else weights
    return lookup_join(df, weights, [label])


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction", weight: str | None = None):
    """(label, prediction, n): rows, or weight, per pair; the base of all scores below."""
    amount = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return predictions.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.sum(amount).alias("n")
    )


def scores(predictions: DataFrame, label: str = "label", prediction: str = "prediction", weight: str | None = None):
    """One row (accuracy, f1): f1 is the mean of the f1 per label, weighted by the label's rows."""
    table = confusion(predictions, label, prediction, weight)
    sides = table.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("value"),
                    F.col("n").alias("actual"),
                    F.lit(0.0).alias("predicted"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0.0).alias("hit"),
                ),
                F.struct(
                    F.col("prediction").alias("value"), F.lit(0.0).alias("actual"), F.col("n").alias("predicted"),
                    F.lit(0.0).alias("hit"),
                ),
            )
        )
    )
    per_label = sides.groupBy("value").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    f1 = F.when(F.col("actual") + F.col("predicted") > 0, 2 * F.col("hit") / (F.col("actual") + F.col("predicted")))
    return per_label.agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy"),
        (F.sum(f1 * F.col("actual")) / F.sum("actual")).alias("f1"),
    )


def evaluator(metric: str, weight: str | None = None, label: str = "label") -> MulticlassClassificationEvaluator:
    """Spark ML evaluator for ``accuracy`` or ``f1``, by rows or by weight."""
    chosen = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)
    return chosen.setWeightCol(weight) if weight else chosen


def report(predictions: DataFrame, weight: str | None = None) -> DataFrame:
    """Accuracy in percent with one digit, f1 with four."""
    return scores(predictions, weight=weight).select(
        F.round(F.col("accuracy") * 100, 1).alias("accuracy_percent"), F.round("f1", 4).alias("f1")
    )


def vs_baseline(predictions: DataFrame, baseline: DataFrame, weight: str | None = None) -> DataFrame:
    """Scores of a model next to those of the majority baseline on the same rows."""
    model = scores(predictions, weight=weight).select(F.lit("model").alias("name"), "accuracy", "f1")
    return model.unionByName(scores(baseline, weight=weight).select(F.lit("majority").alias("name"), "accuracy", "f1"))


def grid_search(
    df: DataFrame,
    estimator: Estimator,
    grid: dict,
    metric: str = "accuracy",
    weight: str | None = None,
    n_folds: int = 3,
    fold_col: str = "",
    parallelism: int = 2,
) -> CrossValidatorModel:
    """Cross-validate every combination of the values in ``grid`` (param -> list of values).

    The prepared rows are used by every fit; persist them before the call.
    """
    builder = ParamGridBuilder()
    for param, values in grid.items():
        builder = builder.addGrid(param, values)
    return CrossValidator(
        estimator=estimator,
        estimatorParamMaps=builder.build(),
        evaluator=evaluator(metric, weight),
        numFolds=n_folds,
        foldCol=fold_col,
        parallelism=parallelism,
    ).fit(df)


def fold_scores(
    df: DataFrame, points: list[tuple[dict, Estimator]], weight: str = "weight", fold_col: str = "fold"
) -> DataFrame:
    """Accuracy and f1, by rows and by weight, of each estimator, as means over the folds.

    Each estimator is fitted once per fold; all four scores come from its one table of labels and
    predictions. ``points`` pairs the values that describe an estimator, the columns of the result,
    with it. Persist ``df`` before the call.
    """
    spark, rows = df.sparkSession, []
    numbers = [row[0] for row in df.select(fold_col).distinct().orderBy(fold_col).collect()]
    for described, estimator in points:
        sums = [0.0] * 4
        for number in numbers:
            model = estimator.fit(df.filter(F.col(fold_col) != number))
            predicted = model.transform(df.filter(F.col(fold_col) == number)).select("label", "prediction", weight)
            pairs = predicted.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
            sums = [a + b for a, b in zip(sums, _four_scores(pairs.collect()), strict=True)]  # at most labels squared
        rows.append((*described.values(), *[total / len(numbers) for total in sums]))
    columns = [*points[0][0], "accuracy", "f1", "weighted_accuracy", "weighted_f1"]
    return spark.createDataFrame(rows, columns)


def _four_scores(pairs: list) -> list[float]:
    """Accuracy and f1 from rows (label, prediction, n, w), by n and then by w."""
    found = []
    for amount in ("n", "w"):
        actual, predicted, hit = Counter(), Counter(), Counter()
        for row in pairs:
            actual[row["label"]] += row[amount]
            predicted[row["prediction"]] += row[amount]
            if row["label"] == row["prediction"]:
                hit[row["label"]] += row[amount]
        total = sum(actual.values())
        f1 = sum(n * 2 * hit[label] / (n + predicted[label]) for label, n in actual.items())
        found += [sum(hit.values()) / total, f1 / total]
    return found


def metric_table(
    spark: SparkSession, models: dict[str, CrossValidatorModel], word_sets: dict[str, list[str]] | None = None
) -> DataFrame:
    """One row per parameter combination with the mean of each metric over the folds.

    ``models`` maps a metric name to the model tuned by it, all on one grid. A word set given as
    a parameter value is shown by its name.
    """
    names = {tuple(words): name for name, words in (word_sets or {}).items()}
    first = next(iter(models.values()))
    rows = []
    for i, params in enumerate(first.getEstimatorParamMaps()):
        row = {
            param.name: names.get(tuple(value), str(value)) if isinstance(value, (list, tuple)) else value
            for param, value in params.items()
        }
        row.update({metric: float(model.avgMetrics[i]) for metric, model in models.items()})
        rows.append(row)
    columns = list(rows[0])
    return spark.createDataFrame([tuple(row[c] for c in columns) for row in rows], columns)


def metric_slice(table: DataFrame, by: str, metric: str, **fixed) -> DataFrame:
    """Best and mean value of a metric per value of one parameter, others fixed if given."""
    for name, value in fixed.items():
        table = table.filter(F.col(name) == value)
    return table.groupBy(by).agg(F.max(metric).alias(f"best_{metric}"), F.avg(metric).alias(f"mean_{metric}")).orderBy(by)


def save_metrics(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def holdout(model, df: DataFrame, weight: str | None = None) -> DataFrame:
    """Scores of a fitted model on rows it has not seen."""
    return scores(model.transform(df), weight=weight)
