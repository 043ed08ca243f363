"""Stages with tables for models: the same as the stages with lists, of any size, saved and loaded."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from labelsense.plans import stages, table_stages

ROWS = [(1, ["b", "a", "b"], "x", "y"), (2, ["a", "c"], "y", None), (3, [], "x", "z"), (4, None, None, "y"), (5, ["a", "b"], "q", "y")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, words array<string>, one string, two string").withColumn("rank", F.lit("mine"))


def found(model, rows, column="features"):
    return {r.id: r[column] for r in model.transform(rows).collect()}


def test_all_words_without_a_limit(rows):
    model = table_stages.TableWordSetEstimator().fit(rows)
    assert [(r["rank"], r.word, r["count"]) for r in model.table.orderBy("rank").collect()] == [(0, "a", 3), (1, "b", 2), (2, "c", 1)]
    assert found(model, rows) == {1: [0, 1], 2: [0, 2], 3: [], 4: [], 5: [0, 1]}
    assert model.transform(rows).columns == [*rows.columns, "features"]
    limited = table_stages.TableWordSetEstimator(limitTo=2, indexWords=False, outputCol="rank").fit(rows)
    assert found(limited, rows, "rank") == {1: ["a", "b"], 2: ["a"], 3: [], 4: [], 5: ["a", "b"]}


def test_same_words_as_the_stage_with_a_list(rows):
    some = rows.filter("words is not null")
    lists = stages.WordSetEstimator(limitTo=2, indexWords=False).fit(some)
    tables = table_stages.TableWordSetEstimator(limitTo=2, indexWords=False).fit(some)
    assert found(tables, some) == found(lists, some)


def test_shared_index(rows):
    fitted = table_stages.TableIndexer(inputCols=["one", "two"], outputCols=["i", "j"]).fit(rows)
    got = {r.id: (r.i, r.j) for r in fitted.transform(rows).collect()}
    assert got == {1: (1.0, 0.0), 2: (0.0, None), 3: (1.0, 3.0), 4: (None, 0.0), 5: (2.0, 0.0)}
    other = rows.limit(1).withColumn("one", F.lit("never seen"))
    assert fitted.transform(other).first().i == 4.0


def test_saved_with_a_pipeline(rows, tmp_path):
    pipeline = Pipeline(stages=[
        table_stages.TableIndexer(inputCols=["one"], outputCols=["i"]), table_stages.TableWordSetEstimator(outputCol="f"),
    ])
    pipeline.write().overwrite().save(str(tmp_path / "plain"))
    fitted = Pipeline.load(str(tmp_path / "plain")).fit(rows)
    fitted.write().overwrite().save(str(tmp_path / "fitted"))
    loaded = PipelineModel.load(str(tmp_path / "fitted"))
    assert sorted(map(str, loaded.transform(rows).collect())) == sorted(map(str, fitted.transform(rows).collect()))
    assert [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages]
    copied = fitted.stages[1].copy({fitted.stages[1].indexWords: False})
    assert found(copied, rows, "f")[1] == ["a", "b"]


def test_empty_table(rows):
    nothing = rows.limit(0)
    model = table_stages.TableWordSetEstimator().fit(nothing)
    assert model.table.count() == 0 and model.transform(nothing).count() == 0 and found(model, rows)[1] == []
