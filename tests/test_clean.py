import pytest
from pyspark.sql import functions as F

from labelsense.operators import clean, evaluate, labels, profile
from labelsense.sources import tables


def reviews(spark):
    rows = [
        (0, "A Malbec of note", "Malbec", 12.0),
        (1, "a malbec of NOTE", "malbec", None),
        (2, "A malbec of note", "Syrah", 9.0),
        (3, "dark", None, 7.0),
        (4, "light", "Syrah", 8.0),
        (5, "pale", "Gamay", 8.0),
    ]
    return spark.createDataFrame(rows, "id long, text string, label string, price double")


def test_lower_strings(spark):
    lowered = clean.lower_strings(reviews(spark))
    assert lowered.schema["price"].dataType.simpleString() == "double"
    assert lowered.filter("id = 0").first()[1:3] == ("a malbec of note", "malbec")


def test_clean_reviews(spark):
    found = clean.clean_reviews(reviews(spark), "id", "text", "label", threshold=0.9)
    assert sorted(map(tuple, found.collect())) == [
        (0, "a variety of note", "malbec"),
        (2, "a malbec of note", "syrah"),
        (4, "light", "syrah"),
        (5, "pale", "gamay"),
    ]


def test_mask_is_a_plain_replace(spark):
    df = spark.createDataFrame([("the redder reds", "red"), ("a.b", "."), ("kept", None)], "text string, label string")
    masked = [r.text for r in clean.mask_label(df, "text", "label").collect()]
    assert masked == ["the varietyder varietys", "avarietyb", "kept"]


@pytest.mark.parametrize(
    ("counts", "threshold", "extra", "kept"),
    [
        ([62, 15, 13, 10], 0.6, 1, 2),
        ([62, 15, 13, 10], 0.6, 0, 1),
        ([50, 50], 0.9, 1, 2),
        ([10] * 10, 0.9, 1, 10),
        ([10] * 10, 0.5, 0, 6),
        ([100], 0.9, 1, 1),
    ],
)
def test_coverage_cut(spark, counts, threshold, extra, kept):
    table = spark.createDataFrame([(f"l{i:02}", n) for i, n in enumerate(counts)], "label string, count long")
    found = clean.common_labels(table, "label", threshold, extra).orderBy("rank").collect()
    assert [r.label for r in found] == [f"l{i:02}" for i in range(kept)]


def test_value_counts_share_includes_missing(spark):
    found = profile.value_counts(clean.lower_strings(reviews(spark)), "label").collect()
    assert [tuple(r) for r in found[:1]] == [("malbec", 2, 2 / 6)]


def test_missing_and_mentions(spark):
    lowered = clean.lower_strings(reviews(spark))
    assert {r.column_name: r.n_missing for r in profile.missing(lowered, "label", "price").collect()} == {
        "label": 1, "price": 1,
    }
    assert profile.label_mentions(lowered, "text", "label").first().n_mentions == 2


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'She said "dry", twice', "a\nb", 5.5), (2, "plain", None, None)]
    df = spark.createDataFrame(rows, "id long, description string, variety string, price double")
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, tables.read_reviews_csv(spark, str(tmp_path / "csv"), df.schema, line_breaks=True).collect())) == rows
    inferred = tables.read_reviews_csv(spark, str(tmp_path / "csv"), None, line_breaks=True)
    assert dict(inferred.dtypes)["price"] == "double"


def test_table_and_word_set_round_trip(spark, tmp_path):
    df = reviews(spark)
    tables.write_table(df, str(tmp_path / "t"))
    assert tables.read_table(spark, str(tmp_path / "t")).count() == 6
    for name, words in (("common", ["red", "dry"]), ("similar", ["oak"])):
        ranked = spark.createDataFrame(list(enumerate(words)), "rank int, word string")
        tables.write_word_set(ranked, name, str(tmp_path / "w"))
    assert tables.read_word_set(spark, str(tmp_path / "w")).count() == 3
    assert tables.word_list(tables.read_word_set(spark, str(tmp_path / "w"), "common"), 1) == ["red"]


def test_split_and_folds_cover_all_rows_once(spark):
    df = spark.range(5000)
    train, test = evaluate.split(df, "id")
    assert train.count() + test.count() == 5000
    assert train.join(test, "id").count() == 0
    assert 4350 < train.count() < 4650
    sizes = [r["count"] for r in evaluate.folds(df, "id").groupBy("fold").count().collect()]
    assert len(sizes) == 3 and min(sizes) > 1500


def test_scores_match_spark_ml(spark):
    rows = [(float(i % 3), float((i * 7) % 4 % 3), 1.0 + i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "label double, prediction double, weight double")
    for weight in (None, "weight"):
        accuracy, f1 = evaluate.scores(df, weight=weight).first()
        assert accuracy == pytest.approx(evaluate.evaluator("accuracy", weight).evaluate(df))
        assert f1 == pytest.approx(evaluate.evaluator("f1", weight).evaluate(df))


def test_class_weights_give_labels_equal_mass(spark):
    df = clean.drop_missing(clean.lower_strings(reviews(spark)), "label")
    mass = evaluate.with_class_weight(df, "label").groupBy("label").agg(F.sum("weight").alias("m")).collect()
    assert all(r.m == pytest.approx(1 / 3) for r in mass)


def test_label_index_keeps_or_drops_unseen(spark):
    index = labels.label_index(spark.createDataFrame([("b",), ("a",), ("b",)], "l string"), "l")
    df = spark.createDataFrame([("a",), ("b",), ("new",)], "l string")
    assert {r.l: r.label for r in labels.with_label(df, index, "l").collect()} == {"b": 0.0, "a": 1.0, "new": 2.0}
    assert labels.with_label(df, index, "l", keep_invalid=False).count() == 2
