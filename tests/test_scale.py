"""The paths for large tables and hot keys give the same results as the short ones."""

import random

import pytest
from pyspark.sql import functions as F

from labelsense.operators import clean, embeddings, labels, matching, profile, scale, wordsets


@pytest.fixture
def hot_rows(spark):
    """A third of the rows on one key, one key without a partner, one null key."""
    rng = random.Random(3)
    keys = ["hot"] * 1000 + [f"k{rng.randrange(300)}" for _ in range(2000)] + ["alone", None]
    return spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, key string").repartition(6)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("key_rows", [None, "rows"])
def test_split_join_equals_plain_join(spark, hot_rows, how, key_rows):
    table = hot_rows.filter("key != 'alone'").groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("m"))
    plain = hot_rows.join(table, ["key"], how)
    split = scale.split_join(hot_rows, table, ["key"], how, salt_on=["id"], key_rows=key_rows)
    assert sorted(split.columns) == sorted(plain.columns)
    assert sorted(map(repr, split.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_split_join_spreads_the_hot_key(spark, hot_rows):
    table = hot_rows.dropna().groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    plan = scale.split_join(hot_rows, table, ["key"], salt_on=["id"])
    assert "_salt" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.filter("key = 'hot'").count() == 1000


def test_lookup_join_falls_back_when_too_large(spark, hot_rows, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 10)
    table = hot_rows.dropna().groupBy("key").agg(F.min("id").alias("m"))
    joined = scale.lookup_join(hot_rows, table, ["key"], salt_on=["id"])
    assert joined.count() == 3001
    assert "_salt" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_running_totals_in_ranges(spark):
    rng = random.Random(5)
    values = [(rng.randrange(10**6), rng.randrange(1, 9)) for _ in range(5000)]
    table = spark.createDataFrame([(v, i, w) for i, (v, w) in enumerate(values)], "v long, i long, w long")
    found = scale.running_totals(
        table, [F.desc("v"), F.asc("i")], {"rank": None, "before": F.col("w")}, one_task_rows=100
    ).collect()
    total = 0
    for rank, row in enumerate(sorted(found, key=lambda r: (-r.v, r.i))):
        assert (row["rank"], row.before) == (rank, total)
        total += row.w


def test_balance_gives_every_label_the_same_count(spark):
    rows = [(i, "a") for i in range(700)] + [(i, "b") for i in range(700, 933)] + [(999, "c"), (1000, None)]
    df = spark.createDataFrame(rows, "id long, label string")
    balanced = labels.balance(df, "id", "label", buckets=16)
    per_label = {r.label: r["count"] for r in balanced.groupBy("label").count().collect()}
    assert per_label == {"a": 700, "b": 700, "c": 700}
    copies = {r.n for r in balanced.filter("label = 'b'").groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert copies == {3, 4}
    assert balanced.select("id").distinct().count() == 934


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_pairs_within_against_all_pairs(spark, distance):
    rng = random.Random(distance)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(60)}
    words |= {"Brand#" + str(n) for n in range(1, 30)}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "v string")
    a, b = df.select(F.col("v").alias("a")), df.select(F.col("v").alias("b"))
    expected = a.join(b, (F.col("a") < F.col("b")) & (F.levenshtein("a", "b") <= distance))
    expected = {(r.a, r.b, r.d) for r in expected.withColumn("d", F.levenshtein("a", "b")).collect()}
    for group_rows in (1000, 4):
        found = [tuple(r) for r in profile.pairs_within(df, "v", distance, group_rows).collect()]
        assert len(found) == len(set(found))
        assert set(found) == expected


def test_similar_labels_reaches_far_pairs(spark):
    df = spark.createDataFrame([("malbec",), ("riesling",), ("riesling",), ("gruner veltliner",)], "v string")
    found = [tuple(r) for r in profile.similar_labels(df, "v", 40).collect()]
    assert [(r[0], r[1]) for r in found] == [
        ("malbec", "riesling"), ("gruner veltliner", "riesling"), ("gruner veltliner", "malbec"),
    ]
    assert found[0][3:] == (1, 2)


def test_similar_labels_of_one_label(spark):
    assert profile.similar_labels(spark.createDataFrame([("a",)], "v string"), "v").count() == 0


@pytest.mark.parametrize("one_task_rows", [10, 10**6])
def test_spearman_with_nulls(spark, monkeypatch, one_task_rows):
    import pandas as pd

    monkeypatch.setattr(scale.running_totals, "__defaults__", (one_task_rows,))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", one_task_rows)
    rng = random.Random(7)
    frame = pd.DataFrame({"price": [rng.choice([None, 5.0, 9.5, 20.0, 80.0]) for _ in range(400)]})
    frame["points"] = [rng.randrange(80, 101) for _ in range(400)]
    frame["length"] = [p + rng.randrange(30) for p in frame["points"]]
    df = spark.createDataFrame(
        [(None if p != p else p, int(q), int(n)) for p, q, n in frame.itertuples(index=False)],
        "price double, points int, length int",
    )
    found = {(r.column_1, r.column_2): (r.correlation, r.n_rows) for r in profile.spearman(df, *frame.columns).collect()}
    for (a, b), (value, rows) in found.items():
        both = frame[[a, b]].astype(float).dropna()
        assert rows == len(both)
        assert value == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-12)
    assert len(found) == 3


def test_duplicate_texts_with_a_hot_copy(spark, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 10)
    rows = [(i, "same") for i in range(500)] + [(i, f"t{i}") for i in range(500, 1500)] + [(1500, "t500")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    found = profile.duplicate_texts(df, "text", "id")
    assert {(r.text, r.n_copies): r["count"] for r in found.groupBy("text", "n_copies").count().collect()} == {
        ("same", 500): 500, ("t500", 2): 2,
    }


def test_drop_duplicates_keeps_the_lowest_id(spark):
    rows = [(3, "t", "a", 30), (1, "t", "a", 10), (2, "t", "b", 20), (4, None, "a", 40), (5, None, "a", 50)]
    df = spark.createDataFrame(rows, "id long, text string, label string, price int")
    kept = clean.drop_duplicates(df, ["text", "label"], "id").collect()
    assert {(r.id, r.price) for r in kept} == {(1, 10), (2, 20), (4, 40)}
    narrow = clean.drop_duplicates(df.drop("price"), ["text", "label"], "id").collect()
    assert {r.id for r in narrow} == {1, 2, 4}


@pytest.fixture
def vectors(spark):
    rng = random.Random(11)
    words = [(f"w{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [("zero", [0.0] * 8)]
    names = [(f"l{i}", [rng.gauss(0, 1) for _ in range(8)]) for i in range(30)]
    return (
        spark.createDataFrame(words, "word string, vector array<double>"),
        spark.createDataFrame(names, "label string, vector array<double>"),
    )


def test_similarity_in_blocks_and_without_broadcast(vectors, monkeypatch):
    words, names = vectors
    whole = {(r.word, r.label): r.similarity for r in embeddings.similarity(words, names).collect()}
    assert len(whole) == 201 * 30
    assert whole["zero", "l0"] == 0.0
    a, b = dict(words.collect())["w5"], dict(names.collect())["l7"]
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    assert whole["w5", "l7"] == pytest.approx(dot / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, abs=1e-8)
    blocks = {(r.word, r.label): r.similarity for r in embeddings.similarity(words, names, block=7).collect()}
    assert blocks == whole
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 10)
    assert {(r.word, r.label): r.similarity for r in embeddings.similarity(words, names, block=7).collect()} == whole


def test_interleave_takes_one_word_per_label_and_round(spark):
    ranks = spark.createDataFrame(
        [("a", "red", 0), ("a", "dry", 1), ("a", "oak", 2), ("b", "red", 0), ("b", "lime", 1), ("b", "dry", 2)],
        "label string, word string, place int",
    )
    order = spark.createDataFrame([("a", 0), ("b", 1)], "label string, label_order int")
    found = wordsets.interleave(ranks, order).orderBy("rank").collect()
    assert [r.word for r in found] == ["red", "dry", "lime", "oak"]


def test_extremes_alternate_and_keep_the_first_place(spark):
    near = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "rank long, word string")
    far = spark.createDataFrame([(0, "z"), (1, "a")], "rank long, word string")
    found = wordsets.extremes(near, far).orderBy("rank").collect()
    assert [(r["rank"], r.word) for r in found] == [(0, "a"), (1, "z"), (2, "b")]


def test_low_entropy(spark):
    import math

    shifted = {"flat": (1.2, 1.2), "one": (1.8, 0.0), "a": (2.0, 1.1)}  # similarities to a and b, plus 1
    rows = [(word, sum(s), sum(x * math.log(x) for x in s if x)) for word, s in shifted.items()]
    pairs = matching.Matches(spark.createDataFrame(rows, "word string, total double, sln double"), None)
    order = spark.createDataFrame([("a", 0), ("b", 1)], "label string, label_order int")
    found = wordsets.low_entropy(pairs, order).orderBy("rank").collect()
    assert [r.word for r in found] == ["one", "flat"]
    assert found[0].entropy == pytest.approx(0.0)
    assert found[1].entropy == pytest.approx(1.0)
    assert math.isfinite(found[0].entropy)


def test_encode_matches_target_order(spark):
    words = spark.createDataFrame([(1, "dry"), (1, "red"), (1, "new"), (2, "old"), (3, "red")], "id long, word string")
    target = spark.createDataFrame([(0, "red"), (1, "oak"), (2, "dry")], "rank long, word string")
    found = {r.id: r.indices for r in wordsets.encode(words, target, "id").collect()}
    assert found == {1: [0, 2], 3: [0]}


def test_balance_of_one_row_against_many(spark):
    """A row that is repeated 10,000 times is divided into blocks first."""
    rows = [(i, "many") for i in range(10_000)] + [(10_000, "one"), (10_001, "three"), (10_002, "three"), (10_003, "three")]
    out = labels.balance(spark.createDataFrame(rows, "id long, label string"), "id", "label")
    counts = out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id", "copy").alias("d")).collect()
    assert {r.label: (r.n, r.d) for r in counts} == dict.fromkeys(["many", "one", "three"], (10_000, 10_000))


def test_split_join_keeps_rows_with_null_keys(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(400)], "id long, k string")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    joined = scale.split_join(rows, table, ["k"], "left", salt_on=["id"]).collect()
    assert len(joined) == 400 and all((r.v is None) == (r.k is None) for r in joined)
    assert scale.split_join(rows, table, ["k"], "left_anti", salt_on=["id"]).count() == 200
