"""Sentence ends with learned abbreviations: known cases, statistics against plain arithmetic, defined results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from labelsense.operators import sentences

NAMES = ["Smith", "Jones", "Brown", "Miller", "Baker", "Louis", "Paul", "Green"]
THINGS = ["wine", "table", "garden", "river", "house", "market", "letter", "window", "cellar", "barrel"]
CASE = "Dr. Smith met Mr. Jones at 5 p.m. in St. Louis. They left."


def sentence(draw):
    thing = draw.choice(THINGS)
    return draw.choice(
        [
            f"Dr. {draw.choice(NAMES)} saw the {thing}.",
            f"They met Mr. {draw.choice(NAMES)} near the {thing}.",
            f"At {draw.randrange(1, 12)} p.m. in the {thing} it was dark and they left the {draw.choice(THINGS)}.",
            f"They went to St. {draw.choice(NAMES)} with a {thing}.",
            f"They left the {thing}.",
            f"The {thing} was near the {draw.choice(THINGS)}!",
            f"They saw a {thing} and a {draw.choice(THINGS)}.",
            f"Was it in the {thing}? They went in.",
        ]
    )


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(sentence(draw) for _ in range(8))) for i in range(150)]
    return spark.createDataFrame(rows, "id long, text string").persist()


@pytest.fixture(scope="module")
def model(corpus):
    return sentences.learn(corpus)


def counted(spark, model, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r.id: r.n_sentences for r in sentences.with_sentence_counts(df, "text", model, ["id"]).collect()}
    return [found[i] for i in range(len(texts))]


def test_abbreviations_are_learned(model):
    assert {r.type for r in model.abbreviations.collect()} == {"dr", "mr", "p.m", "st"}
    assert "they" in {r.type for r in model.starters.collect()}


def test_counts(spark, model):
    texts = [
        CASE,
        CASE.lower(),
        "They met at 5 p.m. They left.",  # a starter after an abbreviation
        "It was dark... then they left.",
        "One. Two! Three? Four",
        "J. Smith left. The end.",  # an initial before a name
        "He said \"no.\" They left.",
        "",
        " \n",
        None,
    ]
    assert counted(spark, model, *texts) == [2, 2, 2, 1, 4, 2, 2, 0, 0, None]


def test_split(spark, model):
    df = spark.createDataFrame([(1, CASE, "x"), (2, None, "x"), (3, "", "x"), (1, "Again.  And  again", "y")], "id long, text string, _row string")
    rows = sentences.split_sentences(df, "text", model, ["id", "_row"]).collect()
    assert {(r.id, r["_row"], r.sentence_no, r.sentence) for r in rows} == {
        (1, "x", 0, "Dr. Smith met Mr. Jones at 5 p.m. in St. Louis."), (1, "x", 1, "They left."),
        (1, "y", 0, "Again."), (1, "y", 1, "And  again"),
    }


def test_split_and_counts_agree(corpus, model):
    split = sentences.split_sentences(corpus, "text", model, ["id"]).groupBy("id").count()
    both = sentences.with_sentence_counts(corpus, "text", model, ["id"]).join(split, "id")
    assert both.count() == 150 and both.filter("n_sentences <> count").count() == 0
    assert both.agg(F.sum("n_sentences")).first()[0] == sum(
        sum(s.count("Was it") + 1 for s in [sentence_]) for sentence_ in _drawn()
    )


def _drawn():
    draw = random.Random(3)
    return [sentence(draw) for _ in range(150 * 8)]


def test_saved_model_and_known_abbreviations(spark, corpus, model, tmp_path):
    model.write(str(tmp_path / "model"))
    back = sentences.SentenceModel.read(spark, str(tmp_path / "model"))
    assert counted(spark, back, CASE) == [2]
    more = sentences.learn(corpus, known=["prof", "mr"])
    assert counted(spark, more, "They saw Prof. Green.") == [1] and counted(spark, model, "They saw Prof. Green.") == [2]


def test_scores_follow_the_published_formulas(spark):
    row = spark.range(1).select(
        sentences.association(F.lit(40), F.lit(50), F.lit(30), F.lit(1000)).alias("a"),
        sentences.abbreviation_score(F.lit(9), F.lit(1), F.lit("p.m"), F.lit(0.1)).alias("s"),
    ).first()
    p, p1, p2 = 50 / 1000, 30 / 40, 20 / 960
    log = lambda k, n, q: k * math.log(q) + (n - k) * math.log(1 - q)
    assert row.a == pytest.approx(2 * (log(30, 40, p1) + log(20, 960, p2) - log(30, 40, p) - log(20, 960, p)), abs=1e-5)
    ratio = 2 * (9 * math.log(0.99) + math.log(0.01) - 9 * math.log(0.1) - math.log(0.9))
    assert row.s == pytest.approx(ratio * math.exp(-2) * 2 * 2**-1, abs=1e-5)


def test_empty_table(spark, corpus):
    nothing = corpus.limit(0)
    empty = sentences.learn(nothing)
    assert sentences.with_sentence_counts(nothing, "text", empty, ["id"]).count() == 0
    assert counted(spark, empty, CASE, "a. b") == [6, 1]


def test_learned_counts_cut_texts_once(spark):
    texts = ["He met Dr. Smith. It was late!\tYes.", "a. b.\n\"Who?\" no", None, "", "Dr. Jones came. Dr. Smith left."] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    rows = sentences.bordered(docs.mapInArrow(seen, docs.schema), "text", [F.col("id")])
    sentences.learn(docs, rows=rows)
    assert calls.value == len(texts)
    expected = sentences.with_sentence_counts(docs, "text", sentences.learn(docs), ["id"]).collect()
    assert sorted(sentences.learned_counts(docs, "text", ["id"]).collect()) == sorted(expected)


def test_borders_are_those_of_the_patterns(spark):
    texts = ["a b.  c\td! \"e?\" f", "x\n.", "No mark\fhere", "(Q).\r\nNext\x0bone?", "", None, "ends. "]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    last = lambda p: F.regexp_extract(p, sentences.LAST_TOKEN, 1)
    pieces = sentences._pieces(F.col("text"))
    before = F.slice(F.concat(F.array(F.lit("")), F.transform(pieces, last)), F.lit(1), F.size(pieces))
    after = F.transform(pieces, lambda p: F.regexp_extract(p, sentences.FIRST_TOKEN, 1))
    cut = sentences._borders(F.col("text"))
    found = docs.select(before.alias("b"), after.alias("a"), F.transform(cut, lambda c: c["before"]).alias("fb"), F.transform(cut, lambda c: c["after"]).alias("fa"))
    for row in found.collect():
        assert (row.fb, row.fa) == (row.b, row.a)
