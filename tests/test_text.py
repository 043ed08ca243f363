import random

import pytest
from pyspark.sql import functions as F

from labelsense.functions.stopwords import ENGLISH, REVIEW_BLACKLIST, stop_words
from labelsense.functions.text import canonical_words, keep_letters_only, pair_sentence, replace_words, sentence_count, tokens, word_count
from labelsense.operators import lemmas


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("A fine, dry wine.", ["A", "fine", ",", "dry", "wine", "."]),
        ("It's not; don't!", ["It", "'s", "not", ";", "do", "n't", "!"]),
        ("well-known rosé (3,000 bottles)", ["well-known", "rosé", "(", "3,000", "bottles", ")"]),
        ("old--new e.g. a/b", ["old", "--", "new", "e.g", ".", "a/b"]),
        ("I cannot stop", ["I", "can", "not", "stop"]),
        ("wait... what?", ["wait", "...", "what", "?"]),
        ("", []),
    ],
)
def test_tokens(spark, text, expected):
    assert one(spark, tokens("t"), t=text) == expected


def test_word_count(spark):
    assert one(spark, word_count("t"), t="Red, not white.") == 5


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("one. two! three?", 3),
        ("it scored 3.5 points (really.) and then\nsome", 2),
        ('he said "yes." then left', 2),
        ("no end", 1),
        ("  ", 0),
    ],
)
def test_sentence_count(spark, text, expected):
    assert one(spark, sentence_count("t"), t=text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Ripe ripe fruit's well-known 3 notes", {"Ripe", "ripe", "fruit", "notes"}),
        ("a/b c_d 'quoted don't", {"do"}),
    ],
)
def test_canonical_words_keep_letters_only(spark, text, expected):
    words = one(spark, canonical_words("t"), t=text)
    assert set(words) == expected
    assert len(words) == len(expected)


def test_letter_words_equal_filtered_tokens(spark):
    """The fast path for letters gives the words of the general one."""
    rng = random.Random(2)
    parts = ["wine", "Can", "n't", "'s", "'", "'T", "-", "--", ".", ",", ":", "5", " ", " ", "\n", "é", "o", "cannot", "/", "(",
             "’", "'ve", "d", "\u00a0", "e\u0301", "_", "?"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(4000)]
    texts += ["don't", "can't've", "it't", "n't", "dogs' tails", "it's-", "CANNOT gonna", "a.b end.", "x,5 x,y 'tis o'brien's"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    slow = F.array_distinct(keep_letters_only(tokens("t", marks=False)))
    both = df.select("t", F.sort_array(canonical_words("t")).alias("fast"), F.sort_array(slow).alias("slow"))
    assert [tuple(r) for r in both.filter("fast != slow").collect()] == []


def test_stop_words_come_back_through_their_lemma(spark):
    """Stop words go first, lemmas second; the option filters once more."""
    rules = {"stop": ["offer"], "lemmas": {"offers": "offer", "tastes": "taste"}}
    assert set(one(spark, canonical_words("t", **rules), t="offer offers tastes")) == {"offer", "taste"}
    assert one(spark, canonical_words("t", **rules, filter_after=True), t="offer offers tastes") == ["taste"]


def test_lower(spark):
    assert one(spark, canonical_words("t", lower=True), t="Tart TART") == ["tart"]


def test_replace_words_with_many_entries(spark):
    mapping = {f"form{i}": f"lemma{i}" for i in range(5000)}
    words = [f"form{i}" for i in range(0, 5000, 7)] + ["other"]
    expected = [mapping.get(w, w) for w in words]
    assert one(spark, replace_words(F.col("w"), mapping), w=words) == expected


@pytest.mark.parametrize(
    ("words", "expected"), [(["b", "a"], ["b", "x y", "a"]), (["c"], ["c"]), ([], [])]
)
def test_pair_sentence(spark, words, expected):
    frame = spark.createDataFrame([(words, "x y")], "w array<string>, l string")
    assert frame.select(pair_sentence("w", "l").alias("s")).first().s == expected


def test_stop_word_lists():
    both = stop_words(REVIEW_BLACKLIST)
    assert len(ENGLISH) == len(set(ENGLISH)) == 179
    assert len(both) == len(set(both)) == 212


def test_lemmas(spark):
    forms = ["drinks", "drink", "carries", "carry", "taste", "tasted", "tasting", "offer", "offering", "glass", "made", "is"]
    vocabulary = spark.createDataFrame([(w,) for w in forms], "word string")
    found = {r.word: r.lemma for r in lemmas.lemma_table(vocabulary).collect()}
    assert found == {
        "drinks": "drink", "carries": "carry", "tasted": "taste", "tasting": "taste", "offering": "offer",
        "made": "make", "is": "be",
    }


def test_lemmas_follow_the_lexicon(spark):
    vocabulary = spark.createDataFrame([("wines",), ("wine",), ("opens",)], "word string")
    lexicon = spark.createDataFrame([("open",)], "word string")
    assert [tuple(r) for r in lemmas.lemma_table(vocabulary, lexicon).collect()] == [("opens", "open")]


def test_lemmatised_rows_hold_each_word_once(spark):
    rows = spark.createDataFrame([(1, "open"), (1, "opens"), (2, "opens"), (2, "red")], "id long, word string")
    table = spark.createDataFrame([("opens", "open")], "word string, lemma string")
    assert sorted(map(tuple, lemmas.lemmatise(rows, table, "id").select("id", "word").collect())) == [
        (1, "open"), (2, "open"), (2, "red"),
    ]


@pytest.mark.parametrize("joint", [",", "-", ".", "'"])
def test_words_of_very_many_parts(spark, joint):
    """No length at which the patterns overflow the stack."""
    text = joint.join(["1" if joint == "," else "ab"] * 200_000) + " end"
    frame = spark.createDataFrame([(text,)], "text string")
    row = frame.select(
        F.size(tokens("text")).alias("tokens"), canonical_words("text").alias("words"), word_count("text").alias("n")
    ).first()
    assert row.tokens == row.n == 2 and row.words == ["end"]
