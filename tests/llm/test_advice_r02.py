"""Cases of the second review: parts of the job that the operators left out."""

from labelsense.llm import decontamination, language_id


def found(spark, docs, items):
    table = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id, r.n_changed) for r in decontamination.contaminated(table, benchmark).collect()}


def test_names_that_open_a_sentence_or_a_window(spark):
    items = [
        (1, "Tom has 3 red balls. Ann has 5 blue balls. How many balls do they have in total?"),
        (2, "How many apples does Maria buy at the market for 5 dollars?"),
    ]
    docs = [
        (1, "Bob has 4 red balls. Eve has 9 blue balls. How many balls do they have in total?"),
        (2, "So: How many apples does Anna buy at the market for 7 dollars? Ten."),
        (3, "Bob has 4 red balls. Bob has 9 blue balls. How many balls do they have in total?"),
        (4, "tom has 3 red balls. ann has 5 blue balls. how many balls do they have in total?"),
        (5, "How many apples does Anna sell at the market for 7 dollars?"),
    ]
    # The first window has 4 fixed words, so its name is not compared: 3 values differ in 1, and 3 is a leak.
    assert found(spark, docs, items) == {(1, 1, 3), (2, 2, 2), (3, 1, 3), (4, 1, 0)}


def test_a_name_at_two_openings_has_one_value(spark):
    items = [(1, "Tom keeps 3 red balls in the old box. Tom sells 5 of them to a man.")]
    docs = [(1, f"Bob keeps 4 red balls in the old box. {name} sells 9 of them to a man.") for name in ("Bob", "Eve")]
    assert found(spark, docs[:1], items) == {(1, 1, 3)}
    assert found(spark, docs[1:], items) == set()


def test_items_without_enough_windows(spark):
    items = [
        (1, "What is the capital of France?"),
        (2, "A train goes 60 km in 2 hours. Ann rides 30 km in 5 hours. Who wins?"),
        (3, "2 + 2 = 4"),
        (4, "Tom has 3 red balls. Ann has 5. Joe has 7. Sue has 9. Who has most balls?"),
    ]
    docs = [
        (1, "Quiz. What is the capital of France? Paris."),
        (2, "WHAT IS THE CAPITAL OF FRANCE"),
        (3, "A train goes 60 km in 2 hours. Ann rides 30 km in 5 hours. Who wins? Ann."),
        (4, "A train goes 70 miles in 3 days. Eve rides 40 miles in 6 days. Who wins?"),
        (5, "A train goes 70 km in 3 hours. Eve rides 70 km in 6 hours. Who wins?"),
        (6, "It says 2 + 2 = 4 here."),
        (7, "It says 3 + 3 = 6 here."),
        (8, "Bob has 4 red balls. Eve has 6. Zoe has 8. Kim has 1. Who has most balls?"),
        (9, "What is the capital"),
        (10, None),
        (11, ""),
    ]
    # In 5 one number stands for two. In 7 the template has no fixed word, so its values must be equal.
    assert found(spark, docs, items) == {(1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 2, 7), (6, 3, 0), (8, 4, 8)}


def test_rare_runs_are_counted(spark):
    texts = [("en", "the old house " * 200_000), ("en", "zürich")]
    table = spark.createDataFrame(texts, "lang string, text string")
    counts = language_id.run_counts(table).collect()
    assert [(r.n, chr(r.c1)) for r in counts if r.c0 == ord("ü")] == [(1, "z")]
    assert sum(r.n for r in counts) == len(texts[0][1]) + len(texts[1][1]) + 1
