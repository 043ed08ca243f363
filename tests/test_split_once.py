"""Texts that several stages need are split once."""

from pyspark.sql import functions as F

from labelsense.operators import lemmas, wordsets
from labelsense.plans import registry
from labelsense.plans.stages import CanonicalWords, LemmaEstimator

TEXTS = [
    (1, "Walks and walked, walking; the walk wasn't long", "en"), (2, "walk walks Walked", "en"), (3, None, "de"),
    (4, "", "de"), (5, "a1 don't we've -- cannot be talked", "de"), (6, "talk talks talking", None),
]


def test_stages_take_split_texts(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string, lang string")
    rules = {"stopWords": ["the", "and"], "lower": True, "filterAfter": True}
    split = CanonicalWords(inputCol="text", outputCol="plain", **rules).transform(docs).drop("text")
    from_texts = LemmaEstimator(inputCol="text", lexiconShare=0.3, **rules).fit(docs)
    from_words = LemmaEstimator(inputCol="plain", lexiconShare=0.3, **rules).fit(split)
    assert from_texts.getLemmas() == from_words.getLemmas() != {}
    expected = {r.doc_id: r.words for r in from_texts.transform(docs).collect()}
    assert {r.doc_id: r.words for r in from_words.transform(split).collect()} == expected
    # The model learned from words splits texts.
    assert {r.doc_id: r.words for r in from_words.copy().setInputCol("text").transform(docs).collect()} == expected


def test_lexicon_from_known_counts(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a"],), (None,)], "words array<string>")
    counts = wordsets.document_frequency(df, "words")
    assert lemmas.corpus_lexicon(df, "words", 0.5, counts).collect() == lemmas.corpus_lexicon(df, "words", 0.5).collect()


def test_prepared_rows_split_every_text_once(spark, tmp_path, monkeypatch):
    words = ["walk", "walks", "talk", "talked", "river", "stone"]
    rows = [(i, " ".join(words[i % 5 :]), "en" if i % 3 else "de") for i in range(60)]
    spark.createDataFrame(rows, "doc_id int, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.sparkContext.accumulator(0)

    def counted(spark_, sf_dir, *columns):
        docs = registry.table(spark_, sf_dir, "documents").select(*columns)

        def seen(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return docs.mapInArrow(seen, docs.schema)

    monkeypatch.setattr(registry, "documents", counted)
    train, test = registry._prepared(spark, str(tmp_path))
    assert train.count() + test.count() == 60
    assert read.value == 60
    assert "walk" in train.select(F.explode("words")).distinct().collect()[0:9].__str__()
