"""The named queries: every operator of the library on whole tables."""

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsense.functions.stopwords import REVIEW_BLACKLIST, stop_words
from labelsense.functions.text import canonical_words, pair_sentence, remove_stop_words, tokens
from labelsense.operators import boosting, clean, embeddings, evaluate, grid, labels, lemmas, matching, network, profile, sentences, wordsets
from labelsense.operators.scale import shared_folder, stored
from labelsense.plans import models
from labelsense.plans.stages import (
    CanonicalWords,
    MajorityEstimator,
    SharedIndexer,
    SharedOneHot,
    WordSetEstimator,
)
from labelsense.plans.table_stages import TableIndexer, TableWordSetEstimator
from labelsense.sources import tables

QUERIES = {}
STOP_WORDS = stop_words(REVIEW_BLACKLIST)


def query(function):
    QUERIES[function.__name__] = function
    return function


def queries():
    return dict(QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return tables.evened(table(spark, sf_dir, "documents").select(*columns))


def words_of(spark: SparkSession, sf_dir: str, stop=()) -> DataFrame:
    """(doc_id, lang, words): the set of lower-case words of every document."""
    docs = documents(spark, sf_dir, "doc_id", "lang", "text")
    return docs.select("doc_id", "lang", canonical_words("text", list(stop), lower=True).alias("words"))


# Profile


@query
def label_counts(spark, sf_dir):
    counts = profile.value_counts(table(spark, sf_dir, "part"), "p_name")
    return counts.withColumn("fraction", F.round("fraction", 6))


@query
def common_labels(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_name").count()
    return clean.common_labels(counts, "p_name", 0.9)


@query
def uniqueness(spark, sf_dir):
    return profile.uniqueness(table(spark, sf_dir, "documents"), "text", "lang", "source")


@query
def missing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return profile.missing(judged, "text", "quality", "toxic")


@query
def label_mentions(spark, sf_dir):
    return profile.label_mentions(table(spark, sf_dir, "documents"), "text", "lang")


@query
def duplicate_texts(spark, sf_dir):
    rows = profile.duplicate_texts(table(spark, sf_dir, "documents"), "text", "doc_id")
    return rows.select("doc_id", "lang", "n_copies")


@query
def similar_labels(spark, sf_dir):
    return profile.similar_labels(table(spark, sf_dir, "part"), "p_name", 40)


@query
def similar_common_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return profile.similar_labels(clean.keep_common_labels(part, "p_name", threshold=0.9), "p_name", 10)


@query
def length_summary(spark, sf_dir):
    lengths = profile.text_lengths(documents(spark, sf_dir, "text"), "text").select("n_words")
    return profile.length_summary(lengths, "n_words")


@query
def sentence_summary(spark, sf_dir):
    lengths = profile.text_lengths(documents(spark, sf_dir, "text"), "text")
    return profile.length_summary(lengths, "n_sentences", "n_words")


@query
def sentence_abbreviations(spark, sf_dir):
    """What the texts themselves say of full stops: abbreviations and sentence starters."""
    model = sentences.learn(documents(spark, sf_dir, "text"))
    found = [(model.abbreviations, "abbreviation"), (model.starters, "starter")]
    rows = [rows.select(F.lit(kind).alias("kind"), "type", F.round("score", 4).alias("score")) for rows, kind in found]
    return rows[0].unionByName(rows[1])


@query
def learned_sentences(spark, sf_dir):
    """Number of sentences of every document, with abbreviations learned from all of them."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    return sentences.learned_counts(docs, "text", ["doc_id"])


@query
def learned_sentence_summary(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return profile.length_summary(sentences.learned_counts(docs, "text", ["doc_id"]), "n_sentences")


@query
def spearman(spark, sf_dir):
    rows = tables.evened(table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_discount"))
    return profile.spearman(rows, *rows.columns).withColumn("correlation", F.round("correlation", 6))


@query
def length_spearman(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "n_chars")
    docs = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = profile.text_lengths(docs, "text", "n_chars", "quality").select("n_chars", "quality", "n_words")
    return profile.spearman(rows, *rows.columns).withColumn("correlation", F.round("correlation", 6))


# Clean


@query
def clean_documents(spark, sf_dir):
    rows = clean.clean_reviews(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", threshold=0.6)
    return rows.select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query
def drop_duplicates(spark, sf_dir):
    docs = clean.drop_missing(clean.lower_strings(table(spark, sf_dir, "documents")), "lang")
    return clean.drop_duplicates(docs, ["text", "lang"], "doc_id").select("doc_id", "lang", "source", "n_chars")


@query
def mask_label(spark, sf_dir):
    masked = clean.mask_label(table(spark, sf_dir, "documents"), "text", "lang")
    return masked.select("doc_id", F.md5("text").alias("text_md5"))


# Words


@query
def top_words(spark, sf_dir):
    return wordsets.common(words_of(spark, sf_dir), "words", 50)


@query
def document_frequency(spark, sf_dir):
    return wordsets.document_frequency(words_of(spark, sf_dir), "words")


@query
def vocabulary(spark, sf_dir):
    return wordsets.vocabulary(words_of(spark, sf_dir), "words")


@query
def exploded_words(spark, sf_dir):
    return wordsets.exploded_words(words_of(spark, sf_dir), "words", "doc_id", "lang")


@query
def token_counts(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", F.size(tokens("text")).alias("n_tokens"))


@query
def stop_word_filter(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text")
    kept = remove_stop_words(tokens(F.lower("text"), marks=False), STOP_WORDS)
    return docs.select("doc_id", F.size(kept).alias("n_kept"))


@query
def lemma_table(spark, sf_dir):
    docs = stored(words_of(spark, sf_dir))
    counts = stored(wordsets.document_frequency(docs, "words"))
    return lemmas.lemma_table(counts, lemmas.corpus_lexicon(docs, "words", counts=counts))


@query
def lemmatised_words(spark, sf_dir):
    docs = stored(words_of(spark, sf_dir, STOP_WORDS))
    words = wordsets.exploded_words(docs, "words", "doc_id")
    counts = stored(wordsets.document_frequency(docs, "words"))
    # Every word may be a base form, however rare: the lemmas are a table here, so nothing bounds their number.
    kept = lemmas.lemmatise(words, lemmas.lemma_table(counts), "doc_id")
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


@query
def pair_sentences(spark, sf_dir):
    docs = words_of(spark, sf_dir).withColumn("words", F.sort_array("words"))
    return docs.select("doc_id", F.md5(F.array_join(pair_sentence("words", "lang"), " ")).alias("sentence_md5"))


@query
def word_vector(spark, sf_dir):
    docs = stored(words_of(spark, sf_dir).select("doc_id", "words"))
    encoded = WordSetEstimator(limitTo=100).fit(docs).transform(docs)
    places = encoded.select("doc_id", F.explode_outer(F.unwrap_udt("features")["indices"]).alias("position"))
    return places.filter(F.col("position").isNotNull())


@query
def word_list(spark, sf_dir):
    docs = stored(words_of(spark, sf_dir).select("doc_id", "words"))
    listed = WordSetEstimator(outputCol="tracked", limitTo=100, indexWords=False).fit(docs).transform(docs)
    return listed.select("doc_id", F.array_join("tracked", " ").alias("tracked"))


@query
def encoded_words(spark, sf_dir):
    docs = words_of(spark, sf_dir)
    words = wordsets.exploded_words(docs, "words", "doc_id")
    encoded = wordsets.encode(words, wordsets.common(docs, "words", 100), "doc_id")
    return encoded.select("doc_id", F.array_join("indices", ",").alias("indices"))


@query
def all_encoded_words(spark, sf_dir):
    """Every word of the documents, none left out, by a stage that was saved and loaded."""
    docs = stored(words_of(spark, sf_dir))
    fitted = models.Pipeline(stages=[TableWordSetEstimator(outputCol="indices")]).fit(docs)
    path = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    models.save(fitted, path)
    encoded = models.PipelineModel.load(path).transform(docs)
    return encoded.select("doc_id", F.array_join("indices", ",").alias("indices"))


@query
def stored_word_set(spark, sf_dir):
    path = f"{shared_folder(spark)}/word-sets-{uuid.uuid4().hex}"
    tables.write_word_set(wordsets.common(words_of(spark, sf_dir), "words", 200), "common", path)
    return tables.read_word_set(spark, path, "common")


# Labels


@query
def label_mode(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    fitted = MajorityEstimator(inputCol="o_orderpriority", outputCol="prediction").fit(orders)
    return fitted.transform(orders).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query
def majority_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("label"))
    scores = evaluate.scores(MajorityEstimator().fit(docs).transform(docs))
    return scores.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query
def label_index(spark, sf_dir):
    return labels.label_index(table(spark, sf_dir, "part"), "p_name")


@query
def indexed_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return labels.with_label(part, labels.label_index(part, "p_brand"), "p_brand")


@query
def shared_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    stage = SharedIndexer(inputCols=["o_orderpriority", "o_orderstatus"], outputCols=["priority", "status"])
    return stage.fit(orders).transform(orders).select("o_orderkey", "priority", "status")


@query
def table_index(spark, sf_dir):
    """One index over two columns, learned and used as a table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    stage = TableIndexer(inputCols=["o_orderpriority", "o_orderstatus"], outputCols=["priority", "status"])
    return stage.fit(orders).transform(orders).select("o_orderkey", "priority", "status")


@query
def shared_one_hot(spark, sf_dir):
    indexed = shared_index(spark, sf_dir)
    stage = SharedOneHot(inputCols=["priority", "status"], outputCols=["priority_vector", "status_vector"])
    hot = stage.fit(indexed).transform(indexed)

    def slot(name):
        vector = vector_to_array(name)
        return F.size(vector).alias("width"), (F.array_position(vector, 1.0) - 1).alias("position")

    parts = [
        hot.select("o_orderkey", F.lit(name).alias("column_name"), *slot(f"{name}_vector"))
        for name in ("priority", "status")
    ]
    return parts[0].unionByName(parts[1])


@query
def balanced_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return labels.balance(docs, "doc_id", "lang")


@query
def class_weights(spark, sf_dir):
    weights = evaluate.class_weights(table(spark, sf_dir, "documents"), "source")
    return weights.withColumn("weight", F.round("weight", 9))


@query
def weighted_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return evaluate.with_class_weight(docs, "lang").withColumn("weight", F.round("weight", 9))


# Similarity of words and labels, on the embeddings table


def vectors_of(spark, sf_dir):
    """Vectors as words v<id>, centroids as labels c<n>, label order by frequency."""
    rows = table(spark, sf_dir, "embeddings")
    # The first ten words have the names of labels, as words of a text do that name its label.
    letter = F.when(F.col("vec_id") < 10, "c").otherwise("v")
    words = rows.select(F.concat(letter, "vec_id").alias("word"), F.col("embedding").alias("vector"))
    named = rows.select(F.concat(F.lit("c"), "label").alias("label"), "embedding")
    order = labels.label_index(named, "label").select(
        F.col("value").alias("label"), F.col("label").cast("int").alias("label_order")
    )
    return words, embeddings.centroids(named, "label", "embedding"), order


FETCH = 200


@query
def similarity(spark, sf_dir):
    words, centres, _ = vectors_of(spark, sf_dir)
    return embeddings.similarity(words, centres).withColumn("similarity", F.round("similarity", 6))


@query
def nearest_words(spark, sf_dir):
    words, centres, _ = vectors_of(spark, sf_dir)
    return embeddings.nearest(words, centres, 10).withColumn("similarity", F.round("similarity", 6))


@query
def opposite_words(spark, sf_dir):
    words, centres, _ = vectors_of(spark, sf_dir)
    return embeddings.nearest(words, centres, 10, opposite=True).withColumn("similarity", F.round("similarity", 6))


@query
def similar_words(spark, sf_dir):
    words, centres, order = vectors_of(spark, sf_dir)
    return wordsets.similar(matching.matched(words, centres, nearest=FETCH), order)


@query
def dissimilar_words(spark, sf_dir):
    words, centres, order = vectors_of(spark, sf_dir)
    return wordsets.dissimilar(matching.matched(words, centres, farthest=FETCH), order)


@query
def extreme_words(spark, sf_dir):
    words, centres, order = vectors_of(spark, sf_dir)
    matches = matching.matched(words, centres, FETCH, FETCH)
    return wordsets.extremes(wordsets.similar(matches, order), wordsets.dissimilar(matches, order))


@query
def low_entropy_words(spark, sf_dir):
    words, centres, order = vectors_of(spark, sf_dir)
    ranked = wordsets.low_entropy(matching.matched(words, centres), order)
    return ranked.withColumn("entropy", F.round("entropy", 6))


@query
def nearest_lists(spark, sf_dir):
    """The first 3,600 words of every label and the last 1,400, with their places."""
    words, centres, _ = vectors_of(spark, sf_dir)
    lists = matching.matched(words, centres, 3600, 1400).lists
    return lists.select("side", "label", "word", F.round("similarity", 6).alias("similarity"), "place")


# Splits and scores


@query
def split(spark, sf_dir):
    train, test = evaluate.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def folds(spark, sf_dir):
    return evaluate.folds(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 3)


@query
def sampled_lines(spark, sf_dir):
    return evaluate.sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.01)


def judged(spark, sf_dir):
    """Quality labels next to a fixed rule: long documents are predicted to be good."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("prediction"))


@query
def confusion(spark, sf_dir):
    return evaluate.confusion(judged(spark, sf_dir))


def _rounded(scores):
    return scores.withColumn("accuracy", F.round("accuracy", 6)).withColumn("f1", F.round("f1", 6))


@query
def f1(spark, sf_dir):
    return _rounded(evaluate.scores(judged(spark, sf_dir)))


@query
def weighted_f1(spark, sf_dir):
    return _rounded(evaluate.scores(evaluate.with_class_weight(judged(spark, sf_dir), "label"), weight="weight"))


@query
def score_report(spark, sf_dir):
    return evaluate.report(judged(spark, sf_dir))


@query
def vs_baseline(spark, sf_dir):
    rows = judged(spark, sf_dir)
    baseline = MajorityEstimator().fit(rows).transform(rows.drop("prediction"))
    return _rounded(evaluate.vs_baseline(rows, baseline))


@query
def bayes_score(spark, sf_dir):
    """Trained on the training part, scored on the test part."""
    docs = documents(spark, sf_dir, "doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    label = F.col("quality").cast("double").alias("label")
    words = stored(docs.select("doc_id", label, canonical_words("text", lower=True).alias("words")))
    train, test = evaluate.split(words, "doc_id")
    stages = models.Pipeline(stages=[WordSetEstimator(limitTo=50), models.bayes()])
    predictions = stages.fit(train).transform(test)
    return evaluate.confusion(predictions).select(F.col("label").cast("int"), F.col("prediction").cast("int"), "n")


# Trained models


def _features(spark, sf_dir, per_label=models.FEATURES_PER_LABEL):
    """Training and test features of documents: the most common words, label = lang.

    Of the plain words only those are lemmatised that can become a tracked word."""
    train, test = evaluate.split(_plain_words(spark, sf_dir), "doc_id")
    index, lemma = models.pipeline("plain", "lang", models.logistic(), stop=STOP_WORDS).getStages()[:2]
    counts = stored(wordsets.document_frequency(train, "plain"))
    index, words = index.fit(train), lemma.fit_counted(train, counts)
    forms = wordsets.forms_of_common(counts, words.getLemmas(), per_label * 4)
    needed = F.col("plain") if forms is None else F.filter("plain", lambda word: word.isin(forms))
    train, test = (
        stored(words.transform(index.transform(rows.withColumn("plain", needed))).select("doc_id", "label", "words"))
        for rows in (train, test)
    )
    fitted = WordSetEstimator(inputCol="words", outputCol="features", limitTo=per_label * 4).fit(train)
    keep = ["doc_id", "label", "features"]
    return stored(fitted.transform(train).select(*keep)), stored(fitted.transform(test).select(*keep))


def _metrics(spark, sf_dir, name, classifier):
    train, test = _features(spark, sf_dir)
    return models.compare_models(train, test, {name: classifier})


@query
def logistic_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, "logistic", models.logistic())


@query
def bayes_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, "bayes", models.bayes())


@query
def forest_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, "forest", models.forest(seed=17))


@query
def boosted_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, "boosted", boosting.BoostedTogether(models.boosted(seed=17)))


@query
def compared_models(spark, sf_dir):
    train, test = _features(spark, sf_dir)
    chosen = {
        "logistic": models.logistic(), "bayes": models.bayes(), "forest": models.forest(seed=17),
        "boosted": boosting.BoostedTogether(models.boosted(seed=17)),
    }
    return models.compare_models(train, test, chosen)


@query
def bottleneck_metrics(spark, sf_dir):
    """Trained on balanced rows of the training part, scored on the test part."""
    train, test = _prepared(spark, sf_dir)
    balanced = stored(labels.balance(train, "doc_id", "lang"))
    words = WordSetEstimator(outputCol="tracked", limitTo=500, indexWords=False).fit(balanced)
    tracked = stored(words.transform(balanced).select("lang", "tracked"))
    index, _ = models.pair_index(tracked, "tracked", "lang")
    pairs = stored(models.counted_pairs(index, tracked, "tracked", "lang"))
    width = len(index.stages[0].labelsArray[0])
    fitted = network.fit_counted(models.bottleneck(width, width, seed=17), pairs.withColumnRenamed("word_index", "word"))
    held = stored(models.counted_pairs(index, words.transform(test), "tracked", "lang"))
    return _rounded(evaluate.scores(fitted.transform(held), weight="n"))


def _split_texts(docs):
    """Rows with their ``words``, split once for all stages that need them, instead of the text."""
    return stored(CanonicalWords(inputCol="text", stopWords=STOP_WORDS, lower=True).transform(docs).drop("text"))


def _fitted_by_steps(stages, train):
    """The pipeline fitted on rows that are stored after the words and after the features, as every stage and
    every step of the classifier reads them again."""
    index, split, tracked, classifier = stages.getStages()
    words = models.Pipeline(stages=[index, split]).fit(train)
    rows = stored(words.transform(train).select("label", "words"))
    tracked = tracked.fit(rows)
    features = stored(tracked.transform(rows).select("label", "features"))
    return models.PipelineModel([*words.stages, tracked, classifier.fit(features)])


def _plain_words(spark, sf_dir):
    """Documents (doc_id, lang, plain) with the words of their texts, not yet lemmatised."""
    return _split_texts(documents(spark, sf_dir, "doc_id", "text", "lang")).withColumnRenamed("words", "plain")


def _prepared(spark, sf_dir):
    """Training and test rows (doc_id, lang, label, words); lemmas and labels are learned from the first.

    The label does not say how many labels there are, the one for unseen values included.
    """
    train, test = evaluate.split(_plain_words(spark, sf_dir), "doc_id")
    stages = models.pipeline("plain", "lang", models.logistic(), stop=STOP_WORDS).getStages()[:2]
    fitted = models.Pipeline(stages=stages).fit(train)
    label = F.col("label").alias("label", metadata={})
    return [stored(fitted.transform(rows).select("doc_id", "lang", label, "words")) for rows in (train, test)]


def _trained_vectors(docs):
    """Word and label vectors learned from rows (lang, words), and the order of the labels."""
    tracked = WordSetEstimator(outputCol="tracked", limitTo=4000, indexWords=False).fit(docs).transform(docs)
    vectors = stored(embeddings.word_vectors(embeddings.train(tracked, "tracked", "lang")))
    order = labels.label_index(docs, "lang").select(
        F.col("value").alias("label"), F.col("label").cast("int").alias("label_order")
    )
    return vectors, embeddings.label_vectors(vectors, order), order


@query
def w2v_neighbours(spark, sf_dir):
    train, _ = _prepared(spark, sf_dir)
    vectors, label_vectors, order = _trained_vectors(train)
    return embeddings.nearest(wordsets.without_labels(vectors, order), label_vectors, 10)


def _word_sets(docs, limit):
    """The first words of all five strategies, learned from rows (lang, words)."""
    vectors, label_vectors, order = _trained_vectors(docs)
    matches = matching.matched(vectors, label_vectors, 3600, 1400)
    near, far = wordsets.similar(matches, order), wordsets.dissimilar(matches, order)
    near, far = stored(near), stored(far)
    sets = {
        "common": wordsets.common(docs, "words", limit),
        "similar": near,
        "dissimilar": far,
        "extremes": wordsets.extremes(near, far),
        "low_entropy": wordsets.low_entropy(matches, order),
    }
    return {name: tables.word_list(words, limit) for name, words in sets.items()}


@query
def trained_variants(spark, sf_dir):
    train, test = _prepared(spark, sf_dir)
    n_labels = train.select("label").distinct().count()
    sets = _word_sets(train, models.FEATURES_PER_LABEL * n_labels)
    return models.train_all(models.prepared_variants(sets, n_labels), train, test)[1]


GRID_LENGTHS = 15  # words per label


def _grid_rows(train):
    """Rows of the training part with weight and fold, and the number of labels."""
    rows = evaluate.folds(evaluate.with_class_weight(train, "lang"), "doc_id", 3)
    return stored(rows.select("doc_id", "label", "words", "weight", "fold")), train.select("label").distinct().count()


def _grid_table(table_, n_labels):
    each = (F.col("limit") / n_labels).cast("int").alias("wordsPerLabel")
    return table_.select(F.col("name").alias("wordSet"), each, "reg", "l1", *[F.round(m, 4).alias(m) for m in grid.METRICS])


@query
def grid_metrics(spark, sf_dir):
    """Strategy by words per label, 75 points, on folds of the training rows from which the sets were learned."""
    train, _ = _prepared(spark, sf_dir)
    rows, n_labels = _grid_rows(train)
    sets = _word_sets(train, GRID_LENGTHS * n_labels)
    points = [grid.Point(name, each * n_labels) for name in sets for each in range(1, GRID_LENGTHS + 1)]
    data = grid.encoded(rows, "doc_id", "words", sets)
    return _grid_table(grid.metric_table(grid.scored(data, grid.logistic(data, points), points)), n_labels)


@query
def regularised_grid(spark, sf_dir):
    """Penalty by its share on absolute values by words per label, 72 points."""
    train, _ = _prepared(spark, sf_dir)
    rows, n_labels = _grid_rows(train)
    sets = {"common": tables.word_list(wordsets.common(train, "words", 14 * n_labels), 14 * n_labels)}
    points = [
        grid.Point("common", each * n_labels, reg, l1)
        for reg in (0.001, 0.005, 0.01, 0.05, 0.1, 0.3, 0.5, 1.0) for l1 in (0.0, 0.01, 0.1) for each in (1, 7, 14)
    ]
    data = grid.encoded(rows, "doc_id", "words", sets)
    return _grid_table(grid.metric_table(grid.scored(data, grid.logistic(data, points), points)), n_labels)


def _quality_words(spark, sf_dir):
    """(doc_id, label, words, weight, fold) of labelled documents, label = quality, and the 50 most common words."""
    docs = documents(spark, sf_dir, "doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    words = stored(docs.select("doc_id", F.col("quality").alias("label"), canonical_words("text", lower=True).alias("words")))
    rows = evaluate.folds(evaluate.with_class_weight(words, "label"), "doc_id", 3)
    return rows, {"common": tables.word_list(wordsets.common(words, "words", 50), 50)}


BAYES_POINTS = [grid.Point("common", limit) for limit in range(5, 51, 5)]


@query
def bayes_grid(spark, sf_dir):
    """Naive Bayes with 5 to 50 words: mean of the four scores over three folds."""
    rows, sets = _quality_words(spark, sf_dir)
    data = grid.encoded(rows, "doc_id", "words", sets)
    table_ = grid.metric_table(grid.scored(data, grid.bayes(data, BAYES_POINTS), BAYES_POINTS))
    return table_.select("limit", *[F.round(m, 6).alias(m) for m in grid.METRICS])


@query
def held_out_bayes(spark, sf_dir):
    """The best point of a grid on folds of the training part, fitted on all of it, on the test part."""
    rows, sets = _quality_words(spark, sf_dir)
    train, test = evaluate.split(rows, "doc_id")
    data = grid.encoded(train, "doc_id", "words", sets)
    best = grid.best_point(grid.metric_table(grid.scored(data, grid.bayes(data, BAYES_POINTS), BAYES_POINTS)))
    held = grid.encoded(test.withColumn("fold", F.lit(-1)), "doc_id", "words", sets, labels=data.labels)
    found = grid.scored(held, grid.bayes(data, [best], folds=[-1]), [best])
    return found.select("limit", *[F.round(m, 6).alias(m) for m in grid.METRICS])


@query
def scored_documents(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    # Fitted on words that are split already; the scorer splits the texts it is given.
    train = _split_texts(evaluate.split(docs, "doc_id")[0]).withColumnRenamed("words", "plain")
    fitted = _fitted_by_steps(models.pipeline("plain", "lang", models.logistic(), limit=56), train)
    folder = f"{shared_folder(spark)}/scorers-{uuid.uuid4().hex}"
    models.save(models.deployable(fitted), f"{folder}/common")
    scorer = models.load_scorer("common", folder)(inputCol="text", outputCol="predicted_lang")
    return scorer.transform(docs.select("doc_id", "text")).select("doc_id", "predicted_lang")


@query
def majority_scored_documents(spark, sf_dir):
    """The majority scorer, learned from the training part, saved, loaded and used on the test part."""
    train, test = evaluate.split(documents(spark, sf_dir, "doc_id", "text", "lang"), "doc_id")
    folder = f"{shared_folder(spark)}/scorers-{uuid.uuid4().hex}"
    models.save(models.deployable(models.majority_pipeline("lang").fit(train)), f"{folder}/majority")
    scorer = models.load_scorer("majority", folder)(inputCol="text", outputCol="predicted_lang")
    return scorer.transform(test.select("doc_id", "text")).select("doc_id", "predicted_lang")


@query
def csv_documents(spark, sf_dir):
    """Documents written as CSV and read again, line breaks, quotes and all."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "n_chars")
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_reviews_csv(docs, path)
    back = tables.read_reviews_csv(spark, path, docs.schema, line_breaks=True)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "n_chars")


@query
def stored_metrics(spark, sf_dir):
    """Scores of a rule per source, written to the metrics sink, read back, and sliced by language."""
    rows = judged(spark, sf_dir).join(documents(spark, sf_dir, "doc_id", "lang", "source"), "doc_id")
    hit = (F.col("label") == F.col("prediction")).cast("int")
    per_source = rows.groupBy("lang", "source").agg(F.avg(hit).alias("accuracy"))
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    evaluate.save_metrics(per_source, path)
    table_ = evaluate.metric_slice(tables.read_table(spark, path), "lang", "accuracy")
    return table_.select("lang", *[F.round(f"{kind}_accuracy", 6).alias(f"{kind}_accuracy") for kind in ("best", "mean")])
