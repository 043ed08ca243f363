"""Spark ML stages: words of a text, tracked words, majority label, shared indexes."""

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, OneHotEncoder, StringIndexer, StringIndexerModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsense.functions.text import canonical_words, lemmatised
from labelsense.operators.labels import stack_columns
from labelsense.operators.lemmas import LEXICON_SHARE, corpus_lexicon, lemma_table
from labelsense.operators.scale import stored
from labelsense.operators.wordsets import document_frequency
from labelsense.plans.params import TrackedWords, WordRules

# Words to track if no limit is given: as many as Spark's CountVectorizer takes.
DEFAULT_VOCABULARY = 1 << 18


class _InOut(HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    def setInputCol(self, value):
        return self._set(inputCol=value)

    def setOutputCol(self, value):
        return self._set(outputCol=value)


def _is_split(dataset, name):
    """Whether a column holds words of texts, by the same rules but without lemmas, rather than texts."""
    return isinstance(dataset.select(name).schema[0].dataType, T.ArrayType)


class CanonicalWords(Transformer, _InOut, WordRules):
    """Text to its set of canonical words.

    ``lemmas`` maps a form to its lemma; ``LemmaEstimator`` learns it from the texts. A column of word
    lists, made by such a stage without lemmas, is taken as split already: texts that several stages
    need are split once.
    """

    lemmas = Param(Params._dummy(), "lemmas", "lemma of each form that is not its own lemma")

    @keyword_only
    def __init__(
        self, *, inputCol=None, outputCol="words", stopWords=None, onlyAlpha=True, lower=False, filterAfter=False,
        lemmas=None,
    ):
        super().__init__()
        self._setDefault(outputCol="words", stopWords=[], onlyAlpha=True, lower=False, filterAfter=False, lemmas={})
        self._set(**self._input_kwargs)

    def setLemmas(self, value):
        return self._set(lemmas=value)

    def getLemmas(self):
        return self.getOrDefault(self.lemmas)

    def _transform(self, dataset):
        rules = self.rules()
        if _is_split(dataset, self.getInputCol()):
            words = lemmatised(
                F.col(self.getInputCol()), rules["stopWords"], rules["onlyAlpha"], self.getLemmas(), rules["filterAfter"]
            )
            return dataset.withColumn(self.getOutputCol(), words)
        return dataset.withColumn(
            self.getOutputCol(),
            canonical_words(
                self.getInputCol(),
                stop=rules["stopWords"],
                only_alpha=rules["onlyAlpha"],
                lower=rules["lower"],
                lemmas=self.getLemmas(),
                filter_after=rules["filterAfter"],
            ),
        )


class LemmaEstimator(Estimator, _InOut, WordRules):
    """Learns the lemmas of the words in a text column; the model is ``CanonicalWords``.

    ``lexicon`` is a list of base forms; without it the words held by at least ``lexiconShare`` of
    the rows serve as lexicon, which bounds the map that the model carries.
    """

    lexicon = Param(Params._dummy(), "lexicon", "base forms a lemma must be one of")
    lexiconShare = Param(
        Params._dummy(), "lexiconShare", "least share of rows that hold a base form", typeConverter=TypeConverters.toFloat
    )

    @keyword_only
    def __init__(
        self, *, inputCol=None, outputCol="words", stopWords=None, onlyAlpha=True, lower=False, filterAfter=False,
        lexicon=None, lexiconShare=LEXICON_SHARE,
    ):
        super().__init__()
        self._setDefault(
            outputCol="words", stopWords=[], onlyAlpha=True, lower=False, filterAfter=False, lexicon=None,
            lexiconShare=LEXICON_SHARE,
        )
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        rules = self.rules()
        stage = CanonicalWords(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), **rules)
        if _is_split(dataset, self.getInputCol()):
            plain = dataset.select(F.col(self.getInputCol()).alias("words"))
        else:
            words = canonical_words(self.getInputCol(), rules["stopWords"], rules["onlyAlpha"], rules["lower"])
            plain = stored(dataset.select(words.alias("words")))
        return self._learned(stage, plain, stored(document_frequency(plain, "words")))

    def fit_counted(self, dataset, counts):
        """``fit`` on a column of word lists whose document frequency is known."""
        stage = CanonicalWords(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), **self.rules())
        return self._learned(stage, dataset.select(F.col(self.getInputCol()).alias("words")), counts)

    def _learned(self, stage, plain, counts):
        given, share = self.getOrDefault("lexicon"), self.getOrDefault("lexiconShare")
        if given is None:
            lexicon = corpus_lexicon(plain, "words", share, counts)
        else:
            lexicon = plain.sparkSession.createDataFrame([(w,) for w in given], "word string")
        rows = lemma_table(counts, lexicon).collect()  # at most eight per base form
        return stage.setLemmas({row.word: row.lemma for row in sorted(rows)})


class MajorityModel(Model, _InOut):
    """Predicts the same label for every row."""

    topLabel = Param(Params._dummy(), "topLabel", "label given to every row")

    @keyword_only
    def __init__(self, *, inputCol="label", outputCol="prediction", topLabel=None):
        super().__init__()
        self._setDefault(inputCol="label", outputCol="prediction")
        self._set(**self._input_kwargs)

    def getTopLabel(self):
        return self.getOrDefault("topLabel")

    def getPredictionCol(self):
        return self.getOutputCol()

    def _transform(self, dataset):
        return dataset.withColumn(self.getOutputCol(), F.lit(self.getTopLabel()))


class MajorityEstimator(Estimator, _InOut):
    """Learns the most frequent label; ties go to the lowest."""

    @keyword_only
    def __init__(self, *, inputCol="label", outputCol="prediction"):
        super().__init__()
        self._setDefault(inputCol="label", outputCol="prediction")
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        label = self.getInputCol()
        counts = dataset.filter(F.col(label).isNotNull()).groupBy(label).count()
        top = counts.orderBy(F.desc("count"), F.asc(label)).first()
        if top is None:
            raise ValueError(f"no label in column {label}")
        return MajorityModel(inputCol=label, outputCol=self.getOutputCol(), topLabel=top[0])


class WordSetModel(Model, _InOut, TrackedWords):
    """Which of the tracked words a row holds, as a 0/1 vector or as a list in tracked order."""

    wordCount = Param(Params._dummy(), "wordCount", "rows that hold each word, for a learned set")

    def getWordCount(self):
        return self.getOrDefault("wordCount")

    @keyword_only
    def __init__(self, *, inputCol="words", outputCol="features", wordSet=None, wordCount=None, indexWords=True):
        super().__init__()
        self._setDefault(inputCol="words", outputCol="features", wordCount=None, indexWords=True)
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        out, words = self.getOutputCol(), list(self.getWordSet())
        if not words:
            raise ValueError("the word set is empty")
        vectors = CountVectorizerModel.from_vocabulary(words, inputCol=self.getInputCol(), outputCol=out)
        encoded = vectors.setBinary(True).setMinTF(1.0).transform(dataset)
        if self.getIndexWords():
            return encoded
        tracked = F.from_json(F.lit(json.dumps(words)), "array<string>")
        places = F.unwrap_udt(out)["indices"]  # ascending
        return encoded.withColumn(out, F.transform(places, lambda i: F.get(tracked, i)))


class WordSetEstimator(Estimator, _InOut, TrackedWords):
    """Tracks the ``limitTo`` most common words, or the first ``limitTo`` words of a given set.

    Without a limit all words of a given set, or the ``DEFAULT_VOCABULARY`` most common words; for
    more use ``wordsets.encode``, which works on tables.
    """

    limitTo = Param(
        Params._dummy(), "limitTo", "most words to track", lambda n: None if n is None else TypeConverters.toInt(n)
    )

    @keyword_only
    def __init__(self, *, inputCol="words", outputCol="features", limitTo=None, wordSet=None, indexWords=True):
        super().__init__()
        self._setDefault(inputCol="words", outputCol="features", limitTo=None, wordSet=None, indexWords=True)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        limit, given = self.getOrDefault("limitTo"), self.getWordSet()
        if given:
            words, counts = list(dict.fromkeys(given))[:limit], None
        else:
            table = document_frequency(dataset, self.getInputCol()).orderBy(F.desc("count"), F.asc("word"))
            top = table.limit(DEFAULT_VOCABULARY if limit is None else limit).collect()
            words, counts = [row["word"] for row in top], [row["count"] for row in top]
        return WordSetModel(
            inputCol=self.getInputCol(),
            outputCol=self.getOutputCol(),
            wordSet=words,
            wordCount=counts,
            indexWords=self.getIndexWords(),
        )


class _InOutMany(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    def setInputCols(self, value):
        return self._set(inputCols=value)

    def setOutputCols(self, value):
        return self._set(outputCols=value)


class SharedIndexer(Estimator, _InOutMany):
    """One string index over the values of several columns; the model is a StringIndexerModel."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        columns = self.getInputCols()
        fitted = StringIndexer(inputCol="value", outputCol="index").fit(stack_columns(dataset, *columns))
        return StringIndexerModel.from_arrays_of_labels(
            [fitted.labels] * len(columns), inputCols=columns, outputCols=self.getOutputCols()
        )


class SharedOneHot(Estimator, _InOutMany):
    """One-hot vectors of one width for several index columns; the last index has its own slot."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        encoder = OneHotEncoder(inputCol="value", outputCol="vector", dropLast=False)
        fitted = encoder.fit(stack_columns(dataset, *self.getInputCols()))
        return PipelineModel(
            [
                fitted.copy().setInputCol(i).setOutputCol(o)
                for i, o in zip(self.getInputCols(), self.getOutputCols(), strict=True)
            ]
        )
