"""Stages whose model is a table: word sets and indexes of any size.

What such a stage has learned is neither a parameter nor on the driver. It is a table that is stored
with the stage, read back with it, and joined with the rows, so that its size is bounded by the
cluster alone. ``stages.WordSetEstimator`` and ``SharedIndexer`` do the same with a list in each task.
The most common words of a table, a fixed number of them, are looked up in a list here too.
"""

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import functions as F

from labelsense.operators.labels import stack_columns
from labelsense.operators.scale import lookup_join, measured, stored
from labelsense.operators.wordsets import common, exploded_words, ranked
from labelsense.plans.stages import WordSetModel
from labelsense.sources.tables import word_list

# Words of a table that each task has in a list. They make up most of a text, whatever the size of the table.
LISTED_WORDS = 1 << 15


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.cls()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        instance.table = self.sparkSession.read.parquet(f"{path}/table")
        return instance


class TableModel(Model, MLWritable, MLReadable):
    """A model with a ``table``, which is written and read with its parameters."""

    table = None

    def write(self):
        return _TableWriter(self)

    @classmethod
    def read(cls):
        return _TableReader(cls)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.table = self.table
        return that


class _TrackedTable(HasInputCol, HasOutputCol):
    indexWords = Param(
        Params._dummy(), "indexWords", "whether rows get the places of words rather than the words", TypeConverters.toBoolean
    )


class TableWordSetModel(TableModel, _TrackedTable):
    """Which words of ``table`` (rank, word, count) a row holds: an array of ranks, or of words, by rank.

    A row without one gets an empty array, and so does a null list. The first ``LISTED_WORDS`` words are found
    row by row; only the rarer ones are dealt out as pairs of word and row, to be joined with the table and
    gathered by row. These have the higher ranks, so they follow the others.
    """

    @keyword_only
    def __init__(self, *, inputCol="words", outputCol="features", indexWords=True):
        super().__init__()
        self._setDefault(inputCol="words", outputCol="features", indexWords=True)
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        words, out = self.getOrDefault("inputCol"), self.getOrDefault("outputCol")
        names = [c for c in dataset.columns if c != out]
        held = [f"_in{i}" for i in range(len(names))]
        rows = dataset.select(*[F.col(c).alias(h) for c, h in zip(names, held, strict=True)])
        rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
        own = F.col(held[names.index(words)])
        first, far = self._listed(rows, own), self._joined(rows, own)
        joined = lookup_join(first, far, ["_row"], "left", salt_on=["_row"])
        listed = F.concat("_near", F.coalesce("_far", F.array().cast(first.schema["_near"].dataType)))
        return joined.select(*[F.col(h).alias(c) for h, c in zip(held, names, strict=True)], listed.alias(out))

    def _listed(self, rows, own):
        """Rows with ``_near``: the places of their words, or the words, among the first ``LISTED_WORDS``."""
        index, first = self.getOrDefault("indexWords"), word_list(self.table, LISTED_WORDS)
        if not first:
            return rows.withColumn("_near", F.array().cast("array<bigint>" if index else "array<string>"))
        filled = rows.withColumn("_words", F.coalesce(own, F.array().cast("array<string>")))
        found = WordSetModel(inputCol="_words", outputCol="_near", wordSet=first, indexWords=index).transform(filled)
        places = F.unwrap_udt("_near")["indices"].cast("array<bigint>") if index else F.col("_near")
        return found.withColumn("_near", places).drop("_words")

    def _joined(self, rows, own):
        """(_row, _far): the places of the words after these, or the words, for rows that hold some."""
        first = self.table.filter(F.col("rank") < LISTED_WORDS).select("word")
        pairs = exploded_words(rows, F.array_distinct(own), "_row").join(F.broadcast(first), "word", "left_anti")
        later, fits = measured(self.table.filter(F.col("rank") >= LISTED_WORDS).select("word", "rank"))
        if not fits:
            pairs = stored(pairs)  # read twice: its words are counted before the join
        hits = lookup_join(pairs, later, ["word"], salt_on=["_row"], fits=fits)
        part = "rank" if self.getOrDefault("indexWords") else "word"
        found = F.array_sort(F.collect_list(F.struct(*dict.fromkeys(["rank", part]))))
        return hits.groupBy("_row").agg(F.transform(found, lambda f: f[part]).alias("_far"))


class TableWordSetEstimator(Estimator, _TrackedTable, DefaultParamsReadable, DefaultParamsWritable):
    """Tracks the ``limitTo`` most common words of the rows' word lists, all of them without a limit."""

    limitTo = Param(
        Params._dummy(), "limitTo", "most words to track", lambda n: None if n is None else TypeConverters.toInt(n)
    )

    @keyword_only
    def __init__(self, *, inputCol="words", outputCol="features", limitTo=None, indexWords=True):
        super().__init__()
        self._setDefault(inputCol="words", outputCol="features", limitTo=None, indexWords=True)
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        model = TableWordSetModel(**{p: self.getOrDefault(p) for p in ("inputCol", "outputCol", "indexWords")})
        model.table = stored(common(dataset, self.getOrDefault("inputCol"), self.getOrDefault("limitTo")))
        return model


class TableIndexerModel(TableModel, HasInputCols, HasOutputCols):
    """The number of each column's value in ``table`` (value, label, count); one above all others for one not in it.

    A null value has a null number.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        size = self.table.count()
        for name, out in zip(self.getOrDefault("inputCols"), self.getOrDefault("outputCols"), strict=True):
            keys = self.table.select(F.col("value").alias("_value"), F.col("label").alias("_label"))
            rows = lookup_join(dataset.withColumn("_value", F.col(name).cast("string")), keys, ["_value"], "left")
            number = F.when(F.col(name).isNotNull(), F.coalesce("_label", F.lit(float(size))))
            dataset = rows.withColumn(out, number).drop("_value", "_label")
        return dataset


class TableIndexer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """One index over the values of several columns, the most frequent first, ties by value."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset):
        values = stack_columns(dataset, *self.getOrDefault("inputCols")).filter(F.col("value").isNotNull())
        counts = values.groupBy(F.col("value").cast("string").alias("value")).count()
        model = TableIndexerModel(inputCols=self.getOrDefault("inputCols"), outputCols=self.getOrDefault("outputCols"))
        places = ranked(counts, F.desc("count"), F.asc("value"))
        model.table = stored(places.select("value", F.col("rank").cast("double").alias("label"), "count"))
        return model
