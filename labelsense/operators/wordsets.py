"""Which words to track: five strategies, each giving an ordered table (rank, word).

Ranks start at 0. The strategies other than the most common words start from the matches of words
and labels, see ``operators.matching``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsense.operators.matching import Matches
from labelsense.operators.scale import lookup_join, running_totals, stored

def exploded_words(df: DataFrame, words: str, *keep: str) -> DataFrame:
    """One row per word of the row's word list.

    The outer form keeps the optimizer from adding a test for empty lists below it, which would
    compute the words a second time.
    """
    return df.select(*keep, F.explode_outer(words).alias("word")).filter(F.col("word").isNotNull())


def vocabulary(df: DataFrame, words: str) -> DataFrame:
    """Every word that occurs, once."""
    return exploded_words(df, words).distinct()


def document_frequency(df: DataFrame, words: str) -> DataFrame:
    """(word, count): number of rows that hold the word; repeats inside a row count once."""
    distinct = df.select(F.array_distinct(words).alias("_words"))
    return exploded_words(distinct, "_words").groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def ranked(words: DataFrame, *order) -> DataFrame:
    """(rank, word, ...) by the given order, for any number of words."""
    return running_totals(words, list(order), {"rank": None})


def common(df: DataFrame, words: str, limit: int | None = None) -> DataFrame:
    """The words held by most rows; ties by word. No limit keeps all of them."""
    counts = document_frequency(df, words)
    if limit is not None:
        counts = counts.orderBy(F.desc("count"), F.asc("word")).limit(limit)
    return ranked(counts, F.desc("count"), F.asc("word")).select("rank", "word", "count")


def forms_of_common(counts: DataFrame, lemmas: dict[str, str], limit: int, most: int = 2000) -> list[str] | None:
    """The words of which the ``limit`` most common lemmas can be made, or None if they are more than ``most``.

    ``counts`` is the document frequency (word, count) before lemmatising. A lemma is held by at least as many rows as
    its most common form, and by at most as many as all its forms together; so the lemmas that the latter leaves below
    the ``limit``-th of the former can't be among the most common, and need not be counted.
    """
    table = counts.sparkSession.createDataFrame(sorted(lemmas.items()), "word string, lemma string")
    known = lookup_join(counts, table, ["word"], "left") if lemmas else counts.withColumn("lemma", F.col("word"))
    forms = stored(known.select("word", "count", F.coalesce("lemma", "word").alias("lemma")))
    bounds = forms.groupBy("lemma").agg(F.max("count").alias("least"), F.sum("count").alias("all"))
    top = bounds.orderBy(F.desc("least")).limit(limit).select("least").collect()
    cut = min((row.least for row in top), default=0) if len(top) == limit else 0
    rows = forms.join(bounds.filter(F.col("all") >= cut), "lemma").select("word").limit(most + 1).collect()
    return sorted(row.word for row in rows) if len(rows) <= most else None


def interleave(ranks: DataFrame, label_order: DataFrame) -> DataFrame:
    """Merge one ranked word list per label into one list: all first words, all second words, ...

    A word that several labels share takes its best place; inside a round the words follow the
    order of the labels. ``ranks``: (label, word, place); ``label_order``: (label, label_order).
    """
    placed = lookup_join(ranks, label_order, ["label"], salt_on=["word"])
    # Place and label order in one number, which Spark can minimise in a hash table.
    key = F.shiftleft(F.col("place").cast("bigint"), 31) + F.col("label_order")
    best = placed.groupBy("word").agg(F.min(key).alias("best"))
    return ranked(best, F.asc("best"), F.asc("word")).select("rank", "word")


def similar(matches: Matches, label_order: DataFrame, opposite: bool = False) -> DataFrame:
    """Words most similar to the labels, the best word of each label first.

    Other labels count towards the length of the lists and are removed afterwards.
    """
    return interleave(without_labels(matches.nearest(opposite), label_order), label_order)


def dissimilar(matches: Matches, label_order: DataFrame) -> DataFrame:
    """Words that point away from the labels."""
    return similar(matches, label_order, opposite=True)


def without_labels(words: DataFrame, label_order: DataFrame) -> DataFrame:
    """Rows whose word is not itself a label."""
    names = label_order.select(F.col("label").alias("word"))
    return lookup_join(words, names, ["word"], "left_anti")


def extremes(similar_words: DataFrame, dissimilar_words: DataFrame) -> DataFrame:
    """Alternate the two lists, up to the length of the shorter; a repeated word keeps its first place."""
    a, b = stored(similar_words), stored(dissimilar_words)
    shorter = F.least(a.agg(F.count(F.lit(1))).scalar(), b.agg(F.count(F.lit(1))).scalar())
    zipped = (
        a.select((F.col("rank") * 2).alias("place"), "rank", "word")
        .unionByName(b.select((F.col("rank") * 2 + 1).alias("place"), "rank", "word"))
        .filter(F.col("rank") < shorter)
    )
    first = zipped.groupBy("word").agg(F.min("place").alias("place"))
    return ranked(first, F.asc("place")).select("rank", "word")


def low_entropy(matches: Matches, label_order: DataFrame, n_labels: int | None = None) -> DataFrame:
    """Words whose similarity is spread most unevenly over the labels, with the entropy.

    Similarities are shifted to [0, 2] and normalised; the base of the logarithm is the number
    of labels. With s the shifted values and S their sum, the entropy is ln S - sum(s ln s)/S.
    """
    base = F.lit(n_labels) if n_labels is not None else label_order.agg(F.count(F.lit(1))).scalar()
    entropy = F.round((F.ln("total") - F.col("sln") / F.nullif("total", F.lit(0.0))) / F.ln(base), 12)
    per_word = without_labels(matches.sums, label_order).select("word", entropy.alias("entropy"))
    return ranked(per_word, F.asc("entropy"), F.asc("word")).select("rank", "word", "entropy")


def encode(words: DataFrame, word_set: DataFrame, id_col: str) -> DataFrame:
    """(id, indices): which words of a target set each row holds, in target order.

    For target sets too large to hand to every task as a parameter; else use ``WordSetModel``.
    ``words`` has one row per id and word.
    """
    hits = lookup_join(words, word_set.select("word", "rank"), ["word"], salt_on=[id_col])
    return hits.groupBy(id_col).agg(F.sort_array(F.collect_set("rank")).alias("indices"))
