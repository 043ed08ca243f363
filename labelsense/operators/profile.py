"""Questions asked of a table before it is cleaned."""

from functools import reduce
from itertools import combinations
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelsense.functions.buckets import digest
from labelsense.functions.text import sentence_count, word_count
from labelsense.operators.scale import lookup_join, measured, running_totals, stored


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Count and share of all rows per value, most frequent first."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.filter(F.col(name).isNotNull()).groupBy(name).count()
    return counts.withColumn("fraction", F.col("count") / total).orderBy(F.desc("count"), F.asc(name))


def uniqueness(df: DataFrame, *names: str) -> DataFrame:
    """Rows, distinct values and duplicates per column; null counts as a value.

    Texts are counted by their digest, and equal values are merged before the shuffle.
    """
    values = [
        F.struct(F.lit(n).alias("column_name"), F.coalesce(digest(F.col(n).cast("string")), F.lit("")).alias("value"))
        for n in names
    ]
    per_value = df.select(F.inline(F.array(*values))).groupBy("column_name", "value").count()
    return per_value.groupBy("column_name").agg(
        F.sum("count").alias("n_rows"),
        F.count(F.lit(1)).alias("n_unique"),
        (F.sum("count") - F.count(F.lit(1))).alias("n_duplicates"),
    )


def missing(df: DataFrame, *names: str) -> DataFrame:
    """Number of nulls per column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("n_missing")) for n in names])
    return counts.select(F.inline(pairs))


def label_mentions(df: DataFrame, text: str, label: str) -> DataFrame:
    """Number of rows whose text holds the row's own label."""
    return df.agg(F.count_if(F.contains(F.col(text), F.col(label))).alias("n_mentions"), F.count(F.lit(1)).alias("n_rows"))


def duplicate_texts(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """All rows of every text that occurs more than once, with the number of copies."""
    keyed = df.withColumn("_digest", digest(text))
    repeated = keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
    return lookup_join(keyed, repeated, ["_digest"], salt_on=[id_col], key_rows="n_copies").drop("_digest")


def _segments(length: Column, parts: int) -> Column:
    """Cut 1..length into ``parts`` consecutive pieces of near equal size: (part, start, size)."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)),
        lambda i: F.struct(
            i.alias("part"),
            (F.floor(i * length / parts) + 1).cast("int").alias("start"),
            (F.floor((i + 1) * length / parts) - F.floor(i * length / parts)).cast("int").alias("size"),
        ),
    )


def pairs_within(values: DataFrame, name: str, distance: int, group_rows: int = 1000) -> DataFrame:
    """Unordered pairs of distinct values at most ``distance`` edits apart.

    If at most d edits turn one string into another, and the shorter one is cut into d+1 pieces,
    at least one piece is in the longer string unchanged, moved by d places or fewer. So the
    pieces of each value are joined with the pieces of other values by equality; the edit
    distance is checked inside the join, and only true pairs leave it. The pieces of a group that
    many values share are divided over several join keys of at most about ``group_rows`` values.
    """
    parts = distance + 1
    v = values.select(F.col(name).alias("v"), F.char_length(name).alias("n"))
    pieces = v.select("v", "n", F.inline(_segments(F.col("n"), parts))).select(
        F.col("v").alias("short"),
        F.col("n").alias("length"),
        "part",
        F.col("v").substr(F.col("start"), F.col("size")).alias("piece"),
    )
    lengths = F.sequence(F.greatest(F.col("n") - distance, F.lit(0)), F.col("n"))
    first = F.greatest(F.col("start") - distance, F.lit(1))
    last = F.greatest(first, F.least(F.col("start") + distance, F.col("n") + 1))
    probes = (
        v.select("v", "n", F.explode(lengths).alias("length"))
        .select("v", "n", "length", F.inline(_segments(F.col("length"), parts)))
        .select("v", "length", "part", "size", F.explode(F.sequence(first, last)).alias("at"))
        .select(F.col("v").alias("long"), "length", "part", F.col("v").substr(F.col("at"), F.col("size")).alias("piece"))
        .distinct()
    )
    group = ["length", "part", "piece"]
    n_chunks = F.ceil(F.count(F.lit(1)) / group_rows).cast("int")
    groups, fits = measured(
        pieces.groupBy(*group).agg(n_chunks.alias("short_chunks")).join(
            probes.groupBy(*group).agg(n_chunks.alias("long_chunks")), group
        )
    )

    def divided(rows: DataFrame, value: str, own: str, other: str) -> DataFrame:
        """Give each row its own chunk of the group, and a copy for every chunk of the other side."""
        return (
            lookup_join(rows, groups, group, salt_on=[value], fits=fits)
            .withColumn(own, F.pmod(F.xxhash64(value), F.col(own)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        )

    shorts = divided(pieces, "short", "short_chunks", "long_chunks")
    longs = divided(probes, "long", "long_chunks", "short_chunks")
    close = F.levenshtein(F.col("short"), F.col("long"), distance)
    same_length = F.char_length("short") == F.char_length("long")
    one_way = (F.col("short") != F.col("long")) & (~same_length | (F.col("short") < F.col("long")))
    keys = [*group, "short_chunks", "long_chunks"]
    equal = [F.col(f"s.{key}") == F.col(f"l.{key}") for key in keys]
    joined = shorts.alias("s").join(longs.alias("l"), reduce(and_, equal) & one_way & (close >= 0))
    return joined.select(
        F.least("short", "long").alias("value_1"), F.greatest("short", "long").alias("value_2"), close.alias("distance")
    ).distinct()


def similar_labels(df: DataFrame, name: str, k: int = 40) -> DataFrame:
    """The k pairs of distinct labels with the fewest edits between them, and how often each occurs.

    The search radius grows until it holds k pairs; all pairs inside it are found, so the k
    nearest are exact whatever radius is needed.
    """
    counts = stored(df.filter(F.col(name).isNotNull()).groupBy(name).count())
    n, longest = counts.agg(F.count(F.lit(1)), F.max(F.char_length(name))).first()
    wanted = min(k, n * (n - 1) // 2)
    radius = min(2, longest or 0)
    while True:
        pairs = stored(pairs_within(counts, name, radius))
        if radius >= (longest or 0) or pairs.limit(wanted).count() >= wanted:
            break
        radius = min(radius * 2, longest)
    nearest = pairs.orderBy("distance", "value_1", "value_2").limit(k)
    for side in ("1", "2"):
        side_counts = counts.select(F.col(name).alias(f"value_{side}"), F.col("count").alias(f"count_{side}"))
        # k rows on the left: the small side is the pairs.
        nearest = side_counts.join(F.broadcast(nearest), f"value_{side}")
    return nearest.select("value_1", "value_2", "distance", "count_1", "count_2").orderBy("distance", "value_1", "value_2")


def text_lengths(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Number of sentences and of words next to the columns in ``keep``."""
    return df.select(*keep, sentence_count(text).alias("n_sentences"), word_count(text).alias("n_words"))


def length_summary(lengths: DataFrame, *names: str) -> DataFrame:
    """Box-plot figures per column: smallest, quartiles, largest, and whisker ends at 1.5 IQR.

    Lengths are counted first, so the exact percentiles work on one row per distinct length.
    """
    stacked = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("bigint").alias("v")) for n in names])
    counts = stored(lengths.select(F.inline(stacked)).groupBy("measure", "v").count())
    box = counts.groupBy("measure").agg(
        F.percentile("v", [0.0, 0.25, 0.5, 0.75, 1.0], F.col("count")).alias("p"),
    )
    box = box.select("measure", *[F.col("p")[i].alias(c) for i, c in enumerate(["min", "q1", "median", "q3", "max"])])
    spread_ = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - spread_, F.col("q3") + spread_)
    whiskers = (
        counts.join(F.broadcast(box), "measure")  # one row per column asked for
        .groupBy("measure")
        .agg(
            F.min(F.when(inside, F.col("v"))).cast("double").alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).cast("double").alias("whisker_high"),
        )
    )
    return box.join(F.broadcast(whiskers), "measure")


def average_ranks(counts: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, rank): average rank of each value within its group; groups are few."""
    placed = running_totals(counts, [F.asc(group), F.asc(value)], {"_before": F.col("n")})
    earlier = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(group).agg(F.sum("n").alias("_rows"))
    starts = starts.select(group, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    rank = F.col("_before") - F.col("_start") + (F.col("n") + 1) / 2
    return placed.join(F.broadcast(starts), group).select(group, value, "n", rank.alias("rank"))


def spearman(df: DataFrame, *names: str) -> DataFrame:
    """Rank correlation of every two columns, nulls dropped pair by pair.

    Rows are first reduced to the distinct value pairs of each column pair, with their count.
    Ranks come from the counts of single values, and the correlation is a sum over value pairs.
    All column pairs go through the same few jobs, and a column is ranked once for all partners
    that have no nulls.
    """
    nulls = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
    pairs = list(combinations(names, 2))

    rankings = {}

    def ranking(name: str, partner: str) -> int:
        """Number of the ranking of a column among the rows where the partner is not null."""
        return rankings.setdefault((name, partner if nulls[partner] else None), len(rankings))

    columns = [
        F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
        for i, (a, b) in enumerate(pairs)
    ]
    stacked = df.select(F.inline(F.array(*columns))).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    joint = stored(stacked.groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n")))

    def by_pair(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("pair"))

    joint = joint.withColumns(
        {
            "ranking_a": by_pair([ranking(a, b) for a, b in pairs]),
            "ranking_b": by_pair([ranking(b, a) for a, b in pairs]),
        }
    )

    sources = {}  # one column pair that holds all rows of the ranking
    for i, (a, b) in enumerate(pairs):
        sources.setdefault(ranking(a, b), (i, "a"))
        sources.setdefault(ranking(b, a), (i, "b"))
    sides = [F.struct(F.col(f"ranking_{s}").alias("ranking"), F.col(s).alias("v"), F.lit(s).alias("side")) for s in "ab"]
    wanted = reduce(or_, [(F.col("pair") == i) & (F.col("side") == s) for i, s in sources.values()])
    values = joint.select("pair", "n", F.inline(F.array(*sides))).filter(wanted)
    counts = values.groupBy("ranking", "v").agg(F.sum("n").alias("n"))
    ranks, fits = measured(average_ranks(counts, "ranking", "v"))

    ranked = joint
    for side, other in (("a", "b"), ("b", "a")):
        of_side = ranks.select(
            F.col("ranking").alias(f"ranking_{side}"), F.col("v").alias(side), F.col("rank").alias(f"rank_{side}"),
            F.col("n").alias("_value_rows"),
        )
        keys = [f"ranking_{side}", side]
        ranked = lookup_join(ranked, of_side, keys, salt_on=["pair", other], key_rows="_value_rows", fits=fits)
        ranked = ranked.drop("_value_rows")
    totals = joint.groupBy("pair").agg(F.sum("n").alias("n_rows"))
    middle = (F.col("n_rows") + 1) / 2
    x, y, n = F.col("rank_a") - middle, F.col("rank_b") - middle, F.col("n")
    return (
        ranked.join(F.broadcast(totals), "pair")  # one row per column pair
        .groupBy("pair", "n_rows")
        .agg((F.sum(n * x * y) / F.sqrt(F.sum(n * x * x) * F.sum(n * y * y))).alias("correlation"))
        .select(
            by_pair([a for a, _ in pairs]).alias("column_1"),
            by_pair([b for _, b in pairs]).alias("column_2"),
            "correlation",
            "n_rows",
        )
    )
