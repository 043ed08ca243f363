"""Line deduplication by a deletion-neighbourhood join.

A line is the sequence of its words. Two lines match if their words are equal, or if one edit of a
word (put in, taken out, or put for another) makes them equal and the longer one has at least
``LEAST_WORDS`` words, so that they are alike to 0.8 or more. A line is dropped if an earlier line
matches it, whether that one is kept or not; earlier means by document id, then by line number.

1. Equal lines are brought together by a hash of their words, with their earliest place.
2. A line with a match shares the first or the last half of its words with it. Only lines that
   share such a half with another line go on.
3. Each of these gives its variants: the words without the i-th one, as a hash, for every i. Lines
   with the same variant and i are one substitution apart; a line that is itself a variant of
   another is one insertion apart. Each line meets the earliest line of each of its groups, not all
   of them, so a group of any size gives one row per line.
4. The words of each such pair are compared, and the earliest line that passes is kept.

Defined results: null and empty texts have no lines and stay as they are; lines without a word are
never dropped; a repeated row is dropped line by line as a copy only if its id or text differ, as
rows with equal ids and texts are one document here; documents with a null id come last; lines of
any length are read whole; an empty table gives an empty table; other columns are carried along, and
columns that bear a result's name are replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsense.llm import words
from labelsense.operators.scale import lookup_join, stored

LEAST_WORDS = 5
ARROW_ROWS = 500
LAST = (1 << 63) - 1


class Lines:
    """Lines with words of all texts of an Arrow column.

    ``text``, ``number``: the line's text in the column, and its number in it from 0; ``low``,
    ``high``: its words in ``values``; ``hash``: of all its words.
    """

    def __init__(self, texts: pa.Array):
        data, offsets = words.text_bytes(texts)
        self.values, starts, _, firsts = words.word_hashes(texts, lower=False)
        text = np.searchsorted(firsts[1:], np.arange(len(starts)), "right")
        breaks = np.flatnonzero(data == 10)
        number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[text]
        new = np.ones(len(starts), bool)
        new[1:] = (text[1:] != text[:-1]) | (number[1:] != number[:-1])
        self.low = np.flatnonzero(new)
        self.high = np.append(self.low[1:], len(starts)) if len(starts) else self.low
        self.text, self.number = text[self.low], number[self.low]
        self.up, self.down = words._power_tables(len(starts) + 1)
        self.sums = np.zeros(len(starts) + 1, np.uint64)
        np.cumsum(self.values * self.up[: len(starts)], out=self.sums[1:])
        self.hash = self.range_hash(self.low, self.high)

    def _sum(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (self.sums[high] - self.sums[low]) * self.down[low]

    def range_hash(self, low: np.ndarray, high: np.ndarray, salt: int | np.ndarray = 0) -> np.ndarray:
        return words.mix(self._sum(low, high) + words.mix((high - low).astype(np.uint64)) + np.uint64(1) * salt)

    def halves(self) -> np.ndarray:
        """Four keys per line: first and last half, for a longer line of n or n + 1 words."""
        size = self.high - self.low
        keys = []
        for longer in (size, size + 1):
            half = np.minimum((longer - 1) // 2, size)
            salt = words.mix(2 * longer.astype(np.uint64))
            keys.append(self.range_hash(self.low, self.low + half, salt))
            keys.append(self.range_hash(self.high - half, self.high, salt + np.uint64(1)))
        return np.stack(keys, axis=1)

    def without_one(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For chosen lines and each of their words: line, place of the word, hash of the others."""
        size = (self.high - self.low)[line]
        owner = np.repeat(line, size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        low, high = self.low[owner], self.high[owner]
        at = low + place
        rest = self._sum(low, at) + self._sum(at + 1, high) * self.up[place]
        return owner, place, words.mix(rest + words.mix((high - low - 1).astype(np.uint64)))


def _lists(rows: list[np.ndarray] | np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (id, key, text) to one row per line with words."""
    for batch in batches:
        for at in range(0, len(batch), ARROW_ROWS):
            part = batch.slice(at, ARROW_ROWS)
            lines = Lines(part.column("text"))
            size = lines.high - lines.low
            halves = lines.halves().view(np.int64)
            counts = np.where(size + 1 >= LEAST_WORDS, 4, 0)
            counts[size + 1 == LEAST_WORDS] = 2  # only as the shorter one of a pair
            flat = halves[np.arange(4)[None, :] >= 4 - counts[:, None]]
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            owner = pa.array(lines.text)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(owner), part.column("key").take(owner), pa.array(lines.number.astype(np.int32)),
                 pa.array(lines.hash.view(np.int64)), pa.array(size.astype(np.int32)),
                 pa.ListArray.from_arrays(offsets, pa.array(flat))],
                ["id", "key", "line_no", "line", "n", "halves"],
            )


def _read_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (id, key, text, wanted line numbers) to the variants of those lines.

    Place -1 is the line itself, with its words.
    """
    for batch in batches:
        for at in range(0, len(batch), ARROW_ROWS):
            part = batch.slice(at, ARROW_ROWS)
            lines = Lines(part.column("text"))
            wanted = part.column("wanted")
            wanted_text = np.repeat(np.arange(len(part)), np.diff(np.asarray(wanted.offsets)))
            code = lambda text, number: text.astype(np.int64) << 32 | number.astype(np.int64)
            chosen = np.flatnonzero(
                np.isin(code(lines.text, lines.number), code(wanted_text, np.asarray(wanted.flatten())))
            )
            owner, place, hashes = lines.without_one(chosen)
            held = (lines.high - lines.low)[owner] >= LEAST_WORDS
            owner, place, hashes = owner[held], place[held], hashes[held]
            own = [lines.values[a:b].view(np.int64) for a, b in zip(lines.low[chosen], lines.high[chosen], strict=True)]
            line = np.concatenate([chosen, owner])
            row = pa.array(lines.text[line])
            none = pa.nulls(len(owner), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(row), part.column("key").take(row),
                 pa.array(lines.number[line].astype(np.int32)), pa.array(lines.hash[line].view(np.int64)),
                 pa.array(np.concatenate([lines.hash[chosen], hashes]).view(np.int64)),
                 pa.array(np.concatenate([np.full(len(chosen), -1), place]).astype(np.int32)),
                 pa.concat_arrays([_lists(own), none])],
                ["id", "key", "line_no", "line", "variant", "place", "words"],
            )


def one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether at most one word is put in, taken out or put for another."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    unequal = np.flatnonzero(a != b[: len(a)])
    first = int(unequal[0]) if len(unequal) else len(a)
    return bool(np.array_equal(a[first + (len(a) == len(b)) :], b[first + 1 :]))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("words"), batch.column("other_words"), strict=True)
        passed = pa.array([one_edit(np.asarray(a.values), np.asarray(b.values)) for a, b in pairs], pa.bool_())
        yield batch.select(["line", "earlier"]).filter(passed)


def _place() -> F.Column:
    return F.struct(F.col("id"), F.col("key"), F.col("line_no"), F.col("line"))


def _keyed(docs: DataFrame, id_: str, text: str) -> DataFrame:
    id_column = F.coalesce(F.col(id_).cast("bigint"), F.lit(LAST)).alias("id")
    return docs.select(id_column, F.xxhash64(text).alias("key"), F.col(text).alias("text"))


def earlier_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(line, earlier): for each line one edit away from an earlier one, the earliest of those.

    ``distinct`` has each line once: line, first (its earliest place), halves.
    """
    halves = distinct.select("line", "first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    met = lookup_join(halves, shared, ["half"], "inner", salt_on=["line"], key_rows="times")
    wanted = met.select("first").distinct().groupBy(F.col("first.id").alias("id"), F.col("first.key").alias("key"))
    wanted = wanted.agg(F.collect_list("first.line_no").alias("wanted"))
    texts = lookup_join(docs, wanted, ["id", "key"], "inner")
    entries = texts.select("id", "key", "text", "wanted").mapInArrow(
        _read_variants, "id bigint, key bigint, line_no int, line bigint, variant bigint, place int, words array<bigint>"
    )
    entries = stored(entries)
    own = entries.filter("place = -1")
    cut = entries.filter("place >= 0").select("line", "variant", "place", _place().alias("at"))
    selves = own.select("variant", _place().alias("at"))

    # Lines that differ in the word at one place.
    groups = cut.groupBy("variant", "place").agg(F.min("at").alias("earlier"), F.count(F.lit(1)).alias("times"))
    replaced = lookup_join(cut, groups.filter("times > 1"), ["variant", "place"], "inner", ["line"], "times")
    # Lines that are another one without a word, and the other way round.
    one_self = selves.groupBy("variant").agg(F.min("at").alias("earlier"))
    longer = lookup_join(cut, one_self, ["variant"], "inner", salt_on=["line", "place"])
    shorter = selves.join(cut.groupBy("variant").agg(F.min("at").alias("earlier")), "variant")
    own_and_earlier = lambda t: t.filter(F.col("earlier") < F.col("at")).select(F.col("at.line").alias("line"), "earlier")
    pairs = own_and_earlier(replaced).unionByName(own_and_earlier(longer)).unionByName(own_and_earlier(shorter)).distinct()

    texts = own.groupBy("line").agg(F.any_value("words").alias("words"))
    other = texts.select(F.col("line").alias("other"), F.col("words").alias("other_words"))
    compared = pairs.withColumn("other", F.col("earlier.line")).join(texts, "line").join(other, "other")
    schema = "line bigint, earlier struct<id:bigint,key:bigint,line_no:int,line:bigint>"
    passed = compared.select("line", "earlier", "words", "other_words").mapInArrow(_verify, schema)
    return passed.groupBy("line").agg(F.min("earlier").alias("earlier"))


def dropped_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per dropped line: id, key (hash of the text), line_no from 0, and the place of the
    earliest line that matches it, kept_id, kept_key and kept_line_no."""
    keyed = _keyed(docs, id_, text)
    lines = stored(
        keyed.mapInArrow(_read_lines, "id bigint, key bigint, line_no int, line bigint, n int, halves array<bigint>")
    )
    distinct = lines.groupBy("line").agg(
        F.min(_place()).alias("first"), F.count(F.lit(1)).alias("times"), F.any_value("halves").alias("halves")
    )
    distinct = stored(distinct)
    earlier = stored(earlier_lines(keyed, distinct.select("line", "first", "halves")))
    info = distinct.select("line", "first", "times").join(earlier, "line", "left")
    info = info.filter(F.col("earlier").isNotNull() | (F.col("times") > 1)).select(
        "line", "times", "first", F.least("first", F.coalesce("earlier", "first")).alias("kept")
    )
    placed = lookup_join(lines.drop("halves", "n"), info, ["line"], "inner", ["id", "key", "line_no"], "times")
    return placed.filter(_place() > F.col("kept")).select(
        "id", "key", "line_no", F.col("kept.id").alias("kept_id"), F.col("kept.key").alias("kept_key"),
        F.col("kept.line_no").alias("kept_line_no"),
    )


def deduplicated(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the dropped lines taken out of ``text``, and ``n_lines`` and ``n_dropped``."""
    docs = docs.drop(*[c for c in ("n_lines", "n_dropped") if c not in (id_, text)])
    dropped = dropped_lines(docs.select(id_, text), id_, text)
    lists = stored(dropped.groupBy("id", "key").agg(F.sort_array(F.collect_set("line_no")).alias("_dropped")))
    names = [f"_in{i}" for i in range(len(docs.columns))]
    body, own_id = names[docs.columns.index(text)], names[docs.columns.index(id_)]
    keyed = docs.toDF(*names).withColumn("id", F.coalesce(F.col(own_id).cast("bigint"), F.lit(LAST)))
    told = lookup_join(keyed.withColumn("key", F.xxhash64(body)), lists, ["id", "key"], "left")
    lines = F.split(F.col(body), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_dropped"))
    # The array around the lines makes the inner loop read them, not split the text again.
    left = F.get(F.transform(F.array(lines), lambda all_: F.transform(kept, lambda i: F.get(all_, i))), 0)
    cleaned = F.when(F.col("_dropped").isNull(), F.col(body)).otherwise(F.array_join(left, "\n"))
    renamed = [(cleaned if n == body else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return told.select(
        *renamed,
        F.when(F.col(body).isNull() | (F.col(body) == ""), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
