"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

A document is the set of its word n-grams as 64-bit hashes. Documents with equal sets are one row
of the incidence matrix, called a class. The product of the matrix with its transpose, which counts
the n-grams two classes share, is taken block by block of columns, and a pair is dropped as soon as
what it has plus what it can still get is below what its sizes ask for.

1. The first block of a class is its prefix: the first n - ceil(t*n) + 1 of its n-grams in an order
   common to all. A pair that reaches the threshold t shares one of them, and its sizes are within
   the factor t, so the block is a join on n-gram and size band. The order puts n-grams that many
   classes hold last; so a passage that stands in every document makes no pairs, unless a prefix
   consists of such n-grams. What two prefixes share, plus the rest of the set whose prefix ends
   first, bounds the overlap.
2. Columns of such n-grams would make a row for every pair. Their classes are laid out in tiles of
   at most ``TILE`` by ``TILE`` instead. A task multiplies the whole sets of a tile, counts the links
   of each class, and gives one row per class with its count and its component in the tile. A pair
   counts in the tile of its first common n-gram only, and not at all if the join above has it.
3. For all other pairs the second block is the zone, the n-grams with the lowest hashes, somewhat longer than the
   prefix. Its overlap, plus the smaller rest, bounds the whole overlap.
4. The last block is everything; it gives the exact overlap of the few pairs that are left.

No group of copies is expanded, no column is capped. ``HOT`` decides only the order of the columns
and where their products are made, never the result. Two different n-grams with one 64-bit hash would count as one; expect that once
in some billions of n-grams, with an effect of one in an overlap.

Defined results: null texts and texts without words have the empty set and are linked with nothing,
not even with each other; a text with fewer words than n has one n-gram, all of its words; copies
are linked; a repeated row is a copy; a null id is never the smallest id of a component, unless all
its ids are null; an empty table gives an empty table; other columns are not read.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsense.llm import words
from labelsense.llm.graph import components
from labelsense.operators.scale import lookup_join, stored

#: An n-gram held by more classes than this comes late in the order of columns.
HOT = 32
TILE = 512
TILE_COLUMNS = 4096
FILTER_BITS = 24
ARROW_ROWS = 500


@dataclass(frozen=True)
class Likeness:
    """Sets of ``words`` words that share at least ``percent`` per cent of their union."""

    words: int = 5
    percent: int = 80

    def prefix(self, n: Column) -> Column:
        return n - F.ceil(n * self.percent / 100).cast("int") + 1

    def zone_size(self, n: int) -> int:
        prefix = n + (-n * self.percent) // 100 + 1
        return min(n, prefix + prefix // 2 + 8)

    def reaches(self, overlap: Column, n: Column, m: Column) -> Column:
        return overlap * (100 + self.percent) >= self.percent * (n + m)


def _sets(like: Likeness, whole: bool):
    """Arrow batches of (id, key, text) to (id, key, n, class, n-grams): all of them or the zone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ARROW_ROWS):
                part = batch.slice(at, ARROW_ROWS)
                sizes, classes, grams = [], [], []
                for found in words.shingle_sets(part.column("text"), like.words):
                    n = len(found)
                    sums = np.array([words.mix(found).sum(), words.mix(found ^ np.uint64(n)).sum()], np.uint64)
                    found = np.sort(found.view(np.int64))
                    sizes.append(n)
                    classes.append(sums.astype(">u8").tobytes() if n else None)
                    grams.append(found if whole else found[: like.zone_size(n)])
                offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
                values = np.concatenate([*grams, np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(sizes, pa.int32()),
                     pa.array(classes, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()))],
                    ["doc_id", "key", "n", "class", "grams"],
                )

    return read


def _text_key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text")


def _read_sets(docs: DataFrame, like: Likeness, whole: bool) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, key bigint, n int, class binary, grams array<bigint>"
    return docs.mapInArrow(_sets(like, whole), schema)


def whole_sets(docs: DataFrame, like: Likeness, wanted: DataFrame) -> DataFrame:
    """(class, n, grams) with all n-grams, of the classes whose text keys are ``wanted``."""
    rows = lookup_join(_text_key(docs), wanted.select("key").distinct(), ["key"], "left_semi", salt_on=["doc_id"])
    texts = rows.groupBy("key").agg(F.any_value("text").alias("text"), F.lit(None).cast("bigint").alias("doc_id"))
    sets = _read_sets(texts.select("doc_id", "key", "text"), like, True)
    return sets.filter("n > 0").groupBy("class", "n").agg(F.any_value("grams").alias("grams"))


def _counted(grams: DataFrame) -> DataFrame:
    return grams.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("times"))


def _hot_of(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """(class, g): the hot n-grams of each class."""
    return lookup_join(sets.select("class", F.explode("grams").alias("g")), hot, ["g"], "inner", salt_on=["class"])


def _too_short(like: Likeness, length: Column, n_hot: Column) -> Column:
    """Whether a zone of ``length`` n-grams, of which ``n_hot`` are hot, doesn't hold the whole prefix."""
    return (length < F.col("n")) & (length - n_hot < like.prefix(F.col("n")))


def short_zones(classes: DataFrame, hot: DataFrame, like: Likeness) -> DataFrame:
    """(class, key) of the classes whose whole sets are needed; n-grams themselves are not shuffled."""
    counts = _hot_of(classes, hot).groupBy("class").agg(F.count(F.lit(1)).alias("n_hot"))
    slim = classes.select("class", "key", "n", F.size("grams").alias("length"))
    return stored(slim.join(counts, "class").filter(_too_short(like, F.col("length"), F.col("n_hot"))).select("class", "key"))


def prefixes(sets: DataFrame, hot: DataFrame, like: Likeness) -> DataFrame:
    """(class, n, prefix, late, grams) from (class, n, grams).

    ``prefix`` has the n-grams of the first block that are not hot, ``late`` those that are, null
    for none. ``prefix`` is null where ``grams`` is a zone that is too short to tell. ``grams`` is
    kept where ``late`` has any; it is the whole set there.
    """
    found = _hot_of(sets, hot).groupBy("class").agg(F.sort_array(F.collect_list("g")).alias("hot"))
    none = F.array().cast("array<bigint>")
    joined = lookup_join(sets, found, ["class"], "left").withColumn("hot", F.coalesce("hot", none))
    early = F.array_except("grams", "hot")
    length = like.prefix(F.col("n"))
    known = ~_too_short(like, F.size("grams"), F.size("hot"))
    more = F.greatest(length - F.size("grams") + F.size("hot"), F.lit(0))
    has_late = known & (more > 0)
    return joined.select(
        "class", "n",
        F.when(known, F.slice(early, F.lit(1), length)).alias("prefix"),
        F.when(has_late, F.slice("hot", F.lit(1), more)).alias("late"),
        F.when(has_late, F.col("grams")).alias("grams"),
    )


def _repeated_filter(prefix: DataFrame) -> np.ndarray:
    """Bits for the n-grams that stand in two prefixes or more; 2 MB, whatever the data.

    Unequal n-grams may share a bit, so it lets through some that stand in one prefix only; the
    join finds no partner for those.
    """
    grams = prefix.select(F.col("prefix").alias("grams"))
    bits = _counted(grams).filter("times > 1").select(F.pmod("g", F.lit(1 << FILTER_BITS)).alias("bit"))
    blocks = bits.groupBy(F.shiftright("bit", 15).cast("int").alias("block")).agg(
        F.bitmap_construct_agg(F.pmod("bit", F.lit(1 << 15))).alias("bits")
    )
    out = np.zeros(((1 << FILTER_BITS) >> 15, 4096), np.uint8)
    for row in blocks.collect():  # at most 2 ** FILTER_BITS / 32,768 rows of 4 KB
        out[row["block"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.ravel()


def _entries(bits) -> object:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits.value, bitorder="little")
        for batch in batches:
            lists = batch.column("prefix")
            g = np.asarray(lists.flatten())
            row = np.repeat(np.arange(len(batch)), np.diff(np.asarray(lists.offsets)))
            keep = table[g & ((1 << FILTER_BITS) - 1)] == 1
            row = pa.array(row[keep])
            kept = ["class", "n", "rest", "last"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in kept], pa.array(g[keep])], [*kept, "g"])

    return emit


def _band(like: Likeness) -> Column:
    """Sizes within the factor of the threshold are in the same band or in neighbouring ones."""
    return F.floor(F.log("n") / F.lit(math.log(101 / like.percent))).cast("int")


def candidate_pairs(prefix: DataFrame, like: Likeness) -> DataFrame:
    """(a, b, n, m): classes whose prefixes share enough n-grams that are not hot, with sizes in reach."""
    spark = prefix.sparkSession
    bits = spark.sparkContext.broadcast(_repeated_filter(prefix))
    # Up to its last n-gram, a prefix has all of the class that are not hot; to the end, if it has late ones.
    last = F.when(F.col("late").isNotNull(), F.lit((1 << 63) - 1)).otherwise(F.array_max("prefix"))
    ranged = prefix.select("class", "n", "prefix", (F.col("n") - F.size("prefix")).alias("rest"), last.alias("last"))
    entries = ranged.mapInArrow(_entries(bits), "class binary, n int, rest int, last bigint, g bigint")
    entries = entries.withColumn("band", _band(like))
    small = entries.select(F.col("class").alias("a"), "n", F.col("rest").alias("rest_a"), F.col("last").alias("last_a"), "g", "band")
    large = entries.select(
        F.col("class").alias("b"), F.col("n").alias("m"), F.col("rest").alias("rest_b"), F.col("last").alias("last_b"), "g",
        F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"),
    )
    first = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") < F.col("b")))
    met = small.join(large, ["g", "band"]).filter(first & (F.col("n") * 100 >= F.col("m") * like.percent))
    pairs = met.groupBy("a", "b", "n", "m", "rest_a", "last_a", "rest_b", "last_b").agg(F.count(F.lit(1)).alias("shared"))
    # What ends first shares no more of its prefix than was counted, so the rest bounds the overlap.
    rest = F.least(
        F.when(F.col("last_a") <= F.col("last_b"), F.col("rest_a")), F.when(F.col("last_b") <= F.col("last_a"), F.col("rest_b"))
    )
    return pairs.filter(like.reaches(F.col("shared") + rest, F.col("n"), F.col("m"))).select("a", "b", "n", "m")


def _tile(like: Likeness):
    def multiply(table: pa.Table) -> pa.Table:
        """The links of one tile, from rows (g, side, class, n, rows, prefix, late, grams).

        Rows of side 0 are held against those of side 1, rows of side 2 against each other. There is
        a result row per class that has links, not per link: the number of rows of the classes that
        it is linked with, and a class of its component in the tile.
        """
        table = table.combine_chunks()
        g, side = table.column("g")[0].as_py(), np.asarray(table.column("side"))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        size, rows = (np.asarray(table.column(c)).astype(np.int64) for c in ("n", "rows"))

        def overlaps(name: str, below: int | None = None) -> np.ndarray:
            """Common n-grams of each row on the left and each on the right, block by block of columns."""
            column = table.column(name).combine_chunks()
            values = np.asarray(column.flatten())
            row = np.repeat(np.arange(len(column)), np.diff(np.asarray(column.offsets)))
            if below is not None:
                values, row = values[values < below], row[values < below]
            columns, place = np.unique(values, return_inverse=True)
            order = np.argsort(place, kind="stable")
            place, row = place[order], row[order]
            total = np.zeros((len(left), len(right)), np.float32)
            for at in range(0, len(columns), TILE_COLUMNS):
                low, high = np.searchsorted(place, [at, at + TILE_COLUMNS])
                block = np.zeros((len(size), min(TILE_COLUMNS, len(columns) - at)), np.float32)
                block[row[low:high], place[low:high] - at] = 1
                total += block[left] @ block[right].T
            return total

        overlap = overlaps("grams")
        linked = overlap * (100 + like.percent) >= like.percent * (size[left][:, None] + size[right][None, :])
        # The tile of an earlier common n-gram, or the join on those that are not hot, has the others.
        linked &= (overlaps("late", below=g) == 0) & (overlaps("prefix") == 0) & (left[:, None] != right[None, :])
        count = np.zeros(len(size), np.int64)
        count[left] += linked @ rows[right]
        if not (side == 2).all():
            count[right] += linked.T @ rows[left]
        root = np.arange(len(size))
        while True:
            before = root.copy()
            root[left] = np.minimum(root[left], np.where(linked, root[right][None, :], len(size)).min(axis=1, initial=len(size)))
            root[right] = np.minimum(root[right], np.where(linked, root[left][:, None], len(size)).min(axis=0, initial=len(size)))
            if (root == before).all():
                break
        held = np.flatnonzero(count)
        classes = table.column("class")
        return pa.table([classes.take(held), classes.take(root[held]), pa.array(count[held])], ["class", "root", "linked"])

    return multiply


def hot_links(prefix: DataFrame, rows: DataFrame, like: Likeness) -> DataFrame:
    """(class, root, linked) from the pairs that share late n-grams but no other of their prefixes.

    ``prefix``: (class, n, prefix, late, whole grams); ``rows``: (class, rows). The classes of a
    column and size band are dealt to blocks of about ``TILE``. Two blocks of one band are a tile,
    and so are a block of a band and one of the next band.
    """
    some = stored(prefix.filter(F.col("late").isNotNull()).join(rows, "class"))
    cells = some.select("class", "n", F.explode("late").alias("g"), _band(like).alias("band"))
    counts = cells.groupBy("g", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    counts = stored(counts)
    above = counts.select("g", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = counts.select("g", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    sizes = counts.join(above, ["g", "band"], "left").join(below, ["g", "band"], "left").fillna(0, ["above", "below"])
    told = lookup_join(cells, sizes, ["g", "band"], "inner", salt_on=["class"])
    told = told.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    own = F.col("own")
    each = lambda count: F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda step, side, i, j: F.struct(
        step.alias("low"), (F.lit(0) if side is None else F.lit(1)).alias("across"),
        (F.when(i == j, 2).when(i == own, 0).otherwise(1) if side is None else F.lit(side)).alias("side"),
        i.alias("i"), j.alias("j"),
    )
    tiles = F.concat(
        F.transform(each(F.col("blocks")), lambda o: tile(F.col("band"), None, F.least(own, o), F.greatest(own, o))),
        F.transform(each(F.col("above")), lambda o: tile(F.col("band"), 0, own, o)),
        F.transform(each(F.col("below")), lambda o: tile(F.col("band") - 1, 1, o, own)),
    )
    told = told.select("g", "class", F.inline(tiles))
    laid = told.join(some, "class")
    return laid.groupBy("g", "low", "across", "i", "j").applyInArrow(_tile(like), "class binary, root binary, linked bigint")


def _with_grams(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("class").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("class").alias("b"), F.col("grams").alias("grams_b"))
    return pairs.join(left, "a").join(right, "b")


def _zone_bound(like: Likeness) -> Column:
    """Whether the overlap in the zone plus the smaller rest is enough."""
    edge = F.least(F.element_at("grams_a", -1), F.element_at("grams_b", -1))
    seen_a = F.filter("grams_a", lambda g: g <= edge)
    seen_b = F.filter("grams_b", lambda g: g <= edge)
    rest = F.least(F.col("n") - F.size(seen_a), F.col("m") - F.size(seen_b))
    return like.reaches(F.size(F.array_intersect("grams_a", "grams_b")) + rest, F.col("n"), F.col("m"))


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()


@dataclass
class Joined:
    """``rows``: (doc_id, key, n, class); ``classes``: (class, n, first_id, rows, key); ``links``:
    (a, b, n, m, overlap), each pair once, but for those of ``stars``: (class, root, linked), which says
    that a class is in one component with the root, and linked with so many rows more."""

    rows: DataFrame
    classes: DataFrame
    links: DataFrame
    stars: DataFrame


def jaccard_join(docs: DataFrame, like: Likeness = Likeness()) -> Joined:
    """The links between unequal sets, and the class of each row."""
    docs = docs.select("doc_id", "text")
    # The row number is stored with the row, so it is the same whenever the table is read.
    sets = stored(_read_sets(_text_key(docs), like, False).withColumn("row", F.monotonically_increasing_id()))
    found = sets.filter("n > 0").groupBy("class", "n").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("key"), F.min("row").alias("row")
    )
    found = stored(found)
    # One row per class, with its zone; the zones stay where they are if the list is short.
    classes = lookup_join(sets.select("row", "grams"), found.select("row", "class", "n", "key"), ["row"], "inner")

    # Columns that many classes hold: first in the zones, then in the whole sets of those classes
    # whose zone consists of them.
    hot = stored(_counted(classes).filter(F.col("times") > HOT).select("g"))
    more = _counted(whole_sets(docs, like, short_zones(classes, hot, like))).filter(F.col("times") > HOT).select("g")
    hot = stored(hot.unionByName(more).distinct())
    short = short_zones(classes, hot, like)
    full = stored(prefixes(stored(whole_sets(docs, like, short)), hot, like))
    zones = stored(prefixes(classes.select("class", "n", "grams"), hot, like).filter(F.col("prefix").isNotNull()))
    prefix = zones.unionByName(full)

    pairs = stored(candidate_pairs(prefix, like))
    seen = stored(lookup_join(classes.select("class", "grams"), _members(pairs), ["class"], "left_semi"))
    pairs = stored(_with_grams(pairs, seen).filter(_zone_bound(like)).select("a", "b", "n", "m"))
    keys = lookup_join(found.select("class", "key"), _members(pairs), ["class"], "left_semi")
    both = _with_grams(pairs, stored(whole_sets(docs, like, keys)))
    overlap = both.select("a", "b", "n", "m", F.size(F.array_intersect("grams_a", "grams_b")).alias("overlap"))
    links = stored(overlap.filter(like.reaches(F.col("overlap"), F.col("n"), F.col("m"))))
    stars = stored(hot_links(prefix, found.select("class", "rows"), like))
    return Joined(sets.select("doc_id", "key", "n", "class"), found.drop("row"), links, stars)


def grouped(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n_shingles, component_id, n_links, class.

    ``component_id`` is the smallest id reachable by links, ``n_links`` the number of other rows
    that the row is linked with directly. ``key`` is a hash of the text.
    """
    joined = jaccard_join(docs, like)
    stars = joined.stars.select(F.col("class").alias("a"), F.col("root").alias("b"))
    nodes = stored(components(joined.links.select("a", "b").unionByName(stars)))
    sized = joined.classes.select("class", "first_id", "rows")
    near = nodes.select(F.col("node").alias("class")).join(sized, "class").select("class", "rows")

    def linked_rows(end: str, other: str) -> DataFrame:
        there = near.select(F.col("class").alias(other), F.col("rows").alias("_rows"))
        return joined.links.join(there, other).groupBy(F.col(end).alias("class")).agg(F.sum("_rows").alias("linked"))

    linked = linked_rows("a", "b").unionByName(linked_rows("b", "a")).unionByName(joined.stars.select("class", "linked"))
    linked = linked.groupBy("class").agg(F.sum("linked").alias("linked"))
    placed = nodes.withColumnRenamed("node", "class").join(sized, "class")
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = placed.join(lowest, "root").join(linked, "class")
    found = found.select("class", "component_id", (F.col("linked") + F.col("rows") - 1).alias("n_links"))
    copies = sized.filter("rows > 1").join(nodes.withColumnRenamed("node", "class"), "class", "left_anti")
    copies = copies.select("class", F.col("first_id").alias("component_id"), (F.col("rows") - 1).alias("n_links"))
    info = lookup_join(joined.rows, found.unionByName(copies), ["class"], "left", salt_on=["doc_id", "key"])
    alone = F.col("n_links").isNull()
    return info.select(
        "doc_id", "key", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "class",
    )


def one_of_each(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """The rows of ``docs`` without all but one of each component, the one with the smallest id.

    Texts are not shuffled unless the list of dropped rows is too long to be broadcast. Rows whose
    text has no words all stay. Of equal rows with equal ids one stays.
    """
    names = [f"_in{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    id_, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = stored(grouped(docs, like))
    node = F.coalesce(F.col("component_id").cast("string"), F.hex("class"))
    some = rows.filter("n_shingles > 0").withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    lowest = some.withColumn("_node", node).groupBy("_node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("least"),
        F.count(F.lit(1)).alias("rows"),
    )
    many = lowest.filter("rows > 1")
    members = lookup_join(some.withColumn("_node", node), many.select("_node", "least"), ["_node"], salt_on=["doc_id"])
    least_id = F.coalesce(F.col("least.doc_id").cast("string"), F.lit("null"))
    is_least = (F.col("_id") == least_id) & (F.col("key") == F.col("least.key"))
    marked = members.groupBy("_id", "key").agg(F.max(is_least).alias("stays"), F.count(F.lit(1)).alias("times"))
    marked = stored(marked.filter("NOT stays OR times > 1").select("_id", "key", "stays"))
    keyed = held.withColumn("_id", F.coalesce(F.col(id_).cast("string"), F.lit("null"))).withColumn("key", F.xxhash64(text))
    told = lookup_join(keyed, marked, ["_id", "key"], "left", salt_on=[id_])
    once = told.filter("stays").dropDuplicates(["_id", "key"])
    kept = told.filter(F.col("stays").isNull()).unionByName(once)
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words and 90 per cent, as the contract of the query says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grouped(docs, Likeness(words=3, percent=90)).select("doc_id", "n_shingles", "component_id", "n_links")
