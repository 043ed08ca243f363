"""Benchmark decontamination by templates, which finds a question with its numbers and names changed.

Every run of ``WINDOW`` tokens of a benchmark item, with numbers, names and units replaced by typed
placeholders, is a key; a second key, if it is another one, has the loose types, by which a name that
opens a sentence or a run is a placeholder as well. The runs of every document are tested against a
bitmap of the keys, whose size is fixed, and those that pass are hash-joined with them. Matches of
one document and item at one distance are brought together, but for those whose own values under the
placeholders do not map one to one from the item to the document. The rest count if all their values
together map one to one, and if they are as many as a run of ``RUN`` tokens has, or as the item has;
where the loose ones make them differ, those of the first key count alone.

An item with too few windows of loose types for such a run, which any item of up to 12 tokens is, has
keys of its whole text as well: its tokens in lower case, so every copy of it is found, and both
templates, if they have ``LEAST_FIXED`` fixed tokens, with values that map one to one.

A window needs ``LEAST_FIXED`` tokens that are not placeholders: without words, a template says
nothing of the question.

Defined results: null and empty texts on either side match nothing; an item of one or two tokens is
found in every document that holds them; ``n_windows`` is 0 if only the whole item was met; a document that holds an item twice gets a row for each distance;
equal rows get equal results; ids may be null or repeat, documents are then told apart by a hash of
their text; an empty table on either side gives an empty result; other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsense.llm.templates import Tokens
from labelsense.operators.scale import lookup_join, stored

WINDOW, LEAST_FIXED, RUN = 8, 5, 13
FILTER_BITS = 24
ARROW_ROWS = 500
_WINDOWS = "id bigint, key bigint, place int, size int, windows int, form int, template bigint, slots array<bigint>"
_STRICT, _LOOSE, _COPY = 0, 1, 2
_LEAST_WINDOWS = RUN - WINDOW + 1


class _Keys:
    """Keys of some places of an Arrow batch: first token, size, whether it is a whole text, form, hash."""

    def __init__(self):
        self.parts = []

    def add(self, at: np.ndarray, size: int, whole: bool, form: int, hashes: np.ndarray) -> None:
        codes = [np.full(len(at), code, np.int32) for code in (size, whole, form)]
        self.parts.append((at.astype(np.int64), *codes, hashes.view(np.int64)))

    def columns(self) -> list[np.ndarray]:
        return [np.concatenate(column) for column in zip(*self.parts, strict=True)]


_FORMS = ((_STRICT, False), (_LOOSE, True), (_COPY, None))


def _window_keys(tokens: Tokens, keys: _Keys) -> tuple[np.ndarray, np.ndarray]:
    """Adds the keys of all windows; the first tokens of those of each kind of types."""
    at, hashes = tokens.windows(WINDOW, LEAST_FIXED)
    loose_at, loose = tokens.windows(WINDOW, LEAST_FIXED, loose=True)
    other = loose != hashes[np.searchsorted(at, loose_at)]
    keys.add(at, WINDOW, False, _STRICT, hashes)
    keys.add(loose_at[other], WINDOW, False, _LOOSE, loose[other])
    return at, loose_at


def _whole_keys(tokens: Tokens, keys: _Keys, few: np.ndarray) -> None:
    """Adds the keys of the whole of each text that is marked in ``few``."""
    sizes = np.diff(tokens.first)
    for size in np.unique(sizes[few & (sizes > 0)]).tolist():
        texts = tokens.first[:-1][few & (sizes == size)]
        for form, loose in _FORMS:
            at, hashes, fixed = tokens.whole(size, loose)
            held = np.isin(at, texts) & ((form == _COPY) | (fixed >= LEAST_FIXED))
            keys.add(at[held], size, True, form, hashes[held])


def _windows(sizes=None, bits=None):
    """Arrow batches of (id, key, text) to the keys of each text.

    Of items, without ``bits``: all windows, and the whole text if it needs that. Of documents: windows
    and runs of the ``sizes`` of whole items, as far as they pass the bitmap.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bits is None else np.unpackbits(bits.value, bitorder="little")
        for batch in batches:
            for start in range(0, len(batch), ARROW_ROWS):
                part = batch.slice(start, ARROW_ROWS)
                tokens, keys = Tokens(part.column("text")), _Keys()
                count = lambda at: np.bincount(np.searchsorted(tokens.first[1:], at, "right"), minlength=len(part))  # noqa: B023, E731
                strict, loose = map(count, _window_keys(tokens, keys))
                if table is None:
                    _whole_keys(tokens, keys, loose < _LEAST_WINDOWS)
                for size in sizes or ():
                    for form, types in _FORMS:
                        at, hashes, _ = tokens.whole(size, types)
                        held = table[hashes.view(np.int64) & ((1 << FILTER_BITS) - 1)] == 1
                        keys.add(at[held], size, True, form, hashes[held])
                at, size, whole, form, template = keys.columns()
                if table is not None:
                    held = np.flatnonzero(table[template & ((1 << FILTER_BITS) - 1)])
                    at, size, whole, form, template = (x[held] for x in (at, size, whole, form, template))
                row = np.searchsorted(tokens.first[1:], at, "right")
                slots = [
                    tokens.slots(a, n, f == _LOOSE) if f != _COPY else np.zeros(0, np.int64)
                    for a, n, f in zip(at.tolist(), size.tolist(), form.tolist(), strict=True)
                ]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in slots])]).astype(np.int32)
                values = np.concatenate([*slots, np.zeros(0, np.int64)])
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(rows), part.column("key").take(rows),
                     pa.array((at - tokens.first[row]).astype(np.int32)), pa.array(np.where(whole, size, 0).astype(np.int32)),
                     pa.array(strict[row].astype(np.int32)), pa.array(form), pa.array(template),
                     pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()))],
                    ["id", "key", "place", "size", "windows", "form", "template", "slots"],
                )

    return read


def _keyed(table: DataFrame, id_: str, text: str) -> DataFrame:
    column = F.col(text)
    return table.select(F.col(id_).cast("bigint").alias("id"), F.xxhash64(column).alias("key"), column.alias("text"))


def _bitmap(templates: DataFrame) -> np.ndarray:
    """One bit per key, 2 MB whatever the number of keys; more keys let more windows through."""
    bits = templates.select(F.pmod("template", F.lit(1 << FILTER_BITS)).alias("bit"))
    blocks = bits.groupBy(F.shiftright("bit", 15).cast("int").alias("block")).agg(
        F.bitmap_construct_agg(F.pmod("bit", F.lit(1 << 15))).alias("bits")
    )
    out = np.zeros(((1 << FILTER_BITS) >> 15, 4096), np.uint8)
    for row in blocks.collect():
        out[row["block"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out.ravel()


def _one_to_one(pairs: Column) -> Column:
    """Whether (item, document) pairs of values map each value to one other, both ways."""
    count = F.size(F.array_distinct(pairs))
    left = F.size(F.array_distinct(F.transform(pairs, lambda p: p["item"])))
    right = F.size(F.array_distinct(F.transform(pairs, lambda p: p["doc"])))
    return (count == left) & (count == right)


def _run(which: Column) -> Column:
    """Number of windows, first place and all pairs of values of the matches for which ``which`` holds."""
    place = F.when(which, F.col("item_place"))
    return F.struct(
        F.size(F.collect_set(place)).alias("n_windows"),
        F.min(place).alias("from_place"),
        F.array_distinct(F.flatten(F.collect_set(F.when(which, F.col("pairs"))))).alias("pairs"),
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document, item and distance: id, key (hash of the text), item_id, first_token,
    n_windows, item_windows, n_changed (values that differ from the item's)."""
    spark = docs.sparkSession
    items = stored(_keyed(benchmark, item_id, item_text).mapInArrow(_windows(), _WINDOWS))
    bits = spark.sparkContext.broadcast(_bitmap(items))
    sizes = [row["size"] for row in items.filter("size > 0").select("size").distinct().collect()]
    found = _keyed(docs, id_, text).mapInArrow(_windows(sizes, bits), _WINDOWS)
    keys = items.select(
        F.col("id").alias("item_id"), F.col("key").alias("item_key"), F.col("place").alias("item_place"),
        F.col("windows").alias("item_windows"), F.col("form").alias("item_form"), "size", "template", F.col("slots").alias("item_slots"),
    )
    pairs = F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc"))
    met = found.join(keys, ["template", "size"]).select(
        "id", "key", "item_id", "item_key", "item_windows", "item_place", (F.col("place") - F.col("item_place")).alias("distance"),
        (F.col("size") > 0).alias("whole"),
        ((F.col("form") == _STRICT) & (F.col("item_form") == _STRICT)).alias("strict"), pairs.alias("pairs"),
    )
    inside = met.filter(_one_to_one(F.col("pairs")))
    runs = inside.groupBy("id", "key", "item_id", "item_key", "item_windows", "distance").agg(
        _run(~F.col("whole")).alias("all"), _run(F.col("strict") & ~F.col("whole")).alias("strict"), _run(F.col("whole")).alias("whole")
    )
    needed = F.greatest(F.least(F.col("item_windows"), F.lit(_LEAST_WINDOWS)), F.lit(1))
    enough = lambda run: (F.col(run)["n_windows"] >= needed) & _one_to_one(F.col(run)["pairs"])
    windows = F.when(enough("all"), F.col("all")).when(enough("strict"), F.col("strict"))
    # The whole item says more than its windows; its places are all 0.
    whole = F.col("whole").withField("n_windows", F.col("all.n_windows"))
    best = F.when(F.col("whole.n_windows") > 0, whole).otherwise(windows)
    return runs.withColumn("run", best).filter(F.col("run").isNotNull()).select(
        F.col("id").alias(id_), "key", "item_id", (F.col("distance") + F.col("run.from_place")).alias("first_token"),
        F.col("run.n_windows").alias("n_windows"), "item_windows",
        F.size(F.filter("run.pairs", lambda p: p["item"] != p["doc"])).alias("n_changed"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the columns they came with."""
    names = [f"_in{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    id_, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    leaks = contaminated(docs.select("doc_id", "text"), benchmark)
    name = F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("null"))
    leaks = leaks.select(name.alias("_id"), "key").distinct()
    name = F.coalesce(F.col(id_).cast("bigint").cast("string"), F.lit("null"))
    keyed = held.withColumn("_id", name).withColumn("key", F.xxhash64(text))
    kept = lookup_join(keyed, leaks, ["_id", "key"], "left_anti", salt_on=[id_])
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op7_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, benchmark).drop("key")
