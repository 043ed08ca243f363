"""Importance resampling towards a target: documents are drawn whose words look like the target's.

The features of a text are its runs of 1 to ``longest`` words, repeats counted, each hashed to one of
``buckets`` buckets by the CRC-32 of its UTF-8 bytes. A bucket's gain is the log ratio of its smoothed
shares in the target and in the documents, and a document's weight the sum of the gains of its
features. A Gumbel number made of a hash of the document's id is added to it; the highest scores are
a draw without replacement in proportion to the exponential of the weights.

Features come from Arrow kernels over whole columns: lower case, split, flatten, dictionary codes.
Runs of words are pairs of codes, so only distinct ones are spelled and hashed; gains are taken by
bucket and summed over the segment of each text. One pass counts buckets, each task adding up its
own; a second pass weighs. The only thing held whole is a number for each bucket, and texts are never
shuffled: ranks come from (id, score) rows, divided into ranges of the order.

Defined results: null and empty texts have no feature and weight 0; texts are read whole; documents
of fewer than ``least_words`` words get no rank; ties go to the smaller id, a null id coming last
and being hashed as "null"; equal rows get equal weights and scores, and a rank each; without a
target text all shares are those of the smoothing; an empty table gives an empty table. Columns that
bear a result's name are replaced, others are carried along.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsense.llm.words import text_bytes
from labelsense.operators.scale import running_totals, stored

LONGEST, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_BYTES = 4 << 20
RESULTS = ["n_words", "n_features", "weight"]


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in ``column`` have about ``size`` bytes, a longer text alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        if high > low:
            yield batch.slice(low, high - low)


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Number of words of each text; for each size of run, where the features of each text begin (one
    entry more than texts) and the bucket of every feature."""
    data, offsets = text_bytes(texts)  # from its first byte: ascii_lower reads slices of large strings wrongly
    whole_texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data))
    lists = pc.split_pattern_regex(pc.ascii_lower(whole_texts), SEPARATORS)
    text = pc.list_parent_indices(lists).to_numpy()
    encoded = pc.list_flatten(lists).dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64)
    names = [name.encode() for name in encoded.dictionary.to_pylist()]
    if b"" in names:  # what stands before a leading and after a trailing separator
        kept = codes != names.index(b"")
        text, codes = text[kept], codes[kept]
    every = np.arange(len(texts) + 1)
    runs, sums, sized = codes, [zlib.crc32(name) for name in names], []
    for size in range(1, longest + 1):
        if size > 1:
            whole = text[size - 1 :] == text[: len(text) - size + 1]
            pairs = runs[: len(whole)] * len(names) + codes[size - 1 :]
            distinct, inverse = np.unique(pairs[whole], return_inverse=True)
            before, last = np.divmod(distinct, max(1, len(names)))
            sums = [zlib.crc32(b" " + names[b], sums[a]) for a, b in zip(before, last, strict=True)]
            runs = np.full(len(whole), -1)
            runs[whole] = inverse
        else:
            whole = np.ones(len(codes), bool)
        bucket = np.array(sums, np.int64)[runs[whole]] % buckets if len(sums) else np.zeros(0, np.int64)
        sized.append((np.searchsorted(text[: len(whole)][whole], every), bucket))
        if not len(sums):
            runs = np.zeros(0, np.int64)
    return np.diff(np.searchsorted(text, every)), sized


def _counting(longest: int, buckets: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in blocks(batch, "text"):
                for _, bucket in features(part.column("text"), longest, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return read


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Number of features of all texts in each bucket."""
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_counting(longest, buckets), "bucket bigint, n bigint")
    total = np.zeros(buckets, np.int64)
    for row in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row per bucket
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed shares of each bucket, in thousandths, rounded down."""
    buckets = len(source)
    ratio = (target + 1.0) * (source.sum() + float(buckets)) / ((source + 1.0) * (target.sum() + float(buckets)))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def _weighing(gains, longest: int, kept: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "_text"):
                words, sized = features(part.column("_text"), longest, len(gains.value))
                count, weight = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                for starts, bucket in sized:
                    sums = np.concatenate([[0], np.cumsum(gains.value[bucket])])
                    count += np.diff(starts)
                    weight += np.diff(sums[starts])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(words), pa.array(count), pa.array(weight)],
                    [*kept, *RESULTS],
                )

    return read


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel number of a document in thousandths, rounded down, from a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))
    place = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((place + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def weighed(
    docs: DataFrame, gains: np.ndarray, columns: list[str], id_: str = "doc_id", text: str = "text",
    longest: int = LONGEST, seed: int = SEED,
) -> DataFrame:
    """The given columns with n_words, n_features, weight and score."""
    results = [*RESULTS, "score"]
    columns = [c for c in columns if c not in results]
    held = [f"_in{i}" for i in range(len(columns))]
    rows = docs.select(*[F.col(c).alias(h) for c, h in zip(columns, held, strict=True)],
                       F.col(id_).alias("_id"), F.col(text).alias("_text"))
    kept = [*held, "_id"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    table = rows.mapInArrow(
        _weighing(shared, longest, kept), f"{fields}, n_words bigint, n_features bigint, weight bigint"
    )
    scored = table.withColumn("score", F.col("weight") + noise(F.col("_id"), seed))
    return scored.select(*[F.col(h).alias(c) for c, h in zip(columns, held, strict=True)], *results)


def gains_for(
    docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text",
    longest: int = LONGEST, buckets: int = BUCKETS,
) -> np.ndarray:
    return bucket_gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))


def ranked(
    scored: DataFrame, id_: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT
) -> DataFrame:
    """``scored`` (narrow rows) with the ``rank`` of the drawn ones, from 1; null for others."""
    scored = stored(scored)
    long_enough = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    drawn = percent * scored.filter(long_enough).count() // 100
    order = [F.col("score").desc(), F.col(id_).asc_nulls_last(), F.col("weight"), F.col("n_words")]
    places = running_totals(scored.filter(long_enough), order, {"_place": None}, one_task_rows=0)
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1).cast("bigint")
    columns = [c for c in scored.columns if c != "rank"]
    rest = scored.filter(~long_enough).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return places.select(*columns, rank.alias("rank")).unionByName(rest)


def drawn_documents(
    docs: DataFrame, target: DataFrame, id_: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """The drawn rows with all their columns, n_words, n_features, weight and score.

    They are the rows not after the last drawn one, so texts stay where they are. Rows that equal
    that one in score and id are drawn or left together.
    """
    gains = gains_for(docs, target, text, target_text, longest, buckets)
    ranks = ranked(weighed(docs, gains, [id_], id_, text, longest, seed), id_, least_words, percent)
    last = ranks.orderBy(F.col("rank").desc_nulls_last()).select(F.col(id_), "score", "rank").first()
    rows = weighed(docs, gains, docs.columns, id_, text, longest, seed).filter(F.col("n_words") >= least_words)
    if last is None or last["rank"] is None:
        return rows.filter(F.lit(False))
    earlier = F.lit(True) if last[id_] is None else F.coalesce(F.col(id_) <= F.lit(last[id_]), F.lit(False))
    return rows.filter((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & earlier))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    scored = weighed(docs, gains_for(docs, benchmark), ["doc_id"])
    return ranked(scored).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS entries FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))
), texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents
  UNION ALL SELECT 't', item_id, text FROM benchmark
), features AS MATERIALIZED (
  SELECT side, id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM texts
), bytes AS (
  SELECT word, list_transform(range(0, strlen(word)),
    lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::BIGINT) AS b
  FROM (SELECT DISTINCT word FROM features)
), buckets AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], b),
    lambda c, x: xor(c >> 8, entries[(xor(c & 255, x) + 1)])), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes, crc_table
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t
  FROM features JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts
), weights AS (
  SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight
  FROM features JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), scores AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights ON id = doc_id
), places AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scores
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scores WHERE n_features >= 20)
    THEN place END AS rank
FROM places
"""
