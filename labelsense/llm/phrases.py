"""Phrase mining by SON partitioning: runs of words that occur together far more often than by chance.

A text is cut into pieces at marks and line ends, and a piece into words. A phrase is a run of 2 to
``longest`` words of one piece that occurs ``support`` times or more in its language. Its score is
a * a / (l * r), with its own count a and the counts of the two parts it can be cut into; the lowest
of all cuts counts. A phrase is dropped if a longer one that holds it has ``covered`` percent of its
count or more.

1. Documents are dealt into ``shards`` shards by a hash of the text. The words of each language in
   each shard are counted.
2. Every shard is mined completely, phrases of one word included, with a support that is lowered to
   the shard's share of the language's words, rounded up. A phrase with the whole support has the
   lowered one in at least one shard, or its counts could not add up. Tasks count 48-bit hashes of
   phrases and hand them on by shard and bucket, so a shard is mined by many tasks, one for each of its
   buckets.
3. The locally frequent phrases of all shards are united, without those whose counts in all shards, by
   hash, miss the whole support, and set bits of a sieve of ``1 << SIEVE_BITS`` bits, one for each value
   of the upper bits of a hash. It is 16 MB whatever the corpus; it lets through every candidate, and
   others that share a bit with one, the more the fuller it is.
4. What passes is counted again over all documents, as text and exactly, and the whole support is
   asked of it. Whatever the hashes did, the counts are right. Tasks add up their own counts and hand
   them on in packs, one for a language and bucket.

Scores, covering and ranks are joins and aggregates of counted phrases; the ranks of a language are
cut to the first ones in every task before they meet.

Defined results: a null text is empty; a null language is "und"; texts are read whole; equal rows
count as often as they are there; ties are broken by count, then by phrase in byte order; an empty
table gives an empty table. Other columns are not read.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelsense.llm import words
from labelsense.llm.resampling import blocks
from labelsense.operators.scale import split_join, stored

LONGEST, SUPPORT, COVERED, FIRST = 3, 10, 50, 2000
SHARDS = 4
SIEVE_BITS = 27
HASH_BITS, SLOT_BITS = 48, 8  # of a phrase's hash; languages are told apart by so many bits of it, those that share one have the lower support
BUCKET_BITS = 8
BUCKET_WORDS = 1 << 19  # of the corpus, for one bucket
BLOCK_BYTES, BLOCK_WORDS = 1 << 20, 1 << 18
TASK_ENTRIES, TASK_ROWS = 3 << 19, 1 << 19
UNKNOWN = "und"

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_SEPARATOR = _BREAK.copy()
_SEPARATOR[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Block:
    """Words of a stretch of text, in order; phrases that start at one of the first ``own`` of them count.

    ``word``: code of each word with its language; ``names``, ``langs``, ``hashes``: of the codes;
    ``piece``: rises with each piece; ``shard``: of each word; ``slots``: of the codes' languages.
    """

    own: int
    word: np.ndarray
    piece: np.ndarray
    shard: np.ndarray
    names: pa.Array
    langs: pa.Array
    hashes: np.ndarray
    slots: np.ndarray

    def longer(self, at: np.ndarray, size: int) -> np.ndarray:
        """Which of the phrases of ``size`` - 1 words at the places ``at`` have one more word in their piece."""
        last = at + size - 1
        inside = last < len(self.word)
        return inside & (self.piece[np.minimum(last, len(self.word) - 1)] == self.piece[at])

    def phrase_hashes(self, total: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the phrases of ``size`` words at ``at``, slot in the low bits; and the running hash.

        ``total`` is the running hash of their first ``size`` - 1 words.
        """
        total = total * words._BASE + self.hashes[self.word[at + size - 1]]
        own = words.mix(total + np.uint64(size)) >> np.uint64(64 - HASH_BITS + SLOT_BITS)
        return (own << np.uint64(SLOT_BITS)) | self.slots[self.word[at]], total


def text_blocks(batch: pa.RecordBatch, longest: int) -> Iterator[Block]:
    """Blocks of an Arrow batch of (text, lang, slot, shard); a long text is read in several."""
    for part in blocks(batch, "text", BLOCK_BYTES):
        data, offsets = words.text_bytes(part.column("text"))
        data = _LOWER[data]
        starts, ends = words.spans(data, offsets, _SEPARATOR)
        text = np.searchsorted(offsets, starts, "right") - 1
        broken = np.cumsum(_BREAK[data], dtype=np.int64)[starts] if len(starts) else starts
        new = np.ones(len(starts), np.int64)
        new[1:] = (np.diff(broken) > 0) | (np.diff(text) > 0)
        piece = np.cumsum(new)
        lang = part.column("lang").dictionary_encode()
        codes, slot = lang.indices.to_numpy().astype(np.int64), part.column("slot").to_numpy().astype(np.uint64)
        shard = part.column("shard").to_numpy()
        for low in range(0, len(starts), BLOCK_WORDS):
            own = min(BLOCK_WORDS, len(starts) - low)
            at = slice(low, min(len(starts), low + own + longest - 1))
            lengths = ends[at] - starts[at]
            stretch = data[starts[at][0] : ends[at][-1]]
            ends_here = np.concatenate([[0], np.cumsum(lengths)])
            spelled = pa.LargeStringArray.from_buffers(
                len(lengths), pa.py_buffer(ends_here), pa.py_buffer(stretch[~_SEPARATOR[stretch]].tobytes())
            ).dictionary_encode()
            key = codes[text[at]] * len(spelled.dictionary) + spelled.indices.to_numpy()
            distinct, first, word = np.unique(key, return_index=True, return_inverse=True)
            names = spelled.dictionary.take(pa.array(distinct % len(spelled.dictionary)))
            bytes_, bounds = words.text_bytes(names)
            yield Block(
                own, word, piece[at], shard[text[at]], names, lang.dictionary.take(pa.array(distinct // len(spelled.dictionary))),
                words.span_hashes(bytes_, bounds[:-1], bounds[1:], words._BYTE), slot[text[at]][first],
            )


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, shard, n): words of each batch."""
    for batch in batches:
        for part in blocks(batch, "text", BLOCK_BYTES):
            data, offsets = words.text_bytes(part.column("text"))
            starts, _ = words.spans(data, offsets, _SEPARATOR)
            n = np.diff(np.searchsorted(starts, offsets))
            table = pa.table({"lang": part.column("lang"), "shard": part.column("shard"), "n": pa.array(n)})
            yield from table.group_by(["lang", "shard"]).aggregate([("n", "sum")]).rename_columns(["lang", "shard", "n"]).to_batches()


def _local_counts(longest: int, bucket_bits: int):
    """Counts of the phrases that a task has seen, by shard and bucket: first the hashes that came
    more than once, with their counts, then those that came once. A hash takes six bytes."""

    def pack(held: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
        shards, buckets, hashes, counts = [], [], [], []
        for shard, parts in held.items():
            own, n = summed(parts)
            bucket = own >> np.uint64(HASH_BITS - bucket_bits)
            for low, high in _runs(bucket):
                once = n[low:high] == 1
                shards.append(shard)
                buckets.append(int(bucket[low]))
                ordered = np.concatenate([own[low:high][~once], own[low:high][once]])
                hashes.append(ordered.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8].tobytes())
                counts.append(n[low:high][~once].astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(shards, pa.int32()), pa.array(buckets, pa.int64()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())],
            ["shard", "bucket", "hashes", "counts"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = {}, 0
        for batch in batches:
            for block in text_blocks(batch, longest):
                at, total = np.arange(block.own), np.zeros(block.own, np.uint64)
                for size in range(1, longest + 1):
                    more = block.longer(at, size)
                    at, total = at[more], total[more]
                    hashes, total = block.phrase_hashes(total, at, size)
                    shard = block.shard[at]
                    for s in np.unique(shard).tolist():
                        own, n = np.unique(hashes[shard == s], return_counts=True)
                        held.setdefault(s, []).append((own, n))
                        entries += len(own)
                if entries > TASK_ENTRIES:
                    held = {s: [summed(parts)] for s, parts in held.items()}
                    entries = sum(len(parts[0][0]) for parts in held.values())
                    if entries > TASK_ENTRIES // 2:
                        yield pack(held)
                        held, entries = {}, 0
        yield pack(held)
        del held
        pa.default_memory_pool().release_unused()

    return read


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    if len(values):
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the sum of their counts."""
    values, n = (np.concatenate(column) for column in zip(*parts, strict=True))
    order = np.argsort(values)
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else order
    return values[first], np.add.reduceat(n[order], first) if len(first) else n


def _frequent(supports: np.ndarray, support: int, bucket_bits: int):
    """The bits of the sieve that are set in a bucket: for the phrases that are frequent in a shard, unless
    the counts of all shards together are below the support."""
    slot = np.uint64((1 << SLOT_BITS) - 1)

    def mine(table: pa.Table) -> pa.Table:
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for shard, hashes, counts in zip(*(table.column(c).to_pylist() for c in ("shard", "hashes", "counts")), strict=True):
            bytes_ = np.frombuffer(hashes, np.uint8).reshape(-1, HASH_BITS // 8)
            own = np.pad(bytes_, [(0, 0), (0, 8 - HASH_BITS // 8)]).view("<u8").reshape(-1)
            n = np.ones(len(own), np.int32)
            n[: len(counts) // 4] = np.frombuffer(counts, np.uint32)
            parts.setdefault(shard, []).append((own, n))
        mined = {shard: summed(parts.pop(shard)) for shard in list(parts)}
        local = [own[n >= supports[shard][(own & slot).astype(np.int64)]] for shard, (own, n) in mined.items()]
        hashes, n = summed(list(mined.values()))
        found = np.intersect1d(np.concatenate(local), hashes[n >= support])
        bits = np.zeros(1 << (SIEVE_BITS - bucket_bits), bool)
        bits[((found >> np.uint64(HASH_BITS - SIEVE_BITS)) & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        return pa.table({"bucket": table.column("bucket")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return mine


def _added_up(parts: list[pa.Table]) -> pa.Table:
    """(lang, bucket, phrase, n), each phrase once."""
    table = pa.concat_tables(parts).group_by(["lang", "bucket", "phrase"], use_threads=False).aggregate([("n", "sum")])
    return table.rename_columns(["lang", "bucket", "phrase", "n"])


def _packed(table: pa.Table) -> pa.RecordBatch:
    """A row for each language and bucket, with its phrases, their lengths and their counts, compressed."""
    codes = table.column("lang").combine_chunks().dictionary_encode().indices.to_numpy()
    table = table.take(pa.array(np.lexsort([table.column("bucket").to_numpy(), codes]))).combine_chunks()
    lang = table.column("lang").combine_chunks().dictionary_encode()
    bucket, n = (table.column(c).to_numpy() for c in ("bucket", "n"))
    phrases = table.column("phrase").combine_chunks()
    rows = {c: [] for c in ("lang", "bucket", "phrases", "lengths", "counts")}
    for low, high in _runs(lang.indices.to_numpy().astype(np.int64) << SIEVE_BITS | bucket):
        data, bounds = words.text_bytes(phrases.slice(low, high - low))
        parts = (data, np.diff(bounds).astype(np.uint32), n[low:high].astype(np.int64))
        values = (lang[low].as_py(), int(bucket[low]), *[zlib.compress(part.tobytes(), 1) for part in parts])
        for column, value in zip(rows.values(), values, strict=True):
            column.append(value)
    kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows.values(), kinds, strict=True)], list(rows))


def _merging(support: int):
    """The phrases of a language and bucket that have the support, from the rows of ``_packed``."""

    def merge(table: pa.Table) -> pa.Table:
        parts = []
        for row in table.select(["phrases", "lengths", "counts"]).to_pylist():
            data, lengths, n = (zlib.decompress(row[c]) for c in ("phrases", "lengths", "counts"))
            bounds = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.uint32), dtype=np.int64)])
            phrase = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
            parts.append(pa.table({"phrase": phrase, "n": pa.array(np.frombuffer(n, np.int64))}))
        counted = pa.concat_tables(parts).group_by("phrase", use_threads=False).aggregate([("n", "sum")])
        counted = counted.filter(pc.greater_equal(counted.column("n_sum"), support))
        lang = pa.repeat(table.column("lang")[0], counted.num_rows)
        return pa.table({"lang": lang, "phrase": counted.column("phrase").cast(pa.string()), "n": counted.column("n_sum")})

    return merge


def _exact_counts(sieve, longest: int, bucket_bits: int):
    """Counts of the phrases that pass the sieve, added up over the blocks of a task; see ``_packed``."""

    def passes(hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> np.uint64(HASH_BITS - SIEVE_BITS)).astype(np.int64)
        return (sieve.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1

    def counts(block: Block) -> Iterator[pa.Table]:
        at, total, code = np.arange(block.own), np.zeros(block.own, np.uint64), np.zeros(block.own, np.int64)
        names = None
        for size in range(1, longest + 1):  # a phrase can only pass if its beginning does
            more = block.longer(at, size)
            hashes, total = block.phrase_hashes(total[more], at[more], size)
            kept = passes(hashes)
            at, total = at[more][kept], total[kept]
            key = code[more][kept] * len(block.names) + block.word[at + size - 1]
            distinct, first, code, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            before, last = np.divmod(distinct, len(block.names))
            added = block.names.take(pa.array(last))
            blank = pa.scalar(" ", pa.large_string())
            names = added if names is None else pc.binary_join_element_wise(names.take(pa.array(before)), added, blank)
            bucket = (hashes[kept][first] >> np.uint64(HASH_BITS - bucket_bits)).astype(np.int64)
            yield pa.table({"lang": block.langs.take(pa.array(last)).cast(pa.string()), "bucket": bucket, "phrase": names, "n": n.astype(np.int64)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for block in text_blocks(batch, longest):
                held += counts(block)
                if sum(map(len, held)) > TASK_ROWS:
                    held = [_added_up(held)]
                    if len(held[0]) > TASK_ROWS // 2:
                        yield _packed(held[0])
                        held = []
        if held:
            yield _packed(_added_up(held))
        del held
        pa.default_memory_pool().release_unused()  # the worker may stay for long without a task

    return read


def local_supports(n_words: DataFrame, support: int, shards: int) -> np.ndarray:
    """Lowered support by shard and slot; of languages in one slot, the lowest. ``n_words``: (lang, slot, n, n0 ..)."""
    lowered = [F.min(F.expr(f"(n{s} * {support} + n - 1) div n")).alias(f"t{s}") for s in range(shards)]
    out = np.ones((shards, 1 << SLOT_BITS), np.int64)
    for row in n_words.filter("n > 0").groupBy("slot").agg(*lowered).collect():  # at most a row per slot
        for s in range(shards):
            out[s, row["slot"]] = max(1, row[f"t{s}"])
    return out


def _prepared(docs: DataFrame, text: str, lang: str, shards: int) -> DataFrame:
    named = F.coalesce(F.col(lang), F.lit(UNKNOWN))
    return docs.select(
        F.coalesce(F.col(text), F.lit("")).alias("text"), named.alias("lang"),
        F.pmod(F.xxhash64(named), F.lit(1 << SLOT_BITS)).cast("int").alias("slot"),
        F.pmod(F.xxhash64(F.col(text)), F.lit(shards)).cast("int").alias("shard"),
    )


def language_words(docs: DataFrame, shards: int) -> DataFrame:
    """(lang, slot, n, n0, n1 ..): words of each language in all and in each shard."""
    counts = docs.select("text", "lang", "shard").mapInArrow(_word_counts, "lang string, shard int, n bigint")
    own = [F.sum(F.when(F.col("shard") == s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in range(shards)]
    slot = F.pmod(F.xxhash64("lang"), F.lit(1 << SLOT_BITS)).cast("int").alias("slot")
    return stored(counts.groupBy("lang").agg(F.sum("n").alias("n"), *own).select("*", slot))


def sieve(docs: DataFrame, n_words: DataFrame, longest: int, support: int, shards: int, bucket_bits: int) -> np.ndarray:
    """Packed bits of all phrases that are frequent in a shard."""
    local = docs.mapInArrow(
        _local_counts(longest, bucket_bits), "shard int, bucket bigint, hashes binary, counts binary"
    )
    supports = local_supports(n_words, support, shards)
    mined = local.groupBy("bucket").applyInArrow(_frequent(supports, support, bucket_bits), "bucket bigint, bits binary")
    bits = np.zeros((1 << bucket_bits, 1 << (SIEVE_BITS - bucket_bits - 3)), np.uint8)
    for row in mined.collect():  # a row per bucket, 16 MB in all
        bits[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(-1)


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, support: int = SUPPORT,
    shards: int = SHARDS,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of all phrases of 1 to ``longest`` words with the support; words of each language."""
    rows = _prepared(docs, text, lang, shards)
    n_words = language_words(rows, shards)
    total = n_words.agg(F.sum("n")).first()[0] or 0
    bucket_bits = max(BUCKET_BITS, min(SIEVE_BITS - 3, (total // BUCKET_WORDS).bit_length()))
    bits = rows.sparkSession.sparkContext.broadcast(sieve(rows, n_words, longest, support, shards, bucket_bits))
    schema = "lang string, bucket bigint, phrases binary, lengths binary, counts binary"
    passed = rows.mapInArrow(_exact_counts(bits, longest, bucket_bits), schema)
    counts = passed.groupBy("lang", "bucket").applyInArrow(_merging(support), "lang string, phrase string, n bigint")
    size = (F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1).cast("int")
    return stored(counts.withColumn("size", size)), n_words.select("lang", "n")


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the phrases of two words or more; the lowest-scoring cut."""
    part = F.split("phrase", " ")
    cut = lambda at, n: F.array_join(F.slice(part, at, n), " ")
    cuts = (
        phrases.filter("size > 1")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        .select("lang", "phrase", "size", F.col("n").alias("a"), "k")
    )
    sides = {"l": cut(F.lit(1), F.col("k")), "r": cut(F.col("k") + 1, F.col("size") - F.col("k"))}
    for name, side in sides.items():  # the counted phrases grow with the corpus, so they are not broadcast
        parts = phrases.select("lang", F.col("phrase").alias("_part"), F.col("n").alias(name))
        cuts = split_join(cuts.withColumn("_part", side), parts, ["lang", "_part"], salt_on=["phrase"]).drop("_part")
    a, l, r = (F.col(c).cast("decimal(16,0)") for c in "alr")
    exact = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, l * r)
    best = F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """The candidates without those that a longer one has ``covered`` percent of."""
    words_ = F.split("phrase", " ")
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.col("size") - n + 1), lambda at: F.array_join(F.slice(words_, at, n), " ")
            ),
        )
    )
    longer = candidates.filter("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("_held"))
    most = longer.groupBy("lang", "phrase").agg(F.max("_held").alias("_held"))
    joined = candidates.join(most, ["lang", "phrase"], "left")
    return joined.filter(F.col("_held").isNull() | (100 * F.col("_held") < covered * F.col("a"))).drop("_held")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, support: int = SUPPORT,
    covered: int = COVERED, first: int = FIRST, shards: int = SHARDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language."""
    phrases, n_words = frequent_phrases(docs, text, lang, longest, support, shards)
    kept = uncovered(stored(scored(phrases)), covered)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    top = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return top.join(n_words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH pieces AS MATERIALIZED (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^ \\t]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents)
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0
), runs AS (
  SELECT lang, i, w, unnest([1, 2, 3]) AS size FROM starts
), counts AS MATERIALIZED (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
  FROM runs WHERE i + size - 1 <= len(w) GROUP BY ALL
), candidates AS MATERIALIZED (
  SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10
), cuts AS (
  SELECT lang, size, phrase, f, k, array_to_string(w[:k], ' ') AS a, array_to_string(w[k + 1:], ' ') AS b
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), cut_scores AS (
  SELECT c.*, x.f AS l, y.f AS r, 1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = a JOIN counts y ON y.lang = c.lang AND y.phrase = b
), best AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
  FROM candidates WHERE size = 3
), most AS (
  SELECT lang, phrase, max(f) AS held FROM inner_ GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, f DESC, phrase) AS rank
  FROM best b LEFT JOIN most USING (lang, phrase) WHERE held IS NULL OR 100 * held < 50 * f
)
SELECT lang, rank, phrase, f AS a, l, r,
  (SELECT sum(f) FROM counts c WHERE c.size = 1 AND c.lang = ranked.lang)::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
