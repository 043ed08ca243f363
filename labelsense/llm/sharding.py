"""Sharding by a minimax contiguous partition of ordered groups.

Rows with equal texts are a group that is not divided. Groups are ordered by the digest of their
text, and this order is cut into contiguous shards so that the largest shard is as small as it can
be: a binary search finds the smallest capacity for which filling shard after shard, greedily,
needs no more shards than there are.

The search runs on sums over ranges of the order, never on the groups themselves. At first each
range is one of 4,096 digest prefixes. A range counts once as atomic, which gives a capacity that
is surely enough, and once as freely divisible, which gives one that is surely needed. Only ranges
in which a cut may fall between the two are then divided by longer prefixes, in a Spark aggregate,
until the two capacities meet. So the driver holds a few thousand sums whatever the size of the
table, and the result is exact. Of all cuts with that capacity the most even ones are taken.

Defined results: a null text is empty and forms a group of its own, apart from empty texts; equal
rows are in one group and get consecutive places in any order; an empty table gives an empty table;
if a group is larger than the mean shard, some shards may be empty. Columns that bear a result's
name are replaced, others are carried along.
"""

from dataclasses import dataclass
from functools import reduce
from operator import add, or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelsense.operators.scale import stored

SHARDS = 24
ROW_BYTES = 8
FIRST_PREFIX, MORE_PREFIX, DIGEST = 3, 2, 32
SLOT_BUCKETS = 1024


def text_group(text: Column) -> Column:
    """Digest that stands for a group in the order, 32 hexadecimal digits."""
    return F.coalesce(F.md5(text.cast("binary")), F.md5(F.lit("\0null\0").cast("binary")))


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES


@dataclass
class Ranges:
    """Consecutive ranges of the order: prefix, sum of sizes, largest group, number of groups."""

    prefix: list[str]
    size: np.ndarray
    largest: np.ndarray
    groups: np.ndarray

    def __post_init__(self):
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        self.total = int(self.ends[-1])

    def step(self, at: int, capacity: int, inside: str) -> int:
        """End of a shard that starts at the byte ``at``, filled greedily.

        ``inside`` says where it may end inside a range of several groups: "no" for nowhere,
        "any" for at any byte, "low" for the lowest byte at which it can end in truth.
        """
        target = at + capacity
        if target >= self.total:
            return self.total
        i = int(np.searchsorted(self.ends, target, "right")) - 1
        if inside == "no" or self.groups[i] == 1:
            return max(at, int(self.ends[i]))
        if inside == "any":
            return target
        return max(at, int(self.ends[i]), target - int(self.largest[i]))

    def steps(self, capacity: int, shards: int, inside: str) -> list[int]:
        found, at = [], 0
        for _ in range(shards):
            at = self.step(at, capacity, inside)
            found.append(at)
        return found

    def smallest(self, shards: int, inside: str) -> int:
        """The smallest capacity that is enough, by binary search."""
        low = max(int(self.largest.max()), -(-self.total // shards))
        high = self.total
        while low < high:
            middle = (low + high) // 2
            if self.steps(middle, shards, inside)[-1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def doubtful(self, low: int, high: int, shards: int) -> list[int]:
        """Ranges of several groups in which a cut may fall for a capacity from low to high."""
        first = np.array(self.steps(low, shards, "low"))
        last = np.array(self.steps(high, shards, "any"))
        open_ = np.zeros(len(self.size), bool)
        for a, b in zip(first, last, strict=True):
            open_ |= (self.ends[:-1] < b + 1) & (self.ends[1:] > a - 1)
        return np.flatnonzero(open_ & (self.groups > 1)).tolist()

    def even_cuts(self, capacity: int, shards: int) -> list[str]:
        """Prefix at which each shard but the first starts; no shard is above the capacity."""
        latest = [self.total]
        for _ in range(shards - 1):  # the earliest start from which the rest still fits
            i = int(np.searchsorted(self.ends, latest[-1] - capacity, "left"))
            latest.append(int(self.ends[i]))
        latest.reverse()
        cuts, at = [], 0
        for k in range(1, shards):
            ideal = at + (self.total - at) / (shards - k + 1)
            allowed = np.flatnonzero((self.ends >= max(at, latest[k - 1])) & (self.ends <= at + capacity))
            i = int(allowed[np.argmin(np.abs(self.ends[allowed] - ideal))])
            at = int(self.ends[i])
            cuts.append(self.prefix[i] if i < len(self.prefix) else "g")  # "g" is above every digest
        return cuts


def _sums(groups: DataFrame, prefix: Column) -> dict[str, tuple[int, int, int]]:
    rows = groups.groupBy(prefix.alias("prefix")).agg(F.sum("size"), F.max("size"), F.count(F.lit(1))).collect()
    return {row[0]: (int(row[1]), int(row[2]), int(row[3])) for row in rows}


def _ranges(sums: dict[str, tuple[int, int, int]]) -> Ranges:
    prefix = sorted(sums)
    columns = [np.array([sums[p][k] for p in prefix], dtype=np.int64) for k in range(3)]
    return Ranges(prefix, *columns)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Smallest capacity, and the prefix at which each shard but the first starts.

    ``groups`` has one row per group: ``digest`` and ``size``.
    """
    sums = _sums(groups, F.substring("digest", 1, FIRST_PREFIX))
    if not sums:
        return 0, ["g"] * (shards - 1)
    while True:
        ranges = _ranges(sums)
        low, high = ranges.smallest(shards, "any"), ranges.smallest(shards, "no")
        open_ = [ranges.prefix[i] for i in ranges.doubtful(low, high, shards)] if low < high else []
        if not open_:
            return high, ranges.even_cuts(high, shards)
        by_length = {n: [p for p in open_ if len(p) == n] for n in {len(p) for p in open_}}
        inside = reduce(or_, [F.substring("digest", 1, n).isin(names) for n, names in by_length.items()])
        longer = F.coalesce(*[
            F.when(F.substring("digest", 1, n).isin(names), F.substring("digest", 1, min(DIGEST, n + MORE_PREFIX)))
            for n, names in by_length.items()
        ])
        finer = _sums(groups.filter(inside), longer)
        for prefix in open_:
            del sums[prefix]
        sums |= finer


def shard_of(digest: Column, cuts: list[str]) -> Column:
    return reduce(add, [(digest >= F.lit(cut)).cast("int") for cut in cuts], F.lit(0))


def text_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per group of equal texts: ``digest`` and the ``size`` of all its rows."""
    sized = docs.select(text_group(F.col(text)).alias("digest"), row_size(F.col(text)).alias("size"))
    return sized.groupBy("digest").agg(F.sum("size").alias("size"))


def sharded(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """The rows with their ``shard``, where they are; nothing but digests and sizes is shuffled."""
    _, cuts = minimax_cuts(stored(text_groups(docs, text)), shards)
    return docs.withColumn("shard", shard_of(text_group(F.col(text)), cuts))


def with_slots(rows: DataFrame, order: list[str], shards: int = SHARDS) -> DataFrame:
    """Number the rows of each shard from 0, without a gap.

    Rows are dealt to buckets by a hash of ``order``; the buckets of a shard follow each other, and
    rows are numbered inside them. There is a count per shard and bucket, so the list that is
    broadcast has at most ``shards * SLOT_BUCKETS`` entries.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(*order)
    numbered = rows.withColumn("_place", F.row_number().over(inside))
    return (
        numbered.join(F.broadcast(starts), ["shard", "_bucket"])
        .withColumn("slot", (F.col("_start") + F.col("_place") - 1).cast("bigint"))
        .drop("_bucket", "_place", "_start")
    )


def op8_sharded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    # Sizes and digests are written once; texts are read once.
    rows = stored(
        docs.select(
            "doc_id", row_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            text_group(text).alias("digest"),
        )
    )
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("size")))
    capacity, cuts = minimax_cuts(groups, SHARDS)
    placed = with_slots(rows.withColumn("shard", shard_of(F.col("digest"), cuts)), ["doc_id", "digest"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("bigint").alias("capacity"),
    )
