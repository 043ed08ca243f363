"""Building blocks that keep plans safe when a key is hot or a table is large."""

import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
ONE_TASK_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, readable by every executor."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
            folder = tempfile.mkdtemp(prefix="labelsense-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(table: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back, so it is not computed again.

    Cuts the lineage as a checkpoint does, and later reads take only the columns they need.
    """
    path = f"{shared_folder(table.sparkSession)}/table-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def measured(table: DataFrame) -> tuple[DataFrame, bool]:
    """The table, computed once, and whether it is small enough to broadcast."""
    kept = stored(table)
    if kept.count() > BROADCAST_ROWS:
        return kept, False
    size = kept.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return kept, size <= BROADCAST_BYTES


def pieces(spark: SparkSession) -> int:
    """Number of parts to divide hot keys into, over the whole table: some per shuffle partition."""
    return max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "inner",
    salt_on: list[str] | None = None,
    key_rows: str | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Join many rows with a table that has each key once.

    The table is broadcast when its measured size allows it, and then the rows do not move.
    Otherwise see ``split_join``. ``fits`` is given for a table that is measured already.
    """
    if fits is None:
        table, fits = measured(table)
    if fits:
        return rows.join(F.broadcast(table), on, how)
    return split_join(rows, table, on, how, salt_on, key_rows)


def split_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "inner",
    salt_on: list[str] | None = None,
    key_rows: str | None = None,
) -> DataFrame:
    """Shuffled join that divides the rows of hot keys over several tasks.

    A key is hot if it holds more than 1/p of all rows, with p = ``pieces``; so there are fewer
    than p hot keys, and their list can be broadcast whatever the data. A hot key with the share
    s of the rows is divided into ceil(s*p) parts, and its table row is copied to each.
    ``key_rows`` names a column of the table with the number of rows per key, if it has one. Rows
    with a null in their key match nothing; they are dealt to all parts, however many they are.
    """
    parts = pieces(rows.sparkSession)
    counts = (
        table.select(*on, F.col(key_rows).alias("_n"))
        if key_rows
        else rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    )
    total = counts.agg(F.sum("_n")).scalar()
    divided = F.ceil(F.col("_n") * parts / total).cast("int")
    hot = stored(counts.filter(F.col("_n") * parts > total).select(*on, divided.alias("_parts")))
    salt_on = salt_on or [c for c in rows.columns if c not in on] or on
    no_key = reduce(or_, [F.col(c).isNull() for c in on])
    salted_rows = rows.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*salt_on), F.when(no_key, parts).otherwise(F.coalesce("_parts", F.lit(1)))).cast("int")
    )
    salted_table = table.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    )
    return salted_rows.drop("_parts").join(salted_table.drop("_parts"), [*on, "_salt"], how).drop("_salt")


def running_totals(
    table: DataFrame,
    order: list[Column],
    totals: dict[str, Column | None],
    one_task_rows: int = ONE_TASK_ROWS,
) -> DataFrame:
    """Add, for each entry of ``totals``, the sum of its weight over all rows earlier in ``order``.

    A weight of None counts rows, so that the result is the place of the row, from 0. ``order``
    must be total. A table of more than ``one_task_rows`` rows is cut into ranges of the order;
    sums inside the ranges are shifted by the sums of the ranges before, so no task sees it all.
    """
    weights = {name: F.lit(1).cast("bigint") if w is None else w for name, w in totals.items()}
    kept = stored(table)

    def earlier(weight, window):
        total = F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(total, F.lit(0))

    if kept.count() <= one_task_rows:
        return kept.withColumns({name: earlier(w, Window.orderBy(*order)) for name, w in weights.items()})
    # Written out, so that every use sees the same ranges.
    ranged = stored(kept.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy("_range").agg(*[F.sum(w).alias(f"_sum_{name}") for name, w in weights.items()])
    starts = sums.select(  # one row per partition
        "_range", *[earlier(F.col(f"_sum_{name}"), Window.orderBy("_range")).alias(f"_start_{name}") for name in weights]
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumns({name: earlier(w, inside) for name, w in weights.items()})
        .join(F.broadcast(starts), "_range")
        .withColumns({name: F.col(name) + F.col(f"_start_{name}") for name in weights})
        .drop("_range", *[f"_start_{name}" for name in weights])
    )
