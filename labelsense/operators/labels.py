"""Labels as numbers, and tables with the same number of rows per label."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelsense.functions.buckets import hash_bucket
from labelsense.operators.scale import lookup_join, running_totals, stored

#: Copies of a row that one task makes in one go.
BLOCK = 4096


def label_counts(df: DataFrame, *names: str) -> DataFrame:
    """Rows per value, over one column or several columns taken together."""
    values = stack_columns(df, *names).filter(F.col("value").isNotNull())
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("count"))


def stack_columns(df: DataFrame, *names: str) -> DataFrame:
    """All values of several columns under each other, in one pass over the table."""
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("value")) for n in names])
    return df.select(F.inline(pairs))


def label_index(df: DataFrame, *names: str) -> DataFrame:
    """(value, count, label): 0.0 is the most frequent value, ties by value.

    With several columns they share one index. Stays a table, for any number of values.
    """
    placed = running_totals(label_counts(df, *names), [F.desc("count"), F.asc("value")], {"label": None})
    return placed.withColumn("label", F.col("label").cast("double"))


def with_label(df: DataFrame, index: DataFrame, name: str, out: str = "label", keep_invalid: bool = True) -> DataFrame:
    """Look the index up for one column.

    Values that are not in the index get the next free number, or are dropped.
    """
    table = index.select(F.col("value").alias(name), F.col("label").alias(out))
    if not keep_invalid:
        return lookup_join(df, table, [name])
    unseen = index.agg(F.count(F.lit(1)).cast("double")).scalar()
    return lookup_join(df, table, [name], "left").withColumn(out, F.coalesce(F.col(out), unseen))


def balance(df: DataFrame, id_col: str, label: str, buckets: int = 4096, copy_col: str = "copy") -> DataFrame:
    """Repeat rows until every label has as many rows as the most frequent one.

    Row number n of a label (in the order of hash bucket and id) is repeated floor(max/c) times,
    and once more if n <= max mod c. Only ids are shuffled to find where the extra copies stop:
    per label that is one bucket and one id in it. A row that is repeated more often than
    ``BLOCK`` times is first divided into blocks, which are dealt out before they are repeated.
    """
    bucket = hash_bucket(id_col, buckets)
    ids = df.select(id_col, label, bucket.alias("_bucket")).filter(F.col(label).isNotNull())
    in_bucket = stored(ids.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_in_bucket")))
    totals = in_bucket.groupBy(label).agg(F.sum("_in_bucket").alias("_total"))
    target = totals.agg(F.max("_total")).scalar()
    plan = stored(
        totals.withColumn("_times", F.floor(target / F.col("_total")).cast("bigint")).withColumn(
            "_extra", target % F.col("_total")
        )
    )
    # One row per label and bucket, so a label has at most ``buckets`` rows here.
    w = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        in_bucket.withColumn("_before", F.coalesce(F.sum("_in_bucket").over(w), F.lit(0)))
        .join(plan, label)
        .filter((F.col("_before") < F.col("_extra")) & (F.col("_extra") <= F.col("_before") + F.col("_in_bucket")))
        .select(label, "_bucket", (F.col("_extra") - F.col("_before")).alias("_needed"))
    )
    place = F.row_number().over(Window.partitionBy(label).orderBy(id_col))
    edge = (
        lookup_join(ids, last, [label, "_bucket"], salt_on=[id_col])
        .withColumn("_place", place)
        .filter(F.col("_place") == F.col("_needed"))
        .select(label, F.col("_bucket").alias("_last_bucket"), F.col(id_col).alias("_last_id"))
    )
    copies = plan.select(label, "_times").join(edge, label, "left")
    early = bucket < F.col("_last_bucket")
    at_edge = (bucket == F.col("_last_bucket")) & (F.col(id_col) <= F.col("_last_id"))
    times = F.col("_times") + F.when(early | at_edge, 1).otherwise(0)
    one = F.lit(1).cast("bigint")
    told = lookup_join(df, copies, [label], salt_on=[id_col]).withColumn("_times", times).drop("_last_bucket", "_last_id")
    blocks = told.withColumn("_first", F.explode(F.sequence(one, F.col("_times"), F.lit(BLOCK).cast("bigint"))))
    far = blocks.filter(F.col("_times") > BLOCK).repartition(id_col, "_first")
    last = F.least(F.col("_times"), F.col("_first") + (BLOCK - 1))
    return (
        blocks.filter(F.col("_times") <= BLOCK)
        .unionByName(far)
        .withColumn(copy_col, F.explode(F.sequence(F.col("_first"), last)))
        .withColumn(copy_col, F.col(copy_col).cast("int"))
        .select(*df.columns, copy_col)
    )
