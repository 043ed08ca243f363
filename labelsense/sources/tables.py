"""Reading and writing review tables, word sets and metrics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsense.sources import csv_blocks

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("country", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("designation", T.StringType()),
        T.StructField("points", T.IntegerType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("province", T.StringType()),
        T.StructField("region_1", T.StringType()),
        T.StructField("region_2", T.StringType()),
        T.StructField("taster_name", T.StringType()),
        T.StructField("taster_twitter_handle", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("variety", T.StringType()),
        T.StructField("winery", T.StringType()),
    ]
)


def read_reviews_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = REVIEW_SCHEMA, line_breaks: bool = True
) -> DataFrame:
    """CSV with a header. ``schema=None`` infers the types.

    Quoted fields may hold line breaks; with a schema, a file is read by many tasks all the same, see
    ``csv_blocks``, and to infer one it is read by one task. Without ``line_breaks`` Spark divides a
    file at every line end; that is only for files whose fields are known to hold none.
    """
    if schema is not None and line_breaks:
        return csv_blocks.read_csv(spark, path, schema)
    return read_whole_csv(spark, path, schema, line_breaks)


def read_whole_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = REVIEW_SCHEMA, line_breaks: bool = True
) -> DataFrame:
    """CSV with a header, by Spark's reader; with ``line_breaks`` each file is read by one task."""
    reader = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"')
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def write_reviews_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; every text is quoted and quotes are doubled, so that it is read back as it was."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def evened(df: DataFrame) -> DataFrame:
    """Deal the rows out if the scan has fewer parts than the cluster has cores.

    For CPU-heavy work on text: a file of one row group would keep a single core busy. A table
    with more parts than cores, so any large one, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_table(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def write_word_set(words: DataFrame, strategy: str, path: str) -> None:
    """Store an ordered word set (rank, word) as JSON under the name of its strategy."""
    words.select(F.col("rank").cast("bigint"), "word").write.mode("overwrite").json(f"{path}/strategy={strategy}")


def read_word_set(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    """Stored word sets as (strategy, rank, word); one strategy, or all of them."""
    stored = spark.read.schema("strategy string, rank bigint, word string").json(path)
    if strategy is not None:
        stored = stored.filter(F.col("strategy") == strategy)
    return stored.select("strategy", "rank", "word")


def word_list(words: DataFrame, limit: int) -> list[str]:
    """The first ``limit`` words of a set, in order, for use as a stage parameter."""
    first = words.filter(F.col("rank") < limit).orderBy("rank").select("word")
    return [row.word for row in first.collect()]
