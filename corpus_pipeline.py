"""From raw documents to sharded training text: rules, near copies, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it has kept. The first
four give back the columns of ``docs``; the last adds ``shard``. Nulls, empty and long texts, equal
rows, empty tables and columns with the names of intermediate results are handled by the operators
as their modules say; a stage never adds or loses a column of ``docs``.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsense.llm import decontamination, mixing, ngram_join, quality_rules, sharding
from labelsense.operators.scale import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return quality_rules.kept_documents(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 or more of their five-word shingles: the smallest id."""
    return ngram_join.one_of_each(docs, ngram_join.Likeness(words=5, percent=80))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, or one with other numbers and names."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, in a random order."""
    names = [f"_in{i}" for i in range(len(docs.columns))]
    id_, source = (names[docs.columns.index(c)] for c in ("doc_id", "source"))
    mix = mixing.mixed(docs.toDF(*names), id_=id_, source=source)
    return mix.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a shard from 0 to 23, equal texts together and sizes as even as can be."""
    return sharding.sharded(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: Components of near copies and minimax cuts have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
