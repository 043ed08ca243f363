"""Mixing sources to target weights by Poisson replication.

A source with the weight w, the share w / sum(w) of the rows asked for and n rows has the mean
repetition rate share * rows / n. Each row draws its number of copies from the Poisson law of that
mean by inverting the law at a uniform number that is a hash of the seed and the row's id, so a
retried task draws the same. Rates above ``STEP`` are cut into equal parts with a draw each, as a
sum of Poisson numbers is Poisson again; the table of the law is then short for any rate.

Defined results: a null source is a source of its own; a null id draws as the text "null"; rows
with equal ids draw the same number; a source without a weight, or with weight 0, is left out;
texts play no part and may be null, empty or long; an empty table gives an empty table; other
columns are carried along, and columns that bear a result's name are replaced.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsense.operators.scale import lookup_join, stored

STEP = 8.0
#: Entries of the law's table; the chance of more than 64 at a mean of 8 is below 1e-30.
DEPTH = 64
BLOCK = 1 << 16
TEMPERATURE = 0.7
SEED = "mix-1"


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts."""
    cells = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cells)), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source.cast("string")))


def _cumulative(mean: Column) -> Column:
    """P(X <= k) of the Poisson law for k = 0 .. DEPTH."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(DEPTH)),
        F.struct(F.array(F.exp(-mean)).alias("sums"), F.exp(-mean).alias("p")),
        lambda s, k: F.struct(
            F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + s["p"] * mean / k)).alias("sums"),
            (s["p"] * mean / k).alias("p"),
        ),
        lambda s: s["sums"],
    )


def rates(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    rows: int | None = None,
    temperature: float = TEMPERATURE,
    source: str = "source",
) -> DataFrame:
    """Mean number of copies of each source's rows, as (_key, _n, rate).

    Without ``weights`` a source weighs its number of rows to the power ``temperature``. ``rows``
    is the expected size of the mix, that of the input if None.
    """
    spark = docs.sparkSession
    counts = stored(docs.groupBy(source_key(F.col(source)).alias("_key")).agg(F.count(F.lit(1)).alias("_n")))
    if weights is None:
        weighed = counts.withColumn("_weight", F.pow(F.col("_n").cast("double"), F.lit(temperature)))
    else:
        given = [("n" if k is None else f"s{k}", float(w)) for k, w in weights.items()]
        weighed = counts.join(spark.createDataFrame(given, "_key string, _weight double"), "_key")
    total = float(rows if rows is not None else counts.agg(F.sum("_n")).first()[0] or 0)
    weight = float(weighed.agg(F.sum("_weight")).first()[0] or 0)
    if weight <= 0:
        return weighed.select("_key", "_n", F.lit(0.0).alias("rate"))
    return weighed.select("_key", "_n", (F.col("_weight") / F.lit(weight) * F.lit(total) / F.col("_n")).alias("rate"))


def copies(docs: DataFrame, rate: DataFrame, seed: str, id_: str, source: str) -> DataFrame:
    """Each row as often as its draw says, with ``copy_no`` from 1 and the rate; not shuffled."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int")
    law = rate.filter(F.col("rate") > 0).withColumn("_parts", parts)
    law = law.withColumn("_law", _cumulative(F.col("rate") / F.col("_parts")))
    keyed = docs.withColumn("_key", source_key(F.col(source)))
    joined = lookup_join(keyed, law, ["_key"], "inner", salt_on=[id_], key_rows="_n")
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")),
        F.lit(0).cast("bigint"),
        lambda sum_, part: sum_
        + F.get(  # the number is hashed once per draw, not once per entry of the law
            F.transform(F.array(uniform(F.lit(seed), id_, part)), lambda u: F.size(F.filter("_law", lambda p: p <= u))), 0
        ),
    )
    blocks = joined.withColumn("_drawn", drawn).filter("_drawn > 0").drop("_law", "_parts", "_key", "_n")
    blocks = blocks.withColumn("_first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_drawn"), F.lit(BLOCK).cast("bigint"))))
    last = F.least(F.col("_drawn"), F.col("_first") + (BLOCK - 1))
    return blocks.withColumn("copy_no", F.explode(F.sequence(F.col("_first"), last))).drop("_first", "_drawn")


def mixed(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    rows: int | None = None,
    temperature: float = TEMPERATURE,
    seed: str = SEED,
    id_: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """The mix in a random order: the columns of ``docs``, ``copy_no``, ``rate`` and ``place``.

    ``place`` is a hash of id and copy; rows are dealt out by it and sorted by it in each part.
    """
    docs = docs.drop("copy_no", "rate", "place")
    out = copies(docs, rates(docs, weights, rows, temperature, source), seed, id_, source)
    cells = [F.lit(seed), F.coalesce(F.col(id_).cast("string"), F.lit("null")), F.col("copy_no").cast("string")]
    out = out.withColumn("place", F.md5(F.concat_ws("|", *cells, F.lit("place"))))
    return out.repartition("place").sortWithinPartitions("place")


def op4_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).withColumn("rate", F.round("rate", 6))


ORACLE = f"""WITH RECURSIVE counts AS (
  SELECT CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, count(*) AS n FROM documents GROUP BY 1),
sums AS (SELECT sum(n)::DOUBLE AS total, sum(pow(n::DOUBLE, {TEMPERATURE})) AS weight FROM counts),
rates AS (SELECT k, pow(n::DOUBLE, {TEMPERATURE}) / weight * total / n AS rate FROM counts, sums),
parts AS (SELECT k, rate, greatest(1, ceil(rate / {STEP}))::BIGINT AS parts FROM rates),
law AS (
  SELECT k, rate / parts AS mean, 0 AS i, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS total FROM parts
  UNION ALL
  SELECT k, mean, i + 1, p * mean / (i + 1), total + p * mean / (i + 1) FROM law WHERE i < {DEPTH}),
draws AS (
  SELECT d.doc_id, d.k, d.rate, d.part,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || part), 1, 13))::BIGINT
      / {float(1 << 52)!r} AS u
  FROM (SELECT DISTINCT doc_id, parts.k, rate, unnest(range(1, parts + 1)) AS part FROM documents
    JOIN parts ON parts.k = CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END) d),
drawn AS (
  SELECT doc_id, draws.k, any_value(rate) AS rate, count(*) FILTER (WHERE law.total <= u) AS n
  FROM draws JOIN law ON law.k = draws.k GROUP BY doc_id, draws.k)
SELECT documents.*, c.copy_no::BIGINT AS copy_no, round(c.rate, 6) AS rate,
  md5('{SEED}|' || coalesce(documents.doc_id::VARCHAR, 'null') || '|' || copy_no || '|place') AS place
FROM documents JOIN (SELECT *, unnest(range(1, n + 1)) AS copy_no FROM drawn) c
  ON c.doc_id IS NOT DISTINCT FROM documents.doc_id
  AND c.k = CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END"""
