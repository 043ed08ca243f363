"""From a raw review table to a clean one."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsense.functions.buckets import digest
from labelsense.operators.scale import lookup_join, running_totals


def lower_strings(df: DataFrame) -> DataFrame:
    """Lower-case every string column; leave the others."""
    return df.select(
        *[F.lower(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema]
    )


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def drop_missing(df: DataFrame, *names: str) -> DataFrame:
    return df.dropna(subset=list(names))


def mask_label(df: DataFrame, text: str, label: str, mask: str = "variety") -> DataFrame:
    """Replace every occurrence of the row's own label in its text."""
    masked = F.when(F.col(label) == "", F.col(text)).otherwise(F.replace(F.col(text), F.col(label), F.lit(mask)))
    return df.withColumn(text, F.when(F.col(label).isNull(), F.col(text)).otherwise(masked))


def drop_duplicates(df: DataFrame, subset: list[str], id_col: str) -> DataFrame:
    """Keep the row with the lowest id among rows equal on ``subset``.

    The lowest id is an aggregate, so copies are merged before the shuffle and a text with very
    many copies costs one row per task. Other columns are fetched by the id afterwards.
    """
    others = [c for c in df.columns if c not in (*subset, id_col)]
    if not others:
        return df.groupBy(*subset).agg(F.min(id_col).alias(id_col)).select(*df.columns)
    keys = [_short(df, c).alias(f"_k{i}") for i, c in enumerate(subset)]
    first = df.select(id_col, *keys).groupBy(*[f"_k{i}" for i in range(len(subset))]).agg(F.min(id_col).alias(id_col))
    return df.join(first.select(id_col), id_col, "left_semi")


def _short(df: DataFrame, name: str):
    return digest(name) if isinstance(df.schema[name].dataType, T.StringType) else F.col(name)


def common_labels(counts: DataFrame, label: str, threshold: float = 0.9, extra: int = 1) -> DataFrame:
    """Most frequent labels up to a share of all rows.

    ``counts`` has one row per label with its ``count``. The cut takes the fewest labels whose
    share is above ``threshold`` plus ``extra`` more; one more is the default.
    """
    order = [F.desc("count"), F.asc(label)]
    placed = running_totals(counts, order, {"rank": None, "_rows_before": F.col("count")})
    limit = placed.agg(F.sum("count")).scalar() * F.lit(threshold)
    needed = placed.filter(F.col("_rows_before") <= limit).agg(F.count(F.lit(1))).scalar()
    return placed.filter(F.col("rank") < needed + F.lit(extra)).select("rank", label, "count")


def keep_common_labels(
    df: DataFrame, label: str, counts: DataFrame | None = None, threshold: float = 0.9, extra: int = 1
) -> DataFrame:
    """Keep the rows whose label survives the coverage cut."""
    if counts is None:
        counts = df.filter(F.col(label).isNotNull()).groupBy(label).count()
    common = common_labels(counts, label, threshold, extra).select(label)
    return lookup_join(df, common, [label], "left_semi")


def clean_reviews(
    df: DataFrame, id_col: str, text: str, label: str, threshold: float = 0.9, extra: int = 1, mask: str = "variety"
) -> DataFrame:
    """Lower-case, drop missing labels and duplicates, mask the label, keep common labels.

    The label counts come from a narrow branch (text digest and label). The cut is then applied
    before the one shuffle that carries texts; it commutes with it, as the label is in the key.
    """
    rows = drop_missing(lower_strings(keep_columns(df, id_col, text, label)), label)
    counts = rows.select(label, digest(text).alias("_digest")).distinct().groupBy(label).count()
    kept = keep_common_labels(rows, label, counts, threshold, extra)
    return mask_label(drop_duplicates(kept, [text, label], id_col), text, label, mask).select(id_col, text, label)
