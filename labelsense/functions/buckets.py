"""Hash buckets that depend on the value alone, so a retried task gives the same answer."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bucket(key: Column | str, buckets: int, salt: str = "") -> Column:
    """Bucket 0..buckets-1 from the first 60 bits of the MD5 of the key."""
    column = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(column.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.lit(buckets)


def spread(keys: list, buckets: int) -> Column:
    """Cheap salt 0..buckets-1 used to split hot join keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def digest(column: Column | str) -> Column:
    """Short stand-in for a long text in a shuffle key."""
    return F.sha2(column, 256)
