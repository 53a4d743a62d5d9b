"""Values carried along the lines of long files, in two levels.

Lines are numbered, and ranges of `SPAN` numbers are scanned by tasks of their own; what ranges hand on to
those after them is one row each, over which a second window runs.  One file may so have any number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import stored

#: line numbers of a range
SPAN = 1 << 16


def _ranges(rows: DataFrame, at: str) -> DataFrame:
    return rows.withColumn("_range", F.floor(F.col(at) / SPAN))


def _handed_on(rows: DataFrame, key: str, ends: DataFrame) -> DataFrame:
    """Rows with the columns of `ends`, one row of which stands for each key and range."""
    ends = ends.withColumnsRenamed({key: "_key", "_range": "_at"})
    return rows.join(ends, F.col(key).eqNullSafe(F.col("_key")) & F.col("_range").eqNullSafe(F.col("_at"))).drop("_key", "_at")


def divided(rows: DataFrame, keys: list[str], most: int, buckets: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys that have no more than `most` rows, and all others; None where there are none.

    Rows are counted by a hash of their keys, in so many buckets; keys of a bucket beyond `most` are among the others.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    large = stored(rows.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("rows")).filter(F.col("rows") > most).select("_bucket"))
    if large.isEmpty():
        return rows, None
    named = rows.withColumn("_bucket", bucket)
    return tuple(named.join(large, "_bucket", how).drop("_bucket") for how in ("left_anti", "left_semi"))


def with_last(rows: DataFrame, key: str, at: str, value: Column, name: str, own: bool = True, short: bool = False) -> DataFrame:
    """Rows with the last value that isn't null up to theirs, or before it where `own` is false.

    `short` says that no key has more rows than a task may put in order; they are then dealt by key only.
    """
    if short:
        before = W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, 0 if own else -1)
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(before))
    rows = _ranges(rows, at).withColumn("_value", value)
    ends = rows.groupBy(key, "_range").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(at))).alias("_end"))
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    inside = W.partitionBy(key, "_range").orderBy(at).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    found = _handed_on(rows, key, ends).withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carried")))
    return found.drop("_range", "_value", "_carried")


def with_running(rows: DataFrame, key: str, at: str, value: Column, name: str) -> DataFrame:
    """Rows with the sum of a value up to theirs."""
    rows = _ranges(rows, at).withColumn("_value", value.cast("long"))
    sums = rows.groupBy(key, "_range").agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_carried", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = W.partitionBy(key, "_range").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    found = _handed_on(rows, key, sums).withColumn(name, F.col("_carried") + F.sum("_value").over(inside))
    return found.drop("_range", "_value", "_carried")
