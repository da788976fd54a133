"""Groups and orders that stay balanced when one key holds a large share of the rows.

Joins need no help here: adaptive execution splits a partition that one key
fills, and no job has to run while a plan is being built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of every key in the given order.

    Ranking with ``= 1`` lets Spark keep one row per key in every task before
    the shuffle, so a key with many copies never meets in one task.
    """
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(spec)).where("_rank = 1").drop("_rank")


def number_in_order(df: DataFrame, order: str) -> DataFrame:
    """Replace any sortable column by consecutive numbers in its order.

    Ranges of the order are numbered side by side; numbers leave a gap only
    between two ranges. Keep the rows narrow, and write the result before it is
    used more than once.
    """
    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    return ranged.withColumn(order, F.monotonically_increasing_id())


# rows of one key and bucket, at most: buckets cover this many consecutive order numbers
BUCKET_BITS = 12


def order_bucket(order: str) -> Column:
    return F.shiftright(F.col(order), BUCKET_BITS)


def number_parts(
    df: DataFrame, keys: Sequence[str], bucket: Sequence[str], chunk: int, weight: Column | None = None
) -> DataFrame:
    """Add ``part``: consecutive pieces of each key of about ``chunk`` rows.

    ``bucket`` columns sort like the row order, and few rows of a key share one
    (``2 ** BUCKET_BITS`` for a bucketed order number). A part holds less than
    ``chunk`` and one more bucket, whatever the key holds. Only the weights of
    the buckets go through the running sum; a key that fits has part 0 alone.
    """
    keys, bucket = list(keys), list(bucket)
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*keys, *bucket).agg(total.alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select(
        *keys,
        *bucket,
        F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / chunk).cast("int").alias("part"),
    )
    return df.join(parts, [*keys, *bucket])
