"""Keep costly expressions from being evaluated again by the filters above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that a later filter reads instead of recomputing.

    The optimiser moves a filter below a projection by copying the projected
    expressions into it, which repeats a page parse or a tokenisation per
    reference. It does not move filters below a generator, so the columns come
    out of a one-element one; the row count is unchanged and nothing shuffles.
    """
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.explode(F.array(made)).alias("_made")).select(
        *df.columns, *[F.col(f"_made.{name}").alias(name) for name in columns]
    )
