"""One row per document revision, and the list of its observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import rfc3339_millis
from vellum.operators.skew import first_per, number_in_order, number_parts, order_bucket
from vellum.schemas import KEY, SCALARS

SOURCES_PER_PART = 10_000


def first_per_digest(df: DataFrame, order: str | Column = "ord") -> DataFrame:
    """First capture of every digest; call it on parsed captures only (A2)."""
    return first_per(df, ["digest"], [order])


def first_per_revision(df: DataFrame, order: str | Column = "ord") -> DataFrame:
    """First capture of every document revision (A3)."""
    return first_per(df, KEY, [order])


def store_spelling(captures: DataFrame) -> DataFrame:
    """``created`` as stored: RFC3339, UTC, whole seconds."""
    if dict(captures.dtypes)["created"] != "timestamp":
        return captures
    return captures.withColumn("created", rfc3339_millis(F.unix_millis("created")))


def new_documents(captures: DataFrame, existing: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Scalar columns of the revisions not stored yet; the first capture wins."""
    first = first_per_revision(captures.select(*KEY, *SCALARS, order), order).drop(order)
    return first if existing is None else first.join(existing.select(*KEY), KEY, "left_anti")


def observations(
    captures: DataFrame, documents: DataFrame, order: str = "ord", number: bool = False
) -> DataFrame:
    """One row per capture, titled as its document is titled in the store.

    Captures of one revision may dominate; adaptive execution splits them.
    With ``number`` any sortable order becomes consecutive numbers.
    """
    titles = documents.select(*KEY, "og_title", "og_description")
    seen = captures.select(
        *KEY, "src", F.col("provenance").alias("sid"), F.col("timestamp").alias("ts"), F.col(order).alias("ord")
    )
    if number:
        seen = number_in_order(seen, "ord")
    return seen.join(titles, KEY).select(*KEY, "og_title", "og_description", "src", "sid", "ts", "ord")


def nest_sources(
    seen: DataFrame, order: Sequence[str] = ("ord",), chunk: int = SOURCES_PER_PART
) -> DataFrame:
    """``sources`` arrays in order of arrival, repeats kept.

    A revision seen more than about ``chunk`` times continues in rows with a
    higher ``part``; every other revision has the single part 0.
    """
    order = list(order)
    bucketed = seen.withColumn("_bucket", order_bucket(order[-1]))
    numbered = number_parts(bucketed, KEY, [*order[:-1], "_bucket"], chunk)
    source = F.struct("src", F.col("sid").alias("id"), "ts")
    listed = numbered.groupBy(*KEY, "part").agg(
        F.array_sort(F.collect_list(F.struct(*order, source.alias("source")))).alias("_listed")
    )
    return listed.select(*KEY, "part", F.col("_listed.source").alias("sources"))


def fold_observations(
    captures: DataFrame, old: DataFrame | None = None, order: str = "ord", chunk: int = SOURCES_PER_PART
) -> DataFrame:
    """Captures folded into document revisions with their sources (A1).

    ``old`` holds earlier captures in the same shape: their scalars win and
    their sources come first. Scalars are on every part.
    """
    captures = store_spelling(captures)
    columns = [*KEY, *SCALARS, "src", "provenance", "timestamp", order]
    every = captures.select(F.lit(1).alias("_age"), *columns)
    if old is not None:
        every = store_spelling(old).select(F.lit(0).alias("_age"), *columns).unionByName(every)
    scalars = first_per(every.select("_age", *KEY, *SCALARS, order), KEY, ["_age", order])
    seen = every.select(
        "_age", *KEY, "src", F.col("provenance").alias("sid"), F.col("timestamp").alias("ts"), F.col(order).alias("ord")
    )
    listed = nest_sources(seen, ["_age", "ord"], chunk)
    return attach_sources(scalars.drop("_age", order), listed)


def attach_sources(documents: DataFrame, listed: DataFrame) -> DataFrame:
    """Every part of the sources with its document's scalars; (id, revision, part) is unique."""
    return listed.join(documents, KEY).select(*KEY, "part", *SCALARS, "sources")
