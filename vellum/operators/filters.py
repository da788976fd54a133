"""Capture filters and the reason a capture is skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vellum.functions.urls import DOCUMENT_PREFIX, document_id

CANDIDATE = "candidate"


def search_index(df: DataFrame, prefix: str = DOCUMENT_PREFIX, status: str = "200") -> DataFrame:
    """Captures below a URL prefix with one HTTP status; both reach the scan."""
    return df.where(F.col("url").startswith(prefix) & (F.col("status") == status))


def is_export(url: Column) -> Column:
    return F.contains(F.coalesce(url, F.lit("")), F.lit("/export"))


def is_published(url: Column) -> Column:
    return F.contains(F.coalesce(url, F.lit("")), F.lit("/pub"))


def exactly(value: Column, wanted: str) -> Column:
    """Equality in which a missing value is simply different."""
    return F.coalesce(value, F.lit("")) == wanted


def drop_export(df: DataFrame, url: str = "url") -> DataFrame:
    return df.where(~is_export(F.col(url)))


def drop_published(df: DataFrame, url: str = "url") -> DataFrame:
    return df.where(~is_published(F.col(url)))


def require_encoding(df: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    return df.where(exactly(F.col("encoding"), encoding))


def require_mime(df: DataFrame, mime: str = "text/html") -> DataFrame:
    return df.where(exactly(F.col("mime-detected"), mime))


def require_visibility(df: DataFrame, visibility: str = "public") -> DataFrame:
    return df.where(exactly(F.col("visibility"), visibility))


def with_document_id(df: DataFrame, url: str = "url") -> DataFrame:
    """Keep the captures whose URL names a document, with its id."""
    return df.withColumn("id", document_id(F.col(url))).where(F.col("id") != "")


def skip_processed(df: DataFrame, processed: DataFrame, digest: str = "digest") -> DataFrame:
    """Captures whose digest the store does not hold."""
    return df.join(processed.select(F.col("digest").alias(digest)), digest, "left_anti")


def classify_captures(
    df: DataFrame,
    origin: str,
    processed: DataFrame | None = None,
    digest: str = "digest",
) -> DataFrame:
    """Add ``id`` and ``status``: the first rule that skips a row, or candidate.

    Crawl rows: export, published, encoding, mime, processed, no_id.
    Scan rows: visibility, export, published, processed, no_id.
    """
    url = F.col("url")
    if processed is None:
        seen = df.withColumn("_seen", F.lit(False))
    else:
        marks = processed.select(F.col("digest").alias(digest)).distinct().withColumn("_mark", F.lit(True))
        seen = df.join(marks, digest, "left").withColumn("_seen", F.col("_mark").isNotNull())
    crawl = origin == "crawl"
    rules = F.when(F.lit(False), "")
    if not crawl:
        rules = rules.when(~exactly(F.col("visibility"), "public"), "visibility")
    rules = rules.when(is_export(url), "export").when(is_published(url), "published")
    if crawl:
        rules = rules.when(~exactly(F.col("encoding"), "UTF-8"), "encoding")
        rules = rules.when(~exactly(F.col("mime-detected"), "text/html"), "mime")
    rules = rules.when(F.col("_seen"), "processed").when(F.col("id") == "", "no_id").otherwise(CANDIDATE)
    return (
        seen.withColumn("id", document_id(url))
        .withColumn("status", rules)
        .select(*[c for c in df.columns if c != "id"], "id", "status")
    )


def run_counters(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows per status; the partial count leaves one row per status and task."""
    return df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))


SKIPPED = ["visibility", "export", "published", "encoding", "mime", "processed"]


#: What becomes of a capture, by the rules above.
REASONS = [*SKIPPED, "no_id", CANDIDATE]
OTHER = "other"


def observe_counters(df: DataFrame, observation: Observation, status: str = "status") -> DataFrame:
    """The same rows, counted by reason while whatever reads them runs.

    Nothing is computed for it: the tasks of that run add up the counts, and
    ``observed_counters`` gives them afterwards. Put it where every row passes,
    before filters and limits. A status outside ``REASONS`` counts as other.
    """
    value = F.coalesce(F.col(status), F.lit(OTHER))
    counts = [F.count_if(value == reason).alias(reason) for reason in REASONS]
    return df.observe(observation, *counts, F.count_if(~value.isin(REASONS)).alias(OTHER))


def observed_counters(spark: SparkSession, observation: Observation) -> DataFrame:
    """Rows per status as the run counted them; waits until the run is over."""
    counted = [(status, n) for status, n in observation.get.items() if n]
    return spark.createDataFrame(counted, "status string, n bigint")


def run_summary(df: DataFrame, status: str = "status", completed: str = "ok") -> DataFrame:
    """completed / errors / skipped in one row; an id-less URL counts as none of them."""
    value = F.col(status)
    skipped = value.isin(SKIPPED)
    done = value == completed
    return df.agg(
        F.count_if(done).alias("completed"),
        F.count_if(~done & ~skipped & (value != "no_id")).alias("errors"),
        F.count_if(skipped).alias("skipped"),
    )
