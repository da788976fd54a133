"""From page HTML to one document row, with a status instead of a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import markup, payload
from vellum.functions.text import rfc3339_millis
from vellum.operators.once import computed_once

OK = "ok"

EXTRACTED = [
    "id",
    "revision",
    "provenance",
    "timestamp",
    "created",
    "page_title",
    "og_title",
    "og_description",
    "og_image",
    "content",
    "links",
    "image_urls",
    "parse_status",
]


def given(df: DataFrame, name: str) -> Column:
    """A caller's value, NULL where it is empty or the column is absent."""
    if name in df.columns:
        return F.nullif(F.col(name), F.lit(""))
    return F.lit(None).cast("string")


def with_provenance(df: DataFrame, value: str | Column) -> DataFrame:
    return df.withColumn("provenance", F.lit(value) if isinstance(value, str) else value)


def with_timestamp(df: DataFrame, value: str | Column) -> DataFrame:
    """Set the observation time; extraction then leaves it alone."""
    return df.withColumn("timestamp", F.lit(value) if isinstance(value, str) else value)


def extract_documents(df: DataFrame, html: str = "html") -> DataFrame:
    """Replace the page column by the fields of the document.

    Optional columns ``id``, ``provenance`` and ``timestamp`` are the caller's
    values and win over what the page says. Other columns pass through. The
    page is dropped in the first projection, scripts in the second.
    """
    carried = [c for c in df.columns if c not in (html, "id", "provenance", "timestamp")]
    cut = df.select(
        *carried,
        given(df, "id").alias("_id"),
        given(df, "provenance").alias("_provenance"),
        given(df, "timestamp").alias("_timestamp"),
        markup.segments(F.coalesce(F.col(html), F.lit(""))).alias("_segments"),
    )
    segs = F.col("_segments")
    parts = cut.select(
        *carried,
        "_id",
        "_provenance",
        "_timestamp",
        markup.page_title(segs).alias("page_title"),
        markup.metas(segs).alias("_metas"),
        markup.scripts(segs).alias("_scripts"),
    )
    meta, body = F.col("_metas"), F.col("_scripts")
    fields = parts.select(
        *carried,
        F.coalesce("_id", payload.embedded_id(body), F.lit("")).alias("id"),
        payload.revision(body).alias("revision"),
        F.coalesce("_provenance", F.lit("")).alias("provenance"),
        "_timestamp",
        payload.server_time_literal(body).alias("_server"),
        payload.created_literal(body).alias("_created"),
        "page_title",
        markup.og_fields(meta, "og:title", "og:description", "og:image").alias("_og"),
        payload.content(payload.snippets(body)).alias("content"),
        payload.links(body).alias("links"),
        payload.image_urls(body).alias("image_urls"),
    )
    timed = (
        fields.select(
            "*",
            F.col("_og")[0].alias("og_title"),
            F.col("_og")[1].alias("og_description"),
            F.col("_og")[2].alias("og_image"),
        )
        .withColumn("created", F.timestamp_millis(payload.epoch_millis(F.col("_created"))))
        .withColumn("_server_ms", payload.epoch_millis(F.col("_server")))
        .withColumn("timestamp", F.coalesce("_timestamp", rfc3339_millis(F.col("_server_ms")), F.lit("")))
    )
    return computed_once(timed, parse_status=parse_status()).select(*carried, *EXTRACTED)


def parse_status() -> Column:
    """First rule a document breaks, else ``ok``."""
    return (
        F.when(F.col("_created").isNotNull() & F.col("created").isNull(), "bad_created")
        .when(
            F.col("_timestamp").isNull() & F.col("_server").isNotNull() & F.col("_server_ms").isNull(),
            "bad_server_time",
        )
        .when(
            (F.col("content") == "")
            & (F.size("links") == 0)
            & (F.size("image_urls") == 0)
            & (F.col("og_title") == ""),
            "empty_document",
        )
        .when(F.col("created").isNull(), "no_created")
        .when(F.col("timestamp") == "", "no_timestamp")
        .otherwise(OK)
    )


def split_quarantine(df: DataFrame, status: str = "parse_status") -> tuple[DataFrame, DataFrame]:
    """Good rows and rows set aside with their reason."""
    good = F.coalesce(F.col(status), F.lit("unknown")) == OK
    return df.where(good), df.where(~good)


def content_digest(raw: Column) -> Column:
    """SHA-1 of the raw bytes in hex."""
    return F.sha1(raw)
