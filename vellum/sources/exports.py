"""JSON forms of query results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import rfc3339_millis


def explore_json(rows: DataFrame) -> DataFrame:
    """One JSON object per explore row."""
    return rows.select(
        F.to_json(
            F.struct("timestamp", "source", "id", "title", "snippet", F.col("revision").cast("string").alias("revision"))
        ).alias("value")
    )


def ndjson_lines(rows: DataFrame) -> DataFrame:
    """The rows as JSON, or the single line ``no data``."""
    lines = explore_json(rows)
    nothing = rows.limit(1).agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return lines.unionByName(nothing.select(F.lit("no data").alias("value")))


def export_ndjson(rows: DataFrame, path: str) -> None:
    """Text files with CRLF line ends."""
    ndjson_lines(rows).write.option("lineSep", "\r\n").text(path)


def document_page_json(pages: DataFrame) -> DataFrame:
    """One JSON object per document page row."""
    return pages.select("id", "continues", "part", F.to_json(F.struct("id", "last_seen", "instances")).alias("value"))


def export_document_pages(pages: DataFrame, path: str) -> None:
    document_page_json(pages).select("value").write.text(path)


def to_document_json(parsed: DataFrame, *carried: str) -> DataFrame:
    """A parsed document in its twelve fields, beside the named columns."""
    ms = F.unix_millis("created")
    fraction = F.regexp_replace(F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"), "0+$", "")
    whole = rfc3339_millis(ms)
    created = F.when(fraction == "", whole).otherwise(F.concat(F.rtrim(whole, F.lit("Z")), F.lit("."), fraction, F.lit("Z")))
    return parsed.select(
        *carried,
        F.to_json(
            F.struct(
                "id",
                "revision",
                "provenance",
                "timestamp",
                "page_title",
                "og_title",
                "og_description",
                "og_image",
                created.alias("created"),
                "content",
                "links",
                "image_urls",
            )
        ).alias("value")
    )
