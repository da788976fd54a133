"""The shared inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import rfc3339_seconds
from vellum.operators.fold import first_per_digest, new_documents, observations
from vellum.plans import render

START = 1767225600  # 2026-01-01T00:00:00Z
CREATED_MS = 1741964966535


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def captures(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed captures from ``documents``: three captures per revision, two revisions per document."""
    n = F.col("doc_id")
    number = F.expr("doc_id div 6")
    first = F.concat(F.lit("https://host"), (n % 7).cast("string"), F.lit(".example.com/p"), (n % 11).cast("string"))
    second = F.concat(F.lit("https://code.example.org/r"), (n % 13).cast("string"))
    kind = F.expr("(doc_id div 2) % 3")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("D"), F.lpad(number.cast("string"), 8, "0")).alias("id"),
        (n % 2).alias("revision"),
        rfc3339_seconds(F.floor((CREATED_MS + number * 1000) / 1000)).alias("created"),
        F.substring_index("text", "\n", 1).alias("page_title"),
        F.substring_index("text", "\n", 1).alias("og_title"),
        F.concat(F.lit("About "), F.col("source")).alias("og_description"),
        F.concat(F.lit("https://img.example.com/"), n.cast("string")).alias("og_image"),
        F.col("text").alias("content"),
        F.array(first, second).alias("links"),
        F.array(F.concat(F.lit("https://img.example.com/b"), (n % 5).cast("string"))).alias("image_urls"),
        F.when(kind == 0, "commoncrawl").when(kind == 1, "urlscan").otherwise("manual").alias("src"),
        F.concat(F.lit("S"), n.cast("string")).alias("provenance"),
        rfc3339_seconds(START + F.expr("doc_id div 4") * 37).alias("timestamp"),
        F.md5("text").alias("digest"),
        F.lit("").alias("url"),
        F.lit("ok").alias("parse_status"),
        n.alias("ord"),
    )


def halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Earlier and later rows, cut at the middle order number, a scalar subquery."""
    middle = rows.agg(F.floor((F.min("ord") + F.max("ord")) / 2)).scalar()
    return rows.where(F.col("ord") <= middle), rows.where(F.col("ord") > middle)


def unique_captures(spark: SparkSession, sf: str) -> DataFrame:
    return first_per_digest(captures(spark, sf))


def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    return new_documents(unique_captures(spark, sf))


def stored_observations(spark: SparkSession, sf: str) -> DataFrame:
    unique = unique_captures(spark, sf)
    return observations(unique, new_documents(unique))


def pages(spark: SparkSession, sf: str, parts: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """``documents`` as document pages; with ``parts`` some pages lack something."""
    n = F.col("ord")
    ms = CREATED_MS + F.floor(n / 6) * 1000
    good = render.e_notation(ms)
    case = n % 7
    columns = dict(
        has_body=case != 4, has_created=case != 1, has_server=case != 3
    ) if parts else {}
    created = F.when(case == 2, F.lit("1.7E+12")).otherwise(good) if parts else good
    html = render.page(
        F.col("id"),
        F.col("revision"),
        F.col("page_title"),
        F.col("content"),
        F.concat("links", F.slice("links", 1, 1)),
        F.concat("image_urls", "image_urls"),
        created,
        (START + F.expr("ord div 4") * 37) * 1000 + 999,
        **columns,
    )
    return captures(spark, sf).select("ord", html.alias("html"), *also)


def crawl_index(spark: SparkSession, sf: str) -> DataFrame:
    """``pages`` as crawl-index records whose URL names a document."""
    n = F.col("page_id")
    ending = (
        F.when(n % 5 == 0, "/edit")
        .when(n % 5 == 1, "/export?format=pdf")
        .when(n % 5 == 2, "/pub")
        .when(n % 5 == 3, "")
        .otherwise("/preview")
    )
    return table(spark, sf, "pages").select(
        n.alias("page_id"),
        F.when(n % 9 == 0, F.col("url"))
        .otherwise(F.concat(F.lit("https://docs.google.com/document/d/P"), n.cast("string"), ending))
        .alias("url"),
        F.when(n % 8 == 0, "404").otherwise("200").alias("status"),
        F.when(n % 6 == 0, "application/pdf").otherwise("text/html").alias("mime-detected"),
        F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, "ISO-8859-1").otherwise("UTF-8").alias("encoding"),
        F.md5("html").alias("digest"),
        F.lit("a.warc.gz").alias("filename"),
        (n * 1000).cast("string").alias("offset"),
        F.lit("1000").alias("length"),
    )


def document_index(spark: SparkSession, sf: str) -> DataFrame:
    """Two index records of every document: one to fetch, and one that a filter drops."""
    n = F.col("doc_id")
    base = F.concat(F.lit("https://docs.google.com/document/d/P"), n.cast("string"))
    good = F.struct(F.concat(base, F.lit("/edit")).alias("url"), F.lit("200").alias("status"), F.lit("UTF-8").alias("encoding"))
    bad = F.struct(
        F.concat(base, F.when(n % 3 == 0, "/export?format=pdf").when(n % 3 == 1, "/pub").otherwise("/edit")).alias("url"),
        F.when(n % 2 == 0, "200").otherwise("404").alias("status"),
        F.when(n % 3 == 2, "ISO-8859-1").otherwise("UTF-8").alias("encoding"),
    )
    return table(spark, sf, "documents").select(n, F.explode(F.array(good, bad)).alias("r")).select(
        "doc_id",
        "r.*",
        F.lit("text/html").alias("mime-detected"),
        F.md5(n.cast("string")).alias("digest"),
    )


def document_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Scan results of every document as JSON lines: its own, one that a filter drops, and for
    every tenth one without a saved page."""
    n = F.col("doc_id")
    kinds = F.array(F.lit("s"), F.lit("x"), F.when(n % 10 == 0, "m"))
    rows = table(spark, sf, "documents").select(n, F.explode(kinds).alias("kind")).where("kind is not null")
    sid = F.concat("kind", n.cast("string"))
    ms = (START + n) * 1000
    return rows.select(
        F.concat(
            F.lit('{"_id":"'),
            sid,
            F.lit('","task":{"time":"'),
            rfc3339_seconds(START + n),
            F.lit('","visibility":"'),
            F.when((F.col("kind") == "x") & (n % 2 == 0), "private").otherwise("public"),
            F.lit('"},"page":{"url":"https://docs.google.com/document/d/U'),
            n.cast("string"),
            F.when((F.col("kind") == "x") & (n % 2 == 1), "/pub").otherwise("/edit"),
            F.lit('"},"sort":['),
            ms.cast("string"),
            F.lit(',"'),
            sid,
            F.lit('"]}'),
        ).alias("value")
    )


def document_doms(spark: SparkSession, sf: str) -> DataFrame:
    """The page of every document under the id of its own scan."""
    return pages(spark, sf).select(F.concat(F.lit("s"), F.col("ord").cast("string")).alias("id"), "html")


def scan_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as JSON lines of scan results."""
    n = F.col("event_id")
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    seconds = F.rtrim(rfc3339_seconds(F.floor(ms / 1000)), F.lit("Z"))
    time = F.concat(seconds, F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"), F.lit("Z"))
    ending = F.when(n % 3 == 0, "/edit").when(n % 3 == 1, "/pub").otherwise("")
    return table(spark, sf, "events").select(
        F.concat(
            F.lit('{"_id":"'),
            n.cast("string"),
            F.lit('","task":{"time":"'),
            time,
            F.lit('","visibility":"'),
            F.when(F.col("event_type") == "error", "private").otherwise("public"),
            F.lit('"},"page":{"url":"https://docs.google.com/document/d/U'),
            F.col("user_id").cast("string"),
            ending,
            F.lit('"},"sort":['),
            ms.cast("string"),
            F.lit(',"'),
            n.cast("string"),
            F.lit('"]}'),
        ).alias("value")
    )


# ---------------------------------------------------------------- the same in SQL

CAPTURES_SQL = """
captures AS (
  SELECT doc_id AS ord,
    'D' || lpad(CAST(doc_id // 6 AS VARCHAR), 8, '0') AS id,
    doc_id % 2 AS revision,
    strftime(TIMESTAMP '2025-03-14 15:09:26' + to_seconds(doc_id // 6), '%Y-%m-%dT%H:%M:%SZ') AS created,
    split_part(text, chr(10), 1) AS og_title,
    'About ' || source AS og_description,
    text AS content,
    ['https://host' || doc_id % 7 || '.example.com/p' || doc_id % 11,
     'https://code.example.org/r' || doc_id % 13] AS links,
    ['https://img.example.com/b' || doc_id % 5] AS image_urls,
    CASE (doc_id // 2) % 3 WHEN 0 THEN 'commoncrawl' WHEN 1 THEN 'urlscan' ELSE 'manual' END AS src,
    'S' || doc_id AS sid,
    strftime(TIMESTAMP '2026-01-01' + to_seconds((doc_id // 4) * 37), '%Y-%m-%dT%H:%M:%SZ') AS ts,
    md5(text) AS digest
  FROM documents)"""

UNIQUE_SQL = CAPTURES_SQL + """,
uniq AS (
  SELECT * FROM captures QUALIFY row_number() OVER (PARTITION BY digest ORDER BY ord) = 1),
docs AS (
  SELECT * FROM uniq QUALIFY row_number() OVER (PARTITION BY id, revision ORDER BY ord) = 1),
seen AS (
  SELECT u.id, u.revision, d.og_title, d.og_description, u.src, u.sid, u.ts, u.ord
  FROM uniq u JOIN docs d ON u.id = d.id AND u.revision = d.revision)"""

INDEX_SQL = """
cap AS (
  SELECT page_id,
    CASE WHEN page_id % 9 = 0 THEN url ELSE 'https://docs.google.com/document/d/P' || page_id ||
      CASE page_id % 5 WHEN 0 THEN '/edit' WHEN 1 THEN '/export?format=pdf' WHEN 2 THEN '/pub'
        WHEN 3 THEN '' ELSE '/preview' END END AS url,
    CASE WHEN page_id % 8 = 0 THEN '404' ELSE '200' END AS status,
    CASE WHEN page_id % 6 = 0 THEN 'application/pdf' ELSE 'text/html' END AS mime,
    CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding,
    md5(html) AS digest
  FROM pages)"""

SCANS_SQL = """
scans AS (
  SELECT CAST(event_id AS VARCHAR) AS scan_id,
    strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS scan_time,
    epoch_us(ts) // 1000 AS sort_ts,
    CASE WHEN event_type = 'error' THEN 'private' ELSE 'public' END AS visibility,
    'https://docs.google.com/document/d/U' || user_id ||
      CASE event_id % 3 WHEN 0 THEN '/edit' WHEN 1 THEN '/pub' ELSE '' END AS url
  FROM events)"""
