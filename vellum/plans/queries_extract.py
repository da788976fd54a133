"""Page to document fields, on pages rendered from ``documents`` and on raw ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import markup, payload
from vellum.functions.text import rfc3339_millis
from vellum.operators import extract
from vellum.plans import canonical
from vellum.plans.canonical import CAPTURES_SQL
from vellum.plans.registry import query
from vellum.sources.exports import to_document_json


def _scripts(spark, sf):
    pages = canonical.pages(spark, sf)
    return pages.select("ord", markup.scripts(markup.segments(F.col("html"))).alias("scripts"))


def _parsed(spark, sf):
    return extract.extract_documents(canonical.pages(spark, sf))


def _positions(found, column, name):
    """One row per element; the outer form keeps Spark from adding a filter that
    would extract the array a second time."""
    rows = found.select("ord", F.posexplode_outer(column).alias("pos", name)).where("pos IS NOT NULL")
    return rows.select("ord", name, F.col("pos").cast("bigint").alias("pos"))


@query(
    """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_extract(html, '<title>(.*?)</title>', 1, 's'),
      '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS title FROM pages"""
)
def page_title(spark, sf):
    return canonical.table(spark, sf, "pages").select(
        "page_id", markup.page_title(markup.segments(F.col("html"))).alias("title")
    )


@query(
    """SELECT page_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS bodies_md5
    FROM (SELECT page_id, regexp_extract_all(html, '<script>(.*?)</script>', 1, 's') AS s FROM pages)"""
)
def script_segments(spark, sf):
    bodies = canonical.table(spark, sf, "pages").select(
        "page_id", markup.scripts(markup.segments(F.col("html"))).alias("s")
    )
    return bodies.select(
        "page_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "\n")).alias("bodies_md5")
    )


@query(
    f"""WITH {CAPTURES_SQL} SELECT ord, og_title, 'About ' || id AS og_description,
    'https://img.example.com/' || id AS og_image, og_title || ' - Docs' AS page_title FROM captures"""
)
def og_fields(spark, sf):
    segs = canonical.pages(spark, sf).select("ord", markup.segments(F.col("html")).alias("s"))
    metas = segs.select("ord", markup.page_title(F.col("s")).alias("page_title"), markup.metas(F.col("s")).alias("m"))
    m = F.col("m")
    return metas.select(
        "ord",
        markup.og_field(m, "og:title").alias("og_title"),
        markup.og_field(m, "og:description").alias("og_description"),
        markup.og_field(m, "og:image").alias("og_image"),
        "page_title",
    )


@query(f"WITH {CAPTURES_SQL} SELECT ord, created FROM captures")
def extract_created(spark, sf):
    return _scripts(spark, sf).select(
        "ord", rfc3339_millis(payload.created_millis(F.col("scripts"))).alias("created")
    )


@query(f"WITH {CAPTURES_SQL} SELECT ord, ts AS server_time FROM captures")
def extract_server_time(spark, sf):
    return _scripts(spark, sf).select(
        "ord", rfc3339_millis(payload.server_time_millis(F.col("scripts"))).alias("server_time")
    )


@query("SELECT doc_id AS ord, md5(text) AS content_md5, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def extract_text(spark, sf):
    texts = _scripts(spark, sf).select("ord", payload.content(payload.snippets(F.col("scripts"))).alias("content"))
    return texts.select(
        "ord", F.md5("content").alias("content_md5"), F.length("content").cast("bigint").alias("n_chars")
    )


@query(f"WITH {CAPTURES_SQL} SELECT ord, unnest(links) AS link, unnest(range(len(links))) AS pos FROM captures")
def extract_links(spark, sf):
    found = _scripts(spark, sf).select("ord", payload.links(F.col("scripts")).alias("links"))
    return _positions(found, "links", "link")


@query(
    f"""WITH {CAPTURES_SQL} SELECT ord, unnest(image_urls || image_urls) AS image,
    unnest(range(2 * len(image_urls))) AS pos FROM captures"""
)
def extract_images(spark, sf):
    found = _scripts(spark, sf).select("ord", payload.image_urls(F.col("scripts")).alias("images"))
    return _positions(found, "images", "image")


@query(f"WITH {CAPTURES_SQL} SELECT ord, revision FROM captures")
def extract_revision(spark, sf):
    return _scripts(spark, sf).select("ord", payload.revision(F.col("scripts")).alias("revision"))


@query(f"WITH {CAPTURES_SQL} SELECT ord, id FROM captures")
def extract_embedded_id(spark, sf):
    return _scripts(spark, sf).select("ord", payload.embedded_id(F.col("scripts")).alias("id"))


@query(
    """SELECT CASE doc_id % 7 WHEN 1 THEN 'no_created' WHEN 2 THEN 'bad_created' WHEN 3 THEN 'no_timestamp'
      WHEN 4 THEN 'empty_document' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1"""
)
def parse_status_counts(spark, sf):
    parsed = extract.extract_documents(canonical.pages(spark, sf, parts=True))
    return parsed.groupBy(F.col("parse_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id AS ord, CASE doc_id % 7 WHEN 1 THEN 'no_created' WHEN 2 THEN 'bad_created'
      WHEN 3 THEN 'no_timestamp' ELSE 'empty_document' END AS status FROM documents WHERE doc_id % 7 BETWEEN 1 AND 4"""
)
def quarantined(spark, sf):
    _, bad = extract.split_quarantine(extract.extract_documents(canonical.pages(spark, sf, parts=True)))
    return bad.select("ord", F.col("parse_status").alias("status"))


@query(
    f"""WITH {CAPTURES_SQL} SELECT ord, 'given' AS id, 'folder' AS provenance, '2026-03-04T05:06:07Z' AS ts, 'ok' AS status
    FROM captures"""
)
def given_values_win(spark, sf):
    """Id, provenance and time set by the caller override the page."""
    pages = canonical.pages(spark, sf).withColumn("id", F.lit("given"))
    given = extract.with_timestamp(extract.with_provenance(pages, "folder"), "2026-03-04T05:06:07Z")
    parsed = extract.extract_documents(given)
    return parsed.select(
        "ord", "id", "provenance", F.col("timestamp").alias("ts"), F.col("parse_status").alias("status")
    )


@query(
    f"""WITH {CAPTURES_SQL} SELECT ord, '{{"id":"' || id || '","revision":' || revision || ',"provenance":"","timestamp":"' ||
      ts || '","page_title":' || CAST(to_json(og_title || ' - Docs') AS VARCHAR) || ',"og_title":' ||
      CAST(to_json(og_title) AS VARCHAR) || ',"og_description":"About ' || id || '","og_image":"https://img.example.com/' ||
      id || '","created":"' || left(created, 19) || '.535Z","content":' || CAST(to_json(content) AS VARCHAR) ||
      ',"links":["' || array_to_string(links, '","') || '"],"image_urls":["' ||
      array_to_string(image_urls || image_urls, '","') || '"]}}' AS document FROM captures"""
)
def document_json(spark, sf):
    """The twelve fields of every parsed document."""
    parsed = _parsed(spark, sf)
    return to_document_json(parsed, "ord").select("ord", F.col("value").alias("document"))
