"""Sources, filters and skip reasons."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from vellum.functions.text import link_tokens
from vellum.functions.urls import document_id, source_url
from vellum.operators import extract, filters
from vellum.plans import canonical, render
from vellum.plans.canonical import INDEX_SQL, SCANS_SQL
from vellum.plans.registry import query
from vellum.session import scratch_path
from vellum.sources import archive, crawl, folder, scans

_INDEX_COLUMNS = "page_id, url, status, mime, encoding, digest"


def _index_rows(df):
    return df.select("page_id", "url", "status", F.col("mime-detected").alias("mime"), "encoding", "digest")


@query(
    f"""WITH {INDEX_SQL}
    SELECT CAST(page_id * 1000 AS BIGINT) AS "offset", url, status, mime, encoding, digest, 0 AS bad FROM cap
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 1 FROM cap WHERE page_id % 10 = 0"""
)
def index_scan(spark, sf):
    """JSON lines, every tenth row followed by a broken one."""
    index = canonical.crawl_index(spark, sf)
    line = F.to_json(F.struct(*[c for c in index.columns if c != "page_id"]))
    broken = F.when(F.col("page_id") % 10 == 0, F.array(line, F.lit('{"url": "cut'))).otherwise(F.array(line))
    path = scratch_path(spark, "index")
    index.select(F.explode(broken).alias("value")).write.text(path)
    rows = crawl.byte_range(crawl.read_crawl_index(spark, path))
    return rows.select(
        "offset",
        "url",
        "status",
        F.col("mime-detected").alias("mime"),
        "encoding",
        "digest",
        F.col("bad_line").isNotNull().cast("int").alias("bad"),
    )


@query(
    f"""WITH {INDEX_SQL} SELECT {_INDEX_COLUMNS} FROM cap
    WHERE starts_with(url, 'https://docs.google.com/document/d/') AND status = '200'"""
)
def index_search(spark, sf):
    return _index_rows(filters.search_index(canonical.crawl_index(spark, sf)))


@query(
    f"""WITH {INDEX_SQL} SELECT {_INDEX_COLUMNS} FROM cap
    WHERE NOT contains(url, '/export') AND NOT contains(url, '/pub')"""
)
def filter_export_pub(spark, sf):
    return _index_rows(filters.drop_published(filters.drop_export(canonical.crawl_index(spark, sf))))


@query(f"WITH {INDEX_SQL} SELECT {_INDEX_COLUMNS} FROM cap WHERE encoding = 'UTF-8'")
def filter_encoding(spark, sf):
    return _index_rows(filters.require_encoding(canonical.crawl_index(spark, sf)))


@query(f"WITH {INDEX_SQL} SELECT {_INDEX_COLUMNS} FROM cap WHERE mime = 'text/html'")
def filter_mime(spark, sf):
    return _index_rows(filters.require_mime(canonical.crawl_index(spark, sf)))


def _scans(spark, sf):
    return scans.parse_scan_lines(canonical.scan_lines(spark, sf))


def _scan_rows(df):
    return df.select("scan_id", "scan_time", F.col("sort_key.ts").alias("sort_ts"), "visibility", "url")


@query(f"WITH {SCANS_SQL} SELECT scan_id, scan_time, sort_ts, visibility, url FROM scans")
def scan_read(spark, sf):
    """Nested scan results read back from JSON files."""
    path = scratch_path(spark, "scans")
    canonical.scan_lines(spark, sf).write.text(path)
    return _scan_rows(scans.read_scans(spark, path))


@query(f"WITH {SCANS_SQL} SELECT scan_id, scan_time, sort_ts, visibility, url FROM scans")
def scan_read_pages(spark, sf):
    """The same wrapped in pages of results, one page per user."""
    lines = canonical.scan_lines(spark, sf)
    bounded = lines.withColumn("_page", F.floor(F.get_json_object("value", "$._id").cast("bigint") / 100))
    envelope = bounded.groupBy("_page").agg(F.array_join(F.collect_list("value"), ",").alias("items"))
    pages = envelope.select(
        F.concat(F.lit('{"results":['), "items", F.lit('],"total":1,"has_more":true}')).alias("value")
    )
    return _scan_rows(scans.parse_scan_lines(pages, envelope=True))


@query(f"WITH {SCANS_SQL} SELECT scan_id, scan_time, sort_ts, visibility, url FROM scans WHERE visibility = 'public'")
def filter_visibility(spark, sf):
    return _scan_rows(filters.require_visibility(_scans(spark, sf)))


@query(
    f"""WITH {INDEX_SQL} SELECT page_id, regexp_extract(url, 'docs\\.google\\.com/document/d/(.+?)/', 1) AS id FROM cap"""
)
def url_doc_id(spark, sf):
    return canonical.crawl_index(spark, sf).select("page_id", document_id(F.col("url")).alias("id"))


_SEEN_DIGESTS = "SELECT md5(html) AS digest FROM pages WHERE page_id % 2 = 0"


def _processed(spark, sf):
    """Digests of every second page, as an earlier run would have left them."""
    return canonical.table(spark, sf, "pages").where("page_id % 2 = 0").select(F.md5("html").alias("digest"))


_STATUS_SQL = f"""WITH {INDEX_SQL}, known AS ({_SEEN_DIGESTS}), judged AS (
  SELECT page_id, CASE
    WHEN contains(url, '/export') THEN 'export' WHEN contains(url, '/pub') THEN 'published'
    WHEN coalesce(encoding, '') <> 'UTF-8' THEN 'encoding' WHEN mime <> 'text/html' THEN 'mime'
    WHEN digest IN (SELECT digest FROM known) THEN 'processed'
    WHEN regexp_extract(url, 'docs\\.google\\.com/document/d/(.+?)/', 1) = '' THEN 'no_id'
    ELSE 'candidate' END AS status
  FROM cap)"""


@query(_STATUS_SQL + " SELECT page_id, status FROM judged")
def skip_reasons(spark, sf):
    index = canonical.crawl_index(spark, sf)
    judged = filters.classify_captures(index, "crawl", _processed(spark, sf))
    return judged.select("page_id", "status")


@query(_STATUS_SQL + " SELECT status, count(*) AS n FROM judged GROUP BY status")
def skip_reason_counts(spark, sf):
    return filters.run_counters(skip_reasons(spark, sf))


@query(_STATUS_SQL + " SELECT status, count(*) AS n FROM judged GROUP BY status")
def skip_reasons_observed(spark, sf):
    """Counted in flight, while the candidates are written; no second pass over the captures."""
    observation = Observation()
    judged = filters.observe_counters(skip_reasons(spark, sf), observation)
    judged.where(F.col("status") == filters.CANDIDATE).write.parquet(scratch_path(spark, "candidates"))
    return filters.observed_counters(spark, observation)


@query(
    _STATUS_SQL
    + """ SELECT count(*) FILTER (status = 'candidate') AS completed, CAST(0 AS BIGINT) AS errors,
    count(*) FILTER (status NOT IN ('candidate', 'no_id')) AS skipped FROM judged"""
)
def run_summary(spark, sf):
    return filters.run_summary(skip_reasons(spark, sf), completed=filters.CANDIDATE)


@query(
    f"""WITH {SCANS_SQL} SELECT status, count(*) AS n FROM (SELECT CASE
      WHEN visibility <> 'public' THEN 'visibility' WHEN contains(url, '/export') THEN 'export'
      WHEN contains(url, '/pub') THEN 'published' WHEN CAST(scan_id AS BIGINT) % 5 = 0 THEN 'processed'
      WHEN regexp_extract(url, 'docs\\.google\\.com/document/d/(.+?)/', 1) = '' THEN 'no_id'
      ELSE 'candidate' END AS status FROM scans) GROUP BY status"""
)
def scan_skip_reason_counts(spark, sf):
    events = canonical.table(spark, sf, "events")
    known = events.where("event_id % 5 = 0").select(F.col("event_id").cast("string").alias("digest"))
    rows = filters.classify_captures(_scans(spark, sf), "scan", known, digest="scan_id")
    return filters.run_counters(rows)


@query(f"WITH {INDEX_SQL} SELECT {_INDEX_COLUMNS} FROM cap c WHERE NOT EXISTS (SELECT 1 FROM ({_SEEN_DIGESTS}) k WHERE k.digest = c.digest)")
def anti_processed(spark, sf):
    index = canonical.crawl_index(spark, sf)
    return _index_rows(filters.skip_processed(index, _processed(spark, sf)))


@query("SELECT page_id, sha1(html) AS digest FROM pages")
def content_digest(spark, sf):
    return canonical.table(spark, sf, "pages").select(
        "page_id", extract.content_digest(F.encode("html", "UTF-8")).alias("digest")
    )


@query(
    f"""WITH {canonical.UNIQUE_SQL} SELECT id, revision, ord, CASE src
      WHEN 'urlscan' THEN 'https://urlscan.io/result/' || sid
      WHEN 'commoncrawl' THEN 'https://index.commoncrawl.org/' || sid ||
        '-index?url=https://docs.google.com/document/d/' || id || '*&filter==status:200' END AS url FROM seen"""
)
def source_links(spark, sf):
    seen = canonical.stored_observations(spark, sf)
    return seen.select("id", "revision", "ord", source_url(F.col("src"), F.col("sid"), F.col("id")).alias("url"))


@query(
    f"""WITH {SCANS_SQL} SELECT scan_id, md5(html) AS html_md5 FROM scans
    JOIN pages ON CAST(scan_id AS BIGINT) % (SELECT count(*) FROM pages) = page_id"""
)
def scan_dom_join(spark, sf):
    """Every scan meets a page; pages are dealt out in turn."""
    pages = canonical.table(spark, sf, "pages")
    number = pages.agg(F.count(F.lit(1))).scalar()
    events = canonical.table(spark, sf, "events")
    doms = events.select(F.col("event_id").cast("string").alias("id"), (F.col("event_id") % number).alias("page_id"))
    joined = scans.join_dom(_scans(spark, sf), doms, bodies=pages)
    return joined.select("scan_id", F.md5("html").alias("html_md5"))


@query(
    f"""WITH {SCANS_SQL} SELECT scan_id, url FROM scans
    WHERE scan_id NOT IN (SELECT CAST(page_id AS VARCHAR) FROM pages)"""
)
def scan_dom_missing(spark, sf):
    return scans.missing_dom(_scans(spark, sf), _doms(spark, sf)).select("scan_id", "url")


def _doms(spark, sf):
    return canonical.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), "html")


@query(f"WITH {SCANS_SQL} SELECT scan_id, scan_time, sort_ts, visibility, url FROM scans WHERE sort_ts > 1704700000000")
def scan_since(spark, sf):
    return _scan_rows(scans.collect_since(_scans(spark, sf), "1704700000000"))


@query(
    f"""WITH {SCANS_SQL} SELECT scan_id, scan_time, sort_ts, visibility, url FROM scans
    WHERE (sort_ts, scan_id) < (1705000000000, '5') ORDER BY sort_ts DESC, scan_id DESC LIMIT 100"""
)
def scan_after_page(spark, sf):
    from vellum.operators.explore import search_after

    return _scan_rows(search_after(_scans(spark, sf), (1705000000000, "5")))


_RANKED_SQL = f"""WITH {SCANS_SQL}, ranked AS (
    SELECT scan_id, sort_ts, row_number() OVER (ORDER BY sort_ts DESC, scan_id DESC) - 1 AS rank FROM scans)"""


@query(_RANKED_SQL + " SELECT scan_id, rank // 100 AS page, rank % 100 AS place FROM ranked")
def scan_pages(spark, sf):
    """The whole walk, every scan with its page."""
    from vellum.operators.explore import scan_pages as walk

    return walk(_scans(spark, sf)).select("scan_id", "page", "place")


@query(
    _RANKED_SQL
    + """ SELECT rank // 100 AS page, count(*) AS rows, CASE WHEN count(*) = 100 THEN arg_max(sort_ts, rank) END AS after_ts,
    CASE WHEN count(*) = 100 THEN arg_max(scan_id, rank) END AS after_id FROM ranked GROUP BY rank // 100"""
)
def scan_page_ends(spark, sf):
    """Where each request of the walk starts, up to the short page."""
    from vellum.operators.explore import page_ends, scan_pages as walk

    ends = page_ends(walk(_scans(spark, sf)))
    return ends.select("page", "rows", F.col("search_after.ts").alias("after_ts"), F.col("search_after.id").alias("after_id"))


@query(
    """SELECT page_id, '2026-01-02T03:04:05Z' AS warc_date, md5(html) AS html_md5, CAST(NULL AS VARCHAR) AS error FROM pages
    UNION ALL SELECT page_id, NULL, NULL, 'bad_range' FROM pages WHERE page_id % 10 = 3"""
)
def archive_read(spark, sf):
    """Pages written as compressed archive members and read by byte range."""
    root = scratch_path(spark, "archive")
    pages = canonical.table(spark, sf, "pages").select(
        F.col("page_id").alias("key"), F.lit("2026-01-02T03:04:05Z").alias("date"), "html"
    )
    listing = scratch_path(spark, "members")
    render.write_archive(pages, root).write.parquet(listing)
    index = spark.read.parquet(listing)
    broken = index.where("key % 10 = 3").withColumn("offset", F.lit("12x"))
    rows = archive.read_archive(index.unionByName(broken), root)
    return rows.select(F.col("key").alias("page_id"), "warc_date", F.md5("html").alias("html_md5"), "error")


@query("SELECT page_id, sha1(html) AS digest, md5(html) AS html_md5 FROM pages")
def html_folder(spark, sf):
    """One HTML file per page, read back whole."""
    root = scratch_path(spark, "folder")
    pages = canonical.table(spark, sf, "pages").select(F.col("page_id").alias("key"), "html")
    names = render.write_html_files(pages, root)
    listing = scratch_path(spark, "names")
    names.write.parquet(listing)
    files = folder.read_html_folder(spark, root).withColumn("name", F.element_at(F.split("path", "/"), -1))
    joined = files.join(spark.read.parquet(listing), "name")
    return joined.select(F.col("key").alias("page_id"), "digest", F.md5("html").alias("html_md5"))


@query(
    f"""WITH {canonical.CAPTURES_SQL} SELECT ord, array_to_string(regexp_extract_all(
      '["' || array_to_string(links, '","') || '"]', '[a-z0-9]+'), ' ') AS tokens FROM captures"""
)
def link_token_list(spark, sf):
    """the links of a document share one position sequence."""
    return canonical.captures(spark, sf).select("ord", F.array_join(link_tokens(F.col("links")), " ").alias("tokens"))
