"""The store over several batches, and collection as a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import explore, fold, search
from vellum.operators.search import phrase
from vellum.plans import canonical, render
from vellum.plans.canonical import SCANS_SQL, UNIQUE_SQL
from vellum.plans.collect import crawl_captures, folder_captures, scan_captures
from vellum.plans.queries_fold import FOLDED_SQL, folded_rows
from vellum.plans.queries_search import CASES, WORDS_SQL, _any, _PHRASE
from vellum.plans.registry import query
from vellum.session import scratch_path
from vellum.sources import scans
from vellum.sources.folder import read_html_folder
from vellum.sources.store import Store, names as _names
from vellum.streaming.collect import collect_scans, start_collection


def _nested(store: Store):
    listed = fold.nest_sources(store.read("observations"), ["batch", "ord"])
    return fold.attach_sources(store.read("documents"), listed)


def _filled(spark, sf, index: bool = False) -> Store:
    """A store filled in two batches, older captures first."""
    store = Store(spark, scratch_path(spark, "store"))
    for half in canonical.halves(canonical.captures(spark, sf)):
        store.add(half, index=index)
    return store


@query(f"WITH {UNIQUE_SQL} {FOLDED_SQL.format(captures='uniq')}")
def store_two_batches(spark, sf):
    """Two batches leave what one would."""
    return folded_rows(_nested(_filled(spark, sf)))


class _Dying(Store):
    """A store whose changes break off before their marker is written."""

    def publish(self, commit):
        raise RuntimeError("broken off")


@query(f"WITH {UNIQUE_SQL} {FOLDED_SQL.format(captures='uniq')}")
def store_after_failure(spark, sf):
    """An attempt that broke off before its marker leaves nothing, whatever is committed next."""
    store = Store(spark, scratch_path(spark, "store"))
    early, late = canonical.halves(canonical.captures(spark, sf))
    store.add(early, index=False)
    try:
        _Dying(spark, store.root).add(late, index=False)
    except RuntimeError:
        store.write_cursor("1")
    store.add(late, index=False)
    return folded_rows(_nested(store))


@query(f"WITH {UNIQUE_SQL} {FOLDED_SQL.format(captures='uniq')}")
def store_compacted(spark, sf):
    """Folders joined into one hold what they held."""
    store = _filled(spark, sf, index=True)
    for name in ("documents", "observations", "processed"):
        store.compact(name)
    return folded_rows(_nested(store))


@query("SELECT DISTINCT md5(text) AS digest FROM documents")
def store_processed(spark, sf):
    """Digests marked with their documents."""
    return _filled(spark, sf).read("processed").select("digest")


@query(f"WITH {WORDS_SQL} SELECT id, revision FROM words WHERE {_any(_PHRASE)}")
def store_search(spark, sf):
    """postings kept batch by batch."""
    return search.search_postings(_filled(spark, sf, index=True).read("postings"), phrase("of the"))


@query(f"WITH {WORDS_SQL} SELECT id, revision FROM words WHERE {_any(_PHRASE)}")
def store_backfill(spark, sf):
    """postings of a store that had none."""
    store = _filled(spark, sf)
    store.ensure_postings()
    return search.search_postings(store.read("postings"), phrase("of the"))


@query(
    f"WITH {WORDS_SQL} "
    + " UNION ALL ".join(f"SELECT '{name}' AS query, id, revision FROM words WHERE {condition}" for name, (_, condition) in CASES.items())
)
def store_queries(spark, sf):
    """All queries over one store, by its dictionary and from their rarest words on."""
    store = _filled(spark, sf, index=True)
    found = [store.search(wanted).select(F.lit(name).alias("query"), "id", "revision") for name, (wanted, _) in CASES.items()]
    return reduce(DataFrame.union, found)


@query(
    f"""WITH {WORDS_SQL}, occurrences AS (
      SELECT id, revision, 'title' AS col, unnest(title) AS term FROM words
      UNION ALL SELECT id, revision, 'content', unnest(content) FROM words
      UNION ALL SELECT id, revision, 'links', unnest(links) FROM words)
    SELECT term, col, count(DISTINCT (id, revision)) AS n, count(*) AS occurrences FROM occurrences GROUP BY term, col"""
)
def store_dictionary(spark, sf):
    """F2, F8: the words of a store, in order, with the number of documents and of occurrences."""
    terms = _filled(spark, sf, index=True).read("terms")
    return terms.groupBy("term", "col").agg(F.sum("n").alias("n"), F.sum("occurrences").alias("occurrences"))


@query(
    f"""WITH {WORDS_SQL}, hits AS (SELECT id, revision FROM words WHERE {_any(_PHRASE)})
    SELECT s.id, s.revision, og_title AS title, og_description AS snippet, ts AS timestamp, src AS source
    FROM seen s JOIN hits h ON s.id = h.id AND s.revision = h.revision
    WHERE src = 'urlscan' AND ts < '2026-01-01T20:00:00Z' ORDER BY ts DESC, s.id, s.revision, src LIMIT 100"""
)
def store_explore(spark, sf):
    """search by the index, source and time together, newest first."""
    store = _filled(spark, sf, index=True)
    hits = store.search(phrase("of the"))
    return explore.explore(store.read("observations"), hits, "urlscan", "2026-01-01T20:00:00Z").drop("ord")


_SEEN_ROW = "id, revision, og_title AS title, og_description AS snippet, ts AS timestamp, src AS source"


@query(f"WITH {UNIQUE_SQL} SELECT {_SEEN_ROW} FROM seen WHERE src = 'urlscan' ORDER BY ts DESC, id, revision, src LIMIT 100")
def store_newest(spark, sf):
    """The newest observations of a source, from the files of the newest days."""
    return _filled(spark, sf).newest(src="urlscan").drop("ord")


@query(
    f"""WITH {UNIQUE_SQL} SELECT {_SEEN_ROW} FROM seen
    WHERE ts < (SELECT min(ts) FROM (SELECT ts FROM seen ORDER BY ts DESC LIMIT 100)) ORDER BY ts DESC, id, revision, src LIMIT 100"""
)
def store_page2(spark, sf):
    """The page after the time of the newest one's last row."""
    store = _filled(spark, sf)
    last = store.newest().agg(F.min("timestamp")).first()[0]
    return store.newest(cursor=last).drop("ord")


@query(
    f"""WITH {UNIQUE_SQL} SELECT revision, created, og_title, og_description, md5(content) AS content_md5
    FROM docs WHERE id = 'D00000003'"""
)
def store_lookup(spark, sf):
    """One document's instances, from the files whose range of ids it falls in."""
    rows = explore.history(_filled(spark, sf).lookup("D00000003"), "D00000003")
    return rows.select("revision", "created", "og_title", "og_description", F.md5("content").alias("content_md5"))


@query(f"WITH {UNIQUE_SQL} SELECT count(DISTINCT id) AS documents, TRUE AS close FROM docs")
def store_count(spark, sf):
    """A4: distinct documents of a store; its sketches tell them within 5 %."""
    store = _filled(spark, sf)
    about = store.count_documents(approx=True).select("documents").scalar()
    exact = F.col("documents")
    return store.count_documents().select("documents", (F.abs(about - exact) <= 0.05 * exact).alias("close"))


@query(
    f"""WITH {UNIQUE_SQL} SELECT s.id, max(s.ts) AS last_seen FROM seen s
    WHERE s.revision = (SELECT max(revision) FROM docs d WHERE d.id = s.id) GROUP BY s.id"""
)
def store_last_seen(spark, sf):
    """When every document was last seen, merged from what each batch kept."""
    return _filled(spark, sf).last_seen()


_TAKEN = "SELECT DISTINCT 'D' || lpad(CAST(doc_id // 6 AS VARCHAR), 8, '0') AS id, doc_id % 2 AS revision FROM labels WHERE toxic = 1"


@query(
    f"""WITH {UNIQUE_SQL}, taken AS ({_TAKEN})
    SELECT d.id, d.revision, md5(d.content) AS content_md5, count(*) AS n_sources
    FROM docs d JOIN seen s ON d.id = s.id AND d.revision = s.revision
    WHERE (d.id, d.revision) NOT IN (SELECT (id, revision) FROM taken) GROUP BY ALL"""
)
def remove_docs(spark, sf):
    """documents taken down by key."""
    store = _filled(spark, sf)
    n = F.col("doc_id")
    taken = canonical.table(spark, sf, "labels").where("toxic = 1").select(
        F.concat(F.lit("D"), F.lpad(F.expr("doc_id div 6").cast("string"), 8, "0")).alias("id"),
        (n % 2).alias("revision"),
    )
    store.remove(taken)
    counts = store.read("observations").groupBy("id", "revision").agg(F.count(F.lit(1)).alias("n_sources"))
    docs = store.read("documents").select("id", "revision", F.md5("content").alias("content_md5"))
    return docs.join(counts, ["id", "revision"])


def _landed(spark, sf):
    """Rendered pages in two landing folders, earlier ones in the first."""
    pages = canonical.pages(spark, sf, also=("src", "provenance", "digest", "url"))
    schema = "ord bigint, html string, src string, provenance string, digest string, url string"
    folders = scratch_path(spark, "landing"), scratch_path(spark, "landing")
    for folder, half in zip(folders, canonical.halves(pages.select(*_names(schema)))):
        half.write.parquet(folder)
    return folders, schema


def _collect(spark, store, folder, schema, checkpoint):
    stream = spark.readStream.schema(schema).parquet(folder)
    start_collection(stream, store, _parse_landed, checkpoint, every=None).awaitTermination()


@query(f"WITH {UNIQUE_SQL} {FOLDED_SQL.format(captures='uniq')}")
def stream_fold(spark, sf):
    """Pages land as files, and every poll of a stream adds the new ones."""
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "progress")
    store = Store(spark, scratch_path(spark, "store"))
    folders, schema = _landed(spark, sf)
    for folder in folders:
        spark.read.schema(schema).parquet(folder).write.mode("append").parquet(landing)
        _collect(spark, store, landing, schema, checkpoint)
    return folded_rows(_nested(store))


@query(f"WITH {UNIQUE_SQL} {FOLDED_SQL.format(captures='uniq')}")
def poll_restart(spark, sf):
    """A poll that runs while files land, is stopped, and goes on from its progress."""
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "progress")
    store = Store(spark, scratch_path(spark, "store"))
    folders, schema = _landed(spark, sf)

    def land(folder):
        spark.read.schema(schema).parquet(folder).write.mode("append").parquet(landing)

    land(folders[0])
    stream = spark.readStream.schema(schema).parquet(landing)
    poll = start_collection(stream, store, _parse_landed, checkpoint, every="1 second")
    poll.processAllAvailable()
    poll.stop()
    land(folders[1])
    poll = start_collection(stream, store, _parse_landed, checkpoint, every="1 second")
    poll.processAllAvailable()
    poll.stop()
    return folded_rows(_nested(store))


@query(f"WITH {UNIQUE_SQL} {FOLDED_SQL.format(captures='uniq')}")
def two_streams(spark, sf):
    """Two streams that both start at batch 0, and one again after its progress was lost."""
    store = Store(spark, scratch_path(spark, "store"))
    folders, schema = _landed(spark, sf)
    for folder in (*folders, folders[0]):
        _collect(spark, store, folder, schema, scratch_path(spark, "progress"))
    return folded_rows(_nested(store))


def _parse_landed(batch):
    from vellum.operators.extract import extract_documents

    parsed = extract_documents(batch)
    text_title = F.regexp_replace("page_title", " - Docs$", "")
    return parsed.withColumn("page_title", text_title)


@query(
    """SELECT 'U' || doc_id AS id, TRUE AS stored, 's' || doc_id AS scan_id, md5(text) AS text_md5 FROM documents
    UNION ALL SELECT 'U' || doc_id, FALSE, 'm' || doc_id, NULL FROM documents WHERE doc_id % 10 = 0"""
)
def scan_collection(spark, sf):
    """Scans with their saved pages; one without is set aside, the run goes on."""
    lines = scans.parse_scan_lines(canonical.document_scans(spark, sf))
    parsed = scan_captures(lines, canonical.document_doms(spark, sf))
    good = F.col("parse_status") == "ok"
    return parsed.select(
        "id",
        good.alias("stored"),
        F.col("digest").alias("scan_id"),
        F.when(good, F.md5("content")).alias("text_md5"),
    )


@query(
    """SELECT status, n FROM (
      SELECT 'ok' AS status, count(*) AS n FROM documents
      UNION ALL SELECT 'fetch_failed', count(*) FROM documents WHERE doc_id % 10 = 0
      UNION ALL SELECT 'bad_line', count(*) FROM documents WHERE doc_id % 10 = 1
      UNION ALL SELECT CASE doc_id % 2 WHEN 0 THEN 'visibility' ELSE 'published' END, count(*) FROM documents GROUP BY 1)
    WHERE n > 0"""
)
def scan_bad_lines(spark, sf):
    """Cut lines are set aside, and the store counts what became of every line."""
    lines = canonical.document_scans(spark, sf)
    number = F.regexp_extract("value", '"_id":"s([0-9]+)"', 1).try_cast("bigint")
    cut = F.when(number % 10 == 1, F.array("value", F.substring("value", 1, 20))).otherwise(F.array("value"))
    landing = scratch_path(spark, "landing")
    lines.select(F.explode(cut).alias("value")).write.text(landing)
    store = Store(spark, scratch_path(spark, "store"))
    stream = scans.stream_scans(spark, landing)
    collect_scans(stream, canonical.document_doms(spark, sf), store, scratch_path(spark, "progress"), None).awaitTermination()
    return store.read("counters").groupBy("status").agg(F.sum("n").alias("n"))


@query("SELECT 'U' || doc_id AS id, 's' || doc_id AS scan_id, 'public/urlscan' AS seen FROM documents")
def scan_stream(spark, sf):
    """Scan results from a landing folder to the store, twice over."""
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "progress")
    saved = scratch_path(spark, "doms")
    canonical.document_doms(spark, sf).write.parquet(saved)
    canonical.document_scans(spark, sf).repartition(2).write.text(landing)
    doms = spark.read.parquet(saved)
    store = Store(spark, scratch_path(spark, "store"))
    for _ in range(2):
        collect_scans(scans.stream_scans(spark, landing, maxFilesPerTrigger="1"), doms, store, checkpoint, None).awaitTermination()
    # the same results once more, without the progress: their digests are known
    store.add(scan_captures(scans.read_scans(spark, landing), doms, store.read("processed")))
    rows = store.read("observations")
    return rows.select("id", F.col("sid").alias("scan_id"), F.concat(F.lit("public/"), "src").alias("seen"))


@query(
    """SELECT 'P' || doc_id AS id, doc_id % 2 AS revision, md5(text) AS content_md5, 'CC-TEST' AS sid,
      '2026-01-02T03:04:05Z' AS ts FROM documents"""
)
def crawl_collection(spark, sf):
    """S2-S4, P1-P6, E*: index records to parsed captures through archive files."""
    root, listing = scratch_path(spark, "archive"), scratch_path(spark, "members")
    pages = canonical.pages(spark, sf).select(
        F.col("ord").alias("key"), F.lit("2026-01-02T03:04:05Z").alias("date"), "html"
    )
    render.write_archive(pages, root).write.parquet(listing)
    members = spark.read.parquet(listing)
    index = canonical.document_index(spark, sf)
    located = index.join(members, index["doc_id"] == members["key"]).drop("key", "doc_id")
    parsed = crawl_captures(located, root, "CC-TEST")
    return parsed.select(
        "id", "revision", F.md5("content").alias("content_md5"), F.col("provenance").alias("sid"), F.col("timestamp").alias("ts")
    )


@query(
    f"""WITH {canonical.CAPTURES_SQL} SELECT id, revision, arg_min(md5(content), ord) AS content_md5, arg_min(ts, ord) AS ts
    FROM captures GROUP BY id, revision"""
)
def folder_collection(spark, sf):
    """Rendered pages as files; the first file of a revision wins."""
    root = scratch_path(spark, "folder")
    pages = canonical.pages(spark, sf).select(F.col("ord").alias("key"), "html")
    render.write_html_files(pages, root).write.parquet(scratch_path(spark, "names"))
    rows = folder_captures(read_html_folder(spark, root), also={"content_md5": F.md5("content")})
    return rows.select("id", "revision", "content_md5", F.col("timestamp").alias("ts"))


@query(f"WITH {SCANS_SQL} SELECT scan_id, scan_time, sort_ts, url FROM scans WHERE sort_ts > 1704700000000")
def scan_cursor(spark, sf):
    """The next collection starts at the cursor the last one left in the store."""
    store = Store(spark, scratch_path(spark, "store"))
    store.write_cursor("1704700000000")
    later = scans.collect_since(scans.parse_scan_lines(canonical.scan_lines(spark, sf)), store.read_cursor())
    return later.select("scan_id", "scan_time", F.col("sort_key.ts").alias("sort_ts"), "url")
