"""Folding captures, document histories, explore queries and their JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import explore, fold
from vellum.plans import canonical
from vellum.plans.canonical import CAPTURES_SQL, UNIQUE_SQL
from vellum.plans.registry import query
from vellum.sources import exports


def sources_text(listed):
    """The sources of a row as one string, to compare without arrays."""
    return F.array_join(F.transform(listed, lambda s: F.concat(s["src"], F.lit("@"), s["ts"])), ",")


def folded_rows(docs):
    return docs.select(
        "id",
        "revision",
        F.md5("content").alias("content_md5"),
        "og_title",
        F.size("sources").cast("bigint").alias("n_sources"),
        sources_text(F.col("sources")).alias("sources"),
    )


FOLDED_SQL = """SELECT u.id, u.revision, md5(arg_min(u.content, u.ord)) AS content_md5,
  arg_min(u.og_title, u.ord) AS og_title, count(*) AS n_sources,
  string_agg(u.src || '@' || u.ts, ',' ORDER BY u.ord) AS sources FROM {captures} u GROUP BY u.id, u.revision"""


@query(f"WITH {CAPTURES_SQL} SELECT digest, min(ord) AS ord, arg_min(id, ord) AS id FROM captures GROUP BY digest")
def digest_first(spark, sf):
    return fold.first_per_digest(canonical.captures(spark, sf).select("digest", "ord", "id"))


@query(f"WITH {UNIQUE_SQL} {FOLDED_SQL.format(captures='uniq')}")
def fold_docs(spark, sf):
    """A2 and A1: one capture per digest, folded into revisions."""
    return folded_rows(fold.fold_observations(canonical.unique_captures(spark, sf)))


@query(f"WITH {CAPTURES_SQL} {FOLDED_SQL.format(captures='captures')}")
def fold_onto_old(spark, sf):
    """A1: later captures added to earlier ones."""
    old, new = canonical.halves(canonical.captures(spark, sf))
    return folded_rows(fold.fold_observations(new, old))


@query(
    f"""WITH {UNIQUE_SQL} SELECT u.id, u.revision, CAST(row_number() OVER w - 1 AS INTEGER) AS position, u.src, u.sid, u.ts
    FROM uniq u WINDOW w AS (PARTITION BY u.id, u.revision ORDER BY u.ord)"""
)
def exploded_sources(spark, sf):
    """Nested sources back to rows."""
    nested = fold.fold_observations(canonical.unique_captures(spark, sf))
    rows = explore.explode_sources(nested)
    return rows.select("id", "revision", F.col("ord").cast("int").alias("position"), "src", "sid", "ts")


@query(
    f"""WITH {UNIQUE_SQL} SELECT u.id, u.revision, CAST(row_number() OVER w - 1 AS INTEGER) AS position, u.src, u.sid, u.ts
    FROM uniq u WHERE NOT (u.revision = 1 AND right(u.id, 1) = '7') WINDOW w AS (PARTITION BY u.id, u.revision ORDER BY u.ord)"""
)
def sources_json(spark, sf):
    """Sources kept as JSON text, some of it broken off, back to rows."""
    nested = fold.fold_observations(canonical.unique_captures(spark, sf))
    text = F.to_json("sources")
    broken = (F.col("revision") == 1) & (F.substring("id", -1, 1) == "7")
    docs = nested.withColumn("sources", F.when(broken, F.expr("left(to_json(sources), length(to_json(sources)) - 2)")).otherwise(text))
    rows = explore.explode_json_sources(docs)
    return rows.select("id", "revision", F.col("ord").cast("int").alias("position"), "src", "sid", "ts")


@query(f"WITH {CAPTURES_SQL} SELECT id, revision, min(ord) AS ord, arg_min(digest, ord) AS digest FROM captures GROUP BY id, revision")
def batch_key_dedup(spark, sf):
    rows = canonical.captures(spark, sf).select("id", "revision", "ord", "digest")
    return fold.first_per_revision(rows)


@query(f"WITH {CAPTURES_SQL} SELECT count(DISTINCT id) AS documents FROM captures")
def count_docs(spark, sf):
    return explore.count_documents(canonical.captures(spark, sf))


@query(f"WITH {CAPTURES_SQL} SELECT count(DISTINCT id) AS documents, TRUE AS close FROM captures")
def count_docs_approx(spark, sf):
    """A4: the approximate count is within 5 % of the exact one."""
    rows = canonical.captures(spark, sf)
    exact, about = (explore.count_documents(rows, approx=a).select("documents").scalar() for a in (False, True))
    one = rows.agg(F.count(F.lit(1)).alias("_rows"))
    return one.select(exact.alias("documents"), (F.abs(about - exact) <= 0.05 * exact).alias("close"))


@query(f"WITH {UNIQUE_SQL} SELECT id, count(*) AS revisions FROM docs GROUP BY id")
def revisions_per_doc(spark, sf):
    return explore.revisions_per_document(canonical.stored_documents(spark, sf).select("id", "revision"))


@query(
    f"""WITH {UNIQUE_SQL} SELECT s.id, max(s.ts) AS last_seen FROM seen s
    WHERE s.revision = (SELECT max(revision) FROM docs d WHERE d.id = s.id) GROUP BY s.id"""
)
def last_seen(spark, sf):
    return explore.last_seen(canonical.stored_observations(spark, sf))


@query("SELECT conv_id AS id, max(turn) AS revision, md5(arg_max(text, turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def latest_turn(spark, sf):
    """T5 over another history: the last turn of every conversation."""
    turns = canonical.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("id"), F.col("turn").alias("revision"), F.md5("text").alias("text_md5")
    )
    return explore.latest_instance(turns)


@query(
    f"""WITH {UNIQUE_SQL} SELECT id, revision, og_title, md5(content) AS content_md5 FROM docs
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision DESC) = 1"""
)
def latest_instance(spark, sf):
    docs = canonical.stored_documents(spark, sf).select("id", "revision", "og_title", F.md5("content").alias("content_md5"))
    return explore.latest_instance(docs)


@query(
    f"""WITH {UNIQUE_SQL} SELECT revision, created, og_title, og_description, md5(content) AS content_md5
    FROM docs WHERE id = 'D00000003'"""
)
def doc_lookup(spark, sf):
    """One document's instances, newest first."""
    rows = explore.history(canonical.stored_documents(spark, sf), "D00000003")
    return rows.select("revision", "created", "og_title", "og_description", F.md5("content").alias("content_md5"))


_PAGE_PARTS_SQL = f"""WITH {UNIQUE_SQL}, latest AS (
  SELECT s.id, max(s.ts) AS last_seen FROM seen s
  WHERE s.revision = (SELECT max(revision) FROM docs d WHERE d.id = s.id) GROUP BY s.id),
instances AS (
  SELECT d.id, d.revision, d.created, d.og_title, d.og_description, d.content, d.links, d.image_urls,
    string_agg('{{"src":"' || s.src || '","id":"' || s.sid || '","ts":"' || s.ts || '"}}', ',' ORDER BY s.ord) AS sources,
    string_agg(s.src || '@' || s.ts, ',' ORDER BY s.ord) AS sources_text
  FROM docs d JOIN seen s ON d.id = s.id AND d.revision = s.revision GROUP BY ALL)"""


def _pages(spark, sf):
    unique = canonical.unique_captures(spark, sf)
    docs = fold.new_documents(unique)
    seen = fold.observations(unique, docs)
    return explore.document_pages(docs, seen, fold.nest_sources(seen))


@query(
    _PAGE_PARTS_SQL
    + """ SELECT i.id, l.last_seen, i.revision, row_number() OVER (PARTITION BY i.id ORDER BY i.revision DESC) - 1 AS position,
    i.created, i.og_title AS title, md5(i.content) AS content_md5, i.sources_text AS sources
    FROM instances i JOIN latest l ON i.id = l.id"""
)
def doc_history(spark, sf):
    """All documents with their instances in order."""
    rows = _pages(spark, sf).select("id", "last_seen", F.posexplode("instances").alias("position", "i"))
    return rows.select(
        "id",
        "last_seen",
        F.col("i.revision").cast("bigint").alias("revision"),
        F.col("position").cast("bigint").alias("position"),
        F.col("i.created").alias("created"),
        F.col("i.title").alias("title"),
        F.md5("i.content").alias("content_md5"),
        sources_text(F.col("i.sources")).alias("sources"),
    )


@query(
    _PAGE_PARTS_SQL
    + """ SELECT i.id, '{"id":"' || i.id || '","last_seen":"' || l.last_seen || '","instances":[' || string_agg(
      '{"id":"' || i.id || '","title":' || CAST(to_json(i.og_title) AS VARCHAR) || ',"revision":"' || i.revision ||
      '","created":"' || i.created || '","description":"' || i.og_description || '","content":' ||
      CAST(to_json(i.content) AS VARCHAR) || ',"links":["' || array_to_string(i.links, '","') || '"],"images":["' ||
      array_to_string(i.image_urls, '","') || '"],"sources":[' || i.sources || ']}', ',' ORDER BY i.revision DESC) || ']}' AS page
    FROM instances i JOIN latest l ON i.id = l.id GROUP BY i.id, l.last_seen"""
)
def document_pages_json(spark, sf):
    """One JSON object per document."""
    return exports.document_page_json(_pages(spark, sf)).select("id", F.col("value").alias("page"))


# ---------------------------------------------------------------- explore

_ROW = "id, revision, og_title AS title, og_description AS snippet, ts AS timestamp, src AS source, ord"
_NEWEST = "ORDER BY ts DESC, id, revision, src, ord LIMIT 100"


@query(f"WITH {UNIQUE_SQL} SELECT {_ROW} FROM seen {_NEWEST}")
def explore_latest(spark, sf):
    return explore.explore(canonical.stored_observations(spark, sf))


@query(f"WITH {UNIQUE_SQL} SELECT {_ROW} FROM seen WHERE src = 'urlscan' {_NEWEST}")
def explore_source(spark, sf):
    return explore.explore(canonical.stored_observations(spark, sf), src="urlscan")


_CURSOR = ("2026-01-01T00:20:58Z", "D00000023", 0, "commoncrawl", 136)


@query(f"WITH {UNIQUE_SQL} SELECT {_ROW} FROM seen WHERE ts < '{_CURSOR[0]}' {_NEWEST}")
def explore_before(spark, sf):
    """P9, T2 with a bare time as the cursor."""
    rows = explore.explore_columns(canonical.stored_observations(spark, sf))
    return explore.page(rows, _CURSOR[0])


@query(
    f"""WITH {UNIQUE_SQL} SELECT {_ROW} FROM seen WHERE ts < '{_CURSOR[0]}' OR (ts = '{_CURSOR[0]}'
    AND (id, revision, src, ord) > ('{_CURSOR[1]}', {_CURSOR[2]}, '{_CURSOR[3]}', {_CURSOR[4]})) {_NEWEST}"""
)
def explore_page2(spark, sf):
    """T2 with the whole last row as the cursor: tied rows are not lost."""
    rows = explore.explore_columns(canonical.stored_observations(spark, sf))
    return explore.page(rows, _CURSOR)


@query(f"WITH {UNIQUE_SQL} SELECT CASE WHEN count(*) = 100 THEN min(ts) END AS next_ts FROM (SELECT ts FROM seen {_NEWEST})")
def next_cursor(spark, sf):
    return explore.next_cursor(explore_latest(spark, sf))


@query(
    f"""WITH {UNIQUE_SQL} SELECT '{{"timestamp":"' || ts || '","source":"' || src || '","id":"' || id || '","title":' ||
    CAST(to_json(og_title) AS VARCHAR) || ',"snippet":"' || og_description || '","revision":"' || revision || '"}}' AS line
    FROM (SELECT * FROM seen {_NEWEST})"""
)
def ndjson_rows(spark, sf):
    """The newest page as JSON lines."""
    return exports.ndjson_lines(explore_latest(spark, sf)).select(F.col("value").alias("line"))


@query("SELECT 'no data' AS line")
def ndjson_empty(spark, sf):
    """A source nobody used."""
    rows = explore.explore(canonical.stored_observations(spark, sf), src="nowhere")
    return exports.ndjson_lines(rows).select(F.col("value").alias("line"))
