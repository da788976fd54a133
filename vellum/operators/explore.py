"""Queries over the store: newest observations, paging, histories, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import instant, rfc3339_seconds
from vellum.operators.skew import first_per, number_parts
from vellum.schemas import KEY
from vellum.session import scratch_path

PAGE = 100
NEVER = "0001-01-01T00:00:00Z"
EXPLORE = ["id", "revision", "title", "snippet", "timestamp", "source", "ord"]
# newest first; the columns after the time only settle ties
ORDER = ["timestamp", "id", "revision", "source", "ord"]


def explode_sources(docs: DataFrame) -> DataFrame:
    """Nested documents back to one row per observation; none without sources."""
    return docs.select(
        *KEY, "og_title", "og_description", F.posexplode("sources").alias("ord", "_source")
    ).select(
        *KEY,
        "og_title",
        "og_description",
        source_field("_source", "src").alias("src"),
        source_field("_source", "id").alias("sid"),
        source_field("_source", "ts").alias("ts"),
        F.col("ord").cast("bigint").alias("ord"),
    )


def source_field(column: str, name: str) -> Column:
    """Field of an observation."""
    return F.col(f"{column}.{name}")


def json_field(value: Column, name: str) -> Column:
    """Field of an observation kept as JSON, as text; NULL where there is none, JSON text of what is no scalar."""
    return F.try_variant_get(value, f"$.{name}", "string")


def explode_json_sources(docs: DataFrame, column: str = "sources") -> DataFrame:
    """Documents whose sources are JSON text to one row per observation.

    The text is parsed once, to a variant. Text that is no JSON or no array gives
    no rows, as does an empty array; an element that is no object gives a row
    with NULL fields, so the others keep their numbers.
    """
    sources = F.try_variant_get(F.try_parse_json(F.col(column)), "$", "array<variant>")
    return docs.select(*KEY, F.posexplode(sources).alias("ord", "_source")).select(
        *KEY,
        *[json_field(F.col("_source"), name).alias(alias) for name, alias in (("src", "src"), ("id", "sid"), ("ts", "ts"))],
        F.col("ord").cast("bigint").alias("ord"),
    )


def explore_columns(seen: DataFrame) -> DataFrame:
    """The six columns of an explore row, and the order number."""
    return seen.select(
        *KEY,
        F.col("og_title").alias("title"),
        F.col("og_description").alias("snippet"),
        F.col("ts").alias("timestamp"),
        F.col("src").alias("source"),
        "ord",
    )


def by_source(rows: DataFrame, src: str | None) -> DataFrame:
    return rows.where(F.col("source") == src) if src else rows


def before(rows: DataFrame, ts: str | None) -> DataFrame:
    """Rows strictly older than ``ts``, compared as text."""
    return rows.where(F.col("timestamp") < ts) if ts else rows


def newest(rows: DataFrame, n: int = PAGE) -> DataFrame:
    """The ``n`` newest rows: a top-n per task, then one merge of those."""
    return rows.orderBy(F.desc("timestamp"), *ORDER[1:]).limit(n)


def page(rows: DataFrame, cursor: Sequence | str | None = None, n: int = PAGE) -> DataFrame:
    """Next page after a cursor.

    A cursor is the ``ORDER`` columns of the last row seen. A bare time is the
    looser form: it skips the rows that share the time of the last row.
    """
    if isinstance(cursor, str):
        return newest(before(rows, cursor), n)
    if cursor is None:
        return newest(rows, n)
    time, *ties = cursor
    beyond = F.lit(False)
    for name, value in reversed(list(zip(ORDER[1:], ties))):
        beyond = (F.col(name) > value) | ((F.col(name) == value) & beyond)
    older = (F.col("timestamp") < time) | ((F.col("timestamp") == time) & beyond)
    return newest(rows.where((F.col("timestamp") <= time) & older), n)


def next_cursor(rows: DataFrame, n: int = PAGE) -> DataFrame:
    """Time of the last row of a full page, NULL after a short one."""
    return rows.agg(F.when(F.count(F.lit(1)) == n, F.min("timestamp")).alias("next_ts"))


def join_hits(seen: DataFrame, hits: DataFrame) -> DataFrame:
    """Observations of the documents found by a search."""
    return seen.join(hits.select(*KEY), KEY, "left_semi")


def explore_filter(
    seen: DataFrame, hits: DataFrame | None = None, src: str | None = None, ts: str | None = None
) -> DataFrame:
    """Any combination of search, source and time; an absent one filters nothing."""
    rows = before(by_source(explore_columns(seen), src), ts)
    return rows if hits is None else join_hits(rows, hits)


def explore(
    seen: DataFrame,
    hits: DataFrame | None = None,
    src: str | None = None,
    ts: str | None = None,
    n: int = PAGE,
) -> DataFrame:
    """Newest matching observations."""
    return newest(explore_filter(seen, hits, src, ts), n)


# ---------------------------------------------------------------- documents


def by_document(docs: DataFrame, doc_id: str) -> DataFrame:
    """Rows of one document; none means not found."""
    return docs.where(F.col("id") == doc_id)


def instance_columns(docs: DataFrame) -> DataFrame:
    """Columns of a document instance."""
    wanted = ["created", "og_title", "og_description", "content", "links", "image_urls"]
    return docs.select(*KEY, *wanted, *[c for c in ("part", "sources") if c in docs.columns])


def history(docs: DataFrame, doc_id: str) -> DataFrame:
    """Instances of one document, newest revision first (T4)."""
    return by_document(instance_columns(docs), doc_id).orderBy(F.desc("revision"))


def latest_instance(docs: DataFrame) -> DataFrame:
    """Highest revision of every document (T5)."""
    return first_per(docs, ["id"], [F.desc("revision")])


def count_documents(docs: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct documents (A4)."""
    count = F.approx_count_distinct("id") if approx else F.count_distinct("id")
    return docs.agg(count.alias("documents"))


def revisions_per_document(docs: DataFrame) -> DataFrame:
    """Revisions held of every document."""
    return docs.groupBy("id").agg(F.count(F.lit(1)).alias("revisions"))


def last_seen(seen: DataFrame) -> DataFrame:
    """Latest observation of the latest revision of every document."""
    return shown_last_seen(latest_of(seen))


def latest_of(seen: DataFrame) -> DataFrame:
    """For every document the highest revision and its latest time, as an instant."""
    return merged_latest(seen.select(*KEY, instant(F.col("ts")).alias("at")))


def merged_latest(parts: DataFrame) -> DataFrame:
    """Results of ``latest_of`` for parts of the observations become that of all of them."""
    latest = parts.groupBy("id").agg(F.max(F.struct("revision", "at")).alias("_latest"))
    return latest.select("id", "_latest.revision", "_latest.at")


def shown_last_seen(latest: DataFrame) -> DataFrame:
    at = rfc3339_seconds(F.unix_seconds("at"))
    return latest.select("id", F.coalesce(at, F.lit(NEVER)).alias("last_seen"))


#: A sketch of distinct ids has two to the power of this many registers: the count is off by 0.8 % or so.
SKETCH_BITS = 14


def places_of(docs: DataFrame) -> DataFrame:
    """Which ids each file holds, of documents read from files; ``file`` is folder and name."""
    file = F.substring_index(F.input_file_name(), "/", -2).alias("file")
    return docs.select("id", file).groupBy("file").agg(
        F.min("id").alias("first"),
        F.max("id").alias("last"),
        F.count(F.lit(1)).alias("n"),
        F.hll_sketch_agg("id", F.lit(SKETCH_BITS)).alias("ids"),
    )


def count_sketched(places: DataFrame) -> DataFrame:
    """Distinct documents, about, from the sketches of their files (A4)."""
    count = F.hll_sketch_estimate(F.hll_union_agg("ids"))
    return places.agg(F.coalesce(count, F.lit(0)).alias("documents"))


# ---------------------------------------------------------------- scan paging


def sort_key(sort: Column) -> Column:
    """``[time, id]`` of a scan as a struct; NULL unless both are there."""
    ts = F.get(sort, F.lit(0)).try_cast("bigint")
    sid = F.get(sort, F.lit(1))
    valid = (F.size(sort) == 2) & (ts != 0) & (sid != "")
    return F.when(valid, F.struct(ts.alias("ts"), sid.alias("id")))


def search_after(
    scans: DataFrame, after: tuple[int, str] | None = None, size: int = 100, key: str = "sort_key"
) -> DataFrame:
    """Next page of scans in ``(time, id)`` order, newest first."""
    ts, sid = F.col(f"{key}.ts"), F.col(f"{key}.id")
    rows = scans.where(F.col(key).isNotNull())
    if after is not None:
        rows = rows.where((ts < after[0]) | ((ts == after[0]) & (sid < after[1])))
    return rows.orderBy(F.desc(ts), F.desc(sid)).limit(size)


def scan_pages(scans: DataFrame, size: int = 100, key: str = "sort_key") -> DataFrame:
    """All scans with the number of their page, newest first, as a walk to the short page meets them.

    ``page`` counts from 0 and ``place`` is the row within its page; the walk
    ends with the page of fewer than ``size`` rows, an empty one if the last is
    full. Scans are sorted in ranges side by side and written with their place
    in the range. How many come before a range, a row for each range, gives the
    rank, so no task sees more than its range.
    """
    spark, order = scans.sparkSession, [F.desc(f"{key}.ts"), F.desc(f"{key}.id")]
    ranged = scans.where(F.col(key).isNotNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.select(
        "*",
        F.spark_partition_id().alias("_range"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_inner"),
    )
    path = scratch_path(spark, "scan-pages")
    numbered.write.parquet(path)
    kept = spark.read.schema(numbered.schema).parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_inner")
    return kept.join(F.broadcast(starts), "_range").select(
        *scans.columns, F.floor(rank / size).alias("page"), (rank % size).alias("place")
    )


def page_ends(pages: DataFrame, size: int = 100, key: str = "sort_key") -> DataFrame:
    """Of every page its rows and the key the next one starts after; NULL after the short page."""
    rows = F.count(F.lit(1))
    return pages.groupBy("page").agg(
        rows.alias("rows"), F.when(rows == size, F.max_by(F.col(key), F.col("place"))).alias("search_after")
    )


# ---------------------------------------------------------------- pages

# bytes on one page row, about; what an instance and an observation take besides the text
PAGE_BYTES = 16_000_000
INSTANCE_BYTES, SOURCE_BYTES = 200, 100
_MAX_REVISION = 4294967295


def document_pages(docs: DataFrame, seen: DataFrame, listed: DataFrame, chunk: int = PAGE_BYTES) -> DataFrame:
    """Every document with its instances, newest revision first.

    ``listed`` are the nested sources. A document that takes more than about
    ``chunk`` bytes goes on in rows with a higher ``part``. Where the sources of
    one revision have several parts, the later ones are rows of their own that
    name the revision in ``continues``. ``last_seen`` is on the first row of a
    document. Rows are numbered by their sizes alone; texts join them after that.
    """
    pieces = listed.withColumnRenamed("part", "_piece")
    text = F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")
    later = F.col("_piece") > 0
    place = F.lit(_MAX_REVISION) - F.col("revision")
    weight = F.col("_text") + INSTANCE_BYTES + SOURCE_BYTES * F.size("sources")
    narrow = pieces.join(docs.select(*KEY, text.alias("_text")), KEY).select(
        *KEY,
        "_piece",
        F.when(later, F.col("revision")).otherwise(-1).alias("_continues"),
        place.alias("_place"),
        F.when(later, F.col("_piece").cast("bigint")).otherwise(F.shiftright(place, 4)).alias("_bucket"),
        F.when(later, chunk).otherwise(weight).alias("_weight"),
    )
    numbered = number_parts(narrow, ["id", "_continues"], ["_bucket"], chunk, F.col("_weight")).select(
        *KEY, "_piece", "_continues", "_place", "part"
    )
    times = F.transform(
        "sources",
        lambda s: F.struct(
            s["src"].alias("src"),
            s["id"].alias("id"),
            F.coalesce(rfc3339_seconds(F.unix_seconds(instant(s["ts"]))), F.lit(NEVER)).alias("ts"),
        ),
    )
    instance = F.struct(
        "id",
        F.col("og_title").alias("title"),
        F.col("revision").cast("string").alias("revision"),
        "created",
        F.col("og_description").alias("description"),
        "content",
        "links",
        F.col("image_urls").alias("images"),
        times.alias("sources"),
    )
    units = pieces.join(numbered, [*KEY, "_piece"]).join(docs, KEY)
    pages = units.groupBy("id", "_continues", "part").agg(
        F.sort_array(F.collect_list(F.struct("_place", instance.alias("_instance")))).alias("_placed")
    )
    seen_last = last_seen(seen).select("id", F.lit(-1).cast("bigint").alias("_continues"), F.lit(0).alias("part"), "last_seen")
    return pages.join(seen_last, ["id", "_continues", "part"], "left").select(
        "id",
        F.when(F.col("_continues") >= 0, F.col("_continues")).alias("continues"),
        "part",
        "last_seen",
        F.col("_placed._instance").alias("instances"),
    )
