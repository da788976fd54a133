"""The document store: Parquet tables that only grow, and one marker per commit.

An attempt writes folders of its own, and the marker of a version lists the
folders that make up every table. Readers open listed folders only; so a
document and the mark that its digest was processed appear together or not at
all, and what a failed attempt or a losing writer left behind is never read.
Nothing that is read is ever rewritten: a batch writes its own rows, and of the
stored ones reads the key and digest columns only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from functools import reduce, wraps

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.explore import (
    PAGE,
    by_document,
    count_documents,
    count_sketched,
    explore_filter,
    last_seen,
    latest_of,
    merged_latest,
    page,
    places_of,
    shown_last_seen,
)
from vellum.operators.extract import split_quarantine
from vellum.operators.filters import run_counters, skip_processed
from vellum.operators.fold import first_per_digest, new_documents, observations, store_spelling
from vellum.operators.cascade import count_blocks, find, looked_up
from vellum.operators.search import Query, build_blocks, postings_in, search_postings
from vellum.schemas import (
    BLOCKS,
    COUNTERS,
    DAY,
    DAYS,
    DOCUMENTS,
    KEY,
    LATEST,
    OBSERVATIONS,
    PLACES,
    POSTINGS,
    PROCESSED,
    QUARANTINE,
    REMOVED,
    SCALARS,
    TERMS,
)

STAGED = [*KEY, *SCALARS, "src", "provenance", "timestamp", "digest", "url", "parse_status", "ord"]

TABLES = {
    "documents": DOCUMENTS,
    "places": PLACES,
    "observations": f"{OBSERVATIONS}, {DAY}",
    "days": DAYS,
    "latest": LATEST,
    "processed": PROCESSED,
    "postings": BLOCKS,
    "terms": TERMS,
    "removed": REMOVED,
    "quarantine": QUARANTINE,
    "counters": COUNTERS,
}
#: How the rows of a table stand in its files, so that lookups skip most of them.
SORTED = {
    "documents": KEY,
    "observations": ["ts"],
    "postings": ["term", "col", "first"],
    "terms": ["term", "col"],
    "processed": ["digest"],
    "removed": KEY,
    "quarantine": ["key"],
    "counters": ["status"],
    "days": ["day", "src"],
    "places": ["first"],
    "latest": ["id"],
}
#: Small tables about the files or rows of another one; their folders have the names of its folders.
BESIDE = {"postings": "terms", "documents": "places", "observations": "latest"}
#: Tables whose files are kept apart by a column, so that a read opens those of the values it wants.
APART = {"observations": "day"}
#: The day of an observation without a time, before all others.
NO_DAY = "!"
#: Parquet's second format codes whole numbers, as positions are, by their differences in blocks.
FORMATS = {"postings": {"parquet.writer.version": "v2"}}
#: Texts take about two thirds of the room they have in Spark's usual format.
PACKED = {"compression": "zstd"}
#: Spark then drops what a write has shuffled when it ends, not when the driver happens to collect its garbage.
DROP_SHUFFLED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Postings are put in order slice by slice, for rows of many documents take several times the room
#: in a shuffle that they take in files: so many bytes of documents in a slice, and so many slices at most.
SLICE_BYTES, SLICES = 16 * 1024 * 1024, 8
#: Documents, and words of them, that show where to cut.
SHOWN_DOCUMENTS, SHOWN_WORDS = 500, 20_000
#: A task writes to the files of all slices at a time, in short stretches, so nothing is sorted for it.
SLICED = "spark.sql.maxConcurrentOutputFileWriters"
STRETCH_BYTES = 8 * 1024 * 1024
#: So long a marker may be in the making; after that its writer is taken for dead.
UNFINISHED_SECONDS = 5.0
#: So often a change is made again on top of what another writer committed meanwhile.
TRIES = 5


class Conflict(RuntimeError):
    """Another writer committed first."""


def _again(change: Callable) -> Callable:
    """Make a change anew, from the store as it is by then, when another writer was first."""

    @wraps(change)
    def made(*args, **options):
        for _ in range(TRIES - 1):
            try:
                return change(*args, **options)
            except Conflict:
                continue
        return change(*args, **options)

    return made


@contextmanager
def _set(spark: SparkSession, **conf: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass(frozen=True)
class Commit:
    """What the newest marker says.

    ``streams`` has the last batch of every stream, ``tables`` the folders of
    every table, ``indexed`` the folders of documents whose words are in the
    postings. ``newest`` is the highest number that any marker had when this one
    was read, finished or not; it is not stored.
    """

    version: int = 0
    cursor: str | None = None
    streams: dict[str, int] = field(default_factory=dict)
    tables: dict[str, list[str]] = field(default_factory=dict)
    indexed: list[str] = field(default_factory=list)
    newest: int = 0


class Attempt:
    """Folders that one change writes; they count once its marker is there.

    The number follows the markers that were there when ``now`` was read. A
    writer that commits after that takes the same number, and the later of the
    two finds the marker made.
    """

    def __init__(self, store: Store, now: Commit):
        self.store, self.now = store, now
        self.version = now.newest + 1
        self.name = f"{self.version:012d}-{uuid.uuid4().hex}"
        self.folders: dict[str, str] = {}

    def path(self, table: str) -> str:
        return self.store.folder(table, self.name)

    def write(self, table: str, rows: DataFrame) -> None:
        if "batch" not in rows.columns:
            rows = rows.withColumn("batch", F.lit(self.version).cast("bigint"))
        order = [c for c in SORTED.get(table, []) if c in rows.columns]
        if order:
            rows = rows.sortWithinPartitions(*order)
        writer = rows.write.options(**PACKED, **FORMATS.get(table, {}))
        if table in self.folders:
            writer = writer.mode("append")
        with _set(rows.sparkSession, **{DROP_SHUFFLED: "true"}):
            (writer.partitionBy(APART[table]) if table in APART else writer).parquet(self.path(table))
        self.folders[table] = self.name

    def kept(self, name: str) -> str:
        return f"{self.path('work')}/{name}"

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """Write an intermediate result once; every later step reads it from there."""
        with _set(rows.sparkSession, **{DROP_SHUFFLED: "true"}):
            rows.write.options(**PACKED).parquet(self.kept(name))
        return self.store.spark.read.schema(rows.schema).parquet(self.kept(name))

    def keep_slices(self, name: str, rows: DataFrame, number: Column, n: int) -> list[DataFrame]:
        """Write an intermediate result cut by a number under ``n``; slice ``k`` is kept as ``name/slice=k``."""
        with _set(rows.sparkSession, **{DROP_SHUFFLED: "true", SLICED: str(n)}):
            writer = rows.withColumn("slice", number).write.options(**PACKED, **{"parquet.block.size": STRETCH_BYTES})
            writer.partitionBy("slice").parquet(self.kept(name))
        return [self.store.spark.read.schema(rows.schema).parquet(f"{self.kept(name)}/slice={k}") for k in range(n)]

    def drop(self, name: str) -> None:
        """Give back the room of an intermediate result that no later step reads."""
        self.store.drop_folder(self.kept(name))

    def publish(self, **changes) -> Commit:
        tables = {t: [*own] for t, own in self.now.tables.items()}
        for table, folder in self.folders.items():
            tables.setdefault(table, []).append(folder)
        commit = replace(self.now, **{"version": self.version, "newest": self.version, "tables": tables, **changes})
        self.store.publish(commit)
        return commit

    def __enter__(self) -> Attempt:
        return self

    def __exit__(self, *error) -> None:
        """The intermediate results go, whether the marker was written or not."""
        self.store.drop_folder(self.path("work"))


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)

    # ------------------------------------------------------------ commits

    def _versions(self) -> list[int]:
        """Versions that have a marker, newest first."""
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)

    def current(self) -> Commit:
        """The newest commit; a marker that its writer did not finish is passed over once it is old."""
        versions = self._versions()
        for version in versions:
            began = time.monotonic()
            while (found := self._marker(version)) is None and time.monotonic() - began < UNFINISHED_SECONDS:
                time.sleep(0.1)
            if found is not None:
                return Commit(**found, newest=versions[0])
        return Commit(newest=versions[0] if versions else 0)

    def _marker(self, version: int) -> dict | None:
        stream = self._fs.open(self._path(f"{self.root}/commits/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def publish(self, commit: Commit) -> None:
        """Create the marker of a version; a second writer of the same version fails here."""
        marker = self._path(f"{self.root}/commits/{commit.version:012d}.json")
        text = json.dumps({k: v for k, v in asdict(commit).items() if k != "newest"})
        try:
            stream = self._fs.create(marker, False)
        except Py4JJavaError as error:
            raise Conflict(f"version {commit.version} of {self.root} was committed by another writer") from error
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def drop_folder(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    # ------------------------------------------------------------ tables

    def _folders(self, table: str, folders: list[str]) -> DataFrame:
        schema = f"{TABLES[table]}, batch bigint"
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [self.folder(table, name) for name in folders]
        if table == "postings":
            return self._blocks(paths)
        if table not in APART:
            return self.spark.read.schema(schema).parquet(*paths)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)
        return rows.select(*names(schema))

    def _blocks(self, paths: list[str]) -> DataFrame:
        """Postings as files hold them; a row of a store from before there were blocks is one of one document."""
        alone = [part for part in POSTINGS.split(", ") if part not in BLOCKS.split(", ")]
        rows = self.spark.read.schema(", ".join([BLOCKS, *alone, "batch bigint"])).parquet(*paths)
        same = {
            "first": F.coalesce("first", "id"),
            "n": F.coalesce("n", F.lit(1).cast("bigint")),
            "occurrences": F.coalesce("occurrences", F.size("positions").cast("bigint")),
            "docs": F.coalesce("docs", F.array(F.struct(*KEY, "positions"))),
        }
        return rows.withColumns(same).drop(*names(", ".join(alone)))

    def folder(self, table: str, name: str) -> str:
        return f"{self.root}/{table}/{'attempt=' if table in APART else ''}{name}"

    def _visible(self, rows: DataFrame, commit: Commit) -> DataFrame:
        """Rows without the documents removed after they were stored."""
        folders = commit.tables.get("removed")
        if not folders:
            return rows
        removed = self._folders("removed", folders).groupBy(*KEY).agg(F.max("batch").alias("_gone"))
        marked = rows.join(removed, KEY, "left")
        return marked.where("_gone is null or batch >= _gone").select(*rows.columns)

    def read(self, table: str, commit: Commit | None = None) -> DataFrame:
        """A table as of a commit, without the documents removed by then.

        A removal hides what was stored before it, so a document may come back.
        """
        commit = commit or self.current()
        rows = self._folders(table, commit.tables.get(table, []))
        if table == "postings":
            rows = postings_in(rows, "batch")
        return self._visible(rows, commit) if table in ("documents", "observations", "postings") else rows

    def _write_postings(self, attempt: Attempt, docs: DataFrame, folders: list[str], once: bool = False) -> None:
        """Blocks in ranges of (term, first key): a search reads few files, and a word
        found in every document is spread over many of them. Ranges are found by
        sampling, so the blocks are kept first: texts are tokenised once. ``folders`` are
        those of the documents: many are put in order slice by slice, and a slice goes when it is written."""
        held = sum(self._fs.getContentSummary(self._path(self.folder("documents", f))).getLength() for f in folders)
        cuts = _cuts(docs, min(SLICES, -(-held // SLICE_BYTES)))
        blocks = build_blocks(docs, once)
        if cuts:
            number = reduce(Column.__add__, [(F.col("term") >= cut).cast("int") for cut in cuts])
            slices = attempt.keep_slices("postings", blocks, number, len(cuts) + 1)
        else:
            slices = [attempt.keep("postings", blocks)]
        for k, some in enumerate(slices):
            if cuts and not self._fs.exists(self._path(attempt.kept(f"postings/slice={k}"))):
                continue  # no word fell into it
            attempt.write("postings", some.repartitionByRange(*SORTED["postings"]))
            attempt.drop(f"postings/slice={k}" if cuts else "postings")
        self._write_beside(attempt, "postings")

    def _write_beside(self, attempt: Attempt, table: str) -> None:
        """What is kept about rows just written: the dictionary of postings, the ids of each file
        of documents, or when a document was last seen."""
        written = self._folders(table, [attempt.name])
        if table == "postings":
            attempt.write("terms", count_blocks(written).repartitionByRange(*SORTED["terms"]))
        elif table == "documents":
            attempt.write("places", places_of(written))
        elif table == "observations":
            attempt.write("latest", latest_of(written))

    def _beside(self, table: str, commit: Commit) -> DataFrame | None:
        """What is kept about a table; None for a store that has folders from before it was kept."""
        folders, kept = (commit.tables.get(t, []) for t in (table, BESIDE[table]))
        return None if set(folders) - set(kept) else self._folders(BESIDE[table], kept)

    def lookup(self, doc_id: str, commit: Commit | None = None) -> DataFrame:
        """Revisions of one document (P11). Files whose range of ids leaves it out are not opened.

        A small job asks which files these are: one of every folder, or as many
        as the revisions of the document fill.
        """
        commit = commit or self.current()
        places = self._beside("documents", commit)
        if places is None:
            return by_document(self.read("documents", commit), doc_id)
        held = places.where(F.lit(doc_id).between(F.col("first"), F.col("last")))
        paths = [f"{self.root}/documents/{r['file']}" for r in held.select("file").orderBy("file").collect()]
        schema = f"{DOCUMENTS}, batch bigint"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return self._visible(by_document(rows, doc_id), commit)

    def count_documents(self, approx: bool = False, commit: Commit | None = None) -> DataFrame:
        """Distinct documents (A4); about so many are told from the sketches of the files alone.

        Ids cannot be taken out of a sketch: once documents were removed, the rest are counted.
        """
        commit = commit or self.current()
        places = self._beside("documents", commit) if approx and not commit.tables.get("removed") else None
        if places is None:
            return count_documents(self.read("documents", commit), approx)
        return count_sketched(places)

    def last_seen(self, commit: Commit | None = None) -> DataFrame:
        """When each document was last seen (A6), from a row for each document and batch.

        Once documents were removed, observations are read instead.
        """
        commit = commit or self.current()
        parts = None if commit.tables.get("removed") else self._beside("observations", commit)
        if parts is None:
            return last_seen(self.read("observations", commit))
        return shown_last_seen(merged_latest(parts))

    def search(self, query: Query, commit: Commit | None = None) -> DataFrame:
        """Keys of the matching documents, by the dictionary and from the rarest word on.

        One small job asks the dictionary how frequent the query's words are and
        which files hold them; no other file of the postings is opened.
        """
        commit = commit or self.current()
        terms = self._beside("postings", commit)
        if terms is None:
            return search_postings(self.read("postings", commit), query)
        counts, files = looked_up(terms, query)
        paths = [f"{self.root}/postings/{name}" for name in files]
        rows = self._blocks(paths) if paths else self.spark.createDataFrame([], f"{BLOCKS}, batch bigint")
        return find(self._visible(postings_in(rows, "batch"), commit), counts, query)

    def newest(
        self,
        query: Query | None = None,
        src: str | None = None,
        cursor: Sequence | str | None = None,
        n: int = PAGE,
        commit: Commit | None = None,
    ) -> DataFrame:
        """The newest matching observations, read day by day backwards until there are ``n``.

        The counts by day and source tell how many days hold ``n`` rows, so an
        unfiltered page opens these only. A search, or documents removed since,
        can leave fewer; then twice as many days are read, and in the end all.
        ``cursor`` is the last row of the page before, or its time alone. The
        page is computed before it is returned.
        """
        commit = commit or self.current()
        latest = cursor if isinstance(cursor, str) or cursor is None else cursor[0]
        days = self._days(commit, src, latest)
        hits = None if query is None else self.search(query, commit)
        seen, some = self.read("observations", commit), _enough(days, n, latest)
        while True:
            rows = seen.where(F.col("day").between(days[some - 1][0], days[0][0])) if some else seen.where(F.lit(False))
            found = page(explore_filter(rows, hits, src), cursor, n)
            kept = found.collect()  # n rows at most
            if len(kept) == n or some >= len(days):
                return self.spark.createDataFrame(kept, found.schema)
            some = min(2 * some, len(days))

    def _days(self, commit: Commit, src: str | None, latest: str | None) -> list[tuple[str, int]]:
        """Days that hold rows of a source up to a time, newest first, with their number."""
        rows = self._folders("days", commit.tables.get("days", []))
        if src:
            rows = rows.where(F.col("src") == src)
        if latest:
            rows = rows.where(F.col("day") <= latest[:10])
        return [(r["day"], r["n"]) for r in rows.groupBy("day").agg(F.sum("n").alias("n")).orderBy(F.desc("day")).collect()]

    # ------------------------------------------------------------ changes

    @_again
    def add(
        self,
        parsed: DataFrame,
        index: bool = True,
        cursor: str | None = None,
        stream: tuple[str, int] | None = None,
        skipped: DataFrame | None = None,
    ) -> Commit:
        """Add parsed captures: new revisions, their observations, digests and words.

        ``parsed`` carries the document fields, ``src``, ``digest``, ``url``,
        ``parse_status`` and ``ord``, any value that orders the captures.
        Failed captures go to quarantine and leave their digest unmarked.
        Captures whose digest is stored are left out, so adding a batch twice
        changes nothing. Rows per status are counted, with those of ``skipped``
        (``status``, ``n``). ``stream`` names a stream and its batch.
        """
        now = self.current()
        with Attempt(self, now) as attempt:
            # pages are parsed once, without a shuffle, and all tables are filled from this copy
            staged = attempt.keep("staged", store_spelling(parsed).select(*STAGED))
            good, bad = split_quarantine(staged)
            attempt.write("quarantine", quarantine_rows(bad))
            counted = run_counters(staged, "parse_status")
            attempt.write("counters", counted if skipped is None else counted.unionByName(skipped))

            # stored digests and revisions this batch meets: its own, once each, probe the store
            digests = self.read("processed", now).select("digest")
            met = self._probe(attempt, "met", digests, good, ["digest"])
            fresh = attempt.keep("fresh", first_per_digest(skip_processed(good, met)))
            attempt.drop("staged")
            stored = self.read("documents", now).select(*KEY, "og_title", "og_description")
            known = self._probe(attempt, "known", stored, fresh, KEY)

            # texts are shuffled once in every write, so that no two of their shuffles are there at a time
            new = attempt.keep("new", new_documents(fresh, known).select(*names(DOCUMENTS)))
            fresh = attempt.keep("captures", fresh.drop(*SCALARS))
            attempt.drop("fresh")
            # ranges of ids: a lookup opens the file that can hold its document
            attempt.write("documents", new.repartitionByRange(*SORTED["documents"]))
            attempt.drop("new")
            self._write_beside(attempt, "documents")
            added = self._folders("documents", [attempt.name])
            titles = known.unionByName(added.select(*KEY, "og_title", "og_description"))
            seen = observations(fresh, titles, number=True)
            # a day with many rows gets several tasks, few rows of many days share one
            attempt.write("observations", seen.select(*names(OBSERVATIONS), day().alias("day")).hint("rebalance", "day"))
            written = self._folders("observations", [attempt.name])
            attempt.write("days", written.groupBy("day", "src").agg(F.count(F.lit(1)).alias("n")))
            self._write_beside(attempt, "observations")
            attempt.write("processed", fresh.select("digest"))
            if index:
                self._write_postings(attempt, added, [attempt.name], once=True)
            return attempt.publish(
                cursor=cursor if cursor is not None else now.cursor,
                streams={**now.streams, stream[0]: stream[1]} if stream else now.streams,
                indexed=[*now.indexed, attempt.name] if index else now.indexed,
            )

    def _probe(self, attempt: Attempt, name: str, stored: DataFrame, batch: DataFrame, on: list[str]) -> DataFrame:
        """Stored rows whose key occurs in the batch; none are looked for in a new store."""
        if not attempt.now.tables.get("documents"):
            return stored
        return attempt.keep(name, stored.join(batch.select(*on).distinct(), on, "left_semi"))

    @_again
    def remove(self, keys: DataFrame) -> Commit:
        """Hide documents by key from documents, observations and postings."""
        with Attempt(self, self.current()) as attempt:
            attempt.write("removed", keys.select(*KEY).distinct())
            return attempt.publish()

    def ensure_postings(self) -> Commit:
        """Index the whole store if it has documents but no postings."""
        now = self.current()
        return now if now.indexed else self.extend_index()

    @_again
    def extend_index(self) -> Commit:
        """Index the documents added with ``index=False``; the marker says which folders these are."""
        now = self.current()
        missing = [f for f in now.tables.get("documents", []) if f not in now.indexed]
        if not missing:
            return now
        with Attempt(self, now) as attempt:
            self._write_postings(attempt, self._visible(self._folders("documents", missing), now), missing)
            return attempt.publish(indexed=[*now.indexed, *missing])

    @_again
    def compact(self, table: str) -> Commit:
        """Put the folders of a table into one; rows and what hides them stay as they are.

        Of documents only those folders are joined that are indexed. The old
        folders are no longer listed; readers of earlier commits still find them.
        """
        now = self.current()
        folders = now.tables.get(table, [])
        joined = [f for f in folders if table != "documents" or f in now.indexed]
        if len(joined) < 2:
            return now
        with Attempt(self, now) as attempt:
            attempt.write(table, self._folders(table, joined).repartitionByRange(*SORTED[table]))
            tables = {**now.tables, table: [*(f for f in folders if f not in joined), attempt.name]}
            if table in BESIDE:
                self._write_beside(attempt, table)
                tables[BESIDE[table]] = [*(f for f in now.tables.get(BESIDE[table], []) if f not in joined), attempt.name]
            indexed = now.indexed
            if table == "documents":
                indexed = [*(f for f in indexed if f not in joined), attempt.name]
            return attempt.publish(tables=tables, indexed=indexed)

    # ------------------------------------------------------------ cursor

    def read_cursor(self) -> str | None:
        """Start of the last collection, NULL before the first."""
        return self.current().cursor

    @_again
    def write_cursor(self, ts: str) -> Commit:
        with Attempt(self, self.current()) as attempt:
            return attempt.publish(cursor=ts)


def _cuts(docs: DataFrame, n: int) -> list[str]:
    """Words that cut postings into at most ``n`` ranges of about the same size, as some of the documents show."""
    if n < 2:
        return []
    some = docs.sample(min(1.0, SHOWN_DOCUMENTS / max(1, docs.count())), 0)
    words = build_blocks(some, True).select("term", F.explode("docs"))
    shown = sorted(r["term"] for r in words.select("term", F.rand(0).alias("_at")).orderBy("_at").limit(SHOWN_WORDS).collect())
    return sorted({shown[k * len(shown) // n] for k in range(1, n)}) if shown else []


def day() -> Column:
    """The day of an observation; it sorts as the time does, which is compared as text."""
    head = F.substring("ts", 1, 10)
    return F.when(F.coalesce(head, F.lit("")) == "", NO_DAY).otherwise(head)


def _enough(days: list[tuple[str, int]], n: int, latest: str | None) -> int:
    """How many days, from the newest on, hold ``n`` rows; the day of ``latest`` may hold none before it."""
    held = 0
    for k, (name, rows) in enumerate(days, 1):
        held += 0 if latest and name == latest[:10] else rows
        if held >= n:
            return k
    return len(days)


def quarantine_rows(bad: DataFrame) -> DataFrame:
    """Captures set aside, in the shape of the quarantine table."""
    return bad.select(
        F.col("src").alias("origin"),
        F.col("digest").alias("key"),
        "url",
        F.col("parse_status").alias("status"),
        F.col("id").alias("detail"),
    )


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]
