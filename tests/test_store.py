import os
import time

import pytest
from pyspark.sql import functions as F

from vellum.operators import explore, fold
from vellum.operators.search import build_postings, phrase, search_postings, term
from vellum.plans.collect import folder_captures, scan_captures
from vellum.sources import folder as folder_module
from vellum.sources.folder import read_html_folder
from vellum.sources.scans import read_scans, stream_scans
from vellum.sources import store as store_module
from vellum.sources.store import Attempt, Conflict, Store
from vellum.streaming.collect import apply_batch, collect_scans

from test_extract import BODY, DCT, END, HEAD, TIME
from test_filters import D
from test_fold import captures, row


def state(store):
    listed = fold.nest_sources(store.read("observations"), ["batch", "ord"])
    docs = fold.attach_sources(store.read("documents"), listed).collect()
    return sorted((r["id"], r["revision"], r["og_title"], [tuple(s) for s in r["sources"]]) for r in docs)


BATCH = [row("A", 1, "a", "s", 1), row("B", 1, "b", "s", 2), row("A", 1, "late", "s", 3), row("C", 1, "c", "s", 4, digest="d1")]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_batches_add_up_and_repeat_without_effect(spark, store, tmp_path):
    store.add(captures(spark, BATCH[:2]))
    store.add(captures(spark, BATCH[2:]))
    once = Store(spark, str(tmp_path / "once"))
    once.add(captures(spark, BATCH))
    assert state(store) == state(once) == [
        ("A", 1, "a", [("s", "p1", row("A", 1, "a", "s", 1)[12]), ("s", "p3", row("A", 1, "a", "s", 1)[12])]),
        ("B", 1, "b", [("s", "p2", row("A", 1, "a", "s", 1)[12])]),
    ]
    before = {t: store.read(t).count() for t in ("documents", "observations", "processed", "postings")}
    store.add(captures(spark, BATCH))
    assert {t: store.read(t).count() for t in before} == before
    # a later title of a stored revision is neither shown nor indexed
    assert {r["og_title"] for r in store.read("observations").where("id = 'A'").collect()} == {"a"}
    assert search_postings(store.read("postings"), term("late")).count() == 0
    assert search_postings(store.read("postings"), term("b")).first()["id"] == "B"


def test_a_failed_capture_leaves_its_digest_free(spark, store):
    failed = list(row("A", 1, "a", "s", 1, digest="d"))
    failed[15] = "no_created"
    store.add(captures(spark, [tuple(failed), row("A", 1, "kept", "s", 2, digest="d")]))
    assert [x[2] for x in state(store)] == ["kept"]
    assert [(r["key"], r["status"]) for r in store.read("quarantine").collect()] == [("d", "no_created")]


def test_removed_documents_may_return(spark, store):
    store.add(captures(spark, BATCH[:2]))
    store.remove(spark.createDataFrame([("A", 1)], "id string, revision bigint"))
    assert [x[0] for x in state(store)] == ["B"]
    assert search_postings(store.read("postings"), term("a")).count() == 0
    store.add(captures(spark, [row("A", 1, "again", "s", 9)]))
    assert [(x[0], x[2], len(x[3])) for x in state(store)] == [("A", "again", 1), ("B", "b", 1)]
    assert explore.explore(store.read("observations")).count() == 2


def test_postings_are_built_when_missing(spark, store):
    store.add(captures(spark, BATCH[:1]), index=False)
    assert store.read("postings").count() == 0
    store.ensure_postings()
    assert search_postings(store.read("postings"), term("a")).count() == 1
    version = store.current().version
    assert store.ensure_postings().version == version
    store.add(captures(spark, BATCH[1:2]), index=False)
    store.extend_index()
    assert search_postings(store.read("postings"), term("b")).count() == 1


def test_files_hold_the_documents_of_a_word_together(spark, store):
    """A row for each word and document was sorted, written and counted before."""
    store.add(captures(spark, [row(f"{k:03d}", 1, "the end", "s", k + 1) for k in range(200)]))
    paths = [store.folder("postings", f) for f in store.current().tables["postings"]]
    blocks = spark.read.parquet(*paths).where("term = 'the' and col = 'title'")
    assert blocks.count() <= 20 and blocks.agg(F.sum("n")).first()[0] == 200
    assert store.read("postings").where("term = 'the' and col = 'title'").count() == 200
    assert blocks.where("first <> docs[0].id or n <> size(docs)").count() == 0


def test_postings_from_before_there_were_blocks(spark, store):
    def words():
        return sorted(map(tuple, store.read("postings").drop("batch").collect()))

    store.add(captures(spark, BATCH[:1]), index=False)
    now = store.current()
    with Attempt(store, now) as attempt:
        attempt.write("postings", build_postings(store.read("documents", now)))
        attempt.publish(indexed=now.tables["documents"])
    old = words()
    assert ("a", "title", "A", 1, [0]) in old and store.search(phrase("a")).count() == 1
    store.add(captures(spark, BATCH[1:]))
    assert all(r in words() for r in old) and store.search(phrase("b")).count() == 1
    before = words()
    store.compact("postings")
    assert words() == before
    found = {(r["term"], r["col"]): (r["n"], r["occurrences"]) for r in store.read("terms").collect()}
    assert found["a", "title"] == found["b", "title"] == (1, 1)
    assert store.search(phrase("a")).count() == store.search(phrase("b")).count() == 1


@pytest.fixture
def many_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with batches of many files
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_lookup_opens_the_file_of_its_document(spark, store, many_files):
    batches = [[row(f"{k:04d}", b, f"t{b}", "s", k + 1, digest=f"{b}-{k}") for k in range(400)] for b in (1, 2)]
    for batch in batches:
        store.add(captures(spark, batch), index=False)
    whole, found = store.read("documents").inputFiles(), store.lookup("0123")
    assert len(whole) >= 8 and len(found.inputFiles()) == 2  # one of each batch
    assert sorted((r["id"], r["revision"], r["og_title"]) for r in found.collect()) == [("0123", 1, "t1"), ("0123", 2, "t2")]
    assert store.lookup("zzz").count() == 0 and store.lookup("").count() == 0
    store.remove(spark.createDataFrame([("0123", 1)], "id string, revision bigint"))
    assert [r["revision"] for r in store.lookup("0123").collect()] == [2]


def test_revisions_of_a_hot_document_fill_several_files(spark, store, many_files):
    store.add(captures(spark, [row("A", k, f"t{k}", "s", k + 1) for k in range(300)] + [row("B", 1, "b", "s", 999)]), index=False)
    assert len(store.lookup("A").inputFiles()) > 1
    assert [r["revision"] for r in store.lookup("A").orderBy("revision").collect()] == list(range(300))
    assert [r["og_title"] for r in store.lookup("B").collect()] == ["b"]


def asked(store):
    n = [store.count_documents(a).first()["documents"] for a in (False, True)]
    return n, sorted(tuple(r) for r in store.last_seen().collect()), sorted(r["revision"] for r in store.lookup("A").collect())


def test_sketches_and_latest_times_follow_batches_compaction_and_removals(spark, store):
    assert asked(store) == ([0, 0], [], [])
    early, late = "2026-01-02T03:04:05Z", "2026-03-02T03:04:05Z"

    def at(ts, *batch):
        return captures(spark, batch).withColumn("timestamp", F.lit(ts))

    store.add(at(late, row("A", 1, "a", "s", 1), row("B", 1, "b", "s", 2)), index=False)
    store.add(at(early, row("A", 2, "a2", "s", 3), row("B", 1, "b", "s", 4), row("C", 1, "c", "s", 5)), index=False)
    store.add(at("soon", row("D", 1, "d", "s", 6)), index=False)
    # the latest revision counts, however old its observation
    expected = ([4, 4], [("A", early), ("B", late), ("C", early), ("D", explore.NEVER)], [1, 2])
    assert asked(store) == expected
    store.ensure_postings()
    for table in ("documents", "observations"):
        store.compact(table)
    assert asked(store) == expected and len(store.current().tables["places"]) == len(store.current().tables["latest"]) == 1
    store.remove(spark.createDataFrame([("A", 2), ("C", 1)], "id string, revision bigint"))
    assert asked(store) == ([3, 3], [("A", late), ("B", late), ("D", explore.NEVER)], [1])


def test_a_store_from_before_the_small_tables_answers_too(spark, store):
    store.add(captures(spark, BATCH[:2]), index=False)
    now = store.current()
    old = {t: f for t, f in now.tables.items() if t not in ("places", "latest")}
    with Attempt(store, now) as attempt:
        attempt.publish(tables=old)
    before = asked(store)
    store.add(captures(spark, BATCH[2:]), index=False)
    assert before[0] == [2, 2] and asked(store) == before


def counts(store):
    return {t: store.read(t).count() for t in ("documents", "observations", "processed", "postings", "quarantine")}


LATER = {
    "cursor": lambda store, batch: store.write_cursor("1"),
    "remove": lambda store, batch: store.remove(store.spark.createDataFrame([("Z", 1)], "id string, revision bigint")),
    "index": lambda store, batch: store.extend_index(),
    "postings": lambda store, batch: store.ensure_postings(),
    "add": lambda store, batch: store.add(batch),
}


@pytest.mark.parametrize("broken", ["quarantine", "counters", "documents", "places", "observations", "latest", "processed", "postings", "marker"])
def test_an_attempt_that_breaks_off_is_never_seen(spark, store, tmp_path, monkeypatch, broken):
    batch = captures(spark, BATCH[1:])
    store.add(captures(spark, BATCH[:1]))
    now = store.current()
    write, publish = Attempt.write, Store.publish

    def dying_write(self, table, rows):
        write(self, table, rows)
        if table == broken:
            raise RuntimeError("broken off")

    def dying_publish(self, commit):
        raise RuntimeError("broken off")

    with monkeypatch.context() as patch:
        patch.setattr(Attempt, "write", dying_write)
        if broken == "marker":
            patch.setattr(Store, "publish", dying_publish)
        with pytest.raises(RuntimeError):
            store.add(batch)
    assert store.current() == now
    before = counts(store)
    for change in list(LATER)[:-1]:
        LATER[change](store, batch)
        assert counts(store) == before, change
    store.add(batch)
    once = Store(spark, str(tmp_path / "once"))
    once.add(captures(spark, BATCH))
    assert state(store) == state(once) and counts(store) == counts(once)


def test_the_second_of_two_writers_fails_and_changes_nothing(spark, store):
    store.add(captures(spark, BATCH[:1]))
    mine = Attempt(store, store.current())
    store.add(captures(spark, BATCH[1:2]))
    mine.write("documents", store.read("documents").drop("batch"))
    before = counts(store)
    with pytest.raises(RuntimeError):
        mine.publish()
    assert counts(store) == before and [x[0] for x in state(store)] == ["A", "B"]


@pytest.mark.parametrize("change", ["cursor", "remove", "index", "add"])
def test_a_batch_committed_while_another_change_starts_stays(spark, store, monkeypatch, change):
    """Another writer commits after a change has read what is current and before it takes a number."""
    store.add(captures(spark, BATCH[:1]), index=False)
    current, other = Store.current, Store(spark, store.root)
    waiting = [captures(spark, BATCH[1:2])]

    def interrupted(self):
        now = current(self)
        if self is store and waiting:
            other.add(waiting.pop())
        return now

    monkeypatch.setattr(Store, "current", interrupted)
    LATER[change](store, captures(spark, [row("C", 1, "c", "s", 9)]))
    expected = ["A", "B", "C"] if change == "add" else ["A", "B"]
    assert not waiting and [x[0] for x in state(store)] == expected
    assert store.read("processed").count() == len(expected) and store.current().version == 3


def test_a_writer_that_is_always_late_gives_up(spark, store, monkeypatch):
    current, other = Store.current, Store(spark, store.root)

    def interrupted(self):
        now = current(self)
        if self is store:
            other.write_cursor(str(now.version))
        return now

    monkeypatch.setattr(Store, "current", interrupted)
    with pytest.raises(Conflict):
        store.write_cursor("mine")
    assert other.read_cursor() == str(store_module.TRIES - 1)


def test_an_unfinished_marker_is_passed_over(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "UNFINISHED_SECONDS", 0.3)
    store.add(captures(spark, BATCH[:1]))
    (tmp_path / "store" / "commits" / f"{2:012d}.json").write_text('{"version": 2, "tab')
    assert store.current().version == 1 and [x[0] for x in state(store)] == ["A"]
    assert store.add(captures(spark, BATCH[1:2])).version == 3
    assert [x[0] for x in state(store)] == ["A", "B"]


def test_compaction_keeps_rows_and_removals(spark, store):
    store.add(captures(spark, BATCH[:1]))
    store.remove(spark.createDataFrame([("A", 1)], "id string, revision bigint"))
    store.add(captures(spark, [row("A", 1, "again", "s", 9)]))
    store.add(captures(spark, BATCH[1:2]), index=False)
    before = state(store), counts(store)
    for table in ("documents", "observations", "processed", "postings", "quarantine"):
        store.compact(table)
    assert (state(store), counts(store)) == before
    tables = store.current().tables
    assert [len(tables[t]) for t in ("documents", "observations", "processed", "postings")] == [2, 1, 1, 1]
    store.extend_index()
    assert search_postings(store.read("postings"), term("b")).count() == 1
    assert search_postings(store.read("postings"), term("again")).count() == 1


def test_tables_without_a_key_are_joined_too(spark, store):
    failed = [list(row("A", 1, "a", "s", k, digest=f"d{k}")) for k in (1, 2)]
    for values in failed:
        values[15] = "no_created"
        store.add(captures(spark, [tuple(values)]))
    for table in ("quarantine", "counters"):
        before = sorted(map(tuple, store.read(table).collect()))
        store.compact(table)
        assert sorted(map(tuple, store.read(table).collect())) == before and len(store.current().tables[table]) == 1


def test_intermediate_results_go(spark, store, tmp_path):
    store.add(captures(spark, BATCH))
    assert list((tmp_path / "store" / "work").iterdir()) == []


def test_intermediate_results_go_when_nothing_reads_them_any_more(spark, store, tmp_path, monkeypatch):
    """Copies of the texts lay there until the change ended."""
    kept = {}

    def looked(name):
        before = getattr(Store, name)

        def made(self, attempt, *args, **options):
            kept.setdefault(name, {p.name for p in (tmp_path / "store" / "work").glob("*/*")})
            return before(self, attempt, *args, **options)

        return made

    for name in ("_write_postings", "_write_beside"):
        monkeypatch.setattr(Store, name, looked(name))
    store.add(captures(spark, BATCH))
    assert kept == {"_write_beside": {"captures"}, "_write_postings": {"captures"}}


def test_shuffles_go_when_a_write_ends(spark, store):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {os.path.basename(f) for f in files.mkString("\n").split("\n") if "shuffle_" in f}

    spark.conf.set(store_module.DROP_SHUFFLED, "false")
    before = shuffled()
    rows = spark.range(1000).repartition(4, "id")
    with Attempt(store, store.current()) as attempt:
        attempt.keep("rows", rows)
        attempt.write("counters", rows.select(F.lit("x").alias("status"), F.col("id").alias("n")))
        attempt.publish()
        until = time.monotonic() + 20
        while (left := shuffled() - before) and time.monotonic() < until:
            time.sleep(0.2)
    assert not left
    assert spark.conf.get(store_module.DROP_SHUFFLED) == "false"
    assert store.read("counters").count() == 1000


def test_postings_written_in_slices_are_the_same(spark, tmp_path, monkeypatch):
    """All of them were in one shuffle, which took several times the room of the files."""
    rows = [row(f"{k:03d}", 1, f"the w{k % 17} {'é' * (k % 3)} x{k}", "s", k + 1) for k in range(120)]
    found, slices = [], []
    monkeypatch.setattr(store_module, "SHOWN_WORDS", 90)
    for size in (store_module.SLICE_BYTES, 1024):
        monkeypatch.setattr(store_module, "SLICE_BYTES", size)
        store = Store(spark, str(tmp_path / str(size)))
        write = Attempt.write
        monkeypatch.setattr(Attempt, "write", lambda self, table, some: (slices.append(some) if table == "postings" else None, write(self, table, some)))
        store.add(captures(spark, rows))
        monkeypatch.setattr(Attempt, "write", write)
        words = sorted(map(tuple, store.read("postings").drop("batch").collect()))
        terms = sorted(map(tuple, store.read("terms").groupBy("term", "col").agg(F.sum("n"), F.sum("occurrences")).collect()))
        hits = [sorted(map(tuple, store.search(q).collect())) for q in (phrase("the w3"), term("x7"), phrase("nowhere"))]
        found.append((words, terms, hits))
    assert found[0] == found[1] and found[0][2][0] and found[0][2][1] == [("007", 1)]
    assert len(slices) > 3  # one of the first store
    paths = [store.folder("postings", f) for f in store.current().tables["postings"]]
    files = spark.read.parquet(*paths).groupBy(F.input_file_name().alias("file")).agg(F.min("term").alias("a"), F.max("term").alias("b"))
    ranges = sorted((r["a"], r["b"]) for r in files.collect())
    assert all(b <= c for (_, b), (c, _) in zip(ranges, ranges[1:]))


def test_cursor_and_replay(spark, store):
    assert store.read_cursor() is None
    store.write_cursor("1")
    apply_batch(store, captures(spark, BATCH[:1]), "s", 0)
    apply_batch(store, captures(spark, BATCH[1:2]), "s", 0)
    assert [x[0] for x in state(store)] == ["A"] and store.read_cursor() == "1"
    apply_batch(store, captures(spark, BATCH[1:2]), "s", 1)
    assert [x[0] for x in state(store)] == ["A", "B"]
    # another stream starts at 0 too
    apply_batch(store, captures(spark, [row("Z", 1, "z", "s", 20)]), "t", 0)
    assert [x[0] for x in state(store)] == ["A", "B", "Z"] and store.current().streams == {"s": 1, "t": 0}


SCAN = '{"_id": "%s", "task": {"time": "2026-01-02T03:04:05Z", "visibility": "%s"}, "page": {"url": "%s"}, "sort": [%d, "%s"]}'


def test_scan_stream(spark, store, tmp_path):
    page = HEAD + DCT + TIME + BODY + END
    doms = spark.createDataFrame([("s1", page), ("s2", "<p>"), ("s4", page), ("s5", page)], "id string, html string")
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "progress")
    landing.mkdir()

    def land(name, *scans):
        (landing / name).write_text("\n".join(SCAN % (s, v, u, 1767323045000, s) for s, v, u in scans))
        collect_scans(stream_scans(spark, str(landing)), doms, store, checkpoint, None).awaitTermination()

    land("one", ("s1", "public", D + "X/edit"), ("s2", "public", D + "Y/edit"), ("s3", "public", D + "Z/edit"), ("s4", "private", D + "P/edit"))
    assert [x[:2] for x in state(store)] == [("X", 7)]
    version = store.current().version
    land("two", ("s5", "public", D + "X/edit"), ("s1", "public", D + "X/edit"))
    assert store.current().version == version + 1
    assert [(x[0], [s[1] for s in x[3]]) for x in state(store)] == [("X", ["s1", "s5"])]
    assert sorted((r["key"], r["status"]) for r in store.read("quarantine").collect()) == [("s2", "empty_document"), ("s3", "fetch_failed")]
    store.add(scan_captures(read_scans(spark, str(landing)), doms))
    assert store.read("observations").count() == 2


def test_folder(spark, store, tmp_path):
    page = HEAD + DCT + TIME + BODY + END
    for name, text in (("b.html", page.replace("Hello", "second")), ("a.html", page), ("c.html", "<p>"), ("d.txt", page)):
        (tmp_path / name).write_text(text)
    store.add(folder_captures(read_html_folder(spark, str(tmp_path)), "folder"))
    docs = store.read("documents").collect()
    assert [(r["id"], r["content"]) for r in docs] == [("ID1", "Hello")]
    assert [r["status"] for r in store.read("quarantine").collect()] == ["empty_document"]
    seen = store.read("observations").first()
    assert (seen["src"], seen["sid"], seen["ts"]) == ("folder", "manual", "2026-02-04T23:19:13Z")


def test_folder_is_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The driver held every name, and a task got a few files only."""
    root = tmp_path / "a folder %41"
    (root / "sub").mkdir(parents=True)
    (root / "k=1").mkdir()
    contents = {f"p{k:03d}.html": f"<p>{k}</p>" for k in range(60)} | {"e.html": "e", "empty.html": "", "ü #%.html": "é", ".h.html": "x", "_h.html": "x", "a.txt": "x", "sub/s.html": "x"}
    for name, text in contents.items():
        (root / name).write_text(text)
    (root / "bad.html").write_bytes(b"a\xff\x00b")
    files = lambda path, *pattern: sorted(map(tuple, read_html_folder(spark, path, *pattern).collect()))
    monkeypatch.setattr(folder_module, "NAMES_TOGETHER", 7)
    monkeypatch.setattr(folder_module, "BATCH_BYTES", 20)
    given = read_html_folder(spark, str(root))
    assert "BinaryFile" not in given._jdf.queryExecution().toString() and given.inputFiles() == []
    made = [files(str(root)), files(f"file:{root}/"), files(str(root), "{e,p00[^1-9]}.html")]
    monkeypatch.setattr(folder_module, "_folder", lambda spark, path: None)  # Spark's own reader
    assert made == [files(str(root)), files(f"file:{root}/"), files(str(root), "{e,p00[^1-9]}.html")]
    assert len(made[0]) == 63 and len(made[2]) == 2


def test_what_is_not_one_folder_is_left_to_spark(spark, tmp_path):
    for name in ("a.html", "b.html"):
        (tmp_path / name).write_text(name)
    found = lambda path: sorted(r["html"] for r in read_html_folder(spark, path).collect())
    assert found(f"{tmp_path}/a.html") == ["a.html"]
    assert found(f"{tmp_path}/[ab].html") == found(str(tmp_path)) == ["a.html", "b.html"]
    (tmp_path / "empty").mkdir()
    assert found(str(tmp_path / "empty")) == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        found(str(tmp_path / "none"))


def test_no_text_moves_for_a_digest_of_it(spark, tmp_path):
    """Texts of all files were shuffled to choose the first of a revision."""
    page = HEAD + DCT + TIME + BODY + END
    for name, text in (("b.html", page.replace("Hello", "second")), ("a.html", page), ("c.html", "<p>")):
        (tmp_path / name).write_text(text)
    files = read_html_folder(spark, str(tmp_path))
    made = folder_captures(files, also={"text_md5": F.md5("content")})
    found = sorted(made.select("id", "parse_status", "text_md5", F.md5("content")).collect())
    assert [(r[0], r[1]) for r in found] == [("", "empty_document"), ("ID1", "ok")] and all(r[2] == r[3] for r in found)
    assert folder_captures(files).columns == [c for c in made.columns if c != "text_md5"]
    node = made.select("id", "text_md5")._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Window":
        node = node.children().head()
    moved = node.children().head().output().mkString(",")
    assert "text_md5#" in moved and "content#" not in moved
