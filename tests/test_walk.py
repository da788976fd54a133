"""Paging to the short page, sources as JSON text, counters in flight, days read backwards, tasks by bytes, a running poll."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from vellum.operators import explore, filters
from vellum.operators.search import term
from vellum.sources import archive
from vellum.sources.scans import parse_scan_lines, stream_scans
from vellum.sources.store import NO_DAY, Store, _enough
from vellum.streaming.collect import collect_scans

from test_extract import BODY, DCT, END, HEAD, TIME
from test_filters import D
from test_fold import captures, row
from test_store import SCAN


def scans(spark, keys):
    rows = [(str(i), key) for i, key in enumerate(keys)]
    return spark.createDataFrame(rows, "scan_id string, sort_key struct<ts: bigint, id: string>")


@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 730])
def test_a_walk_to_the_short_page(spark, n):
    rng = random.Random(n)
    keys = [(rng.randint(1, 40), f"s{k:04d}") for k in range(n)] + [None] * 5
    table = scans(spark, keys).repartition(6)
    pages = explore.scan_pages(table)
    assert pages.columns == ["scan_id", "sort_key", "page", "place"]
    got = {(r["page"], r["place"]): tuple(r["sort_key"]) for r in pages.collect()}
    order = sorted((k for k in keys if k), reverse=True)
    assert got == {divmod(i, 100): key for i, key in enumerate(order)}
    ends = {r["page"]: r for r in explore.page_ends(pages).collect()}
    # page by page, each from where the one before ended
    after, walked = None, 0
    while True:
        page = explore.search_after(table, after).collect()
        assert [tuple(r["sort_key"]) for r in page] == order[100 * walked : 100 * walked + 100]
        if page:
            assert ends[walked]["rows"] == len(page)
        if len(page) < 100:
            assert not page or ends[walked]["search_after"] is None
            break
        after = tuple(ends[walked]["search_after"])
        walked += 1
    assert len(ends) == -(-n // 100)


def test_sources_as_json_text(spark):
    texts = [
        '[{"src":"a","id":"1","ts":"t1"},{"src":"b","id":null},7,{"src":{"x":1},"ts":5}]',
        "[]",
        '[{"src":"a"',
        "{}",
        "no json",
        "",
        None,
    ]
    docs = spark.createDataFrame([("D", k, t) for k, t in enumerate(texts)], "id string, revision bigint, sources string")
    rows = [tuple(r) for r in explore.explode_json_sources(docs).orderBy("revision", "ord").collect()]
    assert rows == [
        ("D", 0, "a", "1", "t1", 0),
        ("D", 0, "b", None, None, 1),
        ("D", 0, None, None, None, 2),
        ("D", 0, '{"x":1}', None, "5", 3),
    ]


def test_counters_in_flight(spark, tmp_path):
    statuses = ["export"] * 5 + ["candidate"] * 3 + ["processed", "unheard of", None]
    rows = spark.createDataFrame([(s, i) for i, s in enumerate(statuses)], "status string, i int").repartition(3)
    observation = Observation()
    kept = filters.observe_counters(rows, observation).where("status = 'candidate'")
    kept.write.parquet(str(tmp_path / "kept"))
    counted = {r["status"]: r["n"] for r in filters.observed_counters(spark, observation).collect()}
    assert counted == {"export": 5, "candidate": 3, "processed": 1, "other": 2}


def seen(k, day, src="s", words="word"):
    values = list(row(f"D{k:03d}", 1, words, src, k))
    values[12] = f"2026-01-{day:02d}T00:00:{k % 60:02d}Z" if day else ""
    return tuple(values)


def test_how_many_days_hold_a_page():
    days = [("2026-01-05", 3), ("2026-01-04", 0), ("2026-01-03", 10), (NO_DAY, 1)]
    assert _enough(days, 3, None) == 1 and _enough(days, 4, None) == 3
    assert _enough(days, 3, "2026-01-05T09:00:00Z") == 3 and _enough(days, 99, None) == 4 and _enough([], 1, None) == 0


def read_days(df):
    """Days the observations of a plan were read from."""
    return {r[0] for r in df.select(F.regexp_extract(F.input_file_name(), "day=([^/]+)", 1)).distinct().collect()}


def test_the_newest_days_are_read_first(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    rows = [seen(k, 1 + k % 9, "urlscan" if k % 2 else "manual", f"word{k % 3}") for k in range(90)] + [seen(95, 0)]
    store.add(captures(spark, rows[:50]))
    store.add(captures(spark, rows[50:]))
    used = []
    read = Store.read

    def watched(self, table, commit=None):
        found = read(self, table, commit)
        return Watched(found) if table == "observations" else found

    class Watched:
        def __init__(self, df):
            self.df = df

        def where(self, condition):
            used.append(read_days(kept := self.df.where(condition)))
            return kept

    everything = store.read("observations")
    monkeypatch.setattr(Store, "read", watched)

    def check(wanted, n, days, **options):
        used.clear()
        found = store.newest(n=n, **options).collect()
        assert [tuple(r) for r in found] == [tuple(r) for r in wanted.collect()]
        assert used == days

    d = [f"2026-01-{k:02d}" for k in range(9, 0, -1)]
    check(explore.explore(everything, n=10), 10, [{d[0]}])
    check(explore.explore(everything, n=11), 11, [{*d[:2]}])
    check(explore.explore(everything, src="urlscan", n=10), 10, [{*d[:2]}], src="urlscan")
    check(explore.explore(everything, ts="2026-01-07T00:00:30Z", n=10), 10, [{*d[2:4]}], cursor="2026-01-07T00:00:30Z")
    # a search leaves fewer rows: twice as many days, until there are enough
    hits = store.search(term("word0"))
    check(explore.explore(everything, hits, n=10), 10, [{d[0]}, {*d[:2]}, {*d[:4]}], query=term("word0"))
    check(explore.explore(everything, n=1000), 1000, [{*d, NO_DAY}])
    store.remove(spark.createDataFrame([(f"D{k:03d}", 1) for k in range(90) if 1 + k % 9 == 9], "id string, revision bigint"))
    monkeypatch.setattr(Store, "read", read)
    left = store.read("observations")
    assert [tuple(r) for r in store.newest(n=5).collect()] == [tuple(r) for r in explore.explore(left, n=5).collect()]


def test_pages_follow_one_another(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.add(captures(spark, [seen(k, 1 + k % 3) for k in range(40)]))
    walked, cursor = [], None
    while page := store.newest(cursor=cursor, n=7).collect():
        walked += page
        cursor = [page[-1][c] for c in explore.ORDER]
    assert [tuple(r) for r in walked] == [tuple(r) for r in explore.explore(store.read("observations"), n=99).collect()]


def test_tasks_by_bytes(spark):
    rng = random.Random(1)
    stretch = 1 << 20
    rows = [("hot.gz", str(k * 1000), "1000") for k in range(20_000)]
    rows += [(f"f{k % 40}.gz", str(rng.randrange(5 * stretch)), str(rng.randrange(200_000))) for k in range(400)]
    rows += [("f1.gz", "x", "10"), (None, "0", None), ("f2.gz", "0", "-5")]
    index = spark.createDataFrame(rows, "filename string, offset string, length string").repartition(5)
    ranged = archive.byte_range(index)
    size = 2 * stretch
    bins, n = archive.bins_by_bytes(ranged, size, stretch)
    placed = {(r["file"], r["stretch"]): r["bin"] for r in bins.collect()}
    weights, stretches = {}, {}
    for r in ranged.collect():
        key = (r["filename"], (r["offset"] or 0) // stretch)
        weights[placed[key]] = weights.get(placed[key], 0) + max(r["length"] or 0, 0)
        stretches[key] = stretches.get(key, 0) + max(r["length"] or 0, 0)
    assert sorted(set(placed.values())) == list(range(n))
    assert max(weights.values()) < size + max(stretches.values())
    assert n >= sum(weights.values()) // (size + max(stretches.values()))


def test_a_poll_that_runs_stops_and_goes_on(spark, tmp_path):
    store, landing, checkpoint = Store(spark, str(tmp_path / "store")), tmp_path / "landing", str(tmp_path / "progress")
    landing.mkdir()
    page = HEAD + DCT + TIME + BODY + END
    doms = spark.createDataFrame([(f"s{k}", page) for k in range(4)] + [("bad", "<p>nothing</p>")], "id string, html string")

    def land(name, *ids):
        (landing / name).write_text("\n".join(SCAN % (s, "public", f"{D}X{s}/edit", 1767323045000, s) for s in ids))

    def poll():
        return collect_scans(stream_scans(spark, str(landing)), doms, store, checkpoint, "1 second")

    land("one", "s0")
    running = poll()
    running.processAllAvailable()
    land("two", "s1", "bad")  # while it runs
    running.processAllAvailable()
    assert [p["batchId"] for p in running.recentProgress if p["numInputRows"]] == [0, 1]
    running.stop()
    before = store.read_cursor()
    land("three", "s2", "s0")
    running = poll()
    running.processAllAvailable()
    assert [p["batchId"] for p in running.recentProgress if p["numInputRows"]] == [2]
    running.stop()
    assert sorted(r["sid"] for r in store.read("observations").collect()) == ["s0", "s1", "s2"]
    # the page that is no document is set aside, and the poll goes on
    assert [(r["key"], r["status"]) for r in store.read("quarantine").collect()] == [("bad", "empty_document")]
    assert int(store.read_cursor()) > int(before) and store.current().streams and max(store.current().streams.values()) == 2
    assert parse_scan_lines(spark.read.text(str(landing))).count() == 5
