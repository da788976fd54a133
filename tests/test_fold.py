import random

from vellum.operators import explore, fold
from vellum.operators.skew import first_per
from vellum.sources import exports

SCHEMA = (
    "id string, revision bigint, created string, page_title string, og_title string, og_description string, "
    "og_image string, content string, links array<string>, image_urls array<string>, src string, "
    "provenance string, timestamp string, digest string, url string, parse_status string, ord bigint"
)
T = "2026-01-02T00:00:00Z"


def row(doc, revision, title, src, ord, ts=T, digest=None):
    return (doc, revision, T, title, title, "", "", f"text {title}", [], [], src, f"p{ord}", ts, digest or f"d{ord}", "", "ok", ord)


def captures(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_first_title_wins_and_sources_stay_in_order(spark):
    rows = [row("A", 1, "third", "s1", 3), row("A", 1, "first", "s1", 1), row("A", 1, "second", "s2", 2), row("B", 1, "b", "s1", 4, "2026-01-02T00:00:00.5Z")]
    docs = {r["id"]: r for r in fold.fold_observations(captures(spark, rows)).collect()}
    assert docs["A"]["og_title"] == "first"
    assert [s["src"] for s in docs["A"]["sources"]] == ["s1", "s2", "s1"]
    seen = explore.explode_sources(fold.fold_observations(captures(spark, rows)))
    page = explore.explore(seen, src="s1", ts="2026-01-03").collect()
    assert [r["id"] for r in page] == ["A", "A", "B"]


def test_old_rows_come_first(spark):
    old = captures(spark, [row("A", 1, "old", "s1", 9)])
    new = captures(spark, [row("A", 1, "new", "s2", 1), row("A", 2, "other", "s2", 2)])
    docs = {r["revision"]: r for r in fold.fold_observations(new, old).collect()}
    assert docs[1]["og_title"] == "old" and [s["src"] for s in docs[1]["sources"]] == ["s1", "s2"]
    assert docs[2]["og_title"] == "other"


def test_a_hot_revision_goes_on_in_parts(spark):
    rows = [row("H", 1, f"h{i}", f"s{i % 3}", i * 5000) for i in range(300)]
    rows += [row(f"C{i % 20}", 1, "c", "s", 1_600_000 + i) for i in range(100)]
    docs = fold.fold_observations(captures(spark, rows), chunk=50).collect()
    hot = sorted((r for r in docs if r["id"] == "H"), key=lambda r: r["part"])
    assert [r["part"] for r in hot] == list(range(6))
    assert [s["id"] for r in hot for s in r["sources"]] == [f"p{i * 5000}" for i in range(300)]
    assert [r["og_title"] for r in hot] == ["h0"] * 6
    assert sorted((r["part"], len(r["sources"])) for r in docs if r["id"] != "H") == [(0, 5)] * 20


def test_digests_and_revisions_keep_their_first(spark):
    rows = [row("A", 1, "x", "s", 2, digest="d"), row("B", 1, "y", "s", 1, digest="d"), row("B", 1, "z", "s", 3)]
    assert sorted(r["ord"] for r in fold.first_per_digest(captures(spark, rows)).collect()) == [1, 3]
    assert sorted(r["ord"] for r in fold.first_per_revision(captures(spark, rows)).collect()) == [1, 2]


def test_ranking_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as ord")
    plan = first_per(df, ["k"], ["ord"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_exports(spark, tmp_path):
    rows = captures(spark, [row("A", 1, 'a "q"', "s", 1), row("A", 1, "x", "s", 2)])
    docs = fold.new_documents(rows)
    seen = fold.observations(rows, docs)
    exports.export_ndjson(explore.explore(seen), str(tmp_path / "rows"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "rows").glob("part-*")))
    line = '{"timestamp":"%s","source":"s","id":"A","title":"a \\"q\\"","snippet":"","revision":"1"}\r\n' % T
    assert text == line * 2
    exports.export_ndjson(explore.explore(seen, src="none"), str(tmp_path / "none"))
    assert "".join(p.read_bytes().decode() for p in (tmp_path / "none").glob("part-*")) == "no data\r\n"
    exports.export_document_pages(explore.document_pages(docs, seen, fold.nest_sources(seen)), str(tmp_path / "pages"))
    page = "".join(p.read_text() for p in (tmp_path / "pages").glob("part-*"))
    assert page.startswith('{"id":"A","last_seen":"%s","instances":[{"id":"A"' % T) and page.count('"src":"s"') == 2


def test_paging_visits_every_row_once(spark):
    rand = random.Random(2)
    rows = [row(f"D{rand.randint(0, 9)}", rand.randint(0, 2), "t", rand.choice("ab"), i, f"2026-01-0{rand.randint(1, 3)}T00:00:00Z") for i in range(230)]
    docs = fold.new_documents(captures(spark, rows))
    seen = explore.explore_columns(fold.observations(captures(spark, rows), docs)).cache()
    visited, cursor = [], None
    while True:
        page = explore.page(seen, cursor, 40).collect()
        visited += [r["ord"] for r in page]
        if len(page) < 40:
            break
        cursor = tuple(page[-1][c] for c in explore.ORDER)
    assert sorted(visited) == list(range(230))
    first = explore.page(seen, None, 40)
    assert explore.next_cursor(first, 40).first()[0] == min(r["timestamp"] for r in first.collect())
    assert explore.next_cursor(first, 41).first()[0] is None
    loose = explore.page(seen, "2026-01-03T00:00:00Z", 40)
    assert {r["timestamp"] for r in loose.collect()} == {"2026-01-02T00:00:00Z"}


def test_top_rows_need_no_global_sort(spark):
    seen = spark.range(1000).selectExpr("'a' id", "0L revision", "'t' og_title", "'d' og_description", "'s' src", "'p' sid", "cast(id as string) ts", "id ord")
    plan = explore.explore(seen)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_last_seen_is_of_the_latest_revision(spark):
    rows = [("A", 1, "2026-05-01T00:00:00Z"), ("A", 2, "2026-01-01T00:00:00.5Z"), ("A", 2, "2026-01-01T01:00:00+01:00"), ("B", 1, "never")]
    seen = spark.createDataFrame(rows, "id string, revision bigint, ts string")
    assert {r["id"]: r["last_seen"] for r in explore.last_seen(seen).collect()} == {"A": "2026-01-01T00:00:00Z", "B": explore.NEVER}


def test_document_pages_in_parts(spark):
    rows = [row("A", r, f"r{r}", "s", r * 10 + k) for r in range(60) for k in range(2)]
    rows += [row("A", 99, "long", "s", 10_000 * i + 7) for i in range(1, 31)] + [row("B", 5, "b", "s", 5)]
    df = captures(spark, rows)
    docs = fold.new_documents(df)
    seen = fold.observations(df, docs)
    pages = explore.document_pages(docs, seen, fold.nest_sources(seen, chunk=10), chunk=6000).collect()
    proper = sorted((p for p in pages if p["id"] == "A" and p["continues"] is None), key=lambda p: p["part"])
    assert len(proper) > 1 and [p["last_seen"] for p in proper] == [T] + [None] * (len(proper) - 1)
    instances = [i for p in proper for i in p["instances"]]
    assert [int(i["revision"]) for i in instances] == [99] + list(range(59, -1, -1))
    further = sorted((p for p in pages if p["continues"] == 99), key=lambda p: p["part"])
    listed = [s["id"] for s in instances[0]["sources"]] + [s["id"] for p in further for s in p["instances"][0]["sources"]]
    assert listed == [f"p{10_000 * i + 7}" for i in range(1, 31)]
    assert [len(p["instances"]) for p in pages if p["id"] == "B"] == [1]


def test_search_after(spark):
    rows = [(f"s{i}", (i // 3, f"k{i % 3}") if i else None) for i in range(30)]
    scans = spark.createDataFrame(rows, "scan_id string, sort_key struct<ts:bigint,id:string>")
    visited, after = [], None
    while page := explore.search_after(scans, after, 7).collect():
        visited += [tuple(r["sort_key"]) for r in page]
        after = visited[-1]
    assert visited == sorted((r[1] for r in rows if r[1]), reverse=True)
