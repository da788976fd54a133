from pyspark.sql import functions as F

from vellum.functions.urls import document_id, source_url
from vellum.operators import filters
from vellum.sources import crawl, scans

D = "https://docs.google.com/document/d/"
URLS = {
    D + "ID1/edit": "ID1",
    D + "/x/edit": "/x",
    D + "ID": "",
    D + "e/2P/pub": "e",
    "https://example.com/": "",
}
LINE = (
    '{"urlkey": "uk,example)/", "timestamp": "20250304050607", "url": "%sID1/edit", "mime": "text/html", '
    '"mime-detected": "text/html", "status": "200", "digest": "ABCD", "length": "2048", "offset": "777000", '
    '"filename": "a.warc.gz", "encoding": "UTF-8"}' % D
)


def test_document_id(spark):
    rows = spark.createDataFrame([(u,) for u in URLS], "u string")
    assert [r[0] for r in rows.select(document_id(F.col("u"))).collect()] == list(URLS.values())
    assert spark.sql("select cast(null as string) u").select(document_id(F.col("u"))).first()[0] == ""


def test_index_lines(spark, tmp_path):
    (tmp_path / "i.json").write_text("\n".join([LINE, "{broken", "", LINE.replace('"encoding": "UTF-8"', '"languages": "eng"')]))
    good, bad = crawl.split_bad_lines(crawl.read_crawl_index(spark, str(tmp_path)))
    rows = crawl.byte_range(good).collect()
    assert [(r["offset"], r["length"], r["mime-detected"], r["encoding"]) for r in rows] == [
        (777000, 2048, "text/html", "UTF-8"),
        (777000, 2048, "text/html", None),
    ]
    assert [r[0] for r in bad.collect()] == ["{broken"]


def test_search_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "index")
    crawl.parse_index_lines(spark.createDataFrame([(LINE,)], "value string")).write.parquet(path)
    found = filters.search_index(spark.read.parquet(path)).select("digest")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = found._jdf.queryExecution().explainString(mode)
    assert "StringStartsWith(url" in plan and "EqualTo(status,200)" in plan
    assert "ReadSchema: struct<url:string,status:string,digest:string>" in plan


def capture(url, encoding="UTF-8", mime="text/html", digest="d", visibility="public"):
    return (url, encoding, mime, digest, visibility)


def test_first_rule_wins(spark):
    rows = [
        (capture(D + "a/export/pub", None), "export", "export"),
        (capture(D + "a/public/", None), "published", "published"),
        (capture(D + "a/edit", None), "encoding", "candidate"),
        (capture(D + "a/edit", "utf-8"), "encoding", "candidate"),
        (capture(D + "a/edit", mime="text/html; x"), "mime", "candidate"),
        (capture(D + "a/edit", mime=None), "mime", "candidate"),
        (capture(D + "a", digest="seen"), "processed", "processed"),
        (capture(D + "a"), "no_id", "no_id"),
        (capture(D + "a/edit"), "candidate", "candidate"),
        (capture(D + "a/export", visibility="private"), "export", "visibility"),
        (capture(D + "a/edit", visibility=None), "candidate", "visibility"),
    ]
    df = spark.createDataFrame([r[0] + (i,) for i, r in enumerate(rows)], "url string, encoding string, `mime-detected` string, digest string, visibility string, n int")
    seen = spark.createDataFrame([("seen",), ("seen",)], "digest string")
    for origin, wanted in (("crawl", 1), ("scan", 2)):
        judged = filters.classify_captures(df, origin, seen).orderBy("n").collect()
        assert [r["status"] for r in judged] == [r[wanted] for r in rows]
    summary = filters.run_summary(filters.classify_captures(df, "crawl", seen), completed="candidate").first()
    assert (summary["completed"], summary["errors"], summary["skipped"]) == (2, 0, 8)


SCAN = '{"_id": "%s", "task": {"time": "%s", "visibility": "public"}, "page": {"url": "u"}, "sort": %s}'


def test_scans(spark):
    lines = [
        (SCAN % ("a", "2026-01-02T03:04:05Z", '[1767323045000, "a"]'),),
        (SCAN % ("b", "2026-01-02T03:04:06.5Z", "[0, \"b\"]"),),
        (SCAN % ("c", "2026-01-02T03:04:07Z", '[1767323047000]'),),
    ]
    df = spark.createDataFrame(lines, "value string")
    rows = scans.parse_scan_lines(df).orderBy("scan_id").collect()
    assert [r["sort_key"] and r["sort_key"].asDict() for r in rows] == [{"ts": 1767323045000, "id": "a"}, None, None]
    since = scans.collect_since(scans.parse_scan_lines(df), "1767323045000")
    assert sorted(r["scan_id"] for r in since.collect()) == ["b", "c"]
    page = spark.createDataFrame([('{"results":[%s],"total":3,"has_more":false}' % ",".join(x[0] for x in lines),)], "value string")
    assert scans.parse_scan_lines(page, envelope=True).count() == 3


def test_bad_scan_lines(spark):
    good = SCAN % ("a", "2026-01-02T03:04:05Z", '[1767323045000, "a"]')
    lines = spark.createDataFrame([(good,), ('{"_id": "cut',), ("",), ("  ",)], "value string")
    kept, bad = scans.split_bad_scans(scans.parse_scan_lines(lines))
    assert [r["scan_id"] for r in kept.collect()] == ["a"] and [r["bad_line"] for r in bad.collect()] == ['{"_id": "cut']
    pages = [('{"results":[%s,%s],"total":2,"has_more":false}' % (good, good),), ('{"results":[%s' % good,), ('{"results":[]}',)]
    kept, bad = scans.split_bad_scans(scans.parse_scan_lines(spark.createDataFrame(pages, "value string"), envelope=True))
    assert kept.where("scan_id = 'a'").count() >= 2
    assert kept.count() + bad.count() == 3


def test_source_url(spark):
    rows = spark.createDataFrame([("urlscan", "s"), ("commoncrawl", "CC"), ("manual", "m")], "src string, sid string")
    assert [r[0] for r in rows.select(source_url(F.col("src"), F.col("sid"), F.lit("I"))).collect()] == [
        "https://urlscan.io/result/s",
        f"https://index.commoncrawl.org/CC-index?url={D}I*&filter==status:200",
        None,
    ]
