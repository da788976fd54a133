import pytest
from pyspark.sql import functions as F

from vellum.operators.extract import extract_documents, split_quarantine, with_provenance, with_timestamp

HEAD = """<!DOCTYPE html><html><head><title>T - Docs</title>
<meta property="og:title" content="T"><meta property="og:description" content="D">
<meta content="https://img.example.com/i" property="og:image">"""
DCT = "<script>config['dct'] = 1.741964966535E12; config['bci'] = 'ID1';</script>"
TIME = '<script>x={"revision":7};y={"server_time_ms":1770247153000,"z":1};</script>'
BODY = """<script>[{"ty":"is","ibi":1,"s":"Hello"},{"lnk_type":0,"ulnk_url":"https://a.example.com/"},"s-blob-v1-IMAGE-k":"https://img.example.com/b"]</script>"""
END = "</head><body></body></html>"


def parse(spark, *pages, **given):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "n int, html string")
    for name, value in given.items():
        rows = rows.withColumn(name, F.lit(value))
    found = [r.asDict() for r in extract_documents(rows).orderBy("n").collect()]
    return found[0] if len(pages) == 1 else found


def script(body):
    return HEAD + DCT + TIME + f"<script>{body}</script>" + END


def test_whole_page(spark):
    doc = parse(spark, HEAD + DCT + TIME + BODY + END)
    doc.pop("n")
    created = doc.pop("created")
    assert str(created) == "2025-03-14 15:09:26.535000"
    assert doc == {
        "id": "ID1", "revision": 7, "provenance": "", "timestamp": "2026-02-04T23:19:13Z",
        "page_title": "T - Docs", "og_title": "T", "og_description": "D",
        "og_image": "https://img.example.com/i", "content": "Hello",
        "links": ["https://a.example.com/"], "image_urls": ["https://img.example.com/b"], "parse_status": "ok",
    }


SNIPPETS = {
    '{"ty":"is","ibi":1,"s":"  two "}': "two",
    '{"ty":"is","ibi":1,"s":"a"},{"ty":"is","ibi":2,"s":"hello"},{"ty":"is","ibi":3,"s":"world"}': "world",
    '{"ty":"is","ibi":1,"s":"C:\\\\"},{"ty":"is","ibi":2,"s":"hello"}': "",
    '{"ty":"is","ibi":1,"s":"ab\u2028cd"}': "ab\u2028cd",
    '{"ty":"is","ibi":1,"s":"ab\tcd"}': "",
    '{"ty":"is","ibi":1,"s":"ab\\qcd"},{"ty":"is","ibi":2,"s":"kept"}': "kept",
    '{"ty":"is","ibi":1,"s":"one"},{"ty":"is","ibi":2,"s":"   "},{"ty":"is","ibi":3,"s":"\\u00e9t\\u00e9"}': "one\nété",
    '{"ty":"is","ibi":1,"s":"cut off': "",
}


def test_snippets(spark):
    docs = parse(spark, *[script(s) for s in SNIPPETS])
    assert [d["content"] for d in docs] == list(SNIPPETS.values())


def test_links_and_images(spark):
    link = '{{"lnk_type":0,"ulnk_url":"http{}"}}'.format
    image = '"s-blob-v1-IMAGE-x":"https://{}"'.format
    doc = parse(spark, script(",".join([link("b"), link("a"), link("b"), link("c"), image("u"), image("u")])))
    assert doc["links"] == ["httpb", "httpa", "httpc"]
    assert doc["image_urls"] == ["https://u", "https://u"]


def test_revision(spark):
    first_per_script = '<script>{"revision":3},{"revision":9}</script><script>{"revision":5}</script>'
    too_large = '<script>{"revision":4294967296}</script><script>{"revision":4294967295}</script>'
    docs = parse(spark, HEAD + first_per_script + END, HEAD + too_large + END, HEAD + END)
    assert [d["revision"] for d in docs] == [5, 4294967295, 0]


def test_tags_that_do_not_count(spark):
    page = (
        "<!-- <title>comment</title> --><textarea><title>area</title></textarea><style><title>s</title></style>"
        "<noscript><meta property='og:title' content=no></noscript><iframe><title>f</title></iframe>"
        '<p title="<title>attribute</title>" data-x=\'<script>"revision":8}</script>\'>it\'s < 3 "</p>'
        "<TITLE lang=en>First</TITLE><script>t = '<title>in script</title>'</script>"
        "<title>Fish &amp; Chips</title ><!--><meta property=og:title content='A &quot;b&quot;' content=second>"
    )
    doc = parse(spark, page + DCT + TIME)
    assert (doc["page_title"], doc["og_title"], doc["revision"]) == ("Fish & Chips", 'A "b"', 7)


def test_cut_off_page_and_line_ends(spark):
    docs = parse(
        spark,
        HEAD.replace("\n", "\r\n") + DCT + TIME + '<script>[{"ty":"is","ibi":1,"s":"Hello"},{"ty":"is","ibi"',
        "<title></title>",
        "<title>open",
        "<title>a</title><meta property=og:title content=",
        "<script " * 2000,
        "<" * 20000,
        '<a b="' * 5000,
    )
    assert docs[0]["content"] == "Hello" and docs[0]["parse_status"] == "ok"
    assert [d["page_title"] for d in docs[1:4]] == ["", "open", "a"]


@pytest.mark.parametrize(
    "page, status",
    [
        (HEAD + DCT + TIME + END, "ok"),
        ("<title>only a title</title>" + DCT + TIME, "empty_document"),
        (HEAD + TIME + BODY, "no_created"),
        (HEAD + DCT + BODY, "no_timestamp"),
        (HEAD + DCT.replace("E12", "E+12") + TIME, "bad_created"),
        (HEAD + DCT + TIME.replace("1770247153000", "9" * 400), "bad_server_time"),
        ("", "empty_document"),
        (None, "empty_document"),
    ],
)
def test_status(spark, page, status):
    assert parse(spark, page)["parse_status"] == status


def test_callers_values_win(spark):
    page = HEAD + DCT + BODY
    doc = parse(spark, page, id="GIVEN", timestamp="2026-02-12T19:17:12Z", provenance="CC")
    assert (doc["id"], doc["timestamp"], doc["provenance"], doc["parse_status"]) == (
        "GIVEN", "2026-02-12T19:17:12Z", "CC", "ok",
    )
    empty = parse(spark, HEAD + DCT + TIME, id="", timestamp="")
    assert (empty["id"], empty["timestamp"]) == ("ID1", "2026-02-04T23:19:13Z")
    rows = with_timestamp(with_provenance(spark.createDataFrame([(page,)], "html string"), "P"), "2026")
    assert extract_documents(rows).first()["timestamp"] == "2026"


def test_filter_on_status_does_not_repeat_the_parse(spark):
    rows = spark.createDataFrame([(1, HEAD + DCT + TIME)], "n int, html string")
    good, bad = split_quarantine(extract_documents(rows))
    assert (good.count(), bad.count()) == (1, 0)
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?is)(?:[^<]++") == 1
