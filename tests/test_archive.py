import gzip

import pytest

from vellum.plans.render import archive_record
from vellum.sources.archive import read_archive

DATE = "2026-02-12T19:17:12Z"
GOOD = gzip.decompress(archive_record(DATE, "<title>é</title>".encode()))


def member(old=b"", new=b""):
    return gzip.compress(GOOD.replace(old, new) if old else GOOD)


RECORDS = [
    (archive_record(DATE, "<title>é</title>".encode()), "<title>é</title>", None),
    (archive_record(DATE, b"\xff<p>"), "\ufffd<p>", None),
    (b"plain bytes", None, "not_gzip"),
    (member(b"WARC/1.0", b"WARC/0.9"), None, "no_archive_header"),
    (archive_record(DATE, b"x", "application/pdf"), None, "not_html"),
    (archive_record(DATE, b"x", "application/xhtml; text/html"), "x", None),
    (member(b"WARC-Date:", b"warc-date:"), None, "missing_header"),
    (member(b"WARC-Identified-Payload-Type:", b"X:"), None, "missing_header"),
    (member(b"Content-Length: 61", b"Content-Length: 0"), None, "missing_header"),
    (member(b"Content-Length: 61", b"Content-Length: x"), None, "bad_content_length"),
    (member(b"Content-Length: 61", b"Content-Length: 51"), "<title>", None),
    (member(b"WARC-Type: response", b"X: " + b"y" * 1024 * 1024), None, "header_too_long"),
    (member()[:-20], None, "truncated_record"),
    (gzip.compress(b"WARC/1.0\r\nno end"), None, "truncated_record"),
]


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    root = tmp_path_factory.mktemp("archive")
    rows, offset, data = [], 0, b""
    for i, (raw, _, _) in enumerate(RECORDS):
        rows.append((i, "a.warc.gz", str(offset), str(len(raw))))
        offset += len(raw)
        data += raw
    (root / "a.warc.gz").write_bytes(data)
    return root, rows


def test_records(spark, archive):
    root, rows = archive
    assert b"Content-Length: 61" in GOOD
    extra = [(90, "a.warc.gz", "x", "1"), (91, "a.warc.gz", "-1", "1"), (92, "none.gz", "0", "10"), (93, "a.warc.gz", None, "1")]
    index = spark.createDataFrame(rows + extra, "n int, filename string, offset string, length string")
    got = {r["n"]: r for r in read_archive(index, str(root)).collect()}
    assert [(got[i]["html"], got[i]["error"]) for i in range(len(RECORDS))] == [(h, e) for _, h, e in RECORDS]
    assert got[0]["warc_date"] == DATE
    assert [got[i]["error"] for i in (90, 91, 92, 93)] == ["bad_range", "bad_range", "unreadable_file", "bad_range"]


def test_many_rows_keep_their_place(spark, archive):
    root, rows = archive
    index = spark.createDataFrame([(i, *rows[i % 2][1:]) for i in range(3000)], "n int, filename string, offset string, length string")
    wrong = [r["n"] for r in read_archive(index, str(root)).collect() if r["html"] != RECORDS[r["n"] % 2][1]]
    assert not wrong
