"""Pages and records in the shape collectors meet, written from table rows.

The test tables hold no document pages, archive files or index lines, so
queries and tests derive them here. Everything is a column expression except
the archive writer, which compresses records into files.
"""

from __future__ import annotations

import gzip
import io
import sys
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.sources.archive import locate

# tasks get these functions with the plan; executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def json_string(text: Column) -> Column:
    """A JSON literal that is safe inside a script."""
    quoted = F.to_json(F.array(text))
    return F.replace(F.substr(quoted, F.lit(2), F.length(quoted) - 2), F.lit("<"), F.lit("\\u003c"))


def escaped(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def e_notation(ms: Column) -> Column:
    digits = ms.cast("string")
    return F.concat(F.substring(digits, 1, 1), F.lit("."), F.substr(digits, F.lit(2), F.length(digits)), F.lit("E12"))


def _when(present: Column | None, text: Column) -> Column:
    return text if present is None else F.when(present, text).otherwise("")


def page(
    doc_id: Column,
    revision: Column,
    title: Column,
    content: Column,
    links: Column,
    images: Column,
    created: Column,
    server_ms: Column,
    *,
    has_body: Column | None = None,
    has_created: Column | None = None,
    has_server: Column | None = None,
) -> Column:
    """A document page; ``created`` is the literal to print. Decoys sit in places
    a page parser must step over."""
    lines = F.transform(
        F.split(content, "\n"),
        lambda line, i: F.concat(F.lit('{"ty":"is","ibi":'), i.cast("string"), F.lit(',"s":'), json_string(line), F.lit("}")),
    )
    targets = F.transform(links, lambda u: F.concat(F.lit('{"lnk_type":0,"ulnk_url":'), json_string(u), F.lit("}")))
    blobs = F.transform(
        images, lambda u, i: F.concat(F.lit('"s-blob-v1-IMAGE-k'), i.cast("string"), F.lit('":'), json_string(u))
    )
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"),
        escaped(title),
        F.lit(' - Docs</title><meta charset="utf-8">'),
        _when(has_body, F.concat(F.lit('<meta property="og:title" content="'), escaped(title), F.lit('">'))),
        F.lit("<meta property='og:description' content='About "),
        doc_id,
        F.lit("'><meta content=https://img.example.com/"),
        doc_id,
        F.lit(' property=og:image><!-- <script>x={"revision":4000000000}</script> -->'),
        F.lit("<textarea><title>decoy</title></textarea><div data-t='<script>y={\"revision\":3999999999}</script>'></div>"),
        F.lit("<script>"),
        _when(has_created, F.concat(F.lit("config['dct'] = "), created, F.lit("; "))),
        F.lit("config['bci'] = '"),
        doc_id,
        F.lit("';</script>"),
        F.lit('<script>r={"revision":0};s={"revision":9}</script><script>t={"revision":'),
        revision.cast("string"),
        F.lit("};"),
        _when(has_server, F.concat(F.lit('u={"server_time_ms":'), server_ms.cast("string"), F.lit(',"z":1};'))),
        F.lit("</script>"),
        _when(
            has_body,
            F.concat(
                F.lit("<script>["),
                F.array_join(lines, ","),
                F.lit("]</script><script>["),
                F.array_join(targets, ","),
                F.lit("]</script><script>{"),
                F.array_join(blobs, ","),
                F.lit("}</script>"),
            ),
        ),
        F.lit("</head><body></body></html>"),
    )


def archive_record(date: str, body: bytes, payload_type: str = "text/html") -> bytes:
    """One compressed archive member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    head = (
        f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Date: {date}\r\n"
        f"WARC-Identified-Payload-Type: {payload_type}\r\nContent-Length: {len(http) + len(body)}\r\n\r\n"
    )
    buffer = io.BytesIO()
    with gzip.GzipFile(fileobj=buffer, mode="wb", mtime=0, compresslevel=1) as member:
        member.write(head.encode() + http + body)
    return buffer.getvalue()


def write_archive(pages: DataFrame, root: str) -> DataFrame:
    """Write one archive file per task from (key, date, html); the index rows come back."""

    def run(batches):
        name = f"{uuid.uuid4().hex}.warc.gz"
        filesystem, path = locate(f"{root}/{name}")
        filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
        offset = 0
        with filesystem.open_output_stream(path, compression=None) as out:
            for batch in batches:
                offsets, lengths = [], []
                for date, html in zip(batch["date"].to_pylist(), batch["html"].to_pylist()):
                    member = archive_record(date, html.encode())
                    out.write(member)
                    offsets.append(str(offset))
                    lengths.append(str(len(member)))
                    offset += len(member)
                yield pa.RecordBatch.from_arrays(
                    [batch["key"], pa.array([name] * batch.num_rows), pa.array(offsets, pa.string()), pa.array(lengths, pa.string())],
                    names=["key", "filename", "offset", "length"],
                )

    return pages.select("key", "date", "html").mapInArrow(
        run, "key bigint, filename string, offset string, length string"
    )


def write_html_files(pages: DataFrame, root: str) -> DataFrame:
    """Write one HTML file per row of (key, html); key and file name come back."""

    def run(batches):
        filesystem, base = locate(root)
        filesystem.create_dir(base, recursive=True)
        for batch in batches:
            names = [f"{key:012d}.html" for key in batch["key"].to_pylist()]
            for name, html in zip(names, batch["html"].to_pylist()):
                with filesystem.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(html.encode())
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(names)], names=["key", "name"])

    return pages.select("key", "html").mapInArrow(run, "key bigint, name string")
