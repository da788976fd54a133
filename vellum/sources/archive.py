"""Byte-range reads of compressed web-archive files, decoded to HTML."""

from __future__ import annotations

import io
import sys
import time
import zlib
from collections.abc import Iterator
from gzip import GzipFile

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.schemas import ARCHIVE
from vellum.session import scratch_path
from vellum.sources.crawl import byte_range

# tasks get these functions with the plan; executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINE_LIMIT = 1024 * 1024
#: Times a read is tried, and seconds before it is tried again, doubled each time.
TRIES, PAUSE = 5, 0.1
#: Captures this close together in one file are read by one task.
STRETCH = 64 * 1024 * 1024
#: Bytes a task reads, about; fewer where there would be less than four tasks for each core.
TASK_BYTES = 256 * 1024 * 1024
# decoded pages handed back to Spark at a time
BATCH_BYTES = 32 * 1024 * 1024


class RecordError(Exception):
    """A record that cannot be used; the message is its error class."""


def _line(stream: GzipFile) -> bytes:
    line = stream.readline(LINE_LIMIT + 1)
    if len(line) > LINE_LIMIT:
        raise RecordError("header_too_long")
    if not line.endswith(b"\n"):
        raise RecordError("truncated_record")
    return line


def decode_record(raw: bytes) -> tuple[str, str]:
    """Capture date and page of one gzip member."""
    with GzipFile(fileobj=io.BytesIO(raw)) as stream:
        try:
            return _decode(stream)
        except (OSError, EOFError, zlib.error) as failure:
            raise RecordError("not_gzip" if stream.tell() == 0 else "truncated_record") from failure


def _decode(stream: GzipFile) -> tuple[str, str]:
    if not _line(stream).startswith(b"WARC/1.0"):
        raise RecordError("no_archive_header")
    size, date, is_html = 0, None, False
    while (line := _line(stream)) != b"\r\n":
        name, _, value = line.partition(b":")
        value = value.strip()
        if name == b"Content-Length":
            try:
                size = int(value)
            except ValueError:
                raise RecordError("bad_content_length") from None
        elif name == b"WARC-Date":
            date = value.decode("utf-8", "replace")
        elif name == b"WARC-Identified-Payload-Type":
            if not line.strip().endswith(b"text/html"):
                raise RecordError("not_html")
            is_html = True
    if size == 0 or date is None or not is_html:
        raise RecordError("missing_header")
    while True:
        line = _line(stream)
        size -= len(line)
        if not line.strip():
            break
    return date, stream.read(max(size, 0)).decode("utf-8", "replace")


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def _read_stretch(root: str):
    """Task body: open each file once, read its ranges in order of offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened_name, opened = None, None
        for batch in batches:
            done, held = 0, 0
            dates, pages, errors = [], [], []
            for name, offset, length in zip(
                batch["filename"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist()
            ):
                date = page = None
                for attempt in range(TRIES):
                    error = None
                    try:
                        if offset is None or length is None or offset < 0 or length < 1:
                            raise RecordError("bad_range")
                        if name != opened_name:
                            if opened is not None:
                                opened.close()
                            opened_name, opened = None, None
                            filesystem, path = locate(f"{root}/{name}")
                            opened = filesystem.open_input_file(path)
                            opened_name = name
                        if offset >= opened.size():
                            raise RecordError("bad_range")
                        opened.seek(offset)
                        date, page = decode_record(opened.read(min(length, opened.size() - offset)))
                    except RecordError as failure:
                        error = str(failure)
                    except (FileNotFoundError, ValueError, TypeError):
                        error = "unreadable_file"
                    except OSError:
                        # a fault of the network may pass: open the file anew, a little later
                        error, opened_name = "unreadable_file", None
                        time.sleep(PAUSE * 2**attempt)
                        continue
                    break
                dates.append(date)
                pages.append(page)
                errors.append(error)
                held += len(page or "")
                if held >= BATCH_BYTES or done + len(dates) == batch.num_rows:
                    yield _with_record(batch.slice(done, len(dates)), dates, pages, errors)
                    done, held = done + len(dates), 0
                    dates, pages, errors = [], [], []

    return run


def _with_record(batch: pa.RecordBatch, dates: list, pages: list, errors: list) -> pa.RecordBatch:
    columns = batch.columns + [pa.array(values, pa.string()) for values in (dates, pages, errors)]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names + ["warc_date", "html", "error"])


def bins_by_bytes(ranged: DataFrame, task_bytes: int = TASK_BYTES, stretch: int = STRETCH) -> tuple[DataFrame, int]:
    """The bin of every file and stretch, so that a bin has about ``task_bytes``; and the number of bins.

    Stretches are put side by side in ranges of their order, bytes are added up
    within each range, and the ranges' bins follow one another. A bin holds less
    than ``task_bytes`` and one more stretch. Rows without a usable range weigh
    nothing. The stretches, a row for each of them, are written before.
    """
    spark = ranged.sparkSession
    place = F.floor(F.coalesce("offset", F.lit(0)) / stretch).alias("stretch")
    weight = F.greatest(F.coalesce("length", F.lit(0)), F.lit(0))
    groups = ranged.groupBy(F.col("filename").alias("file"), place).agg(F.sum(weight).alias("bytes"))
    ordered = groups.repartitionByRange("file", "stretch").withColumn("part", F.spark_partition_id())
    path = scratch_path(spark, "stretches")
    ordered.write.parquet(path)
    kept = spark.read.schema(ordered.schema).parquet(path)

    total = kept.agg(F.sum("bytes")).first()[0] or 0
    wanted = max(1, min(task_bytes, total // (4 * spark.sparkContext.defaultParallelism)))
    before = Window.partitionBy("part").orderBy("file", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    local = kept.withColumn("local", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / wanted))
    # a row for each range: few, whatever the index holds
    sizes = local.groupBy("part").agg((F.max("local") + 1).alias("n"))
    side = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "n", F.coalesce(F.sum("n").over(side), F.lit(0)).alias("start"))
    bins = local.join(F.broadcast(starts), "part").select("file", "stretch", (F.col("start") + F.col("local")).cast("int").alias("bin"))
    return bins, int(sizes.agg(F.sum("n")).first()[0] or 1)


def read_archive(index: DataFrame, root: str, tasks: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Fetch and decode every capture of an index.

    ``root`` is a URI every executor can read. Captures are grouped by file and
    stretch of the file and read in order, so a file that holds a large share
    of the captures is shared by many tasks, and every task reads about
    ``task_bytes``: stretches are dealt out by the bytes the index gives them.
    ``tasks`` deals them out to so many tasks by hash instead. A capture that
    cannot be read or decoded is a row with ``error`` set. Filter first: nothing
    moves through this step. The number of tasks is explicit, because an index
    row is tiny and adaptive execution would put thousands of fetches into one.
    """
    ranged = byte_range(index)
    stretched = ranged.withColumn("_stretch", F.floor(F.coalesce("offset", F.lit(0)) / STRETCH))
    if tasks is None:
        bins, n = bins_by_bytes(ranged, task_bytes)
        same = F.col("filename").eqNullSafe(F.col("file")) & (F.col("_stretch") == F.col("stretch"))
        placed = stretched.join(bins, same).drop("file", "stretch").repartitionById(n, "bin").drop("bin")
    else:
        placed = stretched.repartition(tasks, "filename", "_stretch")
    placed = placed.drop("_stretch").sortWithinPartitions("filename", "offset")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in placed.dtypes)
    return placed.mapInArrow(_read_stretch(root.rstrip("/")), f"{schema}, {ARCHIVE}")
