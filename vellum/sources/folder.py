"""HTML files in a folder."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.extract import content_digest
from vellum.sources.archive import BATCH_BYTES, locate

# tasks get these functions with the plan; executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Names handed on at a time.
NAMES_TOGETHER = 10_000
#: Tasks for each core, at least, that read files.
TASKS = 4


def read_html_folder(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """Whole files with the SHA-1 of their bytes; ``path`` is the order key.

    A task lists the folder, and others read the files whose names they get: the driver
    and the plan hold no names, whatever the folder holds. Spark's own reader, which
    lists in the driver, takes what is not one folder, or one that only Spark can reach.
    """
    root = _folder(spark, path)
    if root is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    else:
        wanted = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
        listed = spark.range(1, numPartitions=1).mapInArrow(_listed(root, wanted), "path string")
        tasks = max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        files = listed.repartition(tasks, "path").mapInArrow(_read, "path string, content binary")
    return files.select(
        "path",
        content_digest(F.col("content")).alias("digest"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("html"),
    )


def _folder(spark: SparkSession, path: str) -> str | None:
    """The folder as Spark names it, if it is one that tasks can list."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if re.search(r"[\\*?\[{]", path) or not filesystem.exists(place) or not filesystem.getFileStatus(place).isDirectory():
        return None
    root = filesystem.makeQualified(place).toString()
    try:
        locate(root)
    except (OSError, ValueError, pa.ArrowException):
        return None
    return root


def _names(root: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder, and whether they are folders; a local folder is never listed as a whole."""
    filesystem, path = locate(root)
    if isinstance(filesystem, fs.LocalFileSystem):
        with os.scandir(path) as entries:
            for entry in entries:
                if (is_folder := entry.is_dir()) or entry.is_file():
                    yield entry.name, is_folder
    else:
        for found in filesystem.get_file_info(fs.FileSelector(path)):
            yield found.base_name, found.type == fs.FileType.Directory


def _files(root: str, wanted: re.Pattern) -> Iterator[str]:
    """Paths of the files that Spark's reader would take: hidden ones are left out, folders of partitions are not."""
    for name, is_folder in _names(root):
        if name.startswith(".") or name.startswith("_") and "=" not in name:
            continue
        if is_folder and "=" in name:
            yield from _files(f"{root}/{name}", wanted)
        elif not is_folder and wanted.fullmatch(name):
            yield f"{root}/{name}"


def _listed(root: str, wanted: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            some = []
            for path in _files(root, re.compile(wanted, re.DOTALL)):
                some.append(path)
                if len(some) == NAMES_TOGETHER:
                    yield pa.RecordBatch.from_arrays([pa.array(some)], names=["path"])
                    some = []
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["path"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body: read the files one after another, handed on some 32 MiB at a time. As with Spark's reader, empty ones give no row."""
    for batch in batches:
        paths, contents, held = [], [], 0
        for path in batch["path"].to_pylist():
            filesystem, place = locate(path)
            with filesystem.open_input_stream(place, compression=None) as file:
                content = file.read()
            if not content:
                continue
            paths.append(path)
            contents.append(content)
            held += len(content)
            if held >= BATCH_BYTES:
                yield _contents(paths, contents)
                paths, contents, held = [], [], 0
        yield _contents(paths, contents)


def _contents(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
