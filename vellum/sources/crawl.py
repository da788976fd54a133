"""Crawl-index records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.schemas import CRAWL_INDEX


def parse_index_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines as index records; an unreadable line keeps its text in ``bad_line``."""
    record = F.from_json(
        column, f"{CRAWL_INDEX}, bad_line string", {"columnNameOfCorruptRecord": "bad_line"}
    )
    carried = [c for c in lines.columns if c != column]
    return lines.where(F.trim(column) != "").select(*carried, record.alias("_r")).select(*carried, "_r.*")


def read_crawl_index(spark: SparkSession, path: str) -> DataFrame:
    """Scan of newline-delimited index files.

    Plain text splits at any size; a gzip file is one task, so write such an
    index to Parquet once, where a search by URL prefix also skips row groups.
    """
    return parse_index_lines(spark.read.text(path))


def split_bad_lines(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable records and unreadable lines."""
    if "bad_line" not in index.columns:
        return index, index.where(F.lit(False)).select(F.lit("").alias("bad_line"))
    return index.where("bad_line is null").drop("bad_line"), index.where("bad_line is not null").select("bad_line")


def byte_range(index: DataFrame) -> DataFrame:
    """``offset`` and ``length`` as numbers, NULL where they are not integers."""
    return index.withColumn("offset", F.col("offset").try_cast("bigint")).withColumn(
        "length", F.col("length").try_cast("bigint")
    )
