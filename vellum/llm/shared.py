"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    Cuts the lineage: a lost executor costs a read, not the work before it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: str = "text") -> Column:
    """Tells rows of one id apart by their text; null has a value of its own."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply a function from a record batch to columns to every batch.

    Batches hold at most ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows
    and ``...maxBytesPerBatch`` bytes, so a task holds one batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(function(batch))

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def with_column_per_batch(
    docs: DataFrame, text_col: str, label: str, kind: str, arrow: pa.DataType, function: Callable[[list], list]
) -> DataFrame:
    """Input rows with a column made from a batch's texts; an input column of that name is replaced."""
    docs = docs.drop(label)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(function(batch.column(at).to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, label])

    field = T.StructField(label, T.StructType.fromDDL(f"x {kind}")[0].dataType)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, field]))


def with_two_columns_per_batch(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    label: str,
    kind: str,
    arrow: pa.DataType,
    function: Callable[[list, list], list],
) -> DataFrame:
    """Like ``with_column_per_batch``, made from a batch's ids and texts."""
    kept = docs.drop(label)
    at, id_at = kept.columns.index(text_col), kept.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(function(batch.column(id_at).to_pylist(), batch.column(at).to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, label])

    field = T.StructField(label, T.StructType.fromDDL(f"x {kind}")[0].dataType)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, field]))


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """Names for helper columns that no column has, upper and lower case alike."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(id_col: str, folds: int) -> Column:
    """Remainder of the checksum of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def drawn(df: DataFrame, key: Column, size: int, rows: int) -> DataFrame:
    """At most ``size`` of about ``rows`` rows: those with the smallest hashes of a key.

    Tasks first drop rows whose hash is above the share that is wanted, with
    some to spare, so only about ``size`` rows meet for the exact cut.
    """
    share = min(1.0, 1.2 * size / max(rows, 1) + 1e-9)
    bound = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    hashed = df.withColumn("_drawn", F.xxhash64(key)).where(F.col("_drawn") <= bound)
    return hashed.orderBy("_drawn").limit(size).drop("_drawn")


def drawn_of_each(df: DataFrame, group: str, key: Column, size: int) -> DataFrame:
    """At most ``size`` rows of each value of a column: those with the smallest hashes of a key.

    The numbers of rows, a row for each value, are sent to all tasks, which drop
    rows above the share that is wanted before any rows of a value meet.
    """
    name, hashed, rows, number = unused(df.columns, "_of", "_drawn", "_rows", "_number")
    counts = df.groupBy(F.col(group).alias(name)).agg(F.count(F.lit(1)).alias(rows))
    place = F.xxhash64(key).cast("double") / 2.0**64 + 0.5
    share = 1.2 * size / F.col(rows) + 1e-9
    met = df.withColumn(hashed, place).join(F.broadcast(counts), F.col(group).eqNullSafe(F.col(name)))
    order = Window.partitionBy(group).orderBy(hashed)
    few = met.where(F.col(hashed) <= share).withColumn(number, F.row_number().over(order))
    return few.where(F.col(number) <= size).select(*df.columns)


def gram_buckets(words: list[str], orders: range, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of words with their borders, and the word each belongs to.

    The hash is the same in every process and takes ``2 ** bits`` values.
    """
    code = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    buckets, owners = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    h = np.zeros(len(code), np.uint64)
    for order in range(1, orders.stop):
        n = len(code) - order + 1
        if n <= 0:
            break
        h = h[:n] * np.uint64(0x100000001B3) + code[order - 1 :] + np.uint64(order)
        if order in orders:
            mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            inside = owner[:n] == owner[order - 1 :]
            buckets.append((mixed >> np.uint64(64 - bits)).astype(np.int64)[inside])
            owners.append(owner[:n][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def row_key(docs: DataFrame, id_col: str, text_col: str, *more: str) -> Column:
    """A key without nulls from id and text; rows that share it are copies of one row."""
    parts = [docs[id_col], *(docs[c] for c in more)]
    return key_of([F.xxhash64(p.isNull(), p) for p in parts[1:]], docs[id_col], text_hash(text_col))


def key_of(more: list[Column], row_id: Column, row_hash: Column) -> Column:
    return F.concat_ws(":", F.coalesce(row_id.cast("string"), F.lit("null")), row_hash, *more)


def kept_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose (id, text hash) is in ``kept``; one of equal rows.

    ``kept`` has the columns ``_id`` and ``_hash``. The join and the choice use
    one key, so texts are shuffled once.
    """
    key, row = unused(docs.columns, "_key", "_row")
    keys = kept.select(key_of([], F.col("_id"), F.col("_hash")).alias(key))
    met = docs.withColumn(key, row_key(docs, id_col, text_col)).join(keys, key, "left_semi")
    first = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return met.withColumn(row, first).where(F.col(row) == 1).select(*docs.columns)
