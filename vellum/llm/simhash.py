"""SimHash near-duplicates: tiles of fingerprints compared exactly with exclusive-or and bit counts."""

from __future__ import annotations

from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.components import connected_components, spanning_forest
from vellum.llm.shared import as_bytes, kept_rows, per_batch, text_hash, written

SEED = 42
#: Fingerprints are tiled by the population counts of this many equal parts.
PARTS = 4
BITS = 64 // PARTS
#: Fingerprints of a tile, about.
TILE = 1024
#: Hashes that are counted at a time, and rows of a tile that are compared at a time.
CHUNK = 65_536
STRIP = 256


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of a whole text; 0 for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    size = min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    last = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, last, CHUNK):
        stop = min(at + CHUNK, last)
        hashes = np.fromiter(
            (digest(line[s : e - 1], SEED) for s, e in zip(starts[at:stop], ends[at + size - 1 : stop + size - 1])),
            np.uint64,
            stop - at,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        values = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(2))], np.uint64)
        return {"_id": batch.column(0), "_hash": batch.column(1), "fp": pa.array(values.view(np.int64))}

    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), text_hash(text_col).alias("_hash"), F.col(text_col).alias("_text"))
    return per_batch(narrow, run, f"_id {id_type}, _hash long, fp long")


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of part counts that are within the radius, one of each pair of opposites."""
    near = product(range(-radius, radius + 1), repeat=PARTS)
    return [d for d in near if sum(map(abs, d)) <= radius and d >= (0,) * PARTS]


def _tiles(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprints by their part counts, in blocks of about ``TILE``, and the blocks of each cell.

    There are at most ``(BITS + 1) ** PARTS`` cells, 83,521, whatever the input.
    """
    counts = [
        F.bit_count(F.shiftrightunsigned("fp", BITS * i).bitwiseAND(F.lit((1 << BITS) - 1))) for i in range(PARTS)
    ]
    celled = classes.select("fp", F.array(*counts).alias("counts"))
    cells = celled.groupBy("counts").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    cells = written(cells, "simhash-cells")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = celled.join(F.broadcast(cells), "counts").withColumn("block", block)
    tiles = placed.groupBy("counts", "block").agg(F.collect_list("fp").alias("fps"))
    return written(tiles, "simhash-tiles"), cells


def _tile_pairs(tiles: DataFrame, cells: DataFrame, radius: int) -> DataFrame:
    """Pairs of tiles whose part counts differ by at most the radius in sum; the others are skipped."""
    steps = F.array(*[F.array(*[F.lit(x) for x in d]) for d in _steps(radius)])
    moved = F.zip_with("counts", "step", lambda x, y: x + y)
    zero = F.lit([0] * PARTS)
    from_tile = (
        tiles.withColumn("step", F.explode(steps))
        .select(F.col("fps").alias("left"), F.col("block").alias("from_block"), "step", moved.alias("counts"))
        .join(F.broadcast(cells), "counts")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("own", (F.col("step") == zero) & (F.col("block") == F.col("from_block")))
        .where((F.col("step") != zero) | (F.col("block") >= F.col("from_block")))
    )
    return from_tile.join(tiles.withColumnRenamed("fps", "right"), ["counts", "block"]).select("own", "left", "right")


def _links(left: np.ndarray, right: np.ndarray, own: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    found_l, found_r = [], []
    for at in range(0, len(left), STRIP):
        near = np.bitwise_count(left[at : at + STRIP, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        if own:
            i, j = i[upper := i + at < j], j[upper]
        found_l.append(left[i + at])
        found_r.append(right[j])
    return np.concatenate(found_l), np.concatenate(found_r)


def _compare(pairs: DataFrame, radius: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        left, right = batch.column(1), batch.column(2)
        lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
        lv = left.values.to_numpy(zero_copy_only=False).view(np.uint64)
        rv = right.values.to_numpy(zero_copy_only=False).view(np.uint64)
        own = batch.column(0).to_pylist()
        found = (_links(lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]], own[k], radius) for k in range(batch.num_rows))
        a, b = spanning_forest([(x.view(np.int64), y.view(np.int64)) for x, y in found])
        return {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}

    return per_batch(pairs, run, "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprint, and fingerprints with their component's root and first document."""
    rows = written(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    first = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id"), F.col("_hash"))
    classes = written(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash-classes")
    tiles, cells = _tiles(classes)
    edges = _compare(_tile_pairs(tiles, cells, radius), radius)
    roots = connected_components(edges)
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    heads = rooted.groupBy("root").agg(F.min("first").alias("head"))
    return rows, written(rooted.join(heads, "root").select("fp", "root", "head"), "simhash-heads")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id``, ``kept``.

    Two rows link when their fingerprints differ in at most ``radius`` bits; a
    component is what links reach, and its id is its smallest id. Equal
    fingerprints are one node, however many rows share them, and a component
    of a node is found from a spanning forest of its links, so groups of copies
    are never expanded into pairs. Every tile of distinct fingerprints is
    compared with every tile whose population counts allow a link.

    A null or wordless text has the fingerprint zero and links like any other.
    Rows without an id take part and never name a component with ids. Repeated
    rows give repeated results; only the two named columns are read, so others
    may have any name. ``kept`` marks rows whose id names their component.
    """
    rows, heads = _classes(docs, id_col, text_col, shingle, radius)
    joined = rows.join(heads, "fp")
    component = F.col("head._id")
    return joined.select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """Input rows, one of each component: that of the smallest id, then text hash."""
    _, heads = _classes(docs, id_col, text_col, shingle, radius)
    kept = heads.select(F.col("head._id").alias("_id"), F.col("head._hash").alias("_hash")).distinct()
    return kept_rows(docs, kept, id_col, text_col)
