"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

Every window of an item is found by its rarest word shingle, which any document
holding the window must hold too. Shingles travel as 64-bit hashes, and a
bitmap of fixed size lets documents drop nearly all of theirs before the join;
the words themselves decide in the end.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import as_bytes, key_of, per_batch, row_key, text_hash, unused, written

#: Bits of a bitmap of shingles; its size, 8 MB, does not depend on the benchmark.
BITMAP_BITS = 26
#: Words that are hashed at a time, about.
CHUNK = 200_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
WORD_TABLE = bytes(b if b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from the words' codes."""
    n = len(codes) - size + 1
    h = np.full(max(n, 0), size, np.uint64)
    for k in range(size if n > 0 else 0):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return h


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def _bit(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - BITMAP_BITS)


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap of the column ``token``, at most ``2 ** (BITMAP_BITS - 6)`` numbers from the cluster."""
    place = F.shiftrightunsigned("token", 64 - BITMAP_BITS)
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    rows = hashes.select(place.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("bits"))
    found = rows.toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bit = _bit(hashes)
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def _item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """Every window of every item with the hashes of its shingles."""

    def run(batch: pa.RecordBatch) -> dict:
        items, texts, sizes, tokens = [], [], [], []
        for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            words = words_of(text)
            m = min(window, len(words))
            hashes = shingle_hashes(_codes(words), min(shingle, m)).view(np.int64) if m else []
            for s in range(len(words) - m + 1 if m else 0):
                items.append(item)
                texts.append(b" ".join(words[s : s + m]).decode())
                sizes.append(m)
                tokens.append(hashes[s : s + m - min(shingle, m) + 1])
        return {
            "item_id": pa.array(items, pa.string()),
            "window": pa.array(texts, pa.string()),
            "m": pa.array(sizes, pa.int32()),
            "tokens": pa.array(tokens, pa.list_(pa.int64())),
        }

    narrow = benchmark.select(F.col(item_col).cast("string"), F.col(text_col))
    return per_batch(narrow, run, "item_id string, window string, m int, tokens array<long>")


def _batches(texts: list[bytes | None]):
    """Words of whole texts, about ``CHUNK`` at a time, with the text each belongs to."""
    words: list[bytes] = []
    owners: list[int] = []
    sizes: list[int] = []
    for k, text in enumerate(texts):
        own = words_of(text)
        words += own
        owners.append(k)
        sizes.append(len(own))
        if len(words) >= CHUNK:
            yield words, np.repeat(owners, sizes)
            words, owners, sizes = [], [], []
    yield words, np.repeat(owners, sizes)


def _found(codes: np.ndarray, owner: np.ndarray, sizes: list[int], bitmap: np.ndarray):
    """Places and hashes of shingles inside one text that the bitmap knows."""
    for size in sizes:
        hashes = shingle_hashes(codes, size)
        at = np.nonzero(_in_bitmap(bitmap, hashes))[0]
        at = at[owner[at] == owner[at + size - 1]]
        yield size, at, hashes[at]


def _token_counts(docs: DataFrame, text_col: str, sizes: list[int], bitmap) -> DataFrame:
    """How often every shingle of the benchmark occurs in all documents."""

    def run(batch: pa.RecordBatch) -> dict:
        kept = [np.empty(0, np.uint64)]
        for words, owner in _batches(as_bytes(batch.column(0))):
            kept += [h for _, _, h in _found(_codes(words), owner, sizes, bitmap.value)]
        token, n = np.unique(np.concatenate(kept), return_counts=True)
        return {"token": pa.array(token.view(np.int64)), "n": pa.array(n)}

    counted = per_batch(docs.select(text_col), run, "token long, n long")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each distinct window with its rarest shingle and that one's place; windows with an absent one are gone."""
    distinct = windows.groupBy("window", "m").agg(F.first("tokens").alias("tokens"))
    tokens = distinct.select("window", "m", F.posexplode("tokens").alias("offset", "token"))
    ranked = tokens.join(counts, "token", "left").select(
        "window", "m", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset").alias("rank")
    )
    rarest = ranked.groupBy("window", "m").agg(F.min("rank").alias("rank")).where("rank.n > 0")
    return rarest.select("window", "m", "rank.token", "rank.offset")


def _scan(docs: DataFrame, id_col: str, text_col: str, window: int, sizes: list[int], bitmap) -> DataFrame:
    """One row per document: number of words, and the places of prefix shingles with the words around them."""
    place = pa.struct([("token", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("around", pa.string())])

    def run(batch: pa.RecordBatch) -> dict:
        n_words = np.zeros(batch.num_rows, np.int64)
        found: list[list] = [[] for _ in range(batch.num_rows)]
        for words, owner in _batches(as_bytes(batch.column(2))):
            if not words:
                continue
            own, first, n = np.unique(owner, return_index=True, return_counts=True)
            n_words[own] = n
            start = dict(zip(own.tolist(), zip(first.tolist(), (first + n).tolist())))
            for size, at, hashes in _found(_codes(words), owner, sizes, bitmap.value):
                for i, k, token in zip(at.tolist(), owner[at].tolist(), hashes.view(np.int64).tolist()):
                    lo, hi = start[k]
                    left = max(lo, i - window + size)
                    around = b" ".join(words[left : min(hi, i + window)]).decode()
                    found[k].append({"token": token, "at": i - lo, "lead": i - left, "around": around})
        return {
            "_id": batch.column(0),
            "_hash": batch.column(1),
            "n_words": pa.array(n_words),
            "places": pa.array(found, pa.list_(place)),
        }

    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), text_hash(text_col).alias("_hash"), F.col(text_col))
    places = "array<struct<token: long, at: int, lead: int, around: string>>"
    return per_batch(narrow, run, f"_id {id_type}, _hash long, n_words long, places {places}")


def _occurrences(scan: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Where windows stand: the join on prefix shingles, bounds on place and length, and the words compared."""
    places = scan.select("_id", "_hash", "n_words", F.explode("places").alias("p")).select(
        "_id", "_hash", "n_words", "p.token", "p.at", "p.lead", "p.around"
    )
    start = F.col("at") - F.col("offset")
    bounded = (
        places.join(prefixes, "token")
        .where((F.col("m") <= F.col("n_words")) & (start >= 0) & (start + F.col("m") <= F.col("n_words")))
        .withColumn("start", start)
    )
    here = F.slice(F.split("around", " "), F.col("lead") - F.col("offset") + 1, F.col("m"))
    exact = bounded.where(F.array_join(here, " ") == F.col("window"))
    return exact.select("_id", "_hash", "start", "m", "window").distinct()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    shingle: int = 3,
    share: int = 20,
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_hit``, ``items``, ``contaminated``, ``_hash``.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one. ``n_hit`` counts the document's words inside any occurrence of
    a window, ``items`` are the items whose windows occur, as sorted strings. A
    row is contaminated if it has hits and at least one word in ``share`` is hit.

    Null and wordless texts have no words and no hits; wordless items have no
    windows. Items that share a window all count; an item without an id gives
    hits and is not listed. Repeated rows give repeated results, rows of one id
    with different texts are judged apart. Only the named columns are read.
    """
    spark = docs.sparkSession
    windows = written(_item_windows(benchmark, item_col, item_text_col, window, shingle), "item-windows")
    sizes = sorted(r[0] for r in windows.select(F.least(F.lit(shingle), "m")).distinct().collect())
    known = spark.sparkContext.broadcast(_bitmap(windows.select(F.explode("tokens").alias("token"))))
    prefixes = written(_prefixes(windows, _token_counts(docs, text_col, sizes, known)), "item-prefixes")
    wanted = spark.sparkContext.broadcast(_bitmap(prefixes))
    scan = written(_scan(docs, id_col, text_col, window, sizes, wanted), "document-places")
    hits = written(_occurrences(scan, prefixes), "item-hits")

    ends = F.col("start") + F.col("m")
    before = Window.partitionBy("_id", "_hash").orderBy("start", "m").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(ends).over(before), F.lit(0))
    spans = hits.select("_id", "_hash", "start", "m").distinct()
    covered = spans.select("_id", "_hash", F.greatest(F.lit(0), ends - F.greatest("start", reached)).alias("new"))
    n_hit = covered.groupBy("_id", "_hash").agg(F.sum("new").alias("n_hit"))
    listed = windows.select("window", "item_id").where("item_id is not null").distinct()
    found = hits.select("_id", "_hash", "window").distinct().join(listed, "window")
    items = found.groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"))

    out = scan.select("_id", "_hash", "n_words")
    for part in (n_hit, items):
        part = part.withColumnsRenamed({"_id": "_part_id", "_hash": "_part_hash"})
        same = F.col("_id").eqNullSafe(F.col("_part_id")) & (F.col("_hash") == F.col("_part_hash"))
        out = out.join(part, same, "left").drop("_part_id", "_part_hash")
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
        "_hash",
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Input rows that are not contaminated; repeated rows stay or go together."""
    found = contamination(docs, benchmark, id_col, text_col, **options)
    (key,) = unused(docs.columns, "_key")
    bad = found.where("contaminated").select(key_of([], F.col(id_col), F.col("_hash")).alias(key)).distinct()
    keyed = docs.withColumn(key, row_key(docs, id_col, text_col))
    return keyed.join(bad, key, "left_anti").select(*docs.columns)
