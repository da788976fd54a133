"""SimHash near-duplicates against a plain all-pairs version."""

import pytest
import xxhash
from pyspark.sql import types as T

from vellum.llm import simhash

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("component_id", T.StringType()),
    ]
)


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows, radius=2):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for (doc, _), fp, g in zip(rows, prints, group):
        ids = [d for (d, _), h in zip(rows, group) if h == g and d is not None]
        out.append((doc, f"{fp:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def result(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = simhash.near_duplicates(docs).collect()
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr)


def rows_of_every_kind():
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(100 + i, base.replace(f"word{i * 7} ", f"Other{i} ")) for i in range(30)]
    rows += [(10 + i, base.upper()) for i in range(20)]
    rows += [(1, None), (2, ""), (3, " \t\n"), (None, None), (4, "one"), (5, "one two"), (6, "ONE\x0bTWO"), (7, "é É")]
    rows += [(8, "x " * 70_000), (8, "x " * 70_000), (9, "a b c d"), (None, "lonely text without an id")]
    return rows


def test_against_all_pairs(spark):
    rows = rows_of_every_kind()
    assert result(spark, rows) == plain(rows)


def test_bits_of_single_words(spark):
    """Chains of few-bit differences are followed across cells and tiles."""
    found = simhash._steps(2)
    assert len(found) == 21
    rows = [(i, f"w{i}") for i in range(3000)]
    assert result(spark, rows) == plain_fast(rows)


def plain_fast(rows, radius=2):
    import numpy as np

    prints = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    group = np.arange(len(rows))
    for i in range(len(rows)):
        for j in np.nonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= radius)[0]:
            group[group == max(group[i], group[j])] = min(group[i], group[j])
    return sorted(((d, f"{int(p):016x}", rows[g][0]) for (d, _), p, g in zip(rows, prints, group)), key=repr)


def test_close_fingerprints_in_small_tiles(spark, monkeypatch):
    """Fingerprints a few bits apart, many to a cell, so that cells hold several blocks."""
    import numpy as np

    monkeypatch.setattr(simhash, "TILE", 8)
    rng = np.random.default_rng(1)
    prints = {int(rng.integers(0, 2**63)) for _ in range(40)}
    for p in list(prints):
        for _ in range(12):
            p ^= 1 << int(rng.integers(0, 63))
            prints.add(p)
    prints = sorted(prints)
    classes = spark.createDataFrame([(p,) for p in prints], "fp long")
    tiles, cells = simhash._tiles(classes)
    edges = simhash._compare(simhash._tile_pairs(tiles, cells, 2), 2).collect()
    group = {p: p for p in prints}
    for a, b in edges:
        assert (a ^ b).bit_count() <= 2
        old, new = group[a], group[b]
        group = {k: new if g == old else g for k, g in group.items()}
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                assert group[a] == group[b]


def test_keep_first(spark):
    rows = rows_of_every_kind()
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    components = {(c, None) if c is not None else (None, f) for _, f, c in plain(rows)}
    got = kept.collect()
    assert len(got) == len(components)
    assert {r["doc_id"] for r in got} == {c for c, _ in components}


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty_table(spark, schema):
    docs = spark.createDataFrame([], schema)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_first(docs).count() == 0
