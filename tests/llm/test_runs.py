"""Periodic runs: groups, runs and collapsed texts against plain searches."""

import hashlib
import zlib
from itertools import pairwise

from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import queries, runs


def plain_runs(words, least=6, powers=4):
    """For every period the maximal stretches, without those that a divisor of it explains."""
    found = []
    for p in range(1, len(words) // powers + 1):
        same = [i for i in range(len(words) - p) if words[i] == words[i + p]]
        cuts = [0, *(k + 1 for k, (a, b) in enumerate(pairwise(same)) if b != a + 1), len(same)]
        for a, b in pairwise(cuts):
            if a < b:
                start, size = same[a], b - a + p
                part = words[start : start + size]
                smaller = any(part[q:] == part[:-q] for q in range(1, p))
                if size >= max(least, powers * p) and not smaller:
                    found.append((start, size, p))
    return sorted(found)


def plain_collapse(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


PERIODIC = st.lists(
    st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 7), st.integers(0, 5)), max_size=5
).map(lambda parts: [x for unit, k, more in parts for x in (unit * (k + 1))[: len(unit) * k + more]])


@given(st.one_of(PERIODIC, st.lists(st.integers(0, 2), max_size=40)))
def test_groups_are_lyndon_words(symbols):
    group, length = runs.lyndon_groups(symbols, 4)
    for i in range(len(symbols)):
        j = i + 1
        while j < len(symbols) and symbols[j:] > symbols[i:]:
            j += 1
        assert length[group[i]] == j - i
    words = [tuple(symbols[i : i + length[g]]) for i, g in enumerate(group)]
    assert len({(g, w) for g, w in zip(group, words, strict=True)}) == len(set(words)) == len(set(group))


@settings(max_examples=400)
@given(st.one_of(PERIODIC, st.lists(st.integers(0, 2), max_size=60)))
def test_runs(symbols):
    assert runs.find_runs(symbols) == plain_runs(symbols)
    assert runs.find_runs(symbols, 2, 2) == plain_runs(symbols, 2, 2)
    assert runs.find_runs(symbols, 1, 3) == plain_runs(symbols, 1, 3)
    assert runs.collapse(symbols, runs.find_runs(symbols)) == plain_collapse(symbols, plain_runs(symbols))


def test_very_long_texts():
    assert runs.find_runs(["a"] * 300_000) == [(0, 300_000, 1)]
    tail = [f"w{k}" for k in range(1000)] * 50
    assert runs.find_runs(["x", *tail, "y"]) == [(1, 50_000, 1000)]
    assert runs.find_runs([str(k) for k in range(200_000)]) == []


TEXTS = [
    "a b a b a b a b c",
    "x\ty\nx\x0by\x0cx\ry x y  end",
    "no\xa0break no\xa0break no\xa0break no\xa0break no\xa0break no\xa0break",
    "one two three",
    "",
    " \n ",
    None,
    "q " * 9 + "r q r q r q r q r é é é é é é",
]


def test_table(spark):
    rows = [(k, t, 1, "s") for k, t in enumerate(TEXTS)] + [(None, TEXTS[0], 2, "t"), (0, TEXTS[0], 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, periodic string")
    found = runs.scan(docs)
    assert found.columns == ["doc_id", "text", "runs", "periodic"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        words = (r["text"] or "").encode().split()
        want = plain_runs(words)
        assert [tuple(x) for x in r["periodic"]["runs"]] == want and r["runs"] in (1, 2)
        assert r["periodic"]["collapsed"].encode() == b" ".join(plain_collapse(words, want))
    assert runs.scan(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    texts = [" ".join(f"w{(k * j) % 11}" for j in range(k % 60)) for k in range(150)] + TEXTS
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(None, "a b c d e f g h", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op12_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for row_id, text, *_ in rows:
        words, h = (text or "").encode().split(), zlib.crc32(str("" if row_id is None else row_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], planted + 1
        found = plain_runs(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{s},{m},{p}\n" for s, m, p in found)
        r = got[row_id]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(plain_collapse(words, found))).hexdigest()
    assert planted > 5
