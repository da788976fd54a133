"""Decontamination against a plain search for every window in every text."""

import random
import re

from vellum.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, window=13, share=20):
    known = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            known.setdefault(tuple(w[s : s + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for m in {len(k) for k in known}:
            for s in range(len(w) - m + 1):
                if (k := tuple(w[s : s + m])) in known:
                    hit.update(range(s, s + m))
                    found |= known[k]
        listed = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), listed, bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=repr)


def make():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of", "É", "straße", "ÀB"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.randint(14, 30))) for i in range(30)]
    items += [(30, "Two words"), (31, "single"), (32, None), (33, ""), (34, "--- !!"), (None, line(20))]
    items += [(35, items[0][1]), (7, items[1][1]), (36, line(13)), (37, "a " * 40)]
    docs = []
    for i in range(120):
        parts = [line(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            _, text = rng.choice(items)
            w = (text or "").split()
            cut = rng.randint(0, max(0, len(w) - 5))
            parts += [rng.choice([", ", "\n", "--"]).join(w[cut : cut + rng.randint(5, 30)]).upper(), line(rng.randint(0, 300))]
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "?!"), (None, items[3][1]), (203, "two\x00WORDS"), (203, "other text"), (203, "other text")]
    docs += [(204, "a " * 300_000), (205, line(5000) + " " + items[4][1]), (206, "single"), (207, "x" * 200_000)]
    return docs, items


def frames(spark, docs, items):
    a = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_words int, window string")
    return a, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, tokens int")


def test_against_plain_search(spark):
    docs, items = make()
    got = decontaminate.contamination(*frames(spark, docs, items)).collect()
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got]
    want = plain(docs, items)
    assert sorted(rows, key=repr) == want
    assert any(r[4] for r in want) and any(r[2] and not r[4] for r in want)


def test_rows_that_stay(spark):
    docs, items = make()
    a, b = frames(spark, docs, items)
    kept = decontaminate.decontaminate(a, b)
    assert kept.columns == a.columns
    want = [d for d, *_, bad in plain(docs, items) if not bad]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    docs, items = make()
    a, b = frames(spark, docs[:5], items[:3])
    none_a, none_b = a.limit(0), b.limit(0)
    assert decontaminate.contamination(none_a, b).count() == 0
    assert [r["n_hit"] for r in decontaminate.contamination(a, none_b).collect()] == [0] * 5
    assert decontaminate.decontaminate(a, none_b).count() == 5
