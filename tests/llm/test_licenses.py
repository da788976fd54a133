"""Licence scans against a plain search for every phrase at every word."""

import random
import re

import pytest

from vellum.llm import licenses
from vellum.llm.shared import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    w = WORD.findall((text or "").translate(LOWER))
    at = lambda key: [s for s in range(len(w)) if w[s : s + len(key)] == key]
    places = sorted((label, s) for label, phrase in licenses.BASE for s in at(phrase.split()))
    notices = []
    for t in licenses.TEMPLATES:
        for s in at(t.key_words):
            first = s - t.key_at
            there = sum(0 <= first + j < len(w) and w[first + j] == x for j, x in enumerate(t.words))
            if there / len(t.words) >= licenses.COVERAGE:
                notices.append((t.label, s, there / len(t.words)))
    return len(w), places, sorted(notices)


def texts():
    rng = random.Random(8)
    notices = [t.notice for t in licenses.TEMPLATES]
    out = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(notices).split()
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(["license", "the", "mit", "x", "public"])
            parts += [rng.choice([" ", "-", ". "]).join(words[rng.randint(0, 2) :]).title(), "filler word " * rng.randint(0, 9)]
        out.append(" ".join(parts))
    return out + [
        None, "", "!?", "MIT License", "mit, (LICENSE) mit license", "apache\x00license é", "general public", "İ mİt license",
        "licen\u212ae apache \u212aey", "mit\u00a0license", "license", "mit license " * 40_000, "z" * 300_000, "mit license", "mit license",
    ]


def test_against_plain_search(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, places string, _words int").repartition(3)
    out = licenses.scan(docs)
    assert out.columns == ["doc_id", "text", "_words", "n_words", "places", "notices"]
    assert {r["_words"] for r in out.collect()} == {3}
    got = {r["doc_id"]: r for r in out.collect()}
    for doc, text in rows:
        r = got[doc]
        places = sorted((p["label"], p["first"]) for p in r["places"])
        notices = sorted((p["label"], p["first"], p["coverage"]) for p in r["notices"])
        n, want_places, want_notices = plain(text)
        assert (r["n_words"], places) == (n, want_places), text
        assert [x[:2] for x in notices] == [x[:2] for x in want_notices], text
        assert [x[2] for x in notices] == pytest.approx([x[2] for x in want_notices])


def test_rare_words_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([("Apache apache", ), ("the License",), (None,), ("license!",)], "text string")
    assert licenses.document_frequencies(docs, ["apache", "license", "mit"]) == {"apache": 1, "license": 2, "mit": 0}


def test_native_and_without_shuffle(spark, capsys):
    licenses.scan(table(spark, "/root/testdata/sf0.001", "documents")).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Exchange", plan)


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
