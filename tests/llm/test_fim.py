"""Fill-in-middle: units, forms and lengths against a plain version, and every text comes back."""

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = st.text(st.sampled_from("ab é😀\n\t\x0b\x85\xa0<>PSM"), max_size=40)


def plain(text, row_id):
    """The contract, step by step, with one match after the other."""
    text = text or ""
    ends = [0, *(m.end() for m in UNIT.finditer(text))]
    n = len(ends) - 1
    h = hashlib.sha256(f"42:{'' if row_id is None else row_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", text, None, None
    a, b = ends[min(h1 % (n + 1), h2 % (n + 1))], ends[max(h1 % (n + 1), h2 % (n + 1))]
    if h4 % 100 < 80:
        return n, "spm", "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b], a, b - a
    return n, "psm", "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b], a, b - a


@given(TEXTS, st.integers(-5, 10**6))
def test_one_text(text, row_id):
    assert tuple(fim.transform_text(text, row_id).values()) == plain(text, row_id)


@given(TEXTS, st.integers(1, 9))
def test_long_texts_are_matched_in_stretches(text, stretch):
    assert fim.unit_ends(text, stretch) == [m.end() for m in UNIT.finditer(text)]


def test_very_long_texts():
    for text in ("a b\n" * 1_500_000, "x" * 3_000_000, " " * 3_000_000):
        assert fim.unit_ends(text) == [m.end() for m in UNIT.finditer(text)]


ROWS = [(k, f"word{k} über  den\n Fluß {'z ' * (k % 7)}") for k in range(200)] + [
    (None, "no id here"),
    (7, None),
    (8, ""),
    (9, " \n "),
    (10, "a <P> mark"),
    (11, "ends in <"),
    (11, "ends in <"),
    (12, "S> P> M> <S < S>"),
    (13, "$1 \\1 \\E"),
]


def test_table(spark):
    docs = spark.createDataFrame([(*r, 5, "x", "y") for r in ROWS], "doc_id long, text string, n int, form string, fim string")
    made = fim.transform(docs)
    assert made.columns == ["doc_id", "text", "n", "form", "fim"]
    rows = made.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(rows) == len(ROWS)
    forms = set()
    for r in rows:
        assert tuple(r["fim"]) == plain(r["text"], r["doc_id"])
        assert r["back"] == (r["text"] or "") and (r["n"], r["form"]) == (5, "x")
        forms.add(r["fim"]["form"])
    assert forms == {"plain", "spm", "psm"}
    assert fim.transform(docs.limit(0)).count() == 0


def test_other_marks(spark):
    marks = ("(a|", "[b", "\\c$")
    docs = spark.createDataFrame([(k, f"one two {k} [c (b| $1") for k in range(60)], "doc_id long, text string")
    made = fim.transform(docs, rate=100, spm=50, marks=marks)
    rows = made.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"), marks)).collect()
    assert {r["fim"]["form"] for r in rows} == {"spm", "psm"} and all(r["back"] == r["text"] for r in rows)
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("ab", "b", "c")):
        with pytest.raises(ValueError):
            fim.transform(docs, marks=bad)
