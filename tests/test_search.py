import random
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.operators import search as search_module
from vellum.operators.search import build_blocks, build_postings, initial, near, phrase, postings_in, prefix, search, search_postings, term

SCHEMA = "id string, revision bigint, og_title string, content string, links array<string>"
ROWS = [
    ("1", 1, "Façade Interview.docx", "naïve Ǖber x² snake_case", ["https://github.com/a", "https://foo.bar/q?x=1&y=2"]),
    ("2", 1, "docx report interview", "確認する テスト amex", []),
    ("3", 1, "report a.docx b", "one two three four five six", ["http://gitlab.com/z"]),
    ("4", 1, "plain", "İstanbul STRASSE straße ﬁ", ["https://github.community/x"]),
    ("5", 1, "don't stop", "éclair 1,000 a\u200db ไทย नमस्ते", []),
]
CASES = [
    (term("facade"), "1"), (term("façade"), "1"), (term("uber"), ""), (term("Ǖber"), "1"), (term("x²"), "1"),
    (term("x2"), ""), (term("x"), "14"), (term("snake_case"), "1"), (phrase("*.docx").only("title"), "123"),
    (phrase("https://github.com/*").only("links"), "1"), (prefix("https://github.com").only("links"), "14"),
    (term("interview").only("title") & term("github").only("links"), "1"), (term("確認"), ""), (term("確認する"), "2"),
    (prefix("確認"), "2"), (term("strasse"), "4"), (term("straße"), "4"), (term("fi"), ""), (term("eclair"), "5"),
    (term("1000"), ""), (phrase("1 000"), "5"), (term("reports"), ""), (term("interview") - term("github"), "2"),
    (term("interview") | term("amex"), "12"), ((term("interview") | term("amex")) - term("github"), "2"),
    ((term("interview") & term("amex")) | term("report"), "23"), (term("one") & term("three"), "3"),
    (phrase("one two"), "3"), (phrase("one three"), ""), (near(["one", "four"], 2), "3"), (near(["one", "four"], 1), ""),
    (near(["two", "one"]), "3"), (initial("docx"), "2"), (initial("interview"), ""),
    (term("amex").only("title", "content"), "2"), (term("1").only("id"), ""), (phrase("a https").only("links"), "1"),
    (prefix("inter"), "12"), (term("INTERVIEW"), "12"), (term(""), ""), (term("github") | term(""), "14"),
    (term("github") & term(""), ""), (term("docx").excluding("title"), ""), (near(["one", ""]), ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def postings(docs):
    return build_postings(docs).cache()


@pytest.mark.parametrize("query, ids", CASES)
def test_cases(docs, postings, query, ids):
    assert "".join(sorted(r["id"] for r in search(docs, query).collect())) == ids
    assert "".join(sorted(r["id"] for r in search_postings(postings, query).collect())) == ids


def test_no_query_keeps_all(docs):
    assert search(docs, None).count() == 5


def test_words_of_a_query_are_words_of_its_text(spark):
    """Every character, alone and inside a word, is split and folded alike in texts and queries."""
    from vellum.functions.text import query_tokens, tokens

    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    texts = [" ".join(f"a{chr(c)}b" for c in codes[k : k + 4096]) for k in range(0, len(codes), 4096)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", tokens(F.col("t")).alias("w"))
    for r in rows.collect():
        assert list(query_tokens(texts[r["n"]])) == r["w"]


def test_random_queries_against_a_full_text_index(spark):
    rand = random.Random(11)
    words = ["ab", "abc", "b", "c", "d"]
    text = lambda n: " ".join(rand.choice(words) for _ in range(rand.randint(0, n)))
    rows = [(str(i), 1, text(4), text(12), [text(2) for _ in range(rand.randint(0, 2))]) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, content, links)")
    for i, _, title, content, links in rows:
        db.execute("insert into t(rowid, title, content, links) values (?,?,?,?)", (int(i), title, content, str(links).replace("'", '"')))
    docs = spark.createDataFrame(rows, SCHEMA).cache()
    postings = build_postings(docs).cache()

    def leaf():
        kind, body = rand.randint(0, 5), " ".join(rand.choice(words) for _ in range(rand.randint(1, 3)))
        if kind == 0:
            return prefix(body), f'"{body}" *'
        if kind == 1:
            return initial(body), f'^"{body}"'
        if kind == 2:
            n, other = rand.randint(0, 4), rand.choice(words)
            return near([body, other, "b"], n), f'NEAR("{body}" {other} b, {n})'
        if kind == 3:
            column = rand.choice(["title", "content", "links"])
            return phrase(body).only(column), f'{column} : "{body}"'
        if kind == 4:
            return phrase(body).excluding("title"), f'- {{title}} : "{body}"'
        return phrase(body), f'"{body}"'

    def tree(depth):
        if depth == 0 or rand.random() < 0.3:
            return leaf()
        (a, x), (b, y) = tree(depth - 1), tree(depth - 1)
        op = rand.choice(["AND", "OR", "NOT"])
        return {"AND": a & b, "OR": a | b, "NOT": a - b}[op], f"(({x}) {op} ({y}))"

    for _ in range(25):
        query, spelled = tree(2)
        wanted = sorted(str(r[0]) for r in db.execute("select rowid from t where t match ?", (spelled,)))
        assert sorted(r["id"] for r in search(docs, query).collect()) == wanted, spelled
        assert sorted(r["id"] for r in search_postings(postings, query).collect()) == wanted, spelled


def test_postings_of_repeated_and_null_keys(spark):
    rows = [
        ("a", 0, "The the cat", "of the of", ["http://x.y"]), ("a", 0, None, "cat of", None), ("a", 1, "", "", []),
        (None, None, "x", None, ["q", None]), (None, None, "x y", None, None),
    ]
    found = build_postings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["col"], r["term"], r["id"], r["revision"], r["positions"]) for r in found), key=repr) == sorted([
        ("title", "the", "a", 0, [0, 1]), ("title", "cat", "a", 0, [2]),
        ("content", "of", "a", 0, [0, 1, 2]), ("content", "the", "a", 0, [1]), ("content", "cat", "a", 0, [0]),
        ("links", "http", "a", 0, [0]), ("links", "x", "a", 0, [1]), ("links", "y", "a", 0, [2]),
        ("title", "x", None, None, [0, 0]), ("title", "y", None, None, [1]),
        ("links", "q", None, None, [0]), ("links", "null", None, None, [1]),
    ], key=repr)


def test_blocks_hold_the_same_postings(spark, monkeypatch):
    rows = [
        ("b", 0, "The the cat", "of the of", ["http://x.y"]), ("a", 1, None, "cat of", None), ("a", 0, "", "the", []),
        (None, None, "the", None, ["q", None]), ("c", None, "the", None, None),
    ]
    twice = [*rows, ("b", 0, "cat", "of", None), (None, None, "x the", None, None)]
    for some, once in ((rows, True), (rows, False), (twice, False)):
        docs = spark.createDataFrame(some, SCHEMA)
        wanted = sorted(map(tuple, build_postings(docs).collect()), key=repr)
        blocks = build_blocks(docs, once)
        assert sorted(map(tuple, postings_in(blocks).collect()), key=repr) == wanted
        for r in blocks.collect():
            assert (r["first"], r["n"], r["occurrences"]) == (r["docs"][0]["id"], len(r["docs"]), sum(len(d["positions"]) for d in r["docs"]))
    one = build_blocks(spark.createDataFrame(rows, SCHEMA).coalesce(1), True)
    assert [d["id"] for d in one.where("term = 'the' and col = 'title'").first()["docs"]] == ["b", "c", None]
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_postings_make_no_group_for_a_word(docs):
    """Words are grouped inside a document's array; groups by term sorted every word and spilled."""
    plan = build_postings(docs)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate [id" in plan and "Aggregate [term" not in plan


def test_postings_sort_no_array_of_words(docs):
    """A document's words are numbers sorted together with others'; arrays of words were walked word by word."""
    plan = build_postings(docs)._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "sort_array" not in plan


def test_postings_of_documents_placed_apart(monkeypatch):
    """Cuts between documents, of a batch that is itself a slice, change no row."""
    words = [[["b", "a", "b"]], [["a"], None, ["c", "a"]], [[]], [None], [["c"]], [["b", "b"]]]
    batch = pa.RecordBatch.from_pydict(
        {
            "id": [*"uvwxyz"],
            "revision": pa.array([1, None, 3, 4, 5, 6], pa.int64()),
            "title": pa.array([[[]]] * 6, pa.list_(pa.list_(pa.string()))),
            "content": words,
            "links": pa.array([[None]] * 6, pa.list_(pa.list_(pa.string()))),
        }
    )
    wanted = {
        ("v", None, "a"): [0, 1], ("v", None, "c"): [0], ("y", 5, "c"): [0], ("z", 6, "b"): [0, 1], ("u", 1, "a"): [1], ("u", 1, "b"): [0, 2],
    }
    for together in (1, 2, 4, 1 << 18):
        monkeypatch.setattr(search_module, "WORDS_TOGETHER", together)
        for first in (0, 1):
            rows = [r for part in search_module._placed(iter([batch.slice(first)])) for r in part.to_pylist()]
            assert all(r["col"] == "content" for r in rows)
            found = [((r["id"], r["revision"], r["term"]), r["positions"]) for r in rows]
            assert len(found) == len(dict(found))
            assert dict(found) == {k: p for k, p in wanted.items() if not first or k[0] != "u"}
