"""Search from the rarest word on: results as by text, rows and files as few as promised."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import cascade
from vellum.operators.cascade import Count, find, looked_up, words_of
from vellum.operators.search import build_postings, initial, near, phrase, prefix, search, search_postings, term
from vellum.sources.store import Store

from test_fold import captures, row

WORDS = ["the", "of", "and", "rare", "rarer", "ere", "erewhon", "x"]
QUERIES = [
    term("the"),
    term("nowhere"),
    phrase(""),
    phrase("of the"),
    phrase("the the"),
    phrase("the rare of"),
    prefix("ra"),
    prefix("the ere"),
    prefix("ere of th"),
    initial("the"),
    initial("of rare"),
    near(["the", "rare"], 1),
    near(["of the", "x", "ere"], 3),
    near(["the", ""], 3),
    near([], 3),
    term("rare") & term("the"),
    (term("the") & prefix("er")) - phrase("of the"),
    (term("rarer") | phrase("and x")) & near(["of", "the"], 2),
    term("rare") - (term("the") | term("of")),
    term("nowhere") | term("x").only("title"),
    phrase("of the").excluding("content"),
    term("the").only("id"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)

    def text(n):
        return " ".join(rng.choices(WORDS, [30, 20, 10, 1, 1, 3, 2, 3], k=n))

    rows = [(f"d{k}", k % 2, text(rng.randint(0, 4)), text(rng.randint(0, 30)), [text(2), text(1)]) for k in range(150)]
    rows += [("empty", 1, None, None, None), ("only", 1, "rare rare rare", "", [])]
    return spark.createDataFrame(rows, "id string, revision bigint, og_title string, content string, links array<string>")


@pytest.fixture(scope="module")
def written(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "postings")
    build_postings(docs).repartitionByRange(6, "term", "col", "id").sortWithinPartitions("term").write.parquet(path)
    postings = spark.read.parquet(path)
    cascade.count_terms(postings).write.parquet(f"{path}-terms")
    return postings, spark.read.parquet(f"{path}-terms")


@pytest.mark.parametrize("number", range(len(QUERIES)))
@pytest.mark.parametrize("sent", [True, False])
def test_same_as_by_text_and_by_postings(docs, written, monkeypatch, number, sent):
    if not sent:
        monkeypatch.setattr(cascade, "BROADCAST_BYTES", -1)
    postings, terms = written
    query = QUERIES[number]
    found = sorted(map(tuple, cascade.search_terms(postings, terms, query).collect()))
    assert len(set(found)) == len(found)
    assert found == sorted(map(tuple, search(docs, query).collect())) == sorted(map(tuple, search_postings(postings, query).collect()))


def test_the_rarest_word_leads(written):
    postings, terms = written
    query = phrase("the rare of").only("content")
    counts, _ = looked_up(terms, query)
    assert set(counts) == set(words_of(query))
    for (word, _, column), count in counts.items():
        rows = postings.where((F.col("term") == word) & (F.col("col") == column))
        assert count == Count(rows.count(), rows.agg(F.sum(F.size("positions"))).first()[0])
    rarest = counts["rare", False, "content"].documents
    assert 4 * rarest < min(counts[w, False, "content"].documents for w in ("of", "the"))
    # every step holds the documents of the rarest word at most
    plan = cascade._Cascade(postings, counts)
    wanted = query.phrases()[0]
    order = sorted(range(3), key=lambda k: counts[wanted.words[k], False, "content"].documents)
    assert wanted.words[order[0]] == "rare"
    assert plan.starts(wanted, "content").count() <= rarest == plan.bound(query).documents


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_sides_are_sent_and_large_ones_are_not(written, monkeypatch):
    postings, _ = written
    counts = {w: Count(10**9, 10**10) for w in words_of(phrase("of the"))}
    assert "broadcast" not in joins(find(postings, counts, phrase("of the")))
    counts = dict.fromkeys(counts, Count(100, 100))
    assert "broadcast" in joins(find(postings, counts, phrase("of the")))


def test_prefix_is_a_range_of_files(spark, docs, tmp_path):
    """The dictionary names the files of a word or prefix; others are not opened."""
    store = Store(spark, str(tmp_path / "store"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with batches of many files
    try:
        for k in range(3):
            rows = [row(f"D{k}{j}", 1, f"w{j:03d} ere{j % 9} zz{k}", "s", 100 * k + j) for j in range(40)]
            store.add(captures(spark, rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = store.read("postings").inputFiles()
    found = store.search(prefix("ere"))
    assert 0 < len(found.inputFiles()) <= len(whole) / 2
    assert 0 < len(store.search(term("zz1")).inputFiles()) <= len(whole) / 4
    assert found.count() == 120
    assert store.search(term("zz1")).count() == 40 and store.search(term("nowhere")).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,ere)" in plan
    store.remove(spark.createDataFrame([("D11", 1)], "id string, revision bigint"))
    store.compact("postings")
    assert store.search(term("zz1")).count() == 39 and len(store.current().tables["terms"]) == 1


def test_a_store_without_dictionary(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.add(captures(spark, [row("A", 1, "some words", "s", 1)]))
    now = store.current()
    now.tables.pop("terms")
    assert store.search(phrase("some words"), now).count() == 1


def test_files_are_named_without_a_pattern(spark, written):
    """A pattern for each posting took most of the time of a change; ``file`` is folder and name."""
    postings, terms = written
    plan = cascade.count_terms(postings)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
    names = {r["file"] for r in terms.select("file").distinct().collect()}
    assert names and all(n.startswith("postings/part-") and n.count("/") == 1 for n in names)
