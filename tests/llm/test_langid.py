"""Language identification: paths against all paths, spans of mixed texts, held-out accuracy."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import langid
from vellum.llm.shared import fold, table


def best_path(scores, switch):
    states = range(scores.shape[1])
    paths = itertools.product(states, repeat=len(scores))
    value = lambda p: sum(scores[i, s] for i, s in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:]))
    return max(value(p) for p in paths), value


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    lengths = np.array([3, 0, 6, 1, 5, 6])
    scores = rng.normal(0, 2, (int(lengths.sum()), 3)).astype(np.float32)
    states = langid.viterbi(scores, lengths, 1.5)
    at = 0
    for n in lengths:
        if n:
            best, value = best_path(scores[at : at + n].astype(float), 1.5)
            assert abs(value(states[at : at + n].tolist()) - best) < 1e-4
        at += n


def test_gram_buckets_do_not_cross_words():
    together, owners = langid.gram_buckets(["abc", "é", "中文字"], langid.ORDERS, langid.BITS)
    for k, word in enumerate(["abc", "é", "中文字"]):
        alone, _ = langid.gram_buckets([word], langid.ORDERS, langid.BITS)
        assert sorted(together[owners == k]) == sorted(alone)


EN = "the quick brown fox jumps over the lazy dog and the other animals of this forest with great joy"
DE = "der schnelle braune fuchs springt über den faulen hund und die anderen tiere dieses waldes mit freude"
RU = "быстрая коричневая лиса прыгает через ленивую собаку и других животных этого леса с радостью"


def model(spark):
    rows = [(i, t, lang) for i in range(5) for t, lang in ((EN, "en"), (DE, "de"), (RU, "ru"))]
    rows += [(90, None, "en"), (91, "", "de"), (92, "no language", None)]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_spans_of_mixed_texts_and_odd_rows(spark):
    fitted = model(spark)
    assert fitted.langs == ["de", "en", "ru"]
    assert fitted.scripts["cyrillic"] == [2] and fitted.scripts["latin"] == [0, 1]
    rows = [(1, f"{EN} {DE} {RU} {DE}"), (2, None), (3, ""), (4, "123 ² !? 456"), (5, EN.upper()), (5, EN.upper())]
    rows += [(6, "a" * 300_000), (7, (EN + " ") * 3000), (None, RU), (8, "中文")]
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, language string, score double")
    got = langid.identify(docs, fitted)
    assert got.columns == ["doc_id", "text", "score", "language"]
    by_id = {r["doc_id"]: r["language"] for r in got.collect()}
    n = [len(langid.words_of(t)) for t in (EN, DE, RU, DE)]
    edges = np.cumsum([0, *n]).tolist()
    spans = [(s["lang"], s["first"], s["past"]) for s in by_id[1]["spans"]]
    assert spans == list(zip(["en", "de", "ru", "de"], edges, edges[1:]))
    assert [by_id[k]["lang"] for k in (1, 2, 3, 4, 5, 7, None)] == ["de", "und", "und", "und", "en", "en", "ru"]
    assert by_id[2]["score"] == 0.0 and not by_id[4]["spans"]
    assert all(0 <= v["score"] <= 1 for v in by_id.values())


def test_many_languages_and_rare_ones(spark):
    rng = np.random.default_rng(2)
    for n in (129, 300):
        scores = rng.normal(0, 1, (40, n)).astype(np.float32)
        scores[:, n - 1] += 9
        assert set(langid.viterbi(scores, np.array([40]), 2.0).tolist()) == {n - 1}
    made = {f"l{k:03d}": " ".join(chr(0x4E00 + 40 * k + j) * 2 for j in range(30)) for k in range(130)}
    rows = [(k, text, lang) for k, (lang, text) in enumerate(made.items())]
    rows += [(1000 + k, "the same frequent text of one language", "en") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = langid.fit(docs, sample=20)
    assert fitted.langs == ["en", *made]
    found = {r["lang"]: r["language"]["lang"] for r in langid.identify(docs, fitted).collect()}
    assert found == {lang: lang for lang in fitted.langs}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    fitted = langid.fit(none)
    some = spark.createDataFrame([(1, EN)], "doc_id long, text string")
    assert langid.identify(some, fitted).first()["language"]["lang"] == "und"
    assert langid.identify(none, model(spark)).count() == 0


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    held = fold("doc_id", 5) == 0
    fitted = langid.fit(docs.where(~held))
    found = langid.identify(docs.where(held), fitted).where(F.length("text") >= 40)
    right, n = found.agg(F.sum((F.col("language.lang") == F.col("lang")).cast("int")), F.count("lang")).first()
    assert n > 150 and right / n >= 0.98
