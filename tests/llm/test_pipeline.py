"""The pipeline and its stages against plain versions."""

import os

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_decontaminate import plain as plain_contamination
from tests.llm.test_simhash import plain_fast
from vellum.llm import langid, mixing, queries, secrets
from vellum.llm.shared import table

DATA = "/root/testdata/sf0.001"


def test_run_against_plain_stages(spark):
    docs = table(spark, DATA, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.fit(docs)
    labels = langid.label_all(model, [r["text"] for r in rows.values()])
    kept = [d for d, (lang, score, _) in zip(rows, labels) if lang != "und" and score >= corpus_pipeline.LANGUAGE_SCORE]
    assert len(kept) > 0.9 * len(rows)
    found = plain_fast(sorted((d, rows[d]["text"]) for d in kept))
    kept = [d for d, _, component in found if d == component]
    items = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    kept = [r[0] for r in plain_contamination([(d, rows[d]["text"]) for d in kept], items) if not r[4]]
    cuts = secrets.calibrate(docs.where(docs["doc_id"].isin(kept)))
    texts = {d: secrets.redacted(rows[d]["text"], secrets.find_spans(rows[d]["text"], cuts), "[SECRET]") for d in kept}
    clean = spark.createDataFrame([(d, t, rows[d]["source"]) for d, t in texts.items()], "doc_id long, text string, source string")
    want = sorted((r["doc_id"], texts[r["doc_id"]], k + 1) for r in mixing.mix(clean).collect() for k in range(r["copies"]))

    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == [*docs.columns, "copy"]
    out = got.collect()
    assert sorted((r["doc_id"], r["text"], r["copy"]) for r in out) == want
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_stages_with_odd_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the quick brown fox jumps over the lazy dog " * 5
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "an entirely different line of words", "en", None, 1)]
    for docs in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, kind), DATA).collect()
    assert len(kept) == 3


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    got = queries.QUERIES[name](spark, DATA)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    columns = sorted(got.columns)
    assert sorted(names) == columns
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)


CONTRACT = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op3_embeddings": ["vec_id", "n_links", "component_id", "kept"],
    "op5_quality": ["doc_id", "held_out", "score", "predicted"],
    "op7_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_language": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_queries_without_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    source = table(spark, DATA, "embeddings" if name == "op3_embeddings" else "documents")
    assert got.columns[: len(CONTRACT[name])] == CONTRACT[name]
    assert got.count() == source.count()
