"""Input columns that are called like the helpers of operators and stages pass unchanged."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import fim, langid, licenses, runs, secrets, urlfilter
from vellum.llm.shared import table, unused

SF = "/root/testdata/sf0.001"
PACKAGE = Path(corpus_pipeline.__file__).parent / "vellum" / "llm"
#: Names in the sources of the package that stand for columns, one of each spelling, beside those of the documents.
NAMES = sorted(
    {
        name.lower()
        for file in [*PACKAGE.glob("*.py"), Path(corpus_pipeline.__file__)]
        for name in re.findall(r'"(_?[a-z]\w*)"', file.read_text(), re.IGNORECASE)
    }
    - {"doc_id", "text", "lang", "source", "n_chars", "copy"}
)


@pytest.fixture(scope="module")
def docs(spark):
    docs = table(spark, SF, "documents")
    return docs.select("*", *[F.concat(F.lit(f"{name} "), "doc_id").alias(name) for name in NAMES])


def test_names_are_found():
    assert {"_key", "_row", "_words", "_found", "_n_words", "_language", "_copies", "_all", "_least", "fp"} <= set(NAMES)
    assert unused(["_Key", "x"], "_key", "_key", "y") == ["_key_", "_key__", "y"]


def unchanged(out, *made):
    rows = out.collect()
    assert rows
    for r in rows:
        for name in NAMES:
            if name not in made:
                assert r[name] == f"{name} {r['doc_id']}"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns + (["copy"] if name == "mixing" else [])
    unchanged(out)


def test_operators(spark, docs):
    unchanged(licenses.scan(docs), "n_words", "places", "notices")
    unchanged(langid.identify(docs, langid.fit(docs)), "language")
    unchanged(secrets.scan(docs), "secrets")
    unchanged(fim.transform(docs), "fim")
    unchanged(runs.scan(docs), "periodic")
    pages = docs.withColumn("url", F.lit("https://example.com/en/"))
    unchanged(urlfilter.judge(pages, []), "judged", "url")
