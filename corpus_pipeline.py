"""A corpus pipeline: five stages from raw documents to a training mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, langid, mixing, secrets, simhash
from vellum.llm.shared import table, unused, written

#: Documents with a lower language score are rejected; even texts of four languages in like parts reach it.
LANGUAGE_SCORE = 0.2


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: undetermined texts and those below the score go."""
    (label,) = unused(docs.columns, "_language")
    found = langid.identify(docs, langid.fit(docs), label=label)
    known = (F.col(f"{label}.lang") != langid.UNKNOWN) & (F.col(f"{label}.score") >= LANGUAGE_SCORE)
    return found.where(known).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return simhash.keep_first(docs, shingle=3, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 stands in a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=13, share=20)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the values of secrets replaced by a mark, and ``n_chars`` to match."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with the number of the copy."""
    return mixing.mixed_rows(docs, weights=(5, 2, 1), share=1.5, most=2)


STAGES = [
    ("language", keep_languages),
    ("simhash", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: SQL has no language models and no randomness tests; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
