"""Licence scans in DataFrame functions: rare words find places, positions and key phrases confirm them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import unused

#: Runs of ASCII digits, lower-case ASCII letters and non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a notice's words that must stand in their places, besides its key phrase.
COVERAGE = 0.5


class Template(NamedTuple):
    """A notice: its label, its words, and the phrase in it that must stand whole."""

    label: str
    notice: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        n = len(self.key_words)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key_words)


# fixed values: the base phrases
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# fixed values: customary licence notices, in lower case without punctuation
TEMPLATES = (
    Template("mit", "released under the mit license", "mit license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge",
    ),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Template("bsd", "use of this source code is governed by a bsd style license", "bsd style license"),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms",
    ),
    Template("isc", "released under the isc license", "isc license"),
    Template("boost", "distributed under the boost software license", "boost software license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    Template("cc0", "licensed under cc0 1 0 universal", "cc0 1 0"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("proprietary", "copyright all rights reserved", "all rights reserved"),
)


def _words(text: Column) -> Column:
    """Words of a whole text with A-Z in lower case.

    ``lower`` does more than that, but only the Kelvin sign becomes an ASCII
    letter by it; any other letter keeps a word from being a template's.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    return F.regexp_extract_all(plain, F.lit(f"({WORD})"), F.lit(1))


def document_frequencies(docs: DataFrame, vocabulary: Sequence[str], text_col: str = "text") -> dict[str, int]:
    """In how many of all documents each word occurs; a number for each word comes to the driver."""
    known = F.filter(_words(F.col(text_col)), lambda w: w.isin(list(vocabulary)))
    counted = docs.select(F.explode(F.array_distinct(known)).alias("word")).groupBy("word").count()
    return {**dict.fromkeys(vocabulary, 0), **{r["word"]: r["count"] for r in counted.collect()}}


def _texts(rows: Sequence[Sequence[str]]) -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in row]) for row in rows])


def scan(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    base: Sequence[tuple[str, str]] = BASE,
    coverage: float = COVERAGE,
    text_col: str = "text",
    prefix: str = "",
) -> DataFrame:
    """Input rows with ``n_words``, ``places`` and ``notices``.

    ``places`` are the base phrases that stand in the text: label and first
    word. ``notices`` are the templates found: label, first word of the key
    phrase, and the share of the template's words that stand in their places
    around it. A template counts from its key phrase and ``coverage`` on.

    Every phrase is looked up by its word of the highest inverse document
    frequency over all documents; where that word stands, the positions of the
    phrase's and the template's other words relative to it are checked. Only
    texts with such a word are looked at closely, and nothing is shuffled.

    A null text is empty: no words, no places. Rows are judged one by one. Input
    columns of the new names are replaced; others may have any name, and
    ``prefix`` sets other new names.
    """
    phrases = [(label, phrase.split()) for label, phrase in base]
    keys = [*(words for _, words in phrases), *(t.key_words for t in templates)]
    seen = document_frequencies(docs, sorted({w for key in keys for w in key}), text_col)
    rarest = [min(range(len(key)), key=lambda k: (seen[key[k]], k)) for key in keys]
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (key, k) in enumerate(zip(keys, rarest)):
        postings.setdefault(key[k], []).append((t, k))
    anchors = sorted(postings)
    number = F.create_map(*[F.lit(x) for pair in zip(anchors, range(1, len(anchors) + 1)) for x in pair])
    listed = F.array(
        *[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in postings[w]]) for w in anchors]
    )
    key_words = _texts(keys)

    own = {n: f"{prefix}{n}" for n in ("n_words", "places", "notices")}
    kept = [F.col(c) for c in docs.columns if c not in own.values()]
    words_col, count_col, found_col = unused(docs.columns, "_words", "_n_words", "_found")
    split = docs.select(*kept, _words(F.col(text_col)).alias(words_col))
    words = F.col(words_col)
    at = F.filter(
        F.transform(words, lambda w, i: F.when(w.isin(anchors), F.struct(i.alias("i"), w.alias("w")))),
        lambda p: p.isNotNull(),
    )
    starts = F.flatten(
        F.transform(
            at,
            lambda p: F.transform(
                F.element_at(listed, F.element_at(number, p["w"])),
                lambda q: F.struct(q["t"].alias("t"), (p["i"] - q["k"]).alias("start")),
            ),
        )
    )
    whole = F.filter(
        starts,
        lambda c: (c["start"] >= 0)
        & (
            F.slice(words, F.greatest(c["start"], F.lit(0)) + 1, F.size(F.element_at(key_words, c["t"] + 1)))
            == F.element_at(key_words, c["t"] + 1)
        ),
    )
    none = F.lit(None).cast("array<struct<t: int, start: int>>")
    found = split.select(
        "*",
        F.size(words).cast("long").alias(count_col),
        F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in anchors])), whole).otherwise(none).alias(found_col),
    )

    base_labels = F.array(*[F.lit(label) for label, _ in phrases])
    notice_labels = F.array(*[F.lit(t.label) for t in templates])
    notice_words = _texts([t.words for t in templates])
    key_at = F.array(*[F.lit(t.key_at) for t in templates])
    n = len(phrases)
    places = F.transform(
        F.filter(found_col, lambda c: c["t"] < n),
        lambda c: F.struct(F.element_at(base_labels, c["t"] + 1).alias("label"), c["start"].cast("long").alias("first")),
    )

    def share(c: Column) -> Column:
        template = F.element_at(notice_words, c["t"] - n + 1)
        first = c["start"] - F.element_at(key_at, c["t"] - n + 1)
        there = F.transform(template, lambda w, j: (F.get(words, first + j) == w).cast("int"))
        return F.aggregate(there, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) / F.size(template)

    notices = F.filter(
        F.transform(
            F.filter(found_col, lambda c: c["t"] >= n),
            lambda c: F.struct(
                F.element_at(notice_labels, c["t"] - n + 1).alias("label"),
                c["start"].cast("long").alias("first"),
                share(c).alias("coverage"),
            ),
        ),
        lambda c: c["coverage"] >= coverage,
    )
    no_places = F.array().cast("array<struct<label: string, first: bigint>>")
    no_notices = F.array().cast("array<struct<label: string, first: bigint, coverage: double>>")
    return found.select(
        *kept,
        F.col(count_col).alias(own["n_words"]),
        F.coalesce(places, no_places).alias(own["places"]),
        F.coalesce(notices, no_notices).alias(own["notices"]),
    )
