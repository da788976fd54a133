"""Tokens, postings and full-text queries, over text and over postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions.text import tokens
from vellum.operators import explore, search
from vellum.operators.search import initial, near, phrase, prefix, term
from vellum.plans import canonical
from vellum.plans.canonical import UNIQUE_SQL
from vellum.plans.registry import query


def _words(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


_LINKS_JSON = """'["' || array_to_string(links, '","') || '"]'"""
WORDS_SQL = (
    f"{UNIQUE_SQL}, words AS (SELECT id, revision, {_words('og_title')} AS title, {_words('content')} AS content, "
    f"{_words(_LINKS_JSON)} AS links FROM docs)"
)


def _keys(condition: str) -> str:
    return f"WITH {WORDS_SQL} SELECT id, revision FROM words WHERE {condition}"


def _any(condition: str) -> str:
    """A condition on the list ``c``, in any of the three columns."""
    return "(" + " OR ".join(condition.replace("$c", c) for c in ("title", "content", "links")) + ")"


@query(
    f"SELECT doc_id AS ord, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS words_md5 "
    f"FROM (SELECT doc_id, {_words('text')} AS w FROM documents)"
)
def tokenize(spark, sf):
    words = canonical.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), tokens(F.col("text")).alias("w"))
    return words.select(
        "ord", F.size("w").cast("bigint").alias("n"), F.md5(F.array_join("w", " ")).alias("words_md5")
    )


@query(
    f"""WITH {WORDS_SQL}, occurrences AS (
      SELECT id, revision, 'title' AS col, unnest(title) AS term, unnest(range(len(title))) AS pos FROM words
      UNION ALL SELECT id, revision, 'content', unnest(content), unnest(range(len(content))) FROM words
      UNION ALL SELECT id, revision, 'links', unnest(links), unnest(range(len(links))) FROM words)
    SELECT term, col, id, revision, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
    FROM occurrences GROUP BY term, col, id, revision"""
)
def term_postings(spark, sf):
    """positions of every word of every document."""
    postings = search.build_postings(canonical.stored_documents(spark, sf))
    return postings.select(
        "term", "col", "id", "revision", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")
    )


# name: (query, condition on the token lists)
_A, _B = "'the'", "'and'"
_PHRASE = "len([i FOR i IN range(1, len($c)) IF $c[i] = 'of' AND $c[i + 1] = 'the']) > 0"
_PREFIX = "len([w FOR w IN $c IF starts_with(w, 'ere')]) > 0"
_PHRASE_PREFIX = "len([i FOR i IN range(1, len($c)) IF $c[i] = 'of' AND starts_with($c[i + 1], 'th')]) > 0"
_NEAR = "len([i FOR i IN range(1, len($c) + 1) IF $c[i] = 'elle' AND list_contains($c[greatest(1, i - 3):i + 3], 'la')]) > 0"
_TERM = "list_contains($c, 'elle')"

CASES = {
    "term": (term("Elle"), _any(_TERM)),
    "phrase": (phrase("of, the"), _any(_PHRASE)),
    "prefix": (prefix("ere"), _any(_PREFIX)),
    "phrase_prefix": (prefix("of th"), _any(_PHRASE_PREFIX)),
    "column": (term("the").only("title"), "list_contains(title, 'the')"),
    "excluded_column": (term("the").excluding("content"), "list_contains(title, 'the') OR list_contains(links, 'the')"),
    "and_or_not": (
        (term("the") & prefix("ere")) - term("elle") | term("host3").only("links"),
        f"({_any('list_contains($c, ' + _A + ')')} AND {_any(_PREFIX)} AND NOT {_any(_TERM)}) OR list_contains(links, 'host3')",
    ),
    "near": (near(["elle", "la"], 2), _any(_NEAR)),
    "initial": (initial("the"), _any("coalesce($c[1], '') = 'the'")),
    "across_links": (
        phrase("p3 https").only("links"),
        "len([i FOR i IN range(1, len(links)) IF links[i] = 'p3' AND links[i + 1] = 'https']) > 0",
    ),
}


def _register(name: str) -> None:
    wanted, condition = CASES[name]

    def by_text(spark, sf):
        return search.search(canonical.stored_documents(spark, sf), wanted)

    def by_postings(spark, sf):
        return search.search_postings(search.build_postings(canonical.stored_documents(spark, sf)), wanted)

    by_text.__name__ = f"search_{name}"
    by_postings.__name__ = f"postings_{name}"
    query(_keys(condition))(by_text)
    query(_keys(condition))(by_postings)


for _name in CASES:
    _register(_name)


@query(_keys("TRUE"))
def search_nothing(spark, sf):
    """no query, no filter."""
    return search.search(canonical.stored_documents(spark, sf), None)


@query(
    f"""WITH {WORDS_SQL}, hits AS (SELECT id, revision FROM words WHERE {_any(_PHRASE)})
    SELECT s.id, s.revision, og_title AS title, og_description AS snippet, ts AS timestamp, src AS source, ord
    FROM seen s JOIN hits h ON s.id = h.id AND s.revision = h.revision
    WHERE src = 'urlscan' AND ts < '2026-01-01T20:00:00Z' ORDER BY ts DESC, s.id, s.revision, src, ord LIMIT 100"""
)
def search_explore(spark, sf):
    """search, source and time together, newest first."""
    hits = search.search(canonical.stored_documents(spark, sf), phrase("of the"))
    seen = canonical.stored_observations(spark, sf)
    return explore.explore(seen, hits, "urlscan", "2026-01-01T20:00:00Z")
