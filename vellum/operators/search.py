"""Full-text matching with composable queries.

A query is built from ``term``, ``phrase``, ``prefix``, ``initial`` and
``near``, limited to columns with ``only`` / ``excluding`` and combined with
``&``, ``|`` and ``-``. The same query runs over token arrays (``matches``, a
filter without a shuffle) or over postings (``search_postings``, which reads
the rows of its words only).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import link_tokens, query_tokens, tokens
from vellum.operators.once import computed_once
from vellum.schemas import BLOCKS, KEY

COLUMNS = ("title", "content", "links")
#: Documents are placed together until they have so many words.
WORDS_TOGETHER = 1 << 21


class Query:
    """Common part of all query nodes."""

    def __and__(self, other: "Query") -> "Query":
        return And(self, other)

    def __or__(self, other: "Query") -> "Query":
        return Or(self, other)

    def __sub__(self, other: "Query") -> "Query":
        return Not(self, other)

    def only(self, *columns: str) -> "Query":
        """Match in these columns only; an unindexed column matches nothing."""
        return self._limit(frozenset(columns))

    def excluding(self, *columns: str) -> "Query":
        return self._limit(frozenset(COLUMNS) - frozenset(columns))

    def _limit(self, columns: frozenset) -> "Query":
        raise NotImplementedError

    def phrases(self) -> list["Phrase"]:
        raise NotImplementedError

    def has_near(self) -> bool:
        return False

    def test(self, starts: Callable[["Phrase", str], Column]) -> Column:
        raise NotImplementedError

    def possible(self, present: Callable[["Phrase", str], Column], exact: bool = False) -> Column:
        """What must hold, from the words a column has; ``exact`` if that is all the query asks."""
        raise NotImplementedError


@dataclass(frozen=True)
class Phrase(Query):
    """Consecutive words of one column; the last may be a prefix.

    The text is split when the query meets a table, by the rule texts are split by.
    """

    text: str
    is_prefix: bool = False
    is_initial: bool = False
    columns: frozenset = frozenset(COLUMNS)

    @property
    def words(self) -> tuple[str, ...]:
        return query_tokens(self.text)

    @property
    def is_word(self) -> bool:
        return len(self.words) <= 1 and not self.is_initial

    def _limit(self, columns):
        return replace(self, columns=self.columns & columns)

    def phrases(self):
        return [self]

    def possible(self, present, exact=False):
        return reduce(Column.__or__, [present(self, c) for c in self.searched()], F.lit(False))

    def searched(self) -> list[str]:
        return [c for c in COLUMNS if c in self.columns] if self.words else []

    def test(self, starts):
        found = [
            F.array_contains(starts(self, c), 0) if self.is_initial else F.size(starts(self, c)) > 0
            for c in self.searched()
        ]
        return reduce(Column.__or__, found, F.lit(False))


@dataclass(frozen=True)
class Near(Query):
    """Phrases of one column with at most ``distance`` words between first and last."""

    parts: tuple[Phrase, ...]
    distance: int = 10

    def _limit(self, columns):
        return replace(self, parts=tuple(p._limit(columns) for p in self.parts))

    def phrases(self):
        return list(self.parts)

    def has_near(self):
        return True

    def possible(self, present, exact=False):
        shared = [c for c in COLUMNS if all(c in p.searched() for p in self.parts)]
        found = [reduce(Column.__and__, [present(p, c) for p in self.parts]) for c in shared]
        return reduce(Column.__or__, found, F.lit(False))

    def test(self, starts):
        if any(not p.words for p in self.parts):
            return F.lit(False)
        shared = [c for c in COLUMNS if all(c in p.columns for p in self.parts)]
        found = [self.close([starts(p, c) for p in self.parts]) for c in shared]
        return reduce(Column.__or__, found, F.lit(False))

    def close(self, positions: list[Column]) -> Column:
        """One pass over the merged positions, keeping the latest of each phrase."""
        events = F.array_sort(F.concat(*[_tagged(p, i) for i, p in enumerate(positions)]))
        far = -1_000_000_000
        start = F.struct(
            *[F.lit(far).alias(f"p{i}") for i in range(len(positions))], F.lit(False).alias("hit")
        )

        def step(state: Column, event: Column) -> Column:
            latest = [
                F.when(event["i"] == i, event["at"]).otherwise(state[f"p{i}"]) for i in range(len(positions))
            ]
            near = [
                event["at"] - at <= len(part.words) + self.distance for at, part in zip(latest, self.parts)
            ]
            return F.struct(
                *[at.alias(f"p{i}") for i, at in enumerate(latest)],
                (state["hit"] | reduce(Column.__and__, near)).alias("hit"),
            )

        return F.aggregate(events, start, step, lambda state: state["hit"])


def _tagged(positions: Column, number: int) -> Column:
    return F.transform(positions, lambda at: F.struct(at.cast("int").alias("at"), F.lit(number).alias("i")))


def shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda at: at - by)


@dataclass(frozen=True)
class _Pair(Query):
    left: Query
    right: Query

    def _limit(self, columns):
        return type(self)(self.left._limit(columns), self.right._limit(columns))

    def phrases(self):
        return self.left.phrases() + self.right.phrases()

    def has_near(self):
        return self.left.has_near() or self.right.has_near()


class And(_Pair):
    def test(self, starts):
        return self.left.test(starts) & self.right.test(starts)

    def possible(self, present, exact=False):
        return self.left.possible(present, exact) & self.right.possible(present, exact)


class Or(_Pair):
    def test(self, starts):
        return self.left.test(starts) | self.right.test(starts)

    def possible(self, present, exact=False):
        return self.left.possible(present, exact) | self.right.possible(present, exact)


class Not(_Pair):
    def test(self, starts):
        return self.left.test(starts) & ~self.right.test(starts)

    def possible(self, present, exact=False):
        left = self.left.possible(present, exact)
        return left & ~self.right.possible(present, exact) if exact else left


def phrase(text: str) -> Phrase:
    """Words in a row, punctuation ignored; no word at all matches nothing."""
    return Phrase(text)


def term(text: str) -> Phrase:
    """One word anywhere; text of several words is a phrase."""
    return phrase(text)


def prefix(text: str) -> Phrase:
    """A phrase whose last word may go on (F8)."""
    return replace(phrase(text), is_prefix=True)


def initial(text: str) -> Phrase:
    """A phrase at the very start of a column."""
    return replace(phrase(text), is_initial=True)


def near(texts: Sequence[str], n: int = 10) -> Near:
    return Near(tuple(phrase(t) for t in texts), n)


# ---------------------------------------------------------------- by scan


def with_tokens(docs: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Add one token array per indexed column."""
    made = {
        "title": lambda: tokens(F.col("og_title")),
        "content": lambda: tokens(F.col("content")),
        "links": lambda: link_tokens(F.col("links")),
    }
    return computed_once(docs, **{f"{c}_tokens": made[c]() for c in columns})


def _starts_in(words: Column, wanted: Phrase) -> Column:
    """Positions in a token array where the phrase starts."""
    last = len(wanted.words) - 1

    def same(word: Column, k: int) -> Column:
        if wanted.is_prefix and k == last:
            return F.startswith(word, F.lit(wanted.words[k]))
        return word == wanted.words[k]

    def here(word: Column, i: Column) -> Column:
        rest = [F.coalesce(same(F.get(words, i + k), k), F.lit(False)) for k in range(1, last + 1)]
        return F.when(reduce(Column.__and__, rest, same(word, 0)), i)

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def matches(query: Query | None) -> Column:
    """Predicate over the columns of ``with_tokens``; no query keeps every row."""
    if query is None:
        return F.lit(True)

    def starts(wanted: Phrase, column: str) -> Column:
        return _starts_in(F.col(f"{column}_tokens"), wanted)

    return query.test(starts)


def search(docs: DataFrame, query: Query | None) -> DataFrame:
    """Keys of the matching documents, straight from their text.

    Only the columns the query names are read and tokenised.
    """
    if query is None:
        return docs.select(*KEY)
    named = {c for wanted in query.phrases() for c in wanted.searched()}
    if not named:
        return docs.where(F.lit(False)).select(*KEY)
    return with_tokens(docs, [c for c in COLUMNS if c in named]).where(matches(query)).select(*KEY)


# ---------------------------------------------------------------- by postings


def build_postings(docs: DataFrame) -> DataFrame:
    """Positions of every word per column and document revision (F2).

    Documents are hashed by key first: the words of one document then meet in
    its own task, and the text crosses the network once instead of every
    occurrence of every word. There a word is a number in an array, and numbers
    of many documents are sorted at once: no group is made for a word, so nothing spills.
    """
    words = _words_of_texts(docs)
    kinds = dict(words.dtypes)
    key = ", ".join(f"{k} {kinds[k]}" for k in KEY)
    return words.mapInArrow(_placed, f"term string, col string, {key}, positions array<int>")


def build_blocks(docs: DataFrame, once: bool = False) -> DataFrame:
    """The same postings, with the documents of a word that a task placed together in one row.

    So what is sorted and written grows with the words of such pieces, not with
    those of documents. ``once`` promises that no key comes twice; then no text
    crosses the network. ``postings_in`` gives the rows of ``build_postings`` back.
    """
    return _words_of_texts(docs, once).mapInArrow(_blocked, BLOCKS)


def postings_in(blocks: DataFrame, *also: str) -> DataFrame:
    """A row for each word and document; conditions on words still reach the files."""
    return blocks.select("term", "col", F.inline("docs"), *also)


def _words_of_texts(docs: DataFrame, once: bool = False) -> DataFrame:
    """For each key and column the words of each of its texts."""
    text = F.struct("og_title", "content", "links").alias("_text")
    if once:
        rows = docs.select(*KEY, F.array(text).alias("_texts"))
    else:
        rows = docs.select(*KEY, text).repartition(*KEY).groupBy(*KEY).agg(F.collect_list("_text").alias("_texts"))
    words_of = {
        "title": lambda t: tokens(t["og_title"]),
        "content": lambda t: tokens(t["content"]),
        "links": lambda t: link_tokens(t["links"]),
    }
    return rows.select(*KEY, *[F.transform("_texts", words_of[c]).alias(c) for c in COLUMNS])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = sum(_number_of_words(batch.column(c)) for c in COLUMNS)
        piece = np.cumsum(words) // WORDS_TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for first, end in pairwise(cuts):
            yield batch.slice(first, end - first)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a document's texts, with its positions in all of them; a text without words has none."""
    for some in _pieces(batches):
        for column in COLUMNS:
            yield from _placed_in(some, column)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each word of a piece, in order, with its documents in order of their keys, nulls last."""
    for some in _pieces(batches):
        order = pc.sort_indices(some.select(KEY), sort_keys=[(k, "ascending") for k in KEY])
        keys = [some.column(k).take(order) for k in KEY]
        place = np.empty(some.num_rows, np.int64)
        place[order.to_numpy()] = np.arange(some.num_rows)
        for column in COLUMNS:
            yield from _blocks_in(some, column, keys, place)


def _number_of_words(texts: pa.ListArray) -> np.ndarray:
    sizes = pc.fill_null(pc.list_value_length(pc.list_flatten(texts)), 0).to_numpy(zero_copy_only=False)
    row = pc.list_parent_indices(texts).to_numpy(zero_copy_only=False)
    return np.bincount(row, sizes, len(texts)).astype(np.int64)


def _occurrences(some: pa.RecordBatch, column: str) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, bool]:
    """Every word of the texts, its row and its position; and whether rows have several texts."""
    texts = some.column(column)
    lists = pc.list_flatten(texts)
    known = pc.list_flatten(lists).dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(pc.list_parent_indices(texts).to_numpy(zero_copy_only=False), sizes).astype(np.int64)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return known, row, at, len(lists) > some.num_rows


def _in_order(key: np.ndarray, at: np.ndarray, several: bool) -> np.ndarray:
    """Positions ascend within a text, so only those of several texts have to be sorted."""
    return np.lexsort((at, key)) if several else np.argsort(key, kind="stable")


def _blocks_in(some: pa.RecordBatch, column: str, keys: list[pa.Array], place: np.ndarray) -> Iterator[pa.RecordBatch]:
    known, row, at, several = _occurrences(some, column)
    if not len(known):
        return
    terms = known.dictionary.take(pc.sort_indices(known.dictionary))
    key = pc.index_in(known.dictionary, terms).to_numpy()[known.indices.to_numpy()] * np.int64(some.num_rows) + place[row]
    order = _in_order(key, at, several)
    key = key[order]
    starts = np.flatnonzero(np.diff(key, prepend=-1))  # of each document with a word
    number, row = np.divmod(key[starts], some.num_rows)
    firsts = np.flatnonzero(np.diff(number, prepend=-1))  # of each word
    ends = pa.array(np.append(starts, len(key)).astype(np.int32))
    positions = pa.ListArray.from_arrays(ends, pa.array(at[order].astype(np.int32)))
    docs = pa.StructArray.from_arrays([*(k.take(pa.array(row)) for k in keys), positions], [*KEY, "positions"])
    bounds = np.append(firsts, len(starts))
    yield pa.RecordBatch.from_pydict(
        {
            "term": terms.take(pa.array(number[firsts])),
            "col": pa.array([column], pa.string()).take(pa.array(np.zeros(len(firsts), np.int64))),
            "first": keys[0].take(pa.array(row[firsts])),
            "n": np.diff(bounds),
            "occurrences": np.diff(np.append(starts, len(key))[bounds]),
            "docs": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), docs),
        }
    )


def _placed_in(some: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    known, row, at, several = _occurrences(some, column)
    if not len(known):
        return
    word = row * len(known.dictionary) + known.indices.to_numpy()
    order = _in_order(word, at, several)
    word = word[order]
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    row, number = np.divmod(word[starts], len(known.dictionary))
    ends = np.append(starts, len(word)).astype(np.int32)
    yield pa.RecordBatch.from_pydict(
        {
            "term": known.dictionary.take(pa.array(number)),
            "col": pa.array([column], pa.string()).take(pa.array(np.zeros(len(row), np.int64))),
            **{k: some.column(k).take(pa.array(row)) for k in KEY},
            "positions": pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order].astype(np.int32))),
        }
    )


def _word(wanted: Phrase, k: int) -> tuple[str, bool]:
    return wanted.words[k], wanted.is_prefix and k == len(wanted.words) - 1


def search_postings(postings: DataFrame, query: Query) -> DataFrame:
    """Keys of the matching documents, from the rows of the query's words.

    The words, prefixes and columns reach the scan. Which words a document has
    is asked first, without positions; only the documents that can match bring
    their positions together, and a query of single words needs none. Rows meet
    per document, so a group never exceeds one document.
    """
    needed: dict[tuple[str, bool, str], str] = {}
    for wanted in query.phrases():
        for k in range(len(wanted.words)):
            for column in wanted.searched():
                needed.setdefault((*_word(wanted, k), column), f"w{len(needed)}")

    def row_of(word: str, is_prefix: bool, column: str) -> Column:
        same = F.startswith(F.col("term"), F.lit(word)) if is_prefix else F.col("term") == word
        return same & (F.col("col") == column)

    if not needed:
        return postings.where(F.lit(False)).select(*KEY)
    rows = postings.where(reduce(Column.__or__, [row_of(*n) for n in needed]))
    had = rows.groupBy(*KEY).agg(*[F.bool_or(row_of(*n)).alias(name) for n, name in needed.items()])

    def present(wanted: Phrase, column: str) -> Column:
        names = [needed[(*_word(wanted, k), column)] for k in range(len(wanted.words))]
        return reduce(Column.__and__, [F.col(name) for name in names])

    words_only = all(p.is_word for p in query.phrases()) and not query.has_near()
    can = had.where(query.possible(present, words_only)).select(*KEY)
    if words_only:
        return can
    grouped = rows.join(can, KEY, "left_semi").groupBy(*KEY).agg(
        *[
            F.flatten(F.collect_list(F.when(row_of(*n), F.col("positions")))).alias(name)
            for n, name in needed.items()
        ]
    )

    def starts(wanted: Phrase, column: str) -> Column:
        found = [
            shifted(F.col(needed[(*_word(wanted, k), column)]), k) for k in range(len(wanted.words))
        ]
        return reduce(F.array_intersect, found)

    return grouped.where(query.test(starts)).select(*KEY)
