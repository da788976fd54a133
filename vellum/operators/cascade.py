"""Full-text matching over postings, from the rarest word on.

The term dictionary has a row for each word, column and file of the postings,
with the number of documents. It says how frequent the words of a query are and
which files hold them. The rows of the rarest word are read first; every other
word only adds its positions to the documents that are left. Their number, known
from the dictionary, decides whether they are sent to the frequent word's rows
(a broadcast of checked size) or both meet by key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.search import And, Near, Not, Or, Phrase, Query, shifted
from vellum.schemas import KEY

#: Documents are sent to all tasks up to so many bytes: a key takes about this many, a position four.
BROADCAST_BYTES, KEY_BYTES = 32 << 20, 64

#: A word, whether it may go on, and the column it stands in.
Word = tuple[str, bool, str]


@dataclass(frozen=True)
class Count:
    """Documents that have a word, and how often they have it; upper bounds where documents were removed."""

    documents: int = 0
    occurrences: int = 0

    def __add__(self, other: Count) -> Count:
        return Count(self.documents + other.documents, self.occurrences + other.occurrences)

    @property
    def small(self) -> bool:
        return self.documents * KEY_BYTES + self.occurrences * 4 <= BROADCAST_BYTES


Counts = dict[Word, Count]


def count_terms(postings: DataFrame) -> DataFrame:
    """The term dictionary of postings read from files; ``file`` is folder and name.

    The name is cut for every row, so from its end: a pattern would be tried at every sign of the path.
    """
    return _counted(postings, F.lit(1), F.size("positions"))


def count_blocks(blocks: DataFrame) -> DataFrame:
    """The same of blocks of postings, which say how many they hold; their documents are not read."""
    return _counted(blocks, F.col("n"), F.col("occurrences"))


def _counted(rows: DataFrame, n: Column, occurrences: Column) -> DataFrame:
    file = F.substring_index(F.input_file_name(), "/", -2).alias("file")
    rows = rows.select("term", "col", file, n.cast("bigint").alias("n"), occurrences.cast("bigint").alias("occurrences"))
    return rows.groupBy("term", "col", "file").agg(F.sum("n").alias("n"), F.sum("occurrences").alias("occurrences"))


def words_of(query: Query) -> list[Word]:
    found: dict[Word, None] = {}
    for wanted in query.phrases():
        for k in range(len(wanted.words)):
            for column in wanted.searched():
                found[_word(wanted, k, column)] = None
    return list(found)


def _word(wanted: Phrase, k: int, column: str) -> Word:
    return wanted.words[k], wanted.is_prefix and k == len(wanted.words) - 1, column


def rows_of(word: Word) -> Column:
    """The rows of a word, or of all words that go on from it: a range of the sorted dictionary and postings."""
    text, goes_on, column = word
    same = F.startswith(F.col("term"), F.lit(text)) if goes_on else F.col("term") == text
    return same & (F.col("col") == column)


def looked_up(terms: DataFrame, query: Query) -> tuple[Counts, list[str]]:
    """How frequent the query's words are, and the files of the postings that hold any of them.

    One job over the dictionary's rows of these words. The driver gets a row for
    each file that holds some, not for each word that a prefix stands for.
    """
    wanted = words_of(query)
    if not wanted:
        return {}, []
    named = {f"w{k}": rows_of(word) for k, word in enumerate(wanted)}
    sums = [F.sum(F.when(same, F.col(what))).alias(f"{name}_{what}") for name, same in named.items() for what in ("n", "occurrences")]
    rows = terms.where(reduce(Column.__or__, named.values())).groupBy("file").agg(*sums).orderBy("file").collect()
    counts = {
        word: Count(sum(r[f"w{k}_n"] or 0 for r in rows), sum(r[f"w{k}_occurrences"] or 0 for r in rows))
        for k, word in enumerate(wanted)
    }
    return counts, [r["file"] for r in rows]


def find(postings: DataFrame, counts: Counts, query: Query) -> DataFrame:
    """Keys of the matching documents, each once."""
    return _Cascade(postings, counts).keys(query, None, None)


def search_terms(postings: DataFrame, terms: DataFrame, query: Query) -> DataFrame:
    """Like ``find``, with a dictionary at hand."""
    return find(postings, looked_up(terms, query)[0], query)


class _Cascade:
    """The plan of one query; ``within`` are the only keys that matter, ``most`` bounds their number."""

    def __init__(self, postings: DataFrame, counts: Counts):
        self.postings, self.counts = postings, counts

    # ------------------------------------------------------------ estimates

    def bound(self, query: Query) -> Count:
        """At most so many documents match; of a phrase those that have its rarest word."""
        match query:
            case Phrase():
                return sum((self._rarest(query, c) for c in query.searched()), Count())
            case Near():
                per_column = [min((self._rarest(p, c) for p in query.parts), key=_size) for c in shared(query)]
                return sum(per_column, Count())
            case And():
                return min(self.bound(query.left), self.bound(query.right), key=_size)
            case Or():
                return self.bound(query.left) + self.bound(query.right)
            case Not():
                return self.bound(query.left)
        raise TypeError(query)

    def _rarest(self, wanted: Phrase, column: str) -> Count:
        return min((self._count(wanted, k, column) for k in range(len(wanted.words))), key=_size)

    def _count(self, wanted: Phrase, k: int, column: str) -> Count:
        return self.counts.get(_word(wanted, k, column), Count())

    # ------------------------------------------------------------ plans

    def keys(self, query: Query, within: DataFrame | None, most: Count | None) -> DataFrame:
        match query:
            case Phrase():
                return self._union([self._phrase_keys(query, c, within, most) for c in query.searched()])
            case Near():
                return self._union([self._near_keys(query, c, within, most) for c in shared(query)])
            case And():
                first, second = sorted((query.left, query.right), key=lambda q: _size(self.bound(q)))
                found = self.keys(first, within, most)
                return self.keys(second, found, _least(self.bound(first), most))
            case Or():
                return self._union([self.keys(query.left, within, most), self.keys(query.right, within, most)])
            case Not():
                found = self.keys(query.left, within, most)
                known = _least(self.bound(query.left), most)
                gone = self.keys(query.right, found, known)
                return found.join(gone, KEY, "left_anti")
        raise TypeError(query)

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        if not parts:
            return self.postings.where(F.lit(False)).select(*KEY)
        return reduce(DataFrame.union, parts).distinct()

    def _phrase_keys(self, wanted: Phrase, column: str, within: DataFrame | None, most: Count | None) -> DataFrame:
        if wanted.is_word:
            rows = self._rows(_word(wanted, 0, column))
            return _met(rows, within, most).select(*KEY)
        starts = self.starts(wanted, column, within, most)
        return (starts.where(F.array_contains("starts", 0)) if wanted.is_initial else starts).select(*KEY)

    def _near_keys(self, query: Near, column: str, within: DataFrame | None, most: Count | None) -> DataFrame:
        if any(not p.words for p in query.parts):
            return self._union([])
        order = sorted(range(len(query.parts)), key=lambda i: _size(self._rarest(query.parts[i], column)))
        found: DataFrame | None = None
        for i in order:
            part = query.parts[i]
            own = self.starts(part, column, within if found is None else found.select(*KEY), most)
            own = own.withColumnRenamed("starts", f"s{i}")
            found = own if found is None else self._joined(own, found, most)
            most = _least(self._rarest(part, column), most)
        return found.where(query.close([F.col(f"s{i}") for i in range(len(order))])).select(*KEY)

    def starts(self, wanted: Phrase, column: str, within: DataFrame | None = None, most: Count | None = None) -> DataFrame:
        """Where the phrase starts, in the documents that have it: from its rarest word to its most frequent."""
        order = sorted(range(len(wanted.words)), key=lambda k: _size(self._count(wanted, k, column)))
        found: DataFrame | None = None
        for k in order:
            word = _word(wanted, k, column)
            rows = self._rows(word)
            here = within if found is None else found.select(*KEY)
            if word[1]:  # the words of a prefix share their documents, of which only those left are brought together
                rows = _met(rows, here, most).groupBy(*KEY).agg(F.flatten(F.collect_list("positions")).alias("positions"))
                here = None
            own = rows.select(*KEY, shifted(F.col("positions"), k).alias("own"))
            if found is None:
                found = _met(own, here, most).withColumnRenamed("own", "starts")
            else:
                both = self._joined(own, found, most)
                found = both.select(*KEY, F.array_intersect("starts", "own").alias("starts")).where(F.size("starts") > 0)
            most = _least(self._count(wanted, k, column), most)
        return found

    def _rows(self, word: Word) -> DataFrame:
        return self.postings.where(rows_of(word))

    def _joined(self, rows: DataFrame, found: DataFrame, most: Count | None) -> DataFrame:
        return rows.join(F.broadcast(found) if most is not None and most.small else found, KEY)


def shared(query: Near) -> list[str]:
    return [c for c in query.parts[0].searched() if all(c in p.searched() for p in query.parts)] if query.parts else []


def _size(count: Count) -> tuple[int, int]:
    return count.documents, count.occurrences


def _least(count: Count, most: Count | None) -> Count:
    return count if most is None else min(count, most, key=_size)


def _met(rows: DataFrame, within: DataFrame | None, most: Count | None) -> DataFrame:
    if within is None:
        return rows
    return rows.join(F.broadcast(within) if most is not None and most.small else within, KEY, "left_semi")
