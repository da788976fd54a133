"""Periodic runs of words, from Lyndon roots that Baier's grouping of suffixes gives under both orders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.shared import with_two_columns_per_batch

KIND = "struct<runs: array<struct<start: bigint, length: bigint, period: bigint>>, collapsed: string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.struct([("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

Run = tuple[int, int, int]


def lyndon_groups(ranks: Sequence[int], size: int) -> tuple[list[int], list[int]]:
    """The group of each place, and for each group the length of the Lyndon word its suffixes begin with.

    This is the first phase of Baier's suffix sorter. Places start in groups by
    their symbol (``0`` to ``size - 1``). From the highest group down: let a
    group's word be v. Each of its places hands on to the nearest place before
    it that is still lower. A lower place that k of them name is followed by k
    times v, so its word u grows to u v^k: it leaves its group for one just above
    it, further up the larger k is. A group is left for good when its turn
    comes, so the groups above it that came from it (``above``) go first. At the
    end places share a group exactly if their longest Lyndon words are equal.

    Linear but for the search of lower places, which skips ones that are done.
    """
    places: list[list[int]] = [[] for _ in range(size)]
    for i, r in enumerate(ranks):
        places[r].append(i)
    group, left, length = list(ranks), [len(p) for p in places], [1] * size
    above: list[list[int] | None] = [None] * size
    # skip[i + 1] leads from a place that is done towards the nearest one before it that is not; 0 is none
    skip = list(range(len(group) + 1))

    def grow(h: int, moved: list[int], size: int) -> None:
        """Some places of a group leave it for a new one just above it."""
        new = len(left)
        left[h] -= len(moved)
        for j in moved:
            group[j] = new
        if above[h] is None:
            above[h] = [new]
        else:
            above[h].append(new)
        places.append(moved)
        left.append(len(moved))
        length.append(size)
        above.append(None)

    for top in range(size - 1, -1, -1):
        turn = [top]
        while turn:
            g = turn[-1]
            if above[g]:
                turn += reversed(above[g])
                above[g] = None
                continue
            turn.pop()
            if not left[g]:
                continue
            word = length[g]
            members = [i for i in places[g] if group[i] == g]
            if len(members) == 1:  # as most are: then one place is named, once
                skip[members[0] + 1] = p = members[0]
                while skip[p] != p:
                    skip[p] = p = skip[skip[p]]
                if p:
                    h = group[p - 1]
                    if left[h] == 1:
                        length[h] += word
                    else:
                        grow(h, [p - 1], length[h] + word)
                continue
            for i in members:
                skip[i + 1] = i
            named: dict[int, int] = {}
            for p in members:
                while skip[p] != p:
                    skip[p] = p = skip[skip[p]]
                if p:
                    named[p] = named.get(p, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for p, k in named.items():
                moves.setdefault((-k, group[p - 1]), []).append(p - 1)
            for k, h in sorted(moves) if len(moves) > 1 else moves:
                moved = moves[k, h]
                if left[h] == len(moved):
                    length[h] -= k * word
                    continue
                grow(h, moved, length[h] - k * word)
    return group, length


def _common(symbols: np.ndarray, a: int, b: int, step: int) -> int:
    """Length of the longest common extension from two places, forwards (step 1) or backwards (-1)."""
    most = len(symbols) - b if step > 0 else a + 1
    done, size = 0, 16
    while done < most:
        size = min(size, most - done)
        if step > 0:
            differ = symbols[a + done : a + done + size] != symbols[b + done : b + done + size]
        else:
            differ = (symbols[a - done - size + 1 : a - done + 1] != symbols[b - done - size + 1 : b - done + 1])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, size = done + size, size * 2
    return most


def find_runs(words: Sequence, least: int = 6, powers: int = 4) -> list[Run]:
    """Start, length and smallest period of all maximal runs, by start, then period.

    A run is as long as ``least`` words and ``powers`` times its period at least
    (``powers`` from 2). Under that order of words in which the word that breaks
    a run is lower than the one a period before it, the run's Lyndon root stands
    in it ``powers - 1`` times over, always as the longest Lyndon word of its
    place. So places whose group returns a word's length further on so often are
    the candidates; their common extensions to both sides give the run.
    """
    if powers < 2:
        raise ValueError("a run holds its period twice at least")
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(numbers) == len(words):
        return []
    ranks = list(map(numbers.__getitem__, words))
    symbols, top = np.array(ranks), len(numbers) - 1
    found: dict[tuple[int, int], int] = {}
    for ordered in (ranks, (top - symbols).tolist()):
        group, length = lyndon_groups(ordered, top + 1)
        group, place = np.array(group), np.arange(len(ranks))
        period = np.array(length)[group]
        ahead = place + (powers - 1) * period <= len(ranks)
        place, period = place[ahead], period[ahead]
        for k in range(1, powers - 1):
            same = group[place] == group[place + k * period]
            place, period = place[same], period[same]
        ends: dict[int, int] = {}
        for i, p in zip(place.tolist(), period.tolist(), strict=True):
            if i + p <= ends.get(p, 0):
                continue
            start = i - _common(symbols, i - 1, i + p - 1, -1)
            ends[p] = i + p + _common(symbols, i, i + p, 1)
            if ends[p] - start >= max(least, powers * p):
                found[start, p] = ends[p] - start
    return sorted((start, size, p) for (start, p), size in found.items())


def collapse(words: Sequence, runs: Sequence[Run]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return list(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        depth[start + period] += 1
        depth[start + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def scan(
    docs: DataFrame,
    least: int = 6,
    powers: int = 4,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "periodic",
) -> DataFrame:
    """Input rows with a struct ``label``: ``runs`` by start, then period, and the ``collapsed`` text.

    Words are parted by ASCII white space and numbered from 0. A run is a
    stretch of words with a smallest period that no neighbouring word extends,
    ``least`` words and ``powers`` periods long at least. The collapsed text is
    the words that no run contains after its first period, with single spaces
    between. ``rewrite`` may change a document's words before, given its id.

    Null, empty and wordless texts have no run and an empty collapsed text. Ids
    may be null or repeat. Other columns pass unchanged under any name; an input
    column ``label`` is replaced. No shuffle; a task holds one batch of texts
    and some 200 bytes for each word of one text.
    """

    def batch(ids: list, texts: list) -> list:
        out = []
        for row_id, text in zip(ids, texts, strict=True):
            words = (text or "").encode().split()  # bytes part at ASCII white space only
            if rewrite is not None:
                words = rewrite(row_id, words)
            runs = find_runs(words, least, powers)
            out.append(
                {
                    "runs": [{"start": s, "length": n, "period": p} for s, n, p in runs],
                    "collapsed": b" ".join(collapse(words, runs)).decode(),
                }
            )
        return out

    return with_two_columns_per_batch(docs, id_col, text_col, label, KIND, _ARROW, batch)
