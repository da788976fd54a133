"""Toxicity: disguised words are restored through a noisy channel, and the restored text is scored.

Every token is a lattice of what its characters may stand for: leetspeak,
characters put between letters, repeated letters, letters set apart by spaces.
Viterbi takes the path that a character model of the corpus finds likeliest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import drawn, gram_buckets, per_batch, text_hash, with_column_per_batch, written

# fixed values: what characters stand for in disguised words
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou",
}
BETWEEN = frozenset(".-_~'`*·/\\,:;")
#: Log probabilities of the channel: a character for a letter, one between letters, a run cut short, a kept character.
SWAP, DROP, CUT, KEEP = -1.0, -0.5, -0.5, -12.0
#: So many equal letters in a row, and so many single letters in a row, are a disguise; fewer equal ones may be.
RUN, APART = 3, 4

#: Buckets of the character model's n-grams, and what smooths them.
LM_BITS = 18
SMOOTH, SYMBOLS = 0.05, 40

#: Labelled rows of either label that a lexicon is learned from, at most; those with the smallest hash.
SAMPLE = 4000
#: n-grams of words with their borders that can be signs.
ORDERS = range(4, 7)
ID_BITS = 48
#: Shares of a text's words from which an n-gram is a sign of its own, by level.
RATES = (0.0, 0.002, 0.004, 0.008, 0.016)
#: A sign explains so many texts that no stronger sign explains, and its share of toxic texts is at least this.
SUPPORT, SHARE = 3, 0.5
#: Texts whose signs a task counts at a time.
GROUP = 256
#: Weight of what is known before counting, in texts.
PRIOR = 4.0
#: Score of a text without signs, at most.
BASE = 0.05
#: Tokens whose signs a worker remembers, and tokens that are looked up at a time, about.
MEMORY, CHUNK = 1_000_000, 300_000

_MASK = (1 << 64) - 1
_DOUBLED = re.compile(r"(.)\1", re.DOTALL)


def _bucket(gram: str) -> int:
    """Bucket of one n-gram, as ``gram_buckets`` makes it."""
    h = 0
    for k, c in enumerate(gram, 1):
        h = (h * 0x100000001B3 + ord(c) + k) & _MASK
    return (((h ^ (h >> 31)) * 0x9E3779B97F4A7C15) & _MASK) >> (64 - LM_BITS)


def core_of(token: str) -> str:
    """The token without what stands around its first and last letter, digit or sign for a letter."""
    start, end = 0, len(token)
    while start < end and not (token[start].isalnum() or token[start] in "@$"):
        start += 1
    while end > start and not (token[end - 1].isalnum() or token[end - 1] in "@$"):
        end -= 1
    return token[start:end]


def may_repeat(core: str) -> bool:
    """Whether neighbours can stand for the same letter, next to each other or with characters put between."""
    if core.isalpha():
        return bool(_DOUBLED.search(core))
    before: str = ""
    for char in core:
        letters = char if char.isalpha() else LEET.get(char, "")
        if any(c in before for c in letters):
            return True
        before = before + letters if char in BETWEEN else letters
    return False


def is_noisy(core: str) -> bool:
    """Whether a token can be a disguise; digits alone are a number."""
    if core.isalpha():
        return may_repeat(core)
    return any(c.isalpha() or (c in LEET and not c.isdigit()) for c in core)


@dataclass
class CharModel:
    """Counts of character pairs and triples of the corpus's words."""

    pairs: np.ndarray
    triples: np.ndarray
    memory: dict[str, float] = field(default_factory=dict)

    def log_p(self, gram: str) -> float:
        """Log probability of a triple's last character after the first two."""
        if (p := self.memory.get(gram)) is None:
            before = float(self.pairs[_bucket(gram[:2])])
            p = math.log((float(self.triples[_bucket(gram)]) + SMOOTH) / (before + SMOOTH * SYMBOLS))
            self.memory[gram] = p
        return p

    def restore(self, core: str, shortest: int = 2) -> str:
        """Likeliest word that the characters stand for; runs of fewer than ``shortest`` letters or signs stay.

        Runs of two and of signs are cut where ``shortest`` is 2, also where
        only what the signs stand for makes them one.
        """
        states = {("", "\x02"): (0.0, "")}
        for char, run in groupby(core):
            n = len(list(run))
            if char.isalpha():
                options = [(char * n, 0.0)] if n < RUN else [(char, CUT), (char * 2, CUT)]
                if shortest <= n < RUN:
                    options.append((char, CUT))
            else:
                options = [(x * n, SWAP * n) for x in LEET.get(char, "")]
                if n >= shortest and shortest < RUN:
                    options += [(x * k, SWAP * k + CUT) for x in LEET.get(char, "") for k in range(1, min(n, RUN))]
                if char in BETWEEN:
                    options.append(("", DROP * n))
                options.append((char * n, KEEP * n))
            following: dict[tuple[str, str], tuple[float, str]] = {}
            for (a, b), (p, word) in states.items():
                merged = [("", cost + CUT) for letters, cost in options if letters[:1] == b and b.isalpha()] if shortest < RUN else []
                for letters, cost in options + merged:
                    q, x, y = p + cost, a, b
                    for c in letters:
                        q += self.log_p(x + y + c) if x else 0.0
                        x, y = y, c
                    key = (x, y)
                    if key not in following or q > following[key][0]:
                        following[key] = (q, word + letters)
            states = following
        ends = [(p + (self.log_p(a + b + "\x03") if a else 0.0), word) for (a, b), (p, word) in states.items()]
        return max(ends, key=lambda e: (e[0], e[1]))[1]


def tokens_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def count_characters(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Character model of the plain words of all documents; tasks add up counts of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << LM_BITS))

        def add(seen: Counter) -> None:
            weights: Counter = Counter()
            for token, n in seen.items():
                weights[core_of(token)] += n
            words = [w for w in weights if w.isalpha()]
            n = np.fromiter((weights[w] for w in words), np.float64, len(words))
            for k, order in enumerate((2, 3)):
                buckets, owners = gram_buckets(words, range(order, order + 1), LM_BITS)
                sums[k] += np.bincount(buckets, n[owners], 1 << LM_BITS)

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(tokens_of(text))
                if len(seen) >= CHUNK:
                    add(seen)
                    seen = Counter()
        add(seen)
        order, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict(
            {"part": order.astype(np.int32), "bucket": bucket.astype(np.int32), "n": sums[order, bucket].astype(np.int64)}
        )

    counted = docs.select(text_col).mapInArrow(run, "part int, bucket int, n long")
    found = counted.groupBy("part", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros((2, 1 << LM_BITS))
    sums[found["part"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return CharModel(sums[0], sums[1])


def restored_words(tokens: list[str], model: CharModel, memory: dict[str, tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Words of every token: its core, and what it is restored to where it is noisy."""
    out = []
    for token in tokens:
        if (words := memory.get(token)) is None:
            core = core_of(token)
            if not core:
                words = ()
            elif not is_noisy(core):
                words = (core,)
            else:
                kept = () if core.isalpha() and not any(len(list(run)) >= RUN for _, run in groupby(core)) else (model.restore(core, RUN),)
                cut = (model.restore(core),) if may_repeat(core) else ()
                words = tuple(dict.fromkeys((core, *kept, *cut)))
            memory[token] = words
        out.append(words)
    return out


def joined_letters(tokens: list[str]) -> list[str]:
    """Words spelled by runs of tokens of one letter or sign."""
    if "s" * APART not in "".join(["s" if len(t) <= 3 else "l" for t in tokens]):
        return []
    out, run = [], []
    for token in [*tokens, "--"]:
        core = core_of(token) if len(token) <= 3 else ""
        if len(core) == 1:
            run.append(core)
        else:
            if len(run) >= APART:
                out.append("".join(run))
            run = []
    return out


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words' n-grams and the word each is from; the last digits tell the order."""
    parts = [gram_buckets(words, range(order, order + 1), ID_BITS) for order in ORDERS]
    ids = [(b << 3) | (order - ORDERS.start) for order, (b, _) in zip(ORDERS, parts)]
    whole = np.fromiter((xxhash.xxh64_intdigest(w) >> (64 - ID_BITS) for w in words), np.int64, len(words))
    ids.append((whole << 3) | len(ORDERS))
    return np.concatenate(ids), np.concatenate([*(o for _, o in parts), np.arange(len(words))])


def _token_grams(words: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of every token, given by its words, and the token each is from."""
    owner = np.repeat(np.arange(len(words)), [len(own) for own in words])
    ids, at = _grams([w for own in words for w in own])
    token = owner[at]
    order = np.lexsort((ids, token))
    ids, token = ids[order], token[order]
    first = np.ones(len(ids), bool)
    first[1:] = (ids[1:] != ids[:-1]) | (token[1:] != token[:-1])
    return ids[first], token[first]


def _signs(text: str, chars: CharModel) -> np.ndarray:
    """Numbers of a whole text's signs: its n-grams, each with every level its rate reaches."""
    tokens = Counter(tokens_of(text))
    tokens.update(joined_letters(tokens_of(text)))
    words = restored_words(list(tokens), chars, {})
    counts = np.fromiter(tokens.values(), np.int64, len(tokens))
    total = sum(n for n, own in zip(tokens.values(), words) if own)
    if not total:
        return np.empty(0, np.int64)
    ids, owner = _token_grams(words)
    grams, place = np.unique(ids, return_inverse=True)
    rates = np.bincount(place, counts[owner]) / total
    return np.concatenate([(grams[rates >= rate] << 3) | level for level, rate in enumerate(RATES)])


@dataclass
class Model:
    """n-grams that are signs, sorted, with the probability each gives a text at every level of its rate."""

    chars: CharModel
    grams: np.ndarray
    chances: np.ndarray
    base: float
    memory: dict[str, tuple[int, ...] | None] = field(default_factory=dict)
    older: dict[str, tuple[int, ...] | None] = field(default_factory=dict)

    def _learn(self, tokens: list[str]) -> None:
        """Remember which signs every token holds; None for one without letters.

        When ``MEMORY`` is full its older half goes. Tokens of one core share
        their signs, so a core is restored once.
        """
        if len(self.memory) > MEMORY // 2:
            self.older, self.memory = self.memory, {}
        cores: dict[str, list[str]] = {}
        for token in set(tokens).difference(self.memory):
            if token in self.older:
                self.memory[token] = self.older[token]
            else:
                cores.setdefault(core_of(token), []).append(token)
        words = restored_words(list(cores), self.chars, {})
        known: list[tuple[int, ...] | None] = [() if own else None for own in words]
        for core, gram in self._held(words):
            known[core] += (gram,)
        for signs, own in zip(known, cores.values(), strict=True):
            for token in own:
                self.memory[token] = signs

    def _held(self, words: list[tuple[str, ...]]) -> Iterator[tuple[int, int]]:
        """Places of tokens, given by their words, and of the signs that they hold; n-grams that are no sign go first."""
        flat = [w for own in words for w in own]
        if not flat or not len(self.grams):
            return
        owner = np.repeat(np.arange(len(words)), [len(own) for own in words])
        ids, at = _grams(flat)
        place = np.minimum(np.searchsorted(self.grams, ids), len(self.grams) - 1)
        hit = self.grams[place] == ids
        pairs = np.unique(np.stack([owner[at[hit]], place[hit]]), axis=1)
        yield from zip(*pairs.tolist(), strict=True)

    def _chance(self, found: list[tuple[int, ...]], total: int) -> float:
        best = self.base
        for gram, n in Counter(g for own in found for g in own).items():
            level = int(np.searchsorted(RATES, n / total, side="right"))
            best = max(best, float(self.chances[gram, :level].max()))
        return best

    def scores(self, texts: list[str | None]) -> list[float]:
        """Chance of the strongest sign in every restored whole text; the base rate without any."""
        out: list[float] = []
        group: list[list[str]] = []
        held = 0
        for k, text in enumerate(texts):
            own = tokens_of(text)
            own += joined_letters(own)
            group.append(own)
            held += len(own)
            if held >= CHUNK or k + 1 == len(texts):
                self._learn([t for own in group for t in own])
                for own in group:
                    known = list(map(self.memory.__getitem__, own))
                    found = [signs for signs in known if signs]
                    out.append(self._chance(found, len(known) - known.count(None)) if found else self.base)
                group, held = [], 0
        return out


def _labelled(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, sample: int
) -> tuple[DataFrame, list[int]]:
    """Texts with their label, at most ``sample`` of either, equal texts once; and all toxic and clean rows."""
    known = labels.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_label")
    )
    known = known.where("_id is not null").distinct()
    parts = [known.where(F.col("_label") == label) for label in (1, 0)]
    rows = [part.count() for part in parts]
    toxic, clean = (drawn(part, F.col("_id"), sample, n) for part, n in zip(parts, rows))
    chosen = toxic.union(clean)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(chosen), "_id").select("_label", "_text", text_hash("_text").alias("_hash"))
    return joined.dropDuplicates(["_hash", "_label"]), rows


def _known(found: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Of the numbers found those that are in the sorted ``signs``."""
    if not len(signs):
        return found[:0]
    return found[signs[np.minimum(np.searchsorted(signs, found), len(signs) - 1)] == found]


def _count_signs(texts: DataFrame, chars: Broadcast, signs: np.ndarray | None) -> DataFrame:
    """In how many texts each sign stands, and a hash of the set of them; of given signs only, if any are given.

    Tasks count ``GROUP`` texts at a time, so a sign of many texts is few rows.
    """
    wanted = None if signs is None else texts.sparkSession.sparkContext.broadcast(signs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                found = [_signs(t, chars.value) for t in batch.column(0).slice(at, GROUP).to_pylist()]
                if wanted is not None:
                    found = [_known(f, wanted.value) for f in found]
                held = batch.column(1).slice(at, GROUP).to_numpy().repeat([len(f) for f in found])
                every = np.concatenate(found)
                order = np.argsort(every, kind="stable")
                sign, first, n = np.unique(every[order], return_index=True, return_counts=True)
                met = np.bitwise_xor.reduceat(held[order], first) if len(first) else held
                yield pa.RecordBatch.from_pydict({"sign": pa.array(sign), "n": pa.array(n), "texts": pa.array(met)})

    counted = texts.select("_text", "_hash").mapInArrow(run, "sign long, n long, texts long")
    return counted.groupBy("sign").agg(F.sum("n").alias("n"), F.bit_xor("texts").alias("texts"))


def one_of_each_set(signs: np.ndarray, texts: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Places of the signs that can be chosen: of those in the same set of texts the one ``choose_signs`` prefers.

    Signs of one set gain the same at every step and nothing once one of them is
    chosen, so only the likeliest, and of equal ones the first by the rule for ties, matters.
    """
    order = np.lexsort((signs, signs & 7, -(signs >> 3 & 7), -chances, texts))
    first = np.ones(len(order), bool)
    first[1:] = texts[order][1:] != texts[order][:-1]
    return np.sort(order[first])


def _hold_signs(texts: DataFrame, chars: Broadcast, signs: np.ndarray) -> DataFrame:
    """Which texts hold which of the given signs."""
    wanted = texts.sparkSession.sparkContext.broadcast(signs)

    def run(batch: pa.RecordBatch) -> dict:
        found = [_known(_signs(t, chars.value), wanted.value) for t in batch.column(1).to_pylist()]
        return {
            "hash": batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))),
            "sign": pa.array(np.concatenate(found)),
        }

    return per_batch(texts.select("_hash", "_text"), run, "hash long, sign long")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    corpus: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
) -> Model:
    """Character model from the whole corpus, and signs from a bounded sample of labelled rows.

    A sign is an n-gram of restored words, from some share of a text's words on.
    Signs are chosen one after another, always the one that explains most toxic
    texts not yet explained, weighed by its share of toxic texts; so words that
    merely stand beside a sign, as in copies of a text, are none. Null labels and
    null texts teach nothing, and without toxic rows no text has a sign.
    """
    chars = count_characters(corpus, text_col)
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(chars)
    labelled, rows = _labelled(docs, labels, label_col, id_col, text_col, sample)
    texts = written(labelled.select("_label", "_text", "_hash"), "toxicity-texts")
    rate = (rows[0] + 1) / (sum(rows) + 20)
    # a clean text of the sample stands for so many, where a toxic one stands for one
    weight = max(1, rows[1] / sample) / max(1, rows[0] / sample)

    bad, good = texts.where("_label = 1"), texts.where("_label = 0")
    seen = _count_signs(bad, shared, None).where(F.col("n") >= SUPPORT).toArrow()
    order = np.argsort(seen["sign"].to_numpy())
    signs, a, sets = (seen[c].to_numpy()[order] for c in ("sign", "n", "texts"))
    other = _count_signs(good, shared, signs).select("sign", "n").toArrow()
    b = np.zeros(len(signs), np.int64)
    b[np.searchsorted(signs, other["sign"].to_numpy())] = other["n"].to_numpy()
    chance = (a + PRIOR * rate) / (a + weight * b + PRIOR)
    strong = np.nonzero(chance >= SHARE)[0]
    kept = strong[one_of_each_set(signs[strong], sets[strong], chance[strong])]
    signs, chance = signs[kept], chance[kept]
    held = _hold_signs(bad, shared, signs).toArrow()
    sign = held["sign"].to_numpy()
    chosen = choose_signs(held["hash"].to_numpy(), sign, chance[np.searchsorted(signs, sign)])
    grams = np.array(sorted({s >> 3 for s in chosen}), np.int64)
    chances = np.zeros((len(grams), len(RATES)))
    for number, chance in chosen.items():
        chances[np.searchsorted(grams, number >> 3), number & 7] = chance
    return Model(chars, grams, chances, min(BASE, rate / 2))


def choose_signs(texts: np.ndarray, signs: np.ndarray, chances: np.ndarray) -> dict[int, float]:
    """Signs that explain the texts, greedily; of equal ones the longest, at the lowest rate."""
    _, text = np.unique(texts, return_inverse=True)
    numbers, first, sign = np.unique(signs, return_index=True, return_inverse=True)
    chance = chances[first]
    by_sign = np.split(text[np.argsort(sign, kind="stable")], np.cumsum(np.bincount(sign, minlength=len(numbers)))[:-1])
    by_text = np.split(sign[np.argsort(text, kind="stable")], np.cumsum(np.bincount(text))[:-1]) if len(text) else []
    gain = np.bincount(sign, minlength=len(numbers)).astype(np.float64)
    open_texts = np.ones(len(by_text), bool)
    out: dict[int, float] = {}
    while len(gain):
        rank = np.where(gain >= SUPPORT, gain * chance, 0)
        top = rank.max()
        if top <= 0:
            break
        ties = np.nonzero(rank >= top - 1e-9)[0]
        best = max(ties.tolist(), key=lambda k: (numbers[k] >> 3 & 7, -(numbers[k] & 7), -numbers[k]))
        out[int(numbers[best])] = float(chance[best])
        for t in by_sign[best].tolist():
            if open_texts[t]:
                open_texts[t] = False
                gain[by_text[t]] -= 1
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text", label: str = "toxicity") -> DataFrame:
    """Input rows with the chance that their whole restored text is toxic.

    Null and empty texts have the base rate, as all texts without a sign. Rows
    are judged one by one. An input column of the label's name is replaced;
    others may have any name.
    """
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return with_column_per_batch(docs, text_col, label, "double", pa.float64(), lambda t: shared.value.scores(t))
