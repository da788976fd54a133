"""Language identification: scripts narrow the languages, Viterbi labels spans of words."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import drawn_of_each, gram_buckets, per_batch, with_column_per_batch

WORD = re.compile(r"[^\W\d_]+")
#: Labelled documents of each language that a model is fitted on, at most; those with the smallest hash of id and text.
SAMPLE = 1000
#: Character n-grams of a word with its borders, hashed into ``2 ** BITS`` buckets.
ORDERS = range(2, 5)
BITS = 18
#: Log odds a change of language between two words has to make up for.
SWITCH = 12.0
#: A language is a candidate for a script that holds this share of its letters.
SCRIPT_SHARE = 0.01
#: What a word loses in a language that is no candidate for its script.
BAR = 24.0
#: A word's score does not grow beyond this many letters.
LONGEST = 12
#: Words whose scores a worker remembers; beyond it the memory starts anew.
MEMORY = 300_000
UNKNOWN = "und"
#: Characters that are labelled at a time, about.
CHUNK = 3_000_000

#: First and last code point of the scripts told apart, by first code point.
SCRIPTS = [
    (0x0041, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1E00, 0x1EFF, "latin"),
    (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
]


def script_of(word: str) -> str:
    """Script of a word's first letter; letters outside the table are a script of their own."""
    at = ord(word[0])
    for low, high, name in SCRIPTS:
        if low <= at <= high:
            return name
    return "other"


def words_of(text: str | None) -> list[str]:
    """Words of a whole text in lower case; digits and signs like a raised two alone are none."""
    found = WORD.findall(unicodedata.normalize("NFC", text).lower()) if text else []
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


@dataclass
class Model:
    """Log probabilities of n-gram buckets per language, and the languages each script may be."""

    langs: list[str]
    table: np.ndarray
    scripts: dict[str, list[int]]
    memory: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def score(self, words: list[str]) -> np.ndarray:
        """Mean log probability of the words' n-grams times their letters; 0 for the best language."""
        buckets, owners = gram_buckets(words, ORDERS, BITS)
        n = np.bincount(owners, minlength=len(words))
        sums = [np.bincount(owners, self.table[buckets, k], len(words)) for k in range(len(self.langs))]
        letters = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), LONGEST)
        scores = np.stack(sums, axis=1) * (letters / n)[:, None]
        bars = {s: np.isin(np.arange(len(self.langs)), own, invert=True) * BAR for s, own in self.scripts.items()}
        none = np.zeros(len(self.langs))
        scores -= np.array([bars.get(script_of(w), none) for w in words])
        return (scores - scores.max(axis=1, keepdims=True)).astype(np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Numbers of the words' score rows."""
        if len(self.memory) > MEMORY:
            self.memory, self.scores = {}, None
        missing = list({w for w in words if w not in self.memory})
        if missing:
            start = len(self.memory)
            new = self.score(missing)
            self.memory.update((word, start + k) for k, word in enumerate(missing))
            self.scores = new if self.scores is None else np.concatenate([self.scores, new])
        return np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best language of every word, all texts in step; ``scores`` has the texts' words in a row.

    Texts are sorted by length, so those still running at a step are the first
    ones. Staying is free, a change costs ``switch``; the lower number wins ties.
    """
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    running = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1), side="left")
    came = np.empty(scores.shape, np.int16)
    best = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t, n in enumerate(running.tolist()):
        at = first[:n] + t
        now = best[:n]
        top = now.argmax(axis=1)
        jump = np.take_along_axis(now, top[:, None], 1) - switch
        stay = now >= jump
        came[at] = np.where(stay, np.arange(scores.shape[1], dtype=np.int16), top[:, None])
        moved = np.where(stay, now, jump) + scores[at]
        best[:n] = moved
    out = np.empty(len(scores), np.int16)
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        at = first[:n] + t
        out[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return out


Label = tuple[str, float, list[tuple[str, int, int]]]


def label_all(model: Model, texts: list[str | None]) -> list[Label]:
    """Language, score and spans (language, first word, past the last) of every text.

    Texts of similar length go together, about ``CHUNK`` characters at a time.
    """
    sizes = [len(t) if t else 0 for t in texts]
    out: list[Label] = [(UNKNOWN, 0.0, [])] * len(texts)
    group: list[int] = []
    held = 0
    by_size = sorted(range(len(texts)), key=sizes.__getitem__)
    for k, following in zip(by_size, [*by_size[1:], -1]):
        group.append(k)
        held += sizes[k]
        if held >= CHUNK or following < 0:
            for at, label in zip(group, label_batch(model, [texts[i] for i in group])):
                out[at] = label
            group, held = [], 0
    return out


def label_batch(model: Model, texts: list[str | None]) -> Iterator[Label]:
    words = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    if not lengths.any():
        yield from ((UNKNOWN, 0.0, []) for _ in texts)
        return
    flat = [w for own in words for w in own]
    rows = model.rows(flat)
    letters = np.fromiter(map(len, flat), np.int64, len(flat))
    scores = model.scores[rows]
    states = viterbi(scores, lengths, SWITCH)
    sure = 1 / np.exp(np.minimum(scores - scores[np.arange(len(states)), states][:, None], 50)).sum(axis=1)
    at = 0
    for n in lengths.tolist():
        if not n:
            yield UNKNOWN, 0.0, []
            continue
        own, weight = states[at : at + n], letters[at : at + n]
        held = np.bincount(own, weights=weight, minlength=len(model.langs))
        top = int(held.argmax())
        score = float((weight * sure[at : at + n])[own == top].sum() / weight.sum())
        edges = np.nonzero(np.diff(own))[0] + 1
        bounds = [0, *edges.tolist(), n]
        spans = [(model.langs[own[a]], a, b) for a, b in zip(bounds, bounds[1:])]
        yield model.langs[top], min(1.0, max(0.0, score)), spans
        at += n


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE
) -> Model:
    """Model from a bounded sample of labelled texts; rows without text or language teach nothing.

    At most ``sample`` texts of each language are drawn, however rare it is beside
    the others. Tasks turn texts into n-gram counts per language; the sums come
    to the driver.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    chosen = drawn_of_each(known, "_lang", F.struct("_id", "_text"), sample).select("_text", "_lang")

    def run(batch: pa.RecordBatch) -> dict:
        langs = batch.column(1).to_pylist()
        counts: dict[str, np.ndarray] = {}
        letters: Counter = Counter()
        for text, lang in zip(batch.column(0).to_pylist(), langs):
            words = words_of(text)
            buckets, _ = gram_buckets(words, ORDERS, BITS)
            counts[lang] = counts.get(lang, 0) + np.bincount(buckets, minlength=1 << BITS)
            for word in words:
                letters[lang, script_of(word)] += len(word)
        rows = [(lang, None, b, int(c[b])) for lang, c in counts.items() for b in np.nonzero(c)[0].tolist()]
        rows += [(lang, script, None, n) for (lang, script), n in letters.items()]
        lang, script, bucket, n = zip(*rows) if rows else ((), (), (), ())
        return {
            "lang": pa.array(lang, pa.string()),
            "script": pa.array(script, pa.string()),
            "bucket": pa.array(bucket, pa.int64()),
            "n": pa.array(n, pa.int64()),
        }

    counted = per_batch(chosen, run, "lang string, script string, bucket long, n long")
    found = counted.groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    langs = sorted({r["lang"] for r in found})
    place = {lang: k for k, lang in enumerate(langs)}
    counts = np.full((1 << BITS, max(1, len(langs))), 0.1, np.float32)
    letters = np.zeros(max(1, len(langs)))
    for r in found:
        if r["bucket"] is not None:
            counts[r["bucket"], place[r["lang"]]] += r["n"]
        else:
            letters[place[r["lang"]]] += r["n"]
    counts /= counts.sum(axis=0, dtype=np.float64)
    table = np.log(counts, out=counts)
    scripts: dict[str, list[int]] = {}
    for r in found:
        if r["script"] is not None and r["n"] >= SCRIPT_SHARE * letters[place[r["lang"]]]:
            scripts.setdefault(r["script"], []).append(place[r["lang"]])
    return Model(langs, table, {script: sorted(own) for script, own in scripts.items()})


def identify(docs: DataFrame, model: Model, text_col: str = "text", label: str = "language") -> DataFrame:
    """Input rows with a struct column: ``lang``, ``score``, ``spans`` (``lang``, ``first``, ``past``: words).

    The language is that of the spans with the most letters; the score is the
    share of all letters in them, each word weighted by how sure its label is.
    Null, empty and letterless texts, and all texts under a model that has
    learned nothing, are ``und`` with score 0 and no spans. Rows are judged
    one by one: repeated rows and ids do not matter. An input column of the
    struct's name is replaced; others may have any name.
    """
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("past", pa.int32())])
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(texts: list[str | None]) -> list:
        own: Model = shared.value
        found = label_all(own, texts) if own.langs else [(UNKNOWN, 0.0, [])] * len(texts)
        return [
            {"lang": lang, "score": score, "spans": [{"lang": x, "first": f, "past": p} for x, f, p in spans]}
            for lang, score, spans in found
        ]

    spans = "array<struct<lang: string, first: int, past: int>>"
    return with_column_per_batch(docs, text_col, label, f"struct<lang: string, score: double, spans: {spans}>", kind, run)
