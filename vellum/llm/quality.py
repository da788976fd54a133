"""Quality classifier: learned vectors of hashed words and character n-grams, averaged, with a softmax."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import drawn, gram_buckets, per_batch, text_hash, with_column_per_batch

#: Labelled rows a model is fitted on, at most; those with the smallest hash.
SAMPLE = 4000
BITS = 17
ORDERS = range(3, 5)
DIMENSIONS = 12
EPOCHS = 8
RATE = 0.8
#: Tokens whose features a worker remembers; beyond it the memory starts anew.
MEMORY = 300_000
#: Tokens that are looked up at a time, about.
CHUNK = 300_000

_WORD, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _codes(words: list[str]) -> np.ndarray:
    """A 64-bit code of every token, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _pairs(codes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring tokens; a repeated token has one bucket, whatever the token."""
    pair = codes[:-1] * _PAIR + codes[1:]
    return _bucket(np.where(codes[:-1] == codes[1:], np.uint64(1), pair))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text's tokens, their n-grams and their pairs, with how often each occurs."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = _codes(words)
    grams, _ = gram_buckets(words, ORDERS, BITS)
    return np.unique(np.concatenate([_bucket(codes * _WORD), grams, _pairs(codes)]), return_counts=True)


@dataclass
class Model:
    """What every bucket adds to the log odds of label 1; the softmax of two classes needs no more."""

    weight: np.ndarray
    bias: float
    memory: dict[str, int] = field(default_factory=dict)
    codes: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    sums: np.ndarray = field(default_factory=lambda: np.empty(0))
    counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.memory) > MEMORY:
            empty = Model(self.weight, self.bias)
            self.memory, self.codes, self.sums, self.counts = empty.memory, empty.codes, empty.sums, empty.counts
        missing = list({w for w in words if w not in self.memory})
        if missing:
            start = len(self.memory)
            self.memory.update((w, start + k) for k, w in enumerate(missing))
            codes = _codes(missing)
            buckets, owners = gram_buckets(missing, ORDERS, BITS)
            n = len(missing)
            sums = np.bincount(owners, self.weight[buckets], n) + self.weight[_bucket(codes * _WORD)]
            self.codes = np.concatenate([self.codes, codes])
            self.sums = np.concatenate([self.sums, sums])
            self.counts = np.concatenate([self.counts, np.bincount(owners, minlength=n) + 1])
        return np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))

    def _score(self, words: list[str], lengths: list[int]) -> np.ndarray:
        rows = self.rows(words)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        codes = self.codes[rows]
        same = owner[1:] == owner[:-1]
        total = np.bincount(owner, self.sums[rows], len(lengths))
        total += np.bincount(owner[1:][same], self.weight[_pairs(codes)][same], len(lengths))
        n = np.bincount(owner, self.counts[rows], len(lengths)) + np.bincount(owner[1:][same], minlength=len(lengths))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -50, 50)))

    def scores(self, texts: list[str | None]) -> list[float]:
        """Probability of label 1 of every whole text; one without tokens has the bias alone."""
        out: list[float] = []
        words: list[str] = []
        lengths: list[int] = []
        for text in texts:
            own = text.split() if text else []
            words += own
            lengths.append(len(own))
            if len(words) >= CHUNK:
                out += self._score(words, lengths).tolist()
                words, lengths = [], []
        return out + (self._score(words, lengths).tolist() if lengths else [])


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Stochastic gradient descent over (buckets, counts, label), vectors and softmax together."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (1 << BITS, DIMENSIONS)) / DIMENSIONS
    out, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    rows = [(b, n / n.sum(), y) for b, n, y in rows if len(b)]
    steps = max(1, EPOCHS * len(rows))
    step = 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)).tolist():
            buckets, share, label = rows[k]
            rate = RATE * (1 - step / steps)
            step += 1
            own = vectors[buckets]
            mean = share @ own
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[label] -= 1
            vectors[buckets] = own - rate * share[:, None] * SPREAD * (error @ out)
            out -= rate * np.outer(error, mean)
            bias -= 0.1 * rate * error
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


#: Gradients are shared out among a text's features; this makes up for the many features of a text.
SPREAD = 100.0


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> Model:
    """Model from at most ``sample`` labelled rows: those whose id and text hash lowest.

    Labels are 0 and 1; null labels and null texts teach nothing. Tasks turn
    whole texts into counted features; these come to the driver, where numpy
    trains. Labels that meet no document and documents without label are left
    out. Without two classes the model knows only the share of label 1.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("_id"), (F.col(label_col) > 0).cast("int").alias("_label")
    )
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = known.where("_id is not null").distinct()
    chosen = drawn(known, F.struct("_id", "_label"), sample, known.count())
    joined = texts.join(F.broadcast(chosen), "_id").select("_label", "_text", text_hash("_text").alias("_hash"))
    joined = joined.orderBy("_hash", "_label").limit(sample)

    def run(batch: pa.RecordBatch) -> dict:
        found = [features(t) for t in batch.column(1).to_pylist()]
        return {
            "label": batch.column(0),
            "hash": batch.column(2),
            "buckets": pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())),
            "counts": pa.array([np.minimum(n, 2**31 - 1).astype(np.int32) for _, n in found], pa.list_(pa.int32())),
        }

    counted = per_batch(joined, run, "label int, hash long, buckets array<int>, counts array<int>").toArrow()
    order = np.lexsort([counted["label"].to_numpy(), counted["hash"].to_numpy()])
    buckets, counts = counted["buckets"].combine_chunks(), counted["counts"].combine_chunks()
    y = counted["label"].to_numpy()
    rows = [(buckets[int(k)].values.to_numpy(), counts[int(k)].values.to_numpy(), int(y[k])) for k in order]
    if len({r[2] for r in rows}) < 2:
        share = (sum(r[2] for r in rows) + 1) / (len(rows) + 2)
        return Model(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    return train(rows)


def score(docs: DataFrame, model: Model, text_col: str = "text", label: str = "quality_score") -> DataFrame:
    """Input rows with the probability of label 1 of their whole text.

    Null and empty texts are scored too, by the bias alone. Rows are judged one
    by one. An input column of the label's name is replaced; others may have any name.
    """
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    return with_column_per_batch(docs, text_col, label, "double", pa.float64(), lambda t: shared.value.scores(t))
