"""Toxicity: disguises are undone, signs are learned, copies teach nothing, held-out results."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import toxicity
from vellum.llm.shared import fold, table

WORDS = "the idiot said that a moron is a stupid loser and what they had was trash like this one is it not to me at all"


@pytest.fixture(scope="module")
def chars(spark):
    docs = spark.createDataFrame([(WORDS,)] * 30 + [(None,), ("",)], "text string")
    return toxicity.count_characters(docs)


@pytest.mark.parametrize(
    "disguised",
    ["1d10t", "id!ot", "i.d.i.o.t", "i-d-i-o-t", "idiiiiiot", "1.d.!.0.t", "iddddiot", "id*ot"],
)
def test_restored(chars, disguised):
    assert chars.restore(disguised) == "idiot"


@pytest.mark.parametrize("disguised", ["iddiot", "iidiiot", "id!!!ot", "id!!ot", "idi!ot", "1idi0ot", "id|!ot", "i.d.d.i.o.t"])
def test_short_runs_are_cut(chars, disguised):
    assert toxicity.is_noisy(disguised) and "idiot" in toxicity.restored_words([disguised], chars, {})[0]


def test_signs_alone_are_words(spark):
    chars = toxicity.count_characters(spark.createDataFrame([("an ass is as good as all the others",)] * 30, "text string"))
    words = toxicity.restored_words(["4$$", "@$$", "good", "2024"], chars, {})
    assert "ass" in words[0] and "ass" in words[1] and "good" in words[2] and words[3] == ("2024",)


def test_counts_of_characters(chars):
    assert chars.triples[toxicity._bucket("idi")] == 30
    assert chars.pairs[toxicity._bucket("\x02t")] == 30 * sum(w.startswith("t") for w in WORDS.split())


def test_single_letters_are_joined():
    assert toxicity.joined_letters("you i d i o t , y a".split()) == ["idiot"]
    assert toxicity.joined_letters(["a", "b", "c"]) == []


def docs_and_labels(spark):
    rows, labels = [], []
    for k in range(60):
        bad = k % 3 == 0
        rows.append((k, f"word{k} plain text number {k} {'total idiot here' if bad else 'nice day'} end{k % 7}"))
        labels.append((k, int(bad)))
    # copies of one toxic text: their other words are no signs
    rows += [(100 + k, f"copied idiot sentence with unrelated neighbours{'!' * k}") for k in range(10)]
    labels += [(100 + k, 1) for k in range(10)]
    rows += [(200, None), (201, ""), (202, "x"), (202, "x"), (None, "idiot"), (203, "q" * 200_000), (204, "fine " * 100_000)]
    labels += [(200, 1), (None, 1), (201, None), (999, 1)]
    return (
        spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, toxicity string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_signs_and_scores(spark):
    docs, labels = docs_and_labels(spark)
    model = toxicity.fit(docs, labels, "toxic", corpus=docs)
    texts = ["an idiot", "an 1d10t!!", "i d i o t", "unrelated neighbours copied sentence", "nice", None, ""]
    high = model.scores(texts)
    assert all(s >= 0.7 for s in high[:3]) and all(s < 0.3 for s in high[3:])
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"] for r in got if r["toxicity"] >= 0.7} == {*range(0, 60, 3), *range(100, 110), None}


def test_one_sign_of_each_set_is_enough():
    rng = random.Random(6)
    sets = [frozenset(rng.sample(range(40), rng.randint(3, 12))) for _ in range(30)]
    signs = {}
    for number in rng.sample(range(1 << 16), 400):
        signs[number << 6 | rng.randrange(5) << 3 | rng.randrange(5)] = (rng.choice(sets), rng.choice([0.5, 0.6, 0.75, 0.9]))
    numbers = np.array(sorted(signs), np.int64)
    chances = np.array([signs[n][1] for n in numbers.tolist()])
    ids = np.array([sets.index(signs[n][0]) for n in numbers.tolist()])

    def chosen(places):
        pairs = [(t, int(numbers[k]), chances[k]) for k in places for t in sorted(signs[int(numbers[k])][0])]
        return toxicity.choose_signs(*map(np.array, zip(*pairs)))

    kept = toxicity.one_of_each_set(numbers, ids, chances)
    assert len(kept) == len(set(ids.tolist())) and chosen(kept) == chosen(range(len(numbers)))


def test_rarer_words_count_beside_many_frequent_ones(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprtv") + rng.choice("aeiou") for _ in range(4))
    frequent = " ".join(word() for _ in range(30))
    rows = [(k, f"{frequent} {word()} {'moron' if k < 40 else 'idiot'}", 1) for k in range(60)]
    rows += [(100 + k, f"{frequent if k < 45 else ''} {word()} {word()}", 0) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs, "toxic", corpus=docs)
    moron, idiot, clean = model.scores(["one moron", "one idiot", frequent])
    assert moron >= 0.7 and idiot >= 0.7 and clean < 0.7


def test_without_labels_or_rows(spark):
    docs, labels = docs_and_labels(spark)
    model = toxicity.fit(docs, labels.limit(0), "toxic", corpus=docs)
    assert max(model.scores(["idiot", None])) < 0.1
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.fit(none, labels, "toxic", corpus=none)).count() == 0


def test_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    labels = table(spark, "/root/testdata/sf0.1", "labels")
    held = fold("doc_id", 3) == 1
    model = toxicity.fit(docs.where(~held), labels.where(~held), "toxic", corpus=docs)
    scored = toxicity.score(docs.where(held), model).join(labels, "doc_id")
    said = F.col("toxicity") >= 0.7
    row = scored.agg(
        F.sum((said & (F.col("toxic") == 1)).cast("int")), F.sum("toxic"), F.sum((said & (F.col("toxic") == 0)).cast("int"))
    ).first()
    assert row[1] > 80 and row[0] / row[1] >= 0.9 and row[2] <= 0.05 * row[1]


def all_readings(core, shortest):
    """Every reading of a token's runs of equal characters, with the channel's cost."""
    runs = [(c, len(list(own))) for c, own in itertools.groupby(core)]

    def choices(char, n):
        if char.isalpha():
            if n >= 3:
                return [(char, toxicity.CUT), (char * 2, toxicity.CUT)]
            return [(char * n, 0.0)] + ([(char, toxicity.CUT)] if n >= shortest else [])
        out = [(char * n, toxicity.KEEP * n)]
        for letter in toxicity.LEET.get(char, ""):
            out.append((letter * n, toxicity.SWAP * n))
            if shortest < 3 and n >= shortest:
                out += [(letter * k, toxicity.SWAP * k + toxicity.CUT) for k in (1, 2) if k < n]
        if char in toxicity.BETWEEN:
            out.append(("", toxicity.DROP * n))
        return out

    def walk(k, word, cost):
        if k == len(runs):
            yield word, cost
            return
        for letters, more in choices(*runs[k]):
            yield from walk(k + 1, word + letters, cost + more)
            if shortest < 3 and letters and word and letters[0] == word[-1] and word[-1].isalpha():
                yield from walk(k + 1, word, cost + more + toxicity.CUT)

    yield from walk(0, "", 0.0)


def test_the_likeliest_of_all_readings(spark):
    chars = toxicity.count_characters(table(spark, "/root/testdata/sf0.001", "documents"))

    def likelihood(word):
        if not word:
            return 0.0
        framed = f"\x02{word}\x03"
        return sum(chars.log_p(framed[k : k + 3]) for k in range(len(framed) - 2))

    rng = random.Random(6)
    for _ in range(400):
        core = "".join(rng.choice("aeiost013$@!.-l") * rng.choice((1, 1, 1, 2, 3)) for _ in range(rng.randint(1, 5)))
        for shortest in (2, toxicity.RUN):
            values = {}
            for word, cost in all_readings(core, shortest):
                values[word] = max(values.get(word, -1e9), cost + likelihood(word))
            best = chars.restore(core, shortest)
            assert values[best] == pytest.approx(max(values.values())), (core, shortest, best)
