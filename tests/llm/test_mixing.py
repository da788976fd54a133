"""Mixing: targets by filling up, samples that meet them, and the same in every run."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vellum.llm import mixing

WEIGHTS = (5, 2, 1)


def plain_targets(sizes, share=1.5, most=2):
    """Sizes by source; the excess of full sources is dealt out until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(order)}
    full = set()
    left = share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        level = (left - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        new = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= new


def documents():
    rows = []
    for k in range(400):
        source = ["a", "B", "é", None, "zz", "a"][k % 6]
        rows.append((k, "word " * (1 + (k * 7919) % 97), source))
    rows += [(1000, None, "a"), (1001, "", "only empty"), (1002, " \t", None), (None, "x y z", "a"), (5, "again \x0b and", "B")]
    rows += [(1003, "same row", "B")] * 3 + [(1004, "long " * 5000, "long one")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "n") for r in rows], "doc_id long, text string, source string, size int, u string")


def test_targets_and_samples(spark):
    rows = documents()
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, biggest = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        n = len((text or "").split())
        sizes[source] += n
        biggest[source] = max(biggest[source], n)
    want = plain_targets(dict(sizes))
    by_id = {(d, len((t or "").split())): s for d, t, s in rows}
    taken = defaultdict(int)
    for r in got:
        source = by_id[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[source] += r["taken"]
    for source in sizes:
        assert abs(taken[source] - want[source]) <= biggest[source] / 2 + 1e-6
    again = mixing.mix(frame(spark, rows[::-1]).repartition(5))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got))


def plain_extra(docs, missing, u):
    """Documents that get one more copy: chances by size, certain ones, then by odds over inclusion odds."""
    fits = sorted((d for d in docs if 0 < docs[d] <= missing), key=lambda d: -docs[d])
    sure: set = set()
    while True:
        rest = [d for d in fits if d not in sure]
        squares = sum(docs[d] ** 2 for d in rest)
        factor = (missing - sum(docs[d] for d in sure)) / squares if rest else 0
        # a size is certain when its chance reaches one, largest first
        top = {d for d in rest if docs[d] == docs[rest[0]]} if rest and factor * docs[rest[0]] >= 1 else set()
        if not top:
            break
        sure |= top
    chance = {d: factor * docs[d] for d in rest}
    odds = {d: (u[d] / (1 - u[d])) / (chance[d] / (1 - chance[d])) for d in rest}
    order = [*sure, *sorted(rest, key=lambda d: odds[d]), *sorted((d for d in docs if docs[d] > missing), key=lambda d: (docs[d], d))]
    before, taken = 0, set()
    for d in order:
        if before + docs[d] / 2 <= missing:
            taken.add(d)
        before += docs[d]
    return taken


def test_chances_by_size(spark):
    sizes = {k: 1 + (k * 7919) % 197 for k in range(300)} | {500: 3000, 501: 900, 502: 0}
    rows = [(k, "w " * n, "one") for k, n in sizes.items()]
    docs = frame(spark, rows)
    u = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.uniform(F.col("doc_id").cast("string"), ":mix").alias("u")).collect()}
    total = sum(sizes.values())
    for share in (0.001, 0.02, 0.1, 0.5, 0.9, 0.99, 1.3, 1.65):
        got = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, share=share).collect()}
        extra = {d for d, n in got.items() if n > int(share) and sizes[d]}
        assert extra == plain_extra(sizes, total * share - int(share) * total, u), share


def test_a_text_that_fills_most_of_its_source(spark):
    rows = [(0, "long " * 6000, "s"), *((k, "ten words " * 5, "s") for k in range(1, 401))]
    docs = frame(spark, rows)
    for share in (0.1, 0.25, 0.35, 0.61, 0.75, 0.9, 1.25, 1.35, 1.65):
        taken = sum(r["taken"] for r in mixing.mix(docs, share=share).collect())
        assert abs(taken - 10_000 * share) <= 100, (share, taken)
    # 5500 words are out of reach: 4000 without the long text, 10,000 with all others
    assert sum(r["taken"] for r in mixing.mix(docs, share=0.55).collect()) == 4000


def test_rows_of_the_mix(spark):
    rows = documents()
    docs = frame(spark, rows)
    copies = defaultdict(int)
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"], r["size"]] += r["copies"]
    out = mixing.mixed_rows(docs)
    assert out.columns == [*docs.columns, "copy"]
    seen = defaultdict(int)
    for r in out.collect():
        seen[r["doc_id"], len((r["text"] or "").split())] += 1
    assert {k: n for k, n in copies.items() if n} == dict(seen)


def test_no_python_in_the_plan(spark, capsys):
    mixing.mix(frame(spark, documents())).explain("formatted")
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(frame(spark, documents()).limit(0)).count() == 0
    rows = mixing.mix(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_rows(frame(spark, documents()).limit(0)).count() == 0
