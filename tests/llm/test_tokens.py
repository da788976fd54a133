"""Token ids: the same as the library gives whole texts, and the files give them back."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import rans, tokens
from vellum.session import scratch_path

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import AddedToken, Tokenizer  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
DEFINITION = open(PATH, encoding="utf-8").read()
LIBRARY, OWN = Tokenizer.from_str(DEFINITION), tokens.Encoder(DEFINITION)


def whole(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4")


def encoded(own, *texts):
    return b"".join(ids.astype("<u4").tobytes() for ids in own.encode(list(texts)))


PIECES = st.sampled_from([*"ab's9!é Ж日😀 \n\t\r\xa0\x85\x1c ​", "  ", " the", "<|endoftext|>", " ' s", "don't "])


@settings(max_examples=1500, deadline=None)  # the first call loads Arrow's functions
@given(st.lists(PIECES, max_size=14).map("".join))
def test_ids_of_a_text(text):
    assert encoded(OWN, text) == whole(text).tobytes()


@pytest.mark.parametrize("token", ["ab!", "ab", "!!", "b!a", "!a"])
def test_added_tokens_within_words(token):
    library = Tokenizer.from_str(DEFINITION)
    library.add_tokens([AddedToken(token, normalized=False)])
    own = tokens.Encoder(library.to_str())
    for text in ("x ab! y", "xab!! ab. zab!a", "a !!! b!a! ab", " ab!"):
        assert encoded(own, text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_memory_in_two_halves(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 20)
    own = tokens.Encoder(DEFINITION)
    for k in range(60):
        text = " ".join(f"w{j}" for j in range(k % 13, k % 29 + 5))
        assert encoded(own, text) == whole(text).tobytes()
        assert len(own._new) <= 50


def test_words_are_remembered_in_little_memory():
    own = tokens.Encoder(DEFINITION)
    for k in range(5):
        text = " ".join(f"w{j}" for j in range(2000 * (k % 3), 2000 * (k % 3) + 4000))
        assert encoded(own, text) == whole(text).tobytes()
    assert own._new.to_pylist() and len(set(own._new.to_pylist())) == len(own._new) == len(own._ids)
    assert own._new.get_total_buffer_size() + own._ids.get_total_buffer_size() < 60 * len(own._new)


def test_words_met_last_stay(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 20)
    own = tokens.Encoder(DEFINITION)
    for k in range(30):
        text = f"x often met n{k} m{k}"
        assert encoded(own, text) == whole(text).tobytes()
        assert len(own._new) <= 20 and {"often", "met", f"n{k}"} <= set(own._new.to_pylist())


def test_frames_keep_their_format():
    """Blocks of unlike lengths, side by side; files of before are read, and the same ones are written."""
    rng = np.random.default_rng(7)
    blocks = [np.minimum(rng.zipf(1.4, n), 900).astype(np.uint32) for n in (40_000, 0, 1, 16_384, 70_001, 63)]
    known = rans.table(*np.unique(np.concatenate(blocks), return_counts=True))
    frames = rans.encode(blocks, known)
    assert zlib.crc32(b"".join(frames)) == 2783688401
    for block, found in zip(blocks, rans.decode(frames, known, known.slots()), strict=True):
        assert found.tolist() == block.tolist()


def test_many_texts(monkeypatch):
    texts = [" ".join(f"w{j}" for j in range(k % 13, k % 29 + 5)) + "  \n" * (k % 5 == 0) for k in range(200)] + ["", " ", "x"]
    for held in (1, 50, 10**6):
        monkeypatch.setattr(tokens, "HELD", held)
        assert encoded(tokens.Encoder(DEFINITION), *texts) == b"".join(whole(t).tobytes() for t in texts)
    assert encoded(OWN) == b""


def test_other_tokenizers_get_whole_texts():
    other = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    own, library = tokens.Encoder(other), Tokenizer.from_str(other)
    for text in ("Two words", "a  b\n c", "", "ÉTÉ now"):
        assert encoded(own, text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


BLOCKS = st.lists(st.lists(st.sampled_from([0, 1, 2, 2, 2, 7, 70_000]), max_size=120), max_size=4)


@settings(max_examples=200)
@given(BLOCKS, st.integers(1, 5), st.integers(1, 4), st.integers(0, 120), st.integers(0, 120))
def test_frames(blocks, lanes, rows, first, last):
    blocks = [np.array(b, np.uint32) for b in blocks]
    ids, counts = np.unique(np.concatenate([*blocks, np.zeros(0, np.uint32)]), return_counts=True)
    known = rans.table(ids, counts)
    assert int(known.frequency.sum()) == (1 << known.bits if len(ids) else 0)
    frames, slots = rans.encode(blocks, known, lanes, rows), known.slots()
    for block, frame, ids in zip(blocks, frames, rans.decode(frames, known, slots), strict=True):
        assert ids.tolist() == block.tolist()
        assert rans.decode_from(frame, first, last, known, slots).tolist() == block[first:last].tolist()


def test_frames_are_small_and_checked():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.zipf(1.5, 200_000), 40_000).astype(np.uint32)
    seen, counts = np.unique(ids, return_counts=True)
    known = rans.table(seen, counts)
    (frame,) = rans.encode([ids], known)
    share = counts / counts.sum()
    checkpoints = 64 / rans.ROWS  # a state for each lane and stretch
    assert 8 * len(frame) < len(ids) * (1.02 * -(share * np.log2(share)).sum() + checkpoints)
    for at in (0, 40, len(frame) // 2, len(frame) - 1):
        bad = bytearray(frame)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            rans.decode([bytes(bad)], known, known.slots())
    with pytest.raises(ValueError, match="another"):
        rans.decode([frame], rans.table([1, 2], [1, 1]), known.slots())
    with pytest.raises(ValueError, match="not in"):
        rans.encode([np.array([50_000], np.uint32)], known)


ROWS = [(k * 37 % 400 - 3, f"text {k} of some length " * (k % 9)) for k in range(400)] + [
    (None, "no id"),
    (None, "no id"),
    (None, None),
    (1, ""),
    (1, ""),
    (1, "ties by text <|endoftext|>"),
    (9_000_000_000, "the last  one \n" * 40_000),
]


def test_ids_are_counted_while_texts_are_encoded(spark):
    """No table of packed ids is read for that: a task's last row says how often it met each id."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    packed = tokens.encoded(docs, PATH, 0).cache()
    ids = np.concatenate([np.append(whole(t), 0) for _, t in ROWS])
    wanted = dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)), strict=True))
    assert packed.where("seen is null").count() == len(ROWS) and 0 < packed.where("seen is not null").count() <= 3
    assert {r["id"]: r["n"] for r in tokens.counted(packed.drop("packed")).collect()} == wanted
    empty = tokens.encoded(docs.limit(0), PATH, 0)
    assert tokens.counted(empty).count() == 0


def test_round_trip(spark):
    docs = spark.createDataFrame([(*r, 1, "z", b"") for r in ROWS], "doc_id long, text string, part int, tie string, packed binary")
    path = scratch_path(spark, "token-test")
    rows = tokens.round_trip(docs.repartition(5), path, PATH).collect()
    assert sorted((-1e9 if d is None else d, (whole(t).tobytes() + bytes(4)).hex()) for d, t in ROWS) == sorted(
        (-1e9 if r["doc_id"] is None else r["doc_id"], bytes(r["ids"]).hex()) for r in rows
    )
    rows.sort(key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    order = [r["doc_id"] for r in rows]
    assert order[:3] == [None] * 3 and order[3:] == sorted(order[3:])
    everything = np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), "<u4")
    for first, last in ((0, 10), (990, 70_000), (at - 5, at + 10), (at, at + 1), (200, 200)):
        pieces = sorted((r["start"], bytes(r["ids"])) for r in tokens.read_span(spark, path, first, last).collect())
        assert b"".join(p for _, p in pieces) == everything[first:last].tobytes()
        assert all(p == everything[s : s + len(p) // 4].tobytes() for s, p in pieces)


def test_text_ids_no_end_and_empty_table(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "y"), (None, "")], "name string, body string")
    rows = tokens.round_trip(docs, scratch_path(spark, "token-test"), PATH, end=None, id_col="name", text_col="body").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in sorted(rows, key=lambda r: (r["start"], r["n_tokens"]))] == [
        (None, 0, 0),
        ("a", 0, 1),
        ("b", 1, 2),
    ]
    assert tokens.round_trip(docs.limit(0), scratch_path(spark, "token-test"), PATH, id_col="name", text_col="body").count() == 0


def test_query(spark):
    from vellum.llm import queries

    rows = queries.op13_token_ids(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    at = 0
    for d, r in zip(docs, sorted(rows, key=lambda r: r["doc_id"]), strict=True):
        ids = whole(d["text"]).tobytes() + bytes(4)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
