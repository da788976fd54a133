"""Token-ID output: documents as ids of a public tokenizer, in frames of a range asymmetric numeral system."""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm import rans
from vellum.llm.shared import written

#: A block takes whole documents until it holds this many ids; so many blocks are encoded or decoded at a time.
BLOCK, TOGETHER = 1 << 16, 32
#: Words a Python worker remembers, some 40 bytes each; beyond it only the half goes on that was met last.
MEMORY = 800_000
#: New words go to the library in texts of so many.
JOINED = 128
#: Characters of the texts that are encoded together.
HELD = 1 << 23
#: A blank before white space or the end. Elsewhere a byte-level splitter always parts before a blank.
_UNSURE = r"\x20(?:[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|\z)"

_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SIGNS = string.punctuation


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _offsets_of(words: pa.Array) -> np.ndarray:
    """Where each of some large strings or binaries begins in their bytes, and where the last ends."""
    return np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]


def _straddles(token: str) -> bool:
    """Letters with signs after them, which would be parted."""
    return bool(_LETTERS.fullmatch(token.rstrip(_SIGNS))) and token[-1] in _SIGNS


class Encoder:
    """Ids of texts under a tokenizer of the ``tokenizers`` library, in 16 bits each where its vocabulary allows.

    A byte-level tokenizer without normalizer splits a text before every blank
    that a sign follows, so what stands between such blanks is encoded once and
    remembered. Texts with a blank before white space or at the end, and all texts
    under other tokenizers, go to the library whole. The string of a special
    token in a text is read as the library reads it.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task its own core
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_str(definition)
        known = json.loads(definition)
        split = known.get("pre_tokenizer") or {}
        plain = all(
            not (t["single_word"] or t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) or _straddles(t["content"]))
            for t in known.get("added_tokens", ())
        )
        self._by_words = (
            plain
            and not known.get("normalizer")
            and not known.get("truncation")
            and not known.get("padding")
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", False)
            and not split.get("add_prefix_space", True)
        )
        if self._by_words:
            self._by_blanks = Tokenizer.from_str(definition)
            self._by_blanks.pre_tokenizer = pre_tokenizers.Sequence(
                [
                    pre_tokenizers.Split("\x20", "merged_with_next"),
                    pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
                ]
            )
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values(), default=-1) + 1
        self.width = "<u2" if self.size <= 1 << 16 else "<u4"
        self._blank = np.zeros(self.size, bool)
        self._blank[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # as byte-level tokens write it
        self._new, self._ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self._met, self._turn = np.zeros(0, np.int64), 0  # when each word was met last

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.width)

    def _each(self, tokenizer, words: pa.Array) -> pa.Array:
        """Ids of words with a blank before each: few texts to the library, parted where a token begins with a blank."""
        if not len(words):
            return pa.array([], pa.large_binary())
        blank = pa.scalar("\x20", pa.large_string())
        blanked = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), words, blank)
        bounds, letters = _offsets_of(blanked), memoryview(blanked.buffers()[2])
        cuts = [*bounds[:-1:JOINED].tolist(), int(bounds[-1])]
        found = tokenizer.encode_batch_fast([str(letters[a:b], "utf-8") for a, b in pairwise(cuts)], add_special_tokens=False)
        ids = np.concatenate([np.array(f.ids, self.width) for f in found])
        starts = np.flatnonzero(self._blank[ids])
        if len(starts) != len(words):
            return pa.array([self._whole(w).tobytes() for w in _strings(blanked)], pa.large_binary())
        at = np.append(starts, len(ids)).astype(np.int64) * ids.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(at), pa.py_buffer(ids)])

    def _known(self, words: pa.Array, plain: np.ndarray) -> pa.Array:
        """Ids of distinct words with a blank before each, remembered or learned.

        ``plain`` words are of letters alone: one piece for the splitter, with no need to look at its pattern.
        """
        at = pc.fill_null(pc.index_in(words, self._new), -1).to_numpy().astype(np.int64)
        unknown = np.flatnonzero(at < 0)
        parts = unknown[plain[unknown]], unknown[~plain[unknown]]
        learned = pa.array(np.concatenate(parts))
        at[learned.to_numpy()] = len(self._new) + np.arange(len(learned))
        each = [self._each(t, words.take(pa.array(k))) for t, k in zip((self._by_blanks, self._tokenizer), parts, strict=True)]
        self._new = pa.concat_arrays([self._new, words.take(learned)])
        self._ids = pa.concat_arrays([self._ids, *each])
        found = self._ids.take(pa.array(at))
        self._turn += 1
        self._met = np.concatenate([self._met, np.zeros(len(learned), np.int64)])
        self._met[at] = self._turn
        if len(self._new) > MEMORY:
            kept = np.sort(np.argsort(-self._met, kind="stable")[: MEMORY // 2])
            self._new, self._ids, self._met = self._new.take(pa.array(kept)), self._ids.take(pa.array(kept)), self._met[kept]
        return found

    def _signed(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words with a blank before each, as bytes.

        Letters and the signs after them are two pieces for the splitter, so a
        word with and without such signs is remembered once.
        """
        trimmed = pc.utf8_rtrim(words, _SIGNS)
        lettered = pc.match_substring_regex(trimmed, rf"\A{_LETTERS.pattern}\z")
        stems = pc.if_else(lettered, trimmed, words)
        stem = stems.dictionary_encode()
        plain = np.zeros(len(stem.dictionary), bool)
        plain[stem.indices.to_numpy()] = lettered.to_numpy(zero_copy_only=False)
        each = self._known(stem.dictionary, plain).take(stem.indices)
        signed = np.flatnonzero(pc.binary_length(stems).to_numpy() < pc.binary_length(words).to_numpy())
        ends = pc.replace_substring_regex(words.take(pa.array(signed)), rf"\A{_LETTERS.pattern}", "")
        signs = ends.dictionary_encode()
        tails = pa.array([b"", *(self._whole(sign).tobytes() for sign in _strings(signs.dictionary))], pa.large_binary())
        tail = np.zeros(len(words), np.int64)
        tail[signed] = signs.indices.to_numpy() + 1
        return pc.binary_join_element_wise(each, tails.take(pa.array(tail)), pa.scalar(b"", pa.large_binary()))

    def _split(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts whose every blank parts words: distinct words are looked up, their ids put in place."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), "\x20")
        starts = parts.offsets.to_numpy()
        firsts = self._tokenizer.encode_batch_fast(_strings(parts.values.take(starts[:-1])), add_special_tokens=False)
        distinct = parts.values.dictionary_encode()
        each = self._signed(distinct.dictionary)
        word = distinct.indices.to_numpy().copy()
        word[starts[:-1]] = len(each)  # first words, without a blank before them, come from the library
        placed = pa.concat_arrays([each, pa.array([b""], pa.large_binary())]).take(pa.array(word))
        ends = _offsets_of(placed) // np.dtype(self.width).itemsize
        found = np.frombuffer(placed.buffers()[2], self.width, ends[-1]) if ends[-1] else np.zeros(0, self.width)
        cuts = ends[starts]
        return [
            np.concatenate([np.array(first.ids, self.width), found[a:b]])
            for first, (a, b) in zip(firsts, pairwise(cuts.tolist()), strict=True)
        ]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; so many texts are held at a time as have ``HELD`` characters."""
        some, held = [], 0
        for text in texts:
            some.append(text)
            held += len(text)
            if held >= HELD:
                yield from self._some(some)
                some, held = [], 0
        yield from self._some(some)

    def _some(self, texts: list[str]) -> Iterator[np.ndarray]:
        unsure = pc.match_substring_regex(pa.array(texts, pa.large_string()), _UNSURE).to_pylist()
        sure = [self._by_words and not u for u in unsure]
        split = iter(self._split([t for t, s in zip(texts, sure, strict=True) if s]) if any(sure) else [])
        for text, by_words in zip(texts, sure, strict=True):
            yield next(split) if by_words else self._whole(text)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task, as are the words it remembers."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


def _definition(spark: SparkSession, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encoded(
    docs: DataFrame, tokenizer: str, end: int | None = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id of each row, the number of its ids, and the ids packed (16 bits each where that is enough, zstd).

    A task's last row has ``seen`` instead: how often each id occurs in its rows, packed alike.
    """
    definition = _definition(docs.sparkSession, tokenizer)
    id_type, kind = _arrow_type(docs, id_col), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = _encoder(definition.value), zstandard.ZstdCompressor(level=3)
        width = "<u4" if (end or 0) >= 1 << 16 else encoder.width
        tail = np.array([] if end is None else [end], width)
        total = np.zeros(max(encoder.size, (end or 0) + 1), np.int64)
        for batch in batches:
            sizes, packed, some, held = [], [], [], 0
            for k, ids in enumerate(encoder.encode([t or "" for t in batch.column(1).to_pylist()]), 1):
                some.append(np.concatenate([ids.astype(width, copy=False), tail]))
                sizes.append(len(some[-1]))
                packed.append(width[-1:].encode() + squeeze.compress(some[-1].tobytes()))
                held += sizes[-1]
                if held >= BLOCK or k == batch.num_rows:
                    total += np.bincount(np.concatenate(some), minlength=len(total))
                    some, held = [], 0
            columns = {"doc_id": pa.array(batch.column(0), id_type), "n": sizes, "packed": packed, "seen": pa.nulls(len(sizes), pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)
        last = {"doc_id": pa.nulls(1, id_type), "n": pa.nulls(1, pa.int64()), "packed": pa.nulls(1, pa.binary())}
        yield pa.RecordBatch.from_pydict({**last, "seen": pa.array([squeeze.compress(total.tobytes())], pa.binary())})

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n bigint, packed binary, seen binary")


def _unpacked(packed: bytes, tool: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(tool.decompress(packed[1:]), f"<u{packed[:1].decode()}").astype("<u4")


def counted(packed: DataFrame) -> DataFrame:
    """How often each id occurs: ``id``, ``n``. Tasks hand on a row for each id they saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, total = zstandard.ZstdDecompressor(), None
        for batch in batches:
            for one in batch.column(0):
                some = np.frombuffer(tool.decompress(one.as_py()), np.int64)
                total = some if total is None else total + some
        if total is not None:
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"id": seen.astype(np.int64), "n": total[seen]})

    parts = packed.where("seen is not null").select("seen").mapInArrow(run, "id bigint, n bigint")
    return parts.groupBy("id").agg(F.sum("n").alias("n"))


def write(
    docs: DataFrame, path: str, tokenizer: str, end: int | None = 0, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the ids of all texts, in ascending order of their documents' ids, below ``path``.

    Two tables result. ``table`` has every id that occurs with its share of a
    power of two; all frames share it. ``frames`` has a row for each block:
    ``part`` and ``block`` in order, ``first`` (ids before it in its part),
    ``ids``, the binary ``frame`` and its ``docs`` (id and number of ids, in
    order). The frame is the file format of ``rans``; Parquet is its container,
    as Spark commits that as a whole, so a lost executor leaves no half a file.

    Every text ends with the id ``end`` (None for none). A null text is an empty
    one. Null ids come first, rows of one id in the order of their ids' hashes;
    equal rows are interchangeable. Columns other than id and text are left out.

    Texts are encoded once and kept packed, which is smaller than they are, and ids
    are counted meanwhile; then that table is dealt out by ranges of ids and written. A long document
    has a block of its own, with as many checkpoints as it needs.
    """
    spark = docs.sparkSession
    packed = written(encoded(docs, tokenizer, end, id_col, text_col), "token-ids")
    counts = counted(packed).orderBy("id").toPandas()  # a row for each id of the vocabulary
    known = rans.table(counts["id"].to_numpy(), counts["n"].to_numpy())
    shares = zip(known.ids.tolist(), known.frequency.tolist(), strict=True)
    spark.createDataFrame(list(shares), "id bigint, share bigint").coalesce(1).write.parquet(f"{path}/table")

    shared = spark.sparkContext.broadcast(known)
    kind = pa.list_(pa.struct([("doc_id", _arrow_type(docs, id_col)), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tool = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        done = made = held = 0
        ready: list[tuple[np.ndarray, list]] = []
        docs_in, pieces = [], []

        def frames() -> pa.RecordBatch:
            nonlocal done, made, ready
            sizes = [len(ids) for ids, _ in ready]
            columns = {
                "part": pa.array([part] * len(ready), pa.int32()),
                "block": pa.array(range(made, made + len(ready)), pa.int64()),
                "first": pa.array((done + np.cumsum([0, *sizes[:-1]])).astype(np.int64)),
                "ids": pa.array(sizes, pa.int64()),
                "frame": pa.array(rans.encode([ids for ids, _ in ready], shared.value), pa.binary()),
                "docs": pa.array([d for _, d in ready], kind),
            }
            done, made, ready = done + sum(sizes), made + len(ready), []
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for row_id, one in zip(batch.column(0), batch.column(1), strict=True):
                pieces.append(_unpacked(one.as_py(), tool))
                held += len(pieces[-1])
                docs_in.append({"doc_id": row_id.as_py(), "n": len(pieces[-1])})
                if held >= BLOCK or len(docs_in) >= BLOCK:
                    ready.append((np.concatenate(pieces), docs_in))
                    docs_in, pieces, held = [], [], 0
                if len(ready) == TOGETHER:
                    yield frames()
        if docs_in:
            ready.append((np.concatenate(pieces), docs_in))
        if ready:
            yield frames()

    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (
        "part int, block bigint, first bigint, ids bigint, frame binary,"
        f" docs array<struct<doc_id: {id_type}, n: bigint>>"
    )
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("packed"), F.col("tie")]
    placed = packed.where("seen is null").withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    placed = placed.sortWithinPartitions(*order).select("doc_id", "packed")
    placed.mapInArrow(run, schema).write.parquet(f"{path}/frames")


def _arrow_type(docs: DataFrame, id_col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[id_col].dataType)


def _known(spark: SparkSession, path: str) -> rans.Table:
    rows = spark.read.parquet(f"{path}/table").orderBy("id").toPandas()  # a row for each id of the vocabulary
    return rans.stored_table(rows["id"].to_numpy(), rows["share"].to_numpy())


def _offsets(frames: DataFrame) -> DataFrame:
    """Ids before each part; a row for each of the written parts."""
    sums = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = frames.groupBy("part").agg(F.sum("ids").alias("n"))
    return parts.select("part", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("before"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents as written: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids``.

    ``ids`` are little-endian unsigned 32-bit. Frames are decoded apart from each
    other and checked against their checksums; a damaged one raises ValueError.
    """
    frames = spark.read.parquet(f"{path}/frames")
    shared = spark.sparkContext.broadcast(_known(spark, path))
    field = frames.schema["docs"].dataType.elementType["doc_id"]
    out = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("doc_id", field.dataType),
            T.StructField("at", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value.slots()
        for batch in batches:
            for some in (batch.slice(k, TOGETHER) for k in range(0, batch.num_rows, TOGETHER)):
                decoded = rans.decode(some.column("frame").to_pylist(), shared.value, slots)
                for k, (ids, first) in enumerate(zip(decoded, some.column("first").to_pylist(), strict=True)):
                    docs = some.column("docs")[k].values
                    sizes = docs.field("n").to_numpy()
                    ends = np.cumsum(sizes)
                    whole = ids.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array(np.full(len(sizes), some.column("part")[k].as_py(), np.int32)),
                            "doc_id": docs.field("doc_id"),
                            "at": pa.array(first + ends - sizes),
                            "n_tokens": pa.array(sizes),
                            "ids": pa.array([whole[4 * (e - n) : 4 * e] for e, n in zip(ends, sizes, strict=True)], pa.binary()),
                        }
                    )

    found = frames.select("part", "first", "frame", "docs").mapInArrow(run, out)
    placed = found.join(F.broadcast(_offsets(frames)), "part")  # a row for each written part
    return placed.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_span(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The ids from place ``first`` to ``last`` (exclusive) of all, in pieces: ``start``, ``ids``.

    Only frames that hold some of them are read, and of these only the stretches
    between the checkpoints around them are decoded.
    """
    frames = spark.read.parquet(f"{path}/frames")
    shared = spark.sparkContext.broadcast(_known(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value.slots()
        for batch in batches:
            for start, frame in zip(batch.column("start").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                ids = rans.decode_from(frame, first - start, last - start, shared.value, slots)
                yield pa.RecordBatch.from_pydict({"start": [max(first, start)], "ids": [ids.astype("<u4").tobytes()]})

    placed = frames.select("part", "first", "ids", "frame").join(F.broadcast(_offsets(frames)), "part")
    start = F.col("before") + F.col("first")
    wanted = placed.where((start < last) & (start + F.col("ids") > first)).select(start.alias("start"), "frame")
    return wanted.mapInArrow(run, "start bigint, ids binary")


def round_trip(docs: DataFrame, path: str, tokenizer: str, **options) -> DataFrame:
    """Write the documents and read them back."""
    write(docs, path, tokenizer, **options)
    return read(docs.sparkSession, path)


