"""Static range asymmetric numeral system: frames of token ids under one frequency table.

A frame stands for itself: header, table of checkpoints, code words, checksum.
Its ids are dealt to lanes in turn (id ``i`` to lane ``i % lanes``), all lanes
share one stream of code words, and a checkpoint every so many rows of lanes
holds the lanes' states, the place in the stream and a checksum of the ids up to
the next one, so that a frame can be decoded from any checkpoint on and all its
stretches side by side.

Little-endian layout::

    magic "rANS", version u16, lanes u16, rows in a stretch u32, stretches u32,
    ids u64, code words u64, checksum of the frequency table u32,
    states u64[stretches][lanes], places u64[stretches], checksums u32[stretches],
    code words u32[...], checksum of all bytes before u32
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

MAGIC, VERSION = b"rANS", 1
_HEADER = struct.Struct("<4sHHIIQQI")
#: Frequencies are shares of a power of two: so many bits more than the ids that occur need, 12 at least and 20 at most.
SPARE, LEAST_BITS, MOST_BITS = 4, 12, 20
#: States stay from 2^31 up and below 2^63; code words have 32 bits.
LOW = 1 << 31
LANES, ROWS = 64, 256


class Table(NamedTuple):
    """Ids that occur, ascending, their frequencies out of ``2 ** bits``, what stands below each, and each id's number."""

    ids: np.ndarray
    frequency: np.ndarray
    below: np.ndarray
    number: np.ndarray
    bits: int
    checksum: int

    def slots(self) -> np.ndarray:
        """For each of ``2 ** bits`` slots the number of the id it belongs to."""
        return np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.frequency.astype(np.int64))


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Whole shares of a power of two, one at least, in proportion to the counts; the largest take what rounding leaves."""
    bits = min(MOST_BITS, max(LEAST_BITS, len(counts).bit_length() + SPARE))
    whole, total = 1 << bits, int(counts.sum())
    if len(counts) > whole // 2:
        raise ValueError("more ids than the table has room for")
    if not len(counts):
        return np.zeros(0, np.uint64)
    share = np.maximum(1, np.floor(counts / total * (whole - len(counts)))).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    over = whole - int(share.sum())
    share[order] += over // len(counts)
    share[order[: over % len(counts)]] += 1
    return share.astype(np.uint64)


def table(ids: Sequence[int], counts: Sequence[int]) -> Table:
    """The table of ids and how often each occurs; every id that is encoded must be in it."""
    order = np.argsort(np.asarray(ids, np.int64), kind="stable")
    ids, counts = np.asarray(ids, np.uint32)[order], np.asarray(counts, np.int64)[order]
    return stored_table(ids, frequencies(counts))


def stored_table(ids: Sequence[int], shares: Sequence[int]) -> Table:
    """The table of ascending ids and their frequencies as they were written."""
    ids, shares = np.asarray(ids, "<u4"), np.asarray(shares, "<u8")
    below = np.concatenate([[0], np.cumsum(shares)[:-1]]).astype(np.uint64) if len(ids) else np.zeros(0, np.uint64)
    number = np.full(int(ids[-1]) + 1 if len(ids) else 0, -1, np.int64)
    number[ids] = np.arange(len(ids))
    bits = int(shares.sum()).bit_length() - 1 if len(ids) else LEAST_BITS
    return Table(ids, shares, below, number, bits, zlib.crc32(shares.tobytes(), zlib.crc32(ids.tobytes())))


def encode(blocks: Sequence[np.ndarray], known: Table, lanes: int = LANES, rows: int = ROWS) -> list[bytes]:
    """One frame for each block of ids; blocks are encoded side by side, row by row from the last.

    Longer blocks come first, so that those with a row at hand are the first ones.
    """
    order = sorted(range(len(blocks)), key=lambda b: -len(blocks[b]))
    sizes = np.array([len(blocks[b]) for b in order], np.int64)
    heights = -(-sizes // lanes)
    starts = np.cumsum(heights) - heights
    # behind a block's ids stands one whose share is the whole: it changes no state and emits nothing
    symbols = np.full((int(heights.sum()), lanes), len(known.ids), np.int32)
    for start, size, b in zip(starts.tolist(), sizes.tolist(), order, strict=True):
        symbols.reshape(-1)[start * lanes : start * lanes + size] = _numbers(np.asarray(blocks[b], np.uint32), known)
    shares, belows = np.append(known.frequency, np.uint64(1 << known.bits)), np.append(known.below, np.uint64(0))
    state = np.full((len(order), lanes), LOW, np.uint64)
    stretches = -(-heights // rows)
    states = [np.zeros((n, lanes), "<u8") for n in stretches]
    emitted: list[np.ndarray] = []
    places_of: list[np.ndarray] = []
    height = int(heights.max(initial=0))
    alive = np.searchsorted(-heights, -np.arange(height), side="left").tolist()  # blocks higher than each row
    whole_share, shift = np.uint64(1 << known.bits), np.uint64(63 - known.bits)
    for t in range(height - 1, -1, -1):
        live = alive[t]
        symbol = symbols[starts[:live] + t].reshape(-1)
        share = shares[symbol]
        x = state[:live].reshape(-1)
        full = np.flatnonzero(x >= share << shift)
        over = x[full]
        emitted.append(over.astype("<u4"))
        places_of.append(full)
        x[full] = over >> np.uint64(32)
        x += x // share * (whole_share - share) + belows[symbol]
        if t % rows == 0:
            for k in range(live):
                states[k][t // rows] = state[k]
    words = np.concatenate([*emitted[::-1], np.zeros(0, "<u4")])
    owner = np.concatenate([*places_of[::-1], np.zeros(0, np.int64)]) // lanes
    row = np.repeat(np.arange(height), np.array([len(e) for e in emitted[::-1]], np.int64))
    counts = np.bincount(row * len(order) + owner, minlength=height * len(order)).reshape(height, len(order))  # code words by row and block
    words = words[np.argsort(owner, kind="stable")]
    ends = np.cumsum(np.bincount(owner, minlength=len(order)))
    frames: list[bytes] = [b""] * len(order)
    for k, b in enumerate(order):
        count = counts[: heights[k], k]
        own = words[ends[k] - count.sum() : ends[k]]
        places = (np.cumsum(count) - count)[::rows].astype("<u8")
        ids, step = np.asarray(blocks[b], "<u4"), lanes * rows
        checks = np.array([zlib.crc32(ids[s : s + step].tobytes()) for s in range(0, len(ids), step)], "<u4")
        body = (
            _HEADER.pack(MAGIC, VERSION, lanes, rows, len(places), len(ids), len(own), known.checksum)
            + states[k].tobytes()
            + places.tobytes()
            + checks.tobytes()
            + own.tobytes()
        )
        frames[b] = body + struct.pack("<I", zlib.crc32(body))
    return frames


def _numbers(ids: np.ndarray, known: Table) -> np.ndarray:
    if len(ids) and (ids.max() >= len(known.number) or (numbers := known.number[ids]).min() < 0):
        raise ValueError("an id is not in the frequency table")
    return numbers if len(ids) else np.zeros(0, np.int64)


class Frame(NamedTuple):
    ids: int
    lanes: int
    rows: int
    states: np.ndarray
    places: np.ndarray
    checks: np.ndarray
    words: np.ndarray


def opened(frame: bytes, known: Table) -> Frame:
    """The parts of a frame; ValueError if it is damaged or was made with another table."""
    if len(frame) < _HEADER.size + 4 or zlib.crc32(frame[:-4]) != struct.unpack("<I", frame[-4:])[0]:
        raise ValueError("a frame is damaged")
    magic, version, lanes, rows, stretches, ids, words, checksum = _HEADER.unpack_from(frame)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a frame of this version")
    if checksum != known.checksum:
        raise ValueError("the frame was made with another frequency table")
    at, parts = _HEADER.size, []
    for kind, n in (("<u8", stretches * lanes), ("<u8", stretches), ("<u4", stretches), ("<u4", words)):
        parts.append(np.frombuffer(frame, kind, n, at))
        at += parts[-1].nbytes
    return Frame(ids, lanes, rows, parts[0].reshape(stretches, lanes), *parts[1:])


def decode(frames: Sequence[bytes], known: Table, slots: np.ndarray) -> list[np.ndarray]:
    """The ids of every frame; the stretches of all frames are decoded side by side."""
    parts = [opened(f, known) for f in frames]
    return _decoded(parts, [(0, len(p.places)) for p in parts], known, slots)


def decode_from(frame: bytes, first: int, last: int, known: Table, slots: np.ndarray) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a frame; only the stretches that hold them are decoded."""
    part = opened(frame, known)
    first, last = max(0, first), min(last, part.ids)
    if first >= last:
        return np.zeros(0, np.uint32)
    step = part.lanes * part.rows
    a, b = first // step, -(-last // step)
    return _decoded([part], [(a, b)], known, slots)[0][first - a * step : last - a * step]


def _decoded(
    parts: Sequence[Frame], wanted: Sequence[tuple[int, int]], known: Table, slots: np.ndarray
) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(parts)
    for shape in sorted({(p.lanes, p.rows) for p in parts}):
        mine = [k for k, p in enumerate(parts) if (p.lanes, p.rows) == shape and wanted[k][0] < wanted[k][1]]
        if mine:
            _decode_alike(mine, parts, wanted, known, slots, out)
    return out


def _decode_alike(mine, parts, wanted, known, slots, out) -> None:
    lanes, rows = parts[mine[0]].lanes, parts[mine[0]].rows
    step = lanes * rows
    offset = np.cumsum([0] + [len(parts[k].words) for k in mine])
    words = np.concatenate([*(parts[k].words for k in mine), np.zeros(1, "<u4")]).astype(np.uint64)
    state = np.concatenate([parts[k].states[a:b] for k in mine for a, b in [wanted[k]]]).astype(np.uint64)
    at = np.concatenate([parts[k].places[a:b].astype(np.int64) + o for k, o in zip(mine, offset) for a, b in [wanted[k]]])
    sizes = np.concatenate([np.minimum(step, parts[k].ids - np.arange(a, b) * step) for k in mine for a, b in [wanted[k]]])
    # longer stretches first, so that those with a row at hand are the first ones
    longest = np.argsort(-sizes, kind="stable")
    state, at = state[longest], at[longest]
    heights = -(-sizes[longest] // lanes)
    alive = np.searchsorted(-heights, -np.arange(int(heights[0])), side="left").tolist()
    found = np.zeros((len(sizes), rows, lanes), np.uint32)
    bits, mask = np.uint64(known.bits), np.uint64((1 << known.bits) - 1)
    share = known.frequency[slots]
    rest = np.arange(len(slots), dtype=np.uint64) - known.below[slots]
    # lanes behind a stretch's last id go on with what follows: nothing after them is read
    for t, live in enumerate(alive):
        old = state[:live].reshape(-1)
        slot = (old & mask).astype(np.int64)
        found[:live, t] = slot.reshape(live, lanes)
        x = share[slot] * (old >> bits) + rest[slot]
        short = np.flatnonzero(x < LOW)
        taken = np.bincount(short // lanes, minlength=live)
        place = np.arange(len(short)) + np.repeat(at[:live] - (np.cumsum(taken) - taken), taken)
        x[short] = (x[short] << np.uint64(32)) | words.take(place, mode="clip")
        at[:live] += taken
        state[:live] = x.reshape(live, lanes)
    ids = np.empty_like(found)
    ids[longest] = known.ids[slots[found]]
    done = 0
    for k in mine:
        a, b = wanted[k]
        own = ids[done : done + b - a].reshape(-1)[: int(sizes[done : done + b - a].sum())]
        for s in range(a, b):
            piece = own[(s - a) * step : (s - a + 1) * step]
            if zlib.crc32(piece.astype("<u4").tobytes()) != parts[k].checks[s]:
                raise ValueError("decoded ids do not match their checksum")
        out[k] = own
        done += b - a
