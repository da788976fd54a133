"""Secret scans: fixed patterns, and a battery of randomness tests on encoded strings."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import per_batch, with_column_per_batch

# fixed values: the base patterns and the lengths their matches need
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32
#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "random")

#: Parts of the keywords, in lower case; a text without any has no assignment.
STEMS = ("passw", "secret", "token", "api")
#: Strings that may be encoded, with their padding; an equals sign inside ends one and starts the next.
STRING = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words that identifiers may be made of.
WORD = re.compile(r"[A-Za-z]{2,12}")
#: Ways to cut a string that mixes alphabets into pieces of this length at least: at slashes, then at what each alphabet lacks.
PIECES = (re.compile(r"[^/]+"), re.compile(r"[A-Za-z0-9+/]+=*"), re.compile(r"[A-Za-z0-9_-]+=*"))
PIECE_LENGTH = 20
#: A string needs this much room for randomness, in bits, for the tests to tell it from words.
ROOM = 76
#: Share of wrong strings among those reported, in each class of encodings and lengths.
FALSE_DISCOVERIES = 0.05
#: p-values are counted by their logarithm, so many steps for a power of ten, to this many in all.
STEPS, LAST_STEP = 20, 600
#: Letters that make up most of the words of Latin script.
COMMON = frozenset("etaoinsrhlETAOINSRHL")
#: Identifiers are made of words: ways to join them and, with every way, so many lengths, from every document and beforehand.
STYLES = ("camel", "lower", "upper", "snake", "path", "number")
LENGTHS = (20, 24, 29, 34, 40, 48, 57, 68, 80, 96, 136, 192, 272)
OWN, BEFOREHAND = 2, 200
#: Words the identifiers made beforehand consist of, so that few documents have a null, too.
WORDS = (
    "get set user email address handler request response server client account number value index item list table column "
    "file path name type data state error message default config update create remove find first last next order total "
    "count start end time date version page title link image source target window control service manager factory"
).split()

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by the size of their alphabet, smallest first.
ENCODINGS = [
    ("hex", _DIGITS + "abcdef"),
    ("hex", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("base36", _DIGITS + _UPPER),
    ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
]
_MEMBERS = [(name, frozenset(letters), {c: i for i, c in enumerate(letters)}) for name, letters in ENCODINGS]
#: Classes of encodings that are judged apart.
FAMILIES = {"hex": 0, "base32": 1, "base36": 1, "base62": 2, "base64": 3, "base64url": 3}


def _grouped(letters: str, group: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray]:
    """The group of each symbol and the share of symbols that each group has."""
    groups = np.array([group(c) for c in letters])
    used, groups = np.unique(groups, return_inverse=True)
    return groups, np.bincount(groups, minlength=len(used)) / len(letters)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


#: Ways to group the symbols of each encoding: digits, lower and upper case, signs; and common letters, rare ones, others.
_GROUPED = [
    [_grouped(letters, _kind), _grouped(letters, lambda c: 0 if c in COMMON else 1 if c.isalpha() else 2)]
    for _, letters in ENCODINGS
]


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: int  # where the secret itself starts


def infer_encoding(string: str) -> tuple[int, np.ndarray] | None:
    """Number of the smallest alphabet that holds the string, and its symbols as numbers.

    Padding is left out. Words and numbers are no encoding: letters and digits must both occur.
    """
    body = string.rstrip("=")
    used = set(body)
    if not (any(c in _DIGITS for c in used) and any(c.isalpha() for c in used)):
        return None
    for k, (_, members, place) in enumerate(_MEMBERS):
        if used <= members:
            return k, np.fromiter(map(place.__getitem__, body), np.int64, len(body))
    return None


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared(counts: np.ndarray, expected: np.ndarray) -> float:
    """Upper tail of the chi-squared statistic, by the cube-root approximation."""
    chi = float(((counts - expected) ** 2 / expected).sum())
    free = len(expected) - 1
    if free < 1:
        return 1.0
    cube = (chi / free) ** (1 / 3)
    return _tail((cube - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))


def uniformity(symbols: np.ndarray, size: int) -> float:
    """Chi-squared test that all symbols are equally likely; groups of neighbouring symbols where the string is short."""
    groups = max(2, min(size, len(symbols) // 5))
    counts = np.bincount(symbols * groups // size, minlength=groups)
    widths = np.bincount(np.arange(size) * groups // size, minlength=groups)
    return chi_squared(counts, len(symbols) * widths / size)


def uniformity_of(symbols: np.ndarray, groups: np.ndarray, shares: np.ndarray) -> float:
    """The same over given groups of symbols."""
    return chi_squared(np.bincount(groups[symbols], minlength=len(shares)), len(symbols) * shares)


def runs(symbols: np.ndarray, size: int) -> float:
    """Test of the number of runs of symbols in the upper and the lower half of the alphabet."""
    high = symbols >= size / 2
    n, ones = len(high), int(high.sum())
    zeros = n - ones
    if not ones or not zeros:
        return 2.0 ** (1 - n)
    mean = 2 * ones * zeros / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    seen = 1 + int((high[1:] != high[:-1]).sum())
    return 2 * _tail(abs(seen - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial_correlation(symbols: np.ndarray) -> float:
    """Test that neighbouring symbols are not correlated."""
    centred = symbols - symbols.mean()
    power = float((centred**2).sum())
    if not power:
        return 0.0
    r = float((centred[1:] * centred[:-1]).sum()) / power
    n = len(symbols)
    return 2 * _tail(abs(r + 1 / n) * math.sqrt(n))


def battery(string: str) -> float | None:
    """Combined p-value of the tests that the string is random; None if it cannot be judged."""
    found = _judge(string)
    return found[1] if found else None


def _judge(string: str) -> tuple[int, float] | None:
    """Number of the encoding, and the p-value combined of uniformity under three groupings, runs and correlation."""
    found = infer_encoding(string)
    if found is None:
        return None
    k, symbols = found
    size = len(ENCODINGS[k][1])
    if len(symbols) * math.log2(size) < ROOM:
        return None
    values = [uniformity(symbols, size), runs(symbols, size), serial_correlation(symbols)]
    values += [uniformity_of(symbols, groups, shares) for groups, shares in _GROUPED[k]]
    least = min(values)
    return k, min(1.0, -math.expm1(len(values) * math.log1p(-least))) if least < 1 else 1.0


def class_of(encoding: int, length: int) -> int:
    """Family of the encoding and half powers of two of the length."""
    return 100 * FAMILIES[ENCODINGS[encoding][0]] + int(2 * math.log2(length))


def identifier(words: Sequence[str], style: str, length: int, seed: int) -> str:
    """A string as programs name things: words joined in some style, with a number here and there."""
    rng = random.Random(seed)
    if style == "number":  # ids of digits with few letters
        digits = [str(rng.randrange(10)) for _ in range(length)]
        for _ in range(rng.randint(1, 3)):
            digits[rng.randrange(length)] = rng.choice("abcdef")
        return "".join(digits)
    out, k = "", 0
    while len(out) < length:
        word = words[k % len(words)].lower()
        joint = {"snake": "_", "path": "/"}.get(style, "") if out else ""
        out += joint + (word.capitalize() if style == "camel" and out else word)
        if rng.random() < 0.3:
            out += str(rng.randrange(100))
        k += 1
    out = out[:length]
    if not any(c.isdigit() for c in out):
        out = out[:-1] + str(rng.randrange(10))
    return out.upper() if style == "upper" else out


def identifiers(words: Sequence[str], seed: int, n: int) -> Iterator[str]:
    """Identifiers of these words, their styles and lengths chosen by the seed."""
    for k in range(n if words else 0):
        some = zlib.crc32(f"{seed}:{k}".encode())
        style, length = STYLES[some % len(STYLES)], LENGTHS[some // len(STYLES) % len(LENGTHS)]
        at = some % len(words)
        yield identifier([*words[at:], *words[:at]], style, length, some)


def _null(strings: Iterable[str]) -> Counter:
    """Identifiers by class and step of their p-value."""
    seen: Counter = Counter()
    for string in strings:
        if (found := _judge(string)) is not None:
            seen[class_of(found[0], len(string)), _step(found[1])] += 1
    return seen


def _step(p: float) -> int:
    return LAST_STEP if p <= 0 else min(LAST_STEP, int(-math.log10(p) * STEPS))


def _mixes(string: str) -> bool:
    """Whether no alphabet can hold the string, as it has the signs of both kinds of base64."""
    return ("+" in string or "/" in string) and ("_" in string or "-" in string)


def _tested(string: str, start: int, ways: tuple[re.Pattern, ...] = PIECES) -> Iterator[tuple[int, str, tuple[int, float]]]:
    """Start, string, encoding and p-value of a string, or of its pieces where it mixes alphabets.

    What stands between pieces that can be judged is cut in the next way.
    """
    if len(string) < PIECE_LENGTH:
        return
    if not _mixes(string):
        found = None if UUID.fullmatch(string) else _judge(string)
        if found is not None:
            yield start, string, found
        return
    if not ways:
        return
    reached = 0
    for m in ways[0].finditer(string):
        found = list(_tested(m.group(), start + m.start(), ways[1:]))
        if found:
            yield from _tested(string[reached : m.start()], start + reached, ways[1:])
            yield from found
            reached = m.end()
    yield from _tested(string[reached:], start + reached, ways[1:])


def _judged(text: str) -> Iterator[tuple[int, int, int, int]]:
    """Strings with a p-value: start, end, class, step of the p-value."""
    for match in STRING.finditer(text):
        for start, string, (encoding, p) in _tested(match.group(), match.start()):
            yield start, start + len(string), class_of(encoding, len(string)), _step(p)


def calibrate(docs: DataFrame, text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For every class of encodings and lengths the last step at which strings are reported as random.

    How far identifiers of ordinary words get is the null: every document gives
    ``OWN`` strings of words of its own, beside those of a fixed list of words.
    A class reports as many of its strings as the step-up rule allows, so that of
    those reported at most ``rate`` are expected to be such identifiers. Tasks
    count strings and null by class and step over all documents; the counts, a
    bounded number, come to the driver.
    """

    def run(batch: pa.RecordBatch) -> dict:
        seen: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if text:
                seen.update((False, c, s) for _, _, c, s in _judged(text))
                seed = zlib.crc32(text.encode())
                words = [m.group() for m in islice(WORD.finditer(text, seed % len(text)), 24)]
                seen.update({(True, c, s): n for (c, s), n in _null(identifiers(words, seed, OWN)).items()})
        return {
            "null": pa.array([k[0] for k in seen], pa.bool_()),
            "class": pa.array([k[1] for k in seen], pa.int32()),
            "step": pa.array([k[2] for k in seen], pa.int32()),
            "n": pa.array(list(seen.values()), pa.int64()),
        }

    counted = per_batch(docs.select(text_col), run, "null boolean, class int, step int, n long")
    found = counted.groupBy("null", "class", "step").agg(F.sum("n").alias("n")).collect()
    seen: dict[int, Counter] = {}
    null: dict[int, Counter] = {}
    for (group, step), n in _null(identifiers(WORDS, 0, BEFOREHAND * len(STYLES) * len(LENGTHS))).items():
        null.setdefault(group, Counter())[step] += n
    for r in found:
        (null if r["null"] else seen).setdefault(r["class"], Counter())[r["step"]] += r["n"]
    return {group: _cut(counts, null.get(group, Counter()), rate) for group, counts in seen.items()}


def _cut(counts: Mapping[int, int], null: Mapping[int, int], rate: float) -> int:
    """The last step that passes the step-up rule; -1 if none does.

    A step passes if, were all strings identifiers, those expected up to it are
    at most ``rate`` of those that are there. One string more in the null than
    was seen keeps the share of identifiers from being taken for nothing.
    """
    total, made, cut = sum(counts.values()), sum(null.values()), -1
    reported = passed = 0
    for step in sorted({*counts, *null}):
        reported += counts.get(step, 0)
        passed += null.get(step, 0)
        if reported and total * (1 + passed) / (1 + made) <= rate * reported:
            cut = step
    return cut


def find_spans(text: str | None, cuts: dict[int, int]) -> list[Span]:
    """All spans of a whole text, by start and kind."""
    if not text:
        return []
    found = []
    lower = text.lower()
    if any(stem in lower for stem in STEMS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LENGTH:
                found.append(Span("assign", m.start(), m.end(), m.start(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LENGTH:
                found.append(Span("access", m.start(), m.end(), m.start()))
    for outer in STRING.finditer(text):
        for m in HEX.finditer(text, outer.start(), outer.end()):
            if m.end() - m.start() >= HEX_LENGTH:
                found.append(Span("hex", m.start(), m.end(), m.start()))
    for start, end, group, step in _judged(text):
        if step <= cuts.get(group, LAST_STEP):
            found.append(Span("random", start, end, start))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int32())])
_SPAN_SQL = "struct<kind: string, start: int, end: int, value: int>"


def scan(docs: DataFrame, text_col: str = "text", label: str = "secrets", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Input rows with the array column ``secrets``: kind, start, end and start of the value, in code points.

    ``assign``, ``access`` and ``hex`` are matches of fixed patterns. ``random``
    are strings of 20 characters and more in an encoding whose symbols are more
    even, mixed and independent than those of identifiers made of ordinary
    words: of the strings reported in a class of encodings and lengths, the
    expected share of identifiers is held at ``rate`` over all documents. That
    cut is all that a row's spans owe to other rows. UUIDs are no secrets. Names before an equals sign and, where the
    whole fits no alphabet, parts of paths are strings of their own. Spans of
    different kinds may overlap.

    Null and empty texts have no spans. Rows are judged one by one, so ids and
    repeated rows do not matter. An input column of the label's name is replaced;
    others may have any name.
    """
    cuts = calibrate(docs, text_col, rate)

    def run(texts: list[str | None]) -> list:
        return [[s._asdict() for s in find_spans(t, cuts)] for t in texts]

    return with_column_per_batch(docs, text_col, label, f"array<{_SPAN_SQL}>", pa.list_(_SPAN), run)


def redacted(text: str | None, spans: list[Span], mark: str) -> str | None:
    """The text with every secret's value replaced; overlapping values become one mark."""
    out, reached = [], 0
    values = sorted((s.value, s.end) for s in spans)
    for k, (start, end) in enumerate(values):
        if start >= reached or not k:
            out += [text[reached:start], mark]
        reached = max(reached, end)
    return "".join([*out, text[reached:]]) if values else text


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Input rows with the values of all secrets replaced by a mark; rows without any stay as they are."""
    cuts = calibrate(docs, text_col, rate)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            clean = [redacted(t, find_spans(t, cuts), mark) for t in texts.to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, texts.type))

    return docs.mapInArrow(run, docs.schema)
