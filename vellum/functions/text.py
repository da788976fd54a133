"""Text functions: trimming, JSON string literals, time spelling, tokens."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space characters.
SPACE = "\t\n\v\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def unicode_trim(text: Column) -> Column:
    """Strip every Unicode white space from both ends."""
    return F.btrim(text, F.lit(SPACE))


# ---------------------------------------------------------------- JSON

# a complete string literal: no bare quote, no raw control character
_LITERAL = r'(?s)\A"(?:[^"\\\x00-\x1F]++|\\.)*+"\z'
_HEX = "[0-9a-fA-F]"
_HIGH, _LOW = rf"\\u[dD][89abAB]{_HEX}{{2}}", rf"\\u[dD][c-fC-F]{_HEX}{{2}}"
# escapes are stepped over one by one from where the last match ended, so each is
# seen whole: text, a plain escape, a pair of surrogates, any other code unit
_WHOLE = rf"[^\\]++|\\[^u]|{_HIGH}{_LOW}|\\u(?![dD][89a-fA-F]){_HEX}{{4}}"
_LONE = rf"(?s)\G(?<before>(?:{_WHOLE})*+)\\u[dD][89a-fA-F]{_HEX}{{2}}"


def json_literal(literal: Column) -> Column:
    """Decode a quoted JSON string; NULL unless it is exactly one valid literal."""
    no_lone = F.when(
        F.contains(F.lower(literal), F.lit("\\ud")),
        F.regexp_replace(literal, _LONE, r"${before}\\ufffd"),
    ).otherwise(literal)
    decoded = F.get(F.from_json(F.concat(F.lit("["), no_lone, F.lit("]")), "array<string>"), F.lit(0))
    inner = F.substr(literal, F.lit(2), F.length(literal) - 2)
    return F.when(
        F.rlike(literal, F.lit(_LITERAL)),
        F.when(F.contains(literal, F.lit("\\")), decoded).otherwise(inner),
    )


# ---------------------------------------------------------------- time

# the last millisecond a timestamp can hold, in the year 294247, and the first of the year 1
_MAX_MS = 9223372036854775
_MIN_MS = -62135596800000


def epoch_millis(number: Column) -> Column:
    """Milliseconds spelled as a (possibly E-notation) number, truncated; NULL if unreadable."""
    ms = number.try_cast("double").try_cast("bigint")
    return F.when(ms.between(_MIN_MS, _MAX_MS), ms)


def rfc3339_seconds(seconds: Column) -> Column:
    """Epoch seconds as ``yyyy-MM-ddTHH:mm:ssZ`` whatever the session time zone is.

    Years of five and six digits have no sign.
    """
    clock = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        secs=seconds.cast("decimal(18,6)")
    )
    return F.concat(F.translate(clock.cast("string"), " +", "T"), F.lit("Z"))


def rfc3339_millis(ms: Column) -> Column:
    return rfc3339_seconds(F.floor(ms / 1000))


def instant(ts: Column) -> Column:
    """RFC3339 text as a timestamp; NULL if unreadable."""
    return ts.try_cast("timestamp")


# ---------------------------------------------------------------- tokens (F1)

# Combining marks that join a word and vanish from it.
JOINING_MARKS = [
    (0x300, 0x304), (0x306, 0x30C), (0x30F, 0x30F), (0x311, 0x311), (0x31B, 0x31B),
    (0x323, 0x328), (0x32D, 0x32E), (0x330, 0x331),
]
_MARKS = "".join(chr(code) for low, high in JOINING_MARKS for code in range(low, high + 1))
WORD = r"[\p{L}\p{N}\p{Co}]+"


def _fold(char: str) -> str:
    """Case-fold one character and drop a single accent from a Latin letter."""
    folded = char.casefold()
    if len(folded) != 1:
        folded = char.lower()
    parts = unicodedata.normalize("NFD", folded)
    if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
        return parts[0]
    return folded


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Lower-case characters that still fold to another one, and that one."""
    source, target = [], []
    for code in range(0x80, 0xFFFF):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        folded = _fold(char)
        if char == char.lower() and len(folded) == 1 and folded != char:
            source.append(char)
            target.append(folded)
    return "".join(source), "".join(target)


def without_marks(low: Column) -> Column:
    """Drop joining marks; most texts have none and pass untouched."""
    has_marks = (F.octet_length(low) != F.length(low)) & F.rlike(low, F.lit(r"[\x{300}-\x{331}]"))
    return F.when(has_marks, F.regexp_replace(low, f"[{_MARKS}]", "")).otherwise(low)


def fold_word(word: Column) -> Column:
    """Fold one lower-case word."""
    return F.when(F.octet_length(word) == F.length(word), word).otherwise(F.translate(word, *_fold_table()))


def tokens(text: Column) -> Column:
    """Ordered array of folded words."""
    words = F.regexp_extract_all(without_marks(F.lower(text)), F.lit(WORD), F.lit(0))
    return F.transform(words, fold_word)


def link_tokens(links: Column) -> Column:
    """Links share one position sequence: the tokens of their JSON text."""
    return tokens(F.to_json(links))


@lru_cache(maxsize=1000)
def query_tokens(text: str) -> tuple[str, ...]:
    """The few words of a query by the same rule; the plan holds one literal row, so no job runs."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    row = spark.sql("SELECT * FROM VALUES (:text) AS query(text)", {"text": text})
    return tuple(row.select(tokens(F.col("text"))).first()[0])
