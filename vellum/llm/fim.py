"""Fill-in-middle transformation: texts cut into three parts at tokens' ends, and put together again."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import with_two_columns_per_batch

SPACE = r"\x20\x09-\x0D"
#: A text is a row of units: a word with the white space before it, or white space that ends the text.
UNITS = regex.compile(rf"([{SPACE}]*[^{SPACE}]+|[{SPACE}]+)*")
#: Where one unit surely ends: after a word, before white space.
_SEAM = regex.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")
#: The matcher keeps about 200 bytes for each unit, so longer texts are matched in stretches of about this length.
STRETCH = 1_000_000

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
KIND = "struct<n: bigint, form: string, output: string, prefix_chars: bigint, middle_chars: bigint>"
_ARROW = pa.struct(
    [
        ("n", pa.int64()),
        ("form", pa.string()),
        ("output", pa.string()),
        ("prefix_chars", pa.int64()),
        ("middle_chars", pa.int64()),
    ]
)


def unit_ends(text: str, stretch: int = STRETCH) -> list[int]:
    """Offsets at which the units of a text end, in code points.

    One full match keeps every repetition of its group. A text above ``stretch``
    characters is cut where a unit ends anyway and matched stretch by stretch.
    """
    if len(text) <= stretch:
        return UNITS.fullmatch(text).ends(1)
    ends, at = [], 0
    while at < len(text):
        seam = _SEAM.search(text, at + stretch) if at + stretch < len(text) else None
        to = seam.start() if seam else len(text)
        ends += UNITS.fullmatch(text, at, to).ends(1)
        at = to
    return ends


def draws(row_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from a document's id; a null id counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def transform_text(
    text: str | None, row_id: object, seed: int = 42, rate: int = 50, spm: int = 80, marks: Sequence[str] = MARKS
) -> dict:
    """The number of units, the form, the text in that form, and the lengths of prefix and middle."""
    text = text or ""
    ends = unit_ends(text)
    n = len(ends)
    first, second, chance, order = draws(row_id, seed)
    if not text or any(m in text for m in marks) or chance % 100 >= rate:
        return {"n": n, "form": "plain", "output": text, "prefix_chars": None, "middle_chars": None}
    cuts = [0, *ends]
    a, b = sorted((cuts[first % (n + 1)], cuts[second % (n + 1)]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if order % 100 < spm else "psm"
    p, s, m = marks
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return {"n": n, "form": form, "output": "".join(parts), "prefix_chars": a, "middle_chars": b - a}


def transform(
    docs: DataFrame,
    seed: int = 42,
    rate: int = 50,
    spm: int = 80,
    marks: Sequence[str] = MARKS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label: str = "fim",
) -> DataFrame:
    """Input rows with a struct ``label``: ``n``, ``form``, ``output``, ``prefix_chars``, ``middle_chars``.

    A text of ``n`` units is cut at two units' ends, which the id and the seed
    choose, and put together as suffix, prefix, middle (``spm`` of 100 texts) or
    prefix, suffix, middle (``psm``); of 100 texts ``100 - rate`` stay ``plain``,
    as do empty texts and texts with a mark in them, which could not be taken
    apart again. The three marks must differ, and none may begin with an end of
    another. Lengths are in code points, null for plain texts.

    A null text is an empty one, a null id counts as the empty text. Rows of one
    id and text get the same result. Other columns pass unchanged under any
    name; an input column ``label`` is replaced. No shuffle; a task holds one
    batch of texts.
    """
    _check(marks)

    def batch(ids: list, texts: list) -> list:
        return [transform_text(t, i, seed, rate, spm, marks) for i, t in zip(ids, texts, strict=True)]

    return with_two_columns_per_batch(docs, id_col, text_col, label, KIND, _ARROW, batch)


def _check(marks: Sequence[str]) -> None:
    if len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different marks are needed")
    for a in marks:
        for b in marks:
            if any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"mark {b!r} begins with an end of {a!r}")


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text a transformed one was made from, from its output and form alone."""
    mark = "|".join(rf"\Q{m}\E" for m in marks)
    parts = F.split(output, mark, -1)
    prefix, suffix = F.when(form == "spm", F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))), F.when(
        form == "spm", F.get(parts, F.lit(1))
    ).otherwise(F.get(parts, F.lit(2)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))
