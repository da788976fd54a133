"""Title, meta and script elements of a page, read with one left-to-right pattern.

The pattern walks the page once. Text, comments, other elements and elements
whose content is raw text are stepped over, so a tag inside a comment, an
attribute or a text area never leaks. All runs are possessive: the matcher
neither backtracks nor recurses, whatever the page holds.

A script that opens a comment may hold whole script elements until the comment
ends, as old pages hid scripts so. Drawings and formulas have rules of their own:
a title there holds elements, and its text ends where the first of them begins.
So their tags are kept among the segments; text there is read as elsewhere in
what HTML a drawing embeds.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[\t\n\f\r ]"
_END = r"(?=[\t\n\f\r />])"
_ATTRS = rf"""(?:[^>=]++|={_WS}*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_FOREIGN = "(?:svg|math)"


def _raw_text(name: str) -> str:
    """Everything up to the closing tag of ``name``, or to the end of a cut-off page."""
    return rf"[^<]*+(?:<(?!/{name}{_END})[^<]*+)*+"


#: Up to the end of a comment or a closing tag of a script, which does not count: it belongs to the script inside.
_INNER_SCRIPT = rf"<script{_END}(?:[^<-]++|-(?!->)|<(?!/script{_END}))*+(?:</script)?+"
_COMMENT_IN_SCRIPT = rf"<!(?=--)(?:[^<-]++|-(?!->)|{_INNER_SCRIPT}|<(?!/?script{_END}))*+(?:-->)?+"
_SCRIPT_TEXT = rf"(?:[^<]++|{_COMMENT_IN_SCRIPT}|<(?!!--|/script{_END}))*+"

_SKIP = "|".join(
    [
        r"[^<]++",
        r"<!--(?:-?>|[^-]*+(?:-(?!-!?>)[^-]*+)*+(?:--!?>)?+)",
        rf"<(?<raw>style|textarea|noscript|iframe|noembed|noframes|xmp){_END}{_ATTRS}>" + _raw_text(r"\k<raw>"),
        rf"<(?!(?:script|title|meta|svg|math){_END})[a-z]{_ATTRS}>",
        rf"<(?![a-z]|!--|/{_FOREIGN}{_END})",
    ]
)
_WANTED = "|".join(
    [
        rf"<script{_END}{_ATTRS}>{_SCRIPT_TEXT}",
        rf"<title{_END}{_ATTRS}>" + _raw_text("title"),
        rf"<meta{_END}{_ATTRS}>",
        rf"<{_FOREIGN}{_END}{_ATTRS}>",
        rf"</{_FOREIGN}{_END}",
        r"<",
        r"\z",
    ]
)
_SEGMENT = rf"(?is)(?:{_SKIP})*+({_WANTED})"
_OPENING = rf"(?is)\A<[a-z]++{_ATTRS}>"
_ATTRIBUTE = rf"""([^\s"'<>/=]+){_WS}*={_WS}*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*)"""


def line_feeds(page: Column) -> Column:
    """CRLF and lone CR become LF, as a page parser reads them."""
    return F.when(F.contains(page, F.lit("\r")), F.regexp_replace(page, "\r\n?", "\n")).otherwise(page)


def segments(page: Column) -> Column:
    """Title, meta and script elements, and the tags of drawings and formulas, in document order."""
    found = F.regexp_extract_all(line_feeds(page), F.lit(_SEGMENT), F.lit(2))
    return F.filter(found, lambda s: F.length(s) > 1)


def _is(segment: Column, name: str) -> Column:
    return F.lower(F.substring(segment, 2, len(name))) == name


def _body(segment: Column) -> Column:
    """Text after the opening tag; a segment ends before its closing tag."""
    start = F.length(F.regexp_extract(segment, _OPENING, 0))
    return F.substr(segment, start + 1, F.length(segment) - start)


def scripts(segs: Column) -> Column:
    """Bodies of the scripts that hold text."""
    bodies = F.transform(F.filter(segs, lambda s: _is(s, "script")), lambda s: _body(s))
    return F.filter(bodies, lambda b: b != "")


def page_title(segs: Column) -> Column:
    """Text of the last title, entities decoded; empty without one.

    The title of a drawing counts too; its text goes up to the first tag or comment.
    """
    last = F.try_element_at(F.filter(segs, lambda s: _is(s, "title")), F.lit(-1))
    text = _body(last)
    drawn = F.exists(segs, _opens) & (_depth_of_last_title(segs) > 0)
    return html_unescape(F.coalesce(F.when(drawn, F.regexp_extract(text, _TEXT, 0)).otherwise(text), F.lit("")))


_TEXT = r"(?i)\A(?:[^<]++|<(?![a-z/!?]))*+"


def _opens(segment: Column) -> Column:
    return F.rlike(segment, F.lit(rf"(?i)\A<{_FOREIGN}{_END}")) & ~F.endswith(segment, F.lit("/>"))


def _depth_of_last_title(segs: Column) -> Column:
    """How many drawings and formulas are open where the last title begins."""

    def step(now: Column, segment: Column) -> Column:
        depth = (
            F.when(_opens(segment), now["depth"] + 1)
            .when(F.startswith(segment, F.lit("</")), F.greatest(now["depth"] - 1, F.lit(0)))
            .otherwise(now["depth"])
        )
        title = F.when(_is(segment, "title"), now["depth"]).otherwise(now["title"])
        return F.struct(depth.alias("depth"), title.alias("title"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("title"))
    return F.aggregate(segs, start, step, lambda now: now["title"])


def metas(segs: Column) -> Column:
    """Meta elements as arrays of (name, value) pairs, names in lower case."""

    def attributes(tag: Column) -> Column:
        names = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1))
        values = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2))
        return F.zip_with(
            names,
            values,
            lambda n, v: F.struct(
                F.lower(n).alias("name"),
                F.regexp_replace(v, r"""(?s)\A(["'])(.*)\1\z""", "$2").alias("value"),
            ),
        )

    tags = F.filter(segs, lambda s: _is(s, "meta"))
    return F.transform(tags, lambda s: attributes(F.substr(s, F.lit(6), F.length(s) - 6)))


def og_field(meta: Column, prop: str) -> Column:
    """``content`` of the last meta whose ``property`` is exactly ``prop``."""
    return html_unescape(og_source(meta, prop), attribute=True)


def og_fields(meta: Column, *props: str) -> Column:
    """Several of them as an array."""
    return F.transform(F.array(*[og_source(meta, p) for p in props]), lambda t: html_unescape(t, attribute=True))


def og_source(meta: Column, prop: str) -> Column:
    """The attribute as it is written in the page."""
    matching = F.filter(
        meta,
        lambda m: F.exists(m, lambda a: (a["name"] == "property") & (a["value"] == prop))
        & F.exists(m, lambda a: a["name"] == "content"),
    )
    last = F.try_element_at(matching, F.lit(-1))
    content = F.get(F.filter(last, lambda a: a["name"] == "content"), F.lit(0))["value"]
    return F.coalesce(content, F.lit(""))


# ---------------------------------------------------------------- entities

_LEGACY = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True)
_REFERENCE = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?"


def _names() -> Column:
    return F.from_json(F.lit(json.dumps(html.entities.html5)), "map<string,string>")


def _code_point(reference: Column) -> Column:
    """The character of ``&#…``; code points a page may not name become U+FFFD."""
    digits = F.regexp_extract(reference, r"([0-9a-fA-F]+);?\z", 1)
    hexadecimal = F.lower(F.substring(reference, 3, 1)) == "x"
    short = F.length(F.regexp_replace(digits, "^0+", "")) <= 7
    code = F.when(
        short,
        F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint"),
    )
    legal = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(legal, F.translate(char, *_WINDOWS)).otherwise(F.lit("\ufffd"))


def _windows() -> tuple[str, str]:
    """Numbers 0x80-0x9F mean the Windows-1252 character, as pages use them."""
    meant = {chr(c): bytes([c]).decode("cp1252", "ignore") for c in range(0x80, 0xA0)}
    return "".join(c for c in meant if meant[c]), "".join(meant.values())


_WINDOWS = _windows()


def html_unescape(text: Column, attribute: bool = False) -> Column:
    """Decode character references; text without ``&`` is returned as it is.

    In running text a name that only starts with a known one (``&notit``) is
    decoded as far as it goes; in an attribute it stays.
    """
    names = _names()
    pieces = F.regexp_extract_all(text, F.lit(rf"{_REFERENCE}|[^&]+|&"), F.lit(0))

    def named(piece: Column) -> Column:
        whole = F.try_element_at(names, F.substr(piece, F.lit(2), F.length(piece)))
        if attribute:
            return F.coalesce(whole, piece)
        prefix = F.regexp_extract(piece, rf"\A&({'|'.join(_LEGACY)})", 1)
        partial = F.concat(
            F.try_element_at(names, prefix),
            F.substr(piece, F.length(prefix) + 2, F.length(piece)),
        )
        return F.coalesce(whole, partial, piece)

    def decode(piece: Column, following: Column) -> Column:
        kept = F.lit(False)
        if attribute:
            kept = ~F.endswith(piece, F.lit(";")) & F.startswith(F.coalesce(following, F.lit("")), F.lit("="))
        return (
            F.when(F.startswith(piece, F.lit("&#")) & (F.length(piece) > 2), _code_point(piece))
            .when(F.startswith(piece, F.lit("&")) & (F.length(piece) > 1) & ~kept, named(piece))
            .otherwise(piece)
        )

    decoded = F.transform(pieces, lambda p, i: decode(p, F.get(pieces, i + 1)))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)
