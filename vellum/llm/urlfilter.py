"""URL filters: host and path rules, and a weighted vocabulary counted with Aho-Corasick."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.shared import with_column_per_batch

#: One of these terms is enough.
STRICT = ("adult", "porn", "xxx", "casino", "viagra", "cialis", "phishing", "malware", "warez", "escort", "payday")
#: It takes several different ones of these.
SOFT = (
    "ads", "bet", "bets", "bonus", "buy", "cheap", "click", "deal", "deals", "discount", "farm", "free", "gambling",
    "jackpot", "loan", "loans", "lottery", "pill", "pills", "poker", "popup", "promo", "replica", "slots", "spam",
    "track", "tracker", "win", "winner",
)
#: Weight at which a URL is rejected; soft terms weigh 1.
LIMIT = 2
VOCABULARY = {**dict.fromkeys(SOFT, 1), **dict.fromkeys(STRICT, LIMIT)}

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ALNUM = frozenset("0123456789abcdefghijklmnopqrstuvwxyz")
_PARTS = re.compile(r"([^/?#]*)([^?#]*)")


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: str | None) -> tuple[str, str]:
    """Both are empty without ``://``; the host is in lower case."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    host, path = _PARTS.match(url, at + 3).groups()
    return host.translate(_LOWER), path


def matching_rule(host: str, path: str, rules: Mapping[str, Sequence[Rule]]) -> Rule | None:
    """Longest rule of the host or a domain above it whose path the URL's starts with."""
    best, at = None, 0
    while at >= 0:
        for rule in rules.get(host[at:], ()):
            if path.startswith(rule.path) and (best is None or len(rule.name) > len(best.name)):
                best = rule
        dot = host.find(".", at)
        at = dot + 1 if dot >= 0 else -1
    return best


def automaton(vocabulary: Mapping[str, int]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def terms_of(url: str, words: ahocorasick.Automaton) -> dict[str, int]:
    """Different terms that stand between characters other than ASCII letters and digits, with their weights."""
    text, out = url.translate(_LOWER), {}
    for last, (term, weight) in words.iter(text):
        first = last - len(term) + 1
        if (first == 0 or text[first - 1] not in _ALNUM) and (last + 1 == len(text) or text[last + 1] not in _ALNUM):
            out[term] = weight
    return out


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    vocabulary: Mapping[str, int] = VOCABULARY,
    limit: int = LIMIT,
    url_col: str = "url",
    label: str = "judged",
) -> DataFrame:
    """Input rows with a struct column: ``host``, ``path``, ``rule``, ``verdict``, ``terms``.

    The longest rule that fits decides; of equally long ones the first. Without
    a rule, a URL is blocked when the weights of its different terms reach the
    limit: one strict term, or several soft ones. ``terms`` lists them, sorted.

    A null URL and one without ``://`` has an empty host and path and fits no
    rule; a null URL is allowed. Rows are judged one by one. Rules and
    vocabulary are parameters that travel to every task. An input column of the
    struct's name is replaced; others may have any name.
    """
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    kind = pa.struct(
        [(n, pa.string()) for n in ("host", "path", "rule", "verdict")] + [("terms", pa.list_(pa.string()))]
    )

    def run(urls: list[str | None]) -> list:
        words = automaton(vocabulary)
        out = []
        for url in urls:
            host, path = host_and_path(url)
            rule = matching_rule(host, path, by_host)
            terms = terms_of(url, words) if url else {}
            verdict = rule.verdict if rule else "block" if sum(terms.values()) >= limit else "allow"
            name = rule.name if rule else None
            out.append({"host": host, "path": path, "rule": name, "verdict": verdict, "terms": sorted(terms)})
        return out

    sql = "struct<host: string, path: string, rule: string, verdict: string, terms: array<string>>"
    return with_column_per_batch(pages, url_col, label, sql, kind, run)
