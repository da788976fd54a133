"""URL filters against plain splitting, rule search and token counts."""

import random
import re

from vellum.llm import urlfilter
from vellum.llm.queries import RULES


def plain(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    tokens = set(re.findall("[0-9a-z]+", low))
    bad = bool(tokens & set(urlfilter.STRICT)) or len(tokens & set(urlfilter.SOFT)) >= 2
    return host, path, rule.name if rule else None, rule.verdict if rule else "block" if bad else "allow"


def urls():
    rng = random.Random(1)
    words = [*urlfilter.STRICT[:4], *urlfilter.SOFT[:8], "example", "blog", "é", "İ", "freedom", "xxxl", "WIN"]
    out = [None, "", "://", "http://", "http:/x", "a://b://c/d", "HTTP://WWW.EXAMPLE.COM/en/1", "http://example.com", "x://net/es/", "x://com/"]
    for _ in range(800):
        name = rng.choice(["-", ".", "", "_"]).join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        host = rng.choice(["", "www.", "m."]) + name + rng.choice([".example.com", ".net", ".org", "net", ".com:80"])
        out.append("https://" + host + rng.choice(["", "/", "/en/1", "/es/2?bet=win", "/fr/#x", "?q=/en/", "/EN/\nx"]))
    return out + ["http://a.org/" + "free" * 50_000, "http://dup.org/", "http://dup.org/"]


def test_against_plain_rules(spark):
    rows = list(enumerate(urls()))
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, judged string, host int")
    out = urlfilter.judge(pages, RULES)
    assert out.columns == ["page_id", "url", "host", "judged"]
    for r in out.collect():
        j = r["judged"]
        assert (j["host"], j["path"], j["rule"], j["verdict"]) == plain(r["url"]), r["url"]


def test_terms_need_borders():
    words = urlfilter.automaton(urlfilter.VOCABULARY)
    assert set(urlfilter.terms_of("http://cheap-pills.org/Free_freedom/xxxl", words)) == {"cheap", "pills", "free"}


def test_empty_table(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
