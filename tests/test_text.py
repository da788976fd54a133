import html
import random
import sqlite3

from pyspark.sql import functions as F

from vellum.functions import markup, payload, text


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_json_literal(spark):
    cases = {
        '"Hello \\u00e9 \\"q\\"\\nb"': 'Hello é "q"\nb',
        '"\\ud83d\\ude00"': "😀",
        '"x\\ud83dy"': "x\ufffdy",
        '"\\ude00"': "\ufffd",
        '"\\\\ud83d"': "\\ud83d",
        **{'"' + "\\\\" * n + '\\ud83d"': "\\" * n + "\ufffd" for n in (31, 32, 33, 34, 1000)},
        '"\\\\ud83d\\ude00"': "\\ud83d\ufffd",
        '"\\ude00\\ud83d"': "\ufffd\ufffd",
        '"\\ud83d\\ud83d\\ude00\\ude00x"': "\ufffd😀\ufffdx",
        '"' + "ab\\n" * 5000 + '\\ud83d"': "ab\n" * 5000 + "\ufffd",
        '"ab\tcd"': None,
        '"ab\\qcd"': None,
        '"ab","cd"': None,
        '"a"]["b"': None,
        '"open': None,
        '""': "",
        '"a\u2028b"': "a\u2028b",
    }
    assert column(spark, cases, text.json_literal) == list(cases.values())


def test_unicode_trim(spark):
    assert column(spark, ["\u00a0x y\u3000\t\u0085", " ", "", "a"], text.unicode_trim) == ["x y", "", "", "a"]


def test_time(spark):
    numbers = ["1.741964966535E12", "1.7E", "1.2.3", "1E400", "-1", "0", "253402300800000", "2.6E14", "9.3E15"]
    shown = column(spark, numbers, lambda c: text.rfc3339_millis(text.epoch_millis(c)))
    assert shown == ["2025-03-14T15:09:26Z", None, None, None, "1969-12-31T23:59:59Z", "1970-01-01T00:00:00Z", "10000-01-01T00:00:00Z", "10209-01-27T06:13:20Z", None]


def test_time_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        shown = column(spark, ["1.741964966535E12"], lambda c: text.rfc3339_millis(text.epoch_millis(c)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert shown == ["2025-03-14T15:09:26Z"]


def test_unescape_like_a_page(spark):
    texts = ["a &amp; b", "&lt;p&gt;", "&notit; &notin; &copy", "&#8364;&#x20AC;&#128;", "&#0;&#xD800;&#x110000;", "& &x; &;", "&#", "&#x;", "plain"]
    assert column(spark, texts, markup.html_unescape) == [html.unescape(t) for t in texts]
    attribute = column(spark, ["a?b=1&copy=2&lt;", "&copy;&notit;"], lambda c: markup.html_unescape(c, True))
    assert attribute == ["a?b=1&copy=2<", "©&notit;"]


TOKENS = {
    "ΟΔΟΣ ødegård łódź Đak ñandú ấ œuvre": "οδοσ ødegard łodz đak nandu ấ œuvre",
    "éclair e\u0301clair 1,000 a\u200db ไทย नमस्ते": "eclair eclair 1 000 a b ไทย नमस त",
    "Façade naïve Ǖber x² snake_case İstanbul ﬁ straße STRASSE": "facade naive ǖber x² snake case istanbul ﬁ straße strasse",
    "確認する テスト don't": "確認する テスト don t",
    "": "",
}


SCRIPTS = {
    "<script><!-- <script>a</script> b --></script><title>t</title>": "<!-- <script>a</script> b -->",
    "<script><!-- <script>a</script> b</script>c</script>": "<!-- <script>a</script> b",
    "<script><!-- <script>a</script><script>b</script> c</script>d": "<!-- <script>a</script><script>b</script> c",
    "<script><!-- <script>a --> b</script> c</script>": "<!-- <script>a --> b",
    "<script><!-- a</script><title>t</title>": "<!-- a",
    "<script><!--><script>a</script>b": "<!--><script>a",
    "<script><!---><script>a</script>b": "<!---><script>a",
    "<script><!-- - -- <script/>a</SCRIPT >b---></script>c": "<!-- - -- <script/>a</SCRIPT >b--->",
    "<script><!-- <scripts>a</script>b": "<!-- <scripts>a",
    "<script><!- <script>a</script>b": "<!- <script>a",
    "<script><!-- <script>a</script>": "<!-- <script>a</script>",
    "<script>x<!--y--><!--<script>z</script>--></script><script>w</script>": "x<!--y--><!--<script>z</script>-->|w",
    "<script>a < b </scripts> </script>": "a < b </scripts> ",
}


def test_script_inside_a_commented_script(spark):
    bodies = column(spark, SCRIPTS, lambda c: F.array_join(markup.scripts(markup.segments(c)), "|"))
    assert bodies == list(SCRIPTS.values())


def test_long_scripts_need_no_deep_stack(spark):
    many = 200_000
    pages = [f"<script><!--{'<script>a</script>' * many}--></script>", f"<script><!--{'-' * many}</script>", f"<script><!--{'<' * many}"]
    sizes = column(spark, pages, lambda c: F.length(F.get(markup.scripts(markup.segments(c)), 0)))
    assert sizes == [18 * many + 7, many + 4, many + 4]


TITLES = {
    "<svg><title>a<b>c</b></title></svg>": "a",
    "<svg viewBox='0 0'><g/><title>a &amp; 1 < 2<!-- c --></title></svg>": "a & 1 < 2",
    "<svg><title>a</title></svg><title>b<i>c</i></title>": "b<i>c</i>",
    "<svg/><title>b<i></title>": "b<i>",
    "<SVG><svg></svg><title>a<b></title></SVG>": "a",
    "</svg><svg></svg><title>b<i></title>": "b<i>",
    "<title>t<b></title><math><title>m<mi>x</mi></title></math>": "m",
    "<title>t<b></title><svg><path/></svg>": "t<b>",
    "<svg><title><b>c</b></title></svg>": "",
    "<svgs><title>b<i></title>": "b<i>",
    "<svg><path></svg>": "",
}


def test_title_of_a_drawing(spark):
    assert column(spark, TITLES, lambda c: markup.page_title(markup.segments(c))) == list(TITLES.values())


def test_tokens(spark):
    got = column(spark, TOKENS, lambda c: F.array_join(text.tokens(c), " "))
    assert got == list(TOKENS.values())
    assert [" ".join(text.query_tokens(t)) for t in TOKENS] == got


def fts_tokens(values):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x)")
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    db.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(values, 1)))
    words = {i: [] for i in range(1, len(values) + 1)}
    for term, doc, at in db.execute("select term, doc, offset from v order by doc, offset"):
        words[doc].append(term)
    return [" ".join(words[i]) for i in sorted(words)]


def test_tokens_like_a_full_text_index(spark):
    letters = "abzAZ09 _-.,'éÉñçøßσςΣĳǆДйŁłİıſ²½\u0301\u0308\u0327\u0345文字テｱא\u05b8ش\u200d\ue000"
    rand = random.Random(7)
    values = ["".join(rand.choice(letters) for _ in range(rand.randint(1, 30))) for _ in range(1500)]
    values = [v.replace("\u05b8", "") for v in values]
    got = column(spark, values, lambda c: F.array_join(text.tokens(c), " "))
    wrong = [(v, g, w) for v, g, w in zip(values, got, fts_tokens(values)) if g != w]
    assert not wrong, wrong[:3]
    assert [" ".join(text.query_tokens(v)) for v in values] == got


def test_link_tokens_share_positions(spark):
    rows = spark.sql("select array('https://a.b/c', 'http://d') as links")
    assert rows.select(text.link_tokens(F.col("links"))).first()[0] == ["https", "a", "b", "c", "http", "d"]


def test_snippet_pattern_equals_its_plain_form(spark):
    plain = r'(?d)\{"ty":"is","ibi":\d+,"s":(".+?[^\\]")\}'
    parts = ['{"ty":"is","ibi":1,"s":"', '"}', "\\", '"', "}", "a", "b\n", "\n", 'ab"}', "\u2028", "é"]
    rand = random.Random(3)
    rows = [("".join(rand.choice(parts) for _ in range(rand.randint(1, 25))),) for _ in range(20000)]
    df = spark.createDataFrame(rows, "t string")
    cut = F.get(payload._up_to_last(F.array("t"), '"}'), F.lit(0))
    same = df.select(
        F.regexp_extract_all("t", F.lit(plain), F.lit(1)).alias("a"),
        F.regexp_extract_all(cut, F.lit(payload.SNIPPET), F.lit(1)).alias("b"),
    )
    assert same.where("a <> b").count() == 0
    assert same.where("size(a) > 0").count() > 1000
