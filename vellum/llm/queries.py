"""Registered queries of this package and the SQL that must agree with them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import (
    covertree,
    decontaminate,
    fim,
    langid,
    licenses,
    mixing,
    quality,
    runs,
    secrets,
    simhash,
    tokens,
    toxicity,
    urlfilter,
)
from vellum.llm.shared import fold, table
from vellum.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


@query()
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


CONTAMINATION_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from documents
), b as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from benchmark
), starts as (
  select item_id, w, least(13, len(w)) as m, unnest(range(1, len(w) - least(13, len(w)) + 2)) as s
  from b where len(w) > 0
), win as (
  select distinct item_id, m, array_to_string(w[s : s + m - 1], ' ') as t from starts
), sizes as (
  select distinct m from win
), places as (
  select r, w, m, unnest(range(1, len(w) - m + 2)) as s from d, sizes where len(w) >= m
), hits as (
  select distinct p.r, p.s, p.m, win.item_id
  from (select r, m, s, array_to_string(w[s : s + m - 1], ' ') as t from places) p join win using (m, t)
), cover as (
  select r, count(distinct k) as n_hit from (select r, unnest(range(s, s + m)) as k from hits) group by r
), found as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct r, item_id::varchar as item from hits where item_id is not null) group by r
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join cover using (r) left join found using (r)
"""


@query(CONTAMINATION_SQL)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


MIXING_SQL = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    (('0x' || md5(coalesce(doc_id::varchar, 'null') || ':mix')[1:13])::bigint + 0.5::double) / 4503599627370496::double
      as u
  from documents
), s as (
  select source, size as source_size, 2 * size as cap,
    [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from (select source, sum(size)::bigint as size from d group by source)
), whole as (
  select 1.5::double * sum(source_size)::double as budget, sum(weight) as weight from s
), level(i, level) as (
  select 0, budget / weight from whole
  union all
  select i + 1, (
    select (whole.budget - coalesce(sum(case when weight * level.level > cap then cap end), 0)::double)
      / sum(case when weight * level.level > cap then 0 else weight end)
    from s)
  from level, whole where i < 60
), t as (
  select s.*, least(weight * (select level from level order by i desc limit 1), cap::double) as target from s
), k as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from t
), m as (
  select *, target - whole * source_size as missing from k
), fits as (
  select m.source, m.missing, d.size, count(*) as n from d join m on d.source is not distinct from m.source
  where d.size > 0 and d.size <= m.missing group by all
), f as (
  select *, (missing - coalesce(sum(size * n) over (
      partition by source order by size desc rows between unbounded preceding and 1 preceding), 0))
    / sum(size * size * n) over (
      partition by source order by size desc rows between current row and unbounded following)::double as factor
  from fits
), c as (
  select source, min(size) filter (factor * size >= 1) as certain,
    arg_max(factor, size) filter (factor * size < 1) as factor
  from f group by source
), q as (
  select d.doc_id, d.size, m.source, m.source_size, m.target, m.whole, m.missing,
    case when d.size = 0 then 3 when d.size > m.missing then 2 when d.size >= c.certain then 0 else 1 end as class,
    case when d.size > 0 and d.size <= m.missing and (c.certain is null or d.size < c.certain)
      then (d.u / (1 - d.u)) / (c.factor * d.size / (1 - c.factor * d.size)) end as rank
  from d join m on d.source is not distinct from m.source left join c on d.source is not distinct from c.source
), r as (
  select *, coalesce(sum(size) over (
      partition by source order by class, rank, size, doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from q
)
select doc_id, size, source_size, target,
  (size * (whole + case when size > 0 and missing > 0 and before + size / 2 <= missing then 1 else 0 end))::bigint as taken
from r
"""


@query(MIXING_SQL)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)
    return mixed.drop("copies")


@query()
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "random")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


@query()
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 5) == 0
    model = langid.fit(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def _license_sql() -> str:
    base = [(label, phrase.split()) for label, phrase in licenses.BASE]
    keys = [*base, *((t.label, t.key_words) for t in licenses.TEMPLATES)]
    key_rows = ", ".join(f"({t}, {j}, '{w}')" for t, (_, words) in enumerate(keys) for j, w in enumerate(words))
    kinds = ", ".join(
        f"({t}, '{label}', {len(words)}, {0 if t < len(base) else licenses.TEMPLATES[t - len(base)].key_at})"
        for t, (label, words) in enumerate(keys)
    )
    notices = ", ".join(
        f"({t + len(base)}, {j}, '{w}')" for t, own in enumerate(licenses.TEMPLATES) for j, w in enumerate(own.words)
    )
    return rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w
  from documents
), tok as (
  select r, unnest(w) as word, unnest(range(len(w))) as p from d
), keys(t, j, word) as (
  values {key_rows}
), kinds(t, label, n, key_at) as (
  values {kinds}
), notice(t, j, word) as (
  values {notices}
), lengths as (
  select t, count(*) as m from notice group by t
), found as (
  select r, t, p - j as s from tok join keys using (word) join kinds using (t)
  group by r, t, p - j having count(*) = any_value(n)
), base as (
  select r, count(*) as n, min(s) as a, max(s) as b from found where t < {len(base)} group by r
), aligned as (
  select found.r, found.t, found.s, count(tok.word) / any_value(m)::double as coverage
  from found join kinds using (t) join lengths using (t) join notice using (t)
  left join tok on tok.r = found.r and tok.p = found.s - key_at + notice.j and tok.word = notice.word
  group by found.r, found.t, found.s
), good as (
  select * from aligned where coverage >= {licenses.COVERAGE}
), base_labels as (
  select r, string_agg(distinct label, ',' order by label) as x from found join kinds using (t) where t < {len(base)} group by r
), labels as (
  select r, string_agg(distinct label, ',' order by label) as x
  from (select r, t from found where t < {len(base)} union all select r, t from good) join kinds using (t) group by r
), best as (
  select r, max(coverage) as score from good group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(base.n, 0)::bigint as n_base, a::bigint as first_word,
  b::bigint as last_word, coalesce(base_labels.x, '') as base_labels, coalesce(labels.x, '') as labels,
  coalesce(score, 0)::double as score
from d left join base using (r) left join base_labels using (r) left join labels using (r) left join best using (r)
"""


@query(_license_sql())
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    first, base = F.col("places.first"), F.col("places.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("notices.label"))).alias("labels"),
        F.coalesce(F.array_max("notices.coverage"), F.lit(0.0)).alias("score"),
    )


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out)
    model = quality.fit(docs.where(~held_out), labels, "quality")
    return quality.score(docs, model, label="score").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


RULES = [
    urlfilter.Rule("com", "/", "allow"),
    urlfilter.Rule("example.com", "/en/", "block"),
    urlfilter.Rule("www.example.com", "/en/", "allow"),
    urlfilter.Rule("net", "/es/", "block"),
    urlfilter.Rule("net", "/fr/", "block"),
]

_STRICT = ", ".join(f"'{t}'" for t in urlfilter.STRICT)
_SOFT = ", ".join(f"'{t}'" for t in urlfilter.SOFT)

URL_SQL = rf"""
with u as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest,
    regexp_extract_all(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[0-9a-z]+') as terms,
    row_number() over () as r
  from pages
), h as (
  select *, regexp_extract(rest, '^[^/?#]*') as raw from u
), p as (
  select r, page_id, terms,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path
  from h
), rules(rule_host, rule_path, said) as (
  values {", ".join(f"('{x.host}', '{x.path}', '{x.verdict}')" for x in RULES)}
), fits as (
  select r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    arg_max(said, length(rule_host || rule_path)) as said
  from p join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by r
)
select page_id, host, path, rule, coalesce(said, case
  when list_has_any(terms, [{_STRICT}]) or len(list_distinct(list_filter(terms, lambda t: t in ({_SOFT})))) >= {urlfilter.LIMIT}
  then 'block' else 'allow' end) as verdict
from p left join fits using (r)
"""


@query(URL_SQL)
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return found.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 3) == 1
    labels = table(spark, sf_dir, "labels").where(~held_out)
    model = toxicity.fit(docs.where(~held_out), labels, "toxic", corpus=docs)
    return toxicity.score(docs, model, label="score").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query()
def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.95)


MIDDLE_SQL = r"""
with t as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as w,
    sha256('42:' || coalesce(doc_id::varchar, '')) as h
  from documents
), c as (
  select *, len(w) as n, ('0x' || h[1:8])::bigint % (len(w) + 1) as x, ('0x' || h[9:16])::bigint % (len(w) + 1) as y,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
      or ('0x' || h[17:24])::bigint % 100 >= 50 then 'plain'
    when ('0x' || h[25:32])::bigint % 100 < 80 then 'spm' else 'psm' end as form
  from t
), p as (
  select *, coalesce(array_to_string(w[1 : least(x, y)], ''), '') as prefix,
    coalesce(array_to_string(w[least(x, y) + 1 : greatest(x, y)], ''), '') as middle,
    coalesce(array_to_string(w[greatest(x, y) + 1 :], ''), '') as suffix
  from c
)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
  case when form <> 'plain' then length(middle) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""


@query(MIDDLE_SQL)
def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"), seed=42, rate=50, spm=80)
    return made.select(
        "doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


def repeated_tail(row_id: object, words: list[bytes]) -> list[bytes]:
    """The contract's words of a document: from some word on, every tenth document repeats a stretch of words."""
    h, n = zlib.crc32(str("" if row_id is None else row_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


@query()
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.scan(docs, least=6, powers=4, rewrite=repeated_tail)
    ranked = F.transform(
        "periodic.runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("from"), (-r["period"]).alias("by"))
    )
    listed = F.transform("periodic.runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_max(ranked)
    return found.select(
        "doc_id",
        F.size("periodic.runs").cast("long").alias("n_runs"),
        (-longest["from"]).alias("start"),
        longest["length"].alias("length"),
        (-longest["by"]).alias("period"),
        F.floor(1000 * longest["length"] / -longest["by"]).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("periodic.collapsed", 256).alias("collapsed_sha256"),
    )


@query()
def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = tokens.round_trip(docs, scratch_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
