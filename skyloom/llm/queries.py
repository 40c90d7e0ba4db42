"""Registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import (
    alignment,
    chat,
    decontaminate,
    edit_prints,
    exact_dedup,
    merkle,
    minhash,
    packing,
    quality,
    sharding,
    token_counts,
    toxicity,
    url_filter,
)
from skyloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_size(table(spark, sf_dir, "documents"), shards=8)


def _strength(level: str) -> str:
    """Prior strength of a level's groups (k labelled, b bad) from their over-dispersion."""
    return f"""(
      select case when rho is null or rho = 0 then 1e4 else least(greatest(1 / rho - 1, 1e0), 1e4) end
      from (
        select (spread - free) / nullif(n - n2 / nullif(n, 0) - free, 0) as rho
        from (
          select sum(k * pow(b / cast(k as double) - m, 2)) / (any_value(m) * (1 - any_value(m))) as spread,
                 count(*) - 1 as free, cast(sum(k) as double) as n, sum(k * k) as n2
          from {level}, mean where k > 0
        ) a
      ) r
    )"""


OP2 = f"""
with urls as (
    select page_id, {LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} as host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
    from pages
),
known as (
    select regexp_replace(host, ':[0-9]*$', '') as host, l.bad from urls left join (
        select doc_id, max(case when quality = 0 or toxic = 1 then 1
                                when quality is not null or toxic is not null then 0 end) as bad
        from labels group by doc_id
    ) l on l.doc_id = page_id
),
hosts as (
    select host, array_to_string(string_split(host, '.')[-1 - labels:], '.') as domain,
           array_to_string(string_split(host, '.')[-labels:], '.') as suffix, count(bad) as k, coalesce(sum(bad), 0) as b
    from (select *, case when array_to_string(string_split(host, '.')[-2:], '.') in ({', '.join(map(repr, url_filter.TWO_LABELS))})
                         then 2 else 1 end as labels from known) n
    group by host, labels
),
domains as (select domain, any_value(suffix) as suffix, sum(k) as k, sum(b) as b from hosts group by domain),
suffixes as (select suffix, sum(k) as k, sum(b) as b from domains group by suffix),
mean as (select least(greatest((sum(b) + 0.5e0) / (sum(k) + 1), 1e-6), 1 - 1e-6) as m from suffixes),
strength as (select {_strength('suffixes')} as s, {_strength('domains')} as d, {_strength('hosts')} as h),
at_suffix as (select suffix, (s * m + b) / (s + k) as p from suffixes, mean, strength),
at_domain as (
    select domain, (d * p + b) / (d + k) as p from domains join at_suffix using (suffix), strength
),
at_host as (select host, k, h, (h * p + b) / (h + k) as rate from hosts join at_domain using (domain), strength),
rules as (
    select * from (values {', '.join(f"('{what}', '{rule}')" for what, rule in url_filter.RULES)}) r (what, rule)
),
judged as (
    select u.page_id, u.host, u.path, r.rule, r.what, a.rate, a.h, a.k
    from urls u join at_host a on a.host = regexp_replace(u.host, ':[0-9]*$', '')
    left join rules r on ends_with('.' || u.host, '.' || split_part(r.rule, '/', 1))
        and starts_with(u.path, substr(r.rule, length(split_part(r.rule, '/', 1)) + 1))
    qualify row_number() over (partition by u.page_id order by length(r.rule) desc nulls last) = 1
)
select page_id, host, path, rule, round(rate, 6) as rate, k as labelled,
       coalesce(what, case when rate - 1.645e0 * sqrt(rate * (1 - rate) / (h + k + 1)) > 0.5e0 then 'block' else 'allow' end)
         as verdict
from judged
"""


@query("op2_url_filter", OP2)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


OP6 = f"""
with norm as (select doc_id, sha256({LOWER.format('text')}) as text_sha256 from documents),
ranked as (
    select *, max(doc_id) over same as keep_id, count(*) over same as group_size,
           row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept
    from norm window same as (partition by text_sha256)
)
select doc_id, keep_id, group_size, kept, text_sha256 from ranked
"""


@query("op6_exact_dedup", OP6)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


OP8 = f"""
with items as (select cast(item_id as varchar) as item, {WORDS.format('text')} as w from benchmark),
windows as (
    select distinct item, w[s : s + least(12, len(w) - 1)] as win
    from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as s from items where len(w) > 0)
),
lengths as (select distinct len(win) as n from windows),
docs as (select doc_id, {WORDS.format('text')} as w from documents),
starts as (
    select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from docs, lengths where len(w) >= n
),
hits as (
    select doc_id, s, n, item from starts join windows on w[s : s + n - 1] = win and len(win) = n
),
words_hit as (
    select doc_id, count(distinct p) as n_hit
    from (select doc_id, unnest(range(s, s + n)) as p from (select distinct doc_id, s, n from hits)) group by 1
),
found as (
    select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as list
    from hits group by 1
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(list, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
from docs d left join words_hit using (doc_id) left join found using (doc_id)
"""


@query("op8_decontaminate", OP8)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_minhash")
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_copies(table(spark, sf_dir, "documents")).drop("t")


@query("op10_chat")
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_roles(table(spark, sf_dir, "conversations"))


@query("op11_fingerprints")
def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_prints.edit_prints(table(spark, sf_dir, "documents"))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"))


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten([[(ascii(c) >> i) & 1 for i in range(8)] for c in string_split({text}, '')])"
    step = "xor(c >> 1, 3988292384 * xor(c & 1, b))"
    return f"xor(list_reduce(list_transform({bits}, lambda b: cast(b as bigint)), lambda c, b: {step}, 4294967295), 4294967295)"


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else strlen(cast({value} as varchar)) || ':' || cast({value} as varchar) end"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


OP13 = f"""
with recursive leaves as (
    select row_number() over () as r, doc_id, lang, {_leaf('n_chars')} as leaf,
           {_leaf(f"(n_chars + case when {_crc32('cast(doc_id as varchar)')} % 7 = 0 then 1 else 0 end)")} as claimed
    from documents
),
placed as (
    select *, row_number() over (partition by lang order by doc_id nulls first, leaf, r) - 1 as i, count(*) over (partition by lang) as n
    from leaves
),
inside(lang, lvl, i, n, h) as (
    select lang, 0, i, n, leaf from placed
    union all
    select lang, lvl + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' order by i))
    from inside where n > 1 group by lang, lvl, i // 2
),
subroots as (
    select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n
    from inside where n = 1
),
above(lvl, i, n, h) as (
    select 0, i, n, subroot from subroots
    union all
    select lvl + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' order by i))
    from above where n > 1 group by lvl, i // 2
),
nodes as (
    select lang, false as top, lvl, i, n, h from inside union all select null, true, lvl, i, n, h from above
),
walk(r, lang, top, lvl, i, n, h, proof) as (
    select r, lang, false, 0, i, n, claimed, '' from placed
    union all
    select w.r, w.lang, w.top or w.n = 1, case when w.n = 1 then 0 else w.lvl + 1 end,
           case when w.n = 1 then s.i else w.i // 2 end, case when w.n = 1 then s.n else (w.n + 1) // 2 end,
           case when w.n = 1 then w.h when w.i % 2 = 1 then sha256(o.h || w.h) else sha256(w.h || coalesce(o.h, '')) end,
           w.proof || case when w.n = 1 then '' else coalesce(o.h, '') end
    from walk w
    left join nodes o on o.top = w.top and (w.top or o.lang is not distinct from w.lang) and o.lvl = w.lvl and o.i = xor(w.i, 1)
    left join subroots s on s.lang is not distinct from w.lang
    where not (w.top and w.n = 1)
)
select p.doc_id, p.leaf, s.subroot, t.h as root, sha256(w.proof) as proof_sha256, w.h as folded_root, w.h = t.h as verified
from walk w join placed p using (r) join subroots s on s.lang is not distinct from w.lang, above t
where w.top and w.n = 1 and t.n = 1
"""


@query("op13_merkle", OP13)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered_fields=merkle.tampering())
