"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations


def _remainders() -> list[int]:
    """The CRC-32 of each byte, by its polynomial."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in out]
    return out


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a string."""
    digit = "(instr('0123456789ABCDEF', substr(h, {}, 1)) - 1)"
    codes = (f"list_transform([hex(encode({text}))], lambda h: list_transform(range(1, length(h), 2),"
             f" lambda i: CAST(16 * {digit.format('i')} + {digit.format('i + 1')} AS BIGINT)))[1]")
    step = f"xor(c >> 8, CAST({_remainders()} AS BIGINT[])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {step}), 4294967295)"


WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


_UP = "list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))"
_STEP = "CASE WHEN e[1] = '1' THEN sha256(substr(e, 2) || a) ELSE sha256(a || substr(e, 2)) END"

OP12 = f"""
with recursive leaves as (
  select doc_id, lang, {_leaf('n_chars')} as leaf,
    CASE WHEN n_chars IS NOT NULL AND {crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} END as changed
  from documents),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from leaves),
levels as (
  select lang, 0 as k, list(leaf order by pos) as l from placed group by lang
  union all
  select lang, k + 1, {_UP} from levels where len(l) > 1),
subroots as (select lang, l[1] as subroot, row_number() over (order by encode(lang) nulls first) - 1 as pos from levels where len(l) = 1),
tops as (
  select 1000 as k, list(subroot order by pos) as l from subroots
  union all
  select k + 1, {_UP} from tops where len(l) > 1),
steps as (
  select p.doc_id, p.leaf, p.lang, p.pos, v.k, (p.pos >> v.k) & 1 as side, v.l[xor(p.pos >> v.k, 1) + 1] as other
  from placed p join levels v on v.lang is not distinct from p.lang where len(v.l) > 1
  union all
  select p.doc_id, p.leaf, p.lang, p.pos, v.k, (s.pos >> (v.k - 1000)) & 1, v.l[xor(s.pos >> (v.k - 1000), 1) + 1]
  from placed p join subroots s on s.lang is not distinct from p.lang, tops v where len(v.l) > 1),
paths as (
  select lang, pos, sha256(coalesce(string_agg(other, '' order by k), '')) as proof_sha256,
    list(side || coalesce(other, '') order by k) as path
  from steps group by all),
folded as (
  select p.doc_id, p.leaf, s.subroot, (select l[1] from tops where len(l) = 1) as root,
    coalesce(h.proof_sha256, sha256('')) as proof_sha256,
    list_reduce(list_prepend(coalesce(p.changed, p.leaf), coalesce(h.path, [])), lambda a, e: {_STEP}) as folded_root
  from placed p join subroots s on s.lang is not distinct from p.lang
  left join paths h on h.lang is not distinct from p.lang and h.pos = p.pos)
select *, folded_root = root as verified from folded
"""

_FEATURES = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

OP11 = f"""
with d as (select row_number() over () as row, doc_id, {WORDS} as w from documents),
f as (select row, unnest({_FEATURES}) as feature from d),
g as (select unnest({_FEATURES}) as feature from (select {WORDS} as w from benchmark)),
b as materialized (select feature, {crc32_sql('feature')} % 10000 as bucket from (select feature from f union select feature from g)),
s as (select bucket, count(*) as n from f join b using (feature) group by 1),
t as (select bucket, count(*) as n from g join b using (feature) group by 1),
gain as (
  select bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((select count(*) from f) + 10000))
    / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * ((select count(*) from g) + 10000)))) AS BIGINT) as gain
  from s full join t using (bucket)),
w as (
  select row, count(*) as n_features, CAST(floor(CAST(sum(gain) AS BIGINT) / count(*)) AS BIGINT) as weight
  from f join b using (feature) join gain using (bucket) group by 1),
h as (
  select row, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    CAST('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) as h
  from d left join w using (row)),
scored as (select *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) as score from h),
able as (select row, row_number() over (order by score desc, doc_id nulls last, n_features) as place, count(*) over () as able from scored where n_words >= 20)
select doc_id, n_features, weight, score, CASE WHEN place <= able * 25 // 100 THEN place END as rank from scored left join able using (row)
"""

ORACLES = {"op11_importance_resampling": OP11, "op12_merkle_manifest": OP12}
