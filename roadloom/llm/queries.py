"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from roadloom.llm.jaccard_join import op7_jaccard_join
from roadloom.llm.line_dedup import op3_line_dedup
from roadloom.llm.mixing import op4_mixing
from roadloom.llm.packing import op5_packing
from roadloom.llm.quality_rules import LEAST_KEPT, LEAST_DOCUMENTS, LINE_SHARE, op2_quality_rules
from roadloom.llm.secret_scan import op1_secret_scan
from roadloom.llm.sharding import op10_sharding
from roadloom.llm.topk_search import op9_topk_search
from roadloom.llm.toxicity import op8_toxicity
from roadloom.llm.url_filter import LOWER, RULES, UPPER, op6_url_filter

QUERIES = {
    "op1_secret_scan": op1_secret_scan, "op2_quality_rules": op2_quality_rules, "op3_line_dedup": op3_line_dedup, "op4_mixing": op4_mixing, "op5_packing": op5_packing,
    "op6_url_filter": op6_url_filter, "op7_jaccard_join": op7_jaccard_join, "op8_toxicity": op8_toxicity, "op9_topk_search": op9_topk_search, "op10_sharding": op10_sharding,
}

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"

_QUALITY = rf"""with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as ls from documents),
win as (select r, i, array_to_string(ws[i:i + 7], ' ') as w from (select r, ws, unnest(range(1, len(ws) - 6)) as i from d where len(ws) >= 8)),
dup as (select r, i from (select r, i, count(*) over (partition by r, w) as c from win) where c > 1),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from dup) group by r),
lines as (select r, source, doc_id, text, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '{_SPACE}', ' ', 'g')) as l from (select r, source, doc_id, text, unnest(ls) as l from d)),
freq as (select source, l from (select source, l, count(distinct (doc_id, text)) as c from lines group by source, l) f
  where c > {LEAST_DOCUMENTS} and c > {LINE_SHARE} * (select count(distinct (doc_id, text)) from d where d.source is not distinct from f.source)),
gone as (select r, sum(length(l) - length(replace(l, ' ', '')) + 1) as n from lines where exists (select 1 from freq f where f.source is not distinct from lines.source and f.l = lines.l) group by r),
m as (select d.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(gone.n, 0)::bigint as words_removed from d left join rep using (r) left join gone using (r))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - words_removed >= {LEAST_KEPT} * n_words as kept from m"""

_RULES = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
_FITS = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for h, p, _ in _RULES]
_TRACKING = r"(?i)(^|&)(utm_[a-z]*|fbclid|gclid)=[^&]*"

#: The pages of the test tables have neither canonical links nor refresh redirects, so their classes are those of equal settled addresses.
_URLS = rf"""with u as (select page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
q as (select *, regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '{_TRACKING}', '', 'g'), '^&', '') as query from u),
a as (select *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_replace(path, '/index\.(html?|php)$', '/'), '/+$', '') || case when query <> '' then '?' || query else '' end as address,
  case {' '.join(f"when {f} then '{h}{p}'" for f, (h, p, _) in zip(_FITS, _RULES, strict=True))} end as rule, case {' '.join(f"when {f} then '{v}'" for f, (_, _, v) in zip(_FITS, _RULES, strict=True))} end as own from q),
b as (select page_id, host, path, rule, own, host <> '' and bool_or(coalesce(own = 'block', false)) over (partition by address) as blocked_alias from a)
select page_id, host, path, rule, coalesce(own, case when blocked_alias then 'block' else 'allow' end) as verdict, blocked_alias from b"""

_JACCARD = rf"""with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') as ws from documents),
s as (select distinct r, array_to_string(ws[i:i + 3], ' ') as g from (select r, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from d where len(ws) > 0)),
n as (select r, count(*) as n from s group by r),
pairs as (select a.r as a, b.r as b, count(*) as c from s a join s b on a.g = b.g and a.r < b.r group by 1, 2),
link as (select a, b from pairs join n x on x.r = a join n y on y.r = b where 100 * c >= 85 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach as (select r as a, r as b from d union select reach.a, edge.b from reach join edge on edge.a = reach.b)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, min(o.doc_id) as component_id from d left join n using (r) join reach on reach.a = d.r join d o on o.r = reach.b group by d.r, d.doc_id, n.n"""

_TOPK = """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20"""

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": _QUALITY, "op6_url_filter": _URLS, "op7_jaccard_join": _JACCARD, "op9_topk_search": _TOPK}
