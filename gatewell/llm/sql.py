"""DuckDB SQL for those training-data queries that SQL can express: exact windows, exact set similarity, digests."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase


def _words(column: str, pattern: str) -> str:
    """The words of a text with A-Z in lower case; null has none."""
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{pattern}')"


DECONTAMINATION = f"""with d as (select doc_id, {_words('text', '[a-z0-9[:^ascii:]]+')} as w from documents),
 b as (select cast(item_id as varchar) as item, {_words('text', '[a-z0-9[:^ascii:]]+')} as w from benchmark),
 win as (select distinct item, w[k:k + 12] as v from (select item, w, unnest(range(1, greatest(len(w) - 11, 2))) as k from b where len(w) > 0)),
 sizes as (select distinct len(v) as n from win),
 met as (select doc_id, k, n, item from (select doc_id, n, k, w[k:k + n - 1] as v from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)) join win using (v)),
 hit as (select doc_id, count(distinct p) as n_hit from (select distinct doc_id, unnest(range(k, k + n)) as p from met) group by 1),
 named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from met) group by 1)
 select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
 from d left join hit using (doc_id) left join named using (doc_id)"""
#: pairs meet by their rarest shingles: of a set of n, n - 0.8 n + 1 hold one of any set that is similar enough
NEAR_DUPLICATES = f"""with recursive d as (select doc_id, {_words('text', '[^ \\t\\n\\x0B\\x0C\\r]+')} as w from documents),
 s as (select distinct doc_id, w[k:k + 1] as v from (select doc_id, w, unnest(range(1, greatest(len(w), 2))) as k from d where len(w) > 0)),
 n as (select doc_id, count(*) as n from s group by 1),
 ranked as (select s.doc_id, v, n, row_number() over (partition by s.doc_id order by c, v) as r from s join n using (doc_id) join (select v, count(*) as c from s group by 1) using (v)),
 head as (select doc_id, v, n from ranked where r <= n - (4 * n + 4) // 5 + 1),
 near as (select distinct x.doc_id as a, y.doc_id as b, x.n as na, y.n as nb from head x join head y on x.v = y.v and x.doc_id < y.doc_id and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
 edge as (select a, b from near join s x on x.doc_id = a join s y on y.doc_id = b and x.v = y.v group by a, b, na, nb having 100 * count(*) >= 80 * (na + nb - count(*))),
 ways as (select a, b from edge union all select b, a from edge),
 reach(a, b) as (select a, b from ways union select r.a, e.b from reach r join ways e on r.b = e.a),
 low as (select a, least(a, min(b)) as c from reach group by a)
 select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(c, d.doc_id) as component_id, coalesce(c, d.doc_id) = d.doc_id as kept from d left join n using (doc_id) left join low on a = d.doc_id"""
WARC = """with p as (select page_id, url, coalesce(html, '') as h, sha1(coalesce(html, '')) as s from pages), g as (select h, max(page_id) as f from p group by 1),
 x as (select p.*, f, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(s, i, 1)) - 1), 4, '0')), 'string_agg', '') as bits from p join g using (h))
 select cast(page_id as bigint) as page_id, url, cast(octet_length(encode(h)) as bigint) as payload_bytes,
 list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * cast(substr(bits, 5 * i + 1, 1) as int) + 8 * cast(substr(bits, 5 * i + 2, 1) as int) + 4 * cast(substr(bits, 5 * i + 3, 1) as int) + 2 * cast(substr(bits, 5 * i + 4, 1) as int) + cast(substr(bits, 5 * i + 5, 1) as int), 1)), 'string_agg', '') as payload_digest,
 case when f = page_id then 'response' else 'revisit' end as record_type, case when f <> page_id then cast(f as bigint) end as refers_to from x"""
