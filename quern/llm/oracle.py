"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
with d as (
  select row_number() over () as uid, doc_id,
         coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents
), b as (
  select item_id, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), win as (
  select distinct item_id, array_to_string(w[i:i+7], ' ') as win, len(w[i:i+7]) as n
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) as i from b where len(w) > 0)
), sizes as (select distinct n from win
), pos as (
  select uid, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, sizes where len(w) >= n
), hit as (
  select uid, i, pos.n, item_id from pos join win on pos.n = win.n and array_to_string(w[i:i+pos.n-1], ' ') = win.win
), words as (
  select uid, count(distinct p) as n_hit from (select uid, unnest(generate_series(i, i + n - 1)) as p from hit) group by uid
), items as (
  select uid, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
  from hit group by uid
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join words using (uid) left join items using (uid)
"""

_HOST = _LOWER.format(r"regexp_extract(rest, '^([^/?#]*)', 1)")
OP10 = rf"""
with rules(rh, rp, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                 ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u as (
  select row_number() over () as uid, page_id,
         case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages
), p as (
  select uid, page_id, {_HOST} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u
), j as (
  select p.*, rh || rp as rule, v,
         row_number() over (partition by uid order by length(rh) + length(rp) desc nulls last, length(rh) desc nulls last) as k
  from p left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from j where k = 1
"""

# Every window of 400 bytes of every text, as hexadecimal digits, counted; those that occur twice cover what goes.
OP3 = """
with d as materialized (select row_number() over () as uid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select uid, i, md5(substr(h, 2 * i - 1, 800)) as m from (select uid, h, unnest(generate_series(1, length(h) // 2 - 399)) as i from d where length(h) >= 800)),
hit as (select uid, i from w semi join (select m from w group by m having count(*) > 1) using (m)),
edge as (select uid, i, case when i <= lag(i) over (partition by uid order by i) + 400 then 0 else 1 end as new from hit),
run as (select uid, i, sum(new) over (partition by uid order by i) as g from edge),
span as (select uid, min(i) as a, max(i) + 399 as z from run group by uid, g),
gap as (select uid, a, z, lag(z, 1, 0) over (partition by uid order by a) as p from span),
cut as (select uid, sum(z - a + 1) as n, count(*) as spans, max(z) as last, string_agg(substr(h, 2 * p + 1, 2 * (a - 1 - p)), '' order by a) as kept from gap join d using (uid) group by uid)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join cut using (uid)
"""

_BASE32 = "array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || substr(sha, 1 + 5 * (k // 4), 5))::int >> (15 - 5 * (k % 4))) & 31)::int]), '')"
_ESCAPED = r"""array_to_string(list_transform(string_split({0}, ''), lambda c: case when regexp_matches(c, '[A-Za-z0-9%/?&=+,):;@!$''(*~.\-_]') then c else regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') end), '')"""
OP5 = f"""
with p as materialized (select page_id, url, coalesce(html, '') as t, sha1(coalesce(html, '')) as sha, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else url end as rest from pages),
f as (select t, min(page_id) as first from p group by t having count(*) > 1 and min(page_id) is not null)
select page_id, cast(strlen(t) as bigint) as payload_bytes, {_BASE32} as payload_digest,
       case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from first then first end as refers_to,
       case when coalesce(url, '') = '' then '-' else
         {_ESCAPED.format("array_to_string(list_reverse(string_split(lower(regexp_extract(rest, '^([^/?#]*)', 1)), '.')), ',') || ')' || regexp_extract(rest, '^[^/?#]*([^#]*)', 1)")} end as urlkey,
       strftime(timestamp '2024-01-01' + to_seconds(coalesce(page_id, 0) % 1000000000), '%Y%m%d%H%M%S') as timestamp
from p left join f using (t)
"""

ORACLE = {"op2_decontamination": OP2, "op3_suffix_dedup": OP3, "op5_warc": OP5, "op10_url_filter": OP10}
