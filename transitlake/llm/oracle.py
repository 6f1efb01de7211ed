"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _words(pattern: str, lower: bool) -> str:
    text = "coalesce(text, '')"
    return f"regexp_extract_all({f"translate({text}, '{UPPER}', '{LOWER}')" if lower else text}, '{pattern}')"


SQL: dict[str, str] = {
    "op1_decontaminate": f"""
with d as (select doc_id, {_words(_PLAIN, True)} as w from documents),
b as (select item_id, {_words(_PLAIN, True)} as w from benchmark where item_id is not null),
win as (select distinct item_id, least(10, len(w)) as k, w[i : i + least(10, len(w)) - 1] as win from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (select doc_id, k, i, w[i : i + k - 1] as win from (select doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) as i from d, (select distinct k from win))),
hit as (select doc_id, i, dw.k, item_id from dw join win on dw.win = win.win),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as items from hit group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join it using (doc_id)""",
    "op3_near_duplicates": f"""
with recursive d as (select doc_id, {_words(_SPACED, True)} as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pr as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
ln as (select a, b from pr join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) as (select doc_id, doc_id from d union select r.a, ln.b from r join ln on r.b = ln.a)
select d.doc_id, coalesce(n, 0) as n_shingles, m.c as component_id, d.doc_id = m.c as kept from d left join n using (doc_id) join (select a, min(b) as c from r group by a) m on m.a = d.doc_id""",
    "op6_chat": r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (select *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 as n from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(n) as bigint) as formatted_chars
from e group by conv_id""",
    "op10_repeats": f"""
with d as (select doc_id, {_words(_SPACED, False)} as w from documents),
wn as (select doc_id, i, array_to_string(w[i : i + 12], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) as i from d)),
ft as (select s, min(doc_id) as f from wn group by s),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from wn join ft using (s) where f < doc_id),
ps as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as x from d),
k as (select ps.doc_id, count(*) filter (gone.p is not null) as n_removed, string_agg(x, ' ' order by ps.p) filter (gone.p is null) as kept from ps left join gone on gone.doc_id = ps.doc_id and gone.p = ps.p group by ps.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)""",
    "op11_audit": r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select lang, source, i, unnest(w) as term from d),
k as (select lang, term from t group by lang, term having count(distinct i) >= 10),
v as (select lang, count(*) as v from k group by lang),
g as (select distinct lang, source from d),
c as (select g.lang, g.source, k.term, coalesce(n, 0) as n from g join k on g.lang = k.lang
  left join (select lang, source, term, count(*) as n from t group by all) x on x.lang = g.lang and x.source = g.source and x.term = k.term),
p as (select c.*, 1 + (1000000000 * cast(n + 2 as hugeint)) // (sum(n) over (partition by c.lang, source) + 2 * v.v) as p from c join v on c.lang = v.lang),
l as (select lang, term, 1 + (1000000000 * cast(n + 2 as hugeint)) // (sum(n) over (partition by lang) + 2 * v) as q
  from (select c.lang, term, v, sum(n) as n from c join v on c.lang = v.lang group by all)),
pr as (select g.lang, g.source, o.source as item from g join g o on g.lang = o.lang and g.source <> o.source),
pv as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (
  select pr.lang, pr.source, 'pair' as part, pr.item, cast(coalesce(value, 0) as bigint) as value from pr left join pv on pr.lang = pv.lang and pr.source = pv.source and pr.item = pv.item
  union all
  select p.lang, p.source, 'term', p.term, cast((p - q) * (p - q) // (p + q) as bigint) from p join l on p.lang = l.lang and p.term = l.term where n > 0 and p > q),
o as (select *, cast(row_number() over (partition by lang, source, part order by value desc, encode(item)) as integer) as rank from r)
select lang, source, part, item, value, rank from o where part = 'pair' or rank <= 10""",
    "op12_spelling": r"""
with recursive crc as (
  select list(list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7], lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by b) as table_
  from (select cast(unnest(range(256)) as bigint) as b)),
r as (
  select doc_id, w, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{C0}-\x{FF}]+')) as w from documents)
  where length(w) >= 6 group by all),
h as (
  select w, n, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || w)), '..'), lambda y: cast('0x' || y as bigint))),
    lambda x, y: xor(x >> 8, table_[(xor(x, y) & 255) + 1])), 4294967295) as h
  from r, crc),
s as (select case when h % 199 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from h),
v as (select word, cast(sum(n) as bigint) as n from s where length(word) >= 6 group by word having sum(n) >= 5),
cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
near as (
  select a.word, b.word as near, b.n as k from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from cut a join v b on a.rest = b.word
  union select b.word, a.word, a.n from cut a join v b on a.rest = b.word),
best as (select word, count(*) as n_near, max(k) as k, arg_min(near, (-k, encode(near))) as near from near group by word),
f as (
  select v.word, n, coalesce(n_near, 0) as n_near, case when k >= 5 * n then near end as form, case when k >= 5 * n then k end as form_n
  from v left join best on v.word = best.word),
up(word, here, depth) as (select word, word, 0 from f union all select up.word, f.form, depth + 1 from up join f on f.word = up.here where f.form is not null),
root as (select word, arg_max(here, depth) as root from up group by word)
select f.*, root from f join root on f.word = root.word""".replace("{UPPER}", UPPER).replace("{LOWER}", LOWER),
    #: Of pages with the one article and the few kinds of tags that the tables' pages have.
    "op13_extract": r"""
with inner_ as (select page_id, url, coalesce(regexp_extract(html, '<article>((?:.|\n)*?)(?:</article>|$)', 1), '') as h from pages),
b as (select page_id, url, generate_subscripts(x, 1) as i, unnest(x) as t from (select page_id, url, regexp_split_to_array(h, '</?(?:p|h1)>') as x from inner_)),
c as (
  select page_id, url, i, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(
    regexp_replace(regexp_replace(t, '<br>', ' ', 'g'), '</?b>', '', 'g'), '&quot;?', '"', 'g'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as t
  from b),
j as (select page_id, url, coalesce(string_agg(t, chr(10) order by i) filter (t <> ''), '') as text from c group by page_id, url)
select page_id, url, text, length(text) as n_chars from j""",
}
