"""The queries of this subpackage by name, and the SQL of those that SQL can express."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import LOWER, UPPER
from .fill_middle import op11_fill_in_middle
from .html import op1_html
from .language import op8_language
from .leaks import op9_leaks
from .lines import op3_lines
from .near import op6_near_duplicates
from .neighbours import op7_neighbours
from .packing import op10_packing
from .personal import op5_personal
from .prefix_trie import op12_prefix_trie
from .quality import op13_quality
from .secrets import op4_secrets
from .token_output import op2_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html, op2_token_output, op3_lines, op4_secrets, op5_personal, op6_near_duplicates, op7_neighbours, op8_language, op9_leaks, op10_packing,
                               op11_fill_in_middle, op12_prefix_trie, op13_quality)}

_BLANKS = "'[ \\t\\n\\x0B\\f\\r]+'"
_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"

ORACLE: dict[str, str] = {
    "op6_near_duplicates": f"""
with recursive w as (select doc_id, {_WORDS} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, x) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.x = e.a),
c as (select doc_id, min(x) as component_id from r group by doc_id)
select c.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, c.doc_id = c.component_id as kept from c left join n using (doc_id)""",
    "op9_leaks": f"""
with d as (select doc_id, {_WORDS} as ws from documents), i as (select item_id, {_WORDS} as ws from benchmark),
ii as (select item_id, len(ws) as m, least(5, len(ws)) as k, list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda j: array_to_string(ws[j:j + least(5, len(ws)) - 1], ' ')) as sh
       from i where len(ws) > 0),
dd as (select doc_id, k, len(ws) as n, list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' ')) as sh
       from d, (select distinct k from ii) where len(ws) >= k),
met as (select distinct x.doc_id, x.n, x.sh, x.p - y.j as o, y.item_id, y.m, y.k, y.ish
        from (select doc_id, k, n, sh, unnest(sh) as h, unnest(range(0, len(sh))) as p from dd) x
        join (select item_id, m, k, sh as ish, unnest(sh) as h, unnest(range(0, len(sh))) as j from ii) y on x.h = y.h and x.k = y.k),
win as (select distinct doc_id, item_id, greatest(0, least(o, n - m)) as start, k, sh[greatest(0, least(o, n - m)) + 1:greatest(0, least(o, n - m)) + least(m, n) - k + 1] as a, ish as b from met),
x as (select doc_id, item_id, start, len(a) as na, len(b) as nb,
      list_sum(list_transform(list_distinct(b), lambda h: least(len(list_filter(a, lambda z: z = h)), len(list_filter(b, lambda z: z = h))))) as c from win)
select doc_id, item_id, arg_max(start, (c / (na + nb - c), -start))::int as start, max(c / (na + nb - c)) as similarity
from x where 5 * c >= 4 * (na + nb - c) group by doc_id, item_id""",
    "op11_fill_in_middle": """
with u as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as us, sha256('7:' || doc_id) as h from documents),
c as (select *, len(us) as n, ('0x' || substr(h, 1, 8))::bigint % (len(us) + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (len(us) + 1) as b,
      t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') as plain, ('0x' || substr(h, 25, 8))::bigint % 100 < 50 as spm from u),
p as (select *, array_to_string(us[1:least(a, b)], '') as pre, array_to_string(us[least(a, b) + 1:greatest(a, b)], '') as mid, array_to_string(us[greatest(a, b) + 1:n], '') as suf from c)
select doc_id, n::bigint as n, case when plain then 'plain' when spm then 'spm' else 'psm' end as form,
  case when not plain then length(pre) end as prefix_chars, case when not plain then length(mid) end as middle_chars,
  sha256(case when plain then t when spm then '<S>' || suf || '<P>' || pre || '<M>' || mid else '<P>' || pre || '<S>' || suf || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256 from p""",
    "op12_prefix_trie": """
with t as (select conv_id, {'r': coalesce(role, ''), 'x': coalesce(text, '')} as m, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from conversations where conv_id is not null),
s as (select conv_id, list(m order by i) as ms from t group by conv_id),
h as (select conv_id, ms, xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, len(conv_id::varchar) + 1), lambda i: ord(substr(conv_id::varchar, i, 1))::bigint)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: z::bigint)), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 4 as h from s),
b as (select h.conv_id, list_concat(coalesce(f.ms[1:h.h], []), h.ms[h.h + 1:]) as ms from h left join s f on f.conv_id = h.conv_id - h.conv_id % 20),
e as (select conv_id, d, ms[1:d] as p, d = len(ms) as ends from (select *, unnest(range(0, len(ms) + 1)) as d from b)),
n as (select p, d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ids from e group by p, d),
c as (select n.*, coalesce(k.n, 0) as n_children, (n.n_convs - 1) * case when n.d = 0 then 0 else len(regexp_extract_all(n.p[n.d].x, '[^ \\t\\n\\x0B\\f\\r]+')) end as own
      from n left join (select p[1:d - 1] as p, count(*) as n from n where d > 0 group by 1) k on n.p = k.p),
u as (select p[1:k] as p, sum(own)::bigint as saved, count(*) filter (n_children = 0) as leaves from (select *, unnest(range(0, d + 1)) as k from c) group by 1)
select c.conv_id, c.d as depth, f.conv_id as parent_conv_id, c.n_convs, c.n_children, u.leaves as n_leaves, u.saved as saved_tokens, sha256(c.ids) as ends_sha256
from c join u on c.p = u.p left join n f on c.d > 0 and f.p = c.p[1:c.d - 1]""",
    "op13_quality": f"""
with t as (select doc_id, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, {_BLANKS}), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) as ls from t),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as p, array_to_string(ws[p:p + 2], ' ') as g from w),
r as (select doc_id, count(distinct q) as n from (select doc_id, unnest([p, p + 1, p + 2]) as q from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1) group by doc_id),
m as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}'))) as n_alpha,
  length(regexp_replace(t, '\\P{{L}}', '', 'g')) as n_letters, length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) as n_upper,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[ \\t\\n\\x0B\\f\\r]*[-*•·]'))) as n_bullets, len(list_filter(ls, lambda x: regexp_matches(x, '(…|\\.\\.\\.)[ \\t\\n\\x0B\\f\\r]*$'))) as n_ellipses
  from w left join r using (doc_id)),
f as (select *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 2 * word_chars < 5 * n_words, word_chars > 12 * n_words, 4 * n_alpha < 3 * n_words,
  10 * n_dup_lines > 3 * n_lines, 2 * n_upper > n_letters, 10 * n_bullets > 9 * n_lines, 10 * n_ellipses > 3 * n_lines] as fs from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fs[1] or fs[2] as base_failed,
  not list_bool_or(fs[1:6] || [fs[8]]) and fs[7]::int + fs[9]::int + fs[10]::int <= 1 as kept,
  list_sum(list_transform(range(1, 11), lambda i: fs[i]::bigint << (i - 1)))::bigint as bits from f"""}
