"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

LINE_DEDUP = """
with t as (select doc_id, md5(coalesce(text, '')) s, string_split(coalesce(text, ''), chr(10)) l from documents),
w as (select doc_id, s, i, array_to_string(l[i + 1:i + 3], chr(10)) k from (select *, unnest(range(len(l) - 2)) i from t where len(l) >= 3)),
d as (select distinct doc_id, s, i + j as line from (select *, row_number() over (partition by k order by doc_id, s, i) r from w), range(3) x(j) where r > 1),
g as (select doc_id, s, list(line) m, count(*) n, count(*) filter (gap) runs from (
    select *, coalesce(line > lag(line) over (partition by doc_id, s order by line) + 1, true) gap from d) group by all)
select t.doc_id, len(l)::bigint n_lines, coalesce(n, 0)::bigint n_removed, coalesce(runs, 0)::bigint n_runs,
    sha256(array_to_string(list_filter(l, lambda x, i: not coalesce(list_contains(m, i - 1), false)), chr(10))) kept_sha256
from t left join g using (doc_id, s)
"""

CHAT_FORMAT = """
with t as (select distinct conv_id, coalesce(turn, -1) turn, role, text from conversations where conv_id is not null),
c as (select conv_id, list({'turn': turn, 'role': role, 'text': text} order by turn, role nulls first, text nulls first) l, count(*) n from t group by conv_id),
m as (select conv_id from c where not exists (select 1 from c o where o.conv_id <> c.conv_id
    and ((o.n > c.n and o.l[1:c.n] = c.l) or (o.l = c.l and o.conv_id < c.conv_id)))),
r as (select conv_id, floor(turn / 256)::bigint piece, count(*) n_turns, string_agg('<|im_start|>' || coalesce(role, '') || chr(10)
    || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' order by turn, role nulls first, text nulls first) s
    from t semi join m using (conv_id) group by all)
select conv_id, piece, n_turns, length(s)::bigint n_chars, sha256(s) rendered_sha256 from r
"""

DECONTAMINATE = r"""
with b as (select distinct item_id::varchar item, list_filter(regexp_split_to_array(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') w from benchmark where text is not null),
v as (select distinct item, len(w[i + 1:i + 10]) n, array_to_string(w[i + 1:i + 10], ' ') k from (select *, unnest(range(greatest(len(w) - 9, 1))) i from b where len(w) > 0)),
d as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') w, row_number() over () r from documents),
p as (select d.r, d.w, z.n, unnest(range(greatest(len(d.w) - z.n + 1, 0))) i from d, (select distinct n from v) z),
h as (select p.r, p.i, v.n, v.item from p join v on v.n = p.n and v.k = array_to_string(p.w[p.i + 1:p.i + p.n], ' ')),
s as (select r, count(distinct i + j) n_hit from h, range(10) x(j) where j < n group by r),
q as (select r, count(*) n_items, string_agg(item, ',' order by item) t from (select distinct r, item from h) group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(t, '')) items_sha256, n_hit is not null contaminated
from d left join s using (r) left join q using (r)
"""


EMBEDDING_DEDUP = """
with recursive f as (select vec_id, embedding::double[] e from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, len(e) n, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) e from f),
l as (select a.vec_id a, b.vec_id b from u a join u b on a.vec_id <> b.vec_id and case when a.n = b.n then list_dot_product(a.e, b.e) >= 0.95 else false end),
r as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
c as (select a, min(b) m from r group by a), n as (select a, count(*) n from l group by a)
select vec_id, coalesce(n, 0)::bigint n_links, coalesce(least(m, vec_id), vec_id) component_id, vec_id = component_id kept
from embeddings left join c on c.a = vec_id left join n on n.a = vec_id
"""

MINHASH_DEDUP = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i + 1:i + 5], ' ') x from (select *, unnest(range(greatest(len(w) - 4, 1))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
m as (select a, min(b) m from r group by a)
select doc_id, coalesce(n, 0)::bigint n_shingles, coalesce(least(m, doc_id), doc_id) component_id, doc_id = component_id kept
from w left join n using (doc_id) left join m on m.a = doc_id
"""

SUFFIX_DEDUP = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
p as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) k from (select *, unnest(range(greatest(length(h) // 2 - 99, 0))) i from h)),
q as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) r from p) where r > 1),
g as (select doc_id, i, sum(gap::int) over (partition by doc_id order by i) g from (select *, coalesce(i > lag(i) over (partition by doc_id order by i) + 100, true) gap from q)),
s as (select doc_id, g, min(i) a, max(i) + 100 b from g group by doc_id, g),
t as (select doc_id, sum(b - a)::bigint removed, count(*) spans, list_prepend(0, list(b order by a)) a, list(a order by a) b from s group by doc_id),
k as (select h.doc_id, h, coalesce(removed, 0) removed, coalesce(spans, 0) spans, coalesce(a, [0]) a, list_append(coalesce(b, []), length(h) // 2) b from h left join t using (doc_id))
select doc_id, (length(h) // 2)::bigint n_bytes, removed::bigint n_removed, spans::bigint n_spans,
    sha256(unhex(array_to_string(list_transform(range(1, len(a) + 1), lambda j: substr(h, 2 * a[j] + 1, 2 * (b[j] - a[j]))), ''))) kept_sha256 from k
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": LINE_DEDUP,
        "op3_embedding_dedup": EMBEDDING_DEDUP,
        "op4_chat_format": CHAT_FORMAT,
        "op5_minhash_dedup": MINHASH_DEDUP,
        "op6_decontaminate": DECONTAMINATE,
        "op9_suffix_dedup": SUFFIX_DEDUP,
    }
