"""The queries in DuckDB SQL."""

from __future__ import annotations

# Relations, as ``views`` has them.

PARTS = """parts as (select p_partkey, label_original, upper(label_original) as label, upper(replace(label_original, ' ', '')) as key from (
    select p_partkey, case when p_partkey % 7 = 0 then replace(p_brand || ' ' || p_name, ' ', '') else p_brand || ' ' || p_name end as label_original from part))"""

PREDICTIONS = """predictions as (select *, gt as rep,
    case p_partkey % 4 when 0 then replace(gt, ' ', '') when 1 then translate(gt, '0158B', 'OISB8') when 2 then substr(gt, 2) else gt end as pred,
    p_partkey % 17 = 0 as is_curved, p_partkey % 3 = 0 as seen, p_partkey % 5 <> 0 as detected
    from (select p_partkey, upper(p_brand || ' ' || p_name) as gt from part)),
serials as (select distinct gt as serial from predictions)"""

BOXES = """boxes as (select 'img_' || l_orderkey || '.jpg' as image, box_index,
    case when (l_partkey + l_linenumber) % 31 = 0 then ' ' when (l_partkey + l_linenumber) % 7 = 0 then replace(p_brand || ' ' || p_name, ' ', '') else p_brand || ' ' || p_name end as transcription,
    l_quantity * 8 as x0, box_index * 15.0::double as y0, l_quantity * 8 + (40 + l_suppkey % 50) as x1, box_index * 15.0::double + 20.0::double as y1,
    l_partkey % 17 = 0 as is_curved, l_returnflag = 'R' as difficult, (40 + l_suppkey % 50)::int as w, (l_linenumber * 3 - 2)::int as h,
    l_linenumber <> 7 as found, l_discount * 400 as dx, l_tax * 100 as dy, l_partkey
    from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as box_index from lineitem) join part on p_partkey = l_partkey),
predicted as (select image, box_index as pred_index, x0 + dx as x0, y0 + dy as y0, x1 + dx as x1, y1 + dy as y1 from boxes where found)"""

PAIRS = (
    BOXES
    + """,
crossings as (select g.image, g.box_index as gi, p.pred_index as pi,
    (least(g.x1, p.x1) - greatest(g.x0, p.x0)) * (least(g.y1, p.y1) - greatest(g.y0, p.y0)) as inter, (g.x1 - g.x0) * (g.y1 - g.y0) as ga, (p.x1 - p.x0) * (p.y1 - p.y0) as pa
    from boxes g join predicted p on g.image = p.image and least(g.x1, p.x1) > greatest(g.x0, p.x0) and least(g.y1, p.y1) > greatest(g.y0, p.y0)),
pairs as (select image, gi, pi, inter, inter / (ga + pa - inter) as iou, inter / pa as inside from crossings)"""
)


def greedy(source: str, keys: str = "image") -> str:
    """Greedy matching as a recursion over the ranked pairs of an image."""
    same = " and ".join(f"m.{k} = r.{k}" for k in keys.split(", "))
    return f"""ranked as (select {keys}, gi, pi, row_number() over (partition by {keys} order by iou desc, gi desc, pi desc) as r from {source}),
walk as (select {keys}, 1::bigint as r, [gi] as g, [pi] as p, gi as mg, pi as mp from ranked where r = 1
    union all select r.{keys.replace(', ', ', r.')}, r.r, case when ok then list_append(m.g, r.gi) else m.g end, case when ok then list_append(m.p, r.pi) else m.p end, case when ok then r.gi end, case when ok then r.pi end
    from walk m join ranked r on {same} and r.r = m.r + 1, lateral (select not list_contains(m.g, r.gi) and not list_contains(m.p, r.pi) as ok)),
matched as (select {keys}, mg as gi, mp as pi from walk where mg is not null)"""


TRUTH = """truth as (select image, box_index as gi, case when is_curved then 'curved' else 'plane' end as kind, x1 - x0 as width,
    least(len(list_filter(regexp_split_to_array(transcription, '\\s+'), lambda t: t <> '')), 3)::int as tokens from boxes)"""

LINES = """lines as (select image, label, is_curved from (select doc_id as image, unnest(string_split(text, chr(10))) as label, lang <> 'en' as is_curved from documents) where label <> '')"""

ASSIGNED = (
    LINES
    + """,
assigned as (select image, case when d < 12 then 'train' when d < 14 then 'val' else 'test' end as split
    from (select distinct image, ('0x' || right(md5(image::varchar), 1))::int as d from lines))"""
)


def distance(a: str, b: str) -> str:
    one = lambda x, y: f"case when greatest(length({x}), length({y})) = 0 then 0.0::double else levenshtein({x}, {y}) / greatest(length({x}), length({y}))::double end"
    u, v = f"upper({a})", f"upper({b})"
    return f"least({one(u, v)}, {one(f'''replace({u}, ' ', '')''', f'''replace({v}, ' ', '')''')})"


def near(source: str, column: str, k: int, where: str = "true") -> str:
    """The k nearest serials of each distinct text."""
    return f"""near as (select * from (select pred, serial, distance, 1 - distance as score, row_number() over (partition by pred order by distance, upper(serial), serial)::int as rank
    from (select pred, serial, {distance('pred', 'serial')} as distance from (select distinct {column} as pred from {source}), serials where {where})) where rank <= {k})"""


def hit(source: str, evidence: str = "true") -> str:
    return f"""hits as (select s.*, coalesce(a.first = upper(s.rep), false) and {evidence} as hit1, coalesce(list_contains(a.near, upper(s.rep)), false) and {evidence} as hit5
    from {source} s left join (select pred, list(upper(serial)) as near, max(upper(serial)) filter (rank = 1) as first from near group by pred) a on a.pred = s.pred)"""


BIN = "case when length({0}) between 1 and 2 then '1-2' when length({0}) between 3 and 4 then '3-4' when length({0}) between 5 and 8 then '5-8' when length({0}) between 9 and 14 then '9-14' when length({0}) between 15 and 40 then '15-40' end"
BUCKET = "least(len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda t: t <> '')), 3)::int"
SHARE = "round(avg(({0})::int::double), 9)"


def sliced(source: str, measures: str, slices: dict[str, str]) -> str:
    every = {"overall": "'all'", **slices}
    return " union all ".join(f"select '{k}' as slice, {v} as value, {measures} from {source} where {v} is not null group by {v}" if k != "overall" else f"select 'overall' as slice, 'all' as value, {measures} from {source}" for k, v in every.items())


KIND = "case when is_curved then 'curved' else 'plane' end"
SEEN = "case when seen then 'seen' else 'unseen' end"
TOKENS = f"'tok' || {BUCKET.format('gt')}"


def components(edges: str, nodes: str) -> str:
    """Components of edges (a, b) by lowering labels to a fixed point."""
    return f"""both_ways as (select a, b from ({edges}) union select b, a from ({edges})),
reach as (select a as node, a as seen from both_ways union select r.node, e.b from reach r join both_ways e on e.a = r.seen),
labelled as (select n.image, coalesce(least(min(r.seen), n.image), n.image) as component from ({nodes}) n left join reach r on r.node = n.image group by n.image)"""


def star(rule: str, limit: str = "n >= 2") -> str:
    return f"select first as a, image as b from (select image, label, min(image) over (partition by label) as first, count(*) over (partition by label) as n from (select distinct image, label from lines where {rule})) where {limit} and image <> first"


SIZES = (
    LINES
    + ", "
    + components(star("length(label) >= 80"), "select distinct image from lines")
    + """,
sizes as (select component, count(*) as size, count(c.image) as n_curved from labelled l left join (select distinct image from lines where is_curved) c on c.image = l.image group by component)"""
)

SPLIT = (
    SIZES
    + """,
totals as (select sum(size)::double as images, sum(n_curved)::double as curved from sizes),
ordered as (select *, row_number() over (order by (n_curved = 0)::int, case when n_curved > 0 then -n_curved else -size end, md5('42' || component)) as r from sizes),
steps as (select 0::bigint as r, null::bigint as component, null::varchar as split, 0::bigint as ct, 0::bigint as cv, 0::bigint as cs, 0::bigint as it, 0::bigint as iv, 0::bigint as "is"
    union all select o.r, o.component, s, ct + case when s = 'train' then o.n_curved else 0 end, cv + case when s = 'val' then o.n_curved else 0 end, cs + case when s = 'test' then o.n_curved else 0 end,
        it + case when s = 'train' then o.size else 0 end, iv + case when s = 'val' then o.size else 0 end, "is" + case when s = 'test' then o.size else 0 end
    from steps p join ordered o on o.r = p.r + 1, totals t, lateral (select case when o.n_curved > 0
        then case when ct - 0.8::double * curved <= cv - 0.1::double * curved and ct - 0.8::double * curved <= cs - 0.1::double * curved then 'train' when cv - 0.1::double * curved <= cs - 0.1::double * curved then 'val' else 'test' end
        else case when it - 0.8::double * images <= iv - 0.1::double * images and it - 0.8::double * images <= "is" - 0.1::double * images then 'train' when iv - 0.1::double * images <= "is" - 0.1::double * images then 'val' else 'test' end end as s)),
chosen as (select component, split from steps where r > 0),
placed as (select image, split from labelled join chosen using (component))"""
)

FOLDS = (
    SIZES
    + """,
ordered as (select component, n_curved, row_number() over (order by n_curved desc, component) as r from sizes where n_curved > 0),
steps as (select 0::bigint as r, null::bigint as component, null::int as fold, [0, 0, 0, 0, 0]::bigint[] as have
    union all select o.r, o.component, f, list_transform(have, lambda x, i: x + case when i = f + 1 then o.n_curved else 0 end)
    from steps p join ordered o on o.r = p.r + 1, lateral (select (list_position(have, list_min(have)) - 1)::int as f)),
folds as (select component, fold from steps where r > 0)"""
)

FRAGMENTS = (
    BOXES
    + """,
fragments as (select image, pred_index as frag_index, (x0 + x1) / 2 as cx, (y0 + y1) / 2 as cy, case when x1 - x0 >= y1 - y0 then 1.0::double else 0.0::double end as dx, case when x1 - x0 >= y1 - y0 then 0.0::double else 1.0::double end as dy,
    greatest(least(x1 - x0, y1 - y0), 1e-6::double) as height, greatest(x1 - x0, y1 - y0) as length, x0, y0 from predicted),
links as (select image, i, j from (select a.image, a.frag_index as i, b.frag_index as j, a.dx * b.dx + a.dy * b.dy as dot, case when a.length >= b.length then a.dx else b.dx end as ux, case when a.length >= b.length then a.dy else b.dy end as uy,
    b.cx - a.cx as vx, b.cy - a.cy as vy, (a.height + b.height) / 2 as mean, (a.length + b.length) / 2 as half from fragments a join fragments b on a.image = b.image and a.frag_index < b.frag_index)
    where dot >= cos(radians(20)) and abs(vx * uy - vy * ux) <= 0.7::double * mean and abs(vx * ux + vy * uy) - half <= 1.5::double * mean)"""
)

GROUPS = (
    FRAGMENTS
    + """,
both_ways as (select image, i as a, j as b from links union select image, j, i from links),
reach as (select image, a as node, a as seen from both_ways union select r.image, r.node, e.b from reach r join both_ways e on e.image = r.image and e.a = r.seen),
firsts as (select image, node, min(seen) as low from reach group by image, node),
grouped as (select f.*, coalesce(least(r.low, f.frag_index), f.frag_index) as g from fragments f left join firsts r on r.image = f.image and r.node = f.frag_index),
leads as (select *, first_value(dx) over w as ux, first_value(dy) over w as uy from grouped window w as (partition by image, g order by length desc, frag_index))
select image, g, string_agg(frag_index::varchar, ',' order by cx * ux + cy * uy, frag_index) as members from leads group by image, g"""
)

CHAINS = PREDICTIONS + ", chains as (select p_partkey as chain_id, list_filter(string_split(gt, ' '), lambda t: t <> '') as texts from predictions)"
SEGMENTS = CHAINS + ", segments as (select chain_id, i, j, upper(trim(array_to_string(texts[i + 1:j], ' '))) as text from (select *, unnest(range(i + 1, len(texts) + 1))::int as j from (select *, unnest(range(len(texts)))::int as i from chains)))"

RESPONSE = (
    PREDICTIONS
    + """,
spoilt as (select serial as rep, unnest(['0 perfect', '1 spaces dropped', '2 one character', '3 two characters']) as level, unnest([serial, replace(serial, ' ', ''),
    substr(serial, 1, k - 1) || '#' || substr(serial, k + 1), substr(substr(serial, 1, k - 1) || '#' || substr(serial, k + 1), 1, 1) || '#' || substr(substr(serial, 1, k - 1) || '#' || substr(serial, k + 1), 3)]) as pred
    from (select serial, length(serial) // 2 + 1 as k from serials)), """
    + near("spoilt", "pred", 5)
    + ", "
    + hit("spoilt")
)

SWEPT = (
    PAIRS
    + ", "
    + TRUTH
    + """,
combos as (select (row_number() over (order by iou_floor, shift) - 1)::int as combo, iou_floor, shift from (select unnest([0.3, 0.5, 0.7, 0.9])::double as iou_floor), (select unnest([0.0, 0.05])::double as shift)),
candidates as (select combo, image, gi, pi, iou from pairs, combos where iou - shift >= iou_floor), """
    + greedy("candidates", "combo, image")
    + """,
tp as (select combo, count(*) as tp, count(*) filter (kind = 'plane') as tpp, count(*) filter (kind = 'curved') as tpc from matched join truth using (image, gi) group by combo),
gt as (select count(*) as gt, count(*) filter (kind = 'plane') as gtp, count(*) filter (kind = 'curved') as gtc from truth),
rates as (select combo, iou_floor, shift, coalesce(tpp, 0) / gtp as plane_recall, coalesce(tpc, 0) / gtc as curved_recall, coalesce(tp, 0) / gt as recall, coalesce(tp, 0) / n_pred as precision, n_pred
    from combos left join tp using (combo), gt, (select count(*) as n_pred from predicted))"""
)

CONF = "conf as (select vec_id % 50 as g, list_transform(embedding, lambda x: abs(x::double)) as c from embeddings)"

# Outlines: of curved boxes the lower left quarter is cut out, so they are one or two rectangles.
SHAPES = (
    BOXES
    + """,
outlines as (select image, box_index as i, is_curved, x0, y0, x1, y1 from boxes),
moved as (select image, box_index as i, is_curved, x0 + dx as x0, y0 + dy as y0, x1 + dx as x1, y1 + dy as y1 from boxes where found),
gq as (select image, i, x0 as a, y0 as b, x1 as c, case when is_curved then (y0 + y1) / 2 else y1 end as d from outlines union all select image, i, (x0 + x1) / 2, (y0 + y1) / 2, x1, y1 from outlines where is_curved),
pq as (select image, i, x0 as a, y0 as b, x1 as c, case when is_curved then (y0 + y1) / 2 else y1 end as d from moved union all select image, i, (x0 + x1) / 2, (y0 + y1) / 2, x1, y1 from moved where is_curved),
crossings as (select g.image, g.i as gi, p.i as pi, sum((least(g.c, p.c) - greatest(g.a, p.a)) * (least(g.d, p.d) - greatest(g.b, p.b))) as inter
    from gq g join pq p on g.image = p.image and least(g.c, p.c) > greatest(g.a, p.a) and least(g.d, p.d) > greatest(g.b, p.b) group by all),
ga as (select image, i, sum((c - a) * (d - b)) as area from gq group by all),
pa as (select image, i, sum((c - a) * (d - b)) as area from pq group by all),
pairs as (select c.image, gi, pi, inter, round(inter / (g.area + p.area - inter), 9) as iou, round(inter / p.area, 9) as inside
    from crossings c join ga g on g.image = c.image and g.i = c.gi join pa p on p.image = c.image and p.i = c.pi)"""
)

CORNERS = """case when is_curved then [{'x': x0, 'y': y0}, {'x': x1, 'y': y0}, {'x': x1, 'y': y1}, {'x': (x0 + x1) / 2, 'y': y1}, {'x': (x0 + x1) / 2, 'y': (y0 + y1) / 2}, {'x': x0, 'y': (y0 + y1) / 2}]
    else [{'x': x0, 'y': y0}, {'x': x1, 'y': y0}, {'x': x1, 'y': y1}, {'x': x0, 'y': y1}] end"""

MIDDLES = f"""gc as (select *, list_avg(list_transform(c, lambda q: q.x)) as cx, list_avg(list_transform(c, lambda q: q.y)) as cy from (select image, i, {CORNERS} as c from outlines)),
axes as (select image, i, cos(angle) as ux, sin(angle) as uy from (select image, i, 0.5 * atan2(2 * list_sum(list_transform(c, lambda q: (q.x - cx) * (q.y - cy))),
    list_sum(list_transform(c, lambda q: (q.x - cx) * (q.x - cx))) - list_sum(list_transform(c, lambda q: (q.y - cy) * (q.y - cy)))) as angle from gc)),
pc as (select image, i, list_avg(list_transform(c, lambda q: q.x)) as cx, list_avg(list_transform(c, lambda q: q.y)) as cy from (select image, i, {CORNERS} as c from moved))"""

# What is read in the regions, and the boxes with their serials.
READINGS = f"""readings as (select image, box_index as pi, case when k % 11 <> 0 and k % 13 = 0 then reverse(t) else t end as text
    from (select image, box_index, l_partkey + box_index as k, upper(case when (l_partkey + box_index) % 5 = 0 then substr(transcription, 2) else transcription end) as t from boxes where found)),
items as (select image, box_index as gi, upper(transcription) as gt, upper(transcription) as rep, is_curved, l_partkey % 3 = 0 as seen from boxes),
serials as (select distinct rep as serial from items)"""


def cuts(margins: str) -> str:
    """The best cut of each chain by its segments' scores: best sums and last cuts by end, then back from the last end."""
    return f"""{SEGMENTS}, {near('segments', 'text', 1)},
scored as (select chain_id, margin, i, j, text, (score - case when j - i > 1 then margin else 0 end) * length(replace(text, ' ', '')) as worth from segments join near on pred = text, (select unnest({margins})::double as margin)),
ends as (select chain_id, margin, j, list(worth order by i) as w from scored group by all),
walk as (select chain_id, margin, 0 as j, [0.0::double] as best, [0] as cut from (select distinct chain_id, margin from scored)
    union all select e.chain_id, e.margin, e.j, list_append(best, r.g), list_append(cut, r.i::int) from walk v join ends e on e.chain_id = v.chain_id and e.margin = v.margin and e.j = v.j + 1,
    lateral (select list_reduce(list_transform(range(e.j), lambda i: {{'g': best[i + 1] + w[i + 1], 'i': i}}), lambda a, x: case when x.g >= a.g - 1e-9 then x else a end) as r)),
back as (select chain_id, margin, cut, j, cut[j + 1] as i from walk where len(cut) = j + 1 and not exists (select 1 from ends e where e.chain_id = walk.chain_id and e.j > walk.j)
    union all select chain_id, margin, cut, i, cut[i + 1] from back where i > 0),
parts as (select b.chain_id, b.margin, (row_number() over (partition by b.chain_id, b.margin order by b.i) - 1)::int as seg, b.i, b.j, s.text from back b join scored s using (chain_id, margin, i, j) where b.j > 0)"""


RECOGNISERS = PREDICTIONS + """,
recognisers as (select p_partkey, gt, rep, is_curved, seen, model, case model when 'small' then pred when 'medium' then case when p_partkey % 8 < 3 then pred else gt end else case when p_partkey % 16 = 1 then pred else gt end end as pred
    from predictions, (select unnest(['small', 'medium', 'large']) as model))"""

LOOK_ALIKES = "('8', 'B', '5', 'S', '0', 'O', '1', 'I', '2', 'Z')"


def ablation() -> str:
    rules = {"all": star("true"), "freq<=8": star("true", "n between 2 and 8"), "len>=40": star("length(label) >= 40"), "len>=80": star("length(label) >= 80")}
    parts = []
    for k, (name, edges) in enumerate(rules.items()):
        body = components(edges, "select distinct image from lines").replace("both_ways", f"both{k}").replace("reach", f"reach{k}").replace("labelled", f"labelled{k}")
        parts.append((body, f"select '{name}' as rule, count(*) as components, max(n) as largest from (select count(*) as n from labelled{k} group by component)"))
    return f"with recursive {LINES}, {', '.join(b for b, _ in parts)} {' union all '.join(q for _, q in parts)}"


METRIC_TOP = f"count(*) as n, round(avg(1 - case when greatest(length(pred), length(gt)) = 0 then 0.0::double else levenshtein(upper(pred), upper(gt)) / greatest(length(pred), length(gt))::double end), 9) as car, {SHARE.format('pred = gt')} as exact, {SHARE.format('hit1')} as top1, {SHARE.format('hit5')} as top5"
TOP5 = f"with {PREDICTIONS}, {near('predictions', 'pred', 5)}"
HITS = f"{TOP5}, {hit('predictions')}"
HITS_DETECTED = f"{TOP5}, {hit('predictions', 'detected')}"


def models() -> str:
    """Metrics by slice of each recogniser."""
    each = [sliced(f"(select * from hits where model = '{m}')", f"'{m}' as model, {METRIC_TOP}", {"kind": KIND, "seen": SEEN}) for m in ("small", "medium", "large")]
    return f"with {RECOGNISERS}, {near('recognisers', 'pred', 5)}, {hit('recognisers')} {' union all '.join(each)}"


def end_to_end() -> str:
    source = f"{PAIRS}, {READINGS}, {greedy('(select * from pairs where iou >= 0.5)')}, found as (select i.*, coalesce(r.text, '') as pred, m.pi is not null as detected from items i left join matched m using (image, gi) left join readings r on r.image = i.image and r.pi = m.pi)"
    top = f"count(*) as n, {SHARE.format('detected')} as det_recall, {SHARE.format('hit1')} as top1, {SHARE.format('hit5')} as top5, count(*) filter (not detected) as fail_detection, count(*) filter (detected and not hit5) as fail_recognition, count(*) filter (detected and hit5) as hits"
    return f"with recursive {source}, {near('found', 'pred', 5)}, {hit('found', 'detected')} {sliced('hits', top, {'kind': KIND, 'seen': SEEN, 'tokens': TOKENS, 'length': BIN.format('gt')})}"


def token_merge() -> str:
    source = f"""{PAIRS}, {READINGS}, held as (select p.image, p.gi, count(*) as n, upper(trim(string_agg(r.text, ' ' order by round(case when g.x1 - g.x0 >= g.y1 - g.y0 then (q.x0 + q.x1) / 2 else (q.y0 + q.y1) / 2 end, 9), p.pi))) as text
        from pairs p join predicted q on q.image = p.image and q.pred_index = p.pi join boxes g on g.image = p.image and g.box_index = p.gi join readings r on r.image = p.image and r.pi = p.pi where p.inside >= 0.5 group by p.image, p.gi),
found as (select i.*, coalesce(n, 0) as n, coalesce(text, '') as pred from items i left join held using (image, gi))"""
    top = f"count(*) as n, {SHARE.format('n > 0')} as coverage, round(avg(n::double), 9) as avg_fragments, {SHARE.format('hit1')} as top1, {SHARE.format('hit5')} as top5"
    return f"with {source}, {near('found', 'pred', 5)}, {hit('found', "s.pred <> ''")} {sliced('hits', top, {'kind': KIND, 'seen': SEEN, 'tokens': TOKENS, 'length': BIN.format('gt')})}"


def oracle_sql() -> dict[str, str]:
    return {
        "shape_pairs": f"with {SHAPES} select image, gi, pi, iou, inside from pairs where iou >= 0.5",
        "shape_metrics": f"""with recursive {SHAPES}, {TRUTH}, {greedy('(select * from pairs where iou >= 0.5)')}, h as (select kind, m.gi is not null as hit from truth t left join matched m on m.image = t.image and m.gi = t.gi),
            k as (select kind, count(*) as gt, count(*) filter (hit) as tp from h group by kind), a as (select 'all' as kind, count(*) as gt, count(*) filter (hit) as tp, (select count(*) from moved) as n from h)
            select kind, gt, tp, round(tp / gt, 9) as recall, null::double as precision, null::double as hmean, case when tp > 0 then 1.0::double else 0.0::double end as precision_matched from k
            union all select kind, gt, tp, round(tp / gt, 9), round(tp / n, 9), round(2 * (tp / n) * (tp / gt) / (tp / n + tp / gt), 9), null from a""",
        "shape_containment": f"""with {SHAPES}, {MIDDLES} select p.image, p.gi, string_agg(p.pi::varchar, ',' order by round(q.cx * u.ux + q.cy * u.uy, 9), p.pi) as pis
            from pairs p join axes u on u.image = p.image and u.i = p.gi join pc q on q.image = p.image and q.i = p.pi where p.inside >= 0.5 group by p.image, p.gi""",
        "crop_sizes": f"with {BOXES} select image, box_index::int as box_index, floor(x1 - x0)::int as w, floor(y1 - y0)::int as h from boxes",
        "end_to_end": end_to_end(),
        "token_merge": token_merge(),
        "model_comparison": models(),
        "top_confusions": f"""with {RECOGNISERS}, c as (select model, substr(gt, i, 1) as g, substr(pred, i, 1) as p from (select model, gt, pred, unnest(range(1, length(gt) + 1)) as i from recognisers where length(gt) = length(pred))),
            n as (select model, g as gt_char, p as pred_char, count(*) as n from c where g <> p and g in {LOOK_ALIKES} and p in {LOOK_ALIKES} group by all)
            select *, (row_number() over (partition by model order by n desc, gt_char, pred_char))::int as rank from n qualify rank <= 8""",
        "db_guided_merge": f"with recursive {cuts('[0.0]')} select chain_id, seg, i, j, text from parts",
        "margin_sweep": f"with recursive {cuts('[0.0, 0.02, 0.05, 0.1, 0.2, 0.5, 0.9]')} select margin, count(*) as parts, count(distinct chain_id) as chains from parts group by margin",
        "sweep_first": f"with recursive {SWEPT} select (row_number() over (order by rates.recall desc, combo))::int as rank, combo, round(rates.recall, 9) as recall from rates qualify rank <= 5",
        "label_scan_flatten": f"with {BOXES} select image, box_index::int as box_index, transcription, difficult, case when is_curved then 6 else 4 end as n_points, is_curved, round(x0, 9) as x0 from boxes",
        "detection_lines_round_trip": f"with {BOXES} select image, count(*) as boxes, sum(length(transcription))::bigint as chars, count(*) filter (difficult) as difficult from boxes group by image",
        "normalize_labels": f"with {PARTS} select p_partkey, label_original, label, key as space_key from parts",
        "space_key_clusters": f"with {PARTS} select key, string_agg(distinct label, '|' order by label) as spellings from parts group by key having count(distinct label) > 1",
        "canonical_spelling": f"with {PARTS}, f as (select label, key, count(*) as freq from parts group by all) select label, first_value(label) over (partition by key order by freq desc, label) as rep, freq from f",
        "serial_db_summary": f"with {PARTS}, f as (select label, key from parts group by all) select count(distinct key) as size, count(*) as raw_unique, (select count(*) from (select key from f group by key having count(*) > 1)) as merged_clusters from f",
        "charset": f"with {BOXES} select distinct char from (select unnest(string_split(upper(transcription), '')) as char from boxes) where char not in ('', ' ')",
        "dictionary_size": f"with {BOXES} select count(*) as chars, count(*) + 2 as out_channels from (select distinct char from (select unnest(string_split(upper(transcription), '')) as char from boxes) where char not in ('', ' '))",
        "char_histogram": f"with {BOXES} select char, count(*) as n from (select unnest(string_split(transcription, '')) as char from boxes) where char <> '' group by char",
        "common_chars": f"with {BOXES} select char, count(*) as n from (select unnest(string_split(transcription, '')) as char from boxes) where char <> '' group by char order by n desc, char limit 12",
        "serial_list": f"with {PREDICTIONS} select serial from serials",
        "length_histogram": f"with {BOXES} select length(transcription)::int as length, count(*) as n from boxes group by 1",
        "box_profile": f"""with {BOXES} select count(distinct image) as images, count(*) as boxes, round(count(*) / count(distinct image), 9) as boxes_per_image, count(distinct transcription) as unique_texts,
            count(*) filter (is_curved) as curved_boxes, count(distinct image) filter (is_curved) as curved_images, count(*) filter (contains(trim(transcription), ' ')) as multi_token, count(*) filter (transcription = '') as empty,
            round(avg(regexp_matches(transcription, '[0-9]')::int::double), 9) as digit_ratio, count(distinct transcription) filter (regexp_matches(transcription, '[a-z]')) as lowercase_texts, max(length(transcription))::int as max_length from boxes""",
        "reject_side_output": f"with {BOXES} select image, box_index::int as box, case when trim(transcription) = '' then 'empty transcription' else 'degenerate crop' end as reason from boxes where trim(transcription) = '' or least(w, h) < 2",
        "label_file_sizes": f"""with {BOXES}, m as (select *, trim(transcription) = '' as blank, least(w, h) < 2 as small from boxes)
            select 'det' as file, count(*) as rows, count(distinct image) as images from m where not blank union all select 'rec', count(*), count(distinct image) from m where not blank and not small
            union all select 'rejects', count(*), count(distinct image) from m where blank or small""",
        "token_spans": f"""with {PARTS}, t as (select p_partkey, string_split(label, ' ') as l from parts), u as (select p_partkey, l, unnest(range(1, len(l) + 1)) as i from t)
            select p_partkey, (row_number() over (partition by p_partkey order by i) - 1)::int as pos, l[i] as token, (length(array_to_string(l[1:i], ' ')) - length(l[i]))::int as start, length(array_to_string(l[1:i], ' '))::int as "end" from u where l[i] <> ''""",
        "token_bucket": f"with {PARTS} select {BUCKET.format('label')} as bucket, count(*) as n from parts group by 1",
        "length_bin": f"with {LINES}, {PARTS}, u as (select label from lines union all select label from parts) select {BIN.format('label')} as bin, count(*) as n from u group by 1",
        "crop_names": f"with {BOXES} select regexp_replace(image, '\\.[^.]*$', '') || '_' || lpad(box_index::varchar, 2, '0') || '.jpg' as crop, {KIND} as kind from boxes",
        "aspect_percentiles": f"""with {BOXES}, r as (select *, w / h as a from boxes where trim(transcription) <> '' and least(w, h) >= 2) select count(distinct image) as images, count(*) as boxes, count(*) filter (is_curved) as curved,
            count(*) filter (len(list_filter(string_split(transcription, ' '), lambda t: t <> '')) > 1) as multi_token, max(length(transcription))::int as max_length, round(avg(a), 9) as aspect_mean, round(quantile_cont(a, 0.05), 9) as aspect_p05,
            round(quantile_cont(a, 0.5), 9) as aspect_p50, round(quantile_cont(a, 0.95), 9) as aspect_p95, round(max(a), 9) as aspect_max from r""",
        "resolution_histogram": f"with {BOXES} select w || 'x' || h as resolution, count(*) as n from boxes group by 1",
        "asset_missing": "select distinct doc_id as k from documents where doc_id not in (select page_id from pages)",
        "asset_unlabeled": "select distinct doc_id as k from documents where doc_id not in (select doc_id from labels)",
        "asset_gate": """select *, missing = 0 and unlabeled = 0 and corrupt = 0 as passed from (select (select count(*) from pages where page_id not in (select doc_id from documents)) as missing, (select count(*) from documents where doc_id not in (select page_id from pages)) as unlabeled,
            (select count(*) from pages where html is null or html = '') as corrupt)""",
        "content_sha256": "select page_id, sha256(html) as sha256 from pages",
        "leak_edges": f"with {LINES} select distinct a, b from ({star('length(label) >= 80')})",
        "components": f"with recursive {LINES}, {components(star('length(label) >= 80'), 'select distinct image from lines')} select image, component from labelled",
        "component_ablation": ablation(),
        "greedy_split": f"with recursive {SPLIT} select component, split from chosen",
        "curved_folds": f"with recursive {FOLDS} select component, fold from folds",
        "kfold_mean_std": f"with recursive {FOLDS}, e as (select fold, avg(length(label)::double) as m from lines join labelled using (image) join folds using (component) where is_curved group by fold) select count(*) as folds, round(avg(m), 6) as mean, round(stddev(m), 6) as std from e",
        "split_stats": f"""with recursive {SPLIT} select split, count(distinct image) as images, count(*) as boxes, count(distinct image) filter (is_curved) as curved_images, count(*) filter (is_curved) as curved_boxes,
            count(distinct label) as unique_labels, count(*) filter (contains(trim(label), ' ')) as multi_token from lines join placed using (image) group by split""",
        "split_laws": f"""with recursive {SPLIT} select count(*) as images, count(distinct image) as distinct_images, (select count(*) from (select label from lines join placed using (image) where length(label) >= 80 group by label
            having count(*) filter (split = 'train') > 0 and count(*) filter (split = 'test') > 0)) as leaking from placed""",
        "seen_flags": f"with {ASSIGNED} select image, md5(label) as label, split, label in (select label from lines join assigned using (image) where split = 'train') as seen from lines join assigned using (image) where split <> 'train'",
        "leakage": f"""with {ASSIGNED}, f as (select label, label in (select label from lines join assigned using (image) where split = 'train') as seen from lines join assigned using (image) where split = 'test')
            select count(distinct label) as unique_test_labels, count(distinct label) filter (seen) as shared, count(distinct label) filter (seen and length(label) >= 5) as shared_identifying, count(distinct label) filter (not seen) as unseen,
            count(*) filter (seen) as crops_seen, count(*) filter (not seen) as crops_unseen from f""",
        "contamination": f"with {ASSIGNED} select split, count(*) filter (is_curved) as curved, count(*) filter (not is_curved) as plane from lines join assigned using (image) group by split",
        "serials_not_in_train": f"""with {PARTS}, f as (select label, key, count(*) as freq from parts group by all), r as (select label, first_value(label) over (partition by key order by freq desc, label) as rep from f)
            select distinct rep as serial from r where rep not in (select rep from parts join r using (label) where p_partkey % 10 < 7)""",
        "fuzzy_top5": f"{TOP5} select pred, serial, round(score, 9) as score, rank from near",
        "fuzzy_top1": f"with {PREDICTIONS}, {near('predictions', 'pred', 1)} select pred, serial, round(score, 9) as score from near",
        "topk_accuracy": f"{HITS} select coalesce({SHARE.format('hit1')}, 0) as top1, coalesce({SHARE.format('hit5')}, 0) as top5 from hits",
        "topk_by_slice": f"{HITS} {sliced('hits', METRIC_TOP, {'kind': KIND, 'seen': SEEN, 'tokens': TOKENS, 'length': BIN.format('gt')})}",
        "e2e_summary": f"{HITS_DETECTED} {sliced('hits', f'''count(*) as n, {SHARE.format('detected')} as det_recall, {SHARE.format('hit1')} as top1, {SHARE.format('hit5')} as top5''', {'kind': KIND, 'seen': SEEN})}",
        "failure_decomposition": f"{HITS_DETECTED} {sliced('hits', 'count(*) filter (not detected) as fail_detection, count(*) filter (detected and not hit5) as fail_recognition, count(*) filter (detected and hit5) as hits', {'kind': KIND})}",
        "car_exact": f"with {PREDICTIONS} select p_partkey, round(1 - levenshtein(pred, gt) / greatest(length(pred), length(gt))::double, 9) as car, pred = gt as exact from predictions",
        "response_curve": f"with {RESPONSE} select level, count(*) as n, {SHARE.format('hit1')} as top1, {SHARE.format('hit5')} as top5 from hits group by level",
        "leverage_by_length": f"{HITS} select {BIN.format('gt')} as length, round(avg(hit5::int::double) - avg((pred = gt)::int::double), 9) as leverage from hits group by 1",
        "neighbour_distance": f"with {PREDICTIONS}, {near('serials', 'serial', 1, 'pred <> serial')} select {BIN.format('pred')} as bin, count(*) as n, round(avg(distance), 9) as mean_distance, round(min(distance), 9) as min_distance from near group by 1",
        "open_set_threshold": f"with {PREDICTIONS}, {near('predictions', 'pred', 1)} select pred, case when score >= 0.95::double then serial end as serial, score < 0.95::double as unregistered from near",
        "confidence_tiebreak": f"{TOP5}, f as (select gt as serial, count(*) as freq from predictions group by gt) select pred, serial, freq from near join f using (serial) qualify row_number() over (partition by pred order by distance, freq desc, serial) = 1",
        "space_error_rate": f"with {PREDICTIONS}, w as (select replace(upper(pred), ' ', '') = replace(upper(gt), ' ', '') and pred <> gt as wrong from predictions) select count(*) as n, count(*) filter (wrong) as space_errors, {SHARE.format('wrong')} as rate from w",
        # Predictions of another length lack characters and have no substitutions.
        "confusion_matrix": f"""with {PREDICTIONS}, c as (select substr(gt, i, 1) as g, substr(pred, i, 1) as p from (select gt, pred, unnest(range(1, length(gt) + 1)) as i from predictions where length(gt) = length(pred)))
            select g as gt_char, p as pred_char, count(*) as n from c where g <> p and g in {LOOK_ALIKES} and p in {LOOK_ALIKES} group by all""",
        "overlap_counts": f"with {BOXES}, m as (select is_curved as c, {BUCKET.format('transcription')} > 1 as m, length(transcription) > 15 as l from boxes) select count(*) filter (c and m and l) as all_three, count(*) filter (c and m) as curved_multi, count(*) filter (m and l) as multi_long from m",
        "token_alone_or_inside": f"with {PARTS}, t as (select label, unnest(string_split(label, ' ')) as token from parts) select token, count(*) filter (label = token) as alone, count(*) filter (label <> token) as inside from t where token <> '' group by token",
        "iou_pairs": f"with {PAIRS} select image, gi, pi, round(iou, 9) as iou from pairs where iou >= 0.5",
        "greedy_match": f"with recursive {PAIRS}, {greedy('(select * from pairs where iou >= 0.5)')} select image, gi, pi from matched",
        "det_metrics": f"""with recursive {PAIRS}, {TRUTH}, {greedy('(select * from pairs where iou >= 0.5)')}, h as (select kind, m.gi is not null as hit from truth t left join matched m on m.image = t.image and m.gi = t.gi),
            k as (select kind, count(*) as gt, count(*) filter (hit) as tp from h group by kind), a as (select 'all' as kind, count(*) as gt, count(*) filter (hit) as tp, (select count(*) from predicted) as n from h)
            select kind, gt, tp, round(tp / gt, 9) as recall, null::double as precision, null::double as hmean from k union all select kind, gt, tp, round(tp / gt, 9), round(tp / n, 9), round(2 * (tp / n) * (tp / gt) / (tp / n + tp / gt), 9) from a""",
        "failure_taxonomy": f"""with recursive {PAIRS}, {TRUTH}, {greedy('(select * from pairs where iou >= 0.5)')}, o as (select image, gi, count(*) as n from pairs group by all)
            select case when n is null then 'missed' when n = 1 then 'partial' else 'split' end as failure, count(*) as n from truth t left join o using (image, gi) where not exists (select 1 from matched m where m.image = t.image and m.gi = t.gi) group by 1""",
        "recall_by_width": f"with recursive {PAIRS}, {TRUTH}, {greedy('(select * from pairs where iou >= 0.5)')} select floor(width / 10)::int as width_bin, tokens, count(*) as gt, round(avg((m.gi is not null)::int::double), 9) as recall from truth t left join matched m on m.image = t.image and m.gi = t.gi group by 1, 2",
        "contain_assign": f"""with {PAIRS} select p.image, p.gi, string_agg(p.pi::varchar, ',' order by case when g.x1 - g.x0 >= g.y1 - g.y0 then (q.x0 + q.x1) / 2 else (q.y0 + q.y1) / 2 end, p.pi) as pis
            from pairs p join predicted q on q.image = p.image and q.pred_index = p.pi join boxes g on g.image = p.image and g.box_index = p.gi where p.inside >= 0.5 group by p.image, p.gi""",
        "token_merge_summary": f"""with {PAIRS}, {TRUTH}, c as (select image, gi, count(*) as n from pairs where inside >= 0.5 group by all) select tokens, count(*) as boxes, round(avg((coalesce(n, 0) > 0)::int::double), 9) as coverage,
            round(avg(coalesce(n, 0)::double), 9) as avg_fragments from truth left join c using (image, gi) group by tokens""",
        "eval_targets": f"""with {ASSIGNED}, t as (select image from assigned where split = 'test'), c as (select distinct image from lines where is_curved), e as (select image from t union select image from c)
            select 'test' as set, count(*) as images from t union all select 'with_curved', count(*) from e union all select 'from_train', count(*) from (select image from e intersect select image from assigned where split = 'train')
            union all select 'not_in_test', count(*) from (select image from e except select image from t)""",
        "link_pairs": f"with {FRAGMENTS} select image, i, j from links",
        "flip_policy": f"""with {FRAGMENTS}, p as (select unnest(['none', 'classifier', 'confidence']) as policy) select policy, count(*) as fragments,
            count(*) filter (case policy when 'none' then false when 'classifier' then frag_index % 3 = 0 else y0 % 5 > x0 % 7 end) as flipped from fragments, p group by policy""",
        "link_sweep": f"""with {FRAGMENTS}, c as (select * from (select unnest(['none', 'classifier', 'confidence']) as policy), (select unnest([0.0, 0.3, 0.6, 1.0, 1.5, 2.0, 3.0])::double as gap)),
            s as (select policy, f.*, case when case policy when 'none' then false when 'classifier' then frag_index % 3 = 0 else y0 % 5 > x0 % 7 end then -1.0::double else 1.0::double end as sign from fragments f, (select distinct policy from c)),
            q as (select a.policy, (a.dx * b.dx + a.dy * b.dy) * a.sign * b.sign as dot, abs((b.cx - a.cx) * case when a.length >= b.length then a.dy else b.dy end - (b.cy - a.cy) * case when a.length >= b.length then a.dx else b.dx end) as across,
                abs((b.cx - a.cx) * case when a.length >= b.length then a.dx else b.dx end + (b.cy - a.cy) * case when a.length >= b.length then a.dy else b.dy end) - (a.length + b.length) / 2 as gap_now, (a.height + b.height) / 2 as mean
                from s a join s b on a.policy = b.policy and a.image = b.image and a.frag_index < b.frag_index)
            select c.policy, c.gap, count(q.mean) as links from c left join q on q.policy = c.policy and dot >= cos(radians(20)) and across <= 0.7::double * mean and gap_now <= c.gap * mean group by all""",
        "fragment_groups": f"with recursive {GROUPS}",
        "fragment_groups_kernel": f"with recursive {GROUPS}",
        "chain_segments": f"with {SEGMENTS} select chain_id, i, j, text from segments",
        "segment_scores": f"with {SEGMENTS}, {near('segments', 'text', 1)} select pred as text, serial, round(score, 9) as score from near",
        "ctc_collapse": "with e as (select user_id as crop, event_id * 7 % 4 as idx, lag(event_id * 7 % 4) over (partition by user_id order by event_id) as b from events) select crop, count(*) as kept from e where idx <> 0 and (b is null or b <> idx) group by crop",
        "mean_confidence_char": f"with {CONF} select g, round(coalesce(list_sum(flatten(list(c))) / nullif(len(flatten(list(c))), 0), 0), 6) as mean_confidence from conf group by g",
        "mean_confidence_fragment": f"with {CONF} select g, round(avg(coalesce(list_avg(c), 0)), 6) as mean_confidence from conf group by g",
        "param_grid": """select (row_number() over (order by thresh, box_thresh, unclip_ratio) - 1)::int as combo, thresh, box_thresh, unclip_ratio from (select unnest([0.2, 0.3])::double as thresh),
            (select unnest([0.5, 0.6])::double as box_thresh), (select unnest([1.5, 2.0, 3.0])::double as unclip_ratio)""",
        "sweep_metrics": f"""with recursive {SWEPT} select combo, iou_floor, shift, round(plane_recall, 9) as plane_recall, round(curved_recall, 9) as curved_recall, round(recall, 9) as recall, round(precision, 9) as precision,
            round(case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end, 9) as hmean, n_pred from rates""",
        "constrained_pick": f"with recursive {SWEPT} select combo, iou_floor, shift, round(plane_recall, 9) as plane_recall from rates where precision >= 0.3 order by rates.plane_recall desc, combo limit 1",
        "sensitivity": f"""{HITS_DETECTED}, s as (select avg(detected::int::double) as det, count(*) filter (hit5) / count(*) filter (detected) as cond from hits)
            select round(s.det, 9) as det, round(s.cond, 9) as cond, round((s.det + 0.1) * s.cond, 9) as more_det, round(s.det * (s.cond + 0.1), 9) as more_cond, round(s.det * 0.856, 9) as estimate from s""",
        "exact_requirement": f"{HITS}, s as (select avg(hit5::int::double) as t from hits) select round(case when 1 - t = 0 then 0.0 else (0.95 - t) / (1 - t) end, 9) as required_exact from s",
        "hash_sample": f"with {LINES} select image from (select distinct image from lines) order by md5('0' || image) limit 60",
        "archive_roundtrip": f"with {PREDICTIONS} select p_partkey::varchar as crop, gt, pred, coalesce(len(embedding), 0)::int as n_conf, coalesce(round(list_avg(list_transform(embedding, lambda x: abs(x::double))), 6), 0) as mean_confidence from predictions left join embeddings on vec_id = p_partkey",
    }
