"""Evaluation of grouped fragments against a plain walk over images, boxes and fragments."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.functions import geometry as G
from tagloom.operators import evaluation, grouping, matching, merge, regions
from tagloom.plans import catalogue
from tagloom.plans import views as V

from .conftest import DATA


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def distance(a, b):
    share = lambda x, y: edits(x, y) / max(len(x), len(y), 1)
    a, b = a.upper(), b.upper()
    return min(share(a, b), share(a.replace(" ", ""), b.replace(" ", "")))


def best_cut(texts, names, margin=0.0):
    """Of all ways to cut a chain the one worth most, the finest of equally good ones."""
    n, ways = len(texts), []
    score = {}
    for k in range(n):
        for places in combinations(range(1, n), k):
            ends = [0, *places, n]
            worth = 0.0
            for i, j in zip(ends, ends[1:]):
                text = " ".join(texts[i:j]).strip().upper()
                if text not in score:
                    score[text] = 1 - min(distance(text, s) for s in names)
                worth += (score[text] - (margin if j - i > 1 else 0)) * len(text.replace(" ", ""))
            ways.append((worth, ends))
    top = max(w for w, _ in ways)
    return [e for w, e in ways if w >= top - 1e-9]


@pytest.fixture(scope="module")
def world(spark):
    """Some images' boxes and fragments, as rows and as tables."""
    images = spark.createDataFrame([(f"img_{k}.jpg",) for k in range(1, 400)], "image string")
    boxes = V.with_corners(V.boxes(spark, DATA)).join(images, "image", "left_semi").cache()
    truth, pieces = V.truth(boxes).cache(), V.fragments(boxes).cache()
    return truth, pieces, truth.collect(), pieces.collect()


def brute_items(truth, pieces, policy, gap, regroup=None):
    out = {}
    for image in {t.image for t in truth}:
        own = sorted((p for p in pieces if p.image == image), key=lambda p: p.frag_index)
        flips = [{"none": False, "classifier": p.cls_flip, "confidence": p.score_bwd > p.score_fwd}[policy] for p in own]
        texts = [p.text_bwd if f else p.text_fwd for p, f in zip(own, flips, strict=True)]
        groups = grouping.group_kernel([p.points for p in own], gap, flips)
        if regroup:
            groups = [g[i:j] for g in groups for i, j in regroup([texts[k] for k in g])]
        hulls = [G.hull(np.concatenate([np.array(own[k].points) for k in g])) for g in groups]
        boxes = [t for t in truth if t.image == image]
        pairs = sorted(((round(G.iou(np.array(t.points), h), 9), t.gi, min(own[m].frag_index for m in groups[k]), k) for t in boxes for k, h in enumerate(hulls)), reverse=True)
        taken, match = set(), {}
        for iou, gi, _, k in pairs:
            if iou >= 0.5 and gi not in match and k not in taken:
                match[gi] = k
                taken.add(k)
        for t in boxes:
            out[image, t.gi] = (t.gi in match, " ".join(texts[m] for m in groups[match[t.gi]]).strip().upper() if t.gi in match else "")
    return out


@pytest.mark.parametrize(("policy", "gap"), [("none", 0.0), ("confidence", 1.5), ("classifier", 1.5)])
def test_grouped_items(spark, world, policy, gap):
    truth, pieces, boxes, fragments = world
    combos = spark.createDataFrame([(policy, gap), (policy, 0.3)], "policy string, gap double")
    f = grouping.with_reading(pieces, policy).crossJoin(combos)
    items = evaluation.grouped_items(truth, f, grouping.groups(grouping.box_geometry(f), F.col("gap"), ("policy", "gap")), combos)
    for g in (gap, 0.3):
        got = {(r.image, r.gi): (r.detected, r.pred) for r in items.where(F.col("gap") == g).collect()}
        assert got == brute_items(boxes, fragments, policy, g)


def test_guided_groups(spark, world):
    """Each chain is cut in one of the ways that are worth most; the evaluation matches the hulls of its parts."""
    truth, pieces, boxes, fragments = world
    names = sorted({t.rep for t in boxes})[::6]
    f = grouping.with_reading(pieces, "none")
    wide = grouping.groups(grouping.box_geometry(f), 1.5)
    cut = evaluation.guided_members(wide, f, spark.createDataFrame([(n,) for n in names], "serial string")).collect()
    text, parts = {(r.image, r.frag_index): r.text_fwd for r in fragments}, {}
    for r in cut:
        parts.setdefault((r.image, r.g), []).append((r.pos, r.frag_index))
    chains = {}
    for r in wide.collect():
        chains.setdefault((r.image, r.g), []).append((r.pos, r.frag_index))
    assert len(cut) == sum(map(len, chains.values()))
    several = 0
    for (image, _), members in chains.items():
        order = [k for _, k in sorted(members)]
        own = sorted((order.index(sorted(p)[0][1]), len(p)) for (i, _), p in parts.items() if i == image and sorted(p)[0][1] in order)
        ends = [0, *np.cumsum([n for _, n in own]).tolist()]
        good = best_cut([text[image, k] for k in order], names)
        several += len(order) > 1
        assert ends in good and len(ends) == max(map(len, good))
    assert several > 20


def test_registered_evaluations(spark):
    """Of the registered grids every combination and way has all true boxes, and the archive is the best one's."""
    n = V.boxes(spark, DATA).count()
    rows = catalogue.group_evaluation(spark, DATA).where("slice = 'overall'").collect()
    assert len(rows) == 6 and {r.n for r in rows} == {n}
    best = max(r.top5 for r in rows)
    assert {r.way for r in catalogue.merge_evaluation(spark, DATA).where("slice = 'overall'").collect()} == {"narrow", "wide", "guided"}
    archived = catalogue.group_archive(spark, DATA).collect()
    assert len(archived) == n and best >= sum(r.pred != "" and r.pred == r.gt for r in archived) / n


def test_whole_images(spark, world):
    """Whole images read at once give what the walk gives, for each combination, and no row is dealt again for it."""
    _, _, boxes, fragments = world
    own = spark.createDataFrame([(f"img_{k}.jpg",) for k in range(1, 400)], "image string")
    images = V.images(spark, DATA, ["classifier", "confidence", "none"]).join(own, "image", "left_semi")
    combos = [("none", 0.0), ("confidence", 1.5), ("classifier", 1.5), ("confidence", 0.3)]
    items = evaluation.read_groups(images, combos, ("rep",))
    assert items._jdf.queryExecution().executedPlan().toString().count("Exchange") == images._jdf.queryExecution().executedPlan().toString().count("Exchange")
    rows = items.collect()
    for k, (policy, gap) in enumerate(combos):
        got = [((r.image, r.gi), (r.detected, r.pred)) for r in rows if r.mask >> k & 1]
        assert len(got) == len(boxes) and dict(got) == brute_items(boxes, fragments, policy, gap)


def test_whole_images_guided(spark, world):
    """Cut chains are read as the groups that ``guided_members`` cuts."""
    truth, pieces, boxes, _ = world
    names = spark.createDataFrame([(n,) for n in sorted({t.rep for t in boxes})[::6]], "serial string")
    own = spark.createDataFrame([(f"img_{k}.jpg",) for k in range(1, 400)], "image string")
    images = V.images(spark, DATA, ["none"]).join(own, "image", "left_semi")
    chains = evaluation.chains(images, "none", 1.5)
    rows = evaluation.read_groups(images, [("none", 1.5)], (), evaluation.guided_cuts(chains, names)).collect()
    f = grouping.with_reading(pieces, "none").cache()
    cut = evaluation.guided_members(grouping.groups(grouping.box_geometry(f), 1.5), f, names).localCheckpoint()
    expected = {(r.image, r.gi): (r.detected, r.pred) for r in evaluation.grouped_items(truth, f, cut).collect()}
    assert {(r.image, r.gi): (r.detected, r.pred) for r in rows if r.mask & 2} == expected
    assert any(r.mask == 2 and r.detected for r in rows)


@pytest.mark.parametrize("margin", [0.0, 0.05])
def test_guided_cuts_compare_few(spark, monkeypatch, margin):
    """Cuts are those that all segments' scores give, though few joined segments are compared with the serials."""
    names = [f"Brand#{k} {a} {b}" for k in range(1, 9) for a, b in (("large", "ring"), ("hot", "bolt"), ("cold", "gizmo"))]
    whole = [[n.upper(), m.upper()[k % 2 :]] for k, n in enumerate(names) for m in names[k::5]]
    broken = [[n.upper()[:k], n.upper()[k:], *more] for k, n in enumerate(names, 3) for more in ([], [" "], ["gnir", n], [n.replace(" ", "")])]
    odd = [["", ""], [" ", names[0]], [names[0], ""], ["x", "y", "z"], [names[0]], ["Brand#1", "large", "ring", "Brand#2", "hot", "bolt"], [names[3], names[3]], ["ab" * 40, names[2]]]
    found = spark.createDataFrame([(k, 0, t) for k, t in enumerate(whole + broken + odd)], "key int, g int, texts array<string>")
    serials = spark.createDataFrame([(n,) for n in names], "serial string")
    chains = found.select(F.col("key").alias("chain_id"), "texts")
    scored = merge.segment_scores(merge.segments(chains), serials).localCheckpoint()
    expected = {}
    for r in merge.best_partition(scored, margin).where("i > 0").collect():
        expected.setdefault(r.chain_id, []).append(r.i)
    compared, top_k = [], merge.top_k

    def counted(rows, *args, **kwargs):
        compared.append(rows.select("text").distinct().count())
        return top_k(rows, *args, **kwargs)

    monkeypatch.setattr(merge, "top_k", counted)
    got = {r.key: list(r.ends) for r in evaluation.guided_cuts(found, serials, margin).collect()}
    assert got == {k: sorted(v) for k, v in expected.items()}
    assert {len(t) for k, t in enumerate(whole + broken + odd) if k not in got} > {1, 2}  # some chains stay whole
    assert sum(compared) < scored.select("text").distinct().count() * 0.75


def test_far_serials(spark):
    """With ``far`` the nearest serials are those among all that are near enough, for the largest of a text's limits."""
    names = spark.createDataFrame([(f"Brand#{k} {a} ring",) for k in range(40) for a in ("red", "new", "large")], "serial string")
    texts = [f"BRAND#{k}{a}RING"[k % 3 :] for k in range(0, 40, 3) for a in (" RED ", "OLD", " ")] + [""]
    preds = spark.createDataFrame([(t, far) for k, t in enumerate(texts) for far in (0.0, k % 7 / 10)], "pred string, far double")
    near = lambda df: {(r.pred, r.serial, r.distance, r["rank"]) for r in df.collect()}
    limit = {t: max(0.0, k % 7 / 10) for k, t in enumerate(texts)}
    expected = {r for r in near(matching.top_k(preds, names, 3)) if r[2] <= limit[r[0]]}
    assert near(matching.top_k(preds, names, 3, far="far")) == expected and expected


def test_spanned_areas():
    """The area of two boxes by their bounds and corners is that of their hull."""
    rng = np.random.default_rng(5)
    box = rng.integers(0, 12, (200, 4)).astype(float)
    fields = {"frag_index": list(range(200)), **{c: box[:, k].tolist() for k, c in enumerate(("x0", "y0", "x1", "y1"))}}
    rows = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))
    none = pa.StructArray.from_arrays([pa.array([], pa.float64())] * 5, names=["gi", "x0", "y0", "x1", "y1"])
    whole = regions.Images(pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), none), pa.ListArray.from_arrays(pa.array([0, 200], pa.int32()), rows))
    a, b = np.arange(0, 200, 2), np.arange(1, 200, 2)
    corners = lambda r: box[r][[0, 1, 2, 1, 2, 3, 0, 3]].reshape(4, 2)
    assert np.allclose(whole._spanned(a, b), [abs(G.np_area(G.hull(np.concatenate([corners(i), corners(j)])))) for i, j in zip(a, b)])
