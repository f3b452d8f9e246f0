"""Polygons of any shape against areas known by construction or by sampling, and grouping by geometry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import geometry as G
from tagloom.operators import detection as D
from tagloom.operators import grouping


def box(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def spun(points, degrees, about=(0.0, 0.0)):
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    return ((np.array(points, float) - about) @ np.array([[c, s], [-s, c]]) + about).tolist()


ELL = [[0, 0], [6, 0], [6, 2], [2, 2], [2, 6], [0, 6]]
COMB = [[0, 0], [9, 0], [9, 5], [7, 5], [7, 1], [5, 1], [5, 5], [4, 5], [4, 1], [2, 1], [2, 5], [0, 5]]


def rows(spark, polygons, index):
    return spark.createDataFrame([("p", k, [[float(x), float(y)] for x, y in q]) for k, q in enumerate(polygons)], f"image string, {index} int, points array<array<double>>")


@pytest.mark.parametrize("degrees", [0, 17, 90, 203])
def test_common_areas(degrees):
    pairs = [(ELL, box(1, 1, 4, 4), 7.0), (ELL, [[6, 6], [0, 6], [0, 4], [4, 4], [4, 0], [6, 0]], 8.0), (COMB, box(0, 2, 9, 1), 5.0), (COMB, COMB, 29.0), (ELL, box(3, 3, 2, 2), 0.0), (box(0, 0, 4, 4), box(1, 1, 1, 1), 1.0)]
    for a, b, want in pairs:
        for p, q in ((a, b), (b, a), (a[::-1], b)):
            assert abs(G.overlap(np.array(spun(p, degrees)), np.array(spun(q, degrees))) - want) < 1e-9


def test_common_areas_of_random_shapes():
    """Stars around a point, many at once, against a grid of points."""
    rng = np.random.default_rng(3)
    star = lambda: [[float(r * np.cos(t) + x), float(r * np.sin(t) + y)] for x, y in [rng.uniform(-0.4, 0.4, 2)] for t, r in zip(np.arange(9) * 2 * np.pi / 9, rng.uniform(0.3, 1.2, 9), strict=True)]
    a, b = [star() for _ in range(12)], [star() for _ in range(12)]
    at = np.arange(13) * 9
    common, area, _ = G.overlaps((np.array(a).reshape(-1, 2), at), (np.array(b).reshape(-1, 2), at), most=60)
    g = np.linspace(-2, 2, 801)
    px, py = np.meshgrid(g, g)

    def inside(p):
        out = np.zeros(px.shape, bool)
        for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1], strict=True):
            cut = (y0 > py) != (y1 > py)
            out ^= cut & (px < (x1 - x0) * (py - y0) / (y1 - y0 + 1e-300) + x0)
        return out

    for k in range(12):
        assert abs(common[k] - (inside(a[k]) & inside(b[k])).mean() * 16.04) < 0.02 and abs(area[k] - abs(G.np_area(np.array(a[k])))) < 1e-9


def test_crossing_outlines():
    """Of a bow tie the loop that turns like the whole counts; degenerate outlines have no area."""
    tie = [[0, 0], [6, 6], [6, 0], [0, 4]]
    loops = G.simple_loops(np.array(tie, float))
    assert len(loops) == 1 and abs(G.overlap(np.array(tie), np.array(box(-9, -9, 99, 99))) - abs(G.np_area(loops[0]))) < 1e-9
    assert abs(abs(G.np_area(loops[0])) - 10.8) < 1e-9
    assert G.simple_loops(np.array(ELL))[0].tolist() == ELL
    assert G.overlap(np.array([[0, 0], [5, 5]]), np.array(ELL)) == G.overlap(np.array([[1, 1]] * 4), np.array(ELL)) == 0
    assert G.iou(np.array([[1, 1]] * 4), np.array([[1, 1]] * 4)) == 0


def test_rectangles_around_points():
    centre, u, length, height = G.min_area_rect(np.array(spun(box(2, 3, 50, 8), 30, (27, 7))))
    assert np.allclose(centre, (27, 7)) and abs(length - 50) < 1e-9 and abs(height - 8) < 1e-9 and abs(u[0] - np.cos(np.pi / 6)) < 1e-9


def test_axes_and_sizes(spark):
    df = rows(spark, [box(0, 0, 9, 2), box(0, 0, 2, 9), spun(box(0, 0, 20, 3), 25), [[0, 0], [7.9, 0], [7.9, 3.2], [0, 3.2]]], "box_index")
    ux, uy = G.principal_axis(F.col("points"))
    got = {r.box_index: r for r in df.select("box_index", ux.alias("x"), uy.alias("y"), G.crop_size(F.col("points")).alias("s")).collect()}
    assert got[0].x == 1 and abs(got[1].y - 1) < 1e-12 and abs(got[2].y - np.sin(np.radians(25))) < 1e-9
    assert (got[3].s.w, got[3].s.h) == (7, 3) and (got[1].s.w, got[1].s.h) == (2, 9)


def test_pairs_and_matches(spark):
    """Overlaps of outlines as joins: shares of both sides, and nothing where only the bounds meet."""
    truth, found = [ELL, box(20, 0, 10, 4), box(40, 0, 4, 4)], [box(3, 3, 2, 2), box(0, 0, 2, 6), box(21, 0, 10, 4), box(20, 0, 8, 4), [[40, 0], [44, 4], [44, 0], [40, 4]]]
    pairs = D.polygon_pairs(rows(spark, truth, "box_index"), rows(spark, found, "pred_index"))
    got = {(r.gi, r.pi): (round(r.inter, 9), round(r.inside, 9)) for r in pairs.collect()}
    assert got[0, 1] == (12.0, 1.0) and got[1, 2] == (36.0, 0.9) and got[1, 3] == (32.0, 1.0) and (0, 0) not in got and 0 < got[2, 4][0] <= 4
    matched = D.greedy_match(pairs).collect()
    assert {(r.gi, r.pi) for r in matched} >= {(0, 1), (1, 2)} and all(r.gi != 1 or r.pi == 2 for r in matched)
    assert D.polygon_pairs(rows(spark, [], "box_index"), rows(spark, found, "pred_index")).count() == 0


def test_upright_boxes_agree(spark):
    df = spark.range(60).select(F.lit("p").alias("image"), F.col("id").cast("int").alias("box_index"), (F.col("id") * 11 % 31).cast("double").alias("x0"), (F.col("id") * 13 % 29).cast("double").alias("y0"))
    df = df.withColumn("x1", F.col("x0") + 6 + F.col("box_index") % 5).withColumn("y1", F.col("y0") + 4)
    other = df.select("image", F.col("box_index").alias("pred_index"), *[(F.col(c) + 0.75).alias(c) for c in ("x0", "y0", "x1", "y1")])
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    points = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")).alias("points")
    key = lambda r: (r.gi, r.pi, round(r.inter, 9), round(r.iou, 9), round(r.inside, 9))
    assert sorted(map(key, D.box_pairs(df, other).collect())) == sorted(map(key, D.polygon_pairs(df.select("image", "box_index", points), other.select("image", "pred_index", points)).collect()))


def held(spark, truth, found):
    g, p = rows(spark, [truth], "gi"), rows(spark, found, "pi")
    out = D.containment(D.polygon_pairs(g, p, "gi", "pi"), g, p).collect()
    return out[0].pis if out else []


@pytest.mark.parametrize("degrees", [0, 35, 90])
def test_regions_inside(spark, degrees):
    """Regions inside a line come in the order of its axis, whatever way it lies."""
    line = spun(box(0, 0, 60, 8), degrees)
    assert held(spark, line, [spun(box(x, 1, 9, 6), degrees) for x in (44, 2, 23)]) == [1, 2, 0]
    assert held(spark, line, [spun(box(55, 1, 9, 6), degrees), spun(box(57, 1, 9, 6), degrees), spun(box(90, 1, 9, 6), degrees)]) == [0]


def test_groups_of_polygons():
    three = [box(0, 0, 30, 10), box(33, 1, 20, 10), box(58, 0, 30, 10)]
    assert grouping.group_kernel(three, 0.6) == [[0, 1, 2]] and grouping.group_kernel(three, 0.4) == [[0, 1], [2]] and grouping.group_kernel(three, 0.1) == [[0], [1], [2]]
    assert grouping.group_kernel(three[::-1], 0.6) == [[2, 1, 0]]
    assert grouping.group_kernel([spun(p, 60) for p in three], 0.6) == [[0, 1, 2]]
    assert grouping.group_kernel(three, 0.6, [True] * 3) == [[2, 1, 0]] and grouping.group_kernel(three, 9.0, [False, True, False]) == [[0, 2], [1]]
    assert grouping.group_kernel([box(0, 0, 30, 10), box(0, 8, 30, 10)], 9.0) == [[0], [1]] and grouping.group_kernel([], 1.0) == []


def test_folded_groups_agree_with_the_kernel(spark):
    rng = np.random.default_rng(8)
    boxes = [(f"i{k % 7}", k, float(rng.integers(0, 300)), float(rng.integers(0, 40)), float(rng.integers(5, 60)), float(rng.integers(4, 14))) for k in range(140)]
    df = spark.createDataFrame([(i, k, x, y, x + w, y + h, False) for i, k, x, y, w, h in boxes], "image string, frag_index int, x0 double, y0 double, x1 double, y1 double, flipped boolean")
    got = {}
    for r in grouping.groups(grouping.box_geometry(df), 0.5).collect():
        got.setdefault((r.image, r.g), []).append((r.pos, r.frag_index))
    want = {}
    for image in {b[0] for b in boxes}:
        own = [b for b in boxes if b[0] == image]
        for members in grouping.group_kernel([box(*b[2:]) for b in own], 0.5):
            names = [own[m][1] for m in members]
            want[image, min(names)] = list(enumerate(names))
    assert {k: sorted(v) for k, v in got.items()} == want and any(len(v) > 2 for v in want.values())


def test_groups_of_polygons_by_image(spark):
    row = [box(0, 0, 30, 10), box(35, 0, 30, 10), box(0, 40, 30, 10)]
    images = {"a": [spun(p, 25) for p in row], "b": [spun(p, 70) for p in row[::-1]], None: row[:1]}
    rows = [(k, 10 * n, [[float(x), float(y)] for x, y in p], n == 1) for k, ps in images.items() for n, p in enumerate(ps)]
    schema = "image string, frag_index int, points array<array<double>>, flipped boolean"
    out: dict = {}
    for r in grouping.group_fragments(spark.createDataFrame(rows[::-1], schema), 0.6).collect():
        out.setdefault(r.image, {}).setdefault(r.group_id, {})[r.pos] = r.frag_index // 10
    for k, ps in images.items():
        found = grouping.group_kernel(ps, 0.6, [n == 1 for n in range(len(ps))])
        assert [[g[p] for p in sorted(g)] for _, g in sorted(out[k].items())] == found
    assert grouping.group_fragments(spark.createDataFrame([], schema), 0.6).collect() == []
