"""Matching of true and predicted regions within an image, and detection metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.config import INSIDE_RATIO, IOU_THRESHOLD
from tagloom.functions import geometry as G
from tagloom.functions.text import hmean, safe_ratio


def _box(side: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{side}_{c}") for c in ("x0", "y0", "x1", "y1"))


def _sided(df: DataFrame, side: str, index: str) -> DataFrame:
    return df.select("image", F.col(index).alias(f"{side}i"), *[F.col(c).alias(f"{side}_{c}") for c in ("x0", "y0", "x1", "y1")])


def box_pairs(truth: DataFrame, predicted: DataFrame, truth_index: str = "box_index", pred_index: str = "pred_index") -> DataFrame:
    """(image, gi, pi, inter, iou, inside) of axis-aligned boxes that overlap, by an equi-join on the image.

    ``inside`` is the share of the predicted box that the true one covers.
    """
    pairs = _sided(truth, "g", truth_index).join(_sided(predicted, "p", pred_index), "image")
    g, p = _box("g"), _box("p")
    pairs = pairs.where((F.least(g[2], p[2]) > F.greatest(g[0], p[0])) & (F.least(g[3], p[3]) > F.greatest(g[1], p[1])))
    return pairs.select("image", "gi", "pi", G.box_intersection(g, p).alias("inter"), G.box_iou(g, p).alias("iou"), (G.box_intersection(g, p) / G.box_area(*p)).alias("inside"))


def polygon_pairs(truth: DataFrame, predicted: DataFrame, truth_index: str = "box_index", pred_index: str = "pred_index", extra: tuple[str, ...] = ()) -> DataFrame:
    """The same for polygons of any shape (column ``points``), by an Arrow kernel on pairs whose bounds overlap.

    ``extra`` names columns of ``predicted``, such as a sweep's parameters, that are kept.  A polygon without area
    overlaps nothing; one that crosses itself counts as its loops that turn like the whole.
    """
    keys = ["image", "gi", "pi", *extra]

    def side(df: DataFrame, name: str, index: str, *more: str) -> DataFrame:
        x0, y0, x1, y1 = G.bounds(F.col("points"))
        return df.select("image", *more, F.col(index).alias(f"{name}i"), F.col("points").alias(f"{name}p"), x0.alias(f"{name}_x0"), y0.alias(f"{name}_y0"), x1.alias(f"{name}_x1"), y1.alias(f"{name}_y1"))

    pairs = side(truth, "g", truth_index).join(side(predicted, "p", pred_index, *extra), "image")
    g, p = _box("g"), _box("p")
    pairs = pairs.where((F.least(g[2], p[2]) > F.greatest(g[0], p[0])) & (F.least(g[3], p[3]) > F.greatest(g[1], p[1])))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inter, ag, ap = G.overlaps(_corners(batch.column("gp")), _corners(batch.column("pp")))
            total = ag + ap - inter
            iou = np.divide(inter, total, out=np.zeros_like(inter), where=total > 0)
            inside = np.divide(inter, ap, out=np.zeros_like(inter), where=ap > 0)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(inter), pa.array(iou), pa.array(inside)], names=[*keys, "inter", "iou", "inside"])
            yield out.filter(pa.array(inter > 0))

    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keys)
    return pairs.select(*keys, "gp", "pp").mapInArrow(kernel, f"{kinds}, inter double, iou double, inside double")


def _corners(polygons: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The corners of all polygons end to end, and where each begins."""
    size = polygons.value_lengths().fill_null(0).to_numpy()
    flat = polygons.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    return flat, np.concatenate([[0], np.cumsum(size)])


def greedy_match(pairs: DataFrame, threshold: float = IOU_THRESHOLD, extra: tuple[str, ...] = ()) -> DataFrame:
    """(image, gi, pi, iou): pairs in descending order of (iou, gi, pi) are taken while both ends are free.

    A fold over each image's few candidate pairs inside the JVM; ``extra`` columns part the pairs further.
    """
    ranked = pairs.where(F.col("iou") >= threshold).groupBy("image", *extra).agg(F.sort_array(F.collect_list(F.struct("iou", "gi", "pi")), asc=False).alias("c"))
    kind = "array<struct<iou:double,gi:bigint,pi:bigint>>"
    ranked = ranked.withColumn("c", F.col("c").cast(kind))
    taken = F.expr(f"""aggregate(c, cast(array() as {kind}),
        (acc, x) -> if(exists(acc, y -> y.gi = x.gi or y.pi = x.pi), acc, concat(acc, array(x))))""")
    return ranked.select("image", *extra, F.inline(taken)).select("image", *extra, "gi", "pi", "iou")


def containment(pairs: DataFrame, truth: DataFrame, predicted: DataFrame, ratio: float = INSIDE_RATIO) -> DataFrame:
    """(image, gi, pis): predictions inside each true box, in reading order along the axis its corners spread on.

    A prediction may lie in several boxes.  ``truth`` has image, gi and points, ``predicted`` image, pi and points;
    a prediction stands where the mean of its corners is, and ties go to the smaller index.
    """
    ux, uy = G.principal_axis(F.col("points"))
    axis = truth.select("image", "gi", ux.alias("ux"), uy.alias("uy"))
    cx, cy = G.centre(F.col("points"))
    place = predicted.select("image", "pi", cx.alias("cx"), cy.alias("cy"))
    held = pairs.where(F.col("inside") >= ratio).select("image", "gi", "pi").join(axis, ["image", "gi"]).join(place, ["image", "pi"])
    along = F.round(F.col("cx") * F.col("ux") + F.col("cy") * F.col("uy"), 9)
    return held.groupBy("image", "gi").agg(F.transform(F.sort_array(F.collect_list(F.struct(along.alias("at"), "pi"))), lambda x: x["pi"]).alias("pis"))


def metrics(truth: DataFrame, matched: DataFrame, n_predicted: DataFrame) -> DataFrame:
    """Recall by kind and overall, precision and their harmonic mean overall, and by kind the precision of what matched.

    ``truth`` needs image, gi and kind; ratios with a zero denominator are 0.0.  A prediction has no kind but that of
    the box it matches, so by kind only matched ones count as predicted.
    """
    hit = truth.join(matched.select("image", "gi").withColumn("hit", F.lit(1)), ["image", "gi"], "left")
    kinds = hit.groupBy(F.coalesce("kind", F.lit("all")).alias("kind")).agg(F.count("*").alias("gt"), F.coalesce(F.sum("hit"), F.lit(0)).alias("tp"), F.count("hit").alias("matched"))
    total = hit.agg(F.count("*").alias("gt"), F.coalesce(F.sum("hit"), F.lit(0)).alias("tp")).select(F.lit("all").alias("kind"), "gt", "tp", F.lit(None).cast("long").alias("matched"))
    rows = kinds.unionByName(total).join(n_predicted.agg(F.count("*").alias("n_pred")))
    precision = F.when(F.col("kind") == "all", safe_ratio(F.col("tp"), F.col("n_pred")))
    recall = safe_ratio(F.col("tp"), F.col("gt"))
    own = F.when(F.col("kind") != "all", safe_ratio(F.col("tp"), F.col("matched")))
    return rows.select("kind", "gt", "tp", "n_pred", recall.alias("recall"), precision.alias("precision"), hmean(precision, recall).alias("hmean"), own.alias("precision_matched"))


def failure_taxonomy(truth: DataFrame, pairs: DataFrame, matched: DataFrame) -> DataFrame:
    """Unmatched true boxes as ``missed`` (nothing overlaps), ``partial`` (one prediction) or ``split`` (several)."""
    overlaps = pairs.groupBy("image", "gi").agg(F.count("*").alias("n"))
    lost = truth.join(matched, ["image", "gi"], "left_anti").join(overlaps, ["image", "gi"], "left")
    n = F.coalesce("n", F.lit(0))
    return lost.groupBy(F.when(n == 0, "missed").when(n == 1, "partial").otherwise("split").alias("failure")).agg(F.count("*").alias("n"))
