"""Fuzzy retrieval of serials: the k nearest by normalised edit distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.checkpoints import Stored
from tagloom.functions.editdistance import Bags, Pairs
from tagloom.functions.text import without_spaces

SERIALS_IN_BLOCK = 4096
PREDICTIONS_IN_SLICE = 4096
FEW_PREDICTIONS = 256  # that are not dealt in smaller slices, as each slice takes up the block of serials anew
SLICES_A_PARTITION = 2  # at least, so that partitions are about as large
ROWS_AT_ONCE = 128


def _nearest(k: int, exclude_self: bool):
    """The k nearest serials of a block for each prediction of a slice.

    Bags of characters bound every pair's distance from below; the k least bounds are compared exactly, and then
    all pairs whose bound doesn't exceed the farthest of these.  Serials farther than a prediction's ``far`` don't count.
    """

    def kernel(preds: pa.Table, names: pa.Table) -> pa.Table:
        texts, serials = preds.column("pred").to_pylist(), names.column("serial").to_pylist()
        if not texts or not serials:
            return pa.table({"pred": pa.array([], pa.string()), "serial": pa.array([], pa.string()), "su": pa.array([], pa.string()), "distance": pa.array([], pa.float64())})
        upper = names.column("su").to_pylist()
        order = sorted(range(len(serials)), key=lambda i: (upper[i].encode(), serials[i].encode()))
        serials, upper, bare = ([col[i] for i in order] for col in (serials, upper, names.column("sn").to_pylist()))
        sides = [(preds.column("pu").to_pylist(), upper), (preds.column("pn").to_pylist(), bare)]
        bags, pairs = [(Bags(a), Bags(b)) for a, b in sides], [Pairs(a, b) for a, b in sides]
        place = {s: j for j, s in enumerate(serials)} if exclude_self else {}
        own = np.array([place.get(t, -1) for t in texts], np.int64)
        far = preds.column("far").to_numpy()

        def exact(row: np.ndarray, col: np.ndarray) -> np.ndarray:
            both = [p.distances(row, col) / np.maximum(np.maximum(p.lengths[row], p.size[col]), 1) for p in pairs]
            return np.where(own[row] == col, np.inf, np.minimum(*both))

        found = []
        most = min(k + exclude_self, len(serials))
        for at in range(0, len(texts), ROWS_AT_ONCE):
            rows = slice(at, min(at + ROWS_AT_ONCE, len(texts)))
            least = np.minimum(*(a.bounds(rows, b) / np.maximum(np.maximum(a.size[rows, None], b.size[None, :]), 1) for a, b in bags))
            open_ = np.flatnonzero(least.min(axis=1) <= far[rows])
            least, place_of = least[open_], open_ + at
            first = np.argpartition(least, most - 1, axis=1)[:, :most]
            near = exact(np.repeat(place_of, most), first.reshape(-1)).reshape(len(open_), most)
            worst = np.minimum(np.sort(near, axis=1)[:, min(k, most) - 1], far[place_of])
            row, col = np.nonzero(least <= worst[:, None])
            near = exact(place_of[row], col)
            by = np.lexsort((col, near, row))
            row, col, near = row[by], col[by], near[by]
            keep = (np.arange(len(row)) - np.searchsorted(row, row) < k) & np.isfinite(near) & (near <= far[place_of[row]])
            found.append((place_of[row[keep]], col[keep], near[keep]))
        row, col, near = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"pred": pa.array([texts[i] for i in row], pa.string()), "serial": pa.array([serials[j] for j in col], pa.string()), "su": pa.array([upper[j] for j in col], pa.string()), "distance": pa.array(near, pa.float64())})

    return kernel


def top_k(predictions: DataFrame, serials: DataFrame, k: int = 5, prediction: str = "pred", serial: str = "serial", exclude_self: bool = False, far: str | None = None) -> DataFrame:
    """(pred, serial, distance, score, rank) of the k nearest serials of each distinct prediction.

    With ``far``, a column of ``predictions``, no serial is given that is farther than the largest of a prediction's rows.

    The distance is the smaller of those of the upper-cased texts as they are and without spaces; ties go to the
    serial that comes first in upper case.  Both sides are made distinct and stored first.  Predictions are dealt
    in slices, the set of serials in blocks; each slice meets each block in one call of a kernel that keeps the
    block's k best and compares only pairs that their characters allow.  A closed set of serials is one block, or
    a few, so predictions are copied once or a few times.  Neither side is broadcast, a call's size is bounded,
    and k rows a block and prediction is all that is shuffled after it.
    """
    store = Stored(predictions.sparkSession, "retrieval")
    limit = F.lit(float("inf")) if far is None else F.max(far)
    preds = store.put(predictions.where(F.col(prediction).isNotNull()).groupBy(F.col(prediction).alias("pred")).agg(limit.alias("far")), "predictions")
    names = store.put(serials.select(F.col(serial).alias("serial")).where("serial is not null").distinct(), "serials")
    blocks = max(1, -(-names.count() // SERIALS_IN_BLOCK))
    parts = int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n = preds.count()
    slices = max(1, min(SLICES_A_PARTITION * parts, -(-n // FEW_PREDICTIONS)), -(-n // PREDICTIONS_IN_SLICE))
    preds = preds.withColumn("pu", F.upper("pred")).withColumn("pn", without_spaces(F.col("pu")))
    names = names.withColumn("su", F.upper("serial")).withColumn("sn", without_spaces(F.col("su")))
    preds = preds.withColumn("slice", F.pmod(F.xxhash64("pred"), F.lit(slices)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = names.withColumn("block", F.pmod(F.xxhash64("serial"), F.lit(blocks)).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    # An explicit number of partitions stays: the texts are few bytes and much work, and would be coalesced to one task.
    preds, names = (df.repartition(parts, "block", "slice") for df in (preds, names))
    near = preds.groupBy("block", "slice").cogroup(names.groupBy("block", "slice")).applyInArrow(_nearest(k, exclude_self), "pred string, serial string, su string, distance double")
    whole = Window.partitionBy("pred").orderBy("distance", "su", "serial")
    best = near.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    return best.select("pred", "serial", "distance", (1 - F.col("distance")).alias("score"), "rank")


def hits(items: DataFrame, best: DataFrame, k: int = 5, gate: str = "none", prediction: str = "pred", truth: str = "rep") -> DataFrame:
    """``items`` with hit1 and hit<k>: whether the true spelling is first, or among the k nearest.

    ``gate`` says what a hit needs besides: ``none``, ``nonempty`` (some text was read) or ``detected``.
    """
    if gate not in ("none", "nonempty", "detected"):
        raise ValueError(f"unknown gate {gate}")
    found = best.groupBy(F.col("pred").alias("_pred")).agg(F.collect_list(F.when(F.col("rank") <= k, F.upper("serial"))).alias("_near"), F.max(F.when(F.col("rank") == 1, F.upper("serial"))).alias("_first"))
    evidence = {"none": F.lit(True), "nonempty": F.col(prediction) != "", "detected": F.col("detected")}[gate] if gate != "detected" else F.col("detected")
    joined = items.join(found, F.col(prediction) == F.col("_pred"), "left")
    first = F.coalesce(F.col("_first") == F.upper(F.col(truth)), F.lit(False)) & evidence
    near = F.coalesce(F.array_contains("_near", F.upper(F.col(truth))), F.lit(False)) & evidence
    return joined.withColumn("hit1", first).withColumn(f"hit{k}", near).drop("_pred", "_near", "_first")


def top_k_accuracy(hit: Column) -> Column:
    """Share of hits; 0.0 over no rows."""
    return F.coalesce(F.avg(hit.cast("double")), F.lit(0.0))


def open_set(best: DataFrame, threshold: float) -> DataFrame:
    """The nearest serial of each prediction, null where even that scores less than ``threshold``."""
    return best.where("rank = 1").select("pred", F.when(F.col("score") >= threshold, F.col("serial")).alias("serial"), "score", (F.col("score") < threshold).alias("unregistered"))
