"""From regions to readings: what was read where a true box is, however the regions were found, matched or grouped.

``truth`` has image, gi, points and whatever columns are to be kept; ``readings`` image, pi, text and conf (an array
of character confidences).  Every true box is one row of the outcome, with ``detected``, ``pred`` and ``conf``; where
nothing was found, nothing was read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.config import IOU_THRESHOLD
from tagloom.functions.text import joined_text, mean_of_characters, normalize_text

from . import detection, grouping, merge, regions


def _read(joined: DataFrame, found: str) -> DataFrame:
    out = joined.withColumn("detected", F.col(found).isNotNull()).withColumn("pred", F.coalesce(normalize_text(F.col("text")), F.lit("")))
    out = out.withColumn("conf", F.coalesce("conf", F.array().cast("array<double>"))).withColumn("mean_confidence", mean_of_characters(F.array("conf")))
    return out.drop("text", found)


def matched_items(truth: DataFrame, matched: DataFrame, readings: DataFrame) -> DataFrame:
    """Each true box with the reading of the region it matches."""
    joined = truth.join(matched.select("image", "gi", "pi"), ["image", "gi"], "left").join(readings.select("image", "pi", "text", "conf"), ["image", "pi"], "left")
    return _read(joined, "pi")


def contained_items(truth: DataFrame, held: DataFrame, readings: DataFrame) -> DataFrame:
    """Each true box with the readings of the regions inside it (``held``: image, gi, pis), and how many there are."""
    rows = held.select("image", "gi", F.posexplode("pis").alias("pos", "pi")).join(readings.select("image", "pi", "text", "conf"), ["image", "pi"])
    parts = rows.groupBy("image", "gi").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "conf"))).alias("p"))
    parts = parts.select("image", "gi", F.size("p").alias("n"), joined_text(F.col("p.text")).alias("text"), F.flatten("p.conf").alias("conf"))
    return _read(truth.join(parts, ["image", "gi"], "left").withColumn("n_fragments", F.coalesce("n", F.lit(0))), "n")


def grouped_items(truth: DataFrame, fragments: DataFrame, members: DataFrame, combos: DataFrame | None = None) -> DataFrame:
    """Each true box with the joined reading of the group whose hull matches it, for each of ``combos``.

    ``fragments`` has image, frag_index, points, text and conf, ``members`` image, g, pos and frag_index; both also
    the columns of ``combos``, where there are any.  The truth has no part in the grouping.
    """
    extra = tuple(combos.columns) if combos is not None else ()
    hulls = grouping.group_hulls(members, fragments, extra)
    pairs = detection.polygon_pairs(truth, hulls, "gi", "g", extra).withColumn("iou", F.round("iou", 9))
    matched = detection.greedy_match(pairs, extra=extra).select("image", *extra, "gi", F.col("pi").alias("g"))
    texts = grouping.group_texts(members, fragments, extra)
    rows = truth if combos is None else truth.crossJoin(F.broadcast(combos))  # a grid of parameters
    joined = rows.join(matched, ["image", *extra, "gi"], "left").join(texts, ["image", *extra, "g"], "left")
    return _read(joined, "g")


def guided_members(members: DataFrame, fragments: DataFrame, serials: DataFrame, margin: float = 0.0) -> DataFrame:
    """Groups (image, g, pos, frag_index) re-cut where the serial set supports it best; ``members`` are wide candidates.

    A part keeps its members' order and is named after its smallest one.
    """
    texts = members.join(fragments.select("image", "frag_index", "text"), ["image", "frag_index"])
    chains = texts.groupBy("image", "g").agg(F.sort_array(F.collect_list(F.struct("pos", "frag_index", "text"))).alias("c"))
    chains = chains.select(F.struct("image", "g").alias("chain_id"), F.col("c.text").alias("texts"), F.col("c.frag_index").alias("names"))
    cuts = merge.best_partition(merge.segment_scores(merge.segments(chains), serials), margin)
    rows = cuts.join(chains.select("chain_id", "names"), "chain_id").withColumn("own", F.slice("names", F.col("i") + 1, F.col("j") - F.col("i")))
    return rows.select("chain_id.image", F.array_min("own").alias("g"), F.posexplode("own").alias("pos", "frag_index"))


def read_groups(images: DataFrame, combos: list[tuple[str, float]], keep: tuple[str, ...], cuts: DataFrame | None = None, conf: bool = False) -> DataFrame:
    """What ``grouped_items`` gives for axis-aligned boxes, all ``combos`` (policy, gap) in one pass over whole images.

    ``images`` has key, image, t (true boxes: gi, x0, y0, x1, y1 and the columns to ``keep``) and f (fragments:
    frag_index, x0, y0, x1, y1, text_fwd, text_bwd, a flip_<policy> for each policy and, for ``conf``, conf_fwd and
    conf_bwd).  The outcome is (image, gi, keep..., mask, detected, pred): combinations that read the same fragments
    the same way share a row, and bit k of ``mask`` is set for the k-th one.  With ``cuts`` (key, g, ends) the groups
    of the last combination are cut at these places in their order, and that is one more combination.
    """
    kinds = images.schema["t"].dataType.elementType
    named = {"image": images.schema["image"].dataType, **{c: kinds[c].dataType for c in ("gi", *keep)}}
    rows, guided = images, cuts is not None
    if guided:
        rows = images.join(cuts.groupBy("key").agg(F.collect_list(F.struct("g", "ends")).alias("cuts")).hint("merge"), "key", "left")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = regions.Images(batch.column("t"), batch.column("f"))
            found = [whole.groups(policy, gap) for policy, gap in combos]
            if guided:
                found.append(whole.cut(found[-1], batch.column("cuts")))
            row, mask, detected, size, member, flip = whole.outcomes(found, IOU_THRESHOLD)
            columns = [batch.column("image").take(pa.array(whole.image_of[row])), *(whole.truth.field(c).take(pa.array(row)) for c in ("gi", *keep))]
            at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            parts = [pa.ListArray.from_arrays(at, whole.reading(c, member, flip)) for c in ("text", *(["conf"] if conf else []))]
            columns += [pa.array(mask, pa.int32()), pa.array(detected), *parts]
            yield pa.RecordBatch.from_arrays(columns, names=["image", "gi", *keep, "mask", "detected", "texts", *(["confs"] if conf else [])])

    kind = ", ".join(f"`{c}` {t.simpleString()}" for c, t in named.items()) + ", mask int, detected boolean, texts array<string>"
    rows = rows.select("image", "t", "f", *(["cuts"] if guided else []))
    out = rows.mapInArrow(kernel, kind + (", confs array<array<double>>" if conf else ""))
    out = out.withColumn("pred", F.when(F.col("detected"), F.coalesce(normalize_text(joined_text(F.col("texts"))), F.lit(""))).otherwise(F.lit(""))).drop("texts")
    if conf:
        out = out.withColumn("conf", F.coalesce(F.flatten("confs"), F.array().cast("array<double>"))).withColumn("mean_confidence", mean_of_characters(F.array("conf"))).drop("confs")
    return out


def chains(images: DataFrame, policy: str, gap: float) -> DataFrame:
    """(key, g, texts) of the groups of several fragments, in reading order; ``images`` as in ``read_groups``."""
    kind = images.schema["key"].dataType.simpleString()
    none = pa.StructArray.from_arrays([pa.array([], pa.float64())] * 5, names=["gi", "x0", "y0", "x1", "y1"])  # true boxes have no part in it

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = regions.Images(pa.ListArray.from_arrays(pa.array(np.zeros(len(batch) + 1), pa.int32()), none), batch.column("f"))
            own = whole.groups(policy, gap)
            several = np.flatnonzero(own.size > 1)
            member = own.members(several)
            at = pa.array(np.concatenate([[0], np.cumsum(own.size[several])]), pa.int32())
            columns = [batch.column("key").take(pa.array(whole.holder[own.name[several]])), pa.array(whole.index[own.name[several]]), pa.ListArray.from_arrays(at, whole.reading("text", member, own.flip[member]))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "g", "texts"])

    return images.select("key", "f").mapInArrow(kernel, f"key {kind}, g bigint, texts array<string>")


def guided_cuts(found: DataFrame, serials: DataFrame, margin: float = 0.0) -> DataFrame:
    """(key, g, ends): where ``chains`` are cut, as ``guided_members`` cuts them; equal chains are scored once."""
    texts = found.select(F.col("texts").alias("chain_id")).distinct()
    scored = merge.deciding_scores(texts.withColumn("texts", F.col("chain_id")), serials, margin)
    cut = merge.best_partition(scored, margin).where("i > 0").groupBy(F.col("chain_id").alias("texts")).agg(F.sort_array(F.collect_list("i")).alias("ends"))
    return found.hint("merge").join(cut.hint("merge"), "texts").select("key", "g", "ends")  # small files may hold very many rows
