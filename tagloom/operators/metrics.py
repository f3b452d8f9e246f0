"""Metrics by overlapping slices, failures, look-alike confusions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.alignment import confusion_pairs

SLICES = ("kind", "seen", "tokens", "length")


def sliced(items: DataFrame, measures: dict[str, Column], slices: tuple[str, ...] = SLICES, by: tuple[str, ...] = (), expected: DataFrame | None = None) -> DataFrame:
    """(by..., slice, value, measures...) overall and by each slice column, in one pass; a null value belongs to no slice.

    A slice without rows has no row, unless it is among the ``expected`` ones (by..., slice, value), a small table:
    then its measures are null.
    """
    tags = [F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value"))]
    tags += [F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices]
    rows = items.withColumn("_t", F.explode(F.array(*tags))).where(F.col("_t.value").isNotNull())
    out = rows.groupBy(*by, F.col("_t.slice").alias("slice"), F.col("_t.value").alias("value")).agg(*[c.alias(k) for k, c in measures.items()])
    return out if expected is None else out.join(F.broadcast(expected), [*by, "slice", "value"], "full")


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def attach_outputs(records: DataFrame, outputs: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Records with a model's outputs by crop: text, char_confidences and score.

    Every record needs its output, and the mean of an output's character confidences must agree with its score;
    a row that breaks either rule is an error when it is read.
    """
    joined = records.join(outputs.select("crop", F.col("text").alias("pred"), "char_confidences", "score"), "crop", "left")
    n = F.size("char_confidences")
    mean = F.when(n > 0, F.aggregate("char_confidences", F.lit(0.0), lambda a, x: a + x) / n).otherwise(F.lit(0.0))
    fault = F.when(F.col("pred").isNull(), F.concat(F.lit("no output for "), F.col("crop"))).when(F.abs(mean - F.col("score")) > tolerance, F.concat(F.lit("confidences and score differ for "), F.col("crop")))
    checked = F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(mean)
    return joined.withColumn("mean_confidence", checked).drop("score")


def failures(detected: Column, hit: Column) -> dict[str, Column]:
    """Exclusive failures; with the hits they sum up to all rows."""
    return {"fail_detection": F.count_if(~detected), "fail_recognition": F.count_if(detected & ~hit), "hits": F.count_if(detected & hit)}


def confusions(items: DataFrame, prediction: str = "pred", truth: str = "gt") -> DataFrame:
    """(gt_char, pred_char, n) of look-alike substitutions, by an Arrow kernel over distinct pairs that differ."""
    pairs = items.where(F.col(prediction) != F.col(truth)).groupBy(F.col(prediction).alias("p"), F.col(truth).alias("t")).agg(F.count("*").alias("times"))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(g, p, n) for a, b, n in zip(batch["p"], batch["t"], batch["times"], strict=True) for g, p in confusion_pairs(a, b)]
            yield pd.DataFrame(out, columns=["gt_char", "pred_char", "times"])

    found = pairs.mapInPandas(kernel, "gt_char string, pred_char string, times bigint")
    return found.groupBy("gt_char", "pred_char").agg(F.sum("times").alias("n"))


def ctc_collapse(steps: DataFrame, blank: int = 0) -> DataFrame:
    """Time steps that a CTC decoder keeps: not the blank, and not what the step before has."""
    from pyspark.sql import Window

    before = F.lag("idx").over(Window.partitionBy("crop").orderBy("t"))
    return steps.withColumn("_b", before).where((F.col("idx") != blank) & (F.col("_b").isNull() | (F.col("_b") != F.col("idx")))).drop("_b")
