"""Splits that keep components together, folds, and what leaks between splits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.config import CURVED_FOLDS, IDENTIFYING_MIN_LEN, SPLIT_RATIOS, SPLIT_SEED


def identifying(label: Column, least: int = IDENTIFYING_MIN_LEN) -> Column:
    """Labels long enough to tell one part from others; spaces count."""
    return F.length(label) >= least


def component_sizes(members: DataFrame, curved: DataFrame) -> DataFrame:
    """(component, size, n_curved) from (image, component) and the curved images."""
    marked = members.join(curved.select("image").distinct().withColumn("c", F.lit(1)), "image", "left")
    return marked.groupBy("component").agg(F.count("*").alias("size"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_curved"))


def assign(sizes: DataFrame, seed: int = SPLIT_SEED, ratios: dict[str, float] = SPLIT_RATIOS) -> DataFrame:
    """(component, split): the split that is most short of its share takes the next component.

    Components with curved images come first, most curved first, by the splits' curved counts; then the others,
    largest first, by the splits' image counts, which include the first ones.  Equal components come in the
    order of md5(seed, component); equal splits in the order of ``ratios``.

    Each choice depends on all before it, so one task reads the components in order; it holds a counter for
    each split and passes rows through.
    """
    names = list(ratios)
    totals = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n_curved"), F.lit(0))).first()
    images, curved = int(totals[0]), int(totals[1])
    order = [F.when(F.col("n_curved") > 0, 0).otherwise(1), -F.when(F.col("n_curved") > 0, F.col("n_curved")).otherwise(F.col("size")), F.md5(F.concat(F.lit(str(seed)), F.col("component").cast("string")))]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have_curved, have = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
        for batch in batches:
            out = []
            for size, n in zip(batch["size"], batch["n_curved"], strict=True):
                if n > 0:
                    to = min(names, key=lambda s: have_curved[s] - ratios[s] * curved)
                    have_curved[to] += n
                else:
                    to = min(names, key=lambda s: have[s] - ratios[s] * images)
                have[to] += size
                out.append(to)
            yield pd.DataFrame({"component": batch["component"], "split": out})

    kind = sizes.schema["component"].dataType.simpleString()
    return sizes.repartition(1).sortWithinPartitions(*order).mapInPandas(walk, f"component {kind}, split string")


def curved_folds(sizes: DataFrame, folds: int = CURVED_FOLDS) -> DataFrame:
    """(component, fold) of components with curved images: most curved first, into the fold with fewest."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = [0] * folds
        for batch in batches:
            out = []
            for n in batch["n_curved"]:
                to = min(range(folds), key=have.__getitem__)
                have[to] += n
                out.append(to)
            yield pd.DataFrame({"component": batch["component"], "fold": out})

    kind = sizes.schema["component"].dataType.simpleString()
    return sizes.where("n_curved > 0").repartition(1).sortWithinPartitions(-F.col("n_curved"), "component").mapInPandas(walk, f"component {kind}, fold int")


def split_stats(records: DataFrame, assignment: DataFrame) -> DataFrame:
    joined = records.join(assignment, "image")
    return joined.groupBy("split").agg(
        F.count_distinct("image").alias("images"),
        F.count("*").alias("boxes"),
        F.count_distinct(F.when(F.col("is_curved"), F.col("image"))).alias("curved_images"),
        F.count_if("is_curved").alias("curved_boxes"),
        F.count_distinct("label").alias("unique_labels"),
        F.count_if(F.contains(F.trim("label"), F.lit(" "))).alias("multi_token"),
    )


def seen_flags(records: DataFrame, assignment: DataFrame, key: str = "label") -> DataFrame:
    """Records of the other splits with ``seen``: whether train has the label."""
    joined = records.join(assignment, "image")
    train = joined.where("split = 'train'").select(F.col(key).alias("_k")).distinct().withColumn("_seen", F.lit(True))
    return joined.where("split <> 'train'").join(train, F.col(key) == F.col("_k"), "left").withColumn("seen", F.coalesce("_seen", F.lit(False))).drop("_k", "_seen")


def leakage(records: DataFrame, assignment: DataFrame, least: int = IDENTIFYING_MIN_LEN) -> DataFrame:
    """One row: how many test labels and crops train has seen, and how many of the labels are identifying."""
    flagged = seen_flags(records, assignment).where("split = 'test'")
    own = F.col("label")
    return flagged.agg(
        F.count_distinct("label").alias("unique_test_labels"),
        F.count_distinct(F.when(F.col("seen"), own)).alias("shared"),
        F.count_distinct(F.when(F.col("seen") & identifying(own, least), own)).alias("shared_identifying"),
        F.count_distinct(F.when(~F.col("seen"), own)).alias("unseen"),
        F.count_if("seen").alias("crops_seen"),
        F.count_if(~F.col("seen")).alias("crops_unseen"),
    )
