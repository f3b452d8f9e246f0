"""Counts and checks over annotated boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.checkpoints import Stored
from tagloom.functions.text import has_digit, has_lowercase, normalize_text, token_spans


def characters(texts: DataFrame, text: str = "transcription") -> DataFrame:
    return texts.select(F.explode(F.split(F.col(text), "")).alias("char")).where("char <> ''")


def profile(boxes: DataFrame, text: str = "transcription") -> DataFrame:
    """One row of totals over the raw texts."""
    t = F.col(text)
    images = F.count_distinct("image")
    return boxes.agg(
        images.alias("images"),
        F.count("*").alias("boxes"),
        F.when(images > 0, F.count("*") / images).otherwise(F.lit(0.0)).alias("boxes_per_image"),
        F.count_distinct(text).alias("unique_texts"),
        F.count_if("is_curved").alias("curved_boxes"),
        F.count_distinct(F.when(F.col("is_curved"), F.col("image"))).alias("curved_images"),
        F.count_if(F.contains(F.trim(t), F.lit(" "))).alias("multi_token"),
        F.count_if(F.length(t) == 0).alias("empty"),
        F.avg(has_digit(t).cast("double")).alias("digit_ratio"),
        F.count_distinct(F.when(has_lowercase(t), t)).alias("lowercase_texts"),
        F.max(F.length(t)).alias("max_length"),
    )


def charset(texts: DataFrame, text: str = "transcription") -> DataFrame:
    """Distinct characters of the normalised texts, the space aside."""
    return characters(texts.select(normalize_text(F.col(text)).alias("t")), "t").where("char <> ' '").distinct()


def char_histogram(texts: DataFrame, text: str = "transcription") -> DataFrame:
    return characters(texts, text).groupBy("char").agg(F.count("*").alias("n"))


def length_histogram(texts: DataFrame, text: str = "transcription") -> DataFrame:
    return texts.groupBy(F.length(F.col(text)).alias("length")).agg(F.count("*").alias("n"))


def rejects(boxes: DataFrame, text: str = "transcription") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(boxes for detection labels, records for recognition labels, rejects with their reasons).

    A blank text is in neither label file; a degenerate crop is in the detection labels only.
    """
    blank = F.trim(F.col(text)) == ""
    small = F.col("crop_size").isNull() | (F.least("crop_size.w", "crop_size.h") < 2)
    marked = boxes.withColumn("reason", F.when(blank, F.lit("empty transcription")).when(small, F.lit("degenerate crop")))
    detection = marked.where("reason is null or reason <> 'empty transcription'").drop("reason")
    return detection, marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("image", F.col("box_index").alias("box"), "reason")


def records(boxes: DataFrame, text: str = "transcription") -> DataFrame:
    """The box facts: normalised label beside the original, and its tokens."""
    label = normalize_text(F.col(text))
    return boxes.withColumn("label_original", F.col(text)).withColumn("label", label).withColumn("tokens", token_spans(label)).drop(text)


def percentiles(rows: DataFrame, value: Column, points: dict[str, float]) -> DataFrame:
    """One row of exact percentiles by name, interpolated between neighbours; null over no rows.

    Values are counted by key and dealt by range; only one total a partition meets in one place, so that each
    partition knows the rank of its first value.
    """
    store = Stored(rows.sparkSession, "percentiles")
    counts = rows.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    counts = store.put(counts.repartitionByRange("v").select("v", "c", F.spark_partition_id().alias("part")), "counts")
    parts = counts.groupBy("part").agg(F.sum("c").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = counts.join(F.broadcast(parts), "part")  # one row a partition
    placed = placed.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy("part").orderBy("v")))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")), F.col("v")))

    out = []
    for name, p in points.items():
        place = F.lit(p) * (F.col("total") - 1)
        low, high, share = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out.append((low + share * (high - low)).alias(name))
    return placed.agg(*out)


def build_stats(rows: DataFrame) -> DataFrame:
    """Totals of the kept boxes, with exact percentiles of the crops' aspect ratios."""
    aspect = F.col("crop_size.w") / F.col("crop_size.h")
    totals = rows.agg(
        F.count_distinct("image").alias("images"),
        F.count("*").alias("boxes"),
        F.count_if("is_curved").alias("curved"),
        F.count_if(F.size("tokens") > 1).alias("multi_token"),
        F.max(F.length("label")).alias("max_length"),
        F.avg(aspect).alias("aspect_mean"),
        F.max(aspect).alias("aspect_max"),
    )
    return totals.join(percentiles(rows, aspect, {"aspect_p05": 0.05, "aspect_p50": 0.5, "aspect_p95": 0.95}))


def sorted_list(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values in ascending order."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def most_common(counts: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` keys with the largest counts, most common first; equal counts by key."""
    return counts.orderBy(F.desc("n"), key).limit(n)


def resolution_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.concat_ws("x", F.col("crop_size.w").cast("string"), F.col("crop_size.h").cast("string")).alias("resolution")).agg(F.count("*").alias("n"))


def asset_differences(labelled: DataFrame, on_disk: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(labelled but missing, on disk but unlabelled)."""
    a, b = labelled.select(key).distinct(), on_disk.select(key).distinct()
    return a.join(b, key, "left_anti"), b.join(a, key, "left_anti")


def asset_gate(missing: DataFrame, unlabeled: DataFrame, corrupt: DataFrame) -> DataFrame:
    counts = missing.agg(F.count("*").alias("missing")).join(unlabeled.agg(F.count("*").alias("unlabeled"))).join(corrupt.agg(F.count("*").alias("corrupt")))
    return counts.withColumn("passed", F.expr("missing = 0 and unlabeled = 0 and corrupt = 0"))
