"""The closed set of serials: one spelling for labels that differ in spaces and letter case only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import space_key


def canonical(records: DataFrame, label: str = "label") -> DataFrame:
    """(label, key, freq, rep): rep is the key's most frequent spelling, of equally frequent ones the first."""
    counted = records.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("freq")).withColumn("key", space_key(F.col("label")))
    best = counted.groupBy("key").agg(F.min_by("label", F.struct(-F.col("freq"), "label")).alias("rep"))
    return counted.join(best, "key").select("label", "key", "freq", "rep")


def serials(records: DataFrame, label: str = "label") -> DataFrame:
    return canonical(records, label).select(F.col("rep").alias("serial")).distinct()


def variants(records: DataFrame, label: str = "label") -> DataFrame:
    """Keys with several spellings, these in ascending order."""
    return canonical(records, label).groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("spellings")).where(F.size("spellings") > 1)


def require_canonical(rows: DataFrame, names: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``rep``; a label without one is an error when its row is read, never a dropped row."""
    joined = rows.join(names.select(F.col("label").alias("_label"), F.col("rep").alias("_rep")), F.col(label) == F.col("_label"), "left")
    checked = F.when(F.col("_rep").isNull(), F.raise_error(F.concat(F.lit("no canonical spelling for "), F.col(label)))).otherwise(F.col("_rep"))
    return joined.withColumn("rep", checked).drop("_label", "_rep")
