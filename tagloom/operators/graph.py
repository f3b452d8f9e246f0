"""Connected components over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.checkpoints import Stored


def components(edges: DataFrame, store: Stored, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node reachable.

    Large-star and small-star rounds: neighbours are linked to the smallest one seen, first the larger ones,
    then the smaller.  A node's edges are never gathered: both steps are a minimum by key, which Spark combines
    before the shuffle, and a join that it may split.  Nulls and self edges are ignored; repeated edges are
    harmless; no edges give no rows.
    """

    def mark(df: DataFrame) -> tuple:
        """Tells one set of edges from another: its size and two sums of hashes."""
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(x, y))"), F.expr("bit_xor(xxhash64(y, x, 1))")).first())

    edges = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    now = store.put(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        joined = large.join(low, "x")
        small = joined.select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionByName(low.select("x", F.col("m").alias("y"))).distinct()
        after = store.put(small, "edges")
        store.drop(now)
        now, last, before = after, before, mark(after)
        if last == before:
            break
    stars = now.groupBy("x").agg(F.min("y").alias("component")).withColumnRenamed("x", "node")
    roots = now.select(F.col("y").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.unionByName(roots)


def label_edges(records: DataFrame, keep: Column | None = None, image: str = "image", label: str = "label", min_images: int = 2, max_images: int | None = None) -> DataFrame:
    """Edges (a, b) from the first image of each shared label to its others.

    A label counts if ``keep`` holds and at least ``min_images`` (and at most ``max_images``) distinct images have
    it.  A star has one edge fewer than images, so a frequent label costs no pairs.
    """
    rows = records.where(keep) if keep is not None else records
    pairs = rows.select(F.col(label).alias("label"), F.col(image).alias("b")).distinct()
    first = pairs.groupBy("label").agg(F.min("b").alias("a"), F.count("*").alias("n")).where(F.col("n") >= min_images)
    if max_images is not None:
        first = first.where(F.col("n") <= max_images)
    return pairs.join(first, "label").where("a <> b").select("a", "b", "label")


def image_components(records: DataFrame, store: Stored, keep: Column | None = None, image: str = "image", label: str = "label", **limits: int) -> DataFrame:
    """(image, component) of every image; those that share no label that counts are alone."""
    found = components(label_edges(records, keep, image, label, **limits), store)
    images = records.select(F.col(image).alias("image")).distinct()
    return images.join(found, F.col("image") == F.col("node"), "left").select("image", F.coalesce("component", "image").alias("component"))
