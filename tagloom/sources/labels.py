"""Readers for label files, dictionaries, archives and image folders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOXES = "array<struct<transcription:string,points:array<array<double>>,difficult:boolean>>"
DETECTIONS = (
    "image string, polys array<array<array<double>>>, text_fwd array<string>, conf_fwd array<array<double>>, score_fwd array<double>, "
    "text_bwd array<string>, conf_bwd array<array<double>>, score_bwd array<double>, cls_flip array<boolean>"
)


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(image, boxes) of lines ``image <tab> JSON array``: cut at the first tab; blank lines don't count; broken JSON fails."""
    line = F.regexp_replace(F.col(value), r"[\r\n]+$", "")
    rows = lines.select(line.alias("line")).where(F.trim("line") != "")
    parts = F.split("line", "\t", 2)
    body = F.coalesce(F.get(parts, F.lit(1)), F.raise_error(F.concat(F.lit("no tab in the line "), F.col("line"))))
    # Filters on the boxes may be tried before blank lines are gone.
    boxes = F.when(F.trim("line") != "", F.from_json(body, BOXES, {"mode": "FAILFAST"}))
    return rows.select(parts[0].alias("image"), boxes.alias("boxes"))


def flatten(samples: DataFrame) -> DataFrame:
    """One row a box, with its position in the image; ``difficult`` is false unless said."""
    rows = samples.select("image", F.posexplode("boxes").alias("box_index", "b"))
    points = F.col("b.points")
    return rows.select("image", "box_index", "b.transcription", points.alias("points"), F.coalesce("b.difficult", F.lit(False)).alias("difficult"), F.size(points).alias("n_points"), (F.size(points) > 4).alias("is_curved"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return flatten(parse_lines(spark.read.text(path)))


def read_recognition_labels(spark: SparkSession, path: str) -> DataFrame:
    """(crop, label) of tab-separated lines; leading spaces and quotes belong to the label."""
    rows = spark.read.text(path).where(F.length("value") > 0)
    parts = F.split("value", "\t", 2)
    return rows.select(parts[0].alias("crop"), F.get(parts, F.lit(1)).alias("label"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """One character a line; empty lines don't count, a lone space does."""
    return spark.read.text(path).where(F.length("value") > 0).select(F.col("value").alias("char"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def of_split(records: DataFrame, assignment: DataFrame, split: str = "test") -> DataFrame:
    return records.join(assignment.where(F.col("split") == split), "image", "left_semi")


def read_archive(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """One archived run; only its partition is read."""
    return spark.read.parquet(path).where(F.col("run_id") == run_id)


def read_images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """(image, sha256, size, width, height, corrupt) of the image files in a folder; one of no bytes counts as missing, as Spark lists none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("image"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), jpeg_size(F.col("content")).alias("shape"))
    return found.select("image", "sha256", "size", F.col("shape")[0].alias("width"), F.col("shape")[1].alias("height"), F.col("shape").isNull().alias("corrupt"))


def jpeg_size(content: Column) -> Column:
    """[width, height] of a whole JPEG, null where it lacks a frame header or its end, by an Arrow kernel."""
    @F.pandas_udf("array<int>")
    def size(bodies: pd.Series) -> pd.Series:
        return bodies.map(_frame)

    return size(content)


def _frame(body: bytes | None) -> list[int] | None:
    """The size in the first frame header, if segments lead from it to a scan and the file ends with the end marker."""
    if not body or body[:2] != b"\xff\xd8" or not body.rstrip(b"\x00").endswith(b"\xff\xd9"):
        return None
    at, size = 2, None
    while at + 4 <= len(body) and body[at] == 0xFF:
        mark, length = body[at + 1], int.from_bytes(body[at + 2 : at + 4], "big")
        if mark == 0xFF:  # a fill byte
            at += 1
            continue
        if length < 2 or at + 2 + length > len(body):
            return None
        if mark == 0xDA:
            return size
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and size is None and length >= 8:
            size = [int.from_bytes(body[at + 7 : at + 9], "big"), int.from_bytes(body[at + 5 : at + 7], "big")]
        at += 2 + length
    return None


def read_serials(spark: SparkSession, path: str) -> DataFrame:
    """(label, key, freq, rep) of a serial set that ``sinks.write_tables`` stored as ``serials``; one without metadata isn't whole."""
    spark.read.parquet(f"{path}/metadata")  # an error where there is none
    return spark.read.parquet(f"{path}/serials")


def fragments(cache: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One row a fragment of a detection cache; a cache that lacks an image asked for is no use and gives an error."""
    if images is not None:
        whole = images.select("image").distinct().join(cache.where("polys is not null"), "image", "left_anti")
        if whole.limit(1).count():
            raise ValueError("the detection cache doesn't cover every image")
    cols = ["polys", "text_fwd", "conf_fwd", "score_fwd", "text_bwd", "conf_bwd", "score_bwd", "cls_flip"]
    rows = cache.select("image", F.posexplode(F.arrays_zip(*cols)).alias("frag_index", "f"))
    return rows.select("image", "frag_index", F.col("f.polys").alias("points"), *[f"f.{c}" for c in cols[1:]])
