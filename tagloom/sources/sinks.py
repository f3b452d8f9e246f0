"""Writers for labels, dictionaries, splits, serials, archives and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUIRED = ("crop", "gt", "pred", "char_confidences", "mean_confidence")
MOST_LINES = 100_000  # of files that are written as one part


def write_dictionary(charset: DataFrame, path: str) -> int:
    """One character a line in ascending order; returns how many.  A charset is small; a larger one is refused."""
    n = charset.count()
    if n > MOST_LINES:
        raise ValueError("this is no charset")
    charset.orderBy("char").coalesce(1).select("char").write.mode("overwrite").text(path)
    return n


def detection_lines(boxes: DataFrame) -> DataFrame:
    """(image, value) with value ``image <tab> JSON``, boxes in their order."""
    entry = F.struct("box_index", F.struct("transcription", "points", "difficult").alias("b"))
    rows = boxes.groupBy("image").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return rows.select("image", F.concat(F.col("image"), F.lit("\t"), F.to_json(F.transform("e", lambda x: x["b"]))).alias("value"))


def write_detection_labels(boxes: DataFrame, path: str) -> None:
    detection_lines(boxes).select("value").write.mode("overwrite").text(path)


def write_recognition_labels(records: DataFrame, path: str) -> None:
    records.select(F.concat(F.col("crop"), F.lit("\t"), F.col("label")).alias("value")).write.mode("overwrite").text(path)


def write_split_files(boxes: DataFrame, records: DataFrame, assignment: DataFrame, path: str) -> None:
    """Detection and recognition labels by split, under det/split=... and rec/split=....

    Detection lines come in the order of the split's list, which is that of image names, and recognition lines in that
    of crops: files are sorted, and their names ascend by range, so no task sorts more than a range.
    """
    det = detection_lines(boxes).join(assignment, "image")
    rec = records.join(assignment, "image").withColumn("value", F.concat(F.col("crop"), F.lit("\t"), F.col("label")))
    for name, rows, order in (("det", det, "image"), ("rec", rec, "crop")):
        dealt = rows.select("split", order, "value").repartitionByRange("split", order).sortWithinPartitions("split", order)
        dealt.select("split", "value").write.mode("overwrite").partitionBy("split").text(f"{path}/{name}")


def write_tables(path: str, metadata: dict[str, str] | None = None, **tables: DataFrame) -> None:
    """A snapshot, split or serial set: each of its relations as Parquet under its name, and ``metadata`` as one row.

    The metadata is written last, so a set that has it is whole.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    if metadata is not None:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(metadata,)], "metadata map<string,string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def write_detections(fragments: DataFrame, path: str) -> None:
    """A detection cache as ``labels.DETECTIONS``: one row an image, its fragments in their order."""
    cols = ["points", "text_fwd", "conf_fwd", "score_fwd", "text_bwd", "conf_bwd", "score_bwd", "cls_flip"]
    rows = fragments.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("frag_index", F.struct(*cols).alias("f")))).alias("e"))
    named = {"polys": "points", **{c: c for c in cols[1:]}}
    rows.select("image", *[F.col(f"e.f.{c}").alias(k) for k, c in named.items()]).write.mode("overwrite").parquet(path)


def archive(predictions: DataFrame, path: str, run_id: str) -> None:
    """Appends a run's predictions; a missing column is an error before anything is written."""
    missing = [c for c in REQUIRED if c not in predictions.columns]
    if missing:
        raise ValueError(f"predictions lack {', '.join(missing)}")
    predictions.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def markdown(metrics: DataFrame, most: int = 1000) -> str:
    """A Markdown table of a report's rows, of which there may be ``most``."""
    rows = metrics.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    lines = ["| " + " | ".join(metrics.columns) + " |", "|" + " --- |" * len(metrics.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def report(title: str, metrics: DataFrame, gate: DataFrame) -> str:
    """A Markdown report: whether the gate (one row with ``passed``) holds, what it counted, and the metrics' table."""
    row = gate.first().asDict()
    passed = bool(row.pop("passed"))
    counts = "\n".join(f"- {k}: {v}" for k, v in row.items())
    return f"# {title}\n\n**{'PASS' if passed else 'FAIL'}**\n\n{counts}\n\n{markdown(metrics)}\n"
