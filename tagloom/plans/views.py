"""Relations of the label-recognition domain, read out of a folder of star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.functions.text import normalize_text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """(p_partkey, label_original, label): codes of parts, of which some are written without spaces."""
    spelt = F.concat("p_brand", F.lit(" "), "p_name")
    shown = F.when(F.col("p_partkey") % 7 == 0, F.replace(spelt, F.lit(" "), F.lit(""))).otherwise(spelt)
    return table(spark, folder, "part").select("p_partkey", shown.alias("label_original"), normalize_text(shown).alias("label"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(p_partkey, gt, pred, is_curved, seen, detected): readings of the codes, three in four of them spoilt."""
    k, gt = F.col("p_partkey"), F.upper(F.concat("p_brand", F.lit(" "), "p_name"))
    pred = F.when(k % 4 == 0, F.replace(gt, F.lit(" "), F.lit(""))).when(k % 4 == 1, F.translate(gt, "0158B", "OISB8")).when(k % 4 == 2, F.substring(gt, 2, 1000)).otherwise(gt)
    return table(spark, folder, "part").select("p_partkey", gt.alias("gt"), pred.alias("pred"), (k % 17 == 0).alias("is_curved"), (k % 3 == 0).alias("seen"), (k % 5 != 0).alias("detected"))


def serials(spark: SparkSession, folder: str) -> DataFrame:
    return predictions(spark, folder).select(F.col("gt").alias("serial")).distinct()


def _lines(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """Lines with their place in the order and the code of their part, by order, in ``parts`` partitions if given.

    The codes come first and the places after, so that what follows finds an order's lines together.
    """
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.struct(F.concat("p_brand", F.lit(" "), "p_name").alias("code")).alias("c"))
    codes = part.groupBy("l_partkey").agg(F.collect_list("c").alias("codes")).hint("merge")  # a small file may hold very many parts
    rows = lines.join(codes, "l_partkey", "left")
    rows = rows if parts is None else rows.repartition(parts, "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.withColumn("box_index", F.row_number().over(order) - 1)
    return rows.withColumn("code", F.explode("codes")).withColumn("code", F.col("code.code")).drop("codes")


def _image() -> Column:
    return F.concat(F.lit("img_"), F.col("l_orderkey").cast("string"), F.lit(".jpg"))


def _boxes(rows: DataFrame, *more: str) -> DataFrame:
    k = F.col("l_partkey") + F.col("l_linenumber")
    text = F.when(k % 31 == 0, F.lit(" ")).when(k % 7 == 0, F.replace("code", F.lit(" "), F.lit(""))).otherwise(F.col("code"))
    w, h = 40 + F.col("l_suppkey") % 50, F.col("l_linenumber") * 3 - 2
    x0, y0 = F.col("l_quantity") * 8, F.col("box_index") * 15.0
    return rows.select(
        *more,
        _image().alias("image"),
        "box_index",
        text.alias("transcription"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + w).alias("x1"),
        (y0 + 20.0).alias("y1"),
        F.when(F.col("l_partkey") % 17 == 0, 6).otherwise(4).alias("n_points"),
        (F.col("l_partkey") % 17 == 0).alias("is_curved"),
        (F.col("l_returnflag") == "R").alias("difficult"),
        F.struct(w.cast("int").alias("w"), h.cast("int").alias("h")).alias("crop_size"),
        (F.col("l_linenumber") != 7).alias("found"),
        (F.col("l_discount") * 400).alias("dx"),
        (F.col("l_tax") * 100).alias("dy"),
        "l_partkey",
    )


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Annotated boxes: an order is an image, its lines are the boxes."""
    return _boxes(_lines(spark, folder))


def images(spark: SparkSession, folder: str, policies: list[str], conf: bool = False, keep: tuple[str, ...] | None = None) -> DataFrame:
    """(key, image, t, f): one row for each image, its true boxes and its fragments, as ``evaluation.read_groups`` takes them.

    With ``keep`` the true boxes have no columns but these, their index and corners.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = _boxes(_lines(spark, folder, parts), "l_orderkey")
    kept = [c for c in truth_columns() if c not in ("image", "points") and (keep is None or c in ("gi", *keep))]
    t = F.struct(*[truth_columns()[c].alias(c) for c in kept], *[F.col(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    named = fragment_columns()
    readings = ["text_fwd", "text_bwd", *(["conf_fwd", "conf_bwd"] if conf else [])]
    flips = [_flip(p, named).alias(f"flip_{p}") for p in policies]
    f = F.struct(*[named[c].alias(c) for c in ("frag_index", "x0", "y0", "x1", "y1", *readings)], *flips)
    f = F.when(F.col("found") & F.col("l_orderkey").isNotNull(), f)
    rows = rows.select(F.col("l_orderkey").alias("key"), "image", t.alias("t"), f.alias("f"))  # compiled, as what an aggregate computes is not
    rows = rows.groupBy("key").agg(F.first("image").alias("image"), F.collect_list("t").alias("t"), F.collect_list("f").alias("f"))
    return rows.select("key", "image", "t", "f")


def predicted_boxes(truth: DataFrame) -> DataFrame:
    """Detections of ``boxes``: shifted copies, some missing."""
    return truth.where("found").select("image", F.col("box_index").alias("pred_index"), (F.col("x0") + F.col("dx")).alias("x0"), (F.col("y0") + F.col("dy")).alias("y0"), (F.col("x1") + F.col("dx")).alias("x1"), (F.col("y1") + F.col("dy")).alias("y1"))


def with_corners(boxes: DataFrame) -> DataFrame:
    """``boxes`` with their four corners as ``points``."""
    corner = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    return boxes.withColumn("points", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))


def with_shapes(boxes: DataFrame) -> DataFrame:
    """``boxes`` with their outlines as ``points``: of curved ones the lower left quarter is cut out."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    cut = F.array(F.array(x, F.col("y1")), F.array(x, y), F.array(F.col("x0").cast("double"), y))
    return with_corners(boxes).withColumn("points", F.when(F.col("is_curved"), F.concat(F.slice("points", 1, 3), cut)).otherwise(F.col("points")))


def truth_columns() -> dict[str, Column]:
    text = F.upper("transcription")
    return {"image": F.col("image"), "gi": F.col("box_index"), "points": F.col("points"), "gt": text, "rep": text, "kind": X.kind(F.col("is_curved")), "seen": F.when(F.col("l_partkey") % 3 == 0, "seen").otherwise("unseen"), "tokens": F.concat(F.lit("tok"), X.token_bucket(text).cast("string")), "length": X.length_bin(text)}


def truth(boxes: DataFrame) -> DataFrame:
    """(image, gi, points, gt, rep, kind, seen, tokens, length) of the true boxes."""
    return boxes.select(*[c.alias(k) for k, c in truth_columns().items()])


def fragment_columns() -> dict[str, Column]:
    k = F.col("l_partkey") + F.col("box_index")
    text = F.upper(F.when(k % 5 == 0, F.substring("transcription", 2, 1000)).otherwise(F.col("transcription")))
    back, sure, turned = F.reverse(text), (k % 7 + 3) / 10, k % 11 == 0
    x0, x1, y0, y1 = (F.col(c) + F.col(s) for c, s in (("x0", "dx"), ("x1", "dx"), ("y0", "dy"), ("y1", "dy")))
    corner = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    return {
        "image": F.col("image"), "frag_index": F.col("box_index"), "x0": x0, "y0": y0, "x1": x1, "y1": y1,
        "points": F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)),
        "text_fwd": F.when(turned, back).otherwise(text), "text_bwd": F.when(turned, text).otherwise(back),
        "conf_fwd": F.array_repeat(sure, F.length(text)), "conf_bwd": F.array_repeat(sure / 2, F.length(text)),
        "score_fwd": sure, "score_bwd": F.when(turned, sure + 0.1).otherwise(sure / 2), "cls_flip": turned | (k % 13 == 0),
    }


def _flip(policy: str, named: dict[str, Column]) -> Column:
    return {"none": F.lit(False), "classifier": named["cls_flip"], "confidence": named["score_bwd"] > named["score_fwd"]}[policy]


def fragments(boxes: DataFrame) -> DataFrame:
    """Detections of ``boxes`` as fragments, read both ways: every eleventh is upside down, every fifth is spoilt."""
    return boxes.where("found").select(*[c.alias(k) for k, c in fragment_columns().items()])


def recognisers(spark: SparkSession, folder: str) -> DataFrame:
    """(model, p_partkey, gt, rep, pred, is_curved, seen): the codes as three recognisers read them."""
    p = predictions(spark, folder).withColumn("rep", F.col("gt"))
    k = F.col("p_partkey")
    readings = {"small": F.col("pred"), "medium": F.when(k % 8 < 3, F.col("pred")).otherwise(F.col("gt")), "large": F.when(k % 16 == 1, F.col("pred")).otherwise(F.col("gt"))}
    rows = p.select("p_partkey", "gt", "rep", "is_curved", "seen", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), c.alias("pred")) for m, c in readings.items()])).alias("r"))
    return rows.select("r.model", "p_partkey", "gt", "rep", "r.pred", "is_curved", "seen")


def label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a label file: image, tab, JSON."""
    b = boxes(spark, folder)
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    four = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    middle = F.array((F.col("x0") + F.col("x1")) / 2, F.col("y1"))
    points = F.when(F.col("is_curved"), F.concat(F.slice(four, 1, 3), F.array(middle, middle), F.slice(four, 4, 1))).otherwise(four)
    entry = F.struct("box_index", F.struct("transcription", points.alias("points"), "difficult").alias("b"))
    rows = b.groupBy("image").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return rows.select(F.concat("image", F.lit("\t"), F.to_json(F.transform("e", lambda x: x["b"]))).alias("value"))


def line_records(spark: SparkSession, folder: str) -> DataFrame:
    """(image, label, is_curved): documents as images, their lines as labels."""
    docs = table(spark, folder, "documents")
    return docs.select(F.col("doc_id").alias("image"), F.explode(F.split("text", "\n")).alias("line"), (F.col("lang") != "en").alias("is_curved")).where("line <> ''").select("image", F.col("line").alias("label"), "is_curved")


def confidences(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, conf): character confidences of a reading."""
    return table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("conf"))


def assignment(images: DataFrame) -> DataFrame:
    """(image, split) by the last digit of the image's md5, for queries that need some split."""
    digit = F.conv(F.substring(F.md5(F.col("image").cast("string")), 32, 1), 16, 10).cast("int")
    return images.select("image").distinct().select("image", F.when(digit < 12, "train").when(digit < 14, "val").otherwise("test").alias("split"))
