"""The queries: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.checkpoints import Stored
from tagloom.config import CANDIDATE_GAP, CONDITIONAL_RECOGNITION, FLIP_POLICIES
from tagloom.functions import geometry as G
from tagloom.functions import text as X
from tagloom.operators import detection as D
from tagloom.operators import evaluation, graph, grouping, matching, merge, metrics, profile, serial_db, split, sweep
from tagloom.sources import labels, sinks

from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def r9(c) -> F.Column:
    return F.round(c, 9)


# Scans, labels, characters


@query
def label_scan_flatten(spark, d):
    return labels.flatten(labels.parse_lines(V.label_lines(spark, d))).select("image", "box_index", "transcription", "difficult", "n_points", "is_curved", r9(F.expr("points[0][0]")).alias("x0"))


@query
def detection_lines_round_trip(spark, d):
    """The written detection labels, read again."""
    boxes = labels.flatten(labels.parse_lines(V.label_lines(spark, d)))
    again = labels.flatten(labels.parse_lines(sinks.detection_lines(boxes)))
    return again.groupBy("image").agg(F.count("*").alias("boxes"), F.sum(F.length("transcription")).alias("chars"), F.count_if("difficult").alias("difficult"))


@query
def normalize_labels(spark, d):
    return V.parts(spark, d).select("p_partkey", "label_original", "label", X.space_key(F.col("label_original")).alias("space_key"))


@query
def space_key_clusters(spark, d):
    return serial_db.variants(V.parts(spark, d)).select("key", F.array_join("spellings", "|").alias("spellings"))


@query
def canonical_spelling(spark, d):
    return serial_db.canonical(V.parts(spark, d)).select("label", "rep", "freq")


@query
def serial_db_summary(spark, d):
    names = serial_db.canonical(V.parts(spark, d))
    keys = names.groupBy("key").agg(F.count("*").alias("n"))
    return names.agg(F.count_distinct("rep").alias("size"), F.count_distinct("label").alias("raw_unique")).join(keys.agg(F.count_if(F.col("n") > 1).alias("merged_clusters")))


@query
def charset(spark, d):
    return profile.charset(V.boxes(spark, d))


@query
def dictionary_size(spark, d):
    return profile.charset(V.boxes(spark, d)).agg(F.count("*").alias("chars")).select("chars", X.out_channels(F.col("chars")).alias("out_channels"))


@query
def char_histogram(spark, d):
    return profile.char_histogram(V.boxes(spark, d))


@query
def common_chars(spark, d):
    """The twelve most common characters, most common first."""
    return profile.most_common(profile.char_histogram(V.boxes(spark, d)), "char", 12)


@query
def serial_list(spark, d):
    return profile.sorted_list(V.serials(spark, d), "serial")


@query
def length_histogram(spark, d):
    return profile.length_histogram(V.boxes(spark, d))


@query
def box_profile(spark, d):
    out = profile.profile(V.boxes(spark, d))
    return out.withColumn("boxes_per_image", r9("boxes_per_image")).withColumn("digit_ratio", r9("digit_ratio"))


@query
def reject_side_output(spark, d):
    return profile.rejects(V.boxes(spark, d))[2]


@query
def label_file_sizes(spark, d):
    """Detection labels keep degenerate crops, recognition labels don't."""
    det, rec, bad = profile.rejects(V.boxes(spark, d))
    one = lambda name, df: df.agg(F.count("*").alias("rows"), F.count_distinct("image").alias("images")).select(F.lit(name).alias("file"), "rows", "images")
    return one("det", det).unionByName(one("rec", rec)).unionByName(one("rejects", bad))


@query
def token_spans(spark, d):
    spans = V.parts(spark, d).select("p_partkey", F.posexplode(X.token_spans(F.col("label"))).alias("pos", "t"))
    return spans.select("p_partkey", "pos", F.col("t.token").alias("token"), F.col("t.start").alias("start"), F.col("t.end").alias("end"))


@query
def token_bucket(spark, d):
    return V.parts(spark, d).groupBy(X.token_bucket(F.col("label")).alias("bucket")).agg(F.count("*").alias("n"))


@query
def length_bin(spark, d):
    lines = V.line_records(spark, d).unionByName(V.parts(spark, d).select(F.col("p_partkey").alias("image"), "label", F.lit(False).alias("is_curved")))
    return lines.groupBy(X.length_bin(F.col("label")).alias("bin")).agg(F.count("*").alias("n"))


@query
def crop_names(spark, d):
    return V.boxes(spark, d).select(X.crop_name(F.col("image"), F.col("box_index")).alias("crop"), X.kind(F.col("is_curved")).alias("kind"))


@query
def aspect_percentiles(spark, d):
    out = profile.build_stats(profile.records(profile.rejects(V.boxes(spark, d))[1]))
    return out.select("images", "boxes", "curved", "multi_token", "max_length", *[r9(c).alias(c) for c in ("aspect_mean", "aspect_p05", "aspect_p50", "aspect_p95", "aspect_max")])


@query
def resolution_histogram(spark, d):
    return profile.resolution_histogram(V.boxes(spark, d))


@query
def asset_missing(spark, d):
    pages, docs = V.table(spark, d, "pages").select(F.col("page_id").alias("k")), V.table(spark, d, "documents").select(F.col("doc_id").alias("k"))
    return profile.asset_differences(docs, pages, "k")[0]


@query
def asset_unlabeled(spark, d):
    labelled, docs = V.table(spark, d, "labels").select(F.col("doc_id").alias("k")), V.table(spark, d, "documents").select(F.col("doc_id").alias("k"))
    return profile.asset_differences(labelled, docs, "k")[1]


@query
def asset_gate(spark, d):
    pages, docs = V.table(spark, d, "pages").select(F.col("page_id").alias("k")), V.table(spark, d, "documents").select(F.col("doc_id").alias("k"))
    missing, extra = profile.asset_differences(pages, docs, "k")
    return profile.asset_gate(missing, extra, V.table(spark, d, "pages").where("html is null or html = ''"))


@query
def content_sha256(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))


# Components, splits, leakage


def _kept(spark, d, least):
    return V.line_records(spark, d), split.identifying(F.col("label"), least)


@query
def leak_edges(spark, d):
    rows, keep = _kept(spark, d, 80)
    return graph.label_edges(rows, keep).select("a", "b").distinct()


@query
def components(spark, d):
    rows, keep = _kept(spark, d, 80)
    return graph.image_components(rows, Stored(spark, "components"), keep)


@query
def component_ablation(spark, d):
    """Which repeated labels tie images together: all, the rarer ones, the longer ones."""
    rows, store, out = V.line_records(spark, d), Stored(spark, "ablation"), None
    for name, keep, limits in (("all", None, {}), ("freq<=8", None, {"max_images": 8}), ("len>=40", F.length("label") >= 40, {}), ("len>=80", F.length("label") >= 80, {})):
        members = graph.image_components(rows, store, keep, **limits)
        one = members.groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest")).select(F.lit(name).alias("rule"), "components", "largest")
        out = one if out is None else out.unionByName(one)
    return out


def _sizes(spark, d):
    rows, keep = _kept(spark, d, 80)
    store = Stored(spark, "split")
    members = store.put(graph.image_components(rows, store, keep), "members")
    return rows, members, store.put(split.component_sizes(members, rows.where("is_curved")), "sizes")


def _assigned(spark, d):
    rows, members, sizes = _sizes(spark, d)
    return rows, members.join(split.assign(sizes), "component").select("image", "split")


@query
def greedy_split(spark, d):
    return split.assign(_sizes(spark, d)[2])


@query
def curved_folds(spark, d):
    return split.curved_folds(_sizes(spark, d)[2])


@query
def kfold_mean_std(spark, d):
    """Mean and deviation over the folds of the curved images' line lengths."""
    rows, members, sizes = _sizes(spark, d)
    folds = members.join(split.curved_folds(sizes), "component")
    each = rows.where("is_curved").join(folds, "image").groupBy("fold").agg(F.avg(F.length("label").cast("double")).alias("m"))
    return each.agg(F.count("*").alias("folds"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev("m"), 6).alias("std"))


@query
def split_stats(spark, d):
    rows, assigned = _assigned(spark, d)
    return split.split_stats(rows, assigned)


@query
def split_laws(spark, d):
    """Every image has one split, and no identifying label is in train and test."""
    rows, assigned = _assigned(spark, d)
    kept = rows.where(split.identifying(F.col("label"), 80)).join(assigned, "image")
    both = kept.groupBy("label").agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b")).where("a > 0 and b > 0")
    return assigned.agg(F.count("*").alias("images"), F.count_distinct("image").alias("distinct_images")).join(both.agg(F.count("*").alias("leaking")))


@query
def seen_flags(spark, d):
    rows = V.line_records(spark, d)
    return split.seen_flags(rows, V.assignment(rows)).select("image", "label", "split", "seen").withColumn("label", F.md5("label"))


@query
def leakage(spark, d):
    rows = V.line_records(spark, d)
    return split.leakage(rows, V.assignment(rows))


@query
def contamination(spark, d):
    """Where evaluated boxes come from, by kind: source split in rows, kind in columns."""
    rows = V.line_records(spark, d)
    joined = rows.join(V.assignment(rows), "image").withColumn("kind", X.kind(F.col("is_curved")))
    return joined.groupBy("split").pivot("kind", ["curved", "plane"]).agg(F.count(F.lit(1))).na.fill(0)


@query
def serials_not_in_train(spark, d):
    p = V.parts(spark, d)
    names = serial_db.canonical(p).select("label", "rep")
    train = p.where("p_partkey % 10 < 7").join(names, "label").select(F.col("rep").alias("serial")).distinct()
    return serial_db.serials(p).join(train, "serial", "left_anti")


# Fuzzy retrieval


@query
def fuzzy_top5(spark, d):
    best = matching.top_k(V.predictions(spark, d), V.serials(spark, d), 5)
    return best.select("pred", "serial", r9("score").alias("score"), "rank")


@query
def fuzzy_top1(spark, d):
    best = matching.top_k(V.predictions(spark, d), V.serials(spark, d), 1)
    return best.select("pred", "serial", r9("score").alias("score"))


def _hits(spark, d, gate="none"):
    items = V.predictions(spark, d).withColumn("rep", F.col("gt"))
    return matching.hits(items, matching.top_k(items, V.serials(spark, d), 5), 5, gate)


@query
def topk_accuracy(spark, d):
    h = _hits(spark, d)
    return h.agg(r9(matching.top_k_accuracy(F.col("hit1"))).alias("top1"), r9(matching.top_k_accuracy(F.col("hit5"))).alias("top5"))


def _sliceable(h):
    return h.withColumn("kind", X.kind(F.col("is_curved"))).withColumn("tokens", F.concat(F.lit("tok"), X.token_bucket(F.col("gt")).cast("string"))).withColumn("length", X.length_bin(F.col("gt"))).withColumn("seen", F.when(F.col("seen"), "seen").otherwise("unseen"))


@query
def topk_by_slice(spark, d):
    measures = {"n": F.count("*"), "car": r9(F.avg(X.car(F.col("pred"), F.col("gt")))), "exact": r9(metrics.share(F.col("pred") == F.col("gt"))), "top1": r9(metrics.share(F.col("hit1"))), "top5": r9(metrics.share(F.col("hit5")))}
    return metrics.sliced(_sliceable(_hits(spark, d)), measures)


@query
def e2e_summary(spark, d):
    h = _sliceable(_hits(spark, d, "detected"))
    return metrics.sliced(h, {"n": F.count("*"), "det_recall": r9(metrics.share(F.col("detected"))), "top1": r9(metrics.share(F.col("hit1"))), "top5": r9(metrics.share(F.col("hit5")))}, ("kind", "seen"))


@query
def failure_decomposition(spark, d):
    return metrics.sliced(_sliceable(_hits(spark, d, "detected")), metrics.failures(F.col("detected"), F.col("hit5")), ("kind",))


@query
def car_exact(spark, d):
    p = V.predictions(spark, d)
    return p.select("p_partkey", r9(X.car(F.col("pred"), F.col("gt"))).alias("car"), (F.col("pred") == F.col("gt")).alias("exact"))


@query
def response_curve(spark, d):
    """Retrieval under growing corruption of the serials themselves."""
    names = V.serials(spark, d)
    s, n = F.col("serial"), F.length("serial")
    spoil = {"0 perfect": s, "1 spaces dropped": X.without_spaces(s), "2 one character": F.overlay(s, F.lit("#"), (F.floor(n / 2) + 1).cast("int")), "3 two characters": F.overlay(F.overlay(s, F.lit("#"), (F.floor(n / 2) + 1).cast("int")), F.lit("#"), F.lit(2))}
    rows = names.select(s.alias("rep"), F.explode(F.array(*[F.struct(F.lit(k).alias("level"), c.alias("pred")) for k, c in spoil.items()])).alias("x")).select("rep", "x.level", "x.pred")
    h = matching.hits(rows, matching.top_k(rows, names, 5), 5)
    return h.groupBy("level").agg(F.count("*").alias("n"), r9(metrics.share(F.col("hit1"))).alias("top1"), r9(metrics.share(F.col("hit5"))).alias("top5"))


@query
def leverage_by_length(spark, d):
    h = _sliceable(_hits(spark, d)).groupBy("length").agg(metrics.share(F.col("hit5")).alias("t"), metrics.share(F.col("pred") == F.col("gt")).alias("e"))
    return h.select("length", r9(F.col("t") - F.col("e")).alias("leverage"))


@query
def neighbour_distance(spark, d):
    names = V.serials(spark, d)
    near = matching.top_k(names, names, 1, prediction="serial", exclude_self=True)
    return near.groupBy(X.length_bin(F.col("pred")).alias("bin")).agg(F.count("*").alias("n"), r9(F.avg("distance")).alias("mean_distance"), r9(F.min("distance")).alias("min_distance"))


@query
def open_set_threshold(spark, d):
    best = matching.top_k(V.predictions(spark, d), V.serials(spark, d), 1)
    return matching.open_set(best, 0.95).select("pred", "serial", "unregistered")


@query
def confidence_tiebreak(spark, d):
    """Of equally near serials, the one whose code is more frequent among parts comes first."""
    p = V.predictions(spark, d)
    freq = p.groupBy(F.col("gt").alias("serial")).agg(F.count("*").alias("freq"))
    best = matching.top_k(p, V.serials(spark, d), 5).join(freq, "serial")
    order = Window.partitionBy("pred").orderBy("distance", F.desc("freq"), "serial")
    return best.withColumn("r", F.row_number().over(order)).where("r = 1").select("pred", "serial", "freq")


@query
def space_error_rate(spark, d):
    p = V.predictions(spark, d)
    wrong = (X.space_key(F.col("pred")) == X.space_key(F.col("gt"))) & (F.col("pred") != F.col("gt"))
    return p.agg(F.count("*").alias("n"), F.count_if(wrong).alias("space_errors"), r9(metrics.share(wrong)).alias("rate"))


@query
def confusion_matrix(spark, d):
    return metrics.confusions(V.predictions(spark, d))


@query
def top_confusions(spark, d):
    """The most common substitutions by recogniser, the first eight of each."""
    found = None
    for model in ("small", "medium", "large"):
        one = metrics.confusions(V.recognisers(spark, d).where(F.col("model") == model)).withColumn("model", F.lit(model))
        found = one if found is None else found.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("n"), "gt_char", "pred_char"))
    return found.withColumn("rank", rank).where("rank <= 8")


@query
def overlap_counts(spark, d):
    """How many boxes are curved, multi-token and long at once."""
    b = V.boxes(spark, d)
    many, long = X.token_count(F.col("transcription")) > 1, F.length("transcription") > 15
    return b.agg(F.count_if(F.col("is_curved") & many & long).alias("all_three"), F.count_if(F.col("is_curved") & many).alias("curved_multi"), F.count_if(many & long).alias("multi_long"))


@query
def token_alone_or_inside(spark, d):
    """How often a token is a label by itself and how often it is part of a longer one."""
    p = V.parts(spark, d)
    tokens = p.select("label", F.explode(F.split("label", " ")).alias("token")).where("token <> ''")
    return tokens.groupBy("token").agg(F.count_if(F.col("label") == F.col("token")).alias("alone"), F.count_if(F.col("label") != F.col("token")).alias("inside"))


# Detection


def _pairs(spark, d):
    truth = V.boxes(spark, d)
    predicted = V.predicted_boxes(truth)
    return truth, predicted, D.box_pairs(truth, predicted)


@query
def iou_pairs(spark, d):
    return _pairs(spark, d)[2].where("iou >= 0.5").select("image", "gi", "pi", r9("iou").alias("iou"))


@query
def greedy_match(spark, d):
    return D.greedy_match(_pairs(spark, d)[2]).select("image", "gi", "pi")


def _truth(truth):
    return truth.select("image", F.col("box_index").alias("gi"), X.kind(F.col("is_curved")).alias("kind"), (F.col("x1") - F.col("x0")).alias("width"), X.token_bucket(F.col("transcription")).alias("tokens"))


@query
def det_metrics(spark, d):
    truth, predicted, pairs = _pairs(spark, d)
    out = D.metrics(_truth(truth), D.greedy_match(pairs), predicted)
    return out.select("kind", "gt", "tp", r9("recall").alias("recall"), r9("precision").alias("precision"), r9("hmean").alias("hmean"))


@query
def failure_taxonomy(spark, d):
    truth, _, pairs = _pairs(spark, d)
    return D.failure_taxonomy(_truth(truth), pairs, D.greedy_match(pairs))


@query
def recall_by_width(spark, d):
    truth, _, pairs = _pairs(spark, d)
    hit = _truth(truth).join(D.greedy_match(pairs).select("image", "gi", F.lit(1).alias("hit")), ["image", "gi"], "left")
    bin = F.floor(F.col("width") / 10).cast("int")
    return hit.groupBy(bin.alias("width_bin"), "tokens").agg(F.count("*").alias("gt"), r9(F.avg(F.coalesce("hit", F.lit(0)).cast("double"))).alias("recall"))


@query
def contain_assign(spark, d):
    truth, predicted, pairs = _pairs(spark, d)
    sides = V.with_corners(truth).withColumnRenamed("box_index", "gi"), V.with_corners(predicted).withColumnRenamed("pred_index", "pi")
    return D.containment(pairs, *sides).select("image", "gi", F.array_join(F.transform("pis", lambda x: x.cast("string")), ",").alias("pis"))


def _shapes(spark, d):
    """True and predicted outlines, some not convex, and their pairs by the kernel for polygons of any shape."""
    truth = V.with_shapes(V.boxes(spark, d))
    moved = [(F.col(c) + F.col(s)).alias(c) for c, s in (("x0", "dx"), ("y0", "dy"), ("x1", "dx"), ("y1", "dy"))]
    predicted = V.with_shapes(truth.where("found").select("image", F.col("box_index").alias("pred_index"), "is_curved", *moved))
    return truth, predicted, D.polygon_pairs(truth, predicted).withColumn("iou", F.round("iou", 9)).withColumn("inside", F.round("inside", 9))


@query
def shape_pairs(spark, d):
    return _shapes(spark, d)[2].where("iou >= 0.5").select("image", "gi", "pi", "iou", "inside")


@query
def shape_metrics(spark, d):
    truth, predicted, pairs = _shapes(spark, d)
    out = D.metrics(_truth(truth), D.greedy_match(pairs), predicted)
    return out.select("kind", "gt", "tp", r9("recall").alias("recall"), r9("precision").alias("precision"), r9("hmean").alias("hmean"), r9("precision_matched").alias("precision_matched"))


@query
def shape_containment(spark, d):
    truth, predicted, pairs = _shapes(spark, d)
    held = D.containment(pairs, truth.withColumnRenamed("box_index", "gi"), predicted.withColumnRenamed("pred_index", "pi"))
    return held.select("image", "gi", F.array_join(F.transform("pis", lambda x: x.cast("string")), ",").alias("pis"))


@query
def crop_sizes(spark, d):
    return V.with_corners(V.boxes(spark, d)).select("image", "box_index", G.crop_size(F.col("points")).alias("s")).select("image", "box_index", "s.w", "s.h")


@query
def token_merge_summary(spark, d):
    """How much of the true boxes their contained predictions cover, by token count."""
    truth, _, pairs = _pairs(spark, d)
    n = pairs.where("inside >= 0.5").groupBy("image", "gi").agg(F.count("*").alias("n"))
    rows = _truth(truth).join(n, ["image", "gi"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy("tokens").agg(F.count("*").alias("boxes"), r9(metrics.share(F.col("n") > 0)).alias("coverage"), r9(F.avg(F.col("n").cast("double"))).alias("avg_fragments"))


@query
def eval_targets(spark, d):
    """Images to evaluate: the test split, and those with curved boxes from any split."""
    rows = V.line_records(spark, d)
    assigned = V.assignment(rows)
    test, curved, train = assigned.where("split = 'test'").select("image"), rows.where("is_curved").select("image"), assigned.where("split = 'train'").select("image")
    every = test.union(curved).distinct()
    one = lambda name, df: df.agg(F.count("*").alias("images")).select(F.lit(name).alias("set"), "images")
    return one("test", test).union(one("with_curved", every)).union(one("from_train", every.intersect(train))).union(one("not_in_test", every.exceptAll(test.distinct())))


# Fragments


def _fragments(spark, d, policy="none"):
    f = V.predicted_boxes(V.boxes(spark, d)).withColumnRenamed("pred_index", "frag_index")
    flips = f.withColumn("cls_flip", F.col("frag_index") % 3 == 0).withColumn("score_fwd", F.col("x0") % 7).withColumn("score_bwd", F.col("y0") % 5)
    return grouping.box_geometry(flips.withColumn("flipped", grouping.resolve_flips(policy)))


@query
def link_pairs(spark, d):
    return grouping.link_pairs(_fragments(spark, d), 1.5)


@query
def flip_policy(spark, d):
    f, out = _fragments(spark, d), None
    for policy in ("none", "classifier", "confidence"):
        one = f.agg(F.count("*").alias("fragments"), F.count_if(grouping.resolve_flips(policy)).alias("flipped")).select(F.lit(policy).alias("policy"), "fragments", "flipped")
        out = one if out is None else out.unionByName(one)
    return out


@query
def fragment_groups(spark, d):
    """Groups of fragments in reading order, by a fold over each image's links."""
    members = grouping.groups(_fragments(spark, d), 1.5)
    return members.groupBy("image", "g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "frag_index"))), lambda x: x["frag_index"].cast("string")), ",").alias("members"))


@query
def link_sweep(spark, d):
    """How many fragments link as the allowed gap grows, under each flip policy: one plan over all combinations."""
    combos = sweep.grid(spark, policy=["none", "classifier", "confidence"], gap=[0.0, 0.3, 0.6, 1.0, 1.5, 2.0, 3.0])
    policies = combos.select("policy").distinct()
    flip = F.when(F.col("policy") == "none", grouping.resolve_flips("none")).when(F.col("policy") == "classifier", grouping.resolve_flips("classifier")).otherwise(grouping.resolve_flips("confidence"))
    f = grouping.box_geometry(_fragments(spark, d).crossJoin(F.broadcast(policies)).withColumn("flipped", flip))
    links = grouping.link_pairs(f.join(F.broadcast(combos.select("policy", "gap")), "policy"), F.col("gap"), ("policy", "gap"))
    return combos.join(links.groupBy("policy", "gap").agg(F.count("*").alias("links")), ["policy", "gap"], "left").select("policy", "gap", F.coalesce("links", F.lit(0)).alias("links"))


def _evaluated(items, combos, slices=("kind", "seen", "tokens")):
    """Coverage and retrieval of what was read, by combination and slice; an empty reading is no hit.

    Boxes that agree in all that counts are one row with their number.  ``combos`` are rows of the columns that name them,
    in the order of the bits of ``mask``.
    """
    by = tuple(combos[0])
    items = items.groupBy("mask", "detected", "pred", "rep", *slices).agg(F.count("*").alias("n"))
    items = Stored(items.sparkSession, "items").put(items, "items")
    h = matching.hits(items, matching.top_k(items, items.select(F.col("rep").alias("serial")), 5), 5, "nonempty")
    each = [F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.struct(*[F.lit(v).alias(c) for c, v in one.items()])) for k, one in enumerate(combos)]
    h = h.withColumn("_c", F.explode(F.array_compact(F.array(*each)))).select("*", *[F.col(f"_c.{c}").alias(c) for c in by])
    part = lambda flag: r9(F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).cast("double") / F.sum("n"))
    measures = {"n": F.sum("n"), "coverage": part("detected"), "top1": part("hit1"), "top5": part("hit5")}
    return metrics.sliced(h, measures, slices, by)


def _read_boxes(spark, d):
    """True boxes, their serials, and what is read in each region by its index."""
    boxes = V.with_corners(V.boxes(spark, d))
    truth = V.truth(boxes)
    readings = V.fragments(boxes).select("image", F.col("frag_index").alias("pi"), F.when(F.col("cls_flip"), F.col("text_bwd")).otherwise(F.col("text_fwd")).alias("text"), F.col("conf_fwd").alias("conf"))
    return truth, truth.select(F.col("rep").alias("serial")).distinct(), readings


@query
def end_to_end(spark, d):
    """Detection, matching, reading and retrieval in one: a box is detected if a region matches it."""
    truth, names, readings = _read_boxes(spark, d)
    items = Stored(spark, "items").put(evaluation.matched_items(truth.drop("points"), D.greedy_match(_pairs(spark, d)[2]), readings), "items")
    h = matching.hits(items, matching.top_k(items, names, 5), 5, "detected")
    measures = {"n": F.count("*"), "det_recall": r9(metrics.share(F.col("detected"))), "top1": r9(metrics.share(F.col("hit1"))), "top5": r9(metrics.share(F.col("hit5"))), **metrics.failures(F.col("detected"), F.col("hit5"))}
    return metrics.sliced(h, measures)


@query
def token_merge(spark, d):
    """Boxes read by the regions inside them, in reading order, and how well that retrieves their serials."""
    truth, names, readings = _read_boxes(spark, d)
    _, predicted, pairs = _pairs(spark, d)
    held = D.containment(pairs, truth, V.with_corners(predicted).withColumnRenamed("pred_index", "pi"))
    items = Stored(spark, "items").put(evaluation.contained_items(truth.drop("points"), held, readings), "items")
    h = matching.hits(items, matching.top_k(items, names, 5), 5, "nonempty")
    measures = {"n": F.count("*"), "coverage": r9(metrics.share(F.col("n_fragments") > 0)), "avg_fragments": r9(F.avg(F.col("n_fragments").cast("double"))), "top1": r9(metrics.share(F.col("hit1"))), "top5": r9(metrics.share(F.col("hit5")))}
    return metrics.sliced(h, measures)


@query
def model_comparison(spark, d):
    """Several recognisers on the same crops: accuracy and retrieval of each, by slice."""
    items = V.recognisers(spark, d)
    h = _sliceable(matching.hits(items, matching.top_k(items, V.serials(spark, d), 5), 5))
    measures = {"n": F.count("*"), "car": r9(F.avg(X.car(F.col("pred"), F.col("gt")))), "exact": r9(metrics.share(F.col("pred") == F.col("gt"))), "top1": r9(metrics.share(F.col("hit1"))), "top5": r9(metrics.share(F.col("hit5")))}
    return metrics.sliced(h, measures, ("kind", "seen"), ("model",))


COMBOS = [{"policy": p, "gap": g} for p in FLIP_POLICIES for g in (0.0, 1.5)]


def _grouped(spark, d, combos, keep, conf=False):
    """Readings of all combinations of a flip policy and a gap, in one pass over the images."""
    images = V.images(spark, d, sorted({c["policy"] for c in combos}), conf, keep)
    return evaluation.read_groups(images, [(c["policy"], c["gap"]) for c in combos], keep, conf=conf)


@query
def group_evaluation(spark, d):
    """Groups without ground truth: their hulls matched to the true boxes, their texts to the serials, for each policy and gap."""
    return _evaluated(_grouped(spark, d, COMBOS, ("rep", "kind", "seen", "tokens")), COMBOS)


@query
def group_archive(spark, d):
    """The best policy and gap by retrieval, its predictions archived and read again."""
    ranked = _evaluated(_grouped(spark, d, COMBOS, ("rep",)), COMBOS, ()).orderBy(F.desc("top5"), "policy", "gap").first()
    spark._jvm.System.gc()  # else the ranking's shuffle files stay beside those of the second pass
    best = _grouped(spark, d, [{"policy": ranked.policy, "gap": ranked.gap}], ("gt",), conf=True)
    store = Stored(spark, "archive")
    path = store.root
    sinks.archive(best.select(X.crop_name(F.col("image"), F.col("gi")).alias("crop"), "gt", "pred", F.col("conf").alias("char_confidences"), "mean_confidence"), path, "groups")
    store.until_exit()
    again = labels.read_archive(spark, path, "groups")
    return again.select("crop", "gt", "pred", F.size("char_confidences").alias("n_conf"), r9("mean_confidence").alias("mean_confidence"))


@query
def merge_evaluation(spark, d):
    """Grouping by geometry, narrow and wide, against wide groups that the serial set cuts."""
    keep = ("rep", "kind", "seen", "tokens")
    images = V.images(spark, d, ["none"], keep=keep)
    store = Stored(spark, "chains")
    chains = store.put(evaluation.chains(images, "none", CANDIDATE_GAP), "chains")
    names = V.truth(V.with_corners(V.boxes(spark, d))).select(F.col("rep").alias("serial")).distinct()
    names = store.put(names, "serials")  # read more than once
    cuts = store.put(evaluation.guided_cuts(chains, names), "cuts")
    items = evaluation.read_groups(images, [("none", 0.0), ("none", CANDIDATE_GAP)], keep, cuts)
    return _evaluated(items, [{"way": w} for w in ("narrow", "wide", "guided")])


@query
def fragment_groups_kernel(spark, d):
    """The same groups by the kernel for polygons of any kind."""
    f = V.predicted_boxes(V.boxes(spark, d))
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    points = F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))
    rows = grouping.group_fragments(f.select("image", F.col("pred_index").alias("frag_index"), points.alias("points"), F.lit(False).alias("flipped")), 1.5)
    gathered = rows.groupBy("image", "group_id").agg(F.min("frag_index").alias("g"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "frag_index"))), lambda x: x["frag_index"].cast("string")), ",").alias("members"))
    return gathered.select("image", "g", "members")


def _chains(spark, d):
    return V.predictions(spark, d).select(F.col("p_partkey").alias("chain_id"), F.filter(F.split("gt", " "), lambda t: t != "").alias("texts"))


@query
def chain_segments(spark, d):
    return merge.segments(_chains(spark, d))


@query
def segment_scores(spark, d):
    parts = merge.segments(_chains(spark, d)).select("text").distinct()
    return matching.top_k(parts, V.serials(spark, d), 1, prediction="text").select(F.col("pred").alias("text"), "serial", r9("score").alias("score"))


@query
def db_guided_merge(spark, d):
    scored = merge.segment_scores(merge.segments(_chains(spark, d)), V.serials(spark, d))
    return merge.best_partition(scored).select("chain_id", "seg", "i", "j", "text")


@query
def margin_sweep(spark, d):
    """Into how many parts chains are cut as joining gets dearer."""
    scored = merge.segment_scores(merge.segments(_chains(spark, d)), V.serials(spark, d))
    margins = sweep.grid(spark, margin=[0.0, 0.02, 0.05, 0.1, 0.2, 0.5, 0.9])
    cuts = merge.best_partition(scored.crossJoin(F.broadcast(margins)), F.col("margin"), ("chain_id", "margin"))
    return cuts.groupBy("margin").agg(F.count("*").alias("parts"), F.count_distinct("chain_id").alias("chains"))


@query
def ctc_collapse(spark, d):
    steps = V.table(spark, d, "events").select(F.col("user_id").alias("crop"), F.col("event_id").alias("t"), (F.col("event_id") * 7 % 4).cast("int").alias("idx"))
    return metrics.ctc_collapse(steps).groupBy("crop").agg(F.count("*").alias("kept"))


@query
def mean_confidence_char(spark, d):
    c = V.confidences(spark, d).groupBy((F.col("vec_id") % 50).alias("g")).agg(F.collect_list("conf").alias("c"))
    return c.select("g", F.round(X.mean_of_characters(F.col("c")), 6).alias("mean_confidence"))


@query
def mean_confidence_fragment(spark, d):
    c = V.confidences(spark, d).groupBy((F.col("vec_id") % 50).alias("g")).agg(F.collect_list("conf").alias("c"))
    return c.select("g", F.round(X.mean_of_fragments(F.col("c")), 6).alias("mean_confidence"))


# Sweeps, archive, estimates


@query
def param_grid(spark, d):
    return sweep.grid(spark, thresh=[0.2, 0.3], box_thresh=[0.5, 0.6], unclip_ratio=[1.5, 2.0, 3.0])


def _swept(spark, d):
    truth, predicted, pairs = _pairs(spark, d)
    combos = sweep.grid(spark, iou_floor=[0.3, 0.5, 0.7, 0.9], shift=[0.0, 0.05])
    rows = pairs.crossJoin(F.broadcast(combos)).where(F.col("iou") - F.col("shift") >= F.col("iou_floor"))
    image = F.struct("combo", "image").alias("image")
    matched = D.greedy_match(rows.select(image, "gi", "pi", "iou"), 0.0).select(F.col("image.combo").alias("combo"), F.col("image.image").alias("image"), "gi")
    n = combos.select("combo").crossJoin(predicted.agg(F.count("*").alias("n_pred")))
    return sweep.metrics(_truth(truth), matched, n, combos)


@query
def sweep_metrics(spark, d):
    rows = _swept(spark, d)
    return rows.select("combo", "iou_floor", "shift", *[r9(c).alias(c) for c in ("plane_recall", "curved_recall", "recall", "precision", "hmean")], "n_pred")


@query
def sweep_first(spark, d):
    """The five combinations with the best recall."""
    return sweep.first_rows(_swept(spark, d), 5).select("rank", "combo", r9("recall").alias("recall"))


@query
def constrained_pick(spark, d):
    return sweep.pick(_swept(spark, d), 0.3).select("combo", "iou_floor", "shift", r9("plane_recall").alias("plane_recall"))


@query
def sensitivity(spark, d):
    """What ten more points of detection or of recognition would be worth, from the measured shares."""
    h = _hits(spark, d, "detected")
    s = h.agg(metrics.share(F.col("detected")).alias("det"), (F.count_if("hit5") / F.count_if("detected")).alias("cond"))
    return s.select(r9("det").alias("det"), r9("cond").alias("cond"), r9((F.col("det") + 0.1) * F.col("cond")).alias("more_det"), r9(F.col("det") * (F.col("cond") + 0.1)).alias("more_cond"), r9(F.col("det") * CONDITIONAL_RECOGNITION).alias("estimate"))


@query
def exact_requirement(spark, d):
    """The exact rate p at which p + (1 - p) * top5 reaches 0.95."""
    return _hits(spark, d).agg(r9(X.safe_ratio(0.95 - matching.top_k_accuracy(F.col("hit5")), 1 - matching.top_k_accuracy(F.col("hit5")))).alias("required_exact"))


@query
def hash_sample(spark, d):
    return sweep.sample(V.line_records(spark, d), "image", 60)


@query
def archive_roundtrip(spark, d):
    """Predictions written to an archive and one run of it read again."""
    p = V.predictions(spark, d).join(V.confidences(spark, d), F.col("p_partkey") == F.col("vec_id"), "left").withColumn("conf", F.coalesce("conf", F.array().cast("array<double>")))
    rows = p.select(F.col("p_partkey").cast("string").alias("crop"), "gt", "pred", F.col("conf").alias("char_confidences"), X.mean_of_characters(F.array("conf")).alias("mean_confidence"))
    store = Stored(spark, "archive")
    path = store.root
    sinks.archive(rows, path, "run-a")
    sinks.archive(rows.withColumn("pred", F.lit("")), path, "run-b")
    store.until_exit()
    return labels.read_archive(spark, path, "run-a").select("crop", "gt", "pred", F.size("char_confidences").alias("n_conf"), F.round("mean_confidence", 6).alias("mean_confidence"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
