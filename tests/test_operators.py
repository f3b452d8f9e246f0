import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.checkpoints import Stored
from tagloom.operators import graph, grouping, matching, merge, metrics, profile, serial_db, split, sweep
from tagloom.sources import config_tree, labels, sinks

from .test_evaluation import distance


def serials(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "serial string")


def texts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "pred string")


def test_space_loss_costs_nothing(spark):
    names = serials(spark, "QR 7 T", "QR 8 T", "Q R7T9")
    got = matching.top_k(texts(spark, "QR7T", "qr8 t"), names, 3).orderBy("pred", "rank").collect()
    assert [(r.pred, r.serial) for r in got if r.rank == 1] == [("QR7T", "QR 7 T"), ("qr8 t", "QR 8 T")] and got[0].score == 1.0 > got[1].score


@pytest.mark.parametrize("k", [1, 4])
def test_top_k_of_odd_texts(spark, k):
    """Empty, long, repeated and wide characters, against a plain table of distances."""
    rng = np.random.default_rng(6)
    words = ["", " ", "ß", "a" * 90, "A" * 70 + " b", "ééé", "x y z"] + ["".join(rng.choice(list("ab1 "), int(rng.integers(1, 14)))) for _ in range(60)]
    names = sorted({w for w in words[::2]})
    got = {}
    for r in matching.top_k(texts(spark, *words, *words[:5]), serials(spark, *names), k).collect():
        got.setdefault(r.pred, []).append((r.rank, r.serial, round(r.distance, 9)))
    for w in set(words):
        order = sorted((round(distance(w, n), 9), n.upper().encode(), n) for n in names)[:k]
        assert [(s, d) for _, s, d in sorted(got[w])] == [(n, d) for d, _, n in order]


def test_top_k_ties_and_self_lookup(spark):
    names = serials(spark, "BB", "AA", "CC", "aa")
    best = matching.top_k(texts(spark, "XX"), names, 3).orderBy("rank").collect()
    assert [b.serial for b in best] == ["AA", "aa", "BB"]
    own = matching.top_k(names.withColumnRenamed("serial", "pred"), names, 1).collect()
    assert all(r.score == 1.0 for r in own)


def test_top_k_over_many_blocks(spark, monkeypatch):
    names = spark.range(90).select(F.concat(F.lit("P"), F.col("id") * 37).alias("serial"))
    preds = spark.range(30).select(F.concat(F.lit("P"), F.col("id") * 41).alias("pred"))
    one = {(r.pred, r.rank): (r.serial, r.distance) for r in matching.top_k(preds, names, 4).collect()}
    monkeypatch.setattr(matching, "SERIALS_IN_BLOCK", 7)
    monkeypatch.setattr(matching, "PREDICTIONS_IN_SLICE", 3)
    assert one == {(r.pred, r.rank): (r.serial, r.distance) for r in matching.top_k(preds, names, 4).collect()}


def test_gates(spark):
    """What a hit needs: nothing, some text, or a detection; an empty reading is as near to a blank serial as can be."""
    items = spark.createDataFrame([("", " ", False), ("", " ", True), ("MU 3", "MU 3", True), ("MU3", "MU 3", False), ("NU", "MU 3", True)], "pred string, rep string, detected boolean")
    best = matching.top_k(items, serials(spark, " ", "MU 3", "NU 44"), 1)
    counts = {g: matching.hits(items, best, 1, g).where("hit1").count() for g in ("none", "nonempty", "detected")}
    assert counts == {"none": 4, "nonempty": 2, "detected": 2}
    with pytest.raises(ValueError):
        matching.hits(items, best, 1, "read")


def test_canonical(spark):
    """The most frequent spelling of a key stands for it; of equally frequent ones the first."""
    rows = spark.createDataFrame([(x,) for x in ["V 9", "V9", "V 9", "v9", "W W", "WW", "Q"]], "label string")
    named = serial_db.canonical(rows)
    assert {r.label: (r.rep, r.freq) for r in named.collect()} == {"V 9": ("V 9", 2), "V9": ("V 9", 1), "v9": ("V 9", 1), "W W": ("W W", 1), "WW": ("W W", 1), "Q": ("Q", 1)}
    assert {r.key: r.spellings for r in serial_db.variants(rows).collect()} == {"V9": ["V 9", "V9", "v9"], "WW": ["W W", "WW"]}
    with pytest.raises(Exception, match="no canonical spelling"):
        serial_db.require_canonical(spark.createDataFrame([("unknown",)], "gt string"), named, "gt").collect()


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 6), (7, 7), (None, 1)], "a int, b int")
    assert {r.node: r.component for r in graph.components(edges, Stored(spark, "t")).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in graph.components(chain, Stored(spark, "t")).collect()} == {0}
    assert graph.components(edges.limit(0), Stored(spark, "t")).count() == 0


def test_split_laws(spark):
    sizes = spark.range(200).select(F.col("id").alias("component"), (F.col("id") % 4 + 1).alias("size"), F.when(F.col("id") % 9 == 0, 1).otherwise(0).alias("n_curved"))
    out = split.assign(sizes).join(sizes, "component")
    by = {r.split: (r.n, r.c) for r in out.groupBy("split").agg(F.sum("size").alias("n"), F.sum("n_curved").alias("c")).collect()}
    total = sum(n for n, _ in by.values())
    assert out.count() == 200 and all(abs(by[s][0] / total - r) < 0.02 for s, r in (("train", 0.8), ("val", 0.1), ("test", 0.1)))
    assert all(c > 0 for _, c in by.values())
    folds = split.curved_folds(sizes).groupBy("fold").count().collect()
    assert max(f["count"] for f in folds) - min(f["count"] for f in folds) <= 2
    assert split.assign(sizes).orderBy("component").collect() == split.assign(sizes).orderBy("component").collect()


def cuts(spark, score, margin=0.0, chain=("KX", "70", "LR5", "9")):
    parts = merge.segments(spark.createDataFrame([(1, list(chain))], "chain_id int, texts array<string>"))
    return [(r.i, r.j) for r in merge.best_partition(parts.withColumn("score", score), margin).orderBy("seg").collect()]


def test_best_partition(spark):
    """The cut whose segments the evidence supports best, by length; equal evidence joins nothing."""
    t, alone = F.col("text"), [(0, 1), (1, 2), (2, 3), (3, 4)]
    for equal in (0.0, 0.35, 1.0):
        assert cuts(spark, F.lit(equal)) == alone
    assert cuts(spark, F.when(t == "70 LR5", 0.9).otherwise(0.4)) == [(0, 1), (1, 3), (3, 4)]
    assert cuts(spark, F.when(t.isin("KX 70", "70 LR5 9"), 0.9).otherwise(0.4)) == [(0, 1), (1, 4)]
    assert cuts(spark, F.when(t == "KX 70 LR5 9", 0.8).otherwise(0.7)) == [(0, 4)]
    assert cuts(spark, F.when(t == "KX 70 LR5 9", 0.8).otherwise(0.7), 0.15) == alone
    assert cuts(spark, F.lit(0.5), chain=("A",)) == [(0, 1)] and cuts(spark, F.lit(0.5), chain=()) == []


def test_slices_and_failures(spark):
    items = spark.createDataFrame([("plane", False, False), ("plane", True, False), ("plane", True, True)], "kind string, detected boolean, hit boolean")
    rows = {(r.slice, r.value): r for r in metrics.sliced(items, {"n": F.count("*"), **metrics.failures(F.col("detected"), F.col("hit"))}, ("kind",)).collect()}
    r = rows["overall", "all"]
    assert (r.fail_detection, r.fail_recognition, r.hits) == (1, 1, 1) and r.n == 3
    assert ("kind", "curved") not in rows
    wanted = spark.createDataFrame([("overall", "all"), ("kind", "plane"), ("kind", "curved")], "slice string, value string")
    every = {(r.slice, r.value): r.n for r in metrics.sliced(items, {"n": F.count("*")}, ("kind",), expected=wanted).collect()}
    assert every == {("overall", "all"): 3, ("kind", "plane"): 3, ("kind", "curved"): None}


def test_ctc(spark):
    steps = spark.createDataFrame([("a", t, i) for t, i in enumerate([0, 1, 1, 0, 1, 2, 2])], "crop string, t int, idx int")
    assert [r.idx for r in metrics.ctc_collapse(steps).orderBy("t").collect()] == [1, 1, 2]


def test_pick(spark):
    """The best row above the floor, the first of equal ones."""
    rows = spark.createDataFrame([(0, 0.31, 0.2), (1, 0.44, 0.5), (2, 0.44, 0.7), (3, 0.12, 1.0)], "combo int, plane_recall double, precision double")
    assert [sweep.pick(rows, floor).first().combo for floor in (0.0, 0.5, 0.6, 0.71)] == [1, 1, 2, 3] and sweep.pick(rows, 1.01).count() == 0
    assert [tuple(r) for r in sweep.grid(spark, a=[1, 2], b=["x", "y"]).collect()] == [(0, 1, "x"), (1, 1, "y"), (2, 2, "x"), (3, 2, "y")]


def test_flips(spark):
    f = spark.createDataFrame([(True, 0.5, 0.5, "ab", "ba")], "cls_flip boolean, score_fwd double, score_bwd double, text_fwd string, text_bwd string")
    f = f.withColumn("conf_fwd", F.array(F.lit(0.5))).withColumn("conf_bwd", F.array(F.lit(0.6)))
    assert [grouping.with_reading(f, p).first().text for p in ("none", "classifier", "confidence")] == ["ab", "ba", "ab"]
    with pytest.raises(ValueError):
        grouping.resolve_flips("other")


def test_label_files(spark, tmp_path):
    path = str(tmp_path)
    (tmp_path / "labels.txt").write_text('p/q 1.jpg\t[{"transcription": "one\\ttwo", "points": [[1,1],[5,1],[6,3],[5,4],[1,4]], "difficult": true}, {"transcription": "", "points": []}]\n \nr.jpg\t[]\n')
    box = labels.read_labels(spark, f"{path}/labels.txt").orderBy("box_index").collect()
    assert [(b.image, b.transcription, b.difficult, b.is_curved, b.n_points) for b in box] == [("p/q 1.jpg", "one\ttwo", True, True, 5), ("p/q 1.jpg", "", False, False, 0)]
    for broken in ("r.jpg\t[{]\n", "no tab here\n"):
        (tmp_path / "broken.txt").write_text(broken)
        with pytest.raises(Exception):
            labels.read_labels(spark, f"{path}/broken.txt").collect()
    (tmp_path / "rec.txt").write_text("k.jpg\t \"two  words\"\n")
    assert labels.read_recognition_labels(spark, f"{path}/rec.txt").first().label == ' "two  words"'
    assert sinks.write_dictionary(spark.createDataFrame([("z",), ("ß",), (" ",)], "char string"), f"{path}/dict") == 3
    assert [r.char for r in labels.read_dictionary(spark, f"{path}/dict").collect()] == [" ", "z", "ß"]


def test_archive(spark, tmp_path):
    row = spark.createDataFrame([("k", "T-4", "7-4", [0.25, 0.5], 0.375)], "crop string, gt string, pred string, char_confidences array<double>, mean_confidence double")
    for run in ("one", "two"):
        sinks.archive(row.withColumn("pred", F.lit(run)), f"{tmp_path}/a", run)
    assert [(r.pred, r.char_confidences) for r in labels.read_archive(spark, f"{tmp_path}/a", "two").collect()] == [("two", [0.25, 0.5])]
    for missing in sinks.REQUIRED:
        with pytest.raises(ValueError, match=missing):
            sinks.archive(row.drop(missing), f"{tmp_path}/a", "three")


def jpeg(width, height, end=b"\xff\xd9"):
    frame = b"\xff\xc0\x00\x11\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes(10)
    return b"\xff\xd8\xff\xe0\x00\x04ab" + frame + b"\xff\xda\x00\x04ab" + b"scan" * 5 + end


def test_images(spark, tmp_path):
    """A file is sound if its segments lead to a scan and it ends as it should; its hash is taken anyway."""
    whole = jpeg(640, 480)
    files = {"a.jpg": whole, "cut.jpg": whole[:-12], "open.jpg": jpeg(8, 8, b""), "text.jpg": b"none", "bad.jpg": whole.replace(b"\xff\xe0\x00\x04", b"\xff\xe0\xff\xff")}
    (tmp_path / "img").mkdir()
    for name, body in files.items():
        (tmp_path / "img" / name).write_bytes(body)
    found = {r.image: (r.width, r.height, r.corrupt) for r in labels.read_images(spark, f"{tmp_path}/img").collect()}
    assert found == {n: (640, 480, False) if n == "a.jpg" else (None, None, True) for n in files}


def test_split_files(spark, tmp_path):
    """Files of each split in the order of its list, however the rows came."""
    boxes = spark.createDataFrame([(f"{k:02d}.jpg", j, f"t{j}", [[0.0, 0.0]], False) for k in range(30) for j in (1, 0)], "image string, box_index int, transcription string, points array<array<double>>, difficult boolean").repartition(7)
    records = boxes.select("image", F.concat("image", F.col("box_index")).alias("crop"), F.col("transcription").alias("label"))
    assignment = boxes.select("image").distinct().withColumn("split", F.when(F.substring("image", 2, 1) < "7", "train").otherwise("test"))
    sinks.write_split_files(boxes, records, assignment, str(tmp_path / "s"))
    for split in ("train", "test"):
        det = [line for f in sorted((tmp_path / "s" / "det" / f"split={split}").glob("part*")) for line in f.read_text().splitlines()]
        rec = [line for f in sorted((tmp_path / "s" / "rec" / f"split={split}").glob("part*")) for line in f.read_text().splitlines()]
        names = [line.split("\t")[0] for line in det]
        assert names == sorted(r.image for r in assignment.where(F.col("split") == split).collect())
        assert [line.split("\t")[0] for line in rec] == [f"{n}{j}" for n in names for j in (0, 1)] and all('"t0"' in line.split('"t1"')[0] for line in det)


def test_stored_serials_and_reports(spark, tmp_path):
    named = serial_db.canonical(spark.createDataFrame([("x 1",), ("x1",), ("x1",)], "label string"))
    with pytest.raises(Exception):
        labels.read_serials(spark, f"{tmp_path}/db")
    sinks.write_tables(f"{tmp_path}/db", {"tag": "t"}, serials=named)
    assert {(r.label, r.rep) for r in labels.read_serials(spark, f"{tmp_path}/db").collect()} == {("x 1", "x1"), ("x1", "x1")}
    assert spark.read.parquet(f"{tmp_path}/db/metadata").first().metadata == {"tag": "t"}
    gate = spark.createDataFrame([(3, False)], "missing int, passed boolean")
    text = sinks.report("Assets", spark.createDataFrame([(1, None)], "a int, b string"), gate)
    assert "**FAIL**" in text and "- missing: 3" in text and "| 1 |  |" in text


def test_sorted_and_most_common(spark):
    rows = spark.createDataFrame([(x,) for x in "banana"] + [(None,)], "char string").repartition(3)
    assert [r.char for r in profile.sorted_list(rows, "char").collect()] == ["a", "b", "n"]
    counts = rows.where("char is not null").groupBy("char").agg(F.count("*").alias("n"))
    assert [r.char for r in profile.most_common(counts, "char", 2).collect()] == ["a", "n"]
    assert [(r["rank"], r.combo) for r in sweep.first_rows(spark.createDataFrame([(0, 0.2), (1, 0.9), (2, 0.9)], "combo int, recall double"), 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_percentiles(spark):
    values = [float(v) for v in np.random.default_rng(2).integers(0, 40, 301)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    got = profile.percentiles(df, F.col("v"), {"a": 0.05, "b": 0.5, "c": 0.95, "d": 0.333, "e": 1.0}).first()
    assert np.allclose(list(got), np.quantile(values, [0.05, 0.5, 0.95, 0.333, 1.0]))
    assert profile.percentiles(df.limit(0), F.col("v"), {"a": 0.5}).first().a is None


def test_shared_folder():
    from tagloom import checkpoints

    class Conf(dict):
        pass

    assert checkpoints.shared_dir(type("S", (), {"conf": Conf({"spark.master": "local[2]"})})()) == checkpoints.LOCAL_DIR
    assert checkpoints.shared_dir(type("S", (), {"conf": Conf({"spark.master": "spark://h:1", "spark.checkpoint.dir": "hdfs:///c/"})})()) == "hdfs:///c"
    for master in ("spark://h:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            checkpoints.shared_dir(type("S", (), {"conf": Conf({"spark.master": master})})())


def test_detection_cache(spark):
    cache = spark.createDataFrame([("a", [[[0.0, 0.0]]], ["x"], [[0.1]], [0.5], ["y"], [[0.2]], [0.6], [True]), ("b", None, None, None, None, None, None, None, None)], labels.DETECTIONS)
    assert labels.fragments(cache).count() == 1
    with pytest.raises(ValueError):
        labels.fragments(cache, cache)


def test_cache_round_trip(spark, tmp_path):
    rows = [("a", k, [[0.0, float(k)]], f"f{k}", [0.5], 0.5, f"b{k}", [0.25], 0.25, k == 1) for k in (1, 0, 2)]
    pieces = spark.createDataFrame(rows, "image string, frag_index int, points array<array<double>>, text_fwd string, conf_fwd array<double>, score_fwd double, text_bwd string, conf_bwd array<double>, score_bwd double, cls_flip boolean")
    sinks.write_detections(pieces, f"{tmp_path}/cache")
    again = labels.fragments(spark.read.schema(labels.DETECTIONS).parquet(f"{tmp_path}/cache"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, pieces.collect()))


def test_config_tree():
    template = {"Global": {"use_gpu": False, "seed": 3}, "Optimizer": {"lr": 0.1}, "Other": {"x": 1}}
    tree = config_tree.overlaid(template, config_tree.detection_settings("/d/", "w", "out", epochs=7))
    assert tree["Global"] | {"seed": 3, "epoch_num": 7, "use_gpu": True} == tree["Global"] and tree["Other"] == {"x": 1}
    assert tree["Optimizer"] == {"lr": {"learning_rate": 1e-4}} and tree["Eval"]["dataset"]["label_file_list"] == ["/d/labels/det_val.txt"]
    assert template == {"Global": {"use_gpu": False, "seed": 3}, "Optimizer": {"lr": 0.1}, "Other": {"x": 1}}
    assert "test" not in str(tree["Train"]) + str(tree["Eval"])


def test_streaming_rescore(spark, tmp_path):
    from tagloom.streaming.rescore import rescore

    rows = spark.createDataFrame([("c1", "OM77"), ("c1", "OM77"), ("c2", "ON 7")], "crop string, pred string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    rescore(stream, serials(spark, "OM 77", "ON 77"), str(tmp_path / "out"), str(tmp_path / "ck"), 1).awaitTermination()
    assert {(r.crop, r.serial) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("c1", "OM 77"), ("c2", "ON 77")}


def test_outputs_are_attached_by_crop(spark):
    records = spark.createDataFrame([("a", "X"), ("b", "Y")], "crop string, gt string")
    outputs = spark.createDataFrame([("b", "y", [0.5, 0.7], 0.6), ("a", "", [], 0.0)], "crop string, text string, char_confidences array<double>, score double")
    assert {r.crop: (r.pred, round(r.mean_confidence, 9)) for r in metrics.attach_outputs(records, outputs).collect()} == {"a": ("", 0.0), "b": ("y", 0.6)}
    for broken in (outputs.where("crop = 'a'"), outputs.withColumn("score", F.lit(0.9))):
        with pytest.raises(Exception):
            metrics.attach_outputs(records, broken).collect()
