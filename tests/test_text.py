from pyspark.sql import functions as F

from tagloom.config import CONFUSABLE_PAIRS
from tagloom.functions import text as X
from tagloom.functions.alignment import confusion_pairs

# Pairs of real codes that must never meet.
CODES = [("8135", "B13S"), ("83", "B3"), ("205", "20S"), ("(5)", "(S)"), ("8165", "B16S"), ("501", "S01"), ("925", "92S"), ("P1", "PI"), ("L85", "LB5"), ("628", "6Z8"), ("165", "16S"), ("ST035", "ST03S")]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_codes_stay_apart(spark):
    rows = spark.createDataFrame(CODES, "a string, b string")
    out = rows.select(X.car(F.col("a"), F.col("b")).alias("car"), (X.space_key(F.col("a")) == X.space_key(F.col("b"))).alias("met")).collect()
    assert all(r.car < 1 and not r.met for r in out)
    for a, b in CONFUSABLE_PAIRS:
        assert value(spark, X.car(F.lit(f"A{a}C"), F.lit(f"A{b}C"))) < 1


def test_case_is_folded_and_nothing_else(spark):
    assert value(spark, X.car(F.lit("abc-1"), F.lit("ABC-1"))) == 1.0
    assert value(spark, X.car(F.lit(""), F.lit(""))) == 1.0
    assert value(spark, X.normalize_text(F.lit(" nav-d "))) == " NAV-D "


def test_token_spans(spark):
    spans = value(spark, X.token_spans(F.lit("8196 P32")))
    assert [tuple(s) for s in spans] == [("8196", 0, 4), ("P32", 5, 8)]
    for text in (" a  bc ", "", " "):
        spans = value(spark, X.token_spans(F.lit(text)))
        assert [s.token for s in spans] == text.split(" ") if "" not in text.split(" ") else [t for t in text.split(" ") if t] == [s.token for s in spans]
        assert all(text[s.start : s.end] == s.token for s in spans)


def test_length_bins_partition(spark):
    rows = spark.range(0, 43).select(F.col("id"), X.length_bin(F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("b")).collect()
    assert {r.b is None for r in rows if r.id in (0, 41, 42)} == {True}
    assert all(r.b is not None for r in rows if 1 <= r.id <= 40)


def test_mean_confidences_differ(spark):
    parts = F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0)))
    assert abs(value(spark, X.mean_of_characters(parts)) - 2 / 3) < 1e-12
    assert value(spark, X.mean_of_fragments(parts)) == 0.75
    empty = F.array().cast("array<array<double>>")
    assert value(spark, X.mean_of_characters(empty)) == 0.0 and value(spark, X.mean_of_fragments(empty)) == 0.0


def test_confusions():
    assert confusion_pairs("B13S", "8135") == [("8", "B"), ("5", "S")]
    assert confusion_pairs("ADC", "ACC") == [] and confusion_pairs("A1CX", "A1C") == []
    assert confusion_pairs("IABC", "1AB") == [("1", "I")]
    assert confusion_pairs("O", "0") == [("0", "O")] and confusion_pairs("0", "O") == [("O", "0")]
    assert confusion_pairs("A1BC", "AIC") == [("I", "B")]


def test_edit_distances(spark):
    import numpy as np

    from tagloom.functions.editdistance import distances

    rng = np.random.default_rng(0)
    words = ["", "a", "ü·x", "A1BC", "x" * 64, "ab" * 32, "ab" * 40, "😀b" * 45] + ["".join(rng.choice(list("abc·1 "), int(n))) for n in rng.integers(0, 90, 40)]
    rows = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(words) for j, b in enumerate(words)], "i int, j int, a string, b string")
    want = np.zeros((len(words), len(words)), int)
    for r in rows.select("i", "j", F.levenshtein("a", "b").alias("d")).collect():
        want[r.i, r.j] = r.d
    assert (distances(words, words) == want).all()
    assert distances([], words).shape == (0, len(words))
