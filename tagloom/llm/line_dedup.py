"""Deletion of repeated runs of lines, by winnowing over line hashes.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, as_text, packed

RUN_LINES = 3

_FIRST = -(1 << 63)  # a null id comes first


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    value = as_text(docs, text)
    return packed(docs, id=F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_FIRST)), sum=F.md5(value), text=value)


def fingerprints(keyed: DataFrame, run: int = RUN_LINES) -> DataFrame:
    """Winnowing's choice for every window of ``run`` lines: id, sum, print, place and the windows around it.

    A window chooses its smallest line hash, at its rightmost occurrence.  Neighbouring windows mostly choose the
    same place, so there are about half as many rows as windows.  Equal windows choose alike, so every repeated
    run of ``run`` lines shares a fingerprint at the same place.  ``around`` extends it both ways: for each
    window that chose the place, how far above it starts and what it holds.
    """
    lines = keyed.select("id", "sum", F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= run)
    hashed = lines.withColumn("h", F.expr("transform(lines, x -> xxhash64(x))"))
    least = hashed.withColumn("low", F.expr(f"transform(sequence(0, size(h) - {run}), i -> array_min(slice(h, i + 1, {run})))"))
    places = F.expr(f"transform(low, (m, i) -> i + {run} - cast(array_position(reverse(slice(h, i + 1, {run})), m) as int))")
    placed = least.withColumn("places", places)
    # A place's windows are neighbours, as chosen places never go back; each group begins where the place is new.
    begins = F.expr("filter(sequence(0, size(places) - 1), i -> i = 0 or places[i] <> places[i - 1])")
    picked = F.expr(f"""transform(begins, (b, k) -> named_struct(
        'print', low[b],
        'place', places[b],
        'around', transform(sequence(b, if(k + 1 < size(begins), begins[k + 1], size(places)) - 1), i -> named_struct(
            'above', places[b] - i,
            'content', unhex(md5(array_join(slice(lines, i + 1, {run}), '\\n')))))))""")
    return placed.withColumn("begins", begins).select("id", "sum", F.inline(picked))


def repeated_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", run: int = RUN_LINES) -> DataFrame:
    """Maximal runs of lines to delete: id, sum (md5 of the text), first line and line after the last.

    Fingerprints at one position only are dropped by a count that Spark combines before the shuffle.  The
    positions of the others are joined: around each, every window that chose it is matched with the earliest
    position that has the same content as far above and below, so a group of n copies costs n rows and never
    n * n pairs.  Overlapping later windows grow together to maximal runs.  Both joins read stored tables on
    either side, so adaptive execution may split a fingerprint or a content that very many documents have.
    """
    store = Stored(docs.sparkSession, "lines")
    cut = store.put(fingerprints(_keyed(docs, id, text), run).distinct(), "fingerprints")
    at = F.struct("id", "sum", "place")
    prints = cut.groupBy("print").agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low <> high").select("print")
    matched = cut.join(store.put(prints, "prints"), "print", "left_semi").select("id", "sum", "place", F.inline("around"))
    matched = store.put(matched.select("id", "sum", "content", (F.col("place") - F.col("above")).alias("start")), "matched")
    where = F.struct("id", "sum", "start")
    classes = matched.groupBy("content").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last").select("content", "first")
    later = matched.join(store.put(classes, "classes"), "content").where(where > F.col("first")).select("id", "sum", "start")
    order = Window.partitionBy("id", "sum").orderBy("start")
    grown = later.withColumn("gap", F.coalesce((F.col("start") > F.lag("start").over(order) + run).cast("int"), F.lit(1)))
    grown = grown.withColumn("island", F.sum("gap").over(order))
    return grown.groupBy("id", "sum", "island").agg(F.min("start").alias("begin"), (F.max("start") + run).alias("end")).drop("island")


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", run: int = RUN_LINES) -> DataFrame:
    """Every row of ``docs`` as a struct ``row`` beside n_lines, n_removed, n_runs and the kept text.

    A run of ``run`` or more consecutive lines that also starts earlier (smaller id, then in the same document
    further up) is deleted, down to the last line that it shares; the earliest copy stays.  Lines end at line
    feeds and are compared whole, judged on the input and not on what is left.

    Null text is empty, and an empty text has one empty line.  A text of fewer than ``run`` lines stays.  A null
    id comes first.  Rows equal in id and text are one document and get the same result; rows equal in id alone
    are ordered by the md5 of their text.  No rows give no rows.  Other columns pass through in ``row``.
    """
    runs = repeated_runs(docs, id, text, run).groupBy("id", "sum").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"))
    joined = _keyed(docs, id, text).join(runs, ["id", "sum"], "left").withColumn("lines", F.split("text", "\n", -1))
    kept = F.expr("""flatten(transform(sequence(0, size(runs)), i -> slice(lines,
        if(i = 0, 0, get(runs, i - 1).end) + 1,
        if(i = size(runs), size(lines), get(runs, i).begin) - if(i = 0, 0, get(runs, i - 1).end))))""")
    joined = joined.withColumn("kept", F.when(F.col("runs").isNull(), F.col("lines")).otherwise(kept))
    return joined.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("kept_text"),
    )
