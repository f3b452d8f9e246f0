"""Collapse of conversations logged as growing snapshots, and their rendering.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECE_TURNS = 256


def _turns(log: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct turns with two independent 64-bit codes that hold the turn number, so their order matters."""
    turns = log.select(F.col(f"`{conv}`").alias("conv"), F.coalesce(F.col(f"`{turn}`").cast("long"), F.lit(-1)).alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    turns = turns.where("conv is not null").distinct().withColumn("piece", F.floor(F.col("turn") / PIECE_TURNS))
    parts = ["turn", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return turns.withColumn("code1", F.xxhash64(F.lit(1), *parts)).withColumn("code2", F.xxhash64(F.lit(2), *parts))


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations that are no proper prefix of another one; of equal ones the smallest name.

    The rolling hash of a prefix is the exclusive-or of its turns' codes, with the number of turns.  It is
    summed up in two levels, piece by piece of ``PIECE_TURNS`` turn numbers and then within a piece, so no
    task sorts more than a piece of a long conversation.  Prefixes that many conversations share are made
    distinct before the join.
    """
    pieces = turns.groupBy("conv", "piece").agg(F.expr("bit_xor(code1)").alias("p1"), F.expr("bit_xor(code2)").alias("p2"), F.count("*").alias("pn"))
    order = Window.partitionBy("conv").orderBy("piece")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    heads = pieces.select(
        "conv", "piece",
        F.coalesce(F.expr("bit_xor(p1)").over(before), F.lit(0)).alias("b1"),
        F.coalesce(F.expr("bit_xor(p2)").over(before), F.lit(0)).alias("b2"),
        F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("bn"),
        F.lead("piece").over(order).isNull().alias("final"),
    )
    inner = Window.partitionBy("conv", "piece").orderBy("turn", F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolling = turns.select(
        "conv", "piece",
        F.expr("bit_xor(code1)").over(upto).alias("c1"),
        F.expr("bit_xor(code2)").over(upto).alias("c2"),
        F.row_number().over(inner).alias("cn"),
        F.lead("turn").over(inner).isNull().alias("ends"),
    ).join(heads, ["conv", "piece"])
    rolling = rolling.select("conv", F.expr("b1 ^ c1").alias("h1"), F.expr("b2 ^ c2").alias("h2"), (F.col("bn") + F.col("cn")).alias("n"), (F.col("ends") & F.col("final")).alias("whole"))
    key = ["h1", "h2", "n"]
    whole = pieces.groupBy("conv").agg(F.expr("bit_xor(p1)").alias("h1"), F.expr("bit_xor(p2)").alias("h2"), F.sum("pn").alias("n"))
    whole = whole.groupBy(*key).agg(F.min("conv").alias("conv"))
    return whole.join(rolling.where("not whole").select(*key).distinct(), key, "left_anti").select("conv", "n")


def formatted(log: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rendered pieces of the maximal conversations: conv_id, piece, n_turns, rendered.

    A conversation is its distinct (turn, role, text) rows in the order of turn, role, text.  One that is a
    proper prefix of another, or equal to one with a smaller name, is dropped.  A piece renders the turns
    whose numbers share a multiple of ``PIECE_TURNS``; pieces of a conversation, in order, are its whole text.

    Rows without a conversation's name are left out; a null turn number counts as -1; a null role or text
    renders as empty but differs from an empty one when prefixes are compared.  A marker inside a text gets a
    space after its bar.  A very long text is rendered whole, and a conversation of any length in pieces; only
    turns that share a number, or have none, are never parted.  Repeated rows count once.  Empty conversations
    don't exist; an empty table gives no rows.  Other columns are not read.
    """
    turns = _turns(log, conv, turn, role, text)
    kept = turns.join(maximal(turns).select("conv"), "conv", "left_semi")
    safe = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    line = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), safe, F.lit("<|im_end|>\n"))
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line"))))
    out = kept.groupBy("conv", "piece").agg(rows.alias("rows"))
    return out.select(F.col("conv").alias("conv_id"), "piece", F.size("rows").cast("long").alias("n_turns"), F.array_join(F.col("rows.line"), "").alias("rendered"))
