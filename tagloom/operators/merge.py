"""Re-assembly of chains of fragments on the evidence of the serial set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.checkpoints import Stored
from tagloom.config import EPSILON
from tagloom.functions.text import joined_text, without_spaces

from .matching import top_k

SLACK = 1e-6  # more than the ties of a chain's ends, ``EPSILON`` each, add up to

def segments(chains: DataFrame) -> DataFrame:
    """All contiguous parts [i, j) of each chain with their text; ``chains`` has chain_id and texts (an array)."""
    n = F.size("texts")
    cut = chains.select("chain_id", "texts", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).where(F.size("texts") > 0)
    cut = cut.select("chain_id", "texts", "i", F.explode(F.sequence(F.col("i") + 1, n)).alias("j"))
    return cut.select("chain_id", "i", "j", joined_text(F.slice("texts", F.col("i") + 1, F.col("j") - F.col("i"))).alias("text"))


def segment_scores(parts: DataFrame, serials: DataFrame) -> DataFrame:
    """Segments with the score of the nearest serial; equal texts are compared once."""
    best = top_k(parts, serials, 1, prediction="text").select(F.col("pred").alias("text"), "score")
    return parts.join(best, "text", "left").select("chain_id", "i", "j", "text", F.coalesce("score", F.lit(0.0)).alias("score"))


def deciding_scores(chains: DataFrame, serials: DataFrame, margin: float = 0.0) -> DataFrame:
    """What ``segment_scores`` gives, less most of the joined segments that ``best_partition`` can't take.

    A joined segment that is worth less than its fragments apart, by more than ties allow, is in no best cut; the fold
    passes it by whatever its score is.  So fragments are scored first.  Then only joined segments are compared that
    could be worth as much for their length beside the longest serial's, with serials near enough for it; one that
    finds none has the score 0.
    """
    store = Stored(chains.sparkSession, "segments")
    ones = segments(chains).where("j - i = 1")
    near = lambda rows, far=None: top_k(rows, serials, 1, prediction="text", far=far).select(F.col("pred").alias("text"), "score")
    score = F.coalesce("score", F.lit(0.0)).alias("score")
    ones = ones.join(near(ones), "text", "left").select("chain_id", "i", "text", score)
    apart = F.sort_array(F.collect_list(F.struct("i", "score", "text"))).alias("s")
    known = store.put(chains.join(ones.groupBy("chain_id").agg(apart), "chain_id").select("chain_id", "texts", "s"), "fragments")
    longest = [F.max(F.length(c)).alias(k) for k, c in (("most", F.upper("serial")), ("bare", without_spaces(F.upper("serial"))))]
    most, bare = serials.agg(*longest).first()
    held = known.select(F.col("chain_id"), F.transform("s", lambda x: x["score"] * F.length(without_spaces(x["text"]))).alias("w"), "texts")
    joined = segments(held.where(F.size("texts") > 1).select(F.struct("chain_id", "w").alias("chain_id"), "texts")).where("j - i > 1")
    size = F.length(without_spaces(F.col("text")))
    apart = F.expr("aggregate(slice(chain_id.w, i + 1, j - i), cast(0 as double), (a, x) -> a + x)")
    far = F.when(size > 0, 1 - margin - (apart - SLACK) / size).otherwise(F.lit(float("inf")))
    least = [1 - F.lit(float(m or 0)) / F.greatest(F.length(c), F.lit(1)) for m, c in ((most, F.upper("text")), (bare, without_spaces(F.upper("text"))))]
    joined = joined.select("chain_id.chain_id", "i", "j", "text", far.alias("far")).where(F.least(*least) <= F.col("far"))
    joined = store.put(joined, "joined")
    joined = joined.join(near(joined, "far"), "text", "left").select("chain_id", "i", "j", "text", score)
    ones = known.select("chain_id", F.explode("s").alias("s")).select("chain_id", "s.i", (F.col("s.i") + 1).alias("j"), "s.text", "s.score")
    return ones.unionByName(joined)


def best_partition(scored: DataFrame, margin: Column | float = 0.0, by: tuple[str, ...] = ("chain_id",)) -> DataFrame:
    """(chain_id, seg, i, j, text): the cut of each chain that its segments' evidence supports best.

    A segment is worth (score - margin if it joins fragments) times its characters other than spaces.  Of equally
    good cuts the finest is taken: a later start of the last segment wins ties within ``EPSILON``.
    A fold over the chain's ends inside the JVM; chains are lines of a few fragments.
    """
    joins = F.when(F.col("j") - F.col("i") > 1, margin if isinstance(margin, Column) else F.lit(float(margin))).otherwise(F.lit(0.0))
    worth = (F.col("score") - joins) * F.length(without_spaces(F.col("text")))
    rows = scored.withColumn("worth", worth).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("j", "i", "worth", "text"))).alias("s"))
    # best[k] is the best sum up to end k, from[k] the start of its last segment
    state = F.expr(f"""aggregate(s, named_struct('best', array(cast(0 as double)), 'from', array(cast(0 as int))),
        (acc, x) -> case
            when size(acc.best) <= x.j then named_struct('best', concat(acc.best, array(get(acc.best, x.i) + x.worth)), 'from', concat(acc.`from`, array(x.i)))
            when get(acc.best, x.i) + x.worth >= get(acc.best, x.j) - {EPSILON} then named_struct(
                'best', concat(slice(acc.best, 1, x.j), array(get(acc.best, x.i) + x.worth)),
                'from', concat(slice(acc.`from`, 1, x.j), array(x.i)))
            else acc end)""")
    rows = rows.select(*by, "s", state.alias("t"))
    cuts = F.expr("""filter(aggregate(sequence(1, size(t.`from`) - 1), array(size(t.`from`) - 1),
        (acc, x) -> if(acc[0] > 0, concat(array(get(t.`from`, acc[0])), acc), acc)), (x, k) -> true)""")
    rows = rows.select(*by, "s", cuts.alias("cuts"))
    rows = rows.select(*by, "s", F.posexplode(F.expr("transform(slice(cuts, 1, size(cuts) - 1), (c, k) -> named_struct('i', c, 'j', get(cuts, k + 1)))")).alias("seg", "c"))
    text = F.expr("filter(s, x -> x.i = c.i and x.j = c.j)[0].text")
    return rows.select(*by, "seg", F.col("c.i").alias("i"), F.col("c.j").alias("j"), text.alias("text"))
