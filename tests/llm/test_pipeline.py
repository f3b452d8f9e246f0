from pyspark.sql import functions as F

from tagloom.llm import decontaminate, line_dedup, minhash
from tagloom.llm.common import Stored

from ..conftest import DATA
from .test_near_duplicates import brute
from .test_text_operators import brute_contamination, brute_lines


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    columns, frames, store = docs.columns, [docs], Stored(spark, "test")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frames.append(store.put(stage(spark, frames[-1], DATA), "stage"))
        assert frames[-1].columns == columns
    named, lines, groups, clean = frames[1:]
    assert named.count() == docs.count()
    want = brute_lines([(r.doc_id, r.text) for r in named.collect()], line_dedup.RUN_LINES)
    assert {r.doc_id: r.text for r in lines.collect()} == {i: kept for (i, _), (_, gone, kept) in want.items() if not gone or kept}
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    want = {int(i) for i, _, _, kept in brute([(r.doc_id, r.text) for r in lines.collect()], *minhash.SIMILARITY) if kept}
    assert {r.doc_id for r in groups.collect()} == want
    want = {r.doc_id for r in groups.collect() if not brute_contamination(r.text, items, decontaminate.WINDOW_WORDS)[1]}
    assert {r.doc_id for r in clean.collect()} == want
    done = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in done} == want and all(r.lossless for r in done)


def test_stages_on_odd_rows(spark, odd):
    """Nulls, repeated rows, long texts, no rows and foreign columns: each stage keeps what its docstring says."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    odd = odd.withColumn("n_chars", F.length("text").cast("long")).withColumn("a.b", F.lit(1)).withColumn("c`d e", F.lit(2))
    english = odd.withColumn("lang", F.when(F.col("doc_id") == 7, "fr").otherwise("en"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, odd.limit(0), DATA)
        assert none.columns == odd.columns and none.count() == 0
    key = lambda r: (str(r.doc_id), r.text or "")
    every = sorted(map(key, odd.collect()))
    assert stages["language_id"](spark, odd, DATA).count() == 0  # no usable label
    kept = sorted(map(key, stages["language_id"](spark, english, DATA).collect()))
    assert set(kept) < set(every) and not any(t.strip() == "" for _, t in kept) and kept.count(("1", "a b c d e f g h")) in (0, 2)
    want = brute_lines([(r.doc_id, r.text) for r in odd.collect()], line_dedup.RUN_LINES)
    lines = stages["line_dedup"](spark, odd, DATA).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in lines) == sorted((str(r.doc_id), want[-(2**63) if r.doc_id is None else r.doc_id, r.text or ""][2]) for r in odd.collect())
    assert all((r.n_chars or 0) == len(r.text or "") for r in lines) and any(r.text is None for r in lines)
    groups = sorted(map(key, stages["minhash_dedup"](spark, odd, DATA).collect()))
    good = {i for i, _, _, kept in brute([(r.doc_id, r.text) for r in odd.collect()], *minhash.SIMILARITY) if kept}
    assert groups == sorted(key(r) for r in odd.collect() if r.doc_id is None or str(r.doc_id) in good)
    assert sorted(map(key, stages["decontaminate"](spark, odd, DATA).collect())) == every
    done = stages["sentencepiece"](spark, odd, DATA)
    assert done.count() == odd.count() and done.where("lossless").count() == odd.count() and stages["sentencepiece"](spark, odd.limit(0), DATA).count() == 0
