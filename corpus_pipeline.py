"""From raw documents to sampled token pieces, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
Null text is empty; a null id is a document's id like any other; repeated rows are one document where documents are
compared, and pass together; very long texts are taken whole; other columns pass through, whatever their names; no
rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import decontaminate, language_id, line_dedup, minhash, sentencepiece_sampling
from tagloom.llm.common import Stored
from tagloom.llm.queries import table, vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the evidence supports; those in none of them go.

    Texts that are null, empty or blank have no language.  Where no row has a usable label there is no language to
    find, and every document goes.
    """
    model = language_id.fit(docs, "lang")
    return language_id.accepted(docs, model, host=F.col("source"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that occur earlier; one of which nothing is left goes.

    A text that nothing is cut from stays as it is, null included; n_chars follows the text.
    """
    done = line_dedup.deduplicated(docs).where("n_removed = 0 or kept_text <> ''")
    changed = F.col("n_removed") > 0
    row = F.col("row")
    own = {"text": F.when(changed, F.col("kept_text")).otherwise(row["text"]), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(row["n_chars"])}
    return done.select(*[own.get(c, row.getField(c)).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Texts without words are no copies of each other; a null id is the smallest, and its rows stay.  Rows that share
    an id stay or go together.
    """
    return minhash.deduplicated(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; those without words hold none.

    Items without an id count; without items all documents stay.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document, and proof that they decode to its text.

    A text without characters has the piece of the leading space; rows equal in id and text have equal ids.
    """
    done = sentencepiece_sampling.sampled(docs, vocabulary("piece_bpe_32k.model"), keep=["doc_id"])
    return done.select("row.doc_id", "ids", "n_pieces", "ids_crc32", "decoded_sha256", "lossless")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_documents),
    ("decontaminate", remove_benchmarks),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # segmentations are sampled


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, store = table(spark, sf_dir, "documents"), Stored(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
