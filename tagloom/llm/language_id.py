"""Language identification by Bayesian fusion of text, markup, address and host evidence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, as_text, arrow, packed, raw, slices

SAMPLE_ROWS = 2000  # labelled rows, at most, that the text model is fitted on
SAMPLE_BYTES = 200_000  # rows longer than this are not taken into the sample
BUCKETS = 1 << 16
SMOOTHING = 0.5
TEXT_WEIGHT = 60  # trigrams that a text counts for at most: neighbouring ones aren't independent
HOST_STRENGTH = 20.0  # pseudo-counts that a parent's distribution lends its children
UNKNOWN = "und"
UNKNOWN_PRIOR = 0.01
MIN_CONFIDENCE = 0.5

#: Bytes as the model sees them: a-z for A-Z, a space for other ASCII, the rest as it is.
_SEEN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def _buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram at each position but the last two; -1 where it is blank."""
    if len(data) < 3:
        return np.empty(0, np.int64)
    seen = _SEEN[data].astype(np.uint32)
    code = seen[:-2] << np.uint32(16) | seen[1:-1] << np.uint32(8) | seen[2:]
    out = (code * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64)
    out[code == 0x202020] = -1
    return out


@dataclass
class Model:
    """Log chances of trigram buckets by language; the last row stands for blanks and counts nothing.

    The last column is the unknown language, in which all buckets are as likely."""

    languages: list[str]
    table: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> Model:
        languages = sorted(set(labels))
        counts = np.zeros((BUCKETS, len(languages)))
        for text, label in zip(texts, labels, strict=True):
            found = _buckets(np.frombuffer(text.encode(), np.uint8))
            counts[:, languages.index(label)] += np.bincount(found[found >= 0], minlength=BUCKETS)
        share = (counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS)
        table = np.concatenate([np.log(share), np.full((BUCKETS, 1), -np.log(BUCKETS))], axis=1)
        return cls([*languages, UNKNOWN], np.concatenate([table, np.zeros((1, table.shape[1]))]).astype(np.float32))

    def likelihoods(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log likelihoods (texts x languages), those of long texts scaled down to ``TEXT_WEIGHT`` trigrams."""
        out = np.zeros((len(at) - 1, len(self.languages)))
        bucket = _buckets(data)
        if not len(bucket):
            return out
        for end in at[1:]:
            bucket[max(end - 2, 0) : end] = -1  # these reach into the next text
        rows = self.table[bucket]
        full = np.flatnonzero((np.diff(at) > 0) & (at[:-1] < len(bucket)))
        out[full] = np.add.reduceat(rows, at[:-1][full], axis=0, dtype=np.float64)
        n = np.zeros(len(at) - 1)
        n[full] = np.add.reduceat((bucket >= 0).astype(np.float64), at[:-1][full])
        return out * np.minimum(1, TEXT_WEIGHT / np.maximum(n, 1))[:, None]


def fit(rows: DataFrame, label: str, text: str = "text", id: str = "doc_id", most: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``most`` labelled rows of usable length, as evenly many of each label as there are.

    Of each label those come first whose ids have the smallest hashes, then by a hash of the text; equal rows count once.
    Labels that are null or don't begin with two letters, and null, empty or longer texts, are not usable.  Without
    usable rows the model knows the unknown language only, and ``identify`` accepts nothing."""
    lang, words = F.lower(F.substring(F.trim(F.col(f"`{label}`").cast("string")), 1, 2)), F.col(f"`{text}`").cast("string")
    usable = rows.select(lang.alias("label"), F.struct(F.xxhash64(F.col(f"`{id}`").cast("string")).alias("h"), F.xxhash64(words).alias("t")).alias("at"), words.alias("text"))
    usable = usable.where(f"label rlike '^[a-z]{{2}}$' and octet_length(text) between 1 and {SAMPLE_BYTES}")
    # Counted by label and leading bits of the hash, so that only about ``most`` rows of each label meet to be ranked.
    keys = Stored(rows.sparkSession, "labelled").put(usable.select("label", "at").distinct().withColumn("lead", F.shiftright("at.h", 52)), "keys")
    upto = keys.groupBy("label", "lead").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(Window.partitionBy("label").orderBy("lead")))
    upto = upto.groupBy("label").agg(F.coalesce(F.min(F.when(F.col("n") >= most, F.col("lead"))), F.max("lead")).alias("upto"))  # 676 labels at most
    few = keys.join(F.broadcast(upto), "label").where("lead <= upto").select("label", "at")
    chosen = few.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("at"))).where(F.col("rank") <= most)
    chosen = chosen.orderBy("rank", "at", "label").limit(most)
    last = chosen.groupBy("label").agg(F.max("at").alias("last"))
    # Texts are read for the chosen rows only.
    sample = usable.join(F.broadcast(last), "label").where(F.col("at") <= F.col("last")).groupBy("label", "at").agg(F.any_value("text").alias("text"))
    sample = sample.orderBy("at", "label").limit(most).collect()
    return Model.fit([r.text for r in sample], [r.label for r in sample])


def host_of(address: Column) -> Column:
    return F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1))


def suffix_of(address: Column) -> Column:
    """The last label of the host, and the first part of the path if that is two letters."""
    path = F.lower(F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return F.concat_ws("/", F.regexp_extract(host_of(address), r"([^.]*)$", 1), path)


def declared_in(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2})", 1)


def visible(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[A-Za-z0-9#]+;", " ")


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: Column | str = "text", declared: Column | None = None, suffix: Column | None = None, host: Column | None = None) -> DataFrame:
    """One row for each of ``docs``: id, sum (md5 of the text), lang, confidence, accepted and the text's own guess.

    A language's score is the log of the text's likelihood, of the chance that such texts declare what this one
    declares, and of the host's prior.  Chances and priors are sums of the texts' posteriors over all rows, by
    language declared, by address suffix and by host; a host's prior leans on its suffix's, and that on the whole
    corpus's, with ``HOST_STRENGTH`` pseudo-counts; a row's own share is taken out first.  The sums are grouped
    aggregations that Spark combines before the shuffle; the rows that meet them hold scores and no texts.

    A row is accepted unless the unknown language wins or no language has ``MIN_CONFIDENCE``.  Of languages that
    tie the first by name wins, and any wins over the unknown one.  A very long text is read whole, and weighs
    no more than one of ``TEXT_WEIGHT`` trigrams.  Columns of any names may come; none but those given are read.  Null text is
    empty, and an empty or blank text has no evidence of its own: it is rejected.  Null evidence of any kind
    is the same as none.  A null id stays null.  Rows that repeat each get their result; no rows give no rows.
    """
    spark, names = docs.sparkSession, model.languages
    value = F.coalesce(F.col(f"`{text}`").cast("string") if isinstance(text, str) else text, F.lit(""))
    none = F.lit("")
    source = docs.select(
        F.col(f"`{id}`").cast("long").alias("id"),
        F.md5(value).alias("sum"),
        F.coalesce(F.when((d := F.lower(F.substring(F.trim(declared), 1, 2))).rlike("^[a-z]{2}$"), d), none).alias("declared") if declared is not None else none.alias("declared"),
        F.coalesce(suffix, none).alias("suffix") if suffix is not None else none.alias("suffix"),
        F.coalesce(host, none).alias("host") if host is not None else none.alias("host"),
        value.alias("text"),
    )
    sent = spark.sparkContext.broadcast(model)
    keep = ["id", "sum", "declared", "suffix", "host"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            scores = sent.value.likelihoods(*raw(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], _lists(scores), _lists(_posterior(scores + flat))], names=[*keep, "text_score", "own"])

    kinds = len(names)
    flat = np.log(np.array([(1 - UNKNOWN_PRIOR) / max(kinds - 1, 1)] * (kinds - 1) + [UNKNOWN_PRIOR]))
    store = Stored(spark, "language")
    scored = store.put(arrow(source, kernel, "id bigint, sum string, declared string, suffix string, host string, text_score array<double>, own array<double>"), "scores")
    sums = [F.coalesce(F.sum(F.col("own")[k]), F.lit(0.0)) for k in range(kinds)]
    whole = np.array(scored.agg(F.array(*sums)).first()[0])

    joined = scored
    if declared is not None:  # two letters or none: at most 677 rows
        joined = joined.join(F.broadcast(scored.groupBy("declared").agg(F.array(*sums).alias("d_sum"))), "declared")
    if suffix is not None or host is not None:
        # Stored, so that adaptive execution may split the rows of a host that very many have.
        joined = joined.join(store.put(scored.groupBy("suffix").agg(F.array(*sums).alias("s_sum")), "suffixes"), "suffix") if suffix is not None else joined
        joined = joined.join(store.put(scored.groupBy("suffix", "host").agg(F.array(*sums).alias("h_sum")), "hosts"), ["suffix", "host"]) if host is not None else joined
    has = [c for c in ("d_sum", "s_sum", "h_sum") if c in joined.columns]

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, text = _matrix(batch, "own", kinds), _matrix(batch, "text_score", kinds)
            given = {k: np.array([x != "" for x in batch.column(k).to_pylist()], bool)[:, None] for k in ("declared", "suffix", "host")}
            prior = np.repeat(((whole + 1) / (whole.sum() + kinds))[None, :], len(own), axis=0)
            for name, at in (("s_sum", "suffix"), ("h_sum", "host")):
                if name in has:
                    rest = np.maximum(_matrix(batch, name, kinds) - own, 0)
                    prior = np.where(given[at], (rest + HOST_STRENGTH * prior) / (rest.sum(axis=1, keepdims=True) + HOST_STRENGTH), prior)
            score = text + np.log(prior)
            if "d_sum" in has:
                rest, total = np.maximum(_matrix(batch, "d_sum", kinds) - own, 0), np.maximum(whole - own, 0)
                score = score + np.where(given["declared"], np.log((rest + 0.5) / (total + 0.5 * 677)), 0)
            post, bare = _posterior(score), (text == 0).all(axis=1)  # without evidence in the text, host and markup decide nothing
            label = lambda x: pa.array([UNKNOWN if b else names[k] for k, b in zip(x.argmax(axis=1), bare, strict=True)])  # noqa: B023, E731
            confidence = np.where(bare, 0.0, post.max(axis=1))
            keeps = ~bare & (post.argmax(axis=1) < kinds - 1) & (confidence >= MIN_CONFIDENCE)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sum"), label(post), pa.array(confidence), pa.array(keeps), label(own)], names=["id", "sum", "lang", "confidence", "accepted", "text_lang"])

    out = arrow(joined.select("id", "sum", "declared", "suffix", "host", "text_score", "own", *has), fuse, "id bigint, sum string, lang string, confidence double, accepted boolean, text_lang string")
    return out.withColumnRenamed("id", id)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(-1, width)


def _posterior(score: np.ndarray) -> np.ndarray:
    chance = np.exp(score - score.max(axis=1, keepdims=True))
    return chance / chance.sum(axis=1, keepdims=True)


def accepted(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", **evidence: Column) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts, with their own columns."""
    found = identify(docs, model, id, text, **evidence).where("accepted").select(F.col(id).alias("id"), "sum").distinct()
    keyed = packed(docs, k=F.col(f"`{id}`").cast("long"), s=F.md5(as_text(docs, text)))
    return keyed.join(found, F.col("k").eqNullSafe(F.col("id")) & (F.col("s") == F.col("sum")), "left_semi").select("row.*")
