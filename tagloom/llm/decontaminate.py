"""Benchmark decontamination with one Aho-Corasick automaton over the normalised items.

Any ``window`` consecutive words of an item hold a whole one of the blocks of half as many words that the item
is cut into, so the automaton spells each item once: its blocks, and whole items that are shorter than a window.
Where a block occurs in a text, the windows around it are looked up whole among the items' windows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, arrow, as_text, packed, slices, with_row

WINDOW_WORDS = 10
SHARD_BYTES = 2 << 20  # of item words in one automaton, which takes about 100 times that; larger benchmarks take several passes
PIECE_WORDS = 2048  # windows of an item that stay together; longer items are dealt in pieces

#: A-Z becomes a-z; other ASCII bytes that are not letters or digits become a space; the rest stays, one byte for one.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else 32 if b <= 47 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))

RESULT = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, contaminated boolean, spans array<struct<start:bigint,end:bigint>>"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
_NAMES = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"]

Items = set[str | None]


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Matcher:
    """The windows of ``pieces`` (item, words joined by spaces) and the automaton of their blocks."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int = WINDOW_WORDS):
        self.window, self.block = window, (window + 1) // 2
        self.whole: dict[bytes, Items] = {}  # items of fewer words
        self.windows: dict[bytes, Items] = {}
        blocks: set[bytes] = set()
        for item, text in pieces:
            words = text.split(b" ")
            if len(words) < window:
                self.whole.setdefault(text, set()).add(item)
                blocks.add(text)
                continue
            for k in range(len(words) - window + 1):
                self.windows.setdefault(b" ".join(words[k : k + window]), set()).add(item)
            for k in range(0, len(words) - self.block + 1, self.block):
                blocks.add(b" ".join(words[k : k + self.block]))
        self.automaton = ahocorasick.Automaton()
        for text in blocks:
            self.automaton.add_word(f" {text.decode('latin-1')} ", (len(text.split(b" ")), text))
        if blocks:
            self.automaton.make_automaton()
        self.empty = not blocks

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, Items]:
        """The first and last word (exclusive) of each occurrence, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: Items = set()
        if self.empty or not words:
            return np.empty((0, 2), np.int64), items
        line = b" " + b" ".join(words) + b" "
        gaps, starts = None, set()
        for end, (size, text) in self.automaton.iter(line.decode("latin-1")):
            if gaps is None:
                gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            last = int(np.searchsorted(gaps, end))
            if text in self.whole:
                spans.append((last - size, last))
                items |= self.whole[text]
            if size == self.block:
                starts.update(range(max(last - self.window, 0), min(last - size, len(words) - self.window) + 1))
        for k in starts:
            found = self.windows.get(b" ".join(words[k : k + self.window]))
            if found:
                spans.append((k, k + self.window))
                items |= found
        return np.array(spans, np.int64).reshape(-1, 2), items


_loaded: dict[str, Matcher] = {}  # of this worker: the latest one only


def _matcher(sent, name: str, window: int) -> Matcher:
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Matcher(sent.value, window)
    return _loaded[name]


def _spans(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Code-point offsets in the original text of each run of hit words, from its first to its last character."""
    plain = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], plain, [False]]).astype(np.int8)))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    runs = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
    return [{"start": int(points[edge[2 * a]]), "end": int(points[edge[2 * b - 1]])} for a, b in runs]


def _result(text: bytes, n: int, spans: np.ndarray, items: Items) -> tuple:
    names = sorted(x for x in items if x is not None)
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    if not len(spans):
        return n, 0, len(items), names, digest, False, []
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, spans[:, 0], 1)
    np.add.at(cover, spans[:, 1], -1)
    hit = np.cumsum(cover[:-1]) > 0
    return n, int(hit.sum()), len(items), names, digest, True, _spans(text, hit)


def _batch(row: pa.Array, results: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*results, strict=True)) if results else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([row, *[pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)]], names=["row", *_NAMES])


def _pieces(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """Distinct (item, words): the normalised words of each item, long ones in overlapping pieces that hold all its windows."""
    source = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), as_text(benchmark, text).alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            items, out = [], []
            for name, value in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = normal_words(value)
                for k in range(0, max(len(words) - window, 0) + 1 if words else 0, PIECE_WORDS):
                    items.append(name)
                    out.append(b" ".join(words[k : k + PIECE_WORDS + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(out, pa.binary())], names=["item", "words"])

    return arrow(source, kernel, "item string, words binary").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every row of ``docs`` as a struct ``row`` beside the columns of ``RESULT``.

    Both sides are lower-cased (A-Z) and cut into words; a word of a document is hit if it lies in an occurrence
    of ``window`` consecutive words of an item, or of a whole item that has fewer.  The text is scanned once.
    ``spans`` are the hit runs as code-point offsets in the original text.

    Null or empty text has no words and no hits; a very long one is scanned whole, in a task of its own batch.
    Items that are null or have no words match nothing.  Items with a null id match like any others and count in
    n_items as one item, but have no name for ``items`` and items_sha256.  Repeated items count once by id.
    Rows repeat as they come.  An empty benchmark leaves every document clean; no rows give no rows.

    The items' total size is measured first; at most about ``shard_bytes`` of words are sent and go into one
    automaton.  A larger benchmark is dealt by hash into several, and the documents are read once for each: one
    is collected, sent and built at a time, hits by text are stored, and the last step joins them.
    """
    store = Stored(docs.sparkSession, "benchmark")
    context = docs.sparkSession.sparkContext
    pieces = store.put(_pieces(benchmark, item, item_text, window), "pieces")
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    of = F.pmod(F.xxhash64("words"), F.lit(shards))
    source = packed(docs, text=as_text(docs, text))
    result = with_row(source, RESULT)

    def send(k: int):
        return context.broadcast([(r.item, bytes(r.words)) for r in pieces.where(of == k).collect()]), uuid.uuid4().hex

    if shards == 1:
        sent, name = send(0)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _matcher(sent, name, window)
            for batch in slices(batches, "text", 8 << 20):
                out = []
                for value in batch.column("text").cast(pa.binary()).to_pylist():
                    words = normal_words(value)
                    out.append(_result(value, len(words), *own.scan(words)))
                yield _batch(batch.column("row"), out)

        return arrow(source, kernel, result)

    def hits(k: int) -> DataFrame:
        sent, name = send(k)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _matcher(sent, name, window)
            for batch in slices(batches, "text", 8 << 20):
                cols: list[list] = [[], [], [], []]
                for value in batch.column("text").cast(pa.binary()).to_pylist():
                    spans, items = own.scan(normal_words(value))
                    if items:
                        for col, x in zip(cols, (hashlib.md5(value).hexdigest(), spans.reshape(-1), [x for x in items if x is not None], None in items), strict=True):
                            col.append(x)
                types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["sum", "at", "items", "nameless"])

        out = store.put(arrow(source.select("text"), kernel, "sum string, at array<bigint>, items array<string>, nameless boolean"), "hits")
        sent.unpersist()
        return out.groupBy("sum").agg(*[F.any_value(c).alias(c) for c in ("at", "items", "nameless")])  # equal texts have equal hits

    found = reduce(DataFrame.unionByName, [hits(k) for k in range(shards)])
    found = found.groupBy("sum").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_set("items")).alias("items"), F.max("nameless").alias("nameless"))
    joined = source.withColumn("sum", F.md5("text")).join(found, "sum", "left").select("row", "text", "at", "items", "nameless")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            out = []
            for value, at, items, nameless in zip(batch.column("text").cast(pa.binary()).to_pylist(), *(batch.column(c).to_pylist() for c in ("at", "items", "nameless")), strict=True):
                own = {*(items or []), *([None] if nameless else [])}
                out.append(_result(value, len(normal_words(value)), np.array(at or [], np.int64).reshape(-1, 2), own))
            yield _batch(batch.column("row"), out)

    return arrow(joined, gather, result)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a hit word, with their own columns."""
    return contamination(docs, benchmark, text, **options).where("not contaminated").select("row.*")
