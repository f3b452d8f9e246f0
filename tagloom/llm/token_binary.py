"""Token ids as patched frame-of-reference blocks in segments, and back.

A segment is one binary value: a header, the documents' ends, the start of every block, and the blocks.  A
block holds 128 ids: its minimum, a bit width, the ids less the minimum cut to that width, and a list of
exceptions (position, the bits above the width).  The width is the number of bits that a given percentile of
the block's ids need, so few large ids don't widen the rest.  Segments are rows of a Parquet table, which
Spark's own writer commits on any store, so a lost executor leaves no half file behind.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, arrow, as_text, ints, slices

MAGIC = b"TLPF"
BLOCK = 128
PERCENTILE = 90
SEGMENT_TOKENS = 1 << 20
DOCS_AT_ONCE = 4096
TEXT_BYTES = 1 << 20  # encoded at a time
END_ID = 0
CACHE_WORDS = 1_300_000
JOINED = 64

SEGMENTS = "part int, seq int, before bigint, first_id bigint, last_id bigint, n_docs bigint, n_tokens bigint, body binary"

_HEADER = struct.Struct("<4sBBHQQQ")  # magic, version, percentile, block, ids, documents, blocks


def pack(ids: np.ndarray, ends: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """The segment of ``ids`` (unsigned 32-bit) whose documents end at ``ends``."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint64)
    grid[:n] = ids
    if n:
        grid[n:] = ids[-1]
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.empty(0, np.uint64)
    grid = grid - low[:, None]
    bits = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)  # 0 for 0, else the number of binary digits
    rank = -(-BLOCK * percentile // 100) - 1
    width = np.partition(bits, rank, axis=1)[:, rank] if blocks else np.empty(0, np.uint8)
    late = np.argwhere(bits > width[:, None]) if blocks else np.empty((0, 2), np.int64)
    extra = np.bincount(late[:, 0], minlength=blocks)
    size = 4 + 1 + 1 + BLOCK // 8 * width.astype(np.int64) + 5 * extra
    start = np.concatenate([[0], np.cumsum(size)])
    body = np.zeros(int(start[-1]), np.uint8)
    if blocks:
        body[start[:-1, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
        body[start[:-1] + 4] = width
        body[start[:-1] + 5] = extra
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            words = np.zeros((len(at), 2 * w), np.uint64)
            cut = grid[at] & np.uint64((1 << int(w)) - 1)
            for k in range(BLOCK):
                word, shift = divmod(k * int(w), 64)
                words[:, word] |= cut[:, k] << np.uint64(shift)
                if shift + int(w) > 64:
                    words[:, word + 1] |= cut[:, k] >> np.uint64(64 - shift)
            body[start[at, None] + 6 + np.arange(16 * int(w))] = words.astype("<u8").view(np.uint8).reshape(len(at), -1)
    if len(late):
        nth = np.arange(len(late)) - np.concatenate([[0], np.cumsum(extra)])[late[:, 0]]
        at = start[late[:, 0]] + 6 + 16 * width[late[:, 0]].astype(np.int64) + 5 * nth
        high = (grid[late[:, 0], late[:, 1]] >> width[late[:, 0]].astype(np.uint64)).astype("<u4")
        body[at] = late[:, 1]
        body[at[:, None] + 1 + np.arange(4)] = high.view(np.uint8).reshape(-1, 4)
    head = _HEADER.pack(MAGIC, 1, percentile, BLOCK, n, len(ends), blocks)
    return head + np.asarray(ends, "<u8").tobytes() + start.astype("<u8").tobytes() + body.tobytes()


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids as unsigned 32-bit integers, ends of documents) of a segment."""
    magic, version, _, block, n, docs, blocks = _HEADER.unpack_from(body)
    if magic != MAGIC or version != 1 or block != BLOCK:
        raise ValueError("not a segment of this format")
    at = _HEADER.size
    ends = np.frombuffer(body, "<u8", docs, at).astype(np.int64)
    start = np.frombuffer(body, "<u8", blocks + 1, at + 8 * docs).astype(np.int64)
    data = np.frombuffer(body, np.uint8, offset=at + 8 * docs + 8 * (blocks + 1))
    if not blocks:
        return np.empty(0, np.uint32), ends
    low = data[start[:-1, None] + np.arange(4)].copy().view("<u4").reshape(-1).astype(np.uint64)
    width, extra = data[start[:-1] + 4].astype(np.int64), data[start[:-1] + 5].astype(np.int64)
    grid = np.zeros((blocks, BLOCK), np.uint64)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            words = data[start[rows, None] + 6 + np.arange(16 * w)].copy().view("<u8").reshape(len(rows), -1)
            mask = np.uint64((1 << int(w)) - 1)
            for k in range(BLOCK):
                word, shift = divmod(k * int(w), 64)
                x = words[:, word] >> np.uint64(shift)
                if shift + w > 64:
                    x = x | (words[:, word + 1] << np.uint64(64 - shift))
                grid[rows, k] = x & mask
    if extra.any():
        row = np.repeat(np.arange(blocks), extra)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra)
        at = start[row] + 6 + 16 * width[row] + 5 * nth
        high = data[at[:, None] + 1 + np.arange(4)].copy().view("<u4").reshape(-1).astype(np.uint64)
        grid[row, data[at]] |= high << width[row].astype(np.uint64)
    return (grid + low[:, None]).reshape(-1)[:n].astype(np.uint32), ends


_SPLIT = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD = r"[^\S \n]"
_EDGE = {" ", "\n"}


class _Index(dict):
    """Numbers for keys, in order of arrival; ``fresh`` gets those not seen before."""

    def __init__(self):
        self.fresh: list[str] = []
        self.following = 0

    def __missing__(self, key: str) -> int:
        self[key] = n = self.following
        self.following = n + 1
        self.fresh.append(key)
        return n


class Encoder:
    """Ids of texts by the tokenizers library.

    The tokenizer's pattern always starts a new piece at a space or line feed that follows a visible character,
    so text cut there has the same ids piece by piece.  Ids of pieces seen before are kept, up to
    ``CACHE_WORDS`` pieces; new ones are encoded many at a time, end to end, and told apart by their bytes, as a
    byte-level token spells as many bytes as its name has characters.  Texts with other white space, or with the
    string of a token that was added to the vocabulary, such as a special one, go whole.

    A piece's key is the word after a single space, or a line feed and a word; any other piece stands behind a space.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.odd = re.compile("|".join([_ODD, *map(re.escape, added)]))
        self.spaced = any(" " in t or "\n" in t for t in added)  # such a string may lie across pieces
        names = self.tokenizer.get_vocab()
        self.spelt = np.zeros(max(names.values()) + 1, np.int64)
        for name, k in names.items():
            self.spelt[k] = len(name)
        self.end_id = end_id
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.index[" "]  # a document's end
        self.index.fresh = []
        self.flat = np.array([self.end_id], np.uint16 if max(len(self.spelt), self.end_id + 1) <= 1 << 16 else np.uint32)
        self.start, self.size = np.zeros(1, np.int32), np.ones(1, np.int32)

    def learn(self, keys: list[str]) -> None:
        """Ids of new keys; words are encoded end to end, other pieces one by one."""
        plain = np.array([k[:1] != " " for k in keys], bool)
        words = [k for k in keys if k[:1] != " "]
        length = np.fromiter(map(len, map(str.encode, words)), np.int64, len(words))
        length += np.fromiter((k[:1] != "\n" for k in words), bool, len(words))
        texts = [(" " + " ".join(words[j : j + JOINED])).replace(" \n", "\n") for j in range(0, len(words), JOINED)]
        other = [k[1:] for k in keys if k[:1] == " "]
        encoded = self.tokenizer.encode_batch_fast(texts + other, add_special_tokens=False)
        ids = np.concatenate([np.empty(0, np.uint32), *(np.array(e.ids, np.uint32) for e in encoded[: len(texts)])])
        reach = np.cumsum(self.spelt[ids])
        ends = np.cumsum(length)
        cut = np.searchsorted(reach, ends) + 1
        if len(words) and not (reach[cut - 1] == ends).all():
            raise ValueError("this tokenizer doesn't cut at spaces")
        rest = [np.array(e.ids, np.uint32) for e in encoded[len(texts) :]]
        sizes = np.empty(len(keys), np.int64)
        starts = np.empty(len(keys), np.int64)
        sizes[plain] = np.diff(cut, prepend=0)
        starts[plain] = cut - sizes[plain] + len(self.flat)
        sizes[~plain] = [len(x) for x in rest]
        starts[~plain] = np.cumsum(sizes[~plain]) - sizes[~plain] + len(self.flat) + len(ids)
        self.flat = np.concatenate([self.flat, *(x.astype(self.flat.dtype) for x in (ids, *rest))])
        self.start, self.size = np.concatenate([self.start, starts.astype(np.int32)]), np.concatenate([self.size, sizes.astype(np.int32)])

    def _cut(self, texts: list[str], odd: bool) -> tuple[list[str], list[int]]:
        """Keys of all pieces, each text's followed by the end's, and the texts' ends among them."""
        keys: list[str] = []
        count: list[int] = []
        for text in texts:
            if odd and self.odd.search(text):
                keys.append(" " + text)
            elif text[:1] in _EDGE or text[-1:] in _EDGE or "  " in text or "\n\n" in text or "\n " in text or " \n" in text:
                keys += [" " + piece for piece in _SPLIT.findall(text)]
            elif text:
                words = text.replace("\n", " \n").split(" ")
                words[0] = " " + words[0]
                keys += words
            keys.append(" ")
            count.append(len(keys))
        return keys, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, each text's followed by the end id; the texts' ends)."""
        if len(self.index) > CACHE_WORDS or len(self.flat) > 8 * CACHE_WORDS:
            self.clear()
        keys, count = self._cut(texts, False)
        found = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        odd = self.spaced or self.odd.search("".join(self.index.fresh)) is not None
        if odd:  # what sends a text whole is only ever in new pieces: none of those may stay
            for key in self.index.fresh:
                del self.index[key]
            self.index.following -= len(self.index.fresh)
            self.index.fresh = []
            keys, count = self._cut(texts, True)
            found = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        if self.index.fresh:
            self.learn(self.index.fresh)
            self.index.fresh = []
        size = self.size[found]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.start[found] - ends + size, size)].astype(np.uint32)
        if odd:  # whole texts aren't kept
            for text in texts:
                if self.odd.search(text):
                    self.index.pop(" " + text, None)
        return ids, ends[np.array(count) - 1]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def segments(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """``docs`` in ascending order of ``id`` as rows of ``SEGMENTS``, part by part and segment by segment.

    ``part`` ascends with ``id`` (a range partitioning, so no task sorts more than its range), ``seq`` within a
    part.  Null text is empty and gives the end id alone; a null id sorts first; rows that repeat an id are all
    written, ordered by their text.  No rows give no segments.  Other columns are not read.
    """
    source = docs.select(F.col(f"`{id}`").cast("long").alias("id"), as_text(docs, text).alias("text"))
    dealt = source.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    dealt = dealt.select("id", "text", F.spark_partition_id().alias("part"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own, seq = encoder(tokenizer, end_id), 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        ends: list[np.ndarray] = []
        size = part = done = 0

        def flush() -> pa.RecordBatch:
            body = struct.pack("<Q", len(names)) + b"".join(struct.pack("<?q", x is not None, x or 0) for x in names) + pack(np.concatenate(held), np.concatenate(ends))
            row = {"part": [part], "seq": [seq], "before": [done], "first_id": [names[0]], "last_id": [names[-1]], "n_docs": [len(names)], "n_tokens": [size], "body": [body]}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in slices(batches, "text", TEXT_BYTES):
            part = batch.column("part")[0].as_py()
            ids, at = own.encode(batch.column("text").to_pylist())
            held.append(ids)
            ends.append(at + size)
            names += batch.column("id").to_pylist()
            size += len(ids)
            if size >= segment_tokens:
                yield flush()
                seq, done, size = seq + 1, done + size, 0
                held.clear(), names.clear(), ends.clear()
        if names:
            yield flush()

    return arrow(dealt, kernel, SEGMENTS)


def write(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Writes the segments of ``docs`` as the table at ``path``."""
    segments(docs, tokenizer, **options).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a written table: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` is the number of ids of all documents before.  Only the totals of the parts (one row for each
    partition that was written, whatever the number of documents) meet in one place to be summed up, and
    that table, of 16 bytes a partition, is what is broadcast.
    """
    table = spark.read.schema(SEGMENTS).parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("earlier"))
    bodies = table.select("part", "before", "body").join(F.broadcast(parts), "part").select((F.col("earlier") + F.col("before")).alias("base"), "body")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, body in zip(batch.column("base").to_pylist(), batch.column("body"), strict=True):
                view = body.as_py()
                n = struct.unpack_from("<Q", view)[0]
                named = np.frombuffer(view, np.dtype([("known", "?"), ("id", "<i8")]), n, 8)
                ids, ends = unpack(view[8 + 9 * n :])
                begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                flat = ids.astype("<u4")
                crc = np.array([zlib.crc32(flat[a:b]) for a, b in zip(begin, ends, strict=True)], np.int64)
                for k in range(0, n, DOCS_AT_ONCE):
                    a, b = begin[k : k + DOCS_AT_ONCE], ends[k : k + DOCS_AT_ONCE]
                    cols = {"doc_id": pa.array(named["id"][k : k + DOCS_AT_ONCE], mask=~named["known"][k : k + DOCS_AT_ONCE]), "start": pa.array(a + base), "n_tokens": pa.array(b - a), "ids_crc32": pa.array(crc[k : k + DOCS_AT_ONCE])}
                    if with_ids:
                        cols["ids"] = ints(flat[a[0] : b[-1]].astype(np.int64), np.concatenate([a, b[-1:]]) - a[0], pa.int64())
                    yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return arrow(bodies, kernel, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes ``docs`` to the shared folder and reads the files back, without the ids themselves."""
    store = Stored(docs.sparkSession, "tokens")
    path = f"{store.root}/segments"
    write(docs, path, tokenizer, **options)
    store.until_exit()
    return read(docs.sparkSession, path, with_ids=False)
