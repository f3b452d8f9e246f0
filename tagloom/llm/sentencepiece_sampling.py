"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice; lossless decoding.

A text gets one leading space, and its spaces become U+2581, as the model expects.  Pieces hold that sign only
at their start (another model is refused), so the lattice falls apart at every space that follows a visible character; each such unit is
filtered once (log sums of all segmentations up to each character) and sampled backwards for every occurrence.
Characters that no piece covers, and U+2581 itself where a text has it, are spelt in byte pieces.

The vocabulary ranks pieces by merge order and carries no probabilities; a piece of rank r weighs
1 / (r + 2) by Zipf's rule, to the power ``sharpness``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, as_text, ints, mix64, packed, slices, with_row

SHARPNESS = 1.0
SEED = 17
CACHED_NODES = 600_000
TEXT_BYTES = 1 << 19  # sampled at a time

_UNIT = re.compile(r" *[^ ]+| +")
_SPACE, _LITERAL = 0x2581, 0x110000  # a space, and U+2581 as a text's own character


class Vocabulary:
    """The pieces of a model: ids by spelling, log weights, bytes."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes: list[bytes] = []
        plain: list[tuple[str, int]] = []
        for k in range(n):
            if model.is_byte(k):
                code = int(model.id_to_piece(k)[3:5], 16)
                self.byte_ids[code] = k
                self.bytes.append(bytes([code]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.bytes.append(b"")
            else:
                piece = model.id_to_piece(k)
                if "▁" in piece.lstrip("▁"):
                    raise ValueError("this model has pieces that span words")
                plain.append((piece, k))
                self.bytes.append(piece.replace("▁", " ").encode())
        order = sorted(plain, key=lambda x: -model.get_score(x[1]))
        self.weight = np.full(n, sharpness * -np.log(len(order) + 2.0))
        for rank, (_, k) in enumerate(order):
            self.weight[k] = sharpness * -np.log(rank + 2.0)
        self.longest = max(len(p) for p, _ in plain)
        self.powers = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        keys: dict[int, list[tuple[int, int]]] = {}
        for piece, k in plain:
            keys.setdefault(len(piece), []).append((int(self.hash(np.array([ord(c) for c in piece], np.uint64))), k))
        self.tables = {}
        for length, found in keys.items():
            found.sort()
            hashes = np.array([h for h, _ in found], np.uint64)
            # by its top bits a hash is found at once, or a few places on
            top = np.arange((1 << 18) + 1, dtype=np.uint64)
            first = np.searchsorted(hashes >> np.uint64(46), top)
            self.tables[length] = (hashes, np.array([k for _, k in found], np.int32), first[:-1].astype(np.int32), np.diff(first).astype(np.int8))
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def hash(self, codes: np.ndarray) -> np.uint64:
        total = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in codes:
                total = total * np.uint64(0x9E3779B97F4A7C15) + mix64(np.array([c], np.uint64))[0]
        return total

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids spell, the leading space included."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)]


class Lattice:
    """Filtered lattices of units, in flat arrays: a node for each character end, its arcs with cumulative chances."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.last: dict[str, int] = {}  # a unit's last node
        self.first_arc = np.zeros(1, np.int64)
        self.root = np.zeros(0, bool)
        self.chance = np.zeros(0, np.float32)
        self.back = np.zeros(0, np.int32)
        self.piece = np.zeros(0, np.int32)  # an id, or less than 0: -1 - code point to be spelt in bytes

    def add(self, units: list[str]) -> None:
        v = self.vocabulary
        sizes = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.where(codes == _SPACE, _LITERAL, np.where(codes == 32, _SPACE, codes))
        n = len(codes)
        ends = np.cumsum(sizes)
        begin = np.repeat(ends - sizes, sizes)  # of the unit, for each character
        mixed = mix64(codes.astype(np.uint64))
        froms, tos, pieces = [], [], []
        stop = np.repeat(ends, sizes)
        live, value = np.arange(n), np.zeros(n, np.uint64)
        covered = np.zeros(n, bool)
        for length in range(1, v.longest + 1):
            # value: hash of the length characters from each start whose unit is that long
            if length > 1:
                inside = stop[live] - live >= length
                live, value = live[inside], value[inside]
            if not len(live):
                break
            value = value * v.powers[1] + mixed[live + length - 1]
            if length not in v.tables:
                continue
            hashes, ids, first, count = v.tables[length]
            top = (value >> np.uint64(46)).astype(np.int64)
            maybe = np.flatnonzero(count[top])
            at, rest = first[top[maybe]], count[top[maybe]]
            while len(maybe):
                hit = hashes[at] == value[maybe]
                from_ = live[maybe[hit]]
                froms.append(from_)
                tos.append(from_ + length)
                pieces.append(ids[at[hit]].astype(np.int64))
                if length == 1:
                    covered[from_] = True
                more = ~hit & (rest > 1)
                maybe, at, rest = maybe[more], at[more] + 1, rest[more] - 1
        bare = np.flatnonzero(~covered)
        froms.append(bare)
        tos.append(bare + 1)
        pieces.append(-1 - codes[bare])
        start, end, piece = np.concatenate(froms), np.concatenate(tos), np.concatenate(pieces)
        byte_weight = v.weight[v.byte_ids[0]]
        spelt = np.where(piece < -1 - 0xFFFF, 4, np.where(piece < -1 - 0x7FF, 3, np.where(piece < -1 - 0x7F, 2, 1)))
        spelt = np.where(piece == -1 - _LITERAL, 3, spelt)
        weight = np.where(piece >= 0, v.weight[np.maximum(piece, 0)], byte_weight * spelt)
        # nodes: character i of the batch has node i + 1 + (number of its unit); a unit's root comes before
        unit = np.repeat(np.arange(len(units)), sizes)
        source, target = start + unit[start], end - 1 + unit[start] + 1
        depth = end - begin[start]
        order = np.argsort(target, kind="stable")
        source, target, weight, piece, depth = source[order], target[order], weight[order], piece[order], depth[order]
        by_depth = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        from_, to, cost = source[by_depth], target[by_depth], weight[by_depth]
        nodes = n + len(units)
        alpha = np.full(nodes, -np.inf)
        roots = ends - sizes + np.arange(len(units))
        alpha[roots] = 0.0
        cuts = np.searchsorted(depth[by_depth], np.arange(1, (int(sizes.max()) if len(sizes) else 0) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                x = alpha[from_[a:b]] + cost[a:b]
                head = np.flatnonzero(np.concatenate([[True], to[a + 1 : b] != to[a : b - 1]]))
                top = np.maximum.reduceat(x, head)
                total = np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(head, b - a)))), head)
                alpha[to[a:b][head]] = top + np.log(total)
        chance = np.exp(alpha[source] + weight - alpha[target])
        arcs = np.bincount(target, minlength=nodes)
        first = np.cumsum(arcs) - arcs
        run = np.cumsum(chance)
        run = run - np.repeat((run - chance)[np.minimum(first, max(len(run) - 1, 0))], arcs) if len(run) else run
        run[(first + arcs - 1)[arcs > 0]] = 2.0  # the last arc of a node takes what rounding leaves
        base, shift = len(self.root), len(self.chance)
        root = np.zeros(nodes, bool)
        root[roots] = True
        self.root = np.concatenate([self.root, root])
        self.first_arc = np.concatenate([self.first_arc[:-1], first + shift, [shift + len(chance)]])
        self.chance = np.concatenate([self.chance, run.astype(np.float32)])
        self.back = np.concatenate([self.back, (source + base).astype(np.int32)])
        self.piece = np.concatenate([self.piece, piece.astype(np.int32)])
        self.last.update(zip(units, (roots + sizes + base).tolist(), strict=True))

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets of the texts); ``seeds`` has one unsigned integer for each."""
        if len(self.root) > CACHED_NODES:
            self.clear()
        cut = [_UNIT.findall(" " + t) for t in texts]
        new = set().union(*cut) - self.last.keys() if cut else set()
        if new:
            self.add(list(new))
        last = self.last
        count = np.array([len(c) for c in cut], np.int64)
        node = np.fromiter((last[u] for c in cut for u in c), np.int64, int(count.sum()))
        ordinal = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)
        stream = mix64(np.repeat(seeds, count) + ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        live = np.arange(len(node))
        length = np.zeros(len(node), np.int64)
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(live):
            word = mix64(stream[live] ^ np.uint64((step + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
            u = (word >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = self.first_arc[node[live]]
            wait = np.flatnonzero(self.chance[arc] <= u)
            while len(wait):
                arc[wait] += 1
                wait = wait[self.chance[arc[wait]] <= u[wait]]
            taken.append((live, self.piece[arc]))
            length[live] += 1
            node[live] = self.back[arc]
            live = live[~self.root[node[live]]]
            step += 1
        ends = np.cumsum(length)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (who, piece) in enumerate(taken):
            out[ends[who] - 1 - k] = piece
        text_end = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
        bare = np.flatnonzero(out < 0)
        if len(bare):
            spelt = [chr(0x2581 if c == _LITERAL else c).encode("utf-8", "surrogatepass") for c in (-1 - out[bare]).tolist()]
            times = np.ones(len(out), np.int64)
            times[bare] = [len(s) for s in spelt]
            moved = np.concatenate([[0], np.cumsum(times)])
            wide = np.repeat(out, times)
            wide[wide < 0] = self.vocabulary.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
            out, text_end = wide, moved[text_end]
        return out.astype(np.int32), text_end


_lattices: dict[tuple[str, float], Lattice] = {}


def lattice(path: str, sharpness: float = SHARPNESS) -> Lattice:
    if (path, sharpness) not in _lattices:
        _lattices[path, sharpness] = Lattice(Vocabulary(path, sharpness))
    return _lattices[path, sharpness]


def row_seeds(keys: list, seed: int) -> np.ndarray:
    raw = [zlib.crc32(repr(k).encode()) | zlib.crc32(repr(k).encode(), 1) << 32 for k in keys]
    return mix64(np.array(raw, np.uint64) ^ mix64(np.array([seed], np.uint64)))


def sampled(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", sharpness: float = SHARPNESS, seed: int = SEED, with_ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (or its columns ``keep``) as a struct ``row`` beside ids, n_pieces, ids_crc32, decoded_sha256 and lossless.

    ``ids`` is one segmentation drawn from the lattice, the same for the same key, text, seed and model however
    the rows are dealt.  The ids are decoded again and compared with the text: ``lossless`` says if all bytes
    came back.  crc32 is over little-endian unsigned 32-bit ids.

    Null or empty text is the leading space alone, which decodes to the empty text.  A null key is a key of its
    own; rows with equal key and text get equal ids.  Texts of any length are taken whole.  No rows give no rows.
    """
    source = packed(docs, key=F.col(f"`{key}`").cast("string"), text=as_text(docs, text))
    if keep is not None:  # so that texts aren't sent twice
        source = source.select(F.struct(*[F.col("row").getField(c).alias(c) for c in keep]).alias("row"), "key", "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model, sharpness)
        for batch in slices(batches, "text", TEXT_BYTES):
            texts = batch.column("text").to_pylist()
            ids, at = own.sample(texts, row_seeds(batch.column("key").to_pylist(), seed))
            back = own.vocabulary.decode(ids).tobytes()
            reach = np.concatenate([[0], np.cumsum(own.vocabulary.size[ids])])[at]
            flat = ids.astype("<u4")
            crc, sums, same = [], [], []
            for k, text in enumerate(texts):
                decoded = back[reach[k] + 1 : reach[k + 1]]
                crc.append(zlib.crc32(flat[at[k] : at[k + 1]]))
                sums.append(hashlib.sha256(decoded).hexdigest())
                same.append(decoded == text.encode())
            cols = {"row": batch.column("row"), "n_pieces": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64()), "decoded_sha256": pa.array(sums), "lossless": pa.array(same)}
            if with_ids:
                cols["ids"] = ints(ids, at, pa.int32())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
        own.clear()  # workers live on; what other stages need isn't held

    return arrow(source, kernel, with_row(source, "n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean" + ", ids array<int>" * with_ids))
