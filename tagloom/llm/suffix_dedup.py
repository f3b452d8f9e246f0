"""Removal of byte strings that occur earlier, by suffix sorting in two stages.

1. Every ``LENGTH``-byte window of a text has a smallest hash among its ``SEED_BYTES``-byte pieces.  Consecutive
   windows whose leftmost smallest piece is the same one make a run, and equal windows have equal hashes, so windows of a run can only repeat
   in runs with that hash.  Runs meet by hash; those that are alone are done.
2. Runs with equal bytes make a class; all but its earliest are repeats.  Where a hash has one class, that is all.
3. Where a hash has several classes, the earliest run of each sends its bytes, and their suffixes are sorted in
   two stages: those smaller than their successor directly, the rest by scanning the buckets of what is sorted.
   Neighbours in that order with a common prefix of ``LENGTH`` bytes are equal windows.

What is removed is the union of all repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Stored, arrow, as_text, mix64, packed, raw, slices, with_row

LENGTH = 100
SEED_BYTES = 32
HOT_IN_TASK = 64  # classes of one hash in one map batch from which on its windows are dealt by their own hashes
HOT_IN_BUCKET = 20_000  # the same where all runs of a hash meet
CHUNK_BYTES = 1 << 20
_FIRST = -(1 << 63)

MEET_ROWS = 100_000  # runs that are looked at together; of a hash with more, one run of each class is held

RUN = np.dtype([("h", "<u8"), ("f", "<u8"), ("id", "<i8"), ("sum", "<i8"), ("pos", "<i4"), ("n", "<i4"), ("hot", "?")])
SENT = "settled boolean, target bigint, h bigint, f bigint, id bigint, sum bigint, pos int, n int, hot boolean"
FOUND = "id bigint, sum bigint, pos int, n int, h bigint, hot boolean, mark boolean"


def _hashes(data: np.ndarray, rolling: Rolling, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of ``data``, the hashes of its pieces, and for each window its smallest piece hash."""
    prefix = rolling.prefix(data)
    n = len(data)
    if n < length:
        return prefix, np.empty(0, np.uint64), np.empty(0, np.uint64)
    low = piece = mix64((prefix[seed:] - prefix[:-seed]) * rolling.down[: n - seed + 1])
    wide, span = length - seed + 1, 1
    full = len(low)
    while span * 2 <= wide:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < wide:
        rest, count = wide - span, full - wide + 1
        low = np.minimum(low[:count], low[rest : rest + count])
    return prefix, piece, low


def runs(data: np.ndarray, at: np.ndarray, rolling: Rolling, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(row, position in its text, number of windows, hash, hash of the bytes) of each run."""
    prefix, piece, low = _hashes(data, rolling, length, seed)
    size = np.diff(at)
    valid = np.zeros(len(low) + 1, np.int32)
    full = np.flatnonzero(size >= length)
    np.add.at(valid, at[:-1][full], 1)
    np.add.at(valid, at[1:][full] - length + 1, -1)
    where = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(where):
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    kept = low[where]
    # where the smallest piece has just been left behind, an equal one further on takes over: a run of its own
    head = np.flatnonzero(np.concatenate([[True], (kept[1:] != kept[:-1]) | (where[1:] != where[:-1] + 1) | (piece[where[1:] - 1] == kept[1:])]))
    # a text's first window begins a run of its own even if the one before has the same hash
    row_of = np.searchsorted(at, where, "right") - 1
    cut = np.flatnonzero(np.concatenate([[True], row_of[1:] != row_of[:-1]]))
    head = np.union1d(head, cut)
    start, n = where[head], np.diff(np.append(head, len(where)))
    row = row_of[head]
    same = mix64(rolling.ranges(prefix, start, start + n - 1 + length) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row, start - at[row], n, kept[head], same


def _classes(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``found`` in the order of hash, class and place; for each, the index of its class's earliest."""
    found = found[np.lexsort((found["pos"], found["sum"], found["id"], found["f"], found["h"]))]
    head = np.concatenate([[True], (found["h"][1:] != found["h"][:-1]) | (found["f"][1:] != found["f"][:-1])]) if len(found) else np.empty(0, bool)
    at = np.flatnonzero(head)
    return found, np.repeat(at, np.diff(np.append(at, len(found))))


def _same_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["id"] == b["id"]) & (a["sum"] == b["sum"]) & (a["pos"] == b["pos"])


def _marks(found: np.ndarray, mark: bool) -> pa.RecordBatch:
    cols = [pa.array(found[k]) for k in ("id", "sum", "pos", "n")]
    cols += [pa.array(found["h"].view(np.int64) if len(found) else np.empty(0, np.int64)), pa.array(found["hot"]), pa.array(np.full(len(found), mark))]
    return pa.RecordBatch.from_arrays(cols, names=["id", "sum", "pos", "n", "h", "hot", "mark"])


class _Hash:
    """What ``meet`` holds: the rows of hashes that may go on in the next batch.

    Rows come sorted by hash, summaries (no windows) first, then by class and place.  A hash with more rows than
    ``MEET_ROWS`` is settled piece by piece: repeats leave, and one run of each class is held until there are
    more than ``HOT_IN_BUCKET``; from then on the hash is hot, and its classes leave too.
    """

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.size = 0
        self.hot: np.uint64 | None = None  # the hash whose earlier classes have left
        self.last: np.ndarray | None = None  # the first run of its latest class

    def take(self, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(found):
            return
        self.held.append(found)
        self.size += len(found)
        if self.size < MEET_ROWS:
            return
        rows = np.concatenate(self.held)
        same = rows["h"] == rows["h"][-1]
        if not same.all():
            yield from self._settle(rows[~same])
        if self.hot is not None and self.hot != rows["h"][-1]:
            self.hot = self.last = None
        rest = rows[same]
        self.held, self.size = [rest], len(rest)
        if len(rest) >= MEET_ROWS:
            yield from self._reduce(rest)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield from self._settle(np.concatenate(self.held))

    def _reduce(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sheds what is decided of one hash, which may have more rows to come."""
        told, seen = rows[rows["n"] == 0][:1], rows[rows["n"] > 0]
        found, earliest = _classes(seen if self.last is None else np.concatenate([self.last, seen]))
        own = np.arange(len(found))
        yield _marks(found[(earliest != own) & ~_same_place(found, found[earliest])], True)
        heads = found[earliest == own]
        if len(told) or self.hot is not None or len(heads) > HOT_IN_BUCKET:
            self.hot = rows["h"][0]
            out = heads.copy() if self.last is None else heads[heads["f"] != self.last["f"][0]]
            out["hot"] = True
            yield _marks(out, False)
            if len(seen):
                self.last = heads[heads["f"] == seen["f"][-1]]
            heads = heads[:0]
        self.held = [np.concatenate([told, heads])]
        self.size = len(self.held[0])

    def _settle(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Decides rows whose hashes are complete; the hot one had rows before."""
        if self.hot is not None and (going := rows["h"] == self.hot).any():
            yield from self._reduce(rows[going])
            rows = rows[~going]
        told = np.unique(rows["h"][rows["n"] == 0])
        found, earliest = _classes(rows[rows["n"] > 0])
        own = np.arange(len(found))
        yield _marks(found[(earliest != own) & ~_same_place(found, found[earliest])], True)
        found = found[earliest == own]
        if len(found):
            head = np.flatnonzero(np.concatenate([[True], found["h"][1:] != found["h"][:-1]]))
            size = np.diff(np.append(head, len(found)))
            found["hot"] |= np.repeat(size > HOT_IN_BUCKET, size) | np.isin(found["h"], told)
            yield _marks(found[np.repeat(size > 1, size) | found["hot"]], False)  # a hash that has one class is done


def two_stage_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of ``text`` (bytes; the end counts as smallest) in the order of their first ``depth`` bytes.

    Suffixes smaller than their successors are sorted directly, eight bytes at a time and only where they still
    tie.  The buckets of first bytes are then scanned in ascending order: each suffix found there whose
    predecessor is not smaller than its successor puts that predecessor at the next free place of its bucket.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    # kind: True where the suffix is smaller than its successor; a run of one byte takes the kind of its end
    after = np.append(text[1:].astype(np.int16), -1)
    step = np.sign(after - text.astype(np.int16))
    place = np.flatnonzero(step)
    rising = step[place[np.searchsorted(place, np.arange(n))]] > 0
    direct = np.flatnonzero(rising)[::-1]  # shorter ones first, which decides what ties with zeros past the end
    padded = np.concatenate([text, np.zeros(16 + depth, np.uint8)]).astype(np.uint64)
    key = np.zeros(n + 8 + depth, np.uint64)
    for k in range(8):
        key |= padded[k : k + len(key)] << np.uint64(56 - 8 * k)
    order, group = direct, np.zeros(len(direct), np.int64)
    open_ = np.arange(len(direct))  # places whose order isn't settled, ascending
    for d in range(0, depth + 1, 8):
        if not len(open_):
            break
        here = order[open_]
        word = key[np.minimum(here + d, n)]
        by_word = np.argsort(word, kind="stable")
        by = by_word[np.argsort(group[open_][by_word], kind="stable")]
        order[open_] = here[by]
        word, old = word[by], group[open_]
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (old[1:] != old[:-1])])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(open_)))
        group[open_] = np.repeat(open_[at], size)
        open_ = open_[np.repeat(size > 1, size)]
    first = np.searchsorted(text[order], np.arange(257)) if len(order) else np.zeros(257, np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def deal(done: np.ndarray, own: int) -> np.ndarray:
        """Hands the predecessors that are to be induced to their buckets; returns those of the bucket ``own``."""
        before = done[done > 0] - 1
        before = before[~rising[before]]
        chars = text[before]
        mine = before[chars == own] if own >= 0 else before[:0]
        rest = chars != own
        before, chars = before[rest], chars[rest]
        if len(before):
            by = np.argsort(chars, kind="stable")
            before, chars = before[by], chars[by]
            cuts = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
            for a, b in zip(cuts, np.append(cuts[1:], len(chars)), strict=True):
                waiting[int(chars[a])].append(before[a:b])
        return mine

    deal(np.array([n]), -1)  # the empty suffix is the smallest
    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        waiting[c] = []
        while len(front):
            out.append(front)
            front = deal(front, c)
        back = order[first[c] : first[c + 1]]
        if len(back):
            out.append(back)
            deal(back, c)
    return np.concatenate(out)


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, counted up to ``depth``."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    end = len(text)
    for d in range(0, depth, 4):
        part = np.zeros(len(live), np.int64)
        still = np.ones(len(live), bool)
        for k in range(d, min(d + 4, depth)):
            x, y = a[live] + k, b[live] + k
            inside = (x < end) & (y < end)
            still &= inside
            still[still] = text[x[still]] == text[y[still]]
            part += still
        out[live] += part
        live = live[still]
    return out


def repeats(blobs: list[bytes], counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows of runs that share their bytes with another window: (owner's index, offset, class), by suffix order.

    Each blob holds ``counts`` windows; a class is a number that equal windows share and no others.
    """
    sizes = np.array([len(b) for b in blobs], np.int64)
    text = np.frombuffer(b"".join(blobs), np.uint8)
    begin = np.cumsum(sizes) - sizes
    order = two_stage_order(text, length)
    owner = np.repeat(np.arange(len(blobs)), sizes)
    offset = np.arange(len(text)) - np.repeat(begin, sizes)
    is_window = offset < np.repeat(counts, sizes)
    order = order[is_window[order]]
    same = common(text, order[:-1], order[1:], length) == length if len(order) > 1 else np.empty(0, bool)
    group = np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.empty(0, np.int64)
    multiple = np.bincount(group)[group] > 1 if len(order) else np.empty(0, bool)
    order, group = order[multiple], group[multiple]
    return np.stack([owner[order], offset[order]]), group


def repeated(docs: DataFrame, store: Stored, length: int = LENGTH, seed: int = SEED_BYTES) -> DataFrame:
    """The repeated runs of windows of ``docs`` (id, sum, text): id, sum, pos, n."""
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(0x9E3779B97F4A7C15, 7)

        def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            found, earliest = _classes(np.concatenate(held))
            repeat = (earliest != np.arange(len(found))) & ~_same_place(found, found[earliest])
            yield sending(found[repeat], mix64(found["f"][repeat] ^ found["sum"][repeat].view(np.uint64)), True)  # settled: goes anywhere
            found = found[earliest == np.arange(len(found))]  # one of each class goes on
            if not len(found):
                return
            head = np.flatnonzero(np.concatenate([[True], found["h"][1:] != found["h"][:-1]]))
            size = np.diff(np.append(head, len(found)))
            found["hot"] = np.repeat(size > HOT_IN_TASK, size)
            target = found["h"].copy()
            target[found["hot"]] = mix64(found["h"][found["hot"]] ^ found["f"][found["hot"]])
            told = found[head[size > HOT_IN_TASK]].copy()  # tells where the hash's other runs meet that it is hot
            told["n"] = 0
            found, target = np.concatenate([found, told]), np.concatenate([target, told["h"]])
            yield sending(found, target, False)

        def sending(found: np.ndarray, target: np.ndarray, settled: bool) -> pa.RecordBatch:
            cols = [np.full(len(found), settled), target.view(np.int64), found["h"].view(np.int64), found["f"].view(np.int64), *(found[k] for k in ("id", "sum", "pos", "n", "hot"))]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["settled", "target", "h", "f", "id", "sum", "pos", "n", "hot"])

        held: list[np.ndarray] = []
        size = 0
        for batch in slices(batches, "text"):
            data, at = raw(batch.column("text"))
            row, pos, n, h, same = runs(data, at, rolling, length, seed)
            found = np.zeros(len(row), RUN)
            found["h"], found["f"], found["pos"], found["n"] = h, same, pos, n
            found["id"] = batch.column("id").to_numpy()[row]
            found["sum"] = batch.column("sum").to_numpy()[row]
            held.append(found)
            size += len(found)
            if size > 1_000_000:
                yield from send(held)
                held, size = [], 0
        if size:
            yield from send(held)

    sent = arrow(docs, first_pass, SENT).repartition(buckets, "target")
    sent = sent.sortWithinPartitions("settled", "h", F.col("n") > 0, "f", "id", "sum", "pos", "n").drop("target")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs come sorted by hash, class and place, so only those of the last hash are held until the next."""
        open_ = _Hash()
        for batch in batches:
            settled = batch.column("settled").to_numpy(zero_copy_only=False)
            found = np.zeros(batch.num_rows, RUN)
            for k in ("id", "sum", "pos", "n", "hot"):
                found[k] = batch.column(k).to_numpy(zero_copy_only=False)
            for k in ("h", "f"):
                found[k] = batch.column(k).to_numpy().view(np.uint64)
            if settled.any():
                yield _marks(found[settled], True)
            yield from open_.take(found[~settled])
        yield from open_.close()

    found = store.put(arrow(sent, meet, FOUND), "runs")
    asked = found.where("not mark").groupBy("id", "sum").agg(F.collect_list(F.struct("pos", "n", "h", "hot")).alias("asked"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(0xD1342543DE82EF95, 11)
        for batch in slices(batches, "text"):
            key, n_, ids, sums, where, bodies = [], [], [], [], [], []
            for id, sum, body, runs_ in zip(batch.column("id").to_pylist(), batch.column("sum").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("asked").to_pylist(), strict=True):
                prefix = None
                for r in runs_:
                    p, n = r["pos"], r["n"]
                    if r["hot"]:
                        if prefix is None:
                            prefix = rolling.prefix(np.frombuffer(body, np.uint8))
                        at = np.arange(p, p + n)
                        own = mix64(rolling.ranges(prefix, at, at + length)).view(np.int64).tolist()
                        for k, x in enumerate(own):
                            key.append(x)
                            n_.append(1)
                            where.append(p + k)
                            bodies.append(body[p + k : p + k + length])
                    else:
                        key.append(r["h"])
                        n_.append(n)
                        where.append(p)
                        bodies.append(body[p : p + n - 1 + length])
                    ids += [id] * (len(key) - len(ids))
                    sums += [sum] * (len(key) - len(sums))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(ids, pa.int64()), pa.array(sums, pa.int64()), pa.array(where, pa.int32()), pa.array(n_, pa.int32()), pa.array(bodies, pa.binary())], names=["key", "id", "sum", "pos", "n", "body"])

    texts = docs.join(asked, ["id", "sum"]).select("id", "sum", "text", "asked")
    bodies = arrow(texts, extract, "key bigint, id bigint, sum bigint, pos int, n int, body binary")
    dealt = bodies.repartition(buckets, "key").sortWithinPartitions("key", "id", "sum", "pos")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {k: [] for k in ("key", "id", "sum", "pos", "n", "body")}
        size = 0

        def done() -> pa.RecordBatch:
            ids, sums, pos = (np.array(held[k], np.int64) for k in ("id", "sum", "pos"))
            (owner, offset), group = repeats(held["body"], np.array(held["n"], np.int64), length)
            at = pos[owner] + offset if len(owner) else np.empty(0, np.int64)
            order = np.lexsort((at, sums[owner], ids[owner], group))
            owner, at, group = owner[order], at[order], group[order]
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, np.int64)
            first = np.repeat(head, np.diff(np.append(head, len(group))))
            later = ~((ids[owner] == ids[owner][first]) & (sums[owner] == sums[owner][first]) & (at == at[first])) if len(group) else np.empty(0, bool)
            owner, at = owner[later], at[later]
            order = np.lexsort((at, owner))
            owner, at = owner[order], at[order]
            cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.empty(0, np.int64)
            n = np.diff(np.append(cut, len(at)))
            return pa.RecordBatch.from_arrays([pa.array(ids[owner[cut]]), pa.array(sums[owner[cut]]), pa.array(at[cut], pa.int32()), pa.array(n, pa.int32())], names=["id", "sum", "pos", "n"])

        for batch in batches:
            rows = {k: batch.column(k).to_pylist() for k in held}
            for k in range(batch.num_rows):
                if size > CHUNK_BYTES and rows["key"][k] != held["key"][-1]:
                    yield done()
                    size = 0
                    for x in held.values():
                        x.clear()
                elif size > 8 * CHUNK_BYTES and set(held["n"]) == {1}:  # a window of very many runs: the first of each text stays
                    yield done()
                    first = list({body: j for j, body in reversed(list(enumerate(held["body"])))}.values())
                    for x in held.values():
                        x[:] = [x[j] for j in first]
                    size = sum(map(len, held["body"]))
                for name, x in held.items():
                    x.append(rows[name][k])
                size += len(rows["body"][k])
        if size:
            yield done()

    spread = arrow(dealt, sort, "id bigint, sum bigint, pos int, n int")
    return found.where("mark").select("id", "sum", "pos", "n").unionByName(store.put(spread, "repeats"))


def removal(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Every row of ``docs`` as a struct ``row`` beside n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes).

    Texts are UTF-8 bytes.  Each byte that a string of ``length`` bytes covers which also starts earlier (smaller
    id, or the same text further left; they may overlap) is removed, judged on the input.  Removal may cut a
    character, so what is kept is binary.

    Null text is empty.  A text shorter than ``length`` is kept whole.  A null id comes first.  Rows equal in id
    and text are one document and get the same result; rows equal in id alone are ordered by a hash of their
    text.  No rows give no rows.  Other columns pass through in ``row``.
    """
    store = Stored(docs.sparkSession, "suffixes")
    value = as_text(docs, text)
    named = {"id": F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_FIRST)), "sum": F.xxhash64(value), "text": value}
    found = repeated(docs.select(*[c.alias(k) for k, c in named.items()]), store, length)
    marks = found.groupBy("id", "sum").agg(F.collect_list(F.struct("pos", "n")).alias("marks"))
    joined = packed(docs, **named).join(marks, ["id", "sum"], "left").select("row", "text", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            cols: list[list] = [[] for _ in range(5)]
            for body, marks in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("marks"), strict=True):
                kept, removed, spans = body, 0, 0
                if marks.is_valid:
                    flat = marks.values
                    pos, n = flat.field("pos").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
                    cover = np.zeros(len(body) + 1, np.int64)
                    np.add.at(cover, pos, 1)
                    np.add.at(cover, pos + n - 1 + length, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
                for c, x in zip(cols, (len(body), removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    c.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return arrow(joined, cut, with_row(joined, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"))
