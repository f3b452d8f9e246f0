"""Near-duplicate documents by bottom-k sketches of word shingles, confirmed on full sets.

1. One hash function over shingles.  A document keeps its k smallest hashes (its sketch) and two sums of all its
   hashes, by which equal sets meet as one class; only the smallest id of a class goes on.
2. Sketch values are ordered by how many sketches hold them, rare ones first.  Documents as similar as asked for
   share so many values that their first ``prefix`` ones must meet; inverted lists of these are the only place
   where documents are compared, and values that one document holds alone have no list.
3. In a list, sketches that overlap enough make a graph; each member reports the smallest member of its part of
   the graph, never its pairs.  Reports joined over all lists are candidate groups.
4. Groups fetch their full sets.  Pairs whose union-sketch estimate allows it are intersected exactly, and links
   make the components.  A group too large for a task is dealt in blocks: all blocks meet the first; what that
   leaves apart from the group's largest component then meets all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.graph import components

from .common import Rolling, Stored, arrow, as_text, mix64, packed, raw, slices

WORDS = 5
SIMILARITY = (80, 100)
SKETCH = 48
MISS = 1e-6  # chance that two documents just as similar as asked for share too few sketch values
LIST_BLOCK = 2048
GROUP_BLOCK = 2048
GROUP_BYTES = 16 << 20
TEXT_BYTES = 1 << 20  # shingled at a time
PAIRS = 8192  # compared at a time
ROWS = 256  # of a table of pairs at a time
FIRST_ROWS = 8  # of a group at first, then twice as many each time: what they link meets no more
FEW = 8  # sets that a value's pairs are listed for, among more than SMALL
SMALL = 64
TASK_EDGES = 1 << 20  # that one task joins; more are joined by star rounds
_FIRST = -(1 << 63)

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def overlap_needed(share: float, size: int = SKETCH, miss: float = MISS) -> int:
    """The most values that two sketches share but for a chance of ``miss``, each value being shared with chance ``share``."""
    tail = 0.0
    for n in range(size + 1):
        tail += comb(size, n) * share**n * (1 - share) ** (size - n)
        if tail >= miss:
            return n
    return size


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, words: int = WORDS):
        self.words, self.rolling = words, Rolling(0x9E3779B97F4A7C15, 5)
        self.odd = mix64(np.arange(1, words + 2, dtype=np.uint64)) | np.uint64(1)

    def sets(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        data = _LOWER[data]
        solid = np.concatenate([[False], ~_SPACE[data], [False]])
        begin = np.flatnonzero(solid[1:-1] & ~solid[:-2])
        # words end at white space and at the end of a text
        starts = np.zeros(len(data) + 1, bool)
        starts[begin] = True
        inner = at[:-1][(np.diff(at) > 0)]
        starts[inner[solid[1:-1][inner]]] = True if len(data) else False
        begin = np.flatnonzero(starts[:-1])
        stops = np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1
        end = np.union1d(stops, at[1:][(np.diff(at) > 0)])
        end = end[np.searchsorted(end, begin, "right")] if len(begin) else begin
        prefix = self.rolling.prefix(data)
        word = mix64(self.rolling.ranges(prefix, begin, end))
        first = np.searchsorted(begin, at)
        n = max(len(word) - self.words + 1, 0)
        total = np.zeros(n, np.uint64)
        for k in range(self.words):
            total += word[k : k + n] * self.odd[k]
        total = mix64(total)
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= self.words:
                x = np.sort(total[a : b - self.words + 1])
                out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif b > a:
                out.append(mix64(np.array([(word[a:b] * self.odd[: b - a]).sum() + np.uint64(b - a) * self.odd[-1]], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges (a, b) reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _counts(values: np.ndarray, owner: np.ndarray, n: int, columns: int = 2048) -> np.ndarray:
    """How many values each two different ones of n sets share (each set's values are distinct)."""
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    head = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.empty(0, bool)
    size = np.diff(np.append(np.flatnonzero(head), len(values)))
    out = np.zeros((n, n), np.float32)
    # Values of few sets: their pairs one by one, else a product of matrices.
    most = FEW if n > SMALL else 1
    few = np.repeat((size > 1) & (size <= most), size)
    column, own = np.cumsum(head[few]), owner[few]
    for k in range(1, most):
        at = np.flatnonzero(column[k:] == column[:-k])
        for x, y in ((own[at], own[at + k]), (own[at + k], own[at])):
            np.add.at(out.reshape(-1), x * n + y, np.float32(1))
    keep = np.repeat(size > most, size)
    owner, column = owner[keep], (np.cumsum(head[keep]) - 1 if keep.any() else np.empty(0, np.int64))
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [c, c + columns])
        has = np.zeros((n, min(columns, int(column[-1]) + 1 - c)), np.float32)
        has[owner[a:b], column[a:b] - c] = 1
        out += has @ has.T
    return out


def _needed(rows: np.ndarray, cols: np.ndarray, num: int, den: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """For sets of these sizes: shared sketch values to be expected at least, and whether the sizes allow the similarity."""
    low, high = np.minimum(rows[:, None], cols[None, :]), np.maximum(rows[:, None], cols[None, :])
    exact = -(-num * (low + high) // (num + den))
    lost = np.maximum(high - SKETCH, 0)
    least = np.where(high <= SKETCH, exact, np.where(low <= SKETCH, np.minimum(exact - lost, need), need))
    return least, low * den >= num * high


def _linked(sets: list[np.ndarray], label: np.ndarray, num: int, den: int, against: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets, similar enough by exact intersection, that join all labels which such pairs join.

    Sets of one label do not meet, nor do those whose labels pairs before them have joined.  ``against`` marks sets that
    need not meet each other, only the unmarked ones.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    top, owner = np.minimum(size, SKETCH), np.arange(n)
    label = np.unique(label, return_inverse=True)[1]
    # Union sketch: of the k smallest values of the union, the share that both hold; five deviations of doubt.
    least = num / den - 5 * sqrt(num / den * (1 - num / den) / SKETCH)
    heads = [s[:SKETCH] for s in sets]
    met = _counts(np.concatenate(heads), np.repeat(owner, top), n).astype(np.uint8)
    sketch = np.full((n, SKETCH), np.iinfo(np.uint64).max, np.uint64)
    for k, s in enumerate(heads):
        sketch[k, : len(s)] = s
    whole = None
    first, second = [owner[:0]], [owner[:0]]
    k, step = 0, FIRST_ROWS
    while k < n:
        rows = owner[k : k + step]
        part = size[rows][:, None]
        ok = (owner > rows[:, None]) & (label[rows][:, None] != label) & (np.minimum(part, size) * den >= num * np.maximum(part, size)) & (part > 0)
        # Both hold no more of the union's smallest values than of their own, and it is as large as the larger set at least.
        ok &= (part + size <= SKETCH) | (met[rows] >= least * np.maximum(top[rows][:, None], top))
        if against is not None:
            ok &= ~(against[rows][:, None] & against)
        a, b = np.nonzero(ok)
        a += k
        k, step = k + step, min(2 * step, ROWS)
        keep = np.zeros(len(a), bool)
        for c in range(0, len(a), PAIRS):
            x, y = a[c : c + PAIRS], b[c : c + PAIRS]
            union = np.sort(np.concatenate([sketch[x], sketch[y]], axis=1), axis=1)
            double = np.concatenate([union[:, 1:] == union[:, :-1], np.zeros((len(x), 1), bool)], axis=1) & (union != np.iinfo(np.uint64).max)
            single = np.concatenate([np.ones((len(x), 1), bool), union[:, 1:] != union[:, :-1]], axis=1) & (union != np.iinfo(np.uint64).max)
            rank = np.cumsum(single, axis=1)
            within = np.minimum(rank[:, -1], SKETCH)
            both = (double & (rank <= within[:, None])).sum(axis=1)
            keep[c : c + PAIRS] = both >= np.where(size[x] + size[y] <= SKETCH, 0, least * within)
        a, b = a[keep], b[keep]
        if len(a) > 64:
            whole = _counts(np.concatenate(sets), np.repeat(owner, size), n) if whole is None else whole
            shared = whole[a, b].astype(np.int64)
        else:
            shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
        ok = den * shared >= num * (size[a] + size[b] - shared)
        if ok.any():
            first.append(a[ok])
            second.append(b[ok])
            label = _roots(n, label[a[ok]], label[b[ok]])[label]
    return np.concatenate(first), np.concatenate(second)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, s1, s2, sketch) of docs (id, text)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", TEXT_BYTES):
                sets = shingler.sets(*raw(batch.column("text")))
                s1 = np.array([mix64(s ^ np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                s2 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1), pa.array(s2), pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary())],
                    names=["id", "n", "s1", "s2", "sketch"],
                )

    return arrow(docs, kernel, "id bigint, n bigint, s1 bigint, s2 bigint, sketch binary")


def joined(edges: DataFrame, store: Stored) -> DataFrame:
    """(node, component) of stored edges (a, b), as ``components`` gives it.

    Its rounds are some ten shuffles each, however few the edges; up to ``TASK_EDGES`` are joined by one task instead.
    """
    if edges.count() > TASK_EDGES:
        return components(edges, store)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches if batch.num_rows]
        if pairs:
            a, b = map(np.concatenate, zip(*pairs, strict=True))
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = _roots(len(ids), at[: len(a)], at[len(a) :])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["node", "component"])

    return store.put(arrow(edges.select("a", "b").coalesce(1), kernel, "node bigint, component bigint"), "components")


def candidate_groups(reps: DataFrame, store: Stored, num: int, den: int) -> DataFrame:
    """(id, group) of the representatives (id, n, sketch) that share enough of their sketches with another one."""
    spark, need = reps.sparkSession, overlap_needed(num / den)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.int64)
            size = np.minimum(batch.column("n").to_numpy(), SKETCH)
            for k in range(0, len(flat), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), size)[k : k + 500_000]), pa.array(flat[k : k + 500_000])], names=["id", "value"])

    entries = arrow(reps.select("id", "n", "sketch"), spread, "id bigint, value bigint")
    shared = store.put(entries.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    # Values that a document holds alone come first in its order and need no list: their number is what is left.
    held = entries.join(shared, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    whole = F.ceil(F.col("n") * num / den)
    prefix = F.when(F.col("n") > SKETCH, F.lit(SKETCH - need + 1)).otherwise(F.least(F.col("n"), F.col("n") - whole + 1 + F.greatest(F.ceil(F.col("n") * den / num) - SKETCH, F.lit(0))))
    listed = reps.select("id", "n", "sketch").join(held, "id").withColumn("left", (prefix - (F.least(F.col("n"), F.lit(SKETCH)) - F.size("held"))).cast("int"))
    listed = listed.where("left > 0").select("id", "n", "sketch", F.explode(F.slice("held", F.lit(1), F.col("left"))).alias("e")).select(F.col("e.value").alias("value"), F.col("e.df").alias("df"), "id", "n", "sketch")
    listed = store.put(listed.withColumn("blocks", F.ceil(F.col("df") / LIST_BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("df"), "lists")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def edges(ids: np.ndarray, n: np.ndarray, bodies: list[bytes]) -> None:
            if len(ids) < 2:
                return
            order = np.argsort(ids, kind="stable")
            ids, n, bodies = ids[order], n[order], [bodies[k] for k in order]
            top = np.minimum(n, SKETCH)
            owner = np.repeat(np.arange(len(ids)), top)
            count = _counts(np.frombuffer(b"".join(bodies), np.uint64), owner, len(ids))
            first, second = [], []
            for k in range(0, len(ids), ROWS):
                least, fits = _needed(n[k : k + ROWS], n, num, den, need)
                x, y = np.nonzero((count[k : k + ROWS] >= least) & fits)
                first.append(x[y > x + k] + k)
                second.append(y[y > x + k])
            a, b = np.concatenate(first), np.concatenate(second)
            if len(a):
                root = _roots(len(ids), a, b)
                own = np.flatnonzero(root != np.arange(len(ids)))
                seen.update(zip(ids[own].tolist(), ids[root[own]].tolist(), strict=True))

        held: tuple[list, list, list] = ([], [], [])
        now = None
        for batch in batches:
            rows = zip(batch.column("value").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("id").to_pylist(), batch.column("n").to_pylist(), batch.column("sketch").to_pylist(), strict=True)
            for value, x, y, id, n, sketch in rows:
                if (value, x, y) != now:
                    if now is not None:
                        edges(np.array(held[0]), np.array(held[1]), held[2])
                    held, now = ([], [], []), (value, x, y)
                for to, one in zip(held, (id, n, sketch), strict=True):
                    to.append(one)
            if len(seen) > 200_000:
                yield _edges(seen)
                seen.clear()
        if now is not None:
            edges(np.array(held[0]), np.array(held[1]), held[2])
        if seen:
            yield _edges(seen)

    def run(rows: DataFrame) -> DataFrame:
        dealt = rows.select("value", "x", "y", "id", "n", "sketch").repartition(parts, "value", "x", "y").sortWithinPartitions("value", "x", "y")
        return store.put(arrow(dealt, compare, "a bigint, b bigint"), "candidates")

    # A list of more than a block's members is dealt in blocks, and each meets the first one.
    at = F.when((F.col("blocks") > 1) & (F.col("own") == 0), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    found = run(listed.select("value", F.lit(0).alias("x"), F.explode(at).alias("y"), "id", "n", "sketch"))
    many = listed.where("blocks > 1")
    if many.limit(1).count():
        # What that leaves apart from the list's largest component then meets all blocks.
        many = many.join(joined(found, store), F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "id"))
        main = many.groupBy("value", "label").agg(F.count("*").alias("c")).groupBy("value").agg(F.max(F.struct("c", "label")).alias("m")).select("value", F.col("m.label").alias("main"))
        many = many.join(main, "value")
        rest = many.where("label <> main").groupBy("value").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("outer"))
        many = many.join(rest, "value")
        outer = many.where("label <> main").select("value", (F.pmod(F.xxhash64("id"), "outer") + 1).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), "id", "n", "sketch")
        inner = many.select("value", F.explode(F.sequence(F.lit(1), F.col("outer"))).alias("x"), F.col("own").alias("y"), "id", "n", "sketch")
        found = found.unionByName(run(outer.unionByName(inner).distinct()))
    return joined(found, store).select(F.col("node").alias("id"), F.col("component").alias("group"))


def _edges(pairs) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(docs: DataFrame, reps: DataFrame, groups: DataFrame, store: Stored, words: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) between representatives that join each component, confirmed on full sets."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    sized = groups.join(reps.select("id", "n"), "id")
    blocks = sized.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / GROUP_BLOCK), F.ceil(F.sum("n") * 8 / GROUP_BYTES)).cast("int").alias("blocks"))
    members = store.put(sized.join(blocks, "group").select("id", "group", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("own")), "members")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        keep = ["id", "group", "blocks", "own"]
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", TEXT_BYTES):
                sets = shingler.sets(*raw(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*keep, "set"])

    # An id's rows may differ in text: the set that has its representative's sums is the one to compare.
    fetched = store.put(arrow(docs.select("id", "text").join(members, "id").select("id", "group", "blocks", "own", "text"), full, "id bigint, group bigint, blocks int, own int, set binary"), "sets")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: set[tuple[int, int]] = set()

        def done() -> None:
            if len(held) < 2:
                return
            held.sort(key=lambda r: (r[0], r[2]))
            ids, labels = np.array([r[0] for r in held]), np.array([r[1] for r in held])
            against = np.array([r[2] for r in held], bool)
            a, b = _linked([np.frombuffer(r[3], np.uint64) for r in held], labels, num, den, against if against.any() else None)
            if len(a):
                root = _roots(len(ids), a, b)
                own = np.flatnonzero(ids != ids[root])
                out.update(zip(ids[own].tolist(), ids[root[own]].tolist(), strict=True))

        now = None
        for batch in slices(batches, "set", 4 << 20):
            cols = [batch.column(k).to_pylist() for k in ("group", "x", "y", "id", "label", "against", "set")]
            for group, x, y, *row in zip(*cols, strict=True):
                if (group, x, y) != now:
                    done()
                    held, now = [], (group, x, y)
                held.append(tuple(row))
            if len(out) > 200_000:
                yield _edges(out)
                out.clear()
        done()
        if out:
            yield _edges(out)

    def run(rows: DataFrame) -> DataFrame:
        dealt = rows.select("group", "x", "y", "id", "label", "against", "set").repartition(parts, "group", "x", "y").sortWithinPartitions("group", "x", "y")
        return store.put(arrow(dealt, meet, "a bigint, b bigint"), "links")

    # First the blocks against the first one; a block meets itself there as well.
    at = F.when((F.col("blocks") > 1) & (F.col("own") == 0), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    found = run(fetched.select("group", F.lit(0).alias("x"), F.explode(at).alias("y"), "id", F.col("id").alias("label"), F.lit(False).alias("against"), "set"))
    if members.where("blocks > 1").limit(1).count():
        # Then what isn't in a large group's largest component against all its blocks.
        label = joined(found, store)
        many = fetched.where("blocks > 1").join(label, F.col("id") == F.col("node"), "left").select("group", "blocks", "own", "id", F.coalesce("component", "id").alias("label"), "set")
        main = many.groupBy("group", "label").agg(F.count("*").alias("c")).groupBy("group").agg(F.max(F.struct("c", "label")).alias("m")).select("group", F.col("m.label").alias("main"))
        many = many.join(main, "group")
        rest = many.where("label <> main").groupBy("group").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("outer"))
        many = many.join(rest, "group")
        outer = many.where("label <> main").select("group", F.pmod(F.xxhash64("id"), "outer").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"), "id", "label", F.lit(False).alias("against"), "set")
        inner = many.select("group", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("x"), F.col("own").alias("y"), "id", "label", F.lit(True).alias("against"), "set")
        found = found.unionByName(run(outer.unionByName(inner)))
    return found


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, words: int = WORDS) -> DataFrame:
    """One row for each of ``docs``: its id, n_shingles, component_id and kept.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a set holds the distinct runs of
    ``words`` words, or all words as one where there are fewer.  Documents link where num * union size <=
    den * intersection size for ``similarity`` (num, den); component_id is the smallest id that links reach and
    kept says that it is the document's own.

    A text that is null or has no words has an empty set, which links with nothing.  A null id counts as the
    smallest and stays null.  Rows that share an id are one document of the component, each with its own
    n_shingles; repeated rows repeat their result, and similarities that tie with the bound link.  A very long
    text gives one set of all its shingles, one batch of a task at a time.  No rows give no rows.  Other columns
    are not read.
    """
    num, den = similarity
    store = Stored(docs.sparkSession, "minhash")
    plain = docs.select(F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_FIRST)).alias("id"), as_text(docs, text).alias("text"))
    table = store.put(sketches(plain, words), "sketches")
    kinds = ["n", "s1", "s2"]
    # Equal sets have equal sketches, so any of the class will do.
    reps = store.put(table.where("n > 0").groupBy(*kinds).agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")), "classes")
    groups = store.put(candidate_groups(reps, store, num, den), "groups")
    found = links(plain, reps, groups, store, words, num, den)
    # Rows of one id with different sets are joined through the id.
    classes = reps.select(*kinds, F.col("id").alias("rep"))
    alike = store.put(table.where("n > 0").join(classes, kinds).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")), "alike")
    label = joined(found.unionByName(alike), store)
    out = table.select("id", "n").join(label, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    shown = lambda c: F.when(F.col(c) != _FIRST, F.col(c))
    return out.select(shown("id").alias(id), F.col("n").alias("n_shingles"), shown("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with their own columns."""
    gone = near_duplicates(docs, id, text, **options).where("not kept").select(F.col(id).alias("gone")).distinct()
    rows = packed(docs, k=F.col(f"`{id}`").cast("long"))
    return rows.join(gone, F.col("k") == F.col("gone"), "left_anti").select("row.*")
