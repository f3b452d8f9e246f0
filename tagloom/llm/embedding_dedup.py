"""Near-duplicate embeddings by search in robust-pruned graphs over overlapping cluster shards.

0. Equal vectors make a class, which is one vector with a weight from here on, so exact copies cost nothing.
1. Centroids are fitted on a bounded sample; every vector goes to its nearest one and to the next few whose
   cosine is within ``overlap`` of that, so close vectors share a shard.  Large tables are divided so twice.
2. Each shard builds a graph: a vector's nearest candidates, pruned so that a kept neighbour hides those much
   closer to it than to the vector, and the reverse edges.  A vector's lists from all its shards are united.
3. In each shard every vector searches the graph greedily from the medoid, then expands from what it found and
   from its own neighbours through everything within range.  Vectors that the search connects are verified
   against each other in double precision.  Rows of two blocks of a shard are compared by a matrix product.
4. A pair counts in its smallest common shard only, so no pairs leave a task: it reports numbers of links and,
   for the components, each vector's root in the shard.
5. The links between different vectors are counted by brute force over all classes for a sample that is drawn
   until enough of it has some; if the recall is too low, the search is repeated with a larger overlap, any
   number of shards a vector and all cosines of a shard, at last with the overlap at which two linked vectors always share a shard.  That misses
   nothing; if the audit still finds less, an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.graph import components

from .common import Stored, arrow

COSINE = 0.95
SAMPLE_ROWS = 16_384  # that centroids are fitted on, at most
MAX_CENTROIDS = 2048
SHARD_ROWS = 2000  # of the rows that are nearest to a centroid, on average
BLOCK_ROWS = 8192  # shards of more rows are dealt in blocks, every two of which meet
OVERLAP = 0.1
DEGREE = 16
NEAREST = 3  # centroids that a vector goes to, at most, as long as the audit finds that enough
SALTS = 16  # parts that rows of a shard are dealt in while it is divided
CANDIDATES = 32
BEAM = 24
ALPHA = 1.2
AUDIT_ROWS = 256  # drawn at first, then eight times as many
AUDIT_MOST = 16_384  # at most, which compares about as many pairs as the search does
AUDIT_LINKED = 64  # classes with links that are enough
AUDIT_RECALL = 0.98
_FIRST = -(1 << 63)


def unit(flat: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 in double precision, and which of them have a direction."""
    x = flat.reshape(-1, dim).astype(np.float64)
    with np.errstate(all="ignore"):
        big = np.abs(x).max(axis=1, initial=0.0)
        x = x / big[:, None]
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return x, np.isfinite(x).all(axis=1)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c


def build(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Robust-pruned neighbours (n x degree, -1 where there are fewer) of unit vectors."""
    n = len(x)
    m = min(candidates, n - 1)
    out = np.full((n, degree), -1, np.int64)
    if m <= 0:
        return out
    for a in range(0, n, 512):
        sim = x[a : a + 512] @ x.T
        rows = np.arange(len(sim))
        sim[rows, rows + a] = -2
        pool = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        order = np.argsort(-np.take_along_axis(sim, pool, axis=1), axis=1, kind="stable")
        pool = np.take_along_axis(pool, order, axis=1)
        near = 1 - np.take_along_axis(sim, pool, axis=1)  # half the squared distance
        around = x[pool].astype(np.float32)
        among = 1 - around @ around.transpose(0, 2, 1)
        alive = np.ones(pool.shape, bool)
        count = np.zeros(len(sim), np.int64)
        for p in range(m):
            take = np.flatnonzero(alive[:, p] & (count < degree))
            out[take + a, count[take]] = pool[take, p]
            count[take] += 1
            hidden = alpha * alpha * among[take, p, :] <= near[take]
            alive[take] &= ~hidden
    return out


def reverse(neighbours: np.ndarray, most: int) -> np.ndarray:
    """The neighbours with up to ``most`` of those that have the row as theirs."""
    n = len(neighbours)
    a, b = np.nonzero(neighbours >= 0)
    target = neighbours[a, b]
    order = np.argsort(target, kind="stable")
    source, target = a[order], target[order]
    nth = np.arange(len(target)) - np.searchsorted(target, target)
    keep = nth < most
    back = np.full((n, most), -1, np.int64)
    back[target[keep], nth[keep]] = source[keep]
    return np.concatenate([neighbours, back], axis=1)


def search(x: np.ndarray, neighbours: np.ndarray, starts: np.ndarray, threshold: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """All (query, found) pairs with a cosine of at least ``threshold`` that every vector's search meets."""
    n = len(x)
    out_a, out_b = [], []
    degree = neighbours.shape[1]
    step = max(64, min(n, (8 << 20) // max(n, 1)))
    for q0 in range(0, n, step):
        q = np.arange(q0, min(q0 + step, n))
        rows = np.arange(len(q))
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True  # stands for no neighbour
        width = beam + degree
        node = np.full((len(q), width), n, np.int64)
        sim = np.full((len(q), width), -3.0)
        done = np.ones((len(q), width), bool)
        first = starts[:beam]
        node[:, : len(first)] = first
        sim[:, : len(first)] = x[q] @ x[first].T
        done[:, : len(first)] = False
        seen[:, first] = True
        live = rows
        while len(live):
            open_ = np.where(done[live, :beam], -3.0, sim[live, :beam])
            best = np.argmax(open_, axis=1)
            more = open_[np.arange(len(live)), best] > -3.0
            live, best = live[more], best[more]
            if not len(live):
                break
            done[live, best] = True
            around = neighbours[node[live, best]]
            around = np.where(around < 0, n, around)
            fresh = ~seen[live[:, None], around]
            seen[live[:, None], around] = True
            near = np.einsum("nd,nkd->nk", x[q[live]], x[np.where(around < n, around, 0)])
            node[live, beam:] = around
            sim[live, beam:] = np.where(fresh, near, -3.0)
            done[live, beam:] = ~fresh
            order = np.argsort(-sim[live], axis=1, kind="stable")
            node[live] = np.take_along_axis(node[live], order, axis=1)
            sim[live] = np.take_along_axis(sim[live], order, axis=1)
            done[live] = np.take_along_axis(done[live], order, axis=1)
        hit_q, hit_k = np.nonzero(sim[:, :beam] >= threshold)
        inside = np.zeros((len(q), n + 1), bool)
        inside[hit_q, node[hit_q, hit_k]] = True
        inside[rows, q] = True
        tried = inside.copy()
        tried[:, n] = True
        a, b = np.nonzero(inside[:, :n])
        while len(a):
            next_a, next_b = [], []
            for k in range(0, len(a), 50_000):
                pa_, pb_ = a[k : k + 50_000], neighbours[b[k : k + 50_000]]
                pb_ = np.where(pb_ < 0, n, pb_)
                new = ~tried[pa_[:, None], pb_]
                pairs = np.unique(np.repeat(pa_, degree).reshape(pb_.shape)[new] * np.int64(n + 1) + pb_[new])
                ya, yb = pairs // (n + 1), pairs % (n + 1)
                tried[ya, yb] = True
                near = np.einsum("nd,nd->n", x[q[ya]], x[yb]) >= threshold
                inside[ya[near], yb[near]] = True
                next_a.append(ya[near])
                next_b.append(yb[near])
            a, b = np.concatenate(next_a), np.concatenate(next_b)
        a, b = np.nonzero(inside[:, :n])
        out_a.append(q[a])
        out_b.append(b)
    return np.concatenate(out_a), np.concatenate(out_b)


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component, once the pairs (a, b) join those that ``root`` has."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _by_length(batch: pa.RecordBatch, name: str = "v") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors in ``name``: the rows that have a direction, and them scaled to length 1."""
    column = batch.column(name)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        same = column if len(rows) == len(sizes) else column.take(pa.array(rows))
        x, ok = unit(same.flatten().to_numpy(zero_copy_only=False), int(dim))
        yield rows[ok], x[ok]


def chosen(x: np.ndarray, centroids: np.ndarray, overlap: float, most: int | None) -> np.ndarray:
    """Which centroids each row goes to: its ``most`` nearest (None: all) of those within ``overlap`` of the nearest."""
    sim = x @ centroids.T
    near = sim >= sim.max(axis=1, initial=-2)[:, None] - overlap
    if most is not None and most < sim.shape[1]:
        nearest = np.zeros(sim.shape, bool)
        np.put_along_axis(nearest, np.argpartition(-sim, most - 1, axis=1)[:, :most], True, axis=1)
        near &= nearest
    return near


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))


def _matrix(rows: pa.Table, name: str = "x") -> np.ndarray:
    flat = rows.column(name).combine_chunks().flatten().to_numpy()
    return flat.reshape(rows.num_rows, -1)


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys, for rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in key], axis=1)
        cut = np.flatnonzero(np.concatenate([[True], (cols[1:] != cols[:-1]).any(axis=1)]))
        for a, b in zip(cut, np.append(cut[1:], len(cols)), strict=True):
            name = tuple(cols[a].tolist())
            if name != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = name
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


PLACED = "id bigint, m bigint, shards array<bigint>, x array<double>"


def _placed(vectors: DataFrame, store: Stored, centroids: np.ndarray | None, overlap: float, most: int | None) -> DataFrame:
    """Classes (id, m, v) with the shards they go to; without centroids, one for each length of vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                ids, m = part.column("id").to_numpy(), part.column("m").to_numpy()
                for rows, x in _by_length(part):
                    near = np.ones((len(x), 1), bool) if sent.value is None else chosen(x, sent.value, overlap, most)
                    shard = np.nonzero(near)[1].astype(np.int64)
                    if sent.value is None:
                        shard += x.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(m[rows]), _lists(shard, near.sum(axis=1)), _lists(x.reshape(-1), np.full(len(x), x.shape[1]))], names=["id", "m", "shards", "x"])

    return store.put(arrow(vectors.select("id", "m", "v"), assign, PLACED), "placed")


def _refined(placed: DataFrame, store: Stored, overlap: float, most: int | None) -> DataFrame:
    """The same with each shard dealt to centroids of its own, fitted on a bounded sample of it in one task.

    A shard's centroids travel to its rows ahead of them, once for each of ``SALTS`` parts of the shard."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    cells = placed.select("id", "m", "x", F.explode("shards").alias("cell"))
    sizes = cells.groupBy("cell").agg(F.least(F.ceil(F.count("*") / SHARD_ROWS), F.lit(MAX_CENTROIDS)).cast("int").alias("k"))
    sample = cells.select("cell", "x", F.row_number().over(Window.partitionBy("cell").orderBy("id")).alias("nth")).where(F.col("nth") <= SAMPLE_ROWS).join(sizes, "cell")
    sample = sample.where(F.col("nth") <= F.greatest(F.lit(64), 64 * F.col("k"))).select("cell", "k", "x").repartition(parts, "cell").sortWithinPartitions("cell")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, k), rows in _groups(batches, ["cell", "k"]):
            x = _matrix(rows)
            own = fit_centroids(x, min(k, -(-len(x) // 8)))
            yield pa.RecordBatch.from_arrays([pa.array([cell]), _lists(own.reshape(-1), np.array([own.size]))], names=["cell", "x"])

    fitted = store.put(arrow(sample, fit, "cell bigint, x array<double>"), "centroids")
    heads = fitted.select("cell", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(None).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("m"), "x")
    rows = cells.select("cell", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"), "id", "m", "x")
    dealt = heads.unionByName(rows).repartition(parts, "cell", "salt").sortWithinPartitions("cell", "salt", F.col("id").asc_nulls_first())
    wide = MAX_CENTROIDS

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = None, None
        for batch in batches:
            begin, cell, salt, heads = 0, batch.column("cell").to_numpy(), batch.column("salt").to_numpy(), batch.column("id").is_null().to_numpy(zero_copy_only=False)
            while begin < batch.num_rows:
                if heads[begin]:
                    name, own, begin = (cell[begin], salt[begin]), batch.column("x")[begin].values.to_numpy(), begin + 1
                    continue
                after = np.flatnonzero(heads[begin:])
                end = min(begin + 2048, batch.num_rows, begin + int(after[0]) if len(after) else batch.num_rows)
                part = batch.slice(begin, end - begin)
                if not ((cell[begin:end] == name[0]) & (salt[begin:end] == name[1])).all():
                    raise ValueError("vectors came without the centroids of their shard")
                x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                near = chosen(x, own.reshape(-1, x.shape[1]), overlap, most)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("m"), _lists(np.nonzero(near)[1].astype(np.int64) + int(name[0]) * wide, near.sum(axis=1)), part.column("x")], names=["id", "m", "shards", "x"])
                begin = end

    out = arrow(dealt, assign, PLACED).groupBy("id").agg(F.any_value("m").alias("m"), F.flatten(F.collect_list("shards")).alias("shards"), F.any_value("x").alias("x"))
    return store.put(out, "placed")


def _linked(placed: DataFrame, store: Stored, threshold: float, whole: bool, few: bool) -> tuple[DataFrame, DataFrame]:
    """(id, n_links, n_others) of placed classes, and the edges (a, b) of each shard's components.

    Links count rows and others classes.  ``whole`` compares all rows of a shard and not those a search connects;
    ``few`` says that there are at most ``MAX_CENTROIDS`` shards."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    spread = placed.select("id", "m", "shards", "x", F.explode("shards").alias("shard"))
    blocks = spread.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    spread = spread.join(F.broadcast(blocks) if few else blocks, "shard").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))

    def graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, ["shard", "own"]):
            x = _matrix(rows)
            ids = rows.column("id").to_numpy()
            lists = reverse(build(x), DEGREE // 2)
            size = (lists >= 0).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(ids[lists[lists >= 0]], size)], names=["id", "near"])

    built = arrow(spread.select("shard", "own", "id", "x").repartition(parts, "shard", "own").sortWithinPartitions("shard", "own", "id"), graph, "id bigint, near array<bigint>")
    united = built.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    dealt = spread.join(united, "id").select("shard", "own", "id", "m", "shards", "x", "near", F.explode(meets).alias("meet")).select("shard", "meet.i", "meet.j", "own", "id", "m", "shards", "x", "near")
    dealt = dealt.repartition(parts, "shard", "i", "j").sortWithinPartitions("shard", "i", "j", "id")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, i, j), rows in _groups(batches, ["shard", "i", "j"]):
            x = _matrix(rows)
            ids, own, weight = rows.column("id").to_numpy(), rows.column("own").to_numpy(), rows.column("m").to_numpy()
            lists = rows.column("near").combine_chunks()
            flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            spot = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            here = ids[spot] == flat
            row, spot = np.repeat(np.arange(len(ids)), np.diff(at))[here], spot[here]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            near = np.full((len(ids), int(nth.max(initial=0)) + 1), -1, np.int64)
            near[row, nth] = spot
            sets = rows.column("shards").combine_chunks()
            held, of = sets.flatten().to_numpy(), np.repeat(np.arange(len(ids)), sets.value_lengths().to_numpy())
            earlier = np.unique(held[held < shard])
            lower = np.zeros((len(ids), len(earlier)), np.float32)
            lower[of[held < shard], np.searchsorted(earlier, held[held < shard])] = 1
            links = np.zeros(len(ids), np.int64)
            root = np.arange(len(ids))
            others = np.zeros(len(ids), np.int64)
            if i != j or whole:  # lists end at a block, so its rows are compared with all of the other one
                left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
                other = x[right].T
                for k in range(0, len(left), 512):
                    g = left[k : k + 512]
                    near = x[g] @ other >= threshold
                    near &= ids[g][:, None] != ids[right]
                    p, q = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                    if not len(p):
                        continue
                    g, h, near = g[p], right[q], near[np.ix_(p, q)]
                    a, b = np.nonzero(near)
                    root = merged(root, g[a], h[b])
                    near &= lower[g] @ lower[h].T == 0
                    links[g] += near @ weight[h]
                    others[g] += near.sum(axis=1)
                    if i != j:
                        links[h] += weight[g] @ near
                        others[h] += near.sum(axis=0)
            else:
                start = np.argmax(x @ x.mean(axis=0))
                root = merged(root, *search(x, near, np.array([start]), threshold))
                # Verify: all cosines within what the search has connected, a block of rows at a time.  A pair counts
                # where its smallest common shard is.
                order = np.argsort(root, kind="stable")
                for group in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
                    for k in range(0, len(group) if len(group) > 1 else 0, 512):
                        g = group[k : k + 512]
                        near = x[g] @ x[group].T >= threshold
                        near &= ids[g][:, None] != ids[group]
                        near &= lower[g] @ lower[group].T == 0
                        links[g] += near @ weight[group]
                        others[g] += near.sum(axis=1)
            some = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some], pa.int64()), pa.array(others[some], pa.int64()), pa.array(ids[root[some]])], names=["id", "links", "others", "root"])

    found = store.put(arrow(dealt, find, "id bigint, links bigint, others bigint, root bigint"), "found")
    return found.groupBy("id").agg(F.sum("links").alias("n_links"), F.sum("others").alias("n_others")), found.select(F.col("id").alias("a"), F.col("root").alias("b"))


def _audit(classes: DataFrame, dim: int, threshold: float) -> dict[int, int]:
    """Brute-force numbers of linked classes, where there are any, of the classes with the smallest names.

    Classes are drawn until ``AUDIT_LINKED`` of them have links, all are drawn or ``AUDIT_MOST`` are."""
    out: dict[int, int] = {}
    most, last = AUDIT_ROWS, None
    while True:
        rest = classes if last is None else classes.where(F.col("id") > F.lit(last))
        picked = rest.orderBy("id").limit(most).select("id", "v").collect()
        if not picked:
            return out
        ids = np.array([r.id for r in picked], np.int64)
        x, ok = unit(np.array([r.v for r in picked], np.float64).reshape(-1), dim)
        out.update(_counted(classes, ids[ok], x[ok], threshold))
        if len(out) >= AUDIT_LINKED or len(picked) < most or most >= AUDIT_MOST:
            return out
        most, last = min(8 * most, AUDIT_MOST), int(ids[-1])


def _counted(classes: DataFrame, ids: np.ndarray, x: np.ndarray, threshold: float) -> dict[int, int]:
    sent = classes.sparkSession.sparkContext.broadcast((ids, x))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = sent.value
        total = np.zeros(len(ids), np.int64)
        step = max(1, (2 << 20) // max(len(ids), 1))
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                for rows, y in _by_length(part):
                    near = x @ y.T >= threshold
                    near &= ids[:, None] != part.column("id").to_numpy()[rows]
                    total += near.sum(axis=1)
        some = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], names=["id", "n"])

    found = arrow(classes.select("id", "v"), count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r.id: r.n for r in found}


def _probed(x: np.ndarray, centroids: np.ndarray, overlap: float, most: int | None, cosine: float) -> float:
    """The share of made-up pairs, each a sampled vector and one at just ``cosine`` from it, that go to a common shard."""
    away = np.random.default_rng(len(x)).normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    other = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * away
    shared = [(chosen(x[k : k + 2048], centroids, overlap, most) & chosen(other[k : k + 2048], centroids, overlap, most)).any(axis=1) for k in range(0, len(x), 2048)]
    return float(np.concatenate(shared).mean())


def _searched(classes: DataFrame, store: Stored, dim: int, n: int, cosine: float, overlap: float) -> tuple[DataFrame, DataFrame]:
    """``_linked`` of ``n`` classes of vectors of length ``dim``, with an audited recall."""
    last = classes.select("id").orderBy("id").limit(SAMPLE_ROWS).agg(F.max("id")).first()[0]
    sample = classes.where(F.col("id") <= F.lit(last)).orderBy("id").limit(SAMPLE_ROWS).select("v").collect()
    x, ok = unit(np.array([r.v for r in sample], np.float64).reshape(-1), dim)
    x = x[ok]
    centroids = fit_centroids(x, max(1, min(MAX_CENTROIDS, len(x) // 8, -(-n // SHARD_ROWS))))
    exact = _audit(classes, dim, cosine)
    # Linked unit vectors are sqrt(2 - 2 * cosine) apart at most, and no cosine with a centroid differs by more.
    enough, whole, most = 2 * float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6, not exact, NEAREST
    while not exact and overlap < enough and _probed(x, centroids, overlap, most, cosine) < AUDIT_RECALL:
        overlap, most = (overlap, None) if most is not None else (min(max(2 * overlap, OVERLAP), enough), None)
    two = n > MAX_CENTROIDS * SHARD_ROWS
    while True:
        placed = _placed(classes, store, centroids, overlap, most)
        if two:
            placed = _refined(placed, store, overlap, most)
        links, edges = _linked(placed, store, cosine, whole, not two)
        if not exact:
            return links, edges
        got = {r.id: r.n_others for r in links.where(F.col("id").isin(list(exact))).collect()}
        recall = np.mean([min(got.get(k, 0) / v, 1) for k, v in exact.items()])
        if recall >= AUDIT_RECALL:
            return links, edges
        if whole and most is None and overlap >= enough:
            raise RuntimeError(f"recall of {recall:.3f} where every linked pair shares a shard")
        whole, most, overlap = True, None, max(overlap, min(max(2 * overlap, OVERLAP), enough))


def near_duplicates(table: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, overlap: float = OVERLAP) -> DataFrame:
    """One row for each of ``table``: its id, n_links, component_id and kept.

    Every row is a vector, and vectors of one length link with a cosine of at least ``cosine``; those of two
    lengths have none.  Rows that share an id or a vector link like any others, ties included.  A vector that is
    null, empty, zero, or holds a null or a non-finite number links with nothing.  component_id is the smallest
    id that links reach, kept says that it is the vector's own.  A null id counts as the smallest and stays null.
    No rows give no rows.  Other columns are not read.

    Lengths that at most ``SHARD_ROWS`` different vectors have are compared whole, all of them in one pass; the
    others are searched one after another.  For each, at most ``SAMPLE_ROWS`` vectors, ``MAX_CENTROIDS``
    centroids and ``AUDIT_MOST`` vectors for the audit are on the driver; centroids and these are sent to the
    tasks.  Beyond ``MAX_CENTROIDS * SHARD_ROWS`` vectors a second level of centroids keeps the shards' size.
    Where no audited vector has a link, all rows of a shard are compared, and the shards overlap so far that
    made-up pairs at the threshold share one.
    """
    store = Stored(table.sparkSession, "embeddings")
    named = table.select(F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_FIRST)).alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    keys = ["k1", "k2"]
    named = named.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))
    usable = named.where(F.size("v") > 0).where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    classes = usable.groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.any_value("v").alias("v"))
    classes = store.put(classes.withColumn("id", F.xxhash64(*keys, "rep")), "classes")
    large = classes.groupBy(F.size("v").alias("d")).count().where(F.col("count") > SHARD_ROWS).orderBy("d").collect()
    rest = classes.where(~F.size("v").isin([r.d for r in large])) if large else classes
    found = [_linked(_placed(rest, store, None, 0, None), store, cosine, True, False)]
    found += [_searched(classes.where(F.size("v") == r.d), store, r.d, r["count"], cosine, overlap) for r in large]
    links, edges = (reduce(DataFrame.unionByName, side) for side in zip(*found, strict=True))
    label = components(edges, store).select(F.col("node").alias("id"), "component")
    named_classes = classes.select(*keys, "id", "rep", "m").join(label, "id", "left").join(links.drop("n_others"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named_classes = store.put(named_classes, "named")
    smallest = named_classes.groupBy("component").agg(F.min("rep").alias("low"))
    joined = named_classes.join(smallest, "component").select(*keys, "low", (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    out = named.select("id", *keys).join(joined, keys, "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("low", "id").alias("component"))
    shown = lambda c: F.when(F.col(c) != _FIRST, F.col(c))
    return out.select(shown("id").alias(id), "n_links", shown("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
