"""Near duplicates of texts and vectors against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import embedding_dedup, minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NONE = -(2**63)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute(rows, num, den):
    sets = [(NONE if i is None else i, shingles(t)) for i, t in rows]
    held = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            held[x].append(k)
    links = []
    for k, (i, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for o in held[x]:
                if o > k:
                    shared[o] += 1
        links += [(i, sets[o][0]) for o, n in shared.items() if den * n >= num * (len(s) + len(sets[o][1]) - n)]
    root = roots({i for i, _ in sets}, links)
    return sorted((str(i), len(s), str(root[i]), root[i] == i) for i, s in sets)


def check(df, num, den):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    shown = lambda x: str(NONE if x is None else x)
    got = sorted((shown(r.doc_id), r.n_shingles, shown(r.component_id), r.kept) for r in minhash.near_duplicates(df, similarity=(num, den)).collect())
    assert got == brute(rows, num, den)


def corpus(n, seed=5):
    """Groups of near copies with edits of many sizes, and texts that share a long passage but are no copies."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 4))
    passage = [word() for _ in range(40)]
    rows = []
    for k in range(n):
        if k % 3 == 0:
            base = [word() for _ in range(int(rng.integers(5, 120)))]
        out = list(base)
        for _ in range(int(rng.integers(0, max(2, len(base) // 25)))):
            out[int(rng.integers(0, len(out)))] = word()
        if k % 7 == 0:
            out = passage + [word() for _ in range(30)]
        rows.append((k, " ".join(out)))
    return rows


@pytest.mark.parametrize("num", [80, 85])
def test_documents(spark, docs, num):
    check(docs, num, 100)
    check(spark.createDataFrame(corpus(240), "doc_id int, text string"), num, 100)


def test_odd_documents(odd):
    check(odd, 85, 100)
    assert minhash.near_duplicates(odd.limit(0)).count() == 0
    kept = minhash.deduplicated(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (2, 3, 4, 6)").count() == 4


def test_blocks_lose_no_link(spark, monkeypatch):
    """Lists and groups of more rows than a block holds."""
    monkeypatch.setattr(minhash, "LIST_BLOCK", 3)
    monkeypatch.setattr(minhash, "GROUP_BLOCK", 2)
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(60):
        out = list(base)
        for j in rng.integers(0, 100, 2):
            out[j] = f"x{k}{j}"
        rows.append((k, " ".join(out)))
    check(spark.createDataFrame(rows + [(100 + i, t) for i, t in corpus(60)], "doc_id int, text string"), 85, 100)


def test_few_edges_need_no_rounds(spark, docs, monkeypatch):
    """One task joins what it can hold; with more edges than that, star rounds give the same."""

    def refused(*_):
        raise AssertionError("star rounds for few edges")

    with monkeypatch.context() as m:
        m.setattr(minhash, "components", refused)
        check(docs, 85, 100)
    monkeypatch.setattr(minhash, "TASK_EDGES", 3)
    check(docs, 85, 100)
    rng = np.random.default_rng(7)
    for a in (np.arange(1, 3000), rng.permutation(3000)[:-1], rng.integers(0, 3000, 1500)):
        b = np.arange(2999)[: len(a)]
        want = roots(range(3000), zip(a.tolist(), b.tolist(), strict=True))
        assert minhash._roots(3000, a, b).tolist() == [want[k] for k in range(3000)]


@pytest.mark.parametrize("some", [False, True])
def test_a_group_is_joined_by_few_pairs(some):
    """Sets in one component don't all meet; what is joined is what all pairs would join."""
    rng = np.random.default_rng(3)
    sets = []
    for k in range(400):
        base = np.arange(1000 * (k % 3), 1000 * (k % 3) + 100) if k % 4 else np.arange(k * 5000, k * 5000 + int(rng.integers(0, 60)))
        gone = rng.integers(0, 100, int(rng.integers(0, 12)))
        sets.append(np.sort(minhash.mix64(np.union1d(np.delete(base, gone[gone < len(base)]), rng.integers(1 << 40, 1 << 41, len(gone) * (k % 5 == 0))).astype(np.uint64))))
    label = np.where(rng.random(400) < 0.1, 7, 1000 + np.arange(400))
    against = rng.random(400) < 0.5 if some else None
    share = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    size = np.diag(share)
    ok = (share * 100 >= 85 * (size[:, None] + size - share)) & (share > 0)
    ok &= ~(against[:, None] & against) if some else True
    same = [(int(np.flatnonzero(label == 7)[0]), int(k)) for k in np.flatnonzero(label == 7)]
    want = roots(range(400), [*same, *np.argwhere(ok).tolist()])
    a, b = minhash._linked(sets, label, 85, 100, against)
    assert all(ok[a, b]) and roots(range(400), [*same, *zip(a.tolist(), b.tolist(), strict=True)]) == want
    assert len(a) < np.triu(ok, 1).sum() / 4


@pytest.mark.parametrize("n", [30, 90])
def test_shared_values_are_counted(n):
    rng = np.random.default_rng(4)
    sets = [np.unique(np.where(rng.random(60) < 0.3, rng.integers(0, 20, 60), rng.integers(0, 2000, 60))).astype(np.uint64) for _ in range(n)]
    got = minhash._counts(np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets]), n, columns=7)
    want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    assert (got == want)[~np.eye(n, dtype=bool)].all()


def test_overlap_bound():
    for share in (0.8, 0.85):
        need = minhash.overlap_needed(share)
        draws = np.random.default_rng(0).binomial(minhash.SKETCH, share, 400_000)
        assert (draws < need).mean() < 1e-4 and need > minhash.SKETCH // 3


# Vectors


def brute_vectors(rows, cosine):
    good = [(NONE if i is None else i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    named = [(i, v.tolist()) for i, v in good]
    good = [(i, v / np.abs(v).max()) for i, v in good]
    good = [(i, v / np.linalg.norm(v)) for i, v in good]
    count, links = defaultdict(int), []
    for a, (_, v) in enumerate(good):
        for b, (_, w) in enumerate(good[a + 1 :], a + 1):
            if len(v) == len(w) and v @ w >= cosine:
                count[a] += 1
                count[b] += 1
                links.append((a, b))
    part, low = roots(range(len(good)), links), {}
    for k, (i, _) in enumerate(good):
        low[part[k]] = min(low.get(part[k], i), i)
    place = {(i, repr(v)): k for k, (i, v) in enumerate(named)}
    out = []
    for i, v in rows:
        i = NONE if i is None else i
        k = place.get((i, repr(v)))
        root = i if k is None else low[part[k]]
        out.append((str(i), 0 if k is None else count[k], str(root), root == i))
    return sorted(out)


def check_vectors(spark, rows, cosine=0.95):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("x", F.lit(1)).withColumn("shard", F.lit("s")).withColumn("n_links", F.lit(0.5))
    shown = lambda x: str(NONE if x is None else x)
    got = sorted((shown(r.vec_id), r.n_links, shown(r.component_id), r.kept) for r in embedding_dedup.near_duplicates(df, cosine=cosine).collect())
    assert got == brute_vectors(rows, cosine)


def clouds(n, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(max(2, n // 12), dim))
    return [(k, (centre[k % len(centre)] * float(rng.uniform(0.1, 9)) + rng.normal(size=dim) * rng.choice([0.02, 0.1, 2.0])).tolist()) for k in range(n)]


def test_vectors(spark):
    check_vectors(spark, clouds(400))


def test_odd_vectors(spark):
    rows = clouds(30, 4)
    rows += [(None, rows[0][1]), (50, None), (51, []), (52, [0.0] * 4), (53, [1.0, None, 0.0, 0.0]), (54, [float("nan"), 1.0, 0.0, 0.0]), (55, [float("inf"), 1.0, 0.0, 0.0]), (56, [1.0, 2.0]), (57, [1e300, 2e300, 0.0, 0.0]), (58, [1e-300, 2e-300, 0.0, 0.0])]
    rows += [(200 + k, rows[3][1]) for k in range(20)] + [(3, rows[3][1]), (3, rows[4][1])]  # copies, and an id used again
    check_vectors(spark, rows)
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert embedding_dedup.near_duplicates(empty).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<double>")).first().kept


def test_vectors_of_several_lengths(spark, monkeypatch):
    """Lengths with few vectors are compared in one pass, those with many are searched; none link across."""
    rows = [(3 * k, v) for k, v in clouds(90, 8)] + [(3 * k + 1, v) for k, v in clouds(60, 3, 2)] + [(1000 + k, [1.0] * (1 + k % 5)) for k in range(40)]
    check_vectors(spark, rows)
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 50)
    check_vectors(spark, rows)


def test_two_levels_of_centroids(spark, monkeypatch):
    """More vectors than one level of centroids divides: shards are divided again, and links are counted once."""
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 25)
    monkeypatch.setattr(embedding_dedup, "MAX_CENTROIDS", 4)
    sizes, linked = [], embedding_dedup._linked

    def seen(placed, *rest):
        sizes.append([r[1] for r in placed.select(F.explode("shards").alias("s")).groupBy("s").count().collect()])
        return linked(placed, *rest)

    monkeypatch.setattr(embedding_dedup, "_linked", seen)
    rows = clouds(400, 24, 4)
    check_vectors(spark, rows)
    assert len(sizes[1]) > 8


def test_shards_widen_where_no_link_is_audited():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids = embedding_dedup.fit_centroids(x, 60)
    assert embedding_dedup._probed(x, centroids, 0.001, 1, 0.95) < 0.9
    enough = 2 * np.sqrt(0.1)
    assert embedding_dedup._probed(x, centroids, enough, None, 0.95) == 1


def test_vectors_in_blocks_and_shards(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 40)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 60)
    rows = clouds(300, seed=4)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    want = {int(i): n for i, n, _, _ in brute_vectors(rows, 0.95)}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.98 * sum(want.values())


def test_pairs_across_blocks(spark, monkeypatch):
    """One shard of two blocks, made of clusters of near copies and of pairs: a block's lists never lead into another."""
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 10_000)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 1000)
    rng = np.random.default_rng(6)
    rows = [c + 0.03 * rng.normal(size=32) for c in rng.normal(size=(15, 32)) for _ in range(100)]
    rows += [c + 0.1 * rng.normal(size=32) for c in rng.normal(size=(200, 32)) for _ in range(2)]
    check_vectors(spark, [(k, v.tolist()) for k, v in enumerate(rows)])


def test_audit_sees_past_exact_copies(spark, monkeypatch):
    """Pairs that a small overlap parts, beside thousands of copies of one vector, which grouping finds."""
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 10)
    rng = np.random.default_rng(8)
    rows = [(k, (c + 0.2 * rng.normal(size=32)).tolist()) for k, c in enumerate(np.repeat(rng.normal(size=(60, 32)), 2, axis=0))]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()
    assert sum(want) > 40
    copies = [(1000 + k, [1.0] * 32) for k in range(6000)]
    df = spark.createDataFrame(rows + copies, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, overlap=0.01).collect()}
    assert [got[k] for k in range(len(rows))] == want and got[1000] == 5999


def test_audit_draws_until_it_finds_links(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32))
    classes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([x, x[2900:] + 0.01]))], "id bigint, v array<double>")
    assert embedding_dedup._audit(classes, 32, 0.95) == {k: 1 for k in range(2900, 3100)}
