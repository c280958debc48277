"""Jaccard join against brute force, and its defined edge cases."""

import random

import numpy as np
import pytest

from gavelworks.llm import jaccard as J

SCHEMA = "doc_id long, text string, comp string"


def brute(rows, k, num, den):
    sets = {}
    for i, t, _ in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets[i] = s
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and len(x & y) * den >= num * len(x | y):
                p, q = comp[a], comp[b]
                comp = {i: min(p, q) if c in (p, q) else c for i, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in ids}


def corpus(seed, n=260):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = r.choices(vocab, k=60)
    out = []
    base = [r.choices(vocab, k=r.choice([1, 2, 3, 5, 9, 14, 25, 40, 80, 200])) for _ in range(40)]
    base.append(r.choices(vocab, k=120))
    for i in range(n):
        b = list(base[-1] if i % 3 == 0 else r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            b[r.randrange(len(b))] = r.choice(vocab)
        if r.random() < 0.1:
            b += passage
        out.append((i, " ".join(b), "x"))
    return out


@pytest.mark.parametrize("k,num,den,seed,tile", [(4, 85, 100, 1, 2048), (5, 80, 100, 2, 4), (2, 60, 100, 3, 8)])
def test_same_as_brute_force(spark, monkeypatch, k, num, den, seed, tile):
    monkeypatch.setattr(J, "TILE", tile)
    rows = corpus(seed) + [(1000, None, "x"), (1001, "", "x"), (1002, " \n\t ", "x"), (1003, "ONE two", "x"), (1004, "one TWO", "x")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(spark, spark.createDataFrame(rows, SCHEMA), k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_every_linked_pair_shares_a_tile():
    r = random.Random(5)
    for num, den in ((85, 100), (80, 100)):
        scheme = J.Scheme(num, den)
        for _ in range(1500):
            n = r.choice([3, 6, 7, 8, 10, 13, 17, 20, 33, 60, 150, 400])
            s = {r.getrandbits(64) for _ in range(n)}
            t = set(s)
            while True:
                u = set(t)
                if r.random() < 0.5:
                    u.discard(r.choice(list(u)))
                if r.random() < 0.5:
                    u.add(r.getrandbits(64))
                if not u or len(s & u) * den < num * len(s | u):
                    break
                t = u
                if r.random() < 0.02:
                    break
            if s == t:
                continue
            a, b = (np.array(sorted(z), np.uint64) for z in (s, t))
            assert set(scheme.keys(a).tolist()) & set(scheme.keys(b).tolist())


def test_tree_search_loses_nothing():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 400, r.integers(5, 120)).astype(np.uint64)) for _ in range(200)]
    pts = np.stack([J.counts(s) for s in sets])
    tree = J.RTree(pts)
    for i, s in enumerate(sets):
        hit = {int(j) for j in tree.search(pts[i], 50, 100)}
        for j, t in enumerate(sets):
            inter = len(np.intersect1d(s, t))
            if inter * 100 >= 50 * (len(s) + len(t) - inter):
                assert j in hit


def test_edge_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert J.jaccard_components(spark, empty).collect() == []
    long = " ".join(f"t{i}" for i in range(30000))
    rows = [(1, long, "c"), (2, long + " end", "c"), (3, "a b c d e f", None), (3, "a b c d e f", None), (None, "a b c d e f", "n"), (4, "totally other words in here now", "n"), (4, "a b c d e f", "n")]
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in J.jaccard_components(spark, spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, -1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (4, 3)]
    kept = J.stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert kept.columns == ["doc_id", "text", "comp"]
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3]


def test_the_trees_find_the_links(spark):
    rows = corpus(7)
    steps = {}
    df = J.jaccard_components(spark, spark.createDataFrame(rows, SCHEMA), steps=steps)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()} == brute(rows, 5, 80, 100)
    # all links come from descents and searches in the trees
    assert set(steps) == {"nearest", "all partners"} and steps["nearest"] > 20


def test_nearest_pairs_reach_their_bound():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 2**63, 80).astype(np.uint64)) for _ in range(30)]
    sets = [np.unique(np.concatenate((b[: len(b) - k], r.integers(0, 2**63, k).astype(np.uint64)))) for b in base for k in (0, 1, 2, 3)]
    for group in (sets, sets[:2], sets[:1], sets[:17] * 40):
        pts = np.stack([J.counts(s) for s in group])
        i, j = J.RTree(pts).nearest(80, 100)
        assert len(set(i.tolist())) == len(i) and not (i == j).any()
        for a, b in zip(i, j):
            near = np.minimum(pts[a], pts[b]).sum()
            assert near * 180 >= 80 * (len(group[a]) + len(group[b]))
    i, j = J.RTree(np.stack([J.counts(s) for s in sets])).nearest(80, 100)
    assert len(i) >= 85 and sum(a // 4 == b // 4 for a, b in zip(i, j)) >= 0.95 * len(i)


def test_counts_of_any_size():
    for top in (3, 70_000):
        c = np.zeros(J.GROUPS, np.uint32)
        c[5] = top
        assert (J._unpacked([J._packed(c)])[0] == c).all()
    assert (J._unpacked([J._packed(c), J._packed(c // 70_000)]) == np.stack([c, c // 70_000])).all()
