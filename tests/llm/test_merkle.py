"""Merkle manifest: the monoid under any cut, brute force over a table, proofs, edge cases."""

import hashlib
import random
import zlib

import pytest

from gavelworks.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 100, 513])
def test_any_cut_and_any_order_gives_the_same_forest(n):
    r = random.Random(n)
    leaves = [H(str(i)) for i in range(n)]
    want = levels(leaves)
    for _ in range(20):
        frags = [{} for _ in range(r.randint(1, 9))]
        for i, h in enumerate(leaves):
            r.choice(frags)[0, i] = h
        runs = {}
        frags = [M.merged(n, f, runs=runs) for f in frags]
        while len(frags) > 1:  # neighbours or not, any two may be merged next
            a = frags.pop(r.randrange(len(frags)))
            b = frags.pop(r.randrange(len(frags)))
            frags.append(M.merged(n, a, b, runs=runs))
        assert frags[0] == {(len(want) - 1, 0): want[-1][0]}
        assert runs == {(lv, i // 8): want[lv][i : i + 8] for lv in range(len(want) - 1) for i in range(0, len(want[lv]), 8)}


def test_merging_is_associative():
    r = random.Random(3)
    for _ in range(50):
        n = r.randint(3, 200)
        frags = [{}, {}, {}]
        for i in range(n):
            frags[r.randrange(3)][0, i] = H(str(i))
        a, b, c = (M.merged(n, f) for f in frags)
        assert M.merged(n, M.merged(n, a, b), c) == M.merged(n, a, M.merged(n, b, c)) == M.merged(n, c, a, b)


def test_a_range_leaves_few_nodes():
    leaves = {(0, i): H(str(i)) for i in range(3, 5000)}
    assert len(M.merged(9999, leaves)) <= 2 * 7 * 5


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted expected rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    trees = {}
    for d, s, g, n, t in rows:
        leaf = H(*map(field, (d, s, g, n, t)))
        now = H(*map(field, (d, s, g, n, low(t)))) if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else leaf
        trees.setdefault((g is not None, (g or "").encode()), []).append((d is not None, d or 0, leaf, now, d))
    out = []
    keys = sorted(trees)
    for k in keys:
        trees[k].sort(key=lambda x: x[:3])
    built = {k: levels([x[2] for x in trees[k]]) for k in keys}
    top = levels([built[k][-1][0] for k in keys])
    for at, k in enumerate(keys):
        for i, (_, _, leaf, now, d) in enumerate(trees[k]):
            sibs, got, j = [], now, i
            for tree, start in ((built[k], i), (top, at)):
                j = start
                for lv in tree[:-1]:
                    run = lv[j // 8 * 8 : j // 8 * 8 + 8]
                    sibs += run[: j % 8] + run[j % 8 + 1 :]
                    got = H(*run[: j % 8], got, *run[j % 8 + 1 :])
                    j //= 8
            root = top[-1][0]
            out.append((d, leaf, built[k][-1][0], root, H(*sibs), got, got == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, root string, tree int"


def test_table_against_brute_force(spark, tmp_path, monkeypatch):
    # many parts, and a fan that needs several rounds
    monkeypatch.setattr(M, "LEAST", 7)
    monkeypatch.setattr(M, "MOST", 13)
    monkeypatch.setattr(M, "FAN", 3)
    r = random.Random(5)
    langs = [None, "", "de", "en", "en", "en", "é", "zz", *(f"l{i:02d}" for i in range(20))]
    rows = [(i, r.choice(["a", None]), r.choice(langs), r.choice([None, i]), r.choice([None, "", "Some Text", "plain", "É Ä x", "L" * 70000])) for i in range(600)]
    rows += [(7, "a", "en", 1, "Twice")] * 40 + [(None, None, None, None, None)] * 3 + [(None, "a", "en", 2, "X")]
    df = spark.createDataFrame([(*x, 1, "r", 2) for x in rows], SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = M.op11(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 3, "abc")], [(1, "s", "en", 3, "ABC"), (2, "s", None, 3, "abc")]])
def test_small_tables(spark, tmp_path, rows):
    spark.createDataFrame([(*x, 1, "r", 2) for x in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, M.op11(spark, str(tmp_path)).collect()), key=str) == brute(rows)
