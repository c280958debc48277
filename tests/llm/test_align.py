"""Cross-tokenizer alignment: byte offsets by brute force, corpus counts, edge cases."""

import hashlib
import random
from collections import Counter

import pytest

from gavelworks.llm import align as A

pytest.importorskip("public_tokenizers")


def brute(texts):
    """Rows without ids of a list of texts, by byte offsets only."""
    left, right = A.load().left, A.load().right
    docs = []
    for t in texts:
        # whole texts, as the libraries encode them
        a, b = (left.t.encode(" " + t, add_special_tokens=False).ids, right.t.encode(t)) if t else ([], [])
        ba, bb = [left.bytes[i] for i in a], [right.bytes[i] for i in b]
        if not t or b"".join(ba) != b" " + t.encode() or b"".join(bb) != b" " + t.encode():
            docs.append(([], [], [], []))
            continue

        def ranges(parts):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        ra, rb = ranges(ba), ranges(bb)
        ends = sorted({e for _, e in ra} & {e for _, e in rb})
        links = [(a[i], b[j]) for i, (s, e) in enumerate(ra) for j, (u, v) in enumerate(rb) if s < v and u < e]
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(a[i]) for i, r in enumerate(ra) if low <= r[0] < e) + "|" + ",".join(str(b[j]) for j, r in enumerate(rb) if low <= r[0] < e))
            low = e
        docs.append((a, b, groups, links))
    counts = Counter(x for d in docs for x in d[3])
    top = {}
    for (_, y), c in counts.items():
        top[y] = max(top.get(y, 0), c)
    return [
        (len(a), len(b), len(g), len(ln), sum(counts[x] == top[x[1]] for x in ln), sum(counts[x] for x in ln), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for a, b, g, ln in docs
    ]


BITS = ["the ", " the", "don't", "'re", " ", "  ", "\n", "\n\n", "\t", "7", "12345", "é", "ß", "日本語", "🙂", " ", "x" * 9, "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "...", "—", "é", "ﬁ", "½", "\x00", "\x01", "word", " Wörter"]
SCHEMA = "doc_id long, text string, block int, kind string, n_a int"


def test_alphabet_is_a_bijection():
    alphabet = A.byte_alphabet()
    assert len(alphabet) == 256 == len(set(alphabet.values()))
    left, right = A.load().left, A.load().right
    assert right.apart and sum(1 for b in left.bytes if len(b) == 1) == 256 and left.bytes[left.t.token_to_id("Ġthe")] == b" the"
    assert right.bytes[right.t.piece_to_id("▁the")] == b" the" and right.bytes[right.t.piece_to_id("<0xC3>")] == b"\xc3"


def test_transducer_on_any_two_cuts():
    r = random.Random(2)
    words = sorted({bytes(r.choices(b"ab ", k=r.randint(1, 4))) for _ in range(80)} | {b"a", b"b", b" "})
    trans = A.Transducer(words, words)
    known = {w: i for i, w in enumerate(words)}

    def cut(s):
        out, at = [], 0
        while at < len(s):
            n = r.choice([k for k in range(1, 5) if s[at : at + k] in known and at + k <= len(s)])
            out.append(known[s[at : at + n]])
            at += n
        return out

    for _ in range(500):
        s = bytes(r.choices(b"ab ", k=r.randint(1, 30)))
        a, b = cut(s), cut(s)
        links, ea, eb = trans.align(a, b)
        ends = lambda ids: [sum(len(words[x]) for x in ids[: k + 1]) for k in range(len(ids))]
        xa, xb = ends(a), ends(b)
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if xa[i] - len(words[a[i]]) < xb[j] and xb[j] - len(words[b[j]]) < xa[i]]
        assert sorted(links) == sorted(a[i] << 32 | b[j] for i, j in want)
        both = sorted(set(xa) & set(xb))
        assert [xa[k - 1] for k in ea] == both == [xb[k - 1] for k in eb] and len(links) == len(a) + len(b) - len(both)


def test_table_against_byte_offsets(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 100)
    r = random.Random(4)
    texts = ["".join(r.choices(BITS, k=r.randint(0, 14))) for _ in range(150)] + [None, "", " ", "  lead", "trail  ", "same", "same", "same text", "long word " * 300]
    rows = [(k if k % 50 else None, t, 1, "c", 2) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = A.align_table(spark, df, groups=True).collect()
    assert sorted([(x.doc_id, x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) for x in got], key=str) == sorted([(row[0], *w) for row, w in zip(rows, brute(texts))], key=str)
    assert sum(x.n_a > 0 for x in got) > 100
    for x in got:
        assert x.groups_sha256 == (hashlib.sha256(x.groups.encode()).hexdigest() if x.n_a else "")


def test_query_and_empty_table(spark, tmp_path):
    texts = ["a plain text", "a plain text", None, "", "again a text", "Größe 12"]
    df = spark.createDataFrame([(k, t, 1, "c", 2) for k, t in enumerate(texts)], SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = A.op13(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == [(k, *w) for k, w in enumerate(brute(texts))]
    assert A.align_table(spark, df.where("false")).collect() == []


def test_forgetting_changes_nothing(monkeypatch):
    texts = ["some words, über 12 of them, some", "some words", "and others\n\n of them"]
    want = A._aligned(A.load(), texts)
    monkeypatch.setattr(A, "MEMO", 0)
    monkeypatch.setattr(A, "CACHE", 0)
    for _ in range(3):
        got = A._aligned(A.load(), texts)
        assert all((x == y).all() for x, y in zip(got[:2], want[:2])) and got[2:] == want[2:]


def test_stretches_put_together_are_the_whole_text():
    """Cutting changes no id, whatever the text."""
    aligner, r = A.load(), random.Random(9)
    bits = [*BITS, " \t", "\x1c", "\x85", "\u3000", "\u2028 ", " \n ", "a\tb", "\r\n"]
    for _ in range(3000):
        t = " " + "".join(r.choices(bits, k=r.randint(1, 20)))
        parts = aligner.cut(t)
        assert "".join(parts) == t
        assert sum(aligner.left.encode(parts), []) == aligner.left.encode([t])[0], repr(t)
        if "▁" not in t:
            assert sum(aligner.right.encode(parts), []) == aligner.right.t.encode(t[1:]), repr(t)
