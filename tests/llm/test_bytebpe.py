"""Byte-level BPE: the public library, chunks of any size, exact round trips, edge cases."""

import base64
import hashlib
import random

import pytest

from gavelworks.llm import bytebpe as B

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


BITS = ["the", " the", "'s", "'re", "'r", "'", " ", "  ", "\n", "\n\n ", "\t", "7", "12345", "é", "ß", "日本語", "🙂", " ", " ", "​", "\x1c", "\x85", "x" * 30, "<|endoftext|>", "...", "—", "́", "՘", "\U000323b0", "Ⅷ", "½", "a1!", "\x00"]


def ids_of(packed):
    return list(memoryview(packed).cast("I"))


def test_same_ids_as_the_library(library):
    m, r = B.load(), random.Random(1)
    for _ in range(3000):
        t = "".join(r.choices(BITS, k=r.randint(0, 25)))
        assert ids_of(m.encode(t)) == library.encode_ordinary(t), repr(t)
        assert m.decode(m.encode(t)) == t.encode()


def test_latin_texts_are_matched_alike(library):
    m, r = B.load(), random.Random(7)
    few = [b for b in BITS if not B._BEYOND.search(b)] + [chr(c) for c in range(B.LATIN)]
    assert m.latin is not None and m.matcher_of("é") is m.latin and m.matcher_of("日") is m.match
    for _ in range(3000):
        t = "".join(r.choices(few, k=r.randint(0, 30)))
        assert m.latin.findall(t) == m.match.findall(t), repr(t)
        assert ids_of(m.encode(t)) == library.encode_ordinary(t), repr(t)


def test_every_letter_number_and_space_as_the_library(library):
    m = B.load()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 5000):
        t = "".join(f"a{c}a1{c} .{c}1 {c}x{c}\n" for c in map(chr, points[k : k + 5000][:: 1 if k < 70000 else 7]))
        assert ids_of(m.encode(t)) == library.encode_ordinary(t), hex(points[k])


def test_long_pre_tokens(library):
    m = B.load()
    for t in ("a" * 30000, "ab" * 20000, " " * 30000 + "x", "=-" * 9000, "日" * 9000):
        assert ids_of(m.encode(t)) == library.encode_ordinary(t)


SCHEMA = "doc_id long, text string, ids int, key string, k int"


@pytest.mark.parametrize("step, overlap", [(5, 5), (16, 8), (64, 16), (300, 40)])
def test_chunks_of_any_size(spark, library, step, overlap):
    r = random.Random(step)
    texts = ["".join(r.choices(BITS, k=r.randint(1, 120))) for _ in range(60)]
    texts += ["'s" * 200, "'" * 300, " " * 500, "a" * 500, "a " * 300, "  a" * 200, "'re'r'e" * 60, "x" * (step + 1), "y" * step]
    rows = [(i, t, 1, "c", 2) for i, t in enumerate(texts)]
    got = B.decode_table(spark, B.encode_table(spark, spark.createDataFrame(rows, SCHEMA), step=step, overlap=overlap)).collect()
    assert len(got) == len(rows)
    for g in got:
        assert ids_of(g.ids) == library.encode_ordinary(texts[g.doc_id]), repr(texts[g.doc_id])
        assert g.n_tokens == len(g.ids) // 4 and g.decoded == texts[g.doc_id].encode()


def test_most_seams_meet_in_prose(spark, library):
    """Windows hand over to each other; the text is not put together again."""
    r = random.Random(4)
    m, t = B.load(), " ".join("".join(r.choices("abcdefgh'", k=r.randint(1, 9))) for _ in range(3000))
    for s in range(0, len(t) - 200, 100):
        a, b = m.boundaries(t[s : s + 200], 100, 197), m.boundaries(t[s + 100 : s + 300], 0, 97)
        assert {e - 100 for e in a} & set(b)


def test_query(spark, library, tmp_path):
    rows = [(1, "plain text", 1, "c", 2), (1, "plain text", 1, "c", 2), (2, None, 1, "c", 2), (3, "", 1, "c", 2), (None, "no id", 1, "c", 2), (4, "long's  words 12 " * 20000, 1, "c", 2), (5, "z" * 200000, 1, "c", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for d, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha((t or "").encode())))
    got = B.op12(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert B.encode_table(spark, df.where("false")).collect() == []


def test_workers_take_the_pattern_from_the_driver(monkeypatch):
    import public_tokenizers

    known = B.spelt(public_tokenizers.PATTERN)

    def asked(pattern):
        raise AssertionError("the library's matchers are not for workers")

    monkeypatch.setattr(B, "spelt", asked)
    model = B.ByteBpe(B.read_ranks(), public_tokenizers.PATTERN, known)
    text = "Größe 12 ½ ไทย it's"
    assert model.decode(model.encode(text)) == text.encode()
    assert B.CACHE <= 100_000
