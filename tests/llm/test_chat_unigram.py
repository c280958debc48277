"""Chat formatting and SentencePiece: exact round trips, brute force, the public library, edge cases."""

import hashlib
import itertools
import math
import random
import struct

import pytest

from gavelworks.llm import chat as C
from gavelworks.llm import unigram as U


def test_escape_is_reversible():
    r = random.Random(1)
    bits = [*C.CONTROLS, "\\", "[", "<", "s>", "/", "a", "]", "\n", " "]
    for _ in range(4000):
        t = "".join(r.choices(bits, k=r.randint(0, 10)))
        e = C.escape(t)
        assert C.unescape(e) == t and not any(c in e for c in C.CONTROLS)


def test_turns_and_loss_read_back():
    r = random.Random(2)
    bits = [*C.CONTROLS, "\\", "x", " ", "é", "<", "q", "z"]
    for _ in range(500):
        turns = [(r.choice(["user", "assistant", "system", "tool", "", "[/ROLE]"]), "".join(r.choices(bits, k=r.randint(0, 6)))) for _ in range(r.randint(0, 6))]
        out = C.render(turns)
        assert not out.rewrites and C.read_back(out.text) == turns
        assert [C.unescape(out.text[a:b]) for a, b in out.loss] == [t for role, t in turns if role == "assistant"]
        assert "".join(out.text[a:b] for a, b in out.spans) == out.text


def test_templates_that_rewrite_history_are_told():
    last_only = lambda turns: "".join(t if i == len(turns) - 1 else t[:1] for i, (_, t) in enumerate(turns))
    got = C.render([("user", "hello"), ("assistant", "there"), ("user", "x")], last_only)
    assert got.rewrites and got.spans[1] is None and got.loss == []
    trims = lambda turns: "".join(f"|{t.strip()}" for _, t in turns)
    assert C.render([("assistant", " a ")], trims).loss == [(1, 2)]


def test_table(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "n"), (3, 0, "user", "tie"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie")]
    rows += [(4, i, ["user", "assistant"][i % 2], "long " * 50) for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.format_conversations(spark, df).collect()}
    assert C.read_back(got[1].formatted) == [("user", "a"), ("assistant", "b")]
    assert C.read_back(got[2].formatted) == [("", "")] and C.read_back(got[None].formatted) == [("user", "n")]
    assert C.read_back(got[3].formatted) == [("assistant", "tie")] * 2 + [("user", "tie")] and len(got[4].loss) == 30
    assert C.format_conversations(spark, df.where("false")).collect() == []


def test_query_has_the_planted_conversation(spark, tmp_path):
    spark.createDataFrame([(5, 0, "user", "hi", 1)], "conv_id long, turn long, role string, text string, formatted int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in C.op10(spark, str(tmp_path)).collect()}
    t = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert got[-1].loss_chars == len(t) and got[-1].loss_sha256 == hashlib.sha256(t.encode()).hexdigest() and got[5].loss_chars == 0


def toy():
    r = random.Random(8)
    pieces = {c: -r.uniform(3, 6) for c in "abc" + U.MARK}
    for _ in range(40):
        w = "".join(r.choices("abc", k=r.randint(2, 4)))
        pieces[r.choice(["", U.MARK]) + w] = -r.uniform(1, 8)
    items = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *pieces.items()]
    return U.Unigram(items, [i > 256 for i in range(len(items))], list(range(1, 257)), 0), items


def test_viterbi_equals_all_segmentations():
    m, items = toy()
    score = dict(items[257:])
    r = random.Random(3)
    for _ in range(300):
        w = "".join(r.choices("abcx" + U.MARK, k=r.randint(1, 9)))
        best = -math.inf
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(w[at:i])
                    at = i
            parts.append(w[at:])
            if all(p in score or len(p) == 1 for p in parts):
                best = max(best, sum(score.get(p, m.unk_score) for p in parts))
        assert math.isclose(m.viterbi(w)[1], best, rel_tol=1e-9)


def _model(items):
    """The toy model in the library's own file format (unigram, byte fallback, identity)."""

    def field(n, kind, body):
        return bytes([n << 3 | kind]) + body

    def var(x):
        out = b""
        while x > 127:
            out += bytes([x & 127 | 128])
            x >>= 7
        return out + bytes([x])

    out = b""
    for i, (p, s) in enumerate(items):
        kind = 2 if i == 0 else 6 if i <= 256 else 1
        body = field(1, 2, var(len(p.encode())) + p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, var(kind))
        out += field(1, 2, var(len(body)) + body)
    trainer = field(3, 0, var(1)) + var(35 << 3) + var(1)  # model_type unigram, byte_fallback
    out += field(2, 2, var(len(trainer)) + trainer)
    norm = field(1, 2, var(8) + b"identity") + field(3, 0, var(1)) + field(4, 0, var(0)) + field(5, 0, var(1))
    return out + field(3, 2, var(len(norm)) + norm)


def test_same_ids_as_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    m, items = toy()
    try:
        sp = sentencepiece.SentencePieceProcessor(model_proto=_model(items))
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"library refuses the hand-made model: {e}")
    r = random.Random(5)
    for _ in range(400):
        t = "".join(r.choices("abcx é", k=r.randint(1, 20)))
        assert m.encode(t) == sp.encode(t)


def test_public_model_round_trip_and_table(spark):
    m = U.load()
    r = random.Random(6)
    for _ in range(400):
        t = "".join(r.choices(["the ", " ", "  ", "\n", U.MARK, "é", "日本", "☃", "ing", "\t", "\u0000", "🙂", "Word"], k=r.randint(0, 25)))
        assert m.decode(m.encode(t)) == t
    rows = [(1, "a plain text", 1), (1, "a plain text", 1), (2, None, 1), (3, "", 1), (4, U.MARK + " ☃ " * 40000, 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = U.encode_table(spark, df).collect()
    assert len(got) == 6 and all(g.round_trip for g in got)
    by = {g.doc_id: g for g in got}
    assert by[2].ids is None and by[3].ids == [] and by[4].n_byte_tokens > 0
    back = {r.doc_id: r.text for r in U.decode_table(spark, U.encode_table(spark, df)).collect()}
    assert back == {1: "a plain text", 2: None, 3: "", 4: rows[4][1], None: "x"}
    assert U.encode_table(spark, df.where("false")).collect() == []
