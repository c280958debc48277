"""Personal data: base spans against the plain patterns, bootstrapping, redaction, edge cases."""

import hashlib
import random
import re

from gavelworks.llm import pii as P

KINDS = ["email", "ip", "card", "phone"]


def plain(text):
    """The contract's patterns, word for word."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and P.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_equals_the_plain_patterns():
    r = random.Random(4)
    bits = ["a", "b.c", "@", "x-y", ".", "1", "12", "255", "256", "0004", " ", "-", "+", "(", ")", "é", "\n", "4111111111111111", "4111-1111 1111-1111", "a@b.co", "+1 (415) 555-0199", "10.0.0.1", "@@", "_", "%"]
    for _ in range(6000):
        t = "".join(r.choices(bits, k=r.randint(1, 14)))
        assert P.base_spans(t) == plain(t), t


def test_long_runs_are_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "+" + "1-" * 150_000, "1." * 150_000, "@a." * 100_000):
        P.base_spans(t)


def test_luhn():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")


def corpus(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    rows = []
    for i in range(60):
        card = next(c for c in iter(lambda: f"4{r.randrange(10**14):014d}", "") if True)
        card += str(next(d for d in range(10) if P.luhn(card + str(d))))
        rows.append((i, f"{word()} {word()} account number {card} was {word()}", "c"))
    for i in range(60, 66):
        rows.append((i, f"{word()} account number {r.randrange(10**8):08d}X was {word()}", "c"))
    for i in range(66, 120):
        rows.append((i, f"{word()} part {r.randrange(10**6):06d} of {word()} and the {1900 + i} year", "c"))
    rows += [(200, None, "c"), (201, "", "c"), (202, "mail a@b.example.com " * 3000, "c"), (0, rows[0][1], "c"), (None, "call +1 (415) 555-0199 now", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, _gw_base string")


def test_bootstrapping_finds_unseen_identifiers(spark):
    docs = corpus(spark)
    got = P.find_pii(spark, docs, ["doc_id", "text"]).collect()
    assert len(got) == docs.count()
    ids = {g.doc_id: [g.text[s.start : s.end] for s in g._gw_spans if s.kind == "id"] for g in got}
    for i in range(60, 66):
        assert len(ids[i]) == 1 and re.fullmatch(r"\d{8}X", ids[i][0])
    assert not any(ids[i] for i in range(66, 120))
    for g in got:
        base = [(s.start, s.kind, s.end) for s in g._gw_base]
        assert base == [(s, KINDS[k], e) for s, k, e in plain(g.text or "")]
        assert set(map(tuple, g._gw_base)) <= set(map(tuple, g._gw_spans))


def contexts(spark, rows):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = P.find_pii(spark, docs, ["doc_id", "text"]).collect()
    return {g.text[s.start : s.end] for g in got for s in g._gw_spans if s.kind == "id"}


def test_more_unseen_identifiers_than_seeds(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    rows = [f"{word()} account number {r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{i} {word()}" for i in range(20)]
    unseen = [f"{r.randrange(10**8):08d}X" for _ in range(25)]
    rows += [f"{word()} account number {u} {word()}" for u in unseen]
    rows += [f"{word()} part {r.randrange(10**8):08d}Y {word()}" for _ in range(40)]
    assert contexts(spark, rows) == set(unseen)


def test_finds_of_one_round_are_seeds_of_the_next(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    # punctuation between the context and the identifier is looked past
    rows = [f"{word()} account number : {r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{i} {word()}" for i in range(30)]
    unseen = [f"{r.randrange(10**8):08d}X" for _ in range(5)]
    rows += [f"{word()} account number - {u} {word()}" for u in unseen] + [f"{word()} member code {u} {word()}" for u in unseen]
    rows += [f"{word()} member code 77665544Z {word()}", f"{word()} part 11223344Z {word()}"]
    assert contexts(spark, rows) == {*unseen, "77665544Z"}


def test_seeds_and_unseen_tokens_share_shapes(spark):
    seed, other = (P.patterns(f"call {x} now", 5, 5 + len(x), P.shape(x)) for x in ("4111111111111111", "4111111111111112"))
    assert seed == other
    (c,) = [c for c in P.candidates("call 4111111111111111 now", P.base_spans("call 4111111111111111 now"))]
    assert c[3] and c[4] == seed


def test_query_digest(spark, tmp_path):
    docs = corpus(spark).drop("_gw_base")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in P.op6(spark, str(tmp_path)).collect()}
    t = "call +1 (415) 555-0199 now"
    assert got[None].base_sha256 == hashlib.sha256(f"phone:5:{5 + 17}".encode()).hexdigest() and got[None].n_phone == 1
    assert got[200].base_sha256 == hashlib.sha256(b"").hexdigest() and got[200].spans == ""
    assert got[202].n_email == 3000 and len(t) == 26


def test_stage_redacts(spark):
    docs = corpus(spark).drop("_gw_base").withColumn("base", P.F.lit(1)).withColumn("n_chars", P.F.lit(5))
    out = P.stage(spark, docs, "")
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[None].text == "call <PHONE> now" and rows[None].n_chars == 16
    assert "<ID>" in rows[60].text and rows[200].text is None and rows[66].text == next(r.text for r in docs.collect() if r.doc_id == 66)
    assert P.stage(spark, docs.where("false"), "").collect() == []


def test_scores_against_brute_force(spark):
    """The kept patterns and added spans are those of a plain-Python pattern-instance graph."""
    r = random.Random(31)
    heads = ["account number", "member code", "part no", "case file", "order ref"]
    make = [lambda: f"{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}", lambda: f"{r.randrange(10**7):07d}{r.choice('XYZ')}", lambda: f"u{r.randrange(40)}@mail.example.com"]
    rows = [f"{r.choice('abc') * 3} {r.choice(heads)} {r.choice(make)()} {r.choice(['was', 'is', 'x' * 90])} seen" for _ in range(400)]
    occ = [(i, c) for i, t in enumerate(rows) for c in P.candidates(t, P.base_spans(t))]
    edges, seed = {}, {}
    for _, (_, _, inst, is_seed, pats) in occ:
        for p in pats:
            edges[p, inst] = edges.get((p, inst), 0) + 1
            seed[p, inst] = seed.get((p, inst), False) or is_seed
    belief = {}
    for _ in range(P.ROUNDS):
        conf = {}
        for pat in {p for p, _ in edges}:
            insts = [i for p, i in edges if p == pat]
            sure = [seed[pat, i] or belief.get(i, 0.0) >= P.ACCEPT for i in insts]
            if sum(sure) >= P.SUPPORT:
                conf[pat] = sum(1.0 if s else belief.get(i, 0.0) for s, i in zip(sure, insts)) / len(insts)
        belief = {}
        for inst in {i for (p, i) in edges if not seed[p, i] and p in conf}:
            w = [(conf[p], n) for (p, i), n in edges.items() if i == inst and p in conf and not seed[p, i]]
            belief[inst] = sum(c * n for c, n in w) / sum(n for _, n in w)
    want = {(i, s, e) for i, (s, e, _, is_seed, pats) in occ if not is_seed and any(conf.get(p, 0) >= P.ACCEPT for p in pats)}
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {(g.doc_id, s.start, s.end) for g in P.find_pii(spark, docs, ["doc_id"]).collect() for s in g._gw_spans if s.kind == "id"}
    assert got == want


def test_contexts_and_instances_are_whole():
    far = "account number" + " -" * 500 + " 12345678X then" + " ." * 400 + " end"
    (c,) = P.candidates(far, [])
    assert "2|account number" in c[4] and "b|number|then" in c[4]
    a, b = "1234" + "z" * 200 + "1", "1234" + "z" * 200 + "2"
    assert P.key(a) != P.key(b) and P.shape("A-" * 60) != P.shape("A-" * 60 + "b")
    assert P._words_before("first second" + " ," * 3000 + " ", 12 + 6001) == ["first", "second"]


def test_stage_takes_any_column_names(spark):
    docs = spark.createDataFrame([(1, "mail a@b.example.com", 7, "k"), (1, "mail a@b.example.com", 7, "k"), (2, None, None, None)], "doc_id long, text string, _gw_base int, c0 string")
    out = P.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "mail <EMAIL>", 7, "k"), (1, "mail <EMAIL>", 7, "k"), (2, None, None, None)]
