"""Court places by automaton and quotes by inverted index: brute force, edge cases, cost."""

import random
import re
import time

from gavelworks.functions.lexicon import PLACES
from gavelworks.operators import places as P
from gavelworks.operators import quotes as Q
from gavelworks.operators import records


def named(n):
    """n invented places in 40 provinces; some begin like others."""
    r = random.Random(n)
    syllables = ["ba", "tu", "ra", "ki", "mo", "san", "pe", "lu", "ding", "wa"]
    out = {}
    while len(out) < n:
        name = " ".join("".join(r.choices(syllables, k=r.randint(2, 3))).title() for _ in range(r.randint(1, 2)))
        out.setdefault(name, f"Prov {len(out) % 40}")
    return out


def keyed(places):
    out = {}
    for name, prov in sorted(places.items()):
        k = re.sub("[^A-Z]", "", name.upper())
        out[k] = min(prov, out.get(k, prov))
    return out


def test_every_place_of_a_large_gazetteer_resolves(spark):
    many = named(600)
    more = spark.createDataFrame([(p, n) for n, p in many.items()], "provinsi string, tempat string")
    gaz = records.gazetteer(spark, more=more)
    known = keyed({**{n: p for p, ns in PLACES.items() for n in ns}, **many})
    assert P.dictionary(gaz) == known
    rows = [(i, f"diajukan di Pengadilan Negeri {n}, lalu PT {n.upper().replace(' ', '')}.") for i, n in enumerate(many)]
    got = P.find_places(spark.createDataFrame(rows, "i int, t string"), "t", gaz, "m").collect()
    for r, n in zip(sorted(got), many):
        k = re.sub("[^A-Z]", "", n.upper())
        assert [(m.key, m.provinsi, m.court) for m in r.m] == [(k, known[k], "PN"), (k, known[k], "PT")], n


def test_the_session_names_a_file_of_further_places(spark, tmp_path):
    (tmp_path / "places.csv").write_text("provinsi,tempat\nAceh,Kuta Uji\n")
    spark.conf.set("spark.gavelworks.places", str(tmp_path / "places.csv"))
    try:
        assert P.dictionary(records.gazetteer(spark))["KUTAUJI"] == "Aceh"
    finally:
        spark.conf.unset("spark.gavelworks.places")
    assert "KUTAUJI" not in P.dictionary(records.gazetteer(spark))


def brute(text, known):
    """Leftmost longest names by trying every stretch of words."""
    words = list(re.finditer(r"[^\W_]+", text))
    out, i = [], 0
    while i < len(words):
        best = None
        for j in range(i, min(i + 6, len(words))):
            if not words[j].group()[0].isupper() or not (words[j].group().isascii() and words[j].group().isalpha()):
                break
            if j > i and not re.fullmatch(r"[\s.\-]*", text[words[j - 1].end() : words[j].start()]):
                break
            k = re.sub("[^A-Z]", "", text[words[i].start() : words[j].end()].upper())
            if k in known:
                best = (words[i].start(), words[j].end(), k, j)
        if best:
            out.append(best[:3])
            i = best[3]
        i += 1
    return out


def test_mentions_against_trying_every_stretch():
    many = named(120)
    known, r = keyed(many), random.Random(1)
    finder = P.Places(known)
    names = list(many)
    for _ in range(2000):
        bits = []
        for _ in range(r.randint(0, 12)):
            n = r.choice(names)
            bits.append(r.choice([n, n.upper(), n.lower(), n.replace(" ", ""), n.replace(" ", "-"), n.replace(" ", "\n"), n + "x", n[:4], "É" + n, n + "7"]))
            bits.append(r.choice([" ", ", ", " di ", ". ", "_", "\n"]))
        t = "".join(bits)
        assert [(m["start"], m["end"], m["key"]) for m in finder.find(t)] == brute(t, known), repr(t)


def test_kinds_of_courts_and_edges(spark):
    gaz = records.gazetteer(spark)
    rows = [
        (1, "Pengadilan Negeri Banda Aceh"), (2, "DILMIL II 11 YOGYAKARTA"), (3, "Pengadilan Militer Tinggi III Surabaya"), (4, "PT. Palangkaraya"), (5, "kerugian negara, SIMPATI, Negara-nya"),
        (6, "Tanjung Balai Karimun dan Tanjung Balai"), (7, None), (8, ""), (9, "Pengadilan Negeri Perpanjangan Oleh Ketua. Pengadilan Negeri Koto Baru"), (10, "PN KOTABARU"),
    ]
    df = spark.createDataFrame([(*r, 5) for r in rows], "i int, t string, m int")
    got = {r.i: r for r in P.find_places(df, "t", gaz, "m").collect()}
    one = lambda i: [(m.key, m.court) for m in got[i].m]
    assert one(1) == [("BANDAACEH", "PN")] and one(2) == [("YOGYAKARTA", "DILMIL")] and one(4) == [("PALANGKARAYA", "PT")]
    assert one(5) == [("NEGARA", None)] and one(6) == [("TANJUNGBALAIKARIMUN", None), ("TANJUNGBALAI", None)]
    assert got[7].m is None and got[8].m == [] and "t" in got[1].asDict()
    court = {r.i: r.pengadilan_asal_teks for r in P.origin_courts(df, "t", gaz).collect()}
    assert court[9] == "PN KOTO BARU" and court[1] == "PN BANDA ACEH" and court[2] is None and court[7] is None
    assert got[10].m[0].provinsi == "Kalimantan Selatan" and got[9].m[0].provinsi == "Sumatera Barat"
    none = P.find_places(df, "t", gaz.where("false"), "m").collect()
    assert all(not r.m for r in none) and P.find_places(df.where("false"), "t", gaz).collect() == []


def test_cost_is_linear_in_the_text():
    finder = P.Places(keyed(named(500)))
    base = "Batu Ra Kimo di Sanpe Lu, TUMOSAN " * 2000
    took = []
    for k in (1, 8):
        t = base * k
        start = time.perf_counter()
        finder.find(t)
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] * 3


# -- quotes ------------------------------------------------------------------------------------


def bare(s):
    return re.sub(r"\W+", "", s.lower())


def test_a_kept_gram_of_every_quote_is_kept_in_its_text():
    r = random.Random(2)
    for floor, gram in Q.CLASSES:
        for _ in range(300):
            hay = "".join(r.choices("abc", k=r.randint(floor, 300)))
            n = r.randint(floor, len(hay))
            at = r.randint(0, len(hay) - n)
            w = floor - gram + 1
            assert len(Q.winnowed(hay[at : at + n], gram, w)) and set(Q.winnowed(hay[at : at + n], gram, w)) <= set(Q.winnowed(hay, gram, w))


def holds(text, quote):
    parts = [p for p in map(bare, re.split(r"\.{3}|…|\|", quote)) if len(p) >= 12]
    return bool(parts) and all(p in bare(text) for p in parts)


def test_found_against_looking_everywhere(spark):
    r = random.Random(3)
    words = ["solar", "liter", "terdakwa", "é", "PN", "12.000", "Bio-solar", "di", "a", "_x_", "sungai", "日本"]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 120)))) for i in range(150)] + [(500, None), (501, ""), (502, "x"), (7, "another text of a repeated id " * 3)]
    quotes = []
    for k in range(120):
        t = docs[r.randrange(150)][1].split(" ")
        a = r.randint(0, len(t))
        q = r.choice([" ", "  ", ", "]).join(t[a : a + r.randint(1, 30)])
        if k % 3 == 0:
            u = docs[r.randrange(150)][1]
            q += r.choice([" ... ", "…", " | "]) + u[: r.randint(0, 60)]
        quotes.append((k, q.upper() if k % 2 else q))
    quotes += [(900, None), (901, ""), (902, "short"), (903, "this text is nowhere to be found at all"), (903, "this text is nowhere to be found at all")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, gram int")
    q = spark.createDataFrame([(*x, 1) for x in quotes], "item_id long, q string, least int")
    want = {(i, k) for i, t in docs for k, s in quotes if t and s and holds(t, s)}
    got = Q.found(d, q, "doc_id", "text", "item_id", "q").collect()
    assert len(got) == len(set(got)) and {(x.doc_id, x.item_id) for x in got} == want and len(want) > 80
    by = {x.item_id: x for x in Q.sources(q, d, "item_id", "q", "doc_id", "text").collect()}
    assert all(by[k].n_texts == len([1 for _, j in want if j == k]) for k, _ in quotes) and by[903].first_text is None
    assert Q.found(d.where("false"), q, "doc_id", "text", "item_id", "q").collect() == []
    assert Q.found(d, q.where("item_id = 902"), "doc_id", "text", "item_id", "q").collect() == []


def test_no_cross_join(spark):
    d = spark.createDataFrame([(1, "some words that are long enough")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "words that are long")], "item_id long, q string")
    plan = Q.found(d, q, "doc_id", "text", "item_id", "q")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
