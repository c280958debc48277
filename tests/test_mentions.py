"""Mentions in one pass: the same rows as the expressions that look behind, linear cost, edge cases."""

import random
import time

from pyspark.sql import functions as F

from gavelworks.functions import rulings as R
from gavelworks.operators import mentions as M

BITS = [
    "1.500 liter", "2,5 ton", "3 kilo liter", "4 KL", "10 k.l", "7 m3", "7 m³", "12 (dua belas) ltr", "5 lt", "5 lé", "9 l", "kapasitas ", "isi ", "@ ", "volume ", "ukuran ", "; ", ", ", "\n", " dan ", "solar ",
    "Rp. 1.200.000,00", "rp 5000", "Rp1 . 000", "Rp7.650,- per liter", "Rp6.800/liter", "kerugian negara ", "kerugian keuangan negara ", "lelang ", "denda ", "harga ", "biaya perkara ", "upah ", " (seribu) ", "x" * 50, "é ", "1.2.3 liter", "0 liter", "Rp", "12",
]


def test_same_rows_as_the_expressions(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choices(BITS, k=r.randint(0, 14)))) for i in range(250)] + [(900, None), (901, ""), (902, "Rp5 " * 60)]
    df = spark.createDataFrame([(*x, 7) for x in rows], "i int, t string, m int")
    got = M.with_mentions(df, {"m": ("volume", "t"), "n": ("money", "t")})
    assert got.columns == ["i", "t", "m", "n"]
    got = {x.i: x for x in got.collect()}
    want = {x.i: x for x in df.select("i", R.volume_mentions("t").alias("m"), R.money_mentions("t").alias("n")).collect()}
    assert len(got) == len(rows) and sum(len(x.m or []) for x in got.values()) > 250
    for i, t in rows:
        assert got[i].m == want[i].m, repr(t)
        assert got[i].n == want[i].n, repr(t)
    assert M.with_mentions(df.where("false"), {"v": ("volume", "t")}).collect() == []


def test_cost_is_linear(spark):
    base = "disita 1.500 liter solar seharga Rp6.800 per liter; kapasitas 5.000 liter, denda Rp10.000.000,00 dan lain-lain " * 100
    took = []
    for k in (1, 16):
        start = time.perf_counter()
        assert len(M.volumes(base * k)) == 200 * k and len(M.amounts(base * k)) == 200 * k
        took.append(time.perf_counter() - start)
    assert took[1] < 16 * took[0] * 3


def test_a_hundred_thousand_texts(spark):
    n = 100_000
    df = spark.range(n).select("id", F.concat(F.lit("barang bukti "), F.col("id") + 1, F.lit(" liter solar, denda Rp"), F.col("id"), F.lit("000")).alias("t"))
    x = M.with_mentions(df, {"m": ("volume", "t"), "n": ("money", "t")})
    got = x.select(F.sum(F.element_at("m", 1)["value"] - F.col("id")).alias("a"), F.count_if(F.element_at("n", 1)["kind"] == "denda").alias("b")).first()
    assert (got.a, got.b) == (n, n)


def test_sizes_are_volumes_without_context_and_need_a_unit_behind_a_run_of_digits():
    import random
    import re

    bits = ["1", "23", "4567", "890", ".", ",", ",", " ", "\n", "(dua liter)", "(", " liter", "kl", "k.l", " L", "l", " ton", "m3", "m³", "kilo liter", "lt", ";", " dan ", " kapasitas ", "é"]
    rng = random.Random(7)
    for _ in range(20000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert [m.span() for m in M._volumes(t)] == [m.span() for m in M._VOLUME.finditer(t)], t
        assert M.sizes(t) == [v[:3] for v in M.volumes(t)], t
    assert re.match(r"\[0-9\]", M._END.pattern)  # found by its first character, not tried at each place


def test_patterns_are_tried_only_where_their_words_are(spark):
    from pyspark.sql import functions as F

    from gavelworks.functions import rulings as R
    from gavelworks.functions.lexicon import FUELS, GENERIC_FUEL, OFFENCES

    assert R.needed(r"bio\s*-?\s*solar") == ["solar"] and R.needed(r"\bgas\s+(?:3|tiga)\s*kg|ab?c{2}d|[x]yz") == ["gas", "a", "yz"] and R.needed("(a|b)|lelang") == []
    pats = [p for ps in FUELS.values() for p in ps] + GENERIC_FUEL + [p for p, _ in OFFENCES]
    texts = ["bio - solar, solar industri; hsd", "pertalit pertalite", "minyak  tanah dan minyak mentah, kondensat", "gas 12 kg, tabung gas, elpiji", "tanpa izin usaha niaga bbm bersubsidi", "niaga solar tanpa izin", "", "solaria gasolin", None]
    x = spark.createDataFrame([(t,) for t in texts], "t string")
    got = x.select(*[F.coalesce(R.hits(F.col("t"), p), F.lit(-1)) for p in pats], *[R.matched(F.col("t"), p) for p in pats]).collect()
    want = x.select(*[F.coalesce(F.regexp_count("t", F.lit(p)), F.lit(-1)) for p in pats], *[F.col("t").rlike(p) for p in pats]).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
