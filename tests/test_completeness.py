"""Operators of the record table, the crawl and the curation that were added or mended, each against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelworks.functions import columns as C
from gavelworks.functions import extended as X
from gavelworks.operators import graph, records, rules
from gavelworks.plans import coder, corpora as K
from gavelworks.sources import pages, readers


def test_provinces(spark):
    rows = [("PN PALANGKA RAYA", "Kalimantan Tengah"), ("PT PALANGKARAYA", "Kalimantan Tengah"), ("PN KOTOBARU", "Sumatera Barat"), ("PN KOTABARU", "Kalimantan Selatan"), ("DILMIL II 11 YOGYAKARTA", "DI Yogyakarta"), ("MAHKAMAH AGUNG", None), ("PN Pelaihari", "Kalimantan Selatan"), ("PN Kisaran", "Sumatera Utara"), ("PN Stabat", "Sumatera Utara"), ("PN Bengkalis", "Riau"), ("PN Antah", None)]
    df = K.frame(spark, [(c, w) for c, w in rows], "court string, want string")
    assert all(r.provinsi == r.want for r in records.with_province(df, "court", records.gazetteer(spark)).collect())
    more = K.frame(spark, [("Aceh", "Antah")], "provinsi string, tempat string")
    assert {r.court: r.provinsi for r in records.with_province(df, "court", records.gazetteer(spark, more=more)).collect()}["PN Antah"] == "Aceh"
    from gavelworks.functions.lexicon import PLACES

    assert sum(map(len, PLACES.values())) <= 200 and len(PLACES) == 38


def test_clean_text_and_bullets(spark):
    raw = "Mahkamah Agung Republik Indonesia\nDirektori Putusan Mahkamah Agung Republik Indonesia\nputusan.mahkamahagung.go.id\nHalaman 1 dari 17 Putusan Nomor 1/Pid.Sus/2020/PN X\nT erdakwa dipidana\nDisclaimer\nEmail : kepaniteraan@mahkamahagung.go.id Telp : 021\n"
    lines = [" Barang bukti", " lanjutan kecil", "a b  c", "T erdakwa"]
    d = K.frame(spark, [(raw,), ("A bcd  efg\n\n\n x¬ y \r\nT ek",), (None,)], "t string").select(C.clean_text("t").alias("c"))
    assert [r.c for r in d.collect()] == ["Terdakwa dipidana\n", "A bcd efg\n\nx y\nTek\n", None]
    assert [r.c for r in K.frame(spark, [(x,) for x in lines], "t string").select(C.bullet_lines("t").alias("c")).collect()] == ["- Barang bukti", "lanjutan kecil", "a b c", "Terdakwa"]
    got = K.frame(spark, [("12-05-2021",), ("2021-05",), (None,)], "t string").select(C.listing_year("t").alias("y")).collect()
    assert [r.y for r in got] == [2021, None, None]


def test_fuel_kinds_in_naming_order(spark):
    assert list(X.KINDS)[-2:] == ["Minyak bakar/MFO", "Bensin (jenis tidak disebut)"]
    d = K.frame(spark, [("bensin dan minyak bakar dan superkerosin, B.B.M dan b.b.m",)], "t string").select(X.counts("t").alias("n"), F.regexp_count(F.lower("t"), F.lit(X.GENERIC)).alias("g")).first()
    assert [x.kind for x in d.n] == ["Minyak tanah", "Minyak bakar/MFO", "Bensin (jenis tidak disebut)"] and d.g == 2


def test_incident_pairs_with_names_and_unknown_years(spark):
    rows = [(1, "P", 2020, "2019", 10.0, ["KAPAL A"]), (2, "P", None, None, 10.0, []), (3, "P", 2023, "2019", 10.0, []), (4, "P", 2021, "2018", 5.0, ["KAPAL A"]), (5, "P", 2021, "2019", 7.0, ["KAPAL A", "PERUSAHAAN X"]), (6, "Q", 2020, "2019", 10.0, ["KAPAL A"])]
    df = K.frame(spark, rows, "chain int, place string, year int, event string, volume double, names array<string>")
    got = {(r.a, r.b): (r.same_volume, tuple(r.shared)) for r in graph.incident_pairs(df).collect()}
    assert got == {(1, 2): (True, ()), (2, 3): (True, ()), (1, 5): (False, ("KAPAL A",))}


def test_courts_are_no_companies(spark):
    cases = K.frame(spark, [("R1", "PN A", "Aceh", "PN", 2020, "2019", 1.0, "putusan PT Semarang dan PT Sinar Laut"), ("R2", "PN A", "Aceh", "PN", 2020, "2019", 2.0, "oleh PT Semarang"), ("R3", "PN A", "Aceh", "PN", 2020, "2019", 3.0, "milik PT Sinar Laut")], "rantai_perkara string, pengadilan_pertama string, provinsi string, tingkat_tercakup string, tahun_putusan_awal int, tahun_kejadian string, volume_liter double, _text string")
    got = {r.rantai_perkara: (r.kelompok_kejadian, r.dasar_kelompok, r.volume_liter_kelompok) for r in records.with_incidents(cases).collect()}
    assert got == {"R1": ("K01", "menyebut PERUSAHAAN SINAR LAUT", 3.0), "R2": ("R2", None, 2.0), "R3": ("K01", "menyebut PERUSAHAAN SINAR LAUT", None)}


def test_frontier_has_no_end_but_the_graphs(spark):
    e = K.frame(spark, [(i, i + 1) for i in range(70)] + [(70, 3)], "a int, b int")
    got = {r.node: r.level for r in graph.frontier(spark, K.frame(spark, [(0,)], "node int"), e).collect()}
    assert got == {i: i for i in range(71)}


def test_robots_groups():
    robots = "User-agent: *\nUser-agent: foo\nDisallow: /x\n\nUser-agent: bar\nDisallow: /\n"
    assert not pages.allowed(robots, "/x/1") and pages.allowed(robots, "/y")
    assert pages.allowed("User-agent: foo\nDisallow: /\nUser-agent: *\nDisallow: /b", "/a")


def test_downloads_and_cache(tmp_path):
    t = str(tmp_path / "d" / "a.pdf")
    with pytest.raises(ValueError):
        pages.save_file(b"<html>captcha", t, "text/html")
    assert not (tmp_path / "d").exists() and pages.save_file(b"%PDF-1", t) == t and pages.save_file(b"%PDF-2", t) == t
    assert open(t, "rb").read() == b"%PDF-1"
    calls = []
    get = lambda u: calls.append(u) or "<html>ok"
    for listing in (False, True):
        u = f"https://x/{'l' * 300}{listing}"
        for now in (None, None, 9e12):
            assert pages.cached(u, str(tmp_path / "c"), get, listing, now=now) == "<html>ok"
    assert len(calls) == 3  # the ruling once, the listing again after its day
    with pytest.raises(ValueError):
        pages.cached("https://x/y", str(tmp_path / "c"), lambda u: "<html>Captcha")


def test_jsonl_latest_over_appends(spark, tmp_path):
    import os

    for n, v in enumerate((3, 1, 2)):
        readers.append_jsonl(K.frame(spark, [("k", v), (f"o{v}", v)], "_key string, v int").coalesce(1), str(tmp_path / "j"))
        for f in os.listdir(tmp_path / "j"):
            p = str(tmp_path / "j" / f)
            if f.endswith(".json") and os.path.getmtime(p) > 2e9 - 100 or f.endswith(".json") and not os.path.exists(p + ".t"):
                os.utime(p, (1e9 + 100 * n,) * 2)
                open(p + ".t", "w").close()
        for f in os.listdir(tmp_path / "j"):
            if f.startswith(".part") and f.endswith(".crc"):
                os.remove(tmp_path / "j" / f)
    for f in os.listdir(tmp_path / "j"):
        if f.endswith(".t"):
            os.remove(tmp_path / "j" / f)
    got = {r._key: r.v for r in readers.read_jsonl_latest(spark, str(tmp_path / "j"), "_key string, v int").collect()}
    assert got == {"k": 2, "o1": 1, "o2": 2, "o3": 3}
    assert {r._key: r.v for r in readers.read_jsonl_latest(spark, str(tmp_path / "j"), "_key string, v int", order="v").collect()}["k"] == 3


def test_candidate_view_and_swap(spark, tmp_path):
    path, built = str(tmp_path / "v"), []
    build = lambda: built.append(1) or K.frame(spark, [(len(built),)], "n int")
    assert [readers.candidate_view(spark, build, path, r).first().n for r in (False, False, True)] == [1, 1, 2]
    (tmp_path / "raw.csv").write_text("a,b\nNA,\n,x\n", encoding="utf-8")
    raw = readers.read_raw(spark, str(tmp_path / "raw.csv"))
    readers.write_raw(raw.withColumn("b", F.concat("b", F.lit("!"))), str(tmp_path / "raw.csv"))
    assert sorted(tuple(r) for r in readers.read_raw(spark, str(tmp_path / "raw.csv")).collect()) == [("", "x!"), ("NA", "!")]
    for n in "ba":
        (tmp_path / f"{n}.pdf").write_bytes(b"%PDF-" + n.encode())
    keys = [r.key for r in readers.read_pdfs(spark, [str(tmp_path / "b.pdf"), str(tmp_path / "a.pdf")]).collect()]
    assert keys[0].startswith("a.") and keys[1].startswith("b.") and keys[0].endswith(".v2")


def test_final_record_and_outputs(spark, tmp_path):
    rows = [("b", "PN", "2021", "Ya", "7"), ("a", "PN", "2021", "Ya", "x"), ("c", "MA", "2020", "Perlu dicek (tanpa PDF)", None), ("d", "PN", "2021", "Tidak", "1"), ("e", "PN", "1999", "Ya", "1"), ("f", "PT", None, "Ya", "1")]
    df = K.frame(spark, rows, "nomor_putusan string, tingkat_persidangan string, tahun_putusan string, relevan_bbm string, nilai_kerugian_uang string").withColumn("url_putusan", F.concat(F.lit("u"), "nomor_putusan"))
    got = [(r.no, r.nomor_putusan, r.nilai_kerugian_uang) for r in records.final_record(df, [2020, 2021]).orderBy("no").collect()]
    assert got == [(1, "c", None), (2, "a", None), (3, "b", 7.0)]
    readers.final_outputs(df, K.frame(spark, [("u", "HTTP 404", 1)], "url string, galat string, x int"), [2020, 2021], str(tmp_path))
    assert [spark.read.parquet(str(tmp_path / n)).count() for n in ("semua_diperiksa", "rekap", "daftar_url", "log_gagal")] == [6, 3, 6, 1]


def test_renumber_and_sequence(spark):
    r = random.Random(1)
    xs = [(r.randrange(40), i) for i in range(500)]
    df = K.frame(spark, r.sample(xs, 500), "a int, b int").repartition(7)
    got = {x.b: x.no for x in records.renumber(df, ["a", "b"]).collect()}
    assert got == {b: n for n, (_, b) in enumerate(sorted(xs), 1)}
    recs = K.frame(spark, K.RECORDS, readers.RECORD_SCHEMA)
    bad = lambda d: rules.validate(d).where("kolom = 'no'").count()
    fine = spark.createDataFrame(recs.drop("no").rdd.zipWithIndex().map(lambda x: (x[1] + 1, *x[0])), readers.RECORD_SCHEMA)
    assert bad(recs) == 1 and bad(fine) == 0 and bad(fine.coalesce(1)) == 0 and bad(fine.withColumn("no", F.col("no") + 1)) == 1


def test_quantiles_against_numpy(spark):
    r = random.Random(3)
    rows = [(g, r.choice([None, 5.0, r.uniform(-3, 1e6), float(r.randrange(10))])) for g in ("a", "b", None) for _ in range(300)] + [("one", 2.5), ("none", None), ("same", 4.0), ("same", 4.0)]
    df = K.frame(spark, rows, "g string, v double")
    for cells in (1024, 3):
        got = {x.g: (x.m, x.p) for x in records.quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.9}, cells).collect()}
        for g in ("a", "b", None, "one", "same"):
            v = [y for k, y in rows if k == g and y is not None]
            assert got[g] == pytest.approx((np.quantile(v, 0.5), np.quantile(v, 0.9))), g
        assert "none" not in got
    stats = {x.g: x for x in records.volume_stats(df, ["g"], "v").collect()}
    assert stats["none"].median is None and stats["none"].perkara == 1 and stats[None].perkara == 300
    assert stats["a"].rata2 == pytest.approx(statistics.mean(y for k, y in rows if k == "a" and y is not None), abs=1e-3)


def test_crawl_relevance_and_online(spark):
    over = K.frame(spark, [("a.pdf", "solar", None), ("b.pdf", "solar solar solar solar", "x"), (None, None, None)], "file_pdf string, kata_kunci string, abstrak string")
    texts = K.frame(spark, [("a.pdf", "kursi dan meja"), ("c.pdf", None)], "file_pdf string, text string")
    got = {r.file_pdf: (r.jenis_bbm_disebut, r.relevan_bbm_kandidat, r.dasar_relevansi) for r in records.crawl_relevance(over, texts).collect()}
    assert got["a.pdf"][0] is None and got["a.pdf"][2] == "teks PDF" and got["b.pdf"][0] == "Solar/Biosolar (4)" and got["b.pdf"][2] == "overview" and got[None][1] == "NA"
    ev = K.frame(spark, [(1, "n1", "x"), (2, None, "y")], "no int, nomor_putusan string, e string")
    on = K.frame(spark, [(1, "n1", "BBM (1)"), (1, "other", "z")], "no int, nomor_putusan string, o string")
    assert sorted((r.no, r.e, r.o) for r in records.with_online(ev, on).collect()) == [(1, "x", "BBM (1)"), (2, "y", None)]


def test_requests_and_unions(spark):
    got = readers.category_pages(K.frame(spark, [("https://x/kategori/m-1.html",)], "url string"), [2020, 2021], 2).collect()
    assert sorted(r.alamat for r in got) == sorted(f"https://x/kategori/m-1/tahunjenis/putus/tahun/{y}{p}.html" for y in (2020, 2021) for p in ("", "/page/2"))
    a, b = K.frame(spark, [("1", "x")], "id string, sumber string"), K.frame(spark, [("y", "2", 3)], "sumber string, id string, n int")
    assert sorted(tuple(r) for r in pages.all_listings(a, b).select("id", "sumber", "n").collect()) == [("1", "x", None), ("2", "y", 3)]
    assert readers.search_pages(spark, ["a", "b"], [2020, 2021], 3).count() == 12


def test_chain_completion_with_audit_and_outcome(spark):
    rows = [("a", "N1", True, 0, 5.0, "tabel", "Bersalah", None), ("b", "N2", False, 2, None, None, None, "ikut putusan sebelumnya"), ("c", "N3", False, 3, 1.0, "own", None, "lain"), ("d", "N4", True, 2, None, "x", "Tidak bersalah", None), ("e", "N5", False, 3, None, None, None, "ikut putusan sebelumnya")]
    df = K.frame(spark, rows, "id string, nomor_putusan string, has_text boolean, prioritas int, vol double, dasar_volume string, hasil_putusan string, dasar_hasil string")
    links = K.frame(spark, [("b", "a"), ("a", "c"), ("d", "b"), ("e", "a"), ("e", "d")], "dari_id string, ke_id string")
    got = {r.id: (r.vol, r.dasar_volume) for r in records.fill_from_chain(df, links, ["vol"], {"vol": "dasar_volume"}).collect()}
    assert got == {"a": (5.0, "tabel"), "b": (5.0, "tabel (dari putusan terkait N1)"), "c": (1.0, "own"), "d": (None, "x"), "e": (5.0, "tabel (dari putusan terkait N1)")}
    out = {r.id: (r.hasil_putusan, r.dasar_hasil) for r in records.outcome_from_below(df, links).collect()}
    assert out["b"] == ("Bersalah", "ikut putusan sebelumnya; hasil putusan sebelumnya (dari putusan terkait N1)")
    assert out["e"] == ("Tidak bersalah", "ikut putusan sebelumnya; hasil putusan sebelumnya (dari putusan terkait N4)") and out["c"] == (None, "lain")


def test_coded_records(spark):
    base = {f: None for f in coder.FIELDS}
    rows = [
        {"file_pdf": "a", **base, "nilai_kerugian_uang": 5.0, "dasar_nilai_uang": "harga", "kutipan_bukti": ["p", "q"], "catatan": "cat", "_error": None, "kutipan_tidak_ditemukan": ["q"], "dasar_kode": "b", "pasal_uu_migas": ["55", "53b"], "koreksi_verifikator": ["ubah"], "model": "m", "verifikasi": True},
        {"file_pdf": "b", **base, "_error": "HTTP", "kutipan_tidak_ditemukan": None, "dasar_kode": None, "pasal_uu_migas": None, "koreksi_verifikator": None, "model": "m", "verifikasi": False},
    ]
    schema = "file_pdf string, " + coder.SCHEMA + ", _error string, kutipan_tidak_ditemukan array<string>, dasar_kode string, pasal_uu_migas array<string>, koreksi_verifikator array<string>, model string, verifikasi boolean"
    df = spark.createDataFrame([tuple(r[c.strip().split(" ")[0]] for c in schema.split(", ")) for r in rows], schema)
    a, b = coder.to_records(df).orderBy("file_pdf").collect()
    assert (a.mata_uang, a.dasar_nilai_uang, a.bukti_kutipan, a.sumber_data) == ("IDR", "(b) harga", "p | q", "PDF putusan (koding m, diverifikasi)")
    assert a.catatan == "cat Pasal UU 22/2001: 55, 53b Koreksi verifikator: ubah 1 kutipan tidak ditemukan di teks"
    assert b.catatan == "GAGAL dikodekan: HTTP" and b.sumber_data is None and b.mata_uang is None


def test_work_folders_need_a_shared_place(spark, monkeypatch):
    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        graph.shared_folder(Far)


def test_incident_pairs_shuffle_cases_only(spark):
    rows = [(1, "P", 2020, None, 10.0, ["KAPAL B", "KAPAL A", None]), (2, "P", 2020, None, 10.0, ["KAPAL A", "KAPAL B"]), (3, "P", 2020, None, 1.0, ["KAPAL A", "KAPAL B"]), (4, "P", 2020, None, None, None), (3, "P", 2020, None, 1.0, ["KAPAL A", "KAPAL B"])]
    df = graph.incident_pairs(K.frame(spark, rows, "chain int, place string, year int, event string, volume double, names array<string>"))
    both = ["KAPAL A", "KAPAL B"]
    assert sorted(map(tuple, df.collect())) == [(1, 2, True, both, 10.0), (1, 3, False, both, None), (2, 3, False, both, None)]
    assert "Aggregate [a#" not in df._jdf.queryExecution().optimizedPlan().toString()
