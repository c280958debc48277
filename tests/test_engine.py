"""Readers, pages, records, streaming, coder and command line."""

import json

import pytest
from pyspark.sql import functions as F

from gavelworks.operators import graph, records, rules
from gavelworks.plans import cli, coder, corpora as K
from gavelworks.sources import pages, readers
from gavelworks.streaming import ingest


@pytest.fixture(scope="module")
def recs(spark):
    return K.frame(spark, K.RECORDS, readers.RECORD_SCHEMA).coalesce(1)


def test_csv_round_trip(spark, recs, tmp_path):
    readers.write_csv(recs, str(tmp_path / "r"))
    assert sorted(map(tuple, readers.read_records(spark, str(tmp_path / "r")).collect()), key=str) == sorted(map(tuple, recs.replace("NA", None).collect()), key=str)
    (tmp_path / "raw.csv").write_text("﻿a,b\nNA,\n,x\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_raw(spark, str(tmp_path / "raw.csv")).collect()] == [("NA", ""), ("", "x")]


def test_issues(spark, recs):
    got = {(r.no, r.kolom, r.tingkat) for r in rules.validate(recs).collect()}
    for want in [(3, "nilai_kerugian_volume", "galat"), (3, "hasil_putusan", "galat"), (4, "tingkat_persidangan", "galat"), (5, "tahun_kejadian", "galat"), (7, "tingkat_proses", "peringatan"), (2, "url_putusan", "info"), (2, "tanggal_putusan", "peringatan"), (None, "no", "peringatan"), (1, "nomor_putusan", "info")]:
        assert want in got, want
    assert rules.validate(recs.drop("catatan")).collect()[0].kolom == "catatan"
    text, code = readers.validation_report(rules.validate(recs))
    assert code == 1 and "## galat" in text


def test_chains_and_frontier(spark):
    r = K.frame(spark, [("b", 2021), ("a", None), ("c", 2020), ("d", 2019)], "id string, year int")
    e = K.frame(spark, [("a", "b", "x"), ("b", "c", "x"), ("c", "zz", "x")], "dari_id string, ke_id string, label string")
    assert {x.id: x.chain for x in graph.chains(r, e).collect()} == {"d": "R0001", "a": "R0002", "b": "R0002", "c": "R0002"}


def test_fill_from_chain(spark):
    rows = K.frame(spark, [("a", True, 0, "x", None), ("b", False, 1, None, "q"), ("c", True, 1, "y", "z")], "id string, has_text boolean, prioritas int, f string, g string")
    links = K.frame(spark, [("b", "a"), ("c", "b")], "dari_id string, ke_id string")
    got = {r.id: (r.f, r.g) for r in records.fill_from_chain(rows, links, ["f", "g"]).collect()}
    assert got == {"a": ("x", None), "b": ("x", "q"), "c": ("y", "z")}


def test_pages_and_robots():
    assert [e["id"] for e in pages.listing(K.LISTING)] == ["aa11", "bb22"] and pages.listing(None) == []
    assert pages.last_page(K.LISTING, "/direktori/index/kategori/m-1.html") == 12
    o = pages.overview(K.OVERVIEW, "https://x/direktori/putusan/aa11.html")
    assert o["meta"]["nomor"] == "1/Pid/2020/PN Mdn" and [t["id"] for t in o["terkait"]] == ["bb22"] and o["lampiran"] == "Ada"
    robots = "User-agent: *\nDisallow: /a\nAllow: /a/b\n"
    assert pages.allowed(robots, "/a/b/c") and not pages.allowed(robots, "/a/x") and pages.allowed(robots, "/z")


def test_fetch_retries():
    calls, slept = [], []
    answers = [(503, {}, b""), (429, {"Retry-After": "7"}, b""), (200, {}, b"ok")]
    assert pages.fetch("u", lambda u: answers[calls.append(u) or len(calls) - 1], slept.append) == b"ok" and 7 in slept
    with pytest.raises(RuntimeError):
        pages.fetch("u", lambda u: (404, {}, b""), slept.append)


def test_lines_of_words(spark):
    w = K.frame(spark, [(1, 10.0, 5.0, 9.0, "b"), (1, 2.0, 5.5, 9.0, "a"), (1, 1.0, 20.0, 9.0, "c"), (1, 1.0, 21.0, 40.0, "watermark")], "page int, x double, y double, height double, word string")
    assert [r.text for r in readers.lines_of_words(w).orderBy("line").collect()] == ["a b", "c"]


def test_pdf_texts_and_jsonl(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.pdf").write_bytes(b"%PDF-" + n.encode())
    p = readers.read_pdfs(spark, str(tmp_path))
    fn = lambda b: ["p1", "p2"] if b.endswith(b"a") else 1 / 0
    got = {r.key[0]: (r.text, r.galat is None) for r in readers.pdf_texts(p, fn).collect()}
    assert got == {"a": ("p1\np2", True), "b": (None, False)}
    assert readers.pdf_texts(p, fn, p.select("key")).count() == 0
    (tmp_path / "j.jsonl").write_text('{"_key":"k","v":1}\n{"_key":"k","v":2}\n')
    assert [r.v for r in readers.read_jsonl_latest(spark, str(tmp_path / "j.jsonl"), "_key string, v int").collect()] == [2]


def test_stream_upsert(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "t")
    df = K.frame(spark, [("a", 1), ("a", 1), ("b", 2)], "id string, v int").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(src)
    s = ingest.new_rulings(spark, src, df.schema.simpleString()[7:-1].replace(":", " "))
    q = s.writeStream.foreachBatch(ingest.upsert_sink(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id for r in spark.read.parquet(f"{out}/v=0").collect()} == {"a", "b"}


def test_coder(spark):
    full = dict.fromkeys(coder.FIELDS) | {"hasil_putusan": "Bersalah", "kutipan_bukti": ["solar seribu liter lebih", "tidak ada di sana sama sekali", "pendek"]}

    def client(prompt, text):
        if "rusak" in text:
            return "{"
        return json.dumps(full | ({"hasil_putusan": "Mungkin"} if "enum" in text else {}))

    t = K.frame(spark, [("a", "membawa solar, seribu liter lebih"), ("b", "rusak"), ("c", "enum")], "file_pdf string, text string")
    got = {r.file_pdf: r for r in coder.code_texts(t, client, "p", "m").collect()}
    assert got["a"]._error is None and got["a"].kutipan_tidak_ditemukan == ["tidak ada di sana sama sekali"]
    assert got["b"]._error and got["c"]._error == "enum: hasil_putusan"
    done = spark.createDataFrame([(got["a"]._key, None)], "_key string, _error string")
    assert coder.code_texts(t, client, "p", "m", done=done).count() == 2
    assert coder.year_range("2020:2022") == [2020, 2021, 2022] and coder.year_range("2020,2024") == [2020, 2024]
    with pytest.raises(ValueError):
        coder.year_range("1900-1950")


def test_commands(spark, recs, tmp_path, capsys):
    readers.write_csv(recs, str(tmp_path / "r"))
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "aa11.html").write_text(K.OVERVIEW)
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.txt").write_text(K.RULINGS[0][1])
    run = lambda *a: cli.main(list(a), spark)
    assert run("crawl", "--pages", str(tmp_path / "pages"), "--out", str(tmp_path / "o")) == 0
    assert run("extract", "--texts", str(tmp_path / "texts"), "--out", str(tmp_path / "e")) == 0
    assert spark.read.parquet(str(tmp_path / "e")).first().hasil_kandidat == "Bersalah"
    assert run("validate", "--records", str(tmp_path / "r"), "--out", str(tmp_path / "v")) == 1
    assert run("analyze", "--records", str(tmp_path / "r"), "--out", str(tmp_path / "a")) == 0
    assert run("curate", "--records", str(tmp_path / "r"), "--texts", str(tmp_path / "texts"), "--out", str(tmp_path / "c")) == 0
    assert spark.read.parquet(str(tmp_path / "a" / "rekap_perkara_unik")).count() == 4
    assert "Laporan validasi" in capsys.readouterr().out


def test_addresses_and_page_checks(spark):
    from gavelworks.functions import web as W

    rows = [("/direktori/putusan/Ab1.html", "<td>Nomor :</td>", 'attachment; filename="a b.pdf"'), ("https://y/z", "A Database Error Occurred <td>Nomor</td>", None), (None, "G-reCAPTCHA", "inline")]
    d = K.frame(spark, rows, "u string, h string, c string")
    got = d.select(W.canonical("u"), W.recognisable("h", "overview"), W.blocked("h"), W.attachment_name("c"), W.search("https://s/?q={q}&y={tahun}&p={page}", F.lit("bahan bakar"), F.lit(2020), F.lit(3))).collect()
    assert [r[0] for r in got] == ["https://putusan3.mahkamahagung.go.id/direktori/putusan/ab1.html", "https://y/z", "https://putusan3.mahkamahagung.go.id/"]
    assert [r[1] for r in got] == [True, False, False] and [r[2] for r in got] == [False, False, True] and [r[3] for r in got] == ["a b.pdf", None, None]
    assert got[0][4] == "https://s/?q=bahan%20bakar&y=2020&p=3"
    b = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "b binary").select(W.repaired("b").alias("t")).collect()
    assert [x.t for x in b] == ["é", "é"]


def test_site_evidence(spark, recs):
    from gavelworks.functions import web as W

    o = spark.createDataFrame([("abc1", {"kata_kunci": "BBM solar", "abstrak": "x"})], "id string, meta map<string,string>")
    got = {r.no: r for r in W.site_evidence(recs, o).collect()}
    assert got[1].kata_kunci_overview_situs == "BBM (1); solar (1)" and got[2].galat_situs == "tanpa url_putusan" and got[4].galat_situs == "halaman tidak ada"
