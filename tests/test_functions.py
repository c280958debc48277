"""Scalar functions and text fields on hand-worked cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gavelworks.functions import columns as C
from gavelworks.functions import rulings as R


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn("t").alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("5.353", 5353.0), ("1.234,5", 1234.5), ("19.930.365,00", 19930365.0), ("12", 12.0), (",5", 5.0), ("x", None), ("", None), ("1.000.", 1000.0), (None, None)])
def test_numbers(spark, text, want):
    assert one(spark, text, C.parse_number) == want


@pytest.mark.parametrize("x,want", [(14920.0, "14920"), (0.5, "0.5"), (1234567.0, "1.23457e+06"), (100.0, "100"), (0.0, "0"), (12.3456789, "12.3457")])
def test_general_number(spark, x, want):
    assert spark.range(1).select(C.general_number(F.lit(x)).alias("v")).first()["v"] == want
    assert want == f"{x:g}"


def test_dates(spark):
    assert one(spark, "pada 5 Pebruari 2020 di", C.parse_date) == dt.date(2020, 2, 5)
    assert one(spark, "31 Februari 2020", C.parse_date) is None
    assert one(spark, "05-02-2020", C.parse_date) is None
    assert one(spark, "1 Mei 2021", lambda c: C.format_date(C.parse_date(c))) == "1 Mei 2021"


def test_verdict_is_the_last_heading(spark):
    t = "x\n M E N G A D I L I :\nlama\nDemikian a\nMENGADILI:\nbaru\nMENGADILI SENDIRI\nisi\nDemikian diputuskan"
    assert one(spark, t, R.verdict) == "MENGADILI:\nbaru\nMENGADILI SENDIRI\nisi"
    assert one(spark, "tanpa", R.verdict) is None


@pytest.mark.parametrize(
    "text,want",
    [
        ("Menyatakan terdakwa TERBUKTI SECARA SAH DAN MEYAKINKAN BERSALAH", "Bersalah"),
        ("terdakwa tidak terbukti secara sah dan meyakinkan bersalah; membebaskan terdakwa dari dakwaan", "Tidak bersalah"),
        ("melepaskan terdakwa dari segala tuntutan hukum", "Tidak bersalah"),
        ("menolak permohonan kasasi dari pemohon kasasi/terdakwa", "Bersalah"),
        ("menolak permohonan kasasi dari penuntut umum", None),
        ("menguatkan putusan", None),
        ("membebaskan terdakwa dari dakwaan primair; terbukti bersalah", "Bersalah"),
        ("bersalah mengadili sendiri: melepaskan terdakwa dari tuntutan hukum", "Tidak bersalah"),
        ("", None),
    ],
)
def test_outcome(spark, text, want):
    assert one(spark, text, R.outcome)["hasil"] == want


def test_fuel_counts_and_relevance(spark):
    got = one(spark, "bio solar, solar dan bio-solar; pertalite. Tabung gas", R.fuel_counts)
    assert [(g.kind, g.n) for g in got] == [("Solar/Biosolar", 3), ("Pertalite", 1), ("LPG/Gas", 1)]
    rel = lambda t: one(spark, t, lambda c: R.relevance(R.fuel_counts(c), c))
    assert [rel(t) for t in ("solar", "BBM saja", "minyak mentah", "elpiji", "BBM elpiji", "lain", None)] == ["Ya", "Ya", "Sebagian", "Tidak", "Tidak", "NA", "NA"]


def test_volumes(spark):
    got = one(spark, "tangki kapasitas 5.000 liter; memuat 800 (delapan ratus) liter, 2 kL dan 3 m3 serta 12 ton", R.volume_mentions)
    assert [(g.value, g.unit, g.kind) for g in got] == [(5000.0, "liter", "kapasitas"), (800.0, "liter", "jumlah"), (2000.0, "liter", "jumlah"), (3000.0, "liter", "jumlah"), (12.0, "ton", "jumlah")]


def test_money_kinds(spark):
    got = one(spark, "kerugian negara Rp1.000.000,00; harga Rp7.650,00 per liter; hasil lelang sebesar Rp 5.000; denda Rp10; Rp7", R.money_mentions)
    assert [(g.value, g.kind) for g in got] == [(1e6, "kerugian_negara"), (7650.0, "harga_per_liter"), (5000.0, "hasil_lelang"), (10.0, "denda"), (7.0, "lain")]


def test_articles_events_origin(spark):
    assert one(spark, "Mengingat Pasal 53 huruf b, Pasal 55 dan Pasal 55\nMENGADILI\nx", R.articles) == ["53b", "55"]
    y = one(spark, "dalam bulan Maret 2019 dan pada bulan April 2019, sekitar bulan Mei tahun 2020", lambda c: R.event_years(c, F.lit(2021)))
    assert y.label == "2019" and y.years == [2019, 2020]
    assert one(spark, "putusan Pengadilan Negeri Nanga Bulik Nomor 1", R.origin_court) == "PN NANGA BULIK"
    assert one(spark, "x", R.origin_court) is None


def test_entities_and_places(spark):
    got = one(spark, "kapal KM. Maju Jaya 2 milik PT Sinar Laut, PT Pertamina, 4/PID/2020/PT MDN, PT Medan", lambda c: R.entities(F.col(c), F.array(F.lit("MEDAN"))))
    assert got == ["KAPAL MAJU JAYA 2", "PERUSAHAAN SINAR LAUT"]


def test_keyword_hits(spark):
    got = one(spark, "B.B.M. dan BBM jenis bio solar, solar", R.keyword_hits)
    assert {g.kind: g.n for g in got} == {"BBM": 2, "solar": 1, "biosolar": 1}
    assert one(spark, None, R.keyword_hits) is None


def test_clean_lines(spark):
    assert one(spark, "a b\n\n\n\nT erdakwa x\nDirektori Putusan\nkata¬ sambung", lambda c: C.clean_lines(c, ["^Direktori"])) == "a b\n\nTerdakwa x\nkata sambung"
