"""Small inline corpora of our own for operators whose input the driver's tables do not have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return f"{v!r}::DOUBLE" if isinstance(v, float) else repr(v)


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple], names: str) -> str:
    """The same rows as a DuckDB table expression."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows) + f") v({names})"


NUMBERS = [(i, s) for i, s in enumerate(["5.353", "1.234,5", "19.930.365,00", "12", "12,5", "1.2", ",5", "abc", "", "1,2,3", "1.000,", "007", "1.23.4", None])]
DATES = [(i, s) for i, s in enumerate(["5 Pebruari 2020", "Selasa, 17 Agustus 2021", "31 Februari 2020", "1-Des-2019", "12 nopember 2022 dan 1 Januari 2023", "05-02-2020", "", None, "29 Februari 2024"])]
CASES = [
    (i, s)
    for i, s in enumerate(
        ["411/PID.SUS/2023/PT MDN", "12/Pid.Sus/2020/PN.Pli", "12/Pid.Sus/2020/PN Pli", "1234 K/PID.SUS/2021", "55 PK/Pid.Sus/2022", "7-K/PM.III-12/AD/2021", "7/Dilmil/2020", "tanpa nomor", "NA", None]
    )
]
COURTS = [(i, s) for i, s in enumerate(["PN MEDAN", "Pengadilan Negeri Banda Aceh Kelas IA", "pt. semarang", "PN. Jakarta  Pusat", "MAHKAMAH AGUNG", "DILMIL I 02 MEDAN", "PN KOTOBARU", "", None])]
RULINGS = [
    ("pdf/a.pdf", "PUTUSAN\nNomor 12/Pid.Sus/2020/PN Pli\nDEMI KEADILAN\nbahwa pada hari Senin, tanggal 3 Februari 2019 terdakwa mengangkut solar\nsetidak-tidaknya dalam tahun 2019 bertempat di jalan\nMengingat, Pasal 55 dan Pasal 53 huruf b Undang-Undang Migas;\nM E N G A D I L I :\n1. Menyatakan Terdakwa terbukti secara sah dan meyakinkan bersalah menyalahgunakan pengangkutan bahan bakar minyak yang disubsidi pemerintah;\n2. Menjatuhkan pidana denda sebesar Rp5.000.000,00 (lima juta rupiah);\n3. barang bukti 1.500 (seribu lima ratus) liter solar dan 2 kiloliter pertalite;\nDemikian diputuskan pada hari Selasa, tanggal 5 Mei 2020, diucapkan pada hari Rabu, tanggal 6 Mei 2020 oleh hakim\n"),
    ("pdf/b.pdf", "Nomor : 99/PID/2021/PT MDN\nmemeriksa putusan Pengadilan Negeri Medan Nomor 1/Pid/2020\nMENGADILI:\n- Menguatkan putusan Pengadilan Negeri Medan;\nDemikian diputuskan tanggal 1 Maret 2021\n"),
    ("pdf/c.pdf", "Nomor 10 K/Pid.Sus/2022\nmobil tangki kapasitas 5.000 liter berisi 800 liter bensin, harga Rp7.650,00 per liter, kerugian negara sebesar Rp1.200.000,00\nMENGADILI:\nMembebaskan Terdakwa tersebut dari segala dakwaan;\nMENGADILI SENDIRI\nMelepaskan Terdakwa dari segala tuntutan hukum;\nDemikian diputuskan 7 Juli 2022 itu juga diucapkan\n"),
    ("pdf/d.pdf", "surat biasa tentang tabung gas 3 kg dan lpg tanpa putusan 12 ton 3 m3"),
    ("pdf/e.pdf", ""),
    ("pdf/f.pdf", None),
]
_R = "no nomor_putusan pengadilan tingkat_persidangan tingkat_proses tanggal_putusan tahun_putusan tahun_kejadian hasil_putusan rincian_amar barang_bbm relevan_bbm nilai_kerugian_uang mata_uang dasar_nilai_uang nilai_kerugian_volume satuan_volume keterangan_volume sumber_data lampiran_pdf file_pdf rantai_perkara klasifikasi sumber_daftar url_putusan bukti_kutipan catatan".split()


def _rec(**kw):
    base = dict(nomor_putusan="1/Pid.Sus/2020/PN Mdn", pengadilan="PN Medan", tingkat_persidangan="PN", tingkat_proses="Pertama", tanggal_putusan="5 Mei 2020", tahun_putusan=2020, tahun_kejadian="2019", hasil_putusan="Bersalah", rincian_amar="Pasal 55", barang_bbm="solar subsidi", relevan_bbm="Ya", nilai_kerugian_uang=None, mata_uang=None, dasar_nilai_uang=None, nilai_kerugian_volume=100.0, satuan_volume="liter", keterangan_volume=None, sumber_data="putusan", lampiran_pdf="Ada", file_pdf="pdf/a.pdf", rantai_perkara="R01", klasifikasi="migas", sumber_daftar="Direktori", url_putusan="https://putusan3.mahkamahagung.go.id/direktori/putusan/abc1.html", bukti_kutipan="BBM solar", catatan=None)
    base.update(kw)
    return tuple(base[c] for c in _R)


RECORDS = [
    _rec(no=1),
    _rec(no=2, nomor_putusan="9/PID/2021/PT MDN", pengadilan="PT Medan", tingkat_persidangan="PT", tingkat_proses="Banding", tanggal_putusan="1 Maret 2020", tahun_kejadian="2018", hasil_putusan=None, file_pdf=None, lampiran_pdf="Tidak ada", url_putusan=None, nilai_kerugian_volume=None, satuan_volume=None),
    _rec(no=3, rantai_perkara="R02", nomor_putusan="3/Pid.Sus/2021/PN Pdg", pengadilan="PN Padang", tahun_putusan=2021, hasil_putusan="Lepas", nilai_kerugian_volume=-5.0, nilai_kerugian_uang=-1.0, url_putusan="http://x", file_pdf="pdf/x.pdf", tahun_kejadian="2023-2022"),
    _rec(no=4, rantai_perkara="R03", tingkat_persidangan="XX", tingkat_proses="Kasasi", relevan_bbm="Tidak", satuan_volume="drum", file_pdf=None, catatan="baris duplikat", url_putusan="https://putusan3.mahkamahagung.go.id/direktori/putusan/abc2.html"),
    _rec(no=5, rantai_perkara="R04", nomor_putusan="NA", tanggal_putusan="kosong", tahun_kejadian="2019-2018", nilai_kerugian_volume=100.0, catatan="kapal KM Maju Jaya milik PT Sinar Laut", pengadilan="PN Medan", url_putusan="https://putusan3.mahkamahagung.go.id/direktori/putusan/abc3.html", tahun_putusan=2019),
    _rec(no=7, rantai_perkara="R05", nomor_putusan="8 PK/Pid.Sus/2022", pengadilan="MAHKAMAH AGUNG", tingkat_persidangan="MA", tingkat_proses="Kasasi", tanggal_putusan="2 Juni 2022", tahun_putusan=2023, catatan="memuat KM Maju Jaya", file_pdf="pdf/c.pdf", mata_uang="IDR", url_putusan="https://putusan3.mahkamahagung.go.id/direktori/putusan/abc4.html", barang_bbm="pertalite industri"),
]
RECORD_NAMES = ", ".join(_R)
LISTING = "<html><body><div class='entry'><a href='https://x/direktori/putusan/aa11.html'>Putusan 1</a><a href='https://x/direktori/putusan/aa11.html'>Putusan PN Medan Nomor 1/Pid/2020</a> Register : 01-02-2020 Putus : 05-05-2020</div><div class='entry'><a href='https://x/direktori/putusan/bb22.html'>Putusan 2</a> Putus : 06-06-2021</div><a href='/direktori/index/kategori/m-1/page/12.html'>Last</a></body></html>"
OVERVIEW = "<html><body><table><tr><td>Nomor</td><td>1/Pid/2020/PN Mdn</td></tr><tr><td>Tingkat Proses</td><td>Pertama</td></tr><tr><td>Tahun</td><td>2020</td></tr><tr><td>Nomor</td><td>lain</td></tr></table><a href='/x/pdf/1'>pdf</a><div><h4>Putusan Terkait</h4><table><tr><td>Banding</td><td><a href='/direktori/putusan/bb22.html'>2/PT</a></td></tr><tr><td><a href='/direktori/putusan/aa11.html'>self</a></td></tr></table></div></body></html>"
