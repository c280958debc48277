"""Consistency rules of decision records as one issue table (no, nomor_putusan, kolom, tingkat, pesan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.lexicon import FUEL_CHECK, RECORD, STAGE_ORDER, STAGES_OF

# fixed values: columns, severities and texts of the issues below
ISSUE = "array<struct<kolom:string,tingkat:string,pesan:string>>"
# fixed value: the form of a ruling's address
URL = r"^https://putusan3\.mahkamahagung\.go\.id/direktori/putusan/[0-9a-z]+\.html$"


def _when(cond, kolom: str, tingkat: str, *pesan):
    text = F.concat(*[F.coalesce(p.cast("string"), F.lit("None")) if not isinstance(p, str) else F.lit(p) for p in pesan])
    return F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(kolom).alias("kolom"), F.lit(tingkat).alias("tingkat"), text.alias("pesan")))


def _read(df: DataFrame) -> DataFrame:
    """df with what several rules read from a text, worked out once a row: _day, _ev, _hint."""
    return df.withColumns({"_day": C.parse_date("tanggal_putusan"), "_ev": C.years_of("tahun_kejadian"), "_hint": C.level_of_number("nomor_putusan")})


def row_rules(files=None) -> list:
    """Rules of one row of ``_read`` in order; ``files``: column telling whether file_pdf exists (default: yes)."""
    col, na = F.col, C.is_na
    level, stage, hint = col("tingkat_persidangan"), col("tingkat_proses"), col("_hint")
    known = level.isin(*STAGES_OF)
    fits = F.lit(False)
    for k, v in STAGES_OF.items():
        fits = fits | ((level == k) & F.coalesce(stage.isin(*v), F.lit(False)))
    day, year, ev = col("_day"), col("tahun_putusan"), col("_ev")
    money, vol, unit, att = col("nilai_kerugian_uang"), col("nilai_kerugian_volume"), col("satuan_volume"), col("lampiran_pdf")
    has_year, has_ev = ~na("tahun_putusan"), ~na("tahun_kejadian")
    exists = F.lit(True) if files is None else files
    q = lambda c: F.concat(F.lit("'"), F.coalesce(c.cast("string"), F.lit("nan")), F.lit("'"))
    return [
        _when(~F.coalesce(known, F.lit(False)), "tingkat_persidangan", "galat", "nilai tidak dikenal: ", q(level)),
        _when(known & ~fits, "tingkat_proses", "galat", q(stage), " tidak cocok dengan tingkat ", level),
        _when(known & (F.when(hint.startswith("MA"), "MA").otherwise(hint) != level), "nomor_putusan", "peringatan", "pola nomor menunjukkan ", hint, ", tercatat ", level),
        _when((hint == "MA (PK)") & (F.coalesce(stage, F.lit("")) != "Peninjauan Kembali"), "tingkat_proses", "peringatan", "nomor PK tetapi tingkat_proses bukan Peninjauan Kembali"),
        _when(na("hasil_putusan"), "hasil_putusan", "peringatan", "hasil putusan kosong/NA"),
        _when(~na("hasil_putusan") & ~col("hasil_putusan").isin("Bersalah", "Tidak bersalah"), "hasil_putusan", "galat", "nilai tidak dikenal: ", q(col("hasil_putusan"))),
        _when(day.isNull(), "tanggal_putusan", "info", "tanggal tidak dalam format baku: ", q(col("tanggal_putusan"))),
        _when(has_year & (year != F.year(day)), "tahun_putusan", "galat", "tahun_putusan ", year, " berbeda dengan tanggal ", col("tanggal_putusan")),
        _when(has_year & ~year.between(2020, 2026), "tahun_putusan", "peringatan", "di luar cakupan 2020-2026: ", year),
        _when(has_ev & ev.isNull(), "tahun_kejadian", "galat", "format tidak dikenal: ", q(col("tahun_kejadian"))),
        _when(has_ev & has_year & (ev["hi"] > year), "tahun_kejadian", "galat", "tahun kejadian ", col("tahun_kejadian"), " sesudah tahun putusan ", year),
        _when(has_ev & ~F.coalesce(has_year & (ev["hi"] > year), F.lit(False)) & ev["span"] & (ev["hi"] < ev["lo"]), "tahun_kejadian", "galat", "rentang terbalik: ", col("tahun_kejadian")),
        _when(~na(money) & (money < 0), "nilai_kerugian_uang", "galat", "nilai negatif"),
        _when(~na(money) & (na("mata_uang") | na("dasar_nilai_uang")), "mata_uang/dasar_nilai_uang", "galat", "nilai uang terisi tetapi mata_uang/dasar kosong"),
        _when(na(money) & ~na("mata_uang"), "mata_uang", "peringatan", "mata_uang terisi tetapi nilai uang NA"),
        _when(~na(vol) & (vol <= 0), "nilai_kerugian_volume", "galat", "volume <= 0"),
        _when(~na(vol) & na(unit), "satuan_volume", "galat", "volume terisi tetapi satuan kosong"),
        _when(~na(vol) & ~na(unit) & ~unit.isin("liter", "ton", "kiloliter"), "satuan_volume", "peringatan", "satuan tidak baku: ", q(unit)),
        _when(na(vol) & ~na(unit), "satuan_volume", "peringatan", "satuan terisi tetapi volume NA"),
        _when(F.coalesce(col("relevan_bbm"), F.lit("")) != "Ya", "relevan_bbm", "peringatan", "relevan_bbm = ", q(col("relevan_bbm")), " (rekap seharusnya hanya 'Ya')"),
        _when(~na("file_pdf") & ~exists, "file_pdf", "galat", "berkas tidak ditemukan: ", col("file_pdf")),
        _when(~na("file_pdf") & ~na(att) & (att != "Ada"), "lampiran_pdf", "peringatan", "file_pdf terisi tetapi lampiran_pdf = ", q(att)),
        _when(na("file_pdf") & (att == "Ada") & ~F.lower(F.coalesce("catatan", F.lit(""))).contains("duplikat"), "file_pdf", "peringatan", "lampiran_pdf = 'Ada' tetapi file_pdf kosong"),
        _when(na("url_putusan"), "url_putusan", "info", "tanpa URL direktori (baris dari tabulasi tim)"),
        _when(~na("url_putusan") & ~col("url_putusan").rlike(URL), "url_putusan", "peringatan", "format URL tidak baku: ", col("url_putusan")),
    ]


def late_pairs(t: DataFrame, chain: str, level: str, day: str) -> DataFrame:
    """Pairs (a, b) of a chain in which the lower court's ruling a is later than the higher court's ruling b."""
    a, b = t.alias("a"), t.alias("b")
    return a.join(b, (F.col(f"a.{chain}") == F.col(f"b.{chain}")) & (F.col(f"a.{level}") < F.col(f"b.{level}")) & (F.col(f"a.{day}") > F.col(f"b.{day}")))


def _issues(df: DataFrame, rules: list) -> DataFrame:
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return df.select("no", "nomor_putusan", F.explode(found).alias("i")).select("no", "nomor_putusan", "i.*")


def validate(df: DataFrame, excluded: DataFrame | None = None, files: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """All issues of a record table; missing columns short-circuit.

    excluded: (nomor_putusan); files: (file_pdf) that exist; candidates: fields read from the texts."""
    spark = df.sparkSession
    none = F.lit(None)
    missing = [c for c in RECORD if c not in df.columns]
    if missing:
        return spark.createDataFrame([(None, None, ",".join(missing), "galat", "kolom wajib tidak ada")], "no int, nomor_putusan string, kolom string, tingkat string, pesan string")
    d = df
    if files is not None:
        d = d.join(files.select("file_pdf").distinct().withColumn("_exists", F.lit(True)), "file_pdf", "left")
    out = _issues(_read(d), row_rules(F.coalesce("_exists", F.lit(False)) if files is not None else None))

    # set rules: sequence, duplicates, chains, exclusion, orphan files
    # 1..n in the order of the file: within a part of it the number runs with the row, from the rows of earlier parts on
    at = df.select("no", F.monotonically_increasing_id().alias("_i")).withColumn("_part", F.shiftright("_i", 33))
    each = at.groupBy("_part").agg(F.count("*").alias("n"), F.count("no").alias("full"), F.min(F.col("no") - F.col("_i") % (1 << 33)).alias("a"), F.max(F.col("no") - F.col("_i") % (1 << 33)).alias("z"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a part
    seq = each.withColumn("before", before).agg(F.max(((F.col("full") < F.col("n")) | (F.col("a") != F.col("before") + 1) | (F.col("z") != F.col("before") + 1)).cast("int")).alias("bad")).where("bad = 1")
    out = out.union(seq.select(none.cast("int"), none.cast("string"), F.lit("no"), F.lit("peringatan"), F.lit("kolom no tidak berurutan 1..n")))
    dup = df.where("url_putusan is not null").withColumn("_n", F.count("*").over(Window.partitionBy("url_putusan"))).where("_n > 1")
    out = out.union(dup.select("no", "nomor_putusan", F.lit("url_putusan"), F.lit("galat"), F.lit("url_putusan sama dengan baris lain")))
    k = df.withColumn("_k", C.case_number_key("nomor_putusan"))
    grp = k.groupBy("_k").agg(F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list("no")), lambda x: x.cast("string")), ", ").alias("_nos"), F.max(F.lower(F.coalesce("catatan", F.lit(""))).contains("duplikat")).alias("_noted")).where("_n > 1")
    same = k.join(grp, "_k")
    out = out.union(same.select("no", "nomor_putusan", F.lit("nomor_putusan"), F.when(F.col("_noted"), "info").otherwise("peringatan"), F.concat(F.lit("nomor sama dengan baris "), "_nos", F.when(F.col("_noted"), " (sudah ditandai duplikat di catatan)").otherwise(""))))
    t = df.where("rantai_perkara is not null").select("rantai_perkara", "no", "nomor_putusan", "tingkat_proses", F.coalesce(C.literal_map(STAGE_ORDER)[F.col("tingkat_proses")], F.lit(0)).alias("lv"), C.parse_date("tanggal_putusan").alias("d")).where("d is not null")
    late = late_pairs(t, "rantai_perkara", "lv", "d")
    msg = F.concat(F.lit("rantai "), "a.rantai_perkara", F.lit(": putusan "), "b.tingkat_proses", F.lit(" ("), F.col("b.d").cast("string"), F.lit(") lebih awal dari "), "a.tingkat_proses", F.lit(" "), "a.nomor_putusan", F.lit(" ("), F.col("a.d").cast("string"), F.lit(")"))
    out = out.union(late.select("b.no", "b.nomor_putusan", F.lit("tanggal_putusan"), F.lit("peringatan"), msg))
    ev = df.where("rantai_perkara is not null").groupBy("rantai_perkara").agg(F.array_sort(F.collect_set(C.value("tahun_kejadian").cast("string"))).alias("ys"), F.min_by(F.struct("no", "nomor_putusan"), "no").alias("f")).where("size(ys) > 1")
    out = out.union(ev.select("f.no", "f.nomor_putusan", F.lit("tahun_kejadian"), F.lit("info"), F.concat(F.lit("rantai "), "rantai_perkara", F.lit(": tahun kejadian berbeda antartingkat ['"), F.array_join("ys", "', '"), F.lit("']"))))
    if excluded is not None:
        x = excluded.select(C.case_number_key("nomor_putusan").alias("_k")).distinct()
        out = out.union(k.join(x, "_k", "left_semi").select("no", "nomor_putusan", F.lit("nomor_putusan"), F.lit("galat"), F.lit("nomor juga tercantum di daftar putusan yang dikeluarkan")))
    if files is not None:
        orphan = files.select("file_pdf").distinct().join(df.select("file_pdf"), "file_pdf", "left_anti")
        out = out.union(orphan.select(none.cast("int"), none.cast("string"), F.lit("file_pdf"), F.lit("info"), F.concat("file_pdf", F.lit(" tidak dirujuk rekap (kemungkinan milik putusan yang dikeluarkan)"))))
    if candidates is not None:
        out = out.union(compare_with_text(df, candidates))
    return out


def compare_with_text(df: DataFrame, cand: DataFrame) -> DataFrame:
    """Records against the fields read from their texts; a text of another ruling stops the row."""
    k = cand.select("file_pdf", *[F.col(c).alias(f"k_{c}") for c in ("nomor_teks", "tahun_putusan_teks", "tanggal_putusan_teks", "hasil_kandidat", "dasar_hasil_kandidat", "jenis_bbm_disebut", "volume_liter_di_amar", "volume_liter_di_amar_jumlah", "volume_liter_maks_teks")])
    j = df.where("file_pdf is not null").join(k, "file_pdf")
    # what several rules need, worked out once a row
    j = j.withColumns({"_mine": C.case_number_core("nomor_putusan"), "_theirs": C.case_number_core("k_nomor_teks"), "_fuels": F.lower(F.coalesce(C.value("k_jenis_bbm_disebut"), F.lit(""))), "_nums": C.number_set("k_volume_liter_di_amar")})
    na, col = C.is_na, F.col
    differs = ~na("k_nomor_teks") & (C.case_number_key("k_nomor_teks") != C.case_number_key("nomor_putusan"))
    mine, theirs = col("_mine"), col("_theirs")
    noted = F.coalesce(col("catatan"), F.lit("nan")).contains(theirs["first"])
    stop = differs & (mine != theirs)
    p = "[cek teks PDF] "
    go = ~F.coalesce(stop, F.lit(False))
    rules = [
        _when(differs & (mine == theirs), "file_pdf", "info", p, "nomor di PDF '", col("k_nomor_teks"), "' beda penulisan kode perkara dengan '", col("nomor_putusan"), "'"),
        _when(stop & noted, "file_pdf", "info", p, "PDF berisi putusan '", col("k_nomor_teks"), "' (sudah dijelaskan di catatan)"),
        _when(stop & ~noted, "file_pdf", "galat", p, "PDF berisi putusan bernomor '", col("k_nomor_teks"), "', bukan '", col("nomor_putusan"), "'"),
        _when(go & (col("k_tahun_putusan_teks") != col("tahun_putusan")), "tahun_putusan", "peringatan", p, "tanggal di teks ", col("k_tanggal_putusan_teks"), " vs tahun_putusan ", col("tahun_putusan")),
        _when(go & ~na("k_hasil_kandidat") & ~na("hasil_putusan") & (col("k_hasil_kandidat") != col("hasil_putusan")), "hasil_putusan", "peringatan", p, "pola amar menunjukkan '", col("k_hasil_kandidat"), "' (", col("k_dasar_hasil_kandidat"), ")"),
    ]
    text = col("_fuels")
    for name, pat in FUEL_CHECK.items():
        rules.append(_when(go & F.lower(col("barang_bbm")).contains(name) & ~text.rlike(pat), "barang_bbm", "peringatan", p, f"'{name}' di rekap tetapi tidak disebut di teks PDF"))
    nums, vol = col("_nums"), col("nilai_kerugian_volume")
    off = (F.size(nums) > 0) & ~F.array_contains(nums, vol) & (vol != F.coalesce(col("k_volume_liter_di_amar_jumlah"), F.lit(-1.0))) & (vol != F.coalesce(col("k_volume_liter_maks_teks"), F.lit(-1.0)))
    rules.append(_when(go & ~na(vol) & (col("satuan_volume") == "liter") & off, "nilai_kerugian_volume", "info", p, "volume ", C.general_number(vol), " liter tidak sama dengan angka liter di amar (", col("k_volume_liter_di_amar"), ")"))
    return _issues(j, rules)


def ordered(issues: DataFrame) -> DataFrame:
    rank = F.when(F.col("tingkat") == "galat", 0).when(F.col("tingkat") == "peringatan", 1).otherwise(2)
    return issues.orderBy(rank, F.col("no").asc_nulls_last())
