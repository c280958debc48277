"""The consistency rules in SQL, the twin of ``rules.validate`` on the inline records."""

from __future__ import annotations

from ..functions.lexicon import FUEL_CHECK, MONTHS, STAGE_ORDER, STAGES_OF
from ..operators.rules import URL

_ALT = "|".join(sorted(MONTHS, key=len, reverse=True))
_DATE = rf"\b(\d{{1,2}})\s*(?:-|\s)\s*({_ALT})\.?\s*(?:-|\s)\s*(\d{{4}})\b"
_MONTH = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MONTHS.items())
_P = "'[cek teks PDF] '"


def na(c: str) -> str:
    return f"({c} IS NULL OR trim({c}::VARCHAR) IN ('', 'NA', 'NaN'))"


def day(c: str) -> str:
    part = lambda i: f"regexp_extract(coalesce({c}, ''), '(?i){_DATE}', {i})"
    return f"try_cast({part(3)} || '-' || lpad((CASE lower({part(2)}) {_MONTH} END)::VARCHAR, 2, '0') || '-' || lpad({part(1)}, 2, '0') AS DATE)"


def quoted(c: str) -> str:
    return f"'''' || coalesce({c}::VARCHAR, 'nan') || ''''"


def key(c: str) -> str:
    return f"(CASE WHEN {na(c)} THEN '' ELSE regexp_replace(upper({c}), '[^A-Z0-9/]', '', 'g') END)"


def core(c: str) -> str:
    p = f"list_filter(list_transform(string_split({c}, '/'), lambda x: trim(x)), lambda x: x <> '')"
    return f"""[coalesce(regexp_extract(({p})[1], '^(\\d*)', 1), ''), coalesce(list_filter({p}, lambda x: regexp_full_match(x, '\\d{{4}}'))[1], ''),
CASE WHEN len({p}) > 1 THEN regexp_replace(upper(({p})[-1]), '[^A-Z]', '', 'g') ELSE '' END]"""


def _level(c: str) -> str:
    n = f"replace(upper({c}), ' ', '')"
    return f"""CASE WHEN regexp_matches({n}, '\\d+PK/') THEN 'MA (PK)' WHEN regexp_matches({n}, '\\d+K/') THEN 'MA (Kasasi)' WHEN regexp_matches({n}, '/PT\\.?[A-Z]') THEN 'PT'
WHEN regexp_matches({n}, '/PN\\.?[A-Z]') THEN 'PN' WHEN regexp_matches({n}, '/PM|DILMIL|/AD/|/AL/|/AU/') THEN 'Pengadilan Militer' END"""


def _row_rules() -> list[tuple[str, str, str, str]]:
    """(condition, column, severity, message) over the prepared rows."""
    known = "tingkat_persidangan IN (" + ", ".join(f"'{k}'" for k in STAGES_OF) + ")"
    fits = " OR ".join(f"tingkat_persidangan = '{k}' AND tingkat_proses IN ({', '.join(repr(x) for x in v)})" for k, v in STAGES_OF.items())
    has = lambda c: f"NOT {na(c)}"
    two = "regexp_full_match(tahun_kejadian::VARCHAR, '\\d{4}(-\\d{4})?')"
    hi = "right(tahun_kejadian, 4)::INT"
    after = f"{has('tahun_kejadian')} AND {has('tahun_putusan')} AND {two} AND {hi} > tahun_putusan"
    vol, money, unit = "nilai_kerugian_volume", "nilai_kerugian_uang", "satuan_volume"
    return [
        (f"NOT coalesce({known}, false)", "tingkat_persidangan", "galat", f"'nilai tidak dikenal: ' || {quoted('tingkat_persidangan')}"),
        (f"{known} AND NOT coalesce({fits}, false)", "tingkat_proses", "galat", f"{quoted('tingkat_proses')} || ' tidak cocok dengan tingkat ' || tingkat_persidangan"),
        (f"{known} AND (CASE WHEN hint LIKE 'MA%' THEN 'MA' ELSE hint END) <> tingkat_persidangan", "nomor_putusan", "peringatan", "'pola nomor menunjukkan ' || hint || ', tercatat ' || tingkat_persidangan"),
        ("hint = 'MA (PK)' AND coalesce(tingkat_proses, '') <> 'Peninjauan Kembali'", "tingkat_proses", "peringatan", "'nomor PK tetapi tingkat_proses bukan Peninjauan Kembali'"),
        (na("hasil_putusan"), "hasil_putusan", "peringatan", "'hasil putusan kosong/NA'"),
        (f"{has('hasil_putusan')} AND hasil_putusan NOT IN ('Bersalah', 'Tidak bersalah')", "hasil_putusan", "galat", f"'nilai tidak dikenal: ' || {quoted('hasil_putusan')}"),
        ("hari IS NULL", "tanggal_putusan", "info", f"'tanggal tidak dalam format baku: ' || {quoted('tanggal_putusan')}"),
        (f"{has('tahun_putusan')} AND tahun_putusan <> year(hari)", "tahun_putusan", "galat", "'tahun_putusan ' || tahun_putusan || ' berbeda dengan tanggal ' || tanggal_putusan"),
        (f"{has('tahun_putusan')} AND tahun_putusan NOT BETWEEN 2020 AND 2026", "tahun_putusan", "peringatan", "'di luar cakupan 2020-2026: ' || tahun_putusan"),
        (f"{has('tahun_kejadian')} AND NOT {two}", "tahun_kejadian", "galat", f"'format tidak dikenal: ' || {quoted('tahun_kejadian')}"),
        (after, "tahun_kejadian", "galat", "'tahun kejadian ' || tahun_kejadian || ' sesudah tahun putusan ' || tahun_putusan"),
        (f"{has('tahun_kejadian')} AND {two} AND NOT coalesce({after}, false) AND tahun_kejadian LIKE '%-%' AND {hi} < left(tahun_kejadian, 4)::INT", "tahun_kejadian", "galat", "'rentang terbalik: ' || tahun_kejadian"),
        (f"{money} < 0", "nilai_kerugian_uang", "galat", "'nilai negatif'"),
        (f"{has(money)} AND ({na('mata_uang')} OR {na('dasar_nilai_uang')})", "mata_uang/dasar_nilai_uang", "galat", "'nilai uang terisi tetapi mata_uang/dasar kosong'"),
        (f"{na(money)} AND {has('mata_uang')}", "mata_uang", "peringatan", "'mata_uang terisi tetapi nilai uang NA'"),
        (f"{vol} <= 0", "nilai_kerugian_volume", "galat", "'volume <= 0'"),
        (f"{has(vol)} AND {na(unit)}", "satuan_volume", "galat", "'volume terisi tetapi satuan kosong'"),
        (f"{has(vol)} AND {has(unit)} AND {unit} NOT IN ('liter', 'ton', 'kiloliter')", "satuan_volume", "peringatan", f"'satuan tidak baku: ' || {quoted(unit)}"),
        (f"{na(vol)} AND {has(unit)}", "satuan_volume", "peringatan", "'satuan terisi tetapi volume NA'"),
        ("coalesce(relevan_bbm, '') <> 'Ya'", "relevan_bbm", "peringatan", f"'relevan_bbm = ' || {quoted('relevan_bbm')} || ' (rekap seharusnya hanya ''Ya'')'"),
        (f"{has('file_pdf')} AND file_pdf NOT IN (SELECT file_pdf FROM files)", "file_pdf", "galat", "'berkas tidak ditemukan: ' || file_pdf"),
        (f"{has('file_pdf')} AND {has('lampiran_pdf')} AND lampiran_pdf <> 'Ada'", "lampiran_pdf", "peringatan", f"'file_pdf terisi tetapi lampiran_pdf = ' || {quoted('lampiran_pdf')}"),
        (f"{na('file_pdf')} AND lampiran_pdf = 'Ada' AND NOT contains(lower(coalesce(catatan, '')), 'duplikat')", "file_pdf", "peringatan", "'lampiran_pdf = ''Ada'' tetapi file_pdf kosong'"),
        (na("url_putusan"), "url_putusan", "info", "'tanpa URL direktori (baris dari tabulasi tim)'"),
        (f"{has('url_putusan')} AND NOT regexp_matches(url_putusan, '{URL}')", "url_putusan", "peringatan", "'format URL tidak baku: ' || url_putusan"),
    ]


def _set_rules() -> list[str]:
    stage = " ".join(f"WHEN '{k}' THEN {v}" for k, v in STAGE_ORDER.items())
    late = f"""SELECT b.no, b.nomor_putusan, 'tanggal_putusan', 'peringatan', 'rantai ' || a.rantai_perkara || ': putusan ' || b.tingkat_proses || ' (' || b.hari || ') lebih awal dari ' || a.tingkat_proses || ' ' || a.nomor_putusan || ' (' || a.hari || ')'
FROM (SELECT *, CASE tingkat_proses {stage} ELSE 0 END AS lv FROM n) a JOIN (SELECT *, CASE tingkat_proses {stage} ELSE 0 END AS lv FROM n) b ON a.rantai_perkara = b.rantai_perkara AND a.lv < b.lv AND a.hari > b.hari"""
    twice = """SELECT n.no, n.nomor_putusan, 'nomor_putusan', CASE WHEN g.noted THEN 'info' ELSE 'peringatan' END, 'nomor sama dengan baris ' || g.nos || CASE WHEN g.noted THEN ' (sudah ditandai duplikat di catatan)' ELSE '' END
FROM n JOIN (SELECT kunci, string_agg(no::VARCHAR, ', ' ORDER BY no) AS nos, bool_or(contains(lower(coalesce(catatan, '')), 'duplikat')) AS noted FROM n GROUP BY kunci HAVING count(*) > 1) g USING (kunci)"""
    years = """SELECT arg_min(no, no), arg_min(nomor_putusan, no), 'tahun_kejadian', 'info', 'rantai ' || rantai_perkara || ': tahun kejadian berbeda antartingkat [''' || string_agg(DISTINCT tahun_kejadian::VARCHAR, ''', ''' ORDER BY tahun_kejadian::VARCHAR) || ''']'
FROM n WHERE rantai_perkara IS NOT NULL GROUP BY rantai_perkara HAVING count(DISTINCT tahun_kejadian) > 1"""
    return [
        "SELECT NULL::INT, NULL::VARCHAR, 'no', 'peringatan', 'kolom no tidak berurutan 1..n' WHERE EXISTS (SELECT 1 FROM (SELECT no, row_number() OVER () AS k FROM r) WHERE no IS DISTINCT FROM k)",
        "SELECT no, nomor_putusan, 'url_putusan', 'galat', 'url_putusan sama dengan baris lain' FROM n WHERE url_putusan IN (SELECT url_putusan FROM r GROUP BY 1 HAVING count(*) > 1)",
        twice,
        late,
        years,
        f"SELECT no, nomor_putusan, 'nomor_putusan', 'galat', 'nomor juga tercantum di daftar putusan yang dikeluarkan' FROM n WHERE kunci IN (SELECT {key('nomor_putusan')} FROM excluded)",
        "SELECT NULL, NULL, 'file_pdf', 'info', file_pdf || ' tidak dirujuk rekap (kemungkinan milik putusan yang dikeluarkan)' FROM files WHERE file_pdf NOT IN (SELECT file_pdf FROM r WHERE file_pdf IS NOT NULL)",
    ]


def _text_rules() -> list[str]:
    def rule(cond: str, kolom: str, tingkat: str, pesan: str) -> str:
        return f"SELECT no, nomor_putusan, '{kolom}', '{tingkat}', {_P} || {pesan} FROM j WHERE {cond}"

    out = [
        rule("differs AND mine = theirs", "file_pdf", "info", "'nomor di PDF ''' || k_nomor || ''' beda penulisan kode perkara dengan ''' || nomor_putusan || ''''"),
        rule("stopped AND noted", "file_pdf", "info", "'PDF berisi putusan ''' || k_nomor || ''' (sudah dijelaskan di catatan)'"),
        rule("stopped AND NOT noted", "file_pdf", "galat", "'PDF berisi putusan bernomor ''' || k_nomor || ''', bukan ''' || coalesce(nomor_putusan, 'None') || ''''"),
        rule("NOT stopped AND k_tahun <> tahun_putusan", "tahun_putusan", "peringatan", "'tanggal di teks ' || k_tanggal || ' vs tahun_putusan ' || tahun_putusan"),
        rule(f"NOT stopped AND k_hasil IS NOT NULL AND NOT {na('hasil_putusan')} AND k_hasil <> hasil_putusan", "hasil_putusan", "peringatan", "'pola amar menunjukkan ''' || k_hasil || ''' (' || k_dasar || ')'"),
    ]
    for name, pattern in FUEL_CHECK.items():
        out.append(rule(f"NOT stopped AND contains(lower(barang_bbm), '{name}') AND NOT regexp_matches(lower(coalesce(k_jenis, '')), '{pattern}')", "barang_bbm", "peringatan", f"'''{name}'' di rekap tetapi tidak disebut di teks PDF'"))
    listed = "list_transform(string_split(k_liter, ';'), lambda x: x::DOUBLE)"
    off = f"k_liter IS NOT NULL AND NOT list_contains({listed}, nilai_kerugian_volume) AND nilai_kerugian_volume <> coalesce(k_jumlah, -1) AND nilai_kerugian_volume <> coalesce(k_maks, -1)"
    shown = "(CASE WHEN nilai_kerugian_volume = floor(nilai_kerugian_volume) THEN nilai_kerugian_volume::BIGINT::VARCHAR ELSE nilai_kerugian_volume::VARCHAR END)"
    out.append(rule(f"NOT stopped AND satuan_volume = 'liter' AND {off}", "nilai_kerugian_volume", "info", f"'volume ' || {shown} || ' liter tidak sama dengan angka liter di amar (' || k_liter || ')'"))
    return out


def twin(records: str, excluded: str, files: str, candidates: str) -> str:
    """SQL for the issues of VALUES tables: records; excluded (nomor_putusan); files (file_pdf); candidates (file_pdf,
    k_nomor, k_tahun, k_tanggal, k_hasil, k_dasar, k_jenis, k_liter, k_jumlah, k_maks)."""
    rows = [f"SELECT no, nomor_putusan, '{kolom}' AS kolom, '{tingkat}' AS tingkat, {pesan} AS pesan FROM n WHERE {cond}" for cond, kolom, tingkat, pesan in _row_rules()]
    differs = f"k_nomor IS NOT NULL AND {key('k_nomor')} <> kunci"
    same = f"coalesce({core('k_nomor')} = {core('nomor_putusan')}, false)"
    noted = f"contains(coalesce(catatan, 'nan'), {core('k_nomor')}[1])"
    return f"""WITH r AS (SELECT * FROM {records}), excluded AS (SELECT * FROM {excluded}), files AS (SELECT DISTINCT file_pdf FROM {files}), cand AS (SELECT * FROM {candidates}),
n AS (SELECT *, {day('tanggal_putusan')} AS hari, {_level('nomor_putusan')} AS hint, {key('nomor_putusan')} AS kunci FROM r),
j0 AS (SELECT n.*, cand.* EXCLUDE (file_pdf), ({differs}) AS differs FROM n JOIN cand USING (file_pdf)),
j AS (SELECT *, CASE WHEN differs THEN {same} ELSE false END AS mine, true AS theirs, (differs AND NOT {same}) AS stopped, coalesce({noted}, false) AS noted FROM j0)
""" + "\nUNION ALL ".join([*rows, *_set_rules(), *_text_rules()])
