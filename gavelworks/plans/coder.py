"""Optional coding of ruling texts by an external model behind an injected client."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.rulings import once

# fixed values: fields of a coded record
FIELDS = [
    "nomor_putusan", "pengadilan", "tingkat_persidangan", "tingkat_proses", "tanggal_putusan", "tahun_kejadian", "hasil_putusan", "rincian_amar", "barang_bbm",
    "relevan_bbm", "nilai_kerugian_uang", "mata_uang", "dasar_nilai_uang", "nilai_kerugian_volume", "satuan_volume", "keterangan_volume", "klasifikasi",
    "kutipan_bukti", "catatan", "keyakinan",
]
SCHEMA = ", ".join(f"{f} {'array<string>' if f == 'kutipan_bukti' else 'double' if f.startswith('nilai') else 'string'}" for f in FIELDS)
ENUMS = {"hasil_putusan": ["Bersalah", "Tidak bersalah"], "relevan_bbm": ["Ya", "Sebagian", "Tidak"], "tingkat_persidangan": ["PN", "PT", "MA", "Pengadilan Militer"]}


def quotes_missing(quotes, text):
    """Quotes with a part of 12 or more word characters that the text does not hold."""

    def absent(hay):
        def one(q):
            parts = F.filter(F.transform(F.split(q, r"\.{3}|…|\|"), C.bare), lambda p: F.length(p) >= 12)
            return F.exists(parts, lambda p: ~F.contains(hay, p))

        return one

    return once(C.bare(text), lambda hay: F.filter(C.col(quotes), absent(hay)))


def code_texts(texts: DataFrame, client, prompt: str, model: str, verify: bool = False, done: DataFrame | None = None) -> DataFrame:
    """(file_pdf, _key, fields.., kutipan_tidak_ditemukan, _error): one call per text not done (two with verify).

    client(prompt, text) returns JSON text; refusals, cut answers and values outside the schema become _error."""
    t = texts.withColumn("_key", C.document_key(F.lit(prompt), F.lit(model), F.lit(str(verify)), "text"))
    if done is not None:
        t = t.join(done.where("_error is null").select("_key"), "_key", "left_anti")

    def ask(text: str) -> tuple[str | None, str | None]:
        try:
            answer = json.loads(client(prompt, text))
            if verify:
                answer = json.loads(client(prompt + "\nPeriksa kembali:\n" + json.dumps(answer, ensure_ascii=False), text))
            if set(answer) != set(FIELDS):
                return None, "schema: " + ",".join(sorted(set(answer) ^ set(FIELDS)))
            bad = [k for k, v in ENUMS.items() if answer[k] is not None and answer[k] not in v]
            return (None, "enum: " + ",".join(bad)) if bad else (json.dumps(answer, ensure_ascii=False), None)
        except Exception as e:  # noqa: BLE001  a failed document is a row with its error
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        for pdf in batches:
            got = [ask(x) for x in pdf["text"]]
            yield pdf[["file_pdf", "_key", "text"]].assign(j=[g[0] for g in got], _error=[g[1] for g in got])

    out = t.select("file_pdf", "_key", "text").mapInPandas(run, "file_pdf string, _key string, text string, j string, _error string")
    out = out.withColumn("r", F.from_json("j", SCHEMA)).select("file_pdf", "_key", "text", "r.*", "_error")
    return out.withColumn("kutipan_tidak_ditemukan", quotes_missing("kutipan_bukti", "text")).drop("text")


def flat(coded: DataFrame) -> DataFrame:
    """Coded records as one text row each, quotes joined."""
    return coded.where("_error is null").select("file_pdf", *[F.array_join(f, " | ").alias(f) if f == "kutipan_bukti" else F.col(f) for f in FIELDS], F.array_join("kutipan_tidak_ditemukan", " | ").alias("kutipan_tidak_ditemukan"))


def to_records(coded: DataFrame) -> DataFrame:
    """Coded records in the columns of a decision record: failures as notes, the basis of amounts with its code in
    front, articles, corrections and lost quotes in the note.

    Columns that are there are used: dasar_kode, pasal_uu_migas, koreksi_verifikator (arrays), model, verifikasi."""
    has = lambda c: c in coded.columns
    arr = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if has(c) else F.array().cast("array<string>")
    bad = F.col("_error").isNotNull()
    joined = lambda c, sep, head: F.when(F.size(arr(c)) > 0, F.concat(F.lit(head), F.array_join(arr(c), sep)))
    lost = F.when(F.size(arr("kutipan_tidak_ditemukan")) > 0, F.concat(F.size(arr("kutipan_tidak_ditemukan")).cast("string"), F.lit(" kutipan tidak ditemukan di teks")))
    note = F.nullif(F.concat_ws(" ", F.nullif("catatan", F.lit("")), joined("pasal_uu_migas", ", ", "Pasal UU 22/2001: "), joined("koreksi_verifikator", "; ", "Koreksi verifikator: "), lost), F.lit(""))
    code = F.coalesce(F.col("dasar_kode").cast("string"), F.lit("None")) if has("dasar_kode") else F.lit("None")
    basis = F.when(~C.is_na("dasar_nilai_uang"), F.concat(F.lit("("), code, F.lit(") "), F.col("dasar_nilai_uang")))
    checked = F.when(F.col("verifikasi"), ", diverifikasi)").otherwise(")") if has("verifikasi") else F.lit(")")
    special = {
        "mata_uang": F.when(F.col("nilai_kerugian_uang").isNotNull(), "IDR"),
        "dasar_nilai_uang": basis,
        "bukti_kutipan": F.array_join(arr("kutipan_bukti"), " | "),
        "sumber_data": F.concat(F.lit("PDF putusan (koding "), F.col("model") if has("model") else F.lit("model"), checked),
    }
    keep = [f for f in FIELDS if f not in ("kutipan_bukti", "catatan", "keyakinan", *special)]
    return coded.select(
        "file_pdf", *[F.when(~bad, F.col(f)).alias(f) for f in keep], *[F.when(~bad, c).alias(n) for n, c in special.items()],
        F.when(bad, F.concat(F.lit("GAGAL dikodekan: "), F.col("_error"))).otherwise(note).alias("catatan"),
    )


def year_range(arg: str) -> list[int]:
    """'2020:2026', '2020-2026' or '2020,2022' as years within 1990-2100."""
    m = re.fullmatch(r"\s*(\d{4})\s*[:-]\s*(\d{4})\s*", arg)
    ys = list(range(int(m[1]), int(m[2]) + 1)) if m else [int(x) for x in arg.split(",")]
    if not ys or any(not 1990 <= y <= 2100 for y in ys):
        raise ValueError(f"years out of 1990-2100: {arg}")
    return ys
