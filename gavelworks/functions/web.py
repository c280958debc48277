"""Addresses and pages of the directory as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col, is_na
from .rulings import keyword_hits, listed

# fixed values: the site's address forms, marks of block pages and of error pages
BASE = "https://putusan3.mahkamahagung.go.id"
BLOCK_MARKS = ["g-recaptcha", "recaptcha/api", "h-captcha", "hcaptcha.com", "saya bukan robot", "i'm not a robot", "cf-chl-", "challenge-platform", "just a moment..."]
ERROR_MARKS = "Database Error|A PHP Error|Fatal error|Uncaught Exception|Service Unavailable|Error Occurred"
OVERVIEW_MARKS = r">\s*(Nomor|Tingkat Proses|Klasifikasi|Lembaga Peradilan)(\s|&nbsp;|&#160;| |:)*<"


def ruling_id(url) -> Column:
    """Id of a ruling's address; null for other addresses."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"(?i)/putusan/([0-9a-z]+)\.html", 1)), F.lit(""))


def canonical(url, base: str = BASE) -> Column:
    """The one address of a ruling; other links are made absolute."""
    u = F.coalesce(col(url), F.lit(""))
    other = F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(u.startswith("/"), F.concat(F.lit(base), u)).otherwise(F.concat(F.lit(base + "/"), u))
    return F.coalesce(F.concat(F.lit(f"{BASE}/direktori/putusan/"), ruling_id(url), F.lit(".html")), other)


def listing_base(url) -> Column:
    return F.regexp_replace(col(url), r"/page/\d+\.html", ".html")


def page(url, n) -> Column:
    """Address of the n-th page of a listing."""
    base = listing_base(url)
    return F.when(col(n) <= 1, base).otherwise(F.concat(F.regexp_replace(base, r"\.html$", ""), F.lit("/page/"), col(n).cast("string"), F.lit(".html")))


def by_year(url, year, kind: str = "putus") -> Column:
    base = F.regexp_replace(listing_base(url), r"/tahunjenis/[^/]+/tahun/\d{4}\.html$", ".html")
    return F.concat(F.regexp_replace(base, r"\.html$", ""), F.lit(f"/tahunjenis/{kind}/tahun/"), col(year).cast("string"), F.lit(".html"))


def search(template: str, words, year, n) -> Column:
    """A search address from a template with {q}, {tahun} and {page}."""
    u = F.replace(F.lit(template), F.lit("{q}"), F.replace(F.url_encode(col(words)), F.lit("+"), F.lit("%20")))
    return F.replace(F.replace(u, F.lit("{tahun}"), col(year).cast("string")), F.lit("{page}"), col(n).cast("string"))


def blocked(html) -> Column:
    t = F.lower(F.substring(F.coalesce(col(html), F.lit("")), 1, 200_000))
    out = F.lit(False)
    for m in BLOCK_MARKS:
        out = out | t.contains(m)
    return out


def recognisable(html, kind: str) -> Column:
    """Whether a page is what was asked for (overview, daftar) and no error page, so that it may be kept."""
    h = F.coalesce(col(html), F.lit(""))
    fine = ~h.rlike(f"(?i){ERROR_MARKS}")
    if kind == "overview":
        return fine & h.rlike(f"(?i){OVERVIEW_MARKS}")
    if kind == "daftar":
        return fine & h.rlike(r"(?i)/direktori/putusan/[0-9a-z]+\.html|Direktori Putusan|putusan3\.mahkamahagung")
    return F.lit(True)


def attachment_name(header) -> Column:
    """File name of a Content-Disposition header."""
    return F.nullif(F.regexp_extract(F.coalesce(col(header), F.lit("")), r"filename\*?=(?:UTF-8'')?\"?([^\";]+)", 1), F.lit(""))


def repaired(content) -> Column:
    """Bytes as text: UTF-8 if valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(col(content).cast("string")), F.decode(col(content), "ISO-8859-1"))


def fresh(fetched_at, is_listing, now, hours: int = 24) -> Column:
    """Whether a kept page may be used again: rulings always, listings for a day."""
    return ~col(is_listing) | (col(fetched_at) > col(now) - F.expr(f"interval {hours} hours"))


def site_evidence(records: DataFrame, overviews: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Keywords in each record's ruling page and its PDF text: (no, nomor_putusan, kata_kunci_overview_situs, kata_kunci_pdf_situs, galat_situs).

    overviews: (id, meta map); texts: (id, text)."""
    r = records.select("no", "nomor_putusan", "url_putusan", ruling_id("url_putusan").alias("id"))
    meta = F.concat_ws(" ", *[F.col("meta")[k] for k in ("kata_kunci", "catatan_amar", "amar_lainnya", "abstrak", "klasifikasi")])
    o = overviews.select("id", keyword_hits(meta).alias("h")).dropDuplicates(["id"]).withColumn("_seen", F.lit(True))
    r = r.join(o, "id", "left")
    if texts is not None:
        r = r.join(texts.select("id", keyword_hits("text").alias("p")).dropDuplicates(["id"]), "id", "left")
    else:
        r = r.withColumn("p", F.lit(None).cast("array<struct<kind:string,n:int>>"))
    error = F.when(is_na("url_putusan"), "tanpa url_putusan").when(F.col("_seen").isNull(), "halaman tidak ada")
    return r.select("no", "nomor_putusan", listed(F.col("h")).alias("kata_kunci_overview_situs"), listed(F.col("p")).alias("kata_kunci_pdf_situs"), error.alias("galat_situs"))
