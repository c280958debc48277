"""Scalar functions as Column expressions: nulls, text, numbers, dates, courts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import BOILERPLATE, MONTH_NAMES, MONTHS

MONTH_ALT = "|".join(sorted(MONTHS, key=len, reverse=True))
# fixed value: the form of a date
DATE = rf"(?i)\b(\d{{1,2}})\s*(?:-|\s)\s*({MONTH_ALT})\.?\s*(?:-|\s)\s*(\d{{4}})\b"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


# -- nulls -------------------------------------------------------------------------------------


def is_na(c) -> Column:
    """Null, NaN, blank or the text NA."""
    t = F.trim(col(c).cast("string"))
    return col(c).isNull() | t.isin("", "NA", "NaN")


def value(c) -> Column:
    """The value, null where is_na."""
    return F.when(~is_na(c), col(c))


def first_value(*cols) -> Column:
    return F.coalesce(*[value(c) for c in cols])


# -- text --------------------------------------------------------------------------------------


def squash(c) -> Column:
    return F.regexp_replace(F.lower(col(c)), r"(?U)\s+", "")


def normalise_space(c) -> Column:
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def case_number_key(c) -> Column:
    """Comparable form of a case number; '' for a missing one."""
    return F.when(is_na(c), F.lit("")).otherwise(F.regexp_replace(F.upper(col(c).cast("string")), "[^A-Z0-9/]", ""))


def case_number_core(c) -> Column:
    """(running number, year, court letters) of a case number."""
    parts = F.filter(F.transform(F.split(col(c), "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.struct(
        F.when(F.size(parts) > 0, F.regexp_extract(F.get(parts, F.lit(0)), r"^(\d*)", 1)).otherwise("").alias("first"),
        F.coalesce(F.get(F.filter(parts, lambda p: p.rlike(r"^\d{4}$")), F.lit(0)), F.lit("")).alias("year"),
        F.when(F.size(parts) > 1, F.regexp_replace(F.upper(F.get(parts, F.size(parts) - 1)), "[^A-Z]", "")).otherwise("").alias("court"),
    )


def level_of_number(c) -> Column:
    """Court level told by the pattern of a case number."""
    n = F.regexp_replace(F.upper(col(c)), " ", "")
    return (
        F.when(n.rlike(r"\d+PK/"), "MA (PK)").when(n.rlike(r"\d+K/"), "MA (Kasasi)").when(n.rlike(r"/PT\.?[A-Z]"), "PT").when(n.rlike(r"/PN\.?[A-Z]"), "PN")
        .when(n.rlike("/PM|DILMIL|/AD/|/AL/|/AU/"), "Pengadilan Militer")
    )


def court_key(c) -> Column:
    """Letters that name the place of a court."""
    # fixed values: prefixes of courts, classes, numbers of military courts
    n = F.trim(F.regexp_replace(F.upper(col(c)), r"\.", " "))
    n = F.regexp_replace(n, r"^(PN|PT|PENGADILAN\s+NEGERI|PENGADILAN\s+TINGGI|DILMIL|PENGADILAN\s+MILITER(\s+TINGGI)?)\b", "")
    n = F.regexp_replace(n, r"\bKELAS\s+[I1]+\s*[AB]?\b", " ")
    n = F.regexp_replace(n, r"\b[IVX]+\s*-?\s*\d+\b", " ")
    return F.regexp_replace(n, "[^A-Z]", "")


def bare(c) -> Column:
    """Letters, numbers and underscores in lower case, nothing between them (marks go, superscripts stay)."""
    return F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}_]+", "")


def strip(c) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def safe_name(c) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"[^\w.-]+", "_"), "^_+|_+$", "")


_LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
#: kerning of some files parts an initial capital: "T erdakwa"
_KERNED = r"\b([TWYPF]) (?=[a-z]{2,})"


def clean_lines(c, drop: list[str] | None = None) -> Column:
    """Lines with spaces and soft hyphens mended and kerned capitals joined; boilerplate lines (default: those of the
    published files) dropped, runs of blank lines folded."""
    boilerplate = "(?i)" + "|".join(f"(?:{p})" for p in (BOILERPLATE if drop is None else drop))
    lines = F.transform(F.split(col(c), _LINE_END), lambda x: F.trim(F.regexp_replace(F.translate(x, "\u00a0\u00ac", " "), r"[ \t]+", " ")))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, _KERNED, "$1"))
    if drop is None or drop:
        lines = F.filter(lines, lambda x: ~x.rlike(boilerplate))
    text = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_text(c) -> Column:
    """A ruling's text without the lines of its files, ended by a line feed."""
    return F.concat(clean_lines(c), F.lit("\n"))


def bullet_lines(c) -> Column:
    """One line per item: a private-use glyph that opens a line becomes "- " unless a lower-case word follows, others go."""
    glyph = "[\ue000-\uf8ff]"
    x = F.regexp_replace(col(c), rf"^\s*{glyph}\s*(?=[^a-z\s])", "- ")
    x = normalise_space(F.regexp_replace(x, "[\u00a0\u00ac\ue000-\uf8ff]", " "))
    return F.regexp_replace(x, _KERNED, "$1")


def head_lines(c, n: int = 40) -> Column:
    return F.array_join(F.slice(F.split(col(c), "\n"), 1, n), "\n")


def redact_names(c) -> Column:
    """Person names after a trigger word become [nama]; a stop word or a place word ends the name."""
    name = r"(?:[A-Z][A-Za-z'.]+)(?:\s+(?:(?:bin|binti|Bin|Binti|BIN|BINTI|Als|als)\.?|(?!Pengadilan|Kabupaten|Kota|Provinsi|Desa|Kecamatan|Jalan|Nomor|Pasal)[A-Z][A-Za-z'.]+)){0,6}"
    return F.regexp_replace(col(c), rf"\b((?i:terdakwa|saksi|terpidana|anak|korban|saudara|sdr\.?))\s+(?!Pengadilan|Pasal|Penuntut|Umum|Tingkat){name}", "$1 [nama]")


# -- numbers -----------------------------------------------------------------------------------


def parse_number(c) -> Column:
    """Indonesian notation: dots for thousands, a comma for decimals; null if it is no number."""
    s = F.regexp_replace(F.trim(col(c)), r"^[.,]+|[.,]+$", "")
    whole, frac = F.regexp_extract(s, r"^(.*),([^,]*)$", 1), F.regexp_extract(s, r"^(.*),([^,]*)$", 2)
    with_comma = F.concat(F.when(F.regexp_replace(whole, r"\.", "") == "", "0").otherwise(F.regexp_replace(whole, r"\.", "")), F.lit("."), frac)
    plain = F.when(s.rlike(r"^\d{1,3}(\.\d{3})+$"), F.regexp_replace(s, r"\.", "")).otherwise(s)
    text = F.when(s.contains(","), with_comma).otherwise(plain)
    return F.when((s != "") & text.rlike(r"^\d*\.?\d+$|^\d+\.$"), text.try_cast("double"))


def general_number(c) -> Column:
    """Like %g: six significant digits without trailing zeros; a tie of the shortest decimal form goes up."""
    x = col(c).cast("double")
    digits = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))).cast("int"))
    fixed = F.format_string("%.6f", F.round(x * F.pow(F.lit(10.0), 5 - digits), 0) / F.pow(F.lit(10.0), 5 - digits))
    trimmed = F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    science = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.format_string("%.5e", x), r"(\.\d*?)0+e", "$1e"), r"\.e", "e"), r"e\+0?(\d)$", "e+0$1")
    return F.when((F.abs(x) >= 1e6) | ((x != 0) & (F.abs(x) < 1e-4)), science).otherwise(trimmed)


def thousands(c) -> Column:
    """Whole number with dots between thousands; '' for null."""
    return F.coalesce(F.translate(F.format_number(col(c), 0), ",", "."), F.lit(""))


def number_set(c) -> Column:
    """Numbers of a ';' list; an empty array for a missing one."""
    parts = F.filter(F.split(F.coalesce(value(c), F.lit("")), ";"), lambda x: F.trim(x) != "")
    return F.array_distinct(F.transform(parts, lambda x: x.try_cast("double")))


# -- dates -------------------------------------------------------------------------------------


def parse_date(c) -> Column:
    """First Indonesian date of a text; null if there is none or the day does not exist."""
    # the text is searched once; its parts are taken from the few characters found
    found = F.transform(F.array(F.regexp_extract(F.coalesce(col(c), F.lit("")), DATE, 0)), _day_of)
    return F.get(found, F.lit(0))


def _day_of(t: Column) -> Column:
    month = literal_map(MONTHS)[F.lower(F.regexp_extract(t, DATE, 2))]
    day = F.concat_ws("-", F.regexp_extract(t, DATE, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, DATE, 1), 2, "0"))
    return F.when(t != "", F.try_to_date(day, "yyyy-MM-dd"))


def format_date(c) -> Column:
    names = F.array(*[F.lit(m) for m in MONTH_NAMES])
    return F.when(col(c).isNotNull(), F.concat_ws(" ", F.dayofmonth(c).cast("string"), F.get(names, F.month(c) - 1), F.year(c).cast("string")))


def years_of(c) -> Column:
    """(from, to) of 'YYYY' or 'YYYY-YYYY'; null for anything else."""
    t = col(c).cast("string")
    lo, hi = F.regexp_extract(t, r"^(\d{4})(?:-(\d{4}))?$", 1), F.regexp_extract(t, r"^(\d{4})(?:-(\d{4}))?$", 2)
    return F.when(lo != "", F.struct(lo.try_cast("int").alias("lo"), F.coalesce(F.nullif(hi, F.lit("")), lo).try_cast("int").alias("hi"), (hi != "").alias("span")))


def record_year(read, deliberated, raw) -> Column:
    return F.coalesce(F.year(parse_date(read)), F.year(parse_date(deliberated)), F.substring(col(raw), 1, 4).try_cast("int"))


def listing_year(c) -> Column:
    """Year at the end of a listing's date; null if there is none."""
    return F.nullif(F.regexp_extract(col(c), r"(\d{4})$", 1), F.lit("")).cast("int")


def redact_addresses(c) -> Column:
    return F.regexp_replace(col(c), "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[surel]")


def in_years(y, lo: int = 2020, hi: int = 2026, unknown: bool = True) -> Column:
    """Year filter; an unknown year passes a filter but is not in range."""
    return F.coalesce(col(y).between(lo, hi), F.lit(unknown))


def page_host(c) -> Column:
    return F.lower(F.regexp_extract(col(c), r"^[A-Za-z]+://([^/?#:]+)", 1))


def document_key(*cols) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *[col(c) for c in cols])), 1, 16)
