"""Candidate fields of a ruling text as Column expressions."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import columns as C
from .columns import col, normalise_space, parse_date, parse_number, squash
from .lexicon import FUELS, GENERIC_FUEL, KEYWORDS, MONEY_KINDS, NOT_CORE, OFFENCES

HEADING = r"^\s*M\s*E\s*N\s*G\s*A\s*D\s*I\s*L\s*I\b(?!\s*S\s*E\s*N\s*D\s*I\s*R\s*I)"
NUMBER = r"(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?)"
VOLUME = rf"{NUMBER}(?:\s*\([^()]{{0,120}}\))?\s*(kilo\s*liter|kiloliter|k\.?l\b|liter|ltr\b|lt\b|l\b|ton\b|m3\b|m³)"
MONEY = r"Rp\.?\s*(\d{1,3}(?:\s?\.\s?\d{3})+(?:,\d{1,2})?|\d+(?:,\d{1,2})?)"


def zipped(text: Column, pattern: str, **groups: int) -> Column:
    """Matches of a pattern as an array of structs with the named groups."""
    arrays = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(n) for n, g in groups.items()]
    return F.arrays_zip(*arrays)


def around(text: Column, flags: str, pattern: str, before: int, after: int, **groups: int) -> Column:
    """Matches of a pattern as an array of structs: up to ``before`` characters before it, the named groups, up to
    ``after`` characters behind it.

    Each match goes on from the end of the last one (``\\G``) and brings what lies between, so the text is read once a
    group; a look behind of that length is tried at each of its lengths, which is quadratic in it."""
    n = re.compile(pattern).groups
    found = zipped(text, rf"(?{flags})\G(.*?)({pattern})(?=(.{{0,{after}}}))", _gap=1, _all=2, after=n + 3, **{k: g + 2 for k, g in groups.items()})
    end = lambda c: F.right(c, F.lit(before))

    def step(acc: Column, m: Column) -> Column:
        past = F.concat(acc["past"], end(m["_gap"]))
        one = F.struct(end(past).alias("before"), *[m[k].alias(k) for k in groups], m["after"].alias("after"))
        return F.struct(end(F.concat(past, m["_all"])).alias("past"), F.concat(acc["out"], F.array(one)).alias("out"))

    none = F.array().cast("array<struct<" + ", ".join(f"{k}: string" for k in ("before", *groups, "after")) + ">>")
    return F.aggregate(found, F.struct(F.lit("").alias("past"), none.alias("out")), step, lambda acc: acc["out"])


def needed(pattern: str) -> list[str]:
    """Words of which a text must hold at least one where the pattern matches: the longest run of plain characters of each
    alternative, outside of groups; none if some alternative has no such run."""
    alts, depth, i = [[""]], 0, 0
    while i < len(pattern):
        c = pattern[i]
        step = 2 if c == "\\" else 1
        if c == "[":
            step = pattern.index("]", i + 2) + 1 - i
        depth += (c == "(") - (c == ")")
        if depth == 0 and c == "|":
            alts.append([""])
        elif c in "?*{" and depth == 0:  # what stands before may be missing
            alts[-1][-1] = alts[-1][-1][:-1]
            alts[-1].append("")
            step = pattern.index("}", i) + 1 - i if c == "{" else 1
        elif depth == 0 and (c.isalnum() or c in " -/"):
            alts[-1][-1] += c
        elif c == "\\" and depth == 0 and not pattern[i + 1].isalnum():
            alts[-1][-1] += pattern[i + 1]
        else:
            alts[-1].append("")
        i += step
    words = [max(runs, key=len) for runs in alts]
    return list(dict.fromkeys(words)) if all(words) else []


def may_match(low: Column, *patterns: str) -> Column:
    """False where none of the patterns can match, told by the words they need; far cheaper than a pattern tried at each
    character.  ``low`` is in lower case, the patterns too."""
    words = [needed(p) for p in patterns]
    if not all(words):
        return F.lit(True)
    return functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in dict.fromkeys(w for ws in words for w in ws)])


def hits(low: Column, pattern: str) -> Column:
    """Number of matches in a text in lower case, null for a null text."""
    return F.when(low.isNull() | may_match(low, pattern), F.regexp_count(low, F.lit(pattern))).otherwise(0)


def matched(low: Column, pattern: str) -> Column:
    """Whether the pattern matches in a text in lower case."""
    return may_match(low, pattern) & low.rlike(pattern)


def case_number(text) -> Column:
    """Number in the first 40 lines."""
    n = F.regexp_extract(C.head_lines(text), r"(?im)^\s*Nomor\s*[.:]?\s*(\d[^\n]{0,60}/[^\n]{2,60})$", 1)
    return F.nullif(F.regexp_replace(normalise_space(n), r"[.;,: ]+$", ""), F.lit(""))


def verdict(text) -> Column:
    """From the last heading of a verdict to the closing sentence; null without a heading."""
    t = col(text)
    has = t.rlike(f"(?m){HEADING}")
    # ``.`` with the flag s, as [\s\S] is some fifteen times as slow in the JVM
    tail = F.regexp_extract(t, rf"(?ms)\A.*({HEADING}.*)\z", 1)
    return F.when(has, C.strip(F.regexp_replace(tail, r"(?ims)^\s*Demikian.*\z", "")))


def before_verdict(text) -> Column:
    t = col(text)
    return F.when(t.rlike(f"(?m){HEADING}"), F.regexp_extract(t, rf"(?ms)\A(.*){HEADING}.*\z", 1)).otherwise(t)


def ruling_date(text) -> Column:
    """Date of the closing paragraph, that of the reading first."""
    end = F.substring(F.regexp_extract(col(text), r"(?is)\A.*(Demikian.*)\z", 1), 1, 2500)

    def day(closing: Column) -> Column:
        own = once(F.regexp_extract(closing, r"(?is)diucapkan(.{0,250})", 1), lambda read: F.when((read != "") & ~F.lower(read).contains("itu juga"), parse_date(read)))
        return F.when(closing != "", F.coalesce(own, parse_date(closing)))

    return once(end, day)


def outcome(verdict_text) -> Column:
    """(hasil, dasar) of a verdict: conviction is looked for before acquittal."""
    own = once(squash(verdict_text), lambda a: F.when(a.contains("mengadilisendiri"), F.element_at(F.split(a, "mengadilisendiri"), -1)).otherwise(a))
    return once(own, lambda a: _outcome(verdict_text, a))


def _outcome(verdict_text, a: Column) -> Column:
    r = lambda h, d: F.struct(F.lit(h).cast("string").alias("hasil"), F.lit(d).alias("dasar"))
    appeal = "menolakpermohonan(kasasi|peninjauankembali)"
    return (
        F.when(F.coalesce(col(verdict_text), F.lit("")) == "", r(None, "amar tidak ditemukan"))
        .when(matched(a, "(?<!tidak)terbukti(secara)?(sah)?(dan)?(meyakinkan|menyakinkan)?bersalah"), r("Bersalah", "amar menyatakan terdakwa terbukti bersalah"))
        .when(matched(a, "membebaskan(para)?terdakwa.{0,150}dakwaan") | a.contains("bebasdarisegaladakwaan"), r("Tidak bersalah", "amar membebaskan terdakwa (vrijspraak)"))
        .when(matched(a, "melepaskan(para)?terdakwa.{0,150}tuntutanhukum"), r("Tidak bersalah", "amar melepaskan terdakwa dari segala tuntutan hukum (onslag)"))
        .when(matched(a, appeal) & a.rlike("pemohon(kasasi|peninjauankembali)[ivx]*/?(terdakwa|terpidana)"), r("Bersalah", "permohonan kasasi/PK terdakwa ditolak (pemidanaan tetap berlaku)"))
        .when(matched(a, appeal), r(None, "permohonan kasasi penuntut umum ditolak: ikut putusan sebelumnya"))
        .when(a.contains("menguatkanputusan"), r(None, "menguatkan putusan sebelumnya: ikut putusan sebelumnya"))
        .when(matched(a, "pidanapenjaraselama|pidanadendasebesar|pidanadendasejumlah|menjatuhkanpidana"), r("Bersalah", "amar menjatuhkan pidana"))
        .otherwise(r(None, "pola amar tidak dikenali"))
    )


def fuel_counts(text) -> Column:
    """array<struct<kind, n>> by descending n, ties in the order of the lexicon."""
    return once(F.lower(col(text)), _fuel_counts)


def _fuel_counts(low: Column) -> Column:
    def counted(t: Column, pats: list[str]) -> Column:
        """Matches of the first pattern, then of the next in what it leaves.  Most are not there at all."""
        p, *rest = pats
        n = F.coalesce(hits(t, p), F.lit(0))
        return once(n, lambda k: k + once(F.when(k > 0, F.regexp_replace(t, p, " ")).otherwise(t), lambda left: counted(left, rest))) if rest else n

    def item(order: int, kind: str):
        return lambda n: F.struct((-n).alias("k"), F.lit(order).alias("o"), F.lit(kind).alias("kind"), n.alias("n"))

    items = [once(counted(low, pats), item(order, kind)) for order, (kind, pats) in enumerate(FUELS.items())]
    seen = F.filter(F.array(*items), lambda x: x["n"] > 0)
    return F.transform(F.array_sort(seen), lambda x: F.struct(x["kind"].alias("kind"), x["n"].alias("n")))


def relevance(counts: Column, text) -> Column:
    kinds = F.transform(counts, lambda x: x["kind"])
    core = F.exists(kinds, lambda k: ~k.isin(*NOT_CORE))
    generic = once(F.lower(F.coalesce(col(text), F.lit(""))), lambda low: may_match(low, *GENERIC_FUEL) & functools.reduce(lambda a, b: a | b, [F.coalesce(col(text), F.lit("")).rlike(f"(?i){p}") for p in GENERIC_FUEL]))
    gas = F.array_contains(kinds, "LPG/Gas")
    return F.when(core | (generic & ~gas), "Ya").when(F.array_contains(kinds, "Minyak mentah"), "Sebagian").when(gas, "Tidak").otherwise("NA")


def listed(counts: Column, with_n: bool = True) -> Column:
    """'kind (n); kind (n)'; null if there is none."""
    one = (lambda x: F.concat(x["kind"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))) if with_n else (lambda x: x["kind"])
    return F.nullif(F.array_join(F.transform(counts, one), "; "), F.lit(""))


def keyword_hits(text) -> Column:
    """array<struct<kind, n>> of evidence keywords, null for a null text."""
    items = [F.struct(F.lit(k).alias("kind"), F.regexp_count(col(text), F.lit(f"(?i){p}")).alias("n")) for k, p in KEYWORDS.items()]
    return F.when(col(text).isNotNull(), F.filter(F.array(*items), lambda x: x["n"] > 0))


def volume_mentions(text) -> Column:
    """array<struct<value, unit, kind, context>>: litres (kilolitres and cubic metres converted) and tonnes;
    kind kapasitas if the same clause before says so, else jumlah."""

    def one(m):
        unit = F.regexp_replace(F.lower(m["unit"]), " ", "")
        v = parse_number(m["num"])
        big = unit.startswith("k") | unit.isin("m3", "m³")
        clause = F.element_at(F.split(F.lower(F.right(m["before"], F.lit(40))), r"[;,\n]|\bdan\b"), -1)
        return F.struct(
            F.when(big, v * 1000).otherwise(v).alias("value"),
            F.when(unit == "ton", "ton").otherwise("liter").alias("unit"),
            F.when(clause.rlike(r"kapasitas|@|isi\s*$|ukuran|volume\s*$"), "kapasitas").otherwise("jumlah").alias("kind"),
            normalise_space(F.concat(m["before"], m["num"], F.lit(" "), m["unit"], m["after"])).alias("context"),
        )

    found = F.transform(around(col(text), "is", VOLUME, 80, 40, num=1, unit=2), one)
    return F.filter(found, lambda x: x["value"].isNotNull())


def money_mentions(text) -> Column:
    """array<struct<value, kind>> of rupiah amounts: a price per litre if the text goes on so, else the keyword nearest before."""

    def one(m):
        after = F.regexp_replace(F.lower(m["after"]), r"^[\s,.\-]*(?:\([^()]{0,60}\))?", "")
        clause = F.element_at(F.split(F.lower(F.right(m["before"], F.lit(90))), r"[;\n]"), -1)
        spots = [F.struct(F.length(F.regexp_extract(clause, rf"(?s)\A(.*)(?:{p})", 1)).alias("at"), F.lit(-i).alias("o"), F.lit(k).alias("kind"), clause.rlike(p).alias("hit")) for i, (k, p) in enumerate(MONEY_KINDS)]
        near = F.array_max(F.filter(F.array(*spots), lambda s: s["hit"]))
        kind = F.when(after.rlike(r"^\s*(?:,-|,00)?\s*(?:/\s*(?:liter|ltr|l\b)|per\s*liter|perliter|setiap\s*liter|tiap\s*liter)"), "harga_per_liter").otherwise(F.coalesce(near["kind"], F.lit("lain")))
        return F.struct(parse_number(F.regexp_replace(m["num"], r"\s", "")).alias("value"), kind.alias("kind"))

    return F.filter(F.transform(around(col(text), "is", MONEY, 120, 60, num=1), one), lambda x: x["value"].isNotNull())


def values(mentions: Column, kind: str, unit: str | None = None) -> Column:
    keep = (lambda x: (x["kind"] == kind) & (x["unit"] == unit)) if unit else (lambda x: x["kind"] == kind)
    return F.array_sort(F.array_distinct(F.transform(F.filter(mentions, keep), lambda x: x["value"])))


ARTICLE = r"(?i)Pasal\s+(5[3-5])\s*(?:huruf\s*[\"“”'‘’]?\s*([a-d])\b)?"


def article_codes(region: Column) -> Column:
    """Codes in order of appearance: 53 with its letter, 54, 55."""
    return F.array_distinct(F.transform(zipped(region, ARTICLE, n=1, letter=2), lambda m: F.concat(m["n"], F.when(m["n"] == "53", F.lower(m["letter"])).otherwise(""))))


def articles(text) -> Column:
    """From the last legal basis before the verdict, else from the whole text."""
    basis = F.substring(F.regexp_extract(before_verdict(text), r"(?s)\A.*(Mengingat.*)\z", 1), 1, 1500)
    return once(F.coalesce(F.nullif(basis, F.lit("")), col(text)), article_codes)


def offences(verdict_text) -> Column:
    own = F.get(F.split(normalise_space(F.lower(col(verdict_text))), "menjatuhkan pidana|menghukum terdakwa|barang bukti"), F.lit(0))
    hits = once(own, lambda a: F.array(*[F.when(matched(a, p), F.lit(code)) for p, code in OFFENCES]))
    return F.coalesce(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())), F.array().cast("array<string>"))


def merge_articles(codes: Column) -> Column:
    """Sorted distinct codes; a bare 53 goes if one with a letter is there; null if none."""
    d = F.array_distinct(codes)
    specific = F.exists(d, lambda c: c.rlike("^53[a-d]$"))
    return F.nullif(F.array_join(F.array_sort(F.filter(d, lambda c: ~(specific & (c == "53")))), ";"), F.lit(""))


def record_articles(details, note) -> Column:
    text = F.concat_ws(" ", F.coalesce(col(details), F.lit("")), F.coalesce(col(note), F.lit("")))
    more = F.regexp_extract_all(text, F.lit(r"(?i)Pasal\s+53\s+huruf\s+[a-d]((?:\s*(?:,|dan|&)\s*[a-d]\b)+)"), F.lit(1))
    letters = F.flatten(F.transform(more, lambda m: F.regexp_extract_all(m, F.lit(r"\b([a-d])\b"), F.lit(1))))
    return merge_articles(F.concat(article_codes(text), F.transform(letters, lambda x: F.concat(F.lit("53"), x)), offences(F.coalesce(col(details), F.lit("")))))


def event_years(text, ruling_year) -> Column:
    """(label, years) of the deed told before the verdict: years said at least max(2, a third of the most) times."""
    body = before_verdict(text)
    pats = [
        rf"(?i)pada\s+hari\s+\w+,?\s+tanggal\s+\d{{1,2}}\s+(?:{C.MONTH_ALT})\.?\s+(\d{{4}})",
        rf"(?i)(?:dalam|pada|sekitar)\s+bulan\s+(?:{C.MONTH_ALT})\s+(?:tahun\s+)?(\d{{4}})",
        r"(?i)setidak-tidaknya\s+(?:pada\s+)?(?:suatu\s+)?(?:waktu\s+)?(?:dalam\s+)?tahun\s+(\d{4})",
    ]
    words = ["hari", "bulan", "setidak-tidaknya"]
    none = F.array().cast("array<string>")
    read = lambda b, low: F.concat(*[F.when(b.isNull() | F.contains(low, F.lit(w)), F.regexp_extract_all(b, F.lit(p), F.lit(1))).otherwise(none) for p, w in zip(pats, words)])
    said = once(body, lambda b: once(F.lower(b), lambda low: read(b, low)))
    all_ = F.transform(said, lambda y: y.cast("int"))
    found = F.filter(all_, lambda y: y.between(1990, F.coalesce(col(ruling_year), F.lit(2100))))
    return once(found, lambda ys: once(_year_counts(ys), _year_label))


def once(x: Column, fn) -> Column:
    """fn(x) with x computed once, however often fn uses it."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def _year_counts(ys: Column) -> Column:
    return F.transform(F.array_sort(F.array_distinct(ys)), lambda y: F.struct(F.size(F.filter(ys, lambda z: z == y)).alias("n"), (-y).alias("k"), y.alias("y")))


def _year_label(freq: Column) -> Column:
    def labelled(top: Column) -> Column:
        main = F.transform(F.filter(freq, lambda f: f["n"] >= F.greatest(F.lit(2), F.floor(top["n"] / 3).cast("int"))), lambda f: f["y"])
        return once(F.when(F.size(main) > 0, main).otherwise(F.array(top["y"])), named)

    def named(main: Column) -> Column:
        lo, hi = F.array_min(main).cast("string"), F.array_max(main).cast("string")
        return F.when(F.size(freq) > 0, F.when(lo == hi, lo).otherwise(F.concat_ws("-", lo, hi)))

    return F.struct(once(F.array_max(freq), labelled).alias("label"), F.transform(freq, lambda f: f["y"]).alias("years"))


# fixed values: words that end the name of a court
STOP_WORDS = [
    "NOMOR", "NO", "TANGGAL", "REGISTER", "KELAS", "YANG", "KARENA", "DALAM", "PADA", "SEJAK", "DI", "DIBAWAH", "TERSEBUT", "DENGAN", "UNTUK", "ATAS", "TELAH",
]


def origin_court(text) -> Column:
    """First court of first instance named in an appeal ruling: up to five capitalised words before a stop word."""
    hits = F.regexp_extract_all(normalise_space(text), F.lit(r"Pengadilan Negeri\s+((?:[A-Z][A-Za-z.\-]*\s?){1,5})"), F.lit(1))

    def name(hit):
        words = F.transform(F.split(F.trim(hit), r"\s+"), lambda w: F.upper(F.regexp_replace(w, "^[.,]+|[.,]+$", "")))
        stop = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(w.isin(*STOP_WORDS), i)), lambda i: i.isNotNull()))
        return F.array_join(F.filter(words, lambda w, i: (w != "") & (i < F.coalesce(stop, F.lit(99)))), " ")

    first = F.get(F.filter(F.transform(hits, name), lambda n: n != ""), F.lit(0))
    return F.when(first.isNotNull(), F.concat(F.lit("PN "), first))


# fixed values: patterns of ships and companies
SHIP = r"\b(?:KM|KMP|KLM|MT|TB|LCT)\.?\s+([A-Z][A-Za-z0-9]*(?:\s+[A-Z0-9][A-Za-z0-9]*){0,3})"
COMPANY = r"\b(?:PT|CV)\.?\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3})"


def entities(text: Column, places: Column) -> Column:
    """Ships and companies of a text; company names that are court places or the state company are left out."""
    t = F.regexp_replace(text, r"/\s*P[TN]\.?\s*[A-Za-z.]+", "/")
    ships = F.transform(F.regexp_extract_all(t, F.lit(SHIP), F.lit(1)), lambda x: F.concat(F.lit("KAPAL "), F.upper(x)))
    firms = F.transform(F.regexp_extract_all(t, F.lit(COMPANY), F.lit(1)), lambda x: F.upper(x))
    firms = F.filter(firms, lambda x: ~x.contains("PERTAMINA") & ~F.array_contains(places, C.court_key(F.get(F.split(x, " "), F.lit(0)))) & ~F.array_contains(places, C.court_key(x)))
    return F.array_sort(F.array_distinct(F.concat(ships, F.transform(firms, lambda x: F.concat(F.lit("PERUSAHAAN "), x)))))


def subsidy(c) -> Column:
    b = F.lower(col(c))
    non = b.rlike("non-subsidi|non subsidi|industri")
    sub = b.rlike(r"(?<!non-)(?<!non )subsidi(?!\s+tidak)") & ~b.contains("status subsidi tidak disebut")
    assigned = b.rlike("pertalite|premium")
    return (
        F.when(C.is_na(c), "tidak disebut").when((sub | assigned) & non, "campuran").when(sub, "subsidi").when(assigned, "penugasan (JBKP)")
        .when(non, "non-subsidi").otherwise("tidak disebut")
    )


def candidates(docs, text: str = "text", carry: tuple = ("file_pdf",)):
    """All candidate fields of ruling texts, one row per input row."""
    from ..operators.mentions import with_mentions

    join = lambda a: F.nullif(F.array_join(F.transform(a, lambda v: C.general_number(v)), ";"), F.lit(""))
    whole = lambda a: F.nullif(F.array_join(F.transform(a, lambda v: v.cast("decimal(20,0)").cast("string")), ";"), F.lit(""))
    d = docs.select(*carry, F.col(text).alias("_t")).withColumn("_v", verdict("_t")).withColumn("_d", ruling_date("_t")).withColumn("_o", outcome("_v"))
    d = with_mentions(d, {"_m": ("size", "_t"), "_mv": ("size", "_v"), "_r": ("money", "_t"), "_rv": ("money", "_v")})
    d = d.withColumn("_f", fuel_counts("_t")).withColumn("_fv", fuel_counts("_v")).withColumn("_e", event_years("_t", F.year("_d"))).withColumn("nomor_teks", case_number("_t"))
    lit_v = F.coalesce(values(F.col("_mv"), "jumlah", "liter"), F.array().cast("array<double>"))
    return d.select(
        *carry, "nomor_teks",
        C.level_of_number("nomor_teks").alias("tingkat_teks"),
        C.format_date("_d").alias("tanggal_putusan_teks"),
        F.year("_d").alias("tahun_putusan_teks"),
        F.col("_e.label").alias("tahun_kejadian_kandidat"),
        F.nullif(F.array_join(F.col("_e.years").cast("array<string>"), ";"), F.lit("")).alias("tahun_disebut_dakwaan"),
        F.col("_o.hasil").alias("hasil_kandidat"), F.col("_o.dasar").alias("dasar_hasil_kandidat"),
        listed(F.col("_f")).alias("jenis_bbm_disebut"), listed(F.col("_fv"), False).alias("jenis_bbm_di_amar"),
        relevance(F.col("_f"), "_t").alias("relevan_bbm_kandidat"),
        join(lit_v).alias("volume_liter_di_amar"),
        F.when(F.size(lit_v) > 0, F.aggregate(lit_v, F.lit(0.0), lambda a, x: a + x)).alias("volume_liter_di_amar_jumlah"),
        F.array_max(values(F.col("_m"), "jumlah", "liter")).alias("volume_liter_maks_teks"),
        join(values(F.col("_m"), "jumlah", "ton")).alias("volume_ton_di_teks"),
        F.array_max(values(F.col("_r"), "kerugian_negara")).alias("rp_kerugian_negara"),
        whole(values(F.col("_r"), "hasil_lelang")).alias("rp_hasil_lelang"),
        whole(values(F.col("_r"), "harga_per_liter")).alias("rp_harga_per_liter"),
        whole(values(F.col("_rv"), "denda")).alias("rp_denda_di_amar"),
        F.nullif(F.array_join(articles("_t"), ";"), F.lit("")).alias("pasal_uu_migas"),
        F.nullif(F.array_join(offences("_v"), ";"), F.lit("")).alias("modus_dari_amar"),
        origin_court("_t").alias("pengadilan_asal_teks"),
        F.length("_t").alias("panjang_teks"),
    )
