"""Queries over texts composed from the given tables by fixed templates; the SQL twins compute what must be found from
the columns, never from the texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.lexicon import PLACES, RECORD
from ..operators import graph, places, quotes, records, rules
from ..sources import listing, readers, udtf
from ..streaming import crawl
from . import catalog, validation_sql
from . import corpora as K
from .catalog import query, t

#: (number, place, province) of the default gazetteer
_NUMBERED = [(i, name, prov) for i, (name, prov) in enumerate((n, p) for p, names in PLACES.items() for n in names)]
_N = len(_NUMBERED)
_VALUES = "(VALUES " + ", ".join(f"({i}, '{n}', '{p}')" for i, n, p in _NUMBERED) + ") AS {0}(i, tempat, provinsi)"


def _place(key):
    """The place of a number, as an expression."""
    return F.element_at(F.array(*[F.lit(n) for _, n, _ in _NUMBERED]), (F.pmod(key, F.lit(_N)) + 1).cast("int"))


def rulings(spark, d):
    """One heading a row of orders, with three courts told apart by the row's numbers, words that only look like
    places, and names with and without spaces, in capitals or not."""
    o = t(spark, d, "orders")
    first, second, home = _place(F.col("o_orderkey")), _place(F.col("o_custkey")), _place(F.col("o_orderkey") + F.col("o_custkey"))
    tight = F.regexp_replace(F.upper(second), " ", "")
    text = F.concat(
        F.lit("PUTUSAN Nomor "), F.col("o_orderkey"), F.lit("/Pid.Sus/2021\nPengadilan Negeri Perpanjangan Oleh Ketua\nPengadilan  Negeri "), F.regexp_replace(first, " ", "\n"),
        F.lit(" Kelas I B; kerugian negara, SIMPATISAN, patih dan simpang empat.\nDikuatkan oleh PT. "), tight, F.lit(", "), F.regexp_replace(F.upper(home), " ", ""), F.lit("2, bertempat di "), home, F.lit("."),
    )
    return o.select("o_orderkey", text.alias("teks"))


@query(f"""WITH g AS (SELECT * FROM {_VALUES.format("v")}), h AS (SELECT o_orderkey, n, s, kind FROM orders, LATERAL (VALUES (0, o_orderkey % {_N}, 'PN'), (1, o_custkey % {_N}, 'PT'), (2, (o_orderkey + o_custkey) % {_N}, NULL)) AS x(n, s, kind))
SELECT o_orderkey, n, upper(replace(tempat, ' ', '')) AS kunci, provinsi, kind AS pengadilan FROM h JOIN g ON s = i""")
def court_mentions(spark, d):
    """Every place named in a text, in order, with its province and the kind of court it stands for."""
    found = places.find_places(rulings(spark, d), "teks", records.gazetteer(spark), "m")
    x = found.select("o_orderkey", F.posexplode("m").alias("n", "m"))
    return x.select("o_orderkey", "n", F.col("m.key").alias("kunci"), F.col("m.provinsi").alias("provinsi"), F.col("m.court").alias("pengadilan"))


@query(f"SELECT o_orderkey, 'PN ' || upper(tempat) AS pengadilan_asal_teks, provinsi FROM orders JOIN {_VALUES.format('v')} ON o_orderkey % {_N} = i")
def origin_courts(spark, d):
    """The first known court of first instance of every text and its province."""
    gaz = records.gazetteer(spark)
    x = places.origin_courts(rulings(spark, d), "teks", gaz)
    return records.with_province(x, "pengadilan_asal_teks", gaz).select("o_orderkey", "pengadilan_asal_teks", "provinsi")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 7 = 6 THEN 'MAHKAMAHAGUNG' ELSE upper(replace(tempat, ' ', '')) END AS kunci, CASE WHEN c_custkey % 7 <> 6 THEN provinsi END AS provinsi
FROM customer JOIN {_VALUES.format("v")} ON c_custkey % {_N} = i""")
def court_provinces(spark, d):
    """Province of a court's name, however the name is written."""
    place = _place(F.col("c_custkey"))
    forms = [F.concat(F.lit("PN "), F.upper(place)), F.concat(F.lit("Pengadilan Negeri "), place), F.concat(F.lit("pengadilan tinggi "), F.lower(place)), F.concat(F.lit("PN. "), place, F.lit(" Kelas I A"))]
    forms += [F.concat(F.lit("DILMIL II 11 "), F.upper(place)), F.concat(F.lit("PT "), F.upper(F.regexp_replace(place, " ", ""))), F.lit("Mahkamah Agung")]
    name = F.element_at(F.array(*forms), (F.col("c_custkey") % 7 + 1).cast("int"))
    x = records.with_province(t(spark, d, "customer").select("c_custkey", name.alias("s")), "s", records.gazetteer(spark))
    return x.select("c_custkey", C.court_key("s").alias("kunci"), "provinsi")


_BARE = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"


@query(f"""SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, {_BARE.format('text')} AS h FROM documents WHERE text IS NOT NULL) d,
(SELECT item_id, {_BARE.format('text')} AS q FROM benchmark WHERE text IS NOT NULL) b WHERE length(q) >= 12 AND contains(h, q)""")
def quotes_in_texts(spark, d):
    """Every document that holds a benchmark item, found by its rarest gram."""
    return quotes.found(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")



@query(f"""WITH b AS (SELECT item_id, {_BARE.format("substr(text, 1, 30)")} AS p, {_BARE.format("substr(text, 61, 40)")} AS q FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, {_BARE.format("text")} AS h FROM documents WHERE text IS NOT NULL),
f AS (SELECT item_id, count(*) AS n, min(doc_id) AS first FROM b, d WHERE greatest(length(p), length(q)) >= 12 AND (length(p) < 12 OR contains(h, p)) AND (length(q) < 12 OR contains(h, q)) GROUP BY item_id)
SELECT benchmark.item_id, coalesce(n, 0) AS n_texts, first AS first_text FROM benchmark LEFT JOIN f ON benchmark.item_id = f.item_id""")
def quote_sources(spark, d):
    """Quotes in two parts, each from another length class, with the number of documents that hold both parts."""
    b = t(spark, d, "benchmark")
    b = b.select("item_id", F.concat_ws(" ... ", F.substring("text", 1, 30), F.substring("text", 61, 40)).alias("q"))
    return quotes.sources(b, t(spark, d, "documents"), "item_id", "q", "doc_id", "text").select("item_id", "n_texts", "first_text")


@query("SELECT (2019 + page_id % 5)::INT AS tahun, (page_id // 5 + 1)::INT AS halaman, md5(html) AS sidik, length(html) AS panjang FROM pages")
def listing_scan(spark, d):
    """All pages, packed as the listings of five years into a shared store and read again by the data source."""
    at = "https://putusan3.mahkamahagung.go.id/direktori/index/kategori/minyak.html"
    store = f"{graph.shared_folder(spark)}/gavelworks-listing/{uuid.uuid4().hex}"
    p = t(spark, d, "pages").select((F.col("page_id") % 5 + 2019).cast("int").alias("tahun"), (F.floor(F.col("page_id") / 5) + 1).cast("int").alias("halaman"), F.col("url").alias("alamat"), "html", F.lit(0.0).alias("diambil"))
    listing.pack(p, store, at).agg(F.sum("n")).first()
    graph.forget(spark, store)
    return listing.read(spark, store, at).select("tahun", "halaman", F.md5("html").alias("sidik"), F.length("html").cast("long").alias("panjang"))


@query(r"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '[?#].*$|/$|/[?#].*$', '') AS id FROM pages),
l AS (SELECT DISTINCT regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1) || regexp_replace(h, '/$', '') AS id FROM pages, LATERAL (SELECT unnest(regexp_extract_all(html, '<a\s[^>]*href="(/[^"#?]*)', 1)) AS h) WHERE h <> '/')
SELECT id, 'dibaca' AS status FROM p UNION ALL SELECT id, 'antre' FROM l WHERE id NOT IN (SELECT id FROM p)""")
def crawl_frontier(spark, d):
    """The crawl state of all pages: a stream is run, stopped, and run again to its end."""
    at = f"{graph.shared_folder(spark)}/gavelworks-crawl/{uuid.uuid4().hex}"
    graph.forget(spark, at)
    schema = t(spark, d, "pages").schema
    s = spark.readStream.schema(schema).parquet(f"{d}/page[s].parquet")  # a pattern, as a single file is no folder
    p = s.select(crawl.page_id("url").alias("id"), crawl.linked_ids(F.col("url"), F.col("html")).alias("links"), F.lit(False).alias("expires"), F.lit(None).cast("timestamp").alias("at"))
    for _ in range(2):
        crawl.run(p, f"{at}/log", f"{at}/state")
    return crawl.status(spark, f"{at}/log").select("id", "status")


# -- pages -------------------------------------------------------------------------------------


def ruling_pages(spark, d):
    """A ruling page for every row of orders, with a related ruling and sometimes a PDF.

    The few columns are dealt over all cores before pages are written from them: a table of some megabytes is one task or
    two, and pages are dear to read."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").repartition(4 * spark.sparkContext.defaultParallelism)
    cell = lambda label, value: [F.lit(f"<tr><td>{label}</td><td>: "), value, F.lit("</td></tr>")]
    key = F.col("o_orderkey").cast("string")
    html = F.concat(
        F.lit("<html><body><table>"), *cell("Nomor", F.concat(key, F.lit("/Pid.Sus/2021/PN&nbsp;Mdn"))), *cell("Tahun", F.year("o_orderdate").cast("string")), *cell("Nomor", F.lit("lain")),
        *cell("Amar", F.concat(F.lit("<b>"), F.col("o_orderstatus"), F.lit("</b> &amp; <i>lain</i>"))), F.lit("</table>"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("<a href='/x/pdf/1.pdf'>PDF</a>")).otherwise(""),
        F.lit("<div><h4>Putusan Terkait</h4><ul><li>Banding <a href='/direktori/putusan/c"), F.col("o_custkey"), F.lit(".html'>"), F.col("o_orderpriority"), F.lit("</a></li></ul></div></body></html>"),
    )
    return o.select("o_orderkey", F.concat(F.lit("https://putusan3.mahkamahagung.go.id/direktori/putusan/o"), key, F.lit(".html")).alias("url"), html.alias("html"))


@query("""SELECT o_orderkey, 'o' || o_orderkey AS id, o_orderkey || '/Pid.Sus/2021/PN Mdn' AS nomor, year(o_orderdate)::VARCHAR AS tahun, o_orderstatus || ' & lain' AS amar,
CASE WHEN o_orderkey % 3 = 0 THEN 'Ada' ELSE 'Tidak ada' END AS lampiran FROM orders""")
def ruling_rows(spark, d):
    """Fields of ruling pages by a table function in SQL."""
    udtf.register(spark)
    ruling_pages(spark, d).createOrReplaceTempView("gavelworks_rulings")
    return spark.sql("SELECT o_orderkey, r.* FROM gavelworks_rulings, LATERAL ruling_fields(html, url, 'id,nomor,tahun,amar,lampiran') r")


@query("SELECT o_orderkey, 'c' || o_custkey AS id, o_orderpriority AS label FROM orders")
def related_rulings(spark, d):
    udtf.register(spark)
    ruling_pages(spark, d).createOrReplaceTempView("gavelworks_rulings")
    return spark.sql("SELECT o_orderkey, r.id, r.label FROM gavelworks_rulings, LATERAL related_rows(html, url) r")


@query("""SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS urutan, 'o' || o_orderkey AS id, 'Putusan Nomor ' || o_orderkey AS judul,
strftime(o_orderdate, '%d-%m-%Y') AS tanggal_putus FROM orders""")
def listing_entries_of_orders(spark, d):
    """Entries of one listing page for every customer."""
    udtf.register(spark)
    entry = F.concat(
        F.lit("<li><a href='/direktori/putusan/o"), F.col("o_orderkey"), F.lit(".html'>Putusan</a><a href='/direktori/putusan/o"), F.col("o_orderkey"), F.lit(".html'>Putusan Nomor "), F.col("o_orderkey"),
        F.lit("</a> Register : 01-01-1990 Putus : "), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit("</li>"),
    )
    p = t(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", entry.alias("e")).alias("s")).groupBy("o_custkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    p.select("o_custkey", F.concat(F.lit("<ul>"), F.array_join(F.transform("s", lambda x: x["e"]), ""), F.lit("</ul>")).alias("html")).createOrReplaceTempView("gavelworks_listings")
    return spark.sql("SELECT o_custkey, r.urutan, r.id, r.judul, r.tanggal_putus FROM gavelworks_listings, LATERAL listing_rows(html) r")


# -- consistency rules -------------------------------------------------------------------------

#: records that break every rule, one set for every eleven orders; numbers, chains, files, addresses, volumes and money
#: come from the order's row
_SET = [r for r in (*catalog.BROKEN, *K.RECORDS) if r[1] != "NA"]
_M = len(_SET)
_SET_CAND = [*catalog.BROKEN_CAND, *catalog.CAND]
_SET_FILES = [*catalog.BROKEN_FILES, *catalog.FILES]
_SET_OUT = [*catalog.BROKEN_OUT, *catalog.EXCLUDED]
_CAND_NAMES = "file_pdf, k_nomor, k_tahun, k_tanggal, k_hasil, k_dasar, k_jenis, k_liter, k_jumlah, k_maks"
_NUMBERED_SET = [(i, *r) for i, r in enumerate(_SET)]
_GROUPS = f"(SELECT DISTINCT o_orderkey // {_M} AS g FROM orders)"
_OWN = {
    "no": "(o_orderkey + 2)::INT",
    "nomor_putusan": "g || '00' || nomor_putusan",
    "rantai_perkara": "rantai_perkara || '-' || g",
    "file_pdf": "replace(file_pdf, 'pdf/', 'pdf/' || g || '-')",
    "url_putusan": "replace(url_putusan, '/putusan/', '/putusan/' || g || 'x')",
    "catatan": "replace(catatan, '77', g || '0077')",
    "nilai_kerugian_volume": "CASE WHEN nilai_kerugian_volume > 0 THEN floor(o_totalprice / 10) ELSE nilai_kerugian_volume END",
    "nilai_kerugian_uang": "CASE WHEN nilai_kerugian_uang > 0 THEN o_totalprice ELSE nilai_kerugian_uang END",
}
SQL_RECORDS = "(SELECT " + ", ".join(f"{_OWN.get(c, c)} AS {c}" for c in RECORD) + f" FROM (SELECT *, o_orderkey // {_M} AS g FROM orders) o JOIN {K.values(_NUMBERED_SET, 'i, ' + K.RECORD_NAMES)} ON o_orderkey % {_M} = i)"
_SQL_TWIN = validation_sql.twin(
    SQL_RECORDS,
    f"(SELECT g || '00' || nomor_putusan AS nomor_putusan FROM {_GROUPS}, {K.values(_SET_OUT, 'nomor_putusan')})",
    f"(SELECT replace(file_pdf, 'pdf/', 'pdf/' || g || '-') AS file_pdf FROM {_GROUPS}, {K.values(_SET_FILES, 'file_pdf')})",
    f"(SELECT * EXCLUDE (g) REPLACE (replace(file_pdf, 'pdf/', 'pdf/' || g || '-') AS file_pdf, g || '00' || k_nomor AS k_nomor) FROM {_GROUPS}, {K.values(_SET_CAND, _CAND_NAMES)})",
)


def broken_records(spark, d):
    """(records, excluded, files, candidates) composed from orders."""
    o = t(spark, d, "orders").withColumn("g", F.floor(F.col("o_orderkey") / _M)).withColumn("i", (F.col("o_orderkey") % _M).cast("int"))
    groups = o.select("g").distinct()
    few = lambda rows, schema: F.broadcast(K.frame(spark, rows, schema))  # noqa: E731  fixed lists of at most eleven rows
    g = F.col("g").cast("string")
    file = F.replace("file_pdf", F.lit("pdf/"), F.concat(F.lit("pdf/"), g, F.lit("-"))).alias("file_pdf")
    own = {
        "no": (F.col("o_orderkey") + 2).cast("int"),
        "nomor_putusan": F.concat(g, F.lit("00"), "nomor_putusan"),
        "rantai_perkara": F.concat("rantai_perkara", F.lit("-"), g),
        "file_pdf": file,
        "url_putusan": F.replace("url_putusan", F.lit("/putusan/"), F.concat(F.lit("/putusan/"), g, F.lit("x"))),
        "catatan": F.replace("catatan", F.lit("77"), F.concat(g, F.lit("0077"))),
        "nilai_kerugian_volume": F.when(F.col("nilai_kerugian_volume") > 0, F.floor(F.col("o_totalprice") / 10).cast("double")).otherwise(F.col("nilai_kerugian_volume")),
        "nilai_kerugian_uang": F.when(F.col("nilai_kerugian_uang") > 0, F.col("o_totalprice")).otherwise(F.col("nilai_kerugian_uang")),
    }
    rows = o.join(few(_NUMBERED_SET, f"i int, {readers.RECORD_SCHEMA}"), "i").select(*[own.get(c, F.col(c)).alias(c) for c in RECORD])
    cand = "file_pdf string, nomor_teks string, tahun_putusan_teks int, tanggal_putusan_teks string, hasil_kandidat string, dasar_hasil_kandidat string, jenis_bbm_disebut string, volume_liter_di_amar string, volume_liter_di_amar_jumlah double, volume_liter_maks_teks double"
    each = lambda rows, schema: groups.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1)))).join(few([(j, *r) for j, r in enumerate(rows)], f"j int, {schema}"), "j").drop("j")
    read = each(_SET_CAND, cand).withColumn("file_pdf", file).withColumn("nomor_teks", F.concat(g, F.lit("00"), "nomor_teks")).drop("g")
    out = each(_SET_OUT, "nomor_putusan string").select(F.concat(g, F.lit("00"), "nomor_putusan").alias("nomor_putusan"))
    return rows, out, each(_SET_FILES, "file_pdf string").select(file), read


@query(_SQL_TWIN)
def validate_orders(spark, d):
    """Every consistency rule over records composed from orders."""
    return rules.validate(*broken_records(spark, d))


@query(f"SELECT tingkat, count(*) AS n FROM ({_SQL_TWIN}) GROUP BY tingkat")
def validation_totals(spark, d):
    """Issues by severity, observed while the issue table is written."""
    to = f"{graph.shared_folder(spark)}/gavelworks-validation/{uuid.uuid4().hex}"
    graph.forget(spark, to)
    counts, _ = readers.write_validation(rules.validate(*broken_records(spark, d)), to)
    return K.frame(spark, list(counts.items()), "tingkat string, n long").where("n > 0")
