"""Further queries of the catalogue: records, crawl and curation operators over whole tables, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import extended as X
from ..functions import web as W
from ..functions.lexicon import FINAL_RELEVANCE, RECORD
from ..operators import graph, records
from ..sources import pages as P
from ..sources import readers
from . import coder
from . import corpora as K
from .catalog import query, t


def _folder(spark: SparkSession, name: str) -> str:
    return f"{graph.shared_folder(spark)}/gavelworks-{name}/{uuid.uuid4().hex}"


_DROP = ["^Released under", "^Licensed under"]


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'),
lambda x: regexp_replace(trim(regexp_replace(replace(replace(x, chr(160), ' '), chr(172), ''), '[ \t]+', ' ', 'g')), '\b([TWYPF]) ([a-z]{2,})', '\1\2', 'g')),
lambda x: NOT regexp_matches(x, '(?i)^Released under|^Licensed under')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS rapi FROM documents""")
def clean_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", C.clean_lines("text", _DROP).alias("rapi"))


@query("""SELECT o_orderkey, printf('%g', sqrt(o_totalprice)) AS umum, replace(format('{:,}', floor(o_totalprice)::BIGINT), ',', '.') AS ribuan, year(o_orderdate) AS tahun FROM orders""")
def number_and_date_formats(spark, d):
    """Amounts as text, and the year read back from a written date by the first of three sources that tells one."""
    o = t(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    said = C.format_date("day")
    year = C.record_year(F.when(F.col("o_orderstatus") == "F", said), F.when(F.col("o_orderstatus") == "O", said), F.date_format("day", "yyyy"))
    return o.select("o_orderkey", C.general_number(F.sqrt("o_totalprice")).alias("umum"), C.thousands(F.floor("o_totalprice")).alias("ribuan"), year.cast("long").alias("tahun"))


_KEYS = [(i, *x) for i, x in enumerate([("Putusan No. 12/Pid.Sus/2020.pdf", "m", '12-05-2021', 'attachment; filename="a b.pdf"'), ("__a  b__", None, "2021-05", "inline"), ("é/x", "", None, None), ("", "n", "x2020", "attachment; filename*=UTF-8''c.pdf"), ("a.b-c_d", "n", "", "filename=x.zip; y")])]


@query(rf"""SELECT i, regexp_replace(regexp_replace(a, '[^\w.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS nama, substr(sha1(concat_ws('|', a, b)), 1, 16) AS kunci, nullif(regexp_extract(c, '(\d{{4}})$', 1), '')::INT AS tahun,
nullif(regexp_extract(coalesce(e, ''), 'filename\*?=(?:UTF-8'''')?"?([^";]+)', 1), '') AS lampiran FROM {K.values(_KEYS, 'i, a, b, c, e')}""")
def keys_and_names(spark, d):
    x = K.frame(spark, _KEYS, "i int, a string, b string, c string, e string")
    return x.select("i", C.safe_name("a").alias("nama"), C.document_key("a", "b").alias("kunci"), C.listing_year("c").alias("tahun"), W.attachment_name("e").alias("lampiran"))


@query(r"""SELECT page_id, NOT regexp_matches(html, '(?i)Database Error|A PHP Error|Fatal error|Uncaught Exception|Service Unavailable|Error Occurred') AND regexp_matches(html, '(?i)/direktori/putusan/[0-9a-z]+\.html|Direktori Putusan|putusan3\.mahkamahagung') AS daftar,
nullif(lower(regexp_extract(url, '(?i)/putusan/([0-9a-z]+)\.html', 1)), '') AS id FROM pages""")
def page_checks(spark, d):
    return t(spark, d, "pages").select("page_id", W.recognisable("html", "daftar").alias("daftar"), W.ruling_id("url").alias("id"))


_AMAR = [(i, s) for i, s in enumerate(["PIDANA PENJARA WAKTU TERTENTU", "bebas", "Lepas dari segala tuntutan", "denda", "Tolak", "", None, "Lain-lain: bersyarat"])]


_AMAR_SQL = " ".join(f"WHEN contains(upper(coalesce(s, '')), '{k}') THEN '{v}'" for k, v in X.OVERVIEW.items())


@query(f"SELECT i, CASE {_AMAR_SQL} END AS hasil FROM {K.values(_AMAR, 'i, s')}")
def overview_outcome(spark, d):
    return K.frame(spark, _AMAR, "i int, s string").select("i", X.outcome_of_overview("s").alias("hasil"))


_SPELLED = [(i, s) for i, s in enumerate(["tahun 2000 dua puluh empat", "2000 Dua  Puluh Satu dan 2000 dua puluh", "2000 dua puluhan", "dua ribu", "", None])]
_spelled_sql = "s"
for _i, _w in enumerate(X.DIGITS, 1):
    _spelled_sql = rf"regexp_replace({_spelled_sql}, '(?i)\b2000\s+dua\s+puluh\s+{_w}\b', '{2020 + _i}', 'g')"


@query(rf"SELECT i, regexp_replace({_spelled_sql}, '(?i)\b2000\s+dua\s+puluh\b', '2020', 'g') AS teks FROM {K.values(_SPELLED, 'i, s')}")
def spelled_years(spark, d):
    return K.frame(spark, _SPELLED, "i int, s string").select("i", X.spelled_year("s").alias("teks"))


_QUOTES = [(0, "membawa solar seribu liter|tidak ada di sana sama sekali|pendek", "Terdakwa membawa SOLAR, seribu liter."), (1, "bagian pertama teks ... yang hilang sekali", "bagian pertama teks"), (2, "", "x"), (3, "solar seribu liter", "")]
_BARE = r"regexp_replace(lower({}), '\W+', '', 'g')"


@query(rf"""SELECT i, array_to_string(list_filter(CASE WHEN q = '' THEN []::VARCHAR[] ELSE string_split(q, '|') END, lambda z: len(list_filter(list_transform(string_split_regex(z, '\.{{3}}|…|\|'), lambda p: {_BARE.format('p')}),
lambda p: length(p) >= 12 AND NOT contains({_BARE.format('s')}, p))) > 0), '|') AS hilang FROM {K.values(_QUOTES, 'i, q, s')}""")
def quotes_not_found(spark, d):
    x = K.frame(spark, _QUOTES, "i int, q string, s string").withColumn("q", F.filter(F.split("q", r"\|"), lambda z: z != ""))
    return x.select("i", F.array_join(coder.quotes_missing("q", "s"), "|").alias("hilang"))


_LINKS = "l AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ke FROM orders), e AS (SELECT id, ke AS src FROM l WHERE ke IS NOT NULL UNION SELECT ke, id FROM l WHERE ke IS NOT NULL)"


def _links(o):
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("dari_id"), nxt.alias("ke_id")).where("ke_id is not null")


@query(f"""WITH o AS (SELECT o_orderkey AS id, 'N' || o_orderkey AS nomor, left(o_orderpriority, 1)::INT AS p, o_orderstatus <> 'O' AS teks, CASE o_orderstatus WHEN 'F' THEN 'Bersalah' WHEN 'P' THEN 'Tidak bersalah' END AS hasil,
CASE WHEN o_orderstatus = 'O' THEN 'ikut putusan sebelumnya' ELSE 'amar' END AS dasar FROM orders), {_LINKS},
g AS (SELECT e.id, arg_min({{'h': s.hasil, 'n': s.nomor}}, {{'p': -s.p, 'i': s.id}}) AS v FROM e JOIN o x ON x.id = e.id JOIN o s ON s.id = e.src AND s.teks AND s.hasil IS NOT NULL AND s.p < x.p GROUP BY 1)
SELECT o.id, CASE WHEN hasil IS NULL AND v IS NOT NULL THEN v.h ELSE hasil END AS hasil_putusan, CASE WHEN hasil IS NULL AND v IS NOT NULL THEN dasar || '; hasil putusan sebelumnya (dari putusan terkait ' || v.n || ')' ELSE dasar END AS dasar_hasil FROM o LEFT JOIN g USING (id)""")
def chain_outcome(spark, d):
    """Orders as rulings, linked with the customer's next order; those of status O follow a lower court's outcome."""
    o = t(spark, d, "orders")
    status = F.col("o_orderstatus")
    rows = o.select(F.col("o_orderkey").alias("id"), F.expr("concat('N', o_orderkey)").alias("nomor_putusan"), F.expr("cast(left(o_orderpriority, 1) as int)").alias("prioritas"), (status != "O").alias("has_text"), F.when(status == "F", "Bersalah").when(status == "P", "Tidak bersalah").alias("hasil_putusan"), F.when(status == "O", "ikut putusan sebelumnya").otherwise("amar").alias("dasar_hasil"))
    return records.outcome_from_below(rows, _links(o)).select("id", "hasil_putusan", "dasar_hasil")


@query(f"""SELECT row_number() OVER (ORDER BY tahun, o_orderstatus, nomor)::INT AS no, nomor AS nomor_putusan, tahun AS tahun_putusan, nilai AS nilai_kerugian_uang FROM (
SELECT 'N' || lpad(o_orderkey::VARCHAR, 12, '0') AS nomor, year(o_orderdate)::INT AS tahun, o_orderstatus, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS nilai,
CASE o_orderpriority WHEN '1-URGENT' THEN '{FINAL_RELEVANCE[0]}' WHEN '2-HIGH' THEN '{FINAL_RELEVANCE[1]}' ELSE 'Tidak' END AS r FROM orders) WHERE r <> 'Tidak' AND tahun BETWEEN 1993 AND 1996""")
def final_record(spark, d):
    o = t(spark, d, "orders")
    rel = F.when(F.col("o_orderpriority") == "1-URGENT", FINAL_RELEVANCE[0]).when(F.col("o_orderpriority") == "2-HIGH", FINAL_RELEVANCE[1]).otherwise("Tidak")
    x = o.select(F.concat(F.lit("N"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("nomor_putusan"), F.year("o_orderdate").cast("string").alias("tahun_putusan"), F.col("o_orderstatus").alias("tingkat_persidangan"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("string")).otherwise("NA").alias("nilai_kerugian_uang"), rel.alias("relevan_bbm"))
    return records.final_record(x, [1993, 1994, 1995, 1996]).select("no", "nomor_putusan", "tahun_putusan", "nilai_kerugian_uang")


@query("""SELECT u AS url, y::INT AS tahun, h::INT AS halaman, regexp_replace(u, '\\.html$', '') || '/tahunjenis/putus/tahun/' || y || CASE WHEN h > 1 THEN '/page/' || h ELSE '' END || '.html' AS alamat
FROM (SELECT 'https://x/kategori/' || lower(replace(n_name, ' ', '-')) || '.html' AS u FROM nation), (SELECT unnest([2020, 2021]) AS y), (SELECT unnest([1, 2, 3]) AS h)""")
def category_pages(spark, d):
    n = t(spark, d, "nation").select(F.concat(F.lit("https://x/kategori/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".html")).alias("url"))
    return readers.category_pages(n, [2020, 2021], 3)


@query("SELECT c_name AS id, c_nationkey AS n, NULL::DOUBLE AS saldo FROM customer UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def all_listings(spark, d):
    a = t(spark, d, "customer").select(F.col("c_name").alias("id"), F.col("c_nationkey").alias("n"))
    return P.all_listings(a, t(spark, d, "supplier").select(F.col("s_acctbal").alias("saldo"), F.col("s_name").alias("id")))


@query("""SELECT o_orderkey AS no, o_orderpriority AS nomor_putusan, o_orderstatus AS dasar, n AS temuan FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN max(l_quantity) > 25 THEN '1-URGENT' ELSE '5-LOW' END AS p, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey AND o_orderpriority = p""")
def evidence_with_online(spark, d):
    ev = t(spark, d, "orders").select(F.col("o_orderkey").alias("no"), F.col("o_orderpriority").alias("nomor_putusan"), F.col("o_orderstatus").alias("dasar"))
    on = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("no")).agg(F.when(F.max("l_quantity") > 25, "1-URGENT").otherwise("5-LOW").alias("nomor_putusan"), F.count("*").alias("temuan"))
    return records.with_online(ev, on)


_HAVE = {"no": "o_orderkey", "nomor_putusan": "o_orderpriority", "hasil_putusan": "o_orderstatus"}


@query("SELECT " + ", ".join(f"{_HAVE[c]} AS {c}" if c in _HAVE else f"NULL::VARCHAR AS {c}" for c in RECORD) + " FROM orders")
def draft_record(spark, d):
    return records.draft(t(spark, d, "orders").select(*[F.col(v).alias(k) for k, v in _HAVE.items()], "o_custkey"))


@query("SELECT c_custkey AS _key, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS v, CASE WHEN c_mktsegment = 'BUILDING' THEN 'baru' ELSE c_name END AS nama FROM customer")
def jsonl_latest(spark, d):
    """Two appends to a file of JSON lines: the later record of a key counts."""
    path = _folder(spark, "jsonl")
    c = t(spark, d, "customer")
    readers.append_jsonl(c.select(F.col("c_custkey").alias("_key"), F.lit(1).alias("v"), F.col("c_name").alias("nama")), path)
    readers.append_jsonl(c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("_key"), F.lit(2).alias("v"), F.lit("baru").alias("nama")), path)
    return readers.read_jsonl_latest(spark, path, "_key long, v int, nama string")


@query("SELECT c_custkey::VARCHAR AS kunci, CASE WHEN c_mktsegment = 'BUILDING' THEN 'NA' ELSE c_name END AS nama, CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END || '!' AS bagian FROM customer")
def raw_rewrite(spark, d):
    """A raw CSV is read cell by cell, changed and put back in its place."""
    path = _folder(spark, "raw")
    c = t(spark, d, "customer")
    seg = F.col("c_mktsegment")
    x = c.select(F.col("c_custkey").cast("string").alias("kunci"), F.when(seg == "BUILDING", "NA").otherwise(F.col("c_name")).alias("nama"), F.when(seg == "MACHINERY", "").otherwise(seg).alias("bagian"))
    readers.write_raw(x, path)
    readers.write_raw(readers.read_raw(spark, path).withColumn("bagian", F.concat("bagian", F.lit("!"))), path)
    return readers.read_raw(spark, path)


@query("SELECT n_nationkey, n_name FROM nation")
def candidate_view(spark, d):
    """A view is built once; asked again without ``rebuild`` it is read, not built."""
    path = _folder(spark, "view")
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    readers.candidate_view(spark, lambda: n.where("false"), path)
    readers.candidate_view(spark, lambda: n, path, rebuild=True)
    return readers.candidate_view(spark, lambda: n.where("false"), path)


_OVER = [("a", "Tidak ada kata", "x.pdf"), ("b", "solar solar solar", None), ("c", None, "hilang.pdf")]


@query(f"SELECT * FROM {K.values([('a', 'Solar/Biosolar (3)', 'teks PDF'), ('b', 'Solar/Biosolar (3)', 'overview'), ('c', None, 'overview')], 'id, jenis_bbm_disebut, dasar_relevansi')}")
def crawl_relevance(spark, d):
    over = K.frame(spark, _OVER, "id string, abstrak string, file_pdf string")
    texts = K.frame(spark, [("x.pdf", "solar, solar dan solar"), ("lain.pdf", "premium")], "file_pdf string, text string")
    return records.crawl_relevance(over, texts).select("id", "jenis_bbm_disebut", "dasar_relevansi")


_BULLETS = [(i, s) for i, s in enumerate([" Barang bukti", " lanjutan", "    1 unit", "a b¬ c", "T erdakwa W aktu", "", None])]


@query(r"SELECT i, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(s, '^\s*[\x{e000}-\x{f8ff}]\s*([^a-z\s])', '- \1'), '[\x{a0}\x{ac}\x{e000}-\x{f8ff}]', ' ', 'g'), '\s+', ' ', 'g')), '\b([TWYPF]) ([a-z]{2,})', '\1\2', 'g') AS baris FROM " + K.values(_BULLETS, "i, s"))
def bullet_lines(spark, d):
    return K.frame(spark, _BULLETS, "i int, s string").select("i", C.bullet_lines("s").alias("baris"))
