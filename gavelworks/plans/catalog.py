"""All registered queries of the ruling engine with their SQL twins.

A decision is played by ``orders`` (o_orderkey = no, o_custkey = chain, o_orderpriority = level,
o_orderdate = date, o_orderstatus = outcome, o_totalprice = volume); operators that need Indonesian
legal text take the inline corpora, as VALUES in their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicon
from ..functions import rulings as R
from ..functions import web as W
from ..operators import graph, records, rules
from ..sources import pages as P
from ..sources import readers
from ..streaming import ingest
from . import corpora as K
from . import validation_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def decisions(spark, d) -> DataFrame:
    o = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.join(F.broadcast(t(spark, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # nation has 25 rows by definition


DEC = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_STATS = "count(*) AS perkara, count(v) AS perkara_dengan_volume, coalesce(sum(v::DECIMAL(18,3)), 0)::DOUBLE AS total, quantile_cont(v, 0.5) AS median, sum(v::DECIMAL(18,3))::DOUBLE / count(v) AS rata2, quantile_cont(v, 0.9) AS p90, max(v) AS maks"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Dedupe, one row per chain, volume statistics by province."""
    return case_volume_by_province(spark, d)


# -- case level, statistics --------------------------------------------------------------------


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
c AS (SELECT o_custkey, arg_min(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, {'p': o_orderpriority, 'k': o_orderkey}) FILTER (o_orderstatus <> 'P') AS v FROM k WHERE rn = 1 GROUP BY o_custkey)
SELECT n_name AS provinsi, """ + _STATS + " FROM c JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def case_volume_by_province(spark, d):
    kept, _ = records.dedupe(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus"), [F.col("o_custkey"), F.col("o_orderdate")], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    cases = kept.groupBy("o_custkey").agg(records.first_by("o_totalprice", ["o_orderpriority", "o_orderkey"], F.col("o_orderstatus") != "P").alias("v"))
    n = t(spark, d, "customer").select("c_custkey", "c_nationkey").join(t(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return records.volume_stats(cases.join(n, F.col("o_custkey") == F.col("c_custkey")).withColumnRenamed("n_name", "provinsi"), ["provinsi"], "v")


@query("""SELECT o_custkey, count(*) AS jumlah, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '+') AS tingkat, arg_max(o_orderkey, {'t': o_orderdate, 'k': o_orderkey}) AS terakhir,
arg_max(o_orderstatus, {'t': o_orderdate, 'k': o_orderkey}) AS hasil_akhir, (count(DISTINCT o_orderstatus) > 1)::INT AS berubah, min(year(o_orderdate)) AS awal, max(year(o_orderdate)) AS akhir,
string_agg(o_orderkey::VARCHAR, '; ' ORDER BY o_orderdate, o_orderkey) AS semua FROM orders GROUP BY o_custkey""")
def case_level(spark, d):
    o = t(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    time = F.struct("day", "o_orderkey")
    return o.groupBy("o_custkey").agg(
        F.count("*").alias("jumlah"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "+").alias("tingkat"), F.max_by("o_orderkey", time).alias("terakhir"), F.max_by("o_orderstatus", time).alias("hasil_akhir"),
        (F.count_distinct("o_orderstatus") > 1).cast("int").alias("berubah"), F.min(F.year("day")).alias("awal"), F.max(F.year("day")).alias("akhir"),
        F.array_join(F.transform(F.array_sort(F.collect_list(time)), lambda x: x["o_orderkey"].cast("string")), "; ").alias("semua"),
    )


def _vol(name: str, key_sql: str, key):
    @query(f"SELECT {key_sql} AS k, {_STATS} FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM {DEC}) GROUP BY 1")
    def q(spark, d):
        x = decisions(spark, d).withColumn("k", key()).withColumn("v", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
        return records.volume_stats(x, ["k"], "v")

    QUERIES[name] = QUERIES.pop("q")
    ORACLES[name] = ORACLES.pop("q")


_vol("volume_stats_by_year", "year(o_orderdate)", lambda: F.year("o_orderdate"))
_vol("volume_stats_by_status", "o_orderstatus", lambda: F.col("o_orderstatus"))
_vol("volume_stats_by_province", "n_name", lambda: F.col("n_name"))


@query("""SELECT coalesce(a, 'Total') AS a, coalesce(b, 'Total') AS b, count(*) AS n FROM (SELECT o_orderpriority AS a, coalesce(nullif(o_orderstatus, 'P'), 'NA') AS b FROM orders) GROUP BY CUBE (a, b)""")
def crosstab_margins(spark, d):
    return records.crosstab(t(spark, d, "orders").select(F.col("o_orderpriority").alias("a"), F.nullif("o_orderstatus", F.lit("P")).alias("b")), "a", "b")


@query("""SELECT coalesce(a, 'Total') AS a, count(*) FILTER (b = 'F') AS "F", count(*) FILTER (b = 'O') AS "O", count(*) FILTER (b = 'P') AS "P", count(*) AS "Total" FROM (SELECT o_orderpriority AS a, o_orderstatus AS b FROM orders) GROUP BY ROLLUP (a)""")
def crosstab_wide(spark, d):
    return records.crosstab_wide(t(spark, d, "orders").select(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")), "a", "b", ["F", "O", "P"])


@query("""WITH x AS (SELECT l_quantity AS v, p_name ILIKE '%a%' AS a, p_name ILIKE '%o%' AS o, p_name ILIKE '%u%' AS u FROM lineitem JOIN part ON l_partkey = p_partkey),
k AS (SELECT unnest([{'k':'a','h':a},{'k':'o','h':o},{'k':'u','h':u}]) AS z, a::INT + o::INT + u::INT = 1 AS s, v FROM x)
SELECT z.k AS jenis, sum(z.h::INT)::BIGINT AS menyebut, count(*) FILTER (z.h AND s) AS satu_jenis, coalesce(sum(v) FILTER (z.h AND s), 0)::DOUBLE AS total, quantile_cont(v, 0.5) FILTER (z.h AND s) AS median FROM k GROUP BY 1""")
def per_kind_conditional(spark, d):
    x = t(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").alias("v")).join(t(spark, d, "part").select("p_partkey", F.lower("p_name").alias("p")), F.col("l_partkey") == F.col("p_partkey"))
    return records.per_kind(x, {k: F.col("p").contains(k) for k in "aou"}, "v")


_CODES = [(i, s) for i, s in enumerate(["55", "53b;55", "53;53b", None, "54", "53b", "53", None])]


@query(f"""WITH e AS (SELECT coalesce(unnest(string_split(c, ';')), '-') AS pasal FROM {K.values(_CODES, 'i, c')} WHERE c IS NOT NULL UNION ALL SELECT '-' FROM {K.values(_CODES, 'i, c')} WHERE c IS NULL)
SELECT a.pasal, count(e.pasal) AS perkara FROM (VALUES ('53a'), ('53b'), ('53c'), ('53d'), ('54'), ('55'), ('-')) a(pasal) LEFT JOIN e ON e.pasal = a.pasal GROUP BY 1""")
def multivalue_codes(spark, d):
    return records.per_article(K.frame(spark, _CODES, "i int, pasal_uu_migas string")).select("pasal", "perkara")


@query("""SELECT o_orderpriority AS grup, string_agg(DISTINCT o_custkey::VARCHAR, ', ' ORDER BY o_custkey::VARCHAR) AS rantai, arg_min('K' || o_orderkey % 100, o_orderkey) AS pertama, max(o_totalprice) AS maks FROM orders GROUP BY 1""")
def group_summary(spark, d):
    o = t(spark, d, "orders").withColumn("o_clerk", F.expr("concat('K', o_orderkey % 100)"))
    g = records.group_summary(o, "o_orderpriority", "o_custkey", "o_clerk", ["o_orderkey"], "o_totalprice", ("rantai", "pertama", "maks"))
    return g.withColumnRenamed("o_orderpriority", "grup")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def value_counts(spark, d):
    return records.value_counts(t(spark, d, "events"), "event_type")


@query("""SELECT count(*) AS baris, count(DISTINCT user_id) AS rantai_perkara, count(value) AS dengan_pdf, count(*) FILTER (value IS NULL) AS na_value, count(*) FILTER (props IS NULL) AS na_props,
(SELECT string_agg(event_type || '=' || n, ';' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)) AS per_event_type FROM events""")
def stats_row(spark, d):
    row = records.stats_row(t(spark, d, "events"), "user_id", "value", ["event_type"], ["value", "props"])
    joined = F.array_join(F.transform(F.array_sort(F.map_entries("per_event_type")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return row.withColumn("per_event_type", joined)


@query("""WITH n AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT *, max(n) OVER w AS top, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, y) AS rn FROM n WINDOW w AS (PARTITION BY o_custkey)),
a AS (SELECT *, n >= greatest(2, top // 3) AS ok FROM r), b AS (SELECT *, bool_or(ok) OVER (PARTITION BY o_custkey) AS ada FROM a)
SELECT o_custkey, y, n FROM b WHERE ok OR (NOT ada AND rn = 1)""")
def majority_threshold(spark, d):
    return records.majority(t(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y")), "o_custkey", "y")


@query("SELECT count(*) AS pairs, avg((abs(a - b) <= 0.1 * abs(b))::INT) AS agreement FROM (SELECT l_extendedprice AS a, o_totalprice AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)")
def agreement(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("a")).join(t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("b")), F.col("l_orderkey") == F.col("o_orderkey"))
    return records.agreement(x, "a", "b", 0.1)


# -- scans, predicates, windows ----------------------------------------------------------------


_TYPES = {"int": "INT", "double": "DOUBLE"}
_TYPED = ", ".join(f"{c}::{_TYPES.get(lexicon.RECORD_TYPES.get(c), 'VARCHAR')} AS {c}" for c in lexicon.RECORD)


@query(f"SELECT {_TYPED} FROM " + K.values([tuple(None if x == "NA" else x for x in r) for r in K.RECORDS], K.RECORD_NAMES))
def scan_typed(spark, d):
    """The typed reader over a written record file: NA is null, the event year stays text."""
    folder = graph.shared_folder(spark) + "/gavelworks-scan/" + uuid.uuid4().hex
    readers.write_csv(_records(spark), folder)
    return readers.read_records(spark, folder)


_NA = [(i, a, b) for i, (a, b) in enumerate([("x", "y"), ("", "y"), (" NA ", "y"), (None, "z"), ("NA", None), ("na", "q")])]


@query(f"SELECT i, a IS NULL OR trim(a) IN ('', 'NA') AS kosong, CASE WHEN a IS NULL OR trim(a) IN ('', 'NA') THEN CASE WHEN b IS NULL OR trim(b) IN ('', 'NA') THEN NULL ELSE b END ELSE a END AS isi FROM {K.values(_NA, 'i, a, b')}")
def na_predicate(spark, d):
    return K.frame(spark, _NA, "i int, a string, b string").select("i", C.is_na("a").alias("kosong"), C.first_value("a", "b").alias("isi"))


@query("SELECT o_orderkey, coalesce(y BETWEEN 1994 AND 1996, true) AS lewat, coalesce(y BETWEEN 1994 AND 1996, false) AS dalam FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS y FROM orders)")
def year_filter_and_flag(spark, d):
    x = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("y"))
    return x.select("o_orderkey", C.in_years("y", 1994, 1996).alias("lewat"), C.in_years("y", 1994, 1996, False).alias("dalam"))


@query("""WITH r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS rn, count(*) OVER (PARTITION BY text) AS n FROM documents) SELECT doc_id, n > 1 AS ganda, rn = 1 AS disimpan FROM r""")
def dedupe_and_duplicates(spark, d):
    x = t(spark, d, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("k"))
    return records.duplicate_flags(x, ["k"], [F.desc("n_chars"), "doc_id"]).select("doc_id", "ganda", "disimpan")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS no, c_custkey = row_number() OVER (ORDER BY c_custkey) AS urut, 'K' || lpad(dense_rank() OVER (ORDER BY c_nationkey)::VARCHAR, 2, '0') AS label FROM customer")
def renumber_sequence_labels(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    label = F.broadcast(c.select("c_nationkey").distinct().withColumn("label", F.format_string("K%02d", F.row_number().over(Window.orderBy("c_nationkey")))))  # 25 nations at most
    return records.renumber(c, ["c_custkey"]).join(label, "c_nationkey").select("c_custkey", F.col("no").cast("long").alias("no"), (F.col("c_custkey") == F.col("no")).alias("urut"), "label")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER w = 1 THEN max(l_quantity) OVER (PARTITION BY l_orderkey) END AS maks, count(*) OVER (PARTITION BY l_orderkey) AS anggota FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def group_max_first_row(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").withColumn("anggota", F.count("*").over(Window.partitionBy("l_orderkey")))
    return records.group_max_first(x, "l_orderkey", "l_linenumber", "l_quantity", "maks").drop("l_quantity")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS pulau FROM g) SELECT user_id, pulau::BIGINT AS pulau, count(*) AS n, min(event_id) AS awal FROM s GROUP BY ALL""")
def gap_islands(spark, d):
    x = records.islands(t(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "ts", "interval 30 minutes", "pulau")
    return x.groupBy("user_id", "pulau").agg(F.count("*").alias("n"), F.min("event_id").alias("awal"))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def top_by_score(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return records.top_by(o, ["o_custkey"], [F.col("o_totalprice"), -F.col("o_orderkey")]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def sort_nulls_last_limit(spark, d):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t(spark, d, "orders").orderBy(rank, F.col("o_totalprice").desc_nulls_last(), "o_orderkey").select("o_orderkey", "o_orderpriority").limit(25)


# -- joins, sets, graphs -----------------------------------------------------------------------


@query(f"SELECT o_custkey, arg_min(n_name, o_orderkey) FILTER (o_orderstatus = 'F') AS pertama FROM {DEC} GROUP BY 1")
def first_resolved_lookup(spark, d):
    return decisions(spark, d).groupBy("o_custkey").agg(records.first_by("n_name", ["o_orderkey"], F.col("o_orderstatus") == "F").alias("pertama"))


@query("SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey)::DOUBLE - o_totalprice AS saudara FROM orders")
def sibling_sum(spark, d):
    return records.sibling_sum(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice", "saudara").select("o_orderkey", "saudara")


@query("SELECT b.o_orderkey AS no, a.o_orderkey AS sebelum FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority < b.o_orderpriority AND a.o_orderdate > b.o_orderdate")
def chain_order_violation(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return rules.late_pairs(o, "o_custkey", "o_orderpriority", "o_orderdate").select(F.col("b.o_orderkey").alias("no"), F.col("a.o_orderkey").alias("sebelum"))


_INC = """i AS (SELECT o_orderkey AS chain, 'C' || o_custkey % 500 AS place, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN year(o_orderdate) END AS y, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS e, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 10000) END AS v,
CASE WHEN o_orderstatus <> 'O' THEN 'KAPAL ' || o_orderkey % 97 END AS nm FROM orders),
p AS (SELECT a.chain AS a, b.chain AS b, coalesce(a.v = b.v, false) AS same_volume, CASE WHEN a.nm = b.nm THEN a.nm ELSE '' END AS shared FROM i a JOIN i b ON a.place = b.place AND a.chain < b.chain AND coalesce(abs(a.y - b.y) <= 2, true) AND (a.e IS NULL OR b.e IS NULL OR left(a.e, 4) = left(b.e, 4)) AND (coalesce(a.v = b.v, false) OR coalesce(a.nm = b.nm, false)))"""


def _incident_cases(spark, d):
    """Orders as cases; some have no year, a volume or a ship shared with others."""
    o = t(spark, d, "orders")
    name = F.when(F.col("o_orderstatus") != "O", F.expr("concat('KAPAL ', o_orderkey % 97)"))
    return o.select(F.col("o_orderkey").alias("chain"), F.expr("concat('C', o_custkey % 500)").alias("place"), F.when(F.col("o_orderpriority") != "3-MEDIUM", F.year("o_orderdate")).alias("year"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("event"), F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 10000)).alias("volume"), F.array_compact(F.array(name)).alias("names"))


@query(f"WITH {_INC} SELECT a, b, same_volume, shared FROM p")
def incident_pairs(spark, d):
    return graph.incident_pairs(_incident_cases(spark, d)).select("a", "b", "same_volume", F.array_join("shared", ",").alias("shared"))


@query(f"""WITH RECURSIVE {_INC}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS n, a AS c FROM e UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.n),
m AS (SELECT n, min(c) AS c FROM r GROUP BY n), s AS (SELECT c, count(*) AS k FROM m GROUP BY c), l AS (SELECT c, k, 'K' || CASE WHEN row_number() OVER (ORDER BY c) < 100 THEN lpad(row_number() OVER (ORDER BY c)::VARCHAR, 2, '0') ELSE (row_number() OVER (ORDER BY c))::VARCHAR END AS g FROM s)
SELECT i.chain, coalesce(l.g, i.chain::VARCHAR) AS kelompok, coalesce(l.k, 1) AS anggota FROM i LEFT JOIN m ON m.n = i.chain LEFT JOIN l ON l.c = m.c""")
def incident_groups(spark, d):
    return graph.incidents(_incident_cases(spark, d))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS tercantum FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def semi_and_anti(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    c = records.not_done(t(spark, d, "customer").select("c_custkey"), o.where("o_orderpriority = '1-URGENT'"), [("c_custkey", "o_custkey")])
    return records.flag_listed(c, o.where("o_orderstatus = 'P'"), ("c_custkey", "o_custkey"), "tercantum")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 0.0 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT -c_custkey, 1.0 FROM customer WHERE c_custkey <= 10")
def upsert_by_id(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.lit(0.0)).union(c.where("c_custkey <= 10").select(-F.col("c_custkey"), F.lit(1.0)))
    return records.upsert(c, new, "c_custkey")


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey, o_orderstatus = 'F' AS teks, o_orderpriority AS p, CASE WHEN o_orderstatus <> 'O' THEN 'K' || o_orderkey % 100 END AS clerk, 'D' || o_orderkey AS dasar FROM orders),
l AS (SELECT id, o_custkey, lead(id) OVER (PARTITION BY o_custkey ORDER BY id) AS ke FROM o), e AS (SELECT id, ke AS src FROM l WHERE ke IS NOT NULL UNION SELECT ke, id FROM l WHERE ke IS NOT NULL),
g AS (SELECT e.id, arg_min({'c': s.clerk, 'd': s.dasar, 'n': s.id}, {'p': s.p, 'i': s.id}) AS v FROM e JOIN o s ON s.id = e.src AND s.teks GROUP BY 1)
SELECT o.id, CASE WHEN teks THEN clerk ELSE coalesce(clerk, v.c) END AS clerk, CASE WHEN teks OR clerk IS NOT NULL OR v IS NULL THEN dasar ELSE v.d || ' (dari putusan terkait N' || v.n || ')' END AS dasar FROM o LEFT JOIN g USING (id)""")
def chain_fill(spark, d):
    """Orders of a customer are linked each with the next one; those of status O have no field of their own."""
    o = t(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.expr("concat('N', o_orderkey)").alias("nomor_putusan"), (F.col("o_orderstatus") == "F").alias("has_text"), F.col("o_orderpriority").alias("prioritas"), F.when(F.col("o_orderstatus") != "O", F.expr("concat('K', o_orderkey % 100)")).alias("clerk"), F.expr("concat('D', o_orderkey)").alias("dasar"))
    links = o.select(F.col("o_orderkey").alias("dari_id"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ke_id")).where("ke_id is not null")
    return records.fill_from_chain(rows, links, ["clerk"], {"clerk": "dasar"}).select("id", "clerk", "dasar")


@query("SELECT n_name AS kata, y AS tahun, h AS halaman FROM nation, (SELECT unnest(range(2020, 2023)) AS y), (SELECT unnest(range(1, 3)) AS h)")
def keyword_year_pages(spark, d):
    return readers.search_pages(spark, t(spark, d, "nation").select(F.col("n_name").alias("kata")), [2020, 2021, 2022], 2)


@query("""WITH RECURSIVE d AS (SELECT DISTINCT l_partkey::BIGINT * 2 AS a, l_suppkey::BIGINT * 2 + 1 AS b FROM lineitem), e AS MATERIALIZED (SELECT a, b FROM d UNION ALL SELECT b, a FROM d),
c(node, comp) USING KEY (node) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.a, min(c.comp) FROM c JOIN e ON e.b = c.node JOIN recurring.c r ON r.node = e.a WHERE c.comp < r.comp GROUP BY e.a) SELECT node, comp FROM c""")
def chain_components(spark, d):
    """Components of all parts (even nodes) and suppliers (odd nodes) of lineitem."""
    line = t(spark, d, "lineitem")
    e = line.select((F.col("l_partkey").cast("long") * 2).alias("a"), (F.col("l_suppkey").cast("long") * 2 + 1).alias("b"))
    e = graph.cut(graph.spread(e, line.count(), "a", "b").distinct())
    # all ends of the edges are nodes; those without the other end are nodes of their own
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    return graph.contracted(nodes, e.where("a is not null and b is not null"))


_E = [(i, (i * 7 + 3) % 40) for i in range(40)] + [(i, i // 2) for i in range(40, 80)]


@query(f"WITH RECURSIVE e AS (SELECT * FROM {K.values(_E, 'a, b')}), r AS (SELECT 79 AS node, 0 AS level UNION SELECT e.b, r.level + 1 FROM r JOIN e ON e.a = r.node WHERE r.level < 45) SELECT node, min(level) AS level FROM r GROUP BY node")
def frontier_levels(spark, d):
    return graph.frontier(spark, K.frame(spark, [(79,)], "node int"), K.frame(spark, _E, "a int, b int"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, d):
    c, s, n = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").select("s_nationkey"), t(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey")
    return c.union(s).distinct().subtract(n)


# -- text --------------------------------------------------------------------------------------


@query(f"""WITH x AS (SELECT i, regexp_replace(trim(s), '^[.,]+|[.,]+$', '', 'g') AS s FROM {K.values(K.NUMBERS, 'i, s')})
SELECT i, CASE WHEN s = '' THEN NULL WHEN contains(s, ',') THEN try_cast(coalesce(nullif(replace(regexp_extract(s, '^(.*),([^,]*)$', 1), '.', ''), ''), '0') || '.' || regexp_extract(s, '^(.*),([^,]*)$', 2) AS DOUBLE)
WHEN regexp_full_match(s, '\\d{{1,3}}(\\.\\d{{3}})+') THEN replace(s, '.', '')::DOUBLE ELSE try_cast(s AS DOUBLE) END AS v FROM x""")
def number_parse(spark, d):
    return K.frame(spark, K.NUMBERS, "i int, s string").select("i", C.parse_number("s").alias("v"))


@query(f"SELECT * FROM {K.values([(0, '2020-02-05', '5 Februari 2020'), (1, '2021-08-17', '17 Agustus 2021'), (2, None, None), (3, '2019-12-01', '1 Desember 2019'), (4, '2022-11-12', '12 November 2022'), (5, None, None), (6, None, None), (7, None, None), (8, '2024-02-29', '29 Februari 2024')], 'i, tanggal, teks')}")
def date_parse_and_format(spark, d):
    x = K.frame(spark, K.DATES, "i int, s string").withColumn("d", C.parse_date("s"))
    return x.select("i", F.col("d").cast("string").alias("tanggal"), C.format_date("d").alias("teks"))


@query(f"""SELECT i, CASE WHEN regexp_matches(n, '\\d+PK/') THEN 'MA (PK)' WHEN regexp_matches(n, '\\d+K/') THEN 'MA (Kasasi)' WHEN regexp_matches(n, '/PT\\.?[A-Z]') THEN 'PT' WHEN regexp_matches(n, '/PN\\.?[A-Z]') THEN 'PN' WHEN regexp_matches(n, '/PM|DILMIL|/AD/|/AL/|/AU/') THEN 'Pengadilan Militer' END AS tingkat,
CASE WHEN s IS NULL OR trim(s) IN ('', 'NA') THEN '' ELSE regexp_replace(upper(s), '[^A-Z0-9/]', '', 'g') END AS kunci FROM (SELECT *, replace(upper(s), ' ', '') AS n FROM {K.values(K.CASES, 'i, s')})""")
def level_from_number(spark, d):
    return K.frame(spark, K.CASES, "i int, s string").select("i", C.level_of_number("s").alias("tingkat"), C.case_number_key("s").alias("kunci"))


@query(f"""WITH p AS (SELECT i, list_filter(list_transform(string_split(s, '/'), lambda x: trim(x)), lambda x: x <> '') AS p FROM {K.values(K.CASES, 'i, s')})
SELECT i, coalesce(regexp_extract(p[1], '^(\\d*)', 1), '') AS urut, coalesce(list_filter(p, lambda x: regexp_full_match(x, '\\d{{4}}'))[1], '') AS tahun, CASE WHEN len(p) > 1 THEN regexp_replace(upper(p[-1]), '[^A-Z]', '', 'g') ELSE '' END AS kode FROM p""")
def number_core(spark, d):
    return K.frame(spark, K.CASES, "i int, s string").withColumn("c", C.case_number_core("s")).select("i", F.coalesce("c.first", F.lit("")).alias("urut"), F.coalesce("c.year", F.lit("")).alias("tahun"), F.coalesce("c.court", F.lit("")).alias("kode"))


@query(f"SELECT * FROM {K.values([(0, 'MEDAN', 'Sumatera Utara'), (1, 'BANDAACEH', 'Aceh'), (2, 'SEMARANG', 'Jawa Tengah'), (3, 'JAKARTAPUSAT', 'DKI Jakarta'), (4, 'MAHKAMAHAGUNG', None), (5, 'MEDAN', 'Sumatera Utara'), (6, 'KOTOBARU', 'Sumatera Barat'), (7, '', None), (8, None, None)], 'i, kunci, provinsi')}")
def court_key_and_province(spark, d):
    x = records.with_province(K.frame(spark, K.COURTS, "i int, s string"), "s", records.gazetteer(spark))
    return x.select("i", C.court_key("s").alias("kunci"), "provinsi")


_EXTRACT = [
    ("pdf/a.pdf", "12/Pid.Sus/2020/PN Pli", "PN", "6 Mei 2020", "2019", "Bersalah", "Ya", "1500;2000", 2000.0, None, "5000000", "55;53b", "55", None),
    ("pdf/b.pdf", "99/PID/2021/PT MDN", "PT", "1 Maret 2021", None, None, "NA", None, None, None, None, None, None, "PN MEDAN"),
    ("pdf/c.pdf", "10 K/Pid.Sus/2022", "MA (Kasasi)", "7 Juli 2022", None, "Tidak bersalah", "Ya", None, None, 1200000.0, None, None, None, None),
    ("pdf/d.pdf", None, None, None, None, None, "Tidak", None, 3000.0, None, None, None, None, None),
    ("pdf/e.pdf", None, None, None, None, None, "NA", None, None, None, None, None, None, None),
    ("pdf/f.pdf", None, None, None, None, None, "NA", None, None, None, None, None, None, None),
]
_ECOLS = "file_pdf, nomor_teks, tingkat_teks, tanggal_putusan_teks, tahun_kejadian_kandidat, hasil_kandidat, relevan_bbm_kandidat, volume_liter_di_amar, volume_liter_maks_teks, rp_kerugian_negara, rp_denda_di_amar, pasal_uu_migas, modus_dari_amar, pengadilan_asal_teks"


@query(f"SELECT * FROM {K.values(_EXTRACT, _ECOLS)}")
def extract_candidates(spark, d):
    return R.candidates(K.frame(spark, K.RULINGS, "file_pdf string, text string")).select(*_ECOLS.split(", "))


@query("""SELECT doc_id, len(regexp_extract_all(text, '(?i)the'))::BIGINT AS kata, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS baris, array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10)) AS kepala, length(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')))::BIGINT AS rapi FROM documents""")
def text_lines_and_hits(spark, d):
    x = t(spark, d, "documents").select("doc_id", "text")
    return x.select("doc_id", F.regexp_count("text", F.lit("(?i)the")).cast("long").alias("kata"), F.size(F.filter(F.split("text", "\n"), lambda v: F.trim(v) != "")).cast("long").alias("baris"), C.head_lines("text", 2).alias("kepala"), F.length(F.trim(F.regexp_replace("text", r"\s+", " "))).cast("long").alias("rapi"))


_SUB = [(i, s) for i, s in enumerate(["solar subsidi", "solar non-subsidi", "pertalite", "pertalite dan solar industri", "solar subsidi dan non subsidi", "minyak tanah", "status subsidi tidak disebut", "", None])]


@query(f"""SELECT i, CASE WHEN s IS NULL OR trim(s) IN ('', 'NA') THEN 'tidak disebut' WHEN (sub OR pen) AND non THEN 'campuran' WHEN sub THEN 'subsidi' WHEN pen THEN 'penugasan (JBKP)' WHEN non THEN 'non-subsidi' ELSE 'tidak disebut' END AS status FROM (
SELECT *, regexp_matches(s, 'non-subsidi|non subsidi|industri') AS non, regexp_matches(regexp_replace(replace(replace(s, 'non-subsidi', ''), 'non subsidi', ''), 'subsidi\\s+tidak', '', 'g'), 'subsidi') AS sub, regexp_matches(s, 'pertalite|premium') AS pen FROM {K.values(_SUB, 'i, s')})""")
def category_cascade(spark, d):
    return K.frame(spark, _SUB, "i int, s string").select("i", R.subsidy("s").alias("status"))


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[surel]', 'g') AS teks FROM documents")
def redact_addresses(spark, d):
    return t(spark, d, "documents").select("doc_id", C.redact_addresses("text").alias("teks"))


_NAMES = [(0, "Menyatakan Terdakwa Budi Santoso bin Ali terbukti"), (1, "saksi Andi Wijaya, menerangkan"), (2, "Terdakwa Pengadilan Negeri"), (3, "Penuntut Umum hadir"), (4, None)]


@query(f"SELECT * FROM {K.values([(0, 'Menyatakan Terdakwa [nama] terbukti'), (1, 'saksi [nama], menerangkan'), (2, 'Terdakwa Pengadilan Negeri'), (3, 'Penuntut Umum hadir'), (4, None)], 'i, teks')}")
def redact_names(spark, d):
    return K.frame(spark, _NAMES, "i int, s string").select("i", C.redact_names("s").alias("teks"))


# -- records on the inline corpus --------------------------------------------------------------


def _records(spark):
    return K.frame(spark, K.RECORDS, readers.RECORD_SCHEMA)


@query(f"""WITH r AS (SELECT * FROM {K.values(K.RECORDS, K.RECORD_NAMES)}), k AS (SELECT *, CASE WHEN nomor_putusan IS NULL OR nomor_putusan = 'NA' THEN '' ELSE regexp_replace(upper(nomor_putusan), '[^A-Z0-9/]', '', 'g') END AS key FROM r)
SELECT kolom, tingkat, count(*) AS n FROM (
SELECT 'tingkat_persidangan' AS kolom, 'galat' AS tingkat FROM r WHERE tingkat_persidangan NOT IN ('PN', 'PT', 'MA', 'Pengadilan Militer')
UNION ALL SELECT 'hasil_putusan', 'peringatan' FROM r WHERE hasil_putusan IS NULL UNION ALL SELECT 'hasil_putusan', 'galat' FROM r WHERE hasil_putusan NOT IN ('Bersalah', 'Tidak bersalah')
UNION ALL SELECT 'nilai_kerugian_volume', 'galat' FROM r WHERE nilai_kerugian_volume <= 0 UNION ALL SELECT 'satuan_volume', 'peringatan' FROM r WHERE satuan_volume NOT IN ('liter', 'ton', 'kiloliter')
UNION ALL SELECT 'nilai_kerugian_uang', 'galat' FROM r WHERE nilai_kerugian_uang < 0 UNION ALL SELECT 'relevan_bbm', 'peringatan' FROM r WHERE relevan_bbm <> 'Ya'
UNION ALL SELECT 'url_putusan', 'info' FROM r WHERE url_putusan IS NULL UNION ALL SELECT 'url_putusan', 'peringatan' FROM r WHERE NOT regexp_matches(url_putusan, '^https://putusan3[.]')
UNION ALL SELECT 'nomor_putusan', 'info' FROM k JOIN (SELECT key FROM k GROUP BY key HAVING count(*) > 1 AND bool_or(contains(lower(coalesce(catatan, '')), 'duplikat'))) USING (key)
UNION ALL SELECT 'mata_uang', 'peringatan' FROM r WHERE nilai_kerugian_uang IS NULL AND mata_uang IS NOT NULL
UNION ALL SELECT 'no', 'peringatan' WHERE EXISTS (SELECT 1 FROM (SELECT no, row_number() OVER () AS k FROM r) WHERE no <> k)
) WHERE kolom IN ('tingkat_persidangan', 'hasil_putusan', 'nilai_kerugian_volume', 'satuan_volume', 'nilai_kerugian_uang', 'relevan_bbm', 'url_putusan', 'mata_uang', 'no') OR tingkat = 'info' GROUP BY ALL""")
def validate_counts(spark, d):
    v = rules.validate(_records(spark).coalesce(1)).groupBy("kolom", "tingkat").agg(F.count("*").alias("n"))
    return v.where("kolom in ('tingkat_persidangan', 'hasil_putusan', 'nilai_kerugian_volume', 'satuan_volume', 'nilai_kerugian_uang', 'relevan_bbm', 'url_putusan', 'mata_uang', 'no') or (kolom = 'nomor_putusan' and tingkat = 'info')")


#: what the extraction reads from the texts of the records, for the SQL twin (extract_candidates checks the reading)
CAND = [
    ("pdf/a.pdf", "12/Pid.Sus/2020/PN Pli", 2020, "6 Mei 2020", "Bersalah", "terbukti bersalah", "Solar/Biosolar (2); Pertalite (1)", "1500;2000", 3500.0, 2000.0),
    ("pdf/c.pdf", "10 K/Pid.Sus/2022", 2022, "7 Juli 2022", "Tidak bersalah", "lepas", "Bensin (jenis tidak disebut) (1)", None, None, 800.0),
]
FILES, EXCLUDED = [("pdf/a.pdf",), ("pdf/c.pdf",), ("pdf/z.pdf",)], [("3/Pid.Sus/2021/PN.Pdg",)]


@query(validation_sql.twin(K.values(K.RECORDS, K.RECORD_NAMES), K.values(EXCLUDED, "nomor_putusan"), K.values(FILES, "file_pdf"), K.values(CAND, "file_pdf, k_nomor, k_tahun, k_tanggal, k_hasil, k_dasar, k_jenis, k_liter, k_jumlah, k_maks")))
def validate_issues(spark, d):
    cand = R.candidates(K.frame(spark, K.RULINGS, "file_pdf string, text string"))
    return rules.ordered(rules.validate(_records(spark).coalesce(1), K.frame(spark, EXCLUDED, "nomor_putusan string"), K.frame(spark, FILES, "file_pdf string"), cand))


#: records and texts of which each breaks another rule
BROKEN = [
    K._rec(no=1, nomor_putusan="1/Pid.Sus/2021/PN Pti", tingkat_proses="Kasasi", tanggal_putusan="5 Mei 2021", tahun_putusan=2020, tahun_kejadian="2022", nilai_kerugian_uang=1000.0, satuan_volume=None, file_pdf="pdf/1.pdf", url_putusan="https://putusan3.mahkamahagung.go.id/direktori/putusan/a1.html"),
    K._rec(no=2, nomor_putusan="2/PID/2018/PT SMG", tingkat_persidangan="PN", tanggal_putusan="31 Februari 2018", tahun_putusan=2018, tahun_kejadian="tak tahu", hasil_putusan="NA", file_pdf="pdf/2.pdf", lampiran_pdf="Tidak ada", url_putusan="https://putusan3.mahkamahagung.go.id/direktori/putusan/a2.html"),
    K._rec(no=3, nomor_putusan="3/Pid.Sus/2022/PN.Pti", tanggal_putusan="1 Juni 2022", tahun_putusan=2022, barang_bbm="pertalite dan minyak tanah", nilai_kerugian_volume=750.5, file_pdf="pdf/3.pdf", rantai_perkara="R09", url_putusan="https://putusan3.mahkamahagung.go.id/direktori/putusan/a3.html"),
    K._rec(no=4, nomor_putusan="4 K/Pid.Sus/2021", tingkat_persidangan="MA", tingkat_proses="Kasasi", tanggal_putusan="2 Januari 2021", tahun_putusan=2021, nilai_kerugian_volume=None, satuan_volume="liter", file_pdf="pdf/4.pdf", catatan="PDF memuat putusan 77 yang lain", rantai_perkara="R09", url_putusan="https://putusan3.mahkamahagung.go.id/direktori/putusan/a4.html"),
    K._rec(no=5, nomor_putusan="5/Pid.Sus/2020/PN Pti", file_pdf=None, lampiran_pdf="Ada", mata_uang="IDR", tahun_kejadian="2020-2019", url_putusan="https://putusan3.mahkamahagung.go.id/direktori/putusan/a4.html"),
    K._rec(no=6, nomor_putusan="1/pid.sus/2021/PN.Pti", relevan_bbm=None, nilai_kerugian_volume=0.0, file_pdf="pdf/5.pdf", rantai_perkara=None, url_putusan="https://putusan3.mahkamahagung.go.id/direktori/putusan/a6.htm"),
]
BROKEN_CAND = [
    ("pdf/1.pdf", "1/Pid.Sus/2021/PN PATI", 2021, "5 Mei 2021", "Tidak bersalah", "bebas", "Solar/Biosolar (9)", "90;10", 100.0, 5.0),
    ("pdf/3.pdf", "3/Pid.Sus/2022/PN Pti", 2022, "1 Juni 2022", "Bersalah", "terbukti bersalah", "Pertalite (3)", "700;1", 701.0, 700.0),
    ("pdf/4.pdf", "77/Pid.Sus/2020/PN Pti", 2020, "1 Mei 2020", None, None, None, None, None, None),
    ("pdf/5.pdf", "8/Pid.Sus/2020/PN Pti", 2020, "1 Mei 2020", None, None, None, None, None, None),
]
BROKEN_FILES = [("pdf/1.pdf",), ("pdf/3.pdf",), ("pdf/4.pdf",), ("pdf/5.pdf",), ("pdf/9.pdf",)]
BROKEN_OUT = [("5/PID.SUS/2020/PN.Pti",)]


@query(validation_sql.twin(K.values(BROKEN, K.RECORD_NAMES), K.values(BROKEN_OUT, "nomor_putusan"), K.values(BROKEN_FILES, "file_pdf"), K.values(BROKEN_CAND, "file_pdf, k_nomor, k_tahun, k_tanggal, k_hasil, k_dasar, k_jenis, k_liter, k_jumlah, k_maks")))
def validate_every_rule(spark, d):
    cand = "file_pdf string, nomor_teks string, tahun_putusan_teks int, tanggal_putusan_teks string, hasil_kandidat string, dasar_hasil_kandidat string, jenis_bbm_disebut string, volume_liter_di_amar string, volume_liter_di_amar_jumlah double, volume_liter_maks_teks double"
    r = K.frame(spark, BROKEN, readers.RECORD_SCHEMA).coalesce(1)
    return rules.validate(r, K.frame(spark, BROKEN_OUT, "nomor_putusan string"), K.frame(spark, BROKEN_FILES, "file_pdf string"), K.frame(spark, BROKEN_CAND, cand))


@query(f"""SELECT * FROM {K.values([("R01", 2, "PN+PT", "Sumatera Utara", 100.0, "55", "K01", 2), ("R02", 1, "PN", "Sumatera Barat", None, "55", "R02", 1), ("R04", 1, "PN", "Sumatera Utara", 100.0, "55", "K01", 2), ("R05", 1, "MA", None, 100.0, "55", "R05", 1)], 'rantai_perkara, jumlah_putusan, tingkat_tercakup, provinsi, volume_liter, pasal_uu_migas, kelompok_kejadian, jumlah_rantai_sekelompok')}""")
def analyze_cases(spark, d):
    gaz = records.gazetteer(spark)
    kept, _ = records.dedupe_decisions(_records(spark).withColumn("nilai_kerugian_volume", F.when(F.col("nilai_kerugian_volume") > 0, F.col("nilai_kerugian_volume"))))
    cases = records.with_incidents(records.case_level(records.prepare(kept, gaz)))
    return cases.select("rantai_perkara", "jumlah_putusan", "tingkat_tercakup", "provinsi", "volume_liter", "pasal_uu_migas", "kelompok_kejadian", "jumlah_rantai_sekelompok")


@query(f"SELECT * FROM {K.values([(1, 'teks PDF putusan', 'bahan bakar minyak, solar, pertalite', False), (2, 'kutipan verbatim (bukti_kutipan)', 'BBM, solar', True), (3, 'kutipan verbatim (bukti_kutipan)', 'BBM, solar', True), (4, 'kutipan verbatim (bukti_kutipan)', 'BBM, solar', True), (5, 'teks PDF putusan', 'bahan bakar minyak, solar, pertalite', False), (7, 'teks PDF putusan', None, False)], 'no, dasar_bukti_kata_kunci, kata_kunci_ditemukan, token_BBM_literal')}")
def keyword_evidence(spark, d):
    return records.evidence(_records(spark), K.frame(spark, K.RULINGS, "file_pdf string, text string")).select("no", "dasar_bukti_kata_kunci", "kata_kunci_ditemukan", "token_BBM_literal")


_REVIEW = [("rekap", 3, "no", "bukan BBM"), ("rekap", 4, "uncertain", "ragu"), ("dikeluarkan", 1, "no", "lain")]


@query(f"SELECT row_number() OVER (ORDER BY no)::INT AS no, nomor_putusan FROM {K.values(K.RECORDS, K.RECORD_NAMES)} WHERE no NOT IN (SELECT no FROM {K.values(_REVIEW, 'dataset, no, final, alasan')} WHERE dataset = 'rekap' AND final = 'no')")
def apply_review(spark, d):
    ex = K.frame(spark, [], "nomor_putusan string")
    return records.apply_review(_records(spark), ex, K.frame(spark, _REVIEW, "dataset string, no int, final string, alasan string"))[0].select("no", "nomor_putusan")


# -- pages -------------------------------------------------------------------------------------


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS judul, len(regexp_extract_all(html, '<a href='))::BIGINT AS tautan, regexp_matches(lower(html), 'g-recaptcha|recaptcha/api|h-captcha|hcaptcha[.]com|saya bukan robot|not a robot|cf-chl-|challenge-platform|just a moment[.]{3}') AS captcha FROM pages")
def page_fields(spark, d):
    p = t(spark, d, "pages")
    return p.select("page_id", C.page_host("url").alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("judul"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("tautan"), W.blocked("html").alias("captcha"))


@query("SELECT regexp_extract(url, '//([^/?#:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(spark, d):
    return t(spark, d, "pages").groupBy(F.regexp_extract("url", "//([^/?#:]+)", 1).alias("host")).agg(F.count("*").alias("n"))


@query(f"SELECT * FROM {K.values([('aa11', 'Putusan PN Medan Nomor 1/Pid/2020', '05-05-2020'), ('bb22', 'Putusan 2', '06-06-2021')], 'id, judul, tanggal_putus')}")
def listing_entries(spark, d):
    return P.listings(K.frame(spark, [("https://x/direktori/index/kategori/m-1.html", K.LISTING)], "url string, html string")).select("id", "judul", "tanggal_putus")


@query(f"SELECT * FROM {K.values([('aa11', '1/Pid/2020/PN Mdn', 'Pertama', 'Ada', 'bb22')], 'id, nomor, proses, lampiran, terkait')}")
def overview_fields(spark, d):
    o = P.overviews(K.frame(spark, [("https://x/direktori/putusan/aa11.html", K.OVERVIEW)], "url string, html string"))
    return o.select("id", F.col("meta")["nomor"].alias("nomor"), F.col("meta")["tingkat_proses"].alias("proses"), "lampiran", F.array_join(F.transform("terkait", lambda x: x["id"]), ",").alias("terkait"))


_EXT = [
    (0, "dalam bulan Maret 2019 bertempat di Kota Medan, atau setidak-tidaknya\nMENGADILI:\nTerdakwa terbukti bersalah;\n- 10 jerigen masing-masing berisi 30 liter solar;\nDemikian diputuskan 5 Mei 2020"),
    (1, "kerugian negara sebesar Rp2.000.000,00 atas solar subsidi, solar subsidi dan solar subsidi; disita total 500 liter solar subsidi"),
    (2, "membeli pertalite 100 liter seharga Rp10.000,00 per liter"),
    (3, None),
]
_EXT_WANT = [(0, "Bersalah", "Ya", "Solar", 300.0, "liter", None, "2019", "Kota Medan"), (1, None, "Ya", "Solar (subsidi)", 500.0, "liter", 2000000.0, None, None), (2, None, "Perlu dicek (sebutan BBM sedikit)", "Pertalite", 100.0, "liter", 1000000.0, None, None), (3, None, "Tidak", None, None, None, None, None, None)]
_EXT_COLS = "i, hasil_putusan, relevan_bbm, barang_bbm, nilai_kerugian_volume, satuan_volume, nilai_kerugian_uang, tahun_kejadian, kab_kota"


@query(f"SELECT * FROM {K.values(_EXT_WANT, _EXT_COLS)}")
def extended_fields(spark, d):
    from ..functions import extended as X

    return X.ruling_record(K.frame(spark, _EXT, "i int, text string")).select(*_EXT_COLS.split(", "))


@query("SELECT date_trunc('hour', ts) AS jam, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    e = t(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value"))
    return ingest.windowed_counts(e).select(F.col("window.start").cast("timestamp_ntz").alias("jam"), "event_type", "n")


@query("SELECT l_orderkey, count(*) AS n, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def lookup_join(spark, d):
    n = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.join(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "n", "o_orderstatus")


_URLS = [(i, u, n) for i, (u, n) in enumerate([("https://x/kategori/migas-1.html", 2), ("https://x/kategori/migas-1/page/7.html", 1), ("https://x/kategori/migas-1/tahunjenis/putus/tahun/2020.html", 3), ("/direktori/putusan/AB12.html", 1), (None, 2)])]


@query(f"""SELECT i, CASE WHEN n <= 1 THEN b ELSE regexp_replace(b, '\\.html$', '') || '/page/' || n || '.html' END AS halaman, regexp_replace(regexp_replace(b, '/tahunjenis/[^/]+/tahun/\\d{{4}}\\.html$', '.html'), '\\.html$', '') || '/tahunjenis/putus/tahun/2021.html' AS tahun,
nullif(lower(regexp_extract(coalesce(u, ''), '(?i)/putusan/([0-9a-z]+)\\.html', 1)), '') AS id FROM (SELECT *, regexp_replace(u, '/page/\\d+\\.html', '.html') AS b FROM {K.values(_URLS, 'i, u, n')})""")
def addresses(spark, d):
    return K.frame(spark, _URLS, "i int, u string, n int").select("i", W.page("u", "n").alias("halaman"), W.by_year("u", F.lit(2021)).alias("tahun"), W.ruling_id("u").alias("id"))


from . import more as _more  # noqa: E402, F401  registers further queries
from . import texts as _texts  # noqa: E402, F401
from . import composed as _composed  # noqa: E402, F401
