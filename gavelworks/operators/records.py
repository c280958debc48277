"""Record-level operators: dedupe, case level, statistics, crosstabs, evidence, review."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rulings as R
from ..functions.lexicon import ARTICLES, DUMMIES, FACT_ORDER, FINAL_RELEVANCE, PLACES, RECORD, STAGE_ORDER
from . import graph


def _ranked(df: DataFrame, key: list, best: list) -> DataFrame:
    """df with ``_rn`` and ``_r2``: the best row of a key has 1 and 1, and ``_many``, whether the key has more rows.

    Rows are ranked within the part of the input they come from, then the best of each part among each other, so that
    a key of any size (no number, no text) is never in one task."""
    d = df.withColumn("_s", F.spark_partition_id())
    part = Window.partitionBy(*key, "_s")
    d = d.withColumn("_rn", F.row_number().over(part.orderBy(*best))).withColumn("_many", F.count("*").over(part) > 1)
    # the best of all parts meet; the others stay where they are
    d = d.withColumn("_s", F.when(F.col("_rn") == 1, F.lit(-1)).otherwise(F.col("_s")))
    d = d.withColumn("_r2", F.row_number().over(part.orderBy(*best))).withColumn("_many", F.col("_many") | ((F.col("_rn") == 1) & (F.count("*").over(part) > 1)))
    return d.drop("_s")


def dedupe(df: DataFrame, key: list[Column], best: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the best row of each key."""
    r, first = _ranked(df, key, best), (F.col("_rn") == 1) & (F.col("_r2") == 1)
    return r.where(first).drop("_rn", "_r2", "_many"), r.where(~first).drop("_rn", "_r2", "_many")


def dedupe_decisions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Same number and date: the one with a PDF, then the lowest ``no``. Records without a number share the key ''."""
    return dedupe(df, [C.case_number_key("nomor_putusan"), F.coalesce("tanggal_putusan", F.lit("nan"))], [F.col("file_pdf").isNotNull().desc(), F.col("no").asc()])


def gazetteer(spark, places: dict | None = None, more: DataFrame | None = None) -> DataFrame:
    """(key, provinsi) for court_key joins: the places of ``places`` (province -> names; default PLACES) and the rows
    of ``more`` (provinsi, tempat; default: the CSV file that the session's spark.gavelworks.places names, if any);
    of places named twice the province first in the alphabet."""
    path = spark.conf.get("spark.gavelworks.places", None)
    if more is None and path:
        more = spark.read.option("header", True).csv(path)
    rows = [(place, prov) for prov, names in (places or PLACES).items() for place in ([names] if isinstance(names, str) else names)]
    g = spark.createDataFrame(rows, "place string, provinsi string")
    if more is not None:
        g = g.union(more.select("tempat", "provinsi"))
    return g.groupBy(C.court_key("place").alias("key")).agg(F.min("provinsi").alias("provinsi")).where("key <> ''")


def court_places(places: dict | None = None) -> list[str]:
    """Keys of the gazetteer's places, for names that must not be taken for companies."""
    return sorted({re.sub("[^A-Z]", "", p.upper()) for names in (places or PLACES).values() for p in names})


def with_province(df: DataFrame, court: str, gaz: DataFrame, out: str = "provinsi") -> DataFrame:
    """Left join with the gazetteer by court_key; the supreme court and unknown courts get null."""
    key = F.when(~F.upper(C.col(court)).contains("MAHKAMAH AGUNG"), C.court_key(court))
    return df.withColumn("_k", key).join(gaz.select(F.col("key").alias("_k"), F.col("provinsi").alias(out)), "_k", "left").drop("_k")


def prepare(df: DataFrame, gaz: DataFrame) -> DataFrame:
    d = df.withColumn("tanggal", C.parse_date("tanggal_putusan")).withColumn("level", F.coalesce(C.literal_map(STAGE_ORDER)[F.col("tingkat_proses")], F.lit(0)))
    d = d.withColumn("prioritas_fakta", F.coalesce(C.literal_map(FACT_ORDER)[F.col("tingkat_persidangan")], F.lit(9))).withColumn("pengadilan", F.upper(F.trim("pengadilan")))
    d = with_province(d, "pengadilan", gaz, "provinsi_pengadilan").withColumn("pasal_uu_migas", R.record_articles("rincian_amar", "catatan"))
    for name, c in dummies("barang_bbm").items():
        d = d.withColumn(name, c)
    return d.withColumn("status_subsidi", R.subsidy("barang_bbm")).withColumn("jumlah_jenis_bbm", sum((F.col(k) for k in DUMMIES), F.lit(0)))


def dummies(c: str) -> dict[str, Column]:
    return {k: F.lower(F.coalesce(C.col(c), F.lit(""))).rlike(p).cast("int") for k, p in DUMMIES.items()}


def first_by(c, order: list[str], cond: Column | None = None) -> Column:
    """Value of the first row in order where cond holds (default: the value is not missing)."""
    cond = ~C.is_na(c) if cond is None else cond
    return F.min_by(F.when(cond, C.col(c)), F.when(cond, F.struct(*order)))


def case_level(d: DataFrame, candidates: DataFrame | None = None, gaz: DataFrame | None = None) -> DataFrame:
    """One row per chain of prepared decisions; rows without a chain are dropped."""
    d = d.where("rantai_perkara is not null").withColumn("_pdf", F.col("file_pdf").isNull().cast("int")).withColumn("_t", F.coalesce(F.datediff("tanggal", F.lit("0001-01-01").cast("date")) + 1, F.lit(0)))
    fact, time = ["prioritas_fakta", "_pdf", "no"], ["_t", "level", "no"]
    if candidates is not None:
        c = candidates.select("file_pdf", F.col("pengadilan_asal_teks").alias("_asal")).dropDuplicates(["file_pdf"])
        d = with_province(d.join(c, "file_pdf", "left"), "_asal", gaz, "_asal_prov")
    else:
        d = d.withColumn("_asal_prov", F.lit(None).cast("string"))
    inst = F.col("tingkat_persidangan").isin("PN", "Pengadilan Militer")
    vol = F.col("nilai_kerugian_volume").isNotNull()
    money = F.col("nilai_kerugian_uang").isNotNull()
    levels = F.array_sort(F.collect_set(F.struct("prioritas_fakta", "tingkat_persidangan")))
    v = first_by(F.struct("nilai_kerugian_volume", "satuan_volume", "nomor_putusan"), fact, vol)
    m = first_by(F.struct("nilai_kerugian_uang", "dasar_nilai_uang"), fact, money)
    last = F.max_by(F.struct("nomor_putusan", "tingkat_proses", "tanggal_putusan", "hasil_putusan"), F.struct(*time))
    g = d.groupBy("rantai_perkara").agg(
        F.count("*").alias("jumlah_putusan"),
        F.array_join(F.transform(levels, lambda x: x["tingkat_persidangan"]), "+").alias("tingkat_tercakup"),
        first_by("nomor_putusan", ["no"], inst & ~C.is_na("nomor_putusan")).alias("nomor_putusan_pertama"),
        first_by("pengadilan", ["no"], inst & ~C.is_na("pengadilan")).alias("pengadilan_pertama"),
        first_by("provinsi_pengadilan", fact).alias("_prov"),
        first_by("_asal_prov", fact).alias("_asal"),
        first_by("tahun_kejadian", fact).alias("tahun_kejadian"),
        F.min("tahun_putusan").alias("tahun_putusan_awal"),
        F.max("tahun_putusan").alias("tahun_putusan_akhir"),
        last.alias("_last"),
        first_by("hasil_putusan", ["no"], inst & ~C.is_na("hasil_putusan")).alias("hasil_tingkat_pertama"),
        (F.count_distinct("hasil_putusan") > 1).cast("int").alias("hasil_berubah_antartingkat"),
        first_by("barang_bbm", fact).alias("barang_bbm"),
        v.alias("_v"),
        m.alias("_m"),
        R.merge_articles(F.flatten(F.collect_list(F.split("pasal_uu_migas", ";")))).alias("pasal_uu_migas"),
        F.array_join(F.array_sort(F.collect_set("sumber_daftar")), "; ").alias("sumber_daftar"),
        F.max(F.col("file_pdf").isNotNull().cast("int")).alias("ada_pdf"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*time, "nomor_putusan"))), lambda x: x["nomor_putusan"]), "; ").alias("nomor_putusan_semua"),
        F.concat_ws(" ", F.collect_list(F.concat_ws(" ", "catatan", "keterangan_volume", "rincian_amar", "bukti_kutipan", "dasar_nilai_uang"))).alias("_text"),
    )
    g = g.withColumn("provinsi", F.coalesce("_prov", "_asal"))
    g = g.withColumn("sumber_provinsi", F.when(F.col("_prov").isNotNull(), "pengadilan dalam rantai").when(F.col("_asal").isNotNull(), "pengadilan asal disebut di teks PDF"))
    g = g.select(
        "*", F.col("_last.nomor_putusan").alias("nomor_putusan_terakhir"), F.col("_last.tingkat_proses").alias("tingkat_terakhir"), F.col("_last.tanggal_putusan").alias("tanggal_putusan_terakhir"),
        C.value("_last.hasil_putusan").alias("hasil_akhir"), R.subsidy("barang_bbm").alias("status_subsidi"), F.col("_v.nilai_kerugian_volume").alias("volume"),
        F.col("_v.satuan_volume").alias("satuan_volume"), F.col("_v.nomor_putusan").alias("volume_dari"), F.col("_m.nilai_kerugian_uang").alias("nilai_uang_rp"), F.col("_m.dasar_nilai_uang").alias("dasar_nilai_uang"),
        *[c.alias(k) for k, c in dummies("barang_bbm").items()],
    ).drop("_prov", "_asal", "_last", "_v", "_m")
    return g.withColumn("volume_liter", F.when(F.col("satuan_volume") == "liter", F.col("volume")))


def with_incidents(cases: DataFrame, places: list[str] | None = None) -> DataFrame:
    """Adds the incident group, its size, the reasons, and the group's largest volume on its first chain.

    places: keys of places with a court (default: the gazetteer's); "PT Semarang" is a court, no company."""
    known = F.array(*[F.lit(p) for p in (court_places() if places is None else places)]).cast("array<string>")
    place = F.coalesce("pengadilan_pertama", F.concat_ws("|", F.coalesce("provinsi", F.lit("?")), "tingkat_tercakup"))
    c = graph.cut(cases.select(F.col("rantai_perkara").alias("chain"), place.alias("place"), F.col("tahun_putusan_awal").alias("year"), C.value("tahun_kejadian").alias("event"), F.col("volume_liter").alias("volume"), R.entities(F.col("_text"), known).alias("names")))
    pairs = graph.incident_pairs(c)
    why = F.filter(F.array(F.when(F.col("same_volume"), F.concat(F.lit("volume sama "), C.general_number("volume"), F.lit(" L"))), F.when(F.size("shared") > 0, F.concat(F.lit("menyebut "), F.array_join("shared", ", ")))), lambda x: x.isNotNull())
    both = pairs.withColumn("w", why).select(F.explode(F.array("a", "b")).alias("rantai_perkara"), "w").select("rantai_perkara", F.explode("w").alias("w"))
    reasons = both.groupBy("rantai_perkara").agg(F.array_join(F.array_sort(F.collect_set("w")), "; ").alias("dasar_kelompok"))
    grp = graph.incidents(c).select(F.col("chain").alias("rantai_perkara"), F.col("kelompok").alias("kelompok_kejadian"), F.col("anggota").alias("jumlah_rantai_sekelompok"))
    out = cases.drop("_text").join(grp, "rantai_perkara").join(reasons, "rantai_perkara", "left")
    return group_max_first(out, "kelompok_kejadian", "rantai_perkara", "volume_liter", "volume_liter_kelompok")


def group_max_first(df: DataFrame, group: str, order: str, v: str, out: str) -> DataFrame:
    """The largest value of each group on its first row, null on the others."""
    w = Window.partitionBy(group)
    return df.withColumn(out, F.when(F.row_number().over(w.orderBy(order)) == 1, F.max(v).over(w)))


def duplicate_flags(df: DataFrame, key: list, best: list, group: str = "ganda", keep: str = "disimpan") -> DataFrame:
    """Whether another row has the same key, and whether this row is the best one."""
    r = _ranked(df, key, best)
    return r.withColumn(group, F.col("_many")).withColumn(keep, (F.col("_rn") == 1) & (F.col("_r2") == 1)).drop("_rn", "_r2", "_many")


def top_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that comes last in order (a struct comparison, aggregated without a sort)."""
    cols = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(cols, F.struct(*order)).alias("_b")).select("_b.*")


def sibling_sum(df: DataFrame, group: str, v: str, out: str) -> DataFrame:
    """Sum of the other rows of the group, in exact decimals."""
    return df.withColumn(out, F.sum(F.col(v).cast("decimal(18,2)")).over(Window.partitionBy(group)).cast("double") - F.col(v))


def islands(df: DataFrame, keys: list[str], order: list[str], at: str, gap, out: str) -> DataFrame:
    """Number of the stretch a row lies in: a step of more than ``gap`` in ``at`` opens a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = (F.col(at) - F.lag(at).over(w) > (F.expr(gap) if isinstance(gap, str) else F.lit(gap))).cast("int")
    d = df.withColumn("_gap", F.coalesce(step, F.lit(0)))
    return d.withColumn(out, F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


renumber = graph.renumber


# -- statistics --------------------------------------------------------------------------------


#: groups whose bounds are sent to every task; with more of them the bounds are joined by shuffle
MOST_GROUPS = 100_000


def near_ranks(df: DataFrame, keys: list[str], v: str, shares: dict[str, float], cells: int = 10_000) -> DataFrame:
    """(keys, _n, _i, _v, _c): the values around each wanted rank and how often each occurs; the values below them are
    one row with a null value.

    A sketch that tells ranks to one part in ``cells`` gives two bounds around each rank, whatever the values are, so
    what lies between them is some parts in ``cells`` of a group (and single values, however common, are one row).
    Groups too small for that are taken whole."""
    x = df.select(*keys, F.col(v).cast("double").alias("_x")).where("_x is not null")
    eps = 1.0 / cells
    # three errors of the sketch to either side
    sides = [q for p in shares.values() for q in (max(0.0, p - 3 * eps), min(1.0, p + 3 * eps))]
    found = F.percentile_approx("_x", F.array(*[F.lit(q) for q in sides]), F.lit(cells))
    span = x.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), found.alias("_b"))
    whole = F.col("_n") * eps < 4
    low = [F.when(whole, F.col("_lo")).otherwise(F.col("_b")[2 * k]).alias(f"_a{k}") for k in range(len(shares))]
    high = [F.when(whole, F.col("_hi")).otherwise(F.col("_b")[2 * k + 1]).alias(f"_z{k}") for k in range(len(shares))]
    span = span.select(*keys, "_n", *low, *high)
    rows = span.limit(MOST_GROUPS + 1).collect()
    if len(rows) <= MOST_GROUPS:
        span = F.broadcast(df.sparkSession.createDataFrame(rows, span.schema))
    same = reduce(lambda p, q: p & q, [F.col(f"x.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys], F.lit(True))
    y = x.alias("x").join(span.alias("s"), same).select(*[f"x.{k}" for k in keys], "x._x", "s._n", *[f"s._{c}{k}" for k in range(len(shares)) for c in "az"])
    each = [F.struct(F.lit(k).alias("_i"), F.when(F.col("_x") >= F.col(f"_a{k}"), F.col("_x")).alias("_v"), (F.col("_x") <= F.col(f"_z{k}")).alias("_in")) for k in range(len(shares))]
    z = y.select(*keys, "_n", F.explode(F.array(*each)).alias("_e")).select(*keys, "_n", "_e.*").where("_in")
    return z.groupBy(*keys, "_n", "_i", "_v").agg(F.count("*").alias("_c"))


def quantiles(df: DataFrame, keys: list[str], v: str, shares: dict[str, float], cells: int = 10_000) -> DataFrame:
    """Exact linear quantiles by keys; no task holds a whole group, see ``near_ranks``.  Null keys are a group; keys
    without a value are left out."""
    near = near_ranks(df, keys, v, shares, cells)
    w = Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_to", F.sum("_c").over(w)).withColumn("_from", F.col("_to") - F.col("_c")).where("_v is not null")
    aggs, out = [], []
    for k, (name, p) in enumerate(shares.items()):
        r = F.lit(p) * (F.col("_n") - 1)  # places from 0
        at = lambda place: F.max(F.when((F.col("_i") == k) & (F.col("_from") <= place) & (place < F.col("_to")), F.col("_v")))  # noqa: E731, B023
        aggs += [at(F.floor(r)).alias(f"_{k}_lo"), at(F.ceil(r)).alias(f"_{k}_hi"), F.max(r - F.floor(r)).alias(f"_{k}_w")]
        sure = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("a rank lies outside its bounds")).cast("double"))
        out.append((sure(f"_{k}_lo") + (sure(f"_{k}_hi") - F.col(f"_{k}_lo")) * F.col(f"_{k}_w")).alias(name))
    return near.groupBy(*keys).agg(*aggs).select(*keys, *out)


def volume_stats(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    """Rows, rows with a volume, sum (0 if none), median, mean, linear 90 % quantile, maximum by keys."""
    x = F.col(v).cast("double")
    one = df.groupBy(*keys).agg(
        F.count("*").alias("perkara"), F.count(v).alias("perkara_dengan_volume"), F.coalesce(F.sum(F.col(v).cast("decimal(18,3)")), F.lit(0)).cast("double").alias("total"),
        (F.sum(F.col(v).cast("decimal(18,3)")).cast("double") / F.count(v)).alias("rata2"), F.max(x).alias("maks"),
    )
    q = quantiles(df, keys, v, {"median": 0.5, "p90": 0.9})
    on = reduce(lambda p, r: p & r, [F.col(f"o.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys])
    return one.alias("o").join(q.alias("q"), on, "left").select(*[f"o.{k}" for k in keys], "perkara", "perkara_dengan_volume", "total", "median", "rata2", "p90", "maks")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) with margins 'Total' and 'NA' for null."""
    t = df.select(F.coalesce(F.col(a).cast("string"), F.lit("NA")).alias(a), F.coalesce(F.col(b).cast("string"), F.lit("NA")).alias(b))
    c = t.cube(a, b).agg(F.count("*").alias("n"))
    return c.select(F.coalesce(a, F.lit("Total")).alias(a), F.coalesce(b, F.lit("Total")).alias(b), "n")


def crosstab_wide(df: DataFrame, a: str, b: str, cats: list[str]) -> DataFrame:
    t = crosstab(df, a, b)
    return t.groupBy(a).pivot(b, [*cats, "Total"]).agg(F.first("n")).na.fill(0)


def per_kind(df: DataFrame, hits: dict[str, Column], v: str, names: tuple = ("jenis", "menyebut", "satu_jenis", "total", "median")) -> DataFrame:
    """Rows that name a kind, rows that name it alone, and sum and median of the values of the latter."""
    kind, said, alone, total, middle = names
    single = sum((c.cast("int") for c in hits.values()), F.lit(0)) == 1
    kinds = F.array(*[F.struct(F.lit(k).alias(kind), c.cast("boolean").alias("_hit")) for k, c in hits.items()])
    x = df.select(single.alias("_s"), F.col(v).cast("double").alias("_v"), F.explode(kinds).alias("_k")).select("_s", "_v", "_k.*")
    one = F.col("_hit") & F.col("_s")
    g = x.groupBy(kind).agg(F.sum(F.col("_hit").cast("int")).alias(said), F.count_if(one).alias(alone), F.coalesce(F.sum(F.when(one, F.col("_v"))), F.lit(0.0)).alias(total))
    return g.join(quantiles(x.where(one), [kind], "_v", {middle: 0.5}), kind, "left")


def per_fuel(cases: DataFrame) -> DataFrame:
    hits = {k.removeprefix("bbm_"): F.col(k) == 1 for k in DUMMIES}
    return per_kind(cases, hits, "volume_liter", ("jenis_bbm", "perkara_menyebut", "perkara_satu_jenis", "total_liter_satu_jenis", "median_liter_satu_jenis"))


def per_article(cases: DataFrame) -> DataFrame:
    """Cases per article code, and those without any."""
    spark = cases.sparkSession
    dim = spark.createDataFrame([*ARTICLES.items(), ("-", "pasal tidak tercatat di rincian_amar/catatan")], "pasal string, uraian string")
    n = cases.select(F.explode(F.coalesce(F.split("pasal_uu_migas", ";"), F.array(F.lit("-")))).alias("pasal")).groupBy("pasal").agg(F.count("*").alias("n"))
    return dim.join(n, "pasal", "left").select("pasal", "uraian", F.coalesce("n", F.lit(0)).alias("perkara"))


def group_summary(df: DataFrame, group: str, member, first: str, order: list[str], v: str, names: tuple) -> DataFrame:
    """Members of each group joined in order, the first one's field, the largest value.

    Members are made distinct by an aggregation over (group, member) first, so that a group's list holds each once."""
    m, f, top = names
    each = df.groupBy(group, C.col(member).cast("string").alias("_m")).agg(F.min(F.struct(*order, first)).alias("_f"), F.max(v).alias("_v"))
    some = F.min_by(F.col(f"_f.{first}"), F.when(~C.is_na(f"_f.{first}"), F.struct(*[F.col(f"_f.{o}") for o in order])))
    return each.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("_m")), ", ").alias(m), some.alias(f), F.max("_v").alias(top))


def incident_summary(cases: DataFrame) -> DataFrame:
    c = cases.where("jumlah_rantai_sekelompok > 1")
    g = group_summary(c, "kelompok_kejadian", "rantai_perkara", "pengadilan_pertama", ["rantai_perkara"], "volume_liter", ("rantai", "pengadilan", "volume_liter_maks"))
    return g.join(c.groupBy("kelompok_kejadian").agg(first_by("dasar_kelompok", ["rantai_perkara"]).alias("dasar")), "kelompok_kejadian")


def value_counts(df: DataFrame, by: str, out: str = "n") -> DataFrame:
    """Rows of each value, the commonest first, then by value."""
    return df.groupBy(by).agg(F.count("*").alias(out)).orderBy(F.desc(out), by)


def summaries(decisions: DataFrame, cases: DataFrame) -> dict[str, DataFrame]:
    stats = lambda keys, df=cases: volume_stats(df, keys, "volume_liter")
    return {
        "putusan_tahun_x_tingkat": crosstab(decisions, "tahun_putusan", "tingkat_persidangan"),
        "perkara_tahun_awal_x_hasil_akhir": crosstab(cases, "tahun_putusan_awal", "hasil_akhir"),
        "perkara_volume_per_tahun_awal": stats(["tahun_putusan_awal"]),
        "perkara_per_jenis_bbm": per_fuel(cases),
        "perkara_per_status_subsidi": stats(["status_subsidi"]),
        "perkara_per_provinsi": stats(["provinsi"], cases.withColumn("provinsi", F.coalesce("provinsi", F.lit("Tidak diketahui")))).orderBy(F.desc("perkara"), "provinsi"),
        "perkara_per_pasal_uu_migas": per_article(cases),
        "kelompok_kejadian_kemungkinan_sama": incident_summary(cases),
        "perkara_per_sumber_daftar": value_counts(cases, "sumber_daftar", "perkara"),
    }


#: what the method note counts: the chain, the file, frequency maps, missing values
NOTE = ("rantai_perkara", "file_pdf", ["tahun_putusan", "tingkat_persidangan", "sumber_daftar", "sumber_data", "relevan_bbm"], ["barang_bbm", "hasil_putusan", "nilai_kerugian_uang", "nilai_kerugian_volume", "tahun_kejadian"])


def stats_row(df: DataFrame, chain: str = NOTE[0], file: str = NOTE[1], freq: list = NOTE[2], missing: list = NOTE[3]) -> DataFrame:
    """One row of counts for the method note: rows, chains, files, missing values, frequency maps."""
    one = df.agg(F.count("*").alias("baris"), F.count_distinct(chain).alias("rantai_perkara"), F.count(file).alias("dengan_pdf"), *[F.count_if(F.col(c).isNull()).alias(f"na_{c}") for c in missing])
    for c in freq:
        m = df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(f"per_{c}"))
        one = one.crossJoin(m)  # one row by one row
    return one


def majority(df: DataFrame, key: str, v: str) -> DataFrame:
    """Values said at least max(2, a third of the most) times, else the single most frequent (smallest on ties)."""
    n = df.groupBy(key, v).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    n = n.withColumn("top", F.max("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), v)))
    n = n.withColumn("ok", F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("top") / 3))).withColumn("any", F.max("ok").over(w))
    return n.where("ok or (not any and rn = 1)").select(key, v, "n")


def agreement(pairs: DataFrame, a: str, b: str, tolerance: float | None = None) -> DataFrame:
    ok = F.col(a) == F.col(b) if tolerance is None else F.abs(F.col(a) - F.col(b)) <= tolerance * F.abs(F.col(b))
    return pairs.agg(F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("pairs"), F.avg(ok.cast("double")).alias("agreement"))


# -- evidence and review -----------------------------------------------------------------------


def evidence(records: DataFrame, texts: DataFrame) -> DataFrame:
    """Keyword evidence of every record by source: own text, quotes, texts of the chain, team table, coder's columns.

    texts: (file_pdf, text). An own text without any hit still decides."""
    hits = graph.cut(texts.select("file_pdf", R.keyword_hits("text").alias("h")).dropDuplicates(["file_pdf"]))
    # every step is dealt by the records' number, so that no task joins more rows than others at smaller sizes
    rows, dealt = records.count(), graph.spread
    r = dealt(records, rows, "file_pdf").join(dealt(hits.withColumnRenamed("h", "own"), rows, "file_pdf"), "file_pdf", "left")
    kinds = list(R.KEYWORDS)
    n = r.select("rantai_perkara", "no", F.explode("own").alias("k")).select("rantai_perkara", "no", "k.*")
    n = dealt(n, rows, "rantai_perkara")
    chain = n.groupBy("rantai_perkara", "kind").agg(F.sum("n").alias("t"))
    mine = n.groupBy("rantai_perkara", "no", "kind").agg(F.sum("n").alias("m"))
    sib = dealt(records.select("rantai_perkara", "no"), rows, "rantai_perkara").join(chain, "rantai_perkara").join(mine, ["rantai_perkara", "no", "kind"], "left").withColumn("n", F.col("t") - F.coalesce("m", F.lit(0))).where("n > 0")
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    sib = dealt(sib, 4 * rows, "no").groupBy("no").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "kind", "n"))), lambda x: F.struct(x["kind"].alias("kind"), x["n"].cast("int").alias("n"))).alias("sib"))
    r = dealt(r, 4 * rows, "no").join(sib, "no", "left")
    tab = F.coalesce(F.col("sumber_daftar").startswith("Tabulasi"), F.lit(False))
    quotes = F.coalesce(C.value("bukti_kutipan"), F.lit(""))
    coder = F.concat_ws(" ", *[C.value(c) for c in ("barang_bbm", "rincian_amar", "catatan", "keterangan_volume", "dasar_nilai_uang")])
    r = r.withColumn("quote", F.when(tab, F.expr("filter(own, x -> false)")).otherwise(R.keyword_hits(quotes))).withColumn("coder", R.keyword_hits(F.when(tab, F.concat_ws(" ", coder, quotes)).otherwise(coder)))
    some = lambda c: F.coalesce(F.size(F.col(c)) > 0, F.lit(False))
    pick = lambda f: F.when(F.col("own").isNotNull(), f("own", "teks PDF putusan")).when(some("quote"), f("quote", "kutipan verbatim (bukti_kutipan)")).when(some("sib"), f("sib", "teks PDF putusan lain dalam rantai")).when(some("coder") & tab, f("coder", "tabulasi tim (bukan teks putusan)")).when(some("coder"), f("coder", "kolom isian pengode saja"))
    basis = F.coalesce(pick(lambda c, t: F.lit(t)), F.lit("tidak ada"))
    kinds_hit = F.coalesce(pick(lambda c, t: F.transform(F.col(c), lambda x: x["kind"])), F.array().cast("array<string>"))
    return r.select("no", "nomor_putusan", basis.alias("dasar_bukti_kata_kunci"), F.nullif(F.array_join(kinds_hit, ", "), F.lit("")).alias("kata_kunci_ditemukan"), F.array_contains(kinds_hit, "BBM").alias("token_BBM_literal"), R.listed(F.col("own")).alias("kata_kunci_di_pdf"), R.listed(F.col("quote")).alias("kata_kunci_di_kutipan"), R.listed(F.col("sib")).alias("kata_kunci_di_pdf_rantai"), R.listed(F.col("coder")).alias("kata_kunci_di_isian_pengode"))


def apply_review(records: DataFrame, excluded: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept records renumbered 1..n, excluded list with the removed ones and their reason); 'uncertain' stays."""
    no = review.where("dataset = 'rekap' and final = 'no'").select("no", "alasan").dropDuplicates(["no"])
    kept = renumber(records.join(no, "no", "left_anti"), ["no", "nomor_putusan"])
    gone = records.join(no, "no").select("nomor_putusan", "pengadilan", "tingkat_persidangan", "tahun_putusan", "barang_bbm", "klasifikasi", "url_putusan", F.col("alasan").alias("alasan_dikeluarkan"))
    return kept.select(*records.columns), excluded.unionByName(gone, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def not_done(todo: DataFrame, done: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows without a partner in ``done``; on: (column of todo, column of done)."""
    d = done.select(*[F.col(b).alias(f"_d{i}") for i, (_, b) in enumerate(on)])
    return todo.join(d, reduce(lambda p, q: p & q, [F.col(a) == F.col(f"_d{i}") for i, (a, _) in enumerate(on)]), "left_anti")


def flag_listed(df: DataFrame, listed: DataFrame, on: tuple[str, str], out: str) -> DataFrame:
    """Whether a row's key is in a list."""
    hit = listed.select(F.col(on[1]).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return df.join(hit, F.col(on[0]) == F.col("_k"), "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def with_online(evidence: DataFrame, online: DataFrame) -> DataFrame:
    """Evidence with what a check of the site found for the same record."""
    return evidence.join(online, ["no", "nomor_putusan"], "left")


def crawl_relevance(over: DataFrame, texts: DataFrame) -> DataFrame:
    """Overviews (file_pdf, and texts of their own) with fuel mentions and relevance, from the file's text where it
    could be read, else from the overview: adds jenis_bbm_disebut, relevan_bbm_kandidat, dasar_relevansi."""
    own = F.concat_ws(" ", *[F.col(c) if c in over.columns else F.lit(None) for c in ("kata_kunci", "catatan_amar", "amar_lainnya", "abstrak", "judul")])
    t = texts.select("file_pdf", F.col("text").alias("_pdf")).where("_pdf is not null").dropDuplicates(["file_pdf"])
    d = over.join(t, "file_pdf", "left").withColumn("_t", F.coalesce("_pdf", own)).withColumn("_f", R.fuel_counts("_t"))
    basis = F.when(F.col("_pdf").isNotNull(), "teks PDF").otherwise("overview")
    d = d.select("*", F.nullif(R.listed(F.col("_f")), F.lit("")).alias("jenis_bbm_disebut"), R.relevance(F.col("_f"), "_t").alias("relevan_bbm_kandidat"), basis.alias("dasar_relevansi"))
    return d.drop("_pdf", "_t", "_f")


def final_record(checked: DataFrame, years: list[int]) -> DataFrame:
    """Relevant rulings of the years, by year, level and number, numbered 1..n."""
    r = checked.where(F.col("relevan_bbm").isin(*FINAL_RELEVANCE) & F.col("tahun_putusan").cast("int").isin(*years))
    r = r.withColumn("tahun_putusan", F.col("tahun_putusan").cast("int"))
    for c in ("nilai_kerugian_uang", "nilai_kerugian_volume"):
        if c in r.columns:
            r = r.withColumn(c, F.col(c).try_cast("double"))
    rest = [c for c in ("url_putusan",) if c in r.columns]
    out = renumber(r.drop("no"), ["tahun_putusan", "tingkat_persidangan", "nomor_putusan", *rest])
    return out.select("no", *[c for c in out.columns if c != "no"])


def fill_from_chain(rows: DataFrame, links: DataFrame, fields: list[str], audit: dict[str, str] | None = None) -> DataFrame:
    """Rows without a text borrow missing fields from linked rows that have one, lower courts first; links count both ways.

    rows: (id, has_text, prioritas, fields..); links: (dari_id, ke_id).  audit: field -> column that names where a
    borrowed value comes from (rows then need ``nomor_putusan``)."""
    both = links.select(F.col("dari_id").alias("id"), F.col("ke_id").alias("src")).union(links.select("ke_id", "dari_id")).where("id <> src").distinct()
    audit = audit or {}
    number = ["nomor_putusan"] if audit else []
    src = rows.where("has_text").select(F.col("id").alias("src"), F.col("prioritas").alias("_p"), *[F.col(c).alias(f"_{c}") for c in dict.fromkeys([*fields, *audit.values(), *number])])
    pick = {f: F.struct(*[f"_{c}" for c in dict.fromkeys([f, *([audit[f]] if f in audit else []), *number])]) for f in fields}
    got = both.join(src, "src").groupBy("id").agg(*[first_by(c, ["_p", "src"], ~C.is_na(f"_{f}")).alias(f"_g_{f}") for f, c in pick.items()])
    out = rows.join(got, "id", "left")
    own = {f: F.col("has_text") | ~C.is_na(f) for f in fields}
    filled = {f: F.when(F.col("has_text"), F.col(f)).otherwise(F.coalesce(C.value(f), F.col(f"_g_{f}._{f}"))) for f in fields}
    for f, a in audit.items():
        note = F.concat(F.coalesce(F.col(f"_g_{f}._{a}"), F.lit("")), F.lit(" (dari putusan terkait "), F.col(f"_g_{f}._nomor_putusan"), F.lit(")"))
        filled[a] = F.when(own[f] | F.col(f"_g_{f}").isNull(), F.col(a)).otherwise(note)
    return out.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in rows.columns])


def outcome_from_below(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rulings that follow an earlier one without quoting it take the outcome of the nearest lower court they are
    linked with.  rows: (id, nomor_putusan, prioritas, has_text, hasil_putusan, dasar_hasil)."""
    both = links.select(F.col("dari_id").alias("id"), F.col("ke_id").alias("src")).union(links.select("ke_id", "dari_id")).where("id <> src").distinct()
    src = rows.where("has_text and hasil_putusan is not null").select(F.col("id").alias("src"), F.col("prioritas").alias("_p"), F.struct("hasil_putusan", "nomor_putusan").alias("_v"))
    below = both.join(src, "src").join(rows.select("id", F.col("prioritas").alias("_own")), "id").where("_p < _own")
    got = below.groupBy("id").agg(F.min_by("_v", F.struct(-F.col("_p"), F.col("src"))).alias("_g"))
    out = rows.join(got, "id", "left")
    take = F.coalesce(F.col("hasil_putusan").isNull() & F.col("dasar_hasil").contains("ikut putusan sebelumnya") & F.col("_g").isNotNull(), F.lit(False))
    note = F.concat("dasar_hasil", F.lit("; hasil putusan sebelumnya (dari putusan terkait "), F.col("_g.nomor_putusan"), F.lit(")"))
    value = {"hasil_putusan": F.when(take, F.col("_g.hasil_putusan")).otherwise(F.col("hasil_putusan")), "dasar_hasil": F.when(take, note).otherwise(F.col("dasar_hasil"))}
    return out.select(*[value[c].alias(c) if c in value else F.col(c) for c in rows.columns])


def draft(df: DataFrame) -> DataFrame:
    """Record columns in their order; absent ones are null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in RECORD])
