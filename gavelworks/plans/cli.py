"""Command line: python -m gavelworks.plans.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rulings as R
from ..functions import web as W
from ..operators import graph, records, rules
from ..sources import pages, readers


def main(argv: list[str] | None = None, spark: SparkSession | None = None, client=None) -> int:
    p = argparse.ArgumentParser(prog="gavelworks")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {
        "check": ["pages"], "crawl": ["pages", "out"], "text": ["pdfs", "out"], "extract": ["texts", "out"], "validate": ["records", "out"],
        "analyze": ["records", "out"], "curate": ["records", "texts", "out"], "llm": ["texts", "out"],
    }.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(f"--{a}", required=True)
        s.add_argument("--excluded")
        s.add_argument("--review")
        s.add_argument("--candidates")
        s.add_argument("--limit", type=int)
        s.add_argument("--rebuild", action="store_true")
        s.add_argument("--places", help="CSV (provinsi, tempat) of further court places")
        s.add_argument("--online", help="table of site_evidence to join")
        s.add_argument("--pdf-texts", dest="pdf_texts", help="table (file_pdf, text) of read files")
        s.add_argument("--failures", help="table (url, galat) of pages that could not be had")
        s.add_argument("--queue", help="table (url) of pages not yet read")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("gavelworks").getOrCreate()
    some = lambda df: df.limit(a.limit) if a.limit else df
    if a.command == "check":
        o = pages.overviews(some(readers.read_pages(spark, a.pages)))
        o.select(*[F.count_if(F.col("meta")[v].isNull()).alias(v) for v in pages.LABELS.values()]).show()
    elif a.command == "crawl":
        src = readers.read_pages(spark, a.pages).where(~W.blocked("html"))
        o = pages.overviews(some(src)).withColumn("id", F.coalesce("id", F.regexp_extract("url", r"([0-9a-z]+)\.html$", 1)))
        # of pages saved twice the one whose address comes last, the same on every run
        o = graph.cut(records.top_by(o, ["id"], ["url"]))
        e = pages.edges(o)
        year = C.record_year(F.col("meta")["tanggal_dibacakan"], F.col("meta")["tanggal_musyawarah"], F.col("meta")["tahun"])
        chain = graph.chains(o.select("id", year.alias("year")), e)
        d = o.join(chain, "id").select(F.col("meta")["nomor"].alias("nomor_putusan"), F.col("meta")["lembaga_peradilan"].alias("pengadilan"), F.col("meta")["tingkat_proses"].alias("tingkat_proses"), F.col("meta")["tanggal_dibacakan"].alias("tanggal_putusan"), year.alias("tahun_putusan"), F.col("lampiran").alias("lampiran_pdf"), F.col("chain").alias("rantai_perkara"), F.col("url").alias("url_putusan"))
        flat = o.select("id", "url", "lampiran", "pdf_url", F.regexp_extract("pdf_url", r"([^/]+)$", 1).alias("file_pdf"), *[F.col("meta")[k].alias(k) for k in pages.LABELS.values() if k != "id"])
        seen = spark.read.parquet(a.pdf_texts) if a.pdf_texts else spark.createDataFrame([], "file_pdf string, text string")
        reached = graph.frontier(spark, o.select(F.col("id").alias("node")), e.select(F.col("dari_id").alias("a"), F.col("ke_id").alias("b")))
        queue = reached.where("level > 0").select(F.col("node").alias("id"))
        if a.queue:
            queue = queue.union(spark.read.parquet(a.queue).select(W.ruling_id("url"))).distinct()
        failed = spark.read.parquet(a.failures) if a.failures else readers.read_pages(spark, a.pages).where(W.blocked("html")).select("url", F.lit("CAPTCHA").alias("galat"))
        tables = {"overview": records.crawl_relevance(flat, seen), "terkait": e, "rekap_draft": records.draft(d), "antrean_tersisa": records.not_done(queue, o, [("id", "id")]), "gagal": failed}
        for n, df in tables.items():
            df.write.mode("overwrite").parquet(f"{a.out}/{n}")
    elif a.command == "text":
        t = readers.pdf_texts(some(readers.read_pdfs(spark, a.pdfs)))
        t.withColumn("text", C.clean_text("text")).write.mode("overwrite").parquet(a.out)
    elif a.command == "extract":
        build = lambda: R.candidates(some(readers.read_texts(spark, a.texts)).withColumn("text", C.clean_text("text")))
        readers.candidate_view(spark, build, a.out, a.rebuild)
    elif a.command == "validate":
        r = readers.read_records(spark, a.records)
        ex = readers.read_raw(spark, a.excluded) if a.excluded else None
        i = rules.validate(r, ex, None, spark.read.parquet(a.candidates) if a.candidates else None)
        # the rules run once, while their issues are written
        counts, code = readers.write_validation(rules.ordered(i), f"{a.out}/laporan_validasi")
        text, _ = readers.validation_report(spark.read.parquet(f"{a.out}/laporan_validasi"), counts)
        print(text)
        print(readers.stats_json(records.stats_row(r)))
        return code
    elif a.command == "analyze":
        gaz = records.gazetteer(spark, more=spark.read.option("header", True).csv(a.places) if a.places else None)
        kept, _ = records.dedupe_decisions(readers.read_records(spark, a.records))
        d = graph.cut(records.prepare(kept, gaz))
        cases = graph.cut(records.with_incidents(records.case_level(d, spark.read.parquet(a.candidates) if a.candidates else None, gaz)))
        cases.write.mode("overwrite").parquet(f"{a.out}/rekap_perkara_unik")
        for n, t in records.summaries(d, cases).items():
            t.write.mode("overwrite").parquet(f"{a.out}/{n}")
            print(f"\n### {n}\n\n{readers.markdown(t)}")
    elif a.command == "curate":
        r = readers.read_records(spark, a.records)
        ev = records.evidence(r, readers.read_texts(spark, a.texts))
        if a.online:
            ev = records.with_online(ev, spark.read.parquet(a.online))
        ev.write.mode("overwrite").parquet(f"{a.out}/bukti")
        if a.review:
            ex = readers.read_raw(spark, a.excluded) if a.excluded else spark.createDataFrame([], "nomor_putusan string")
            kept, gone = records.apply_review(r, ex, spark.read.option("header", True).option("inferSchema", False).schema("dataset string, no int, final string, alasan string").csv(a.review))
            kept.write.mode("overwrite").parquet(f"{a.out}/rekap")
            gone.write.mode("overwrite").parquet(f"{a.out}/dikeluarkan")
    elif a.command == "llm":
        if client is None:
            print("llm: no client was given", file=sys.stderr)
            return 2
        from .coder import code_texts

        code_texts(some(readers.read_texts(spark, a.texts)), client, "Kodekan putusan ini", "model").write.mode("append").json(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
