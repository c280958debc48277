"""Readers and writers: record CSV, raw CSV, texts, saved pages, PDFs, JSON lines, reports."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import columns as C
from ..functions import web as W
from ..functions.lexicon import CLEAN_VERSION, RECORD, RECORD_TYPES
from ..shipping import ship

RECORD_SCHEMA = ", ".join(f"{c} {RECORD_TYPES.get(c, 'string')}" for c in RECORD)
#: severities of issues, worst first
LEVELS = ("galat", "peringatan", "info")
_SENTINEL = "\u0001none\u0001"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Decision records with NA as null; the event year stays text."""
    return spark.read.schema(RECORD_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "NA").csv(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every cell as text, 'NA' and '' kept."""
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    schema = StructType([StructField(n, StringType()) for n in names])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", _SENTINEL).option("emptyValue", "").csv(path).na.fill("")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "NA").csv(path)


def write_csv_file(df: DataFrame, path: str) -> None:
    """One CSV file with a byte order mark, for summary tables that people open."""
    _small(df).toPandas().to_csv(path, index=False, encoding="utf-8-sig", na_rep="NA")


def _small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The table itself if a count shows it to be fit for people; else ValueError, nothing is cut off."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: write a table instead")
    return df


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages of a folder: (url = file, html)."""
    return spark.read.option("pathGlobFilter", "*.html").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(F.concat(F.lit("pdf/"), F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.txt$", ".pdf")).alias("file_pdf"), F.col("value").alias("text"))


def read_pdfs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """PDFs of a folder or a list of files, by path: (path, key of stem, content hash and cleaning version, content)."""
    r = spark.read.format("binaryFile")
    b = r.option("pathGlobFilter", "*.pdf").load(path) if isinstance(path, str) else r.load(path)
    stem = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
    key = F.concat_ws(".", stem, F.substring(F.sha1("content"), 1, 12), F.lit(f"v{CLEAN_VERSION}"))
    return b.select("path", key.alias("key"), "content").orderBy("path")


def candidate_view(spark: SparkSession, build, path: str, rebuild: bool = False) -> DataFrame:
    """The table at ``path``, built by ``build()`` where it isn't there yet or ``rebuild`` asks for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    if rebuild or not there:
        swap(build(), path)
    return spark.read.parquet(path)


def swap(df: DataFrame, path: str, write=None) -> None:
    """Rewrite a table that may be read by df itself: written aside (default: Parquet), then put in its place."""
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.part"
    (write or (lambda d, to: d.write.parquet(to)))(df, aside)
    new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x) for x in (aside, path))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"could not put {aside} in place of {path}")
    spark.catalog.refreshByPath(path)


def write_raw(df: DataFrame, path: str) -> None:
    """Rewrite a raw CSV in place, cells as they are."""
    swap(df, path, lambda d, to: d.write.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(to))


def pdf_texts(pdfs: DataFrame, extract=None, done: DataFrame | None = None) -> DataFrame:
    """(path, key, text, galat): texts of PDFs not done before; ``extract`` maps bytes to pages (default: pypdf, if there)."""
    ship(pdfs.sparkSession)
    todo = pdfs if done is None else pdfs.join(done.select("key"), "key", "left_anti")

    def run(batches):
        for pdf in batches:
            texts, errors = [], []
            for content in pdf["content"]:
                try:
                    fn = extract or _pypdf
                    texts.append("\n".join(fn(content)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a broken file is a row with its error
                    texts.append(None)
                    errors.append(str(e))
            yield pdf[["path", "key"]].assign(text=texts, galat=errors)

    return todo.select("path", "key", "content").mapInPandas(run, "path string, key string, text string, galat string")


def _pypdf(content: bytes) -> list[str]:
    import io

    from pypdf import PdfReader  # optional

    return [p.extract_text(orientations=(0,)) or "" for p in PdfReader(io.BytesIO(content)).pages]


def lines_of_words(words: DataFrame) -> DataFrame:
    """(page, line, text) from words with coordinates (page, x, y, height, word): odd heights dropped, a gap over 3 starts a line."""
    from ..operators.records import islands

    d = islands(words.where("height >= 5 and height < 17"), ["page"], ["y", "x"], "y", 3, "line")
    return d.groupBy("page", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word"))), lambda x: x["word"]), " ").alias("text"))


def read_jsonl_latest(spark: SparkSession, path: str, schema: str, key: str = "_key", order: str | None = None) -> DataFrame:
    """Last record of each key of appended JSON lines: by ``order`` if given, else by the number of the append that
    ``append_jsonl`` writes (lines without one are older), then by the files' times and the lines in them."""
    d = spark.read.schema(f"{schema}, {SEQUENCE} long").json(path)
    m = "_metadata."
    at = [order] if order else [F.coalesce(SEQUENCE, F.lit(0)), f"{m}file_modification_time", f"{m}file_path", f"{m}file_block_start"]
    d = d.select("*", F.struct(*at, F.monotonically_increasing_id().alias("_i")).alias("_at"))
    return d.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at")))).where("_rn = 1").drop("_rn", "_at", SEQUENCE)


#: column of appended JSON lines: the time of the append in nanoseconds, always later than the writer's last one
SEQUENCE = "_urut"
_LAST_APPEND = [0]


def append_jsonl(df: DataFrame, path: str) -> None:
    _LAST_APPEND[0] = max(time.time_ns(), _LAST_APPEND[0] + 1)
    df.withColumn(SEQUENCE, F.lit(_LAST_APPEND[0])).write.mode("append").json(path)


def search_pages(spark: SparkSession, keywords: list[str] | DataFrame, years: list[int], pages: int) -> DataFrame:
    """Keyword (a list, or a table with ``kata``) x year x page requests."""
    k = keywords if isinstance(keywords, DataFrame) else spark.createDataFrame([(x,) for x in keywords], "kata string")
    y = k.select("kata", F.explode(F.array(*[F.lit(x) for x in years])).alias("tahun"))
    return y.select("kata", "tahun", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("halaman"))


def category_pages(categories: DataFrame, years: list[int], pages: int) -> DataFrame:
    """(url of the category, tahun, halaman, alamat): category x year x page requests."""
    y = categories.select("url", F.explode(F.array(*[F.lit(x) for x in years])).alias("tahun"))
    p = y.select("url", "tahun", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("halaman"))
    return p.withColumn("alamat", W.page(W.by_year("url", F.col("tahun")), "halaman"))


def final_outputs(checked: DataFrame, failures: DataFrame, years: list[int], out: str) -> None:
    """All checked rulings, the final record, the list of addresses and the log of failures."""
    from ..operators import records

    for name, df in {
        "semua_diperiksa": checked, "rekap": records.final_record(checked, years), "daftar_url": checked.select("url_putusan").where("url_putusan is not null").distinct(),
        "log_gagal": failures.select("url", "galat"),
    }.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def url_id(c):
    return F.regexp_extract(C.col(c), r"/putusan/([0-9a-z]+)\.html", 1)


def markdown(df: DataFrame) -> str:
    """A small table as Markdown, numbers with dots between thousands."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    rows = _small(df).select(*[C.thousands(c).alias(c) if c in floats else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(r) + " |" for r in rows)])


def write_validation(issues: DataFrame, path: str) -> tuple[dict[str, int], int]:
    """Write the issue table; (issues by severity, exit code 1 if there is an error), counted while it is written."""
    seen = Observation("validasi")
    counts = [F.count_if(F.col("tingkat") == level).alias(level) for level in LEVELS]
    issues.observe(seen, *counts).write.mode("overwrite").parquet(path)
    got = {level: int(seen.get[level] or 0) for level in LEVELS}
    return got, int(got["galat"] > 0)


def validation_report(issues: DataFrame, counts: dict[str, int] | None = None) -> tuple[str, int]:
    """(Markdown by severity, exit code 1 if there is an error); ``counts``: as ``write_validation`` found them."""
    out, errors = ["# Laporan validasi"], 0
    for level in LEVELS:
        part = issues.where(F.col("tingkat") == level).orderBy(F.col("no").asc_nulls_last(), "kolom")
        n = part.count() if counts is None else counts[level]
        errors += n if level == "galat" else 0
        out.append(f"\n## {level} ({n})\n\n{markdown(part)}" if n else f"\n## {level} (0)")
    return "\n".join(out), int(errors > 0)


def stats_json(row: DataFrame) -> str:
    return json.dumps(json.loads(row.select(F.to_json(F.struct("*")).alias("j")).first()["j"]), ensure_ascii=False, indent=2)
