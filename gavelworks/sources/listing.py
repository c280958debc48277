"""Listing pages as a data source: ``spark.read.format("listing")`` over a store that all executors share.

A listing is read page by page for every year.  Partitions are ranges of ``span`` pages of one year, and filters on
``tahun`` and ``halaman`` are pushed down: a range that can't hold a wanted page is never planned.  The store keeps one
Parquet file (a pack) for every range, ``<store>/<listing>/tahun=2021/00000.parquet``, written aside and moved into
place by the one task whose range it is, so that tasks don't get into each other's way and a lost executor's range is
read again from what is there.  Any file system that pyarrow knows will do (a path or a URI).

Options: ``store``; ``listing`` (address of its first page); ``years`` ("2020-2026", default: those of the store);
``pages`` (most pages of a year, default: those of the store); ``span`` (50); ``opener`` ("package.module:function",
address -> (status, headers, body); without it nothing is requested); ``hours`` (24: older pages are asked for again);
``delay``, ``attempts`` (see ``pages.fetch``).

Rows: tahun, halaman, alamat, html, diambil (seconds since 1970), galat.  A page that can't be had or isn't a listing
is a row with its error and no html, and isn't kept; pages behind the last one that page 1 links to are not asked for.
"""

from __future__ import annotations

import importlib
import io
import re
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..shipping import ship
from . import pages as P

SCHEMA = "tahun int, halaman int, alamat string, html string, diambil double, galat string"
_PACK = pa.schema([("halaman", pa.int32()), ("alamat", pa.string()), ("html", pa.string()), ("diambil", pa.float64())])
SPAN = 50
_FAULTS = re.compile("captcha|database error|a php error|fatal error|uncaught exception|service unavailable", re.I)


def base(url: str) -> str:
    """Address of a listing without its page."""
    return re.sub(r"/page/\d+\.html$", ".html", url)


def address(url: str, year: int, page: int) -> str:
    """Address of a page of a listing's year."""
    stem = base(url).removesuffix(".html") + f"/tahunjenis/putus/tahun/{year}"
    return f"{stem}.html" if page <= 1 else f"{stem}/page/{page}.html"


class Store:
    """Packs of listing pages in a shared folder."""

    def __init__(self, root: str, listing: str):
        from pyarrow import fs

        self.fs, path = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else "file://" + root)
        self.file, self.dir = fs.FileType, fs.FileSelector
        self.root = f"{path.rstrip('/')}/{re.sub('[^A-Za-z0-9]+', '_', re.sub('^https?://', '', base(listing)))[:150]}"

    def path(self, year: int, k: int) -> str:
        return f"{self.root}/tahun={year}/{k:05d}.parquet"

    def read(self, year: int, k: int) -> dict[int, tuple]:
        """halaman -> (alamat, html, diambil) of a pack; a missing one is empty."""
        path = self.path(year, k)
        if self.fs.get_file_info(path).type != self.file.File:
            return {}
        with self.fs.open_input_file(path) as f:
            rows = pq.read_table(f).to_pylist()
        return {r["halaman"]: (r["alamat"], r["html"], r["diambil"]) for r in rows}

    def write(self, year: int, k: int, pages: dict[int, tuple]) -> None:
        path = self.path(year, k)
        rows = [{"halaman": p, "alamat": a, "html": h, "diambil": t} for p, (a, h, t) in sorted(pages.items())]
        body = io.BytesIO()
        pq.write_table(pa.Table.from_pylist(rows, _PACK), body)
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex[:8]}.part"
        with self.fs.open_output_stream(part) as f:
            f.write(body.getvalue())
        self.fs.move(part, path)

    def packs(self) -> list[tuple[int, int]]:
        """(year, number) of all packs."""
        if self.fs.get_file_info(self.root).type != self.file.Directory:
            return []
        found = self.fs.get_file_info(self.dir(self.root, recursive=True))
        named = (re.search(r"tahun=(\d+)/(\d+)\.parquet$", i.path) for i in found)
        return sorted((int(m[1]), int(m[2])) for m in named if m)


class Range(InputPartition):
    def __init__(self, year: int, k: int):
        super().__init__((year, k))
        self.year, self.k = year, k


#: filters that are pushed: what keeps a value, and whether a range of values may hold one that is kept
_TESTS = {
    EqualTo: (lambda x, v: x == v, lambda a, b, v: a <= v <= b),
    In: (lambda x, v: x in v, lambda a, b, v: any(a <= x <= b for x in v)),
    GreaterThan: (lambda x, v: x > v, lambda a, b, v: b > v),
    GreaterThanOrEqual: (lambda x, v: x >= v, lambda a, b, v: b >= v),
    LessThan: (lambda x, v: x < v, lambda a, b, v: a < v),
    LessThanOrEqual: (lambda x, v: x <= v, lambda a, b, v: a <= v),
}


class ListingReader(DataSourceReader):
    def __init__(self, options):
        self.o, self.filters = dict(options), []
        self.span = int(self.o.get("span", SPAN))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("tahun",), ("halaman",)):
                self.filters.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f

    def _tests(self, column: str):
        by_name = {k.__name__: v for k, v in _TESTS.items()}
        return [(*by_name[kind], v) for c, kind, v in self.filters if c == column]

    def partitions(self) -> list[Range]:
        kept = Store(self.o["store"], self.o["listing"]).packs()
        if "years" in self.o:
            low, _, high = self.o["years"].partition("-")
            years = list(range(int(low), int(high or low) + 1))
        else:
            years = sorted({y for y, _ in kept})
        years = [y for y in years if all(keep(y, v) for keep, _, v in self._tests("tahun"))]
        if "pages" in self.o:
            ranges = {(y, k) for y in years for k in range(-(-int(self.o["pages"]) // self.span))}
        else:
            ranges = {(y, k) for y, k in kept if y in set(years)}
        first = lambda k: k * self.span + 1
        fit = [(y, k) for y, k in sorted(ranges) if all(may(first(k), first(k + 1) - 1, v) for _, may, v in self._tests("halaman"))]
        return [Range(y, k) for y, k in fit] or [Range(0, -1)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.k < 0:
            return
        store, rows, wanted = Store(self.o["store"], self.o["listing"]), [], self._tests("halaman")
        kept = store.read(part.year, part.k)
        if "opener" in self.o:
            rows = self._refresh(store, part, kept)
        for p, (url, html, at) in sorted(kept.items()):
            rows.append((part.year, p, url, html, at, None))
        rows = sorted(r for r in rows if all(keep(r[1], v) for keep, _, v in wanted))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split(" ")[0] for f in SCHEMA.split(", ")])

    def _get(self, url: str) -> str:
        module, _, name = self.o["opener"].partition(":")
        opener = getattr(importlib.import_module(module), name)
        body = P.fetch(url, opener, time.sleep, int(self.o.get("attempts", 5)), float(self.o.get("delay", 3.0)))
        html = body.decode("utf-8", "replace")
        if _FAULTS.search(html[:200_000]):
            raise ValueError("blocked or faulty page")
        return html

    def _refresh(self, store: Store, part: Range, kept: dict[int, tuple]) -> list[tuple]:
        """Ask for what is missing or old in a range; rows of what could not be had."""
        listing, failed, changed = self.o["listing"], [], False
        old = time.time() - float(self.o.get("hours", 24)) * 3600
        fresh = lambda page: page is not None and page[2] >= old
        first = (kept if part.k == 0 else store.read(part.year, 0)).get(1)
        start = address(listing, part.year, 1)
        try:
            if not fresh(first):
                first = (start, self._get(start), time.time())
                if part.k == 0:
                    kept[1], changed = first, True
        except (RuntimeError, ValueError) as e:
            # without page 1 no one knows how many there are
            return [(part.year, part.k * self.span + 1, start, None, None, str(e))]
        last = min(P.last_page(first[1], start), int(self.o.get("pages", 1 << 30)))
        for p in range(part.k * self.span + 1, min(last, (part.k + 1) * self.span) + 1):
            if fresh(kept.get(p)):
                continue
            url = address(listing, part.year, p)
            try:
                kept[p], changed = (url, self._get(url), time.time()), True
            except (RuntimeError, ValueError) as e:
                failed.append((part.year, p, url, None, None, str(e)))
                kept.pop(p, None)
        if changed:
            store.write(part.year, part.k, kept)
        return failed


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("listing")`` known, with its filters pushed down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListingSource)


def pack(pages: DataFrame, store: str, listing: str, span: int = SPAN) -> DataFrame:
    """Write pages (tahun, halaman, alamat, html, diambil) into a store; returns (tahun, k, n) of the packs.

    Each pack is written by one task and holds ``span`` pages at most; of repeated pages the one fetched last stays."""
    ship(pages.sparkSession)
    rows = pages.select("tahun", "halaman", "alamat", "html", F.col("diambil").cast("double").alias("diambil"), F.floor((F.col("halaman") - 1) / span).cast("int").alias("k"))

    def run(batches):
        to, now, held = Store(store, listing), None, {}

        def done():
            merged = to.read(*now) | held
            to.write(*now, merged)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([len(merged)], pa.int64())], names=["tahun", "k", "n"])

        for rb in batches:
            for r in rb.to_pylist():
                if (r["tahun"], r["k"]) != now:
                    if now is not None:
                        yield done()
                    now, held = (r["tahun"], r["k"]), {}
                held[r["halaman"]] = (r["alamat"], r["html"], r["diambil"])
        if now is not None:
            yield done()

    return rows.repartition("tahun", "k").sortWithinPartitions("tahun", "k", "halaman", "diambil").mapInArrow(run, "tahun int, k int, n long")


def read(spark: SparkSession, store: str, listing: str, **options) -> DataFrame:
    register(spark)
    r = spark.read.format("listing").option("store", store).option("listing", listing)
    for k, v in options.items():
        r = r.option(k, str(v))
    return r.load()
