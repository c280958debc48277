"""Tables read from pages in SQL: ``SELECT ... FROM pages, LATERAL ruling_fields(html, url, 'nomor,amar')``.

``ruling_fields`` gives one row a page with the labels that are asked for as columns; ``listing_rows`` one row an
entry of a listing; ``related_rows`` one row a related ruling.  A null page gives a row of nulls from the first and no
rows from the others.  The columns of ``ruling_fields`` are worked out when the query is planned (``analyze``), so an
unknown label is an error of the query, not of a task.  Rows go to Python and back pickled: with Arrow each call of
``eval`` makes a table of its own, which takes longer than reading the page.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..shipping import ship
from . import pages as P

#: columns besides the labels of the overview table
OTHERS = ("id", "pdf_url", "zip_url", "lampiran")


class RulingFields:
    def __init__(self, analysis: AnalyzeResult | None = None):
        self.names = [f.name for f in analysis.schema.fields] if analysis else []

    @staticmethod
    def analyze(html: AnalyzeArgument, url: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(names.value, str):
            raise ValueError("the labels must be a constant text")
        known, schema = {*P.LABELS.values(), *OTHERS}, StructType()
        for n in (x.strip() for x in names.value.split(",")):
            if n not in known:
                raise ValueError(f"no such label: {n}")
            schema = schema.add(n, StringType())
        return AnalyzeResult(schema)

    def eval(self, html: str, url: str, names: str) -> Iterator[tuple]:
        got = P.overview(html, url or "", related_too=False) if html is not None else {"meta": {}}
        yield tuple(got.get(n) if n in OTHERS else got["meta"].get(n) for n in self.names)


class ListingRows:
    def eval(self, html: str) -> Iterator[tuple]:
        for k, e in enumerate(P.listing(html)):
            yield k + 1, e["id"], e["url"], e["judul"], e["teks_entri"], e["tanggal_putus"]


class RelatedRows:
    def eval(self, html: str, url: str) -> Iterator[tuple]:
        for e in P.overview(html, url or "", fields=False)["terkait"]:
            yield e["id"], e["label"]


def register(spark: SparkSession) -> None:
    """Make the three functions known to SQL."""
    ship(spark)
    listing = StructType().add("urutan", IntegerType())
    for n in ("id", "url", "judul", "teks_entri", "tanggal_putus"):
        listing = listing.add(n, StringType())
    spark.udtf.register("ruling_fields", udtf(RulingFields, useArrow=False))
    spark.udtf.register("listing_rows", udtf(ListingRows, returnType=listing, useArrow=False))
    spark.udtf.register("related_rows", udtf(RelatedRows, returnType="id string, label string", useArrow=False))
