"""Resumable crawl state: which pages were read, which wait to be read, and which must be read again.

Every page that arrives is a reading of its own id and a mention of the ids it links to.  A stateful operator keyed by
id holds the visited map (id -> when it was read) and the frontier (ids mentioned, not read), and a timer for pages
that expire, as listings do after a day.  It writes a log of changes: ``antre`` (an id joins the frontier), ``dibaca``
(it is read, once, however often it arrives) and ``basi`` (it has expired and is back in the frontier).  The state is
in the checkpoint: a stream that is stopped goes on where it was, and no page is read again.

Mentions are made distinct before the shuffle, per page and per batch of rows, so that a page everything links to is
not a row per link.

Timers follow the watermark of the arrival (``arrived``, by default the clock of the batch), not of the reading: a
page that was read long ago and arrives now is not late, it has merely expired sooner.

Defined cases: null ids, links and link lists are left out; a page without a time counts as of 1970; a page that is
read and mentioned in one batch is read; repeated rows change nothing; other columns are ignored.
"""

from __future__ import annotations

import datetime as dt
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..shipping import ship

# the worker that asks the operator for its state reads no shipped files: the class goes with the query
cloudpickle.register_pickle_by_value(sys.modules[__name__])
LOG = "id string, status string, pada timestamp"
HOURS = 24
_EPOCH = dt.datetime(1970, 1, 1)


def page_id(url) -> Column:
    """Host and path of an address: scheme, query, fragment and a last slash don't tell pages apart."""
    return F.regexp_replace(F.regexp_replace(F.col(url) if isinstance(url, str) else url, "^[A-Za-z]+://", ""), r"[?#].*$|/$|/[?#].*$", "")


def linked_ids(url, html) -> Column:
    """Ids of the addresses on the page's own host that it links to."""
    host = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1)
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r"<a\s[^>]*href=\"(/[^\"#?]*)"), F.lit(1)))
    return F.transform(F.filter(found, lambda h: h != "/"), lambda h: F.concat(host, F.regexp_replace(h, "/$", "")))


def mentions(pages: DataFrame) -> DataFrame:
    """(id, dibaca, kedaluwarsa, pada, tiba) of pages (id, links, expires, at and perhaps arrived): one row for the page,
    one for each link."""
    arrived = F.coalesce("arrived", F.current_timestamp()) if "arrived" in pages.columns else F.current_timestamp()
    own = F.struct(F.col("id").alias("id"), F.lit(True).alias("dibaca"), F.coalesce("expires", F.lit(False)).alias("kedaluwarsa"))
    others = F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda i: F.struct(i.alias("id"), F.lit(False).alias("dibaca"), F.lit(False).alias("kedaluwarsa")))
    x = pages.select(F.coalesce("at", F.lit(_EPOCH)).alias("pada"), arrived.alias("tiba"), F.explode(F.array_union(F.array(own), others)).alias("m"))
    x = x.select("m.*", "pada", "tiba").where("id is not null")

    def once(batches):
        for pdf in batches:
            yield pdf.sort_values("pada").drop_duplicates(["id", "dibaca"])

    return x.mapInPandas(once, x.schema)


class Frontier(StatefulProcessor):
    """State of one id."""

    def __init__(self, hours: float = HOURS):
        self.hours = hours

    def init(self, handle) -> None:
        self.handle = handle
        self.read_at = handle.getValueState("dibaca", "pada timestamp")
        self.waits = handle.getValueState("antre", "sejak timestamp")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows))
        reads = pdf[pdf["dibaca"]]
        if len(reads) and not self.read_at.exists():
            first = reads.sort_values("pada").iloc[0]
            self.read_at.update((first["pada"],))
            self.waits.clear()
            if first["kedaluwarsa"]:
                self.handle.registerTimer(int((first["pada"] + dt.timedelta(hours=self.hours)).timestamp() * 1000))
            yield self._row(key, "dibaca", first["pada"])
        elif not len(reads) and not self.read_at.exists() and not self.waits.exists():
            at = pdf["pada"].min()
            self.waits.update((at,))
            yield self._row(key, "antre", at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.timezone.utc).replace(tzinfo=None)
        self.read_at.clear()
        self.waits.update((at,))
        yield self._row(key, "basi", at)

    def _row(self, key, status: str, at) -> pd.DataFrame:
        return pd.DataFrame({"id": [key[0]], "status": [status], "pada": [at]})

    def close(self) -> None:
        pass


def frontier_stream(pages: DataFrame, hours: float = HOURS, delay: str = "1 hour") -> DataFrame:
    """The log of changes of a stream of pages (id, links array, expires boolean, at timestamp and perhaps arrived)."""
    ship(pages.sparkSession)
    m = mentions(pages).withWatermark("tiba", delay)
    return m.groupBy("id").transformWithStateInPandas(Frontier(hours), LOG, "Append", "EventTime")


def run(pages: DataFrame, log: str, checkpoint: str, hours: float = HOURS, delay: str = "1 hour") -> None:
    """Read all that has arrived and stop; run it again, after a crash or later, to go on.  The log is Parquet."""
    spark = pages.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = frontier_stream(pages, hours, delay).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(provider, before)


def status(spark: SparkSession, log: str) -> DataFrame:
    """(id, status, pada) as it stands: the last change of every id."""
    rank = F.when(F.col("status") == "antre", 0).when(F.col("status") == "basi", 1).otherwise(2)
    last = F.max_by(F.struct("status", "pada"), F.struct("pada", rank))
    return spark.read.schema(LOG).parquet(log).groupBy("id").agg(last.alias("s")).select("id", "s.status", "s.pada")
