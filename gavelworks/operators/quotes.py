"""Quotes in a corpus by an inverted index: every text that holds a quote, however many texts there are.

Texts and quotes are compared by their letters and digits in lower case (``bare``).  From every stretch of ``WINDOW``
successive q-grams the one of least hash is kept (winnowing), so a text and a quote share every gram that is kept
within the quote: a text that holds it is never missed.  Of a quote's kept grams the one in the fewest texts is looked
up in the posting lists, and each text found is then searched for the quote itself.

A part of a quote must have ``SHORTEST`` characters or more.  Quotes are indexed by length class, so that long ones
use long, rare grams and few of them; a text is indexed only for the classes that are asked for.

Defined cases: null texts and quotes hold nothing; a quote whose parts are all too short is found nowhere (``parts``
is empty); a quote in parts (`...`, `…` or `|` between) is found where all its parts are; repeated quotes and rows with
equal ids are taken as one by ``found``; an empty corpus or no quotes give an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..shipping import ship
from . import graph

#: letters and digits a part of a quote needs
SHORTEST = 12
#: least length of a class and its gram; a window of ``least - gram + 1`` grams lies in every quote of the class
CLASSES = [(48, 24), (24, 12), (SHORTEST, 6)]
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def parts(c) -> Column:
    """The bare parts of a quote that are long enough, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(C.col(c), r"\.{3}|…|\|"), C.bare), lambda p: F.length(p) >= SHORTEST))


def winnowed(text: str, gram: int, window: int) -> np.ndarray:
    """Hashes of the kept grams: of every ``window`` successive grams the least one.  A text shorter than a window
    keeps its least gram only; one shorter than a gram none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - gram + 1
    if n <= 0:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(gram):
            h = h * _BASE + codes[k : k + n] + np.uint64(1)
        h = (h ^ (h >> np.uint64(29))) * _MIX
        h ^= h >> np.uint64(32)
    # least value of every window by doubling: after k rounds each place holds the least of the next 2**k
    low, span = h, 1
    while span < min(window, n):
        step = min(span, min(window, n) - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    return np.unique(low).astype(np.int64)


def _grams(df: DataFrame, keep: list[str], classes: list[int]) -> DataFrame:
    """df's ``keep`` columns with (least, gram) for every kept gram of ``_bare`` in the given classes."""
    ship(df.sparkSession)
    shape = dict(CLASSES)

    def run(batches):
        for rb in batches:
            texts = rb.column(rb.num_columns - 1).to_pylist()
            for least in classes:
                gram = shape[least]
                found = [winnowed(t, gram, least - gram + 1) if t else np.empty(0, np.int64) for t in texts]
                at = np.repeat(np.arange(len(texts)), [len(f) for f in found])
                cols = [c.take(pa.array(at)) for c in rb.columns[:-1]]
                hashes = np.concatenate(found) if found else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(at), least, np.int32)), pa.array(hashes)], names=[*rb.schema.names[:-1], "least", "gram"])

    src = df.select(*keep, "_bare")
    return src.mapInArrow(run, StructType([f for f in src.schema.fields if f.name != "_bare"] + StructType.fromDDL("least int, gram long").fields))


def found(docs: DataFrame, quotes: DataFrame, doc_id: str, text: str, quote_id: str, quote: str) -> DataFrame:
    """(doc_id, quote_id) of every text that holds every part of a quote; both ids are named as given."""
    spark = docs.sparkSession
    hay = docs.select(F.col(doc_id).alias("_doc"), C.bare(text).alias("_bare")).where("_bare <> ''")
    each = graph.cut(quotes.select(F.col(quote_id).alias("_q"), F.explode(parts(quote)).alias("_bare")).distinct().withColumn("_of", F.count("*").over(Window.partitionBy("_q"))))
    n = F.length("_bare")
    least = F.lit(CLASSES[-1][0])
    for floor, _ in reversed(CLASSES[:-1]):
        least = F.when(n >= floor, F.lit(floor)).otherwise(least)
    each = each.withColumn("_least", least)
    asked = [r[0] for r in each.select("_least").distinct().collect()]  # of the three classes
    if not asked:
        return spark.createDataFrame([], StructType([docs.select(doc_id).schema[0], quotes.select(quote_id).schema[0]]))
    needles = each.select(F.struct("_q", "_bare").alias("_part"), "_least", "_bare")
    keys = graph.cut(_grams(needles, ["_part", "_least"], asked).where("least = _least").select("_part", "least", "gram"))
    # posting lists of the grams that any quote keeps
    wanted = keys.select("least", "gram").distinct()
    lists = graph.cut(_grams(hay, ["_doc"], asked).join(wanted, ["least", "gram"], "left_semi"))
    length = lists.groupBy("least", "gram").agg(F.count("*").alias("_texts"))
    rare = keys.join(length, ["least", "gram"], "left").groupBy("_part").agg(F.min_by(F.struct("least", "gram"), F.struct(F.coalesce("_texts", F.lit(0)), "gram")).alias("_k"))
    near = rare.select("_part", "_k.least", "_k.gram").join(lists, ["least", "gram"]).select("_part", "_doc").distinct()
    sure = near.join(hay.withColumnRenamed("_bare", "_hay"), "_doc").where(F.contains("_hay", F.col("_part._bare"))).select("_doc", "_part").distinct()
    all_parts = sure.groupBy("_doc", F.col("_part._q").alias("_q")).agg(F.count("*").alias("_n")).join(each.select("_q", "_of").distinct(), "_q").where("_n = _of")
    return all_parts.select(F.col("_doc").alias(doc_id), F.col("_q").alias(quote_id))


def sources(quotes: DataFrame, docs: DataFrame, quote_id: str, quote: str, doc_id: str, text: str) -> DataFrame:
    """The quotes with ``n_texts``, how many texts hold each, and ``first_text``, the smallest id of one: 0 and null for
    a quote that the corpus does not hold."""
    hits = found(docs, quotes, doc_id, text, quote_id, quote).groupBy(F.col(quote_id).alias("_q")).agg(F.count("*").alias("n_texts"), F.min(doc_id).alias("first_text"))
    kept = [c for c in quotes.columns if c not in ("n_texts", "first_text")]
    return quotes.select(*kept).join(hits, F.col(quote_id) == F.col("_q"), "left").select(*kept, F.coalesce("n_texts", F.lit(0)).alias("n_texts"), "first_text")
