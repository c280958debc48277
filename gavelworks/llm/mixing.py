"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

A tree domain > language > source carries integer weights.  The token budget goes
from the root down; at each node children that can't use their share (supply times
the most epochs) take what they have and their siblings share the shortage by
weight, so only what a whole family lacks reaches the level above.  A leaf's budget
is whole epochs plus a prefix, in an order seeded per epoch, of documents whose
tokens fit the rest.

The prefix is found without sorting a leaf: documents fall into ranges of their
order hash (about 2,000 a range), ranges are summed map-side, and only the range in
which the budget ends is ordered; it yields the last hash that is in.  All shares
are integer arithmetic; rounding leaves at most one token per child unspent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, table

DOMAIN_WEIGHTS = {"web": 5, "books": 3, "code": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
BUDGET, EPOCHS, SEED = (6, 10), 3, 17
#: leaves up to this count are sent to every executor; beyond it the join is shuffled
BROADCAST_LEAVES = 50_000
TREE = ["domain", "lang", "source"]


def domain_of(source):
    """Domain of a source by its last digit: 0 3 6 9 web, 1 4 7 books, 2 5 8 code, else other."""
    d = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9])$", 1)
    return F.when(d.isin("0", "3", "6", "9"), "web").when(d.isin("1", "4", "7"), "books").when(d.isin("2", "5", "8"), "code").otherwise("other")


def _weight(c: str, weights: dict):
    w = F.lit(1)
    for k, v in weights.items():
        w = F.when(F.col(c) == k, v).otherwise(w)
    return w.cast("long")


def _fill(nodes: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Adds ``give``: the share of the parent's budget ``have`` for children with cap and weight w."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    order = by.orderBy((F.col("cap").cast("double") / F.col("w")).asc(), F.col(key).asc())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    n = nodes.withColumn("full", F.col("cap") * rest <= (F.col("have") - before) * F.col("w"))
    sat = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(by)
    n = n.withColumn("_sat", sat).withColumn("_open", open_w)
    return n.withColumn("give", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("((have - _sat) * w) div _open"))).drop("_sat", "_open", "full")


def leaf_budgets(leaves: DataFrame, budget=BUDGET, epochs: int = EPOCHS, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS) -> DataFrame:
    """(domain, lang, source, supply) -> plus give, the tokens to take from each leaf."""
    cap = leaves.withColumn("cap", F.col("supply") * epochs)
    dom = cap.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("s"))
    dom = dom.withColumn("have", F.expr(f"(sum(s) over (partition by 1)) * {budget[0]} div {budget[1]}")).withColumn("w", _weight("domain", domain_weights))
    dom = _fill(dom, [], "domain").select("domain", F.col("give").alias("have"))
    lan = cap.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(dom, "domain").withColumn("w", _weight("lang", lang_weights))
    lan = _fill(lan, ["domain"], "lang").select("domain", "lang", F.col("give").alias("have"))
    leaf = cap.join(lan, ["domain", "lang"]).withColumn("w", F.lit(1).cast("long"))
    return _fill(leaf, ["domain", "lang"], "source").drop("have", "w", "cap")


def prepared(docs: DataFrame) -> DataFrame:
    """Tree columns, n_tokens (words) and the document's id as text; nulls become '' in the tree."""
    return docs.select(
        F.col("doc_id"),
        domain_of(F.col("source")).alias("domain"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
    )


def order_hash(seed: int):
    """Order of a document in epoch ``whole`` of its leaf."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan(spark: SparkSession, slim: DataFrame, work: Work, seed: int = SEED, **kw) -> DataFrame:
    """Per leaf: supply, give, whole (epochs taken in full), cut (last order hash of the next one, null if none)."""
    leaves = work.save(slim.groupBy(*TREE).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n_docs")), "leaves")
    got = leaf_budgets(leaves, **kw)
    got = got.withColumn("whole", F.when(F.col("supply") > 0, F.expr("give div supply")).otherwise(F.lit(0)).cast("long"))
    got = work.save(got.withColumn("rest", F.col("give") - F.col("whole") * F.col("supply")).withColumn("ranges", F.greatest(F.lit(1), F.expr("n_docs div 2048")).cast("long")), "budgets")
    d = small(spark, slim, got).where("rest > 0").withColumn("h", order_hash(seed))
    d = d.withColumn("range", F.expr("(conv(substr(h, 1, 8), 16, 10) * ranges) div 4294967296"))
    sums = d.groupBy(*TREE, "range", "rest").agg(F.sum("n_tokens").alias("t"))
    w = Window.partitionBy(*TREE).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0)))
    last = sums.where("before <= rest and before + t > rest").select(*TREE, "range", "before")
    inside = d.join(last, [*TREE, "range"])
    cum = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*TREE).orderBy("h"))
    cut = inside.withColumn("cum", cum).where("cum <= rest").groupBy(*TREE).agg(F.max("h").alias("cut"))
    # a range that begins beyond what fits ends the prefix before it
    edge = sums.where("before + t <= rest").groupBy(*TREE).agg(F.max("range").alias("r"))
    got = got.join(cut, TREE, "left").join(edge, TREE, "left")
    return work.save(got.select(*TREE, "supply", "give", "whole", "ranges", "r", "cut"), "plan")


def small(spark: SparkSession, rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Join rows with the leaf table, sent around only if it was counted to be small."""
    n = leaves.limit(BROADCAST_LEAVES + 1).count()
    side = F.broadcast(leaves.drop("supply", "n_docs")) if n <= BROADCAST_LEAVES else leaves.drop("supply", "n_docs")
    return rows.join(side, TREE)


def _epochs(rows: DataFrame, seed: int) -> DataFrame:
    h = rows.withColumn("h", order_hash(seed)).withColumn("range", F.expr("(conv(substr(h, 1, 8), 16, 10) * ranges) div 4294967296"))
    more = (F.coalesce(F.col("range") <= F.col("r"), F.lit(False))) | F.coalesce(F.col("h") <= F.col("cut"), F.lit(False))
    return h.withColumn("epochs", F.col("whole") + more.cast("long")).where("epochs > 0")


def mix(spark: SparkSession, docs: DataFrame, work: Work | None = None, seed: int = SEED, **kw) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epochs (times taken, 1 or more) of the chosen documents.

    Null lang and source are leaves of their own (''); null or empty texts have no
    tokens and follow the epochs of their leaf; rows of one doc_id are in or out together."""
    work = work or Work(spark, "mixing")
    slim = work.save(prepared(docs), "tokens")
    p = plan(spark, slim, work, seed, **kw)
    return _epochs(small(spark, slim, p), seed).select("doc_id", *TREE, "n_tokens", "epochs")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The chosen documents, each as many times as it has epochs."""
    work = Work(spark, "mixing")
    slim = work.save(prepared(docs), "tokens")
    p = plan(spark, slim, work)
    cols = [F.col(f"`{c}`").alias(f"_gw_{i}") for i, c in enumerate(docs.columns)]
    tree = [domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")]
    rows = docs.select(*cols, F.col("doc_id").alias("doc_id"), *tree)
    out = _epochs(small(spark, rows, p), SEED).withColumn("_gw_n", F.explode(F.expr("sequence(1L, epochs)")))
    return out.select(*[F.col(f"_gw_{i}").alias(c) for i, c in enumerate(docs.columns)])


def _sql_fill(src: str, parent: str, key: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""SELECT *, CASE WHEN is_full THEN cap ELSE ((have - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({by}), 0)) * w) // (sum(CASE WHEN NOT is_full THEN w END) OVER ({by})) END AS give FROM (
    SELECT *, cap * sum(w) OVER ({by} ORDER BY cap::DOUBLE / w, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      <= (have - coalesce(sum(cap) OVER ({by} ORDER BY cap::DOUBLE / w, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full FROM ({src}))"""


def oracle() -> str:
    case = lambda c, ws: "CASE " + c + "".join(f" WHEN '{k}' THEN {v}" for k, v in ws.items()) + " ELSE 1 END"
    return f"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_matches(source, '[0369]$') THEN 'web' WHEN regexp_matches(source, '[147]$') THEN 'books' WHEN regexp_matches(source, '[258]$') THEN 'code' ELSE 'other' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, sum(n_tokens)::BIGINT * {EPOCHS} AS cap FROM d GROUP BY ALL),
dom AS ({_sql_fill(f"SELECT domain, sum(cap)::BIGINT AS cap, (SELECT sum(supply)::BIGINT * {BUDGET[0]} // {BUDGET[1]} FROM leaf) AS have, {case('domain', DOMAIN_WEIGHTS)} AS w FROM leaf GROUP BY domain", "", "domain")}),
lan AS ({_sql_fill(f"SELECT l.domain, l.lang, sum(l.cap)::BIGINT AS cap, any_value(dom.give) AS have, {case('l.lang', LANG_WEIGHTS)} AS w FROM leaf l JOIN dom ON dom.domain = l.domain GROUP BY l.domain, l.lang", "domain", "lang")}),
fin AS ({_sql_fill("SELECT l.domain, l.lang, l.source, l.supply, l.cap, lan.give AS have, 1 AS w FROM leaf l JOIN lan ON lan.domain = l.domain AND lan.lang = l.lang", "domain, lang", "source")}),
q AS (SELECT d.*, f.give, CASE WHEN f.supply > 0 THEN f.give // f.supply ELSE 0 END AS whole, f.supply FROM d JOIN fin f ON f.domain = d.domain AND f.lang = d.lang AND f.source = d.source),
h AS (SELECT *, give - whole * supply AS rest, md5(concat_ws(':', '{SEED}', whole::BIGINT::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS h FROM q),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM h)
SELECT doc_id, domain, lang, source, n_tokens, (whole + CASE WHEN rest > 0 AND cum <= rest THEN 1 ELSE 0 END)::BIGINT AS epochs
FROM c WHERE whole + CASE WHEN rest > 0 AND cum <= rest THEN 1 ELSE 0 END > 0
"""
