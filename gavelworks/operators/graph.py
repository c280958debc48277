"""Connected components, dense labels and breadth-first frontiers over edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset a temporary one, which only local mode can share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(sc, "_gavelworks_cut", None):
        sc._gavelworks_cut = "file://" + tempfile.mkdtemp(prefix="gavelworks-")
    return sc._gavelworks_cut


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative table: written once to the shared folder and read again; the folder goes with
    the application."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gavelworks-graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Let a folder go with the application."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


#: rows of a join or a group that one task sorts or hashes
TASK_ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to so many tasks that each gets about ``TASK_ROWS`` of ``rows``, however many shuffle partitions
    the session has; as it is where those are enough."""
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp) for (node) and undirected (a, b): comp is the smallest node reachable.

    Edges to unknown nodes are ignored; nodes without edges are their own component."""
    known = nodes.select("node").where("node is not null").distinct()
    e = edges.select("a", "b").join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    return contracted(known, e)


def contracted(known: DataFrame, e: DataFrame) -> DataFrame:
    """``components`` of known nodes (distinct) and edges between them.

    Each round every node moves to the smallest of its neighbours (and on to that one's), and the edges are drawn
    again between what is left: the graph shrinks by half or more a round, and the smallest node of a component is
    never moved."""
    e = cut(e.where("a <> b"))
    n = 2 * e.count()
    e = cut(spread(e.union(e.select(F.col("b"), F.col("a"))), n, "a", "b").distinct())
    moves = []
    while n := e.count():
        to = spread(e, n, "a").groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        far = to.select(F.col("node").alias("to"), F.col("to").alias("far"))
        move = cut(to.join(far, "to").select("node", F.col("far").alias("to")))
        moves.append(move)
        e = spread(e, n, "a").join(spread(move.toDF("a", "ta"), n, "a"), "a")
        e = spread(e, n, "b").join(spread(move.toDF("b", "tb"), n, "b"), "b").where("ta <> tb")
        e = cut(spread(e.select(F.col("ta").alias("a"), F.col("tb").alias("b")), n, "a", "b").distinct())
    lab = known.withColumn("comp", F.col("node"))
    for move in moves:
        lab = lab.join(move.toDF("comp", "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return cut(lab) if moves else lab


def renumber(df: DataFrame, order: list, out: str = "no") -> DataFrame:
    """1..n in order: rows are dealt by range, numbered within their range, and moved by the counts of earlier ranges.

    Rows of one value of the first columns lie in one range, so ties need a last column that tells rows apart."""
    d = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    n = d.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    n = n.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    d = d.join(F.broadcast(n.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part")
    no = (F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")).cast("int")
    return d.withColumn(out, no).drop("_part", "_before")


def chains(rulings: DataFrame, links: DataFrame) -> DataFrame:
    """(id, chain): linked rulings share a chain R0001.., numbered by earliest year (9999 if unknown) and smallest id.

    rulings: (id, year); links: (dari_id, ke_id)."""
    comp = components(rulings.select(F.col("id").alias("node")), links.select(F.col("dari_id").alias("a"), F.col("ke_id").alias("b")))
    x = comp.join(rulings.select(F.col("id").alias("node"), "year"), "node")
    first = x.groupBy("comp").agg(F.min(F.coalesce("year", F.lit(9999))).alias("y"), F.min("node").alias("i"))
    first = renumber(first, ["y", "i"], "n").select("comp", F.format_string("R%04d", "n").alias("chain"))
    return comp.join(first, "comp").select(F.col("node").alias("id"), "chain")


def incident_pairs(cases: DataFrame) -> DataFrame:
    """Pairs of chains that may stem from one incident: same place, ruling years at most two apart, event years
    equal or unknown, and the same volume or a shared ship or company.

    cases: (chain, place, year, event, volume, names array), one row a chain.  Two equi joins, on place and volume and on
    place and name, so that a busy court costs no square of its cases; the other conditions are residuals.  A pair is
    told where it is found, once: pairs of one volume by the first join with all that they share, the others by the
    second at the first name they share.  So only cases are shuffled, never pairs."""
    names = F.array_sort(F.array_distinct(F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    keep = cases.select("chain", "place", "year", F.substring("event", 1, 4).alias("event"), "volume", names.alias("names")).distinct()

    def joined(key: str, rows: DataFrame) -> DataFrame:
        a, b = rows.alias("x"), rows.alias("y")
        x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
        event = F.coalesce(x("event") == y("event"), F.lit(True))
        # an unknown year is no reason against a pair
        years = ~F.coalesce(F.abs(x("year") - y("year")) > 2, F.lit(False))
        shared = F.array_intersect(x("names"), y("names"))
        on = (x("place") == y("place")) & (x(key) == y(key)) & (x("chain") < y("chain")) & years & event
        if key == "name":
            on = on & ~F.coalesce(x("volume") == y("volume"), F.lit(False)) & (x("name") == shared[0])
        return a.join(b, on).select(x("chain").alias("a"), y("chain").alias("b"), F.lit(key == "volume").alias("same_volume"), shared.alias("shared"), (x("volume") if key == "volume" else F.lit(None).cast(kind)).alias("volume"))

    kind = keep.schema["volume"].dataType
    return joined("volume", keep.where("volume is not null")).union(joined("name", keep.withColumn("name", F.explode("names"))))


def incident_links(cases: DataFrame) -> DataFrame:
    """(a, b): edges that join what ``incident_pairs`` joins, without its squares.

    Cases of one place and volume (or name), ruling year and event year are all pairs of each other, so each is linked
    with the smallest of them, and only these are paired: at most one for every year and event year of a key."""
    volume = cases.where("volume is not null").select("chain", "place", "year", "event", F.concat(F.lit("v"), F.col("volume").cast("string")).alias("key"))
    named = cases.select("chain", "place", "year", "event", F.explode("names").alias("key")).withColumn("key", F.concat(F.lit("n"), F.col("key")))
    rows = volume.union(named).where("place is not null and key is not null")
    rows = cut(rows.select("chain", "place", "key", "year", F.substring("event", 1, 4).alias("event")))
    alike = ["place", "key", "year", "event"]
    heads = cut(rows.groupBy(*alike).agg(F.min("chain").alias("head")))
    on = (F.col("r.place") == F.col("h.place")) & (F.col("r.key") == F.col("h.key")) & F.col("r.year").eqNullSafe(F.col("h.year")) & F.col("r.event").eqNullSafe(F.col("h.event"))
    star = rows.alias("r").join(heads.alias("h"), on).select(F.col("r.chain").alias("a"), F.col("h.head").alias("b"))
    x, y = heads.alias("x"), heads.alias("y")
    near = (F.col("x.head") < F.col("y.head")) & ~F.coalesce(F.abs(F.col("x.year") - F.col("y.year")) > 2, F.lit(False))
    near = near & F.coalesce(F.col("x.event") == F.col("y.event"), F.lit(True))
    pairs = x.join(y, (F.col("x.place") == F.col("y.place")) & (F.col("x.key") == F.col("y.key")) & near).select(F.col("x.head").alias("a"), F.col("y.head").alias("b"))
    return star.union(pairs).where("a <> b").distinct()


def incidents(cases: DataFrame) -> DataFrame:
    """(chain, kelompok, anggota): components over the links; groups of more than one are K01.. by smallest chain."""
    comp = components(cases.select(F.col("chain").alias("node")), incident_links(cases))
    size = comp.groupBy("comp").agg(F.count("*").alias("anggota"))
    label = renumber(size.where("anggota > 1"), ["comp"], "n").withColumn("kelompok", F.format_string("K%02d", "n"))
    return comp.join(size, "comp").join(label.select("comp", "kelompok"), "comp", "left").select(F.col("node").alias("chain"), F.coalesce("kelompok", F.col("node").cast("string")).alias("kelompok"), "anggota")


def frontier(spark: SparkSession, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) reached from seeds (node) over (a, b), level by level with anti-joins until nothing new is reached."""
    seen = cut(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    now, level = seen, 0
    while now.limit(1).count():
        level += 1
        new = now.join(edges, now.node == edges.a).select(F.col("b").alias("node")).where("node is not null").distinct()
        now = cut(new.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        seen = cut(seen.union(now)) if level % 8 == 0 else seen.union(now)
    return seen
