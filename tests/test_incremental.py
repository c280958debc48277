"""Keyed tables, growing components, exact ranks and keys of many rows: brute force, replay, skew."""

import os
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from gavelworks.operators import graph, records
from gavelworks.operators.incremental import Components
from gavelworks.sources.keyed import KeyedTable


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upserts_rewrite_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "t")
    t = KeyedTable(spark, path, "k", "seq", buckets=16)
    assert t.read() is None
    rows = [(i, i % 3, f"v{i}") for i in range(500)]
    assert t.upsert(spark.createDataFrame(rows, "k long, seq int, v string"), epoch=1) == list(range(16))
    before = files(path)
    batch = spark.createDataFrame([(7, 5, "new"), (7, 4, "older"), (8, 0, "late"), (9999, None, "more"), (None, 9, "no key")], "k long, seq int, v string")
    hit = t.upsert(batch, epoch=2)
    after = files(path)
    assert len(hit) <= 3 and all(after[f] == m for f, m in before.items())
    # what was written follows the batch: as many buckets as were hit
    assert len({os.path.dirname(f) for f in set(after) - set(before)}) == len(hit)
    got = {r.k: (r.seq, r.v) for r in t.read().collect()}
    assert len(got) == 501 and got[7] == (5, "new") and got[8] == (2, "v8") and got[9999] == (None, "more")
    assert t.upsert(batch, epoch=2) == [] and t.upsert(batch) == hit  # replays
    assert {r.k: (r.seq, r.v) for r in t.read().collect()} == got
    wider = spark.createDataFrame([(1, 9, "x", 1.5)], "k long, seq int, v string, w double")
    t.upsert(wider, gone=spark.createDataFrame([(2,)], "k long"))
    now = {r.k: r for r in t.read().collect()}
    assert 2 not in now and now[1].w == 1.5 and now[3].w is None and len(now) == 500
    n = t.versions()
    assert t.vacuum() > 0 and t.versions() == n[-1:] and t.read().count() == 500
    with pytest.raises(ValueError):
        KeyedTable(spark, path, "k", buckets=8).manifest()


def test_order_of_batches_and_rows_is_no_matter(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.randrange(40), r.randrange(5), r.choice("abc")) for _ in range(300)]
    seen = set()
    for n in range(3):
        r.shuffle(rows)
        t = KeyedTable(spark, str(tmp_path / f"t{n}"), "k", "seq", buckets=4)
        t.upsert(spark.createDataFrame(rows, "k int, seq int, v string"))
        seen.add(tuple(sorted(map(tuple, t.read().collect()))))
    assert len(seen) == 1 and {(k, s) for k, s, _ in next(iter(seen))} == {(k, max(s for x, s, _ in rows if x == k)) for k in {x[0] for x in rows}}


def test_two_writers(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k", buckets=2)
    m = t.manifest()
    t.upsert(spark.createDataFrame([(1, 2)], "k int, v int"))
    with pytest.raises(RuntimeError):
        t._commit(m | {"version": 1})
    assert t.read().count() == 1


def test_appends_equal_one_run(spark, tmp_path):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(None, 3), (5, 5)]
    parts = [edges[:50], edges[50:100], [*edges[100:], *edges[:5]]]
    c = Components(spark, str(tmp_path / "c"), buckets=8)
    for k, p in enumerate(parts):
        c.append(spark.createDataFrame(p, "a int, b int"), spark.createDataFrame([(900 + k,)], "node int"), epoch=k)
    got = {x.node: x.comp for x in c.labels().collect()}
    full = spark.createDataFrame(edges, "a int, b int").where("a is not null")
    nodes = full.select(F.explode(F.array("a", "b")).alias("node")).union(spark.createDataFrame([(900,), (901,), (902,)], "node int"))
    assert got == {x.node: x.comp for x in graph.components(nodes, full).collect()}
    before = files(tmp_path / "c")
    # nothing changes between known components: no file is written
    assert c.append(spark.createDataFrame(edges[:30], "a int, b int")) == [] and files(tmp_path / "c") == before
    assert len(c.append(spark.createDataFrame([(2000, 2001)], "a int, b int"))) <= 2


def test_few_values_lie_around_a_rank(spark):
    n = 300_000
    x = spark.range(n).select(F.when(F.col("id") == 0, F.lit(1e12)).otherwise(F.col("id") * 0.001).alias("v"), F.lit("g").alias("g"))
    near = records.near_ranks(x, ["g"], "v", {"m": 0.5, "p": 0.9}).where("_v is not null").groupBy("_i").count().collect()
    assert len(near) == 2 and all(r["count"] < n / 256 for r in near)
    got = records.quantiles(x, ["g"], "v", {"m": 0.5, "p": 0.9}).first()
    v = np.arange(1, n) * 0.001
    v = np.append(v, 1e12)
    assert (got.m, got.p) == pytest.approx((np.quantile(v, 0.5), np.quantile(v, 0.9)), rel=1e-12)
    common = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.lit(7.0)).otherwise(F.rand(3) * 100).alias("v"), F.lit(None).cast("string").alias("g"))
    got = records.quantiles(common, ["g"], "v", {"m": 0.5, "p": 0.9}).first()
    v = [r.v for r in common.collect()]
    assert (got.m, got.p) == pytest.approx((np.quantile(v, 0.5), np.quantile(v, 0.9)), rel=1e-12)


def test_ranks_around_the_small_group_bound(spark):
    r = random.Random(7)
    for cells, n in [(10, 39), (10, 40), (10, 41), (20, 500), (3, 1)]:
        v = [r.choice([r.random(), 0.5]) for _ in range(n)]
        for p in (0.0, 0.1, 0.5, 0.9, 1.0):
            got = records.quantiles(spark.createDataFrame([("g", x) for x in v], "g string, v double"), ["g"], "v", {"q": p}, cells).first().q
            assert got == pytest.approx(np.quantile(v, p)), (cells, n, p)


def test_a_key_of_many_rows_is_ranked_in_parts(spark):
    rows = [(i, None if i % 3 else f"k{i % 7}", i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "no int, k string, q int").repartition(6)
    kept, gone = records.dedupe(df, ["k"], [F.col("q").desc(), F.col("no")])
    want = {}
    for no, k, q in rows:
        if k not in want or (-q, no) < (-want[k][1], want[k][0]):
            want[k] = (no, q)
    assert {r.k: r.no for r in kept.collect()} == {k: v[0] for k, v in want.items()} and gone.count() == 1000 - len(want)
    flags = records.duplicate_flags(df.union(spark.createDataFrame([(5000, "alone", 1)], df.schema)), ["k"], [F.col("q").desc(), F.col("no")]).collect()
    assert all(r.ganda == (r.k != "alone") for r in flags) and sum(r.disimpan for r in flags) == len(want) + 1
    plan = records.dedupe(df, ["k"], ["no"])[0]._jdf.queryExecution().toString()
    assert "_s" in plan


def test_links_join_what_pairs_join(spark):
    r = random.Random(5)
    rows = [(f"c{i:03d}", r.choice(["p", "q", None]), r.choice([None, *range(2015, 2024)]), r.choice([None, "2019", "2020-2021", "2021"]), r.choice([None, 1000.0, 5.0]), r.sample(["KM A", "CV B"], r.choice([0, 0, 1, 2]))) for i in range(90)]
    c = spark.createDataFrame(rows, "chain string, place string, year int, event string, volume double, names array<string>")
    nodes = c.select(F.col("chain").alias("node"))
    a = {x.node: x.comp for x in graph.components(nodes, graph.incident_pairs(c)).collect()}
    b = {x.node: x.comp for x in graph.components(nodes, graph.incident_links(c)).collect()}
    assert a == b and 1 < len(set(a.values())) < 90
    # one court, one volume, one year: as many links as cases, not their square
    same = spark.range(3000).select(F.col("id").cast("string").alias("chain"), F.lit("p").alias("place"), F.lit(2020).alias("year"), F.lit("2019").alias("event"), F.lit(1000.0).alias("volume"), F.array().cast("array<string>").alias("names"))
    assert graph.incident_links(same).count() == 2999


def test_streams_into_a_keyed_table(spark, tmp_path):
    from gavelworks.streaming import ingest

    sink = ingest.keyed_sink(str(tmp_path / "t"), buckets=4)
    one = spark.createDataFrame([("a", "2024-01-02", 1), ("a", "2024-01-01", 9), ("b", "2024-01-01", 2)], "id string, fetched_at string, v int")
    sink(one, 0)
    sink(spark.createDataFrame([("a", "2023-01-01", 7), ("c", "2024-01-01", 3)], one.schema), 1)
    sink(one, 0)
    t = KeyedTable(spark, str(tmp_path / "t"), "id", "fetched_at", buckets=4)
    assert {r.id: r.v for r in t.read().collect()} == {"a": 1, "b": 2, "c": 3} and t.manifest()["epoch"] == 1
    ingest.upsert_sink(str(tmp_path / "w"))(one, 0)
    assert {r.id: r.v for r in spark.read.parquet(str(tmp_path / "w" / "v=0")).collect()} == {"a": 1, "b": 2}


def test_appends_within_a_tick_keep_their_order(spark, tmp_path):
    from gavelworks.sources import readers

    path = str(tmp_path / "j")
    for v in range(4):
        readers.append_jsonl(spark.createDataFrame([("k", v)], "_key string, v int"), path)
    for d, _, fs in os.walk(path):
        for f in fs:
            os.utime(os.path.join(d, f), (1, 1))
    got = readers.read_jsonl_latest(spark, path, "_key string, v int")
    assert got.columns == ["_key", "v"] and [r.v for r in got.collect()] == [3]
