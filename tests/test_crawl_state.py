"""Crawl state over a stream: restart, each page once, expiry, and the same frontier as the batch operator."""

import datetime as dt
import random

from gavelworks.operators import graph
from gavelworks.streaming import crawl

SCHEMA = "id string, links array<string>, expires boolean, at timestamp, arrived timestamp, status string"
T0 = dt.datetime(2024, 1, 1)


def drop(spark, folder, rows, hour=0):
    """One more file of a page stream, which arrives so many hours after the first."""
    spark.createDataFrame([(*r, T0 + dt.timedelta(hours=hour), "x") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def go(spark, tmp_path, **more):
    crawl.run(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "pages")), str(tmp_path / "log"), str(tmp_path / "chk"), **more)
    return spark.read.schema(crawl.LOG).parquet(str(tmp_path / "log")).collect()


def test_restarted_stream_equals_batch_frontier(spark, tmp_path):
    r = random.Random(1)
    names = [f"p{i}" for i in range(30)]
    pages = [(n, [r.choice([*names, f"q{r.randrange(15)}", "hub", None]) for _ in range(4)] + ["hub"], False, T0 + dt.timedelta(minutes=i)) for i, n in enumerate(names)]
    parts = [pages[:11], pages[11:20] + pages[3:6], [*pages[20:], pages[0], (None, ["z"], None, None), ("lone", None, None, None)]]
    reads = []
    for part in parts:
        drop(spark, str(tmp_path / "pages"), part)
        log = go(spark, tmp_path)
        reads.append(sum(x.status == "dibaca" for x in log))
        ids = [x.id for x in log if x.status == "dibaca"]
        assert len(ids) == len(set(ids))
    assert reads == [11, 20, 31]
    assert go(spark, tmp_path) == log  # nothing new: nothing happens
    now = {x.id: x.status for x in crawl.status(spark, str(tmp_path / "log")).collect()}
    edges = spark.createDataFrame([(n, k) for n, ks, *_ in pages for k in ks if k] + [("z0", "z")], "a string, b string")
    reached = {x.node for x in graph.frontier(spark, spark.createDataFrame([(n,) for n in [*names, "lone"]], "node string"), edges).collect()}
    assert set(now) - {"z"} == reached and now["z"] == "antre"
    assert {k for k, v in now.items() if v == "dibaca"} == {*names, "lone"} and now["hub"] == "antre"


def test_listings_expire_after_a_day(spark, tmp_path):
    folder = str(tmp_path / "pages")
    drop(spark, folder, [("old", ["a"], True, T0), ("new", ["a"], True, T0 + dt.timedelta(hours=9)), ("a", [], False, None)])
    go(spark, tmp_path)
    drop(spark, folder, [("b", ["old", "new"], False, T0)], 20)
    assert not [x for x in go(spark, tmp_path) if x.status == "basi"]
    drop(spark, folder, [("c", [], False, T0)], 26)
    go(spark, tmp_path)
    drop(spark, folder, [("d", [], False, T0)], 27)
    log = go(spark, tmp_path)
    assert [(x.id, x.pada) for x in log if x.status == "basi"] == [("old", T0 + dt.timedelta(hours=24))]
    assert not [x for x in log if x.status == "antre"]  # what is mentioned is read or back in the frontier already
    drop(spark, folder, [("old", ["e"], True, T0 + dt.timedelta(hours=27))], 28)
    go(spark, tmp_path)
    now = {x.id: x.status for x in crawl.status(spark, str(tmp_path / "log")).collect()}
    assert now == {"old": "dibaca", "new": "dibaca", "a": "dibaca", "b": "dibaca", "c": "dibaca", "d": "dibaca", "e": "antre"}
