"""Queries over whole tables without a SQL twin, against brute force on a small fixture."""

from gavelworks.plans import catalog


def test_groups_violations_and_components(spark, tmp_path):
    orders = [(i, i % 13 + 1, f"{i * 7 % 5}-P", f"2020-{i * 5 % 12 + 1:02d}-01", "FOP"[i % 3], float(i * 37 % 101)) for i in range(1, 120)]
    lines = [(i, i % 4, 10 * (i % 9) + i % 2, i % 9, i % 5) for i in range(1, 60)]
    cols = "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string, o_orderstatus string, o_totalprice double"
    spark.createDataFrame(orders, cols).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, x int").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = lambda n: [tuple(r) for r in catalog.QUERIES[n](spark, str(tmp_path)).collect()]
    want = []
    for p in sorted({o[2] for o in orders}):
        g = [o for o in orders if o[2] == p]
        want.append((p, ", ".join(sorted({str(o[1]) for o in g})), f"K{min(o[0] for o in g) % 100}", max(o[5] for o in g)))
    assert sorted(rows("group_summary")) == want
    pairs = sorted((b[0], a[0]) for a in orders for b in orders if a[1] == b[1] and a[2] < b[2] and a[3] > b[3])
    assert sorted(rows("chain_order_violation")) == pairs and len(pairs) > 50
    edges = [(2 * x[2], 2 * x[3] + 1) for x in lines]
    comp = {n: n for e in edges for n in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert dict(rows("chain_components")) == comp and len(set(comp.values())) > 1


def test_large_steps_are_dealt_by_their_rows(spark, monkeypatch):
    from gavelworks.operators import graph

    df = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert graph.spread(df, 4_000_000, "a") is df
    assert graph.spread(df, 9_000_001, "a").rdd.getNumPartitions() == 10
    monkeypatch.setattr(graph, "TASK_ROWS", 25)
    got = graph.components(df.selectExpr("a as node"), df)
    assert {r.comp for r in got.collect()} == {0} and got.count() == 60


def test_batches_to_python_are_small(spark):
    from gavelworks import shipping

    shipping.ship(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
