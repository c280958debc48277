"""Page tables in SQL: columns worked out when the query is planned, null pages, repeated rows."""

import pytest

from gavelworks.sources import udtf

PAGE = (
    "<table><tr><td>Nomor</td><td>: 1/Pid/2020</td></tr><tr><td>Amar</td><td>LAIN</td></tr></table><a href='/a/pdf/x.pdf'>p</a>"
    "<div><h4>Putusan Terkait</h4><a href='/direktori/putusan/bb.html'>Banding</a><a href='/direktori/putusan/aa.html'>ini</a></div>"
)


@pytest.fixture
def pages(spark):
    udtf.register(spark)
    rows = [(1, "https://x/direktori/putusan/aa.html", PAGE), (2, None, None), (3, "u", ""), (3, "u", "")]
    spark.createDataFrame(rows, "i int, url string, html string").createOrReplaceTempView("udtf_pages")
    return spark


def test_columns_follow_the_labels(pages):
    x = pages.sql("SELECT i, r.* FROM udtf_pages, LATERAL ruling_fields(html, url, 'amar, nomor,id,pdf_url') r")
    assert x.columns == ["i", "amar", "nomor", "id", "pdf_url"]
    got = sorted(map(tuple, x.collect()), key=str)
    assert got == [(1, "LAIN", "1/Pid/2020", "aa", "/a/pdf/x.pdf"), (2, None, None, None, None), (3, None, None, None, None), (3, None, None, None, None)]


@pytest.mark.parametrize("labels", ["'nomor,tak_ada'", "url"])
def test_unknown_labels_are_errors_of_the_query(pages, labels):
    with pytest.raises(Exception, match="label"):
        pages.sql(f"SELECT * FROM udtf_pages, LATERAL ruling_fields(html, url, {labels})")


def test_related_and_listing_rows(pages):
    assert [tuple(r) for r in pages.sql("SELECT i, r.id, r.label FROM udtf_pages, LATERAL related_rows(html, url) r").collect()] == [(1, "bb", "Banding")]
    page = "<li><a href='/direktori/putusan/c1.html'>A</a> Putus : 05-06-2021</li><li><a href='/direktori/putusan/c2.html'>B</a></li>"
    got = pages.sql(f'SELECT * FROM listing_rows("{page}")').collect()
    assert [(r.urutan, r.id, r.judul, r.tanggal_putus) for r in got] == [(1, "c1", "A", "05-06-2021"), (2, "c2", "B", None)]
    assert pages.sql("SELECT * FROM listing_rows(CAST(NULL AS STRING))").collect() == []


def test_ruling_pages_are_dealt_over_all_cores(spark, tmp_path):
    from gavelworks.plans import catalog, texts  # noqa: F401  the catalogue comes first

    spark.sql("SELECT id AS o_orderkey, id AS o_custkey, DATE'2021-01-01' AS o_orderdate, 'F' AS o_orderstatus, '1-URGENT' AS o_orderpriority FROM range(0, 400, 1, 1)").write.parquet(str(tmp_path / "orders.parquet"))
    assert texts.ruling_pages(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert texts.related_rulings(spark, str(tmp_path)).count() == 400


def test_rows_are_no_arrow_table_each(pages):
    x = pages.sql("SELECT i, r.* FROM udtf_pages, LATERAL ruling_fields(html, url, 'nomor') r")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


def test_plain_pages_need_no_parser_and_give_its_tree(monkeypatch):
    import random

    from gavelworks.sources import pages as P

    def shape(n):
        return n.tag, n.attrs, [k if isinstance(k, str) else shape(k) for k in n.kids]

    plain = ["<td>", "</td>", "<tr>", "</tr>", "<TD CLASS='x y'>", "<b>", "</b>", "<br>", '<a href="/direktori/putusan/a1.html" title=\'\'>', "</a>", "</A\n>", "<i x='1'>", "&amp;", "&nbsp", " teks ", ">", "é", "<li\tA='1' a='2'>"]
    odd = ["<br/>", "<a href='/x?a=1&amp;b'>", "<a title='p > q'>", "<a href=x>", "<", "a < b", "<!-- c -->", "<!DOCTYPE html>", "<p", "</p x='1'>", "</ p>", "<script>", "</script>", "<a b='1'c='2'>", "<textarea>", "</>", "<1>", "<pé>", "<p\x0bx='1'>", "</td/>"]
    rng, both = random.Random(3), [0, 0]
    for k in range(4000):
        html = "".join(rng.choice(plain if k % 2 or rng.random() < 0.8 else odd) for _ in range(rng.randrange(12)))
        nodes, want = P._plain(html), P._parsed(html)
        both[nodes is None] += 1
        assert nodes is not None or k % 2 == 0, html
        assert shape(P.tree(html)) == shape(want), html
        assert [shape(n) for n in P._nodes(html)] == [shape(n) for n in want.walk()], html
    assert min(both) > 400
    monkeypatch.setattr(P, "_parsed", None)
    assert P.overview(PAGE, "https://x/direktori/putusan/aa.html")["meta"] == {"nomor": "1/Pid/2020", "amar": "LAIN"}
