"""The listing data source: pushed filters, ranges, the shared store, requests through an injected opener."""

import time

import pytest

from gavelworks.sources import listing as L

AT = "https://site.example/direktori/index/kategori/minyak.html"
OPENER = '''
import re
def open_url(url):
    m = re.search(r"/tahun/(\\d+)(?:/page/(\\d+))?\\.html$", url)
    year, page = int(m[1]), int(m[2] or 1)
    with open({log!r}, "a") as f:
        f.write(f"{{year}} {{page}}\\n")
    if year == 2022 and page == 2:
        return 404, {{}}, b""
    if year == 2023:
        return 200, {{}}, b"<html>Captcha please</html>"
    prefix = url.split("/page/")[0].removesuffix(".html")
    return 200, {{}}, f"<html>{{year}}-{{page}} <a href='{{prefix}}/page/{{year - 2013}}.html'>last</a></html>".encode()
'''


def filled(spark, tmp_path, span=4):
    store = str(tmp_path / "store")
    rows = [(y, p, f"u{y}/{p}", f"<html>{y} {p}</html>", 1.0) for y in (2020, 2021, 2022) for p in range(1, 11)]
    df = spark.createDataFrame([*rows, (2020, 1, "u", "newer", 2.0)], "tahun int, halaman int, alamat string, html string, diambil double")
    assert L.pack(df, store, AT, span).agg({"n": "sum"}).first()[0] == 30
    return store


def test_filters_reach_the_source(spark, tmp_path):
    df = L.read(spark, filled(spark, tmp_path), AT, span=4)
    assert df.rdd.getNumPartitions() == 9 and df.count() == 30
    assert df.where("tahun = 2020 and halaman = 1").first().html == "newer"
    for cond, parts, n in [
        ("tahun = 2021", 3, 10), ("tahun > 2020 and halaman <= 4", 2, 8), ("tahun in (2020, 2022) and halaman between 5 and 6", 2, 4), ("halaman = 9", 3, 3), ("tahun = 2030", 1, 0),
        ("tahun = 2021 and html like '%10%'", 3, 1), ("halaman in (1, 10)", 6, 6),
    ]:
        x = df.where(cond)
        plan = x._sc._jvm.PythonSQLUtils.explainString(x._jdf.queryExecution(), "formatted")
        assert (x.rdd.getNumPartitions(), x.count()) == (parts, n), cond
        assert "PushedFilters: [" in plan and ("(tahun" in plan or "(halaman" in plan), plan


def test_packing_again_keeps_other_pages(spark, tmp_path):
    store = filled(spark, tmp_path)
    L.pack(spark.createDataFrame([(2020, 2, "n", "new", 5.0), (2020, 11, "n", "more", 5.0)], "tahun int, halaman int, alamat string, html string, diambil double"), store, AT, 4).count()
    got = {(r.tahun, r.halaman): r.html for r in L.read(spark, store, AT, span=4).where("tahun = 2020").collect()}
    assert len(got) == 11 and got[2020, 2] == "new" and got[2020, 3] == "<html>2020 3</html>"


@pytest.fixture
def opener(spark, tmp_path):
    log, name = tmp_path / "log.txt", f"opener_{time.time_ns()}"
    (tmp_path / f"{name}.py").write_text(OPENER.format(log=str(log)))
    spark.sparkContext.addPyFile(str(tmp_path / f"{name}.py"))
    return f"{name}:open_url", log


def test_pages_are_asked_for_once(spark, tmp_path, opener):
    name, log = opener
    options = dict(opener=name, years="2020-2023", pages=20, span=3, delay=0, attempts=1)
    store = str(tmp_path / "shared")
    read = lambda **more: L.read(spark, store, AT, **(options | more))
    got = {(r.tahun, r.halaman): r for r in read().where("tahun <= 2022").collect()}
    # 2020 has 7 pages, 2021 has 8, 2022 has 9 of which one is not there
    assert {k for k in got if got[k].html} == {(2020, p) for p in range(1, 8)} | {(2021, p) for p in range(1, 9)} | {(2022, p) for p in range(1, 10) if p != 2}
    assert "404" in got[2022, 2].galat and got[2020, 3].html.startswith("<html>2020-3")
    asked = log.read_text().splitlines()
    assert not [a for a in asked if a.startswith("2023")] and all(asked.count(a) == 1 for a in asked if not a.endswith(" 1"))
    read().where("tahun <= 2021").collect()
    # pages 1 of both years are known now, and nothing else is missing
    assert log.read_text().splitlines() == asked
    again = read().where("tahun = 2022 and halaman = 2").collect()
    assert [r.galat is not None for r in again] == [True] and log.read_text().splitlines() == [*asked, "2022 2"]
    read(hours=0).where("tahun = 2020 and halaman = 5").collect()
    assert log.read_text().splitlines()[len(asked) + 1 :].count("2020 5") == 1
    blocked = read().where("tahun = 2023").collect()
    assert all(r.html is None and r.galat for r in blocked) and not [k for k in L.Store(store, AT).packs() if k[0] == 2023]


def test_empty_store(spark, tmp_path):
    assert L.read(spark, str(tmp_path / "none"), AT).collect() == []
