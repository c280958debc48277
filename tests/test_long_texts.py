"""Text expressions whose cost must stay in proportion to the text."""

from pyspark.sql import functions as F

from gavelworks.functions import columns as C
from gavelworks.functions import rulings as R
from gavelworks.functions.lexicon import FUELS


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", 1000)
    return df._jdf.queryExecution().analyzed().toString()


def test_each_pattern_is_in_the_plan_once(spark):
    t = spark.createDataFrame([("solar, biosolar dan bio-solar",)], "t string")
    shown = plan(t.select(R.fuel_counts("t")))
    assert shown.count("regexp_replace(") <= 2 * sum(map(len, FUELS.values()))
    shown = plan(R.candidates(t, "t", ()))
    assert r"[\s\S]" not in shown


def test_context_before_a_match_of_any_characters(spark):
    t = spark.createDataFrame([("\U0001f600" * 200 + " kapasitas 9.000 liter, disita 5 liter solar Rp7.000,00 denda Rp 5",)], "t string")
    got = t.select(R.volume_mentions("t").alias("v"), R.money_mentions("t").alias("m"), R.around(F.col("t"), "is", R.VOLUME, 10, 6, num=1).alias("a")).first()
    assert [(v.value, v.kind) for v in got.v] == [(9000.0, "kapasitas"), (5.0, "jumlah")]
    assert [(m.value, m.kind) for m in got.m] == [(7000.0, "lain"), (5.0, "denda")]
    assert [tuple(a) for a in got.a] == [("kapasitas ", "9.000", ", disi"), ("r, disita ", "5", " solar")]


def test_a_changed_quote_is_missing_where_the_text_goes_on_from_its_letters(spark, tmp_path):
    from gavelworks.plans import composed

    tail = "satu kalimat yang cukup panjang"
    rows = [(3, "a" * 18 + "zz" + tail), (6, "a" * 20 + (tail + " " * 40)[:60] + " zz " + (tail + " " * 40)[:60]), (9, "a" * 20 + "กั" * 6 + "́" * 10), (4, "abc"), (12, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    none = "kalimat ini tidak ada di mana pun"
    assert dict(composed.quotes_missing_of_texts(spark, str(tmp_path)).collect()) == {3: f"{none}|zz{tail}", 6: f"{none}|zz{(tail + ' ' * 40)[:60]}", 9: none, 4: none}


def test_row_rules_read_a_date_once(spark):
    from gavelworks.operators import rules
    from gavelworks.plans import catalog, corpora
    from gavelworks.sources import readers

    rows = corpora.frame(spark, list(catalog.BROKEN), readers.RECORD_SCHEMA)
    shown = plan(rules._issues(rules._read(rows), rules.row_rules()))
    assert 0 < shown.count("nopember") <= plan(rows.select(C.parse_date("tanggal_putusan"))).count("nopember")
