"""The corpus pipeline end to end on a small corpus."""

import random

import corpus_pipeline


def test_stages_and_run(spark, tmp_path):
    r = random.Random(1)
    syl = {"en": "th er an ing tion ou sh".split(), "fr": "eau eux ou tion que ai oi".split()}
    rows = []
    for i in range(120):
        lang = r.choice(["en", "fr"])
        rows.append((i, " ".join("".join(r.choices(syl[lang], k=r.randint(1, 4))) for _ in range(40)), lang, f"src{i % 5}", 1))
    rows += [(500, rows[3][1], "en", "src1", 1), (501, None, "en", "src1", 1), (502, "12 34", None, None, 1), (503, rows[4][1] + " mail a@b.example.com", "en", "src0", 1)]
    rows = [(i, t, g, s, len(t or ""), 9) for i, t, g, s, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, epochs int").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "pii", "mixing", "sentencepiece"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        ids = {x.doc_id for x in docs.collect()}
        if k == 0:
            assert not ids & {501, 502} and 500 in ids
        if k == 1:
            assert not ids & {500, 503} and {3, 4} <= ids
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(g.round_trip for g in got) and {g.doc_id for g in got} <= set(range(120))


def test_empty_null_and_repeated_rows(spark, tmp_path):
    r = random.Random(2)
    syl = {"en": "th er an ing tion ou sh".split(), "fr": "eau eux ou tion que ai oi".split()}
    words = lambda g, n: " ".join("".join(r.choices(syl[g], k=r.randint(1, 4))) for _ in range(n))
    rows = [(i, words("en" if i % 2 else "fr", 40), "en" if i % 2 else "fr", f"src{i % 3}", "x", 1.5) for i in range(60)]
    rows += [rows[5]] * 3  # the same row again
    rows += [(7, words("en", 40), "en", "src0", "x", None)]  # another text under a known id
    rows += [(None, words("fr", 40), "fr", "src1", "x", None), (None, None, None, None, None, None), (90, "", "en", "src0", "x", None)]
    rows += [(91, words("en", 30000), None, "src0", "x", None)]  # very long, language unknown
    schema = "doc_id long, text string, lang string, source string, _gw_base string, tokens double"
    for name, data in (("full", rows), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(data, schema).write.parquet(str(folder / "documents.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, docs, str(folder))
            assert out.columns == docs.columns, stage_name
            out.write.parquet(str(folder / f"s{k}"))
            docs = spark.read.parquet(str(folder / f"s{k}"))
            ids = sorted((x.doc_id for x in docs.collect()), key=str)
            if name == "empty":
                assert ids == []
            elif stage_name == "language_id":
                assert 90 not in ids and ids.count(5) == 4 and ids.count(None) == 1
                assert {x.lang for x in docs.where("doc_id = 91").collect()} == {"en"}
            elif stage_name == "near_duplicates":
                assert ids.count(5) == 1 and ids.count(7) == 1 and ids.count(None) == 1 and 91 in ids
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(folder))
        assert (last.count() == 0) == (name == "empty")


def test_every_language_is_learned_and_repeats_dont_fill_the_sample(spark):
    from gavelworks.llm import langid

    rows = [(10 * k + j, f"{'abcdefghijklmnopqrst'[k]}{'uvwxyz'[k % 6]}q " * 8, f"l{k:02d}") for k in range(20) for j in range(10)]
    df = spark.createDataFrame(rows + [(10, rows[10][1], "l01")] * 3000, "doc_id long, text string, lang string")
    model = langid.train(spark, df, most=40)
    assert model.langs == sorted({r[2] for r in rows})
    assert langid.allowance(spark, df, model, most=20) >= langid.MOST_UNSEEN


def test_of_unequal_rows_under_one_id_the_same_stays(spark):
    from gavelworks.llm import jaccard

    rows = [(1, t, x) for t in ("b text of some words here", "a text of some words here") for x in ("z", "y")] + [(2, None, "q"), (None, "n", "q"), (None, "n", "r")]
    seen = set()
    for k in range(3):
        df = spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, source string").repartition(3)
        seen.add(tuple(sorted(map(tuple, jaccard.stage(spark, df, "").collect()), key=str)))
    assert seen == {((1, "a text of some words here", "y"), (2, None, "q"), (None, "n", "q"), (None, "n", "r"))}
