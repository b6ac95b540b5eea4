"""The pipeline stage by stage, each against its input."""

from pyspark.sql import functions as F


def test_stages(spark, data):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mixing", "sentencepiece"]
    for name, stage in c.STAGES:
        out = c.materialize(stage(spark, docs, data))
        if name == "sentencepiece":
            assert out.count() == docs.count() and out.where("not round_trip").isEmpty()
            break
        assert out.columns == docs.columns
        if name in ("toxicity", "simhash_near_dedup"):
            assert out.join(docs, docs.columns, "left_anti").isEmpty() and 0 < out.count() <= docs.count()
        if name == "simhash_near_dedup":
            from tessel.llm import jaccard_prefix

            rows = [(r.doc_id, r.text) for r in docs.dropDuplicates(["doc_id"]).collect()]
            assert len(rows) == docs.count()
            assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(set(jaccard_prefix.brute_force(rows).values()))
        if name == "pii":
            assert out.count() == docs.count()
            assert out.where(F.col("text").rlike(r"@mail[0-9]|\) 555-")).count() <= 1
        docs = out


def test_awkward_rows(spark, data):
    import corpus_pipeline as c

    rows = [(1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "no id here", "en", "a", 10), (None, "no id here", "en", "a", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = c.near_duplicates(spark, docs, data).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in one) == [(-1, "no id here"), (1, "one two three"), (2, "")]
    for _, stage in c.STAGES:
        docs = c.materialize(stage(spark, docs, data))
    assert docs.count() > 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in c.STAGES:
        empty = c.materialize(stage(spark, empty, data))
    assert empty.count() == 0


def test_near_copies_of_five_words(spark, data):
    import random

    import corpus_pipeline as c
    from tessel.llm import jaccard_prefix

    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 40))
    rows = []
    for g in range(15):
        base = [word() for _ in range(rng.choice([3, 8, 60, 300]))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 35))):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows) * 3 + 1, " ".join(w) + rng.choice(["", "\n", " and a common line at the end of many texts"])))
    rows += [(500, None), (501, ""), (502, " "), (503, "One Two"), (504, "one  two")]
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = jaccard_prefix.brute_force(rows)
    for most in (2048, 2):
        assert {r.doc_id: r.component_id for r in jaccard_prefix.near_duplicates(docs, most=most).collect()} == want
    assert sorted(r.doc_id for r in c.near_duplicates(spark, docs, data).collect()) == sorted(set(want.values()))


def test_a_repeated_id_with_other_texts(spark, data):
    import corpus_pipeline as c

    a, b, x = "one text of seven words in all", "another one that shares nothing with it", "a third text without any copy here"
    rows = [(5, a), (5, b), (3, x), (7, x), (7, "and a fourth text of eight lone words"), (None, a), (None, "only nameless rows have this text here"), (None, "only nameless rows have this text here")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, 2) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    out = c.near_duplicates(spark, docs, data)
    assert out.columns == docs.columns
    want = [(-1, "only nameless rows have this text here"), (3, x), (5, a), (5, b), (7, "and a fourth text of eight lone words")]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in out.collect()) == sorted(want)
