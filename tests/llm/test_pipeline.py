import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect(spark, tmp_path):
    plain = lambda i: " ".join(f"word{i}{chr(97 + k % 26)}{k}" for k in range(60 + (i * 7) % 80)) + ". It ends here."
    item = " ".join(f"item{k}" for k in range(30))
    rows = [(i, plain(i)) for i in range(60)] + [(60 + i, f"BUY!! NOW!! BUY!! NOW!! {i}!! " * 20) for i in range(60)]
    rows += [(200, plain(0) + " more"), (201, plain(201) + " " + item), (202, plain(202) + " mail me.x@host.org now"), (203, plain(203)), (203, plain(203)), (None, plain(204))]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t)) for i, t in rows], SCHEMA)
    for name, df in (
        ("documents", docs),
        ("labels", spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string")),
    ):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    out, now = {}, spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, now, d)
        assert got.columns == docs.columns
        got.write.parquet(f"{tmp_path}/out-{name}")
        now = spark.read.parquet(f"{tmp_path}/out-{name}")
        out[name] = [(r.doc_id, r.text, r.n_chars) for r in now.collect()]
    ids = {k: sorted(x[0] if x[0] is not None else -1 for x in v) for k, v in out.items()}
    assert ids["quality"] == [-1, *range(60), 200, 201, 202, 203, 203]
    assert ids["near_duplicates"] == [-1, *range(60), 201, 202, 203]
    assert ids["decontamination"] == [-1, *range(60), 202, 203] == ids["personal_data"]
    masked = {i: (t, n) for i, t, n in out["personal_data"]}
    assert "[EMAIL]" in masked[202][0] and "me.x@host.org" not in masked[202][0] and all(len(t) == n for t, n in masked.values())
    assert set(ids["mixing"]) < set(ids["personal_data"])
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == ids["mixing"]


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_row_that_stays_of_a_repeated_id_is_always_the_same(spark):
    texts = [" ".join(f"w{i}x{k}" for k in range(20)) for i in range(6)]
    rows = [(1, t, "en", s, n) for t, s, n in [(texts[0], "a", 1), (texts[1], "a", 1), (texts[1], None, 2), (None, "a", 0), (texts[2], "b", 1)]] + [(2, texts[3], "en", "a", 1), (None, texts[4], None, None, None), (None, texts[5], None, None, None)]
    got = []
    for part in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(part, SCHEMA).repartition(3)
        got.append({tuple(r) for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()})
    assert got[0] == got[1] == got[2] and sorted(str(r[0]) for r in got[0]) == ["1", "2", "None", "None"] and got[0] < set(rows)
