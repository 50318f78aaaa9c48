import random

import corpus_pipeline


def test_stages_keep_clean_documents_and_act_in_turn(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(120)) for _ in range(120)]
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i, t in enumerate(texts):
        if i % 3 == 0 and i < 90:
            t += " villain rogue villain rogue"
        rows.append((i, t, "en", "s", len(t)))
    rows += [(500, texts[1], "en", "s", 1), (501, texts[100] + " " + passage, "en", "s", 1), (502, texts[2] + " " + passage, "en", "s", 1)]
    rows += [(503, None, "en", "s", None), (504, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(90)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.spanforge.scratch", str(tmp_path / "scratch"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == before.columns
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {i for i in range(120) if i % 3 or i >= 90}
    assert set(kept["toxicity"]) == clean | {500, 501, 502, 503, 504}
    assert 500 not in kept["simhash"] and clean <= set(kept["simhash"]) and {503, 504} & set(kept["simhash"]) == {503}
    last = kept["substrings"]
    assert set(last) == set(kept["simhash"]) and passage in last[501] and passage not in last[502]
    assert all(last[i] == texts[i] for i in clean)
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(last)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


STAGE_SCHEMA = "doc_id long, text string, doc int, spans int, component_id long, start int, k int, score double, fp long"


def stage_rows():
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    base, passage = text(150), text(70)
    rows = [(1, base), (2, base + " more"), (3, None), (4, ""), (5, " \t"), (None, base), (6, text(40) + " " + passage), (7, text(40) + " " + passage), (8, text(20_000)), (9, "one")]
    rows += [rows[6], (9, "one"), (9, "two words")]
    return [(d, t, 1, 2, 3, 4, 5, 0.5, 6) for d, t in rows]


def test_each_stage_takes_any_columns_odd_rows_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = stage_rows()
    docs = spark.createDataFrame(rows, STAGE_SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    stages = dict(corpus_pipeline.STAGES)
    out = {name: stage(spark, docs, str(tmp_path)).collect() for name, stage in stages.items()}
    for name in ("toxicity", "simhash", "substrings"):
        assert all(tuple(r)[2:] == (1, 2, 3, 4, 5, 0.5, 6) for r in out[name])
        assert stages[name](spark, docs.limit(0), str(tmp_path)).columns == docs.columns
    assert len(out["toxicity"]) == len(rows)
    ids = sorted(r.doc_id for r in out["simhash"] if r.doc_id is not None)
    assert ids == [1, 3, 6, 7, 8, 9, 9] and sum(r.doc_id is None for r in out["simhash"]) == 1
    kept = {}
    for r in out["substrings"]:
        kept.setdefault(r.doc_id, []).append(r.text)
    assert len(out["substrings"]) == len(rows) and kept[3] == [None] and kept[4] == [""] and kept[5] == [" \t"]
    assert len(kept[7][0].split()) == 40 and len(kept[6][0].split()) == 110 and len(kept[8][0].split()) == 20_000
    assert {r.doc_id for r in out["packing"]} == {r[0] for r in rows}
    assert all(stage(spark, docs.limit(0), str(tmp_path)).count() == 0 for stage in stages.values())
