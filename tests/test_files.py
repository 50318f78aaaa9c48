import json

import pytest
from spanforge.operators import judge
from spanforge.sources import files
from spanforge.streaming.ingest import ingest_responses


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,x,note\n1, 2.5 ,"two\nlines, ""q"""\n2,bad,\n', encoding="utf-8")
    rows = files.read_csv(spark, str(tmp_path / "a.csv"), {"x": "double"}).orderBy("id").collect()
    assert [(r.id, r.x, r.note) for r in rows] == [("1", 2.5, 'two\nlines, "q"'), ("2", None, None)]
    assert files.read_strict_csv(spark, str(tmp_path / "a.csv"), ["id", "x", "note"], "id").count() == 2
    with pytest.raises(ValueError):
        files.read_strict_csv(spark, str(tmp_path / "a.csv"), ["id"], "id")
    with pytest.raises(Exception, match="blank or repeated"):
        files.read_strict_csv(spark, str(tmp_path / "a.csv"), ["id", "x", "note"], "note").collect()


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()] == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n[2]\n')
    with pytest.raises(Exception, match="ill-formed"):
        files.read_json_lines(spark, str(tmp_path / "b.jsonl"), "a int").collect()


def test_candidate_layouts(spark, tmp_path):
    items = [{"id": "x", "v": 1}, {"id": "y", "v": 2}]
    layouts = [json.dumps(items), json.dumps({"candidates": items}), "\n".join(map(json.dumps, items)), json.dumps({"candidates": items}, indent=1)]
    for i, text in enumerate(layouts):
        (tmp_path / f"{i}.json").write_text(text)
        assert sorted((r.id, r.v) for r in files.read_candidates(spark, str(tmp_path / f"{i}.json"), "id string, v int").collect()) == [("x", 1), ("y", 2)]
    (tmp_path / "one.json").write_text(json.dumps(items[0], indent=1))
    assert [r.id for r in files.read_candidates(spark, str(tmp_path / "one.json"), "id string, v int").collect()] == ["x"]


def test_results(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": [{"candidate_id": "x", "s": 1.5}]}')
    assert files.read_results(spark, str(tmp_path / "a.json"), "candidate_id", ["s"]).first().s == 1.5
    (tmp_path / "b.json").write_text('{"results": [{"candidate_id": "x", "s": NaN}]}')
    with pytest.raises(Exception, match="finite"):
        files.read_results(spark, str(tmp_path / "b.json"), "candidate_id", ["s"]).collect()


def test_fallback_sources_cues_and_sink(spark, tmp_path):
    a, b = (spark.createDataFrame([(i, n) for i in ids], "k int, v string") for ids, n in (([1, 2], "p"), ([2, 3], "f")))
    assert sorted((r.k, r.v, r.provider) for r in files.with_fallback(a, b, "k").collect()) == [(1, "p", "primary"), (2, "p", "primary"), (3, "f", "fallback")]
    events = spark.createDataFrame([(1, [(5, None, [("a\n",), ("b",)]), (9, 4, [(" ",)]), (7, 2, [("c",)])])], "k int, events array<struct<tStartMs:long,dDurationMs:long,segs:array<struct<utf8:string>>>>")
    assert sorted((r.start_ms, r.end_ms, r.text) for r in files.subtitle_cues(events, "k").collect()) == [(5, 6, "a b"), (7, 9, "c")]
    one = spark.createDataFrame([(1, 1, 0.0, 5.0), (1, 2, 0.0, 5.0), (1, 3, 9.0, 9.0), (1, 4, 7.0, 9.0)], "k int, rank int, pred_start_sec double, pred_end_sec double")
    two = one.withColumnsRenamed({"pred_start_sec": "start_sec", "pred_end_sec": "end_sec"})
    assert sorted((r.source, r.place, r.rank) for r in files.named_sources({"a": one, "b": two}, "k", 2).collect()) == [("a", 1, 1), ("a", 2, 4), ("b", 1, 1), ("b", 2, 4)]
    files.write_sparse([a, spark.createDataFrame([(9, 1.0)], "k int, w double")], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("w = 1 and v is null").count() == 1


def test_judge_tables(spark):
    c = spark.createDataFrame([("x", "abcdef"), ("y", "gh")], "id string, text string")
    tasks = judge.task_table(c, "id", {"text": 3}, "run", "p1", 2)
    assert tasks.count() == 4 and tasks.select("request_key").distinct().count() == 4
    assert json.loads(tasks.where("id = 'x'").first().payload) == {"id": "x", "text": "abc"}
    done = tasks.where("repeat = 1").select("request_key").withColumn("answer", tasks.request_key)
    hits, todo = judge.cache_lookup(tasks, done)
    assert {r.repeat for r in hits.collect()} == {1} and {r.repeat for r in todo.collect()} == {2}
    rows = spark.createDataFrame([
        ("a", "a", "score", 3, 4, ["x"]), ("b", "q", "score", 3, 4, None), ("c", "c", "maybe", 3, 4, None), ("d", "d", "score", 9, 4, None),
        ("e", "e", "abstain", 3, 1, None), ("f", "f", "abstain", 3, None, None), ("g", "g", "score", 3, 7, None), ("h", "h", "score", 3, 4, ["zz"]),
    ], "id string, answer_id string, verdict string, ev int, dim int, flags array<string>")
    got = {r.id: r.reason for r in judge.check_responses(rows, "id", ["dim"], ["ev"], ["x"]).collect()}
    assert got == {"a": None, "b": "id differs", "c": "unknown verdict", "d": "evidence ev", "e": "abstained with dim", "f": None, "g": "dimension dim", "h": "unknown flag"}


def test_choices(spark):
    rows = spark.createDataFrame([(1, [("b", 2), ("zz", 1), ("a", 1), ("b", 1), ("c", None)])], "k int, choices array<struct<id:string,rank:int>>")
    valid = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "k int, id string")
    assert [(r.place, r.id) for r in judge.choices(rows, valid, "k", 3).orderBy("place").collect()] == [(1, "a"), (2, "b"), (3, "c")]


def test_stream_takes_each_key_once_over_restarts(spark, tmp_path):
    schema = "candidate_id string, version int, score double, ingest_ts timestamp"
    src = tmp_path / "in"
    src.mkdir()

    def put(name, rows):
        (src / name).write_text("\n".join(json.dumps({"candidate_id": c, "version": v, "score": 1.0, "ingest_ts": f"2024-01-01T00:0{i}:00"}) for i, (c, v) in enumerate(rows)))

    def run():
        ingest_responses(spark, str(src), schema, str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()

    put("1.json", [("a", 1), ("a", 1), ("b", 1)])
    run()
    put("2.json", [("b", 1), ("b", 2)])
    run()
    run()
    got = sorted((r.candidate_id, r.version) for r in spark.read.parquet(str(tmp_path / "table")).collect())
    assert got == [("a", 1), ("b", 1), ("b", 2)]


def test_stream_keeps_late_new_keys_and_repeats_a_batch(spark, tmp_path):
    schema = "candidate_id string, version int, score double, ingest_ts timestamp"
    src, table, cp = tmp_path / "in", tmp_path / "table", tmp_path / "cp"
    src.mkdir()

    def put(name, rows):
        (src / name).write_text("\n".join(json.dumps({"candidate_id": c, "version": 1, "score": s, "ingest_ts": f"2024-01-{day:02d}T00:00:00"}) for c, s, day in rows))

    def run():
        ingest_responses(spark, str(src), schema, str(table), str(cp)).awaitTermination()

    def found():
        return sorted(((r.candidate_id or ""), r.score) for r in spark.read.parquet(str(table)).collect())

    put("1.json", [("1", 1.0, 10), (None, 1.0, 10)])
    run()
    put("2.json", [("2", 5.0, 3), ("2", 4.0, 1), ("3", 3.0, 11), ("1", 9.0, 1), (None, 2.0, 1)])
    run()
    assert found() == [("", 1.0), ("1", 1.0), ("2", 4.0), ("3", 3.0)]
    for name in ("1", ".1.crc"):  # as if it had stopped after writing the batch
        (cp / "commits" / name).unlink()
    run()
    assert found() == [("", 1.0), ("1", 1.0), ("2", 4.0), ("3", 3.0)]


def test_assets_accounts_and_line_files(spark, tmp_path):
    from spanforge.sources import files

    (tmp_path / "v1_asset.json").write_text('{"duration_ms": 5000, "resolution": 720, "persons": [{"person_id": "a"}, {"person_id": "b"}]}')
    (tmp_path / "v2_asset.json").write_text('{"duration_ms": 7000, "fallback_count": 2}')
    got = {r.longform_id: (r.duration_ms, r.person_count, r.fallback_count) for r in files.read_assets(spark, str(tmp_path)).collect()}
    assert got == {"v1": (5000.0, 2, 0.0), "v2": (7000.0, 0, 2.0)}
    for account, rows in (("x", "v1,READY\nv2,FAILED\n"), ("y", "v1,READY\n")):
        (tmp_path / "acc" / account).mkdir(parents=True)
        (tmp_path / "acc" / account / "inventory.csv").write_text("longform_id,status\n" + rows)
    assert {r.longform_id: r.accounts for r in files.ready_accounts(spark, str(tmp_path / "acc" / "*" / "inventory.csv")).collect()} == {"v1": ["x", "y"]}
    (tmp_path / "c.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert sorted(r.id for r in files.read_candidates(spark, str(tmp_path / "c.jsonl"), "id int").collect()) == [1, 2]


def test_assets_by_the_line_take_few_files(spark, tmp_path):
    (tmp_path / "many.jsonl").write_text('{"file": "v1_asset.json", "duration_ms": 5000, "persons": [{"person_id": "a"}]}\n{"file": "d/v2_asset.json", "duration_ms": 7000, "fallback_count": 2}\n{"file": "other.json"}\n')
    got = {r.longform_id: (r.duration_ms, r.person_count, r.fallback_count) for r in files.read_assets(spark, str(tmp_path / "many.jsonl")).collect()}
    assert got == {"v1": (5000.0, 1, 0.0), "v2": (7000.0, 0, 2.0)}


def test_assets_query_writes_no_file_for_each_recording(spark, tmp_path, monkeypatch):
    from spanforge.plans import sources

    users = 200
    spark.range(3 * users).selectExpr("id as event_id", "timestamp_ntz'2024-01-02 00:00:00' as ts", f"id % {users} as user_id", "'view' as event_type", "3.0D as value").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(sources, "shared_folder", lambda _: str(tmp_path / "shared"))
    assert sources.a7_assets_and_accounts(spark, str(tmp_path)).count() == users
    assert len(list((tmp_path / "shared").rglob("*.json"))) < users / 2
