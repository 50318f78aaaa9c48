import pytest
from pyspark.sql import functions as F

from spanforge.functions import intervals as iv
from spanforge.functions import text as tx
from spanforge.operators import audit, evaluation, generate, joins, ranks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_interval_measures(spark):
    lit = F.lit
    assert one(spark, iv.overlap(lit(0.0), lit(5.0), lit(5.0), lit(9.0))) == 0
    assert one(spark, iv.hull_iou(lit(0.0), lit(2.0), lit(8.0), lit(10.0))) == 0
    assert one(spark, iv.hull_iou(lit(0.0), lit(6.0), lit(4.0), lit(10.0))) == 0.2
    assert one(spark, iv.hull_iou(lit(None).cast("double"), lit(6.0), lit(4.0), lit(10.0))) is None
    assert one(spark, iv.shortest_ratio(lit(0.0), lit(10.0), lit(8.0), lit(12.0))) == 0.5
    assert one(spark, iv.triangular(lit(45.0), 45, 45)) == 1 and one(spark, iv.triangular(lit(100.0), 45, 45)) == 0


def test_clock(spark):
    for text, want in (("1:05", 65), ("1:00:01.5", 3601.5), ("12", 12), ("x", 0), (None, None)):
        assert one(spark, tx.clock_to_seconds(F.lit(text).cast("string"))) == want
    assert [one(spark, tx.seconds_to_clock(F.lit(s))) for s in (5.9, 65.0, 3600.0, -4.0)] == ["0:05", "1:05", "1:00:00", "0:00"]
    with pytest.raises(Exception, match="not a clock time"):
        one(spark, tx.clock_to_seconds(F.lit("x"), strict=True))


def test_ranks_and_percentiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 4.0), ("b", 7.0)], "g string, v double")
    got = df.select("g", "v", ranks.rank_percentile("v", ["g"]).alias("p")).orderBy("g", "v").collect()
    assert [r.p for r in got] == [0.0, 50.0, 50.0, 100.0, 50.0]


def test_auc_kappa_and_correlation(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 1.0)], "y int, s double")
    assert ranks.roc_auc(df, "y", "s").first().auc == 0.5
    df = spark.createDataFrame([(1, 2.0), (0, 1.0)], "y int, s double")
    assert ranks.roc_auc(df, "y", "s").first().auc == 1.0
    assert ranks.roc_auc(df.where("y = 1"), "y", "s").first().auc is None
    same = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "a int, b int")
    assert ranks.weighted_kappa(same, "a", "b").first().kappa == 1.0
    assert ranks.weighted_kappa(same.where("a = 1"), "a", "b").first().kappa is None
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(ranks.pearson("x", "y").alias("r")).first().r is None


def test_tie_aware_hits_and_random_baselines(spark):
    df = spark.createDataFrame([(1, 80.0, True), (1, 80.0, False), (1, 70.0, False), (2, 5.0, False)], "pool int, score double, gold boolean")
    r = ranks.tie_aware_hits(df, "pool", "score", "gold").collect()
    assert len(r) == 1 and (r[0].hit_at_1, r[0].hit_at_3, r[0].mrr) == (0.5, 1.0, 0.75)
    b = ranks.random_baselines(spark.createDataFrame([(9, 1), (2, 1), (3, 0)], "size long, golds long")).orderBy("size").collect()
    assert (b[0].random_mrr, b[1].random_hit_at_1, b[1].random_mrr) == (0.75, 0.0, 0.0)
    assert abs(b[2].random_hit_at_1 - 1 / 9) < 1e-12 and abs(b[2].random_hit_at_3 - 1 / 3) < 1e-12


def test_ranked_dedupe(spark):
    rows = [(1, i, r, s, s + 5.0) for i, (r, s) in enumerate([(1, 0.0), (2, 10.0), (3, 0.0), (4, 20.0), (5, 10.0), (6, 30.0), (7, 40.0)])]
    df = spark.createDataFrame(rows, "pair int, n int, rank int, s double, e double")
    got = evaluation.ranked_dedupe(df, ["pair"], "s", "e", "n").orderBy("new_rank").collect()
    assert [r.new_rank for r in got] == [1, 2, 3, 4, 5] and [r.s for r in got] == [0.0, 10.0, 20.0, 30.0, 40.0]
    a = evaluation.dedupe_audit(df, ["pair"], "s", "e", "n").first()
    assert (a.removed, a.top_unique, a.underfilled) == (2, 3, False)


def overlapping(rows):
    return sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[3] and b[2] < a[3] and a[3] > a[2] and b[3] > b[2])


def test_interval_join_finds_each_pair_once(spark):
    import random
    rng = random.Random(1)
    rows = [(rng.randrange(3), i, s := rng.randrange(-5000, 5000), s + rng.choice([0, 1, 4, 700, 5000, 10**6])) for i in range(160)]
    df = spark.createDataFrame(rows, "k int, id int, start_ms long, end_ms long")
    want = overlapping(rows)
    assert sorted((r.l.id, r.r.id) for r in joins.interval_join(df, df, "k").collect()) == want
    assert "CartesianProduct" not in joins.interval_join(df, df, "k")._jdf.queryExecution().executedPlan().toString()
    met, apart = (sorted(r.id for r in joins.interval_join(df, df.where("id % 2 = 0"), "k", how=h).collect()) for h in ("left_semi", "left_anti"))
    assert met == sorted({a for a, b in want if b % 2 == 0}) and sorted(met + apart) == list(range(160))
    assert joins.interval_join(df, df.limit(0), "k").collect() == []


def test_interval_join_deals_long_intervals_and_a_hot_recording_evenly(spark):
    import random
    from pyspark.sql import functions as F
    rng = random.Random(2)
    week, lengths = 604_800_000, [1000, 30_000, 3_600_000, 86_400_000, 604_800_000]
    rows = [(rng.choice([0, *range(1, 3)]) if i % 3 else 0, i, s := rng.randrange(week), s + rng.choices(lengths, [90, 60, 8, 1, 1])[0]) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, id int, start_ms long, end_ms long")
    assert sorted((r.l.id, r.r.id) for r in joins.interval_join(df, df, "k").collect()) == overlapping(rows)
    dealt = joins.interval_join(df.where("id % 2 = 0"), df, "k").select(F.col("l.id"))._jdf.queryExecution().optimizedPlan()
    assert "Generate" in dealt.toString()
    sizes = [1, 2, 7, 8, 9, 63, 64, 65, 511, 512, 513, 8 ** 10, 8 ** 10 + 1, 8 ** 16 - 1, 8 ** 16, 8 ** 16 + 1, 8 ** 19]
    found = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", joins.length_class(F.lit(0), F.col("n")).alias("c")).collect()
    assert all(8 ** r.c >= r.n and (r.c == 0 or 8 ** (r.c - 1) < r.n) for r in found)


def test_union_length_merges_touching_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 2, 3), (1, 20, 21), (1, 30, 30)], "k int, start_ms long, end_ms long")
    assert joins.union_length(df, ["k"]).first().union_ms == 10


def test_unknown_keys_and_repeated_keys_are_errors(spark):
    a, b = (spark.createDataFrame([(i,) for i in ids], "id int") for ids in ([1, 2], [1]))
    assert joins.require_known(b, a, "id").count() == 1
    with pytest.raises(Exception, match="unknown id"):
        joins.require_known(a, b, "id").collect()
    with pytest.raises(Exception, match="repeated id"):
        audit.require_unique(a.union(b), "id").collect()


def test_spaced_windows(spark):
    df = spark.createDataFrame([(1, 0, 100), (2, 0, 10)], "id int, start_ms long, end_ms long")
    got = [(r.id, r.kind, r.start_ms, r.end_ms) for r in generate.spaced_windows(df, 40, 3).orderBy("id", "step").collect()]
    assert got == [(1, "spaced", 0, 40), (1, "spaced", 30, 70), (1, "spaced", 60, 100), (2, "source_full", 0, 10)]


def test_no_group_crosses_a_split(spark):
    df = spark.createDataFrame([(i // 3, "ab"[i % 2]) for i in range(90)], "g int, y string")
    split = audit.group_split(df, "g", "y", 0.4, 1)
    assert split.count() == 30 and split.select("g").distinct().count() == 30
    assert {r.role for r in split.collect()} == {"dev", "locked"}


def test_context_and_rubric(spark):
    assert one(spark, tx.context_near(F.lit("0123456789"), "before", 4)) == "6789"
    assert one(spark, tx.context_near(F.lit("0123456789"), "after", 4)) == "0123"
    scores = {"a": F.lit(4), "b": F.lit(4)}
    assert one(spark, tx.rubric_score(scores, {"a": 0.5, "b": 0.5})) == 100
    assert one(spark, tx.rubric_score({"a": F.lit(None).cast("int"), "b": F.lit(2)}, {"a": 0.5, "b": 0.5})) is None
    with pytest.raises(ValueError):
        tx.rubric_score({"a": F.lit(1)}, {"a": 0.5})


def test_evidence_cut_at_a_line_end_keeps_it(spark):
    c = spark.createDataFrame([("x", 1, 0, 1000)], "candidate_id string, longform_id int, start_ms long, end_ms long")
    s = spark.createDataFrame([(1, 1, 0, 10, "abcd"), (1, 2, 10, 20, "e"), (1, 3, 20, 30, "f")], "longform_id int, speech_id int, start_ms long, end_ms long, text string")
    assert [joins.evidence(c, s, caps=(n, n, n)).first().core for n in (4, 5, 6, 7, 8)] == ["abcd", "abcd\n", "abcd\ne", "abcd\ne\n", "abcd\ne\nf"]


def test_controls_by_parts_equal_ranks_of_all_draws(spark):
    from spanforge.operators import rollups

    rows = spark.createDataFrame([(i if i else None, "neg mid pos".split()[i % 7 % 3] if i % 11 else None, float(i * 7919 % 53)) for i in range(130)], "id long, label string, y double")
    drawn = rollups.hash_scores(rows, "id", 6, 3)
    u, c = F.col("random_score"), F.col("label")
    value = {"random": u, "oracle": F.when(c == "neg", 0).when(c == "mid", 1).when(c == "pos", 2) + u, "polar": F.when(c == "neg", u).when(c == "mid", 3 * u).when(c == "pos", 2 + u)}
    got = {r.kind: r for r in rollups.control_distributions(rows, "id", "label", "y", list(value), 6, 3, part_rows=20).collect()}
    for kind, v in value.items():
        found = [r.spearman for r in ranks.spearman(drawn.withColumn("v", v), "v", "y", ["simulation"]).collect()]
        assert got[kind].mean == pytest.approx(sum(found) / 6, abs=1e-12) and got[kind].valid == 6
    labels = rows.select("id", (F.col("y") % 2).cast("int").alias("z"))
    aucs = [r.auc for r in ranks.roc_auc(rollups.hash_scores(labels, "id", 6, 3), "z", "random_score", ["simulation"]).collect()]
    assert rollups.null_control(labels, "id", "z", 6, 3, part_rows=20).first().mean == pytest.approx(sum(aucs) / 6, abs=1e-12)
    assert rollups.control_distribution(rows.where("false"), "id", "label", "y", "polar", 6, 3).first().valid == 0


def test_score_sets_are_compared_by_ranges_and_their_first_rows(spark):
    rows = [(i, float(i % 7), float(i % 5) if i % 11 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    out = joins.compare_score_sets(df.select("id", F.col("x").alias("s")), df.select("id", F.col("y").alias("s")), "id", "s", top=10)
    known = [r for r in rows if r[2] is not None]
    tops = [{r[0] for r in sorted(known, key=lambda r: (-r[c], r[0]))[:10]} for c in (1, 2)]
    got = out.first()
    assert (got.n, got.top_overlap, got.top_jaccard) == (len(known), len(tops[0] & tops[1]), len(tops[0] & tops[1]) / len(tops[0] | tops[1]))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "row_number" not in plan  # ids aren't numbered, of either order only the first ones are taken
    none = joins.compare_score_sets(df.where("id < 0").select("id", F.col("x").alias("s")), df.select("id", F.col("y").alias("s")), "id", "s").first()
    assert (none.n, none.top_overlap, none.top_jaccard) == (0, 0, None)


def test_text_quality_takes_each_count_once(spark):
    from spanforge.functions import text as tx
    from spanforge.operators import scenes
    texts = [None, "", "  　\n", "Plain words?", "中文??�� a", "x\U0001f600鿿ꀀ", "1234567 [89]", "abcdefgh", "  ab cdef "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = scenes.text_quality(df, "doc_id", "text", "A-Za-z")
    want = df.select("doc_id", tx.garbled_share("text").alias("garbled"), scenes.text_usable("text", "A-Za-z").alias("usable"), tx.solid_length("text").alias("solid"))
    assert sorted(found.collect()) == sorted(want.collect())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 3
    odd = df.select("text", tx.count_class("text", tx.GARBLED).alias("n"), tx.count_class("text", r"\[\]()").alias("b")).collect()
    assert [r.n for r in odd] == [None if t is None else sum(c in "�?" or "㐀" <= c <= "䶿" or "一" <= c <= "鿿" for c in t) for t in texts]
    assert [r.b for r in odd] == [None if t is None else sum(c in "[]()" for c in t) for t in texts]


def test_tasks_over_lines_grow_with_their_rows(spark, tmp_path, monkeypatch):
    from spanforge.plans import slates, views
    lines = [(i // 4, i % 4, i // 3, float(i % 50), "NRAS"[i % 4] if i % 9 else None, 0.05) for i in range(1000)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, i // 5, 1.0) for i in range(250)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(views, "TASK_ROWS", 50)
    found = views.judgments(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 20
    want = {(a, b): None if flag is None or flag == "R" else 2 * q for a, b, _, q, flag, _ in lines}
    assert {(r.candidate_id, r.repeat): r.score for r in found.collect()} == want
    with monkeypatch.context() as m:
        m.setattr(slates.pl, "gold_pools", lambda golds, edits: edits)
        assert slates._pools(spark, str(tmp_path)).rdd.getNumPartitions() == 20


def test_hard_negatives_go_to_as_many_tasks_as_conversations_need(spark, monkeypatch):
    from spanforge.plans import scenes, views

    monkeypatch.setattr(views, "TASK_ROWS", 5)
    tasks = views.tasks_for(views.load(spark, "/root/testdata/sf0.001", "conversations"))
    plan = scenes.hard_negative_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert f", {tasks}), REPARTITION_BY_NUM" in plan
