import hashlib
import random
import statistics

import numpy as np
import pytest
from spanforge.operators import nested, pools

FEATURES = ["a", "b", "c"]


def sample():
    rng = random.Random(3)
    rows = []
    for i in range(240):
        a, b = rng.gauss(0, 1), rng.gauss(5, 3)
        rows.append((i, f"g{i % 17}", f"s{i % 4}", a, b, 1.0, 2 * a - 0.3 * b + rng.gauss(0, 1)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, grp string, source string, a double, b double, c double, y double")


def ridge(train, alpha):
    x, y = np.array([r[3:6] for r in train]), np.array([r[6] for r in train])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    flat = scale < 1e-9
    z = np.where(flat, 0, (x - mean) / np.where(flat, 1, scale))
    b = np.linalg.solve(z.T @ z + (alpha + 1e-12) * np.eye(3), z.T @ (y - y.mean())) / np.where(flat, 1, scale)
    return lambda r: float(y.mean() + (np.array(r[3:6]) - mean) @ np.where(flat, 0, b))


def ntile(keys, n):
    size, extra = divmod(len(keys), n)
    out, at = {}, 0
    for f in range(n):
        for k in keys[at:at + size + (f < extra)]:
            out[k] = f + 1
        at += size + (f < extra)
    return out


def spearman(x, y):
    rank = lambda v: np.array([np.sum(v < u) + (np.sum(v == u) + 1) / 2 for u in v])
    return np.corrcoef(rank(np.array(x)), rank(np.array(y)))[0, 1]


def test_ranks_and_tiles_of_a_key_are_taken_by_ranges(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from spanforge.operators import order, ranks

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1.5, 2.0, round(rng.gauss(0, 3), 2)])) for i in range(400)] + [("one", 900, 1.0)]
    df = spark.createDataFrame(rows, "k string, id int, x double")
    got = order.ranks_within(df, ["k"], "x", "r")
    assert sorted(got.collect(), key=lambda r: r.id) == sorted(df.withColumn("r", ranks.average_rank("x", ["k"])).collect(), key=lambda r: r.id)
    sizes = order.in_ranges(df, ["x"]).groupBy("k", "_range_x").count()
    assert sizes.where("k = 'a'").count() > 2  # so no task holds a key
    known = df.where("k is not null").withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    tiled = order.numbers_within(known, ["k"], ["h", "id"], "place").select("id", order.tile(F.col("place"), F.col("_size"), 7).alias("t"))
    want = known.select("id", F.ntile(7).over(Window.partitionBy("k").orderBy("h", "id")).alias("t"))
    assert sorted(tiled.collect()) == sorted(want.collect())


def test_score_of_predictions_with_ties_and_of_flat_ones(spark):
    rng = random.Random(4)
    rows = [("a", float(rng.randrange(9)), float(rng.randrange(5))) for _ in range(90)] + [("flat", 1.0, float(i)) for i in range(5)] + [("one", 1.0, 1.0)]
    got = {r.k: r.score for r in nested.selection_score(spark.createDataFrame(rows, "k string, prediction double, y double"), ["k"], "y").collect()}
    mine = [r for r in rows if r[0] == "a"]
    assert abs(got["a"] - spearman([r[1] for r in mine], [r[2] for r in mine])) < 2e-9 and got["flat"] is None and got["one"] is None


def test_nested_selection_matches_plain_loops(spark):
    rows, seed = sample(), 5
    sha = lambda *parts: hashlib.sha256("|".join(parts).encode()).hexdigest()
    groups = sorted({r[1] for r in rows})
    outer = ntile(sorted(groups, key=lambda g: (sha(str(seed), g), g)), 5)
    want = {}
    for held in range(1, 6):
        rest = [g for g in groups if outer[g] != held]
        inner = ntile(sorted(rest, key=lambda g: (sha(str(seed), str(held), g), g)), 4)
        train = [r for r in rows if outer[r[1]] != held]
        scores = []
        for alpha in (0.1, 10.0, 1000.0):
            p, y = [], []
            for f in range(1, 5):
                fit = ridge([r for r in train if inner[r[1]] != f], alpha)
                own = [r for r in train if inner[r[1]] == f]
                p += [fit(r) for r in own]
                y += [r[6] for r in own]
            scores.append((-round(spearman(p, y), 9), abs(np.log10(alpha)), alpha))
        fit = ridge(train, min(scores)[2])
        want |= {r[0]: round(fit(r), 6) for r in rows if outer[r[1]] == held}
    got = nested.nested_predictions(frame(spark, rows), "grp", "y", FEATURES, [0.1, 10.0, 1000.0], seed=seed)
    assert {r.id: round(r.prediction, 6) for r in got.collect()} == want
    twice = nested.repeated_predictions(frame(spark, rows), "id", "grp", "y", FEATURES, [1.0], [1, 2]).collect()
    assert len(twice) == len(rows) and {r.repeats for r in twice} == {2}


def test_stacking_has_no_negative_weights(spark):
    rng = random.Random(2)
    rows = [(y := rng.gauss(0, 1), y + rng.gauss(0, 0.1), -y, rng.gauss(0, 1)) for _ in range(300)]
    w = nested.stack_weights(spark.createDataFrame(rows, "y double, good double, bad double, noise double"), "y", ["good", "bad", "noise"])
    assert w["good"] > 0.8 and w["bad"] == 0.0 and abs(w["noise"]) < 0.1


def test_scores_of_new_rows(spark):
    df = frame(spark, sample())
    fit, reference = nested.final_fit(df, "y", FEATURES, 1.0)
    out = nested.score_new(df.limit(10), fit, reference, FEATURES, "id", accepted=False).collect()
    assert sorted(r.batch_rank for r in out) == list(range(1, 11)) and {r.status for r in out} == {"research_only"}
    best = nested.compare_specs(df, "grp", "y", {"all": FEATURES, "flat": ["c"]}, [1.0], seed=1).collect()
    assert best[0].spec == "all" and best[0].score > 0.7


def test_controls_leave_their_own_fold_out(spark):
    df = spark.createDataFrame([(1, 1, "s", 1.0), (2, 2, "s", 3.0), (3, 2, "t", 8.0)], "id int, fold int, source string, y double")
    got = {r.id: r.prediction for r in nested.control_predictions(df, "source", "fold", "y", "source", "id").collect()}
    assert got == {1: 3.0, 2: 1.0, 3: 1.0}
    assert {r.prediction for r in nested.control_predictions(df, "constant", "fold", "y", "source", "id").collect()} == {5.5, 1.0}
    assert nested.control_predictions(df, "random", "fold", "y", "source", "id").count() == 3


def test_bundles_must_match(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 3)], "k int, x int"), spark.createDataFrame([(1, 5)], "k int, z int")
    assert pools.join_bundle({"a": a, "a2": a.withColumnRenamed("x", "w")}, "k").count() == 2
    with pytest.raises(Exception, match="isn't in every table once"):
        pools.join_bundle({"a": a, "b": b}, "k").collect()
    with pytest.raises(Exception, match="isn't uniform"):
        pools.require_uniform(a, "x").collect()
    assert pools.require_uniform(b, "z").count() == 1


def test_stored_fits_refuse_what_they_must(spark, tmp_path):
    from spanforge.operators import artifact
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random() if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame([(i, 2 * a + (b or 0.5), a, b) for i, a, b in rows], "id int, y double, a double, b double")
    path = str(tmp_path / "fit")
    with pytest.raises(ValueError, match="isn't accepted"):
        artifact.save_artifact(df, "y", ["a", "b"], 1.0, path, accepted=False)
    with pytest.raises(ValueError, match="forbidden inputs"):
        artifact.save_artifact(df, "y", ["a", "b"], 1.0, path, accepted=True, forbidden=["b"])
    artifact.save_artifact(df, "y", ["a", "b"], 1.0, path, accepted=False, forbidden=["percentile_PRIVATE"], allow_rejected=True)
    with pytest.raises(ValueError, match="experimental_rejected"):
        artifact.load_artifact(spark, path)
    held = artifact.load_artifact(spark, path, allow_rejected=True)
    scored = artifact.score_with(df.select("id", "a", "b"), held, "id").collect()
    assert sorted(r.batch_rank for r in scored) == list(range(1, 41)) and {r.status for r in scored} == {"experimental_rejected"}
    median = statistics.median(b for _, _, b in rows if b is not None)
    assert held.medians["b"] == median and all(r.b == median for r in scored if r.id % 5 == 0)
    with pytest.raises(ValueError, match="percentile_PRIVATE"):
        artifact.score_with(df.withColumn("Percentile_private", df.y), held, "id")
    with pytest.raises(ValueError, match="missing features"):
        artifact.score_with(df.select("id", "a"), held, "id")
    held.reference.limit(3).write.mode("overwrite").parquet(str(tmp_path / "other"))
    spark.read.parquet(str(tmp_path / "other")).write.mode("overwrite").parquet(f"{path}/reference")
    with pytest.raises(ValueError, match="digest"):
        artifact.load_artifact(spark, path, allow_rejected=True)


def test_acceptance_takes_size_gates_and_a_fresh_holdout(spark):
    from spanforge.operators import audit
    metrics = spark.createDataFrame([("n", 12.0), ("rho", 0.4), ("odd", float("nan"))], "metric string, value double")
    gates = lambda *g: spark.createDataFrame(list(g), "metric string, kind string, minimum double")
    status = lambda fresh, *g: audit.acceptance(metrics, gates(*g), fresh).first().status
    good = [("n", "size", 12.0), ("rho", "observed", 0.4), ("rho", "lower_bound", 0.0)]
    assert status(True, *good) == "accepted" and status(False, *good) == "internal_pass"
    assert status(True, *good, ("n", "size", 13.0)) == "insufficient"
    assert status(True, *good, ("odd", "observed", 0.0)) == status(True, *good, ("rho", "lower_bound", 0.4)) == "rejected"
    assert status(True) == "rejected"


def test_stacking_leaves_its_own_rows_out(spark):
    rng = random.Random(5)
    rows = [(i, i // 3, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(120)]
    df = spark.createDataFrame([(i, g, 2 * a + rng.gauss(0, 0.1), a, b) for i, g, a, b in rows], "id int, grp int, y double, a double, b double")
    out = nested.stacked_predictions(df, "grp", "y", {"good": ["a"], "noise": ["b"], "both": ["a", "b"]}, seed=1).collect()
    assert len(out) == 120 and len({(r.grp, r.outer) for r in out}) == 40
    assert sum((r.prediction - r.y) ** 2 for r in out) < 0.1 * sum(r.y ** 2 for r in out)
    changed = df.withColumn("y", df.y + (df.grp == 0).cast("double") * 1000)
    fold = next(r.outer for r in out if r.grp == 0)
    again = {r.id: r.prediction for r in nested.stacked_predictions(changed, "grp", "y", {"good": ["a"], "noise": ["b"], "both": ["a", "b"]}, seed=1).collect()}
    assert all(abs(again[r.id] - r.prediction) < 1e-9 for r in out if r.outer == fold)
    assert any(abs(again[r.id] - r.prediction) > 1 for r in out if r.outer != fold)


def test_drawn_aucs_by_small_blocks_equal_brute_force(spark):
    from hashlib import md5

    rows = [("a", y, i, n, (i * 7 + 3 * y) % 5) for y, n in ((0, 9), (1, 4)) for i in range(n)] + [("b", y, i, n, (i * 5 + y) % 3) for y, n in ((0, 3), (1, 11)) for i in range(n)]
    frame = spark.createDataFrame(rows, "ch string, _y int, _i int, _n int, _code int")
    got = {(r._r, r.ch): r.auc for r in nested._drawn_aucs(frame, "ch", 7, 5, draws_at_once=14, codes_at_once=2).collect()}
    code = {(ch, y, i): c for ch, y, i, _, c in rows}
    for r in range(7):
        for ch in "ab":
            side = [[code[ch, y, int(md5(f"5|{r}|{ch}|{y}|{i}".encode()).hexdigest()[:8], 16) % n] for c, y, i, n, _ in rows if c == ch and y == k] for k in (0, 1)]
            won = sum((q < p) + (q == p) / 2 for p in side[1] for q in side[0])
            assert abs(got.pop((r, ch)) - won / (len(side[0]) * len(side[1]))) < 1e-12
    assert not got


def test_rank_ensemble_takes_ranges_of_each_model(spark):
    import random

    rng = random.Random(2)
    rows = [(i, m, rng.choice([rng.random() * k, float(rng.randrange(4))])) for m, k in (("x", 1), ("y", 1000)) for i in range(200)] + [(200, "x", None)]
    got = {r.i: r.prediction for r in nested.rank_ensemble(spark.createDataFrame(rows, "i int, m string, s double"), "i", "m", "s").collect()}
    by = {m: [-1.0 if s is None else s for _, n, s in rows if n == m] for m in "xy"}
    shares = {}
    for i, m, s in rows:
        shares.setdefault(i, []).append(sum(v <= (-1.0 if s is None else s) for v in by[m]) / len(by[m]))
    assert all(abs(got[i] - sum(v) / len(v)) < 1e-12 for i, v in shares.items())
    plan = nested.rank_ensemble(spark.createDataFrame(rows, "i int, m string, s double"), "i", "m", "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "_range_" in plan


def test_rows_that_several_steps_read_are_worked_out_once(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def mark(x):
        seen.add(1)
        return x

    marked = F.udf(mark, "double").asNondeterministic()
    df = frame(spark, sample()[:40])
    nested.batch_rank(df.select("id", marked("y").alias("y")), "y", "id").collect()
    assert seen.value == 40
    nested.stacked_predictions(df.withColumn("y", marked("y")), "grp", "y", {"first": ["a"], "second": ["b"]}, seed=3).collect()
    assert seen.value <= 160


def test_replicates_side_by_side_are_those_one_by_one(spark, monkeypatch):
    from spanforge.operators import replicates, resample
    rng = random.Random(8)
    rows = [(i // 3 if i % 11 else None, "abc"[i * i % 7 % 3] if i % 13 else None, rng.choice([None, 0.5, round(rng.random(), 2)]), float(rng.randint(0, 9))) for i in range(150)]
    df = spark.createDataFrame([*rows, (900, "alone", 0.25, 3.0)], "g int, c string, y double, s double")
    found = lambda: sorted((r.metric, *(None if v is None else round(v, 9) for v in r[1:])) for r in resample.bundle_bootstrap(df, "g", "c", "y", "s", 20, 3).collect())
    with monkeypatch.context() as m:
        m.setattr(replicates, "CHANNEL_ROWS", 0)
        want = found()
    with monkeypatch.context() as m:
        m.setattr(replicates, "CELLS", 700)
        m.setattr(resample, "bootstrap_draws", None)
        assert found() == want


def test_values_and_not_rows_of_a_channel_are_ranked_over_all_channels(spark, monkeypatch):
    from spanforge.operators import replicates, resample
    rows = [(i // 3, "ab"[i % 2], (i * i % 5) / 4, float(i % 7 % 4)) for i in range(900)]
    df = spark.createDataFrame(rows, "g int, c string, y double, s double")
    sizes, plain = [], replicates.once

    def once(table, name):
        out = plain(table, name)
        if "cells" in out.columns:
            sizes.append(out.selectExpr("sum(length(cells))").first()[0])
        return out

    monkeypatch.setattr(replicates, "once", once)
    assert resample.bundle_bootstrap(df, "g", "c", "y", "s", 20, 3).count() == 6
    # 5 and 4 values of 2 channels in 20 replicates
    assert sizes and sum(sizes) <= 20 * 2 * (5 + 4) * 24
    assert replicates.CHANNEL_ROWS >= 5_000_000
