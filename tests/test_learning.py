import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanforge.functions import scores
from spanforge.operators import audit, joins, learning, pairwise, ranks


def test_region_weights(spark):
    lit = F.lit
    row = lambda a, b, **k: spark.range(1).select(scores.region_weight(lit(a), lit(b), lit(abs(a - b)), **k).alias("w")).first().w
    assert row(0.4, 0.6, local_boost=2.0) == 2.0 and row(0.05, 0.95, local_boost=2.0) == 1.0
    assert row(0.4, 0.6, local_boost=3.0, middle_boost=2.0) == 6.0 and row(0.05, 0.95, extreme=0.25) == 0.25


def test_pair_weights_are_equal_in_total_per_group(spark):
    rows = [(g, i, i / 10) for g, n in (("a", 4), ("b", 9)) for i in range(n)]
    pairs = joins.group_pairs(spark.createDataFrame(rows, "g string, id int, y double"), "g", "id", "y", 0.05)
    w = learning.pair_weights(pairs, "g", "y")
    totals = {r.g: r.t for r in w.groupBy("g").agg(F.sum("weight").alias("t")).collect()}
    n = w.count()
    assert abs(totals["a"] - totals["b"]) < 1e-9 and abs(sum(totals.values()) - n) < 1e-9


def test_banded_pairs_equal_all_pairs_within_the_band(spark):
    rows = [("g", i, (i * 37 % 100) / 100) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, id int, y double")
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if 0.1 <= abs(a[2] - b[2]) <= 0.25}
    got = {(r.a.id, r.b.id) for r in joins.group_pairs(df, "g", "id", "y", 0.1, 0.25).collect()}
    assert got == want


def test_weights_of_pairs_are_summed_without_listing_pairs(spark, monkeypatch):
    rows = [(g, i, (i * 37 % 101) / 100) for g in "abc" for i in range(60 if g != "c" else 1)] + [("a", 3, 0.5), ("b", None, 0.5), (None, 1, 0.5), ("a", 70, None)]
    df = spark.createDataFrame(rows, "g string, id int, y double")
    for low, high in ((0.03, 0.15), (0.05, 0.9), (0.01, 0.05)):
        spec = dict(local_boost=2.0, middle_boost=1.5, extreme=0.25)
        w = learning.pair_weights(joins.group_pairs(df, "g", "id", "y", low, high), "g", "y", **spec)
        want = sorted(w.groupBy("g").agg(F.count("*"), F.round(F.sum("weight"), 6), F.round(F.max("weight"), 9)).collect())
        with monkeypatch.context() as m:
            m.setattr(joins, "group_pairs", None)
            found = learning.pair_weight_totals(df, "g", "id", "y", low, high, **spec)
            assert sorted(found.select("g", "pairs", F.round("total", 6), F.round("largest", 9)).collect()) == want


def test_ranker_learns_an_order(spark):
    rows = [(i, "g", " ".join(["good"] * (i % 5) + ["dull"] * (4 - i % 5)), (i % 5) / 4) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, g string, text string, y double")
    features = learning.tf_idf(df, "id", "text", 2, 3, max_share=1.0)
    pairs = learning.pair_weights(joins.group_pairs(df.select("id", "g", "y"), "g", "id", "y", 0.2), "g", "y")
    model = learning.fit_pairwise(learning.pair_differences(pairs, features, "id", "y"), features)
    scored = df.select("id", "g", "y").join(learning.linear_scores(features, model, "id"), "id")
    assert ranks.pair_accuracy(joins.group_pairs(scored, "g", "id", "y", 0.2), "y", "score").first().accuracy == 1.0


@pytest.mark.parametrize("spec", [{}, {"local": (0.1, 0.2), "local_boost": 2.0, "middle_boost": 1.5, "extreme": 0.25, "middle": (0.45, 0.55)}])
def test_banded_ranker_is_that_of_listed_pairs_and_lists_none(spark, monkeypatch, spec):
    rng = random.Random(5)
    words = ["good", "dull", "fine", "odd", "long", "bare"]
    rows = [(i, "g" if i % 3 else "h", " ".join(rng.choices(words, k=rng.randint(1, 6))), rng.random()) for i in range(120)] + [(200, None, "good", 0.5), (201, "g", "dull", None), (202, "alone", "fine", 0.5)]
    df = spark.createDataFrame(rows, "id int, g string, text string, y double")
    features = learning.tf_idf(df, "id", "text", 2, 3, max_share=1.0)
    listed = learning.pair_weights(joins.group_pairs(df.select("id", "g", "y"), "g", "id", "y", 0.1, 0.3), "g", "y", **spec)
    want = {r.term: r.coefficient for r in learning.fit_pairwise(learning.pair_differences(listed, features, "id", "y"), features, iterations=200).collect()}
    with monkeypatch.context() as m:
        m.setattr(joins, "group_pairs", None)
        m.setattr(pairwise, "BLOCK_ROWS", (16, 16))
        m.setattr(pairwise, "CELLS", 64)
        found = {r.term: r.coefficient for r in pairwise.fit_banded(df, features, "g", "id", "y", 0.1, 0.3, iterations=200, **spec).collect()}
    assert found.keys() == want.keys() and max(abs(found[t] - want[t]) for t in want) < 0.02 * max(map(abs, want.values()))


def test_features_of_the_banded_ranker_are_kept_once(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "g", " ".join(rng.choices(["good", "dull", "fine", "odd"], k=4)), rng.random()) for i in range(160)]
    df = spark.createDataFrame(rows, "id int, g string, text string, y double")
    features = learning.tf_idf(df, "id", "text", 2, 3, max_share=1.0)
    kept = []

    def first_step(value_of, start, *_):
        value_of(start)
        kept.append(sum(r.diskSize() for r in spark.sparkContext._jsc.sc().getRDDStorageInfo()))
        return start

    monkeypatch.setattr(pairwise, "BLOCK_ROWS", (16, 16))
    monkeypatch.setattr(pairwise, "minimised", first_step)
    for low, high in ((0.1, 0.11), (0.01, 0.9)):
        pairwise.fit_banded(df, features, "g", "id", "y", low, high)
    assert 0 < kept[1] < 1.2 * kept[0]


def test_grams_are_made_where_their_text_is(spark):
    rng = random.Random(6)
    rows = [(i % 50 if i % 17 else None, " ".join(rng.choices(["Good", "d\u00fcll", "o", "\U0001d49cx"], k=rng.randint(0, 6))) if i % 13 else None, i % 4 > 0) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, text string, known boolean")
    for kind, low, high in (("char", 2, 4), ("word", 1, 2)):
        found = learning.tf_idf(df, "id", "text", low, high, most_terms=30, train=F.col("known"), **({"kind": kind} if kind == "word" else {}))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "hashpartitioning(id" in plan
        counts, train = {}, {}
        for i, text, known in rows:
            words = (text or "").lower().split()
            for w in words if kind == "char" else [""]:
                w = f" {w} "
                grams = [w[j:j + n] for n in range(low, min(high, len(w)) + 1) for j in range(len(w) - n + 1)] if kind == "char" else [" ".join(words[j:j + n]) for n in (1, 2) for j in range(len(words) - n + 1)]
                for g in grams:
                    counts.setdefault((i, known), Counter())[g] += 1
        for (_, known), tf in counts.items():
            for g, k in tf.items():
                a, b = train.get(g, (0, 0))
                train[g] = (a + known, b + known * k)
        n = sum(known for *_, known in rows)
        kept = sorted((g for g, (d, _) in train.items() if 2 <= d <= 0.98 * n), key=lambda g: (-train[g][1], g.encode()))[:30]
        idf = {g: math.log((1 + n) / (1 + train[g][0])) + 1 for g in kept}
        raw = [(i, g, (1 + math.log(k)) * idf[g]) for (i, _), tf in counts.items() for g, k in tf.items() if g in idf]
        norm = {}
        for i, _, w in raw:
            norm[i] = norm.get(i, 0.0) + w * w
        order = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
        want = sorted(((i, g, round(w / math.sqrt(norm[i]), 9)) for i, g, w in raw), key=order)
        assert sorted(((r.id, r.term, round(r.weight, 9)) for r in found.collect()), key=order) == want and want


def test_exact_position_tail(spark):
    df = spark.createDataFrame([(3, 1, 1)], "n long, g long, hit int")
    assert abs(learning.exact_position_tail(df, "n", "g", "hit", 1).first().p_value - 1 / 3) < 1e-12
    df = spark.createDataFrame([(2, 1, 1), (4, 1, 0)], "n long, g long, hit int")
    assert abs(learning.exact_position_tail(df, "n", "g", "hit", 1).first().p_value - (1 - 0.5 * 0.75)) < 1e-12


def test_exact_position_tail_of_more_pools_than_one_fold_and_of_none(spark):
    import math
    import random

    kinds = [(20, 1, 15_000, 700), (10, 1, 9_000, 930), (3, 3, 4, 4), (5, 0, 7, 0)]
    rows = [(n, g, int(i < hits)) for n, g, pools, hits in kinds for i in range(pools)]
    random.Random(2).shuffle(rows)
    got = learning.exact_position_tail(spark.createDataFrame(rows, "n long, g long, hit int"), "n", "g", "hit", 1).first()

    def term(n, p, x):
        return math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p))

    above = [0.0]
    for x in range(2_000, -1, -1):
        above.append(above[-1] + term(9_000, 0.1, x))
    above.reverse()
    want = sum(term(15_000, 0.05, x) * (above[max(0, 1_630 - x)] if 1_630 - x < len(above) else 0.0) for x in range(2_000))
    assert (got.pools, got.hits) == (24_011, 1_634) and 0.2 < want < 0.8 and abs(got.p_value - want) < 1e-8
    none = learning.exact_position_tail(spark.createDataFrame([], "n long, g long, hit int"), "n", "g", "hit", 1).collect()
    assert [tuple(r) for r in none] == [(0, None, None)]


def test_shortcut_and_gates(spark):
    df = spark.createDataFrame([("a", "x", "dev"), ("a", "y", "dev"), ("a", "y", "dev"), ("b", "x", "locked"), ("a", "x", "locked")], "s string, y string, role string")
    assert sorted((r.s, r.predicted) for r in audit.source_shortcut(df, "s", "y", "role").collect()) == [("a", "y"), ("b", "y")]
    metrics = spark.createDataFrame([("m", float("nan")), ("n", 2.0)], "metric string, value double")
    gates = spark.createDataFrame([("m", "observed", 0.0), ("n", "lower_bound", 2.0), ("n", "observed", 2.0)], "metric string, kind string, minimum double")
    assert sorted((r.metric, r.kind, r.passed) for r in audit.gate_report(metrics, gates).collect()) == [("m", "observed", False), ("n", "lower_bound", False), ("n", "observed", True)]


def test_calibration_without_keys_and_of_flat_or_missing_training(spark):
    from spanforge.operators import learning
    scores = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 5.0)], "fit string, s double")
    training = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0)], "fit string, s double")
    got = lambda kind, keys: sorted((r.fit, r.s, None if r.calibrated is None else round(r.calibrated, 6)) for r in learning.calibrated(scores, training, "s", kind, keys).collect())
    assert got("raw", []) == [("a", 1.0, 1.0), ("a", 3.0, 3.0), ("b", 5.0, 5.0), ("c", 5.0, 5.0)]
    assert got("zscore", ["fit"]) == [("a", 1.0, -1.224745), ("a", 3.0, 1.224745), ("b", 5.0, 0.0), ("c", 5.0, None)]
    assert got("ecdf", ["fit"]) == [("a", 1.0, 0.375), ("a", 3.0, 0.875), ("b", 5.0, 0.75), ("c", 5.0, 0.5)]
    assert got("ecdf", []) == [("a", 1.0, 0.3), ("a", 3.0, 0.7), ("b", 5.0, 0.9), ("c", 5.0, 0.9)]
