import hashlib
import random

import pytest
from spanforge.operators.trees import trees_out_of_fold

FEATURES = ["a", "b", "c"]


def uniform(seed, kind, held, tree, node, i):
    return int(hashlib.md5(f"{seed}|{kind}|{held}|{tree}|{node}|{i}".encode()).hexdigest()[:8], 16) / 2 ** 32


def grow(rows, held, tree, node, depth, min_leaf, draws, seed):
    """A tree by plain recursion: a function of a row's features."""
    mean = sum(r[2] for r in rows) / len(rows)
    best = None
    if depth:
        drawn = sorted(range(3), key=lambda i: (uniform(seed, "pick", held, tree, node, i), i))[:draws]
        for i in drawn:
            xs = [r[3 + i] for r in rows]
            cut = round(min(xs) + uniform(seed, "cut", held, tree, node, i) * (max(xs) - min(xs)), 9)
            left = [r for r in rows if r[3 + i] <= cut]
            if min(len(left), len(rows) - len(left)) >= max(1, min_leaf):
                s, b, n, a = sum(r[2] for r in rows), sum(r[2] for r in left), len(rows), len(left)
                gain = round(b * b / a + (s - b) ** 2 / (n - a) - s * s / n, 9)
                if gain > 0:
                    best = min(best or (0, 9, 0), (-gain, i, cut))
    if not best:
        return lambda r: mean
    _, i, cut = best
    sides = [grow([r for r in rows if (r[3 + i] > cut) == side], held, tree, 2 * node + side, depth - 1, min_leaf, draws, seed) for side in (False, True)]
    return lambda r: sides[r[3 + i] > cut](r)


@pytest.mark.parametrize(("depth", "min_leaf", "share"), [(4, 1, 0.75), (2, 6, 1.0)])
def test_forest_equals_plain_recursion(spark, depth, min_leaf, share):
    rng = random.Random(9)
    rows = [(i, i % 3, round(rng.gauss(0, 1), 6), float(rng.randrange(5)), round(rng.random(), 6), 1.0) for i in range(70)]
    rows = [(*r[:2], round(r[2] + 3 * (r[3] > 2) + r[4], 6), *r[3:]) for r in rows]
    odd = [(100, 0, None, 1.0, 1.0, 1.0), (101, None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows + odd, "id int, fold int, y double, a double, b double, c double")
    got = {r.id: r.prediction for r in trees_out_of_fold(df, "id", "fold", "y", FEATURES, 3, depth, min_leaf, share, seed=4).collect()}
    want = {}
    for held in range(3):
        forest = [grow([r for r in rows if r[1] != held], held, t, 1, depth, min_leaf, max(1, int(share * 3)), 4) for t in range(3)]
        want |= {r[0]: sum(f(r) for f in forest) / 3 for r in rows if r[1] == held}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_no_rows(spark):
    df = spark.createDataFrame([], "id int, fold int, y double, a double, b double, c double")
    assert trees_out_of_fold(df, "id", "fold", "y", FEATURES, 2, 1).collect() == []


def test_rows_arent_shuffled_to_meet_their_cuts(spark, monkeypatch):
    from spanforge.operators import trees

    written = []
    once = trees.once
    monkeypatch.setattr(trees, "once", lambda df, name: written.append((name, df._jdf.queryExecution().executedPlan().toString())) or once(df, name))
    df = spark.createDataFrame([(i, i % 3, float(i % 7), float(i % 5), float(i % 4), 1.0) for i in range(60)], "id int, fold int, y double, a double, b double, c double")
    trees_out_of_fold(df, "id", "fold", "y", FEATURES, 2, 2).collect()
    plans = [plan for name, plan in written if name == "forest-splits"]
    assert len(plans) == 2 and all("SortMergeJoin" not in p and "BroadcastHashJoin" in p for p in plans)
