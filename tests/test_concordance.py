import random
from collections import defaultdict

import numpy as np
import pytest
from spanforge.operators.concordance import CountTree, concordance, concordance_share, later_in_band

BANDS = [(0.1, 0.4), (0.01, None), (0.3, 0.3)]
SCHEMA = "g string, t double, s double, w int"


def brute(rows, bands=BANDS):
    known = [r for r in rows if r[1] is not None and r[2] is not None and r[1] == r[1] and r[2] == r[2]]
    out = defaultdict(lambda: [0, 0, 0])
    for i, (g, t, s, w) in enumerate(known):
        for h, u, v, x in known[i + 1:]:
            if g == h:
                for band, (low, high) in enumerate(bands):
                    if abs(t - u) >= low and (high is None or abs(t - u) <= high):
                        order = np.sign(t - u) == np.sign(s - v)
                        for c, hit in enumerate((True, order and s != v, s == v)):
                            out[str(g), band][c] += w * x * hit
    return {k: tuple(v) for k, v in out.items()}


def sample(rng, n):
    rows = [(rng.choice("aab"), rng.randrange(50) / 49, float(rng.randrange(30)), rng.randrange(3)) for _ in range(n)]
    rows += [("hot", 0.5, float(rng.randrange(60)), 1) for _ in range(n // 2)] + [("hot", rng.random(), 7.0, 2) for _ in range(n // 4)] + [("hot", rng.random(), rng.random(), 1) for _ in range(n // 4)]
    return rows + [(None, 0.1, 1.0, 1), (None, 0.3, 2.0, 1), (None, 0.3, 1.0, 1), ("a", None, 1.0, 1), ("a", 1.0, None, 1), ("a", float("nan"), 1.0, 1), ("one", 0.1, 0.2, 5), ("a", -0.0, -0.0, 1), ("a", 0.0, 0.0, 1)]


@pytest.mark.parametrize("block_rows", [1 << 18, 40, 7])
def test_counts_equal_those_of_all_pairs(spark, block_rows):
    rows = sample(random.Random(5), 240)
    got = concordance(spark.createDataFrame(rows, SCHEMA), ["g"], "t", "s", BANDS, "w", block_rows).collect()
    assert {(str(r.g), r.band): (r.pairs, r.right, r.tied) for r in got} == {k: v for k, v in brute(rows).items() if v[0]}


def test_shares_and_empty_tables(spark):
    rows = [(0.0, 1.0), (0.5, 2.0), (1.0, 2.0)]
    df = spark.createDataFrame(rows, "t double, s double")
    assert [tuple(r) for r in concordance_share(concordance(df, [], "t", "s", [(0.01, None)])).collect()] == [(0, 3, 2.5 / 3)]
    assert concordance(df.limit(0), [], "t", "s", [(0.01, None)]).collect() == []
    with pytest.raises(ValueError, match="lower gap"):
        concordance(df, [], "t", "s", [(0.0, None)])


def test_queries_of_a_large_group_are_counted_in_pieces():
    import pyarrow as pa
    from spanforge.operators.concordance import _by_group

    rng = np.random.default_rng(6)
    rows = [(g, kind, float(rng.integers(9)), float(rng.integers(9)), int(rng.integers(1, 4)), 0 if kind else None) for g in range(5) for kind in (0, 1) for _ in range(40 if g == 2 else 6)]
    table = pa.table(dict(zip(("g", "kind", "t", "s", "w", "edge"), (pa.array(c) for c in zip(*rows)))))
    got = defaultdict(lambda: np.zeros(3, int))
    for batch in _by_group(["g"], lambda t, own, i: np.searchsorted(t, own), at_once=5)(iter(table.to_batches(max_chunksize=7))):
        for r in batch.to_pylist():
            got[r["g"]] += [r["pairs"], r["right"], r["tied"]]
    for g in range(5):
        held, asked = ([r for r in rows if r[0] == g and r[1] == k] for k in (0, 1))
        pairs = [(h[4] * q[4], h[3] < q[3], h[3] == q[3]) for q in asked for h in held if h[2] < q[2]]
        assert got[g].tolist() == [sum(p[0] for p in pairs), sum(p[0] for p in pairs if p[1]), sum(p[0] for p in pairs if p[2])]


def test_count_tree():
    rng = np.random.default_rng(3)
    ranks, weights = rng.integers(0, 9, 70), rng.integers(0, 5, 70)
    start, length, rank = rng.integers(0, 40, 300), rng.integers(0, 31, 300), rng.integers(0, 10, 300)
    want = [int(weights[a:a + n][ranks[a:a + n] < r].sum()) for a, n, r in zip(start, length, rank)]
    assert CountTree(ranks, weights).below(start, start + length, rank).tolist() == want


@pytest.mark.parametrize("block_rows", [1 << 18, 16])
def test_rows_in_bands_equal_those_of_all_pairs(spark, block_rows):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), rng.choice([rng.random(), rng.randrange(20) / 20])) for i in range(150)] + [(150, "a", None), (151, None, 0.5), (None, "b", 0.4), (7, "c", 0.25)]
    got = {r.i: (r.own, r.other) for r in later_in_band(spark.createDataFrame(rows, "i long, g string, v double"), "g", "i", "v", 0.05, 0.15, block_rows).collect()}
    want = defaultdict(lambda: [0, 0])
    known = [r for r in rows if None not in r]
    for i, g, v in known:
        for j, h, w in known:
            if i < j and 0.05 <= abs(v - w) <= 0.15:
                want[i][g != h] += 1
    assert {i: n for i, n in got.items() if any(n)} == {i: tuple(n) for i, n in want.items()}
