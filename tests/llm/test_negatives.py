import numpy as np
import pytest
from spanforge.llm.negatives import Vectors, best_pairs, exact_scores, mine_negatives, quantised

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows, positives=5, negatives=10):
    vectors = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or None in v or not np.isfinite(v).all():
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        whole = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        vectors[i] = min(vectors.get(i, (label, whole)), (label, whole))
    out = []
    for a, (label, v) in vectors.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in vectors.items() if i != a and len(w) == len(v))
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(s, i) for s, i, other in scored if other != label and -30 * p <= -100 * s <= -90 * p][:negatives]
            out += [(a, positive, n + 1, i, -p, -s) for n, (s, i) in enumerate(fit)]
    return sorted(out)


def sample(rng, n=700, size=24):
    centers = rng.normal(size=(6, size)) + 0.4
    rows = []
    for i in range(n):
        v = centers[rng.integers(6)] * rng.choice([0.2, 1.0]) + rng.normal(size=size) * rng.choice([0.02, 0.5])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(rng.integers(10) if i % 3 else 4)))
    return rows


def odd(rows):
    v = rows[9][1]
    return [(None, v, 1), (1000, None, 1), (1100, v, None), (1200, [None, 1.0], 1), (1300, [float("nan")] * 24, 1), (1400, [float("inf")] * 24, 2),
            (1500, [], 3), (1501, [], 3), (1502, [], 4), (1600, v, 4), (1601, v, 4), (1602, v, 5), (1603, v, 5), (1600, v, 4), (1700, v, 3), (1700, v, 2),
            (1800, [3.0e5] * 24, 6), (1801, [2.0e5] * 24, 6), (1802, [1.5e5] * 24, 7), (-700, v, 1), (1900, [0.0] * 24, 8), (1901, [1.0, 2.0], 9)]


@pytest.mark.parametrize(("block_rows", "tile_anchors"), [(16384, 4096), (97, 3)])
def test_matches_brute_force(spark, block_rows, tile_anchors):
    rows = sample(np.random.default_rng(13))
    rows += odd(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in mine_negatives(quantised(df), block_rows=block_rows, tile_anchors=tile_anchors).collect())
    assert got == brute(rows)
    assert len(got) > 100


def test_no_rows_and_no_anchors(spark):
    assert mine_negatives(quantised(spark.createDataFrame([], SCHEMA))).collect() == []
    assert mine_negatives(quantised(spark.createDataFrame([(1, [1.0], 1, ""), (2, [1.0], 2, "")], SCHEMA))).collect() == []


def test_bounds_leave_the_best_and_spare_most_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    base = np.repeat(rng.integers(-200, 200, (40, 8)), 8, axis=1)
    x = base[rng.integers(40, size=3000)] + rng.integers(-4, 5, (3000, 64))
    rows = Vectors.of(np.arange(3000), np.zeros(3000), x)
    few = rows.take(slice(0, 16))
    scored = []
    monkeypatch.setattr("spanforge.llm.negatives.exact_scores", lambda a, r, i, j: scored.append(len(i)) or exact_scores(a, r, i, j))
    ok = few.ids[:, None] != rows.ids[None, :]
    every = np.full(16, np.inf)
    i, j, score = best_pairs(few, rows, ok, -every, every, 5)
    for a in range(16):
        want = sorted((-int(x[a] @ x[b]), b) for b in range(3000) if b != a)[:5]
        assert [(-s, b) for s, b in zip(score[i == a], j[i == a])] == want
    assert sum(scored) < 0.1 * 16 * 3000
