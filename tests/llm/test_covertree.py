import numpy as np
import pytest
from spanforge.llm.covertree import LEAF, Links, cover_tree, embedding_links, traverse

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, cosine=0.98):
    def usable(v, label):
        return label is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)

    ok = [usable(v, label) for _, v, label in rows]
    links = [set() for _ in rows]
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows):
            if i != j and ok[i] and ok[j] and label == other and len(v) == len(w):
                a, b = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i].add(j)
    comp = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            low = min([comp[i], *(comp[j] for j in near)]) if near else comp[i]
            if low != comp[i]:
                comp[i], changed = low, True
    return sorted((r[0], len(links[i]), comp[i], comp[i] == r[0]) for i, r in enumerate(rows))


def sample(n, rng):
    rows = []
    centers = rng.normal(size=(4, 8))
    for i in range(n):
        kind = i % 4
        v = rng.normal(size=8) if kind == 0 else centers[i % 3] + rng.normal(size=8) * rng.choice([0.01, 0.08, 0.3])
        rows.append((i + 5, [float(x) for x in v.astype(np.float32)], int(rng.integers(2))))
    return rows


@pytest.mark.parametrize(("cells", "shard"), [(None, 2048), (3, 2048), (4, 20), (40, 5), (1, 17)])
def test_links_match_brute_force(spark, cells, shard):
    rng = np.random.default_rng(2)
    rows = sample(260, rng)
    rows += [(900 + i, rows[3][1], rows[3][2]) for i in range(4)] + [(950, [2 * x for x in rows[3][1]], rows[3][2])]
    rows += [(1, None, 0), (2, [0.0] * 8, 0), (3, [float("nan")] * 8, 0), (4, rows[3][1], None), (970, [1.0, None], 0),
             (971, [float("inf"), 1.0], 0), (972, [], 0), (973, [1.0, 0.0], 0), (974, [1.0, 0.01], 0)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in embedding_links(df, cells=cells, shard_size=shard).collect())
    assert got == brute(rows)


def test_dense_groups_are_counted_without_their_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in (np.ones(8) + rng.normal(size=8) * 0.002).astype(np.float32)], 1) for i in range(400)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    assert {(r.n_links, r.component_id) for r in embedding_links(df, shard_size=90).collect()} == {(399, 0)}


def test_no_rows_and_null_ids(spark):
    assert embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, [1.0], 1, ""), (5, [1.0], 1, ""), (5, [1.0], 1, "")], SCHEMA)
    assert sorted((r.vec_id is None, r.n_links, r.kept) for r in embedding_links(df).collect()) == [(False, 1, True), (False, 1, True), (True, 0, True)]


def test_trees_are_nested_separated_and_covering():
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=(1, 6)) + 0.05 * rng.normal(size=(700, 6)), np.repeat(rng.normal(size=(1, 6)), 100, axis=0)])
    units = v / np.linalg.norm(v, axis=1)[:, None]
    stack, seen = [cover_tree(units, np.arange(len(units)))], 0
    while stack:
        node = stack.pop()
        gaps = np.linalg.norm(units[node.points] - node.center, axis=1)
        assert gaps.max() <= node.radius + 1e-12
        if node.leaf:
            assert len(node.points) <= LEAF or node.radius < 1e-5
            seen += len(node.points)
            continue
        seen += len(node.singles)
        below = np.concatenate([node.singles, *(c.points for c in node.children)])
        assert sorted(below) == sorted(node.points)
        assert any((c.center == node.center).all() for c in node.children) or (units[node.singles] == node.center).all(axis=1).any()
        centers = np.concatenate([units[node.singles], *(c.center[None] for c in node.children)])
        apart = np.linalg.norm(centers[:, None] - centers[None], axis=2) + 9 * np.eye(len(centers))
        assert apart.min() > node.radius / 2 - 1e-6 and all(c.radius <= node.radius / 2 + 1e-6 for c in node.children)
        stack += node.children
    assert seen == len(units)


def test_dual_traversal_finds_the_pairs_of_two_trees():
    rng = np.random.default_rng(5)
    center = rng.normal(size=8)
    for spread in (0.02, 0.08, 0.2, 2.0):
        v = center + spread * rng.normal(size=(900, 8))
        units = v / np.linalg.norm(v, axis=1)[:, None]
        links = Links(np.ones(900, np.int64))
        traverse(units, cover_tree(units, np.arange(400)), cover_tree(units, np.arange(400, 900)), links, 0.98)
        want = units[:400] @ units[400:].T >= 0.98
        assert (links.counts == np.concatenate([want.sum(axis=1), want.sum(axis=0)])).all()
