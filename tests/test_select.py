import random

from spanforge.operators import select

SCHEMA = "longform_id int, scene_id int, value double, start_ms long, end_ms long, rank int"


def sample():
    rng = random.Random(4)
    rows = []
    for g in range(6):
        n = rng.randrange(1, 30)
        for i in range(n):
            s = rng.randrange(100_000)
            rows.append((g, i, float(rng.randrange(8)), s, s + rng.choice([0, 5_000, 20_000, 60_000]), i + 1))
    return rows


def ratio(a, b):
    both = max(0, min(a[4], b[4]) - max(a[3], b[3]))
    short = min(a[4] - a[3], b[4] - b[3])
    return both / short if short > 0 else 0.0


def groups(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[3], r[4], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def got(df):
    return {(r.longform_id, r.place): r.scene_id for r in df.collect()}


def numbered(chosen):
    return {(g, i + 1): r[1] for g, items in chosen.items() for i, r in enumerate(items)}


def test_suppression(spark):
    rows = sample()
    want = {}
    for g, items in groups(rows).items():
        kept = []
        for x in items:
            if len(kept) < 4 and all(ratio(x, y) <= 0.5 for y in kept):
                kept.append(x)
        want[g] = kept
    assert got(select.suppress_overlaps(spark.createDataFrame(rows, SCHEMA), 4, 0.5)) == numbered(want)


def test_bins_then_fill(spark):
    rows, want = sample(), {}
    for g, items in groups(rows).items():
        length = max(1, max(r[4] for r in items))
        kept = []
        ok = lambda x: all(ratio(x, y) <= 0.7 and x[1] != y[1] for y in kept)  # noqa: B023, E731
        for b in range(5):
            own = [x for x in items if min(4, (x[3] + x[4]) * 5 // (2 * length)) == b and ok(x)]
            if own and len(kept) < 6:
                kept.append(own[0])
        for x in items:
            if len(kept) < 6 and ok(x):
                kept.append(x)
        want[g] = kept
    assert got(select.bins_then_fill(spark.createDataFrame(rows, SCHEMA), 6, 5, 0.7)) == numbered(want)


def test_relevance_and_diversity(spark):
    rows, want = sample(), {}
    for g, items in groups(rows).items():
        length, kept = max(1, max(r[4] for r in items)), []
        for _ in range(4):
            free = [x for x in items if all(x[1] != y[1] and ratio(x, y) <= 0.6 for y in kept)]
            if not free:
                break

            def value(x):
                near = min((abs(x[3] + x[4] - y[3] - y[4]) / 2 for y in kept), default=None)  # noqa: B023
                spread = 1.0 if near is None else min(1.0, near / length / 0.13)  # noqa: B023
                return round(x[2] + 2.0 * spread - 1.5 * max((ratio(x, y) for y in kept), default=0.0), 9)  # noqa: B023

            kept.append(min(free, key=lambda x: (-value(x), -x[2], x[3], x[4], x[1])))
        want[g] = kept
    assert got(select.relevance_and_diversity(spark.createDataFrame(rows, SCHEMA), 4, 0.6, 2.0, 1.5)) == numbered(want)


def test_source_bands(spark):
    rows, want = sample(), {}
    for g, items in groups(rows).items():
        top, kept = max(r[5] for r in items), []
        ok = lambda x: all(ratio(x, y) <= 0.4 and x[1] != y[1] for y in kept)  # noqa: B023, E731
        for b in range(3):
            own = [x for x in items if min(2, (x[5] - 1) * 3 // top) == b and ok(x)]
            if own and len(kept) < 7:
                kept.append(own[0])
        for test in (ok, lambda x: all(x[1] != y[1] for y in kept)):  # noqa: B023
            for x in items:
                if len(kept) < 7 and test(x):
                    kept.append(x)
        want[g] = kept
    assert got(select.source_bands(spark.createDataFrame(rows, SCHEMA), 7, 3, 0.4, "rank")) == numbered(want)
