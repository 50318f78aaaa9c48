import random

from spanforge.operators import slates

SCHEMA = "longform_id int, scene_id int, score double, start_ms long, end_ms long, rank int"


def sample():
    rng = random.Random(7)
    rows = []
    for g in range(8):
        n = rng.choice([1, 3, 9, 40, 60])
        for i in range(n):
            s = rng.randrange(900_000)
            rows.append((g, i, float(rng.randrange(9)), s, s + rng.choice([0, 20_000, 45_000, 90_000]), i + 1))
    return rows


def center(r):
    return (r[3] + r[4]) / 2


def ratio(a, b):
    both = max(0, min(a[4], b[4]) - max(a[3], b[3]))
    short = min(a[4] - a[3], b[4] - b[3])
    return both / short if short > 0 else 0.0


def free(x, chosen, most):
    return all(x[1] != y[1] and ratio(x, y) <= most for y in chosen)


def by_group(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[3], r[4], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def events_of(items):
    clusters = []
    for x in items:
        links = []
        for c in clusters:
            def relation(y, x=x):
                near = max(0.0, 1 - abs(center(x) - center(y)) / (max(x[4] - x[3], y[4] - y[3], 1000) * 1.5))
                return round(max(ratio(x, y), 0.55 * near), 9)
            links.append(max(map(relation, c)))
        if links and max(links) >= 0.55:
            clusters[links.index(max(links))].append(x)
        else:
            clusters.append([x])
    reps = [min(c, key=lambda y: (-y[2], abs((y[4] - y[3]) / 1000 - 45), y[3], y[4], y[1])) for c in clusters]
    sizes = [len(c) for c in clusters]
    norm = lambda xs: [(x - min(xs)) / (max(xs) - min(xs)) if max(xs) > min(xs) else 1.0 for x in xs]
    return list(zip(reps, sizes, norm([r[2] for r in reps]), norm(sizes)))


def in_time(rows):
    return [r[1] for r in sorted(rows, key=lambda r: (center(r), -r[2], r[1]))]


def greedy(events, chosen, k, value, most):
    while len(chosen) < k:
        open_ = [(-round(value(e, chosen), 9), i) for i, e in enumerate(events) if free(e[0], [c[0] for c in chosen], most)]
        if not open_:
            break
        chosen.append(events[min(open_)[1]])
    return chosen


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.place):
        out.setdefault(r.longform_id, []).append(r.scene_id)
    return out


def test_events(spark):
    rows = sample()
    found = slates.cluster_events(spark.createDataFrame(rows, SCHEMA)).collect()
    have = {}
    for r in sorted(found, key=lambda r: r.place):
        have.setdefault(r.longform_id, []).append((r.scene_id, r.support, round(r.score_norm, 9), round(r.support_norm, 9)))
    assert have == {g: [(r[1], n, round(a, 9), round(b, 9)) for r, n, a, b in events_of(items)] for g, items in by_group(rows).items()}


def test_events_of_many_like_intervals_with_scenes_and_empty_ones(spark):
    rng = random.Random(3)
    rows = []
    for i in range(220):
        s = rng.randrange(120) * 500
        rows.append((i % 2, i, float(rng.randrange(4)), s, s + rng.choice([0, 0, 1000, 1000, 8000, 40_000]), rng.choice(["", "", "a", "b", "c|d"])))
    want = {}
    for g in (0, 1):
        clusters = []
        for x in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[3], r[4], r[1])):
            def relation(y, x=x):
                near = max(0.0, 1 - abs(center(x) - center(y)) / (max(x[4] - x[3], y[4] - y[3], 1000) * 1.5))
                return round(max(ratio(x, y), 0.75 if x[5] and x[5] == y[5] else 0.0, 0.55 * near), 9)
            links = [max(map(relation, c)) for c in clusters]
            if links and max(links) >= 0.55:
                clusters[links.index(max(links))].append(x)
            else:
                clusters.append([x])
        want[g] = [(min(c, key=lambda y: (-y[2], abs((y[4] - y[3]) / 1000 - 45), y[3], y[4], y[1]))[1], len(c)) for c in clusters]
    df = spark.createDataFrame(rows, "longform_id int, scene_id int, score double, start_ms long, end_ms long, ids string")
    have = {}
    for r in sorted(slates.cluster_events(df, scenes="ids").collect(), key=lambda r: r.place):
        have.setdefault(r.longform_id, []).append((r.scene_id, r.support))
    assert have == want


def test_slate_numbers_go_beyond_99(spark):
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([("v", i, 1000 * i, 1000 * i + 900, i, -i) for i in range(1, 151)], "longform_id string, scene_id int, start_ms long, end_ms long, rank int, value int")
    said = rows.select("longform_id", F.col("scene_id").alias("speech_id"), F.lit("x").alias("text"), "start_ms", "end_ms")
    found = slates.slate(rows, said, 150, lambda df, k: slates.select_by(df, "rank", k)).collect()
    assert sorted(r.candidate_id for r in found) == sorted(f"v_cand_{i:02d}" for i in range(1, 151))


def test_adaptive_events(spark):
    rows, k, want = sample(), 6, {}
    for g, items in by_group(rows).items():
        if len(items) <= k:
            want[g] = in_time(items)
            continue
        events = events_of(items)
        if len(events) <= k:
            want[g] = in_time([e[0] for e in events])
            continue
        cs = [center(e[0]) for e in events]
        span = max(1000.0, max(cs) - min(cs))

        def value(e, chosen):
            near = min(1.0, min(abs(center(e[0]) - center(c[0])) for c in chosen) / (span / 5)) if chosen else 0.0  # noqa: B023
            return 0.72 * e[2] + 0.22 * near + 0.06 * e[3]

        chosen = greedy(events, [], k, value, 0.62)
        rest = sorted((i for i, e in enumerate(events) if e[0][1] not in {c[0][1] for c in chosen}), key=lambda i: (-events[i][0][2], i))  # noqa: B023
        want[g] = in_time([e[0] for e in (chosen + [events[i] for i in rest])[:k]])
    assert got(slates.adaptive_events(spark.createDataFrame(rows, SCHEMA), k)) == want


def test_adaptive_coverage(spark):
    rows, k, want = sample(), 5, {}
    for g, items in by_group(rows).items():
        if len(items) <= k:
            want[g] = in_time(items)
            continue
        low, high = min(map(center, items)), max(map(center, items))
        late = [x for x in items if center(x) >= max(120_000, low + 0.08 * max(1000, high - low))]
        events = events_of(late if len(late) >= k else items)
        if len(events) <= k:
            want[g] = in_time([e[0] for e in events])
            continue
        cs = [center(e[0]) for e in events]
        low, span = min(cs), max(1000.0, max(cs) - min(cs))
        worth = lambda e: round(0.74 * e[2] + 0.16 * e[3] + 0.10 * max(0.0, 1 - abs((e[0][4] - e[0][3]) / 1000 - 45) / 45), 9)
        events = [events[i] for i in sorted(range(len(events)), key=lambda i: (-worth(events[i]), i))]  # noqa: B023
        chosen = []
        for b in range(k):
            for e in events:
                if min(k - 1, int((center(e[0]) - low) * k // span)) == b and free(e[0], [c[0] for c in chosen], 0.58) and len(chosen) < k:
                    chosen.append(e)
                    break

        def value(e, chosen):
            near = min(1.0, min(abs(center(e[0]) - center(c[0])) for c in chosen) / (span / (k - 1))) if chosen else 0.0  # noqa: B023
            return 0.68 * worth(e) + 0.32 * near  # noqa: B023

        # of equal values the earlier event of the clustering wins
        place = {e[0][1]: i for i, e in enumerate(events_of(late if len(late) >= k else items))}
        while len(chosen) < k:
            open_ = [(-round(value(e, chosen), 9), place[e[0][1]], e) for e in events if free(e[0], [c[0] for c in chosen], 0.58)]
            if not open_:
                break
            chosen.append(min(open_, key=lambda t: t[:2])[2])
        rest = [e for e in events if e[0][1] not in {c[0][1] for c in chosen}]
        want[g] = in_time([e[0] for e in (chosen + rest)[:k]])
    assert got(slates.adaptive_coverage(spark.createDataFrame(rows, SCHEMA), k)) == want


def test_coverage_bins_follow_the_duration(spark):
    rows = [(0, i, 1.0, 10_000 * i, 10_000 * i + 5000, i) for i in range(60)] + [(1, i, 1.0, 40_000 * i, 40_000 * i + 5000, i) for i in range(60)]
    found = got(slates.adaptive_coverage(spark.createDataFrame(rows, SCHEMA), 40, per_bin=2))
    assert {g: len(ids) for g, ids in found.items()} == {0: 10, 1: 26}  # ten minutes: 5 bins, nearly forty: 13
    for g, step in ((0, 10), (1, 40)):
        late = [i for i in range(60) if i * step + 2.5 >= max(120, 2.5 + 0.08 * 59 * step)]
        assert min(found[g]) >= min(late)


def test_timeline_scores(spark):
    rows, k = sample(), 5
    for quota in (False, True):
        want = {}
        for g, items in by_group(rows).items():
            items = sorted(items, key=lambda r: (-r[2], r[5], r[3], r[4], r[1]))
            low, high = min(map(center, items)), max(map(center, items))
            late = [x for x in items if center(x) >= (max(120_000, low + 0.08 * (high - low)) if quota else 0)]
            items = late if len(late) >= k else items
            if len(items) <= k:
                want[g] = in_time(items)
                continue
            low, span = min(map(center, items)), max(1000.0, max(map(center, items)) - min(map(center, items)))
            chosen = [x for x in items if center(x) >= low + 0.82 * span][:1] if quota else []
            for b in range(k):
                own = [x for x in items if min(k - 1, int((center(x) - low) * k // span)) == b and free(x, chosen, 0.45)]
                if own and len(chosen) < k:
                    chosen.append(own[0])
            for x in items:
                if len(chosen) < k and free(x, chosen, 0.45):
                    chosen.append(x)
            want[g] = in_time(chosen)
        assert got(slates.timeline_score(spark.createDataFrame(rows, SCHEMA), k, late_quota=quota)) == want


def test_strategies_and_bins(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    for name in ("rank", "overlap", "bins", "mmr"):
        assert slates.select_by(df, name, 3, score="score").count() > 0
    minutes = spark.createDataFrame([(10.0,), (15.0,), (15.1,), (22.0,), (90.0,)], "m double")
    assert [r[0] for r in minutes.select(slates.coverage_bins(minutes.m)).collect()] == [5, 5, 7, 9, 13]
