from itertools import combinations

import xxhash
from spanforge.llm.simhash import fingerprint, similar_components, simhash_components

SCHEMA = "doc_id long, text string, fp string, component_id long"


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {ord(c): " " for c in "\t\n\v\f\r"}).split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_that_of_a_plain_count():
    for text in [None, "", " \n", "one", "one two", "É two\x1cthree FOUR", "a b c d " * 400, "x y z " + "q r s t u " * 77]:
        assert fingerprint(text) == brute_fingerprint(text)


def brute_components(rows):
    fps = {d: brute_fingerprint(t) for d, t in rows}
    comp = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= 2 and comp[a] != comp[b]:
                comp[a] = comp[b] = min(comp[a], comp[b])
                changed = True
    return {(d, f"{fps[d]:016x}", comp[d]) for d, _ in rows}


def texts():
    base = " ".join(f"w{i * 7919 % 1009}" for i in range(400))
    words = base.split()
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one"), (4, "One"), (5, base), (6, base), (7, base + " tail")]
    for i in range(40):
        edited = words[:]
        edited[i * 9] = f"changed{i}"
        rows.append((10 + i, " ".join(edited)))
    rows += [(100 + i, f"other text number {i} of its own kind {i * i}") for i in range(30)]
    return rows


def test_components_match_brute_force_also_when_shards_are_split(spark):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    want = brute_components(rows)
    for size in (4096, 5):
        got = {tuple(r) for r in simhash_components(docs, shard_size=size).collect()}
        assert got == want


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "", 0), (1, "a b c", "", 0), (None, "a b c", "", 0)], SCHEMA)
    got = simhash_components(docs).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got) == [(False, 1), (False, 1), (True, 1)]
    assert simhash_components(docs.limit(0)).count() == 0


def test_similar_components_match_brute_force(spark):
    import random

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([30, 200, 600]))]
        for v in range(8):
            text = base[:]
            for _ in range(rng.choice([0, 1, 2, 6, 20]) * len(base) // 200):
                text[rng.randrange(len(text))] = word()
            rows.append((g * 10 + v, " ".join(text)))
    rows += [(500, None), (501, " "), (502, "two words"), (503, "Two words")]
    sets = {d: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for d, t in rows}
    comp = {d: d for d, _ in rows}
    for _ in range(10):
        for a, b in combinations(sets, 2):
            either = len(sets[a] | sets[b])
            if (len(sets[a] & sets[b]) / either >= 0.8) if either else True:
                comp[a] = comp[b] = min(comp[a], comp[b])
    df = spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA)
    for size in (4096, 4):
        got = {r.doc_id: r.component_id for r in similar_components(df, shard_size=size).collect()}
        assert got == comp
    assert similar_components(df.limit(0)).count() == 0


def test_similar_components_dont_count_repeated_lines(spark):
    import random

    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(n)]
    rows = []
    for g in range(24):
        body, line = words(100), words(18)
        rows += [(2 * g, " ".join(body + line), "", 0), (2 * g + 1, " ".join(body + line * 30), "", 0)]
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: d - d % 2 for d, *_ in rows}


def test_leaders_find_the_links_that_all_pairs_have():
    import random

    import numpy as np
    from spanforge.llm.simhash import _jaccard, _similar_links

    rng = random.Random(8)
    for _ in range(20):
        sets, fps = [], []
        base = np.array(sorted(rng.sample(range(10 ** 6), 60)))
        for _ in range(50):
            kept = [x for x in base.tolist() if rng.random() < 0.93]
            base = np.array(kept + rng.sample(range(10 ** 6), 60 - len(kept))) if rng.random() < 0.3 else base  # drifts, so groups are chains
            sets.append(np.unique(np.array(kept)))
            fps.append(rng.getrandbits(2))
        comp = list(range(50))
        for _ in range(50):
            for a, b in combinations(range(50), 2):
                if _jaccard(sets[a], sets[b]) >= 0.8:
                    comp[a] = comp[b] = min(comp[a], comp[b])
        got = dict(_similar_links(fps, sets, list(range(50)), 18, 0.8))
        assert [got.get(i, i) for i in range(50)] == comp


def test_very_long_texts_and_a_large_group_of_like_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words), "", 0), (2, " ".join(words[:-3]), "", 0)]
    rows += [(10 + i, " ".join([*words[:200], f"end{i}"]), "", 0) for i in range(300)]
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, SCHEMA), shard_size=100).collect()}
    assert got == {1: 1, 2: 1} | {10 + i: 10 for i in range(300)}


def short_sets(rng, kind):
    """Two or three sets of 4 to 10 hashes, neighbours of which have a Jaccard index of exactly 0.8 or a little more."""
    import numpy as np

    pool = rng.sample(range(1, 1 << 60), 16)
    cut = [(1, 9), (0, 9), (0, 8)] if kind == 0 else [(0, 8), (0, 10), (2, 10)] if kind == 1 else [(0, 4), (0, 5), (1, 5)]
    return [np.array(sorted(pool[a:b]), np.uint64) for a, b in cut]


def test_chains_of_short_texts_at_the_threshold_in_all_orders():
    import random
    from itertools import permutations

    from spanforge.llm.simhash import _jaccard, _similar_links, majority_bits

    rng = random.Random(14)
    whole = total = 0
    for n in range(120):
        sets = short_sets(rng, n % 3)
        assert _jaccard(sets[0], sets[1]) >= 0.8 and _jaccard(sets[1], sets[2]) >= 0.8
        fps = [int(majority_bits(s)) for s in sets]
        for order in permutations(range(3)):
            got = _similar_links([fps[i] for i in order], [sets[i] for i in order], [0, 1, 2], 18, 0.8)
            total += 1
            whole += len(got) == 2
    assert whole >= 0.99 * total


def test_triples_of_short_texts_are_joined_whole(spark):
    rng = __import__("random").Random(15)
    rows = []
    for g in range(200):
        w = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(9)]
        for at, text in enumerate((w[1:], w, w[:8])):
            rows.append((3 * g + at, " ".join(text), "", 0))
    got = {r.doc_id: r.component_id for r in similar_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[3 * g] == got[3 * g + 1] == got[3 * g + 2] for g in range(200)) >= 197
