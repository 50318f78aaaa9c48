import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from spanforge.llm import suffixes
from spanforge.llm.suffixes import anchors, remove_repeats, repeated_starts, suffix_array

SCHEMA = "doc_id long, text string, n_bytes string"


@pytest.mark.parametrize("few", [1024, 0])
def test_suffix_array_is_the_sorted_order(monkeypatch, few):
    monkeypatch.setattr(suffixes, "FEW_SYMBOLS", few)
    rng = random.Random(3)
    for _ in range(150):
        n, k = rng.randrange(1, 90), rng.choice([1, 2, 3, 20])
        s = [rng.randrange(1, k + 1) for _ in range(n)]
        s = (s * rng.randrange(1, 4))[:200] + [0]
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffix_array(np.array(s), k + 1).tolist() == want


def test_repeated_starts_match_a_count():
    rng = random.Random(5)
    for _ in range(60):
        base = bytes(rng.choice(b"ab\x00") for _ in range(60))
        regions = [base[rng.randrange(20):][:rng.randrange(3, 60)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(5)]
        seen = Counter(r[i:i + 8] for r in regions for i in range(len(r) - 7))
        want = [[i for i in range(len(r) - 7) if seen[r[i:i + 8]] > 1] for r in regions]
        assert [x.tolist() for x in repeated_starts(regions, 8)] == want


def test_each_window_has_one_anchor_that_depends_on_its_bytes_alone():
    rng = random.Random(1)
    for text in ["a" * 500, "abc" * 300, "".join(rng.choice("ab ") for _ in range(900))]:
        data = text.encode()
        h, first, last = anchors(data, 200)
        assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
        for x, a, b in zip(h.tolist(), first.tolist(), last.tolist()):
            for w in {a, b}:
                assert anchors(data[w:w + 200], 200)[0].tolist() == [x]
    assert len(anchors(b"x" * 199, 200)[0]) == 0


def brute(rows, length):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone[:len(b)].sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def sample():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 8)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(3)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 1000), (4, "ab " * 200), (5, passage[0]), (6, passage[0]), (6, "other " + passage[0][10:250])]
    for i in range(10, 60):
        text = [word() for _ in range(rng.randrange(150))]
        for p in passage:
            if rng.random() < 0.4:
                part = p.split(" ")
                part[rng.randrange(len(part))] = word()
                text.insert(rng.randrange(len(text) + 1), " ".join(part[rng.randrange(8):]))
        rows.append((i, " ".join(text)))
    rows += [(None, rows[-1][1]), (100, rows[-1][1]), (101, rows[-2][1]), (101, rows[-2][1])]
    return rows


@pytest.mark.parametrize(("shard", "hot", "most"), [(2 << 20, 20_000, 1 << 25), (3000, 20_000, 1 << 25), (2 << 20, 2, 1 << 25), (2 << 20, 20_000, 300), (3000, 3, 700)])
def test_removal_matches_brute_force(spark, monkeypatch, shard, hot, most):
    monkeypatch.setattr(suffixes, "SHARD", shard)
    plain = suffixes.repeated_spans
    monkeypatch.setattr(suffixes, "repeated_spans", lambda docs, length: plain(docs, length, hot, most))
    rows = sample()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in remove_repeats(df).collect()), key=str) == brute(rows, 200)


def test_no_rows_and_nothing_repeated(spark):
    df = spark.createDataFrame([(1, "alone " + "x" * 150, "")], SCHEMA)
    assert remove_repeats(df).first().n_removed == 0
    assert remove_repeats(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40_000))
    df = spark.createDataFrame([(1, long, ""), (2, long[1000:2000], "")], SCHEMA)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(df).collect()}
    assert got == {1: (1000, 1), 2: (1000, 1)}
