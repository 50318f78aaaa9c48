import math
import random
import re

import numpy as np
import pytest
from spanforge.llm import lexical
from spanforge.llm.lexical import search, terms, tile_scores

DOCS, ITEMS = "doc_id long, text string, item_id int, score string", "item_id int, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute(docs, items, k=20):
    held = [(d, plain(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n, length = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        scores = []
        for d, words in held:
            m, score = 100 - 25 + 25 * len(words) * n // length, 0
            for t in plain(text):
                df, tf = sum(t in w for _, w in held), words.count(t)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(str(item), rank, str(d), -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out)


def sample():
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdeéßñ漢0") for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    text = lambda n: "".join(rng.choice(vocab).title() + rng.choice([" ", ", ", "\x7f", "\n", "_", "-"]) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(90)]
    docs += [(200 + i, docs[5][1]) for i in range(30)] + [(None, docs[5][1]), (None, docs[5][1]), (7, docs[8][1]), (7, docs[8][1])]
    docs += [(300, None), (301, ""), (302, " .,\x00"), (303, text(20_000)), (304, "É é É"), (-5, docs[5][1])]
    items = [(i, text(rng.randrange(1, 12))) for i in range(9)] + [(20, None), (21, "?!"), (22, "nowhere"), (23, docs[5][1]), (24, "é É"), (24, "é"), (None, docs[8][1]), (25, "ñ " * 300)]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "s") for d in docs], DOCS), spark.createDataFrame([(*i, "d") for i in items], ITEMS)


@pytest.mark.parametrize(("k", "tile_items", "pass_terms"), [(20, 512, 1 << 18), (3, 4, 1 << 18), (20, 2, 5)])
def test_matches_brute_force(spark, k, tile_items, pass_terms, monkeypatch):
    docs, items = sample()
    got = search(*frames(spark, docs, items), k=k, tile_items=tile_items, pass_terms=pass_terms).collect()
    assert sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in got) == brute(docs, items, k)


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(1, 700))) + " ÀB漢字c d 1_2"
    assert [t.decode() for t in terms(text)] == plain(text)


def test_sums_are_exact_beyond_double(monkeypatch):
    rng = np.random.default_rng(4)
    weighted, impacts = rng.integers(0, 10 ** 9, (3, 40)), rng.integers(0, 10 ** 6, (40, 5)).astype(float)
    want = [[sum(int(a) * int(b) for a, b in zip(row, column)) for column in impacts.T] for row in weighted]
    assert tile_scores(weighted, impacts).tolist() == want
    assert tile_scores(weighted * 100, impacts).tolist() == [[100 * x for x in row] for row in want]


def test_small_tiles_keep_ties_by_id(spark, monkeypatch):
    docs = [(i, "a b") for i in range(100, 0, -1)]
    best = lexical._Best(1, 3)
    for s in range(0, 100, 7):
        ids = np.array([d for d, _ in docs[s:s + 7]])
        best.add(np.full((1, len(ids)), 5), ids, np.zeros(len(ids), bool))
    assert best.found[0][1].tolist() == [1, 2, 3]


def test_no_rows(spark):
    docs, items = sample()
    assert search(*frames(spark, [], items)).collect() == []
    assert search(*frames(spark, docs, [])).collect() == []
    assert search(*frames(spark, [(1, None)], items)).collect() == []
