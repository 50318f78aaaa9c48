import hashlib
import random
import re
import struct
from collections import Counter

import xxhash
from spanforge.llm.ordermin import fingerprint_edits, fingerprints

SCHEMA = "doc_id long, text string, n_chars long, bucket string"
MASK = (1 << 64) - 1


def longs(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v & MASK), seed)
    return seed


def words_of(text):
    out = []
    for w in re.split(r"\s+", text):
        out += [w] if len(w) <= 24 else [w[i:i + 4] for i in range(len(w))]
    return out


def signature(text):
    words = words_of(text)
    seen, elements = Counter(), []
    kmers = []
    for i, w in enumerate(words):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        if i + 1 < len(words):
            h = xxhash.xxh64_intdigest(words[i + 1].encode(), h)
        kmers.append(h & ((1 << 34) - 1))
    for i, k in enumerate(kmers):
        e = longs(k, seen[k]) & ((1 << 34) - 1)
        seen[k] += 1
        elements.append((e, i))
    sig = {}
    for b in range(64):
        own = sorted(x for x in elements if x[0] >> 28 == b)[:2]
        if own:
            own.sort(key=lambda x: x[1])
            sig[b] = longs(*(e for e, _ in own)) & ((1 << 24) - 1)
    return sig


def string(sig):
    order = [*range(32, 64), *range(32)]  # bins of negative longs sort first
    return "".join(f"{b << 24 | sig[b]:08x}" for b in order if b in sig)


def likeness(a, b):
    j = (sum(a[k] == b.get(k) for k in a) / len(a.keys() | b.keys())) ** 0.5
    return 2 * j / (1 + j)


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (-r[0], r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        n = len(t)
        edited = t[:n - n // 2] + after[:n // 2]
        a, b, c = signature(t), signature(edited), signature(after)
        out.append((d, n, hashlib.sha256(edited.encode()).hexdigest(), string(a), string(b), round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return sorted(out)


def sample():
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    rows = [(0, None), (1, ""), (2, " "), (3, "one"), (4, "same same " * 3000), (5, "a\nb c"), (6, "a b\nc")]
    rows += [(i * i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 900)))) for i in range(10, 70)]
    rows += [(200, "x" * 24), (201, "x" * 25), (202, "tab\tand\u2003wide  blank "), (203, "".join(rng.choice("漢字仮名交文") for _ in range(300)) + " 😀" * 30)]
    rows += [(9000, rows[-1][1]), (9001, rows[-1][1]), (9001, "twice"), (9001, "twice")]
    return rows


def test_matches_brute_force_in_one_bucket_and_in_many(spark):
    rows = sample()
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], SCHEMA)
    for size in (512, 4):
        got = sorted((*r[:5], round(r[5], 9), round(r[6], 9)) for r in fingerprint_edits(df, bucket_rows=size).collect())
        assert got == brute(rows)


def test_plain_fingerprints_single_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", 0, "")], SCHEMA)
    assert fingerprints(df).first().fingerprint == string(signature("a b"))
    assert fingerprint_edits(df).first().near_next == 1.0
    assert fingerprint_edits(df.limit(0)).count() == 0
    assert fingerprint_edits(spark.createDataFrame([(None, None, 0, ""), (1, "a", 0, "")], SCHEMA)).count() == 2


def test_no_python_runs(spark):
    df = spark.createDataFrame([(1, "a b", 0, "")], SCHEMA)
    plan = fingerprint_edits(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_likeness_follows_edits_in_texts_without_blanks_and_with_other_white_space(spark):
    rng = random.Random(4)
    solid = "".join(rng.choice("漢字仮名交文日本語東京都") for _ in range(2000))
    tabs = "\t".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(300))
    latin = "".join(rng.choice("abcdefghij") for _ in range(2000))
    rows = []
    for i, (text, edit) in enumerate(((solid, solid[:-10] + "い" * 10), (tabs, tabs[:-5] + "zzzzz"), (latin, latin[:1000] + "-" + latin[1000:]), (latin, latin[::-1]))):
        rows += [(10 * i + 1, text), (10 * i, edit)]  # in descending order the edit follows its text
    near = {r.doc_id: r.near_next for r in fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near[1] > 0.9 and near[11] > 0.9 and near[21] > 0.9 and near[31] < 0.1


def test_very_long_runs_take_time_in_proportion(spark):
    text = "ab" * 400_000
    r = fingerprint_edits(spark.createDataFrame([(2, text), (1, text + "c")], "doc_id long, text string")).collect()
    assert len(r) == 2
