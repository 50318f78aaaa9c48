import hashlib
import random
from collections import Counter

import pytest
from spanforge.llm.linededup import LineRuns, line_digests, without_shared_lines

SCHEMA = "doc_id long, text string, n int, uid string, places string"
BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_docs=10, min_chars=1):
    split = [(d, (t or "").split("\n")) for d, t in rows]
    held = Counter(k for _, lines in split for k in {key(x) for x in lines})
    out = []
    for d, lines in split:
        stay = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < min_docs]
        out.append((str(d), len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "u", "p") for d, t in rows], SCHEMA)


def sample():
    rng = random.Random(12)
    common = [f"Line {i} of all" for i in range(40)] + ["ÉCOLE", "école", "İ", "i̇", " Straße\t", "x", " x", "漢字"]
    rows = [(0, None), (1, ""), (2, "\n\n\n"), (3, " \t\r\n"), (None, "x\nY"), (None, None), (None, "x\nY"), (7, "same\nSAME\n same \nother"), (7, "twice"), (7, "twice")]
    for i in range(20, 160):
        lines = [rng.choice(common) for _ in range(rng.randrange(1, 9))] + [f"own {i} {j}" for j in range(rng.randrange(4))]
        rng.shuffle(lines)
        rows.append((i, rng.choice(["\n", "\r\n", " \n\t"]).join(x.upper() if rng.random() < 0.3 else x for x in lines)))
    rows.append((500, "\n".join(rng.choice(common) for _ in range(20_000))))
    rows.append((501, "very long line " * 50_000 + "\nx"))
    return rows


@pytest.mark.parametrize(("batches", "fan", "min_docs", "min_chars", "most_hot"), [(4, 2, 10, 1, 4096), (1, 2, 2, 1, 1), (5, 3, 3, 4, 2)])
def test_matches_brute_force(spark, batches, fan, min_docs, min_chars, most_hot):
    rows = sample()
    got = without_shared_lines(frame(spark, rows), min_docs, min_chars, batches, fan, most_hot=most_hot).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in got) == brute(rows, min_docs, min_chars)


def test_digests_and_a_line_that_every_row_has(spark):
    rows = [(i, f"Header\nown {i}\nheader ") for i in range(300)]
    got = line_digests(frame(spark, rows)).collect()
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == {(i, 3, 2, hashlib.sha256(f"own {i}".encode()).hexdigest()) for i in range(300)}


def test_runs_settle_lines_over_batches_and_are_dropped(spark):
    runs = LineRuns(spark, min_docs=3)
    for batch in ([1, 1, 1, 2], [1, 2, 3], [1, 2, 4], [], [3, 3, 5]):
        runs.add(spark.createDataFrame([(x, -x) for x in batch], "a long, b long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted((r.a, r.b, r.n) for r in runs.settle().collect()) == [(1, -1, 3), (2, -2, 3), (3, -3, 3)]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_no_rows_and_no_runs(spark):
    assert line_digests(frame(spark, [])).collect() == []
    assert LineRuns(spark, 2).settle().collect() == []
    with pytest.raises(ValueError, match="fan"):
        LineRuns(spark, 2, fan=1)
