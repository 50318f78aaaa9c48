import random
import zlib

from spanforge.llm.toxicity import Lexicon, features, fold, hits, learn, score, score_documents

SCHEMA = "doc_id long, text string, score double, toxic int"
LEXICON = Lexicon(((" idiot ", 3.0), (" stup", 2.0)), (" stupa ", " dear idiot "), (-5.0, 2.0, 2.0))


def test_folding():
    assert fold("1D10T, іdіоt! ＩＤＩＯＴ i​diot") == ["idiot"] * 4
    assert fold(None) == [] and fold(" .,") == []


def test_hits_are_those_of_a_plain_scan():
    rng = random.Random(8)
    vocab = ["idiot", "idiots", "stup", "stupid", "stupa", "dear", "xidiot", "a", "be"]
    for _ in range(200):
        words = [rng.choice(vocab) for _ in range(rng.randrange(12))]
        want = []
        for i, w in enumerate(words):
            if w == "idiot" and not (i and words[i - 1] == "dear"):
                want.append((sum(len(x) + 1 for x in words[:i]), 3.0))
            elif w.startswith("stup") and w != "stupa":
                want.append((sum(len(x) + 1 for x in words[:i]), 2.0))
        assert hits(words, LEXICON) == want


def test_score_falls_with_length_and_rises_with_hits():
    short, long_, twice = "an idiot", "an idiot " + "word " * 500, "an idiot idiot"
    assert 0 < score("", LEXICON) < score(long_, LEXICON) < score(short, LEXICON) < score(twice, LEXICON) < 1
    assert features("dear idiot", LEXICON)[1] == 0


def corpus():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["villain", "vi11ain", "rogue" + rng.choice("xyz")])
        elif i % 7 == 0:
            text[5] = "roguefort"
        docs.append((i, " ".join(text), 0.5, 1 - bad))
        labels.append((i, int(bad) if zlib.crc32(str(i).encode()) % 3 != 1 else int(not bad)))  # wrong where held out
    return docs, labels


def test_held_out_rows_are_told_apart_and_never_learnt_from(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, SCHEMA)
    lexicon = learn(df, spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int"))
    rows = score_documents(df.union(df.limit(2)), lexicon).collect()
    assert len(rows) == len(docs) + 2
    wrong = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        wrong += r.predicted != (r.doc_id % 4 == 0)
    assert wrong <= 0.02 * len(rows)


def test_nothing_to_learn_from_and_odd_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    lexicon = learn(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert lexicon == Lexicon()
    assert score_documents(empty, lexicon).count() == 0
    odd = spark.createDataFrame([(None, None, 0.0, 1), (1, "", 0.0, 1), (2, "x" * 300000, 0.0, 1)], SCHEMA)
    assert [(r.predicted, r.held_out) for r in score_documents(odd, LEXICON).orderBy("doc_id").collect()][0] == (0, False)
