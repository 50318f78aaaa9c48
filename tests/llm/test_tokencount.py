import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
from spanforge.llm.bytebpe import _field  # noqa: E402
from spanforge.llm.tokencount import RESTART, SPACE, Counter, count_tokens, counter, single, vocabulary  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


def unigram(pieces, dummy=1):
    """The library's own unigram tokenizer over these pieces, with identity normalisation and byte fallback."""
    kinds = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, s, 1) for p, s in pieces)]
    out = b"".join(_field(1, _field(1, p.encode()) + _field(2, float(s)) + _field(3, k)) for p, s, k in kinds)
    out += _field(2, _field(3, 1) + bytes([35 << 3 & 127 | 128, 35 << 3 >> 7, 1]))
    out += _field(3, _field(1, b"identity") + _field(3, dummy) + _field(4, 0))
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_counts_are_those_of_the_library():
    lib, own, rng = unigram(vocabulary(PATH)), counter(PATH), random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñABC0123456789'.,!?-   "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(500)]
    texts += ["The quick brown fox jumps over the lazy dog. " * 3, "x  y   z", " lead", "trail ", "", "Über größere Straßen", "a\nb", "🜁", "🜁" * 9000]
    texts += ["".join(rng.choice(letters) for _ in range(200_000)), "x" * 100_000, " ".join("".join(rng.choice("etaoin") for _ in range(4)) for _ in range(40_000))]
    for text in texts:
        assert own.count(text)[1] == len(lib.encode(text)), repr(text[:80])


def test_counts_of_real_texts_are_those_of_the_library(spark):
    import os

    table = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(table):
        pytest.skip("needs the given tables")
    lib, own = unigram(vocabulary(PATH)), counter(PATH)
    texts = [r.text or "" for r in spark.read.parquet(table).select("text").collect()]
    assert [own.count(t)[1] for t in texts] == [len(x) for x in lib.encode(texts)]


def test_ties_and_rounding_are_those_of_the_library():
    rng = random.Random(9)
    for i in range(300):
        names = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 4))) for _ in range(6)}
        names |= {SPACE + n for n in list(names)[:3]} | {SPACE * 2}
        scale = rng.choice([1.0, 0.37, 1000.0, 3e4])  # with the last ones scores are counted anew within a run
        pieces = [(n, single(-rng.randrange(1, 5) * scale - (rng.random() if i % 2 else 0))) for n in sorted(names)]
        own, lib = Counter(pieces), unigram(pieces)
        text = "".join(rng.choice("abé  \n") for _ in range(rng.randrange(1, 400)))
        assert own.count(text)[1] == len(lib.encode(text)), (pieces, text)
    with pytest.raises(ValueError):
        Counter([("a" + SPACE, -1.0)])
    assert RESTART < 0


def test_table(spark):
    rows = [(1, "a b", 5), (1, "a b", 5), (2, None, 5), (None, "", 5), (3, "wort " * 40000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = count_tokens(df, PATH).collect()
    own = counter(PATH)
    assert sorted((r.doc_id or 0, r.n_chars, r.n_tokens) for r in got) == sorted((d or 0, len(t or ""), own.count(t)[1]) for d, t, _ in rows)
    assert count_tokens(df.limit(0), PATH).count() == 0


def test_scores_are_replaced_by_the_kind_of_model_alone():
    import public_tokenizers
    from spanforge.llm.tokencount import MERGES, UNIGRAM, model_type

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        assert model_type(file.read()) == MERGES
    piece = b"\x0a\x08\x0a\x01a\x15\x00\x00\x80\xbf"  # "a" with the score -1.0, a whole number
    assert model_type(piece + b"\x12\x02\x18\x01") == UNIGRAM
    assert model_type(piece + b"\x12\x05\x0a\x01x\x18\x02") == MERGES
    assert model_type(piece) == model_type(b"") == UNIGRAM
