import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
from spanforge.llm.bytebpe import byte_bpe, encode_digests, encode_documents, read_ranks  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ODD = ["", None, " ", "Hello, World's 42 cats!  \n\n x", "<|endoftext|>", "日本語 テキスト 🎉🎉", "\x00\x1c\x1f\x85\xa0 ",
       "a" * 5000, "é" * 999, " \t\n" * 50, "don't WON'T 'S"]


def reference():
    ranks = {token: rank for rank, token in enumerate(read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_ids_are_those_of_the_library_and_decode_to_the_text():
    encode, bpe, rng = reference(), byte_bpe(PATH, PATTERN), random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçABC0123456789'.,!?-  \n"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(300)]
    wide = ["".join(f"a{chr(c)} " for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3500, 256)]
    for text in [t or "" for t in ODD] + made + wide:
        ids = bpe.encode(text)
        assert [int(i) for i in ids.split()] == encode(text), repr(text)[:80]
        assert bpe.decode(ids) == text.encode()


def test_every_token_of_the_vocabulary(spark):
    encode, bpe = reference(), byte_bpe(PATH, PATTERN)
    for token in read_ranks(PATH):
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert [int(i) for i in bpe.encode(text).split()] == encode(text)


def test_digests(spark):
    encode = reference()
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(ODD)] + [(0, "", 9)], "doc_id long, text string, n_tokens int")
    want = []
    for r in docs.collect():
        ids, text = encode(r.text or ""), (r.text or "").encode()
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    assert sorted(tuple(r) for r in encode_digests(docs, PATH, PATTERN).collect()) == sorted(want)
    assert encode_digests(docs.limit(0), PATH, PATTERN).count() == 0
    first = encode_documents(docs.where("doc_id = 3"), PATH, PATTERN).first()
    assert first.ids == encode(ODD[3]) and bytes(first.decoded) == ODD[3].encode()
