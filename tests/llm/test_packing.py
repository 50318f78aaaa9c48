import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
from spanforge.llm.packing import pack_documents, word_bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "Hello, World's 42 cats!", "a\x01b \x1c\x1d x\xa0y　z", "<|endoftext|> <|x|>", "é ΣΑΣ İ ŒUVRE",
       "日本語 テキスト 🎉🎉", "  \t\n ", "I'M you'Re 's ''", "word " * 9000, "x" * 20000, "\x85 q"]


def reference():
    tok = tokenizers.Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library():
    encode, bpe, rng = reference(), word_bpe(PATH), random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçABC0123456789'.,!?-  \n"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(300)]
    wide = ["".join(chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x30000, 256)]
    for text in ODD + made + wide:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == encode(text), repr(text)[:80]


def check(rows, texts):
    encode = reference()
    ids = {d: np.array([*encode(t), 2], "<u4") for d, t in texts.items()}
    spans, places = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        spans[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for d, own in ids.items():
        at = 0
        for start, length in sorted(spans[d]):
            assert start == at and length > 0
            at += length
        assert at == len(own)
    padded = 0
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded == 0


def test_every_id_is_in_one_piece_and_nothing_is_padded(spark):
    rng = random.Random(1)
    texts = dict(enumerate(ODD + ["lorem ipsum dolor " * rng.randrange(700) for _ in range(120)]))
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in texts.items()], "doc_id long, text string, start int, offset int")
    check(pack_documents(docs.repartition(3), PATH).collect(), texts)
    assert pack_documents(docs.limit(0), PATH).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = pack_documents(docs.coalesce(1), PATH).collect()
    assert sum(r.length for r in rows) == 7
