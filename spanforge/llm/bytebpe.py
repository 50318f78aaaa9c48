"""Byte-level BPE through a sentencepiece model that is made from a rank file."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, at the index of their rank."""
    with open(path, "rb") as f:
        ranked = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranked[i] for i in range(len(ranked))]


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes, whole number or 32-bit float."""
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return bytes([number << 3 | 2]) + _varint(len(value)) + value
    return bytes([number << 3]) + _varint(value)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised BPE model: the tokens in letters, each scored by its negative rank, identity normalisation.

    The ids of the model are the ranks; the unknown piece comes after them and
    can't occur, as each byte has a piece.
    """
    letters = byte_letters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, "".join(letters[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, normal)
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_field(1, "⁇".encode()) + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    """Encodes text as the rank file's own library would, and decodes ids by the inverse mapping."""

    MEMO = 300_000
    #: Characters of the matches that the memo keeps from one text to the next.
    MEMO_CHARS = 64

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.whole = {token: str(rank) for rank, token in enumerate(self.tokens)}
        self.letters = dict(enumerate(byte_letters()))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        back = {letter: byte for byte, letter in self.letters.items()}
        self.bytes_of = {
            str(i): bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.tokens))
        }
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, str] = {}

    def _learn(self, parts: list[str]) -> None:
        new, texts = [], []
        for part in parts:
            raw = part.encode()
            rank = self.whole.get(raw)
            if rank is not None:
                self.memo[part] = rank
            else:
                new.append(part)
                texts.append(raw.decode("latin-1").translate(self.letters))
        for part, ids in zip(new, self.model.encode(texts, num_threads=1)):
            self.memo[part] = " ".join(map(str, ids))

    def encode(self, text: str) -> str:
        """The ids in decimal, joined by spaces."""
        parts = self.split(text)
        new = set(parts).difference(self.memo)
        if new:
            if len(self.memo) + len(new) > self.MEMO:
                self.memo.clear()
                new = set(parts)
            self._learn(list(new))
        found = " ".join(map(self.memo.__getitem__, parts))
        for part in new:
            if len(part) > self.MEMO_CHARS:
                del self.memo[part]
        return found

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split()))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = bpe.encode(text.as_py() or "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc.as_py()], pa.int64()), pa.array([[int(i) for i in ids.split()]], pa.list_(pa.int32())), pa.array([bpe.decode(ids)], pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded binary"
    )


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row.

    Whole texts are encoded, each match of ``pattern`` separately, by a
    sentencepiece model made from the rank file; the ids are then decoded. A
    match that is itself a token is that token, as in the rank file's library.
    Null and empty texts have no ids; very long texts are encoded whole, match by match; repeated rows stay as many; other columns are ignored.
    Tasks keep a bounded memo and need no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(ranks_path, pattern)
        for batch in batches:
            n, shas, decoded = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(ids.count(" ") + 1 if ids else 0)
                shas.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
