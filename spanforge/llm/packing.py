"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heapreplace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
#: Context sizes of the tiers; all are powers of two, so that a full window of any tier has no padding.
TIERS = (4096, 2048, 1024, 512, 256)
#: Tokens that a task gathers before it packs them.
BLOCK_TOKENS = 1 << 20
#: Tokens of a training step, to which sequences are dealt in balance.
STEP_TOKENS = 64 * WINDOW


class WordBPE:
    """Ids of a lower-casing word BPE vocabulary with word ends, as packed little-endian 32-bit words.

    No merge crosses white space, so a text's ids are those of its runs in
    order, and a bounded memo holds the runs seen. New runs go through the
    vocabulary's merges in one batch: the word end is written as the control
    character U+0001, which merges with the character before it first of all.
    A run that holds that character, text of the special tokens or a letter
    beyond Latin (libraries differ in their tables of rare scripts) is encoded
    by the tokenizers library directly, with special tokens as text.
    """

    MEMO = 300_000
    #: Bytes of the runs that the memo keeps from one text to the next.
    MEMO_BYTES = 64
    END = "\x01"
    BEYOND = "\u0250"
    #: The split of the vocabulary's own file (a fixed value).
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}

        def raw(piece: str) -> bytes:
            stem = piece.removesuffix("</w>")
            return bytes(byte[c] for c in stem) + (self.END.encode() if stem != piece else b"")

        ids = {raw(piece): i for piece, i in model["vocab"].items() if not piece.startswith("<|")}
        ranks = {bytes([b, 1]): b for b in range(256)} | {bytes([b]): 256 + b for b in range(256)}
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            ranks.setdefault(raw(left) + raw(right), len(ranks))
        self.ids = np.zeros(len(ranks), "<u4")
        self.last = np.zeros(len(ranks), bool)
        for piece, rank in ranks.items():
            self.ids[rank] = ids.get(piece, 0)
            self.last[rank] = len(piece) > 1 and piece.endswith(b"\x01")
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.parts = regex.compile(self.SPLIT).findall
        self.normal = self.slow.normalizer.normalize_str
        self.memo: dict[bytes, bytes] = {}

    def _learn(self, runs: list[bytes]) -> None:
        plain, parts, odd = [], [], []
        for raw in runs:
            run = raw.decode()
            if self.END in run or "<|" in run or max(run) >= self.BEYOND:
                odd.append((raw, run))
            else:
                plain.append(raw)
                parts.append(self.parts(run.lower() if run.isascii() else self.normal(run)))
        for (raw, _), found in zip(odd, self.slow.encode_batch([run for _, run in odd], add_special_tokens=False)):
            self.memo[raw] = np.array(found.ids, "<u4").tobytes()
        text = "".join(p + self.END + " " for p in chain.from_iterable(parts))
        ranks = self.fast.encode_to_numpy(text)
        ends = np.concatenate([[0], np.flatnonzero(self.last[ranks]) + 1])
        upto = ends[np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])].tolist()
        packed = self.ids[ranks].tobytes()
        for raw, lo, hi in zip(plain, upto, upto[1:]):
            self.memo[raw] = packed[4 * lo:4 * hi]

    def encode(self, text: str | None) -> bytes:
        runs = (text or "").encode().split()  # at ASCII white space; other kinds stay inside a run
        new = set(runs).difference(self.memo)
        if new:
            if len(self.memo) + len(new) > self.MEMO:
                self.memo.clear()
                new = set(runs)
            self._learn(list(new))
        found = b"".join(map(self.memo.__getitem__, runs))
        for run in new:
            if len(run) > self.MEMO_BYTES:
                del self.memo[run]
        return found


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


class Piece:
    """A run of a document's ids: ``ids`` has those of the whole document, packed."""

    __slots__ = ("doc", "ids", "length", "start")

    def __init__(self, doc: int | None, ids: bytes, start: int, length: int) -> None:
        self.doc, self.ids, self.start, self.length = doc, ids, start, length

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.ids, self.start, n), Piece(self.doc, self.ids, self.start + n, self.length - n)


class Pool:
    """Pieces in order of length."""

    def __init__(self) -> None:
        self.items: list[Piece] = []

    def add(self, piece: Piece) -> None:
        insort(self.items, piece, key=lambda p: p.length)

    def best(self, most: int) -> Piece | None:
        """The longest piece of ``most`` tokens or fewer, taken out."""
        at = bisect_right(self.items, most, key=lambda p: p.length)
        return self.items.pop(at - 1) if at else None

    def longest(self) -> Piece | None:
        return self.items.pop() if self.items else None


def pack(pool: Pool, final: bool) -> list[list[Piece]]:
    """Full windows, tier by tier from the longest, out of the pieces in ``pool``.

    The longest piece left opens a window of its tier's size. The gap is filled
    by the longest shorter pieces that fit; where none fits, one is cut, and
    what is left of it goes back and so to a lower tier. Pieces that can't fill
    their window stay in the pool, or at the end are cut to powers of two.
    """
    windows: list[list[Piece]] = []
    while opener := pool.longest():
        size = next(t for t in reversed(TIERS) if t >= opener.length)
        window, gap = [opener], size - opener.length
        while gap and (piece := pool.best(gap) or pool.longest()):
            if piece.length > gap:
                piece, rest = piece.cut(gap)
                pool.add(rest)
            window.append(piece)
            gap -= piece.length
        if not gap:
            windows.append(window)
        elif not final:
            for piece in window:
                pool.add(piece)
            break
        else:
            left = list(reversed(window))
            total = size - gap
            while total:
                want = 1 << (total.bit_length() - 1)
                total -= want
                part: list[Piece] = []
                while want:
                    piece = left.pop()
                    if piece.length > want:
                        piece, rest = piece.cut(want)
                        left.append(rest)
                    part.append(piece)
                    want -= piece.length
                windows.append(part)
    return windows


def step_groups(windows: list[list[Piece]]) -> list[int]:
    """A training step for each window: steps of about equal tokens and attention cost.

    Windows go from the costliest to the cheapest, each to the step with the
    least load so far.
    """
    tokens = [sum(p.length for p in w) for w in windows]
    costs = [sum(p.length ** 2 for p in w) / WINDOW + n for w, n in zip(windows, tokens)]
    loads = [(0.0, g) for g in range(max(1, round(sum(tokens) / STEP_TOKENS)))]
    heapify(loads)
    steps = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -costs[i]):
        load, g = loads[0]
        steps[i] = g
        heapreplace(loads, (load + costs[i], g))
    return steps


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("sequence_tokens", pa.int64()), ("step_group", pa.int64()),
])


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = 2) -> DataFrame:
    """A row per piece of a document in a sequence of at most 4096 tokens.

    Each task tokenises and packs the documents of its own partition, a block of
    tokens at a time, so nothing is shuffled and a lost task is run again over
    the same rows with the same result. Whole windows of 4096 are cut off long
    documents; the rest goes by its length to a tier of 256 to 4096 and is
    packed as :func:`pack` says. Every sequence is a full window of a tier or,
    for what a task has left at its end, of a smaller power of two: nothing is
    padded. ``step_group`` deals the sequences to training steps of equal cost.

    Null and empty texts are the end id alone. Repeated rows and rows without
    doc_id are packed like any other. Very long texts are tokenised whole and
    cut into windows of 4096. Documents of equal length take their places in the order of the task's rows, and
    so do sequences of equal cost in ``step_group``. Further columns are ignored. An empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = word_bpe(tokenizer_path), int(end_id).to_bytes(4, "little")
        first = TaskContext.get().partitionId() << 33
        sequences = steps = 0
        pool, full, held = Pool(), [], 0

        def emit(windows: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequences, steps
            rows: list[tuple] = []
            groups = step_groups(windows)
            for window, group in zip(windows, groups):
                offset, total = 0, sum(p.length for p in window)
                for p in window:
                    crc = zlib.crc32(memoryview(p.ids)[4 * p.start:4 * (p.start + p.length)])
                    rows.append((p.doc, p.start, p.length, crc, len(p.ids) // 4, first + sequences, offset, total, first + steps + group))
                    offset += p.length
                sequences += 1
            steps += max(groups, default=-1) + 1
            cols = zip(*rows) if rows else [[]] * len(SCHEMA)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=SCHEMA)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.encode(text.as_py()) + end
                n = len(ids) // 4
                whole = n - n % WINDOW
                full += [[Piece(doc, ids, at, WINDOW)] for at in range(0, whole, WINDOW)]
                if n > whole:
                    pool.add(Piece(doc, ids, whole, n - whole))
                held += n
                if held >= BLOCK_TOKENS:
                    yield emit(full + pack(pool, False))
                    full, held = [], 0
        yield emit(full + pack(pool, True))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "sequence_tokens long, step_group long"
    )
