"""Token counts by a Viterbi pass that carries the best score and its number of pieces, but no path."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack, unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Fixed values of the tokenizer: what an unknown character costs beyond the worst piece, and the score
#: from which on it counts scores from zero again.
UNKNOWN_PENALTY = 10.0
RESTART = -100_000.0


def single(x: float) -> float:
    """``x`` in single precision."""
    return unpack("f", pack("f", x))[0]


class Counter:
    """Counts of the pieces of a unigram vocabulary in whole texts.

    The vocabulary's normalisation is the identity with a space before the text;
    spaces are written as U+2581. No piece has that character after another one, so the
    best path of a text is made of the best paths of its runs (spaces, then the
    characters up to the next space), each from the score that the one before has left. If no piece
    goes on from a letter to another kind of character or back, runs end there too.

    Tie rules of the tokenizer: at each end the path whose last piece starts
    first wins, a later one must score more; an unknown character is tried, after
    all pieces, only where no piece is that character alone; it counts as its
    UTF-8 bytes. A path's score is kept in single precision and compared
    with a new one in double precision. Where the best score at a position is below
    RESTART, it is taken off all scores that are open there.

    A bounded memo holds, for the short runs seen, the scores along their best
    path as exact sums give it, and by how much other paths lose at its
    positions. Where that is more than rounding could make up for, the path is the same
    from any score before; elsewhere the run is worked out from the score at hand.
    """

    #: Runs in each of the memo's halves. Longer ones than MEMO_CHARS are worked out anew each time, so the memo is bounded in bytes too.
    MEMO = 200_000
    MEMO_CHARS = 64

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces):
            raise ValueError("a piece goes on after a space; runs can't be counted on their own")
        if any(s > 0 for _, s in pieces):
            raise ValueError("scores must not be positive")
        self.unknown = single(min((single(s) for _, s in pieces), default=0.0) - UNKNOWN_PENALTY)
        self.found = ahocorasick.Automaton()
        for piece, score in pieces:
            self.found.add_word(piece, (len(piece), single(score)))
        if pieces:
            self.found.make_automaton()
        self.memo: dict[str, tuple[bytes, int, float, float]] = {}
        self.older: dict[str, tuple[bytes, int, float, float]] = {}
        letters = {c for p, _ in pieces if len(p) > 1 for c in p if c.isalpha()}
        kinds = "".join(map(re.escape, sorted(letters)))
        if letters and not any(a != SPACE and (a in letters) != (b in letters) for p, _ in pieces for a, b in zip(p, p[1:])):
            parts = f"{SPACE}+(?:[{kinds}]+|[^{SPACE}{kinds}]+)?|[{kinds}]+|[^{SPACE}{kinds}]+"
        else:
            parts = f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        self.runs = re.compile(parts).findall

    def _matches(self, text: str) -> list[list[tuple[int, float]]]:
        """For each last character, (length, score) of the pieces that end there, from the longest to the shortest."""
        ends: list[list[tuple[int, float]]] = [[] for _ in text]
        if len(self.found):
            for last, hit in self.found.iter(text):
                ends[last].append(hit)
        return ends

    def _path(self, text: str) -> tuple[bytes, int, float, float]:
        """(scores along the best path, pieces, least lead a character, lowest score of a position) in exact sums."""
        ends, unknown = self._matches(text), self.unknown
        scores, steps = [0.0], [(0, 0.0)]
        for last, hits in enumerate(ends):
            best, step, length = -math.inf, (1, unknown), 0
            for hit in hits:
                length, score = hit
                total = scores[last + 1 - length] + score
                if total > best:
                    best, step = total, hit
            if length != 1 and scores[last] + unknown > best:
                best, step = scores[last] + unknown, (1, unknown)
            scores.append(best)
            steps.append(step)
        path, pieces, lead, at = [], 0, math.inf, len(text)
        while at:
            length, score = step = steps[at]
            best, alone = scores[at], False
            for hit in ends[at - 1]:
                alone = hit[0] == 1
                if hit is not step:
                    lead = min(lead, best - scores[at - hit[0]] - hit[1])
            if alone or length != 1:
                pieces += 1
                if not alone:
                    lead = min(lead, best - scores[at - 1] - unknown)
            else:
                pieces += len(text[at - 1].encode())
            path.append(score)
            at -= length
        path.reverse()
        return pack(f"<{len(path)}f", *path), pieces, lead / len(text), min(scores)

    def _absolute(self, text: str, before: float) -> tuple[float, int, float]:
        """(score after the run, pieces, what was taken off), each position's pieces tried in turn as the tokenizer does."""
        starts: dict[int, list[tuple[int, float]]] = {}
        for last, hits in enumerate(self._matches(text)):
            for length, score in hits:
                starts.setdefault(last + 1 - length, []).append((length, score))
        scores: list[float | None] = [before] + [None] * len(text)
        counts, off, far = [0] * (len(text) + 1), 0.0, 0
        for at, char in enumerate(text):
            here = scores[at]
            if here < RESTART:
                for i in range(at, far + 1):
                    if scores[i] is not None:
                        scores[i] = single(scores[i] - here)
                off, here = off + here, 0.0
            alone = False
            for length, score in sorted(starts.get(at, ())):
                alone |= length == 1
                far = max(far, at + length)
                if scores[at + length] is None or here + score > scores[at + length]:
                    scores[at + length], counts[at + length] = single(here + score), counts[at] + 1
            if not alone:
                total = single(here + self.unknown)
                far = max(far, at + 1)
                if scores[at + 1] is None or total > scores[at + 1]:
                    scores[at + 1], counts[at + 1] = total, counts[at] + len(char.encode())
        return scores[-1], counts[-1], off

    def count(self, text: str | None) -> tuple[float, int]:
        """(score, pieces) of the best path over ``text``; empty texts have neither."""
        if not text:
            return 0.0, 0
        memo, runs = self.memo, self.runs(SPACE + text.replace(" ", SPACE))
        new = set(runs).difference(memo)
        if new:
            older = self.older
            fresh = {r: older.get(r) or self._path(r) for r in new}
            memo.update((r, f) for r, f in fresh.items() if len(r) <= self.MEMO_CHARS)
            found = [fresh.get(r) or memo[r] for r in runs]
            if len(memo) > self.MEMO:
                # what is still in use comes over from the older half
                self.memo, self.older = {}, memo
        else:
            found = list(map(memo.__getitem__, runs))
        packed, pieces, leads, lows = zip(*found)
        score = self._along(packed, 0.0)
        if score + min(lows) > RESTART and min(leads) > digit(score):
            return score, sum(pieces)
        return self._walk(runs, found, digit(max(score, RESTART)))

    @staticmethod
    def _along(packed: tuple[bytes, ...] | list[bytes], before: float) -> float:
        """``before`` and the scores, added one by one in single precision."""
        return float(np.add.accumulate(np.frombuffer(pack("<f", before) + b"".join(packed), "<f4"))[-1])

    def _walk(self, runs: list[str], found: list[tuple], step: float) -> tuple[float, int]:
        """As :meth:`count`, where a run may depend on the score before it: those runs are worked out one by one."""
        score, pieces, off = 0.0, 0, 0.0
        near = [i for i, f in enumerate(found) if f[2] <= step or f[3] < -5000.0]
        done = 0
        for i in [*near, len(runs)]:
            part = found[done:i]
            after = self._along([f[0] for f in part], score)
            if after > RESTART + 5000.0:
                score = after
                pieces += sum(f[1] for f in part)
            else:
                for run, (packed, n, _, low) in zip(runs[done:i], part):
                    if score < RESTART:
                        off, score = off + score, 0.0
                    if score + low > RESTART:
                        score = self._along([packed], score)
                    else:
                        score, n, gone = self._absolute(run, score)
                        off += gone
                    pieces += n
            if i < len(runs):
                score, n, gone = self._absolute(runs[i], score)
                pieces += n
                off += gone
            done = i + 1
        return score + off, pieces


def digit(score: float) -> float:
    """Value of the last binary digit of scores down to a little below ``score`` in single precision."""
    return math.ldexp(1.0, math.frexp(score - 1.0)[1] - 24)


def rank_scores(pieces: int) -> list[float]:
    """Log-probabilities by Zipf's law for pieces in order of rank: the chance of one is in inverse proportion to its place."""
    whole = math.log(sum(1 / i for i in range(1, pieces + 1)))
    return [-math.log(i) - whole for i in range(1, pieces + 1)]


@lru_cache(maxsize=2)
def counter(model_path: str) -> Counter:
    """The ordinary pieces of a sentencepiece file as a unigram vocabulary.

    A file of merges has ranks in place of log-probabilities; its pieces get the scores of :func:`rank_scores` by their order.
    """
    return Counter(vocabulary(model_path))


#: Kinds of models by their number in a sentencepiece file (fixed values); a file that names none is of the first kind.
UNIGRAM, MERGES = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message: numbers, or the bytes of texts and messages."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at:at + size]
            at += size


def model_type(data: bytes) -> int:
    """The kind of model that a sentencepiece file says it is: field 3 of the trainer's description, which is field 2."""
    found = UNIGRAM
    for number, value in _fields(data):
        if number == 2 and isinstance(value, bytes):
            found = next((v for n, v in _fields(value) if n == 3 and isinstance(v, int)), UNIGRAM)
    return found


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    plain = [
        i for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    scores = [model.get_score(i) for i in plain]
    with open(model_path, "rb") as file:
        if model_type(file.read()) == MERGES:
            scores = rank_scores(len(plain))
    return [(model.id_to_piece(i), s) for i, s in zip(plain, scores)]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens, score) for every row, by the best path over its whole text.

    The pieces and scores of the file are read as a unigram vocabulary: counts
    are those of the tokenizer's unigram model over it, not of the merges that
    the same file may also stand for. Time and memory grow in proportion to a
    text's length, however long it is. Null and empty texts have 0 tokens and score 0; repeated rows stay as many;
    other columns are ignored; an empty table gives no rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            found = [own.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())],
                ["doc_id", "n_chars", "n_tokens", "score"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_chars long, n_tokens long, score double"
    )
