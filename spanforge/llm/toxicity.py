"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, save

#: Letters of other scripts that look like Latin ones, and digits written for letters.
HOMOGLYPHS = dict(zip("аеорсухіѕјԛԝһԁӏкмтвнαοινρυκτχ", "aeopcyxisjqwhdlkmtbhaoivpuktx"))
DIGITS = dict(zip("01345789", "oieastbg"))
_FOLD = {ord(a): b for a, b in (HOMOGLYPHS | DIGITS).items()} | {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}
_WORDS = re.compile(r"\w+").findall


def fold(text: str | None) -> list[str]:
    """The words of ``text`` in lower case, with look-alikes and digits as the letters they stand for."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORDS(text.lower().translate(_FOLD))


@dataclass(frozen=True)
class Lexicon:
    """Terms with weights, exception phrases, and the coefficients of the score.

    A term is a word (" word ") or the start of words (" star"); an exception is
    a word or two neighbouring words inside which terms don't count.
    """

    terms: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = (-12.0, 0.0, 0.0)


@lru_cache(maxsize=4)
def _automaton(terms: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):  # noqa: ANN202
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in terms:
        found.add_word(term, (len(term), weight))
    for phrase in exceptions:
        found.add_word(phrase, (len(phrase), None))
    if len(found):
        found.make_automaton()
    return found


def hits(words: list[str], lexicon: Lexicon) -> list[tuple[int, float]]:
    """(start, weight) of the words that a term matches outside of exceptions, the largest weight for each."""
    automaton = _automaton(lexicon.terms, lexicon.exceptions)
    if not words or not len(automaton):
        return []
    best: dict[int, float] = {}
    safe: list[tuple[int, int]] = []
    for last, (length, weight) in automaton.iter(f" {' '.join(words)} "):
        start = last - length + 1
        if weight is None:
            safe.append((start, last))
        else:
            best[start] = max(weight, best.get(start, 0.0))
    # exceptions in order of their start: a hit is inside one if the furthest end so far is beyond it
    safe.sort()
    out, i, end = [], 0, -1
    for s, w in sorted(best.items()):
        while i < len(safe) and safe[i][0] <= s:
            end = max(end, safe[i][1])
            i += 1
        if s >= end:
            out.append((s, w))
    return out


def features(text: str | None, lexicon: Lexicon) -> tuple[float, float, float]:
    """1, the weight of all hits on a log scale, and the weight per hundred words."""
    words = fold(text)
    total = sum(w for _, w in hits(words, lexicon))
    return 1.0, math.log1p(total), min(20.0, 100 * total / max(1, len(words))) / 10


def score(text: str | None, lexicon: Lexicon) -> float:
    z = sum(a * b for a, b in zip(lexicon.coefficients, features(text, lexicon)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves 1 when divided by 3; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_terms(sample: DataFrame, prefixes: range) -> DataFrame:
    """(term, label, n): documents of each label with the term; terms are words and starts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int]] = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            out = pa.RecordBatch.from_pydict({
                "term": pa.array([k[0] for k in keys], pa.string()),
                "label": pa.array([k[1] for k in keys], pa.int32()),
                "n": pa.array([counts[k] for k in keys], pa.int64()),
            })
            counts.clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(fold(text.as_py()))
                terms = {f" {w} " for w in words}
                terms |= {f" {w[:k]}" for w in words for k in prefixes if len(w) > k}
                counts.update((t, label) for t in terms)
                if len(counts) > 200_000:
                    yield flush()
        yield flush()

    return sample.select("text", "toxic").mapInArrow(run, "term string, label int, n long").groupBy("term").agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("neg"),
    )


def _exceptions(sample: DataFrame, lexicon: Lexicon, min_docs: int) -> tuple[str, ...]:
    """Words, and pairs of them, with a hit that only clean documents hold, ``min_docs`` of them or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, labels = [], []
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = fold(text.as_py())
                starts = np.cumsum([0] + [len(w) + 1 for w in words])
                seen = set()
                for start, _ in hits(words, lexicon):
                    i = int(np.searchsorted(starts, start))
                    seen |= {f" {words[i]} ", f" {' '.join(words[max(0, i - 1):i + 1])} ", f" {' '.join(words[i:i + 2])} "}
                phrases += seen
                labels += [label] * len(seen)
        yield pa.RecordBatch.from_pydict({"phrase": pa.array(phrases, pa.string()), "label": pa.array(labels, pa.int32())})

    found = sample.select("text", "toxic").mapInArrow(run, "phrase string, label int").groupBy("phrase").agg(
        F.count("*").alias("n"), F.max("label").alias("toxic"))
    rows = found.where((F.col("toxic") == 0) & (F.col("n") >= min_docs)).select("phrase").collect()
    return tuple(sorted(r.phrase for r in rows))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, ...]:
    """Logistic regression by Newton's method; the weights of the features are not below zero."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * (ridge + 1e-6)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in (w[0], *np.maximum(w[1:], 0)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          most_rows: int = 20_000, min_docs: int = 5, odds: float = 20.0) -> Lexicon:
    """A lexicon from the labelled rows that aren't held out.

    ``most_rows`` bounds the sample of labelled rows (chosen by a hash of the
    id, so about that many), and so all that is broadcast or reaches the driver:
    the ids of the sample, the terms and exception phrases that occur in ``min_docs`` and
    in three of its rows or more, and three numbers a row. A term must be in ``min_docs`` toxic documents and be ``odds`` times as
    frequent in them as in clean ones; the start of a word replaces longer terms
    that begin with it. Rows with a null id or label are not learnt from; with
    no toxic rows the lexicon is empty.
    """
    wanted = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = wanted.count()
    share = min(1.0, most_rows / max(1, total))
    chosen = wanted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sample = save(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos:
        return Lexicon()
    rate = ((F.col("pos") + 0.5) / (n_pos + 1)) / ((F.col("neg") + 0.5) / (n_neg + 1))
    rows = _count_terms(sample, range(3, 9)).where(F.col("pos") >= min_docs).withColumn("odds", rate).where(
        F.col("odds") >= odds).select("term", "odds").collect()
    kept: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.term), r.term)):
        covered = any(kept.get(r.term[:k], 0.0) >= math.log(r.odds) - 0.7 for k in range(2, len(r.term)))
        if not covered:
            kept[r.term] = math.log(r.odds)
    terms = tuple(sorted(kept.items(), key=lambda t: (-t[1], t[0])))
    lexicon = Lexicon(terms)
    lexicon = Lexicon(terms, _exceptions(sample, lexicon, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py(), lexicon) for t in batch.column(0)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), batch.column(1)], ["a", "b", "y"])

    fitted = sample.select("text", "toxic").mapInArrow(run, "a double, b double, y int").toPandas()
    discard(sample)
    x = np.column_stack([np.ones(len(fitted)), fitted["a"], fitted["b"]])
    return Lexicon(terms, lexicon.exceptions, _fit(x, fitted["y"].to_numpy(float)))


def score_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    Only the whole text decides. Null, empty and wordless texts have no hits and
    get the score of such texts; repeated rows stay as many; rows without id
    count as not held out; other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score(t.as_py(), lexicon) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, score double"
    )
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, in one pass without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py(), lexicon) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
