"""Ranked lexical search: dense products of tiles of item vocabulary with tiles of document impacts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import save

#: A to Z become lower case, what isn't a letter, a digit or beyond ASCII becomes a blank; bytes of UTF-8 beyond 127 stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))
#: Whole numbers of float64 up to which sums are exact.
EXACT = 1 << 53
#: Items of a tile, and the terms at which a tile, or the tiles of one pass over the documents, are full.
TILE_ITEMS, PASS_TERMS = 512, 1 << 18
#: Documents and terms of a dense tile of impacts.
TILE_DOCS, TILE_TERMS = 512, 2048
#: Largest impact: 10^9 tf div (1000 tf + 12 m) is less.
IMPACT = 1_000_000


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.encode().translate(_FOLD).split() if text else []


def weight(documents: int, holders: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holders + 1)))


class Tile:
    """A bounded number of items over their own, compact vocabulary: an entry (item, term, count) for each term of an item, in order of terms."""

    def __init__(self, items: list[tuple[int, object, list[bytes]]]) -> None:
        self.numbers, self.ids = [i for i, _, _ in items], [i for _, i, _ in items]
        held = [Counter(t) for _, _, t in items]
        self.terms = sorted(set().union(*held))
        index = {t: i for i, t in enumerate(self.terms)}
        entries = np.array([(row, index[t], n) for row, c in enumerate(held) for t, n in c.items()], np.int64)
        self.item, self.term, self.count = entries[np.argsort(entries[:, 1], kind="stable")].T

    def weighted(self, weights: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Counts times weights of the ``terms``, an ascending few of the tile's, as a dense matrix (items, terms)."""
        out = np.zeros((len(self.ids), len(terms)), np.int64)
        at = np.minimum(np.searchsorted(terms, self.term), len(terms) - 1)
        own = terms[at] == self.term
        out[self.item[own], at[own]] = self.count[own] * weights[self.term[own]]
        return out


def _postings(tile_terms: list[bytes], id_col: str, text_col: str):
    """For each document its number of terms, and the indexes and counts of those that ``tile_terms`` has."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: i for i, t in enumerate(tile_terms)}
        for batch in batches:
            sizes, at, tf, ends = [], [], [], [0]
            for text in batch[text_col]:
                found = terms(text.as_py())
                sizes.append(len(found))
                for t, n in Counter(found).items():
                    i = index.get(t)
                    if i is not None:
                        at.append(i)
                        tf.append(n)
                ends.append(len(at))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch[id_col].cast(pa.int64()), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))],
                ["doc_id", "n", "at", "tf"])

    return made


class _Best:
    """The ``k`` best documents of each item so far, equal scores by id, rows without id last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a score that a document must have to be among them

    def add(self, scores: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        for item in np.flatnonzero((scores >= self.least[:, None]).any(axis=1)):
            row = scores[item]
            near = np.flatnonzero(row >= self.least[item])
            if len(near) > self.k:  # all that reach the k-th best score, ties included
                near = near[row[near] >= -np.partition(-row[near], self.k - 1)[self.k - 1]]
            s, d, none = (np.concatenate([a, b]) for a, b in zip(self.found[item], (row[near], ids[near], no_id[near])))
            order = np.lexsort((d, none, -s))[:self.k]
            self.found[item] = s[order], d[order], none[order]
            if len(order) == self.k:
                self.least[item] = s[order[-1]]


def tile_scores(weighted: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """``weighted`` (items, terms) times ``impacts`` (terms, documents), exact in long: by float64 products over spans of terms whose sums stay below 2^53."""
    total = np.zeros((len(weighted), impacts.shape[1]), np.int64)
    most = np.cumsum(weighted.max(axis=0, initial=0)) * IMPACT
    start = 0
    while start < weighted.shape[1]:
        before = most[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(most, before + EXACT)))
        if end == start + 1 and most[start] - before >= EXACT:
            total += weighted[:, start:end] * impacts[start:end].astype(np.int64)
        else:
            total += (weighted[:, start:end].astype(np.float64) @ impacts[start:end]).astype(np.int64)
        start = end
    return total


def _ranked(tile: Tile, of_pass: np.ndarray, weights: np.ndarray, documents: int, length: int, k: int, id_type: pa.DataType):
    """The best documents of each item among the rows of a task; ``of_pass`` are the tile's terms among those of the postings."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(tile.ids), k)
        for batch in batches:
            for s in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(s, TILE_DOCS)
                m = np.array([75 + 25 * n * documents // length for n in part["n"].to_pylist()], np.int64)
                at, tf = (part[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "tf"))
                doc = np.repeat(np.arange(part.num_rows), np.diff(part["at"].offsets.to_numpy()))
                near = np.minimum(np.searchsorted(of_pass, at), len(of_pass) - 1)
                own = of_pass[near] == at
                term, tf, doc = near[own], tf[own], doc[own]
                impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
                used, place = np.unique(term, return_inverse=True)  # what the documents of the tile have of the vocabulary
                scores = np.zeros((len(tile.ids), part.num_rows), np.int64)
                for t in range(0, len(used), TILE_TERMS):
                    few = used[t:t + TILE_TERMS]
                    own = (place >= t) & (place < t + len(few))
                    dense = np.zeros((len(few), part.num_rows))
                    dense[place[own] - t, doc[own]] = impact[own]
                    scores += tile_scores(tile.weighted(weights, few), dense)
                ids = part["doc_id"]
                best.add(scores, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))
        for number, item, (s, d, none) in zip(tile.numbers, tile.ids, best.found):
            if len(s):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(s), number)), pa.array([item] * len(s), id_type), pa.array(d, pa.int64(), mask=none), pa.array(s, pa.int64())],
                    ["item", "item_id", "doc_id", "score"])

    return made


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
           tile_items: int = TILE_ITEMS, pass_terms: int = PASS_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item, equal scores by id, scores above 0 alone.

    Scores are sums, over an item's terms with repeats, of a whole-number weight by rarity times a whole-number impact by
    the term's occurrences in the document and the document's length. Sums are exact: float64 products run over spans of terms whose sums stay below 2^53.

    The items are a stated query set: the driver takes them in tiles of ``tile_items``, and has no more than about
    ``pass_terms`` terms at once, beside one item. For these, one pass over the whole texts writes each document's length and its counts of the
    tile's terms; holders of a term, documents and lengths are counted by Spark over that table. Then each task fills dense tiles of
    impacts, multiplies them by the tile's weights and keeps its ``k`` best documents an item, and a window takes the best of all.

    Null and empty texts have no terms: such items have no rows, such documents don't count. Rows without doc_id or with a repeated one are
    documents like any other (without an id they come last among equal scores); so are items, each row with ranks of its own. Very long texts are
    taken whole. Other columns are ignored; empty tables give no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    id_type = asked.schema["item_id"].dataType
    schema = f"item long, item_id {id_type.simpleString()}, doc_id long, score long"
    found = docs.sparkSession.createDataFrame([], schema)

    def scored(tiles: list[Tile]) -> DataFrame:
        vocabulary = sorted(set().union(*(t.terms for t in tiles)))
        held = save(docs.mapInArrow(_postings(vocabulary, "doc_id", "text"), "doc_id long, n long, at array<int>, tf array<long>").where("n > 0"), "postings")
        size = held.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        holders = dict(held.select(F.explode("at").alias("t")).groupBy("t").count().collect())  # a row for each term of the pass at most
        out = found
        for tile in tiles if size.n else ():
            of_pass = np.searchsorted(np.array(vocabulary, object), np.array(tile.terms, object))
            weights = np.array([weight(size.n, holders.get(int(i), 0)) for i in of_pass], np.int64)
            out = out.union(held.mapInArrow(_ranked(tile, of_pass, weights, size.n, size.l, k, to_arrow_type(id_type)), schema))
        return out

    tiles: list[Tile] = []
    rows: list[tuple[int, object, list[bytes]]] = []
    width = 0
    for number, row in enumerate(asked.toLocalIterator()):
        if own := terms(row.text):
            rows.append((number, row.item_id, own))
            width += len(own)
        if len(rows) == tile_items or width > pass_terms:
            tiles.append(Tile(rows))
            rows, width = [], 0
        if sum(len(t.terms) for t in tiles) > pass_terms:
            found, tiles = scored(tiles), []
    if rows:
        tiles.append(Tile(rows))
    if tiles:
        found = scored(tiles)
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
