"""Hard negatives of anchor vectors, found through the means and deviations of vector segments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import save

#: Numbers of segments of the levels of summaries, coarse to fine.
LEVELS = (1, 4, 16)
#: Rows of a block, anchors of a tile, and anchors that are bounded at once.
BLOCK_ROWS, TILE_ANCHORS, AT_ONCE = 16384, 4096, 32
#: Whole numbers of float64 up to which sums are exact.
EXACT = 1 << 53
#: Pairs that are gathered at once; and the share of pairs from which a level is multiplied whole in place of gathered.
GATHERED, DENSE = 1 << 18, 0.05
LONG = (-(1 << 63), (1 << 63) - 1)


@dataclass
class Vectors:
    """Rows of one length: whole-number components, and for each level the scaled means and deviations of the segments."""

    ids: np.ndarray
    labels: np.ndarray
    exact: np.ndarray  # int64
    summaries: list[tuple[np.ndarray, np.ndarray]]
    norm: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, labels: np.ndarray, exact: np.ndarray) -> Vectors:
        x = exact.astype(np.float64)
        summaries = []
        for n in LEVELS:
            edges = np.unique(np.linspace(0, x.shape[1], min(n, x.shape[1]) + 1).astype(int))
            parts = [x[:, a:b] for a, b in zip(edges[:-1], edges[1:])]
            root = np.sqrt(np.diff(edges))
            empty = np.zeros((len(x), 0))
            means = np.stack([p.mean(axis=1) for p in parts], axis=1) * root if parts else empty
            deviations = np.stack([p.std(axis=1) for p in parts], axis=1) * root if parts else empty
            summaries.append((means, deviations))
        return Vectors(ids, labels, exact, summaries, np.sqrt((x * x).sum(axis=1)))

    def take(self, at: np.ndarray | slice) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.exact[at], [(m[at], d[at]) for m, d in self.summaries], self.norm[at])

    def largest(self) -> int:
        return max(abs(int(self.exact.max())), abs(int(self.exact.min()))) if self.exact.size else 0


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """a[i] . b[j] for each pair, by one product of the matrices where the pairs are a fair share of all."""
    if len(i) > DENSE * len(a) * len(b):
        return (a @ b.T)[i, j]
    return np.concatenate([np.einsum("pk,pk->p", a[i[s:s + GATHERED]], b[j[s:s + GATHERED]]) for s in range(0, len(i), GATHERED)] or [np.zeros(0)])


def exact_scores(anchors: Vectors, rows: Vectors, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs as long: in float64 where no sum can pass 2^53, else in whole numbers of any size, held to those of a long."""
    if anchors.exact.shape[1] * anchors.largest() * rows.largest() < EXACT:
        return _products(anchors.exact.astype(np.float64), rows.exact.astype(np.float64), i, j).astype(np.int64)
    found = [sum(int(x) * int(y) for x, y in zip(anchors.exact[p], rows.exact[q])) for p, q in zip(i, j)]
    return np.array([min(max(s, LONG[0]), LONG[1]) for s in found], np.int64)


def _bounds(anchors: Vectors, rows: Vectors, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible score of each pair.

    Over a segment, the score is the length times the product of the means plus that of a covariance, and a covariance is
    at most the product of the deviations. A hair of the norms makes up for rounding.
    """
    (m, d), (n, e) = anchors.summaries[level], rows.summaries[level]
    middle, reach = _products(m, n, i, j), _products(d, e, i, j)
    reach = reach + 1e-9 * anchors.norm[i] * rows.norm[j] + 1e-6
    return middle - reach, middle + reach


def _seeds(anchors: Vectors, rows: Vectors, ok: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """A score, for each anchor, that the k best rows within ``low`` to ``high`` reach: the k-th best of some rows that look well, or ``low``."""
    m, n = anchors.summaries[-1][0], rows.summaries[-1][0]
    guess = m @ n.T
    guess[~ok | (guess > high[:, None])] = -np.inf
    want = min(2 * k, guess.shape[1])
    best = np.argpartition(-guess, want - 1, axis=1)[:, :want]
    i = np.repeat(np.arange(len(best)), want)
    scores = exact_scores(anchors, rows, i, best.ravel()).reshape(best.shape)
    fits = np.take_along_axis(ok, best, axis=1) & (scores >= low[:, None]) & (scores <= high[:, None])
    least = np.where(fits, scores.astype(np.float64), -np.inf)
    return np.maximum(low, -np.partition(-least, k - 1, axis=1)[:, k - 1]) if want >= k else low


def best_pairs(anchors: Vectors, rows: Vectors, ok: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the k best rows of each anchor among ``ok`` pairs with scores in ``low`` to ``high``, equal scores by id.

    The bounds of each level leave out pairs that can't be in that range or among the k best; what the last level leaves is scored.
    """
    least = _seeds(anchors, rows, ok, low, high, k)
    i, j = np.nonzero(ok)
    for level in range(len(LEVELS)):
        if not len(i):
            break
        under, over = _bounds(anchors, rows, level, i, j)
        stay = (over >= least[i]) & (under <= high[i])
        i, j = i[stay], j[stay]
    scores = exact_scores(anchors, rows, i, j)
    stay = (scores >= least[i]) & (scores <= high[i])
    i, j, scores = i[stay], j[stay], scores[stay]
    order = np.lexsort((rows.ids[j], ~scores, i))
    i, j, scores = i[order], j[order], scores[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], scores[place < k]


def _vectors(table: pa.Table) -> Vectors:
    n = len(table)
    flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return Vectors.of(table["vec_id"].to_numpy(), table["label"].to_numpy(), flat.reshape(n, len(flat) // n if n else 0))


def _in_cells(rows: DataFrame, anchors: DataFrame, blocks: int, tiles: int) -> tuple[DataFrame, DataFrame]:
    """Both tables dealt to the cells of a grid: a block of rows and a tile of anchors, of vectors of one length.

    A row comes once for each tile and an anchor once for each block, so each pair meets in one cell.
    """
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    length = F.size("vector").alias("length")
    own = rows.select("*", length, deal(blocks, 3).alias("block"), every(tiles).alias("tile"))
    theirs = anchors.select("*", length, every(blocks).alias("block"), deal(tiles, 5).alias("tile"))
    return own, theirs.select(*(F.col(c).alias(c) for c in theirs.columns))  # columns of their own, as both come from one table


def _positives_in_cell(k: int):
    def found(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(anchors):
            r, a = _vectors(rows), _vectors(anchors)
            for label in np.unique(a.labels):
                own, theirs = a.take(a.labels == label), r.take(r.labels == label)
                for s in range(0, len(own.ids) if len(theirs.ids) else 0, AT_ONCE):
                    few = own.take(slice(s, s + AT_ONCE))
                    ok = few.ids[:, None] != theirs.ids[None, :]
                    all_scores = np.full(len(few.ids), np.inf)
                    i, j, score = best_pairs(few, theirs, ok, -all_scores, all_scores, k)
                    out.append((few.ids[i], theirs.ids[j], score))
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), columns)))

    return found


def _negatives_in_cell(k: int, low: tuple[int, int], high: tuple[int, int]):
    def found(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(anchors):
            r, a = _vectors(rows), _vectors(anchors)
            positives, scores = (anchors[c].to_numpy() for c in ("positive_id", "positive_score"))
            # in whole numbers: the least score s with low * positive <= s, the largest with s <= high * positive
            least = np.array([-(-low[0] * int(p) // low[1]) for p in scores], np.float64)
            most = np.array([high[0] * int(p) // high[1] for p in scores], np.float64)
            for s in range(0, len(a.ids), AT_ONCE):
                few, at = a.take(slice(s, s + AT_ONCE)), slice(s, s + AT_ONCE)
                i, j, score = best_pairs(few, r, few.labels[:, None] != r.labels[None, :], least[at], most[at], k)
                out.append((few.ids[i], positives[at][i], r.ids[j], scores[at][i], score))
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(5)]
        return pa.table(dict(zip(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), columns)))

    return found


def mine_negatives(rows: DataFrame, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100),
                   block_rows: int = BLOCK_ROWS, tile_anchors: int = TILE_ANCHORS) -> DataFrame:
    """Hard negatives for each anchor and positive: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label (both long), vector (whole numbers, as array<long>) and is_anchor. The score of two rows is the inner product.
    An anchor's positives are the best ``positives`` other rows of its label; a positive's negatives are the best ``negatives`` rows of other
    labels with scores of ``low`` to ``high`` (fractions) of the positive's. Higher scores come first, equal ones by id.

    Rows are dealt to blocks and anchors to tiles of bounded size by hashes of their ids, and each block meets each tile in one task, which returns the best
    of that block; a window takes the best of all. A label with a third of the rows is in all blocks alike. Within a cell pairs are left out by
    bounds from the means and deviations of their segments, coarse levels first; all others are scored exactly.

    Rows with a null id, label or vector, or a null component, take no part; of rows of one id the first by (label, vector) does; vectors of unequal length
    aren't compared, and those without components have score 0. Scores beyond 2^53 meet their bounds in double, those beyond a long are held to it. No rows, no anchors or no positives give no rows.
    """
    usable = rows.where("vec_id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    one = usable.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "is_anchor")).alias("r"))
    held = save(one.select("vec_id", "r.*"), "negatives-rows")
    total = held.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("a")).first()
    blocks, tiles = max(1, -(-total.n // block_rows)), max(1, -(-total.a // tile_anchors))
    anchors = held.where("is_anchor").drop("is_anchor")
    held = held.drop("is_anchor")
    cell = ("length", "block", "tile")

    left, right = _in_cells(held, anchors, blocks, tiles)
    near = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_positives_in_cell(positives), "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = save(near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= positives).drop("_n"), "negatives-positives")

    paired = anchors.join(near.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    left, right = _in_cells(held, paired, blocks, max(1, -(-total.a * positives // tile_anchors)))
    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    far = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_negatives_in_cell(negatives, low, high), schema)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def quantised(embeddings: DataFrame, scale: int = 256, shift_every: int = 7, classes: int = 10, anchor_every: int = 100,
              id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """Rows for :func:`mine_negatives`: components as floor(scale * x) in double, labels of every ``shift_every``-th id moved on by one class, anchors at every ``anchor_every``-th id.

    Vectors with null or non-finite components get a null one; what is beyond a long is held to its bounds.
    """
    i, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    whole = lambda x: F.when(F.abs(x.cast("double")) < float("inf"), F.floor(x.cast("double") * scale))
    return embeddings.select(
        i.alias("vec_id"), F.when(i % shift_every == 0, (label + 1) % classes).otherwise(label).alias("label"),
        F.transform(F.col(vector_col), whole).alias("vector"), F.coalesce(i % anchor_every == 0, F.lit(False)).alias("is_anchor"))
