"""Concordant pairs counted without listing pairs: counts of prefixes in a count tree, over blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.sources.shared import once

from .order import dense_numbers, steps_below

#: Distinct (target, score) rows of a group that are counted in one task, about.
BLOCK_ROWS = 1 << 18
#: Lower and upper gap of a band of pairs, both within it; no upper gap is None.
Band = tuple[float, float | None]


class CountTree:
    """Weights of the rows from one place to another whose score rank is below a given one, for many queries at once.

    One level for each bit of the rank, highest first: the rows are parted by that bit, order kept, and running
    sums tell how many rows, and how much weight, of a prefix have it unset.
    """

    def __init__(self, ranks: np.ndarray, weights: np.ndarray) -> None:
        self.bits = int(ranks.max(initial=0) + 1).bit_length()
        self.levels = []
        running = lambda x: np.concatenate([[0], np.cumsum(x)])
        for b in range(self.bits - 1, -1, -1):
            unset = (ranks >> b) & 1 == 0
            self.levels.append((running(unset.astype(np.int64)), running(np.where(unset, weights, 0)), int(unset.sum())))
            order = np.concatenate([np.flatnonzero(unset), np.flatnonzero(~unset)])
            ranks, weights = ranks[order], weights[order]

    def below(self, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
        total = np.zeros(len(end), np.int64)
        for level, (unset, weight, zeros) in enumerate(self.levels):
            up = (rank >> (self.bits - 1 - level)) & 1 == 1
            total += np.where(up, weight[end] - weight[start], 0)
            start = np.where(up, zeros + start - unset[start], unset[start])
            end = np.where(up, zeros + end - unset[end], unset[end])
        return total


def _prefix(t: np.ndarray, own: np.ndarray, edge: float, strict: bool) -> np.ndarray:
    """How many of the ascending ``t`` are ``edge`` or more (or, if strict, more than it) below each of ``own``, by the difference as a double."""
    far = (lambda at: own - t[at] > edge) if strict else (lambda at: own - t[at] >= edge)
    n = np.searchsorted(t, own - edge, side="left" if strict else "right")
    while True:  # what rounding puts on the other side of a searched bound
        more = (n < len(t)) & far(np.minimum(n, len(t) - 1))
        less = (n > 0) & ~far(np.maximum(n - 1, 0)) & ~more
        if not (more | less).any():
            return n
        n = n + more - less


#: Columns of the streamed rows besides their keys: place in the order of targets, score, weight; of queries (kind 1) also the edge.
FIELDS = ("t", "s", "w", "edge")
#: Where the prefix of a query ends: from the distinct, ascending places that are held, those of the queries, and their edge.
PrefixOf = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def _counted(held: list[tuple], asked: list[tuple], prefix_of: PrefixOf) -> pa.RecordBatch:
    """Sums for the queries of several groups at once, each against the held rows of its own group: (number, g, t, s, w, edge) for both."""
    own, _, t, s, w, _ = (np.concatenate(x) for x in zip(*held))
    group, g, qt, qs, qw, edges = (np.concatenate(x) for x in zip(*asked))
    places, at = np.unique(t, return_inverse=True)
    width = len(places) + 1
    key = own * width + at
    order = np.argsort(key, kind="stable")
    key, distinct, ranks = key[order], *np.unique(s[order], return_inverse=True)
    tree, running = CountTree(ranks, w[order]), np.concatenate([[0], np.cumsum(w[order])])
    out = []
    for edge in np.unique(edges):
        mine = edges == edge
        base = group[mine] * width
        start, end = np.searchsorted(key, base), np.searchsorted(key, base + prefix_of(places, qt[mine], int(edge)))
        below = tree.below(start, end, np.searchsorted(distinct, qs[mine]))
        upto = tree.below(start, end, np.searchsorted(distinct, qs[mine], side="right"))
        names, which = np.unique(g[mine], return_inverse=True)
        sums = np.zeros((3, len(names)), np.int64)
        for i, v in enumerate((running[end] - running[start], below, upto - below)):
            np.add.at(sums[i], which, qw[mine] * v)
        out.append((names, np.full(len(names), edge, np.int64), *sums))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["g", "edge", "pairs", "right", "tied"])


def _by_group(keys: Sequence[str], prefix_of: PrefixOf, at_once: int = BLOCK_ROWS):
    """Streams rows sorted by ``keys`` and kind: those of kind 0 are held for their key, those of kind 1 are its queries. Small groups are counted together, the queries of a large one in pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        asked: list[tuple] = []
        now, number, size = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            named = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
            kind = batch["kind"].to_numpy(zero_copy_only=False)
            fields = [(batch[f].fill_null(0) if f == "edge" else batch[f]).to_numpy(zero_copy_only=False) for f in FIELDS]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in (*named, kind)], axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                key = tuple(int(c[a]) for c in named)
                if key != now:
                    if size > at_once:
                        if asked:
                            yield _counted(held, asked, prefix_of)
                        held, asked, size = [], [], 0
                    now, number = key, number + 1
                rows = (np.full(b - a, number), np.full(b - a, key[0]), *(f[a:b] for f in fields))
                if kind[a] == 0:
                    held.append(rows)
                elif held and held[-1][0][0] == number:
                    asked.append(rows)
                    if size > 4 * at_once:
                        yield _counted(held, asked, prefix_of)
                        held, asked, size = [h for h in held if h[0][0] == number], [], 0
                size += b - a
        if asked:
            yield _counted(held, asked, prefix_of)

    return run


def concordance(rows: DataFrame, groups: Sequence[str], target: str, score: str, bands: Sequence[Band], weight: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(groups, band, pairs, right, tied) for each group: pairs of its rows whose targets are within a band apart, those in the same order by score, those of equal score.

    A row with a ``weight`` of n stands for n copies; copies are no pair, as a band's lower gap must be over 0. Rows without target or
    score are left out; groups without pairs in a band aren't listed for it, and of the keys null is one.

    No pair is made. Rows of one (target, score) are added up first. The pairs of a band are those over its lower gap less those beyond its upper
    one, and either are, for each row, a prefix of the group's rows in order of the target. Targets are cut at quantiles of the group into
    blocks of about ``block_rows``, scores into as many; a target or score that is itself a bound is a block of its own.
    Of a prefix, the block that its end is in is counted by a :class:`CountTree` over that block; whole blocks are counted
    by one over the row's range of scores, and by a matrix of (block, range) sums for the ranges below. So tasks hold a block each, and the matrix has the square of the number of blocks.
    """
    if not bands or any(low <= 0 for low, _ in bands):
        raise ValueError("bands have a lower gap over 0")
    edges = sorted({(low, False) for low, _ in bands} | {(high, True) for _, high in bands if high is not None})
    group = F.xxhash64(*(F.struct(k, F.col(k).isNull()) for k in groups)) if groups else F.lit(0).cast("long")
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    known = rows.where(F.col(target).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(target).cast("double")) & ~F.isnan(F.col(score).cast("double")))
    flat = known.select(group.alias("g"), (F.col(target).cast("double") + 0.0).alias("t"), (F.col(score).cast("double") + 0.0).alias("s"), w.alias("w")).groupBy("g", "t", "s").agg(F.sum("w").alias("w")).where("w > 0")
    flat = once(flat, "concordance")

    # quantiles of a group, as many as it has blocks
    sizes = flat.groupBy("g").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    many = sizes.where(F.col("n") > block_rows)
    most = many.agg(F.max(parts)).first()[0]
    if not most:
        placed = flat.withColumns({"tb": F.lit(0), "sb": F.lit(0)})
    else:
        cuts = [i / most for i in range(1, most)]
        big = flat.join(F.broadcast(many.select("g")) if many.count() <= 10_000 else many.select("g"), "g")
        bounds = big.groupBy("g").agg(*(F.array_sort(F.array_distinct(F.percentile_approx(c, cuts, 100 * most))).alias(f"{c}_cuts") for c in ("t", "s")))
        both = flat.join(bounds, "g", "left")
        block = lambda c: F.coalesce(2 * steps_below(F.col(f"{c}_cuts"), lambda x: x < F.col(c), most) + F.array_contains(f"{c}_cuts", F.col(c)).cast("int"), F.lit(0))
        placed = both.withColumns({"tb": block("t"), "sb": block("s")}).drop("t_cuts", "s_cuts")

    at_most = 2 * (most or 0) + 1
    blocks = placed.groupBy("g", "tb").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.sum("w").alias("w"))
    listed = blocks.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("tb", "low", "high", "w"))).alias("blocks"))
    far = lambda x, e, strict: (F.col("t") - x > e) if strict else (F.col("t") - x >= e)
    per_edge = F.explode(F.array(*(F.struct(
        F.lit(i).alias("edge"), steps_below(F.col("highs"), lambda x, e=e, st=st: far(x, e, st), at_most).alias("whole"), steps_below(F.col("lows"), lambda x, e=e, st=st: far(x, e, st), at_most).alias("begun"))
        for i, (e, st) in enumerate(edges))))
    asked = placed.join(listed.select("g", "blocks", F.col("blocks.high").alias("highs"), F.col("blocks.low").alias("lows")), "g").select("g", "t", "s", "w", "sb", "blocks", per_edge.alias("q")).select(
        "g", "t", "s", "w", "sb", "q.*", F.get(F.col("blocks"), F.col("q.whole"))["tb"].alias("cut"), F.coalesce(F.get(F.col("blocks"), F.col("q.whole") - 1)["tb"], F.lit(-1)).alias("last"))

    def streamed(held: DataFrame, queries: DataFrame, keys: Sequence[str], prefix_of: PrefixOf) -> DataFrame:
        dealt = held.withColumn("kind", F.lit(0)).unionByName(queries.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        return dealt.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(_by_group(keys, prefix_of), "g long, edge long, pairs long, right long, tied long")

    # the block that the prefix ends in
    own = placed.join(blocks.where("low < high").select("g", "tb"), ["g", "tb"], "left_semi").select("g", "tb", "t", "s", "w")
    ends = asked.where("begun > whole").select("g", F.col("cut").alias("tb"), "t", "s", "w", "edge")
    found = streamed(own, ends, ("g", "tb"), lambda t, own, i: _prefix(t, own, *edges[i]))
    # whole blocks: all weights, then the row's own range of scores, then the ranges below
    before = Window.partitionBy("g").orderBy("tb").rowsBetween(Window.unboundedPreceding, 0)
    running = blocks.select("g", F.col("tb").alias("last"), F.sum("w").over(before).alias("held"))
    whole = asked.where("whole > 0")
    if most:
        pairs = whole.groupBy("g", "edge", "last").agg(F.sum("w").alias("w")).join(running, ["g", "last"]).groupBy("g", "edge").agg(F.sum(F.col("w") * F.col("held")).alias("pairs"))
        zero = F.lit(0).cast("long")
        found = found.unionByName(pairs.select("g", F.col("edge").cast("long"), "pairs", zero.alias("right"), zero.alias("tied")))
        like = streamed(placed.select("g", "sb", F.col("tb").cast("double").alias("t"), "s", "w"), whole.select("g", "sb", F.col("last").cast("double").alias("t"), "s", "w", "edge"),
                        ("g", "sb"), lambda t, own, i: np.searchsorted(t, own, side="right"))
        found = found.unionByName(like.withColumn("pairs", zero))
        cells = placed.groupBy("g", "tb", "sb").agg(F.sum("w").alias("w")).withColumn("edge", F.lit(-1)).unionByName(
            whole.groupBy("g", F.col("last").alias("tb"), "sb", "edge").agg(F.sum("w").alias("w")))

        def matrix(table: pa.Table) -> pa.Table:
            g, tb, sb, w, edge = (table[c].to_numpy() for c in ("g", "tb", "sb", "w", "edge"))
            held = edge == -1
            sums = np.zeros((tb.max() + 2, sb.max() + 2), np.int64)
            sums[tb[held] + 1, sb[held] + 1] = w[held]
            sums = sums.cumsum(axis=0).cumsum(axis=1)
            rows_ = [(int(g[0]), int(e), 0, int((w[edge == e] * sums[tb[edge == e] + 1, sb[edge == e]]).sum()), 0) for e in np.unique(edge[~held])]
            return pa.table({n: pa.array([r[i] for r in rows_], pa.int64()) for i, n in enumerate(("g", "edge", "pairs", "right", "tied"))})

        lower = cells.groupBy("g").applyInArrow(matrix, "g long, edge long, pairs long, right long, tied long")
        found = found.unionByName(lower)

    place = {e: i for i, e in enumerate(edges)}
    names = ("pairs", "right", "tied")
    of = lambda e, c: F.coalesce(F.sum(F.when(F.col("edge") == place[e], F.col(c))), F.lit(0))
    sums = [F.struct(F.lit(i).alias("band"), *((of((low, False), c) - (of((high, True), c) if high is not None else 0)).alias(c) for c in names)) for i, (low, high) in enumerate(bands)]
    by = found.groupBy("g").agg(F.array(*sums).alias("found")).select("g", F.inline("found")).where("pairs > 0")
    if not groups:
        return by.drop("g")
    return known.select(*groups, group.alias("_group")).distinct().join(by.withColumnRenamed("g", "_group"), "_group").select(*groups, "band", *names)


def concordance_share(counts: DataFrame) -> DataFrame:
    """(band, pairs, accuracy) over all groups: the share of pairs in the same order by score as by target, ties in score half."""
    return counts.groupBy("band").agg(F.sum("pairs").alias("pairs"), ((F.sum("right") + F.sum("tied") / 2.0) / F.sum("pairs")).alias("accuracy"))


def later_in_band(rows: DataFrame, group: str, id_col: str, value: str, min_gap: float, max_gap: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, own, other): for each row, how many rows with a larger id are ``min_gap`` (over 0) to ``max_gap`` apart in value: those of its own group, those of others.

    No pair is made. Rows are dealt in order of the value to blocks of ``block_rows``, and those of a block again by group; a row asks the blocks that its
    two bands touch, where a :class:`CountTree` over the ids counts the larger ones between two places. Tasks hold one block each and
    stream its queries. Ids are whole numbers; rows without an id, group or value take no part, repeated ids are rows of their own.
    """
    if min_gap <= 0:
        raise ValueError("bands have a lower gap over 0")
    known = rows.where(F.col(id_col).isNotNull() & F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        F.xxhash64(group).alias("g"), F.col(id_col).cast("long").alias("id"), (F.col(value).cast("double") + 0.0).alias("t"))
    placed = dense_numbers(known, ["t", "id"], "place").withColumn("b", F.expr(f"int((place - 1) div {block_rows})")).drop("place")
    placed = once(placed.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("g", F.when(F.col("own"), F.col("g")).otherwise(0)), "bands")
    blocks = placed.groupBy("own", "g", "b").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    listed = blocks.groupBy("own", "g").agg(F.collect_list(F.struct("b", "low", "high")).alias("blocks"))
    t = F.col("t")
    touched = F.filter("blocks", lambda x: ((x["high"] - t >= min_gap) & (x["low"] - t <= max_gap)) | ((t - x["low"] >= min_gap) & (t - x["high"] <= max_gap)))
    asked = placed.join(F.broadcast(listed), ["own", "g"]).select("own", "g", "id", "t", F.explode(F.transform(touched, lambda x: x["b"])).alias("b"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, tree = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, g, b, kind, ids, values = (batch[c].to_numpy(zero_copy_only=False) for c in ("own", "g", "b", "kind", "id", "t"))
            cuts = np.flatnonzero((own[1:] != own[:-1]) | (g[1:] != g[:-1]) | (b[1:] != b[:-1]) | (kind[1:] != kind[:-1])) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if (own[i], g[i], b[i]) != now:
                    now, held, tree = (own[i], g[i], b[i]), [], None
                if kind[i] == 0:
                    held.append((values[i:j], ids[i:j]))
                    continue
                if tree is None:
                    at, names = (np.concatenate(c) for c in zip(*held))
                    distinct, ranks = np.unique(names, return_inverse=True)
                    tree, mirror = CountTree(ranks, np.ones(len(at), np.int64)), -at[::-1]
                q = values[i:j]
                rank = np.searchsorted(distinct, ids[i:j], side="right")
                spans = ((_prefix(at, q, max_gap, True), _prefix(at, q, min_gap, False)), (len(at) - _prefix(mirror, -q, min_gap, False), len(at) - _prefix(mirror, -q, max_gap, True)))
                n = sum(e - s - tree.below(s, e, rank) for s, e in spans)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j]), pa.array(own[i:j]), pa.array(n)], ["id", "own", "n"])

    dealt = placed.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)))
    found = dealt.repartition("own", "g", "b").sortWithinPartitions("own", "g", "b", "kind", "t").mapInArrow(counted, "id long, own boolean, n long")
    own, every = F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)), F.sum(F.when(~F.col("own"), F.col("n")).otherwise(0))
    return found.groupBy(F.col("id").alias(id_col)).agg(own.alias("own"), (every - own).alias("other"))
