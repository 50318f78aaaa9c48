"""The metrics of a bundle for many replicates at once: rows in one order, their multiplicities side by side as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.sources.shared import once

from .concordance import _prefix
from .order import dense_numbers

#: Replicates that are worked out side by side.
SIDE = 16
#: Rows of a channel up to which its replicates are worked out side by side.
CHANNEL_ROWS = 1 << 23
#: Cells (row, replicate) that are worked out at once, and (value, replicate) that are ranked over all channels in one task, about.
CELLS = 1 << 22
#: Of a channel, replicate and value: its number in the channel's order, its copies and its distance from the mean; then its place.
_CELL = [("r", "<u2"), ("k", "<u4"), ("w", "<u4"), ("v", "<f8")]
_PLACE = [("r", "<u2"), ("k", "<u4"), ("p", "<f8")]


def _ties(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the values, the first places of ties in it, and the tie of each value."""
    order = np.argsort(values, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], values[order][1:] != values[order][:-1]]))
    tie = np.empty(len(values), np.int64)
    tie[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(values))))
    return order, first, tie


def _average_ranks(values: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each row and replicate the mean place of the value's copies."""
    order, first, tie = _ties(values)
    sums = np.add.reduceat(w[order], first)
    return (sums.cumsum(axis=0) - (sums - 1) / 2)[tie]


def _correlation(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    n = np.maximum(w.sum(axis=0), 1)
    mx, my = (w * x).sum(axis=0) / n, (w * y).sum(axis=0) / n
    vx, vy, xy = (w * (x - mx) ** 2).sum(axis=0) / n, (w * (y - my) ** 2).sum(axis=0) / n, (w * (x - mx) * (y - my)).sum(axis=0) / n
    known = (n >= 2) & (vx > 1e-12) & (vy > 1e-12)
    return np.where(known, xy / np.sqrt(np.where(known, vx * vy, 1)), np.nan)


def _gain(values: np.ndarray, target: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gains in descending order of the values, those of a tie averaged over its places."""
    order, first, _ = _ties(-values)
    n, g = np.add.reduceat(w[order], first), np.add.reduceat((w * target[:, None])[order], first)
    upto = n.cumsum(axis=0).astype(np.int64)
    discount = np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(1, upto.max(initial=0) + 1) + 1.0))])
    return (g / np.maximum(n, 1) * (discount[upto] - discount[upto - n.astype(np.int64)])).sum(axis=0)


def prefix_hits(t: np.ndarray, s: np.ndarray, w: np.ndarray, edges: list[tuple[float, bool]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hits, pairs) for each edge and replicate: pairs of rows, ``t`` ascending, whose targets are the edge apart (or more than it, if strict); those in order count 1, those of equal score a half.

    As in :class:`spanforge.operators.concordance.CountTree` the rows are parted by a bit of the score's rank at a time, but for all replicates at once, and a level is kept no longer than it is read.
    """
    ranks = np.unique(s, return_inverse=True)[1].astype(np.int32)
    bits = int(ranks.max(initial=0) + 1).bit_length()
    before = np.concatenate([np.zeros((1, w.shape[1])), w.cumsum(axis=0)])
    ends = [_prefix(t, t, *e).astype(np.int32) for e in edges]
    pairs = [(w * before[end]).sum(axis=0) for end in ends]
    asked = [(i, rank, np.zeros(len(t), np.int32), end) for i, end in enumerate(ends) for rank in (ranks, ranks + 1)]
    hits, held, moved = [np.zeros(w.shape[1]) for _ in edges], ranks, w
    for b in range(bits - 1, -1, -1):
        unset = (held >> b) & 1 == 0
        places, zeros = np.concatenate([np.zeros(1, np.int32), np.cumsum(unset, dtype=np.int32)]), int(unset.sum())
        weight = np.concatenate([np.zeros((1, w.shape[1])), np.where(unset[:, None], moved, 0).cumsum(axis=0)])
        later = []
        for i, rank, start, end in asked:
            up = (rank >> b) & 1 == 1
            some = np.flatnonzero(up & (end > start))
            hits[i] += np.einsum("ij,ij->j", w[some], weight[end[some]] - weight[start[some]]) / 2
            later.append((i, rank, *(np.where(up, zeros + x - places[x], places[x]) for x in (start, end))))
        order = np.concatenate([np.flatnonzero(unset), np.flatnonzero(~unset)])
        held, moved, asked = held[order], moved[order], later
    return list(zip(hits, pairs))


def _packs(of: tuple, part: np.ndarray, cells: np.ndarray) -> list[tuple]:
    """(channel, chunk, kind, part, sums of the weights, cells) of each part that has some; ``of`` are the first three."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    return [(*of, int(part[at[0]]), np.bincount(cells["r"][at], cells["w"][at], SIDE).astype(np.int64), cells[at].tobytes()) for at in np.split(order, cuts) if len(at)]


_KINDS = {"chunk": pa.int32(), "kind": pa.int32(), "part": pa.int32(), "sums": pa.list_(pa.int64()), "cells": pa.binary()}
_PACK = "chunk int, kind int, part int, sums array<long>, cells binary"


def _table(channel: pa.DataType, packs: list[tuple], stats: list[tuple]) -> pa.Table:
    m, kinds = len(stats), {"_channel": channel, **_KINDS}
    columns = {n: pa.concat_arrays([pa.array(c, t), pa.nulls(m, t)]) for (n, t), c in zip(kinds.items(), zip(*packs) if packs else [[]] * 6)}
    columns["replicate"] = pa.array([None] * len(packs) + [r for r, _ in stats], pa.int32())
    columns["stats"] = pa.array([None] * len(packs) + [[None if v != v else float(v) for v in s] for _, s in stats], pa.list_(pa.float64()))
    return pa.table(columns)


def _placed(table: pa.Table) -> list[bytes]:
    """For each pack of a part the mean places of its cells over all channels and parts."""
    each = [np.frombuffer(c, _CELL) for c in table["cells"].to_pylist()]
    cells = np.concatenate(each)
    order = np.lexsort((cells["v"], cells["r"]))
    r, v, w = (cells[f][order] for f in "rvw")
    fresh = np.concatenate([[True], r[1:] != r[:-1]])
    first = np.flatnonzero(fresh | np.concatenate([[True], v[1:] != v[:-1]]))
    sums = np.add.reduceat(w.astype(np.int64), first)
    upto = sums.cumsum()
    heads = np.flatnonzero(fresh[first])
    upto -= np.repeat(upto[heads] - sums[heads], np.diff(np.append(heads, len(first))))
    places = upto - (sums - 1) / 2.0 + np.asarray(table["before"][0].as_py())[r[first]]
    out = np.empty(len(cells), _PLACE)
    out["r"], out["k"] = cells["r"], cells["k"]
    out["p"][order] = np.repeat(places, np.diff(np.append(first, len(cells))))
    return [x.tobytes() for x in np.split(out, np.cumsum([len(c) for c in each])[:-1])]


class _Channel:
    """Rows of a channel in order of the target, with the replicates of a chunk that draw them: weights are made for some replicates at a time."""

    def __init__(self, table: pa.Table) -> None:
        self.channel, self.chunk, self.type = table["_channel"][0].as_py(), table["chunk"][0].as_py(), table["_channel"].type
        t, s, drawn = table["_t"].to_numpy(), table["_s"].to_numpy(), table["drawn"].combine_chunks()
        order = np.argsort(t, kind="stable")
        place = np.empty(len(t), np.int32)
        place[order] = np.arange(len(t))
        self.t, self.s = t[order], s[order]
        self.row, self.r = np.repeat(place, np.asarray(drawn.value_lengths())), drawn.flatten().to_numpy()

    def sides(self) -> list[tuple[int, int]]:
        step = max(1, min(SIDE, CELLS // len(self.t)))
        return [(a, min(SIDE, a + step)) for a in range(0, SIDE, step)]

    def weights(self, a: int, b: int) -> np.ndarray:
        some = (self.r >= a) & (self.r < b)
        cells = self.row[some].astype(np.int64) * (b - a) + (self.r[some] - a)
        return np.bincount(cells, minlength=len(self.t) * (b - a)).reshape(len(self.t), b - a).astype(np.float64)


def _with_before(packs: DataFrame) -> DataFrame:
    """Packs with the weights of each replicate in the parts below."""
    by = ["kind", "chunk"]
    each = packs.select(*by, "part", F.posexplode("sums").alias("r", "w")).groupBy(*by, "part", "r").agg(F.sum("w").alias("w"))
    below = F.coalesce(F.sum("w").over(Window.partitionBy(*by, "r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = each.withColumn("b", below).groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct("r", "b")))["b"].alias("before"))
    return packs.join(before, [*by, "part"])


def replicate_bundles(known: DataFrame, groups: DataFrame, replicates: int, seed: int, min_gap: float, local: tuple[float, float]) -> DataFrame:
    """(replicate, metrics of a bundle but ``robust``) from rows (_group, _channel, _t, _s) without null or NaN values, at most CHANNEL_ROWS a channel.

    A channel's replicates are worked out some at a time, about CELLS cells together. What is ranked over all channels are the distinct values of a channel and replicate, and not its rows;
    their places go back to the channel, whose rows are read once more for the correlation.

    The draws are those of :func:`spanforge.operators.audit.bootstrap_draws`. A task has a channel and SIDE replicates: the rows once, in order of the target, and a matrix of their
    multiplicities, from which ranks, gains and pairs of all its replicates come. Centred values are ranked over all channels as packed cells, by parts of the value
    that hold about CELLS of them at most (equal values are in one).
    """
    numbered = once(dense_numbers(groups, ["_group"], "_number").withColumn("_number", F.col("_number") - 1), "groups")
    n = numbered.count()
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long")
    slots = known.sparkSession.range(replicates * n).select((F.col("id") / F.lit(max(n, 1))).cast("int").alias("r"), (F.col("id") % F.lit(max(n, 1))).alias("slot"))
    drawn = slots.select((u % F.lit(max(n, 1))).alias("_number"), F.floor(F.col("r") / SIDE).cast("int").alias("chunk"), (F.col("r") % SIDE).cast("byte").alias("r"))
    drawn = once(drawn.groupBy("_number", "chunk").agg(F.collect_list("r").alias("drawn")).join(numbered, "_number").select("_group", "chunk", "drawn"), "drawn")
    parts = -(-known.count() * SIDE // CELLS)
    cuts: list[list[float]] = [[], []]
    if parts > 1:
        means = known.groupBy("_channel").agg(F.avg("_t").alias("mt"), F.avg("_s").alias("ms")).withColumnRenamed("_channel", "c")
        centred = known.join(means, known["_channel"].eqNullSafe(means["c"])).select((F.col("_t") - F.col("mt")).alias("x"), (F.col("_s") - F.col("ms")).alias("y"))
        cuts = list(map(sorted, map(set, centred.agg(*(F.percentile_approx(c, [i / parts for i in range(1, parts)], 10_000) for c in ("x", "y"))).first())))
    edges = sorted({(min_gap, False), (local[0], False), (local[1], True)})

    def of_channel(table: pa.Table) -> pa.Table:
        rows = _Channel(table)
        t, s, stats = rows.t, rows.s, []
        values = [(*_ties(v)[:2], v) for v in (t, s)]
        cells: list[list[np.ndarray]] = [[], []]
        for a, b in rows.sides():
            w = rows.weights(a, b)
            total = w.sum(axis=0)
            rho = _correlation(_average_ranks(t, w), _average_ranks(s, w), w)
            got, ideal = _gain(s, t, w), _gain(t, t, w)
            found = dict(zip(edges, prefix_hits(t, s, w, edges)))
            whole, near = found[min_gap, False], tuple(x - y for x, y in zip(found[local[0], False], found[local[1], True]))
            ndcg = np.where(total >= 2, np.where(ideal > 0, got / np.where(ideal > 0, ideal, 1), 0.0), np.nan)
            stats += [(rows.chunk * SIDE + a + r, [v[r] for v in (rho, ndcg, *whole, *near)]) for r in np.flatnonzero(total).tolist()]
            for held, (order, first, v) in zip(cells, values):
                copies = np.add.reduceat(w[order], first)
                k, r = np.nonzero(copies)
                mean = (w * v[:, None]).sum(axis=0) / np.maximum(total, 1)
                held.append(some := np.empty(len(k), _CELL))
                some["r"], some["k"], some["w"] = r + a, k, copies[k, r]
                some["v"] = np.round(v[order][first][k] - mean[r], 12) + 0.0
        packs = []
        for kind, held in enumerate(cells):
            each = np.concatenate(held)
            packs += _packs((rows.channel, rows.chunk, kind), np.searchsorted(cuts[kind], each["v"]), each)
        return _table(rows.type, packs, stats)

    def place(table: pa.Table) -> pa.Table:
        return pa.table({"_channel": table["_channel"], "chunk": table["chunk"], "kind": table["kind"], "cells": pa.array(_placed(table), pa.binary())})

    def pooled_sums(table: pa.Table, places: pa.Table) -> pa.Table:
        rows = _Channel(table)
        ties = [_ties(v)[2] for v in (rows.t, rows.s)]
        of_kind = places["kind"].to_numpy()
        cells = [np.frombuffer(b"".join(places["cells"].filter(pa.array(of_kind == kind)).to_pylist()), _PLACE) for kind in (0, 1)]
        out = []
        for a, b in rows.sides():
            w = rows.weights(a, b)
            ranks = []
            for tie, each in zip(ties, cells):
                each = each[(each["r"] >= a) & (each["r"] < b)]
                of_value = np.zeros((tie.max() + 1, b - a))
                of_value[each["k"], each["r"] - a] = each["p"]
                ranks.append(of_value[tie])
            x, y = ranks
            out.append([v.sum(axis=0) for v in (w, w * x, w * y, w * x * x, w * y * y, w * x * y)])
        sums = np.concatenate([np.array(o) for o in out], axis=1)
        some = np.flatnonzero(sums[0])
        return pa.table({"replicate": pa.array((rows.chunk * SIDE + some).astype(np.int32)), **{n: pa.array(v[some]) for n, v in zip(("n", "x", "y", "xx", "yy", "xy"), sums)}})

    joined = known.join(drawn, "_group").select("_channel", "chunk", "_t", "_s", "drawn")
    by_channel = joined.groupBy("_channel", "chunk")
    channel = f"_channel {known.schema['_channel'].dataType.simpleString()}"
    both = once(by_channel.applyInArrow(of_channel, f"{channel}, {_PACK}, replicate int, stats array<double>"), "replicates")
    at = lambda i: F.col("stats")[i]
    by = both.where("replicate is not null").groupBy("replicate").agg(
        F.avg(at(0)).alias("macro_spearman"), F.avg(at(1)).alias("ndcg"), (F.sum(at(2)) / F.nullif(F.sum(at(3)), F.lit(0.0))).alias("pair_accuracy"),
        (F.sum(at(4)) / F.nullif(F.sum(at(5)), F.lit(0.0))).alias("local_pair_accuracy"))
    packs = _with_before(both.where("cells is not null").select("_channel", "chunk", "kind", "part", "sums", "cells"))
    placed = packs.groupBy("kind", "chunk", "part").applyInArrow(place, f"{channel}, chunk int, kind int, cells binary")
    sums = by_channel.cogroup(placed.groupBy("_channel", "chunk")).applyInArrow(
        pooled_sums, "replicate int, n double, x double, y double, xx double, yy double, xy double").groupBy("replicate").agg(
        *(F.sum(c).alias(f"_{c}") for c in ("n", "x", "y", "xx", "yy", "xy")))
    n_ = F.col("_n")
    va, vb = F.col("_xx") / n_ - F.pow(F.col("_x") / n_, 2), F.col("_yy") / n_ - F.pow(F.col("_y") / n_, 2)
    pooled = F.when((n_ >= 2) & (va > 1e-12) & (vb > 1e-12), (F.col("_xy") / n_ - F.col("_x") / n_ * F.col("_y") / n_) / F.sqrt(va * vb))
    return sums.select("replicate", pooled.alias("centred")).join(by, "replicate")
