"""Greedy selection of diverse intervals, in rounds that carry each row's state along.

Candidates are ordered by (score descending, start, end, id), so ties have a
defined winner. A round is one window over the recording: it finds the best open row and
tells every row of it. All windows share one shuffle, so a recording of any length may spill.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    """Overlap of two structs (s, e) over the shorter one."""
    both = F.greatest(F.lit(0), F.least(a["e"], b["e"]) - F.greatest(a["s"], b["s"]))
    short = F.least(a["e"] - a["s"], b["e"] - b["s"])
    return F.when(short > 0, both / short).otherwise(0.0)


def in_rounds(items: DataFrame, key: str, rounds: Sequence[tuple[Column, Column]], limit: int | Column, max_overlap: float) -> DataFrame:
    """``items`` (key, struct x of s, e, id and more, and other columns) with ``place``, the number of the row in the order of choice, and ``n``, how many were chosen.

    Each round (test, order) chooses the least ``order`` among the rows that pass ``test``, overlap no chosen one by more than
    ``max_overlap`` of the shorter and share no chosen one's id, if fewer than ``limit`` are chosen. ``order`` ends in what tells rows apart. Tests and orders may use
    ``near``, the distance of centres to the nearest chosen row (null before the first), and ``most``, the greatest overlap with one.
    """
    w = Window.partitionBy(key)
    kept = [c for c in items.columns if c != key]
    state = items.select("*", F.lit(None).cast("double").alias("near"), F.lit(0.0).alias("most"), F.lit(True).alias("open"), F.lit(None).cast("int").alias("place"), F.lit(0).alias("n"))
    x, best = F.col("x"), F.col("best.x")
    limit = F.lit(limit) if isinstance(limit, int) else limit
    for test, order in rounds:
        can = F.col("open") & test & (F.col("most") <= max_overlap) & (F.col("n") < limit)
        state = state.withColumn("best", F.min(F.when(can, F.struct(order.alias("v"), x.alias("x")))).over(w))
        some = F.col("best").isNotNull()
        chosen = some & F.col("open") & (x == best)
        apart = F.abs((x["s"] + x["e"]) - (best["s"] + best["e"])) / 2.0
        state = state.select(
            key, *kept, F.when(some, F.least("near", apart)).otherwise(F.col("near")).alias("near"), F.when(some, F.greatest("most", _ratio(x, best))).otherwise(F.col("most")).alias("most"),
            (F.col("open") & ~F.coalesce(x["id"] == best["id"], F.lit(False))).alias("open"), F.when(F.coalesce(chosen, F.lit(False)), F.col("n") + 1).otherwise(F.col("place")).alias("place"),
            (F.col("n") + F.when(some, 1).otherwise(0)).alias("n"))
    return state


def filled(state: DataFrame, key: str, order: Sequence[Column], limit: int | Column) -> DataFrame:
    """The chosen rows of :func:`in_rounds`, and after them those that share no chosen one's id, in ``order``, up to ``limit``."""
    rest = F.row_number().over(Window.partitionBy(key, F.col("place").isNull() & F.col("open")).orderBy(*order)) + F.col("n")
    limit = F.lit(limit) if isinstance(limit, int) else limit
    placed = F.when(F.col("place").isNotNull(), F.col("place")).when(F.col("open"), rest)
    return state.withColumn("place", placed).where(F.col("place") <= limit)


def _items(rows: DataFrame, key: str, id_col: str, score: str, start: str, end: str, *more: Column) -> DataFrame:
    item = F.struct((-F.col(score)).alias("cost"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(id_col).alias("id"))
    return rows.select(F.col(key), item.alias("x"), *more)


def _numbered(state: DataFrame, key: str, id_col: str) -> DataFrame:
    return state.where("place is not null").select(key, "place", F.col("x.id").alias(id_col), (-F.col("x.cost")).alias("score"))


def suppress_overlaps(rows: DataFrame, k: int, max_overlap: float, key: str = "longform_id", id_col: str = "scene_id", score: str = "value",
                      start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """(key, place, id, score): best first, each kept if it overlaps no kept one by more than ``max_overlap`` of the shorter, up to ``k``. Rows of one id count once."""
    state = in_rounds(_items(rows, key, id_col, score, start, end), key, [(F.lit(True), F.col("x"))] * k, k, max_overlap)
    return _numbered(state, key, id_col)


def bins_then_fill(rows: DataFrame, k: int, bins: int, max_overlap: float, key: str = "longform_id", id_col: str = "scene_id", score: str = "value",
                   start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """The best allowed candidate of each of ``bins`` equal parts of the timeline by centre, in their order, then others by score, up to ``k``."""
    length = F.max(end).over(Window.partitionBy(key))
    part = F.least(F.lit(bins - 1), F.floor((F.col(start) + F.col(end)) * bins / (2 * F.greatest(length, F.lit(1))))).alias("part")
    rounds = [(F.col("part") == b, F.col("x")) for b in range(bins)] + [(F.lit(True), F.col("x"))] * k
    return _numbered(in_rounds(_items(rows, key, id_col, score, start, end, part), key, rounds, k, max_overlap), key, id_col)


def relevance_and_diversity(rows: DataFrame, k: int, max_overlap: float, diversity: float, penalty: float, key: str = "longform_id", id_col: str = "scene_id",
                            score: str = "value", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Maximal marginal relevance: in each of ``k`` rounds the best of score + diversity * spread - penalty * overlap.

    Spread is the distance of centres to the nearest chosen one over 13 % of the
    timeline, at most 1; candidates over the overlap cap are out. The first round takes the best score with full spread.
    Each row carries its nearest distance and greatest overlap so far, so a round is one window over the recording; all
    windows share one shuffle, and a recording of any length may spill.
    """
    w = Window.partitionBy(key)
    item = F.struct((-F.col(score)).alias("cost"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(id_col).alias("id"))
    state = rows.select(F.col(key), item.alias("x"), F.greatest(F.lit(1), F.max(end).over(w)).alias("length"), F.lit(None).cast("double").alias("near"),
                        F.lit(0.0).alias("most"), F.lit(True).alias("open"), F.lit(None).cast("int").alias("place"))
    x, best = F.col("x"), F.col("best.x")
    for n in range(1, k + 1):
        spread = F.coalesce(F.least(F.lit(1.0), F.col("near") / F.col("length") / 0.13), F.lit(1.0))
        value = F.round(-x["cost"] + diversity * spread - penalty * F.col("most"), 9)
        state = state.withColumn("best", F.min(F.when(F.col("open"), F.struct((-value).alias("v"), x.alias("x")))).over(w))
        shared, apart = _ratio(x, best), F.abs((x["s"] + x["e"]) - (best["s"] + best["e"])) / 2.0
        chosen = F.coalesce(F.col("open") & (x == best), F.lit(False))
        state = state.select(
            key, "x", "length", F.coalesce(F.least("near", apart), F.col("near")).alias("near"), F.greatest(F.col("most"), F.coalesce(shared, F.lit(0.0))).alias("most"),
            (F.col("open") & ~chosen & ~F.coalesce((shared > max_overlap) | (x["id"] == best["id"]), F.lit(False))).alias("open"), F.when(chosen, n).otherwise(F.col("place")).alias("place"))
    return state.where("place is not null").select(key, "place", F.col("x.id").alias(id_col), (-F.col("x.cost")).alias("score")).dropDuplicates([key, "place"])


def source_bands(rows: DataFrame, k: int, bands: int, max_overlap: float, source_rank: str, key: str = "longform_id", id_col: str = "scene_id",
                 score: str = "value", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """One best allowed candidate per band of source ranks, then the best allowed overall, then the best left whatever its overlap, up to ``k``."""
    top = F.max(source_rank).over(Window.partitionBy(key))
    band = F.least(F.lit(bands - 1), F.floor((F.col(source_rank) - 1) * bands / F.greatest(top, F.lit(1)))).alias("band")
    rounds = [(F.col("band") == b, F.col("x")) for b in range(bands)] + [(F.lit(True), F.col("x"))] * k
    state = in_rounds(_items(rows, key, id_col, score, start, end, band), key, rounds, k, max_overlap)
    return _numbered(filled(state, key, [F.col("x")], k), key, id_col)
