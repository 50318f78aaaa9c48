"""Windows made from ranked sources and for the duration of a target, and the choice of hard negatives."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.scores import hardness

from .generate import boundary_windows, prefix_windows, spaced_windows
from .joins import away_from
from .scenes import window_features


def padded_speech_runs(sources: DataFrame, said: DataFrame, id_col: str = "source_id", min_ms: int = 20_000, max_ms: int = 90_000, max_gap_ms: int = 4_000,
                       most: int = 18, lead_ms: int = 1_000, tail_ms: int = 1_500) -> DataFrame:
    """Runs of the speeches cut to a source (see related_speeches), padded within it: id, start_ms, end_ms.

    A run ends at a gap over ``max_gap_ms`` or after ``most`` speeches; windows within the bounds stay.
    """
    w = Window.partitionBy(id_col).orderBy("start_ms", "end_ms", "text")
    fresh = F.when(F.col("start_ms") - F.lag("end_ms").over(w) > max_gap_ms, 1).otherwise(0)
    placed = said.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(id_col, "_island").orderBy("start_ms", "end_ms", "text")
    ends = F.array(*(F.lead("end_ms", n).over(inside) for n in range(most)))
    runs = placed.select(id_col, "start_ms", ends.alias("ends")).select(id_col, "start_ms", F.explode("ends").alias("end_ms")).where("end_ms is not null")
    bounds = sources.select(id_col, F.col("start_ms").alias("_lo"), F.col("end_ms").alias("_hi"))
    out = runs.join(bounds, id_col).select(
        id_col, F.greatest("_lo", F.col("start_ms") - lead_ms).alias("start_ms"), F.least("_hi", F.col("end_ms") + tail_ms).alias("end_ms"))
    length = F.col("end_ms") - F.col("start_ms")
    return out.where((length >= min_ms) & (length <= max_ms)).distinct()


def expand_sources(sources: DataFrame, durations_ms: Sequence[int], windows_per_source: int = 5, prefixes_ms: Sequence[int] = (), scenes: DataFrame | None = None,
                   said: DataFrame | None = None, most_rank: int = 10, min_ms: int = 15_000, key: str = "longform_id", id_col: str = "source_id") -> DataFrame:
    """Ranked windows of ranked sources: the key, id, source_rank, window_rank, kind, start_ms, end_ms and rank over the recording.

    The windows of a source are prefixes, evenly spaced ones, those at scene
    boundaries and those of speech runs, in this order; equal ones come once. A window's rank goes on from those of the
    sources before it in the recording.
    """
    base = sources.where(F.col("rank") <= most_rank).select(key, id_col, "rank", "start_ms", "end_ms")
    part = lambda df, order, kind, first: df.select(
        key, id_col, "rank", "start_ms", "end_ms", F.lit(order).alias("_part"), F.lit(kind).alias("kind") if kind else F.col("kind"), first.cast("long").alias("_first"))
    parts = [part(prefix_windows(base, prefixes_ms), 0, "prepend", F.col("window_ms"))] if prefixes_ms else []
    for d in sorted(set(durations_ms)):
        parts.append(part(spaced_windows(base, d, windows_per_source), 1 + len(parts), None, F.col("step")))
    ranks = base.select(id_col, "rank")
    if scenes is not None:
        parts.append(part(boundary_windows(base, scenes, durations_ms, min_ms, key, id_col).join(ranks, id_col), 100, "scene_boundary", F.col("start_ms")))
    if said is not None:
        runs = padded_speech_runs(base, said, id_col).join(base.select(key, id_col, "rank"), id_col)
        parts.append(part(runs, 101, "speech_boundary", F.col("start_ms")))
    every = reduce(DataFrame.unionByName, parts).where("end_ms > start_ms")
    order = ["_part", "_first", "start_ms", "end_ms"]
    once = every.withColumn("_n", F.row_number().over(Window.partitionBy(id_col, "start_ms", "end_ms").orderBy(*order))).where("_n = 1")
    placed = once.withColumn("window_rank", F.row_number().over(Window.partitionBy(id_col).orderBy(*order)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("rank", id_col, "window_rank"))
    return placed.select(key, id_col, F.col("rank").alias("source_rank"), "window_rank", "kind", "start_ms", "end_ms", rank.alias("rank"))


def _runs(marks: DataFrame, targets: DataFrame, low: Column, high: Column, key: str, target: str, kind: str, strength: float) -> DataFrame:
    """Pairs of a mark's start and a later or the same mark's end that are ``low`` to ``high`` apart: both are dealt to bins of two minutes."""
    width = 120_000
    starts = targets.join(marks.select(key, F.col("start_ms")), key).withColumn("_bin", F.explode(F.sequence(
        F.floor((F.col("start_ms") + low) / width), F.floor((F.col("start_ms") + high) / width))))
    ends = marks.select(key, "end_ms", F.floor(F.col("end_ms") / width).alias("_bin"))
    length = F.col("end_ms") - F.col("start_ms")
    found = starts.join(ends, [key, "_bin"]).where((length >= low) & (length <= high))
    return found.select(key, target, "start_ms", "end_ms", F.lit(kind).alias("boundary_type"), F.lit(strength).alias("boundary_strength"))


def evaluation_windows(targets: DataFrame, scenes: DataFrame, speeches: DataFrame, key: str = "longform_id", target: str = "target_ms", ratios: tuple[float, float] = (0.75, 1.25)) -> DataFrame:
    """Windows of about the duration of a target: key, target, start_ms, end_ms, boundary_type, boundary_strength.

    They are the runs of scenes (strength 1) and of speeches (.85) of .75 to
    1.25 times the duration, 8 to 120 seconds; of equal intervals the strongest
    stays. A target without any gets windows of its duration at both edges of each scene that is long enough (.65).
    """
    wanted = targets.select(key, target).distinct()
    low, high = F.greatest(F.lit(8000.0), F.col(target) * ratios[0]), F.least(F.lit(120_000.0), F.col(target) * ratios[1])
    runs = _runs(scenes, wanted, low, high, key, target, "scene_sequence", 1.0).union(_runs(speeches.dropDuplicates([key, "start_ms", "end_ms", "text"]), wanted, low, high, key, target, "speech_sequence", 0.85))
    size = F.least(F.lit(120_000.0), F.greatest(F.lit(8000.0), F.col(target).cast("double"))).cast("long")
    rest = wanted.join(runs.select(key, target).distinct(), [key, target], "left_anti").join(scenes.select(key, "start_ms", "end_ms"), key).where(F.col("end_ms") - F.col("start_ms") >= size)
    edge = rest.select(key, target, F.explode(F.array("start_ms", F.greatest("start_ms", F.col("end_ms") - size))).alias("start_ms"), size.alias("_size"))
    edges = edge.select(key, target, "start_ms", (F.col("start_ms") + F.col("_size")).alias("end_ms"), F.lit("scene_edge_duration_trim").alias("boundary_type"), F.lit(0.65).alias("boundary_strength"))
    best = F.max_by(F.struct("boundary_type", "boundary_strength"), "boundary_strength")
    return runs.union(edges).groupBy(key, target, "start_ms", "end_ms").agg(best.alias("b")).select(key, target, "start_ms", "end_ms", "b.*")


def hard_negatives(targets: DataFrame, scenes: DataFrame, speeches: DataFrame, known: DataFrame, guard_ms: int = 2_000, key: str = "longform_id", target: str = "target_ms") -> DataFrame:
    """The hardest evaluation window of each target away from known intervals, with evidence: its hardness and the size of the pool.

    Ties go to the nearest duration, then to the earliest start.
    """
    windows = away_from(evaluation_windows(targets, scenes, speeches, key, target), known, key, guard_ms)
    windows = windows.withColumn("candidate_id", F.concat_ws(":", key, target, "start_ms", "end_ms"))
    f = window_features(windows.select(key, "candidate_id", "start_ms", "end_ms"), scenes, speeches, key=key).drop(key)
    seconds = (F.col("end_ms") - F.col("start_ms")) / 1000.0
    joined = windows.join(f, "candidate_id").where("description <> '' or transcript <> ''")
    value = hardness(seconds, F.col(target) / 1000.0, "speech_count", "speech_coverage", "unique_speakers", "description_chars", "boundary_strength", F.col("text_usable").cast("int"))
    scored = joined.withColumn("hardness", F.round(value, 9))
    w = Window.partitionBy(key, target)
    order = w.orderBy(F.desc("hardness"), F.abs(F.col("end_ms") - F.col("start_ms") - F.col(target)), "start_ms", "end_ms")
    return scored.withColumns({"_n": F.row_number().over(order), "pool_size": F.count("*").over(w)}).where("_n = 1").select(
        key, target, "start_ms", "end_ms", "boundary_type", "hardness", "pool_size")


def unique_candidates(rows: DataFrame, order: Sequence[str | Column], key: str = "longform_id", start: str = "start_sec", end: str = "end_sec", scenes: str | None = None) -> DataFrame:
    """The first row in ``order`` of each interval of a recording, times at three decimals, and of each set of scenes."""
    same = [F.col(key), F.format_string("%.3f", F.col(start).cast("double")), F.format_string("%.3f", F.col(end).cast("double"))]
    if scenes:
        same.append(F.coalesce(F.col(scenes), F.lit("")))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(*order))).where("_n = 1").drop("_n")
