"""Candidate windows from scenes and speeches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjacent_windows(scenes: DataFrame, key: str = "longform_id", min_ms: int = 15_000, max_ms: int = 90_000, most_scenes: int = 4) -> DataFrame:
    """Runs of 1 to ``most_scenes`` neighbouring scenes with a duration within bounds: the first scene's id, width, start and end."""
    w = Window.partitionBy(key).orderBy("start_ms", "end_ms", "scene_id")
    ends = F.array(*(F.struct(F.lit(n).alias("width"), F.lead("end_ms", n - 1).over(w).alias("end_ms")) for n in range(1, most_scenes + 1)))
    wide = scenes.select(key, "scene_id", "start_ms", ends.alias("ends"))
    runs = wide.select(key, "scene_id", "start_ms", F.inline("ends"))
    length = F.col("end_ms") - F.col("start_ms")
    return runs.where((length >= min_ms) & (length <= max_ms))


def speech_runs(speeches: DataFrame, key: str = "longform_id", min_ms: int = 8_000, max_ms: int = 30_000, max_gap_ms: int = 3_000, most: int = 8) -> DataFrame:
    """Runs of 1 to ``most`` speeches without a gap over ``max_gap_ms``, with a duration within bounds.

    Gaps cut a recording into islands; a run ends in the island where it starts.
    """
    w = Window.partitionBy(key).orderBy("start_ms", "end_ms", "speech_id")
    gap = F.col("start_ms") - F.lag("end_ms").over(w)
    islands = speeches.withColumn("_new", F.when(gap > max_gap_ms, 1).otherwise(0)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "island").orderBy("start_ms", "end_ms", "speech_id")
    ends = F.array(*(F.struct(F.lit(n).alias("speeches"), F.lead("end_ms", n - 1).over(inside).alias("end_ms")) for n in range(1, most + 1)))
    wide = islands.select(key, "speech_id", "start_ms", ends.alias("ends"))
    runs = wide.select(key, "speech_id", "start_ms", F.inline("ends"))
    length = F.col("end_ms") - F.col("start_ms")
    return runs.where((length >= min_ms) & (length <= max_ms))


def sliding_windows(scenes: DataFrame, durations_ms: Sequence[int] = (15_000, 30_000), stride_ms: int = 5_000) -> DataFrame:
    """Windows of each duration from a scene's start on, every ``stride_ms``, that end within the scene."""
    sized = scenes.withColumn("window_ms", F.explode(F.array(*(F.lit(d) for d in sorted(set(durations_ms))))))
    room = F.col("end_ms") - F.col("start_ms") - F.col("window_ms")
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(room / stride_ms)))
    return sized.where(room >= 0).withColumn("step", steps).select(
        *(c for c in scenes.columns if c not in ("start_ms", "end_ms")), "window_ms", "step", (F.col("start_ms") + F.col("step") * stride_ms).alias("start_ms")
    ).withColumn("end_ms", F.col("start_ms") + F.col("window_ms"))


def spaced_windows(sources: DataFrame, window_ms: int, n: int) -> DataFrame:
    """The whole source where it is no longer than a window, else ``n`` windows at even distances from its start to its end."""
    room = F.col("end_ms") - F.col("start_ms") - window_ms
    steps = F.explode(F.sequence(F.lit(0), F.when(room <= 0, 0).otherwise(n - 1)))
    start = F.col("start_ms") + (F.expr(f"(end_ms - start_ms - {window_ms}) * step div {max(1, n - 1)}") if n > 1 else F.lit(0))
    rest = [c for c in sources.columns if c not in ("start_ms", "end_ms")]
    return sources.withColumn("step", steps).select(
        *rest, F.when(room <= 0, "source_full").otherwise("spaced").alias("kind"), "step",
        F.when(room <= 0, F.col("start_ms")).otherwise(start).alias("start_ms"),
        F.when(room <= 0, F.col("end_ms")).otherwise(start + window_ms).alias("end_ms"))


def prefix_windows(sources: DataFrame, durations_ms: Sequence[int]) -> DataFrame:
    """Windows from the source's start, one per duration, cut at its end."""
    rest = [c for c in sources.columns if c != "end_ms"]
    sized = sources.withColumn("window_ms", F.explode(F.array(*(F.lit(d) for d in durations_ms))))
    return sized.select(*rest, "window_ms", F.least(F.col("end_ms"), F.col("start_ms") + F.col("window_ms")).alias("end_ms"))


def repeat_tasks(candidates: DataFrame, id_col: str, repeats: int, seed: int) -> DataFrame:
    """(id, repeat, position): each candidate once per repeat, with a hash that shuffles them anew for each."""
    position = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(id_col).cast("string")), 256)
    return candidates.select(id_col).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("position", position)


def first_windows(windows: DataFrame, key: str, start: str, end: str, order: str) -> DataFrame:
    """Windows without empty ones and without repeats of an interval at millisecond precision; the first in ``order`` stays."""
    w = Window.partitionBy(key, start, end).orderBy(order)
    return windows.where(F.col(end) > F.col(start)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_k(rows: DataFrame, key: str, k: int, *order) -> DataFrame:  # noqa: ANN002
    """The first ``k`` rows of each key by ``order``, numbered."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= k)


def boundary_windows(sources: DataFrame, scenes: DataFrame, durations_ms: Sequence[int], min_ms: int, key: str = "longform_id", id_col: str = "source_id") -> DataFrame:
    """Windows of each duration forward and backward from every distinct scene boundary within a source, cut to it, ``min_ms`` long or longer.

    Columns: the key, the source's id, start_ms, end_ms; equal windows come once.
    """
    from .joins import interval_join

    pairs = interval_join(sources, scenes, key)
    marks = pairs.select(
        F.col(f"l.{key}").alias(key), F.col(f"l.{id_col}").alias(id_col), F.col("l.start_ms").alias("s"), F.col("l.end_ms").alias("e"),
        F.explode(F.array("r.start_ms", "r.end_ms")).alias("at")).where("at >= s and at <= e").distinct()
    sized = marks.withColumn("d", F.explode(F.array(*(F.lit(d) for d in durations_ms))))
    both = sized.select(key, id_col, "s", "e", F.inline(F.array(
        F.struct(F.col("at").alias("a"), (F.col("at") + F.col("d")).alias("b")), F.struct((F.col("at") - F.col("d")).alias("a"), F.col("at").alias("b")))))
    cut = both.select(key, id_col, F.greatest("a", "s").alias("start_ms"), F.least("b", "e").alias("end_ms"))
    return cut.where(F.col("end_ms") - F.col("start_ms") >= min_ms).distinct()
