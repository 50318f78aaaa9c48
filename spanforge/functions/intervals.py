"""Measures of half-open intervals; times in any one unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    """part / whole, or ``otherwise`` where the whole isn't positive."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(otherwise))


def duration(start: C, end: C) -> Column:
    return F.greatest(F.lit(0), col(end) - col(start))


def center(start: C, end: C) -> Column:
    return (col(start) + col(end)) / 2.0


def overlap(s1: C, e1: C, s2: C, e2: C) -> Column:
    """Common length; touching intervals have none."""
    return F.greatest(F.lit(0), F.least(col(e1), col(e2)) - F.greatest(col(s1), col(s2)))


def hull_iou(s1: C, e1: C, s2: C, e2: C) -> Column:
    """Overlap over the length from the first start to the last end; null if an end is null."""
    hull = F.greatest(col(e1), col(e2)) - F.least(col(s1), col(s2))
    known = col(s1).isNotNull() & col(e1).isNotNull() & col(s2).isNotNull() & col(e2).isNotNull()
    return F.when(known, ratio(overlap(s1, e1, s2, e2), hull))


def coverage(pred_start: C, pred_end: C, gold_start: C, gold_end: C) -> Column:
    """Share of the gold interval that the predicted one covers."""
    return ratio(overlap(pred_start, pred_end, gold_start, gold_end), col(gold_end) - col(gold_start))


def shortest_ratio(s1: C, e1: C, s2: C, e2: C) -> Column:
    """Overlap over the shorter duration: the measure of redundancy of the selectors."""
    return ratio(overlap(s1, e1, s2, e2), F.least(duration(s1, e1), duration(s2, e2)))


def triangular(length: C, ideal: float, tolerance: float) -> Column:
    """1 at the ideal duration, falling to 0 at ``tolerance`` from it."""
    return F.greatest(F.lit(0.0), 1 - F.abs(col(length) - ideal) / F.lit(float(tolerance)))


def interval_key(longform: C, start: C, end: C, scenes: C | None = None) -> Column:
    """Text key of an interval in seconds at three decimals."""
    parts = [col(longform).cast("string"), F.format_string("%.3f", col(start).cast("double")), F.format_string("%.3f", col(end).cast("double"))]
    if scenes is not None:
        parts.append(F.array_join(F.array_sort(F.split(col(scenes), r"\|")), "|"))
    return F.concat_ws(":", *parts)


def prediction_scores(ps: C, pe: C, gs: C, ge: C, unit: float = 1.0, core: float = 0.70, tight: float = 0.30, tolerance: float = 15.0) -> dict[str, Column]:
    """Quality of a predicted interval against a gold one; ``unit`` is the length of a second.

    A core hit covers ``core`` of the gold interval and at least five seconds or
    half of it; a tight hit also has the IoU ``tight``. The score weighs coverage,
    IoU, start and length by .45, .30, .15 and .10.
    """
    gold, pred = duration(gs, ge) / unit, duration(ps, pe) / unit
    both = overlap(ps, pe, gs, ge) / unit
    covered, iou = coverage(ps, pe, gs, ge), hull_iou(ps, pe, gs, ge)
    start_error = F.abs(col(ps) - col(gs)) / unit
    start_score = F.greatest(F.lit(0.0), 1 - start_error / tolerance)
    length_score = ratio(F.least(pred, gold), F.greatest(pred, gold))
    core_hit = (covered >= core) & (both >= F.least(F.lit(5.0), gold / 2))
    return {
        "overlap_sec": both.cast("double"), "gold_coverage": covered, "temporal_iou": iou, "start_error_sec": start_error.cast("double"),
        "end_error_sec": (F.abs(col(pe) - col(ge)) / unit).cast("double"),
        "center_error_sec": F.abs(center(ps, pe) - center(gs, ge)) / unit,
        "start_score": start_score, "length_score": length_score,
        "core_hit": core_hit, "tight_hit": core_hit & (iou >= tight),
        "final_score": 100 * (0.45 * covered + 0.30 * iou + 0.15 * start_score + 0.10 * length_score),
    }
