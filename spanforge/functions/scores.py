"""Scoring expressions of candidates, events and pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import C, center, col, duration, shortest_ratio, triangular
from .text import terms_present


def heuristic_score(text: C, seconds: C, scenes: C, boost: Sequence[str], payoff: Sequence[str], drop: Sequence[str], ideal: float = 80.0) -> Column:
    """Terms present (.85 boost, .65 payoff, -.9 penalty), 2.5 times the duration fit, less .25 per scene beyond the first, and two bonuses."""
    d, n = col(seconds), col(scenes)
    return (
        0.85 * terms_present(text, boost) + 0.65 * terms_present(text, payoff) - 0.9 * terms_present(text, drop)
        + 2.5 * triangular(d, ideal, 95.0) - 0.25 * F.greatest(F.lit(0), n - 1)
        + F.when(d.between(45, 115), 0.7).otherwise(0.0) + F.when((n == 2) & (d <= 160), 0.25).otherwise(0.0))


#: What the kind of a window's boundary adds.
BOUNDARY = {"speech_boundary": 0.10, "sliding": 0.06, "scene_exact": 0.04}


def representative_score(score: C, seconds: C, kind: C) -> Column:
    """Score, .18 of the fit to 45 seconds, and the quality of the boundary."""
    quality = F.lit(0.0)
    for name, value in BOUNDARY.items():
        quality = F.when(col(kind) == name, value).otherwise(quality)
    return F.coalesce(col(score), F.lit(0.0)) + 0.18 * triangular(seconds, 45.0, 45.0) + quality


def event_value(score_norm: C, support_norm: C, seconds: C) -> Column:
    return 0.74 * col(score_norm) + 0.16 * col(support_norm) + 0.10 * triangular(seconds, 45.0, 45.0)


def relation_strength(s1: C, e1: C, k1: C, s2: C, e2: C, k2: C, second: float = 1.0) -> Column:
    """The largest of the overlap ratio, .75 for one scene set, and .55 of the nearness of the centres; ``second`` is the unit's length."""
    scale = F.greatest(duration(s1, e1), duration(s2, e2), F.lit(second)) * 1.5
    near = F.greatest(F.lit(0.0), 1 - F.abs(center(s1, e1) - center(s2, e2)) / scale)
    same = F.when((col(k1) != "") & (col(k1) == col(k2)), 0.75).otherwise(0.0)
    return F.greatest(shortest_ratio(s1, e1, s2, e2), same, 0.55 * near)


def hardness(seconds: C, target: C, speeches: C, coverage: C, speakers: C, description_chars: C, boundary: C, usable: C) -> Column:
    """How hard a negative is: nearness of the durations and amount of evidence, each at most 1."""
    at_most = lambda c, n: F.least(F.lit(1.0), F.coalesce(col(c), F.lit(0)) / n)
    alike = F.exp(-F.abs(F.log(F.greatest(F.lit(0.001), col(seconds)) / col(target))))
    return (0.25 * alike + 0.20 * at_most(speeches, 8.0) + 0.15 * at_most(coverage, 1.0) + 0.10 * at_most(speakers, 2.0)
            + 0.10 * at_most(description_chars, 240.0) + 0.10 * col(boundary) + 0.10 * F.coalesce(col(usable), F.lit(0)))


def primary_score(version: C, verdict: C, saliency: C, checks: Sequence[C], direct: C, chances: tuple[C, C, C]) -> Column:
    """Score of 0 to 100 of a judgment by its rubric version; null for abstentions and missing parts.

    v1: half saliency of 1 to 5, half checks of 0 to 2; v2 and v3: half
    saliency of 0 to 100, half checks of 0 to 4; v4: the direct percentile; v5:
    the product of three chances in percent.
    """
    mean = sum((col(c) for c in checks), F.lit(0.0)) / len(checks)
    a, b, c = (col(x) for x in chances)
    value = (
        F.when(col(version) == "v1", 0.5 * (col(saliency) - 1) / 4 * 100 + 0.5 * mean / 2 * 100)
        .when(col(version).isin("v2", "v3"), 0.5 * col(saliency) + 0.5 * mean / 4 * 100)
        .when(col(version) == "v4", col(direct)).when(col(version) == "v5", a * b * c / 10000.0))
    return F.when(col(verdict) == "score", value)


def region_weight(left: C, right: C, gap: C, local: tuple[float, float] = (0.10, 0.40), local_boost: float = 1.0, middle: tuple[float, float] = (0.2, 0.8),
                  middle_boost: float = 1.0, extreme: float = 1.0) -> Column:
    """Weight of a training pair: boosts for a local gap and for two targets in the middle, a factor for opposite extremes."""
    low, high = middle
    a, b = col(left), col(right)
    both = (a > low) & (a < high) & (b > low) & (b < high)
    apart = ((a <= low) & (b >= high)) | ((b <= low) & (a >= high))
    return (F.when(col(gap).between(*local), local_boost).otherwise(1.0) * F.when(both, middle_boost).otherwise(1.0)
            * F.when(apart, extreme).otherwise(1.0))


def weighted_mean(values: Mapping[str, float]) -> Column:
    """Mean of columns by weights that are scaled to sum to 1."""
    total = sum(values.values())
    return sum((F.col(c) * F.lit(w / total) for c, w in values.items()), F.lit(0.0))


def duration_bonus(seconds: C) -> Column:
    """What usual lengths of clips add: about 30, 45 and 60 seconds .5, about 75 seconds .2."""
    d = col(seconds)
    return F.when(d.between(25, 35) | d.between(40, 50) | d.between(55, 65), 0.5).when(d.between(70, 80), 0.2).otherwise(0.0)


def position_score(start_seconds: C) -> Column:
    """0 in the first 90 seconds, .35 to 180, .7 to 300, then 1."""
    s = col(start_seconds)
    return F.when(s < 90, 0.0).when(s < 180, 0.35).when(s < 300, 0.7).otherwise(1.0)


def trim_components(text: C, start_seconds: C, end_seconds: C, kind: C, source_rank: C, rank: C, window_rank: C, genre: C, lecture: Mapping[str, float],
                    variety: Mapping[str, float], filler: Mapping[str, float], titles: Sequence[str]) -> dict[str, Column]:
    """Twelve parts of the score of a trim window, each from 0 to 1.

    ``source_rank`` may be null, then the window's own rank counts; ``kind`` is sliding, speech_boundary or another.
    """
    from .text import keyword_score

    t = F.coalesce(col(text), F.lit(""))
    d = F.greatest(F.lit(0.0), col(end_seconds) - col(start_seconds))
    at_most = lambda c, n: F.least(F.lit(float(n)), c) / float(n)
    is_lecture = col(genre) == "lecture"
    lines = F.char_length(F.regexp_replace(t, "[^\n]", ""))
    title = sum(((F.char_length(t) - F.char_length(F.replace(t, F.lit(x), F.lit("")))) / F.lit(float(len(x))) for x in titles), F.lit(0.0))
    prior = lambda r, n: F.when(r.isNotNull(), F.greatest(F.lit(0.0), 1 - (r - 1) / F.lit(float(n))))
    solid = F.char_length(F.trim(t))
    return {
        "signal": at_most(F.when(is_lecture, keyword_score(t, lecture)).otherwise(keyword_score(t, variety)), 8),
        "duration": F.when(is_lecture, triangular(d, 55.0, 55.0)).otherwise(triangular(d, 45.0, 45.0)),
        "speech_density": at_most(lines, 10), "titleability": at_most(title, 5),
        "rank_prior": F.coalesce(prior(col(source_rank), 20), prior(col(rank), 120)), "window_prior": prior(F.coalesce(col(window_rank), F.lit(999)), 35),
        "sliding_window": F.when(col(kind) == "sliding", 1.0).otherwise(0.0), "speech_boundary": F.when(col(kind) == "speech_boundary", 1.0).otherwise(0.0),
        "duration_bucket": duration_bonus(d), "position": position_score(start_seconds),
        "content_volume": F.when(solid == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(solid / 450.0, lines / 8.0))),
        "filler_penalty": at_most(keyword_score(t, filler), 5),
    }


#: Weights of the parts that count.
TRIM_WEIGHTS = {"signal": 0.5, "duration": 1.7, "speech_density": 1.8, "titleability": 0.4, "rank_prior": 0.5, "sliding_window": 0.5, "speech_boundary": 0.5, "filler_penalty": -2.5}


def trim_score(components: Mapping[str, Column], language: C, known: Sequence[str] = ("ko", "en")) -> Column:
    """The weighted parts, less .2 for a language that isn't known."""
    return sum((w * components[c] for c, w in TRIM_WEIGHTS.items()), F.lit(0.0)) - F.when(F.coalesce(col(language).isin(*known), F.lit(False)), 0.0).otherwise(0.2)


def placeholder_score(text: C, seconds: C, terms: Sequence[str]) -> Column:
    """Occurrences of the terms, plus the fit of the duration to 45 seconds."""
    t = F.coalesce(col(text), F.lit(""))
    return sum(((F.char_length(t) - F.char_length(F.replace(t, F.lit(x), F.lit("")))) / F.lit(float(len(x))) for x in terms), F.lit(0.0)) + triangular(seconds, 45.0, 45.0)


def _bounded(value: Column, low: float, high: float) -> Column:
    """Half-even whole number of a value cut to its bounds; sums that are a half but for their last digits count as one."""
    return F.bround(F.round(F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), value)), 9)).cast("int")


#: Weights of the engagement parts, penalties by intelligibility, and anchors of the chances in percent.
SALIENCY_WEIGHTS = {"opening": 0.29, "change": 0.23, "gain": 0.27, "memorable": 0.21}
INTELLIGIBILITY_PENALTY = {5: 0, 4: 0, 3: 3, 2: 8, 1: 15}
STOP_ANCHORS = (8, 18, 32, 48, 67)
SHARE_ANCHORS = (2, 5, 10, 20, 36)


def saliency(dimensions: Mapping[str, C]) -> Column:
    """0 to 100 from engagement scores of 0 to 4 (opening, change, gain, memorable)."""
    return _bounded(sum((w * col(dimensions[d]) for d, w in SALIENCY_WEIGHTS.items()), F.lit(0.0)) / 4.0 * 100.0, 0, 100)


def evidence_saliency(base: C, intelligibility: C, flags: C) -> Column:
    """Saliency less what weak evidence costs."""
    penalty = F.lit(0)
    for level, cost in INTELLIGIBILITY_PENALTY.items():
        penalty = F.when(col(intelligibility) == level, cost).otherwise(penalty)
    flagged = lambda f, cost: F.when(F.array_contains(col(flags), f), cost).otherwise(0)
    return _bounded(col(base) - penalty - flagged("asr_degraded", 3) - flagged("visual_dependent", 4), 0, 100)


def funnel_chances(dimensions: Mapping[str, C], seconds: C) -> dict[str, Column]:
    """Chances in percent to stop, to watch and to share, from scores of 0 to 4 and a duration."""
    d = {k: col(v) for k, v in dimensions.items()}
    anchor = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), i.cast("int") + 1)
    stop = anchor(STOP_ANCHORS, d["opening"]) + (d["change"] - 2) * 2
    watch = 28 + 15 * (d["progression"] + d["boundary"] + d["gain"]) / 3.0 - F.when(col(seconds) > 90, 8).when(col(seconds) > 60, 4).otherwise(0)
    share = anchor(SHARE_ANCHORS, F.bround((d["gain"] + d["memorable"]) / 2.0)) + F.greatest(F.lit(0), d["change"] - 2) * 2
    return {"stop": _bounded(stop, 1, 80), "watch": _bounded(watch, 20, 92), "share": _bounded(share, 1, 50)}


def rubric_checks(checks: Mapping[str, C], boundary: C, flags: C) -> dict[str, Column]:
    """The checks, and the naturalness of both ends: the boundary score less one where it is flagged as awkward."""
    end = lambda flag: F.greatest(F.lit(0), col(boundary) - F.when(F.array_contains(col(flags), flag), 1).otherwise(0))
    return {**{k: col(v) for k, v in checks.items()}, "natural_start": end("awkward_start"), "natural_end": end("awkward_end")}
