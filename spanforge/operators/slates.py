"""Slates of a recording: events made of like intervals, and their selection over the timeline.

Selection goes in rounds of windows, as in :mod:`spanforge.operators.select`.
Values that are compared are rounded to nine decimals, so that equal ones tie; ties go to the
first in order of (score descending, start, end, id).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.intervals import interval_key
from spanforge.functions.scores import trim_components, trim_score
from spanforge.functions.text import detect_language, genre, seconds_to_clock

from spanforge.sources.shared import once

from .generate import top_k
from .joins import evidence, interval_join
from .select import _ratio, bins_then_fill, filled, in_rounds, relevance_and_diversity, source_bands, suppress_overlaps
from .windows import unique_candidates


def _center(x: Column) -> Column:
    return (x["s"] + x["e"]) / 2.0


def cluster_events(rows: DataFrame, threshold: float = 0.55, key: str = "longform_id", id_col: str = "scene_id", score: str = "score",
                   start: str = "start_ms", end: str = "end_ms", scenes: str | None = None, second: float = 1000.0) -> DataFrame:
    """A row per event of a recording: place, id of its representative, score, support, start, end, score_norm and support_norm.

    From the best score down, an interval joins the event with the closest
    earlier member if their relation is ``threshold`` (0.55 or more) or more, of equally close ones that of the event begun first, else it begins one. The relation is the largest of the
    overlap over the shorter, .75 for the same scenes, and .55 of the nearness of the centres over 1.5 times the longer.
    The representative has the best score, of equal ones the duration nearest to 45 seconds. Both norms are over the
    recording's events, 1 where they are flat.

    A relation of 0.55 needs an overlap, the same scenes or the same centre, so those it can be with come from joins. Each interval keeps its closest earlier ones alone; its event is that of the first interval
    that these lead to, found by pointer jumping, in rounds that grow with the logarithm of the longest chain.
    """
    if threshold < 0.55:
        raise ValueError("events have a threshold of 0.55 or more")
    cost = -F.round(F.col(score), 9)
    flat = rows.select(key, cost.alias("cost"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(id_col).alias("id"), (F.coalesce(F.col(scenes), F.lit("")) if scenes else F.lit("")).alias("k"))
    items = once(flat.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("cost", "s", "e", "id", "k"))), "event-items")

    def relation(x: Column, y: Column) -> Column:
        scale = F.greatest(x["e"] - x["s"], y["e"] - y["s"], F.lit(second)) * 1.5
        near = F.greatest(F.lit(0.0), 1 - F.abs(_center(x) - _center(y)) / scale)
        same = F.when((x["k"] != "") & (x["k"] == y["k"]), 0.75).otherwise(0.0)
        return F.round(F.greatest(_ratio(x, y), same, 0.55 * near), 9)

    side = lambda df, name, *more: df.select(key, *more, F.struct("n", "s", "e", "k").alias(name))
    met = interval_join(items, items, key, left_cols=("s", "e"), right_cols=("s", "e")).select(F.col(f"l.{key}").alias(key), "l", "r")
    met = met.select(key, *(F.struct(*(F.col(f"{x}.{c}").alias(c) for c in ("n", "s", "e", "k"))).alias(x) for x in ("l", "r")))
    middle = (F.col("s") + F.col("e")).alias("m")
    empty = side(items, "l", middle).join(side(items, "r", middle), [key, "m"]).where("l.s >= l.e or r.s >= r.e").drop("m")
    pairs = met.unionByName(empty)
    if scenes:
        pairs = pairs.unionByName(side(items, "l", "k").join(side(items.where("k <> ''"), "r", "k"), [key, "k"]).drop("k"))
    linked = pairs.where("r.n < l.n").select(key, F.col("l.n").alias("x"), F.col("r.n").alias("y"), relation(F.col("l"), F.col("r")).alias("rel")).where(F.col("rel") >= threshold)
    closest = F.max("rel").over(Window.partitionBy(key, "x"))
    up = once(linked.withColumn("_best", closest).where("rel = _best").select(key, "x", "y").distinct(), "event-links")
    while True:
        over = up.select(key, F.col("x").alias("y"), F.col("y").alias("z"))
        jumped = up.join(over, [key, "y"], "left")
        if jumped.where("z is not null").isEmpty():
            break
        up = once(jumped.select(key, "x", F.coalesce("z", "y").alias("y")).distinct(), "event-links")
    roots = up.groupBy(key, F.col("x").alias("n")).agg(F.min("y").alias("root"))
    member = F.struct("cost", F.abs((F.col("e") - F.col("s")) / second - 45.0).alias("off"), "s", "e", "id")
    found = items.join(roots, [key, "n"], "left").groupBy(key, F.coalesce("root", "n").alias("root")).agg(F.min(member).alias("r"), F.count("*").cast("int").alias("support"))
    events = found.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("root")) - 1).alias("place"), F.struct("r", "support").alias("x"))
    w = Window.partitionBy(key)
    norm = lambda c: F.when(F.max(c).over(w) > F.min(c).over(w), (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w))).otherwise(1.0)
    flat = events.select(key, (F.col("place") + 1).alias("place"), F.col("x.r.id").alias(id_col), (-F.col("x.r.cost")).alias("score"), F.col("x.support").alias("support"),
                         F.col("x.r.s").alias("start_ms"), F.col("x.r.e").alias("end_ms"))
    return flat.withColumns({"score_norm": norm("score"), "support_norm": norm("support")})


def _events(rows: DataFrame, key: str, id_col: str, **names) -> DataFrame:  # noqa: ANN003
    """(key, x, score_norm, support_norm, value, low, span, total): the events of a recording, ``x`` with their place, the range of their centres and their number."""
    found = cluster_events(rows, key=key, id_col=id_col, **names)
    value = 0.74 * F.col("score_norm") + 0.16 * F.col("support_norm") + 0.10 * F.greatest(F.lit(0.0), 1 - F.abs((F.col("end_ms") - F.col("start_ms")) / 1000.0 - 45.0) / 45.0)
    w, center = Window.partitionBy(key), (F.col("start_ms") + F.col("end_ms")) / 2.0
    item = F.struct("place", (-F.col("score")).alias("cost"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col(id_col).alias("id"))
    return found.select(key, item.alias("x"), "score_norm", "support_norm", F.round(value, 9).alias("value"), F.min(center).over(w).alias("low"),
                        F.greatest(F.lit(1000.0), F.max(center).over(w) - F.min(center).over(w)).alias("span"), F.count("*").over(w).alias("total"))


def _in_time(chosen: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, place, id) of the structs ``x``, in order of centres."""
    x = F.col("x")
    return chosen.select(key, F.row_number().over(Window.partitionBy(key).orderBy(_center(x), x["cost"], x["id"])).alias("place"), x["id"].alias(id_col))


def _whole(rows: DataFrame, key: str, id_col: str, score: str) -> DataFrame:
    return rows.select(key, F.struct((-F.col(score)).alias("cost"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col(id_col).alias("id")).alias("x"))


def _apart(steps: int) -> Column:
    """Distance to the nearest chosen row over an even step of the timeline, at most 1; 0 before the first is chosen."""
    return F.coalesce(F.least(F.lit(1.0), F.col("near") / (F.col("span") / float(max(2, steps - 1)))), F.lit(0.0))


def _worth(value: Column) -> Column:
    return F.struct((-F.round(value, 9)).alias("v"), F.col("x.place").alias("p"))


def adaptive_events(rows: DataFrame, k: int, key: str = "longform_id", id_col: str = "scene_id", score: str = "score") -> DataFrame:
    """(key, place, id): up to ``k`` events by .72 score, .22 distance to the chosen ones and .06 support, in order of time.

    An event overlaps no chosen one by more than .62 of the shorter; open places are filled by score. Recordings of ``k`` rows or fewer keep all of them.
    """
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    events = _events(counted.where(F.col("_n") > k).drop("_n"), key, id_col, score=score)
    value = 0.72 * F.col("score_norm") + 0.22 * _apart(k) + 0.06 * F.col("support_norm")
    state = in_rounds(events, key, [(F.lit(True), _worth(value))] * k, k, 0.62)
    chosen = filled(state, key, [F.col("x.cost"), F.col("x.place")], k)
    return _in_time(_whole(counted.where(F.col("_n") <= k), key, id_col, score), key, id_col).union(_in_time(chosen, key, id_col))


def coverage_bins(end_minutes: Column) -> Column:
    """5 bins for a quarter of an hour, two more for each five minutes begun beyond, 13 at most."""
    return F.when(end_minutes <= 15, 5).otherwise(F.least(F.lit(13), 5 + 2 * F.floor((end_minutes - 15.0 + 4.999) / 5.0))).cast("int")


def adaptive_coverage(rows: DataFrame, k: int, bins: int | None = None, per_bin: int = 1, key: str = "longform_id", id_col: str = "scene_id", score: str = "score") -> DataFrame:
    """(key, place, id): events spread over the bins of the timeline, in order of time.

    The intro (before 120 seconds or 8 % of the range) is left out if enough
    rows are beyond it. Each bin gives its best ``per_bin`` events that overlap no chosen one by over .58; then the best by .68 of the
    event's value and .32 of the distance to the chosen ones follow, then the rest by value. Without ``bins`` there are ``k``, or with
    more than one event a bin as many as the end of the recording's last row gives (see :func:`coverage_bins`).
    """
    by_length = bins is None and per_bin > 1
    w = Window.partitionBy(key)
    count = coverage_bins(F.max("end_ms").over(w) / 60_000.0) if by_length else F.lit(bins or k)
    center = (F.col("start_ms") + F.col("end_ms")) / 2.0
    sized = rows.withColumns({"_c": center, "_bins": count}).withColumn("_target", F.least(F.lit(k), F.col("_bins") * per_bin))
    placed = sized.withColumns({"_n": F.count("*").over(w), "_lo": F.min("_c").over(w), "_hi": F.max("_c").over(w)})
    late = F.col("_c") >= F.greatest(F.lit(120_000.0), F.col("_lo") + 0.08 * F.greatest(F.lit(1000.0), F.col("_hi") - F.col("_lo")))
    kept = placed.withColumn("_late", F.count_if(late).over(w)).where((F.col("_n") > F.col("_target")) & (late | (F.col("_late") < F.col("_target"))))
    few = _whole(placed.where(F.col("_n") <= F.col("_target")), key, id_col, score)
    events = _events(kept.select(*rows.columns), key, id_col, score=score)
    if by_length:
        events = events.join(rows.groupBy(key).agg(coverage_bins(F.max("end_ms") / 60_000.0).alias("bins")), key)
    else:
        events = events.withColumn("bins", F.lit(bins or k))
    target, most = F.least(F.lit(k), F.col("bins") * per_bin), 13 if by_length else bins or k
    part = F.least(F.col("bins") - 1, F.floor((_center(F.col("x")) - F.col("low")) * F.col("bins") / F.col("span")).cast("int"))
    steps = F.greatest(F.lit(2), F.col("bins") - 1)
    apart = F.coalesce(F.least(F.lit(1.0), F.col("near") / (F.col("span") / steps)), F.lit(0.0))
    value = 0.68 * F.col("value") + 0.32 * apart
    rounds = [(F.col("part") == b, _worth(F.col("value"))) for b in range(most) for _ in range(per_bin)] + [(F.lit(True), _worth(value))] * min(k, most * per_bin)
    state = in_rounds(events.withColumn("part", part), key, rounds, target, 0.58)
    chosen = filled(state, key, [F.desc("value"), F.col("x.place")], target)
    return _in_time(few, key, id_col).union(_in_time(chosen, key, id_col))


def timeline_diverse(rows: DataFrame, k: int, rank: str = "rank", score: str = "score", key: str = "longform_id", id_col: str = "scene_id") -> DataFrame:
    """(key, place, id): the best rank of each of ``k`` bins of the timeline, then others by rank, up to ``k``, in order of rank."""
    w = Window.partitionBy(key)
    center = (F.col("start_ms") + F.col("end_ms")) / 2.0
    placed = rows.withColumn("_c", center).withColumns({"_lo": F.min("_c").over(w), "_hi": F.max("_c").over(w)})
    part = F.least(F.lit(k - 1), F.floor((F.col("_c") - F.col("_lo")) * k / F.greatest(F.lit(1000.0), F.col("_hi") - F.col("_lo"))))
    first = F.row_number().over(Window.partitionBy(key, "_bin").orderBy(rank, F.desc(score), "start_ms", id_col)) == 1
    marked = placed.withColumn("_bin", part).withColumn("_first", first)
    kept = marked.withColumn("_n", F.row_number().over(w.orderBy(F.desc("_first"), rank, "start_ms", id_col))).where(F.col("_n") <= k)
    return kept.withColumn("place", F.row_number().over(w.orderBy(rank, "start_ms", id_col))).select(key, "place", id_col)


def timeline_score(rows: DataFrame, k: int, min_center_ms: float = 0.0, late_quota: bool = False, max_overlap: float = 0.45, rank: str = "rank", score: str = "score",
                   key: str = "longform_id", id_col: str = "scene_id") -> DataFrame:
    """(key, place, id): the best score of each of ``k`` bins, then others by score, without overlaps over ``max_overlap``, in order of time.

    Rows before ``min_center_ms`` are left out if ``k`` others are there. With
    ``late_quota`` that bound is the intro's end (120 seconds or 8 % of the range) and a place is kept for the last 18 % of the timeline.
    """
    w, x = Window.partitionBy(key), F.col("x")
    item = F.struct((-F.col(score)).alias("cost"), F.col(rank).alias("r"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col(id_col).alias("id"))
    placed = rows.select(key, item.alias("x")).withColumn("c", _center(x))
    low, high = F.min("c").over(w), F.max("c").over(w)
    bound = F.greatest(F.lit(120_000.0), low + 0.08 * (high - low)) if late_quota else F.lit(float(min_center_ms))
    kept = placed.withColumn("late", F.col("c") >= bound).withColumn("lates", F.count_if("late").over(w)).where(F.col("late") | (F.col("lates") < k))
    kept = kept.select(key, "x", "c", low.alias("low"), F.greatest(F.lit(1000.0), high - low).alias("span"), F.count("*").over(w).alias("total"))
    part = F.least(F.lit(k - 1), F.floor((F.col("c") - F.col("low")) * k / F.col("span")).cast("int"))
    rounds = [(F.col("c") >= F.col("low") + 0.82 * F.col("span"), x)] if late_quota and k > 1 else []
    rounds += [(F.col("part") == b, x) for b in range(k)] + [(F.lit(True), x)] * k
    state = in_rounds(kept.where(F.col("total") > k).withColumn("part", part), key, rounds, k, max_overlap)
    return _in_time(kept.where(F.col("total") <= k), key, id_col).union(_in_time(state.where("place is not null"), key, id_col))


def left_bridges(selected: DataFrame, candidates: DataFrame, reserve: int = 0, key: str = "longform_id", id_col: str = "candidate_id", tolerance_ms: int = 10) -> DataFrame:
    """(key, place, id): the selected items, each followed by the best candidate that has one more scene before the same ones and the same end.

    ``selected`` has (key, place, id), ``candidates`` also scene_ids, start_ms,
    end_ms and score. With ``reserve``, only so many bridges of a recording are added, in order of their sources.
    """
    full = selected.join(candidates, [key, id_col]).select(key, "place", F.col(id_col).alias("_source"), F.col("scene_ids").alias("_ids"), F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    longer = candidates.where(F.size("scene_ids") > 1).join(selected.select(key, id_col), [key, id_col], "left_anti").withColumn("_ids", F.expr("slice(scene_ids, 2, size(scene_ids) - 1)"))
    pairs = longer.join(full, [key, "_ids"]).where((F.abs(F.col("end_ms") - F.col("_e")) <= tolerance_ms) & (F.col("start_ms") < F.col("_s")))
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_source").orderBy(F.desc("score"), "start_ms", id_col))).where("_n = 1")
    single = best.withColumn("_n", F.row_number().over(Window.partitionBy(key, id_col).orderBy("place"))).where("_n = 1")
    if reserve > 0:
        single = single.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("place"))).where(F.col("_n") <= reserve)
    both = selected.select(key, "place", id_col, F.lit(0).alias("_bridge")).union(single.select(key, "place", id_col, F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("place", "_bridge"))).select(key, "place", id_col)


def select_by(rows: DataFrame, strategy: str, k: int, bins: int = 12, max_overlap: float = 0.72, diversity: float = 2.0, penalty: float = 1.5, key: str = "longform_id",
              id_col: str = "scene_id", score: str = "value") -> DataFrame:
    """(key, place, id): the selection by the named strategy: rank, overlap, bins or mmr."""
    if strategy == "bins":
        return bins_then_fill(rows, k, bins, max_overlap, key, id_col, score).drop("score")
    if strategy == "mmr":
        return relevance_and_diversity(rows, k, max_overlap, diversity, penalty, key, id_col, score).drop("score")
    if strategy == "overlap":
        return suppress_overlaps(rows, k, max_overlap, key, id_col, score).drop("score")
    if strategy == "rank":
        return top_k(rows, key, k, F.desc(score), "start_ms", id_col).select(key, "place", id_col)
    raise ValueError(f"unknown strategy {strategy}")


def slate(rows: DataFrame, speeches: DataFrame, k: int, select: Callable[[DataFrame, int], DataFrame], pad_ms: int = 20_000, order: Sequence[str] = ("rank", "start_ms"), key: str = "longform_id",
          id_col: str = "scene_id") -> DataFrame:
    """Numbered candidates with clock times, a context window and their evidence.

    Repeated intervals of a recording count once, the first in ``order``;
    ``select`` chooses (key, place, id) from the rest.
    """
    unique = rows.withColumn("_n", F.row_number().over(Window.partitionBy(interval_key(key, F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0)).orderBy(*order))).where("_n = 1").drop("_n")
    chosen = select(unique, k).join(unique.select(key, id_col, "start_ms", "end_ms"), [key, id_col])
    number = F.col("place").cast("string")
    named = chosen.withColumn("candidate_id", F.concat(F.col(key).cast("string"), F.lit("_cand_"), F.when(F.col("place") < 10, F.concat(F.lit("0"), number)).otherwise(number)))
    told = evidence(named.select("candidate_id", key, "start_ms", "end_ms"), speeches, key, pad_ms=pad_ms)
    clock = lambda c: seconds_to_clock(c / 1000.0)
    return named.join(told, "candidate_id").select(
        key, "candidate_id", "place", id_col, "start_ms", "end_ms", clock(F.col("start_ms")).alias("start_time"), clock(F.col("end_ms")).alias("end_time"),
        clock(F.greatest(F.lit(0), F.col("start_ms") - pad_ms)).alias("context_start_time"), clock(F.col("end_ms") + pad_ms).alias("context_end_time"), "before", "core", "after")


def trim_rerank(rows: DataFrame, speeches: DataFrame, k: int, max_overlap: float, bands: int, lexicons: Mapping[str, Mapping[str, float]], titles: Sequence[str], scripts: Sequence[tuple[str, str, int, float]] = (("ko", "\uac00-\ud7a3", 20, 0.25), ("en", "A-Za-z", 40, 0.0)),
                key: str = "longform_id", id_col: str = "scene_id", pad_ms: int = 0) -> DataFrame:
    """(key, place, id, score): trim windows reranked by what is said in them, the best of each band of source ranks first.

    A recording's language and genre come from the texts of its windows;
    repeated intervals count once. ``rows`` has rank, source_rank, window_rank and kind; ``lexicons`` weights for lecture, variety and filler.
    """
    unique = unique_candidates(rows, ["rank", "start_ms", id_col], key, "start_ms", "end_ms")
    named = unique.withColumn("candidate_id", F.concat_ws(":", key, id_col))
    told = evidence(named.select("candidate_id", key, "start_ms", "end_ms"), speeches, key, pad_ms=pad_ms, caps=(0, 6000, 0)).select("candidate_id", "core")
    texts = named.join(told, "candidate_id")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "start_ms", id_col, F.col("core").alias("_t")))), lambda x: x["_t"])
    about = texts.groupBy(key).agg(F.array_join(lines, "\n").alias("_all")).select(
        key, detect_language("_all", scripts, "other").alias("language"), genre("_all", lexicons["lecture"], lexicons["variety"]).alias("genre"))
    parts = trim_components("core", F.col("start_ms") / 1000.0, F.col("end_ms") / 1000.0, "kind", "source_rank", "rank", "window_rank", "genre", lexicons["lecture"], lexicons["variety"], lexicons["filler"], titles)
    scored = texts.join(about, key).withColumn("score", F.round(trim_score(parts, "language"), 9))
    return source_bands(scored, k, bands, max_overlap, "source_rank", key, id_col, "score")
