"""Interval joins and the joins of predictions, scores and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.intervals import overlap, prediction_scores
from spanforge.sources.shared import once


#: Widths of the bins of interval joins: powers of 2 ** BITS milliseconds.
BITS = 3


def _width(c: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), BITS * c)


def length_class(start: Column, end: Column) -> Column:
    """The least n so that (2 ** BITS) ** n is the interval's length or more: it touches two bins of that width at most, as does any shorter one."""
    length = F.greatest(end - start, F.lit(1)).cast("long")
    near = F.greatest(F.lit(0), F.ceil(F.log2(length) / BITS).cast("int"))
    # what rounding puts on the other side of a power
    return F.when(_width(near) < length, near + 1).when((near > 0) & (_width(near - 1) >= length), near - 1).otherwise(near)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_cols: tuple[str, str] = ("start_ms", "end_ms"),
                  right_cols: tuple[str, str] = ("start_ms", "end_ms"), how: str = "inner") -> DataFrame:
    """Pairs of rows of one ``key`` whose half-open intervals overlap: structs ``l`` and ``r``.

    Intervals are classed by length, a power of eight. A pair meets in a bin as wide as the class of its longer interval, in the one that holds its later start, and so comes
    once. A row goes to the at most two bins that it touches in its own class, and in each longer class that the other table has (up to 21;
    those that there are reach the driver). So an interval of a week costs no more rows than one of a second, a recording of any length is dealt to
    many bins, and the join is on (key, class, bin), which adaptive execution can split where a bin is hot.

    ``how`` is inner, left_semi or left_anti
    (columns of ``left`` for the last two; rows must have no null bounds to match). Empty intervals overlap nothing.
    """
    def classed(df: DataFrame, cols: tuple[str, str], name: str) -> DataFrame:
        s, e = F.col(cols[0]).cast("long"), F.col(cols[1]).cast("long")
        return df.where(s < e).select(F.struct(*df.columns).alias(name), F.col(key).alias(key), F.col(cols[0]).alias(f"{name}s"), F.col(cols[1]).alias(f"{name}e"), length_class(s, e).alias(f"{name}c"))

    ours, theirs = classed(left, left_cols, "l"), classed(right, right_cols, "r")
    there = ours.select(F.lit("l"), "lc").union(theirs.select(F.lit("r"), "rc")).distinct().collect()
    levels = {n: sorted(c for side, c in there if side == n) for n in ("l", "r")}

    def binned(df: DataFrame, name: str, others: list[int]) -> DataFrame:
        own = F.col(f"{name}c")
        dealt = df.withColumn("class", F.explode(F.array(own, *(F.when(own < x, x) for x in others)))).where("class is not null")
        w = _width(F.col("class"))
        first, last = F.floor(F.col(f"{name}s") / w), F.floor((F.col(f"{name}e") - 1) / w)
        return dealt.withColumn("bin", F.explode(F.array(first, F.when(last > first, last)))).where("bin is not null")

    hit = (F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")) & (F.col("class") == F.greatest("lc", "rc"))
    first = F.col("bin") == F.floor(F.greatest("ls", "rs") / _width(F.col("class")))
    pairs = binned(ours, "l", levels["r"]).join(binned(theirs, "r", levels["l"]), [key, "class", "bin"]).where(hit & first)
    if how == "inner":
        return pairs.select("l", "r")
    met = pairs.select("l.*").distinct()
    return left.join(met, [left[c].eqNullSafe(met[c]) for c in left.columns], how)


def evidence(candidates: DataFrame, speeches: DataFrame, key: str = "longform_id", id_col: str = "candidate_id", pad_ms: int = 20_000,
             caps: tuple[int, int, int] = (1800, 5000, 2500)) -> DataFrame:
    """Texts spoken before, in and after each candidate, in order of time, each cut to its cap.

    A speech of the core overlaps the candidate; one of the context overlaps the
    pad on that side (the one before starts at 0 at the earliest). Equal speeches count once.
    """
    s, e = F.col("start_ms"), F.col("end_ms")
    wide = candidates.withColumns({"pad_start": F.greatest(F.lit(0), s - pad_ms), "pad_end": e + pad_ms})
    pairs = interval_join(wide, speeches, key, left_cols=("pad_start", "pad_end"))
    met = lambda a, b: overlap(a, b, "r.start_ms", "r.end_ms") > 0
    sides = {"before": met("l.pad_start", "l.start_ms"), "core": met("l.start_ms", "l.end_ms"), "after": met("l.end_ms", "l.pad_end")}
    side = F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in sides.items()))))
    told = pairs.select(F.col(f"l.{id_col}").alias(id_col), "r.start_ms", "r.end_ms", "r.speech_id", "r.text", side.alias("_side")).distinct()
    # what starts beyond the cap isn't gathered; the line end before what starts at it is the last character within
    earlier = Window.partitionBy(id_col, "_side").orderBy("start_ms", "end_ms", "speech_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    length = F.when(F.col("text").isNull(), 0).otherwise(F.char_length("text") + 1)
    cap = F.coalesce(*(F.when(F.col("_side") == n, c) for n, c in zip(sides, caps)))
    short = told.withColumn("_upto", F.coalesce(F.sum(length).over(earlier), F.lit(0))).where(F.col("_upto") <= cap)
    said = F.struct("start_ms", "end_ms", "speech_id", "text")
    joined = lambda n: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_side") == n, said))), lambda x: x.text), "\n").alias(n)
    grouped = short.groupBy(id_col).agg(*(joined(n) for n in sides))
    text = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    return candidates.select(id_col).join(grouped, id_col, "left").select(id_col, *(text(c, n) for c, n in zip(sides, caps)))


def overlapping_scenes(candidates: DataFrame, scenes: DataFrame, key: str = "longform_id", id_col: str = "candidate_id") -> DataFrame:
    """(id, scene_ids): ids of the scenes that overlap each candidate, in order of time; empty where there are none."""
    pairs = interval_join(candidates, scenes, key)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r.start_ms", "r.end_ms", "r.scene_id"))), lambda x: x.scene_id)
    found = pairs.groupBy(F.col(f"l.{id_col}").alias(id_col)).agg(ordered.alias("scene_ids"))
    none = F.array().cast(found.schema["scene_ids"].dataType)
    return candidates.select(id_col).join(found, id_col, "left").withColumn("scene_ids", F.coalesce("scene_ids", none))


def nearest_boundaries(candidates: DataFrame, scenes: DataFrame, key: str = "longform_id", id_col: str = "candidate_id") -> DataFrame:
    """Distance of each candidate's start and end to the nearest scene boundary of its recording.

    An as-of join both ways: boundaries and points are put in one order of time
    per recording, and the last boundary before and the first after are carried along.
    """
    marks = scenes.select(key, F.explode(F.array("start_ms", "end_ms")).alias("at")).distinct()
    points = candidates.select(key, id_col, F.explode(F.array(
        F.struct(F.lit("start").alias("side"), F.col("start_ms").alias("at")), F.struct(F.lit("end").alias("side"), F.col("end_ms").alias("at")))).alias("p"))
    rows = points.select(key, id_col, "p.side", "p.at", F.lit(None).cast("long").alias("mark")).unionByName(
        marks.select(key, F.lit(None).cast(candidates.schema[id_col].dataType).alias(id_col), F.lit(None).cast("string").alias("side"), "at", F.col("at").alias("mark")))
    by = Window.partitionBy(key).orderBy("at")
    before = F.last("mark", ignorenulls=True).over(by.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("mark", ignorenulls=True).over(by.rangeBetween(0, Window.unboundedFollowing))
    gaps = rows.withColumn("gap", F.least(F.col("at") - before, after - F.col("at"))).where(F.col("side").isNotNull())
    return gaps.groupBy(id_col).agg(
        F.max(F.when(F.col("side") == "start", F.col("gap"))).alias("start_gap_ms"), F.max(F.when(F.col("side") == "end", F.col("gap"))).alias("end_gap_ms"))


def away_from(windows: DataFrame, known: DataFrame, key: str = "longform_id", guard_ms: int = 0) -> DataFrame:
    """The windows that overlap no known interval widened by ``guard_ms``, its start at 0 at the earliest.

    Ends of windows and starts of known intervals are put in one order of time
    per recording: a window overlaps one of those that start before its end if the latest end among them is
    beyond its start. So there is one shuffle, and no pairs are made. Windows without a key or bounds, and empty ones, overlap nothing.
    """
    wide = known.select(key, F.greatest(F.lit(0), F.col("start_ms") - guard_ms).alias("_s"), (F.col("end_ms") + guard_ms).alias("_e")).where("_s < _e")
    row = F.struct(*windows.columns)
    ours = windows.select(F.col(key), row.alias("_row"), F.col("end_ms").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_end"))
    theirs = wide.select(F.col(key), F.lit(None).cast(ours.schema["_row"].dataType).alias("_row"), F.col("_s").alias("_at"), F.lit(1).alias("_kind"), F.col("_e").cast("long").alias("_end"))
    reach = F.max("_end").over(Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    placed = ours.union(theirs).withColumn("_reach", reach).where("_kind = 0")
    hit = F.col(key).isNotNull() & (F.col("_reach") > F.col("_row.start_ms")) & (F.col("_row.start_ms") < F.col("_row.end_ms"))
    return placed.where(~F.coalesce(hit, F.lit(False))).select("_row.*")


def score_against_gold(predictions: DataFrame, gold: DataFrame, key: str = "longform_id", unit: float = 1000.0, overlapping: bool = False) -> DataFrame:
    """Each prediction with each gold interval of its recording, or those alone that it overlaps, and the measures of the pair.

    Columns: the key, scene_id (of the prediction), rank, gold_id and those of :func:`prediction_scores`.
    """
    if overlapping:
        pairs = interval_join(predictions.select(key, "scene_id", "rank", "start_ms", "end_ms"), gold.select(key, "scene_id", "start_ms", "end_ms"), key)
        met = prediction_scores("l.start_ms", "l.end_ms", "r.start_ms", "r.end_ms", unit)
        return pairs.select(F.col(f"l.{key}").alias(key), "l.scene_id", "l.rank", F.col("r.scene_id").alias("gold_id"), *(c.alias(n) for n, c in met.items()))
    g = gold.select(key, F.col("scene_id").alias("gold_id"), F.col("start_ms").alias("gold_start"), F.col("end_ms").alias("gold_end"))
    measures = prediction_scores("start_ms", "end_ms", "gold_start", "gold_end", unit)
    return predictions.join(g, key).select(key, "scene_id", "rank", "gold_id", *(c.alias(n) for n, c in measures.items()))


def require_known(predictions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """``predictions``; a key that ``gold`` doesn't have is an error when the row is read."""
    known = gold.select(F.col(key), F.lit(True).alias("_known")).distinct()
    bad = F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return predictions.join(known, key, "left").where(F.when(F.col("_known"), True).otherwise(bad.cast("boolean"))).drop("_known")


def attach_scores(targets: DataFrame, scores: DataFrame, id_col: str = "candidate_id", score_col: str = "score") -> DataFrame:
    """``targets`` with the mean score over repeats and a status: scored, abstained (only nulls) or missing."""
    means = scores.groupBy(id_col).agg(F.avg(score_col).alias("mean_score"), F.count(score_col).alias("scored"), F.count("*").alias("repeats"))
    status = F.when(F.col("repeats").isNull(), "missing").when(F.col("scored") == 0, "abstained").otherwise("scored")
    return targets.join(means, id_col, "left").withColumn("status", status).drop("scored", "repeats")


def group_pairs(rows: DataFrame, group: str, id_col: str, value: str, min_gap: float, max_gap: float | None = None) -> DataFrame:
    """Pairs of one group with ids in order and values ``min_gap`` to ``max_gap`` apart: structs ``a`` and ``b``, and ``gap``.

    With an upper gap, values are dealt to bins of its width and a row meets only
    its own bin and the next, so a banded measure doesn't make all pairs of a group.
    """
    width = max_gap if max_gap else None
    slot = F.floor(F.col(value) / width) if width else F.lit(0)
    a = rows.select(F.col(group), F.struct(*rows.columns).alias("a"), slot.alias("slot"))
    near = F.explode(F.array(slot - 1, slot, slot + 1)) if width else slot
    b = rows.select(F.col(group), F.struct(*rows.columns).alias("b"), near.alias("slot"))
    gap = F.abs(F.col(f"a.{value}") - F.col(f"b.{value}"))
    kept = a.join(b, [group, "slot"]).where(F.col(f"a.{id_col}") < F.col(f"b.{id_col}")).withColumn("gap", gap).where(F.col("gap") >= min_gap)
    return (kept.where(F.col("gap") <= max_gap) if max_gap else kept).select(group, "a", "b", "gap")


def compare_score_sets(left: DataFrame, right: DataFrame, id_col: str, score: str, top: int = 10) -> DataFrame:
    """One row: Spearman correlation of two score sets on common ids, overlap and Jaccard index of their top ``top``, mean rank gap.

    The common ids are written once; of each side's order only the first ``top`` rows, a small number, are taken.
    """
    from .order import average_ranks
    from .ranks import pearson

    both = left.select(id_col, F.col(score).alias("x")).join(right.select(id_col, F.col(score).alias("y")), id_col).where("x is not null and y is not null")
    both = once(both, "compared")
    placed = average_ranks(both, {"rx": "x", "ry": "y"}).agg(F.count("*").alias("n"), pearson("rx", "ry").alias("spearman"), F.avg(F.abs(F.col("rx") - F.col("ry"))).alias("mean_rank_gap"))
    first = lambda c: both.orderBy(F.desc(c), id_col).limit(top).withColumn("side", F.lit(c))
    side = lambda c: F.count_if(F.col("side") == c)
    common, either = F.sum(F.least("_x", "_y")), F.sum(F.greatest("_x", "_y"))
    tops = first("x").union(first("y")).groupBy(id_col, "x", "y").agg(side("x").alias("_x"), side("y").alias("_y")).agg(
        F.coalesce(common, F.lit(0)).alias("top_overlap"), (common / F.nullif(either, F.lit(0))).alias("top_jaccard"))
    return placed.join(F.broadcast(tops)).select("n", "spearman", "top_overlap", "top_jaccard", "mean_rank_gap")


def union_length(intervals: DataFrame, keys: list[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """(keys, union_ms): total length of the union of each group's intervals; touching ones merge, empty ones count nothing."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = intervals.where(F.col(end) > F.col(start)).withColumn("fresh", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn(
        "island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg((F.max(end) - F.min(start)).alias("length")).groupBy(*keys).agg(F.sum("length").alias("union_ms"))
