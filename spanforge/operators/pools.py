"""Evaluation pools, bundles of tables, evidence from captions, and score sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.intervals import hull_iou
from spanforge.functions.scores import region_weight
from spanforge.sources.shared import once

from .concordance import later_in_band
from .joins import evidence


def contiguous_candidates(edits: DataFrame, pool: str = "pool_id", candidate: str = "candidate_id", max_gap_ms: int = 1_000) -> DataFrame:
    """(pool, candidate, rank, start_ms, end_ms): candidates whose edits have no gap over ``max_gap_ms``, as one interval.

    A candidate with an empty edit is left out too.
    """
    w = Window.partitionBy(pool, candidate).orderBy("start_ms", "end_ms")
    gap = F.col("start_ms") - F.lag("end_ms").over(w)
    bad = (F.col("end_ms") <= F.col("start_ms")) | F.coalesce(gap > max_gap_ms, F.lit(False))
    marked = edits.withColumn("_bad", bad).groupBy(pool, candidate).agg(
        F.min("rank").alias("rank"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.bool_or("_bad").alias("_bad"))
    return marked.where("not _bad").drop("_bad")


def gold_pools(golds: DataFrame, edits: DataFrame, most: int = 8, least: int = 2, iou: float = 0.5, pool: str = "pool_id") -> tuple[DataFrame, DataFrame]:
    """Pools of up to ``most`` contiguous candidates by rank for each gold interval, and (pool, reason) of golds without one.

    Candidates with the IoU or more are as good as gold; where there is none, the gold interval itself is put in
    as a candidate without rank. Golds with an empty interval or with fewer than ``least`` candidates have no pool.
    """
    known = golds.select(pool, F.col("start_ms").alias("gold_start"), F.col("end_ms").alias("gold_end"))
    parsed = contiguous_candidates(edits, pool)
    top = parsed.withColumn("baseline_rank", F.row_number().over(Window.partitionBy(pool).orderBy("rank", "candidate_id"))).where(F.col("baseline_rank") <= most)
    sized = top.withColumn("_n", F.count("*").over(Window.partitionBy(pool)))
    joined = sized.join(known, pool).where((F.col("_n") >= least) & (F.col("gold_end") > F.col("gold_start")))
    scored = joined.withColumn("gold_iou", hull_iou("start_ms", "end_ms", "gold_start", "gold_end"))
    rows = scored.select(pool, F.col("candidate_id").cast("string").alias("candidate_id"), F.lit("auto").alias("role"), "baseline_rank", "start_ms", "end_ms", "gold_iou", (F.col("gold_iou") >= iou).alias("is_gold"))
    lacking = scored.groupBy(pool).agg(F.max("gold_iou").alias("_best"), F.first("gold_start").alias("start_ms"), F.first("gold_end").alias("end_ms")).where(F.col("_best") < iou)
    injected = lacking.select(pool, F.concat(F.lit("gold-"), F.col(pool).cast("string")), F.lit("injected_gold"), F.lit(None).cast("int"), "start_ms", "end_ms", F.lit(1.0), F.lit(True))
    counts = known.join(top.groupBy(pool).agg(F.count("*").alias("_n")), pool, "left").fillna(0, ["_n"])
    reason = F.when(~F.coalesce(F.col("gold_end") > F.col("gold_start"), F.lit(False)), "empty_gold_interval").when(
        F.col("_n") < least, F.concat(F.lit("insufficient_contiguous_candidates:"), F.col("_n").cast("string")))
    return rows.union(injected), counts.withColumn("reason", reason).where("reason is not null").select(pool, "reason")


def gold_sources(golds: DataFrame, id_col: str, labels: Sequence[str], key: str = "longform_id") -> DataFrame:
    """Gold intervals as rows of a source named gold, of rank 1, with their labels."""
    return golds.select(F.col(id_col), key, F.lit("gold").alias("source_system"), F.lit(1).alias("source_rank"), "start_ms", "end_ms", *labels)


def caption_evidence(candidates: DataFrame, own: DataFrame, captions: DataFrame, prefer_own: bool = True, key: str = "longform_id", id_col: str = "candidate_id", pad_ms: int = 20_000) -> DataFrame:
    """Evidence of candidates from captions: before, core and after, content duration, and where the core comes from.

    ``own`` has a candidate's own cues (id, start_ms, end_ms, text), which are
    its core if there are any and ``prefer_own`` is set; else the core are the recording's ``captions`` in the interval.
    """
    told = evidence(candidates, captions, key, id_col, pad_ms, caps=(2500, 5000, 2500))
    line = F.struct("start_ms", "end_ms", "text")
    mine = own.groupBy(id_col).agg(
        F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "\n"), 1, 5000).alias("_own"), F.max("end_ms").alias("_own_ms"))
    joined = candidates.select(id_col, (F.col("end_ms") - F.col("start_ms")).alias("_ms")).join(told, id_col).join(mine, id_col, "left")
    uses = F.col("_own").isNotNull() & F.lit(prefer_own)
    return joined.select(
        id_col, "before", F.when(uses, F.col("_own")).otherwise(F.col("core")).alias("core"), "after", F.when(uses, F.col("_own_ms")).otherwise(F.col("_ms")).alias("content_ms"),
        F.when(uses, "own_captions_with_long_context").otherwise("long_captions_interval").alias("evidence_source"), F.when(uses, "own").otherwise("longform").alias("scope"))


def resolve_evidence(scene_based: DataFrame, captions: DataFrame, mode: str, id_col: str = "candidate_id") -> DataFrame:
    """The evidence of each candidate by mode: scenes, captions, prefer_captions or prefer_scenes (the other where the first has no text).

    Both tables have (id, description, core, provider).
    """
    if mode not in ("scenes", "captions", "prefer_captions", "prefer_scenes"):
        raise ValueError(f"unknown mode {mode}")
    fields = ("description", "core", "provider")
    a = scene_based.select(id_col, F.struct(*fields).alias("_s"))
    b = captions.select(id_col, F.struct(*fields).alias("_c"))
    has = lambda c: (F.coalesce(F.col(f"{c}.description"), F.lit("")) != "") | (F.coalesce(F.col(f"{c}.core"), F.lit("")) != "")
    both = a.join(b, id_col, "full_outer")
    use_scenes = {"scenes": F.lit(True), "captions": F.lit(False), "prefer_captions": ~F.coalesce(has("_c"), F.lit(False)), "prefer_scenes": F.coalesce(has("_s"), F.lit(False))}[mode]
    out = both.select(id_col, F.when(use_scenes, F.col("_s")).otherwise(F.col("_c")).alias("_x")).select(id_col, "_x.*")
    return out.withColumn("available", (F.coalesce("description", F.lit("")) != "") | (F.coalesce("core", F.lit("")) != ""))


def require_uniform(rows: DataFrame, column: str, expected: str | None = None) -> DataFrame:
    """``rows``; more than one value of the column (or another one than expected, or none) is an error when a row is read."""
    w = Window.partitionBy()
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    low, high = F.min(text).over(w), F.max(text).over(w)
    good = (low == high) & (low != "") & (F.lit(True) if expected is None else low == F.lit(expected))
    bad = F.raise_error(F.concat(F.lit(f"{column} isn't uniform: "), low, F.lit(", "), high)).cast("boolean")
    return rows.withColumn("_good", F.when(good, True).otherwise(bad)).where("_good").drop("_good")


def join_bundle(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """The tables joined one to one on the key; an id that one of them lacks or has twice is an error when its row is read."""
    joined: DataFrame | None = None
    counts = []
    for name, table in tables.items():
        n = F.count("*").over(Window.partitionBy(key))
        marked = table.withColumn(f"_n_{name}", n)
        counts.append(f"_n_{name}")
        joined = marked if joined is None else joined.join(marked, key, "full_outer")
    ok = F.lit(True)
    for c in counts:
        ok = ok & F.coalesce(F.col(c) == 1, F.lit(False))
    bad = F.raise_error(F.concat(F.lit(f"{key} isn't in every table once: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return joined.where(F.when(ok, True).otherwise(bad)).drop(*counts)


def lookup_by_two_keys(rows: DataFrame, table: DataFrame, first: str, second: str, columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``columns`` of the table by the first key, else by the second, and which of them it was; the least values of a repeated key count."""
    by = lambda k, p: table.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(F.struct(*columns)).alias(p))
    found = rows.join(by(first, "_one"), first, "left").join(by(second, "_two"), second, "left")
    pick = F.coalesce("_one", "_two")
    return found.select(*rows.columns, *(pick[c].alias(c) for c in columns), F.when(F.col("_one").isNotNull(), first).when(F.col("_two").isNotNull(), second).alias("matched_by"))


def cross_group_pairs(rows: DataFrame, same: DataFrame, group: str, id_col: str, value: str, min_gap: float, max_gap: float, share: float) -> DataFrame:
    """Pairs of rows of different groups, ``min_gap`` to ``max_gap`` apart, weighted by region and scaled to ``share`` of the weight of ``same``.

    ``same`` has the weights of the pairs within groups; if it has none, pairs keep their own weights. Values are dealt to bins of the upper
    gap, so a row meets its own bin and its neighbours alone. Columns: a_id, b_id, gap, weight.
    """
    slot = F.floor(F.col(value) / max_gap)
    a = rows.select(F.col(id_col).alias("a_id"), F.col(group).alias("a_group"), F.col(value).alias("a_value"), slot.alias("slot"))
    b = rows.select(F.col(id_col).alias("b_id"), F.col(group).alias("b_group"), F.col(value).alias("b_value"), F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"))
    pairs = a.join(b, "slot").where("a_id < b_id and a_group <> b_group").withColumn("gap", F.abs(F.col("a_value") - F.col("b_value"))).where(
        (F.col("gap") >= min_gap) & (F.col("gap") <= max_gap)).withColumn("_w", region_weight("a_value", "b_value", "gap"))
    own, other = pairs.agg(F.sum("_w").alias("_cross")), same.agg(F.sum("weight").alias("_same"))
    scale = F.when((F.col("_same") > 0) & (F.col("_cross") > 0), share * F.col("_same") / F.col("_cross")).otherwise(1.0)
    return pairs.join(F.broadcast(own)).join(F.broadcast(other)).select("a_id", "b_id", "gap", (F.col("_w") * scale).alias("weight"))


def cross_group_counts(rows: DataFrame, group: str, id_col: str, value: str, min_gap: float, max_gap: float, share: float) -> DataFrame:
    """(a_id, pairs, weight): for each row that has any, the number and the weight of its pairs of :func:`cross_group_pairs` with rows of larger ids, without listing them.

    Each pair counts the same: all of them have ``share`` of the weight of the pairs within groups, or 1 each if there are none.
    """
    counts = once(later_in_band(rows, group, id_col, value, min_gap, max_gap), "counts")
    sums = counts.agg(F.sum("own").alias("_same"), F.sum("other").alias("_cross"))
    scale = F.when(F.col("_same") > 0, share * F.col("_same") / F.col("_cross")).otherwise(1.0)
    return counts.where("other > 0").join(F.broadcast(sums)).select(F.col(id_col).alias("a_id"), F.col("other").alias("pairs"), (F.col("other") * scale).alias("weight"))


def compile_sheet(sheet: DataFrame, reasons: DataFrame, id_col: str, dimensions: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """(id, judgment, score, complete): a wide sheet of whole scores from 0 to 4 as a map of dimension to (score, reason), and its rubric score.

    ``reasons`` gives (dimension, score, reason). A score that is missing or out of range, or has no
    reason, makes the sheet's row incomplete, without a rubric score.
    """
    long = sheet.select(id_col, F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("int").alias("score")) for d in dimensions))).alias("x")).select(id_col, "x.*")
    told = long.join(F.broadcast(reasons.select("dimension", "score", "reason")), ["dimension", "score"], "left")
    good = F.col("score").between(0, 4) & F.col("reason").isNotNull()
    weight: Column = F.lit(0.0)
    for d, w in weights.items():
        weight = F.when(F.col("dimension") == d, F.lit(float(w))).otherwise(weight)
    out = told.groupBy(id_col).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", F.struct("score", "reason").alias("v"))))).alias("judgment"),
        F.bool_and(F.coalesce(good, F.lit(False))).alias("complete"), F.sum(weight * F.col("score")).alias("_s"))
    return out.select(id_col, "judgment", F.when(F.col("complete"), F.round(25 * F.col("_s"), 4)).alias("score"), "complete")


def version_rows(judged: DataFrame, versions: Mapping[str, Mapping[str, Column]], id_col: str) -> DataFrame:
    """One row per version of each judged row: (id, version, and the union of the versions' fields, null where a version lacks one)."""
    names = sorted({n for fields in versions.values() for n in fields})
    part = lambda v, fields: F.struct(F.lit(v).alias("version"), *(fields[n].cast("double").alias(n) if n in fields else F.lit(None).cast("double").alias(n) for n in names))
    return judged.select(id_col, F.inline(F.array(*(part(v, f) for v, f in versions.items()))))
