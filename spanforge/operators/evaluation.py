"""Summaries of runs against gold intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hit_summary(scored: DataFrame, pair: Sequence[str], ks: Sequence[int] = (3, 5)) -> DataFrame:
    """One row per run of hit rates and mean best IoU, each over the pairs that have a row within k.

    ``scored`` has the measures of pairs of a prediction and a gold interval, and
    rank. Top-1 figures are means over rows of rank 1 (over all rows where there is none).
    """
    by_pair = scored.groupBy(*pair).agg(
        F.count("*").alias("rows"),
        *(F.max(F.when(F.col("rank") <= k, F.col(c).cast("double"))).alias(f"{n}_{k}") for k in ks for c, n in (("core_hit", "core"), ("tight_hit", "tight"), ("temporal_iou", "iou"))),
        F.sum(F.when(F.col("rank") == 1, F.col("core_hit").cast("double"))).alias("first_core"), F.count_if(F.col("rank") == 1).alias("firsts"),
        F.sum(F.when(F.col("rank") == 1, F.col("temporal_iou"))).alias("first_iou"),
        F.sum(F.col("core_hit").cast("double")).alias("all_core"), F.sum("temporal_iou").alias("all_iou"))
    firsts = F.sum("firsts")
    top = lambda a, b: F.when(firsts > 0, F.sum(a) / firsts).otherwise(F.sum(b) / F.sum("rows"))
    return by_pair.agg(
        F.count("*").alias("pairs"), F.sum("rows").alias("predictions"), top("first_core", "all_core").alias("core_at_1"), top("first_iou", "all_iou").alias("iou_at_1"),
        *(F.avg(f"{n}_{k}").alias(f"{n}_at_{k}") for k in ks for n in ("core", "tight", "iou")))


def recall_table(scored: DataFrame, gold: DataFrame, pair: Sequence[str], ks: Sequence[int] = (1, 3, 5, 10, 12, 20, 30, 50, 60, 120)) -> DataFrame:
    """A row per k: core and tight recall and mean best IoU over all gold pairs, 0 for pairs without a row within k."""
    best = scored.groupBy(*pair).agg(
        *(F.max(F.when(F.col("rank") <= k, F.col(c).cast("double"))).alias(f"{n}_{k}") for k in ks for c, n in (("core_hit", "core"), ("tight_hit", "tight"), ("temporal_iou", "iou"))))
    joined = gold.select(*pair).distinct().join(best, list(pair), "left").fillna(0.0)
    row = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"{n}_{k}").alias(n) for n in ("core", "tight", "iou"))) for k in ks)))
    return joined.select(row.alias("x")).groupBy("x.k").agg(
        F.count("*").alias("pairs"), F.avg("x.core").alias("core_recall"), F.avg("x.tight").alias("tight_recall"), F.avg("x.iou").alias("mean_best_iou"))


def repeat_summary(scores: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """Per candidate: repeats, scored repeats, mean and population deviation of each field, and whether it was scored."""
    aggs = [x for f in fields for x in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std"))]
    out = scores.groupBy(id_col).agg(F.count("*").alias("repeats"), F.count(fields[0]).alias("scored"), *aggs)
    return out.withColumn("status", F.when(F.col("scored") > 0, "scored").otherwise("abstained"))


def repeat_reliability(scores: DataFrame, id_col: str, repeat: str, score: str) -> DataFrame:
    """A row per two repeats: common candidates, Spearman correlation and mean absolute difference."""
    from .ranks import average_rank, pearson

    known = scores.where(F.col(score).isNotNull()).select(id_col, repeat, score)
    a, b = (known.select(id_col, F.col(repeat).alias(f"{x}_repeat"), F.col(score).alias(f"{x}_score")) for x in ("a", "b"))
    pairs = a.join(b, id_col).where("a_repeat < b_repeat")
    keys = ["a_repeat", "b_repeat"]
    ranked = pairs.withColumns({"ra": average_rank("a_score", keys), "rb": average_rank("b_score", keys)})
    return ranked.groupBy(*keys).agg(F.count("*").alias("common"), pearson("ra", "rb").alias("spearman"), F.avg(F.abs(F.col("a_score") - F.col("b_score"))).alias("mae"))


def pool_summary(pool_rows: DataFrame, bucket: str, metrics: Sequence[str]) -> DataFrame:
    """Means of the metrics for each bucket and over all (null bucket)."""
    return pool_rows.rollup(bucket).agg(F.count("*").alias("pools"), *(F.avg(m).alias(m) for m in metrics))


def score_audit(scores: DataFrame, score: str) -> DataFrame:
    """One row: scored and abstained rows, distinct scores, size of the largest tie and the mean."""
    ties = scores.groupBy(score).agg(F.count("*").alias("n"))
    known = F.col(score).isNotNull()
    return ties.agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("scored"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("abstained"),
        F.count_if(known).alias("distinct_scores"), F.max(F.when(known, F.col("n"))).alias("largest_tie"),
        (F.sum(F.when(known, F.col(score) * F.col("n"))) / F.sum(F.when(known, F.col("n")))).alias("mean_score"))


def ranked_dedupe(predictions: DataFrame, keys: Sequence[str], start: str, end: str, ordinal: str, rank: str = "rank") -> DataFrame:
    """Predictions without repeats of a rounded interval in their group, renumbered 1 to n in order of (rank, ordinal)."""
    w = Window.partitionBy(*keys)
    same = Window.partitionBy(*keys, F.bround(F.col(start), 3), F.bround(F.col(end), 3)).orderBy(rank, ordinal)
    first = predictions.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return first.withColumn("new_rank", F.row_number().over(w.orderBy(rank, ordinal)))


def dedupe_audit(predictions: DataFrame, keys: Sequence[str], start: str, end: str, ordinal: str, rank: str = "rank", top: int = 5) -> DataFrame:
    """Per group: rows, rows removed by :func:`ranked_dedupe`, distinct intervals in the original top, and whether less than ``top`` are left."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, ordinal))
    span = F.struct(F.bround(F.col(start), 3).alias("s"), F.bround(F.col(end), 3).alias("e"))
    out = predictions.withColumns({"_p": place, "_i": span}).groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_distinct("_i").alias("unique_rows"), F.count_distinct(F.when(F.col("_p") <= top, F.col("_i"))).alias("top_unique"))
    return out.withColumns({"removed": F.col("rows") - F.col("unique_rows"), "underfilled": F.col("unique_rows") < top})
