"""Tie-aware ranks, agreement metrics and hit rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import average_ranks, dense_numbers, steps_below


def average_rank(value: str, groups: Sequence[str] = ()) -> Column:
    """1-based rank in which ties share the mean of their places."""
    return F.rank().over(Window.partitionBy(*groups).orderBy(value)) + (F.count("*").over(Window.partitionBy(*groups, value)) - 1) / 2.0


def rank_percentile(value: str, groups: Sequence[str] = ()) -> Column:
    """0 to 100 by average rank; a group of one row has 50."""
    n = F.count("*").over(Window.partitionBy(*groups))
    return F.when(n > 1, (average_rank(value, groups) - 1) / (n - 1) * 100).otherwise(50.0)


def centered(value: str, groups: Sequence[str], decimals: int = 12) -> Column:
    """Value less its group's mean, rounded so that equal ones stay equal under later ranks."""
    return F.round(F.col(value) - F.avg(value).over(Window.partitionBy(*groups)), decimals)


def min_max(value: str, groups: Sequence[str]) -> Column:
    """0 to 1 within the group; 1 for all where it is flat."""
    w = Window.partitionBy(*groups)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(1.0)


def pearson(x: str | Column, y: str | Column, min_rows: int = 2) -> Column:
    """Correlation as an aggregate; null for fewer rows than ``min_rows`` or a flat side."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    flat = (F.stddev_pop(a) <= 1e-12) | (F.stddev_pop(b) <= 1e-12)
    return F.when((F.count_if(both) >= min_rows) & ~flat, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def spearman(rows: DataFrame, x: str, y: str, groups: Sequence[str] = (), min_rows: int = 2) -> DataFrame:
    """(groups, n, spearman): correlation of average ranks within each group."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = known.withColumns({"_rx": average_rank(x, groups), "_ry": average_rank(y, groups)}) if groups else average_ranks(known, {"_rx": x, "_ry": y})
    return ranked.groupBy(*groups).agg(F.count("*").alias("n"), pearson("_rx", "_ry", min_rows).alias("spearman"))


def macro_spearman(rows: DataFrame, x: str, y: str, group: str, min_rows: int = 2) -> DataFrame:
    """One row: the mean of the groups' correlations that are defined, and their number."""
    return spearman(rows, x, y, [group], min_rows).agg(F.avg("spearman").alias("macro_spearman"), F.count("spearman").alias("groups"))


def roc_auc(rows: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, positives, negatives, auc): chance that a positive outscores a negative, ties half; null for one class only."""
    known = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    ranked = known.withColumn("_r", average_rank(score, groups)) if groups else average_ranks(known, {"_r": score})
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    ranks = F.sum(F.when(F.col(label) == 1, F.col("_r")))
    out = ranked.groupBy(*groups).agg(pos.alias("positives"), neg.alias("negatives"), ranks.alias("_ranks"))
    p, n = F.col("positives").cast("double"), F.col("negatives")
    return out.withColumn("auc", F.when((p > 0) & (n > 0), (F.col("_ranks") - p * (p + 1) / 2) / (p * n))).drop("_ranks")


def weighted_kappa(rows: DataFrame, actual: str, predicted: str, classes: int = 3) -> DataFrame:
    """One row: quadratic weighted kappa of whole classes 0 to classes - 1; null where no disagreement is possible.

    Expected disagreement needs only sums and sums of squares of both sides, so there is no table of all class pairs.
    """
    a, b = F.col(actual).cast("double"), F.col(predicted).cast("double")
    known = rows.where(a.isNotNull() & b.isNotNull())
    scale = float((classes - 1) ** 2)
    observed = F.sum((a - b) * (a - b)) / scale
    expected = (F.sum(a * a) + F.sum(b * b) - 2 * F.sum(a) * F.sum(b) / F.nullif(F.count("*"), F.lit(0))) / scale
    return known.agg(F.count("*").alias("n"), observed.alias("_o"), expected.alias("_e")).select(
        "n", F.when(F.col("_e") > 0, 1 - F.col("_o") / F.col("_e")).alias("kappa"))


def pair_accuracy(pairs: DataFrame, target: str, score: str) -> DataFrame:
    """One row: share of pairs (structs a, b) in the same order by score as by target, ties in score half."""
    order = F.signum(F.col(f"a.{target}") - F.col(f"b.{target}"))
    got = F.signum(F.col(f"a.{score}") - F.col(f"b.{score}"))
    return pairs.agg(F.count("*").alias("pairs"), F.avg(F.when(got == 0, 0.5).when(got == order, 1.0).otherwise(0.0)).alias("accuracy"))


def top_share_precision(rows: DataFrame, target: str, score: str, group: str, id_col: str, percent: int = 20) -> DataFrame:
    """One row: share of each group's top ceil(percent %) by score that are also in it by target, over all groups."""
    w = Window.partitionBy(group)
    k = F.ceil(F.count("*").over(w) * percent / F.lit(100.0))
    placed = rows.withColumns({
        "_s": F.row_number().over(w.orderBy(F.desc(score), id_col)), "_t": F.row_number().over(w.orderBy(F.desc(target), id_col)), "_k": k})
    hit = F.count_if((F.col("_s") <= F.col("_k")) & (F.col("_t") <= F.col("_k")))
    picked = F.count_if(F.col("_s") <= F.col("_k"))
    return placed.agg(picked.alias("picked"), (hit / F.nullif(picked, F.lit(0))).alias("precision"))


def macro_ndcg(rows: DataFrame, target: str, score: str, group: str) -> DataFrame:
    """One row: mean NDCG of groups of two rows or more, gains linear in the target, averaged over ties in score."""
    w = Window.partitionBy(group)
    discount = 1 / F.log2(F.row_number().over(w.orderBy(F.desc("_key"))) + 1.0)

    def gain(key: str) -> DataFrame:
        placed = rows.withColumn("_key", F.col(key)).withColumn("_d", discount)
        by_tie = placed.groupBy(group, "_key").agg(F.avg(target).alias("g"), F.sum("_d").alias("d"), F.count("*").alias("n"))
        return by_tie.groupBy(group).agg(F.sum(F.col("g") * F.col("d")).alias(key + "_dcg"), F.sum("n").alias("n"))

    both = gain(score).join(gain(target).drop("n"), group).where("n >= 2")
    ideal = F.col(f"{target}_dcg")
    return both.agg(F.avg(F.when(ideal > 0, F.col(f"{score}_dcg") / ideal).otherwise(0.0)).alias("ndcg"), F.count("*").alias("groups"))


def _all_but(total: Column, marked: Column, draws: Column | int) -> Column:
    """Chance that none of ``marked`` out of ``total`` is among ``draws`` drawn without replacement."""
    draws = F.lit(draws) if isinstance(draws, int) else draws
    steps = F.sequence(F.lit(0), F.greatest(draws.cast("int"), F.lit(1)) - 1)
    return F.when(draws <= 0, 1.0).otherwise(F.aggregate(
        steps, F.lit(1.0), lambda acc, i: acc * F.greatest(F.lit(0.0), (total - marked - i) / F.greatest(total - i, F.lit(1)))))


def tie_aware_hits(rows: DataFrame, pool: str, score: str, is_gold: str, ks: Sequence[int] = (1, 3)) -> DataFrame:
    """Expected hit@k and reciprocal rank of the first gold item of each pool, ties in random order.

    With T items tied at the best gold score, g of them gold, and b above, the
    first gold item stands m places or more into the tie with the chance of m
    draws without gold; sums of that chance give all measures without listing
    orders. Pools without gold are left out.
    """
    best = F.max(F.when(F.col(is_gold), F.col(score))).over(Window.partitionBy(pool))
    placed = rows.withColumn("_best", best).where(F.col("_best").isNotNull())
    t = placed.groupBy(pool).agg(
        F.count("*").alias("size"), F.count_if(F.col(is_gold)).alias("golds"), F.count_if(F.col(score) > F.col("_best")).alias("_b"),
        F.count_if(F.col(score) == F.col("_best")).alias("_t"), F.count_if((F.col(score) == F.col("_best")) & F.col(is_gold)).alias("_g"))
    hits = {f"hit_at_{k}": 1 - _all_but(F.col("_t"), F.col("_g"), F.least(F.lit(k) - F.col("_b"), F.col("_t"))) for k in ks}
    hits = {n: F.when(F.col("_b") >= k, 0.0).otherwise(c) for (n, c), k in zip(hits.items(), ks)}
    out = t.withColumns(hits)
    return out.withColumn("mrr", _reciprocal(F.col("_t"), F.col("_g"), F.col("_b"))).withColumns({
        "best_rank_min": F.col("_b") + 1, "best_rank_max": F.col("_b") + F.col("_t") - F.col("_g") + 1}).drop("_b", "_t", "_g")


def _reciprocal(total: Column, marked: Column, above: Column) -> Column:
    """Mean of 1 / (above + place of the first marked item) over all orders of the tie."""
    steps = F.sequence(F.lit(1), (total - marked + 1).cast("int"))
    start = F.struct(F.lit(1.0).alias("none"), F.lit(0.0).alias("sum"))

    def step(acc: Column, m: Column) -> Column:
        left = total - (m - 1)
        hit = acc["none"] * marked / left
        return F.struct((acc["none"] - hit).alias("none"), (acc["sum"] + hit / (above + m)).alias("sum"))

    return F.aggregate(steps, start, step, lambda acc: acc["sum"])


def random_baselines(pools: DataFrame, size: str = "size", golds: str = "golds", ks: Sequence[int] = (1, 3)) -> DataFrame:
    """Exact hit@k and reciprocal rank of a random order, for pools with their size and number of gold items."""
    n, g = F.col(size), F.col(golds)
    out = pools.withColumns({f"random_hit_at_{k}": 1 - _all_but(n, g, F.least(F.lit(k), n)) for k in ks})
    return out.withColumn("random_mrr", F.when(g > 0, _reciprocal(n, g, F.lit(0))).otherwise(0.0))


def ecdf_percentile(values: DataFrame, reference: DataFrame, value: str, smoothed: bool = False) -> DataFrame:
    """``values`` with ``percentile``: share of ``reference`` at or below, or (count + 0.5) / (N + 1) if smoothed; 0.5 for no reference.

    Rows of both tables are dealt to ranges of the value; a row counts the
    reference rows of its own range up to it and adds those of the ranges
    before, so there is no order over all rows in one task.
    """
    spark = values.sparkSession
    both = values.select(*values.columns, F.lit(0).alias("_ref")).unionByName(
        reference.select(F.col(value), F.lit(1).alias("_ref")), allowMissingColumns=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = reference.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cut = F.array(*(F.lit(float(b)) for b in sorted(set(bounds)))).cast("array<double>")
    placed = both.withColumn("_part", F.coalesce(steps_below(cut, lambda b: b < F.col(value), max(1, parts)), F.lit(0)))
    own = F.sum("_ref").over(Window.partitionBy("_part").orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    sizes = placed.groupBy("_part").agg(F.sum("_ref").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    count = F.col("_own") + F.col("_before")
    share = (count + 0.5) / (F.col("_all") + 1) if smoothed else count / F.col("_all")
    return placed.withColumn("_own", own).where("_ref = 0").join(F.broadcast(offsets), "_part").withColumn(
        "percentile", F.when(F.col("_all") > 0, share).otherwise(0.5)).select(*values.columns, "percentile")


def fuse_ranks(rows: DataFrame, pool: str, first: str, second: str, weight: float = 0.5) -> DataFrame:
    """``rows`` with the rank percentiles of both scores in their pool and ``fused``, their weighted mean."""
    return rows.withColumns({"first_pct": rank_percentile(first, [pool]), "second_pct": rank_percentile(second, [pool])}).withColumn(
        "fused", weight * F.col("first_pct") + (1 - weight) * F.col("second_pct"))


def rank_classes(rows: DataFrame, score: str, id_col: str, low: tuple[int, int] = (30, 94), middle: tuple[int, int] = (64, 94)) -> DataFrame:
    """``rows`` with ``class`` 0, 1, 2 by order of (score, id): the first round(n * 30/94) are 0, up to round(n * 64/94) are 1.

    Rounding is half-even. Rows are numbered by ranges of the score (see :func:`dense_numbers`).
    """
    total = rows.agg(F.count("*").alias("_n"))
    place, all_ = F.col("_place"), F.col("_n")
    placed = dense_numbers(rows, [score, id_col], "_place").join(F.broadcast(total))
    return placed.withColumn("class", F.when(place <= F.bround(all_ * low[0] / F.lit(low[1])), 0).when(place <= F.bround(all_ * middle[0] / F.lit(middle[1])), 1).otherwise(2)).drop("_place", "_n")
