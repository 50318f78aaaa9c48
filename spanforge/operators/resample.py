"""Rank metrics over multiplicities, and bootstraps of whole metric bundles by groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.sources.shared import once

from . import replicates as replicates_
from .audit import bootstrap_draws
from .concordance import concordance

#: Metrics of :func:`bundle_metrics`.
BUNDLE = ("centred", "macro_spearman", "pair_accuracy", "local_pair_accuracy", "ndcg", "robust")


def weighted_rank(value: str, keys: Sequence[str], weight: str) -> Column:
    """Average rank of the row's copies within its keys, a row standing for ``weight`` of them: ties, copies too, share the mean of their places."""
    upto = F.sum(weight).over(Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    return upto - (F.sum(weight).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def weighted_pearson(x: str, y: str, weight: str) -> Column:
    """Correlation as an aggregate, each row counted ``weight`` times; null for fewer than two or a flat side."""
    w, a, b = F.col(weight), F.col(x).cast("double"), F.col(y).cast("double")
    n = F.sum(w)
    mean_a, mean_b = F.sum(w * a) / n, F.sum(w * b) / n
    var = lambda v, m: F.sum(w * v * v) / n - m * m
    va, vb = var(a, mean_a), var(b, mean_b)
    return F.when((n >= 2) & (va > 1e-12) & (vb > 1e-12), (F.sum(w * a * b) / n - mean_a * mean_b) / F.sqrt(va * vb))


def _dcg(rows: DataFrame, keys: Sequence[str], by: str, target: str, weight: str, out: str) -> DataFrame:
    """Per keys: gains in descending order of ``by``, those of a tie averaged over its places; a row takes ``weight`` places."""
    ties = rows.groupBy(*keys, F.col(by).alias("_v")).agg(F.sum(weight).alias("_w"), (F.sum(F.col(weight) * F.col(target)) / F.sum(weight)).alias("_g"))
    upto = F.sum("_w").over(Window.partitionBy(*keys).orderBy(F.desc("_v")))
    places = F.sequence(F.col("_upto") - F.col("_w") + 1, F.col("_upto"))
    discount = F.aggregate(places, F.lit(0.0), lambda acc, p: acc + 1 / F.log2(p + 1.0))
    return ties.withColumn("_upto", upto).groupBy(*keys).agg(F.sum(F.col("_g") * discount).alias(out), F.sum("_w").alias(f"{out}_n"))


def bundle_metrics(rows: DataFrame, keys: Sequence[str], channel: str, target: str, score: str, weight: str, min_gap: float = 0.01,
                   local: tuple[float, float] = (0.10, 0.40)) -> DataFrame:
    """(keys, BUNDLE): channel-centred and macro Spearman correlation, pair accuracy over all and over local gaps in a channel, macro NDCG, and the mean of the first four, accuracies as 2a - 1.

    A row stands for ``weight`` copies of itself. Rows without target or score, or of weight 0, are left out. A metric that isn't defined is null, and so
    is a mean with an undefined part. A key's rows are ordered by windows, which spill; its pairs are counted by :func:`concordance`.
    """
    keys = list(keys)
    known = rows.where(F.col(target).isNotNull() & F.col(score).isNotNull() & (F.col(weight) > 0)).select(
        *keys, channel, F.col(target).cast("double").alias("_t"), F.col(score).cast("double").alias("_s"), F.col(weight).cast("long").alias("_w"))
    known = once(known, "bundle")
    by = Window.partitionBy(*keys, channel)
    mean = lambda c: F.sum(F.col("_w") * F.col(c)).over(by) / F.sum("_w").over(by)
    centred = known.withColumns({"_ct": F.round(F.col("_t") - mean("_t"), 12), "_cs": F.round(F.col("_s") - mean("_s"), 12)})
    inside = [*keys, channel]
    ranked = centred.withColumns({"_rt": weighted_rank("_t", inside, "_w"), "_rs": weighted_rank("_s", inside, "_w")}).withColumns(
        {"_pt": weighted_rank("_ct", keys, "_w"), "_ps": weighted_rank("_cs", keys, "_w")})
    # a channel's sums are parts of those of its key
    w, a, b = F.col("_w"), F.col("_pt"), F.col("_ps")
    sums = {"n": w, "x": w * a, "y": w * b, "xx": w * a * a, "yy": w * b * b, "xy": w * a * b}
    each = ranked.groupBy(*inside).agg(weighted_pearson("_rt", "_rs", "_w").alias("_r"), *(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    n = F.sum("_n")
    va, vb = F.sum("_xx") / n - F.pow(F.sum("_x") / n, 2), F.sum("_yy") / n - F.pow(F.sum("_y") / n, 2)
    pooled = F.when((n >= 2) & (va > 1e-12) & (vb > 1e-12), (F.sum("_xy") / n - F.sum("_x") / n * F.sum("_y") / n) / F.sqrt(va * vb))
    out = each.groupBy(*keys).agg(pooled.alias("centred"), F.avg("_r").alias("macro_spearman"))

    share = lambda band, name: ((F.sum(F.when(F.col("band") == band, F.col("right") + F.col("tied") / 2.0))) / F.sum(F.when(F.col("band") == band, F.col("pairs")))).alias(name)
    pairs = concordance(known, inside, "_t", "_s", [(min_gap, None), local], "_w").groupBy(*keys).agg(share(0, "pair_accuracy"), share(1, "local_pair_accuracy"))
    got, ideal = _dcg(known, inside, "_s", "_t", "_w", "_got"), _dcg(known, inside, "_t", "_t", "_w", "_ideal")
    same = [got[k].eqNullSafe(ideal[k]) for k in inside]
    ndcg = got.join(ideal, same).where("_got_n >= 2").select(*(got[k] for k in keys), "_got", "_ideal").groupBy(*keys).agg(
        F.avg(F.when(F.col("_ideal") > 0, F.col("_got") / F.col("_ideal")).otherwise(0.0)).alias("ndcg"))
    out = out.join(pairs, keys, "left").join(ndcg, keys, "left") if keys else out.join(F.broadcast(pairs), how="left").join(F.broadcast(ndcg), how="left")
    return _with_robust(out).select(*keys, *BUNDLE)


def _with_robust(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("robust", (F.col("centred") + F.col("macro_spearman") + 2 * F.col("pair_accuracy") - 1 + 2 * F.col("local_pair_accuracy") - 1) / 4.0)


def bundle_bootstrap(rows: DataFrame, group: str, channel: str, target: str, score: str, replicates: int = 2000, seed: int = 0, **gaps) -> DataFrame:  # noqa: ANN003
    """(metric, value, low, median, high, valid): each metric of :func:`bundle_metrics` on all rows, and the 2.5, 50 and 97.5 % quantiles over replicates that resample whole groups.

    A replicate is how often each group is drawn (see :func:`spanforge.operators.audit.bootstrap_draws`): its rows carry that number, so a
    group that is drawn thrice is no three copies, and one that isn't drawn takes no part. ``valid`` counts the replicates that define the metric.

    Replicates are worked out side by side (:func:`spanforge.operators.replicates.replicate_bundles`), unless a channel has over ``CHANNEL_ROWS`` rows or a value
    is NaN: then each one's rows are ordered by windows.
    """
    held = once(rows.select(F.col(group), F.col(channel).alias("_channel"), F.col(target).alias("_target"), F.col(score).alias("_score")), "bootstrap")
    known = held.where("_target is not null and _score is not null").select(F.col(group).alias("_group"), "_channel", F.col("_target").cast("double").alias("_t"), F.col("_score").cast("double").alias("_s"))
    sizes = known.groupBy("_channel").agg(F.count("*").alias("n"), F.max(F.isnan("_t") | F.isnan("_s")).alias("nan")).agg(F.max("n").alias("n"), F.max("nan").alias("nan")).first()
    if (sizes.n or 0) <= replicates_.CHANNEL_ROWS and not sizes.nan:
        min_gap, local = gaps.get("min_gap", 0.01), gaps.get("local", (0.10, 0.40))
        found = _with_robust(replicates_.replicate_bundles(known, held.select(F.col(group).alias("_group")).distinct(), replicates, seed, min_gap, local)).select("replicate", *BUNDLE)
    else:
        drawn = bootstrap_draws(held.select(group), group, replicates, seed).groupBy("replicate", group).agg(F.count("*").alias("_times"))
        found = bundle_metrics(held.join(drawn, group), ["replicate"], "_channel", "_target", "_score", "_times", **gaps)
    whole = bundle_metrics(held.withColumn("_times", F.lit(1)), [], "_channel", "_target", "_score", "_times", **gaps)
    spread = found.agg(*(c for m in BUNDLE for c in (F.percentile(m, [0.025, 0.5, 0.975]).alias(f"{m}_q"), F.count(m).alias(f"{m}_n"))))
    line = lambda m: F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), *(F.col(f"{m}_q")[i].alias(c) for i, c in enumerate(("low", "median", "high"))), F.col(f"{m}_n").alias("valid"))
    return whole.join(F.broadcast(spread)).select(F.inline(F.array(*(line(m) for m in BUNDLE))))
