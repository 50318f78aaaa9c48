"""Forests of randomised trees, grown level by level from grouped sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.sources.shared import once

AT = ["held", "tree", "node"]


def _uniform(seed: int, kind: str, feature: int) -> Column:
    """A number in 0 to 1 that MD5 of (seed, kind, held, tree, node, feature) gives, so any engine draws the same."""
    text = F.concat_ws("|", F.lit(f"{seed}|{kind}"), *(F.col(c).cast("string") for c in AT), F.lit(str(feature)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _routed(rows: DataFrame, splits: Sequence[DataFrame]) -> DataFrame:
    """``rows`` with the node that the splits of the levels so far lead to; ``open`` until a node has none."""
    for level in splits:
        x = F.get(F.col("x"), F.col("feature"))
        rows = rows.join(level, AT, "left").withColumns({
            "node": F.when(F.col("feature").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(x > F.col("cut"), 1).otherwise(0)),
            "open": F.col("open") & F.col("feature").isNotNull()}).drop("feature", "cut")
    return rows


def trees_out_of_fold(rows: DataFrame, id_col: str, fold: str, target: str, features: Sequence[str], trees: int = 200, depth: int = 8, min_leaf: int = 1,
                      share: float = 0.75, seed: int = 0) -> DataFrame:
    """(id, fold, prediction): the mean over ``trees`` trees that are grown on all other folds.

    A node draws ``share`` of the features (one at least), and for each a cut evenly between its least and largest value in the node; the one that
    lowers the squares most splits it, of equal ones the first. Both sides must have ``min_leaf`` rows and the gain, at nine decimals, must be over 0.
    A leaf predicts the mean of its rows. Draws are hashes, so the forest is the same on any engine and however rows are dealt.

    A level takes two aggregations over all folds and trees at once: the ranges of the features, and the sums on both sides of the cuts. Its
    splits, a row for each node, are written; rows find their node through them again, so no state of rows is stored. Null features count as 0, rows without target or fold as none.
    """
    p = len(features)
    draws = max(1, int(share * p))
    known = rows.where(F.col(target).isNotNull() & F.col(fold).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(fold).alias("own"), F.col(target).cast("double").alias("y"), F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features)).alias("x"))
    known = once(known, "forest-rows")
    held = known.select(F.col("own").alias("held")).distinct()
    start = {"tree": F.explode(F.sequence(F.lit(0), F.lit(trees - 1))), "node": F.lit(1).cast("long"), "open": F.lit(True)}
    training = known.join(F.broadcast(held), F.col("own") != F.col("held")).withColumns(start)
    splits: list[DataFrame] = []
    for _ in range(depth):
        placed = _routed(training, splits).where("open")
        x = [F.get(F.col("x"), F.lit(i)) for i in range(p)]
        ranges = placed.groupBy(*AT).agg(*(f(v).alias(f"{n}{i}") for i, v in enumerate(x) for f, n in ((F.min, "low"), (F.max, "high"))))
        order = F.array_sort(F.array(*(F.struct(_uniform(seed, "pick", i).alias("u"), F.lit(i).alias("i")) for i in range(p))))
        cuts = ranges.select(*AT, F.transform(F.slice(order, 1, draws), lambda s: s["i"]).alias("drawn"), F.array(*(
            F.round(F.col(f"low{i}") + _uniform(seed, "cut", i) * (F.col(f"high{i}") - F.col(f"low{i}")), 9) for i in range(p))).alias("cuts"))
        cuts = once(cuts, "forest-cuts")  # a row for each node, whose size Spark then knows, so rows aren't shuffled to meet it
        left = [F.when(v <= F.get(F.col("cuts"), F.lit(i)), 1) for i, v in enumerate(x)]
        sums = placed.join(cuts, AT).groupBy(*AT).agg(
            F.first("cuts").alias("cuts"), F.first("drawn").alias("drawn"), F.count("*").alias("n"), F.sum("y").alias("s"),
            F.array(*(F.count(c) for c in left)).alias("ns"), F.array(*(F.coalesce(F.sum(c * F.col("y")), F.lit(0.0)) for c in left)).alias("ss"))
        n, s = F.col("n"), F.col("s")

        def gain(i: Column) -> Column:
            a, b = F.get(F.col("ns"), i), F.get(F.col("ss"), i)
            return F.when((a >= min_leaf) & (n - a >= min_leaf) & (a > 0) & (a < n), F.round(b * b / a + (s - b) * (s - b) / (n - a) - s * s / n, 9))

        ranked = F.array_min(F.transform(F.filter("drawn", lambda i: gain(i) > 0), lambda i: F.struct((-gain(i)).alias("g"), i.alias("i"))))
        splits.append(once(sums.select(*AT, F.get(F.col("cuts"), ranked["i"]).alias("cut"), ranked["i"].alias("feature")).where("feature is not null"), "forest-splits"))
    leaves = once(_routed(training, splits).groupBy(*AT).agg(F.avg("y").alias("value")), "forest-leaves")
    asked = known.withColumns({"held": F.col("own"), **start})
    return _routed(asked, splits).join(leaves, AT).groupBy("id", "own").agg(F.avg("value").alias("prediction")).select(F.col("id").alias(id_col), F.col("own").alias(fold), "prediction")
