"""Linear models from sums, in folds of whole groups: nested selection, ensembles, final fits and their scores.

A fold's training sums are the total less its own, so all folds and
strengths of regularisation are fitted from one pass over the rows; what is solved is a small matrix for each fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.sources.shared import once

from .audit import grouped_folds
from .order import dense_numbers, in_ranges, numbers_within, ranks_within, tile
from .ranks import ecdf_percentile
from .rollups import hash_scores


def moments(rows: DataFrame, groups: Sequence[str], target: str, features: Sequence[str]) -> DataFrame:
    """Sums that a linear fit of ``target`` needs, per group: n, y, and arrays x, xy and xx (upper triangle, by rows)."""
    known = rows.where(F.col(target).isNotNull())
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    y = F.col(target).cast("double")
    return known.groupBy(*groups).agg(
        F.count("*").cast("double").alias("n"), F.sum(y).alias("y"), F.array(*(F.sum(a) for a in x)).alias("x"), F.array(*(F.sum(a * y) for a in x)).alias("xy"),
        F.array(*(F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x)))).alias("xx"))


def without_own(sums: DataFrame, within: Sequence[str], n_features: int) -> DataFrame:
    """Each group's sums replaced by those of all other groups of the same ``within``."""
    w = Window.partitionBy(*within)
    sizes = {"x": n_features, "xy": n_features, "xx": n_features * (n_features + 1) // 2}
    arrays = {c: F.array(*(F.sum(F.col(c)[i]).over(w) - F.col(c)[i] for i in range(n))) for c, n in sizes.items()}
    return sums.withColumns({**{c: F.sum(c).over(w) - F.col(c) for c in ("n", "y")}, **arrays})


def ridge(sums: DataFrame, groups: Sequence[str], features: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """(groups, alpha, intercept, coefficients): ridge regressions on standardised features, in the features' own units.

    A group without rows has no fit; a flat feature has the coefficient 0.
    """
    p = len(features)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.n < 1:
                    continue
                x, xy, xx = (np.asarray(v, float) for v in (row.x, row.xy, row.xx))
                full = np.zeros((p, p))
                full[np.triu_indices(p)] = xx
                full = full + np.triu(full, 1).T
                mean, y = x / row.n, row.y / row.n
                cov = full - row.n * np.outer(mean, mean)
                scale = np.sqrt(np.maximum(np.diag(cov) / row.n, 0))
                flat = scale <= 1e-9
                scale = np.where(flat, 1.0, scale)
                z, zy = cov / np.outer(scale, scale), (xy - x * y) / scale
                zy = np.where(flat, 0.0, zy)
                for a in alphas:
                    b = np.where(flat, 0.0, np.linalg.solve(z + (a + 1e-12) * np.eye(p), zy)) / scale
                    out.append([*(getattr(row, g) for g in groups), float(a), float(y - b @ mean), b.tolist()])
            yield pd.DataFrame(out, columns=[*groups, "alpha", "intercept", "coefficients"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*groups).schema) + (", " if groups else "")
    return sums.mapInPandas(solve, kinds + "alpha double, intercept double, coefficients array<double>")


def predict(rows: DataFrame, fits: DataFrame, on: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``rows`` with alpha and ``prediction`` of each fit of their group; fits are few, a row for each fold and strength."""
    value = F.col("intercept")
    for i, f in enumerate(features):
        value = value + F.col("coefficients")[i] * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    joined = rows.join(F.broadcast(fits), list(on)) if on else rows.join(F.broadcast(fits))
    return joined.withColumn("prediction", value).drop("intercept", "coefficients")


def out_of_fold(rows: DataFrame, fold: str, target: str, features: Sequence[str], alphas: Sequence[float], within: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``prediction`` and alpha by fits on all other folds. With a channel as the fold, each channel is left out in turn."""
    sums = moments(rows, [*within, fold], target, features)
    fits = ridge(without_own(sums, within, len(features)), [*within, fold], features, alphas)
    return predict(rows, fits, [*within, fold], features)


def selection_score(predictions: DataFrame, keys: Sequence[str], target: str, ranks: str | None = None) -> DataFrame:
    """(keys, score): Spearman correlation of predictions with the target, at nine decimals. ``ranks`` names a column of the target's average ranks within the keys, if there is one.

    Rows of one prediction are added up first; both sides are ranked by ranges of the value. The deviation of
    ranks from their mean, known from the number of rows, is what is summed.
    """
    if not ranks:
        ranks = "_rt"
        predictions = ranks_within(once(predictions.select(*keys, "prediction", target), "scored"), keys, target, ranks)
    x = F.col(ranks)
    ties = once(predictions.groupBy(*keys, "prediction").agg(F.count("*").alias("_n"), F.sum(x).alias("_x"), F.sum(x * x).alias("_xx")), "ties")
    placed = in_ranges(ties, ["prediction"])
    part = "_range_prediction"
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    sizes = placed.groupBy(*keys, part).agg(F.sum("_n").alias("_rows"))
    w = Window.partitionBy(*keys)
    offsets = sizes.select(*named, F.col(part).alias("_p"), (F.sum("_rows").over(w.orderBy(part)) - F.col("_rows")).alias("_before"), F.sum("_rows").over(w).alias("_all"))
    upto = placed.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, part).orderBy("prediction")))
    both = upto.join(offsets, [*(upto[k].eqNullSafe(offsets[f"_k{i}"]) for i, k in enumerate(keys)), upto[part] == offsets["_p"]])
    n, mean = F.col("_n"), (F.col("_all") + 1) / 2.0
    p = F.col("_before") + F.col("_upto") - (n - 1) / 2.0 - mean
    t, tt = F.col("_x") - n * mean, F.col("_xx") - 2 * mean * F.col("_x") + n * mean * mean
    sums = both.groupBy(*keys).agg(F.first("_all").alias("_all"), F.sum(p * t).alias("_pt"), F.sum(n * p * p).alias("_pp"), F.sum(tt).alias("_tt"))
    known = (F.col("_all") >= 2) & (F.col("_pp") > 1e-12) & (F.col("_tt") > 1e-12)
    return sums.select(*keys, F.when(known, F.round(F.col("_pt") / F.sqrt(F.col("_pp")) / F.sqrt(F.col("_tt")), 9)).alias("score"))


def best_spec(scores: DataFrame, keys: Sequence[str], spec: str = "alpha") -> DataFrame:
    """(keys, spec): the best score, of equal ones the spec nearest to 1 on a log scale, then the least."""
    order = F.struct(-F.coalesce(F.col("score"), F.lit(-2.0)), F.abs(F.log10(spec)), F.col(spec))
    return scores.groupBy(*keys).agg(F.min_by(spec, order).alias(spec))


def inner_folds(placed: DataFrame, group: str, outer: int, inner: int, seed: int) -> DataFrame:
    """The rows (with ``outer``) once for each outer fold ``held`` that isn't theirs, with an ``inner`` fold of whole groups, shuffled by hashes of the seed."""
    groups = placed.select(group, "outer").distinct()
    rest = groups.withColumn("held", F.explode(F.sequence(F.lit(1), F.lit(outer)))).where("held <> outer")
    position = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("held").cast("string"), F.col(group).cast("string")), 256)
    numbered = numbers_within(rest.withColumn("_position", position), ["held"], ["_position", group], "_place")
    return placed.join(numbered.select(group, "held", tile(F.col("_place"), F.col("_size"), inner).alias("inner")), group)


def inner_scores(training: DataFrame, target: str, features: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """(held, alpha, score) of predictions out of the inner folds of :func:`inner_folds`, pooled. The target is ranked once for all strengths."""
    sums = without_own(moments(training, ["held", "inner"], target, features), ["held"], len(features))
    fits = ridge(sums, ["held", "inner"], features, alphas)
    ranked = ranks_within(training.select("held", "inner", target, *features), ["held"], target, "_rank")
    return selection_score(predict(ranked, fits, ["held", "inner"], features), ["held", "alpha"], target, "_rank")


def nested_predictions(rows: DataFrame, group: str, target: str, features: Sequence[str], alphas: Sequence[float], outer: int = 5, inner: int = 4, seed: int = 0) -> DataFrame:
    """``rows`` with outer fold, chosen alpha and ``prediction``: each row is predicted by a fit on the other outer folds.

    The alpha of an outer fold is the best over its inner folds, whose
    predictions are pooled for the score. Folds hold whole groups and are shuffled by hashes of the seed.
    """
    return _nested(*_placed_and_training(rows, group, outer, inner, seed), target, features, alphas)


def _placed_and_training(rows: DataFrame, group: str, outer: int = 5, inner: int = 4, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``rows`` with their outer fold, and the rows of :func:`inner_folds`, both written once."""
    placed = once(grouped_folds(rows, group, outer, seed).withColumnRenamed("fold", "outer"), "placed")
    return placed, once(inner_folds(placed, group, outer, inner, seed), "training")


def _nested(placed: DataFrame, training: DataFrame, target: str, features: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    chosen = best_spec(inner_scores(training, target, features, alphas), ["held"]).withColumnRenamed("held", "outer")
    sums = without_own(moments(placed, ["outer"], target, features), [], len(features))
    fits = ridge(sums, ["outer"], features, alphas).join(chosen, ["outer", "alpha"])
    return predict(placed, fits, ["outer"], features)


def repeated_predictions(rows: DataFrame, id_col: str, group: str, target: str, features: Sequence[str], alphas: Sequence[float], seeds: Sequence[int], **folds) -> DataFrame:  # noqa: ANN003
    """(id, prediction, repeats): the mean of nested predictions over seeds."""
    rows = once(rows.select(*dict.fromkeys([id_col, group, target, *features])), "repeated")
    parts = [nested_predictions(rows, group, target, features, alphas, seed=s, **folds).select(id_col, "prediction") for s in seeds]
    return reduce(DataFrame.union, parts).groupBy(id_col).agg(F.avg("prediction").alias("prediction"), F.count("*").alias("repeats"))


def control_predictions(rows: DataFrame, kind: str, fold: str, target: str, source: str, id_col: str, seed: int = 0) -> DataFrame:
    """``rows`` with the ``prediction`` of a control, from other folds alone: constant, source (mean of the row's source) or random (hash of the id)."""
    if kind == "random":
        return hash_scores(rows, id_col, 1, seed).withColumnRenamed("random_score", "prediction").drop("simulation")
    keys = {"constant": [], "source": [source]}[kind]
    y = F.col(target).cast("double")
    small = rows.groupBy(fold, *keys).agg(F.sum(y).alias("_s"), F.count(y).alias("_c"))  # a row for each fold and source

    def others(by: list[str], name: str) -> DataFrame:
        own = small.groupBy(fold, *by).agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
        w = Window.partitionBy(*by)  # over a row for each fold
        left = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)) - F.coalesce(c, F.lit(0))
        return own.select(F.col(fold).alias("_f"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), (left("_s") / F.nullif(left("_c"), F.lit(0))).alias(name))

    every = others([], "_every").withColumnRenamed("_f", "_g")
    out = rows.join(every, rows[fold].eqNullSafe(every["_g"]), "left")
    if keys:
        near = others(keys, "_near")
        out = out.join(near, [rows[fold].eqNullSafe(near["_f"]), *(rows[k].eqNullSafe(near[f"_k{i}"]) for i, k in enumerate(keys))], "left")
    value = F.coalesce("_near", "_every") if keys else F.col("_every")
    return out.withColumn("prediction", value).select(*rows.columns, "prediction")


def rank_ensemble(members: DataFrame, id_col: str, model: str, score: str) -> DataFrame:
    """(id, prediction): the mean over models of a score's share of scores at or below it, counted by ranges of the score."""
    placed = in_ranges(members, [score])
    part = f"_range_{score}"
    own = F.count("*").over(Window.partitionBy(model, part).orderBy(score).rangeBetween(Window.unboundedPreceding, 0))
    sizes = placed.groupBy(model, part).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(model)
    offsets = sizes.select(F.col(model).alias("_m"), F.col(part).alias("_p"), (F.sum("_n").over(w.orderBy(part)) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_all"))
    counted = placed.withColumn("_own", own)
    joined = counted.join(offsets, counted[model].eqNullSafe(offsets["_m"]) & (counted[part] == offsets["_p"]))
    return joined.groupBy(id_col).agg(F.avg((F.col("_own") + F.col("_before")) / F.col("_all")).alias("prediction"))


def _nonnegative(n: float, y: float, x: Sequence[float], xy: Sequence[float], xx: Sequence[float], alpha: float, rounds: int) -> tuple[float, np.ndarray]:
    """Intercept and weights, none below zero, of a ridge regression on standardised members, from its sums: projected steps of one over the trace."""
    p = len(x)
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = xx
    full = full + np.triu(full, 1).T
    mean = np.asarray(x) / n
    cov = full - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov) / n, 1e-18))
    z = cov / np.outer(scale, scale) + alpha * np.eye(p)
    zy = (np.asarray(xy) - np.asarray(x) * y / n) / scale
    b, step = np.zeros(p), 1 / np.trace(z)
    for _ in range(rounds):
        b = np.maximum(0.0, b - step * (z @ b - zy))
    return float(y / n - (b / scale) @ mean), b / scale


def stack_weights(rows: DataFrame, target: str, members: Sequence[str], alpha: float = 1.0, rounds: int = 500) -> dict[str, float]:
    """Weights, none below zero, of a ridge regression of the target on standardised member scores: the few sums of the rows reach the driver."""
    sums = moments(rows, [], target, members).first()
    _, weights = _nonnegative(sums.n, sums.y, sums.x, sums.xy, sums.xx, alpha, rounds)
    return dict(zip(members, map(float, weights)))


def stacked_predictions(rows: DataFrame, group: str, target: str, members: Mapping[str, Sequence[str]], alpha: float = 1.0, outer: int = 5, inner: int = 4, seed: int = 0,
                        meta_alpha: float = 1.0, rounds: int = 500) -> DataFrame:
    """``rows`` with outer fold, a column of each member (name: features) and ``prediction``, the members' sum by weights that are none below zero.

    The weights of an outer fold come from predictions that its training rows get out of inner folds, so no row has a part in the weights
    that it is predicted by. Members are ridge regressions of strength ``alpha``. Fits and weights are small tables from sums; the rows are joined with those alone.
    """
    placed, training = _placed_and_training(rows, group, outer, inner, seed)

    def with_members(df: DataFrame, source: DataFrame, fold: str, within: list[str]) -> DataFrame:
        for name, features in members.items():
            sums = without_own(moments(source, [*within, fold], target, features), within, len(features))
            fits = ridge(sums, [*within, fold], features, [alpha])
            df = predict(df, fits, [*within, fold], features).drop("alpha").withColumnRenamed("prediction", name)
        return df

    sums = moments(with_members(training, training, "inner", ["held"]), ["held"], target, list(members))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(r.held, *_nonnegative(r.n, r.y, r.x, r.xy, r.xx, meta_alpha, rounds)) for r in batch.itertuples(index=False) if r.n >= 1]
            yield pd.DataFrame([(h, i, w.tolist()) for h, i, w in found], columns=["outer", "intercept", "weights"])

    weights = sums.mapInPandas(weigh, "outer int, intercept double, weights array<double>")
    both = with_members(placed, placed, "outer", []).join(F.broadcast(weights), "outer")
    value = F.col("intercept")
    for i, name in enumerate(members):
        value = value + F.col("weights")[i] * F.col(name)
    return both.withColumn("prediction", value).drop("intercept", "weights")


def select_models(log: DataFrame, predictions: DataFrame, id_col: str) -> DataFrame:
    """(id, repeat, model, prediction): of each (repeat, fold) the predictions of the model with the best inner score, ties by name."""
    best = log.groupBy("repeat", "fold").agg(F.min_by("model", F.struct(-F.col("score"), F.col("model"))).alias("model"))
    return predictions.join(best, ["repeat", "fold", "model"]).select(id_col, "repeat", "model", "prediction")


def compare_specs(rows: DataFrame, group: str, target: str, specs: Mapping[str, Sequence[str]], alphas: Sequence[float], **folds) -> DataFrame:  # noqa: ANN003
    """(spec, score, n): the score of nested predictions for each named set of features, best first."""
    used = dict.fromkeys([group, target, *(f for features in specs.values() for f in features)])
    placed, training = _placed_and_training(rows.select(*used), group, **folds)
    parts = [_nested(placed, training, target, features, alphas).select(F.lit(name).alias("spec"), F.col(target).alias("_t"), "prediction") for name, features in specs.items()]
    every = once(reduce(DataFrame.unionByName, parts), "compared")
    scores = selection_score(every, ["spec"], "_t").join(every.groupBy("spec").agg(F.count("*").alias("n")), "spec")
    return scores.orderBy(F.desc_nulls_last("score"), "spec")


def final_fit(rows: DataFrame, target: str, features: Sequence[str], alpha: float) -> tuple[DataFrame, DataFrame]:
    """A fit on all rows (one row: intercept, coefficients), and the predictions of these rows as the reference of percentiles."""
    fit = ridge(moments(rows, [], target, features), [], features, [alpha])
    return fit, predict(rows, fit, [], features).select("prediction")


def score_new(rows: DataFrame, fit: DataFrame, reference: DataFrame, features: Sequence[str], ordinal: str, accepted: bool = True) -> DataFrame:
    """``rows`` with prediction, percentile against the reference (0 to 100), rank in the batch and a status; fits that aren't accepted are named so."""
    scored = predict(rows, fit, [], features).drop("alpha")
    placed = ecdf_percentile(scored, reference, "prediction", smoothed=True).withColumn("percentile", F.round(100 * F.col("percentile"), 6))
    return batch_rank(placed, "percentile", ordinal).withColumn("status", F.lit("accepted" if accepted else "research_only"))


def batch_rank(rows: DataFrame, score: str, ordinal: str) -> DataFrame:
    """``rows`` with ``batch_rank``: 1 for the best score, equal ones in input order. Rows are numbered by ranges of the score."""
    return dense_numbers(once(rows, "batch"), [score, ordinal], "batch_rank", descending=True)


def ensemble_scores(rows: DataFrame, members: Mapping[str, float], reference: DataFrame, ordinal: str) -> DataFrame:
    """``rows`` with the weighted mean of the members (named ``score`` like the reference's column), their least, greatest and spread, percentile and batch rank."""
    total = sum(members.values())
    mean = sum((F.col(m) * F.lit(w / total) for m, w in members.items()), F.lit(0.0))
    xs = F.array(*members)
    plain = sum((F.col(m) for m in members), F.lit(0.0)) / len(members)
    spread = F.sqrt(sum(((F.col(m) - plain) * (F.col(m) - plain) for m in members), F.lit(0.0)) / len(members))
    scored = rows.withColumns({"score": F.round(mean, 9), "least": F.array_min(xs), "greatest": F.array_max(xs), "spread": spread})
    return batch_rank(ecdf_percentile(scored, reference, "score"), "percentile", ordinal)


def _drawn_aucs(strata: DataFrame, channel: str, replicates: int, seed: int, draws_at_once: int = 1 << 22, codes_at_once: int = 1 << 16) -> DataFrame:
    """(_r, channel, auc): AUC of each channel in each replicate, from rows (channel, _y, _i, _n, _code), the code being the place of the score among those of the channel.

    Draws go, packed, to the block of rows that they draw from, and from there as counts of codes to blocks of replicates and codes of their channel, whose
    sums over the lower blocks are added. A task holds about ``draws_at_once`` of them, not a channel.
    """
    rows_at_once, chunk, width = max(1, draws_at_once // replicates), max(1, (1 << 20) // replicates), max(1, draws_at_once // (2 * codes_at_once))
    keys = (channel, "_y", "_b")
    tail = F.encode(F.concat_ws("|", F.lit(""), F.col(channel).cast("string"), F.col("_y").cast("string"), F.col("_i").cast("string")), "utf-8")
    kinds = {channel: strata.schema[channel].dataType.simpleString()}
    spark = strata.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-strata.count() * replicates // (1 << 23)))
    slots = strata.repartition(tasks, channel, "_y", "_i").sortWithinPartitions(channel, "_y").select(channel, "_y", F.col("_n").cast("long").alias("_n"), tail.alias("tail"))
    drawn = [("r", "<u4"), ("i", "<u4")]
    heads_ = [f"{seed}|{r}".encode() for r in range(replicates)]

    def cut(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return first, np.append(first[1:], len(key))

    def draw(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            y, n, tails = (batch[c].to_numpy(zero_copy_only=False) for c in ("_y", "_n", "tail"))
            names = batch[channel].to_numpy(zero_copy_only=False)
            bounds = np.flatnonzero((names[1:] != names[:-1]) | (y[1:] != y[:-1])) + 1
            for lo, hi in zip([0, *bounds.tolist()], [*bounds.tolist(), len(y)]):
                for at in range(lo, hi, chunk):
                    mine = tails[at:min(at + chunk, hi)]
                    u = np.frombuffer(b"".join([md5(h + x).digest() for h in heads_ for x in mine]), ">u4")[::4].astype(np.int64) % n[at]
                    block = u // rows_at_once
                    order = np.argsort(block, kind="stable")
                    cells = np.empty(len(u), drawn)
                    cells["r"], cells["i"] = np.repeat(np.arange(replicates), len(mine))[order], (u % rows_at_once)[order]
                    a, b = cut(block[order])
                    where = pa.array(np.full(len(a), at))
                    yield pa.RecordBatch.from_arrays(
                        [batch[channel].take(where), batch["_y"].take(where), pa.array(block[order][a].astype(np.int32)), pa.array([cells[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist())], pa.binary())],
                        [*keys, "cells"])

    coded = [("r", "<u4"), ("code", "<u4"), ("n", "<u4")]

    def code(packs: pa.Table, rows: pa.Table) -> pa.Table:
        cells = np.frombuffer(b"".join(packs["cells"].to_pylist()), drawn)
        lookup = np.zeros(rows_at_once, np.int64)
        lookup[rows["_i"].to_numpy() % rows_at_once] = rows["_code"].to_numpy()
        codes = lookup[cells["i"]]
        span = int(codes.max(initial=0)) + 1
        key, n = np.unique(cells["r"] * np.int64(span) + codes, return_counts=True)
        out = np.empty(len(key), coded)
        out["r"], out["code"], out["n"] = key // span, key % span, n
        part = (out["r"] // width) * np.int64(span) + out["code"] // codes_at_once
        order = np.argsort(part, kind="stable")
        out, part = out[order], part[order]
        a, b = cut(part) if len(part) else (np.zeros(0, int),) * 2
        where = pa.array(np.zeros(len(a), np.int64))
        return pa.table([packs[channel].take(where), packs["_y"].take(where), pa.array((out["r"][a] // width).astype(np.int32)), pa.array((out["code"][a] // codes_at_once).astype(np.int32)),
                         pa.array([out[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist())], pa.binary())], [channel, "_y", "_rb", "_cb", "cells"])

    def sums(packs: pa.Table) -> pa.Table:
        held = np.zeros((2, width, codes_at_once))
        for y, cells in zip(packs["_y"].to_pylist(), packs["cells"].to_pylist()):
            c = np.frombuffer(cells, coded)
            np.add.at(held[y], (c["r"] % width, c["code"] % codes_at_once), c["n"])
        q, p = held
        known = np.flatnonzero(p.sum(axis=1) + q.sum(axis=1))
        won = (p * (q.cumsum(axis=1) - q / 2)).sum(axis=1)
        where = pa.array(np.zeros(len(known), np.int64))
        return pa.table([packs[channel].take(where), packs["_cb"].take(where), pa.array((known + width * packs["_rb"][0].as_py()).astype(np.int32)), *(pa.array(v[known]) for v in (p.sum(axis=1), q.sum(axis=1), won))],
                        [channel, "_cb", "_r", "p", "q", "won"])

    name = f"`{channel}` {kinds[channel]}"
    packs = slots.mapInArrow(draw, f"{name}, _y int, _b int, cells binary")
    table = strata.select(channel, "_y", F.expr(f"int(_i div {rows_at_once})").alias("_b"), F.col("_i").cast("long").alias("_i"), F.col("_code").cast("long").alias("_code"))
    counts = packs.groupBy(*keys).cogroup(table.groupBy(*keys)).applyInArrow(code, f"{name}, _y int, _rb int, _cb int, cells binary")
    found = counts.groupBy(channel, "_rb", "_cb").applyInArrow(sums, f"{name}, _cb int, _r int, p double, q double, won double")
    lower = F.coalesce(F.sum("q").over(Window.partitionBy(channel, "_r").orderBy("_cb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return found.withColumn("won", F.col("won") + F.col("p") * lower).groupBy("_r", channel).agg((F.sum("won") / (F.sum("p") * F.sum("q"))).alias("auc"))


def stratified_bootstrap(rows: DataFrame, channel: str, label: str, score: str, id_col: str, replicates: int, seed: int, least: int = 3) -> DataFrame:
    """One row: mean AUC over channels with ``least`` rows of both classes, and the quantiles of it over replicates that resample both classes of each.

    Draw (replicate, channel, class, slot) takes the row whose number 32 bits of its MD5 leave.
    """
    known = rows.where(F.col(label).isin(0, 1) & F.col(score).isNotNull()).select(channel, F.col(label).cast("int").alias("_y"), F.col(score).alias("_s"), id_col)
    stratum = Window.partitionBy(channel, "_y")
    numbered = known.withColumns({"_i": F.row_number().over(stratum.orderBy(id_col)) - 1, "_n": F.count("*").over(stratum)})
    w = Window.partitionBy(channel)
    stable = numbered.withColumns({"_pos": F.count_if(F.col("_y") == 1).over(w), "_neg": F.count_if(F.col("_y") == 0).over(w)}).where((F.col("_pos") >= least) & (F.col("_neg") >= least))
    def macro(df: DataFrame, keys: list[str]) -> DataFrame:
        counted = df.groupBy(*keys, channel, "_s").agg(F.count_if(F.col("_y") == 1).alias("p"), F.count_if(F.col("_y") == 0).alias("q"))
        below = F.sum("q").over(Window.partitionBy(*keys, channel).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
        by = counted.withColumn("b", F.coalesce(below, F.lit(0))).groupBy(*keys, channel).agg(
            (F.sum(F.col("p") * (F.col("b") + F.col("q") / 2.0)) / (F.sum("p") * F.sum("q"))).alias("auc"))
        return by.groupBy(*keys).agg(F.avg("auc").alias("m"), F.count("*").alias("channels"))

    stable = once(stable.withColumn("_code", F.dense_rank().over(w.orderBy("_s")) - 1), "strata")
    by = _drawn_aucs(stable.where(F.col(channel).isNotNull()), channel, replicates, seed)
    out = by.groupBy("_r").agg(F.avg("auc").alias("m")).agg(F.percentile("m", [0.025, 0.5, 0.975]).alias("q"), F.count("m").alias("valid"))
    return macro(stable, []).crossJoin(F.broadcast(out)).select(F.col("m").alias("macro_auc"), "channels", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"), "valid")
