"""Roll-ups of runs, groups and variants, and null controls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.sources.shared import once

from .order import average_ranks
from .ranks import pearson, spearman


def weighted_summary(runs: DataFrame, weight: str, metrics: Sequence[str]) -> DataFrame:
    """One row: total weight and the weighted mean of each metric, over the runs that have it."""
    return runs.agg(F.sum(weight).alias("total"), *(
        (F.sum(F.col(m) * F.col(weight)) / F.nullif(F.sum(F.when(F.col(m).isNotNull(), F.col(weight))), F.lit(0))).alias(m) for m in metrics))


def coverage_rollup(rows: DataFrame, group: str, keys: Sequence[str], text: str) -> DataFrame:
    """Per group: rows, distinct values of each key, their sorted list for the first key, complete rows and mean text length."""
    listed = F.array_join(F.array_sort(F.collect_set(F.col(keys[0]).cast("string"))), ",")
    return rows.groupBy(group).agg(
        F.count("*").alias("rows"), *(F.count_distinct(k).alias(f"{k}_count") for k in keys), listed.alias(f"{keys[0]}_list"),
        F.count_if(F.coalesce(F.trim(text), F.lit("")) != "").alias("complete"), F.avg(F.char_length(F.coalesce(F.col(text), F.lit("")))).alias("mean_chars"))


def channel_validity(rows: DataFrame, channel: str, label: str, score: str, least: int = 3) -> DataFrame:
    """Per channel with both classes: counts, whether both have ``least`` rows, means, AUC, and pairs right, tied and wrong.

    Pairs of a high and a low row are counted by ranks: a high row beats the low
    ones below it, so no pair is listed.
    """
    known = rows.where(F.col(label).isin(0, 1) & F.col(score).isNotNull())
    w = Window.partitionBy(channel)
    low = F.col(label) == 0
    below = F.sum(low.cast("long")).over(w.orderBy(score).rangeBetween(Window.unboundedPreceding, 0))
    level = F.sum(low.cast("long")).over(Window.partitionBy(channel, score))
    counted = known.withColumns({"_tied": level, "_below": below - level})
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(low)
    high = lambda c: F.sum(F.when(F.col(label) == 1, F.col(c)))
    out = counted.groupBy(channel).agg(
        pos.alias("highs"), neg.alias("lows"), F.avg(F.when(F.col(label) == 1, F.col(score))).alias("mean_high"), F.avg(F.when(low, F.col(score))).alias("mean_low"),
        high("_below").alias("right"), high("_tied").alias("tied"))
    both = out.where("highs > 0 and lows > 0").withColumn("wrong", F.col("highs") * F.col("lows") - F.col("right") - F.col("tied"))
    return both.withColumns({"auc": (F.col("right") + F.col("tied") / 2.0) / (F.col("highs") * F.col("lows")), "stable": (F.col("highs") >= least) & (F.col("lows") >= least)})


def human_alignment(judge: DataFrame, humans: DataFrame, id_col: str, dimensions: Sequence[str]) -> DataFrame:
    """One row: Spearman correlation of the judge's score with the mean human axis score, 25 times the mean of complete dimensions.

    Means are rounded to nine decimals, so that those that are equal but for the order of addition tie.
    """
    axis = 25 * sum((F.col(d) for d in dimensions), F.lit(0.0)) / len(dimensions)
    means = humans.select(id_col, axis.alias("axis")).groupBy(id_col).agg(F.round(F.avg("axis"), 9).alias("human"))
    both = judge.join(means, id_col).where("human is not null and score is not null")
    return spearman(both, "score", "human").select("n", "spearman")


def variant_contrasts(summary: DataFrame, metrics: Sequence[str], contrasts: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(contrast, metrics): differences of two variants' rows for each named contrast, at eight decimals."""
    wanted = sorted({v for pair in contrasts.values() for v in pair})
    wide = summary.groupBy().pivot("variant", wanted).agg(*(F.max(m).alias(m) for m in metrics))
    cell = lambda v, m: F.col(f"{v}_{m}") if len(metrics) > 1 else F.col(v)
    rows = [F.struct(F.lit(n).alias("contrast"), *(F.round(cell(a, m) - cell(b, m), 8).alias(m) for m in metrics)) for n, (a, b) in contrasts.items()]
    return wide.select(F.inline(F.array(*rows)))


def metric_bundle(rows: DataFrame, target: str, score: str, channel: str) -> DataFrame:
    """One row: pooled and channel-centred Spearman correlation, distinct scores and rows in ties."""
    w = Window.partitionBy(channel)
    known = rows.where(F.col(target).isNotNull() & F.col(score).isNotNull()).withColumns({
        "_ct": F.round(F.col(target) - F.avg(target).over(w), 12), "_cs": F.round(F.col(score) - F.avg(score).over(w), 12)})
    ranked = average_ranks(known, {"_rt": target, "_rs": score, "_rct": "_ct", "_rcs": "_cs"}).withColumn("_same", F.count("*").over(Window.partitionBy(score)))
    return ranked.agg(
        F.count("*").alias("n"), pearson("_rt", "_rs").alias("pooled"), pearson("_rct", "_rcs").alias("centred"),
        F.count_distinct(score).alias("unique_scores"), F.count_if(F.col("_same") > 1).alias("tied_rows"))


def performance_metrics(rows: DataFrame, target: str, score: str, channel: str, source: str, id_col: str, min_gap: float = 0.01, local: tuple[float, float] = (0.10, 0.40)) -> DataFrame:
    """One row of an evaluation's figures: pooled, channel-centred, source-residual and macro Spearman correlations, pair accuracies over all and over
    local gaps, top-fifth precision, NDCG, and two means of the robust ones: plain, and weighted for selection. A mean with an undefined part is null.

    Ranks over all rows are taken by ranges, pairs are counted and not listed (see :func:`concordance`).
    """
    from .concordance import concordance
    from .ranks import macro_ndcg, macro_spearman, top_share_precision

    known = once(rows.where(F.col(target).isNotNull() & F.col(score).isNotNull()).select(id_col, channel, source, target, score), "metrics")
    by, second = Window.partitionBy(channel), Window.partitionBy(source)
    centred = known.withColumns({f"_c{c}": F.round(F.col(c) - F.avg(c).over(by), 12) for c in (target, score)})
    centred = centred.withColumns({f"_s{c}": F.round(F.col(f"_c{c}") - F.avg(f"_c{c}").over(second), 12) for c in (target, score)})
    kinds = {"pooled": (target, score), "centred": (f"_c{target}", f"_c{score}"), "source_residual": (f"_s{target}", f"_s{score}")}
    ranked = average_ranks(centred, {f"_{k}_{i}": c for k, pair in kinds.items() for i, c in enumerate(pair)})
    out = ranked.agg(F.count("*").alias("n"), *(pearson(f"_{k}_0", f"_{k}_1").alias(k) for k in kinds))
    share = lambda band, name: [
        F.coalesce(F.sum(F.when(F.col("band") == band, F.col("pairs"))), F.lit(0)).alias(f"{name}_count"),
        (F.sum(F.when(F.col("band") == band, F.col("right") + F.col("tied") / 2.0)) / F.sum(F.when(F.col("band") == band, F.col("pairs")))).alias(name)]
    parts = [
        macro_spearman(known, target, score, channel).select("macro_spearman"),
        concordance(known, [channel], target, score, [(min_gap, None), local]).agg(*share(0, "pair_accuracy"), *share(1, "local_pair_accuracy")),
        top_share_precision(known, target, score, channel, id_col).select(F.col("precision").alias("top_fifth")), macro_ndcg(known, target, score, channel).select("ndcg")]
    for part in parts:
        out = out.join(F.broadcast(part))
    skill, local_skill = 2 * F.col("pair_accuracy") - 1, 2 * F.col("local_pair_accuracy") - 1
    return out.withColumns({
        "robust": (F.col("centred") + F.col("macro_spearman") + skill + local_skill) / 4.0,
        "selection": 0.4 * F.col("centred") + 0.3 * F.col("macro_spearman") + 0.15 * skill + 0.15 * local_skill})


def hash_scores(rows: DataFrame, id_col: str, simulations: int, seed: int) -> DataFrame:
    """``rows`` once per simulation with a uniform ``random_score`` that MD5 of (seed, simulation, id) gives."""
    text = F.concat_ws("|", F.lit(str(seed)), F.col("simulation").cast("string"), F.col(id_col).cast("string"))
    draw = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("simulation", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1)))).withColumn("random_score", draw)


#: Draws of a simulation that are ranked at once, about.
PART_ROWS = 1 << 18


def draw_ranks(rows: DataFrame, id_col: str, simulations: int, seed: int, spans: Mapping[int, tuple[float, float]], part_rows: int = PART_ROWS) -> DataFrame:
    """(simulation, kind, n, x, xx, xy): for each simulation sums over its rows of the average rank x of a random value, from the middle of all ranks, its square, and its product with ``y``.

    ``rows`` have a class ``c`` and a whole number ``y``, at most their number, besides the id. Kind 0 ranks low + (high - low) u of the span of the row's class, u its uniform draw (see :func:`hash_scores`),
    kind 1, with several classes, class + u. Draws go to parts of the value of kind 0, packed by the hundreds: nine bytes each, not a row. In a part each class has one range of u,
    so both ranks are those within it and offsets, which are sums of numbers of rows.
    """
    from hashlib import md5

    import numpy as np
    import pyarrow as pa

    n = rows.count()
    top = max(high for _, high in spans.values())
    parts = max(1, -(-n // part_rows))
    low, wide = (np.array([f(*spans[c]) for c in sorted(spans)]) for f in (lambda a, b: a, lambda a, b: b - a))
    cell = [("u", "<u4"), ("y", "<i4" if n < 1 << 31 else "<i8"), ("c", "u1")]
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * simulations // (1 << 23)))
    tail = F.concat(F.lit("|"), F.col(id_col).cast("string"))
    dealt = rows.repartition(tasks, id_col).select(F.encode(F.coalesce(tail, F.lit("")), "utf-8").alias("tail"), F.col("c").cast("int").alias("c"), F.col("y").cast("long").alias("y"))
    at_once = max(1, (1 << 20) // simulations)

    def pack(batches):  # noqa: ANN001, ANN202
        def out(tails, c, y):  # noqa: ANN001, ANN202
            # the same draws as those of hash_scores
            digests = b"".join([md5(head + x).digest() for head in (f"{seed}|{i}".encode() for i in range(simulations)) for x in tails])
            u = np.frombuffer(digests, ">u4")[::4] / float(1 << 32)
            sim, c, y = np.repeat(np.arange(simulations), len(tails)), np.tile(c, simulations), np.tile(y, simulations)
            part = np.minimum((low[c] + wide[c] * u) / top * parts, parts - 1).astype(np.int64)
            key = sim * parts + part
            order = np.argsort(key, kind="stable")
            key = key[order]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            cells = np.empty(len(key), cell)
            cells["u"], cells["y"], cells["c"] = (u[order] * (1 << 32)).astype(np.uint32), y[order], c[order]
            data, ends = cells.tobytes(), np.append(heads[1:], len(key)) * cells.itemsize
            packed = [data[a:b] for a, b in zip((heads * cells.itemsize).tolist(), ends.tolist())]
            for i in range(0, len(heads), 10_000):
                k = key[heads[i:i + 10_000]]
                yield pa.RecordBatch.from_arrays([pa.array((k // parts).astype(np.int32)), pa.array((k % parts).astype(np.int32)), pa.array(packed[i:i + 10_000], pa.binary())], ["simulation", "part", "cells"])

        for batch in batches:
            tails, c, y = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            for i in range(0, len(tails), at_once):
                yield from out(*(x[i:i + at_once] for x in (tails, c, y)))

    def ranked(v):  # noqa: ANN001, ANN202
        order = np.argsort(v, kind="stable")
        s = v[order]
        heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        sizes = np.diff(np.append(heads, len(s)))
        ranks = np.empty(len(v))
        ranks[order] = np.repeat(heads + (sizes + 1) / 2.0, sizes)
        return ranks

    sums = "n long, x double, xx double, y double, xy double"

    def local(table: pa.Table) -> pa.Table:
        cells = np.frombuffer(b"".join(table["cells"].to_pylist()), cell)
        u, y, c = cells["u"] / float(1 << 32), cells["y"].astype(np.float64), cells["c"]
        found = []
        for kind, group, x in [(0, 0, (low[c] + wide[c] * u, y))] + [(1, k, (u[c == k], y[c == k])) for k in (np.unique(c).tolist() if len(spans) > 1 else [])]:
            r = ranked(x[0])
            found.append((table["simulation"][0].as_py(), table["part"][0].as_py(), kind, group, len(r), r.sum(), (r * r).sum(), x[1].sum(), (r * x[1]).sum()))
        return pa.table(dict(zip(("simulation", "part", "kind", "c", "n", "x", "xx", "y", "xy"), map(list, zip(*found)))), pa.schema(
            [("simulation", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("c", pa.int32()), ("n", pa.int64()), *((k, pa.float64()) for k in ("x", "xx", "y", "xy"))]))

    found = dealt.mapInArrow(pack, "simulation int, part int, cells binary").groupBy("simulation", "part").applyInArrow(local, f"simulation int, part int, kind int, c int, {sums}")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("simulation", "kind").orderBy("c", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    o = F.col("_o")
    placed = found.withColumn("_o", before - F.lit((n + 1) / 2.0)).select(
        "simulation", "kind", "n", (F.col("x") + o * F.col("n")).alias("x"), (F.col("xx") + 2 * o * F.col("x") + o * o * F.col("n")).alias("xx"), (F.col("xy") + o * F.col("y")).alias("xy"))
    return placed.groupBy("simulation", "kind").agg(*(F.sum(k).alias(k) for k in ("n", "x", "xx", "xy")))


def null_control(rows: DataFrame, id_col: str, label: str, simulations: int, seed: int, part_rows: int = PART_ROWS) -> DataFrame:
    """One row: mean and 2.5 and 97.5 % quantiles of the AUC of random scores."""
    known = once(rows.where(F.col(label).isNotNull()).select(id_col, F.lit(0).alias("c"), (F.col(label) == 1).cast("int").alias("y"), (F.col(label) == 0).cast("int").alias("_neg")), "control")
    counts = known.agg(F.count("*").alias("_n"), F.sum("y").cast("double").alias("_p"), F.sum("_neg").alias("_q"))
    p, q = F.col("_p"), F.col("_q")
    ranks = F.col("xy") + p * (F.col("_n") + 1) / 2.0
    sums = draw_ranks(known, id_col, simulations, seed, {0: (0.0, 1.0)}, part_rows).join(F.broadcast(counts))
    aucs = sums.select(F.when((p > 0) & (q > 0), (ranks - p * (p + 1) / 2) / (p * q)).alias("auc"))
    return aucs.agg(F.avg("auc").alias("mean"), F.percentile("auc", [0.025, 0.975]).alias("q"), F.count("auc").alias("valid")).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "valid")


def control_distribution(rows: DataFrame, id_col: str, label: str, target: str, kind: str, simulations: int, seed: int, duration: str | None = None) -> DataFrame:
    """One row: mean and 2.5 and 97.5 % quantiles of the Spearman correlation of a control's scores with the target.

    ``kind`` is random; oracle (the class of neg, mid, pos plus a uniform number); polar (neg in 0 to 1, pos in 2 to 3, mid anywhere); or
    duration, which is the same in every simulation.
    """
    if kind == "duration":
        found = spearman(hash_scores(rows, id_col, 1, seed).withColumn("_v", F.col(duration).cast("double")), "_v", target, ["simulation"])
        return _spread(found.withColumn("kind", F.lit(kind)), [kind]).drop("kind")
    return control_distributions(rows, id_col, label, target, [kind], simulations, seed).drop("kind")


def _spread(found: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(kind, mean, low, high, valid) of (kind, spearman), a row for each of the kinds."""
    of = [F.when(F.col("kind") == k, F.col("spearman")) for k in kinds]
    one = found.agg(*(F.struct(F.lit(k).alias("kind"), F.avg(c).alias("mean"), F.percentile(c, [0.025, 0.975]).alias("q"), F.count(c).alias("valid")).alias(k) for k, c in zip(kinds, of)))
    return one.select(F.inline(F.array(*kinds))).select("kind", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "valid")


def control_distributions(rows: DataFrame, id_col: str, label: str, target: str, kinds: Sequence[str], simulations: int, seed: int, part_rows: int = PART_ROWS) -> DataFrame:
    """(kind, mean, low, high, valid): :func:`control_distribution` of several random kinds, polar and oracle from the same draws.

    The target is ranked once, as its ranks are the same in every simulation; those of the controls are summed by parts (see :func:`draw_ranks`).
    """
    if odd := set(kinds) - {"random", "oracle", "polar"}:
        raise ValueError(f"unknown kinds {sorted(odd)}")
    c = F.when(F.col(label) == "neg", 0).when(F.col(label) == "mid", 1).when(F.col(label) == "pos", 2)
    out = []
    for spans, names in (({0: (0.0, 1.0), 1: (0.0, 3.0), 2: (2.0, 3.0)}, {0: "polar", 1: "oracle"}), ({0: (0.0, 1.0)}, {0: "random"})):
        if wanted := {i: k for i, k in names.items() if k in kinds}:
            known = rows.select(id_col, F.col(target).alias("_t"), (c if len(spans) > 1 else F.lit(0)).alias("c")).where("_t is not null and c is not null")
            size = known.agg(F.count("*").alias("_all"))
            place = (2 * F.col("_rank") - F.col("_all") - 1).cast("long")
            ranked = once(average_ranks(known, {"_rank": "_t"}).join(F.broadcast(size)).select(id_col, "c", place.alias("y")), "control")
            sums = draw_ranks(ranked, id_col, simulations, seed, spans, part_rows).join(F.broadcast(ranked.agg(F.var_pop("y").alias("_vy"))))
            v = F.col("xx") / F.col("n") - F.pow(F.col("x") / F.col("n"), 2)
            r = F.when((F.col("n") >= 2) & (F.sqrt(v) > 1e-12) & (F.sqrt("_vy") > 1e-12), F.col("xy") / F.col("n") / F.sqrt(v * F.col("_vy")))
            name = F.coalesce(*(F.when(F.col("kind") == i, k) for i, k in wanted.items()))
            out.append(sums.select(name.alias("kind"), r.alias("spearman")).where("kind is not null"))
    return _spread(reduce(DataFrame.union, out), kinds)


def dataset_audit(rows: DataFrame, key: str, channel: str, allowed: DataFrame, label: str) -> DataFrame:
    """(check, detail, n): rows and repeated keys, rows of channels that aren't allowed, and the label balance."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    keys = n.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"))
    line = lambda check, detail, c: F.struct(F.lit(check).alias("check"), detail.cast("string").alias("detail"), c.cast("long").alias("n"))
    a = keys.select(F.inline(F.array(line("rows", F.lit(None), F.col("rows")), line("repeated keys", F.lit(None), F.col("repeated")))))
    odd = rows.join(allowed.select(channel).distinct(), channel, "left_anti").groupBy(channel).agg(F.count("*").alias("n"))
    b = odd.select(F.lit("unknown channel"), F.col(channel).cast("string"), "n")
    return a.union(b).union(rows.groupBy(label).agg(F.count("*").alias("n")).select(F.lit("label"), F.col(label).cast("string"), "n"))


def bundle_violations(left: DataFrame, right: DataFrame, key: str, value: str, texts: Sequence[str], secret: str, tolerance: float = 1e-9) -> DataFrame:
    """(check, key): ids that only one table has, values that differ or aren't finite, blank texts, and texts with a secret-like token."""
    a, b = left.select(key, F.col(value).alias("_a"), *texts), right.select(key, F.col(value).alias("_b"))
    both = a.join(b, key, "full_outer")
    left_in, right_in = left.select(key).withColumn("_l", F.lit(True)).distinct(), right.select(key).withColumn("_r", F.lit(True)).distinct()
    both = both.join(left_in, key, "left").join(right_in, key, "left")
    has_left = F.col("_l").isNotNull()
    checks: list[Column] = [
        F.when(~has_left, "only right"), F.when(F.col("_r").isNull(), "only left"),
        F.when(has_left & F.col("_r").isNotNull() & ~F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= tolerance, F.lit(False)), "values differ"),
        *(F.when(has_left & (F.coalesce(F.trim(t), F.lit("")) == ""), f"blank {t}") for t in texts),
        *(F.when(F.col(t).rlike(secret), f"secret in {t}") for t in texts),
    ]
    return both.select(F.explode(F.array_compact(F.array(*checks))).alias("check"), key)
