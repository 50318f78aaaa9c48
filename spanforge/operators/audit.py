"""Checks, splits and controls of evaluation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import dense_numbers


def key_audit(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, blank keys and keys that repeat."""
    text = F.trim(F.col(key).cast("string"))
    by_key = rows.groupBy(key).agg(F.count("*").alias("n"), F.first(text).alias("t"))
    return by_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(key).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(F.coalesce(F.col("t"), F.lit("")) == "", F.col("n"))), F.lit(0)).alias("blank"), F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("repeated"))


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """``rows``; a blank or repeated key is an error when its row is read."""
    n = F.count("*").over(Window.partitionBy(key))
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    bad = F.raise_error(F.concat(F.lit(f"blank or repeated {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    return rows.withColumn("_n", n).where(F.when(blank | (F.col("_n") > 1), bad).otherwise(True)).drop("_n")


def id_difference(left: DataFrame, right: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """A row per side: number of its ids that the other lacks, and the first few of them."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    ids = a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))
    placed = ids.withColumn("_n", F.row_number().over(Window.partitionBy("side").orderBy(key)))
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= examples, F.col(key)))), lambda x: x.cast("string")), ",")
    return placed.groupBy("side").agg(F.count("*").alias("n"), first.alias("examples"))


def leak_report(rows: DataFrame, id_col: str, forbidden: Sequence[str], required: Sequence[str], ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(id, reason): rows with a value in a forbidden column, a blank required text, or a number out of range or missing."""
    reasons: list[Column] = []
    for c in forbidden:
        if c in rows.columns:
            reasons.append(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", f"forbidden {c}"))
    for c in required:
        reasons.append(F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", f"blank {c}"))
    for c, (low, high) in ranges.items():
        reasons.append(F.when(~F.coalesce(F.col(c).between(low, high), F.lit(False)), f"range {c}"))
    return rows.select(id_col, F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


def term_leaks(rows: DataFrame, id_col: str, text: str, terms: Sequence[str], low: int = 45, high: int = 150) -> DataFrame:
    """(id, leak, length_ok): whether a text holds one of the terms as a word, and whether its solid length is within bounds."""
    pattern = r"(?iU)\b(" + "|".join(terms) + r")\b"
    solid = F.char_length(F.regexp_replace(F.col(text), r"(?U)\s", ""))
    return rows.select(id_col, F.col(text).rlike(pattern).alias("leak"), solid.between(low, high).alias("length_ok"))


def normalize_names(rows: DataFrame, names: DataFrame, column: str, raw: str, canonical: str) -> DataFrame:
    """``rows`` with ``column`` replaced by its canonical name where the table has one."""
    table = names.select(F.col(raw).alias("_raw"), F.col(canonical).alias("_name"))
    return rows.join(table, rows[column] == table["_raw"], "left").withColumn(column, F.coalesce("_name", column)).select(*rows.columns)


def grouped_folds(rows: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    """``rows`` with ``fold`` 1 to ``folds``: whole groups, in an order shuffled by a hash of the seed, in folds of nearly equal numbers of groups. Fewer than two groups are an error when a row is read."""
    position = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")), 256)
    placed = dense_numbers(rows.select(group).distinct().withColumn("_position", position), ["_position", group], "_place")
    total = placed.agg(F.count("*").alias("_n"))
    short, longer = F.expr(f"_n div {folds}"), F.expr(f"_n % {folds}")
    # the first folds have a group more, as ntile has it
    fold = F.when(F.col("_place") <= longer * (short + 1), F.ceil(F.col("_place") / (short + 1))).otherwise(longer + F.ceil((F.col("_place") - longer * (short + 1)) / F.nullif(short, F.lit(0))))
    few = F.raise_error(F.lit(f"fewer than two values of {group}")).cast("int")
    ordered = placed.join(F.broadcast(total)).select(group, F.when(F.col("_n") < 2, few).otherwise(fold.cast("int")).alias("fold"))
    return rows.join(ordered, group)


def group_split(rows: DataFrame, group: str, label: str, dev_fraction: float, seed: int, existing: str | None = None) -> DataFrame:
    """(group, rows, role): dev or locked for whole groups, about ``dev_fraction`` of the rows of each label mix.

    Groups of one label signature are put in an order of hashes, and those whose
    rows before them fill less than the share are dev; so no group crosses roles and both keep the label balance.
    Roles in the column ``existing`` stay and count toward the share; a group that has both is an error when it is read.
    """
    have = F.collect_set(existing) if existing else F.array().cast("array<string>")
    g = rows.groupBy(group).agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set(F.col(label).cast("string"))), "+").alias("signature"), have.alias("_roles"))
    if existing:
        bad = F.raise_error(F.concat(F.lit(f"{group} has two roles: "), F.coalesce(F.col(group).cast("string"), F.lit("null")))).cast("string")
        g = g.withColumn("_role", F.when(F.size("_roles") > 1, bad).otherwise(F.get("_roles", F.lit(0))))
        taken = F.coalesce(F.sum(F.when(F.col("_role") == "dev", F.col("rows"))).over(Window.partitionBy("signature")), F.lit(0))
        g = g.withColumn("_taken", taken)
    else:
        g = g.withColumns({"_role": F.lit(None).cast("string"), "_taken": F.lit(0)})
    position = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string"))), 1, 16)
    w = Window.partitionBy("signature").orderBy("position", group)
    free = F.when(F.col("_role").isNull(), F.col("rows")).otherwise(0)
    before = F.coalesce(F.sum(free).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_taken")
    total = F.sum("rows").over(Window.partitionBy("signature"))
    placed = g.withColumn("position", position).withColumn("role", F.coalesce("_role", F.when(before < total * dev_fraction, "dev").otherwise("locked")))
    return placed.select(group, "rows", "signature", "role")


def blind_and_private(rows: DataFrame, id_col: str, private: Sequence[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """A blind table in hash order without private columns, and a keyed table of those with the suffix ``_PRIVATE``."""
    key = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")), 256)
    blind = rows.select(*(c for c in rows.columns if c not in private), key.alias("blind_key")).orderBy("blind_key")
    return blind, rows.select(key.alias("blind_key"), id_col, *(F.col(c).alias(f"{c}_PRIVATE") for c in private))


def blind_failures(rows: DataFrame, id_col: str, required: Sequence[str], private: Sequence[str]) -> DataFrame:
    """(id, reason): rows that can't be in a blind table: a repeated or missing id, a blank required text, or no private value to keep apart."""
    n = F.count("*").over(Window.partitionBy(id_col))
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    reasons = [F.when(F.col(id_col).isNull(), "missing id"), F.when(F.col(id_col).isNotNull() & (F.col("_n") > 1), "repeated id"),
               *(F.when(blank(c), f"blank {c}") for c in required), *(F.when(F.col(c).isNull(), f"missing {c}") for c in private)]
    return rows.withColumn("_n", n).select(id_col, F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


def drop_features(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``rows`` without the named columns; a name that isn't there is an error."""
    if missing := set(names) - set(rows.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return rows.drop(*names)


def source_shortcut(rows: DataFrame, source: str, label: str, role: str, dev: str = "dev") -> DataFrame:
    """``rows`` outside of dev with ``predicted``: the commonest dev label of their source, ties by name, else of all of dev."""
    counts = rows.where(F.col(role) == dev).groupBy(source, label).agg(F.count("*").alias("n"))
    best = lambda df: df.agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("p"))
    by_source = best(counts.groupBy(source)).withColumnRenamed("p", "by_source")
    overall = best(counts.groupBy(label).agg(F.sum("n").alias("n")).groupBy()).withColumnRenamed("p", "overall")
    return rows.where(F.col(role) != dev).join(by_source, source, "left").join(F.broadcast(overall), how="left").withColumn(
        "predicted", F.coalesce("by_source", "overall")).drop("by_source", "overall")


def gate_report(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Gates (metric, minimum, kind) with the observed value and whether it passes: at least the minimum, or above it for lower bounds."""
    joined = gates.join(metrics, "metric", "left")
    value = F.when(F.isnan("value") | (F.abs("value") == float("inf")), None).otherwise(F.col("value"))
    passed = F.when(F.col("kind") == "lower_bound", value > F.col("minimum")).otherwise(value >= F.col("minimum"))
    return joined.select("metric", "kind", "minimum", value.alias("value"), F.coalesce(passed, F.lit(False)).alias("passed"))


def acceptance(metrics: DataFrame, gates: DataFrame, fresh: bool) -> DataFrame:
    """One row: whether the size gates and the statistical gates pass, whether the holdout is fresh, the names of gates that fail, and the status.

    Gates are as in :func:`gate_report`; those of kind size are minimum numbers of rows. Too few rows are insufficient; a failed gate is rejected; all passed on rows that were
    seen before is an internal_pass, and accepted takes a holdout that is confirmed fresh. Without gates of a kind, that kind passes; without any, nothing is accepted.
    """
    report = gate_report(metrics, gates)
    sizes = F.coalesce(F.bool_and(F.when(F.col("kind") == "size", F.col("passed"))), F.lit(True))
    others = F.coalesce(F.bool_and(F.when(F.col("kind") != "size", F.col("passed"))), F.lit(True))
    failed = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.concat_ws(":", "kind", "metric")))), ",")
    one = report.agg(F.count("*").alias("_gates"), sizes.alias("sizes_passed"), others.alias("gates_passed"), failed.alias("failed")).withColumn("fresh", F.lit(fresh))
    status = F.when(F.col("_gates") == 0, "rejected").when(~F.col("sizes_passed"), "insufficient").when(~F.col("gates_passed"), "rejected").when(~F.col("fresh"), "internal_pass").otherwise("accepted")
    return one.withColumn("status", status).drop("_gates")


def bootstrap_draws(groups: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, slot, group): each replicate draws as many groups as there are, with replacement, by hashes that any engine can repeat.

    Groups get dense numbers from 0 in their order; draw (replicate, slot) takes
    the number that 32 bits of its MD5 leave when divided by the number of groups.
    """
    numbered = dense_numbers(groups.select(group).distinct(), [group], "number").withColumn("number", (F.col("number") - 1).cast("int"))
    n = numbered.count()
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long")
    slots = groups.sparkSession.range(replicates * n).select((F.col("id") / F.lit(max(n, 1))).cast("int").alias("replicate"), (F.col("id") % F.lit(max(n, 1))).cast("int").alias("slot"))
    return slots.withColumn("number", (draw % F.lit(max(n, 1))).cast("int")).join(numbered, "number").select("replicate", "slot", group)


def bootstrap_mean(rows: DataFrame, group: str, value: str, replicates: int, seed: int) -> DataFrame:
    """One row: mean of ``value`` and the 2.5, 50 and 97.5 % quantiles of its means over resampled groups.

    Each group is reduced to a sum and a count before it is drawn, so the draws join a small row per group.
    """
    sums = rows.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = bootstrap_draws(sums, group, replicates, seed).join(sums, group)
    means = drawn.groupBy("replicate").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
    out = means.agg(F.percentile("m", [0.025, 0.5, 0.975]).alias("q"), F.count("m").alias("valid"))
    total = sums.agg((F.sum("s") / F.sum("n")).alias("mean"))
    return total.crossJoin(F.broadcast(out)).select("mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"), "valid")
