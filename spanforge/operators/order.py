"""Orders over all rows by ranges of the value and offsets, without a window over all rows in one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps_below(bounds: Column, test: Callable[[Column], Column], most: int = (1 << 25) - 1) -> Column:
    """How many of the sorted ``bounds``, at most ``most``, pass ``test``, which a prefix of them does, by halving."""
    return F.aggregate(F.expr("array(" + ",".join(str(1 << b) for b in range(most.bit_length() - 1, -1, -1)) + ")"), F.lit(0),
                       lambda acc, step: F.when(F.coalesce(test(F.get(bounds, acc + step - 1)), F.lit(False)), acc + step).otherwise(acc))


def _number(rows: DataFrame, column: str) -> Column:
    """A double in the order of the column: of a string its first six bytes."""
    if rows.schema[column].dataType.typeName() == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return F.col(column).cast("double")


def in_ranges(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``_range_<column>`` for each column: about as many ranges of its values as there are shuffle partitions, equal values in one, null in the first."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / parts for i in range(1, parts)] or [0.5]
    found = rows.agg(*(F.percentile_approx(_number(rows, c), cuts, 10_000).alias(f"b{i}") for i, c in enumerate(columns))).first()
    out = {}
    for i, c in enumerate(columns):
        bounds = F.array(*(F.lit(float(b)) for b in sorted(set(found[i] or [])))).cast("array<double>")
        out[f"_range_{c}"] = F.when(F.col(c).isNull(), -1).otherwise(steps_below(bounds, lambda b, c=c: b < _number(rows, c), max(1, parts)))
    return rows.withColumns(out)


def _offsets(placed: DataFrame, part: str, out: str, weight: Column | None = None, descending: bool = False) -> DataFrame:
    """(part, out): rows, or weight, in the ranges before; a row for each range."""
    sizes = placed.groupBy(part).agg(F.sum(weight if weight is not None else F.lit(1)).alias("_n"))
    before = Window.orderBy(F.desc(part) if descending else part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(out))


def dense_numbers(rows: DataFrame, order: Sequence[str], out: str, descending: bool = False) -> DataFrame:
    """``rows`` with ``out``: 1, 2, ... in the order of the columns, the first of them descending if so said, null first (last if descending).

    Rows of one range of the first column are numbered together; equal values of that column are in one range.
    """
    first, rest = order[0], order[1:]
    part = f"_range_{first}"
    placed = in_ranges(rows, [first])
    by = Window.partitionBy(part).orderBy(F.desc(first) if descending else first, *rest)
    offsets = _offsets(placed, part, "_before", descending=descending)
    numbered = placed.withColumn(out, F.row_number().over(by)).join(F.broadcast(offsets), part)
    return numbered.withColumn(out, F.col(out) + F.col("_before")).select(*rows.columns, out)


def average_ranks(rows: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """``rows`` with, for each ``{out: column}``, the 1-based rank over all rows in which ties share the mean of their places."""
    columns = sorted(set(values.values()))
    placed = in_ranges(rows, columns)
    out = placed
    for c in columns:
        part = f"_range_{c}"
        local = F.rank().over(Window.partitionBy(part).orderBy(c)) + (F.count("*").over(Window.partitionBy(part, c)) - 1) / 2.0
        out = out.withColumn(f"_local_{c}", local).join(F.broadcast(_offsets(placed, part, f"_before_{c}")), part)
    return out.select(*rows.columns, *((F.col(f"_local_{c}") + F.col(f"_before_{c}")).alias(o) for o, c in values.items()))


def ranks_within(rows: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """``rows`` with ``out``: 1-based rank within the keys in which ties share the mean of their places, null first. A key's rows are ranked by ranges of the column, which are the same for all keys."""
    part = f"_range_{column}"
    placed = in_ranges(rows, [column])
    sizes = placed.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(part).alias("_p"), before.alias("_before"))
    local = F.rank().over(Window.partitionBy(*keys, part).orderBy(column)) + (F.count("*").over(Window.partitionBy(*keys, part, column)) - 1) / 2.0
    ranked = placed.withColumn(out, local)
    same = [*(ranked[k].eqNullSafe(offsets[f"_k{i}"]) for i, k in enumerate(keys)), ranked[part] == offsets["_p"]]
    return ranked.join(offsets, same).withColumn(out, F.col(out) + F.col("_before")).select(*rows.columns, out)


def numbers_within(rows: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """``rows`` with ``out``, 1, 2, ... within the keys in the order of the columns, null first, and ``_size``, the rows of the keys; keys aren't null. A key's rows are numbered by ranges of the first column."""
    part = f"_range_{order[0]}"
    placed = in_ranges(rows, [order[0]])
    w = Window.partitionBy(*keys)
    sizes = placed.groupBy(*keys, part).agg(F.count("*").alias("_n"))
    offsets = sizes.select(*keys, part, (F.sum("_n").over(w.orderBy(part)) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_size"))
    numbered = placed.withColumn(out, F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))).join(offsets, [*keys, part])
    return numbered.withColumn(out, F.col(out) + F.col("_before")).select(*rows.columns, out, "_size")


def tile(place: Column, size: Column, tiles: int) -> Column:
    """The tile 1 to ``tiles`` of a place from 1, as ntile has it: the first ones have a row more."""
    short, longer = F.floor(size / F.lit(tiles)), size % F.lit(tiles)
    return F.when(place <= longer * (short + 1), F.ceil(place / (short + 1))).otherwise(longer + F.ceil((place - longer * (short + 1)) / F.nullif(short, F.lit(0)))).cast("int")
