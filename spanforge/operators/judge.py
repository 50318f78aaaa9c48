"""Tables before and after a scoring judge: tasks, responses, their validation and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def task_table(candidates: DataFrame, id_col: str, fields: dict[str, int], run_id: str, prompt: str, repeats: int) -> DataFrame:
    """(id, repeat, payload, request_key, tokens): a request per candidate and repeat, its text fields cut to their caps.

    The key is the SHA-256 of the request with fields in alphabetical order, so equal requests have equal keys.
    """
    cut = F.struct(F.col(id_col).cast("string").alias(id_col), *(F.substring(c, 1, n).alias(c) for c, n in sorted(fields.items())))
    rows = candidates.select(id_col, F.to_json(cut).alias("payload")).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    request = F.to_json(F.struct("payload", F.lit(prompt).alias("prompt"), "repeat", F.lit(run_id).alias("run_id")))
    return rows.withColumn("request_key", F.sha2(request, 256)).withColumn("tokens", F.greatest(F.lit(1), F.ceil(F.char_length("payload") / 4)).cast("long"))


def cache_lookup(tasks: DataFrame, responses: DataFrame, key: str = "request_key") -> tuple[DataFrame, DataFrame]:
    """(hits, todo): tasks with their stored response, and tasks without one."""
    return tasks.join(responses, key), tasks.join(responses.select(key).distinct(), key, "left_anti")


def check_responses(rows: DataFrame, id_col: str, dimensions: Sequence[str], evidence: Sequence[str], allowed_flags: Sequence[str]) -> DataFrame:
    """``rows`` with ``reason``: null for a valid response, else the first rule that it breaks.

    The answer's id must match, the verdict be score or abstain, evidence be 1
    to 5, and each dimension 0 to 4, or null throughout for an abstention; flags must be known.
    """
    no: list[Column] = [
        F.when(~F.coalesce(F.col("answer_id") == F.col(id_col), F.lit(False)), "id differs"),
        F.when(~F.coalesce(F.col("verdict").isin("score", "abstain"), F.lit(False)), "unknown verdict"),
    ]
    no += [F.when(~F.coalesce(F.col(c).between(1, 5), F.lit(False)), f"evidence {c}") for c in evidence]
    no += [F.when((F.col("verdict") == "abstain") & F.col(c).isNotNull(), f"abstained with {c}") for c in dimensions]
    no += [F.when((F.col("verdict") == "score") & ~F.coalesce(F.col(c).between(0, 4), F.lit(False)), f"dimension {c}") for c in dimensions]
    known = F.array(*(F.lit(f) for f in allowed_flags)).cast("array<string>")
    no.append(F.when(F.size(F.array_except(F.coalesce("flags", F.array().cast("array<string>")), known)) > 0, "unknown flag"))
    return rows.withColumn("reason", F.coalesce(*no))


def failure_flags(dimensions: dict[str, str], intelligibility: str) -> Column:
    """Flags in order for dimensions of 1 or less, and ``degraded`` for an intelligibility of 2 or less."""
    flags = [F.when(F.col(c) <= 1, flag) for c, flag in dimensions.items()]
    return F.array_distinct(F.array_compact(F.array(*flags, F.when(F.col(intelligibility) <= 2, "degraded"))))


def mapped_flags(flags: str | Column, names: dict[str, str], allowed: Sequence[str]) -> Column:
    """The flags under their mapped names, those that are allowed, each once and in order."""
    f = F.coalesce(F.col(flags) if isinstance(flags, str) else flags, F.array().cast("array<string>"))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else None
    renamed = F.transform(f, lambda x: F.coalesce(F.try_element_at(table, x), x)) if names else f
    return F.array_distinct(F.filter(renamed, lambda x: x.isin(*allowed)))


def group_payload(candidates: DataFrame, key: str, id_col: str, fields: dict[str, int], order: Sequence[str]) -> DataFrame:
    """(key, candidates, payload, tokens): one JSON request per recording, its candidates in ``order`` with their text fields cut to the caps."""
    part = F.struct(F.col(id_col).cast("string").alias(id_col), *(F.substring(c, 1, n).alias(c) for c, n in sorted(fields.items())))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, part.alias("_part")))), lambda x: x["_part"])
    rows = candidates.groupBy(key).agg(F.count("*").alias("candidates"), listed.alias("_list"))
    rows = rows.select(key, "candidates", F.to_json(F.struct("_list")).alias("_json")).withColumn("payload", F.expr("substring(_json, 10, length(_json) - 10)"))
    return rows.select(key, "candidates", "payload", F.greatest(F.lit(1), F.ceil(F.char_length("payload") / 4)).cast("long").alias("tokens"))


def choices(rows: DataFrame, valid: DataFrame, key: str, k: int) -> DataFrame:
    """(key, place, id): the ids of the array ``choices`` of (id, rank) that are valid for the key, each once, by rank, up to ``k``."""
    from pyspark.sql import Window

    listed = rows.select(key, F.posexplode("choices").alias("at", "c")).select(key, "at", F.col("c.id").alias("id"), F.col("c.rank").alias("rank"))
    known = listed.join(valid.select(key, "id").distinct(), [key, "id"], "left_semi")
    first = known.withColumn("_n", F.row_number().over(Window.partitionBy(key, "id").orderBy("at"))).where("_n = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("rank"), "at"))).where(F.col("place") <= k).select(key, "place", "id")


def usage_summary(responses: DataFrame, usage: str, run: str) -> DataFrame:
    """Per run: requests, cache hits, seconds and tokens out of the JSON column ``usage``."""
    tokens = F.get_json_object(usage, "$.total_tokens").try_cast("long")
    return responses.groupBy(run).agg(
        F.count("*").alias("requests"), F.count_if("cached").alias("cache_hits"), F.sum("elapsed").alias("elapsed"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))
