"""Queries of judge tables and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import judge

from .evaluation import query, rounded
from .views import judgments, load, timeline, with_views


@query("""with t as (select doc_id, cast(r as integer) as repeat, to_json({'doc_id': cast(doc_id as varchar), 'lang': left(lang, 8), 'source': left(source, 4)}) as payload from documents cross join (select unnest([1, 2]) as r))
    select doc_id, repeat, cast(payload as varchar) as payload, sha256(cast(to_json({'payload': cast(payload as varchar), 'prompt': 'prompt', 'repeat': repeat, 'run_id': 'run'}) as varchar)) as request_key, greatest(1, cast(ceil(length(payload) / 4.0) as bigint)) as tokens from t""")
def m1_task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.task_table(load(spark, sf_dir, "documents"), "doc_id", {"lang": 8, "source": 4}, "run", "prompt", 2).select("doc_id", "repeat", "payload", "request_key", "tokens")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def m2_requests_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("request_key"))
    stored = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("request_key"))
    return judge.cache_lookup(tasks, stored)[1].select("c_custkey")


_CHECK = """case when l_linenumber % 7 = 0 then 'id differs' when not l_returnflag in ('A', 'N', 'R') then 'unknown verdict'
    when not cast(l_quantity as double) / 10 between 1 and 5 then 'evidence ev'
    when l_returnflag = 'R' and cast(l_tax as double) * 60 > 4 then null when l_returnflag = 'R' then 'abstained with dim'
    when not cast(l_tax as double) * 60 between 0 and 4 then 'dimension dim' end"""


@query(f"select reason, count(*) as n from (select {_CHECK} as reason from lineitem) group by reason")
def m3_response_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = F.col("l_tax").cast("double") * 60
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 7 == 0, -1).otherwise(F.col("l_orderkey")).alias("answer_id"),
        F.when(F.col("l_returnflag") == "R", "abstain").otherwise("score").alias("verdict"), (F.col("l_quantity").cast("double") / 10).alias("ev"),
        F.when((F.col("l_returnflag") == "R") & (tax > 4), None).otherwise(tax).alias("dim"), F.array().cast("array<string>").alias("flags"))
    return judge.check_responses(rows, "id", ["dim"], ["ev"], []).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""{with_views('judge')} select candidate_id, repeat, array_to_string(list_filter([case when second <= 10 then 'weak_hook' end, case when second >= 90 and second / 100 <= 1 then 'weak_end' end, case when score / 20 <= 2 then 'degraded' end], lambda x: x is not null), ',') as flags from judge""")
def f9_failure_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir).withColumns({
        "hook": F.when(F.col("second") <= 10, 1).otherwise(F.when(F.col("second").isNotNull(), 4)), "end": F.when((F.col("second") >= 90) & (F.col("second") / 100 <= 1), 0).otherwise(3), "clear": F.col("score") / 20})
    return j.select("candidate_id", "repeat", F.array_join(judge.failure_flags({"hook": "weak_hook", "end": "weak_end"}, "clear"), ",").alias("flags"))


@query(f"""{with_views('timeline')}, x as (select longform_id, event_type as id, value as rank, row_number() over (partition by longform_id order by start_ms, scene_id) as pos from timeline),
    f as (select * from x where id in ('view', 'click', 'purchase') qualify row_number() over (partition by longform_id, id order by pos) = 1)
    select longform_id, cast(row_number() over (partition by longform_id order by cast(round(rank) as integer) nulls last, pos) as integer) as place, id from f qualify row_number() over (partition by longform_id order by cast(round(rank) as integer) nulls last, pos) <= 2""")
def g18_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir)
    item = F.struct("start_ms", "scene_id", F.struct(F.col("event_type").alias("id"), F.round("value").cast("int").alias("rank")).alias("c"))
    rows = t.groupBy("longform_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.c).alias("choices"))
    valid = t.where("event_type in ('view', 'click', 'purchase')").select("longform_id", F.col("event_type").alias("id"))
    return judge.choices(rows, valid, "longform_id", 2)


@query("""select o_orderstatus as run, count(*) as requests, count(*) filter (o_orderkey % 3 = 0) as cache_hits, round(sum(cast(o_totalprice as double)), 2) as elapsed, cast(sum(o_custkey) as bigint) as tokens from orders group by all""")
def m5_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("run"), (F.col("o_orderkey") % 3 == 0).alias("cached"), F.col("o_totalprice").cast("double").alias("elapsed"), F.to_json(F.struct(F.col("o_custkey").alias("total_tokens"))).alias("usage"))
    return rounded(judge.usage_summary(rows, "usage", "run"), 2)


@query(f"""{with_views('judge')} select candidate_id, repeat, array_to_string(list_distinct_in_order, ',') as flags from (select *, list_filter([case when second <= 20 then 'hook' end, case when score >= 60 then 'end' end, case when score >= 90 then 'end' end], lambda x: x is not null) as f,
    case when second <= 20 and score >= 60 then ['weak_hook', 'end'] when second <= 20 then ['weak_hook'] when score >= 60 then ['end'] else []::varchar[] end as list_distinct_in_order from judge)""")
def f9_mapped_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("second") <= 20, "hook"), F.when(F.col("score") >= 60, "end"), F.when(F.col("score") >= 90, "finish"), F.when(F.col("score") >= 95, "unheard")))
    mapped = judge.mapped_flags(flags, {"hook": "weak_hook", "finish": "end"}, ["weak_hook", "end"])
    return judgments(spark, sf_dir).select("candidate_id", "repeat", F.array_join(mapped, ",").alias("flags"))


@query("""select conv_id, count(*) as candidates, cast(to_json(list({'turn': cast(turn as varchar), 'role': role, 'text': left(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), 30)} order by turn)) as varchar) as payload,
    greatest(1, cast(ceil(length(to_json(list({'turn': cast(turn as varchar), 'role': role, 'text': left(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), 30)} order by turn))) / 4.0) as bigint)) as tokens from conversations group by conv_id""")
def f19_group_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").withColumns({"at": F.col("turn"), "text": F.regexp_replace("text", "[^a-zA-Z ]", "")})
    return judge.group_payload(c, "conv_id", "turn", {"role": 100, "text": 30}, ["at"])
