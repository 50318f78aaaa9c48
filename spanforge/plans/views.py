"""Timelines, predictions and pools made from the given tables, in Spark and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per user: 30 days of events squeezed into 4 320 seconds, in whole milliseconds."""
    base = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 600000")
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("longform_id"), F.col("event_id").alias("scene_id"), "event_type", "value",
        base.alias("start_ms"), (base + F.round(F.col("value") * 1000).cast("long")).alias("end_ms"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(spark, sf_dir).where("event_type = 'purchase' and value >= 5")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("longform_id").orderBy(F.desc("value"), "scene_id")
    return timeline(spark, sf_dir).where("event_type in ('view', 'click', 'signup')").withColumn("rank", F.row_number().over(by))


def speeches(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    """Utterances of a conversation, 60 ms a character and 1.5 s between turns; dealt by conversation to ``tasks``, if given."""
    rows = load(spark, sf_dir, "conversations")
    rows = rows.repartition(tasks, "conv_id") if tasks else rows
    upto = F.sum(F.char_length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.withColumn("c", upto).select(
        F.col("conv_id").alias("longform_id"), F.col("turn").alias("speech_id"), F.col("role").alias("speaker_id"), "text",
        (60 * (F.col("c") - F.char_length("text")) + 1500 * F.col("turn")).alias("start_ms"),
        (60 * F.col("c") + 1500 * F.col("turn")).alias("end_ms"),
    )


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("pool_id"), F.col("o_orderkey").alias("candidate_id"), F.col("o_totalprice").cast("double").alias("score"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_gold"), F.row_number().over(by).alias("baseline_rank"),
        F.col("o_orderstatus").alias("bucket"),
    )


#: Rows of a given table that a task groups, joins or sorts at once, about.
TASK_ROWS = 1_000_000


def tasks_for(rows: DataFrame) -> int:
    """A number of tasks that grows with the rows, which are counted from the footers of their files; Spark's own number of partitions stays as it is however many there are."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per candidate and repeat; null where the judge abstained.

    Rows are dealt by candidate once, which the groups of both, and those of a candidate, go by. The largest flag is a number, as those of texts are sorted for.
    """
    lines = load(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_returnflag") > "R", 2).when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") < "R", 0)
    dealt = lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", flag.alias("flag")).repartition(tasks_for(lines), "l_orderkey")
    rows = dealt.groupBy("l_orderkey", "l_linenumber").agg(
        F.max(F.col("l_quantity").cast("double")).alias("q"), F.max("flag").alias("flag"), F.max(F.col("l_discount").cast("double")).alias("d"))
    return rows.select(
        F.col("l_orderkey").alias("candidate_id"), F.col("l_linenumber").alias("repeat"),
        F.when(F.col("flag") != 1, 2 * F.col("q")).alias("score"), F.when(F.col("flag") != 1, 1000 * F.col("d")).alias("second"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text candidates: the channel is the source, the target the average-rank percentile of length in it."""
    by = Window.partitionBy("source")
    low = F.rank().over(by.orderBy("n_chars"))
    tied = F.count("*").over(Window.partitionBy("source", "n_chars"))
    n = F.count("*").over(by)
    marks = F.length(F.regexp_replace("text", "[^?,]", ""))
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("candidate_id"), F.expr("doc_id div 3").alias("longform_id"), F.col("source").alias("channel"), "lang", "text",
        F.when(n > 1, (low + (tied - 1) / 2.0 - 1) / (n - 1)).otherwise(0.5).alias("target"), marks.cast("double").alias("score"),
    )


#: The same as common table expressions of DuckDB SQL.
SQL = {
    "timeline": """timeline as (
        select user_id as longform_id, event_id as scene_id, event_type, value,
               (epoch_us(ts) - 1704067200000000) // 600000 as start_ms,
               (epoch_us(ts) - 1704067200000000) // 600000 + cast(round(value * 1000) as bigint) as end_ms from events)""",
    "gold": "gold as (select * from timeline where event_type = 'purchase' and value >= 5)",
    "pred": """pred as (
        select *, row_number() over (partition by longform_id order by value desc, scene_id) as rank
        from timeline where event_type in ('view', 'click', 'signup'))""",
    "speech": """speech as (
        select conv_id as longform_id, turn as speech_id, role as speaker_id, text,
               60 * (c - length(text)) + 1500 * turn as start_ms, 60 * c + 1500 * turn as end_ms
        from (select *, cast(sum(length(text)) over (partition by conv_id order by turn) as bigint) as c from conversations))""",
    "pool": """pool as (
        select o_custkey as pool_id, o_orderkey as candidate_id, cast(o_totalprice as double) as score, o_orderpriority = '1-URGENT' as is_gold,
               row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as baseline_rank, o_orderstatus as bucket from orders)""",
    "judge": """judge as (
        select l_orderkey as candidate_id, l_linenumber as repeat, case when flag <> 'R' then 2 * q end as score, case when flag <> 'R' then 1000 * d end as second
        from (select l_orderkey, l_linenumber, max(cast(l_quantity as double)) as q, max(l_returnflag) as flag, max(cast(l_discount as double)) as d from lineitem group by all))""",
    "texts": """texts as (
        select doc_id as candidate_id, doc_id // 3 as longform_id, source as channel, lang, text,
               case when count(*) over (partition by source) > 1 then
                   (rank() over (partition by source order by n_chars) + (count(*) over (partition by source, n_chars) - 1) / 2.0 - 1)
                   / (count(*) over (partition by source) - 1) else 0.5 end as target,
               cast(length(regexp_replace(text, '[^?,]', '', 'g')) as double) as score from documents)""",
}
#: What each view is made from.
NEEDS = {"gold": ["timeline"], "pred": ["timeline"]}


def with_views(*names: str) -> str:
    """``with`` clause of the named views."""
    wanted: list[str] = []
    for name in names:
        for x in [*NEEDS.get(name, []), name]:
            if x not in wanted:
                wanted.append(x)
    return "with " + ", ".join(SQL[x] for x in wanted)
