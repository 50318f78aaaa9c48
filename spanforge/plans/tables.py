"""Queries of text expressions, audits, splits and controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import text as tx
from spanforge.operators import audit

from .evaluation import query, rounded
from .views import judgments, load, pools, texts, timeline, with_views


@query(f"""{with_views('timeline')}, t as (select scene_id, start_ms // 1000 as s from timeline)
    select scene_id, case when s >= 3600 then (s // 3600) || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0')
        else (s // 60) || ':' || lpad((s % 60)::varchar, 2, '0') end as clock, cast(s as double) as seconds from t""")
def b1_b2_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir).select("scene_id", tx.seconds_to_clock(F.col("start_ms") / 1000).alias("clock"))
    return t.withColumn("seconds", tx.clock_to_seconds("clock"))


@query("""select event_id, coalesce(try_cast(nullif(trim(substr(props, 1, 3)), '') as double), -1) as loose, try_cast(cast(value as varchar) as double) as exact from events""")
def b3_parse_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumns({"p": F.substring("props", 1, 3), "v": F.col("value").cast("string")}).select(
        "event_id", tx.parse_number("p", -1.0).alias("loose"), tx.parse_number("v").alias("exact"))


@query("""select o_orderkey, 'C_' || substr(sha256(o_custkey || '|' || o_orderkey), 1, 14) as content_id,
    round(cast(('0x' || substr(sha256('s:' || o_orderkey), 1, 16))::ubigint as double) / 18446744073709551615.0, 9) as u from orders""")
def b10_b11_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", tx.content_id("C_", "o_custkey", "o_orderkey").alias("content_id"), F.round(tx.hash_uniform("s", "o_orderkey"), 9).alias("u"))


@query("""select o_orderkey, cast(o_custkey as varchar) as owner, o_orderstatus as status, cast(null as varchar) as absent from orders""")
def b13_note_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("owner="), "o_custkey", F.lit("; status = "), "o_orderstatus").alias("notes"))
    return n.select("o_orderkey", tx.note_value("notes", "owner").alias("owner"), tx.note_value("notes", "status").alias("status"), tx.note_value("notes", "absent").alias("absent"))


@query("""select doc_id, greatest(1, cast(ceil(length(text) / 4.0) as bigint)) as tokens, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as latin,
    round(case when length(regexp_replace(text, '\\s', '', 'g')) > 0 then length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '\\s', '', 'g')) else 0 end, 6) as latin_share,
    case when length(regexp_replace(left(text, 20000), '[^äöüß]', '', 'g')) >= 20 and length(regexp_replace(left(text, 20000), '[^äöüß]', '', 'g')) / length(regexp_replace(left(text, 20000), '\\s', '', 'g')) >= 0.02 then 'de'
         when length(regexp_replace(left(text, 20000), '[^A-Za-z]', '', 'g')) >= 40 and length(regexp_replace(left(text, 20000), '[^A-Za-z]', '', 'g')) / length(regexp_replace(left(text, 20000), '\\s', '', 'g')) >= 0 then 'latin' else 'other' end as language
    from documents""")
def c4_c6_script_and_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = [("de", "äöüß", 20, 0.02), ("latin", "A-Za-z", 40, 0.0)]
    return load(spark, sf_dir, "documents").select(
        "doc_id", tx.token_estimate("text").alias("tokens"), tx.count_class("text", "A-Za-z").alias("latin"), F.round(tx.class_share("text", "A-Za-z"), 6).alias("latin_share"),
        tx.detect_language("text", scripts, "other").alias("language"))


@query("""select doc_id, round(2.0 * (length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 - 0.5 * (length(lower(text)) - length(replace(lower(text), 'un', ''))) / 2, 6) as keywords,
    cast(contains(text, 'The') as integer) + cast(contains(text, 'und') as integer) + cast(contains(text, 'http') as integer) as present,
    case when a >= 6 and a >= 1.35 * b then 'lecture' when b >= 4 and b >= 0.75 * a then 'variety' else 'general' end as genre
    from (select *, (length(lower(left(text, 50000))) - length(replace(lower(left(text, 50000)), 'tion', ''))) / 4.0 as a, (length(lower(left(text, 50000))) - length(replace(lower(left(text, 50000)), 'ung', ''))) / 3.0 as b from documents)""")
def c7_c9_lexicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(load(spark, sf_dir, "documents").select(
        "doc_id", tx.keyword_score("text", {"the": 2.0, "un": -0.5}).alias("keywords"), tx.terms_present("text", ["The", "und", "http"]).alias("present"),
        tx.genre("text", {"tion": 1.0}, {"ung": 1.0}).alias("genre")))


@query("""select doc_id, length(t) as chars, case when t = '' then 0 else length(regexp_replace(t, '[^\\n]', '', 'g')) + 1 end as lines, length(regexp_replace(t, '[^?]', '', 'g')) as questions,
    length(regexp_replace(t, '[^!]', '', 'g')) as exclamations, regexp_matches(t, '[0-9]') as has_digit, length(regexp_replace(t, '[^\\[\\]()]', '', 'g')) as brackets, round(ln(1 + length(t)), 6) as log_chars,
    len(list_filter(regexp_split_to_array(t, '\\s+'), lambda q: q <> '')) as words, length(trim(t)) < 8 as too_short
    from (select doc_id, coalesce(text, '') as t from documents)""")
def c11_c13_text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tx.text_statistics("text")
    return rounded(load(spark, sf_dir, "documents").select("doc_id", *(s[c].alias(c) for c in ("chars", "lines", "questions", "exclamations", "has_digit", "brackets", "log_chars", "too_short")), s["words"].cast("long").alias("words")))


@query("""select conv_id, count(*) filter (role <> before) as turns from (select *, lag(role) over (partition by conv_id order by turn) as before from conversations) group by conv_id""")
def c11_speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role)
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles.alias("roles"))
    return c.select("conv_id", tx.speaker_turns("roles").cast("long").alias("turns"))


@query("""select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as compacted, right(regexp_replace(text, '(?m)[ \\t]+$', '', 'g'), 40) as before, left(regexp_replace(text, '(?m)[ \\t]+$', '', 'g'), 40) as after,
    '[ROLE]' || chr(10) || role || chr(10) || '[TEXT]' || chr(10) || trim(text) as tagged from conversations""")
def c14_c17_text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.compact("text").alias("compacted"), tx.context_near("text", "before", 40).alias("before"), tx.context_near("text", "after", 40).alias("after"),
        tx.tagged({"ROLE": "role", "TEXT": "text"}).alias("tagged"))


@query(f"""{with_views('judge')} select candidate_id, repeat, case when score >= 75 then 'strong' when score >= 50 then 'adequate' when score is not null then 'weak' end as band,
    case when score <= 20 then 'neg' when score >= 80 then 'pos' when score is not null then 'mid' end as label, round(25 * (0.6 * score / 25 + 0.4 * second / 25), 4) as rubric from judge""")
def f8_f13_f14_score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir).withColumns({"a": F.col("score") / 25, "b": F.col("second") / 25})
    return j.select("candidate_id", "repeat", tx.band("score").alias("band"), tx.percentile_label("score").alias("label"), tx.rubric_score({"a": "a", "b": "b"}, {"a": 0.6, "b": 0.4}).alias("rubric"))


@query("""select s_suppkey, round(sqrt((case when s_nationkey % 3 = 0 then 1.0 when s_nationkey % 3 = 1 then 0.85 else 0.8 end) * (case when s_nationkey % 2 = 0 then 0.65 else 0.9 end)), 6) as weight from supplier""")
def f17_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").withColumns({
        "a": F.when(F.col("s_nationkey") % 3 == 0, "high").when(F.col("s_nationkey") % 3 == 1, "Medium ").otherwise("?"), "b": F.when(F.col("s_nationkey") % 2 == 0, "low").otherwise("manual")})
    return s.select("s_suppkey", F.round(tx.reliability("a", "b"), 6).alias("weight"))


@query(f"""{with_views('timeline')}, t as (select scene_id, start_ms / 1000.0 as s, end_ms / 1000.0 as e, value from timeline),
    n as (select scene_id, s, e, least(greatest(s - 5, s - 2), e + 30) as a, least(greatest(e + value, s - 2), e + 30) as b from t)
    select scene_id, round(case when b - a between 15 and 90 then a else s end, 6) as start, round(case when b - a between 15 and 90 then b else e end, 6) as end,
           abs(case when b - a between 15 and 90 then a else s end - s) > 0.001 or abs(case when b - a between 15 and 90 then b else e end - e) > 0.001 as adjusted from n""")
def f15_adjusted_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir).select("scene_id", "value", (F.col("start_ms") / 1000.0).alias("s"), (F.col("end_ms") / 1000.0).alias("e"))
    out = tx.bounded_adjustment("s", "e", F.col("s") - 5, F.col("e") + F.col("value"), F.col("s") - 2, F.col("e") + 30)
    return rounded(t.select("scene_id", *(c.alias(n) for n, c in out.items())))


@query("select count(*) as rows, count(distinct o_custkey) as distinct_keys, cast(0 as bigint) as blank, (select count(*) from (select o_custkey from orders group by o_custkey having count(*) > 1)) as repeated from orders")
def s1_key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.key_audit(load(spark, sf_dir, "orders"), "o_custkey")


@query("""with l as (select distinct c_custkey as k from customer), r as (select distinct o_custkey + 5 as k from orders where o_orderstatus = 'P'),
    x as (select k, 'left_only' as side from l where k not in (select k from r) union all select k, 'right_only' from r where k not in (select k from l)),
    n as (select *, row_number() over (partition by side order by k) as n from x)
    select side, count(*) as n, string_agg(cast(k as varchar), ',' order by k) filter (n <= 5) as examples from n group by side""")
def s2_id_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return audit.id_difference(left, load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") + 5).alias("k")), "k")


@query("""select doc_id, unnest(list_filter([case when lang = 'fr' then 'forbidden hint' end, case when trim(coalesce(text, '')) = '' then 'blank text' end, case when not coalesce(n_chars between 100 and 5000, false) then 'range n_chars' end], lambda x: x is not null)) as reason from documents""")
def s3_leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").withColumn("hint", F.when(F.col("lang") == "fr", "x"))
    return audit.leak_report(d, "doc_id", ["hint", "absent"], ["text"], {"n_chars": (100, 5000)})


@query("""with g as (select distinct source from documents), f as (select source, ntile(4) over (order by sha256('3|' || source), source) as fold from g) select doc_id, cast(fold as integer) as fold from documents join f using (source)""")
def s10_grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.grouped_folds(load(spark, sf_dir, "documents"), "source", 4, 3).select("doc_id", "fold")


_SPLIT = """g as (select source, count(*) as rows, string_agg(distinct lang, '+' order by lang) as signature from documents group by source),
    p as (select *, substr(md5('5|' || source), 1, 16) as position from g),
    r as (select source, rows, signature, case when coalesce(sum(rows) over (partition by signature order by position, source rows between unbounded preceding and 1 preceding), 0) < sum(rows) over (partition by signature) * 0.4 then 'dev' else 'locked' end as role from p)"""


@query(f"with {_SPLIT} select * from r")
def s7_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.group_split(load(spark, sf_dir, "documents"), "source", "lang", 0.4, 5)


@query("""with x as (select *, case when doc_id % 3 = 0 then 'dev' else 'locked' end as role from documents), c as (select source, lang, count(*) as n from x where role = 'dev' group by all),
    s as (select source, first(lang order by n desc, lang) as p from c group by source), o as (select first(lang order by n desc, lang) as p from (select lang, sum(n) as n from c group by lang))
    select doc_id, coalesce(s.p, o.p) as predicted, lang from x left join s using (source), o where role <> 'dev'""")
def l6_source_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").withColumn("role", F.when(F.col("doc_id") % 3 == 0, "dev").otherwise("locked"))
    return audit.source_shortcut(d, "source", "lang", "role").select("doc_id", "predicted", "lang")


_DRAWS = """n as (select count(*) as n from s), k as (select source, row_number() over (order by source) - 1 as number from s),
    d as (select r, ('0x' || substr(md5('11|' || r || '|' || t), 1, 8))::bigint % n.n as number from n, range(2000) a(r), range(n.n) b(t)),
    m as (select r, sum(k2.v) / sum(k2.c) as m from d join k using (number) join s k2 using (source) group by r)"""


@query(f"""with s as (select source, sum(n_chars) as v, count(n_chars) as c from documents group by source), {_DRAWS}
    select round((select sum(v) / sum(c) from s), 6) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.5), 6) as median, round(quantile_cont(m, 0.975), 6) as high, count(m) as valid from m""")
def l1_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.bootstrap_mean(load(spark, sf_dir, "documents"), "source", "n_chars", 2000, 11))


@query(f"""{with_views('judge')}, m as (select 'mean' as metric, avg(score) as value from judge union all select 'scored', count(score) from judge),
    g as (select * from (values ('mean', 'observed', 40.0), ('scored', 'lower_bound', 1e9), ('absent', 'observed', 0.0)) v(metric, kind, minimum))
    select metric, kind, cast(minimum as double) as minimum, round(value, 6) as value, coalesce(case when kind = 'lower_bound' then value > minimum else value >= minimum end, false) as passed from g left join m using (metric)""")
def l7_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judgments(spark, sf_dir)
    metrics = j.agg(F.avg("score").alias("mean"), F.count("score").cast("double").alias("scored")).select(F.inline(F.array(
        F.struct(F.lit("mean").alias("metric"), F.col("mean").alias("value")), F.struct(F.lit("scored").alias("metric"), F.col("scored").alias("value")))))
    gates = spark.createDataFrame([("mean", "observed", 40.0), ("scored", "lower_bound", 1e9), ("absent", "observed", 0.0)], "metric string, kind string, minimum double")
    return rounded(audit.gate_report(metrics, gates))


@query(f"""{with_views('judge')}, m as (select 'mean' as metric, avg(score) as value from judge union all select 'rows', count(*) from judge union all select 'mid', count(*) filter (score between 30 and 60) from judge),
    g as (select * from (values ('rows', 'size', 10.0), ('mid', 'size', 5.0), ('mean', 'observed', 40.0), ('mean', 'lower_bound', 20.0)) v(metric, kind, minimum)),
    r as (select *, coalesce(case when kind = 'lower_bound' then value > minimum else value >= minimum end, false) as passed from g left join m using (metric)),
    x as (select bool_and(passed) filter (kind = 'size') as sizes_passed, bool_and(passed) filter (kind <> 'size') as gates_passed, coalesce(string_agg(kind || ':' || metric, ',' order by kind || ':' || metric) filter (not passed), '') as failed from r)
    select sizes_passed, gates_passed, failed, fresh, case when not sizes_passed then 'insufficient' when not gates_passed then 'rejected' when not fresh then 'internal_pass' else 'accepted' end as status from x, (values (true), (false)) f(fresh)""")
def l7_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates of an evaluation, as they stand for rows that were seen before and for a fresh holdout."""
    j = judgments(spark, sf_dir)
    metrics = j.agg(F.avg("score").alias("mean"), F.count("*").cast("double").alias("rows"), F.count_if(F.col("score").between(30, 60)).cast("double").alias("mid")).select(F.inline(F.array(
        *(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mean", "rows", "mid")))))
    gates = spark.createDataFrame([("rows", "size", 10.0), ("mid", "size", 5.0), ("mean", "observed", 40.0), ("mean", "lower_bound", 20.0)], "metric string, kind string, minimum double")
    return audit.acceptance(metrics, gates, True).union(audit.acceptance(metrics, gates, False))


@query("""select event_id, case when value > 8 then null else round(value, 6) end as known from events""")
def b14_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("value") > 9, F.lit(float("nan"))).when(F.col("value") > 8, F.lit(float("-inf"))).otherwise(F.col("value"))
    return rounded(load(spark, sf_dir, "events").select("event_id", tx.finite(odd).alias("known")))


@query("""select doc_id, case when lang = 'en' and source in ('src0', 'src1') then 'talk-en' when lang = 'en' then 'any-en' when lang = 'de' and source = 'src2' then 'talk-de' else 'any' end as prompt from documents""")
def c10_prompt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = {"en": {"default": "any-en", "src0": "talk-en", "src1": "talk-en"}, "de": {"src2": "talk-de"}}
    return load(spark, sf_dir, "documents").select("doc_id", tx.lookup(table, "lang", "source", "any").alias("prompt"))


@query("select doc_id, text from documents")
def s12_without_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.drop_features(load(spark, sf_dir, "documents"), ["n_chars", "source", "lang"])


@query("""with x as (select l_orderkey as id, case when l_linenumber = 3 then ' ' else l_returnflag end as t, l_partkey as p from lineitem),
    n as (select id, count(*) as n from x group by id) select id, 'repeated id' as reason from x join n using (id) where n > 1 union all select id, 'blank t' from x where trim(t) = '' union all select id, 'missing p' from x where p is null""")
def s8_blind_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") == 3, " ").otherwise(F.col("l_returnflag")).alias("t"), F.col("l_partkey").alias("p"))
    return audit.blind_failures(rows, "id", ["t"], ["p"])


@query("""with b as (select doc_id, lang, sha256('5|' || doc_id) as blind_key from documents) select blind_key, lang from b""")
def s8_blind_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return audit.blind_and_private(d, "doc_id", ["doc_id", "source"], 5)[0].select("blind_key", "lang")


@query("""with g as (select source, count(*) as rows, string_agg(distinct lang, '+' order by lang) as signature, case when source in ('src1', 'src4') then 'dev' when source = 'src2' then 'locked' end as had from documents group by source),
    p as (select *, substr(md5('5|' || source), 1, 16) as position, coalesce(sum(rows) filter (had = 'dev') over (partition by signature), 0) as taken from g)
    select source, rows, signature, coalesce(had, case when taken + coalesce(sum(case when had is null then rows else 0 end) over (partition by signature order by position, source rows between unbounded preceding and 1 preceding), 0) < sum(rows) over (partition by signature) * 0.4 then 'dev' else 'locked' end) as role from p""")
def s7_split_with_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").withColumn("had", F.when(F.col("source").isin("src1", "src4"), "dev").when(F.col("source") == "src2", "locked"))
    return audit.group_split(d, "source", "lang", 0.4, 5, existing="had")
