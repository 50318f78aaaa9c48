"""Queries of roll-ups, controls and bundle audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import audit, generate, rollups

from .evaluation import ORACLES, query, rounded
from .views import judgments, load, pools, texts, timeline, with_views


@query(f"""{with_views('pool')}, r as (select bucket, count(*) as pairs, avg(is_gold::int) as hit, avg(score) as s from pool group by bucket)
    select cast(sum(pairs) as bigint) as total, round(sum(hit * pairs) / sum(pairs), 6) as hit, round(sum(s * pairs) / sum(pairs), 3) as s from r""")
def h3_weighted_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = pools(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("pairs"), F.avg(F.col("is_gold").cast("int")).alias("hit"), F.avg("score").alias("s"))
    out = rollups.weighted_summary(runs, "pairs", ["hit", "s"])
    return out.select("total", F.round("hit", 6).alias("hit"), F.round("s", 3).alias("s"))


@query("""select source, count(*) as rows, count(distinct lang) as lang_count, count(distinct doc_id) as doc_id_count, string_agg(distinct lang, ',' order by lang) as lang_list,
    count(*) filter (trim(coalesce(text, '')) <> '') as complete, round(avg(length(coalesce(text, ''))), 6) as mean_chars from documents group by source""")
def h5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollups.coverage_rollup(load(spark, sf_dir, "documents"), "source", ["lang", "doc_id"], "text"))


@query("""with x as (select d.source, l.quality as y, cast(d.n_chars // 100 as double) as s from labels l join documents d using (doc_id)),
    p as (select a.source, count(*) filter (a.s > b.s) as r, count(*) filter (a.s = b.s) as t, count(*) filter (a.s < b.s) as w from x a join x b on a.source = b.source and a.y = 1 and b.y = 0 group by a.source),
    c as (select source, count(*) filter (y = 1) as highs, count(*) filter (y = 0) as lows, avg(s) filter (y = 1) as mh, avg(s) filter (y = 0) as ml from x group by source)
    select source, highs, lows, round(mh, 6) as mean_high, round(ml, 6) as mean_low, r as right, t as tied, w as wrong, round((r + t / 2.0) / (highs * lows), 6) as auc, highs >= 3 and lows >= 3 as stable from c join p using (source)""".replace(" as right,", ' as "right",'))
def h15_channel_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "source", F.expr("cast(n_chars div 100 as double)").alias("s")), "doc_id")
    return rounded(rollups.channel_validity(x, "source", "quality", "s"))


@query(f"""{with_views('judge', 'pool')}, h as (select candidate_id, round(avg(case when score is null or second is null then null else 25 * (score / 25 + second / 25) / 2 end), 9) as human from judge group by candidate_id),
    b as (select p.score, h.human from pool p join h using (candidate_id) where h.human is not null and p.score is not null),
    r as (select rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as a, rank() over (order by human) + (count(*) over (partition by human) - 1) / 2.0 as b from b)
    select count(*) as n, round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) as spearman from r""")
def h17_human_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    humans = judgments(spark, sf_dir).withColumns({"a": F.col("score") / 25, "b": F.col("second") / 25})
    return rounded(rollups.human_alignment(pools(spark, sf_dir).select("candidate_id", "score"), humans, "candidate_id", ["a", "b"]))


@query(f"""{with_views('pool')}, v as (select bucket as variant, avg(is_gold::int) as hit, avg(baseline_rank) as rank from pool group by bucket)
    select 'open_done' as contrast, round((select hit from v where variant = 'O') - (select hit from v where variant = 'F'), 6) as hit, round((select rank from v where variant = 'O') - (select rank from v where variant = 'F'), 6) as rank
    union all select 'part_done', round((select hit from v where variant = 'P') - (select hit from v where variant = 'F'), 6), round((select rank from v where variant = 'P') - (select rank from v where variant = 'F'), 6)""")
def h19_variant_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = pools(spark, sf_dir).groupBy(F.col("bucket").alias("variant")).agg(F.avg(F.col("is_gold").cast("int")).alias("hit"), F.avg("baseline_rank").alias("rank"))
    return rounded(rollups.variant_contrasts(v, ["hit", "rank"], {"open_done": ("O", "F"), "part_done": ("P", "F")}))


@query(f"""{with_views('texts')}, c as (select *, round(target - avg(target) over (partition by channel), 12) as ct, round(score - avg(score) over (partition by channel), 12) as cs from texts where score is not null),
    r as (select score, rank() over (order by target) + (count(*) over (partition by target) - 1) / 2.0 as a, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as b,
        rank() over (order by ct) + (count(*) over (partition by ct) - 1) / 2.0 as d, rank() over (order by cs) + (count(*) over (partition by cs) - 1) / 2.0 as e, count(*) over (partition by score) as same from c)
    select count(*) as n, round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 4) as pooled, round(covar_pop(d, e) / (stddev_pop(d) * stddev_pop(e)), 4) as centred, count(distinct score) as unique_scores, count(*) filter (same > 1) as tied_rows from r""")
def h14_metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollups.metric_bundle(texts(spark, sf_dir).select("channel", "target", "score"), "target", "score", "channel"), 4)


_CENTRED = f"""{with_views('texts')}, c as (select *, round(target - avg(target) over (partition by channel), 12) as ct, round(score - avg(score) over (partition by channel), 12) as cs from texts where score is not null and target is not null),
    d as (select *, round(ct - avg(ct) over (partition by lang), 12) as st, round(cs - avg(cs) over (partition by lang), 12) as ss from c)"""
_RHO = lambda a, b: f"(select covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) from (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as x, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as y from d))"
_ALL_PAIRS = f"{with_views('texts')} select avg(case when sign(a.score - b.score) = 0 then 0.5 when sign(a.score - b.score) = sign(a.target - b.target) then 1.0 else 0 end) as accuracy from texts a join texts b on a.channel = b.channel and a.candidate_id < b.candidate_id where abs(a.target - b.target) >= "


@query(f"""with m as ({_CENTRED} select {_RHO('target', 'score')} as pooled, {_RHO('ct', 'cs')} as centred, {_RHO('st', 'ss')} as residual), pa as ({_ALL_PAIRS} 0.01), la as ({_ALL_PAIRS} 0.1 and abs(a.target - b.target) <= 0.4), h9 as ({ORACLES['h9_macro_spearman']}), h12 as ({ORACLES['h12_top_quintile']}), h13 as ({ORACLES['h13_macro_ndcg']})
    select round(pooled, 4) as pooled, round(centred, 4) as centred, round(residual, 4) as source_residual, round(macro_spearman, 4) as macro_spearman, round(pa.accuracy, 4) as pair_accuracy, round(la.accuracy, 4) as local_pair_accuracy, round(precision, 4) as top_fifth, round(ndcg, 4) as ndcg,
        round((centred + macro_spearman + 2 * pa.accuracy - 1 + 2 * la.accuracy - 1) / 4, 3) as robust, round(0.4 * centred + 0.3 * macro_spearman + 0.15 * (2 * pa.accuracy - 1) + 0.15 * (2 * la.accuracy - 1), 3) as selection from m, pa, la, h9, h12, h13""")
def h14_performance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = rollups.performance_metrics(texts(spark, sf_dir), "target", "score", "channel", "lang", "candidate_id").drop("n", "pair_accuracy_count", "local_pair_accuracy_count")
    return m.select(*(F.round(c, 3 if c in ("robust", "selection") else 4).alias(c) for c in m.columns))


_LABELS = """x as (select o_orderkey as id, o_custkey as dur, cast(o_totalprice as double) as y, case when o_orderpriority = '1-URGENT' then 'neg' when o_orderpriority = '5-LOW' then 'pos' else 'mid' end as label from orders),
    s as (select x.*, sim, ('0x' || substr(md5('9|' || sim || '|' || id), 1, 8))::bigint / 4294967296.0 as u from x, range(100) r(sim))"""
_SPREAD = lambda value: f"""v as (select sim, y, {value} as v from s), k as (select sim, rank() over (partition by sim order by v) + (count(*) over (partition by sim, v) - 1) / 2.0 as a, rank() over (partition by sim order by y) + (count(*) over (partition by sim, y) - 1) / 2.0 as b from v),
    q as (select covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) as r from k group by sim)"""  # noqa: E731


@query(f"""select 'polar' as kind, * from (with {_LABELS}, {_SPREAD("case label when 'neg' then u when 'pos' then 2 + u else 3 * u end")} select round(avg(r), 5) as mean, round(quantile_cont(r, 0.025), 5) as low, round(quantile_cont(r, 0.975), 5) as high, count(r) as valid from q)
    union all select 'oracle', * from (with {_LABELS}, {_SPREAD("case label when 'neg' then 0 when 'pos' then 2 else 1 end + u")} select round(avg(r), 5), round(quantile_cont(r, 0.025), 5), round(quantile_cont(r, 0.975), 5), count(r) from q)""")
def l5_label_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("y"), F.when(p == "1-URGENT", "neg").when(p == "5-LOW", "pos").otherwise("mid").alias("label"))
    return rounded(rollups.control_distributions(rows, "id", "label", "y", ["polar", "oracle"], 100, 9), 5)


@query("""with x as (select l.doc_id, l.quality as y, sim, ('0x' || substr(md5('9|' || sim || '|' || l.doc_id), 1, 8))::bigint / 4294967296.0 as s from labels l, range(500) r(sim)),
    r as (select *, rank() over (partition by sim order by s) + (count(*) over (partition by sim, s) - 1) / 2.0 as r from x),
    a as (select sim, (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)) as auc from r group by sim)
    select round(avg(auc), 6) as mean, round(quantile_cont(auc, 0.025), 6) as low, round(quantile_cont(auc, 0.975), 6) as high, count(auc) as valid from a""")
def l5_null_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rollups.null_control(load(spark, sf_dir, "labels"), "doc_id", "quality", 500, 9))


@query("""with s as (select s_suppkey as source, cast(s_acctbal as double) as v, 1 as c from supplier), n as (select count(*) as n from s), k as (select source, row_number() over (order by source) - 1 as number from s),
    d as (select r, ('0x' || substr(md5('13|' || r || '|' || t), 1, 8))::bigint % n.n as number from n, range(2000) a(r), range(n.n) b(t)),
    m as (select r, sum(s.v) / sum(s.c) as m from d join k using (number) join s using (source) group by r)
    select round((select avg(v) from s), 6) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.5), 6) as median, round(quantile_cont(m, 0.975), 6) as high, count(m) as valid from m""")
def l2_row_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("v"))
    return rounded(audit.bootstrap_mean(rows, "s_suppkey", "v", 2000, 13))


@query("""select 'rows' as check, null::varchar as detail, (select count(*) from documents) as n union all select 'repeated keys', null, (select count(*) from (select doc_id from documents group by doc_id having count(*) > 1))
    union all select 'unknown channel', source, count(*) from documents where source not in ('src0', 'src1') group by source union all select 'label', lang, count(*) from documents group by lang""".replace("as check", 'as "check"'))
def s5_dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return rollups.dataset_audit(d, "doc_id", "source", d.where("source in ('src0', 'src1')"), "lang")


@query("""select d.doc_id, case when d.source = 'src1' then 'one' else d.source end as source from documents d""")
def s6_normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("src1", "one")], "raw string, name string")
    return audit.normalize_names(load(spark, sf_dir, "documents").select("doc_id", "source"), names, "source", "raw", "name")


@query("""with c as (select c_custkey, cast(c_acctbal as double) as v, c_mktsegment as t from customer), r as (select c_custkey, cast(c_acctbal as double) + (c_custkey % 5 = 0)::int as v from customer where c_custkey % 11 <> 0)
    select 'only left' as "check", c_custkey from c where c_custkey not in (select c_custkey from r) union all select 'values differ', c_custkey from c join r using (c_custkey) where abs(c.v - r.v) > 1e-9
    union all select 'secret in t', c_custkey from c where regexp_matches(t, 'AUTO')""")
def s13_bundle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("v"), F.col("c_mktsegment").alias("t"))
    other = c.where("c_custkey % 11 <> 0").select("c_custkey", (F.col("v") + (F.col("c_custkey") % 5 == 0).cast("int")).alias("v"))
    return rollups.bundle_violations(c, other, "c_custkey", "v", ["t"], "AUTO")


@query("""select item_id, regexp_matches(text, '(?i)\\b(the|und)\\b') as leak, length(regexp_replace(text, '\\s', '', 'g')) between 45 and 150 as length_ok from benchmark""")
def s4_term_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.term_leaks(load(spark, sf_dir, "benchmark"), "item_id", "text", ["the", "und"])


@query(f"""{with_views('timeline')} select longform_id, event_type, max(value) as best, cast(count(*) as integer) as n from timeline group by all""")
def g3_best_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir)
    best = generate.top_k(t.withColumn("k", F.struct("longform_id", "event_type")), "k", 1, F.desc("value"), "scene_id")
    n = t.groupBy("longform_id", "event_type").agg(F.count("*").cast("int").alias("n"))
    return best.select("longform_id", "event_type", F.col("value").alias("best")).join(n, ["longform_id", "event_type"])
