"""Queries of ranks, agreement metrics, pools and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import concordance, evaluation, joins, ranks, resample
from spanforge.sources.shared import once

from .evaluation import query, rounded
from .views import judgments, load, pools, texts, with_views


@query(f"""{with_views('pool')} select candidate_id, round(rank() over (partition by pool_id order by bucket) + (count(*) over (partition by pool_id, bucket) - 1) / 2.0, 6) as avg_rank from pool""")
def i1_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pools(spark, sf_dir).select("candidate_id", ranks.average_rank("bucket", ["pool_id"]).alias("avg_rank")))


@query(f"""{with_views('pool')} select candidate_id, round(case when count(*) over (partition by pool_id) > 1 then
    (rank() over (partition by pool_id order by bucket) + (count(*) over (partition by pool_id, bucket) - 1) / 2.0 - 1) / (count(*) over (partition by pool_id) - 1) * 100 else 50 end, 6) as pct from pool""")
def i2_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pools(spark, sf_dir).select("candidate_id", ranks.rank_percentile("bucket", ["pool_id"]).alias("pct")))


@query(f"""{with_views('pool')} select candidate_id, round(score - avg(score) over (partition by pool_id), 6) as centered,
    round(case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 1 end, 6) as scaled
    from pool window w as (partition by pool_id)""")
def i3_i4_center_and_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools(spark, sf_dir).select("candidate_id", F.round(ranks.centered("score", ["pool_id"]), 6).alias("centered"), F.round(ranks.min_max("score", ["pool_id"]), 6).alias("scaled"))


@query("""with n as (select count(*) as n from customer) select c_custkey, case
        when row_number() over (order by c_acctbal, c_custkey) <= round_even(n * 30 / 94.0, 0) then 0
        when row_number() over (order by c_acctbal, c_custkey) <= round_even(n * 64 / 94.0, 0) then 1 else 2 end as class from customer, n""")
def i5_rank_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.rank_classes(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey").select("c_custkey", "class")


@query("""with r as (select c_acctbal as v from customer), n as (select count(*) as n from r),
    c as (select v, count(*) as k from r group by v), u as (select v, sum(k) over (order by v) as upto from c)
    select s.s_suppkey, round(coalesce((select max(upto) from u where u.v <= s.s_acctbal), 0) / n.n, 6) as percentile from supplier s, n""")
def i7_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("v"))
    reference = load(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("double").alias("v"))
    return rounded(ranks.ecdf_percentile(values, reference, "v").select("s_suppkey", "percentile"))


@query(f"""{with_views('pool')}, p as (select candidate_id,
        case when count(*) over (partition by pool_id) > 1 then (rank() over (partition by pool_id order by score) + (count(*) over (partition by pool_id, score) - 1) / 2.0 - 1) / (count(*) over (partition by pool_id) - 1) * 100 else 50 end as a,
        case when count(*) over (partition by pool_id) > 1 then (rank() over (partition by pool_id order by bucket) + (count(*) over (partition by pool_id, bucket) - 1) / 2.0 - 1) / (count(*) over (partition by pool_id) - 1) * 100 else 50 end as b from pool)
    select candidate_id, round(a, 6) as first_pct, round(b, 6) as second_pct, round(0.3 * a + 0.7 * b, 6) as fused from p""")
def i8_rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.fuse_ranks(pools(spark, sf_dir), "pool_id", "score", "bucket", 0.3).select("candidate_id", "first_pct", "second_pct", "fused"))


_TIES = """
    best as (select pool_id, max(case when is_gold then bucket end) as top from pool group by pool_id),
    t as (select p.pool_id, count(*) as size, count(*) filter (is_gold) as golds, count(*) filter (p.bucket > b.top) as above,
                 count(*) filter (p.bucket = b.top) as tied, count(*) filter (p.bucket = b.top and is_gold) as marked
          from pool p join best b on b.pool_id = p.pool_id where b.top is not null group by p.pool_id),
    none as (
        select pool_id, 0 as m, 1.0::double as p from t
        union all
        select n.pool_id, n.m + 1, n.p * (t.tied - t.marked - n.m) / (t.tied - n.m) from none n join t on t.pool_id = n.pool_id where n.m < t.tied - t.marked + 1 and n.m < t.tied)"""


@query(f"""{with_views('pool').replace('with ', 'with recursive ', 1)}, {_TIES},
    mrr as (select a.pool_id, sum((a.p - b.p) / (t.above + b.m)) as mrr from none a join none b on b.pool_id = a.pool_id and b.m = a.m + 1 join t on t.pool_id = a.pool_id group by a.pool_id)
    select t.pool_id, size, golds,
           round(case when above >= 1 then 0 else 1 - (select coalesce(min(p), 1) from none n where n.pool_id = t.pool_id and n.m <= 1 - above) end, 6) as hit_at_1,
           round(case when above >= 3 then 0 else 1 - (select coalesce(min(p), 1) from none n where n.pool_id = t.pool_id and n.m <= 3 - above) end, 6) as hit_at_3,
           round(mrr, 6) as mrr, above + 1 as best_rank_min, above + tied - marked + 1 as best_rank_max
    from t join mrr using (pool_id)""")
def i9_tie_aware_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.tie_aware_hits(pools(spark, sf_dir), "pool_id", "bucket", "is_gold"))


@query(f"""{with_views('pool').replace('with ', 'with recursive ', 1)}, t as (select pool_id, count(*) as size, count(*) filter (is_gold) as golds from pool group by pool_id),
    none as (select pool_id, 0 as m, 1.0::double as p from t where golds > 0 union all
             select n.pool_id, n.m + 1, n.p * (t.size - t.golds - n.m) / (t.size - n.m) from none n join t on t.pool_id = n.pool_id where n.m < t.size - t.golds + 1 and n.m < t.size),
    mrr as (select a.pool_id, sum((a.p - b.p) / b.m) as mrr from none a join none b on b.pool_id = a.pool_id and b.m = a.m + 1 group by a.pool_id)
    select t.pool_id, size, golds, round(coalesce(1 - (select min(p) from none n where n.pool_id = t.pool_id and n.m <= 1), 0), 6) as random_hit_at_1,
           round(coalesce(1 - (select min(p) from none n where n.pool_id = t.pool_id and n.m <= 3), 0), 6) as random_hit_at_3, round(coalesce(mrr, 0), 6) as random_mrr
    from t left join mrr using (pool_id)""")
def i10_random_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pools(spark, sf_dir).groupBy("pool_id").agg(F.count("*").alias("size"), F.count_if("is_gold").alias("golds"))
    return rounded(ranks.random_baselines(p))


@query(f"""{with_views('judge')} select candidate_id, count(*) as repeats, count(score) as scored, round(avg(score), 6) as score_mean, round(stddev_pop(score), 6) as score_std,
    round(avg(second), 6) as second_mean, round(stddev_pop(second), 6) as second_std, case when count(score) > 0 then 'scored' else 'abstained' end as status from judge group by candidate_id""")
def h4_repeat_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.repeat_summary(judgments(spark, sf_dir), "candidate_id", ["score", "second"]))


@query("""with c as (select l_orderkey, l_linenumber, max(cast(l_quantity as double)) as q, max(cast(l_discount as double)) as d from lineitem group by all),
    k as (select least(2, cast(floor(q / 17) as integer)) as a, least(2, cast(floor(d * 28) as integer)) as b from c), n as (select count(*) as n from k),
    o as (select sum((a - b) * (a - b)) / 4.0 as o from k),
    e as (select sum(x.n * y.n * (x.a - y.b) * (x.a - y.b)) / 4.0 / max(n.n) as e from (select a, count(*) as n from k group by a) x, (select b, count(*) as n from k group by b) y, n)
    select n.n, round(1 - o / e, 6) as kappa from n, o, e""")
def h7_weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("double")).alias("q"), F.max(F.col("l_discount").cast("double")).alias("d"))
    k = rows.select(F.least(F.lit(2), F.floor(F.col("q") / 17).cast("int")).alias("a"), F.least(F.lit(2), F.floor(F.col("d") * 28).cast("int")).alias("b"))
    return rounded(ranks.weighted_kappa(k, "a", "b"))


_RANKED = """r as (select channel, rank() over (partition by channel order by target) + (count(*) over (partition by channel, target) - 1) / 2.0 as a,
                 rank() over (partition by channel order by score) + (count(*) over (partition by channel, score) - 1) / 2.0 as b from texts where score is not null),
    s as (select channel, count(*) as n, case when count(*) >= 2 and stddev_pop(a) > 1e-12 and stddev_pop(b) > 1e-12 then covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) end as spearman from r group by channel)"""


@query(f"""{with_views('texts')}, {_RANKED} select channel, n, round(spearman, 6) as spearman from s""")
def h8_spearman_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.spearman(texts(spark, sf_dir), "target", "score", ["channel"]))


@query(f"""{with_views('texts')}, {_RANKED} select round(avg(spearman), 6) as macro_spearman, count(spearman) as groups from s""")
def h9_macro_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.macro_spearman(texts(spark, sf_dir), "target", "score", "channel"))


@query("""with x as (select l.quality as y, cast(d.n_chars as double) as s, d.lang from labels l join documents d using (doc_id) where l.quality is not null),
    r as (select *, rank() over (partition by lang order by s) + (count(*) over (partition by lang, s) - 1) / 2.0 as r from x)
    select lang, count(*) filter (y = 1) as positives, count(*) filter (y = 0) as negatives,
           round(case when count(*) filter (y = 1) > 0 and count(*) filter (y = 0) > 0 then (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)) end, 6) as auc
    from r group by lang""")
def h10_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return rounded(ranks.roc_auc(x, "quality", "n_chars", ["lang"]))


_BAND = """p as (select a.target - b.target as t, a.score - b.score as s from texts a join texts b on a.channel = b.channel and a.candidate_id < b.candidate_id
        where abs(a.target - b.target) >= 0.1 and abs(a.target - b.target) <= 0.4)"""


@query(f"""{with_views('texts')} select a.channel, count(*) as pairs, round(sum(abs(a.target - b.target)), 4) as gaps from texts a join texts b on a.channel = b.channel and a.candidate_id < b.candidate_id
    where abs(a.target - b.target) >= 0.05 and abs(a.target - b.target) <= 0.1 group by a.channel""")
def d15_banded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts(spark, sf_dir).select("candidate_id", "channel", "target")
    return joins.group_pairs(t, "channel", "candidate_id", "target", 0.05, 0.1).groupBy("channel").agg(F.count("*").alias("pairs"), F.round(F.sum("gap"), 4).alias("gaps"))


@query(f"""{with_views('texts')}, {_BAND} select count(*) as pairs, round(avg(case when sign(s) = 0 then 0.5 when sign(s) = sign(t) then 1.0 else 0 end), 6) as accuracy from p""")
def h11_pair_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts(spark, sf_dir).select("candidate_id", "channel", "target", "score")
    counts = concordance.concordance(t, ["channel"], "target", "score", [(0.1, 0.4)])
    return rounded(concordance.concordance_share(counts).drop("band"))


@query(f"""{with_views('texts')}, r as (select channel, row_number() over (partition by channel order by score desc, candidate_id) as s, row_number() over (partition by channel order by target desc, candidate_id) as t,
        ceil(count(*) over (partition by channel) * 20 / 100.0) as k from texts)
    select count(*) filter (s <= k) as picked, round(count(*) filter (s <= k and t <= k) / (count(*) filter (s <= k)), 6) as precision from r""")
def h12_top_quintile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts(spark, sf_dir).select("candidate_id", "channel", "target", "score")
    return rounded(ranks.top_share_precision(t, "target", "score", "channel", "candidate_id"))


@query(f"""{with_views('texts')}, x as (select channel, target, score, 1 / log2(row_number() over (partition by channel order by score desc) + 1) as ds, 1 / log2(row_number() over (partition by channel order by target desc) + 1) as dt from texts),
    a as (select channel, sum(g * d) as dcg, sum(n) as n from (select channel, score, avg(target) as g, sum(ds) as d, count(*) as n from x group by all) group by channel),
    b as (select channel, sum(target * dt) as ideal from x group by channel)
    select round(avg(case when ideal > 0 then dcg / ideal else 0 end), 6) as ndcg, count(*) as groups from a join b using (channel) where n >= 2""")
def h13_macro_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranks.macro_ndcg(texts(spark, sf_dir).select("channel", "target", "score"), "target", "score", "channel"))


@query(f"""{with_views('judge')}, p as (select a.repeat as a_repeat, b.repeat as b_repeat, a.score as x, b.score as y from judge a join judge b on a.candidate_id = b.candidate_id and a.repeat < b.repeat where a.score is not null and b.score is not null),
    r as (select *, rank() over (partition by a_repeat, b_repeat order by x) + (count(*) over (partition by a_repeat, b_repeat, x) - 1) / 2.0 as rx, rank() over (partition by a_repeat, b_repeat order by y) + (count(*) over (partition by a_repeat, b_repeat, y) - 1) / 2.0 as ry from p)
    select a_repeat, b_repeat, count(*) as common, round(case when count(*) >= 2 and stddev_pop(rx) > 1e-12 and stddev_pop(ry) > 1e-12 then covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) end, 6) as spearman, round(avg(abs(x - y)), 6) as mae
    from r group by all""")
def h16_repeat_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.repeat_reliability(judgments(spark, sf_dir), "candidate_id", "repeat", "score"))


@query(f"""{with_views('pool')}, t as (select pool_id, min(bucket) as bucket, count(*) as size, avg(score) as mean_score from pool group by pool_id)
    select bucket, count(*) as pools, round(avg(size), 6) as size, round(avg(mean_score), 4) as mean_score from t group by rollup(bucket)""")
def h18_pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pools(spark, sf_dir).groupBy("pool_id").agg(F.min("bucket").alias("bucket"), F.count("*").alias("size"), F.avg("score").alias("mean_score"))
    out = evaluation.pool_summary(t, "bucket", ["size", "mean_score"])
    return out.select("bucket", "pools", F.round("size", 6).alias("size"), F.round("mean_score", 4).alias("mean_score"))


@query(f"""{with_views('judge')}, t as (select score, count(*) as n from judge group by score)
    select cast(coalesce(sum(n) filter (score is not null), 0) as bigint) as scored, cast(coalesce(sum(n) filter (score is null), 0) as bigint) as abstained, count(score) as distinct_scores,
           max(n) filter (score is not null) as largest_tie, round(sum(score * n) filter (score is not null) / sum(n) filter (score is not null), 6) as mean_score from t""")
def h20_score_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.score_audit(judgments(spark, sf_dir), "score"))


@query(f"""{with_views('judge')}, m as (select candidate_id, avg(score) as x, avg(second) as y from judge group by candidate_id having avg(score) is not null and avg(second) is not null),
    r as (select *, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry,
                 row_number() over (order by x desc, candidate_id) as px, row_number() over (order by y desc, candidate_id) as py from m)
    select count(*) as n, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) as spearman, count(*) filter (px <= 10 and py <= 10) as top_overlap,
           round(count(*) filter (px <= 10 and py <= 10) / (count(*) filter (px <= 10 or py <= 10)), 6) as top_jaccard, round(avg(abs(rx - ry)), 4) as mean_rank_gap from r""")
def d14_compare_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = once(judgments(spark, sf_dir).groupBy("candidate_id").agg(F.avg("score").alias("x"), F.avg("second").alias("y")), "judged")
    left, right = m.select("candidate_id", F.col("x").alias("s")), m.select("candidate_id", F.col("y").alias("s"))
    out = joins.compare_score_sets(left, right, "candidate_id", "s")
    return out.select("n", F.round("spearman", 6).alias("spearman"), "top_overlap", F.round("top_jaccard", 6).alias("top_jaccard"), F.round("mean_rank_gap", 4).alias("mean_rank_gap"))


#: Replicates of the bundle bootstrap.
_REPLICATES = 500


@query(f"""{with_views('texts')}, k as (select longform_id, row_number() over (order by longform_id) - 1 as number from (select distinct longform_id from texts)), n as (select count(*) as n from k),
    d as (select r, ('0x' || substr(md5('17|' || r || '|' || t), 1, 8))::bigint % n.n as number from n, range({_REPLICATES}) a(r), range(n.n) b(t)),
    x as (select r, channel, target, score from d join k using (number) join texts using (longform_id) union all select -1, channel, target, score from texts),
    c as (select *, round(target - avg(target) over (partition by r, channel), 12) as ct, round(score - avg(score) over (partition by r, channel), 12) as cs from x),
    k2 as (select *, rank() over (partition by r order by ct) + (count(*) over (partition by r, ct) - 1) / 2.0 as a, rank() over (partition by r order by cs) + (count(*) over (partition by r, cs) - 1) / 2.0 as b,
        rank() over (partition by r, channel order by target) + (count(*) over (partition by r, channel, target) - 1) / 2.0 as u, rank() over (partition by r, channel order by score) + (count(*) over (partition by r, channel, score) - 1) / 2.0 as v,
        1 / log2(row_number() over (partition by r, channel order by score desc) + 1) as ds, 1 / log2(row_number() over (partition by r, channel order by target desc) + 1) as dt from c),
    p as (select r, case when stddev_pop(a) > 1e-6 and stddev_pop(b) > 1e-6 then corr(a, b) end as centred from k2 group by r),
    m as (select r, avg(s) as macro_spearman from (select r, channel, case when stddev_pop(u) > 1e-6 and stddev_pop(v) > 1e-6 then corr(u, v) end as s from k2 group by all) group by r),
    q as (select a.r, a.target - b.target as gap, case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end as hit from x a join x b on a.r = b.r and a.channel = b.channel and a.target - b.target >= 0.01),
    h as (select r, avg(hit) as pair_accuracy, avg(hit) filter (gap >= 0.1 and gap <= 0.4) as local_pair_accuracy from q group by r),
    g1 as (select r, channel, sum(g * d) as dcg, sum(n) as n from (select r, channel, score, avg(target) as g, sum(ds) as d, count(*) as n from k2 group by all) group by all), g2 as (select r, channel, sum(target * dt) as ideal from k2 group by all),
    g as (select r, avg(case when ideal > 0 then dcg / ideal else 0 end) as ndcg from g1 join g2 using (r, channel) where n >= 2 group by r),
    w as (select *, (centred + macro_spearman + 2 * pair_accuracy - 1 + 2 * local_pair_accuracy - 1) / 4 as robust from p join m using (r) join h using (r) join g using (r)),
    l as (unpivot (select * from w) on centred, macro_spearman, pair_accuracy, local_pair_accuracy, ndcg, robust into name metric value v)
    select metric, round(max(v) filter (r = -1), 5) as value, round(quantile_cont(v, 0.025) filter (r >= 0), 5) as low, round(quantile_cont(v, 0.5) filter (r >= 0), 5) as median, round(quantile_cont(v, 0.975) filter (r >= 0), 5) as high, count(v) filter (r >= 0) as valid from l group by metric""")
def l1_bundle_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.bundle_bootstrap(texts(spark, sf_dir), "longform_id", "channel", "target", "score", _REPLICATES, 17), 5)
