"""Queries of interval measures, joins, generators and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import intervals as iv
from spanforge.operators import evaluation, generate, joins

from .views import gold, load, pools, predictions, speeches, timeline, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with its SQL."""
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at ``digits`` decimals: sums depend on their order beyond that."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


#: Overlap, hull and measures of a pair of intervals p (predicted) and g (gold), in SQL.
_PAIR = """
    select p.longform_id, p.scene_id, p.rank, g.scene_id as gold_id,
           p.start_ms as ps, p.end_ms as pe, g.start_ms as gs, g.end_ms as ge,
           greatest(0, least(p.end_ms, g.end_ms) - greatest(p.start_ms, g.start_ms)) as ov,
           greatest(p.end_ms, g.end_ms) - least(p.start_ms, g.start_ms) as hull
    from pred p join gold g on p.longform_id = g.longform_id"""
_SCORED = f"""
    scored as (
        select *, core_cov >= 0.7 and ov / 1000.0 >= least(5.0, (ge - gs) / 2000.0) as core_hit from (
            select *, case when ge > gs then ov::double / (ge - gs) else 0 end as core_cov,
                   case when hull > 0 then ov::double / hull else 0 end as iou from ({_PAIR})))"""


def _scored(spark: SparkSession, sf_dir: str, top: int | None = 5) -> DataFrame:
    p = predictions(spark, sf_dir)
    return joins.score_against_gold(p.where(F.col("rank") <= top) if top else p, gold(spark, sf_dir))


@query(f"""{with_views('gold', 'pred')}, {_SCORED}
    select longform_id, scene_id, gold_id, cast(rank as integer) as rank, round(ov / 1000.0, 6) as overlap_sec, round(core_cov, 6) as gold_coverage, round(iou, 6) as temporal_iou,
           round(abs(ps - gs) / 1000.0, 6) as start_error_sec, round(abs(pe - ge) / 1000.0, 6) as end_error_sec,
           round(abs((ps + pe) / 2.0 - (gs + ge) / 2.0) / 1000.0, 6) as center_error_sec,
           round(greatest(0.0, 1 - abs(ps - gs) / 1000.0 / 15.0), 6) as start_score,
           round(case when greatest(pe - ps, ge - gs) > 0 then least(pe - ps, ge - gs)::double / greatest(pe - ps, ge - gs) else 0 end, 6) as length_score,
           core_hit, core_hit and iou >= 0.3 as tight_hit,
           round(100 * (0.45 * core_cov + 0.30 * iou + 0.15 * greatest(0.0, 1 - abs(ps - gs) / 1000.0 / 15.0)
                 + 0.10 * case when greatest(pe - ps, ge - gs) > 0 then least(pe - ps, ge - gs)::double / greatest(pe - ps, ge - gs) else 0 end), 6) as final_score
    from scored where rank <= 5""")
def f7_prediction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir))


@query(f"""{with_views('gold', 'pred')}, {_SCORED}, pair as (
        select longform_id, gold_id, count(*) as n,
               max(case when rank <= 3 then core_hit::int end) as c3, max(case when rank <= 3 then (core_hit and iou >= 0.3)::int end) as t3, max(case when rank <= 3 then iou end) as i3,
               max(case when rank <= 5 then core_hit::int end) as c5, max(case when rank <= 5 then (core_hit and iou >= 0.3)::int end) as t5, max(case when rank <= 5 then iou end) as i5,
               sum(case when rank = 1 then core_hit::int else 0 end) as c1, sum(case when rank = 1 then iou else 0 end) as i1, sum(case when rank = 1 then 1 else 0 end) as n1
        from scored where rank <= 5 group by all)
    select count(*) as pairs, cast(sum(n) as bigint) as predictions, round(sum(c1) / sum(n1), 6) as core_at_1, round(sum(i1) / sum(n1), 6) as iou_at_1,
           round(avg(c3), 6) as core_at_3, round(avg(t3), 6) as tight_at_3, round(avg(i3), 6) as iou_at_3,
           round(avg(c5), 6) as core_at_5, round(avg(t5), 6) as tight_at_5, round(avg(i5), 6) as iou_at_5 from pair""")
def h1_hit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.hit_summary(_scored(spark, sf_dir), ["longform_id", "gold_id"]))


@query(f"""{with_views('gold', 'pred')}, {_SCORED}, ks as (select unnest([1, 3, 5, 10, 12, 20, 30, 50, 60, 120]) as k),
    best as (select k, g.longform_id, g.scene_id,
                    max(case when rank <= k then core_hit::int end) as c, max(case when rank <= k then (core_hit and iou >= 0.3)::int end) as t, max(case when rank <= k then iou end) as i
             from ks cross join gold g left join scored s on s.longform_id = g.longform_id and s.gold_id = g.scene_id group by all)
    select cast(k as integer) as k, count(*) as pairs, round(avg(coalesce(c, 0)), 6) as core_recall, round(avg(coalesce(t, 0)), 6) as tight_recall, round(avg(coalesce(i, 0)), 6) as mean_best_iou
    from best group by k""")
def h2_recall_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    golds = gold(spark, sf_dir).withColumnRenamed("scene_id", "gold_id")
    # a prediction without overlap scores 0 for every measure, and ranks beyond the last k count nowhere
    p = predictions(spark, sf_dir).where("rank <= 120")
    scored = joins.score_against_gold(p, gold(spark, sf_dir), overlapping=True)
    return rounded(evaluation.recall_table(scored, golds, ["longform_id", "gold_id"]))


@query(f"""{with_views('timeline')}, t as (select *, lead(start_ms) over w as s2, lead(end_ms) over w as e2 from timeline window w as (partition by longform_id order by start_ms, scene_id))
    select scene_id, greatest(0, least(end_ms, e2) - greatest(start_ms, s2)) as overlap_ms,
           round(case when greatest(end_ms, e2) > least(start_ms, s2) then greatest(0, least(end_ms, e2) - greatest(start_ms, s2))::double / (greatest(end_ms, e2) - least(start_ms, s2)) else 0 end, 6) as iou,
           round(case when least(end_ms - start_ms, e2 - s2) > 0 then greatest(0, least(end_ms, e2) - greatest(start_ms, s2))::double / least(end_ms - start_ms, e2 - s2) else 0 end, 6) as shortest_ratio,
           round(greatest(0.0, 1 - abs((end_ms - start_ms) / 1000.0 - 45.0) / 45.0), 6) as duration_fit, round((start_ms + end_ms) / 2.0, 6) as center_ms
    from t where s2 is not null""")
def b4_b9_interval_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("longform_id").orderBy("start_ms", "scene_id")
    t = timeline(spark, sf_dir).withColumns({"s2": F.lead("start_ms").over(w), "e2": F.lead("end_ms").over(w)}).where("s2 is not null")
    pair = ("start_ms", "end_ms", "s2", "e2")
    return rounded(t.select(
        "scene_id", iv.overlap(*pair).alias("overlap_ms"), iv.hull_iou(*pair).alias("iou"), iv.shortest_ratio(*pair).alias("shortest_ratio"),
        iv.triangular(iv.duration("start_ms", "end_ms") / 1000.0, 45, 45).alias("duration_fit"), iv.center("start_ms", "end_ms").alias("center_ms")))


@query(f"""{with_views('timeline')}
    select a.longform_id, a.scene_id as left_id, b.scene_id as right_id, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) as overlap_ms
    from timeline a join timeline b on a.longform_id = b.longform_id and a.scene_id < b.scene_id and a.start_ms < b.end_ms and b.start_ms < a.end_ms
    where a.end_ms > a.start_ms and b.end_ms > b.start_ms""")
def interval_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir).select("longform_id", "scene_id", "start_ms", "end_ms")
    return joins.interval_join(t, t, "longform_id").where("l.scene_id < r.scene_id").select(
        "l.longform_id", F.col("l.scene_id").alias("left_id"), F.col("r.scene_id").alias("right_id"),
        iv.overlap("l.start_ms", "l.end_ms", "r.start_ms", "r.end_ms").alias("overlap_ms"))


def _turn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speeches(spark, sf_dir).select(
        F.concat_ws("-", "longform_id", "speech_id").alias("candidate_id"), "longform_id", "start_ms", "end_ms")


@query(f"""{with_views('speech')}, c as (select longform_id || '-' || speech_id as candidate_id, longform_id, start_ms as s, end_ms as e from speech),
    j as (select c.*, r.start_ms, r.end_ms, r.speech_id, r.text from c left join speech r on r.longform_id = c.longform_id and r.end_ms > r.start_ms and c.e > c.s
          and r.start_ms < c.e + 20000 and r.end_ms > greatest(0, c.s - 20000))
    select candidate_id,
        left(coalesce(string_agg(text, chr(10) order by start_ms, end_ms, speech_id) filter (least(s, end_ms) > greatest(greatest(0, s - 20000), start_ms)), ''), 1800) as before,
        left(coalesce(string_agg(text, chr(10) order by start_ms, end_ms, speech_id) filter (least(e, end_ms) > greatest(s, start_ms)), ''), 5000) as core,
        left(coalesce(string_agg(text, chr(10) order by start_ms, end_ms, speech_id) filter (least(e + 20000, end_ms) > greatest(e, start_ms)), ''), 2500) as after
    from j group by candidate_id""")
def d1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.evidence(_turn_windows(spark, sf_dir), speeches(spark, sf_dir))


@query(f"""{with_views('gold')}
    select g.scene_id as candidate_id, coalesce(string_agg(cast(t.scene_id as varchar), ',' order by t.start_ms, t.end_ms, t.scene_id), '') as scene_ids
    from gold g left join timeline t on t.longform_id = g.longform_id and t.start_ms < g.end_ms and g.start_ms < t.end_ms and t.end_ms > t.start_ms group by g.scene_id""")
def d4_overlapping_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold(spark, sf_dir).select(F.col("scene_id").alias("candidate_id"), "longform_id", "start_ms", "end_ms")
    found = joins.overlapping_scenes(g, timeline(spark, sf_dir))
    return found.select("candidate_id", F.array_join(F.col("scene_ids").cast("array<string>"), ",").alias("scene_ids"))


@query(f"""{with_views('gold', 'pred')}, b as (select longform_id, start_ms as at from pred union select longform_id, end_ms from pred)
    select g.scene_id as candidate_id, min(abs(g.start_ms - b.at)) as start_gap_ms, min(abs(g.end_ms - b.at)) as end_gap_ms from gold g left join b on b.longform_id = g.longform_id group by g.scene_id""")
def d7_nearest_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold(spark, sf_dir).select(F.col("scene_id").alias("candidate_id"), "longform_id", "start_ms", "end_ms")
    return joins.nearest_boundaries(g, predictions(spark, sf_dir))


@query(f"""{with_views('gold', 'pred')}
    select p.longform_id, p.scene_id from pred p where not exists (
        select 1 from gold g where g.longform_id = p.longform_id and p.end_ms > p.start_ms and p.start_ms < g.end_ms + 2000 and greatest(0, g.start_ms - 2000) < p.end_ms)""")
def d13_away_from_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select("longform_id", "scene_id", "start_ms", "end_ms")
    return joins.away_from(p, gold(spark, sf_dir), guard_ms=2000).select("longform_id", "scene_id")


@query(f"""{with_views('pool', 'gold', 'pred')} select p.longform_id, p.scene_id, p.rank::int as rank, g.scene_id as gold_id from pred p join gold g using (longform_id) where p.rank <= 3""")
def d9_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold(spark, sf_dir).select("longform_id", F.col("scene_id").alias("gold_id"))
    return predictions(spark, sf_dir).where("rank <= 3").join(g, "longform_id").select("longform_id", "scene_id", "rank", "gold_id")


@query(f"""{with_views('pool', 'judge')}, m as (select candidate_id, avg(score) as s, count(score) as n from judge group by candidate_id)
    select p.candidate_id, round(m.s, 6) as mean_score, case when m.n is null then 'missing' when m.n = 0 then 'abstained' else 'scored' end as status from pool p left join m using (candidate_id)""")
def d11_attach_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .views import judgments

    targets = pools(spark, sf_dir).select("candidate_id")
    return rounded(joins.attach_scores(targets, judgments(spark, sf_dir)))


@query(f"""{with_views('timeline')}, o as (select *, max(end_ms) over (partition by longform_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from timeline where end_ms > start_ms),
    i as (select *, sum(case when reach is null or start_ms > reach then 1 else 0 end) over (partition by longform_id order by start_ms, end_ms rows unbounded preceding) as island from o)
    select longform_id, cast(sum(n) as bigint) as union_ms from (select longform_id, island, max(end_ms) - min(start_ms) as n from i group by all) group by longform_id""")
def h6_union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.union_length(timeline(spark, sf_dir), ["longform_id"])


@query(f"""{with_views('timeline')}, x as (select t.longform_id, t.scene_id, t.start_ms, w.n as width, case w.n when 1 then e1 when 2 then e2 when 3 then e3 else e4 end as end_ms
        from (select *, end_ms as e1, lead(end_ms, 1) over o as e2, lead(end_ms, 2) over o as e3, lead(end_ms, 3) over o as e4 from timeline window o as (partition by longform_id order by start_ms, end_ms, scene_id)) t
        cross join (select unnest([1, 2, 3, 4]) as n) w)
    select longform_id, scene_id, start_ms, cast(width as integer) as width, end_ms from x where end_ms - start_ms between 15000 and 90000""")
def e1_adjacent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.adjacent_windows(timeline(spark, sf_dir))


@query(f"""{with_views('speech')}, g as (select *, case when start_ms - lag(end_ms) over w > 3000 then 1 else 0 end as fresh from speech window w as (partition by longform_id order by start_ms, end_ms, speech_id)),
    i as (select *, sum(fresh) over (partition by longform_id order by start_ms, end_ms, speech_id rows unbounded preceding) as island,
                 row_number() over (partition by longform_id order by start_ms, end_ms, speech_id) as n from g)
    select a.longform_id, a.speech_id, a.start_ms, cast(b.n - a.n + 1 as integer) as speeches, b.end_ms from i a join i b on a.longform_id = b.longform_id and a.island = b.island and b.n - a.n between 0 and 7
    where b.end_ms - a.start_ms between 8000 and 30000""")
def e2_speech_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.speech_runs(speeches(spark, sf_dir))


@query(f"""{with_views('speech')}, d as (select unnest([15000, 30000]) as window_ms)
    select longform_id, speech_id, cast(window_ms as integer) as window_ms, step, start_ms + 5000 * step as start_ms, start_ms + 5000 * step + window_ms as end_ms
    from (select *, unnest(range(0, (end_ms - start_ms - window_ms) // 5000 + 1)) as step from speech cross join d where end_ms - start_ms >= window_ms)""")
def e3_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.sliding_windows(speeches(spark, sf_dir).select("longform_id", "speech_id", "start_ms", "end_ms"))


@query(f"""{with_views('speech')}
    select longform_id, speech_id, case when end_ms - start_ms <= 15000 then 'source_full' else 'spaced' end as kind, cast(step as integer) as step,
           case when end_ms - start_ms <= 15000 then start_ms else start_ms + (end_ms - start_ms - 15000) * step // 3 end as start_ms,
           case when end_ms - start_ms <= 15000 then end_ms else start_ms + (end_ms - start_ms - 15000) * step // 3 + 15000 end as end_ms
    from (select *, unnest(range(0, case when end_ms - start_ms <= 15000 then 1 else 4 end)) as step from speech)""")
def e4_spaced_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.spaced_windows(speeches(spark, sf_dir).select("longform_id", "speech_id", "start_ms", "end_ms"), 15_000, 4)


@query(f"""{with_views('speech')} select longform_id, speech_id, start_ms, cast(d as integer) as window_ms, least(end_ms, start_ms + d) as end_ms from speech cross join (select unnest([8000, 15000]) as d)""")
def e5_prefix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.prefix_windows(speeches(spark, sf_dir).select("longform_id", "speech_id", "start_ms", "end_ms"), [8000, 15000])


@query("""select o_orderkey, cast(r as integer) as repeat, sha256('7|' || r || '|' || o_orderkey) as position from orders cross join (select unnest([1, 2]) as r)""")
def e9_repeat_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.repeat_tasks(load(spark, sf_dir, "orders"), "o_orderkey", 2, 7)


@query(f"""{with_views('timeline')} select longform_id, scene_id, start_ms // 60000 as minute, end_ms // 60000 as end_minute from timeline where end_ms // 60000 > start_ms // 60000
    qualify row_number() over (partition by longform_id, start_ms // 60000, end_ms // 60000 order by scene_id) = 1""")
def g1_first_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = timeline(spark, sf_dir).select("longform_id", "scene_id", F.expr("start_ms div 60000").alias("minute"), F.expr("end_ms div 60000").alias("end_minute"))
    return generate.first_windows(t, "longform_id", "minute", "end_minute", "scene_id")


_COARSE = "select longform_id, scene_id, cast(rank as integer) as rank, start_ms // 120000 as s, end_ms // 120000 as e from pred"


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("longform_id", "scene_id", "rank", F.expr("start_ms div 120000").alias("s"), F.expr("end_ms div 120000").alias("e"))


@query(f"""{with_views('pred')}, p as ({_COARSE}), f as (select * from p qualify row_number() over (partition by longform_id, s, e order by rank, scene_id) = 1)
    select *, cast(row_number() over (partition by longform_id order by rank, scene_id) as integer) as new_rank from f""")
def g2_ranked_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ranked_dedupe(_coarse(spark, sf_dir), ["longform_id"], "s", "e", "scene_id")


@query(f"""{with_views('pred')}, p as ({_COARSE}), q as (select *, row_number() over (partition by longform_id order by rank, scene_id) as n from p)
    select longform_id, count(*) as rows, count(distinct (s, e)) as unique_rows, count(distinct (s, e)) filter (n <= 5) as top_unique,
           count(*) - count(distinct (s, e)) as removed, count(distinct (s, e)) < 5 as underfilled from q group by longform_id""")
def g2_dedupe_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.dedupe_audit(_coarse(spark, sf_dir), ["longform_id"], "s", "e", "scene_id")


@query(f"""{with_views('pred')} select longform_id, scene_id, cast(place as integer) as place from (select *, row_number() over (partition by longform_id order by rank, start_ms) as place from pred) where place <= 5""")
def g14_rank_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.top_k(predictions(spark, sf_dir), "longform_id", 5, "rank", "start_ms").select("longform_id", "scene_id", "place")


@query(f"""{with_views('pool')} select pool_id, candidate_id, cast(place as integer) as place from (select *, row_number() over (partition by pool_id order by score desc, candidate_id) as place from pool) where place <= 3""")
def g16_score_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.top_k(pools(spark, sf_dir), "pool_id", 3, F.desc("score"), "candidate_id").select("pool_id", "candidate_id", "place")


@query(f"""{with_views('gold')}, w as (select longform_id, scene_id as source_id, start_ms - 30000 as s, end_ms + 30000 as e from gold),
    m as (select distinct w.*, b.at_ms from (select w.longform_id, w.source_id, w.s, w.e, unnest([t.start_ms, t.end_ms]) as at_ms from w join timeline t on t.longform_id = w.longform_id and t.start_ms < w.e and w.s < t.end_ms and t.end_ms > t.start_ms) b
          join w on w.source_id = b.source_id and w.longform_id = b.longform_id where b.at_ms >= w.s and b.at_ms <= w.e),
    d as (select unnest([8000, 20000]) as d), x as (select longform_id, source_id, greatest(at_ms, s) as start_ms, least(at_ms + d, e) as end_ms from m, d union select longform_id, source_id, greatest(at_ms - d, s), least(at_ms, e) from m, d)
    select longform_id, source_id, start_ms, end_ms from x where end_ms - start_ms >= 5000""")
def e6_boundary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = gold(spark, sf_dir).select("longform_id", F.col("scene_id").alias("source_id"), (F.col("start_ms") - 30000).alias("start_ms"), (F.col("end_ms") + 30000).alias("end_ms"))
    return generate.boundary_windows(sources, timeline(spark, sf_dir), [8000, 20000], 5000)
