"""Queries of greedy selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.operators import select

from .evaluation import query, rounded
from .views import predictions, timeline, with_views

#: Greedy suppression as a recursive query: an item is kept if no kept one before it overlaps it by more than half.
_GREEDY = f"""{with_views('timeline').replace('with ', 'with recursive ', 1)},
    o as (select longform_id, scene_id, value, start_ms as s, end_ms as e, row_number() over (partition by longform_id order by value desc, start_ms, end_ms, scene_id) as n from timeline),
    step as (
        select longform_id, 1::bigint as n, [{{'s': s, 'e': e, 'id': scene_id, 'v': value}}] as chosen from o where n = 1
        union all
        select o.longform_id, o.n, case when len(chosen) < 5 and len(list_filter(chosen, lambda y:
                case when least(o.e - o.s, y.e - y.s) > 0 then greatest(0, least(o.e, y.e) - greatest(o.s, y.s)) / least(o.e - o.s, y.e - y.s) else 0 end > 0.5)) = 0
            then list_append(chosen, {{'s': o.s, 'e': o.e, 'id': o.scene_id, 'v': o.value}}) else chosen end
        from step t join o on o.longform_id = t.longform_id and o.n = t.n + 1),
    done as (select longform_id, chosen from step t where n = (select max(n) from o where o.longform_id = t.longform_id))
    select longform_id, cast(i as integer) as place, chosen[i].id as scene_id, round(chosen[i].v, 6) as score from (select *, unnest(range(1, len(chosen) + 1)) as i from done)"""


@query(_GREEDY)
def g_overlap_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.suppress_overlaps(timeline(spark, sf_dir), 5, 0.5))


_ITEM = "{'s': o.s, 'e': o.e, 'id': o.scene_id, 'v': o.v}"
_SHARE = "case when least(o.e - o.s, y.e - y.s) > 0 then greatest(0, least(o.e, y.e) - greatest(o.s, y.s)) / least(o.e - o.s, y.e - y.s) else 0 end"


def _allowed(most: float) -> str:
    return f"len(list_filter(chosen, lambda y: y.id = o.scene_id or {_SHARE} > {most})) = 0"


def _by_parts(source: str, part: str, parts: int, k: int, most: float, phases: tuple[str, ...]) -> str:
    """SQL of a selection: the best allowed item of each part in turn, then phases over all items in order, each with its own condition."""
    views = with_views("timeline", *([source] if source != "timeline" else [])).replace("with ", "with recursive ", 1)
    sql = f"""{views}, o as (select *, {part} as part from (select longform_id, scene_id, value as v, start_ms as s, end_ms as e, {'rank, max(rank) over (partition by longform_id) as top,' if source == 'pred' else ''}
            row_number() over (partition by longform_id order by value desc, start_ms, end_ms, scene_id) as n, greatest(1, max(end_ms) over (partition by longform_id)) as length from {source})),
        p0 as (select longform_id, 0::bigint as r, [{{'s': start_ms, 'e': end_ms, 'id': scene_id, 'v': value}}][1:0] as chosen from {source} qualify row_number() over (partition by longform_id) = 1
            union all select longform_id, r + 1, case when x is not null and len(chosen) < {k} then list_append(chosen, x) else chosen end from (
                select t.longform_id, t.r, t.chosen, arg_min({_ITEM}, o.n) filter (o.part = t.r and {_allowed(most)}) as x from p0 t join o on o.longform_id = t.longform_id where t.r < {parts} group by t.longform_id, t.r, t.chosen)),
        d0 as (select longform_id, chosen from p0 where r = {parts})"""
    for i, test in enumerate(phases):
        sql += f""",
        p{i + 1} as (select longform_id, 0::bigint as n, chosen from d{i}
            union all select t.longform_id, o.n, case when len(chosen) < {k} and {test} then list_append(chosen, {_ITEM}) else chosen end from p{i + 1} t join o on o.longform_id = t.longform_id and o.n = t.n + 1),
        d{i + 1} as (select longform_id, chosen from p{i + 1} t where n = (select max(n) from o where o.longform_id = t.longform_id))"""
    return sql + f" select longform_id, cast(i as integer) as place, chosen[i].id as scene_id, round(chosen[i].v, 6) as score from (select *, unnest(range(1, len(chosen) + 1)) as i from d{len(phases)})"


@query(_by_parts("timeline", "least(11, (s + e) * 12 // (2 * length))", 12, 12, 0.72, (_allowed(0.72),)))
def g5_bins_then_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.bins_then_fill(timeline(spark, sf_dir), 12, 12, 0.72))


@query(f"""{with_views('timeline').replace('with ', 'with recursive ', 1)}, o as (select longform_id, scene_id, value as v, start_ms as s, end_ms as e, greatest(1, max(end_ms) over (partition by longform_id)) as length from timeline),
    p as (select longform_id, 0 as r, [{{'s': start_ms, 'e': end_ms, 'id': scene_id, 'v': value}}][1:0] as chosen from timeline qualify row_number() over (partition by longform_id) = 1
        union all select longform_id, r + 1, case when x is not null then list_append(chosen, x) else chosen end from (
            select longform_id, r, chosen, arg_min({_ITEM}, {{'w': -w, 'c': -o.v, 's': o.s, 'e': o.e, 'id': o.scene_id}}) as x from (
                select t.longform_id, t.r, t.chosen, o, case when {_allowed(0.62)} then round(o.v + 2.0 * coalesce(least(1.0, list_min(list_transform(chosen, lambda y: abs((o.s + o.e) - (y.s + y.e)) / 2.0)) / o.length / 0.13), 1.0)
                    - 1.5 * coalesce(list_max(list_transform(chosen, lambda y: {_SHARE})), 0.0), 9) end as w from p t join o on o.longform_id = t.longform_id where t.r < 5) where true group by longform_id, r, chosen)),
    d as (select longform_id, chosen from p where r = 5)
    select longform_id, cast(i as integer) as place, chosen[i].id as scene_id, round(chosen[i].v, 6) as score from (select *, unnest(range(1, len(chosen) + 1)) as i from d)""")
def g7_relevance_and_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.relevance_and_diversity(timeline(spark, sf_dir), 5, 0.62, 2.0, 1.5))


@query(_by_parts("pred", "least(3, floor((rank - 1) * 4 / greatest(1, top)))", 4, 10, 0.45, (_allowed(0.45), "len(list_filter(chosen, lambda y: y.id = o.scene_id)) = 0")))
def g9_source_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(select.source_bands(predictions(spark, sf_dir), 10, 4, 0.45, "rank"))
