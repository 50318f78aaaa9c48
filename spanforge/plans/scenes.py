"""Queries of scene payloads, evidence, windows and the scores of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import scores as sc
from spanforge.functions import text as tx
from spanforge.operators import pools, scenes, windows

from .evaluation import query, rounded
from .views import load, speeches, tasks_for, timeline, with_views

#: Scenes of a conversation: four turns each.
_SCENE = """scene as (select longform_id, scene_id, min(start_ms) as start_ms, max(end_ms) as end_ms, any_value(scene_id % 5 = 0) as is_fallback, left(arg_min(text, speech_id), 60) as description
        from (select *, speech_id // 4 as scene_id from speech) group by longform_id, scene_id)"""


def placed_speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeches with the id and bounds of their scene."""
    w = Window.partitionBy("longform_id", "scene_id")
    s = speeches(spark, sf_dir).withColumn("scene_id", F.expr("speech_id div 4"))
    return s.withColumns({"scene_start_ms": F.min("start_ms").over(w), "scene_end_ms": F.max("end_ms").over(w)})


def scene_rows(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    s = speeches(spark, sf_dir, tasks).withColumn("scene_id", F.expr("speech_id div 4"))
    return s.groupBy("longform_id", "scene_id").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), (F.first("scene_id") % 5 == 0).alias("is_fallback"),
        F.substring(F.min_by("text", "speech_id"), 1, 60).alias("description")).withColumns({"name": F.lit(""), "person_ids": F.array().cast("array<string>")})


@query(f"""{with_views('speech')}, u as (select longform_id, speech_id // 4 as scene_id, speech_id, speaker_id, trim(text) as text, start_ms, end_ms from speech),
    c as (select *, cast(start_ms // 1000 as bigint) as s, cast(end_ms // 1000 as bigint) as e from u where text <> ''),
    l as (select longform_id, scene_id, '[' || case when s >= 3600 then (s // 3600) || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') else (s // 60) || ':' || lpad((s % 60)::varchar, 2, '0') end
             || '-' || case when e >= 3600 then (e // 3600) || ':' || lpad((e % 3600 // 60)::varchar, 2, '0') || ':' || lpad((e % 60)::varchar, 2, '0') else (e // 60) || ':' || lpad((e % 60)::varchar, 2, '0') end
             || '] S' || speaker_id || ': ' || text as line, start_ms, end_ms from c),
    t as (select longform_id, scene_id, string_agg(line, chr(10) order by start_ms, end_ms) as transcript, count(*) as n from l group by all)
    select b.longform_id, cast(b.scene_id as varchar) as scene_id, round(b.s / 1000.0, 6) as start_sec, round(b.e / 1000.0, 6) as end_sec, round((b.e - b.s) / 1000.0, 6) as duration_sec,
           case when b.scene_id % 3 = 0 then 'scene ' || b.scene_id when b.scene_id % 3 = 1 then 'about ' || b.scene_id else 'sum ' || b.scene_id end as description, cast(coalesce(n, 0) as integer) as speeches, coalesce(transcript, '') as transcript
    from (select longform_id, scene_id, min(start_ms) as s, max(end_ms) as e from u group by all) b left join t using (longform_id, scene_id)""")
def c1_c3_scene_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes written as JSON under three sets of names, and read back by one schema."""
    s = placed_speeches(spark, sf_dir)
    line = F.struct(
        "speech_id", F.when(F.col("speech_id") % 2 == 0, F.col("start_ms")).alias("start_ms"), F.when(F.col("speech_id") % 2 == 1, F.col("start_ms")).alias("startTimeMs"), F.col("end_ms").alias("end_time_ms"),
        F.when(F.col("speech_id") % 2 == 0, F.col("text")).alias("text"), F.when(F.col("speech_id") % 2 == 1, F.col("text")).alias("utterance"), F.col("speaker_id").alias("speaker"))
    one = s.groupBy("longform_id", "scene_id").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.collect_list(line).alias("said"))
    kind = F.col("scene_id") % 3
    at = lambda k, c: F.when(kind == k, c)
    label = F.col("scene_id").cast("string")
    payload = F.struct(
        at(0, label).alias("scene_id"), at(1, label).alias("id"), at(2, label).alias("sceneId"), at(0, F.col("s")).alias("start_ms"), at(1, F.col("s")).alias("startTimeMs"), at(2, F.col("s")).alias("start_time_ms"),
        at(0, F.col("e")).alias("end_time_ms"), at(1, F.col("e")).alias("end_ms"), at(2, F.col("e")).alias("endTimeMs"), at(0, F.concat(F.lit("scene "), label)).alias("description"),
        at(1, F.concat(F.lit("about "), label)).alias("scene_description"), at(2, F.concat(F.lit("sum "), label)).alias("summary"), at(0, F.col("said")).alias("speeches"), at(1, F.col("said")).alias("transcript"), at(2, F.col("said")).alias("script"))
    listed = one.groupBy("longform_id").agg(F.to_json(F.collect_list(payload)).alias("list"))
    held = F.concat(F.lit('{"items": '), F.col("list"), F.lit("}"))
    payloads = listed.select("longform_id", F.when(F.crc32(F.col("longform_id").cast("string")) % 2 == 0, F.col("list")).otherwise(held).alias("payload"))
    out = scenes.normalize_scenes(payloads, "longform_id", "payload")
    return rounded(out.select("longform_id", "scene_id", "start_sec", "end_sec", "duration_sec", "description", F.size("speeches").alias("speeches"), "transcript"))


@query(f"""{with_views('speech')}, {_SCENE} select longform_id, cast(scene_id as bigint) as scene_id, case when longform_id % 3 = 0 then 'primary' else 'fallback' end as provider from scene where longform_id % 3 = 0 or longform_id % 2 = 0""")
def a5_provider_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scene_rows(spark, sf_dir).select("longform_id", F.col("scene_id").cast("long").alias("scene_id"))
    return scenes.with_fallback(s.where("longform_id % 3 = 0"), s.where("longform_id % 3 = 0 or longform_id % 2 = 0"), "longform_id")


@query("""select doc_id, round(case when length(regexp_replace(text, '\\s', '', 'g')) > 0 then length(regexp_replace(text, '[^\\x{FFFD}?\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]', '', 'g')) / length(regexp_replace(text, '\\s', '', 'g')) else 0 end, 6) as garbled,
    length(trim(text)) >= 8 and case when length(regexp_replace(text, '\\s', '', 'g')) > 0 then length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '\\s', '', 'g')) else 0 end >= 0.1
      and case when length(regexp_replace(text, '\\s', '', 'g')) > 0 then length(regexp_replace(text, '[^\\x{FFFD}?\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]', '', 'g')) / length(regexp_replace(text, '\\s', '', 'g')) else 0 end <= 0.35 as usable,
    length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) as solid from documents""")
def c5_c17_usable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scenes.text_quality(load(spark, sf_dir, "documents"), "doc_id", "text", "A-Za-z"))


_TOLD = """told as (select conv_id, string_agg('[' || (turn // 60) || ':' || lpad((turn % 60)::varchar, 2, '0') || '-' || ((turn + 1) // 60) || ':' || lpad(((turn + 1) % 60)::varchar, 2, '0') || '] S' || left(role, 1) || ': ' || text, chr(10) order by turn) as t, count(*) as n,
    count(distinct left(role, 1)) as speakers from conversations group by conv_id)"""


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stamped transcript of each conversation, a second a turn."""
    s = F.struct("turn", F.col("turn").cast("double").alias("start_sec"), (F.col("turn") + 1).cast("double").alias("end_sec"), F.substring("role", 1, 1).alias("speaker_id"), "text")
    return load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(s)).alias("s")).select("conv_id", scenes.transcript("s").alias("t"), F.size("s").alias("n"))


@query(f"""with {_TOLD}, turns as (select conv_id, count(*) filter (r <> before) as turns from (select conv_id, left(role, 1) as r, lag(left(role, 1)) over (partition by conv_id order by turn) as before from conversations) group by conv_id)
    select conv_id, length(t) as chars, n as timed_lines, speakers, turns, length(regexp_replace(t, '[^?]', '', 'g')) as questions, round(ln(1 + length(t)), 6) as log_chars, round(length(t) / greatest(1.0, n), 6) as chars_per_second,
      round(ln(1 + length(regexp_replace(t, '[^\\[\\]()]', '', 'g'))), 6) as brackets, length(trim(t)) < 20 as missing from told join turns using (conv_id) where not contains(t, chr(10) || chr(10))""")
def c11_c13_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = told(spark, sf_dir).where(~F.contains("t", F.lit("\n\n")))
    s, f = tx.transcript_statistics("t"), tx.structure_features("t", F.lit(None).cast("string"), F.col("n"))
    return rounded(t.select(
        "conv_id", s["chars"].alias("chars"), s["timed_lines"].cast("long").alias("timed_lines"), s["speakers"].cast("long").alias("speakers"), s["turns"].cast("long").alias("turns"), s["questions"].alias("questions"),
        f["transcript_log_chars"].alias("log_chars"), f["chars_per_second"].alias("chars_per_second"), f["brackets"].alias("brackets"), (f["transcript_missing"] == 1).alias("missing")))


@query(f"""with {_TOLD} select conv_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '\\[\\s*\\d+:\\d+(?::\\d+)?\\s*-\\s*\\d+:\\d+(?::\\d+)?\\s*\\]', ' ', 'g'), '\\bS\\d+\\s*:', ' SPEAKER ', 'gi'), '\\s+', ' ', 'g')) as plain from told""")
def c14_plain_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir).select("conv_id", tx.normalize_text("t").alias("plain"))


@query("""select p_partkey, length(p_name) as short_chars, length(regexp_replace(p_name, '[^?]', '', 'g')) as short_questions, regexp_matches(p_name, '[0-9]') as short_digit, length(p_brand) as long_chars, regexp_matches(p_brand, '[0-9]') as long_digit from part""")
def c12_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tx.title_features("p_name", "p_brand")
    return load(spark, sf_dir, "part").select("p_partkey", *(f[c].alias(c) for c in ("short_chars", "short_questions", "short_digit", "long_chars", "long_digit")))


@query("""select doc_id, case when doc_id % 5 = 0 then null else doc_id end as id, case when doc_id % 5 = 0 then null else lang end as lang from documents""")
def c18_json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("doc_id").alias("id"), "lang"))
    k = F.col("doc_id") % 5
    answer = (F.when(k == 1, body).when(k == 2, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone."))).when(k == 3, F.concat(F.lit("<think>{maybe}</think>\n"), body))
              .when(k == 4, F.concat(F.lit("The answer is "), body, F.lit(" I think."))).otherwise(F.concat(F.lit("["), F.lit('1, 2'), F.lit("] and {broken"))))
    found = tx.json_object(answer)
    return load(spark, sf_dir, "documents").select("doc_id", F.get_json_object(found, "$.id").cast("long").alias("id"), F.get_json_object(found, "$.lang").alias("lang"))


@query("""with x as (select conv_id, list(trim(text) order by turn) as l from conversations where not contains(text, chr(10)) and trim(text) <> '' group by conv_id)
    select conv_id, left(l[1], 180) as first, left(l[len(l)], 180) as last, left(list_sort(list_transform(l, lambda q, i: {'n': -length(q), 'i': i, 's': q}))[1].s, 180) as longest, coalesce(left(list_filter(l, lambda q: contains(q, 'th') or contains(q, 'ei'))[1], 180), '') as hook from x""")
def c19_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations").where(~F.contains("text", F.lit("\n")) & (F.trim("text") != ""))
    line = F.concat(F.lit("[0:00-0:01] S1: "), F.trim("text"))
    t = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda y: y["x"]), "\n").alias("t"))
    q = tx.quotes("lines", {"hook": ("th", "ei")})
    return t.withColumn("lines", tx.spoken_lines("t")).select("conv_id", *(v.alias(n) for n, v in q.items()))


@query(f"""{with_views('speech')}, {_SCENE} select longform_id, count(*) as scenes, string_agg(left(description, 20), '|' order by start_ms, end_ms, scene_id) as names from scene group by longform_id""")
def c20_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = scenes.overview(scene_rows(spark, sf_dir), "longform_id", description_chars=20)
    return o.select("longform_id", F.size("scenes").cast("long").alias("scenes"), F.array_join(F.transform("scenes", lambda x: x["description"]), "|").alias("names"))


_SOURCES = "src as (select longform_id || '-' || scene_id as source_id, longform_id, scene_id, start_ms + 500 as s, end_ms + 1500 as e from scene)"


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene_rows(spark, sf_dir).select(
        F.concat_ws("-", "longform_id", "scene_id").alias("source_id"), "longform_id", (F.col("start_ms") + 500).alias("start_ms"), (F.col("end_ms") + 1500).alias("end_ms"), F.array("scene_id").alias("scene_ids"))


@query(f"""{with_views('speech')}, {_SCENE}, {_SOURCES}, x as (select *, speech_id // 4 as sid from speech)
    select distinct source_id, greatest(s, x.start_ms) as start_ms, least(e, x.end_ms) as end_ms, text from src join x using (longform_id) join scene c on c.longform_id = x.longform_id and c.scene_id = x.sid
    where x.start_ms < e and s < x.end_ms and x.end_ms > x.start_ms and (x.sid = src.scene_id or (c.start_ms < e and s < c.end_ms))""")
def d5_related_speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.related_speeches(source_rows(spark, sf_dir), placed_speeches(spark, sf_dir))


_UNION = """union_of as (select source_id, kind, sum(hi - lo) as ms from (select source_id, kind, island, min(lo) as lo, max(hi) as hi from (
        select *, sum(fresh) over (partition by source_id, kind order by lo, hi rows unbounded preceding) as island from (
            select *, case when lo > max(hi) over (partition by source_id, kind order by lo, hi rows between unbounded preceding and 1 preceding) or row_number() over (partition by source_id, kind order by lo, hi) = 1 then 1 else 0 end as fresh from pieces where hi > lo)) group by all) group by all)"""


@query(f"""{with_views('speech')}, {_SCENE}, {_SOURCES}, pieces as (
        select source_id, 'scene' as kind, greatest(s, c.start_ms) as lo, least(e, c.end_ms) as hi from src join scene c using (longform_id) where c.start_ms < e and s < c.end_ms and c.end_ms > c.start_ms
        union all select source_id, 'speech', greatest(s, x.start_ms), least(e, x.end_ms) from src join speech x using (longform_id) where x.start_ms < e and s < x.end_ms and x.end_ms > x.start_ms), {_UNION},
    cs as (select source_id, count(*) as n, count(*) filter (is_fallback) as f from src join scene c using (longform_id) where c.start_ms < e and s < c.end_ms and c.end_ms > c.start_ms group by source_id),
    xs as (select source_id, count(distinct (x.start_ms, x.end_ms, speech_id, speaker_id, text)) as n, count(distinct nullif(speaker_id, '')) as k from src join speech x using (longform_id) where x.start_ms < e and s < x.end_ms and x.end_ms > x.start_ms group by source_id),
    b as (select longform_id, start_ms as mark from scene union select longform_id, end_ms from scene),
    g as (select source_id, min(abs(s - mark)) as sg, min(abs(e - mark)) as eg from src join b using (longform_id) group by source_id)
    select source_id, coalesce(cs.n, 0) as scene_count, coalesce(xs.n, 0) as speech_count, coalesce(xs.k, 0) as unique_speakers, round(coalesce(cs.f, 0) / greatest(1, coalesce(cs.n, 1)), 6) as fallback_share,
      round(greatest(0, coalesce(cs.n, 0) - 1) * 60.0 / ((e - s) / 1000.0), 6) as scene_rate, round(coalesce(xs.n, 0) * 60.0 / ((e - s) / 1000.0), 6) as speech_rate,
      round(least(1.0, coalesce(us.ms, 0) / 1000.0 / ((e - s) / 1000.0)), 6) as scene_coverage, round(least(1.0, coalesce(ux.ms, 0) / 1000.0 / ((e - s) / 1000.0)), 6) as speech_coverage,
      round(sg / 1000.0, 6) as start_gap_sec, round(eg / 1000.0, 6) as end_gap_sec, sg <= 2000 as start_aligned, eg <= 2000 as end_aligned
    from src left join cs using (source_id) left join xs using (source_id) left join g using (source_id) left join union_of us on us.source_id = src.source_id and us.kind = 'scene' left join union_of ux on ux.source_id = src.source_id and ux.kind = 'speech'""")
def d6_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = source_rows(spark, sf_dir).withColumnRenamed("source_id", "candidate_id")
    f = scenes.window_features(w, scene_rows(spark, sf_dir), speeches(spark, sf_dir))
    return rounded(f.select(
        F.col("candidate_id").alias("source_id"), F.col("scene_count").cast("long").alias("scene_count"), F.col("speech_count").cast("long").alias("speech_count"), F.col("unique_speakers").cast("long").alias("unique_speakers"),
        "fallback_share", "scene_rate", "speech_rate", "scene_coverage", "speech_coverage", "start_gap_sec", "end_gap_sec", "start_aligned", "end_aligned"))


@query(f"""{with_views('speech')}, {_SCENE}, ranked as (select *, longform_id || '-' || scene_id as source_id, row_number() over (partition by longform_id order by end_ms - start_ms desc, scene_id) as rank from scene), s as (select * from ranked where rank <= 3),
    w as (select longform_id, source_id, rank, 0 as part, d as first, 'prepend' as kind, start_ms, least(end_ms, start_ms + d) as end_ms from s, (select unnest([15000, 25000]) as d)
        union all select longform_id, source_id, rank, 1, 0, 'source_full', start_ms, end_ms from s where end_ms - start_ms <= 20000
        union all select longform_id, source_id, rank, 1, i, 'spaced', start_ms + (end_ms - start_ms - 20000) * i // 2, start_ms + (end_ms - start_ms - 20000) * i // 2 + 20000 from s, range(3) r(i) where end_ms - start_ms > 20000),
    o as (select * from w where end_ms > start_ms qualify row_number() over (partition by source_id, start_ms, end_ms order by part, first) = 1),
    n as (select *, row_number() over (partition by source_id order by part, first, start_ms, end_ms) as window_rank from o)
    select longform_id, source_id, cast(rank as integer) as source_rank, cast(window_rank as integer) as window_rank, kind, start_ms, end_ms, cast(row_number() over (partition by longform_id order by rank, source_id, window_rank) as integer) as rank from n""")
def e7_expanded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("longform_id").orderBy(F.desc("_d"), "scene_id")
    s = scene_rows(spark, sf_dir).withColumn("_d", F.col("end_ms") - F.col("start_ms")).withColumn("rank", F.row_number().over(w))
    s = s.withColumn("source_id", F.concat_ws("-", "longform_id", "scene_id"))
    return windows.expand_sources(s, [20_000], 3, [15_000, 25_000], most_rank=3)


_TARGETS = "target as (select longform_id, 9000 + 1000 * (longform_id % 7) as target_ms from (select distinct longform_id from scene))"
_WINDOWS = f"""runs as (select t.longform_id, target_ms, a.start_ms, b.end_ms, 1.0 as strength from target t join scene a using (longform_id) join scene b using (longform_id)
        where b.end_ms - a.start_ms between greatest(8000, 0.75 * target_ms) and least(120000, 1.25 * target_ms)
        union all select t.longform_id, target_ms, a.start_ms, b.end_ms, 0.85 from target t join speech a using (longform_id) join speech b using (longform_id)
        where b.end_ms - a.start_ms between greatest(8000, 0.75 * target_ms) and least(120000, 1.25 * target_ms)),
    edges as (select t.longform_id, target_ms, unnest([start_ms, greatest(start_ms, end_ms - target_ms)]) as start_ms, target_ms as size from target t join scene using (longform_id)
        where end_ms - start_ms >= target_ms and t.longform_id not in (select longform_id from runs)),
    win as (select longform_id, target_ms, start_ms, end_ms, max(strength) as strength from (select * from runs union all select longform_id, target_ms, start_ms, start_ms + size, 0.65 from edges) group by all)"""


def targets(spark: SparkSession, sf_dir: str, tasks: int = 0) -> DataFrame:
    return scene_rows(spark, sf_dir, tasks).select("longform_id").distinct().withColumn("target_ms", (9000 + 1000 * (F.col("longform_id") % 7)).cast("long"))


@query(f"""{with_views('speech')}, {_SCENE}, {_TARGETS}, {_WINDOWS} select longform_id, target_ms, start_ms, end_ms, cast(strength as double) as boundary_strength from win""")
def e8_evaluation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.evaluation_windows(targets(spark, sf_dir), scene_rows(spark, sf_dir), speeches(spark, sf_dir)).drop("boundary_type")


def hard_negative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts meet several times in one task, so they go to as many tasks as the rows need, which Spark doesn't join again
    tasks = tasks_for(load(spark, sf_dir, "conversations"))
    s = scene_rows(spark, sf_dir, tasks)
    known = s.where("scene_id = 0").select("longform_id", "start_ms", "end_ms")
    return windows.hard_negatives(targets(spark, sf_dir, tasks), s, speeches(spark, sf_dir, tasks), known)


@query(f"""{with_views('speech')}, {_SCENE}, {_TARGETS}, {_WINDOWS}, known as (select longform_id, greatest(0, start_ms - 2000) as ks, end_ms + 2000 as ke from scene where scene_id = 0),
    ok as (select w.*, row_number() over () as source_id, start_ms as s, end_ms as e from win w where not exists (select 1 from known k where k.longform_id = w.longform_id and k.ks < w.end_ms and w.start_ms < k.ke)),
    pieces as (select source_id, 'speech' as kind, greatest(s, x.start_ms) as lo, least(e, x.end_ms) as hi from ok join speech x using (longform_id) where x.start_ms < e and s < x.end_ms and x.end_ms > x.start_ms), {_UNION},
    d as (select source_id, string_agg(trim(description), ' ' order by c.start_ms, c.end_ms, c.scene_id) filter (trim(coalesce(description, '')) <> '') as t from ok join scene c using (longform_id) where c.start_ms < e and s < c.end_ms and c.end_ms > c.start_ms group by source_id),
    xs as (select source_id, count(distinct (x.start_ms, x.end_ms, speech_id, speaker_id, text)) as n, count(distinct nullif(speaker_id, '')) as k from ok join speech x using (longform_id) where x.start_ms < e and s < x.end_ms and x.end_ms > x.start_ms group by source_id),
    f as (select ok.*, coalesce(xs.n, 0) as n, coalesce(xs.k, 0) as k, least(1.0, coalesce(u.ms, 0) / (e - s)) as cov, trim(coalesce(d.t, '')) as t from ok left join xs using (source_id) left join d using (source_id) left join union_of u using (source_id) where coalesce(xs.n, 0) > 0 or trim(coalesce(d.t, '')) <> ''),
    q as (select *, length(regexp_replace(t, '\\s', '', 'g')) as solid, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as latin, length(regexp_replace(t, '[^\\x{{FFFD}}?\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) as odd from f),
    h as (select *, round(0.25 * exp(-abs(ln(greatest(0.001, (e - s) / 1000.0) / (target_ms / 1000.0)))) + 0.20 * least(1.0, n / 8.0) + 0.15 * cov + 0.10 * least(1.0, k / 2.0) + 0.10 * least(1.0, solid / 240.0) + 0.10 * strength
        + 0.10 * (length(t) >= 8 and solid > 0 and latin / greatest(1, solid) >= 0.1 and odd / greatest(1, solid) <= 0.35)::int, 9) as hardness from q)
    select longform_id, target_ms, round(hardness, 6) as hardness, count(*) over (partition by longform_id) as pool_size from h qualify row_number() over (partition by longform_id order by hardness desc, abs(e - s - target_ms), s, e) = 1""")
def g17_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hard_negative_rows(spark, sf_dir).select("longform_id", "target_ms", "hardness", "pool_size"))


@query(f"""{with_views('timeline')}, r as (select *, row_number() over (partition by longform_id order by value desc, scene_id) as rank from timeline), x as (select *, start_ms // 60000 as s, start_ms // 60000 + 1 as e from r)
    select longform_id, scene_id, cast(rank as integer) as rank from x qualify row_number() over (partition by longform_id, s, e, event_type order by rank, scene_id) = 1""")
def g4_unique_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("longform_id").orderBy(F.desc("value"), "scene_id")
    t = timeline(spark, sf_dir).withColumn("rank", F.row_number().over(w)).withColumns({"s": F.expr("start_ms div 60000"), "e": F.expr("start_ms div 60000 + 1")})
    return windows.unique_candidates(t, ["rank", "scene_id"], start="s", end="e", scenes="event_type").select("longform_id", "scene_id", "rank")


_COUNT = lambda t, x: f"(length({t}) - length(replace({t}, '{x}', ''))) / {len(x)}.0"
_LOW = "lower(t)"


@query(f"""{with_views('speech')}, x as (select longform_id, speech_id, text as t, start_ms / 1000.0 as s, end_ms / 1000.0 as e, speech_id + 1 as rank from speech),
    c as (select *, e - s as d, case when longform_id % 2 = 0 then least(8.0, {_COUNT(_LOW, 'the')} * 2.0) else least(8.0, {_COUNT(_LOW, 'un')} * 1.5) end / 8.0 as signal,
        case when longform_id % 2 = 0 then greatest(0.0, 1 - abs(e - s - 55.0) / 55.0) else greatest(0.0, 1 - abs(e - s - 45.0) / 45.0) end as duration, least(10.0, length(regexp_replace(t, '[^\\n]', '', 'g'))) / 10.0 as density,
        least(5.0, {_COUNT('t', '?')} + {_COUNT('t', '!')}) / 5.0 as title, greatest(0.0, 1 - (rank - 1) / 120.0) as prior, (speech_id % 3 = 0)::int as sliding, (speech_id % 3 = 1)::int as boundary, least(5.0, {_COUNT(_LOW, 'er')}) / 5.0 as filler from x)
    select longform_id, speech_id, round(0.5 * signal + 1.7 * duration + 1.8 * density + 0.4 * title + 0.5 * prior + 0.5 * sliding + 0.5 * boundary - 2.5 * filler - 0.2, 6) as score,
        round(case when d between 25 and 35 or d between 40 and 50 or d between 55 and 65 then 0.5 when d between 70 and 80 then 0.2 else 0 end, 6) as bonus, round(case when s < 90 then 0 when s < 180 then 0.35 when s < 300 then 0.7 else 1 end, 6) as position,
        round(case when length(trim(t)) = 0 then 0 else least(1.0, greatest(length(trim(t)) / 450.0, length(regexp_replace(t, '[^\\n]', '', 'g')) / 8.0)) end, 6) as volume from c""")
def f2_trim_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = speeches(spark, sf_dir).withColumns({
        "kind": F.when(F.col("speech_id") % 3 == 0, "sliding").when(F.col("speech_id") % 3 == 1, "speech_boundary").otherwise("spaced"), "rank": F.col("speech_id") + 1,
        "genre": F.when(F.col("longform_id") % 2 == 0, "lecture").otherwise("variety"), "s": F.col("start_ms") / 1000.0, "e": F.col("end_ms") / 1000.0})
    none = F.lit(None).cast("int")
    c = sc.trim_components("text", "s", "e", "kind", none, "rank", none, "genre", {"the": 2.0}, {"un": 1.5}, {"er": 1.0}, ["?", "!"])
    return rounded(s.select("longform_id", "speech_id", sc.trim_score(c, F.lit("other")).alias("score"), c["duration_bucket"].alias("bonus"), c["position"].alias("position"), c["content_volume"].alias("volume")))


@query(f"""{with_views('speech')}, x as (select longform_id, speech_id, round({_COUNT('text', 'th')} + {_COUNT('text', 'ei')} + greatest(0.0, 1 - abs((end_ms - start_ms) / 1000.0 - 45.0) / 45.0), 6) as score, abs((end_ms - start_ms) / 1000.0 - 45.0) as off from speech)
    select longform_id, speech_id, score from x qualify row_number() over (partition by longform_id order by score desc, off, speech_id) = 1""")
def f3_placeholder_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = speeches(spark, sf_dir).withColumn("d", (F.col("end_ms") - F.col("start_ms")) / 1000.0).withColumn("score", F.round(sc.placeholder_score("text", "d", ["th", "ei"]), 6))
    best = F.min_by(F.struct("speech_id", "score"), F.struct(-F.col("score"), F.abs(F.col("d") - 45.0), F.col("speech_id")))
    return s.groupBy("longform_id").agg(best.alias("b")).select("longform_id", "b.*")


_DIMS = """q as (select l_orderkey, l_linenumber, cast(l_quantity as integer) % 5 as opening, (cast(l_quantity as integer) // 5) % 5 as change, l_partkey % 5 as gain, l_suppkey % 5 as memorable, (l_partkey // 5) % 5 as progression, l_linenumber % 5 as boundary,
    1 + l_orderkey % 5 as clear, cast(l_extendedprice as double) / 500 as seconds, l_returnflag = 'R' as asr, l_returnflag = 'A' as visual from lineitem)"""
_ROUND = lambda x, lo, hi: f"cast(round_even(round(least({hi}.0, greatest({lo}.0, {x})), 9), 0) as integer)"
_BASE = _ROUND("(0.29 * opening + 0.23 * change + 0.27 * gain + 0.21 * memorable) / 4.0 * 100.0", 0, 100)


@query(f"""with {_DIMS}, b as (select *, {_BASE} as base from q)
    select l_orderkey, l_linenumber, base as saliency, {_ROUND("base - case clear when 3 then 3 when 2 then 8 when 1 then 15 else 0 end - case when asr then 3 else 0 end - case when visual then 4 else 0 end", 0, 100)} as evidence_saliency,
      {_ROUND("[8, 18, 32, 48, 67][opening + 1] + (change - 2) * 2", 1, 80)} as stop, {_ROUND("28 + 15 * ((progression + boundary + gain) / 3.0) - case when seconds > 90 then 8 when seconds > 60 then 4 else 0 end", 20, 92)} as watch,
      {_ROUND("[2, 5, 10, 20, 36][cast(round_even((gain + memorable) / 2.0, 0) as integer) + 1] + greatest(0, change - 2) * 2", 1, 50)} as share, cast(greatest(0, boundary - asr::int) as integer) as natural_start, cast(greatest(0, boundary - visual::int) as integer) as natural_end from b""")
def f11_rescores(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    d = {"opening": q % 5, "change": F.floor(q / 5).cast("int") % 5, "gain": (F.col("l_partkey") % 5).cast("int"), "memorable": (F.col("l_suppkey") % 5).cast("int"),
         "progression": (F.expr("l_partkey div 5") % 5).cast("int"), "boundary": (F.col("l_linenumber") % 5).cast("int")}
    flags = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "asr_degraded"), F.when(F.col("l_returnflag") == "A", "visual_dependent"), F.when(F.col("l_returnflag") == "R", "awkward_start"), F.when(F.col("l_returnflag") == "A", "awkward_end")))
    rows = load(spark, sf_dir, "lineitem").withColumns({**d, "flags": flags, "clear": (1 + F.col("l_orderkey") % 5).cast("int"), "seconds": F.col("l_extendedprice").cast("double") / 500})
    names = {k: k for k in d}
    rows = rows.withColumn("base", sc.saliency(names))
    f, ends = sc.funnel_chances(names, "seconds"), sc.rubric_checks({}, "boundary", "flags")
    return rows.select("l_orderkey", "l_linenumber", F.col("base").alias("saliency"), sc.evidence_saliency("base", "clear", "flags").alias("evidence_saliency"),
                       *(v.alias(k) for k, v in f.items()), *(v.cast("int").alias(k) for k, v in ends.items()))


@query(f"""with {_DIMS}, b as (select *, {_BASE} as base from q) select l_orderkey, l_linenumber, v.version, cast(case v.version when 'v1' then least(5, greatest(1, base // 20 + 1)) when 'v4' then {_ROUND("0.75 * base + 0.25 * (progression + boundary) / 2 / 4.0 * 100.0", 0, 100)} else base end as double) as primary_value,
    case when v.version = 'v1' then cast(gain // 2 as double) end as checks from b, (values ('v1'), ('v2'), ('v4')) v(version)""")
def e10_version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    d = {"opening": q % 5, "change": F.floor(q / 5).cast("int") % 5, "gain": (F.col("l_partkey") % 5).cast("int"), "memorable": (F.col("l_suppkey") % 5).cast("int"), "progression": (F.expr("l_partkey div 5") % 5).cast("int"), "boundary": (F.col("l_linenumber") % 5).cast("int")}
    rows = load(spark, sf_dir, "lineitem").withColumns(d).withColumn("base", sc.saliency({k: k for k in d})).withColumn("id", F.struct("l_orderkey", "l_linenumber"))
    base = F.col("base")
    direct = F.bround(F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 0.75 * base + 0.25 * (F.col("progression") + F.col("boundary")) / 2 / 4.0 * 100.0)), 9))
    versions = {"v1": {"primary_value": F.least(F.lit(5), F.greatest(F.lit(1), F.floor(base / 20) + 1)), "checks": F.floor(F.col("gain") / 2)}, "v2": {"primary_value": base}, "v4": {"primary_value": direct}}
    return pools.version_rows(rows, versions, "id").select("id.*", "version", "primary_value", "checks")


@query("""with q as (select l_orderkey, l_linenumber, [cast(l_quantity as integer) % 5, l_partkey % 5, l_suppkey % 5, l_orderkey % 5, l_linenumber % 5, (l_partkey // 5) % 5, (l_suppkey // 5) % 5] as d from lineitem), x as (select l_orderkey, l_linenumber, list_transform(d, lambda y: y / 4.0) as d from q)
    select l_orderkey, l_linenumber, round(list_avg(d), 6) as mean, round(list_min(d), 6) as least, round(list_stddev_pop(d), 6) as spread, round(list_avg(d[1:3]), 6) as head_mean, round(list_avg(d[4:7]), 6) as rest_mean, round(least(d[4], d[2]), 6) as least_3_1,
        round(d[4] * d[2], 6) as product_3_1, round(d[1] * d[3], 6) as product_0_2, round(d[5] * d[6], 6) as product_4_5, round(d[6] * d[7], 6) as product_5_6 from x""")
def f18_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = [F.col("l_quantity").cast("int") % 5, F.col("l_partkey") % 5, F.col("l_suppkey") % 5, F.col("l_orderkey") % 5, F.col("l_linenumber") % 5, F.expr("l_partkey div 5") % 5, F.expr("l_suppkey div 5") % 5]
    return rounded(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(v.alias(k) for k, v in tx.interactions(dims).items())))


@query("""with x as (select c_custkey, case when c_acctbal > 5000 then 'relative_high' when c_acctbal < 1000 then 'relative_low' else 'middle' end as tier, case when c_custkey % 100 >= 75 then 'strong' when c_custkey % 100 >= 50 then 'adequate' else 'weak' end as b from customer)
    select c_custkey, case when tier = 'relative_high' and b = 'strong' then 'aligned_high_quality' when tier = 'relative_low' and b = 'weak' then 'aligned_low_quality' when tier = 'relative_low' and b = 'strong' then 'high_quality_relative_underperformer'
      when tier = 'relative_high' and b = 'weak' then 'low_quality_relative_outperformer' else 'mixed_or_nondiagnostic' end as alignment from x""")
def f13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("c_acctbal") > 5000, "relative_high").when(F.col("c_acctbal") < 1000, "relative_low").otherwise("middle")
    return load(spark, sf_dir, "customer").select("c_custkey", tx.alignment_case(tier, tx.band(F.col("c_custkey") % 100)).alias("alignment"))


@query("""select conv_id, turn, case when turn % 3 = 0 then '[SCENE_ASR]' || chr(10) || text || chr(10) || chr(10) || '[CAPTIONS]' || chr(10) || role when turn % 3 = 1 then text else role end as merged,
    case when turn % 3 = 0 then 'scene_asr+candidate_captions' when turn % 3 = 1 then 'full_longform_captions' else 'candidate_captions' end as source from conversations where text <> ''""")
def f16_merged_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 3
    m = tx.merged_transcript(F.when(k != 2, F.col("text")), F.when(k != 1, F.col("role")), k == 0)
    return load(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", m["text"].alias("merged"), m["source"].alias("source"))


@query(f"""{with_views('speech')}, {_SCENE}, c as (select longform_id || '-' || scene_id as candidate_id, longform_id, start_ms as s, end_ms as e, scene_id from scene),
    own as (select longform_id || '-' || (speech_id // 4) as candidate_id, left(string_agg(text, chr(10) order by start_ms, end_ms, text), 5000) as t, max(end_ms) as ms from speech where (speech_id // 4) % 2 = 0 group by all),
    told as (select candidate_id, left(coalesce(string_agg(text, chr(10) order by start_ms, end_ms, speech_id) filter (x.start_ms < e and s < x.end_ms), ''), 5000) as core from c left join speech x on x.longform_id = c.longform_id and x.end_ms > x.start_ms and x.start_ms < e and s < x.end_ms group by candidate_id)
    select candidate_id, coalesce(own.t, told.core) as core, coalesce(own.ms, e - s) as content_ms, case when own.t is not null then 'own_captions_with_long_context' else 'long_captions_interval' end as evidence_source from c join told using (candidate_id) left join own using (candidate_id)""")
def d2_caption_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = placed_speeches(spark, sf_dir).withColumn("candidate_id", F.concat_ws("-", "longform_id", "scene_id"))
    c = scene_rows(spark, sf_dir).select(F.concat_ws("-", "longform_id", "scene_id").alias("candidate_id"), "longform_id", "start_ms", "end_ms")
    own = s.where("scene_id % 2 = 0").select("candidate_id", "start_ms", "end_ms", "text")
    return pools.caption_evidence(c, own, speeches(spark, sf_dir)).select("candidate_id", "core", "content_ms", "evidence_source")


@query("""select doc_id, case when doc_id % 3 = 0 or coalesce(text, '') = '' then 'captions' else 'scenes' end as provider, case when doc_id % 3 = 0 or coalesce(text, '') = '' then lang else left(text, 20) end as core from documents""")
def d3_evidence_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    a = d.select("doc_id", F.lit("").alias("description"), F.when(F.col("doc_id") % 3 != 0, F.substring("text", 1, 20)).otherwise("").alias("core"), F.lit("scenes").alias("provider"))
    b = d.select("doc_id", F.lit("").alias("description"), F.col("lang").alias("core"), F.lit("captions").alias("provider"))
    return pools.resolve_evidence(a, b, "prefer_scenes", "doc_id").select("doc_id", "provider", "core")


