"""Scenes and speeches: schema-on-read of their payloads, transcripts, related speeches and features of a window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, StringType, StructField, StructType

from spanforge.functions.intervals import C, col, overlap, ratio
from spanforge.functions.text import GARBLED, SPACE, class_share, count_class, garbled_share, seconds_to_clock, solid_length

from .joins import interval_join, nearest_boundaries, union_length

_TIMES = ("start_ms", "startTimeMs", "start_time_ms", "end_ms", "endTimeMs", "end_time_ms")


def _struct(texts: Sequence[str], **others: DataType) -> StructType:
    """Times as numbers, the named texts, and other fields."""
    kinds = [(n, DoubleType()) for n in _TIMES] + [(n, StringType()) for n in texts] + list(others.items())
    return StructType([StructField(n, t) for n, t in kinds])


#: All names that the fields of an utterance and of a scene go by.
SPEECH = _struct(("speech_id", "id", "text", "utterance", "speech", "speaker_id", "speaker"))
SCENE = _struct(
    ("scene_id", "id", "sceneId", "name", "scene_name", "description", "scene_description", "summary", "speech"), is_fallback=BooleanType(),
    persons=ArrayType(StructType([StructField("person_id", StringType())])), speeches=ArrayType(SPEECH), transcript=ArrayType(SPEECH), script=ArrayType(SPEECH))
#: What a payload holds its scenes under.
HELD = StructType([StructField(n, ArrayType(SCENE)) for n in ("data", "items", "scenes")])


def _first_text(*options: Column) -> Column:
    """The first option that is neither null nor empty."""
    return F.coalesce(*(F.nullif(o, F.lit("")) for o in options))


def _filled(*arrays: Column) -> Column:
    return F.coalesce(*(F.when(F.size(a) > 0, a) for a in arrays))


def normalize_speeches(raw: Column) -> Column:
    """Array of (start_sec, end_sec, speech_id, speaker_id, text) in order of time, from an array of utterances under any of their names.

    Utterances without a start, an end or a text are left out; one without an id has its 1-based place.
    """
    numbered = F.transform(raw, lambda x, i: F.struct(
        (F.coalesce(x["start_ms"], x["startTimeMs"], x["start_time_ms"]) / 1000.0).alias("start_sec"),
        (F.coalesce(x["end_ms"], x["endTimeMs"], x["end_time_ms"]) / 1000.0).alias("end_sec"),
        i.alias("place"),
        F.coalesce(_first_text(x["speech_id"], x["id"]), (i + 1).cast("string")).alias("speech_id"),
        F.coalesce(_first_text(x["speaker_id"], x["speaker"]), F.lit("")).alias("speaker_id"),
        F.trim(F.coalesce(_first_text(x["text"], x["utterance"], x["speech"]), F.lit(""))).alias("text")))
    known = F.filter(numbered, lambda x: x["start_sec"].isNotNull() & x["end_sec"].isNotNull() & (x["text"] != ""))
    return F.transform(F.array_sort(known), lambda x: x.dropFields("place"))


def transcript(speeches: C) -> Column:
    """A line ``[M:SS-M:SS] S<speaker>: text`` for each speech of an array in order of time."""
    line = lambda s: F.concat(
        F.lit("["), seconds_to_clock(s["start_sec"]), F.lit("-"), seconds_to_clock(s["end_sec"]), F.lit("] S"),
        F.coalesce(_first_text(s["speaker_id"]), F.lit("?")), F.lit(": "), s["text"])
    return F.array_join(F.transform(col(speeches), line), "\n")


def normalize_scenes(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """A row per scene of the JSON payloads: key, place, scene_id, times in seconds, texts, speeches, is_fallback, person_ids.

    A payload is a list of scenes or an object with one under data, items or
    scenes; each field may go by any of its names, of which the first that isn't
    empty counts. Other payloads give no rows.
    """
    text = F.trim(F.col(payload))
    listed, held = F.from_json(text, ArrayType(SCENE)), F.from_json(text, HELD)
    scenes = F.when(text.startswith("["), listed).when(text.startswith("{"), _filled(held["data"], held["items"], held["scenes"]))
    rows = payloads.select(F.col(key), F.posexplode(scenes).alias("place", "s"))
    s = F.col("s")
    start, end = (F.coalesce(s[f"{x}_ms"], s[f"{x}TimeMs"], s[f"{x}_time_ms"], F.lit(0.0)) / 1000.0 for x in ("start", "end"))
    speeches = normalize_speeches(_filled(s["speeches"], s["transcript"], s["script"]))
    none = F.coalesce(speeches, F.array().cast("array<struct<start_sec:double,end_sec:double,speech_id:string,speaker_id:string,text:string>>"))
    return rows.select(
        key, "place", _first_text(s["scene_id"], s["id"], s["sceneId"]).alias("scene_id"), start.alias("start_sec"), end.alias("end_sec"),
        F.greatest(F.lit(0.0), end - start).alias("duration_sec"), F.coalesce(_first_text(s["name"], s["scene_name"]), F.lit("")).alias("name"),
        F.coalesce(_first_text(s["description"], s["scene_description"], s["summary"], s["name"]), F.lit("")).alias("description"),
        none.alias("speeches"), _first_text(s["speech"]).alias("said"), F.coalesce(s["is_fallback"], F.lit(False)).alias("is_fallback"),
        F.coalesce(F.array_distinct(F.filter(F.transform(s["persons"], lambda p: p["person_id"]), lambda p: p.isNotNull())), F.array().cast("array<string>")).alias("person_ids"),
    ).withColumn("transcript", F.coalesce("said", transcript("speeches"))).drop("said")


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str, labels: tuple[str, str] = ("primary", "fallback")) -> DataFrame:
    """Scenes of ``primary``, and those of ``fallback`` for recordings that the first one lacks, with their ``provider``."""
    rest = fallback.join(primary.select(key).distinct(), key, "left_anti")
    return primary.withColumn("provider", F.lit(labels[0])).unionByName(rest.withColumn("provider", F.lit(labels[1])))


def related_speeches(sources: DataFrame, speeches: DataFrame, key: str = "longform_id", id_col: str = "source_id") -> DataFrame:
    """(id, start_ms, end_ms, text): the speeches that overlap a source, cut to it.

    ``sources`` has ``scene_ids``; ``speeches`` has the id and bounds of its
    scene. With ids, only speeches of those scenes or of scenes that overlap the
    source count. Speeches with equal times and text come once.
    """
    pairs = interval_join(sources, speeches, key)
    chosen = (F.size("l.scene_ids") == 0) | F.array_contains("l.scene_ids", F.col("r.scene_id")) | (
        overlap("l.start_ms", "l.end_ms", "r.scene_start_ms", "r.scene_end_ms") > 0)
    once = pairs.where(chosen).select(
        F.col(f"l.{id_col}").alias(id_col), F.col("l.start_ms").alias("lo"), F.col("l.end_ms").alias("hi"), "r.start_ms", "r.end_ms", "r.text").distinct()
    return once.select(id_col, F.greatest("lo", "start_ms").alias("start_ms"), F.least("hi", "end_ms").alias("end_ms"), "text")


def overview(scenes: DataFrame, key: str, name_chars: int = 160, description_chars: int = 500) -> DataFrame:
    """(key, scenes): an array of (start_ms, end_ms, scene_id, name, description) in order of time, with the texts cut."""
    part = F.struct("start_ms", "end_ms", "scene_id", F.substring("name", 1, name_chars).alias("name"), F.substring("description", 1, description_chars).alias("description"))
    return scenes.groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("scenes"))


def text_usable(text: C, script: str, least_chars: int = 8, least_share: float = 0.10, most_garbled: float = 0.35) -> Column:
    """Whether a text is long enough, in the wanted script, and not garbled."""
    return (F.char_length(F.trim(col(text))) >= least_chars) & (class_share(text, script) >= least_share) & (garbled_share(text) <= most_garbled)


def text_quality(rows: DataFrame, id_col: str, text: str, script: str, least_chars: int = 8, least_share: float = 0.10, most_garbled: float = 0.35) -> DataFrame:
    """(id, garbled, usable, solid): :func:`spanforge.functions.text.garbled_share`, :func:`text_usable` and :func:`spanforge.functions.text.solid_length`, from counts that are each taken once."""
    counted = rows.select(F.col(id_col), F.char_length(F.trim(col(text))).alias("_chars"), solid_length(text).alias("_solid"), count_class(text, script).alias("_script"), count_class(text, GARBLED).alias("_odd"))
    share = lambda c: F.when(F.col("_solid") > 0, F.col(c) / F.col("_solid")).otherwise(0.0)
    return counted.select(id_col, share("_odd").alias("garbled"), ((F.col("_chars") >= least_chars) & (share("_script") >= least_share) & (share("_odd") <= most_garbled)).alias("usable"), F.col("_solid").alias("solid"))


def transcript_usable(text: C, speeches: C, script: str) -> Column:
    """Whether a transcript has two speeches, 40 solid characters, the wanted script, and isn't garbled."""
    solid = F.char_length(F.regexp_replace(col(text), SPACE, ""))
    return (col(speeches) >= 2) & (solid >= 40) & (class_share(text, script) >= 0.10) & (garbled_share(text) <= 0.35)


def window_features(windows: DataFrame, scenes: DataFrame, speeches: DataFrame, assets: DataFrame | None = None, script: str = "A-Za-z",
                    key: str = "longform_id", id_col: str = "candidate_id", second: float = 1000.0) -> DataFrame:
    """A row per window of the counts, rates, coverages, texts and boundary gaps of the scenes and speeches that overlap it.

    ``scenes`` has scene_id, name, description, is_fallback and person_ids,
    ``speeches`` speech_id, speaker_id and text, both with start_ms and end_ms.
    ``assets`` may give (key, duration_ms, resolution, person_count, fallback_count). Windows without scenes
    or speeches have zeros; the boundary gaps are over all scenes of the recording, null where there are none.
    """
    length = F.greatest(F.lit(0.001), (F.col("end_ms") - F.col("start_ms")) / second)
    base = windows.select(key, id_col, "start_ms", "end_ms").withColumn("_length", length)
    clipped = lambda pairs: pairs.select(
        F.col(f"l.{id_col}").alias(id_col), F.greatest("l.start_ms", "r.start_ms").alias("start_ms"), F.least("l.end_ms", "r.end_ms").alias("end_ms"))
    seen, said = interval_join(base, scenes, key), interval_join(base, speeches, key)
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        F.coalesce(F.trim(c), F.lit("")) != "", F.struct("r.start_ms", "r.end_ms", "r.scene_id", F.trim(c).alias("t"))))), lambda x: x["t"]), " ")
    by_scene = seen.groupBy(F.col(f"l.{id_col}").alias(id_col)).agg(
        F.count("*").alias("scene_count"), F.count_if("r.is_fallback").alias("_fallback"),
        F.size(F.array_distinct(F.flatten(F.collect_list("r.person_ids")))).alias("person_count"),
        F.trim(F.concat_ws(" ", F.nullif(in_order("r.name"), F.lit("")), F.nullif(in_order("r.description"), F.lit("")))).alias("description"))
    spoken = F.struct((F.col("r.start_ms") / second).alias("start_sec"), (F.col("r.end_ms") / second).alias("end_sec"), "r.speech_id", "r.speaker_id", "r.text")
    by_speech = said.groupBy(F.col(f"l.{id_col}").alias(id_col)).agg(
        F.array_sort(F.collect_set(spoken)).alias("_speeches"), F.count_distinct(F.nullif(F.col("r.speaker_id"), F.lit(""))).alias("unique_speakers"))
    unions = union_length(clipped(seen), [id_col]).withColumnRenamed("union_ms", "_scene_ms"), union_length(clipped(said), [id_col]).withColumnRenamed("union_ms", "_speech_ms")
    gaps = nearest_boundaries(windows, scenes, key, id_col)
    out = base.join(by_scene, id_col, "left").join(by_speech, id_col, "left")
    for part in (*unions, gaps):
        out = out.join(part, id_col, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    words = F.coalesce(transcript("_speeches"), F.lit(""))
    out = out.withColumns({"transcript": words, "description": F.coalesce("description", F.lit("")), "speech_count": F.coalesce(F.size("_speeches"), F.lit(0))})
    out = out.withColumn("speech_count", F.greatest(F.lit(0), F.col("speech_count")))
    per_minute = lambda n: n * 60.0 / F.col("_length")
    solid = lambda c: F.char_length(F.regexp_replace(c, SPACE, ""))
    features = {
        "available": F.col("start_gap_ms").isNotNull(), "scene_count": zero("scene_count"), "scene_rate": per_minute(F.greatest(F.lit(0), zero("scene_count") - 1)),
        "scene_coverage": F.least(F.lit(1.0), zero("_scene_ms") / second / F.col("_length")),
        "fallback_share": ratio(zero("_fallback"), zero("scene_count")), "person_count": zero("person_count"),
        "speech_count": F.col("speech_count"), "speech_rate": per_minute(F.col("speech_count")), "unique_speakers": zero("unique_speakers"),
        "speech_coverage": F.least(F.lit(1.0), zero("_speech_ms") / second / F.col("_length")),
        "text_usable": text_usable("description", script), "transcript_usable": transcript_usable("transcript", "speech_count", script),
        "transcript_chars": solid("transcript"), "transcript_script": class_share("transcript", script), "transcript_garbled": garbled_share("transcript"),
        "description_chars": solid("description"), "description_script": class_share("description", script), "description_garbled": garbled_share("description"),
        "start_gap_sec": F.col("start_gap_ms") / second, "end_gap_sec": F.col("end_gap_ms") / second,
        "start_aligned": F.coalesce(F.col("start_gap_ms") <= 2 * second, F.lit(False)), "end_aligned": F.coalesce(F.col("end_gap_ms") <= 2 * second, F.lit(False)),
    }
    keep = [F.col(key), F.col(id_col), *(c.alias(n) for n, c in features.items()), F.substring("description", 1, 1800).alias("description"), F.substring("transcript", 1, 8000).alias("transcript")]
    if assets is None:
        return out.select(*keep)
    extra: Sequence[str] = ("duration_ms", "resolution", "person_count", "fallback_count")
    named = assets.select(key, *(F.col(c).alias(f"asset_{c}") for c in extra))
    return out.select(*keep).join(named, key, "left")
