"""Column expressions over text, clock strings, numbers and ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import C, col

#: Unicode white space for Java's regular expressions, whose \s is ASCII alone.
SPACE = r"(?U)\s"
#: Replacement characters, question marks and CJK ideographs.
GARBLED = "\ufffd?\u3400-\u4dbf\u4e00-\u9fff"


def clock_to_seconds(text: C, strict: bool = False) -> Column:
    """Seconds of ``M:S``, ``H:M:S`` or a plain number; other texts give 0, or raise if ``strict``; null stays null."""
    t = F.trim(col(text))
    parts = F.transform(F.split(t, ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)
    good = t.rlike(r"^\d+(\.\d+)?$|^(\d+:)?\d+:\d+(\.\d+)?$")
    bad = F.raise_error(F.concat(F.lit("not a clock time: "), t)).cast("double") if strict else F.lit(0.0)
    return F.when(t.isNull(), None).when(good, total).otherwise(bad)


def seconds_to_clock(seconds: C) -> Column:
    """``M:SS``, or ``H:MM:SS`` from an hour on; fractions are cut, negatives count as 0."""
    s = F.greatest(F.lit(0), F.floor(col(seconds))).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def parse_number(text: C, default: float | None = None, low: float | None = None, high: float | None = None) -> Column:
    """Number in ``text``; blank, bad or non-finite ones give ``default``, values beyond the bounds raise."""
    value = F.trim(col(text)).try_cast("double")
    value = F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)
    value = F.coalesce(value, F.lit(default).cast("double"))
    for bound, beyond in ((low, lambda v, b: v < b), (high, lambda v, b: v > b)):
        if bound is not None:
            value = F.when(beyond(value, bound), F.raise_error(F.concat(F.lit("out of bounds: "), value.cast("string"))).cast("double")).otherwise(value)
    return value


def content_id(prefix: str, *parts: C, digits: int = 14) -> Column:
    """``prefix`` and the first hex digits of the SHA-256 of the parts joined by ``|``."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *(col(p).cast("string") for p in parts)), 256), 1, digits))


def hash_uniform(salt: str, key: C, whole: int = (1 << 64) - 1) -> Column:
    """Number in 0 to 1 from the first eight bytes of the SHA-256 of ``salt:key``."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), col(key).cast("string")), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(whole))


def note_value(notes: C, key: str) -> Column:
    """Value of ``key`` in ``k=v; k=v``; the first one counts, null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(col(notes), rf"(?:^|;)\s*{key}\s*=([^;]*)", 1)), F.lit(""))


def finite(value: C) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(col(value)) | (F.abs(col(value)) == float("inf")), None).otherwise(col(value))


def token_estimate(text: C) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.char_length(col(text)) / 4)).cast("long")


def count_class(text: C, characters: str) -> Column:
    """Characters of ``text`` in a class such as ``a-z``."""
    return F.char_length(col(text)) - F.char_length(F.regexp_replace(col(text), f"[{characters}]+", ""))


def class_share(text: C, characters: str) -> Column:
    """Share of a class among the characters that aren't white space; 0 where there are none."""
    solid = F.char_length(F.regexp_replace(col(text), SPACE, ""))
    return F.when(solid > 0, count_class(text, characters) / solid).otherwise(0.0)


def garbled_share(text: C) -> Column:
    """Share of replacement characters, question marks and CJK ideographs among the characters that aren't white space."""
    return class_share(text, GARBLED)


def detect_language(text: C, scripts: Sequence[tuple[str, str, int, float]], default: str) -> Column:
    """The first (language, class, least count, least share) that the first 20 000 characters satisfy, or ``default``."""
    head = F.substring(col(text), 1, 20_000)
    out = F.lit(default)
    for language, characters, count, share in reversed(scripts):
        out = F.when((count_class(head, characters) >= count) & (class_share(head, characters) >= share), language).otherwise(out)
    return out


def keyword_score(text: C, weights: Mapping[str, float]) -> Column:
    """Occurrences of each term in lower case, without overlaps, times its weight."""
    low = F.lower(col(text))
    total = F.lit(0.0)
    for term, weight in weights.items():
        count = (F.char_length(low) - F.char_length(F.replace(low, F.lit(term), F.lit("")))) / F.lit(len(term))
        total = total + count * F.lit(float(weight))
    return total


def terms_present(text: C, terms: Sequence[str]) -> Column:
    """How many of the terms occur, case and all."""
    return sum((F.contains(col(text), F.lit(t)).cast("int") for t in terms), F.lit(0))


def genre(text: C, lecture: Mapping[str, float], variety: Mapping[str, float], default: str = "general") -> Column:
    """``lecture`` or ``variety`` where its score over the first 50 000 characters is high and leads the other's."""
    head = F.substring(col(text), 1, 50_000)
    a, b = keyword_score(head, lecture), keyword_score(head, variety)
    return F.when((a >= 6) & (a >= 1.35 * b), "lecture").when((b >= 4) & (b >= 0.75 * a), "variety").otherwise(default)


def lookup(table: Mapping[str, Mapping[str, str]], language: C, kind: C, default: str) -> Column:
    """Entry for (language, kind), else the language's default, else ``default``."""
    out = F.lit(default)
    for lang, kinds in table.items():
        inner = F.lit(kinds.get("default", default))
        for k, v in kinds.items():
            if k != "default":
                inner = F.when(col(kind) == k, v).otherwise(inner)
        out = F.when(col(language) == lang, inner).otherwise(out)
    return out


def text_statistics(text: C) -> dict[str, Column]:
    """Characters, lines, words, question and exclamation marks, digits, and log length of a text."""
    t = F.coalesce(col(text), F.lit(""))
    return {
        "chars": F.char_length(t), "lines": F.when(t == "", 0).otherwise(F.char_length(F.regexp_replace(t, "[^\n]", "")) + 1),
        "words": F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")), "questions": count_class(t, "?"), "exclamations": count_class(t, "!"),
        "has_digit": t.rlike("[0-9]"), "brackets": count_class(t, r"\[\]()"), "log_chars": F.log1p(F.char_length(t).cast("double")),
        "too_short": F.char_length(F.trim(t)) < 8,
    }


#: A line's time stamp and a line's speaker, as transcripts have them.
STAMP, SPEAKER = r"\[\s*\d+:\d+(?::\d+)?\s*-\s*\d+:\d+(?::\d+)?\s*\]", r"(?i)\bS[\w?]*\s*:"


def transcript_statistics(text: C) -> dict[str, Column]:
    """Characters, lines, lines with a time stamp, distinct speakers, changes of speaker, and question and exclamation marks of a transcript."""
    t = F.coalesce(col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    speakers = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"\bS([\w?]+)\s*:", 1)), lambda s: s != "")
    return {
        "chars": F.char_length(t), "lines": F.size(lines), "timed_lines": F.size(F.filter(lines, lambda x: x.rlike(STAMP))),
        "speakers": F.size(F.array_distinct(speakers)), "turns": speaker_turns(speakers), "questions": count_class(t, "?"), "exclamations": count_class(t, "!"),
    }


def title_features(short: C, long: C) -> dict[str, Column]:
    """Characters, question and exclamation marks of both titles and whether either has a digit."""
    out: dict[str, Column] = {}
    for name, title in (("short", short), ("long", long)):
        t = F.coalesce(col(title), F.lit(""))
        out |= {f"{name}_chars": F.char_length(t), f"{name}_questions": count_class(t, "?"), f"{name}_exclamations": count_class(t, "!"), f"{name}_digit": t.rlike("[0-9]")}
    return out


def structure_features(transcript: C, description: C, seconds: C, script: str = "A-Za-z") -> dict[str, Column]:
    """Seventeen numbers on the shape of a candidate's transcript and description, its duration counted as a second at least."""
    t, d = (F.coalesce(col(c), F.lit("")) for c in (transcript, description))
    length = F.greatest(F.lit(1.0), F.coalesce(col(seconds), F.lit(0.0)))
    log = lambda c: F.log1p(c.cast("double"))
    stats = transcript_statistics(t)
    return {
        "transcript_log_chars": log(F.char_length(t)), "description_log_chars": log(F.char_length(d)), "log_seconds": log(length),
        "timed_lines": log(stats["timed_lines"]), "lines": log(stats["lines"]), "speaker_marks": log(F.regexp_count(t, F.lit(SPEAKER))),
        "questions": log(count_class(t, "?")), "exclamations": log(count_class(t, "!")), "brackets": log(count_class(t, r"\[\]()")),
        "description_questions": log(count_class(d, "?")), "description_exclamations": log(count_class(d, "!")),
        "transcript_script": class_share(t, script), "description_script": class_share(d, script),
        "chars_per_second": F.char_length(t) / length, "lines_per_second": stats["lines"] / length,
        "description_missing": (F.char_length(F.trim(d)) < 8).cast("double"), "transcript_missing": (F.char_length(F.trim(t)) < 20).cast("double"),
    }


def speaker_turns(speakers: C) -> Column:
    """Changes between neighbours in an array of speakers."""
    s = col(speakers)
    return F.size(F.filter(F.transform(s, lambda x, i: (i > 0) & (x != F.get(s, i - 1))), lambda x: x))


def normalize_text(text: C) -> Column:
    """Without ``[a:b - c:d]`` stamps, speaker tags as one token, white space as single blanks, trimmed."""
    t = F.regexp_replace(col(text), r"\[\s*\d+:\d+(?::\d+)?\s*-\s*\d+:\d+(?::\d+)?\s*\]", " ")
    t = F.regexp_replace(t, r"(?i)\bS\d+\s*:", " SPEAKER ")
    return F.trim(F.regexp_replace(t, SPACE + "+", " "))


def solid_length(text: C) -> Column:
    """Characters that aren't white space."""
    return F.char_length(F.regexp_replace(F.coalesce(col(text), F.lit("")), SPACE, ""))


def compact(text: C) -> Column:
    """White space as single blanks, trimmed."""
    return F.trim(F.regexp_replace(col(text), SPACE + "+", " "))


def context_near(text: C, side: str, most: int) -> Column:
    """The last ``most`` characters of a text before a boundary, or the first of one after it, without blanks at line ends."""
    t = F.regexp_replace(col(text), r"(?m)[ \t]+$", "")
    return F.right(t, F.lit(most)) if side == "before" else F.left(t, F.lit(most))


def tagged(sections: Mapping[str, C]) -> Column:
    """Sections under ``[NAME]`` lines; empty ones are left out."""
    return F.concat_ws("\n", *(
        F.when(F.coalesce(F.trim(col(c)), F.lit("")) != "", F.concat(F.lit(f"[{name}]\n"), F.trim(col(c)))) for name, c in sections.items()))


def spoken_lines(text: C, sounds: Sequence[str] = ("[music]", "[applause]")) -> Column:
    """The lines of a transcript without time stamp and speaker; blank ones and those of a sound alone are left out."""
    bare = F.transform(F.split(F.coalesce(col(text), F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\[[^\]]+\]\s*S[^:]*:\s*", "")))
    return F.filter(bare, lambda x: (x != "") & ~x.isin(*sounds))


def pick_line(text: C, keywords: Sequence[str]) -> Column:
    """The first line that holds a keyword, else an empty text."""
    lines = F.filter(F.split(col(text), "\n"), lambda line: F.exists(F.array(*(F.lit(k) for k in keywords)), lambda k: F.contains(line, k)))
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))


def quotes(lines: C, keywords: Mapping[str, Sequence[str]], most: int = 180) -> dict[str, Column]:
    """First, last and longest line (of equal ones the first), and the first with one of the keywords for each name; empty where there is none."""
    x = col(lines)
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, most)
    longest = F.array_max(F.transform(x, lambda s, i: F.struct(F.char_length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]
    out = {"first": cut(F.get(x, F.lit(0))), "last": cut(F.try_element_at(x, F.lit(-1))), "longest": cut(longest)}
    holds = lambda words: F.filter(x, lambda s: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(s, w)))
    return out | {name: cut(F.get(holds(words), F.lit(0))) for name, words in keywords.items()}


def json_object(text: C) -> Column:
    """The JSON object in a model's answer, as text: one in a fenced block, else in what follows a closed think tag, else in the whole; null for none.

    Of each, the text from the first brace to the last one that makes a
    well-formed object counts; objects inside other text are found, lists are not objects.
    """
    t = col(text)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    after = F.regexp_extract(t, r"(?s)</think>(.*)$", 1)
    span = lambda c: F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    first = lambda c: F.regexp_extract(c, r"(\{[^{}]*\})", 1)
    good = lambda c: F.when(F.try_parse_json(F.nullif(c, F.lit(""))).isNotNull() & F.startswith(F.trim(c), F.lit("{")), F.trim(c))
    return F.coalesce(*(good(c) for part in (fenced, after, t) for c in (span(part), first(part))))


def band(score: C) -> Column:
    """strong from 75, adequate from 50, else weak; null stays null."""
    s = col(score)
    return F.when(s >= 75, "strong").when(s >= 50, "adequate").when(s.isNotNull(), "weak")


def alignment_case(tier: C, quality: C) -> Column:
    """How a tier of performance in its channel (relative_high, relative_low or other) and a quality band go together."""
    high, low = col(tier) == "relative_high", col(tier) == "relative_low"
    strong, weak = col(quality) == "strong", col(quality) == "weak"
    return (F.when(high & strong, "aligned_high_quality").when(low & weak, "aligned_low_quality").when(low & strong, "high_quality_relative_underperformer")
            .when(high & weak, "low_quality_relative_outperformer").otherwise("mixed_or_nondiagnostic"))


def percentile_label(percentile: C, low: float = 20, high: float = 80) -> Column:
    p = col(percentile)
    return F.when(p <= low, "neg").when(p >= high, "pos").when(p.isNotNull(), "mid")


def rubric_score(scores: Mapping[str, C], weights: Mapping[str, float]) -> Column:
    """25 times the weighted mean of scores 0 to 4, at four decimals; null if one is missing."""
    if set(scores) != set(weights) or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must name the dimensions and sum to 1")
    return F.round(25 * sum((col(c) * F.lit(weights[d]) for d, c in scores.items()), F.lit(0.0)), 4)


def reliability(confidence: C, other: C | None = None) -> Column:
    """Weight of a stated confidence; of two, the root of the product."""
    def weight(c: C) -> Column:
        c = F.lower(F.trim(col(c)))
        return F.when(c == "high", 1.0).when(c.isin("medium", "mid"), 0.85).when(c == "low", 0.65).when(c == "manual", 0.9).otherwise(0.8)

    return weight(confidence) if other is None else F.sqrt(weight(confidence) * weight(other))


def interactions(dimensions: Sequence[C]) -> dict[str, Column]:
    """Ten terms of seven scores from 0 to 4, scaled to 0 to 1: moments, the means of the first three and of the rest, and joint terms of pairs."""
    if len(dimensions) != 7:
        raise ValueError("seven dimensions are needed")
    d = [col(c) / 4.0 for c in dimensions]
    mean_of = lambda xs: sum(xs, F.lit(0.0)) / len(xs)
    mean = mean_of(d)
    return {
        "mean": mean, "least": F.least(*d), "spread": F.sqrt(sum(((x - mean) * (x - mean) for x in d), F.lit(0.0)) / len(d)),
        "head_mean": mean_of(d[:3]), "rest_mean": mean_of(d[3:]), "least_3_1": F.least(d[3], d[1]),
        "product_3_1": d[3] * d[1], "product_0_2": d[0] * d[2], "product_4_5": d[4] * d[5], "product_5_6": d[5] * d[6],
    }


def merged_transcript(scene: C, captions: C, primary: C) -> dict[str, Column]:
    """The transcripts of the scenes and of captions as one text under their labels, and where it comes from.

    ``primary`` says whether the scenes are those of the first provider.
    """
    s, c = (F.coalesce(col(x), F.lit("")) for x in (scene, captions))
    label = F.when(col(primary), "SCENE_ASR").otherwise("SUBTITLE_FALLBACK")
    source = F.when(col(primary), "scene_asr").otherwise("full_longform_captions")
    both = F.concat(F.lit("["), label, F.lit("]\n"), s, F.lit("\n\n[CAPTIONS]\n"), c)
    return {
        "text": F.when((s != "") & (c != ""), both).when(s != "", s).otherwise(c),
        "source": F.when((s != "") & (c != ""), F.concat(source, F.lit("+candidate_captions"))).when(s != "", source).otherwise("candidate_captions"),
    }


def bounded_adjustment(start: C, end: C, new_start: C, new_end: C, low: C, high: C, least: float = 15.0, most: float = 90.0) -> dict[str, Column]:
    """A suggested interval cut to its context where its duration is within bounds, else the original one."""
    s = F.least(F.greatest(col(new_start), col(low)), col(high))
    e = F.least(F.greatest(col(new_end), col(low)), col(high))
    good = F.coalesce((e - s >= least) & (e - s <= most), F.lit(False))
    a, b = F.when(good, s).otherwise(col(start)), F.when(good, e).otherwise(col(end))
    return {"start": a, "end": b, "adjusted": (F.abs(a - col(start)) > 0.001) | (F.abs(b - col(end)) > 0.001)}
