"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decay per day by relationship type, the rate of other types, and preset factors.
DECAY_RATES = {"prefers": 0.05, "avoids": 0.04, "knows": 0.005, "discussed": 0.03, "mentioned_with": 0.1, "has_goal": 0.02, "relates_to": 0.01}
DEFAULT_RATE = 0.01
PRESETS = {"fast": 2.0, "normal": 1.0, "slow": 0.5}
CONFIDENCE_FLOOR = 0.1
CONFIDENCE_LEVELS = (1.0, 0.8, 0.6, 0.4)
DEFAULT_CONFIDENCE = 0.8
RELATIONSHIP_TYPES = ("prefers", "avoids", "knows", "discussed", "mentioned_with", "has_goal", "relates_to")
ENTITY_TYPES = ("PERSON", "PREFERENCE", "GOAL", "CONCEPT", "EVENT", "TOPIC")


def normalize_name(name: Column) -> Column:
    """Small letters, punctuation (hyphens too) dropped, white space runs to one hyphen."""
    kept = F.regexp_replace(F.lower(name), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", "-")


def effective_group(group: Column, conversation: Column) -> Column:
    return F.coalesce(F.nullif(group, F.lit("")), conversation)


def entity_id(tenant: Column, group: Column, entity_type: Column, canonical: Column) -> Column:
    return F.concat_ws(":", tenant, F.coalesce(F.nullif(group, F.lit("")), F.lit("conversation")), entity_type, canonical)


def short_name(ident: Column) -> Column:
    return F.element_at(F.split(ident, ":"), -1)


def snap_confidence(raw: Column, levels: tuple[float, ...] = CONFIDENCE_LEVELS) -> Column:
    """The nearest level by double arithmetic; a tie goes to the level listed first; null counts as the default."""
    value = F.coalesce(raw, F.lit(DEFAULT_CONFIDENCE))
    return F.array_min(F.array(*[F.struct(F.abs(F.lit(x) - value).alias("d"), F.lit(i).alias("i"), F.lit(x).alias("level")) for i, x in enumerate(levels)]))["level"]


def decay_rate(rel_type: Column, preset: str = "normal", rates: dict[str, float] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in (rates or DECAY_RATES).items() for x in (k, v * PRESETS.get(preset, 1.0))])
    return F.coalesce(F.try_element_at(table, rel_type), F.lit(DEFAULT_RATE * PRESETS.get(preset, 1.0)))


def days_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000.0)


def decayed_confidence(base: Column, rel_type: Column, last: Column, now: Column, preset: str = "normal", rates: dict[str, float] | None = None) -> Column:
    days = days_between(last, now)
    return F.when(days <= 0, base).otherwise(F.greatest(base * F.exp(-decay_rate(rel_type, preset, rates) * days), F.lit(CONFIDENCE_FLOOR)))


def reinforced_confidence(decayed: Column, new: Column) -> Column:
    return F.least(F.lit(0.7) * new + F.lit(0.3) * decayed, F.lit(1.0))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths and zero norms."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    add = lambda acc, v: acc + v
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), add)
    norms = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)) * F.sqrt(F.aggregate(y, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.when((F.size(x) != F.size(y)) | (F.size(x) <= 0) | (norms == 0), F.lit(0.0)).otherwise(dot / norms)


def hash_fraction(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def extract_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(20\d{2})", 1), F.lit(""))


def extract_yyyymm(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?<!\d)(20\d{2}(?:0[1-9]|1[0-2]))(?!\d)", 1), F.lit(""))


def assign_split(date: Column, train_until: str = "2023-12-31", eval_until: str = "2025-12-31") -> Column:
    return F.when(date.isNull(), "unspecified").when(date <= train_until, "train").when(date <= eval_until, "eval").otherwise("holdout")


def reduced_metadata(meta: Column) -> Column:
    """Only the first key in order; an empty map stays empty."""
    first = F.array_min(F.map_keys(meta))
    return F.map_filter(meta, lambda k, v: k == first)


def relationship_type(raw: Column) -> Column:
    return F.when(raw.isin(*RELATIONSHIP_TYPES), raw).otherwise("relates_to")


def parse_time(text: Column) -> Column:
    """ISO time, Z or an offset, to UTC; null where it can't be read."""
    return F.coalesce(F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()).cast("timestamp_ntz"), F.try_to_timestamp(text).cast("timestamp_ntz"))


def temporal_marker(marker: Column, at: Column) -> Column:
    """now and infer: the message's time; yesterday, last week, always: before it; else an ISO time."""
    back = F.when(marker == "yesterday", 1).when(marker == "last week", 7).when(marker == "always", 365).when(marker.isNull() | marker.isin("now", "infer"), 0)
    return F.when(back.isNotNull(), F.timestamp_add("DAY", -back, at)).otherwise(F.coalesce(F.try_to_timestamp(marker).cast("timestamp_ntz"), at))
