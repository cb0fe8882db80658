"""Confidence gates, pacing labels, ids and small media arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutlens.functions import constants as K


def confident(value: Column, confidence: Column, basis: Column) -> Column:
    return F.struct(
        value.alias("value"), F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"), basis.alias("basis")
    )


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.80, "confident").when(c >= 0.55, "likely").when(c >= 0.30, "uncertain").otherwise("speculative")


def is_trusted(c: Column) -> Column:
    return c >= K.TRUST_THRESHOLD


def is_displayed(c: Column) -> Column:
    return c >= K.DISPLAY_THRESHOLD


def effective(value: Column, c: Column, fallback) -> Column:
    """An untrusted value gives way to its declared fallback."""
    return F.when(is_trusted(c), value).otherwise(fallback if isinstance(fallback, Column) else F.lit(fallback))


def effective_duration(kind: Column, duration: Column) -> Column:
    return F.when(kind == "cut", F.lit(0.0)).otherwise(duration)


def pacing_label(median: Column) -> Column:
    return (
        F.when(median < 0.6, "Very fast cuts").when(median < 1.2, "Fast cuts")
        .when(median < 2.5, "Steady pacing").otherwise("Relaxed pacing")
    )


def derived_tags(tags: Column, median: Column, aligned: Column, text_slots: Column, transitions: Column) -> Column:
    """Own tags when there are any, otherwise tags read off the statistics."""
    found = F.array_compact(
        F.array(
            F.when(median < 0.8, "Fast Reel").when(median > 2.0, "Slideshow"),
            F.when(aligned, "Beat Sync"),
            F.when(text_slots >= 3, "Text Heavy"),
            F.when(transitions == 0, "Minimal"),
        )
    )
    return (
        F.when(tags.isNotNull() & (F.size(tags) > 0), tags)
        .when(F.size(found) > 0, found)
        .otherwise(F.array(F.lit("Reference")))
    )


def numbered(prefix: str, index: Column) -> Column:
    return F.format_string(prefix + "_%02d", index.cast("int"))


def stable_id(seed: Column, path: Column) -> Column:
    """Same inputs, same id, on every run."""
    return F.substring(F.sha2(F.concat_ws("/", seed, path), 256), 1, 32)


def export_size(canvas_w: Column, canvas_h: Column, short_side: int) -> Column:
    ratio = canvas_w.cast("double") / canvas_h.cast("double")
    even = lambda v: (v - v % 2).cast("bigint")
    wide = ratio >= 1
    w = F.when(wide, F.round(short_side * ratio)).otherwise(F.lit(float(short_side)))
    h = F.when(wide, F.lit(float(short_side))).otherwise(F.round(short_side / ratio))
    return F.struct(even(w).alias("width"), even(h).alias("height"))


def bitrate(width: Column, height: Column, fps: Column, hevc: Column, quality: Column) -> Column:
    per_pixel = F.when(hevc, 0.09).otherwise(0.14)
    factor = F.when(quality == "standard", 0.65).when(quality == "maximum", 1.6).otherwise(1.0)
    return F.floor((width * height * fps).cast("double") * per_pixel * factor)


def estimated_bytes(rate: Column, seconds: Column) -> Column:
    return F.floor(rate.cast("double") / 8 * seconds * 1.2) + 200_000


def quality_score(aesthetic: Column, sharpness: Column, is_utility: Column) -> Column:
    base = F.when(aesthetic.isNull(), F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (aesthetic + 1) / 2)))
    blended = F.when(sharpness.isNull(), base).otherwise(base * 0.75 + sharpness * 0.25)
    return F.when(is_utility, blended * 0.3).otherwise(blended)


def feature_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two feature prints; null when absent, empty or of unequal length."""
    squares = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.sqrt(squares))


def clip_gain(volume: Column, fade_in: Column, fade_out: Column, start: Column, end: Column, muted: Column, t: Column) -> Column:
    rise = F.when((fade_in > 0) & (t - start < fade_in), F.try_divide(t - start, fade_in)).otherwise(F.lit(1.0))
    fall = F.when((fade_out > 0) & (end - t < fade_out), F.try_divide(end - t, fade_out)).otherwise(F.lit(1.0))
    audible = ~muted & (t >= start) & (t < end)
    return F.when(audible, F.least(F.greatest(volume * rise * fall, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def duck_factor(t: Column, s: Column, e: Column, level: float = K.DUCK_LEVEL, ramp: float = K.DUCK_RAMP) -> Column:
    """Gain factor one voice interval imposes at ``t``."""
    return (
        F.when((t >= s) & (t <= e), F.lit(level))
        .when((t < s) & (t > s - ramp), level + (1 - level) * ((s - t) / ramp))
        .when((t > e) & (t < e + ramp), level + (1 - level) * ((t - e) / ramp))
        .otherwise(F.lit(1.0))
    )


def is_staged_name(name: Column) -> Column:
    """File stem produced by a picker: a known prefix and nothing but a long hex id."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return stem.rlike("^(reference-|picked-)[0-9A-Fa-f-]{32,}$")


def safe_title(title: Column, default: str = "Untitled Style") -> Column:
    kept = F.trim(F.regexp_replace(title, r"[^\p{L}\p{M}\p{N}\p{Zs}\t]", ""))
    return F.when(kept == "", F.lit(default)).otherwise(kept)
