"""Text similarity, watermark rules, slot typing and on-screen text animation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutlens.functions import constants as K
from cutlens.functions.geometry import center_x, center_y, clamp


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), " "), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Overlap of the two token sets; two empty texts are alike."""
    both, either = F.size(F.array_intersect(tokens(a), tokens(b))), F.size(F.array_union(tokens(a), tokens(b)))
    return F.when(either > 0, F.try_divide(both.cast("double"), either.cast("double"))).otherwise(F.lit(1.0))


def is_growing(a: Column, b: Column) -> Column:
    """One text is a prefix of the other, as when words appear one by one."""
    return a.startswith(b) | b.startswith(a)


def match_score(overlap: Column, similarity: Column, growing: Column) -> Column:
    return overlap * 0.5 + F.greatest(similarity, F.when(growing, 0.8).otherwise(0.0)) * 0.5


def contains_any(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda acc, c: acc | c, [text.contains(p) for p in phrases])


def is_watermark(text: Column, frame: Column, coverage: Column) -> Column:
    low = F.lower(text)
    cy, cx = center_y(frame), center_x(frame)
    corner = ((cy < 0.14) | (cy > 0.88)) & ((cx < 0.30) | (cx > 0.70))
    lasting = (frame["h"] < 0.035) & corner & (coverage > 0.75)
    return low.startswith("@") | low.rlike(K.WATERMARK_HANDLE) | contains_any(low, K.WATERMARK_PHRASES) | lasting


def text_role(text: Column, index: Column, total: Column, size: Column, largest: Column) -> Column:
    return (
        F.when(contains_any(F.lower(text), K.CTA_KEYWORDS), "cta")
        .when((index == 0) & (size >= largest * 0.85), "title")
        .when((index == total - 1) & (total > 1), "cta")
        .when(size >= largest * 0.7, "subtitle")
        .otherwise("caption")
    )


def text_align(frame: Column) -> Column:
    cx = center_x(frame)
    return F.when(cx < 0.38, "leading").when(cx >= 0.62, "trailing").otherwise("center")


def font_category(text: Column, frame: Column, size: Column) -> Column:
    per_char = frame["w"] / F.greatest(F.lit(1), F.length(text))
    ratio = F.when(frame["h"] > 0, F.try_divide(per_char, frame["h"])).otherwise(F.lit(0.5))
    narrow, big = ratio < 0.34, size > 0.075
    return F.struct(
        F.when(narrow, "condensed").when(big, "displayBold").otherwise("sansSerif").alias("value"),
        F.when(narrow, 0.46).when(big, 0.44).otherwise(0.38).alias("confidence"),
    )


def text_animation(growth: Column, observations: Column) -> Column:
    return F.struct(
        F.when(growth >= 2, "wordByWord").otherwise("fadeIn").alias("entry"),
        F.when(growth >= 2, 0.62).when(observations >= 4, 0.44).otherwise(0.30).alias("entry_confidence"),
        F.lit("fadeOut").alias("exit"),
        F.lit(0.35).alias("exit_confidence"),
    )


def fit_text_size(size: Column, hint: Column, text: Column) -> Column:
    ratio = hint.cast("double") / F.greatest(F.length(text), F.lit(1))
    return F.when(hint > 0, size * clamp(ratio, 0.6, 1.15)).otherwise(size)


def display_words(text: Column, all_caps: Column) -> Column:
    """Words in drawing order with a marker between lines."""
    source = F.when(all_caps, F.upper(text)).otherwise(text)
    lines = F.transform(F.split(source, "\n"), lambda line: F.filter(F.split(line, " "), lambda w: w != ""))
    marked = F.transform(
        lines, lambda words, i: F.when(i > 0, F.concat(F.array(F.lit(K.LINE_BREAK)), words)).otherwise(words)
    )
    return F.flatten(marked)


def text_for_slot(texts: Column, slot: Column) -> Column:
    """What the user wrote for a slot; blank means nothing."""
    value = F.regexp_replace(F.try_element_at(texts, slot), r"^\s+|\s+$", "")
    return F.when(value != "", value)


def lookup(table: dict[str, float], key: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(key == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)


def entry_seconds(kind: Column) -> Column:
    return lookup(K.ENTRY_SECONDS, kind)


def exit_seconds(kind: Column) -> Column:
    return lookup(K.EXIT_SECONDS, kind)


def text_opacity(start: Column, end: Column, entry: Column, exit_: Column, t: Column) -> Column:
    rise_s, fall_s = entry_seconds(entry), exit_seconds(exit_)
    instant = entry.isin("none", "wordByWord", "typeOn")
    rise = F.when((rise_s > 0) & (t - start < rise_s) & ~instant, F.try_divide(t - start, rise_s)).otherwise(F.lit(1.0))
    fall = F.when((fall_s > 0) & (end - t < fall_s), F.try_divide(end - t, fall_s)).otherwise(F.lit(1.0))
    return F.when((t >= start) & (t < end), clamp(F.least(rise, fall), 0.0, 1.0)).otherwise(F.lit(0.0))


def word_state(local: Column, remaining: Column, index: Column, words: Column, entry: Column, exit_: Column, word_start: Column) -> Column:
    """Opacity, vertical offset and scale of one word. ``word_start`` is its caption timing or null."""
    entry_s, exit_s = entry_seconds(entry), exit_seconds(exit_)
    leaving = (exit_s > 0) & (remaining < exit_s)
    exit_alpha = F.when(leaving, F.greatest(F.lit(0.0), F.try_divide(remaining, exit_s))).otherwise(F.lit(1.0))
    exit_shift = F.when((exit_ == "slideDown") & leaving, (1 - exit_alpha) * 0.05).otherwise(F.lit(0.0))
    exit_scale = F.when((exit_ == "popOut") & leaving, 0.85 + exit_alpha * 0.15).otherwise(F.lit(1.0))

    timed = clamp((local - word_start) / 0.09, 0.0, 1.0)
    entering = (entry_s > 0) & (local < entry_s)
    p = clamp(F.try_divide(local, entry_s), 0.0, 1.0)
    eased = p * (2 - p)
    per_word = entry_s / F.greatest(F.lit(1), words)
    since = local - index * per_word
    by_word = clamp(since / F.greatest(F.lit(0.08), per_word * 0.8), 0.0, 1.0)
    slides = entry.isin("slideUp", "slideDown")

    alpha = (
        F.when(word_start.isNotNull(), timed)
        .when((entry == "fadeIn") & entering, p)
        .when((entry == "popIn") & entering, p)
        .when(slides & entering, eased)
        .when(entry == "wordByWord", by_word)
        .when(entry == "typeOn", F.when(since >= 0, 1.0).otherwise(0.0))
        .otherwise(F.lit(1.0))
    )
    scale = (
        F.when(word_start.isNotNull(), 0.96 + timed * 0.04)
        .when((entry == "popIn") & entering, F.when(p < 0.7, 0.8 + p * 0.35).otherwise(1.06 - (p - 0.7) * 0.2))
        .when(entry == "wordByWord", 0.94 + by_word * 0.06)
        .otherwise(F.lit(1.0))
    )
    shift = F.when(
        word_start.isNull() & slides & entering, (1 - eased) * F.when(entry == "slideUp", 0.06).otherwise(-0.06)
    ).otherwise(F.lit(0.0))
    return F.struct(
        F.least(alpha, exit_alpha).alias("opacity"), (shift + exit_shift).alias("offset_y"), (scale * exit_scale).alias("scale")
    )
