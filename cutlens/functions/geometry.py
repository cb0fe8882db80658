"""Normalised rectangles (struct x, y, w, h; 0..1, origin top left), easing and frame snapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    return F.least(F.greatest(value, num(low)), num(high))


def rect(x, y, w, h) -> Column:
    return F.struct(num(x).alias("x"), num(y).alias("y"), num(w).alias("w"), num(h).alias("h"))


def full() -> Column:
    return rect(0.0, 0.0, 1.0, 1.0)


def center_x(r: Column) -> Column:
    return r["x"] + r["w"] / 2


def center_y(r: Column) -> Column:
    return r["y"] + r["h"] / 2


def area(r: Column) -> Column:
    return r["w"] * r["h"]


def scaled(r: Column, factor) -> Column:
    """Scale about the centre."""
    w, h = r["w"] * num(factor), r["h"] * num(factor)
    return rect(center_x(r) - w / 2, center_y(r) - h / 2, w, h)


def scaled_full(factor) -> Column:
    """The unit square scaled about its centre."""
    f = num(factor)
    return rect(F.lit(0.5) - f / 2, F.lit(0.5) - f / 2, f, f)


def offset(r: Column, dx, dy) -> Column:
    return rect(r["x"] + num(dx), r["y"] + num(dy), r["w"], r["h"])


def clamp_inside(r: Column) -> Column:
    w, h = F.least(r["w"], F.lit(1.0)), F.least(r["h"], F.lit(1.0))
    return rect(clamp(r["x"], 0.0, 1 - w), clamp(r["y"], 0.0, 1 - h), w, h)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return rect(*[a[c] + (b[c] - a[c]) * t for c in "xywh"])


def iou(a: Column, b: Column) -> Column:
    ix = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    iy = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    total = area(a) + area(b) - ix * iy
    return F.when(total > 0, F.try_divide(ix * iy, total)).otherwise(F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return rect(x, y, F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y)


def from_bottom_left(x, y, w, h) -> Column:
    """Flip a box whose origin is bottom left."""
    return rect(x, 1 - num(y) - num(h), w, h)


def compose(window: Column, inner: Column) -> Column:
    """``inner`` expressed relative to ``window``."""
    return clamp_inside(
        rect(window["x"] + inner["x"] * window["w"], window["y"] + inner["y"] * window["h"],
             window["w"] * inner["w"], window["h"] * inner["h"])
    )


def ease(kind: Column, t: Column) -> Column:
    u = clamp(t, 0.0, 1.0)
    return (
        F.when(kind == "linear", u)
        .when(kind == "easeIn", u * u)
        .when(kind == "easeOut", u * (2 - u))
        .otherwise(F.when(u < 0.5, 2 * u * u).otherwise((4 - 2 * u) * u - 1))
    )


def frame_count(t: Column, fps) -> Column:
    """Whole frames, half rounded away from zero."""
    return F.round(t * num(fps)).cast("bigint")


def snap_to_frame(t: Column, fps) -> Column:
    return F.round(t * num(fps)) / num(fps)


def aspect_ratio(w: Column, h: Column) -> Column:
    return F.when(h > 0, F.try_divide(w.cast("double"), h.cast("double"))).otherwise(F.lit(1.0))


def aspect_preset(w: Column, h: Column) -> Column:
    ratio = F.try_divide(w.cast("double"), h.cast("double"))
    return (
        F.when(h <= 0, "other")
        .when(ratio < 0.60, "portrait9x16")
        .when(ratio < 0.90, "portrait4x5")
        .when(ratio < 1.15, "square1x1")
        .when(ratio < 2.10, "landscape16x9")
        .otherwise("other")
    )


def orientation(ratio: Column) -> Column:
    return F.when(ratio < 0.9, "portrait").when(ratio <= 1.1, "square").otherwise("landscape")


def shot_framing(salient_area: Column) -> Column:
    return F.when(salient_area >= 0.45, "closeUp").when(salient_area >= 0.18, "medium").otherwise("wide")


def framing_index(framing: Column) -> Column:
    return F.when(framing == "closeUp", 0).when(framing == "medium", 1).when(framing == "wide", 2)


def fill_size(source_aspect: Column, target_aspect: Column) -> tuple[Column, Column]:
    """Largest window of the target aspect inside the source, as (w, h)."""
    w = F.when(source_aspect > target_aspect + 1e-6, target_aspect / source_aspect).otherwise(F.lit(1.0))
    h = F.when(source_aspect < target_aspect - 1e-6, source_aspect / target_aspect).otherwise(F.lit(1.0))
    return w, h


def tighten_factor(framing: Column, framing_confidence: Column, subject: Column, w: Column, h: Column) -> Column:
    """How much a trusted close or medium framing narrows the fill window around a subject."""
    desired = F.when(framing == "closeUp", 0.50).when(framing == "medium", 0.28)
    share = area(subject) / F.greatest(w * h, F.lit(1e-6))
    by_subject = F.greatest(subject["w"] / F.greatest(w, F.lit(1e-6)), subject["h"] / F.greatest(h, F.lit(1e-6)))
    factor = F.least(F.lit(1.0), F.greatest(F.lit(0.62), F.sqrt(share / desired), by_subject))
    return F.when((framing_confidence >= 0.55) & desired.isNotNull() & (share < desired * 0.6), factor).otherwise(F.lit(1.0))


def place_window(w: Column, h: Column, subject: Column, reference: Column, reference_confidence: Column) -> Column:
    """Put a window of size (w, h) over the subject, or where stills usually look best."""
    use = reference.isNotNull() & (reference_confidence >= 0.4)
    ax = F.when(use, center_x(reference)).otherwise(F.lit(0.5))
    ay = F.when(use, center_y(reference)).otherwise(F.lit(0.42))
    x = F.when(subject.isNull(), (1 - w) / 2).otherwise(center_x(subject) - ax * w)
    y = F.when(subject.isNull(), (1 - h) * 0.35).otherwise(center_y(subject) - ay * h)
    return clamp_inside(rect(x, y, w, h))


def fill_window(source_aspect: Column, target_aspect: Column, subject: Column, reference: Column,
                reference_confidence: Column, framing: Column, framing_confidence: Column) -> Column:
    w, h = fill_size(source_aspect, target_aspect)
    factor = F.when(subject.isNull(), F.lit(1.0)).otherwise(tighten_factor(framing, framing_confidence, subject, w, h))
    return place_window(w * factor, h * factor, subject, reference, reference_confidence)


def crop_at(start: Column, end: Column, easing: Column, duration: Column, t: Column) -> Column:
    progress = ease(easing, clamp(F.try_divide(t, duration), 0.0, 1.0))
    return F.when(duration > 0, clamp_inside(lerp(start, end, progress))).otherwise(start)


def source_time(source_start: Column, speed: Column, t: Column) -> Column:
    return source_start + t * speed
