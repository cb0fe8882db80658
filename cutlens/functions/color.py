"""Colour conversion, grading and filter presets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutlens.functions import constants as K
from cutlens.functions.geometry import clamp, num


def luma709(r: Column, g: Column, b: Column) -> Column:
    return K.LUMA_R * r + K.LUMA_G * g + K.LUMA_B * b


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = top - low
    red = F.try_divide(g - b, delta)
    hue = (
        F.when(delta <= 1e-6, F.lit(0.0))
        .when(top == r, F.when(red < 0, red + 6).otherwise(red) / 6)
        .when(top == g, (F.try_divide(b - r, delta) + 2) / 6)
        .otherwise((F.try_divide(r - g, delta) + 4) / 6)
    )
    return F.struct(hue.alias("h"), saturation(r, g, b).alias("s"), top.alias("v"))


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top > 1e-6, F.try_divide(top - F.least(r, g, b), top)).otherwise(F.lit(0.0))


def distance2(r1: Column, g1: Column, b1: Column, r2: Column, g2: Column, b2: Column) -> Column:
    return (r1 - r2) * (r1 - r2) + (g1 - g2) * (g1 - g2) + (b1 - b2) * (b1 - b2)


def hue_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 1 - d)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used: functions of arrays run element by
    element, and what stands inside them is evaluated anew for each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_mean(values: Column) -> Column:
    return once(values, lambda v: F.try_divide(array_sum(v), F.size(v).cast("double")))


def mean_hue_distance(a: Column, b: Column) -> Column:
    """Mean circular distance of two hue planes, doubled so that it spans 0..1."""
    return array_mean(F.zip_with(a, b, hue_distance)) * 2


def mean_abs_difference(a: Column, b: Column) -> Column:
    """0 when the sizes differ or the planes are empty."""
    diff = lambda b: array_mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return once(b, lambda b: F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), diff(b)).otherwise(F.lit(0.0)))


def blend_residual(frame: Column, a: Column, b: Column, alpha: Column) -> Column:
    """Mean error of explaining ``frame`` as ``(1 - alpha) * a + alpha * b``."""
    predicted = once(alpha, lambda w: F.zip_with(a, b, lambda x, y: x * (1 - w) + y * w))
    same = (F.size(frame) == F.size(a)) & (F.size(frame) == F.size(b)) & (F.size(frame) > 0)
    return F.when(same, mean_abs_difference(frame, predicted)).otherwise(F.lit(float("inf")))


def to_hex(r: Column, g: Column, b: Column) -> Column:
    parts = [F.round(clamp(c, 0.0, 1.0) * 255).cast("int") for c in (r, g, b)]
    return F.format_string("#%02X%02X%02X", *parts)


def parse_hex(text: Column) -> Column:
    """#RRGGBB or #RRGGBBAA as 0..1 channels; anything else is opaque white."""
    bare = F.regexp_replace(F.trim(text), "^#", "")
    good = bare.rlike("^([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$")
    safe = F.when(good, F.rpad(bare, 8, "F")).otherwise(F.lit("FFFFFFFF"))
    channel = lambda i: F.conv(F.substring(safe, i, 2), 16, 10).cast("double") / 255
    return F.struct(*[channel(i).alias(n) for n, i in zip("rgba", (1, 3, 5, 7))])


def grade(exposure, contrast, sat, temperature) -> Column:
    names = ("exposure", "contrast", "saturation", "temperature")
    return F.struct(*[num(v).alias(n) for n, v in zip(names, (exposure, contrast, sat, temperature))])


def apply_grade(r: Column, g: Column, b: Column, gr: Column) -> Column:
    """Stops, contrast about mid grey, saturation about luma, temperature, clamp."""
    lit = [(c * F.pow(F.lit(2.0), gr["exposure"]) - 0.5) * gr["contrast"] + 0.5 for c in (r, g, b)]
    y = luma709(*lit)
    out = [y + (c - y) * gr["saturation"] for c in lit]
    warm = gr["temperature"] * 0.06
    shifted = (out[0] + warm, out[1], out[2] - warm)
    return F.struct(*[clamp(c, 0.0, 1.0).alias(n) for n, c in zip("rgb", shifted)])


def scene_grade(contrast: Column, sat: Column, reference_sat: Column) -> Column:
    ratio = sat / F.greatest(F.lit(0.01), reference_sat)
    return grade(0.0, clamp(contrast, 0.9, 1.2), clamp(ratio, 0.85, 1.25), 0.0)


def infer_grade(asset: Column, reference: Column) -> Column:
    """Nudge an asset palette toward a reference palette."""
    ratio = lambda n: F.when(asset[n] > 0.01, F.try_divide(reference[n], asset[n])).otherwise(F.lit(1.0))
    return grade(
        clamp((reference["brightness"] - asset["brightness"]) * 0.5, -0.25, 0.25),
        clamp(1 + (ratio("contrast") - 1) * 0.4, 0.85, 1.25),
        clamp(1 + (ratio("saturation") - 1) * 0.4, 0.80, 1.30),
        0.0,
    )


def match_preset(gr: Column, vignette: Column, grain: Column) -> Column:
    """Id of the first preset within .01 of every field, null when none is."""
    fields = [gr["exposure"], gr["contrast"], gr["saturation"], gr["temperature"], vignette, grain]
    hits = []
    for preset in K.PRESETS:
        close = F.lit(True)
        for field, value in zip(fields, preset[1:]):
            close = close & (F.abs(F.lit(value) - field) < 0.01)
        hits.append(F.when(close, F.lit(preset[0])))
    return F.coalesce(*hits)
