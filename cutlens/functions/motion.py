"""Camera motion: naming a fitted similarity transform and turning it into a crop move."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutlens.functions.geometry import clamp, clamp_inside, full, offset, scaled_full


def motion_kind(m: Column) -> Column:
    zoom = F.abs(m["scale"] - 1)
    pan = F.greatest(F.abs(m["tx"]), F.abs(m["ty"]))
    zooms, pans, turns = zoom > 0.06, pan > 0.05, F.abs(m["rot"]) > 0.05
    zoom_name = F.when(m["scale"] > 1, "zoomIn").otherwise("zoomOut")
    pan_name = F.when(
        F.abs(m["tx"]) >= F.abs(m["ty"]), F.when(m["tx"] > 0, "panLeft").otherwise("panRight")
    ).otherwise(F.when(m["ty"] > 0, "panUp").otherwise("panDown"))
    return (
        F.when(turns & ~zooms & ~pans, "rotate")
        .when(turns, "complex")
        .when(zooms & pans & (zoom / 2 > pan * 1.6), zoom_name)
        .when(zooms & pans & (pan > zoom / 2 * 1.6), pan_name)
        .when(zooms & pans, "complex")
        .when(zooms, zoom_name)
        .when(pans, pan_name)
        .otherwise("none")
    )


def motion_confidence(m: Column) -> Column:
    fit = F.greatest(F.lit(0.0), 1 - m["residual"] * 8)
    seen = F.least(F.lit(1.0), m["n"].cast("double") / 5)
    return F.when(m["n"] > 0, F.least(F.lit(0.97), fit * 0.7 + seen * 0.3)).otherwise(F.lit(0.0))


def motion_energy(m: Column) -> Column:
    pan = F.sqrt(m["tx"] * m["tx"] + m["ty"] * m["ty"])
    return F.least(F.lit(1.0), F.abs(m["scale"] - 1) * 3 + pan * 4)


def camera_move(m: Column) -> Column:
    """Crop pair that reproduces the motion on a still: kind, confidence, start, end, easing."""
    kind, conf = motion_kind(m), motion_confidence(m)
    absent = m.isNull() | (m["n"] <= 0)
    unnamed = kind.isin("rotate", "complex")
    pan = kind.startswith("pan")
    dx, dy = clamp(m["tx"], -0.10, 0.10) / 2, clamp(m["ty"], -0.10, 0.10) / 2
    base = scaled_full(0.88)
    zoom_in = scaled_full(clamp(F.try_divide(F.lit(1.0), m["scale"]), 0.62, 0.98))
    zoom_out = scaled_full(clamp(m["scale"], 0.62, 0.98))
    start = (
        F.when(absent, full())
        .when(kind == "zoomOut", clamp_inside(zoom_out))
        .when(pan, clamp_inside(offset(base, dx, dy)))
        .otherwise(full())
    )
    end = (
        F.when(absent, full())
        .when(kind == "zoomIn", clamp_inside(zoom_in))
        .when(pan, clamp_inside(offset(base, -dx, -dy)))
        .when(unnamed, scaled_full(0.90))
        .otherwise(full())
    )
    return F.struct(
        F.when(absent, "none").when(unnamed, "zoomIn").otherwise(kind).alias("kind"),
        F.when(absent, F.lit(1.0)).when(unnamed, F.least(conf, F.lit(0.5))).otherwise(conf).alias("confidence"),
        start.alias("start"),
        end.alias("end"),
        F.when(absent | (kind == "none"), "linear").otherwise("easeInOut").alias("easing"),
    )


def transition_of(kind: Column, duration: Column) -> Column:
    """Transition that reproduces a detected boundary."""
    name = (
        F.when(kind.isin("start", "cut"), "cut")
        .when(kind.isin("dissolve", "unknownGradual"), "dissolve")
        .when(kind.isin("fadeFromBlack", "fadeToBlack"), "fadeToBlack")
        .otherwise("fadeToWhite")
    )
    return F.struct(name.alias("kind"), F.when(name == "cut", F.lit(0.0)).otherwise(clamp(duration, 0.12, 0.8)).alias("duration"))
