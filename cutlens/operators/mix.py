"""Audio mix plans: gain envelopes with fades and ducking.

``audio(project_id, clip_id, asset_id, role, start, duration, volume, fade_in, fade_out, muted)``
and video ``clips(project_id, clip_id, asset_id, start, duration, volume)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlens.functions import constants as K
from cutlens.functions.labels import clip_gain, duck_factor
from cutlens.operators.ordered import asof, positions, running_max

PROJECT = ["project_id"]
TRACK = ["project_id", "track_id"]


def voice_intervals(audio: DataFrame, timelines: DataFrame | None = None) -> DataFrame:
    """Audible voices, which music is lowered under; none in a project whose timeline has
    ``duck_music_under_voice`` off (``timelines(project_id, duck_music_under_voice)``)."""
    voices = audio.filter((F.col("role") == "voice") & ~F.col("muted") & (F.col("volume") > 0))
    if timelines is not None:
        voices = voices.join(timelines.filter("NOT duck_music_under_voice").select("project_id"), "project_id", "left_anti")
    return voices.select(
        "project_id", F.col("start").alias("v_start"), (F.col("start") + F.col("duration")).alias("v_end"))


def duck_points(points: DataFrame, voices: DataFrame, level: float = K.DUCK_LEVEL, ramp: float = K.DUCK_RAMP, width: float = 60.0) -> DataFrame:
    """Deepest duck factor at each ``points(project_id, t, ...)``; 1 where no voice is near.

    The deepest factor belongs to the nearest voice: the furthest end among those begun by then,
    or the next one to begin. Both are as-of lookups, so no point meets more than two intervals.
    """
    ordered = positions(voices, PROJECT, ["v_start", "v_end"], F.floor(F.col("v_start") / 600.0), out="_i")
    reach = running_max(ordered, PROJECT, "_i", F.col("v_end"), "reach")
    found = asof(points, reach, PROJECT, "t", ["reach"], width, right_at="v_start", forward=True)
    t = F.col("t")
    behind = duck_factor(t, F.least(t, F.col("prev_reach")), F.col("prev_reach"), level, ramp)
    ahead = duck_factor(t, F.col("next_t"), F.col("next_t"), level, ramp)
    return found.select(*points.columns, F.least(F.coalesce(behind, F.lit(1.0)), F.coalesce(ahead, F.lit(1.0))).alias("duck"))


def mix_plan(audio: DataFrame, clips: DataFrame, assets: DataFrame, timelines: DataFrame | None = None, cell: float = 10.0) -> DataFrame:
    """Gain envelope points ``(project_id, track_id, role, t, gain)`` of every audible track.

    ``assets(project_id, asset_id, kind)``: tracks of unknown assets are dropped, and only video
    clips with volume make sound of their own. ``timelines`` may switch ducking off, see ``voice_intervals``.
    """
    pool = assets.select("project_id", "asset_id", "kind")
    a = (
        audio.filter(~F.col("muted") & (F.col("volume") > 0) & (F.col("duration") > 0)).join(pool.drop("kind"), ["project_id", "asset_id"], "left_semi")
        .select("project_id", F.col("clip_id").cast("string").alias("track_id"), "role", "start", (F.col("start") + F.col("duration")).alias("end"),
                "volume", "fade_in", "fade_out", F.lit(0.0).alias("edge"), F.col("role").isin("music", "reference", "clipAudio").alias("ducked"))
    )
    edge = F.least(F.lit(K.CLIP_EDGE_FADE), F.col("duration") / 2)
    v = (
        clips.filter((F.col("volume") > K.AUDIBLE_GAIN) & (F.col("duration") > 0)).join(pool.filter("kind = 'video'").drop("kind"), ["project_id", "asset_id"], "left_semi")
        .select("project_id", F.col("clip_id").cast("string").alias("track_id"), F.lit("clipAudio").alias("role"), "start", (F.col("start") + F.col("duration")).alias("end"),
                "volume", F.lit(0.0).alias("fade_in"), F.lit(0.0).alias("fade_out"), edge.alias("edge"), F.lit(True).alias("ducked"))
    )
    tracks = a.unionByName(v)
    voices = voice_intervals(audio, timelines)

    start, end = F.col("start"), F.col("end")
    own = F.array_compact(F.array(
        start, end,
        F.when(F.col("fade_in") > 0, F.least(end, start + F.col("fade_in"))), F.when(F.col("fade_out") > 0, F.greatest(start, end - F.col("fade_out"))),
        F.when(F.col("edge") > 0, start + F.col("edge")), F.when(F.col("edge") > 0, end - F.col("edge"))))
    own_points = tracks.withColumn("t", F.explode(own))
    # voice edges that fall inside a ducked track: both meet in time cells
    edges = voices.select("project_id", F.explode(F.array(
        F.col("v_start") - K.DUCK_RAMP, F.col("v_start"), F.col("v_end"), F.col("v_end") + K.DUCK_RAMP)).alias("t")).distinct().withColumn("_cell", F.floor(F.col("t") / cell))
    ducked = tracks.filter("ducked").withColumn("_cell", F.explode(F.sequence(F.floor(start / cell), F.floor(end / cell))))
    inside = ducked.join(edges, ["project_id", "_cell"]).filter((F.col("t") >= start) & (F.col("t") <= end)).drop("_cell")
    points = own_points.unionByName(inside.select(*own_points.columns)).distinct()

    t = F.col("t")
    faded = clip_gain(F.col("volume"), F.col("fade_in"), F.col("fade_out"), start, end, F.lit(False), F.least(t, end - 1e-6))
    into, out = t - start, end - t
    e = F.col("edge")
    edged = F.col("volume") * F.when(into < e, F.try_divide(into, e)).otherwise(F.lit(1.0)) * F.when(out < e, F.try_divide(out, e)).otherwise(F.lit(1.0))
    raw = F.when(F.col("role") == "clipAudio", F.when(e > 0, edged).otherwise(F.col("volume"))).otherwise(faded)
    gained = duck_points(points, voices).withColumn(
        "gain", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw * F.when(F.col("ducked"), F.col("duck")).otherwise(F.lit(1.0)))))
    audible = gained.groupBy(*TRACK, "role").agg(F.max("gain").alias("_top")).filter(F.col("_top") > K.AUDIBLE_GAIN)
    return gained.select(*TRACK, "role", "start", "end", "t", "gain").join(audible.drop("_top"), [*TRACK, "role"], "left_semi")


def envelope_gain(points: DataFrame, instants: DataFrame, width: float = 60.0) -> DataFrame:
    """Gain of each track at ``instants(project_id, track_id, t)``: linear between envelope
    points, 0 outside the track."""
    found = asof(instants, points.select(*TRACK, F.col("t").alias("p"), "gain"), TRACK, "t", ["gain"], width, right_at="p", forward=True)
    span = F.col("next_t") - F.col("prev_t")
    part = F.try_divide(F.col("t") - F.col("prev_t"), span)
    mixed = F.col("prev_gain") + (F.col("next_gain") - F.col("prev_gain")) * part
    gain = F.when(F.col("prev_t").isNull() | F.col("next_t").isNull(), F.lit(0.0)).when(span > 1e-9, mixed).otherwise(F.col("next_gain"))
    return found.select(*instants.columns, gain.alias("gain"))
