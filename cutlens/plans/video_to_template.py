"""From observations of videos to edit templates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlens.operators import motion, palette, shots, template
from cutlens.session import cut_lineage

SHOT = ["video_id", "shot_idx"]


@dataclass(frozen=True)
class Observations:
    """Inputs of an analysis; all but frames and durations may be missing, and a missing stage
    only leaves its part of the template at the defaults.

    ``text_tracks`` come from the text operator, ``tempo(video_id, bpm, confidence, basis)`` and
    ``beats(video_id, t)`` from the audio ones. ``whole_flow``: no shot has more flow vectors than a slice has rows.
    """

    frames: DataFrame
    durations: DataFrame
    thumbs: DataFrame | None = None
    flow: DataFrame | None = None
    boxes: DataFrame | None = None
    pixels: DataFrame | None = None
    text_tracks: DataFrame | None = None
    tempo: DataFrame | None = None
    beats: DataFrame | None = None
    whole_flow: bool = False


@dataclass(frozen=True)
class Templates:
    scenes: DataFrame
    text_slots: DataFrame
    stats: DataFrame
    confidence: DataFrame
    beat_grid: DataFrame | None


RECT = "struct<x:double,y:double,w:double,h:double>"
MOTION = "struct<scale:double,tx:double,ty:double,rot:double,residual:double,n:int>"
PALETTE = "struct<brightness:double,saturation:double,contrast:double>"


def compile_template(seen: Observations, aspect: float = 1.0) -> Templates:
    """Shots, motion, subjects, palettes, text and beats meet on (video, shot)."""
    cuts = cut_lineage(shots.detect_shots(seen.frames, seen.thumbs, seen.durations))
    rows, saturation = cuts, None
    if seen.flow is not None:
        fits = motion.similarity_fit(motion.steady_vectors(seen.flow, aspect), min_points=motion.MIN_POINTS, whole=seen.whole_flow)
        moves = motion.compose_motion(fits, aspect).select(*SHOT, F.struct("scale", "tx", "ty", "rot", "residual", "n").alias("motion"))
        rows = rows.join(moves, SHOT, "left")
    else:
        rows = rows.withColumn("motion", F.lit(None).cast(MOTION))
    if seen.boxes is not None:
        subjects = motion.subject_region(seen.boxes, SHOT, ["frame_idx"]).withColumnRenamed("region", "subject")
        rows = rows.join(subjects, SHOT, "left")
    else:
        rows = rows.withColumn("subject", F.lit(None).cast(RECT))
    rows = rows.withColumn("salient_area", F.when(F.col("subject").isNotNull(), F.least(F.lit(1.0), F.col("subject.w") * F.col("subject.h"))))
    if seen.pixels is not None:
        stats = cut_lineage(palette.palette_stats(seen.pixels, SHOT))
        rows = rows.join(stats.select(*SHOT, F.struct("brightness", "saturation", "contrast").alias("palette")), SHOT, "left")
        saturation = stats.groupBy("video_id").agg(F.avg("saturation").alias("mean_saturation"))
    else:
        rows = rows.withColumn("palette", F.lit(None).cast(PALETTE))
    scenes = cut_lineage(template.compile_scenes(rows, saturation))
    if seen.text_tracks is not None:
        slots = cut_lineage(template.compile_text_slots(seen.text_tracks))
    else:
        slots = cuts.limit(0).select("video_id", F.lit("caption").alias("role"), F.struct(F.lit(0.0).alias("confidence")).alias("font"))
    grid = template.compile_beat_grid(scenes, seen.beats, seen.tempo) if seen.beats is not None and seen.tempo is not None else None
    return Templates(
        scenes=scenes, text_slots=slots, stats=template.template_stats(scenes, slots, seen.durations),
        confidence=template.compile_confidence(scenes, slots, seen.tempo), beat_grid=grid)
