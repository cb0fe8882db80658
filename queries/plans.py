"""End-to-end jobs: video to template, music to template, arrange and bind."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlens.functions import color
from cutlens.operators import audio, music, text
from cutlens.plans.arrange_and_bind import arrange
from cutlens.plans.music_to_template import plan_templates
from cutlens.plans.video_to_template import Observations, compile_template
from cutlens.session import cut_lineage
from cutlens.sources import adapters as A
from queries.common import r6, registry

JOBS, SQL, register = registry()


def _observations(spark, sf) -> Observations:
    """Every stage of the same videos: frames and pictures from events, motion and boxes from line
    items, pixels from orders, text from conversations, beats and tempo from events."""
    frames = A.frames(spark, sf)
    seconds = cut_lineage(A.durations(frames))
    hits = A.turn_hits(spark, sf)
    onset = A.onset(spark, sf)
    tempo = cut_lineage(audio.estimate_tempo(onset, 2, 8).select(F.col("track_id").alias("video_id"), "bpm", "confidence", "basis"))
    beats = frames.filter("content_value > 0.1").select("video_id", "t")
    pixels = A.pixel_grid(spark, sf).select((F.col("asset_id") % 40).alias("video_id"), (F.col("x") % 6).alias("shot_idx"), "sample_id", "r", "g", "b")
    whole_flow = A.crowded_flow(spark, sf) is None
    boxes = A.boxes(spark, sf).select("video_id", F.col("shot_idx").cast("bigint").alias("shot_idx"), "frame_idx", "x", "y", "w", "h")
    return Observations(
        frames=frames, durations=seconds, thumbs=A.thumbs(spark, sf, frames), flow=A.flow(spark, sf, whole_flow), boxes=boxes, pixels=pixels,
        text_tracks=cut_lineage(text.text_tracks(hits, seconds)), tempo=tempo, beats=beats, whole_flow=whole_flow)


@register("compile_template")
def compile_template_stats(spark, sf):
    t = compile_template(_observations(spark, sf))
    grid = t.beat_grid.select("video_id", "cuts_aligned", "cut_style", r6("bpm").alias("bpm"))
    return t.stats.join(t.confidence.select("video_id", r6("overall").alias("overall"), "weakest"), "video_id").join(grid, "video_id", "left").select(
        "video_id", "scene_count", r6("median_seconds").alias("median_seconds"), r6("cuts_per_second").alias("cuts_per_second"), "transition_count", "text_slot_count", "overall", "weakest", "cuts_aligned", "cut_style", "bpm")


@register("plan_templates_from_music")
def _(spark, sf):
    energy = A.energy(spark, sf)
    tracks = energy.groupBy("track_id").agg((F.count(F.lit(1)) * 2.0).alias("track_seconds"))
    _, scenes = plan_templates(energy, A.beats(spark, sf).select("track_id", "t", "is_downbeat"), tracks, 0.5)
    return scenes.select("track_id", "scene_id", r6("start").alias("start_t"), r6("end").alias("end_t"), "section", "role", "framing", "move", "transition")


@register("arrange_and_bind")
def arrange_and_bind(spark, sf):
    """Templates of the slot table bound to the asset pools, best of four seeds."""
    slots = A.slots(spark, sf)
    sure = lambda v, c=None: F.struct(v.alias("value"), (F.lit(1.0) if c is None else c).alias("confidence"))
    ends = F.col("scene_idx") * 1.2 + 1.2
    scenes = slots.select(
        "project_id", "scene_idx", F.format_string("scene_%02d", F.col("scene_idx") + 1).alias("scene_id"), "slot_id", (ends - 1.2).alias("start"), ends.alias("end"), sure(F.col("role")).alias("role"),
        sure(F.col("framing"), F.col("framing_confidence")).alias("framing"), sure(F.col("subject"), F.col("subject_confidence")).alias("subject"), "source_kind",
        F.struct(F.lit("none").alias("kind"), F.lit(1.0).alias("confidence"), F.col("subject").alias("start"), F.col("subject").alias("end"), F.lit("linear").alias("easing")).alias("move"),
        F.when(F.col("scene_idx") > 0, F.struct(F.lit("dissolve").alias("kind"), F.lit(0.7).alias("confidence"), F.lit(0.3).alias("duration"))).alias("transition"),
        color.grade(0.0, 1.0, 1.0, 0.0).alias("grade"))
    projects = slots.select("project_id").distinct().select("project_id", F.lit(0.5625).alias("canvas_aspect"), F.lit(0.0).alias("clip_volume"), F.lit("literal").alias("cut_style"))
    _, clips = arrange(scenes, A.assets(spark, sf), A.features(spark, sf), projects)
    return clips.select("project_id", "pos", "slot_id", "asset_id", r6("start").alias("start_t"), r6("duration").alias("seconds"), r6("crop_start.x").alias("x"), r6("crop_start.w").alias("w"))
