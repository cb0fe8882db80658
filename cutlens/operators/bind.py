"""Binding a template and an assignment into a timeline.

``scenes(project_id, scene_idx, scene_id, slot_id, start, end, move, framing, subject,
transition, grade)`` as the compiler makes them, keyed by project; ``assignments(project_id,
slot_id, asset_id)``; ``assets(project_id, asset_id, kind, aspect, asset_seconds)``;
``features(project_id, asset_id, region)``; ``projects(project_id, canvas_aspect, fps,
clip_volume, cut_style, template_seconds)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlens.functions import color, geometry as g, labels
from cutlens.functions import text as txt
from cutlens.operators.timeline import relayout, scene_durations, with_fill_window

RECT = "struct<x:double,y:double,w:double,h:double>"


@dataclass(frozen=True)
class BindOptions:
    fidelity: str = "closeMatch"  # closeMatch, styleOnly or structureOnly
    apply_grade: bool = False
    respect_beats: bool = True
    fps: int = 30

    @property
    def structure_only(self) -> bool:
        return self.fidelity == "structureOnly"


def with_crops(df: DataFrame, move: Column, has_asset: Column, source_aspect: Column, target_aspect: Column, region: Column,
               subject: Column, framing: Column, binds_moves: bool = True) -> DataFrame:
    """Add ``crop_start`` and ``crop_end``: the trusted move laid into the asset's fill window."""
    moving = F.lit(binds_moves) & labels.is_trusted(move["confidence"]) & (move["kind"] != "none")
    framed = with_fill_window(df, "_window", source_aspect, target_aspect, region, subject["value"], subject["confidence"], framing["value"], framing["confidence"])
    for end in ("start", "end"):
        framed = framed.withColumn("_raw", F.when(moving, move[end]).otherwise(g.full())).withColumn(
            f"crop_{end}", F.when(has_asset, g.compose(F.col("_window"), F.col("_raw"))).otherwise(F.col("_raw")))
    return framed.drop("_window", "_raw")


def bind_clips(scenes: DataFrame, assignments: DataFrame, assets: DataFrame, features: DataFrame, projects: DataFrame,
               beats: DataFrame | None = None, options: BindOptions = BindOptions()) -> DataFrame:
    """Clips of every project, laid out without gaps.

    Beats are used for projects cut ``onBeat``; ``beats(project_id, t)``.
    """
    timed = scenes.select(F.col("project_id").alias("template_id"), "scene_idx", "start", "end")
    snapping = projects.filter("cut_style = 'onBeat'").select(F.col("project_id").alias("template_id"))
    grid = (beats.select(F.col("project_id").alias("template_id"), "t") if beats is not None
            else timed.select("template_id", F.col("start").alias("t")).limit(0))
    if not options.respect_beats:
        grid = grid.limit(0)
    seconds = scene_durations(timed, grid.join(snapping, "template_id", "left_semi"), options.fps).select(
        F.col("template_id").alias("project_id"), "scene_idx", "seconds")
    rows = (
        scenes.join(seconds, ["project_id", "scene_idx"])
        .join(assignments.select("project_id", "slot_id", "asset_id"), ["project_id", "slot_id"], "left")
        .join(assets.select("project_id", "asset_id", "kind", "aspect", "asset_seconds"), ["project_id", "asset_id"], "left")
        .join(features.select("project_id", "asset_id", "region"), ["project_id", "asset_id"], "left")
        .join(projects.select("project_id", "canvas_aspect", "clip_volume"), "project_id")
    )
    rows = with_crops(
        rows, F.col("move"), F.col("kind").isNotNull(), F.col("aspect"), F.col("canvas_aspect"), F.col("region"), F.col("subject"), F.col("framing"),
        not options.structure_only)
    tr = F.col("transition")
    kind = labels.effective(tr["kind"], tr["confidence"], "cut")
    bound = F.when(
        F.lit(not options.structure_only) & (F.col("scene_idx") > 0) & tr.isNotNull(),
        F.struct(kind.alias("kind"), labels.effective_duration(kind, tr["duration"]).alias("duration"), F.lit(None).cast("string").alias("direction")))
    video = F.coalesce(F.col("kind") == "video", F.lit(False))
    grade = F.col("grade") if options.apply_grade and not options.structure_only else F.lit(None)
    clips = rows.select(
        "project_id", F.col("scene_idx").alias("pos"), labels.stable_id(F.col("project_id").cast("string"), F.concat(F.lit("clip/"), F.col("scene_id"))).alias("clip_id"),
        "slot_id", "asset_id", "start", F.col("seconds").alias("duration"),
        F.when(video, F.least(F.lit(0.25), F.greatest(F.lit(0.0), F.col("asset_seconds") - F.col("seconds")))).otherwise(F.lit(0.0)).alias("source_start"),
        F.lit(1.0).alias("speed"), F.lit(1.0).alias("opacity"), F.when(video, F.col("clip_volume")).otherwise(F.lit(0.0)).alias("volume"),
        "crop_start", "crop_end", F.col("move.easing").alias("easing"), bound.alias("transition"),
        F.coalesce(grade, color.grade(0.0, 1.0, 1.0, 0.0)).alias("grade"), F.lit(0.0).alias("vignette"), F.lit(0.0).alias("grain"), F.lit("fill").alias("fit"))
    return relayout(clips, options.fps)


def bind_text(slots: DataFrame, user_text: DataFrame, fps: int = 30) -> DataFrame:
    """Text layers from the user's own words; a slot the user left blank gives no layer.

    ``slots`` as compiled, keyed by project; ``user_text(project_id, slot_id, text)``. The
    template's sample text is never read.
    """
    words = user_text.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text <> ''")
    rows = slots.filter("role <> 'watermark'").drop("sample_text").join(words, ["project_id", "slot_id"])
    font, anim = F.col("font"), F.col("animation")
    return rows.select(
        "project_id", labels.stable_id(F.col("project_id").cast("string"), F.concat(F.lit("text/"), F.col("slot_id"))).alias("layer_id"),
        "slot_id", "text", "role", g.snap_to_frame(F.col("start"), fps).alias("start"), g.snap_to_frame(F.col("end"), fps).alias("end"),
        "frame", "alignment", labels.effective(font["value"], font["confidence"], "sansSerif").alias("font"),
        F.when(font["value"] == "displayBold", "heavy").otherwise("bold").alias("weight"),
        txt.fit_text_size(F.col("size_ratio"), F.col("char_hint"), F.col("text")).alias("size_ratio"), "color_hex",
        labels.effective(anim["entry"], anim["entry_confidence"], "fadeIn").alias("entry"),
        labels.effective(anim["exit"], anim["exit_confidence"], "fadeOut").alias("exit"))


def bind_audio(content: DataFrame, assets: DataFrame) -> DataFrame:
    """Music, reference and voice clips. ``content(project_id, template_seconds, music_id,
    reference_id, voice_id)`` with nullable ids."""
    total = F.col("template_seconds")
    item = lambda role, asset, volume, fade_in, fade_out: F.struct(
        F.lit(role).alias("role"), F.col(asset).alias("asset_id"), volume.alias("volume"), F.lit(fade_in).alias("fade_in"), fade_out.alias("fade_out"))
    items = F.array(
        item("music", "music_id", F.lit(1.0), 0.15, F.least(F.lit(0.8), total * 0.1)),
        item("reference", "reference_id", F.when(F.col("music_id").isNull(), 1.0).otherwise(0.5), 0.05, F.least(F.lit(0.6), total * 0.08)),
        item("voice", "voice_id", F.lit(1.0), 0.02, F.lit(0.05)))
    wanted = content.withColumn("c", F.explode(items)).filter("c.asset_id IS NOT NULL").select("project_id", "template_seconds", "c.*")
    track = F.coalesce("asset_seconds", "template_seconds")
    return wanted.join(assets.select("project_id", "asset_id", "asset_seconds"), ["project_id", "asset_id"], "left").select(
        "project_id", F.concat(F.lit("audio/"), "role").alias("clip_id"), "asset_id", "role", F.lit(0.0).alias("start"),
        F.when(track > 0, F.least(total, track)).otherwise(total).alias("duration"), F.lit(0.0).alias("source_start"),
        "volume", "fade_in", "fade_out", F.lit(False).alias("muted"))


def bind_content(content: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audio clips and overlays of every project, from what its user brought along (``content`` of ``bind_audio`` with
    ``logo_id``)."""
    return bind_audio(content, assets), logo_overlay(content)


def logo_overlay(content: DataFrame) -> DataFrame:
    """The logo for the whole length, low in the frame. ``content(project_id, template_seconds, logo_id)``."""
    return content.filter("logo_id IS NOT NULL").select(
        "project_id", F.lit("overlay/logo").alias("overlay_id"), F.col("logo_id").alias("asset_id"), F.lit(0.0).alias("start"),
        F.col("template_seconds").alias("end"), g.rect(0.36, 0.855, 0.28, 0.075).alias("frame"), F.lit(0.92).alias("opacity"))
