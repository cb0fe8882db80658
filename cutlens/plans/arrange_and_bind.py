"""From a template and a pool of assets to the best of several finished timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlens.functions.geometry import full
from cutlens.operators import assign, bind, music, quality
from cutlens.session import cut_lineage
from cutlens.sources import adapters

REPEAT_SEEDS = (0, 1, 2, 3)


def slots_of(scenes: DataFrame, projects: DataFrame) -> DataFrame:
    """Slot rows for the assignment from compiled scenes."""
    s = scenes.join(projects.select("project_id", "canvas_aspect"), "project_id")
    return s.select(
        "project_id", "slot_id", "scene_idx", F.col("role.value").alias("role"), F.col("framing.value").alias("framing"), F.col("framing.confidence").alias("framing_confidence"),
        F.col("subject.value").alias("subject"), F.coalesce("subject.confidence", F.lit(0.0)).alias("subject_confidence"), "source_kind",
        (F.col("end") - F.col("start")).alias("seconds"), "canvas_aspect")


def arrange(scenes: DataFrame, assets: DataFrame, features: DataFrame, projects: DataFrame, beats: DataFrame | None = None,
            locks: DataFrame | None = None, options: bind.BindOptions = bind.BindOptions()) -> tuple[DataFrame, DataFrame]:
    """Assign, bind and score every seed at once; keep each project's best.

    Returns the assignment and the clips of the chosen seed. Seeds become part of the project key
    while they are bound and scored, so all of them share one job.
    """
    found = cut_lineage(assign.assign_assets(slots_of(scenes, projects), assets, features, locks, REPEAT_SEEDS))
    seeds = F.explode(F.array(*[F.lit(s) for s in REPEAT_SEEDS]))
    tag = lambda df: df.withColumn("project_id", F.struct("project_id", "seed")).drop("seed")
    spread = lambda df: tag(df.withColumn("seed", seeds))
    grid = None if beats is None else spread(beats.select("project_id", "t"))
    clips = cut_lineage(bind.bind_clips(
        spread(scenes).withColumn("project_id", F.to_json("project_id")), tag(found).withColumn("project_id", F.to_json("project_id")),
        spread(assets).withColumn("project_id", F.to_json("project_id")), spread(features).withColumn("project_id", F.to_json("project_id")),
        spread(projects).withColumn("project_id", F.to_json("project_id")), None if grid is None else grid.withColumn("project_id", F.to_json("project_id")), options))
    planned = None
    if grid is not None:
        on_beat = projects.filter("cut_style = 'onBeat'").select("project_id")
        planned = spread(beats.join(on_beat, "project_id", "left_semi").select("project_id", "t")).withColumn("project_id", F.to_json("project_id"))
    kinds = spread(assets.select("project_id", "asset_id", "kind")).withColumn("project_id", F.to_json("project_id"))
    scored = quality.edit_quality(clips, kinds, planned, options.fps)
    key = f"project_id {dict(scenes.dtypes)['project_id']}, seed int"
    opened = lambda df: df.withColumn("_k", F.from_json("project_id", key)).withColumn("project_id", F.col("_k.project_id")).withColumn("seed", F.col("_k.seed")).drop("_k")
    best = cut_lineage(assign.best_of_seeds(opened(scored).select("project_id", "seed", "total", F.col("repeat_issues").alias("repeats"))).select("project_id", "seed", "total"))
    chosen = best.select("project_id", "seed")
    return found.join(chosen, ["project_id", "seed"], "left_semi"), opened(clips).join(chosen, ["project_id", "seed"], "left_semi").drop("seed")


def bind_music_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Music templates of every track bound to five assets each (whole tables, for checks)."""
    beats, sections = adapters.beats(spark, folder), adapters.music_sections(spark, folder)
    tracks = beats.select("track_id").distinct().withColumn("track_seconds", F.lit(60.0))
    cuts = cut_lineage(music.plan_cuts(beats.select("track_id", "t", "is_downbeat"), sections, tracks))
    planned = music.plan_music_template(cuts, sections)
    sure = lambda value: F.struct(value.alias("value"), F.lit(1.0).alias("confidence"))
    scenes = planned.select(
        F.col("track_id").alias("project_id"), "scene_idx", "scene_id", "slot_id", "start", "end", sure(F.col("role")).alias("role"), sure(F.col("framing")).alias("framing"),
        F.struct(F.col("move").alias("kind"), F.lit(1.0).alias("confidence"), F.col("crop_start").alias("start"), F.col("crop_end").alias("end"), "easing").alias("move"),
        F.struct(F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("value"), F.lit(0.0).alias("confidence")).alias("subject"),
        F.when(F.col("transition").isNotNull(), F.struct(F.col("transition").alias("kind"), F.lit(1.0).alias("confidence"), F.col("transition_seconds").alias("duration"))).alias("transition"),
        F.lit(None).cast("struct<exposure:double,contrast:double,saturation:double,temperature:double>").alias("grade"))
    pool = tracks.withColumn("asset_id", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>"))).select(
        F.col("track_id").alias("project_id"), "asset_id", F.when((F.col("asset_id") + F.col("track_id")) % 2 == 0, "video").otherwise("image").alias("kind"),
        (0.6 + F.col("asset_id") * 0.4).alias("aspect"), (F.col("asset_id") * 0.6).alias("asset_seconds"))
    assignment = scenes.select("project_id", "slot_id", (F.col("scene_idx") % 5).cast("bigint").alias("asset_id"))
    features = pool.select("project_id", "asset_id", F.when(F.col("asset_id") % 2 == 0, full()).alias("region"))
    projects = tracks.select(F.col("track_id").alias("project_id"), F.lit(0.5625).alias("canvas_aspect"), F.lit(0.3).alias("clip_volume"), F.lit("onBeat").alias("cut_style"))
    return bind.bind_clips(scenes, assignment, pool, features, projects, beats.select(F.col("track_id").alias("project_id"), "t"))
