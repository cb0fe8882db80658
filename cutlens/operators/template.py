"""Edit templates compiled from shots, text tracks and audio, with a confidence on every value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlens.functions import color, labels, motion
from cutlens.functions import constants as K
from cutlens.functions import text as txt
from cutlens.functions.geometry import area, center_x, center_y, shot_framing
from cutlens.operators.ordered import nearest, positions, with_neighbours
from cutlens.operators.shots import upper_median

VIDEO = ["video_id"]


def scene_roles(shots: DataFrame) -> DataFrame:
    """Opening, closing, hero (one clearly longest interior scene), detail, wide or body.

    ``shots(video_id, shot_idx, start, end, salient_area)``.
    """
    seconds = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    sided = with_neighbours(shots.withColumn("_d", seconds), VIDEO, "shot_idx", 0, 1, lambda w: {"_last": F.lead("start").over(w).isNull()})
    interior = (F.col("shot_idx") > 0) & ~F.col("_last")
    stats = sided.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_d").alias("_mean"),
        F.max(F.when(interior, F.struct("_d", (-F.col("shot_idx")).alias("_i")))).alias("_hero"),
    )
    rows = sided.join(stats, "video_id")
    few, first = F.col("_n") <= 2, F.col("shot_idx") == 0
    hero = F.coalesce((F.col("shot_idx") == -F.col("_hero._i")) & (F.col("_d") > F.col("_mean") * 1.4), F.lit(False))
    a = F.col("salient_area")
    role = (
        F.when(first, "opening").when(few | F.col("_last"), "closing").when(hero, "hero")
        .when(a >= 0.45, "detail").when(a < 0.18, "wide").otherwise("body")
    )
    conf = F.when(few, 0.55).when(first | F.col("_last"), 0.86).when(hero, 0.71).when((a >= 0.45) | (a < 0.18), 0.66).otherwise(0.58)
    basis = (
        F.when(few, F.format_string("only %d scenes", "_n"))
        .when(first, F.format_string("first scene, %.2fs", "_d"))
        .when(F.col("_last"), F.format_string("last scene, %.2fs", "_d"))
        .when(hero, F.format_string("longest interior scene, %.2fs vs %.2fs mean", "_d", "_mean"))
        .when(a >= 0.45, F.format_string("tight framing, salient area %.2f", a))
        .when(a < 0.18, F.format_string("loose framing, salient area %.2f", a))
        .otherwise("interior scene, no distinguishing framing")
    )
    return rows.withColumn("role", labels.confident(role, conf, basis)).drop("_d", "_last", "_n", "_mean", "_hero")


def compile_scenes(shots: DataFrame, reference_saturation: DataFrame | None = None) -> DataFrame:
    """Scene rows of a template.

    ``shots`` carries boundaries (``kind``, ``boundary_seconds``, ``confidence``, ``basis``) and
    may carry nulls in ``salient_area``, ``subject`` (rectangle), ``motion`` (struct) and
    ``palette`` (struct of brightness, saturation, contrast).
    ``reference_saturation(video_id, mean_saturation)``.
    """
    rows = scene_roles(shots)
    if reference_saturation is None:
        rows = rows.withColumn("mean_saturation", F.lit(0.5))
    else:
        rows = rows.join(reference_saturation, "video_id", "left").withColumn("mean_saturation", F.coalesce("mean_saturation", F.lit(0.5)))
    m, a, idx = F.col("motion"), F.col("salient_area"), F.col("shot_idx")
    energy = F.coalesce(F.when(m.isNotNull(), motion.motion_energy(m)), F.lit(0.0))
    switch = motion.transition_of(F.col("kind"), F.col("boundary_seconds"))
    subject = F.col("subject")
    p = F.col("palette")
    return rows.select(
        "video_id", labels.numbered("scene", idx + 1).alias("scene_id"), labels.numbered("asset", idx + 1).alias("slot_id"),
        idx.alias("scene_idx"), "start", "end", "role",
        labels.confident(
            F.when(a.isNull(), "medium").otherwise(shot_framing(a)), F.when(a.isNull(), 0.30).otherwise(0.72),
            F.when(a.isNull(), "no salient region detected — defaulted").otherwise(F.format_string("salient area %.2f of frame", a)),
        ).alias("framing"),
        energy.alias("motion_energy"),
        F.when(m.isNull(), "unknown").when(energy > 0.12, "video").otherwise("image").alias("source_kind"),
        motion.camera_move(m).alias("move"),
        F.when(idx > 0, F.struct(switch["kind"].alias("kind"), F.col("confidence"), switch["duration"].alias("duration"), F.col("basis"))).alias("transition"),
        F.when(p.isNotNull(), color.scene_grade(p["contrast"], p["saturation"], F.col("mean_saturation"))).alias("grade"),
        F.when(subject.isNotNull(), F.struct(
            subject.alias("value"), F.lit(0.66).alias("confidence"),
            F.format_string("salient region centred (%.2f, %.2f), %.0f%% of frame", center_x(subject), center_y(subject), area(subject) * 100).alias("basis"),
        )).alias("subject"),
    )


def compile_text_slots(tracks: DataFrame) -> DataFrame:
    """Text slots from usable tracks in start order; watermarks are dropped before ranking."""
    usable = tracks.filter("NOT is_watermark")
    ordered = positions(usable, VIDEO, ["start", "track"], F.floor(F.col("start") / 600.0), out="slot_idx")
    totals = ordered.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"), F.max("size_ratio").alias("_largest"))
    rows = ordered.join(totals, "video_id")
    t = F.col("text")
    return rows.select(
        "video_id", labels.numbered("text", F.col("slot_idx") + 1).alias("slot_id"), "slot_idx", "start", "end", "frame",
        txt.text_role(t, F.col("slot_idx"), F.col("_n"), F.col("size_ratio"), F.col("_largest")).alias("role"),
        txt.text_align(F.col("frame")).alias("alignment"), txt.font_category(t, F.col("frame"), F.col("size_ratio")).alias("font"),
        txt.text_animation(F.col("growth"), F.col("observations")).alias("animation"),
        "size_ratio", "color_hex", t.alias("sample_text"), F.length(t).alias("char_hint"),
    )


def aligned_ratio(cuts: DataFrame, beats: DataFrame, keys: list[str], at: str = "t", tolerance: float = 0.08, width: float = 60.0) -> DataFrame:
    """Share of cuts with a beat within ``tolerance``: ``(keys, cuts, aligned, ratio)``."""
    near = nearest(cuts, beats.select(*keys, F.col("t").alias("_beat")), keys, at, tolerance=tolerance, width=width, right_at="_beat")
    return near.groupBy(*keys).agg(F.count(F.lit(1)).alias("cuts"), F.count("near_t").alias("aligned")).withColumn(
        "ratio", F.col("aligned") / F.col("cuts"))


def compile_beat_grid(scenes: DataFrame, beats: DataFrame, tempo: DataFrame) -> DataFrame:
    """Tempo and whether the cuts sit on the beats, for every video that has beats.

    ``beats(video_id, t)``, ``tempo(video_id, bpm, confidence, basis)``.
    """
    cuts = scenes.filter("scene_idx > 0").select("video_id", F.col("start").alias("t"))
    counted = aligned_ratio(cuts, beats, VIDEO)
    with_beats = tempo.join(beats.select("video_id").distinct(), "video_id", "left_semi").join(counted, "video_id", "left")
    n, ratio = F.coalesce("cuts", F.lit(0)), F.coalesce("ratio", F.lit(0.0))
    return with_beats.select(
        "video_id", "bpm", F.col("confidence").alias("bpm_confidence"), n.alias("cuts"), F.coalesce("aligned", F.lit(0)).alias("aligned"),
        (ratio >= 0.5).alias("cuts_aligned"),
        F.when(n == 0, 0.2).otherwise(F.least(F.lit(0.9), 0.5 + F.abs(ratio - 0.5))).alias("alignment_confidence"),
        F.when(ratio >= 0.5, "onBeat").otherwise("literal").alias("cut_style"),
        (F.col("confidence") > 0.3).alias("has_music"),
    )


def template_stats(scenes: DataFrame, text_slots: DataFrame, durations: DataFrame) -> DataFrame:
    """Scene count, upper-median length, cut rate, real transitions and text slots per template."""
    seconds = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    kind = labels.effective(F.col("transition.kind"), F.col("transition.confidence"), "cut")
    per_scene = scenes.select("video_id", seconds.alias("_d"), F.coalesce(kind != "cut", F.lit(False)).alias("_soft"))
    stats = per_scene.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("scene_count"), upper_median("_d").alias("median_seconds"), F.count_if("_soft").alias("transition_count"))
    slots = text_slots.filter("role <> 'watermark'").groupBy("video_id").agg(F.count(F.lit(1)).alias("text_slot_count"))
    return stats.join(durations, "video_id").join(slots, "video_id", "left").select(
        "video_id", "scene_count", "median_seconds",
        F.when(F.col("video_seconds") > 0, F.try_divide((F.col("scene_count") - 1).cast("double"), F.col("video_seconds"))).otherwise(F.lit(0.0)).alias("cuts_per_second"),
        "transition_count", F.coalesce("text_slot_count", F.lit(0)).alias("text_slot_count"),
    )


def confidence_rollup(parts: DataFrame) -> DataFrame:
    """Weighted overall confidence and the name of the weakest part, the first of equals.

    ``parts(video_id, scenes, motion, text, audio)``; a null means nothing was there to doubt
    (text and audio 1.0) or nothing to judge (scenes and motion .5).
    """
    value = {n: F.coalesce(F.col(n), F.lit(1.0 if n in ("text", "audio") else 0.5)) for n, _ in K.CONFIDENCE_WEIGHTS}
    filled = parts.select("video_id", *[v.alias(n) for n, v in value.items()])
    overall = sum((F.col(n) * w for n, w in K.CONFIDENCE_WEIGHTS), F.lit(0.0))
    ranked = [F.struct(F.col(n).alias("c"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, _) in enumerate(K.CONFIDENCE_WEIGHTS)]
    return filled.select("*", overall.alias("overall"), F.least(*ranked)["name"].alias("weakest"))


def compile_confidence(scenes: DataFrame, text_slots: DataFrame, tempo: DataFrame | None) -> DataFrame:
    """Mean confidences per part of each template, rolled up. Transition and role confidences
    count equally toward the scene part."""
    per = scenes.groupBy("video_id").agg(
        ((F.sum("role.confidence") + F.coalesce(F.sum("transition.confidence"), F.lit(0.0)))
         / (F.count("role.confidence") + F.count("transition.confidence"))).alias("scenes"),
        F.avg("move.confidence").alias("motion"))
    texts = text_slots.groupBy("video_id").agg(F.avg("font.confidence").alias("text"))
    joined = per.join(texts, "video_id", "left")
    if tempo is None:
        joined = joined.withColumn("audio", F.lit(None).cast("double"))
    else:
        joined = joined.join(tempo.select("video_id", F.col("confidence").alias("audio")), "video_id", "left")
    return confidence_rollup(joined)
