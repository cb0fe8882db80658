"""Timelines: layout, lookups at instants, treatments and bounded edits.

``clips(project_id, pos, clip_id, asset_id, start, duration, source_start, speed, volume,
opacity, crop_start, crop_end, easing, transition, grade, vignette, grain, fit)`` with dense
``pos`` per project; ``transition`` is a nullable struct of kind, duration, direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlens.functions import color, geometry as g
from cutlens.functions import constants as K
from cutlens.functions import text as txt
from cutlens.operators.ordered import active_at, asof, nearest, positions, running_max, running_sum, with_entity, with_neighbours

PROJECT = ["project_id"]
PLACE = ["project_id", "pos", "clip_id", "start", "duration", "transition"]
FPS = 30


def with_fill_window(df: DataFrame, out: str, source_aspect: Column, target_aspect: Column, subject: Column, reference: Column,
                     reference_confidence: Column, framing: Column, framing_confidence: Column) -> DataFrame:
    """Add the fill window step by step, so that no step is evaluated more than once per row."""
    w, h = g.fill_size(source_aspect, target_aspect)
    sized = df.withColumn("_fw", w).withColumn("_fh", h).withColumn(
        "_k", F.when(subject.isNull(), F.lit(1.0)).otherwise(g.tighten_factor(framing, framing_confidence, subject, F.col("_fw"), F.col("_fh"))))
    narrowed = sized.withColumn("_fw", F.col("_fw") * F.col("_k")).withColumn("_fh", F.col("_fh") * F.col("_k"))
    return narrowed.withColumn(out, g.place_window(F.col("_fw"), F.col("_fh"), subject, reference, reference_confidence)).drop("_fw", "_fh", "_k")


def relayout(clips: DataFrame, fps: int = FPS, whole: bool = False) -> DataFrame:
    """Gapless frame-aligned starts, at least one frame per clip.

    Durations are whole frames, so starts are an integer prefix sum. ``whole``, here and below: no project has more
    rows than a slice (``ordered.crowded`` tells), and each is taken as one.
    """
    frames = clips.withColumn("_frames", F.greatest(F.lit(1), g.frame_count(F.col("duration"), fps)))
    laid = running_sum(frames, PROJECT, "pos", {"_before": F.col("_frames")}, inclusive=False, whole=whole)
    return laid.withColumn("start", F.col("_before") / fps).withColumn("duration", F.col("_frames") / fps).drop("_frames", "_before")


def timeline_duration(clips: DataFrame, texts: DataFrame, audio: DataFrame, overlays: DataFrame, projects: DataFrame) -> DataFrame:
    """Latest end of anything on the timeline, 0 when it is empty."""
    ends = [
        clips.select("project_id", (F.col("start") + F.col("duration")).alias("end")),
        texts.select("project_id", "end"),
        audio.select("project_id", (F.col("start") + F.col("duration")).alias("end")),
        overlays.select("project_id", "end"),
    ]
    every = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3])
    last = every.groupBy("project_id").agg(F.max("end").alias("_end"))
    return projects.select("project_id").join(last, "project_id", "left").select(
        "project_id", F.greatest(F.lit(0.0), F.coalesce("_end", F.lit(0.0))).alias("timeline_seconds"))


def active_clip(clips: DataFrame, instants: DataFrame, width: float = 60.0) -> DataFrame:
    """The clip under each ``instants(project_id, t)``; the first clip before the start, the last
    one after the end. Clips follow each other without overlap, so this is a backward lookup."""
    return _with_clip(_placed(clips, instants, width), instants)


def _with_transitions(clips: DataFrame, whole: bool = False) -> DataFrame:
    """Places of the clips and their transitions; no other column is moved to the neighbours."""
    soft = lambda c: c.isNotNull() & (c["kind"] != "cut") & (c["duration"] > 0)
    sided = with_neighbours(clips if whole else clips.select(*PLACE), PROJECT, "pos", 1, 1, lambda w: {
        "_from": F.lag("clip_id").over(w), "_to": F.lead("clip_id").over(w), "_prev_end": F.lag(F.col("start") + F.col("duration")).over(w),
        "_next_start": F.lead("start").over(w), "_next_tr": F.lead("transition").over(w),
    }, whole=whole)
    return sided.withColumn("_in", F.when(soft(F.col("transition")) & (F.col("pos") > 0), F.col("transition"))).withColumn(
        "_out", F.when(soft(F.col("_next_tr")), F.col("_next_tr"))).drop("_next_tr")


def _placed(clips: DataFrame, instants: DataFrame, width: float, whole: bool = False) -> DataFrame:
    """Instants with the columns of their clip as ``_c_<column>``, null where no clip lies; columns of their own, so that
    those that nobody asks for are not moved."""
    found = _nearby_whole(clips, instants) if whole else _nearby(clips, instants, width)
    hit = lambda c: F.col(f"_h_{c}")
    covered = ((F.col("t") < hit("start") + hit("duration")) | hit("_to").isNull()) & ((F.col("t") >= hit("start")) | hit("_prev_end").isNull())
    return found.withColumn("_covered", covered).select(
        *instants.columns, *[F.when(F.col("_covered"), F.col(c)).alias(f"_c_{c[3:]}") for c in found.columns if c.startswith("_h_")])


def _nearby(clips: DataFrame, instants: DataFrame, width: float) -> DataFrame:
    """Instants with the last clip that has taken over by then, or else the first, as ``_h_<column>``."""
    # a clip takes over where the one before it ends, so rounding never leaves two candidates; the lookup moves
    # only places, and the clips join once their places are known
    sided = _with_transitions(clips)
    places = sided.select("project_id", F.coalesce("_prev_end", "start").alias("_from_t"), "pos")
    heads = places.groupBy("project_id").agg(F.min(F.struct("_from_t", "pos"))["pos"].alias("_head"))
    found = asof(instants, places, PROJECT, "t", ["pos"], width, right_at="_from_t").join(heads, "project_id")
    placed = found.select(*instants.columns, F.coalesce("prev_pos", "_head").alias("_pos"))
    rest = clips.drop(*[c for c in PLACE if c not in ("project_id", "pos")])
    every = sided.join(rest, ["project_id", "pos"])
    held = every.select(F.col("project_id").alias("_project"), *[F.col(c).alias(f"_h_{c}") for c in every.columns if c != "project_id"])
    return placed.join(held, (F.col("project_id") == F.col("_project")) & (F.col("_pos") == F.col("_h_pos")))


def _nearby_whole(clips: DataFrame, instants: DataFrame) -> DataFrame:
    """The same with one window over the clips and instants of a project."""
    sided = _with_transitions(clips, whole=True)
    names = [c for c in sided.columns if c != "project_id"]
    # each column in a struct of its own: a null in it is not looked past, and what nobody asks for is left out
    nothing = [F.lit(None).cast(sided.schema[c].dataType).alias(c) for c in names]
    right = sided.select("project_id", F.coalesce("_prev_end", "start").cast("double").alias("_t"), F.col("pos").alias("_at"), *[F.struct(c).alias(f"_h_{c}") for c in names])
    left = instants.select("project_id", F.col("t").cast("double").alias("_t"), F.struct(*[c for c in instants.columns if c != "project_id"]).alias("_l"),
                           *[F.when(F.lit(False), F.struct(n)).alias(f"_h_{c}") for c, n in zip(names, nothing)])
    both = right.unionByName(left, allowMissingColumns=True).filter("project_id IS NOT NULL")
    # at equal times the clip sorts first, so "at or before" includes it
    order = Window.partitionBy(*PROJECT).orderBy("_t", F.col("_at").isNull(), "_at")
    upto, every = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = {c: F.coalesce(F.last(f"_h_{c}", True).over(upto), F.first(f"_h_{c}", True).over(every)) for c in names}
    found = both.select("project_id", "_l", *[h.alias(f"_h_{c}") for c, h in held.items()]).filter("_l IS NOT NULL AND _h_pos IS NOT NULL")
    return found.select(*[F.col("project_id") if c == "project_id" else F.col(f"_l.{c}") for c in instants.columns], *[F.col(f"_h_{c}.{c}").alias(f"_h_{c}") for c in names])


def _with_clip(placed: DataFrame, instants: DataFrame, *more: str) -> DataFrame:
    columns = [c for c in placed.columns if c.startswith("_c_")]
    clip = F.when(F.col("_c_pos").isNotNull(), F.struct(*[F.col(c).alias(c[3:]) for c in columns]))
    return placed.select(*instants.columns, clip.alias("clip"), *more)


def transition_window(clips: DataFrame, instants: DataFrame, width: float = 60.0) -> DataFrame:
    """Transition under each instant: half of it before the boundary and half after."""
    return _with_clip(_transition_at(_placed(clips, instants, width)), instants, "stage")


def _transition_at(placed: DataFrame) -> DataFrame:
    """Add the transition step by step, so that no step is evaluated more than once per row."""
    t, c = F.col("t"), lambda name: F.col(f"_c_{name}")
    into, out = c("_in"), c("_out")
    in_start, out_start = c("start") - into["duration"] / 2, c("_next_start") - out["duration"] / 2
    entering = into.isNotNull() & (t >= in_start) & (t < c("start") + into["duration"] / 2)
    marked = placed.withColumn("_entering", F.coalesce(entering, F.lit(False)))
    marked = marked.withColumn("_leaving", ~F.col("_entering") & out.isNotNull() & (t >= out_start))
    progress = lambda start, seconds: g.clamp(F.try_divide(t - start, seconds), 0.0, 1.0)
    return marked.withColumn("stage", F.when(F.col("_entering"), F.struct(
        c("_from").alias("from_clip"), c("clip_id").alias("to_clip"), into["kind"].alias("kind"),
        into["direction"].alias("direction"), progress(in_start, into["duration"]).alias("progress"),
    )).when(F.col("_leaving"), F.struct(
        c("clip_id").alias("from_clip"), c("_to").alias("to_clip"), out["kind"].alias("kind"),
        out["direction"].alias("direction"), progress(out_start, out["duration"]).alias("progress"),
    ))).drop("_entering", "_leaving")


def clip_state(clips: DataFrame, instants: DataFrame, width: float = 60.0, whole: bool = False) -> DataFrame:
    """Crop, source time and transition of the clip under each instant."""
    c = lambda name: F.col(f"_c_{name}")
    rows = _transition_at(_placed(clips, instants, width, whole)).withColumn("_local", g.clamp(F.col("t") - c("start"), 0.0, c("duration")))
    # step by step, so that no step is evaluated more than once per row
    rows = rows.withColumn("_u", g.clamp(F.try_divide(F.col("_local"), c("duration")), 0.0, 1.0)).withColumn("_u", g.ease(c("easing"), F.col("_u")))
    rows = rows.withColumn("_crop", g.lerp(c("crop_start"), c("crop_end"), F.col("_u")))
    crop = F.when(c("fit") == "fit", g.full()).when(c("duration") > 0, g.clamp_inside(F.col("_crop"))).otherwise(c("crop_start"))
    return rows.select(
        *instants.columns, c("clip_id").alias("clip_id"), c("asset_id").alias("asset_id"),
        F.when(c("asset_id").isNotNull(), crop).alias("crop"),
        F.when(c("asset_id").isNotNull(), g.source_time(c("source_start"), c("speed"), F.col("_local"))).alias("source_t"),
        c("opacity").alias("opacity"), F.col("stage.kind").alias("transition"), F.col("stage.from_clip").alias("from_clip"),
        F.col("stage.to_clip").alias("to_clip"), F.col("stage.progress").alias("progress"),
    )


def overlay_state(overlays: DataFrame, instants: DataFrame, width: float = 1.0, whole: bool = False) -> DataFrame:
    """Overlays visible at each instant. ``overlays(project_id, overlay_id, asset_id, start, end, frame, opacity)``."""
    return active_at(instants, overlays, PROJECT, "t", "start", "end", width, whole)


def text_state(layers: DataFrame, instants: DataFrame, width: float = 1.0, whole: bool = False) -> DataFrame:
    """One row per visible word: opacity, vertical offset and scale.

    ``layers(project_id, layer_id, text, start, end, entry, exit, all_caps, word_starts)``.
    """
    shown = active_at(instants, layers, PROJECT, "t", "start", "end", width, whole)
    words = F.filter(txt.display_words(F.col("text"), F.col("all_caps")), lambda w: w != K.LINE_BREAK)
    counted = shown.withColumn("_words", words).withColumn("_n", F.size("_words"))
    starts = F.when(F.size("word_starts") == F.col("_n"), F.col("word_starts"))
    each = counted.withColumn("_starts", starts).select("*", F.posexplode("_words").alias("word_idx", "word"))
    each = each.withColumn("_local", F.col("t") - F.col("start")).withColumn("_left", F.col("end") - F.col("t")).withColumn("_at", F.get("_starts", F.col("word_idx")))
    state = txt.word_state(F.col("_local"), F.col("_left"), F.col("word_idx"), F.col("_n"), F.col("entry"), F.col("exit"), F.col("_at"))
    rows = each.drop("_words", "_starts").withColumn("state", state).drop("_n", "_local", "_left", "_at")
    # a layer's words at an instant; each is computed once
    of_layer = Window.partitionBy("project_id", "t", "layer_id")
    return rows.withColumn("_top", F.max("state.opacity").over(of_layer)).filter("_top > 0.001").drop("_top")


def timeline_state(clips: DataFrame, overlays: DataFrame, layers: DataFrame, instants: DataFrame, whole: bool = False) -> DataFrame:
    """Everything drawn at each instant, bottom to top, as one table of draw items."""
    c = clip_state(clips, instants, whole=whole).select(
        "project_id", "t", F.lit("clip").alias("layer"), F.col("clip_id").cast("string").alias("item"), "opacity",
        F.col("crop").alias("rect"), "transition", "progress")
    blank = [F.lit(None).cast("string").alias("transition"), F.lit(None).cast("double").alias("progress")]
    o = overlay_state(overlays, instants, whole=whole).select(
        "project_id", "t", F.lit("overlay").alias("layer"), F.col("overlay_id").cast("string").alias("item"), "opacity", F.col("frame").alias("rect"), *blank)
    x = text_state(layers, instants, whole=whole).select(
        "project_id", "t", F.lit("word").alias("layer"), F.concat_ws("/", F.col("layer_id").cast("string"), F.col("word_idx").cast("string")).alias("item"),
        F.col("state.opacity").alias("opacity"), F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("rect"), *blank)
    return c.unionByName(o).unionByName(x)


def adjacent_repeats(clips: DataFrame) -> DataFrame:
    """Clips that show the asset of the clip before them."""
    sided = with_neighbours(clips, PROJECT, "pos", 1, 0, lambda w: {"_prev": F.lag("asset_id").over(w)})
    return sided.filter(F.col("asset_id") == F.col("_prev")).drop("_prev")


def scene_durations(scenes: DataFrame, beats: DataFrame, fps: int = FPS, tolerance: float = 0.12) -> DataFrame:
    """Scene lengths after snapping boundaries to beats, frame-aligned, two frames at least.

    A boundary snaps unless that would come too close to the previous one, which itself may have
    snapped: a chain of yes/no decisions. Each boundary's answer for both cases is known at once,
    and composing such answers is a running parity since the last boundary that did not care.
    ``scenes(template_id, scene_idx, start, end)``, ``beats(template_id, t)``.
    """
    keys = ["template_id"]
    least = 2.0 / fps
    near = nearest(scenes.withColumnRenamed("start", "_start"), beats.select("template_id", F.col("t").alias("_beat")), keys, "end",
                   tolerance=tolerance, right_at="_beat")
    sided = with_neighbours(near, keys, "scene_idx", 1, 0, lambda w: {"_pe": F.lag("end").over(w), "_pn": F.lag("near_t").over(w)})
    plain = F.coalesce("_pe", "_start")
    if_plain = F.coalesce(F.col("near_t") > plain + least, F.lit(False))
    if_snapped = F.coalesce(F.col("near_t") > F.coalesce("_pn", plain) + least, F.lit(False))
    asked = sided.withColumn("_a", if_plain).withColumn("_b", if_snapped)
    fixed = (F.col("scene_idx") == 0) | (F.col("_a") == F.col("_b"))
    flips = running_sum(asked, keys, "scene_idx", {"_flips": F.when(F.col("_a") & ~F.col("_b") & ~fixed, 1).otherwise(0).cast("bigint")})
    anchor = F.when(fixed, F.struct("scene_idx", "_flips", "_a"))
    held = running_max(flips, keys, "scene_idx", anchor, "_anchor")
    odd = (F.col("_flips") - F.col("_anchor._flips")) % 2 == 1
    snapped = F.when(odd, ~F.col("_anchor._a")).otherwise(F.col("_anchor._a"))
    placed = held.withColumn("_at", F.when(snapped, F.col("near_t")).otherwise(F.col("end")))
    spans = with_neighbours(placed, keys, "scene_idx", 1, 0, lambda w: {"_from": F.coalesce(F.lag("_at").over(w), F.col("_start"))})
    seconds = F.greatest(F.lit(least), g.snap_to_frame(F.col("_at") - F.col("_from"), fps))
    return spans.select("template_id", "scene_idx", F.col("_at").alias("boundary"), seconds.alias("seconds"))


def retime_to_beats(clips: DataFrame, beats: DataFrame, fps: int = FPS, tolerance: float = 0.14) -> DataFrame:
    """Clip lengths with their ends moved onto beats, three frames at least, and how far they moved.

    A moved end is pushed out to keep the minimum after the end before it, so along a stretch of
    movable ends it is the largest of (beat minus its rank times the minimum): a running maximum.
    ``beats(project_id, t)``. Projects where nothing moves give no rows.
    """
    least = 3.0 / fps
    ended = clips.withColumn("_end", F.col("start") + F.col("duration"))
    near = nearest(ended, beats.select("project_id", F.col("t").alias("_beat")), PROJECT, "_end", tolerance=tolerance, right_at="_beat")
    sided = with_neighbours(near, PROJECT, "pos", 1, 0, lambda w: {"_pe": F.lag("_end").over(w), "_pm": F.lag("near_t").over(w).isNotNull(), "_first": F.lag("pos").over(w).isNull()})
    movable = F.col("near_t").isNotNull()
    # at the head of a stretch the end before is where it was
    head = movable & (F.col("_first") | ~F.col("_pm"))
    stretched = running_sum(sided.withColumn("_move", movable), PROJECT, "pos", {"_stretch": F.when(head | ~movable, 1).otherwise(0).cast("bigint")})
    before = F.coalesce("_pe", "start")
    level = F.when(F.col("_move"), F.when(F.col("_first") | ~F.col("_pm"), F.greatest(F.col("near_t"), before + least)).otherwise(F.col("near_t")) - F.col("pos") * least)
    lifted = running_max(stretched, PROJECT, "pos", F.struct("_stretch", F.coalesce(level, F.lit(float("-inf"))).alias("u")), "_top")
    placed = lifted.withColumn("_to", F.when(F.col("_move"), F.col("_top.u") + F.col("pos") * least).otherwise(F.col("_end")))
    shift = F.abs(F.col("_to") - F.col("_end"))
    spans = with_neighbours(placed.withColumn("_shift", shift), PROJECT, "pos", 1, 0, lambda w: {"_from": F.coalesce(F.lag("_to").over(w), F.col("start"))})
    stats = spans.groupBy("project_id").agg(F.count_if(F.col("_shift") > 0.001).alias("moved"), F.sum(F.when(F.col("_shift") > 0.001, F.col("_shift"))).alias("_sum"))
    seconds = F.greatest(F.lit(least), g.snap_to_frame(F.col("_to") - F.col("_from"), fps))
    out = spans.join(stats.filter("moved > 0"), "project_id").withColumn("new_duration", seconds)
    changed = F.abs(F.col("new_duration") - F.col("duration")) > 0.0005
    any_changed = out.filter(changed).select("project_id").distinct()
    return out.join(any_changed, "project_id", "left_semi").select(
        "project_id", "pos", "clip_id", "duration", F.when(changed, F.col("new_duration")).otherwise(F.col("duration")).alias("new_duration"),
        "moved", (F.col("_sum") / F.col("moved")).alias("mean_shift"))


def scratch_timeline(assets: DataFrame, seconds: float = 2.0, fps: int = FPS, volume: float = 0.0) -> DataFrame:
    """Even clips over a project's visuals in arrival order with alternating push in and out."""
    pool = positions(assets.filter(F.col("kind").isin("image", "video")), PROJECT, ["arrival"], F.expr("arrival div 4096"))
    video, even = F.col("kind") == "video", F.col("pos") % 2 == 0
    tight = g.scaled_full(0.88)
    length = F.when(video & (F.col("asset_seconds") > 0), F.least(F.col("asset_seconds"), F.lit(seconds * 2))).otherwise(F.lit(seconds))
    clips = pool.select(
        "project_id", "pos", F.concat(F.lit("scratch_"), (F.col("pos") + 1).cast("string")).alias("slot_id"), "asset_id",
        (F.col("pos") * seconds).alias("start"), length.alias("duration"),
        F.when(even, g.full()).otherwise(tight).alias("crop_start"), F.when(even, tight).otherwise(g.full()).alias("crop_end"),
        F.lit("easeInOut").alias("easing"), F.when(F.col("pos") > 0, "cut").alias("transition"),
        F.when(video, F.lit(volume)).otherwise(F.lit(0.0)).alias("volume"))
    return relayout(clips, fps)


def retarget_canvas(clips: DataFrame, assets: DataFrame, target_aspect: float) -> DataFrame:
    """New crops for another canvas aspect; a push in is kept down to .62.

    ``assets(project_id, asset_id, aspect, region)``. Clips without an asset are left out.
    """
    rows = clips.join(assets, ["project_id", "asset_id"])
    nothing = F.lit(None).cast("struct<x:double,y:double,w:double,h:double>")
    zoom = F.col("crop_end.w") / F.greatest(F.lit(0.01), F.col("crop_start.w"))
    framed = with_fill_window(rows, "new_start", F.col("aspect"), F.lit(target_aspect), F.col("region"), nothing, F.lit(0.0), F.lit("medium"), F.lit(0.0))
    sized = framed.withColumn("_zoom", zoom)
    tight = g.clamp_inside(g.scaled(F.col("new_start"), F.greatest(F.lit(0.62), F.least(F.lit(1.0), F.col("_zoom")))))
    return sized.select("project_id", "pos", "clip_id", "new_start", F.when(F.col("_zoom") < 1, tight).otherwise(F.col("new_start")).alias("new_end"))


def footage_shortfall(clips: DataFrame, assets: DataFrame) -> DataFrame:
    """Video clips that need more footage than their source has left."""
    need, left = F.col("duration") * F.col("speed"), F.col("asset_seconds") - F.col("source_start")
    rows = clips.join(assets.select("project_id", "asset_id", "kind", "asset_seconds"), ["project_id", "asset_id"])
    return rows.filter((F.col("kind") == "video") & (F.col("asset_seconds") > 0) & (need > left + 0.05)).select(
        "project_id", "pos", "clip_id", need.alias("needed"), left.alias("left"))


def variation(clips: DataFrame, kind: str) -> DataFrame:
    """Another treatment of the same edit: transitions, moves and looks change, timing does not.

    ``kind``: alternateTransitions, cinematic, punchy or minimal.
    """
    preset = {p[0]: p[1:] for p in K.PRESETS}[{"cinematic": "film", "punchy": "vivid"}.get(kind, "none")]
    none = F.lit(None).cast("struct<kind:string,duration:double,direction:string>")
    change = lambda name, seconds, direction=None: F.struct(
        F.lit(name).alias("kind"), (seconds if isinstance(seconds, Column) else F.lit(seconds)).cast("double").alias("duration"),
        F.lit(direction).cast("string").alias("direction"))
    pos = F.col("pos")
    if kind == "alternateTransitions":
        cycle = F.array(*[none if name is None else change(name, s, d) for name, s, d in K.TRANSITION_CYCLE])
        step = ((pos - 1) % len(K.TRANSITION_CYCLE)).cast("int")
        return clips.withColumn("transition", F.when(pos > 0, F.get(cycle, step)).otherwise(F.col("transition")))
    start, end = F.col("crop_start"), F.col("crop_end")
    base = F.when(start["w"] >= end["w"], start).otherwise(end)
    # the widest crop serves as the base, so a second application changes nothing
    sized = clips.withColumn("_base", base)
    tight = g.clamp_inside(g.scaled(F.col("_base"), 0.9 if kind == "cinematic" else 0.84))
    even = pos % 2 == 0
    if kind == "minimal":
        moved = sized.withColumn("crop_start", F.col("_base")).withColumn("crop_end", F.col("_base"))
    else:
        moved = sized.withColumn("_tight", tight).withColumn("crop_start", F.when(even, F.col("_base")).otherwise(F.col("_tight"))).withColumn(
            "crop_end", F.when(even, F.col("_tight")).otherwise(F.col("_base"))).drop("_tight")
    if kind == "cinematic":
        last = F.col("_last") == pos
        soft = change("dissolve", F.least(F.lit(0.6), F.greatest(F.lit(0.3), F.col("duration") * 0.35)))
        moved = with_entity(moved, PROJECT, F.max("pos").alias("_last")).withColumn(
            "transition", F.when(pos == 0, F.col("transition")).when(last, change("fadeToBlack", 0.6)).otherwise(soft)).drop("_last")
    else:
        moved = moved.withColumn("transition", F.when(pos == 0, F.col("transition")).otherwise(none))
    return moved.drop("_base").withColumn("grade", color.grade(*preset[:4])).withColumn("vignette", F.lit(preset[4])).withColumn("grain", F.lit(preset[5]))


def clamp_edits(edits: DataFrame, clips: DataFrame, assets: DataFrame, fps: int = FPS) -> DataFrame:
    """Bound requested clip trims by the footage left and a two-frame minimum.

    ``edits(project_id, edit_id, clip_id, edge, delta)`` with edge leading or trailing;
    ``assets(project_id, asset_id, kind, asset_seconds)``.
    """
    pool = assets.select("project_id", "asset_id", "kind", "asset_seconds")
    rows = edits.join(clips, ["project_id", "clip_id"]).join(pool, ["project_id", "asset_id"], "left")
    least = 2.0 / fps
    video = F.coalesce(F.col("kind") == "video", F.lit(False))
    speed = F.greatest(F.lit(0.01), F.col("speed"))
    wanted_end = F.col("start") + F.col("duration") + F.col("delta")
    limit = F.col("start") + (F.col("asset_seconds") - F.col("source_start")) / speed
    end = F.when(video, F.least(wanted_end, limit)).otherwise(wanted_end)
    trimmed = F.least(F.col("duration") - least, F.greatest(F.col("delta"), F.when(video, -F.col("source_start") / speed).otherwise(F.lit(0.0))))
    leading = F.col("edge") == "leading"
    duration = F.when(leading, F.col("duration") - trimmed).otherwise(F.greatest(F.lit(least), end - F.col("start")))
    source = F.when(leading, F.when(video, F.col("source_start") + trimmed * F.col("speed")).otherwise(F.lit(0.0))).otherwise(F.col("source_start"))
    asked = F.when(leading, F.col("duration") - F.col("delta")).otherwise(F.col("duration") + F.col("delta"))
    return rows.select("project_id", "edit_id", "clip_id", duration.alias("new_duration"), source.alias("new_source_start"),
                       (asked - duration).alias("rejected"))


def clamp_layer_moves(edits: DataFrame, layers: DataFrame, durations: DataFrame) -> DataFrame:
    """Bound text-layer moves and trims to the timeline and a .2 s minimum.

    ``edits(project_id, edit_id, layer_id, action, delta)`` with action move, leading or trailing;
    ``durations(project_id, timeline_seconds)``.
    """
    rows = edits.join(layers.select("project_id", "layer_id", "start", "end"), ["project_id", "layer_id"]).join(durations, "project_id")
    length = F.col("end") - F.col("start")
    moved = F.least(F.greatest(F.lit(0.0), F.col("start") + F.col("delta")), F.greatest(F.lit(0.0), F.col("timeline_seconds") - length))
    lead = F.least(F.greatest(F.lit(0.0), F.col("start") + F.col("delta")), F.col("end") - 0.2)
    trail = F.greatest(F.col("start") + 0.2, F.least(F.col("timeline_seconds") + 5, F.col("end") + F.col("delta")))
    a = F.col("action")
    return rows.select("project_id", "edit_id", "layer_id",
                       F.when(a == "move", moved).when(a == "leading", lead).otherwise(F.col("start")).alias("new_start"),
                       F.when(a == "move", moved + length).when(a == "leading", F.col("end")).otherwise(trail).alias("new_end"))


def clamp_audio_moves(edits: DataFrame, audio: DataFrame, assets: DataFrame) -> DataFrame:
    """Bound audio moves and trims to the source and a .2 s minimum.

    ``edits(project_id, edit_id, clip_id, action, delta)``; ``audio(project_id, clip_id, asset_id,
    start, duration, source_start)``; ``assets(project_id, asset_id, asset_seconds)``.
    """
    rows = edits.join(audio.select("project_id", "clip_id", "asset_id", "start", "duration", "source_start"), ["project_id", "clip_id"]).join(
        assets.select("project_id", "asset_id", "asset_seconds"), ["project_id", "asset_id"], "left")
    trim = F.least(F.col("duration") - 0.2, F.greatest(F.col("delta"), -F.col("source_start")))
    wanted = F.col("start") + F.col("duration") + F.col("delta")
    end = F.least(wanted, F.coalesce(F.col("start") + F.col("asset_seconds") - F.col("source_start"), wanted))
    a = F.col("action")
    return rows.select(
        "project_id", "edit_id", "clip_id",
        F.when(a == "move", F.greatest(F.lit(0.0), F.col("start") + F.col("delta"))).when(a == "leading", F.greatest(F.lit(0.0), F.col("start") + trim)).otherwise(F.col("start")).alias("new_start"),
        F.when(a == "leading", F.col("duration") - trim).when(a == "trailing", F.greatest(F.lit(0.2), end - F.col("start"))).otherwise(F.col("duration")).alias("new_duration"),
        F.when(a == "leading", F.col("source_start") + trim).otherwise(F.col("source_start")).alias("new_source_start"))


def caption_layers(segments: DataFrame, max_words: int = 5) -> DataFrame:
    """Caption layers of at most five words from transcript segments.

    ``segments(project_id, segment_id, text, start, end, word_starts, clip_start, clip_seconds,
    clip_source_start, timeline_seconds)``: times are in the source, the audio clip says where
    they fall on the timeline. Words without times are spread evenly.
    """
    shift = F.col("clip_source_start")
    start, end = F.col("start") - shift, F.col("end") - shift
    inside = segments.filter((end > 0) & (start < F.col("clip_seconds"))).withColumn("_s", F.greatest(F.lit(0.0), start)).withColumn(
        "_e", F.least(F.col("clip_seconds"), end))
    words = F.filter(F.split("text", " "), lambda w: w != "")
    counted = inside.withColumn("_words", words).withColumn("_n", F.size("_words")).filter("_n > 0")
    even = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.col("_s") + (F.col("_e") - F.col("_s")) * i / F.col("_n"))
    given = F.transform("word_starts", lambda w: w - F.col("clip_source_start"))
    timed = counted.withColumn("_starts", F.when(F.size("word_starts") == F.col("_n"), given).otherwise(even))
    chunks = timed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {max_words}").cast("int"))))
    first = (F.col("chunk") * max_words).cast("int")
    chunk_start = F.get("_starts", first)
    chunk_stop = F.coalesce(F.get("_starts", first + max_words), F.col("_e"))
    rows = chunks.withColumn("_cs", chunk_start).withColumn("layer_start", F.col("clip_start") + F.col("_cs")).withColumn(
        "layer_end", F.least(F.col("timeline_seconds"), F.col("clip_start") + F.greatest(chunk_stop, F.col("_cs") + 0.4)))
    return rows.filter(F.col("layer_end") > F.col("layer_start") + 0.05).select(
        "project_id", "segment_id", "chunk", F.concat_ws(" ", F.slice("_words", first + 1, max_words)).alias("text"),
        "layer_start", "layer_end", F.transform(F.slice("_starts", first + 1, max_words), lambda w: w - F.col("_cs")).alias("word_starts"))
