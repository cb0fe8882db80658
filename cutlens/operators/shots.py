"""Shot boundaries from per-frame metrics.

``frames(video_id, frame_idx, t, content_value, luma_mean, luma_std)`` with dense ``frame_idx``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlens.functions import color
from cutlens.functions import constants as K
from cutlens.operators.ordered import chain_members, islands, positions, running_sum, with_neighbours
from cutlens.session import cut_lineage

VIDEO = ["video_id"]
# Boundary clusters up to this size are folded as one array; longer ones take the join path.
CLUSTER_ROWS = 1024


@dataclass(frozen=True)
class ShotOptions:
    min_content: float = K.MIN_CONTENT_VALUE
    ratio: float = K.ADAPTIVE_RATIO
    rolling_rows: int = K.ROLLING_ROWS
    min_shot: float = K.MIN_SHOT_SECONDS
    gradual_min: float = K.GRADUAL_MIN_VALUE
    dissolve_residual: float = K.DISSOLVE_RESIDUAL
    flat_std: float = K.FLAT_LUMA_STD
    extreme_luma: float = K.FADE_EXTREME_LUMA
    max_gradual: float = K.MAX_GRADUAL_SECONDS
    endpoint_difference: float = K.GRADUAL_ENDPOINT_DIFFERENCE


def upper_median(value: str) -> Column:
    """Aggregate: element n/2 of the sorted values (the upper one of an even count).

    That is the lower median of the negated values. ``percentile_disc`` merges partial value
    counts, so no task ever holds a list of a group's rows.
    """
    return F.expr(f"-(percentile_disc(0.5) WITHIN GROUP (ORDER BY -({value})))")


def sample_frames(frames: DataFrame, stride: int = 1, start: float | None = None, end: float | None = None) -> DataFrame:
    """Every ``stride``-th decoded frame, optionally inside a time range; pushed to the scan."""
    kept = frames.filter(F.col("frame_idx") % stride == 0)
    if start is not None:
        kept = kept.filter(F.col("t") >= start)
    if end is not None:
        kept = kept.filter(F.col("t") <= end)
    return kept


def shot_sample_times(shots: DataFrame, n: int = 5) -> DataFrame:
    """``n`` evenly spaced instants per shot, inset a little from both ends."""
    inset = F.least(F.lit(0.08), (F.col("end") - F.col("start")) * 0.12)
    first = F.col("start") + inset
    last = F.greatest(first, F.col("end") - inset)
    step = (last - first) * F.col("sample") / max(1, n - 1)
    return shots.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("sample_t", first + step)


def content_difference(signatures: DataFrame, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """``content_value`` per frame: weighted mean HSV difference to the previous frame, first 0.

    ``signatures(video_id, frame_idx, hue, sat, val)`` with equally long planes.
    """
    planes = with_neighbours(
        signatures, VIDEO, "frame_idx", 1, 0,
        lambda w: {f"_{p}": F.lag(p).over(w) for p in ("hue", "sat", "val")},
    )
    wh, ws, wv = weights
    value = (
        wh * color.mean_hue_distance(F.col("hue"), F.col("_hue"))
        + ws * color.mean_abs_difference(F.col("sat"), F.col("_sat"))
        + wv * color.mean_abs_difference(F.col("val"), F.col("_val"))
    ) / (wh + ws + wv)
    comparable = F.size("hue") == F.size("_hue")
    return planes.withColumn("content_value", F.when(comparable, value).otherwise(F.lit(0.0))).drop("_hue", "_sat", "_val")


def mark_cuts(frames: DataFrame, options: ShotOptions = ShotOptions()) -> DataFrame:
    """Add ``rolling`` (mean of the neighbours, the frame itself excluded), ``ratio`` and ``is_cut``."""
    k = options.rolling_rows

    def around(w):
        back, ahead = w.rowsBetween(-k, -1), w.rowsBetween(1, k)
        count = F.count("content_value").over(back) + F.count("content_value").over(ahead)
        total = F.coalesce(F.sum("content_value").over(back), F.lit(0.0)) + F.coalesce(
            F.sum("content_value").over(ahead), F.lit(0.0)
        )
        neighbour = F.struct("luma_std", "frame_idx", "luma_mean", "t")
        return {
            "rolling": F.coalesce(F.try_divide(total, count), F.lit(0.0)),
            "_prev": F.lag(neighbour).over(w),
            "_next": F.lead(neighbour).over(w),
        }

    rolled = with_neighbours(frames, VIDEO, "frame_idx", k, k, around)
    ratio = F.try_divide(F.col("content_value"), F.col("rolling"))
    hit = (F.col("content_value") >= options.min_content) & (F.col("rolling") > 1e-6) & (ratio >= options.ratio)
    return rolled.withColumn("ratio", ratio).withColumn("is_cut", F.coalesce(hit, F.lit(False)))


def detect_cuts(frames: DataFrame, options: ShotOptions = ShotOptions()) -> DataFrame:
    return _cuts(mark_cuts(frames, options), options)


def _cuts(marked: DataFrame, options: ShotOptions) -> DataFrame:
    return marked.filter("is_cut").select(
        "video_id", "frame_idx", F.lit("cut").alias("kind"), "t", F.lit(0.0).alias("duration"),
        F.least(F.lit(0.98), 0.62 + (F.col("ratio") - options.ratio) / 8).alias("confidence"),
        F.format_string("frame delta %.3f, %.1fx rolling average %.3f", "content_value", "ratio", "rolling").alias("basis"),
    )


def elevated_runs(frames: DataFrame, options: ShotOptions = ShotOptions()) -> DataFrame:
    """Unbroken runs of raised, non-cut frames with what the gradual tests need from them."""
    return _runs(mark_cuts(frames, options), options)


def _runs(marked: DataFrame, options: ShotOptions) -> DataFrame:
    member = (F.col("content_value") >= options.gradual_min) & ~F.col("is_cut") & (F.col("frame_idx") >= 1)
    here = F.struct("luma_std", "frame_idx", "luma_mean", "t")
    rows = islands(marked, VIDEO, "frame_idx", member)
    # the window is one frame wider than the run on both sides where frames exist
    flattest = F.least(here, F.coalesce("_prev", here), F.coalesce("_next", here))
    return rows.groupBy("video_id", "run").agg(
        F.min("frame_idx").alias("first_idx"),
        F.max("frame_idx").alias("last_idx"),
        F.count(F.lit(1)).alias("n_frames"),
        F.min(F.coalesce("_prev", here)["frame_idx"]).alias("start_idx"),
        F.max(F.coalesce("_next", here)["frame_idx"]).alias("end_idx"),
        F.min(F.coalesce("_prev", here)["t"]).alias("start_t"),
        F.max(F.coalesce("_next", here)["t"]).alias("end_t"),
        F.min(flattest).alias("flat"),
    )


def detect_gradual(frames: DataFrame, thumbs: DataFrame, options: ShotOptions = ShotOptions()) -> DataFrame:
    """Fades and dissolves. ``thumbs(video_id, frame_idx, thumb)`` are equally sized luma arrays."""
    return _gradual(cut_lineage(mark_cuts(frames, options)), thumbs, options)


def _gradual(marked: DataFrame, thumbs: DataFrame, options: ShotOptions) -> DataFrame:
    long_enough = marked.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 6").select("video_id")
    seconds = F.col("end_t") - F.col("start_t")
    runs = (
        _runs(marked, options)
        .join(long_enough, "video_id", "left_semi")
        .filter((F.col("n_frames") >= 3) & (seconds <= options.max_gradual))
        .withColumn("seconds", seconds)
    )
    flat = F.col("flat")
    dark = flat["luma_mean"] < 0.5
    extreme = (flat["luma_mean"] <= options.extreme_luma) | (flat["luma_mean"] >= 1 - options.extreme_luma)
    fading_in = flat["frame_idx"] <= F.expr("(start_idx + end_idx) div 2")
    is_fade = (flat["luma_std"] < options.flat_std) & extreme
    fades = runs.filter(is_fade).select(
        "video_id", F.col("first_idx").alias("frame_idx"),
        F.when(dark, F.when(fading_in, "fadeFromBlack").otherwise("fadeToBlack"))
        .otherwise(F.when(fading_in, "fadeFromWhite").otherwise("fadeToWhite")).alias("kind"),
        F.when(fading_in, F.col("end_t")).otherwise(F.col("start_t")).alias("t"),
        F.col("seconds").alias("duration"),
        F.least(F.lit(0.92), 0.60 + (options.flat_std - flat["luma_std"]) * 6).alias("confidence"),
        F.format_string("luma std dev fell to %.3f over %d frames, mean %.2f", flat["luma_std"], "n_frames", flat["luma_mean"]).alias("basis"),
    )
    # One pass over the thumbnails: a run lasts at most max_gradual seconds, so the pictures it
    # needs, both ends included, are a short list. Without both ends there is nothing to blend.
    wanted = runs.filter(~is_fade).withColumn("frame_idx", F.explode(F.sequence("start_idx", "end_idx")))
    pictures = (
        wanted.join(thumbs.select("video_id", "frame_idx", "thumb"), ["video_id", "frame_idx"])
        .groupBy("video_id", "run")
        .agg(F.sort_array(F.collect_list(F.struct("frame_idx", "thumb"))).alias("pics"),
             *[F.first(c).alias(c) for c in ("first_idx", "start_idx", "end_idx", "end_t", "seconds", "n_frames")])
        .filter((F.get("pics", F.lit(0))["frame_idx"] == F.col("start_idx")) & (F.element_at("pics", -1)["frame_idx"] == F.col("end_idx")))
        .withColumn("_a", F.get("pics", F.lit(0))["thumb"]).withColumn("_b", F.element_at("pics", -1)["thumb"])
        .filter(color.mean_abs_difference(F.col("_a"), F.col("_b")) >= options.endpoint_difference)
    )
    inner = F.slice("pics", F.lit(2), F.size("pics") - 2)
    weight = lambda p: (p["frame_idx"] - F.col("start_idx")) / (F.col("end_idx") - F.col("start_idx"))
    residual = F.transform(inner, lambda p: color.blend_residual(p["thumb"], F.col("_a"), F.col("_b"), weight(p)))
    # exploded, as a filter over the column would evaluate it a second time
    small = F.filter(F.array(color.array_mean(residual)), lambda r: r <= options.dissolve_residual)
    residuals = pictures.withColumn("residual", F.explode(small))
    dissolves = residuals.select(
        "video_id", F.col("first_idx").alias("frame_idx"), F.lit("dissolve").alias("kind"), F.col("end_t").alias("t"),
        F.col("seconds").alias("duration"),
        F.least(F.lit(0.94), 0.58 + (options.dissolve_residual - F.col("residual")) * 12).alias("confidence"),
        F.format_string("blend residual %.3f over %d frames", "residual", "n_frames").alias("basis"),
    )
    return fades.unionByName(dissolves)


def candidate_boundaries(frames: DataFrame, thumbs: DataFrame | None = None, options: ShotOptions = ShotOptions()) -> DataFrame:
    """Start, cuts and gradual transitions of every video, before merging."""
    # measured once, read by the start, cut and gradual branches
    marked = cut_lineage(mark_cuts(frames, options))
    counted = marked.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    starts = counted.select(
        "video_id", F.lit(-1).cast("bigint").alias("frame_idx"), F.lit("start").alias("kind"), F.lit(0.0).alias("t"),
        F.lit(0.0).alias("duration"), F.lit(1.0).alias("confidence"), F.lit("start of reference").alias("basis"),
    )
    found = _cuts(marked, options)
    if thumbs is not None:
        found = found.unionByName(_gradual(marked, thumbs, options))
    measurable = counted.filter("_n > 2").select("video_id")
    return starts.unionByName(found.join(measurable, "video_id", "left_semi"))


def merge_boundaries(boundaries: DataFrame, durations: DataFrame, min_shot: float = K.MIN_SHOT_SECONDS) -> DataFrame:
    """Drop the weaker of two boundaries closer than ``min_shot`` and any that leaves a runt tail.

    What is kept depends on the last kept boundary, but a gap of ``min_shot`` always restarts the
    decision, so clusters between such gaps are independent and are folded in parallel.
    ``durations(video_id, video_seconds)``.
    """
    rank = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "cut", 1).otherwise(2)
    ordered = positions(
        cut_lineage(boundaries.withColumn("_rank", rank)), VIDEO, ["t", "_rank", "frame_idx"], F.floor(F.col("t") / 600.0)
    ).drop("_rank")
    gapped = with_neighbours(ordered, VIDEO, "pos", 1, 0, lambda w: {"_gap": F.col("t") - F.lag("t").over(w)})
    clustered = running_sum(
        gapped, VIDEO, "pos", {"cluster": F.when(F.coalesce(F.col("_gap") >= min_shot, F.lit(True)), 1).otherwise(0)}
    ).drop("_gap")
    clustered = cut_lineage(clustered)
    sizes = clustered.groupBy("video_id", "cluster").agg(F.count(F.lit(1)).alias("_size"))
    long = sizes.filter(F.col("_size") > CLUSTER_ROWS).select("video_id", "cluster")
    short_rows, kept_long = clustered, None
    if not long.isEmpty():
        short_rows = clustered.join(long, ["video_id", "cluster"], "left_anti")
        kept_long = _merge_long(clustered.join(long, ["video_id", "cluster"], "left_semi"), min_shot)
    item = F.struct("pos", "t", "confidence", "kind", "duration", "basis", "frame_idx")
    kept = (
        short_rows.groupBy("video_id", "cluster")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .select("video_id", F.explode(_fold_cluster(F.col("items"), min_shot)).alias("b"))
        .select("video_id", "b.*")
    )
    if kept_long is not None:
        kept = kept.unionByName(kept_long)
    return (
        kept.join(durations, "video_id")
        .filter((F.col("kind") == "start") | (F.col("video_seconds") - F.col("t") >= min_shot))
        .drop("pos", "video_seconds")
    )


def _fold_cluster(items: Column, min_shot: float) -> Column:
    def step(kept, b):
        last = F.element_at(kept, -1)
        stronger = (b["confidence"] > last["confidence"]) & (last["kind"] != "start")
        return (
            F.when(b["t"] - last["t"] >= min_shot, F.concat(kept, F.array(b)))
            .when(stronger, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(b)))
            .otherwise(kept)
        )

    return F.aggregate(F.slice(items, 2, F.size(items)), F.slice(items, 1, 1), step)


def _merge_long(rows: DataFrame, min_shot: float) -> DataFrame:
    """The same decision for clusters of any length. While boundary b is the last kept one, the
    next boundary that changes it is its successor; the kept ones lie on the chain of successors
    from the cluster's head and are left by a gap, not by a stronger neighbour."""
    keys = ["video_id", "cluster"]
    right = rows.select(*keys, F.col("pos").alias("_pos"), F.col("t").alias("_t"), F.col("confidence").alias("_c"),
                        F.floor(F.col("t") / min_shot).alias("_cell"))
    left = rows.withColumn("_cell", F.explode(F.transform(F.array(*[F.lit(i) for i in range(4)]),
                                                          lambda i: F.floor(F.col("t") / min_shot) + i)))
    far = F.col("_t") - F.col("t") >= min_shot
    changes = (F.col("_pos") > F.col("pos")) & (far | ((F.col("_c") > F.col("confidence")) & (F.col("kind") != "start")))
    nexts = (
        left.join(right, [*keys, "_cell"]).filter(changes)
        .groupBy(*keys, "pos").agg(F.min(F.struct(F.col("_pos").alias("next"), far.alias("far"))).alias("s"))
    )
    linked = cut_lineage(rows.join(nexts, [*keys, "pos"], "left"))
    heads = linked.groupBy(*keys).agg(F.min("pos").alias("node"))
    links = linked.select(*keys, F.col("pos").alias("node"), F.col("s.next").alias("next"))
    on_chain = chain_members(links, heads, keys).withColumnRenamed("node", "pos")
    return (
        linked.join(on_chain, [*keys, "pos"], "left_semi").filter("s IS NULL OR s.far")
        .select("video_id", "pos", "t", "confidence", "kind", "duration", "basis", "frame_idx")
    )


def shots_of(boundaries: DataFrame, durations: DataFrame) -> DataFrame:
    """Shot table: each boundary opens a shot that lasts until the next one or the end."""
    ranked = positions(boundaries, VIDEO, ["t", "frame_idx"], F.floor(F.col("t") / 600.0), out="shot_idx")
    ahead = with_neighbours(ranked, VIDEO, "shot_idx", 0, 1, lambda w: {"_next": F.lead("t").over(w)})
    return ahead.join(durations, "video_id").select(
        "video_id", "shot_idx", F.col("t").alias("start"), F.coalesce("_next", "video_seconds").alias("end"),
        "kind", F.col("duration").alias("boundary_seconds"), "confidence", "basis",
    )


def detect_shots(frames: DataFrame, thumbs: DataFrame | None, durations: DataFrame, options: ShotOptions = ShotOptions()) -> DataFrame:
    found = candidate_boundaries(frames, thumbs, options)
    return shots_of(merge_boundaries(found, durations, options.min_shot), durations)
