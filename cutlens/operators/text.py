"""On-screen text: grouping OCR hits into tracks and rejecting watermarks.

``hits(video_id, hit_id, t, text, confidence, frame)`` with ``frame`` a rectangle struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutlens.functions import constants as K
from cutlens.functions import text as txt
from cutlens.functions.geometry import iou, rect
from cutlens.operators.ordered import chain_roots, positions, running_sum, with_neighbours
from cutlens.operators.shots import upper_median
from cutlens.session import cut_lineage

VIDEO = ["video_id"]


def ocr_gate(hits: DataFrame) -> DataFrame:
    """Readable hits only, trimmed."""
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    return hits.filter(F.col("confidence") >= K.MIN_TEXT_CONFIDENCE).withColumn("text", trimmed).filter("text <> ''")


def sessions(hits: DataFrame, gap: float = K.TEXT_GAP_SECONDS) -> DataFrame:
    """Number the stretches of a video without a silence longer than ``gap``. Nothing can be
    matched across such a silence, so sessions are independent."""
    ordered = positions(hits, VIDEO, ["t", "hit_id"], F.floor(F.col("t") / 60.0))
    gapped = with_neighbours(ordered, VIDEO, "pos", 1, 0, lambda w: {"_gap": F.col("t") - F.lag("t").over(w)})
    return running_sum(
        gapped, VIDEO, "pos", {"session": F.when(F.coalesce(F.col("_gap") > gap, F.lit(True)), 1).otherwise(0)}
    ).drop("_gap")


def best_predecessors(hits: DataFrame, gap: float = K.TEXT_GAP_SECONDS, grid: int = 8) -> DataFrame:
    """``(video_id, pos, parent, score)``: for each hit the earlier one, at most ``gap`` seconds before it, that it goes on.

    A hit goes on another if their boxes overlap by more than .35 and their words by more than .55, or one text grows
    out of the other; the best score wins, then the later one. Boxes that overlap share the corner of their overlap, so
    hits meet in cells of time and of a ``grid`` over the frame, and only in the cell that holds that corner.
    """
    at = lambda v: F.least(F.greatest(F.floor(v * grid), F.lit(0)), F.lit(grid - 1))
    cells = lambda lo, size: F.explode(F.sequence(at(F.col(lo)), F.greatest(at(F.col(lo)), at(F.col(lo) + F.col(size)))))
    boxed = hits.select("video_id", "pos", "t", "text", "frame", *[F.col(f"frame.{c}").alias(f"_{c}") for c in "xywh"])
    spread = boxed.withColumn("_cx", cells("_x", "_w")).withColumn("_cy", cells("_y", "_h")).drop("_w", "_h")
    slot = F.floor(F.col("t") / gap)
    earlier = spread.withColumn("_ct", slot).select("video_id", "_ct", "_cx", "_cy", *[F.col(c).alias(f"a{c}") for c in ("pos", "t", "text", "frame", "_x", "_y")])
    later = spread.withColumn("_ct", F.explode(F.array(slot, slot - 1)))
    met = later.join(earlier, ["video_id", "_ct", "_cx", "_cy"]).filter((F.col("apos") < F.col("pos")) & (F.col("t") - F.col("at") <= gap))
    once = met.filter((at(F.greatest("_x", "a_x")) == F.col("_cx")) & (at(F.greatest("_y", "a_y")) == F.col("_cy")))
    shared, alike, growing = iou(F.col("aframe"), F.col("frame")), txt.token_jaccard(F.col("atext"), F.col("text")), txt.is_growing(F.col("atext"), F.col("text"))
    scored = once.select("video_id", "pos", "apos", shared.alias("shared"), alike.alias("alike"), growing.alias("growing")).filter("shared > 0.35 AND (alike > 0.55 OR growing)")
    score = txt.match_score(F.col("shared"), F.col("alike"), F.col("growing"))
    return scored.groupBy("video_id", "pos").agg(F.max_by("apos", F.struct(score, "apos")).alias("parent"), F.max(score).alias("score"))


def link_hits(hits: DataFrame, gap: float = K.TEXT_GAP_SECONDS) -> DataFrame:
    """Hits with ``pos`` (their place in the video) and ``track``, the position of the first hit of their track: the root
    of the chain of best predecessors, found by jumping over predecessors, so in a number of rounds that grows with the
    logarithm of the longest track.

    A hit is compared with single earlier hits, not with all that a track has shown so far. So a text that is cut short
    for a moment goes on from the short form, and two hits may go on one.
    """
    ordered = cut_lineage(positions(hits, VIDEO, ["t", "hit_id"], F.floor(F.col("t") / 60.0)))
    parents = best_predecessors(ordered, gap)
    links = ordered.select("video_id", F.col("pos").alias("node")).join(parents.select("video_id", F.col("pos").alias("node"), "parent"), ["video_id", "node"], "left")
    roots = chain_roots(links, VIDEO).select("video_id", F.col("node").alias("pos"), F.col("root").alias("track"))
    return ordered.join(roots, ["video_id", "pos"])


def text_tracks(hits: DataFrame, durations: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """Text tracks with median rectangle, longest text, entry growth and the watermark verdict.

    ``durations(video_id, video_seconds)``; ``colors(video_id, hit_id, color_hex)`` optionally
    gives the text colour measured at a hit, of which a track takes that of its first.
    """
    linked = link_hits(ocr_gate(hits))
    keys = ["video_id", "track"]
    longest = F.max_by("text", F.struct(F.length("text"), -F.col("pos")))
    tracks = linked.groupBy(*keys).agg(
        longest.alias("text"), F.min("t").alias("start"), F.max("t").alias("last_t"), F.avg("confidence").alias("mean_confidence"),
        F.count(F.lit(1)).alias("observations"), F.min_by("hit_id", "pos").alias("first_hit"),
        *[upper_median(f"frame.{c}").alias(c) for c in "xywh"],
    ).filter(F.col("observations") >= K.MIN_TEXT_OBSERVATIONS)
    grown = width_growth(linked.select(*keys, "pos", F.col("frame.w").alias("width")))
    frame = rect(*[F.col(c) for c in "xywh"])
    seconds = F.col("video_seconds")
    out = tracks.join(grown, keys).join(durations, "video_id").withColumn("frame", frame)
    if colors is None:
        out = out.withColumn("color_hex", F.lit("#FFFFFF"))
    else:
        out = out.join(colors.withColumnRenamed("hit_id", "first_hit"), ["video_id", "first_hit"], "left").withColumn(
            "color_hex", F.coalesce("color_hex", F.lit("#FFFFFF")))
    coverage = (F.col("last_t") - F.col("start")) / F.greatest(seconds, F.lit(0.001))
    return out.select(
        *keys, "text", "start", F.least(seconds, F.col("last_t") + 0.1).alias("end"), "frame", "mean_confidence",
        F.col("h").alias("size_ratio"), "color_hex", txt.is_watermark(F.col("text"), F.col("frame"), coverage).alias("is_watermark"),
        "observations", "growth",
    )


def width_growth(rows: DataFrame, first: int = 6, factor: float = 1.08) -> DataFrame:
    """How often the width grew by more than 8 % within a track's first observations."""
    order = Window.partitionBy("video_id", "track").orderBy("pos")
    early = rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= first)
    grew = F.col("width") > F.lag("width").over(order) * factor
    return early.withColumn("_g", F.coalesce(grew, F.lit(False))).groupBy("video_id", "track").agg(F.count_if("_g").alias("growth"))


def usable_text(tracks: DataFrame) -> DataFrame:
    """Tracks without watermarks, each with its video's number of rejected ones."""
    dropped = tracks.groupBy("video_id").agg(F.count_if("is_watermark").alias("dropped"))
    return tracks.filter("NOT is_watermark").join(dropped, "video_id")
