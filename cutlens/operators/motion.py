"""Camera motion from flow vectors and subject regions from salient boxes.

``flow(video_id, shot_idx, pair, point_id, sx, sy, tx, ty)``; y is in units of the frame width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlens.functions.geometry import clamp_inside, rect, scaled, union
from cutlens.operators.ordered import positions
from cutlens.session import cut_lineage

PAIR = ["video_id", "shot_idx", "pair"]
MIN_POINTS = 8
POINT = ("point_id", "sx", "sy", "tx", "ty")


def steady_vectors(flow: DataFrame, aspect: float = 1.0) -> DataFrame:
    """Finite vectors shorter than a third of the frame whose source lies inside the 10 % margin."""
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    inside = F.col("sx").between(0.1, 0.9) & F.col("sy").between(0.1 * aspect, 0.9 * aspect)
    return flow.filter(~F.isnan(dx) & ~F.isnan(dy) & (F.abs(dx) < 1 / 3) & (F.abs(dy) < aspect / 3) & inside)


def flow_gate(flow: DataFrame, aspect: float = 1.0) -> DataFrame:
    """Steady vectors of the pairs that have at least eight of them. ``aspect`` is height over width."""
    gated = steady_vectors(flow, aspect)
    enough = gated.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_n")).filter(f"_n >= {MIN_POINTS}").select(*PAIR)
    return gated.join(enough, PAIR, "left_semi")


def _sums() -> dict[str, Column]:
    return {
        "n": F.count(F.lit(1)),
        **{f"_{c}": F.sum(c) for c in ("sx", "sy", "tx", "ty")},
        "_dot": F.sum(F.col("sx") * F.col("tx") + F.col("sy") * F.col("ty")),
        "_cross": F.sum(F.col("sx") * F.col("ty") - F.col("sy") * F.col("tx")),
        "_ss": F.sum(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")),
    }


def _solve(points: DataFrame) -> DataFrame:
    """Closed-form scale, rotation and translation from sums that combine map-side."""
    return _fit(points.groupBy(*PAIR).agg(*[c.alias(name) for name, c in _sums().items()]))


def _solve_beside(points: DataFrame) -> DataFrame:
    """The same beside every point of a pair, for pairs that a task holds whole."""
    pair = Window.partitionBy(*PAIR)
    return _fit(points.select("*", *[c.over(pair).alias(name) for name, c in _sums().items()]), POINT)


def _fit(sums: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    n = F.col("n")
    mean = {c: F.col(f"_{c}") / n for c in ("sx", "sy", "tx", "ty")}
    a = F.col("_dot") - n * (mean["sx"] * mean["tx"] + mean["sy"] * mean["ty"])
    b = F.col("_cross") - n * (mean["sx"] * mean["ty"] - mean["sy"] * mean["tx"])
    spread = F.col("_ss") - n * (mean["sx"] * mean["sx"] + mean["sy"] * mean["sy"])
    solved = sums.withColumn("_a", a).withColumn("_b", b).withColumn("_v", spread)
    good = (n >= 3) & (F.col("_v") > 1e-9)
    solved = solved.withColumn("rot", F.when(good, F.atan2("_b", "_a")).otherwise(F.lit(0.0))).withColumn(
        "scale", F.when(good, F.try_divide(F.sqrt(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")), F.col("_v"))).otherwise(F.lit(1.0))
    )
    cos, sin = F.cos("rot"), F.sin("rot")
    return solved.select(
        *PAIR, *kept, "scale", "rot",
        F.when(good, mean["tx"] - F.col("scale") * (cos * mean["sx"] - sin * mean["sy"])).otherwise(F.lit(0.0)).alias("dx"),
        F.when(good, mean["ty"] - F.col("scale") * (sin * mean["sx"] + cos * mean["sy"])).otherwise(F.lit(0.0)).alias("dy"),
        F.when(good, n).otherwise(F.lit(0)).cast("bigint").alias("n"),
    )


def _moved(x, y) -> tuple[Column, Column]:
    cos, sin = F.cos("rot"), F.sin("rot")
    return F.col("scale") * (cos * x - sin * y) + F.col("dx"), F.col("scale") * (sin * x + cos * y) + F.col("dy")


def _error() -> Column:
    px, py = _moved(F.col("sx"), F.col("sy"))
    ex, ey = px - F.col("tx"), py - F.col("ty")
    return F.sqrt(ex * ex + ey * ey)


def _errors(points: DataFrame, fits: DataFrame) -> DataFrame:
    return points.join(fits, PAIR).withColumn("error", _error())


def similarity_fit(points: DataFrame, keep: float = 0.8, min_points: int = 3, whole: bool = False) -> DataFrame:
    """Fit, drop the worst fifth, refit. One row per pair with at least ``min_points`` points;
    with steady vectors and 8 this includes the gate without another pass.

    ``whole``: no pair has more points than a slice has rows, so each is taken as one; points that come hashed by
    shot are not shuffled again.
    """
    if whole:
        known = points.filter(" AND ".join(f"{c} IS NOT NULL" for c in PAIR)).select(*PAIR, *POINT)
        fits = _solve_beside(known).filter(F.col("n") >= max(3, min_points)).withColumn("error", _error())
        ranked = positions(fits, PAIR, ["error", "point_id"], F.floor(F.col("error") * 64), out="_pos", whole=True)
        trimmed = ranked.filter(F.col("_pos") < F.greatest(F.lit(3), F.floor(F.col("n") * keep))).select(*PAIR, *POINT)
        return _solve_beside(trimmed).groupBy(*PAIR).agg(
            *[F.first(c).alias(c) for c in ("scale", "rot", "dx", "dy", "n")], F.avg(_error()).alias("residual"))
    first = _solve(points).filter(F.col("n") >= max(3, min_points))
    scored = cut_lineage(
        _errors(points, first.withColumn("keep_rows", F.greatest(F.lit(3), F.floor(F.col("n") * keep))))
        .select(*PAIR, "point_id", "sx", "sy", "tx", "ty", "error", "keep_rows"))
    ranked = positions(scored, PAIR, ["error", "point_id"], F.floor(F.col("error") * 64), out="_pos")
    trimmed = ranked.filter(F.col("_pos") < F.col("keep_rows")).select(*PAIR, "sx", "sy", "tx", "ty")
    second = _solve(trimmed)
    residuals = _errors(trimmed, second).groupBy(*PAIR).agg(F.avg("error").alias("residual"))
    return second.join(residuals, PAIR)


def compose_motion(fits: DataFrame, aspect: float = 1.0) -> DataFrame:
    """One motion per shot: scales multiply, the rest adds up, measured at the frame centre."""
    mx, my = _moved(F.lit(0.5), F.lit(0.5 * aspect))
    centred = fits.withColumn("_tx", mx - 0.5).withColumn("_ty", my - 0.5 * aspect)
    return centred.groupBy("video_id", "shot_idx").agg(
        F.product("scale").alias("scale"), F.sum("_tx").alias("tx"), F.sum("_ty").alias("ty"),
        F.sum("rot").alias("rot"), F.avg("residual").alias("residual"), F.count(F.lit(1)).cast("int").alias("n"),
    )


def subject_region(boxes: DataFrame, group: list[str], frame: list[str]) -> DataFrame:
    """Union of the boxes of each frame, averaged over the frames of a group, inside the frame.

    ``boxes(*group, *frame, x, y, w, h)``.
    """
    per_frame = boxes.groupBy(*group, *frame).agg(
        F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"),
    )
    mean = per_frame.groupBy(*group).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"),
        F.avg(F.col("_r") - F.col("x")).alias("w"), F.avg(F.col("_b") - F.col("y")).alias("h"),
    )
    return mean.select(*group, clamp_inside(rect(*[F.col(c) for c in "xywh"])).alias("region"))


def asset_subject(salient: DataFrame, faces: DataFrame, keys: list[str]) -> DataFrame:
    """Subject of an asset: salient boxes united with the face box grown by 1.4."""
    def box(df: DataFrame, name: str) -> DataFrame:
        u = df.groupBy(*keys).agg(
            F.min("x").alias("x"), F.min("y").alias("y"),
            F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"),
            F.count(F.lit(1)).alias(f"{name}_count"),
        )
        return u.select(*keys, rect(F.col("x"), F.col("y"), F.col("_r") - F.col("x"), F.col("_b") - F.col("y")).alias(name), f"{name}_count")

    both = box(salient, "salient").join(box(faces, "face"), keys, "full_outer")
    padded = clamp_inside(scaled(F.col("face"), 1.4))
    region = F.when(F.col("face").isNull(), F.col("salient")).when(F.col("salient").isNull(), padded).otherwise(union(F.col("salient"), padded))
    return both.select(*keys, region.alias("region"), F.coalesce("face_count", F.lit(0)).alias("face_count"))
