"""Music structure and music-driven edit plans.

``energy(track_id, i, rms)`` with dense ``i``; ``beats(track_id, t, is_downbeat)``;
``tracks(track_id, track_seconds)``.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutlens.functions import constants as K
from cutlens.functions import labels
from cutlens.functions.geometry import full, scaled_full
from cutlens.operators.ordered import asof, running_sum, with_entity, with_neighbours
from cutlens.session import cut_lineage

TRACK = ["track_id"]


@dataclass(frozen=True)
class PlanOptions:
    max_seconds: float = 30.0
    asset_count: int = 8
    intensity: float = 0.5
    min_shot: float = 0.4


def trailing_average(energy: DataFrame, k: int) -> DataFrame:
    """Mean of the last ``k`` values; a track of at most ``k`` values is left as it is."""
    counted = with_entity(energy, TRACK, F.count(F.lit(1)).alias("_n"))
    rolled = with_neighbours(counted, TRACK, "i", k - 1, 0, lambda w: {"_mean": F.avg("rms").over(w.rowsBetween(-(k - 1), 0))})
    smooth = F.when((F.lit(k) > 1) & (F.col("_n") > k), F.col("_mean")).otherwise(F.col("rms"))
    return rolled.withColumn("smooth", smooth).drop("_mean", "_n")


def slope_by(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope per group, 0 for fewer than two points."""
    return rows.groupBy(*keys).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _absorb(bands: pd.Series, sizes: pd.Series, left: pd.Series, right: pd.Series, min_run: pd.Series) -> pd.Series:
    """Bands of a stretch of short runs after they are absorbed by their neighbours."""

    def settle(band, size, before, after, least):
        band, size = [int(b) for b in band], [int(s) for s in size]
        before = None if pd.isna(before) else int(before)
        after = None if pd.isna(after) else int(after)
        owner = list(range(len(band)))  # original run -> current run
        changed = True
        while changed:
            changed = False
            for i, own in enumerate(band):
                prev = band[i - 1] if i else before
                nxt = band[i + 1] if i + 1 < len(band) else after
                # runs that met a long neighbour of their own band now belong to it
                joined = (i == 0 and before == own) or (i + 1 == len(band) and after == own)
                if size[i] >= least or joined:
                    continue
                options = [b for b in (prev, nxt) if b is not None]
                fill = min(options, key=lambda b: abs(b - own)) if options else own
                if fill != own:
                    band[i], changed = fill, True
            merged_band, merged_size, remap = [], [], []
            for b, s in zip(band, size):
                if merged_band and merged_band[-1] == b:
                    merged_size[-1] += s
                else:
                    merged_band.append(b)
                    merged_size.append(s)
                remap.append(len(merged_band) - 1)
            owner = [remap[o] for o in owner]
            band, size = merged_band, merged_size
        return [band[o] for o in owner]

    return pd.Series([settle(*row) for row in zip(bands, sizes, left, right, min_run)])


def music_sections(energy: DataFrame, tracks: DataFrame, per_second: float = 4.0) -> DataFrame:
    """Contiguous sections (intro, build, peak, release, outro, steady) with mean intensity.

    Short runs of a loudness band are absorbed by their neighbours. A run long enough to stand
    never changes, so the stretches between such runs settle independently of each other.
    """
    smooth = cut_lineage(trailing_average(energy, max(1, round(per_second))))
    stats = smooth.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rms").alias("mean"), F.min("smooth").alias("low"), F.max("smooth").alias("high"))
    known = tracks.filter("track_seconds > 0").join(stats, "track_id", "left")
    few = F.coalesce(F.col("n") < 8, F.lit(True))
    plain = few | (F.col("high") - F.col("low") <= 1e-6)
    simple = known.filter(plain).select(
        "track_id", F.lit(0).cast("bigint").alias("section"), F.lit("steady").alias("kind"), F.lit(0.0).alias("start"),
        F.col("track_seconds").alias("end"), F.when(few, F.coalesce("mean", F.lit(0.5))).otherwise(F.lit(0.5)).alias("intensity"))
    shaped = known.filter(~plain).withColumn(
        "min_run", F.greatest(F.lit(1), F.floor(F.greatest(F.lit(2.0), F.col("track_seconds") * 0.06) * per_second)).cast("int"))

    level = (F.col("smooth") - F.col("low")) / (F.col("high") - F.col("low"))
    banded = smooth.join(shaped, "track_id").withColumn("level", level).withColumn(
        "band", F.when(F.col("level") < 0.35, 0).when(F.col("level") < 0.72, 1).otherwise(2))
    runs = _runs(banded.select("track_id", "i", "band", "level", "n", "min_run", "track_seconds"))
    settled = cut_lineage(_settle(cut_lineage(runs)))
    return simple.unionByName(_classify(settled, per_second))


def _runs(banded: DataFrame) -> DataFrame:
    changed = with_neighbours(banded, TRACK, "i", 1, 0, lambda w: {"_new": (F.col("band") != F.lag("band").over(w))})
    numbered = running_sum(changed, TRACK, "i", {"run": F.when(F.coalesce("_new", F.lit(False)), 1).otherwise(0).cast("bigint")})
    x, y = F.col("i").cast("double"), F.col("level")
    return numbered.groupBy("track_id", "run").agg(
        F.first("band").alias("band"), F.min("i").alias("first_i"), F.count(F.lit(1)).alias("size"),
        F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"),
        *[F.first(c).alias(c) for c in ("n", "min_run", "track_seconds")])


def _settle(runs: DataFrame) -> DataFrame:
    stands = F.col("size") >= F.col("min_run")
    stretched = running_sum(runs, TRACK, "run", {"stretch": F.when(stands, 1).otherwise(0).cast("bigint")})
    merging = (F.col("min_run") > 1) & (F.col("n") > F.col("min_run"))
    short = stretched.filter(~stands & merging)
    anchors = stretched.filter(stands).select("track_id", "stretch", F.col("band").alias("_anchor"))
    listed = (
        short.groupBy("track_id", "stretch").agg(
            F.sort_array(F.collect_list(F.struct("run", "band", "size"))).alias("items"), F.first("min_run").alias("min_run"))
        .join(anchors.withColumnRenamed("_anchor", "_left"), ["track_id", "stretch"], "left")
        .join(anchors.select("track_id", (F.col("stretch") - 1).alias("stretch"), F.col("_anchor").alias("_right")), ["track_id", "stretch"], "left")
    )
    bands = _absorb(F.col("items.band"), F.col("items.size"), F.col("_left"), F.col("_right"), F.col("min_run"))
    new = listed.select("track_id", F.explode(F.arrays_zip(F.col("items.run").alias("run"), bands.alias("band"))).alias("z")).select(
        "track_id", F.col("z.run").alias("run"), F.col("z.band").alias("_band"))
    return stretched.join(new, ["track_id", "run"], "left").withColumn("band", F.coalesce("_band", "band")).drop("_band", "stretch")


def _classify(runs: DataFrame, per_second: float) -> DataFrame:
    changed = with_neighbours(runs, TRACK, "run", 1, 0, lambda w: {"_new": (F.col("band") != F.lag("band").over(w))})
    numbered = running_sum(changed, TRACK, "run", {"section": F.when(F.coalesce("_new", F.lit(False)), 1).otherwise(0).cast("bigint")})
    parts = numbered.groupBy("track_id", "section").agg(
        F.first("band").alias("band"), F.min("first_i").alias("first_i"), F.sum("size").alias("size"),
        *[F.sum(c).alias(c) for c in ("sy", "sxy", "sx", "sxx")], F.first("track_seconds").alias("track_seconds"))
    sided = with_neighbours(parts, TRACK, "section", 1, 1, lambda w: {"_prev": F.lag("band").over(w), "_next_i": F.lead("first_i").over(w)})
    m = F.col("size")
    slope = F.coalesce(F.try_divide(m * F.col("sxy") - F.col("sx") * F.col("sy"), m * F.col("sxx") - F.col("sx") * F.col("sx")), F.lit(0.0))
    after_peak = F.coalesce(F.col("_prev") == 2, F.lit(False))
    fallback = F.when(after_peak, "release").otherwise("steady")
    kind = (
        F.when(F.col("band") == 2, "peak")
        .when((F.col("band") == 0) & (F.col("section") == 0), "intro")
        .when((F.col("band") == 0) & F.col("_next_i").isNull(), "outro")
        .when((F.col("band") == 1) & (slope > 0.008), "build")
        .otherwise(fallback)
    )
    end = F.when(F.col("_next_i").isNull(), F.col("track_seconds")).otherwise(F.least(F.col("_next_i") / per_second, F.col("track_seconds")))
    return sided.select("track_id", "section", kind.alias("kind"), (F.col("first_i") / per_second).alias("start"), end.alias("end"),
                        (F.col("sy") / m).alias("intensity"))


def beats_per_cut(kind: Column, intensity: float) -> Column:
    scale = 1.5 - 0.8 * intensity
    out = F.lit(K.SECTION_BEATS["steady"] * scale)
    for name, beats in K.SECTION_BEATS.items():
        out = F.when(kind == name, beats * (max(0.9, scale * 0.8) if name == "peak" else scale)).otherwise(out)
    return out


def plan_cuts(beats: DataFrame, sections: DataFrame, tracks: DataFrame, options: PlanOptions = PlanOptions()) -> DataFrame:
    """Cut times ``(track_id, i, t)`` on beats, denser where the music is; even slots without a grid.

    The walk over beats is sequential, but only the beats of the first ``max_seconds`` take part,
    so each track folds one short array.
    """
    planned = tracks.withColumn("plan_seconds", F.least("track_seconds", F.lit(options.max_seconds)))
    early = beats.join(planned.select("track_id", "plan_seconds"), "track_id").filter("t < plan_seconds")
    placed = asof(early, sections, TRACK, "t", ["kind"], 60.0, right_at="start")
    wanted = max(4, options.asset_count + options.asset_count // 2) * 1.6
    counted = with_entity(placed, TRACK, F.count(F.lit(1)).alias("_n"))
    base = beats_per_cut(F.coalesce("prev_kind", F.lit("steady")), options.intensity)
    projected = F.col("_n") / F.greatest(F.lit(1.0), base)
    target = F.when(projected > wanted, base * (projected / wanted)).otherwise(base)
    rows = counted.select("track_id", "_n", F.struct("t", target.alias("target"), F.col("is_downbeat").alias("down")).alias("b"))
    lists = rows.groupBy("track_id").agg(F.sort_array(F.collect_list("b")).alias("bs"), F.first("_n").alias("_n"))
    listed = planned.join(lists, "track_id", "left")

    def step(acc, b):
        since = acc["since"] + 1
        cut = (since >= b["target"]) | (b["down"] & (since >= b["target"] - 1))
        near = b["t"] - F.element_at(acc["cuts"], -1) < options.min_shot
        return F.when(near, acc).otherwise(
            F.struct(F.when(cut, F.concat(acc["cuts"], F.array(b["t"]))).otherwise(acc["cuts"]).alias("cuts"),
                     F.when(cut, F.lit(0.0)).otherwise(since).alias("since")))

    start = F.struct(F.array(F.lit(0.0)).alias("cuts"), F.lit(0.0).alias("since"))
    walked = F.aggregate("bs", start, step, lambda acc: acc["cuts"])
    seconds = F.col("plan_seconds")
    closed = (
        F.when(seconds - F.element_at(walked, -1) >= options.min_shot, F.concat(walked, F.array(seconds)))
        .when(F.size(walked) > 1, F.concat(F.slice(walked, 1, F.size(walked) - 1), F.array(seconds)))
        .otherwise(walked)
    )
    slots = F.greatest(F.lit(4), F.least(F.lit(options.asset_count), F.floor(seconds / 2))).cast("int")
    even = F.transform(F.sequence(F.lit(0), slots), lambda i: i * (seconds / slots))
    cuts = F.when(F.coalesce("_n", F.lit(0)) >= 2, closed).otherwise(even)
    return listed.select("track_id", F.posexplode(cuts).alias("i", "t"))


def plan_music_template(cuts: DataFrame, sections: DataFrame, options: PlanOptions = PlanOptions()) -> DataFrame:
    """Scenes between consecutive cuts with role, framing, move and transition by section."""
    paired = with_neighbours(cuts.withColumn("i", F.col("i").cast("bigint")), TRACK, "i", 0, 1, lambda w: {"_end": F.lead("t").over(w)})
    spans = paired.filter("_end IS NOT NULL").select(
        "track_id", F.col("i").alias("scene_idx"), F.col("t").alias("start"), F.col("_end").alias("end"), ((F.col("t") + F.col("_end")) / 2).alias("mid"))
    placed = asof(spans, sections.select("track_id", "start", "kind", "intensity"), TRACK, "mid", ["kind", "intensity"], 60.0, right_at="start")
    kind = F.coalesce("prev_kind", F.lit("steady"))
    level = F.coalesce("prev_intensity", F.lit(0.5))
    idx = F.col("scene_idx")
    even, calm = idx % 2 == 0, kind.isin("intro", "outro")
    pushes = calm | (kind == "build") | (kind.isin("peak", "steady") & even)
    tight = F.greatest(F.lit(0.78), 1 - (0.06 + 0.10 * level * (0.5 + options.intensity)))
    factor = F.when(calm, 0.94).when(kind == "steady", 0.90).otherwise(tight)
    inner = scaled_full(factor)
    soft = (kind == "outro") | ((kind == "release") & even)
    return placed.select(
        "track_id", labels.numbered("scene", idx + 1).alias("scene_id"), labels.numbered("asset", idx + 1).alias("slot_id"),
        "scene_idx", "start", "end", kind.alias("section"), level.alias("motion_energy"),
        F.when(idx == 0, "opening").when(kind == "peak", "hero").otherwise("body").alias("role"),
        F.when(kind == "peak", F.when(even, "closeUp").otherwise("medium")).when(calm, "wide")
        .otherwise(F.when(idx % 3 == 0, "wide").otherwise("medium")).alias("framing"),
        F.when(pushes, "zoomIn").otherwise("zoomOut").alias("move"),
        F.when(pushes, full()).otherwise(inner).alias("crop_start"), F.when(pushes, inner).otherwise(full()).alias("crop_end"),
        F.when(kind == "build", "easeIn").when(kind.isin("release", "peak"), "easeOut").otherwise("easeInOut").alias("easing"),
        F.when(idx > 0, F.when(soft, "dissolve").otherwise("cut")).alias("transition"),
        F.when(idx > 0, F.when(soft, 0.35).otherwise(0.0)).alias("transition_seconds"),
    )
