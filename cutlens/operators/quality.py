"""Edit quality: coverage, continuity, diversity, rhythm, and the issues behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlens.functions import constants as K
from cutlens.operators.ordered import nearest, with_neighbours

PROJECT = ["project_id"]


def _rhythm(clips: DataFrame, beats: DataFrame, fps: int) -> DataFrame:
    tolerance = max(0.08, 2.0 / fps)
    ended = with_neighbours(clips.select("project_id", "pos", (F.col("start") + F.col("duration")).alias("end")), PROJECT, "pos", 0, 1,
                            lambda w: {"_more": F.lead("pos").over(w).isNotNull()})
    cuts = ended.filter(F.col("_more") & (F.col("end") > 0.01)).drop("_more")
    near = nearest(cuts, beats.select("project_id", F.col("t").alias("_beat")), PROJECT, "end", tolerance=tolerance, right_at="_beat")
    return near.join(beats.select("project_id").distinct(), "project_id", "left_semi").groupBy("project_id").agg(
        F.count(F.lit(1)).alias("boundaries"), F.count("near_t").alias("aligned"))


def _measured(clips: DataFrame, assets: DataFrame | None, beats: DataFrame | None, fps: int) -> DataFrame:
    """Counts per project, all from map-side combined aggregates."""
    has = F.col("asset_id").isNotNull()
    sided = with_neighbours(clips, PROJECT, "pos", 1, 0, lambda w: {"_repeat": F.coalesce(F.col("asset_id") == F.lag("asset_id").over(w), F.lit(False))})
    if assets is None:
        sided = sided.withColumn("_still", F.lit(False))
    else:
        stills = assets.filter("kind = 'image'").select("project_id", "asset_id", F.lit(True).alias("_image"))
        sided = sided.join(stills, ["project_id", "asset_id"], "left").withColumn(
            "_still", F.coalesce("_image", F.lit(False)) & (F.col("duration") > K.LONG_STILL_SECONDS))
    per_asset = sided.groupBy("project_id", "asset_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_repeat").alias("repeats"), F.count_if("_still").alias("stills"),
        F.count_if(F.col("duration") < 3.0 / fps).alias("short"))
    counts = per_asset.groupBy("project_id").agg(
        F.sum("n").alias("clips"), F.sum(F.when(has, F.col("n")).otherwise(0)).alias("filled"), F.sum("short").alias("short"),
        F.sum("repeats").alias("repeats"), F.sum("stills").alias("stills"),
        F.count("asset_id").alias("distinct"), F.coalesce(F.max(F.when(has, F.col("n"))), F.lit(0)).alias("worst"))
    if beats is None:
        return counts.withColumn("boundaries", F.lit(0)).withColumn("aligned", F.lit(0))
    return counts.join(_rhythm(clips, beats, fps), "project_id", "left").fillna(0, ["boundaries", "aligned"])


def _overused():
    share = F.try_divide(F.col("worst").cast("double"), F.col("filled").cast("double"))
    fair = F.try_divide(F.expr("(filled + distinct - 1) div nullif(distinct, 0)").cast("double"), F.col("filled").cast("double"))
    return F.coalesce((F.col("filled") >= 4) & (share > F.greatest(F.lit(0.4), fair + 0.12)), F.lit(False)), share


def _without_clips(projects: DataFrame, clips: DataFrame) -> DataFrame:
    return projects.select("project_id").distinct().join(clips.select("project_id"), "project_id", "left_anti")


def edit_quality(clips: DataFrame, assets: DataFrame | None = None, beats: DataFrame | None = None, fps: int = 30, projects: DataFrame | None = None) -> DataFrame:
    """Scores per project. An empty slot caps the total below acceptable; every over-long still
    costs .05. ``beats(project_id, t)`` only for edits planned on a grid. With ``projects(project_id)``, a
    project without clips scores 0 and has one issue."""
    m = _measured(clips, assets, beats, fps)
    n = F.col("clips").cast("double")
    overused, share = _overused()
    diversity = F.when(F.col("filled") > 0, F.try_divide(F.col("distinct").cast("double"), F.col("filled").cast("double"))
                       * F.when(overused, F.greatest(F.lit(0.3), 1.4 - share * 2)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))
    scored = m.select(
        "*",
        (F.col("filled") / n * F.greatest(F.lit(0.0), 1 - F.col("short") / n)).alias("coverage"),
        F.when(n > 1, 1 - F.try_divide(F.col("repeats").cast("double"), n - 1)).otherwise(F.lit(1.0)).alias("continuity"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), diversity)).alias("diversity"), diversity.alias("_d"),
        F.when(F.col("boundaries") > 0, F.try_divide(F.col("aligned").cast("double"), F.col("boundaries").cast("double"))).otherwise(F.lit(1.0)).alias("rhythm"),
        overused.alias("overused"))
    total = F.col("coverage") * 0.35 + F.col("continuity") * 0.25 + F.col("_d") * 0.20 + F.col("rhythm") * 0.20
    capped = F.when(F.col("filled") < F.col("clips"), F.least(total, F.lit(K.ACCEPTABLE_QUALITY - 0.1))).otherwise(total)
    docked = F.when(F.col("stills") > 0, F.greatest(F.lit(0.0), capped - 0.05 * F.col("stills"))).otherwise(capped)
    issues = (
        (F.col("clips") - F.col("filled")) + F.col("short") + F.col("stills") + F.col("repeats") + F.col("overused").cast("int")
        + ((F.col("distinct") == 1) & (F.col("clips") >= 3)).cast("int") + ((F.col("boundaries") > 0) & (F.col("rhythm") < 0.5)).cast("int"))
    final = F.least(F.lit(1.0), F.greatest(F.lit(0.0), docked))
    scores = scored.select("project_id", final.alias("total"), "rhythm", "diversity", "continuity", "coverage", issues.alias("issues"),
                         (F.col("repeats") + F.col("overused").cast("int") + ((F.col("distinct") == 1) & (F.col("clips") >= 3)).cast("int")).alias("repeat_issues"),
                         (final >= K.ACCEPTABLE_QUALITY).alias("acceptable"))
    if projects is None:
        return scores
    nothing = [F.lit(0.0).alias(c) for c in ("total", "rhythm", "diversity", "continuity", "coverage")]
    return scores.unionByName(_without_clips(projects, clips).select("project_id", *nothing, F.lit(1).alias("issues"), F.lit(0).alias("repeat_issues"), F.lit(False).alias("acceptable")))


def quality_issues(clips: DataFrame, assets: DataFrame | None = None, beats: DataFrame | None = None, fps: int = 30, projects: DataFrame | None = None) -> DataFrame:
    """One row per issue: ``(project_id, kind, clip_idx, detail)``; with ``projects``, also for those without clips."""
    one = F.col("pos") + 1
    clip_issue = lambda df, kind, detail: df.select("project_id", F.lit(kind).alias("kind"), F.col("pos").alias("clip_idx"), detail.alias("detail"))
    empty = clip_issue(clips.filter("asset_id IS NULL"), "emptySlot", F.format_string("scene %d has no asset", one))
    short = clip_issue(clips.filter(F.col("duration") < 3.0 / fps), "tooShortClip", F.format_string("scene %d is %.0f ms", one, F.col("duration") * 1000))
    sided = with_neighbours(clips, PROJECT, "pos", 1, 0, lambda w: {"_p": F.lag("asset_id").over(w)}).filter("asset_id = _p")
    repeat = clip_issue(sided, "adjacentRepeat", F.format_string("scenes %d and %d show the same asset", "pos", one))
    out = empty.unionByName(short).unionByName(repeat)
    if assets is not None:
        stills = clips.join(assets.filter("kind = 'image'").select("project_id", "asset_id"), ["project_id", "asset_id"], "left_semi")
        out = out.unionByName(clip_issue(stills.filter(F.col("duration") > K.LONG_STILL_SECONDS), "longStillScene",
                                         F.format_string("scene %d is %.0fs of a single photo", one, "duration")))
    m = _measured(clips, None, beats, fps)
    overused, share = _overused()
    whole = lambda df, kind, detail: df.select("project_id", F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("clip_idx"), detail.alias("detail"))
    out = out.unionByName(whole(m.filter(overused), "overusedAsset", F.format_string("one asset fills %d%% of scenes", F.floor(share * 100))))
    out = out.unionByName(whole(m.filter("distinct = 1 AND clips >= 3"), "lowDiversity", F.lit("every scene uses the same asset")))
    if projects is not None:
        out = out.unionByName(whole(_without_clips(projects, clips), "emptySlot", F.lit("timeline has no clips")))
    off = m.filter("boundaries > 0 AND aligned < boundaries * 0.5")
    return out.unionByName(whole(off, "offGridCut", F.format_string("only %d/%d cuts land on the beat grid", "aligned", "boundaries")))
