"""Media files, projects, ingest batches and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutlens.functions.geometry import aspect_preset

HEAD_BYTES = 1_048_576


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``(path, length, head)``; only the first megabyte is kept per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.substring("content", 1, HEAD_BYTES).alias("head"))


def source_info(media: DataFrame) -> DataFrame:
    """Presented size, aspect, frame rate, fingerprint and length verdict of sources.

    ``media(source_id, seconds, fps, width, height, rotation, has_audio, length, head)``, where
    ``head`` holds the file's first megabyte. Sources without a positive duration are refused.
    """
    turned = F.abs(F.col("rotation")) % 180 == 90
    w = F.when(turned, F.col("height")).otherwise(F.col("width"))
    h = F.when(turned, F.col("width")).otherwise(F.col("height"))
    stamp = F.concat_ws("", F.col("seconds").cast("string"), F.lit("|"), w.cast("string"), F.lit("x"), h.cast("string"))
    digest = F.sha2(F.concat(F.encode(stamp, "utf-8"), F.col("head"), F.encode(F.col("length").cast("string"), "utf-8")), 256)
    return media.filter((F.col("seconds") > 0) & ~F.isnan("seconds")).select(
        "source_id", "seconds", F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.lit(30.0)).alias("fps"), w.alias("width"), h.alias("height"),
        aspect_preset(w, h).alias("aspect"), "has_audio", F.concat(F.lit("sha256:"), digest).alias("fingerprint"),
        (F.col("seconds") > 120).alias("too_long"))


def project_catalog(projects: DataFrame, clips: DataFrame) -> DataFrame:
    """Scene count, length and canvas of every project; projects without clips stay.

    ``projects(project_id, title, modified_at, is_favorite, canvas_w, canvas_h)``.
    """
    sums = clips.groupBy("project_id").agg(F.count(F.lit(1)).alias("scenes"), F.max(F.col("start") + F.col("duration")).alias("_end"))
    return projects.join(sums, "project_id", "left").select(
        "project_id", "title", "modified_at", "is_favorite", F.coalesce("scenes", F.lit(0)).alias("scenes"),
        F.coalesce("_end", F.lit(0.0)).alias("seconds"), (F.col("canvas_w").cast("double") / F.col("canvas_h")).alias("canvas_aspect"))


def read_projects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Project documents; unreadable ones are skipped."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.filter("_corrupt_record IS NULL").drop("_corrupt_record")


def search_projects(catalog: DataFrame, query: str = "", sort: str = "recent") -> DataFrame:
    """Projects whose title contains the query, sorted by recency, name or favourites first."""
    needle = query.strip().lower()
    found = catalog.filter(F.lower("title").contains(needle)) if needle else catalog
    newest = F.col("modified_at").desc()
    order = {"recent": [newest], "name": [F.lower("title")], "favorites": [F.col("is_favorite").desc(), newest]}[sort]
    return found.orderBy(*order, "project_id")


def diag_report(log: DataFrame, keep: int | None = None) -> DataFrame:
    """Per source and category: counts, warnings, timings, memory; with ``keep``, over the last so many
    entries of a source only.

    ``log(source_id, seq, level, category, seconds, memory_mb)``.
    """
    kept = log
    if keep is not None:
        newest = Window.partitionBy("source_id").orderBy(F.col("seq").desc())
        kept = log.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= keep)
    timing = F.when(F.col("level") == "timing", F.col("seconds"))
    per = kept.groupBy("source_id", "category").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("level").isin("warning", "failure")).alias("problems"),
        F.sum(timing).alias("timed_seconds"), F.max(timing).alias("slowest_seconds"), F.max("memory_mb").alias("category_peak_mb"))
    peaks = kept.groupBy("source_id").agg(F.max("memory_mb").alias("peak_mb"), F.count(F.lit(1)).alias("kept"))
    return per.join(peaks, "source_id")


def ingest_audit(items: DataFrame, assets: DataFrame) -> DataFrame:
    """Per batch, how many items were referenced, copied or failed; an origin the project already
    holds, or that came earlier in the batch, is not added twice.

    ``items(project_id, batch_id, item_id, origin, copied_path)`` with nullable origin and path.
    """
    known = assets.select("project_id", "origin").distinct().withColumn("_known", F.lit(True))
    firsts = items.filter("origin IS NOT NULL").groupBy("project_id", "origin").agg(F.min("item_id").alias("_first"))
    rows = items.join(known, ["project_id", "origin"], "left").join(firsts, ["project_id", "origin"], "left")
    repeat = F.coalesce("_known", F.lit(False)) | (F.col("item_id") != F.col("_first"))
    outcome = (
        F.when(F.col("origin").isNotNull(), F.when(repeat, "known").otherwise("referenced"))
        .when(F.col("copied_path").isNotNull(), "copied").otherwise("failed")
    )
    return rows.withColumn("outcome", outcome).groupBy("project_id", "batch_id", "outcome").agg(F.count(F.lit(1)).alias("items"))
