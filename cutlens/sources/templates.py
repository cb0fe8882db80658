"""Versioned template documents and the template library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutlens.functions import constants as K
from cutlens.functions import labels
from cutlens.functions.geometry import clamp_inside, full, offset, scaled_full

RECT = "struct<x:double,y:double,w:double,h:double>"
DOCUMENT = (
    "schemaVersion int, id string, title string, createdAt timestamp, duration double, "
    "canvas struct<width:int,height:int,fps:int>, "
    f"scenes array<struct<id:string,index:int,start:double,end:double,role:string,framing:string,move:string,"
    f"cropStart:{RECT},cropEnd:{RECT},transition:string,transitionDuration:double>>, "
    f"textSlots array<struct<id:string,role:string,start:double,end:double,frame:{RECT},sizeRatio:double,charCountHint:int>>, "
    "tags array<string>, isBuiltIn boolean"
)


def parse_templates(texts: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split JSON documents into readable templates and a quarantine with the reason.

    Documents of a newer schema version are refused, as are unparsable ones and those without an
    id; absent later fields become null.
    """
    parsed = texts.withColumn("_doc", F.from_json(column, DOCUMENT, {"mode": "PERMISSIVE"}))
    version = F.col("_doc.schemaVersion")
    why = (
        F.when(version.isNull() | F.col("_doc.id").isNull(), "unreadable")
        .when(version > K.SCHEMA_VERSION, F.format_string("version %d is newer than %d", version, F.lit(K.SCHEMA_VERSION)))
    )
    judged = parsed.withColumn("reason", why)
    keep = [c for c in texts.columns if c != column]
    good = judged.filter("reason IS NULL").select(*keep, "_doc.*")
    bad = judged.filter("reason IS NOT NULL").select(*keep, column, "reason")
    return good, bad


def read_templates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Templates and quarantine from a folder of JSON documents, one per line."""
    return parse_templates(spark.read.text(path))


def to_document(templates: DataFrame) -> DataFrame:
    """One JSON text per template with keys in a fixed order and without null fields."""
    fields = sorted(c for c in templates.columns)
    return templates.select(F.to_json(F.struct(*fields)).alias("value"))


def write_templates(templates: DataFrame, path: str, mode: str = "append") -> None:
    to_document(templates.withColumn("schemaVersion", F.lit(K.SCHEMA_VERSION))).write.mode(mode).text(path)


def import_templates(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming templates ready to append: an id already taken, also by an earlier incoming one,
    is replaced by a fresh id, and nothing imported counts as built in."""
    taken = existing.select(F.col("id")).distinct().withColumn("_taken", F.lit(True))
    body = F.sha2(F.to_json(F.struct(*sorted(incoming.columns))), 256)
    keyed = incoming.withColumn("_body", body)
    firsts = keyed.groupBy("id").agg(F.min("_body").alias("_first"))
    marked = keyed.join(taken, "id", "left").join(firsts, "id")
    clash = F.coalesce("_taken", F.lit(False)) | (F.col("_body") != F.col("_first"))
    fresh = labels.stable_id(F.col("id"), F.col("_body"))
    out = marked.withColumn("id", F.when(clash, fresh).otherwise(F.col("id"))).withColumn("isBuiltIn", F.lit(False))
    return out.select(*incoming.columns, *([] if "isBuiltIn" in incoming.columns else ["isBuiltIn"]))


def library(saved: DataFrame, starters: DataFrame) -> DataFrame:
    """Saved templates first, starters after them (``shelf`` 0 and 1)."""
    return saved.withColumn("shelf", F.lit(0)).unionByName(starters.withColumn("shelf", F.lit(1)), allowMissingColumns=True)


def find_template(projects: DataFrame, saved: DataFrame, starters: DataFrame) -> DataFrame:
    """Resolve ``projects(project_id, template_id)`` in the saved templates, else in the starters."""
    s = saved.select(F.col("id").alias("template_id"), F.col("title").alias("_saved"))
    b = starters.select(F.col("id").alias("template_id"), F.col("title").alias("_starter"))
    return projects.join(s, "template_id", "left").join(b, "template_id", "left").select(
        "project_id", "template_id", F.coalesce("_saved", "_starter").alias("title"),
        F.when(F.col("_saved").isNotNull(), "saved").when(F.col("_starter").isNotNull(), "starter").alias("found_in"))


def search_templates(templates: DataFrame, category: str = "All", query: str = "") -> DataFrame:
    """Templates of a category (All, Yours or a tag) whose title or tags contain the query."""
    found = templates
    if category == "Yours":
        found = found.filter(~F.coalesce("isBuiltIn", F.lit(False)))
    elif category != "All":
        found = found.filter(F.array_contains("tags", category))
    needle = query.strip().lower()
    if needle:
        found = found.filter(F.lower("title").contains(needle) | F.lower(F.array_join("tags", " ")).contains(needle))
    return found


def distinct_tags(templates: DataFrame) -> DataFrame:
    """Every tag in use, sorted, after the two fixed categories."""
    tags = templates.select(F.explode("tags").alias("tag")).distinct().withColumn("shelf", F.lit(2))
    fixed = templates.sparkSession.createDataFrame([("All", 0), ("Yours", 1)], "tag string, shelf int")
    return fixed.unionByName(tags).orderBy("shelf", "tag")


# Starter templates. Per template the canvas, scene lengths, moves, transitions
# (kind, seconds), framings, roles and text slots (role, start, end, x, y, w, h, size, font,
# entry, alignment, hint). Shorter lists repeat.
REEL, SQUARE = (1080, 1920, 30), (1080, 1080, 30)
STARTERS = [
    dict(key="fast-reel", title="Fast Reel", tags=["Fast Reel", "Beat Sync"], canvas=REEL, seconds=[0.55] * 12,
         moves=["zoomIn", "zoomOut"], framings=["wide", "closeUp", "closeUp"], palette=["#111111", "#F5F5F5", "#E9448B"],
         text=[("title", 0.2, 1.9, 0.08, 0.14, 0.84, 0.14, 0.07, "displayBold", "popIn", "center", "BIG BOLD TITLE"),
               ("cta", 5.4, 6.6, 0.1, 0.74, 0.8, 0.1, 0.05, "displayBold", "wordByWord", "center", "TAP THE LINK")]),
    dict(key="photo-montage", title="Photo Montage", tags=["Photo Montage", "Emotional"], canvas=REEL, seconds=[2.0] * 8,
         moves=["zoomIn", "panRight"], transitions=[("dissolve", 0.45)], roles=["opening"] + ["body"] * 6 + ["closing"],
         palette=["#F3E9DD", "#8A6A52", "#FFFFFF"],
         text=[("title", 0.4, 3.6, 0.1, 0.42, 0.8, 0.16, 0.06, "serif", "fadeIn", "center", "A little story")]),
    dict(key="cinematic", title="Cinematic", tags=["Cinematic", "Luxury"], canvas=(1920, 1080, 24), seconds=[2.5] * 6,
         moves=["zoomIn", "panLeft", "zoomOut", "panRight", "zoomIn", "none"],
         transitions=[("dissolve", 0.5)] * 3 + [("fadeToBlack", 0.7)] + [("dissolve", 0.5)] * 2, framings=["wide"],
         roles=["opening"] + ["wide"] * 4 + ["closing"], palette=["#0B0B0F", "#C9A96E", "#E8E8E8"],
         text=[("title", 5.4, 8.4, 0.15, 0.4, 0.7, 0.2, 0.09, "serif", "fadeIn", "center", "TITLE")]),
    dict(key="product-ad", title="Product Ad", tags=["Product", "Business"], canvas=REEL, seconds=[1.6, 0.9, 0.9, 1.4, 0.9, 0.9, 2.0],
         moves=["zoomIn", "zoomIn", "panLeft", "zoomOut", "zoomIn", "panRight", "zoomIn"],
         transitions=[("cut", 0.0)] * 3 + [("push", 0.3)] + [("cut", 0.0)] * 2 + [("dissolve", 0.35)],
         framings=["wide", "closeUp", "closeUp", "medium", "closeUp", "closeUp", "medium"],
         roles=["opening", "detail", "detail", "hero", "detail", "detail", "closing"], palette=["#FFFFFF", "#1C1C1E", "#E9448B"],
         text=[("title", 0.3, 2.2, 0.08, 0.12, 0.84, 0.14, 0.066, "displayBold", "slideUp", "center", "PRODUCT NAME"),
               ("subtitle", 4.9, 6.4, 0.1, 0.7, 0.8, 0.1, 0.042, "sansSerif", "fadeIn", "center", "One line about it"),
               ("cta", 6.9, 8.5, 0.1, 0.44, 0.8, 0.12, 0.06, "displayBold", "popIn", "center", "DM TO ORDER")]),
    dict(key="minimal", title="Minimal", tags=["Minimal"], canvas=REEL, seconds=[1.6] * 5, moves=["none"], palette=["#FAFAFA", "#222222"],
         text=[("caption", 0.5, 7.5, 0.1, 0.82, 0.8, 0.08, 0.032, "sansSerif", "fadeIn", "center", "a quiet caption")]),
    dict(key="slideshow", title="Slideshow", tags=["Photo Montage", "Wedding", "Birthday"], canvas=REEL, seconds=[3.0] * 10,
         moves=["zoomIn", "zoomOut", "panLeft", "panRight"], transitions=[("dissolve", 0.6)], palette=["#FFF7F0", "#D8A7B1", "#6B4E71"]),
    dict(key="square-post", title="Square Post", tags=["Product", "Fashion", "Food"], canvas=SQUARE, seconds=[1.2] * 6,
         moves=["zoomIn", "zoomOut"], transitions=[("slide", 0.3)], framings=["closeUp"], palette=["#F2EDE4", "#2B2B2B", "#C46A4A"],
         text=[("title", 0.2, 2.0, 0.08, 0.08, 0.84, 0.14, 0.075, "displayBold", "popIn", "center", "NEW IN")]),
    dict(key="travel", title="Travel Story", tags=["Travel", "Fast Reel"], canvas=REEL, seconds=[1.8] + [1.1] * 8,
         moves=["zoomIn", "panRight", "zoomOut", "panLeft", "zoomIn", "panRight", "zoomIn", "panLeft", "zoomOut"],
         transitions=[("whip", 0.22), ("cut", 0.22), ("cut", 0.22)], framings=["wide", "medium", "medium"], roles=["opening"] + ["body"] * 8,
         palette=["#1E2A38", "#F4C15D", "#FFFFFF"],
         text=[("title", 0.3, 1.9, 0.08, 0.72, 0.84, 0.14, 0.064, "handwritten", "slideUp", "leading", "Somewhere new")]),
    dict(key="quote", title="Words First", tags=["Text Heavy", "Emotional", "Business"], canvas=REEL, seconds=[3.0] * 4, moves=["zoomIn"],
         transitions=[("fadeToBlack", 0.5)], framings=["wide"], palette=["#101010", "#EDEDED"],
         text=[("title", 0.4, 2.7, 0.1, 0.36, 0.8, 0.28, 0.062, "serif", "wordByWord", "center", "The first line of the thought")]
         + [("caption", i * 3.0 + 0.4, i * 3.0 + 2.7, 0.1, 0.36, 0.8, 0.28, 0.05, "serif", "wordByWord", "center", "and the next") for i in (1, 2, 3)]),
    dict(key="portrait-45", title="Portrait Feed", tags=["Product", "Fashion", "Minimal"], canvas=(1080, 1350, 30), seconds=[1.3] * 7,
         moves=["zoomIn", "none"], transitions=[("dissolve", 0.3)], palette=["#F7F7F5", "#2E2E2E"]),
]


def starter_scenes(spark: SparkSession) -> DataFrame:
    """Scenes of the starter templates; starts are running sums of the lengths."""
    rows = []
    for spec in STARTERS:
        pick = lambda name, i, default: (spec.get(name) or [default])[i % len(spec.get(name) or [default])]
        for i, seconds in enumerate(spec["seconds"]):
            kind, length = pick("transitions", i, ("cut", 0.0))
            rows.append((spec["key"], i, seconds, pick("moves", i, "none"), kind, length, pick("framings", i, "medium"), pick("roles", i, "body")))
    flat = spark.createDataFrame(rows, "template_id string, scene_idx int, seconds double, move string, kind string, kind_seconds double, framing string, role string")
    before = Window.partitionBy("template_id").orderBy("scene_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("seconds").over(before), F.lit(0.0))
    m = F.col("move")
    dx = F.when(m == "panLeft", 0.06).when(m == "panRight", -0.06).otherwise(0.0)
    inner, shifted = scaled_full(0.86), lambda d: clamp_inside(offset(scaled_full(0.86), d, 0.0))
    return flat.select(
        "template_id", labels.numbered("scene", F.col("scene_idx") + 1).alias("scene_id"), labels.numbered("asset", F.col("scene_idx") + 1).alias("slot_id"),
        "scene_idx", start.alias("start"), (start + F.col("seconds")).alias("end"), "role", "framing", "move",
        F.when(m.startswith("pan"), shifted(dx)).when(m == "zoomOut", inner).otherwise(full()).alias("crop_start"),
        F.when(m.startswith("pan"), shifted(-dx)).when(m == "zoomIn", inner).otherwise(full()).alias("crop_end"),
        F.when(m == "none", "linear").otherwise("easeInOut").alias("easing"),
        F.when(F.col("scene_idx") > 0, F.col("kind")).alias("transition"), F.when(F.col("scene_idx") > 0, F.col("kind_seconds")).alias("transition_seconds"),
        F.when(m == "none", 0.0).otherwise(0.2).alias("motion_energy"))


def starter_text_slots(spark: SparkSession) -> DataFrame:
    rows = [(s["key"], i, *t) for s in STARTERS for i, t in enumerate(s.get("text", []))]
    flat = spark.createDataFrame(rows, "template_id string, slot_idx int, role string, start double, end double, x double, y double, w double, h double, "
                                       "size_ratio double, font string, entry string, alignment string, hint string")
    return flat.select("template_id", labels.numbered("text", F.col("slot_idx") + 1).alias("slot_id"), "slot_idx", "role", "start", "end",
                       F.struct("x", "y", "w", "h").alias("frame"), "size_ratio", "font", "entry", "alignment", F.col("hint").alias("sample_text"), F.length("hint").alias("char_hint"))


def seed_templates(spark: SparkSession) -> DataFrame:
    """One row per starter template: id, title, tags, canvas, duration and statistics."""
    heads = spark.createDataFrame([(s["key"], s["title"], s["tags"], *s["canvas"], s["palette"]) for s in STARTERS],
                                  "id string, title string, tags array<string>, width int, height int, fps int, palette array<string>")
    scenes = starter_scenes(spark).groupBy(F.col("template_id").alias("id")).agg(
        F.max("end").alias("duration"), F.count(F.lit(1)).alias("scene_count"), F.count_if(F.col("transition") != "cut").alias("transition_count"))
    texts = starter_text_slots(spark).groupBy(F.col("template_id").alias("id")).agg(F.count(F.lit(1)).alias("text_slot_count"))
    return heads.join(scenes, "id").join(texts, "id", "left").select(
        "id", "title", "tags", F.struct("width", "height", "fps").alias("canvas"), "palette", "duration", "scene_count", "transition_count",
        F.coalesce("text_slot_count", F.lit(0)).alias("text_slot_count"), F.lit(True).alias("isBuiltIn"))
