"""Observation tables derived from generic business tables, for checks and benchmarks.

There is no video in those tables; each adapter maps rows to observations by arithmetic on their
keys and values, so every check reads whole tables and grows with them. Tables that need a rank
are written once, as an ingest job would land them with their frame numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlens.functions import color, geometry as g
from cutlens.operators.ordered import FEW_INTERVALS, SLICE_ROWS, crowded, positions
from cutlens.session import cut_lineage, landed


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _ordered_events(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", *columns)
    return landed(positions(events, ["user_id"], ["ts", "event_id"], F.floor(F.unix_timestamp("ts") / 21600), out="frame_idx"))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events in order are the frames of a video at 30 per second."""
    e, i = F.col("event_id"), F.col("frame_idx")
    return _ordered_events(spark, folder, ["value"]).select(
        F.col("user_id").alias("video_id"), "frame_idx", (i / 30.0).alias("t"), (F.col("value") / 500).alias("content_value"),
        ((e % 11) / 10.0).alias("luma_mean"), ((e % 20) / 100.0).alias("luma_std"), "event_id")


def durations(frames_: DataFrame) -> DataFrame:
    return frames_.groupBy("video_id").agg((F.count(F.lit(1)) / 30.0).alias("video_seconds"))


def thumbs(spark: SparkSession, folder: str, frames_: DataFrame) -> DataFrame:
    """Even videos blend steadily from frame to frame, odd ones jump between unrelated pictures."""
    vectors = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("_e"))
    total = vectors.agg(F.count(F.lit(1)).alias("_n")).scalar()
    odd = frames_.filter("video_id % 2 = 1").select("video_id", "frame_idx", (F.col("event_id") % total).alias("vec_id"))
    ramp = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: 0.2 + 0.011 * F.col("frame_idx"))
    even = frames_.filter("video_id % 2 = 0").select("video_id", "frame_idx", ramp.alias("thumb"))
    return even.unionByName(odd.join(vectors, "vec_id").select("video_id", "frame_idx", F.col("_e").alias("thumb")))


def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a label in id order are the frames of a video."""
    vectors = positions(table(spark, folder, "embeddings"), ["label"], ["vec_id"], F.expr("vec_id div 1024"), out="frame_idx")
    e = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return vectors.select(F.col("label").alias("video_id"), "frame_idx", e.alias("hue"), F.transform(e, lambda x: 1 - x).alias("sat"), F.transform(e, lambda x: x * x).alias("val"))


def pixel_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as pixels of 40 x 30 pictures."""
    o, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.expr("o_orderkey div 1200").alias("asset_id"), o.alias("sample_id"), (o % 40).alias("x"), F.expr("(o_orderkey % 1200) div 40").alias("y"),
        ((c % 51) / 50.0).alias("r"), ((o % 97) / 96.0).alias("g"), (F.floor(p) % 101 / 100.0).alias("b"))


def crowded_flow(spark: SparkSession, folder: str) -> DataFrame | None:
    """Suppliers whose line items, the vectors of a shot, are more than the rows of a slice; None if there are none."""
    return crowded(["l_suppkey"], (table(spark, folder, "lineitem").select("l_suppkey"), SLICE_ROWS))


def flow(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """Line items as flow vectors of a zoom with a pan; every seventh is an outlier."""
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
        (F.col("l_suppkey") % 20).alias("video_id"), F.expr("l_suppkey div 20").alias("shot_idx"))
    rows = positions(items, ["video_id", "shot_idx"], ["l_orderkey", "l_linenumber", "l_partkey"], F.expr("l_orderkey div 4096"), out="point_id", whole=whole)
    sx = 0.05 + F.col("l_quantity") / 50.0 * 0.9
    sy = 0.05 + (F.col("l_partkey") % 90) / 100.0
    zoom = 1.02 + (F.col("l_suppkey") % 5) * 0.03
    base = rows.withColumn("sx", sx).withColumn("sy", sy).withColumn("zoom", zoom)
    outlier = F.col("point_id") % 7 == 3
    return base.select(
        "video_id", "shot_idx", (F.col("point_id") % 3).alias("pair"), "point_id", "sx", "sy",
        F.when(outlier, F.col("sx") + F.col("l_discount")).otherwise(F.col("zoom") * F.col("sx") - 0.04).alias("tx"),
        F.when(outlier, F.col("sy") - F.col("l_tax")).otherwise(F.col("zoom") * F.col("sy") + 0.01).alias("ty"))


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as salient boxes of frames."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("video_id"), F.col("l_linenumber").alias("shot_idx"), (F.col("l_orderkey") % 50).alias("frame_idx"),
        (F.col("l_discount") * 4).alias("x"), (F.col("l_tax") * 4).alias("y"), (F.col("l_quantity") / 100.0).alias("w"), ((F.col("l_partkey") % 40) / 100.0).alias("h"),
        "l_orderkey", "l_partkey")


def turn_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation as text hits every .4 s, in two places that take turns. Each shows its
    whole text after those of the turns before it in its row of four, so what is on screen grows."""
    plain = F.regexp_replace("text", r"[\n\t]", " ")
    turn = F.col("turn")
    blocks = table(spark, folder, "conversations").groupBy("conv_id", (turn - turn % 4).alias("_head")).agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce(plain, F.lit("")).alias("text")))).alias("_turns"))
    rows = blocks.select("conv_id", "_turns", F.posexplode("_turns").alias("_at", "_own"))
    shown = F.array_join(F.slice(F.col("_turns.text"), 1, F.col("_at") + 1), " ")
    return _placed(rows.select("conv_id", F.col("_own.turn").alias("turn"), shown.alias("_text")), F.col("_text"))


def _placed(rows: DataFrame, text: Column) -> DataFrame:
    turn = F.col("turn")
    return rows.select(
        F.col("conv_id").alias("video_id"), turn.alias("hit_id"), (turn * 0.4).alias("t"), text.alias("text"), (0.3 + (turn % 7) / 10.0).alias("confidence"),
        g.rect(0.1 + (F.expr("turn div 3") % 2) * 0.1, 0.1 + (F.expr("turn div 4") % 2) * 0.4, 0.4 + (turn % 4) * 0.08, F.lit(0.08)).alias("frame"))


def text_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as finished text tracks, some of them watermarks."""
    d = F.col("doc_id")
    mark = F.when(d % 7 == 0, F.concat(F.lit("@"), "text")).when(d % 11 == 0, F.concat("text", F.lit(" follow for more"))).otherwise(F.col("text"))
    return table(spark, folder, "documents").select(
        (d % 50).alias("video_id"), d.alias("track"), mark.alias("text"), (F.expr("doc_id div 50") * 0.7).alias("start"), (F.expr("doc_id div 50") * 0.7 + 1.1).alias("end"),
        g.rect((d % 60) / 100.0, (d % 19) / 20.0, 0.2 + (d % 4) / 10.0, 0.02 + (d % 8) / 100.0).alias("frame"), ((d % 5) / 4.0).alias("coverage"),
        (0.02 + (d % 8) / 100.0).alias("size_ratio"), (d % 4).alias("growth"), (2 + d % 5).alias("observations"), F.lit("#FFFFFF").alias("color_hex"))


def onset(spark: SparkSession, folder: str) -> DataFrame:
    """A user's event values as an onset envelope scaled to its peak."""
    rows = _ordered_events(spark, folder, ["value"])
    peaks = rows.groupBy("user_id").agg(F.max("value").alias("_m"))
    return rows.join(peaks, "user_id").select(F.col("user_id").alias("track_id"), F.col("frame_idx").alias("k"), (F.col("value") / F.col("_m")).alias("v"))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return _ordered_events(spark, folder, ["value"]).select(
        F.col("user_id").alias("track_id"), F.col("frame_idx").alias("i"), (F.col("value") / 500 - 0.05).alias("x"))


def pcm(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a type as signal blocks of 512 samples."""
    rows = positions(table(spark, folder, "events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"], F.expr("event_id div 8192"), out="i")
    blocks = rows.groupBy(F.col("event_type").alias("track_id"), F.expr("i div 512").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("i", "value"))).alias("_s"))
    return blocks.select("track_id", "block", F.transform("_s", lambda s: s["value"] / 500).alias("samples"))


def spectra(spark: SparkSession, folder: str) -> DataFrame:
    s = signatures(spark, folder)
    return s.select(F.col("video_id").alias("track_id"), F.col("frame_idx").alias("k"), F.col("hue").alias("mags"))


def energy(spark: SparkSession, folder: str) -> DataFrame:
    """A user's daily value sums as a loudness curve."""
    daily = table(spark, folder, "events").groupBy(F.col("user_id").alias("track_id"), F.to_date("ts").alias("_d")).agg(F.sum("value").alias("rms"))
    return landed(positions(daily, ["track_id"], ["_d"], F.floor(F.unix_date("_d") / 30), out="i").select("track_id", "i", "rms"))


def beats(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events as beats: 30 days are one minute."""
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - start) / 43200000000.0
    return table(spark, folder, "events").select(F.col("user_id").alias("track_id"), t.alias("t"), (F.col("event_type") == "signup").alias("is_downbeat"), "event_type")


def music_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Six ten-second sections per track whose kinds rotate with the track id."""
    kinds = F.array(*[F.lit(k) for k in ("intro", "build", "peak", "release", "outro", "steady")])
    users = table(spark, folder, "events").select(F.col("user_id").alias("track_id")).distinct()
    s = F.col("section")
    return users.withColumn("section", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        "track_id", "section", (s * 10.0).alias("start"), (s * 10.0 + 10).alias("end"), F.get(kinds, ((s + F.col("track_id")) % 6).cast("int")).alias("kind"), (s / 5.0).alias("intensity"))


def slots(spark: SparkSession, folder: str) -> DataFrame:
    """Nations of a region as the slots of a project's template."""
    n = table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"), F.col("n_regionkey").cast("bigint").alias("project_id"))
    rows = cut_lineage(positions(n, ["project_id"], ["n"], F.expr("n div 64"), out="scene_idx"))
    k = F.col("n")
    pick = lambda names, e: F.get(F.array(*[F.lit(v) for v in names]), (e % len(names)).cast("int"))
    return rows.select(
        "project_id", F.concat(F.lit("slot_"), k.cast("string")).alias("slot_id"), "scene_idx",
        pick(["opening", "body", "detail", "hero", "closing", "wide"], k).alias("role"), pick(["closeUp", "medium", "wide"], k).alias("framing"),
        ((3 + (k % 4) * 2) / 10.0).alias("framing_confidence"), g.rect((k % 5) / 10.0, (k % 7) / 10.0, 0.3, 0.3).alias("subject"), (0.2 + (k % 3) * 0.2).alias("subject_confidence"),
        pick(["image", "video", "unknown"], k).alias("source_kind"), (0.3 + (k % 6) * 0.4).alias("seconds"), F.lit(0.5625).alias("canvas_aspect"))


def assets(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers of a region as the assets of a project."""
    n = table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("project_id"))
    s = table(spark, folder, "supplier")
    k = F.col("s_suppkey")
    kind = F.when(k % 9 == 8, "audio").when(k % 3 == 0, "video").otherwise("image")
    dated = F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(((k * 37) % 365).cast("int"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        "project_id", k.alias("asset_id"), kind.alias("kind"), F.when(k % 2 == 0, 4000 / 3000).otherwise(3000 / 4000).alias("aspect"),
        F.when(kind == "image", 0.0).otherwise((k % 8) * 0.5).alias("asset_seconds"), F.when(k % 10 != 7, dated).alias("created_at"), k.alias("arrival"),
        F.concat(F.lit("lib/"), (k % 80).cast("string")).alias("origin"))


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Features of most assets; the print comes from the vector table."""
    a = assets(spark, folder).filter("asset_id % 13 <> 5")
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("print"))
    bal = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("asset_id"), "s_acctbal")
    k = F.col("asset_id")
    area = (k % 7) / 10.0
    return a.join(bal, "asset_id").join(vectors, F.col("vec_id") == k, "left").select(
        "project_id", "asset_id", F.when(k % 5 != 0, g.shot_framing(area)).alias("framing"), F.when(k % 4 != 1, (F.floor("s_acctbal") % 200) / 100.0 - 1).alias("aesthetic"),
        (k % 11 == 0).alias("is_utility"), F.when(k % 6 != 2, (k % 20) / 20.0).alias("sharpness"),
        F.when(k % 5 != 0, g.rect((k % 4) / 10.0, (k % 3) / 10.0, 0.4, 0.5)).alias("region"), F.when(k % 2 == 0, 4000 / 3000).otherwise(3000 / 4000).alias("aspect"),
        (k % 3).cast("int").alias("faces"), "print")


def crowded_timelines(spark: SparkSession, folder: str) -> DataFrame | None:
    """Projects with more clips or instants than a slice has rows, or more than a few overlays or texts; None if there are none."""
    items = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("project_id"))
    return crowded(["project_id"], (items, SLICE_ROWS), (table(spark, folder, "orders").select(F.col("o_orderkey").alias("project_id")), FEW_INTERVALS))


def clips(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """Line items of an order as the clips of a timeline."""
    rows = positions(
        table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"), ["l_orderkey"],
        ["l_linenumber", "l_partkey", "l_suppkey"], F.expr("l_linenumber * 1000000000L + l_partkey div 4096"), whole=whole)
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    pick = lambda names, e: F.get(F.array(*[F.lit(v) for v in names]), (e % len(names)).cast("int"))
    kind = pick(["cut", "dissolve", "push", "fadeToBlack"], s)
    change = F.struct(kind.alias("kind"), F.when(kind == "cut", 0.0).otherwise(0.2 + (p % 5) * 0.1).alias("duration"), F.when(kind == "push", "left").alias("direction"))
    return rows.select(
        F.col("l_orderkey").alias("project_id"), "pos", F.concat_ws("-", F.lit("c"), F.col("pos").cast("string")).alias("clip_id"),
        F.when(p % 50 != 0, p % 5).alias("asset_id"), F.lit(0.0).alias("start"), (F.col("l_quantity") * 0.037).alias("duration"), ((s % 10) / 10.0).alias("source_start"),
        (0.5 + (n % 4) * 0.5).alias("speed"), ((s % 3) / 2.0).alias("volume"), F.lit(1.0).alias("opacity"),
        F.when(p % 2 == 0, g.full()).otherwise(g.scaled_full(0.8)).alias("crop_start"), g.scaled_full(0.7 + (s % 3) * 0.1).alias("crop_end"),
        pick(["linear", "easeIn", "easeOut", "easeInOut"], n).alias("easing"), F.when(p % 3 != 0, change).alias("transition"),
        color.grade(0.0, 1.0 + (p % 3) * 0.1, 1.0, 0.0).alias("grade"), ((p % 4) * 0.1).alias("vignette"), F.lit(0.0).alias("grain"),
        F.when(s % 7 == 0, "fit").otherwise("fill").alias("fit"), s.alias("supp"))


def clip_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Five assets for every timeline."""
    orders = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("project_id")).distinct()
    a = F.col("asset_id")
    return orders.withColumn("asset_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")))).select(
        "project_id", "asset_id", F.when((a + F.col("project_id")) % 2 == 0, "video").otherwise("image").alias("kind"), (0.6 + a * 0.4).alias("aspect"), (a * 0.6).alias("asset_seconds"),
        F.when(a % 2 == 0, g.rect(a / 10.0, 0.2, 0.3, 0.4)).alias("region"))


def instants(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    every = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("project_id"), ((F.col("l_suppkey") % 40) * 0.11).alias("t"))
    return (every.repartition("project_id") if whole else every).distinct()


def overlays(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as overlays of their own timeline."""
    o = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        o.alias("project_id"), o.alias("overlay_id"), (F.col("o_custkey") % 5).alias("asset_id"), ((F.col("o_custkey") % 20) * 0.1).alias("start"),
        ((F.col("o_custkey") % 20) * 0.1 + 0.5 + (o % 10) * 0.3).alias("end"), g.rect(0.36, 0.855, 0.28, 0.075).alias("frame"), F.lit(0.92).alias("opacity"))


def text_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as text layers of their own timeline."""
    o = F.col("o_orderkey")
    pick = lambda names, e: F.get(F.array(*[F.lit(v) for v in names]), (e % len(names)).cast("int"))
    start = (F.col("o_custkey") % 15) * 0.1
    return table(spark, folder, "orders").select(
        o.alias("project_id"), o.alias("layer_id"), F.concat(F.lower("o_orderpriority"), F.lit(" of "), F.col("o_orderstatus"), F.lit("\nline two")).alias("text"),
        start.alias("start"), (start + 0.6 + (o % 7) * 0.4).alias("end"), pick(["none", "fadeIn", "popIn", "slideUp", "slideDown", "wordByWord", "typeOn"], o).alias("entry"),
        pick(["none", "fadeOut", "popOut", "slideDown"], F.expr("o_orderkey div 7")).alias("exit"), (o % 2 == 0).alias("all_caps"),
        F.when(o % 5 == 0, F.array(*[F.lit(i * 0.2) for i in range(5)])).alias("word_starts"))


def audio_clips(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as audio clips of the customer's project."""
    o, cents = F.col("o_orderkey"), F.floor("o_totalprice")
    pick = lambda names, e: F.get(F.array(*[F.lit(v) for v in names]), (e % len(names)).cast("int"))
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("project_id"), o.alias("clip_id"), (o % 5).alias("asset_id"), pick(["music", "voice", "effect"], o).alias("role"),
        ((cents % 200) / 10.0).alias("start"), (0.5 + (o % 40) / 10.0).alias("duration"), (0.2 + (o % 9) / 10.0).alias("volume"), ((o % 4) / 10.0).alias("fade_in"),
        ((o % 6) / 10.0).alias("fade_out"), (o % 17 == 0).alias("muted"), ((o % 3) / 10.0).alias("source_start"))


def edit_log(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events as an edit log over five clips."""
    rows = _ordered_events(spark, folder, ["event_type", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = (F.when(F.col("event_type") == "click", "setClipVolume").when(F.col("event_type") == "view", "trimClip").when(F.col("event_type") == "purchase", "undo")
            .when(F.col("event_type") == "error", "redo").otherwise("moveClip"))
    return rows.select(
        F.col("user_id").alias("project_id"), F.col("frame_idx").alias("seq"), kind.alias("kind"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("entity_id"),
        F.col("value").cast("string").alias("new_value"), F.format_string("%d", k).alias("old_value"), (k % 5).alias("index"), (F.expr("0L") + F.floor(k / 5) % 5).alias("to_index"), "ts",
        F.when(k % 4 != 0, F.expr("frame_idx div 8")).alias("gesture"),
        F.when(k % 7 == 0, "trim:c9").otherwise(F.concat(F.when(kind == "setClipVolume", "clipvol:c").otherwise("trim:c"), (k % 3).cast("string"))).alias("gesture_key"))


def edit_clips(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "events").select(F.col("user_id").alias("project_id")).distinct()
    return users.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("clip_id", F.concat(F.lit("c"), F.col("pos").cast("string")))


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation as transcript segments of one audio clip, which ends inside the last turn."""
    turn = F.col("turn")
    turns = table(spark, folder, "conversations")
    seconds = turns.groupBy("conv_id").agg((F.max("turn") * 2.5 + 1.0).alias("_seconds"))
    return turns.join(seconds, "conv_id").select(
        F.col("conv_id").alias("project_id"), turn.alias("segment_id"), F.regexp_replace("text", r"[\n\t]", " ").alias("text"), (turn * 2.5).alias("start"), (turn * 2.5 + 2.2).alias("end"),
        F.lit(None).cast("array<double>").alias("word_starts"), F.lit(0.5).alias("clip_start"), F.col("_seconds").alias("clip_seconds"), F.lit(1.0).alias("clip_source_start"),
        (F.col("_seconds") + 0.3).alias("timeline_seconds"))


def templates(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as saved templates: the text is the title, language and source are the tags."""
    d = F.col("doc_id")
    words = F.filter(F.split(F.regexp_replace("text", r"[\n\t]", " "), " "), lambda w: w != "")
    return table(spark, folder, "documents").select(
        F.concat(F.lit("tpl-"), (d % 900).cast("string")).alias("id"), F.array_join(words, " ").alias("title"), F.array("lang", "source").alias("tags"),
        (d % 3 == 0).alias("isBuiltIn"), (F.col("n_chars") / 100.0).alias("duration"), d.alias("doc_id"))


def projects(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        o.alias("project_id"), F.concat_ws(" ", "o_orderpriority", F.col("o_custkey").cast("string")).alias("title"), F.col("o_orderdate").alias("modified_at"),
        (o % 6 == 0).alias("is_favorite"), F.lit(1080).alias("canvas_w"), F.when(o % 2 == 0, 1920).otherwise(1350).alias("canvas_h"))
