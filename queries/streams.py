"""Streaming operators run over the event table as a file stream, to the end of the data.

Windows the watermark has not passed stay open, so the SQL leaves them out as well.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlens.session import shared_folder
from cutlens.sources import adapters as A
from cutlens.streaming import streams
from queries.common import MARKED, r6, registry, s6

JOBS, SQL, register = registry()


def _events(spark: SparkSession, sf: str) -> DataFrame:
    schema = A.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is and return what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda df, batch: df.write.mode("append").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@register("stream_frames", "SELECT user_id AS video_id, event_id AS frame_idx FROM events WHERE event_id % 8 = 0")
def _(spark, sf):
    frames = _events(spark, sf).select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_idx"), "ts")
    return _drain(streams.stream_frames(frames, 8)).select("video_id", "frame_idx")


@register("stream_cuts", f"""WITH {MARKED}, n AS (SELECT video_id, max(frame_idx) AS m, max(ts) AS last FROM frames GROUP BY 1)
SELECT video_id, frame_idx, {s6('least(0.98, 0.62 + (ratio - 3) / 8)', 'confidence')} FROM marked JOIN n USING (video_id) WHERE is_cut AND (frame_idx <= m - 2 OR last + INTERVAL 20 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)""")
def stream_cuts(spark, sf):
    """The last two frames of a video stay open until the watermark is well past them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    landed = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    A._ordered_events(spark, sf, ["value"]).select(
        F.col("user_id").alias("video_id"), "frame_idx", (F.col("frame_idx") / 30.0).alias("t"), (F.col("value") / 500).alias("content_value"), F.col("ts").cast("timestamp").alias("ts")).write.parquet(landed)
    frames = spark.readStream.schema("video_id bigint, frame_idx bigint, t double, content_value double, ts timestamp").parquet(landed)
    return _drain(streams.stream_cuts(frames, idle_ms=20 * 86_400_000, delay="1 hour")).select("video_id", "frame_idx", r6("confidence").alias("confidence"))


@register("stream_energy", f"""WITH w AS (SELECT user_id AS track_id, date_trunc('day', ts) AS d, sqrt(avg(value * value)) AS rms, count(*) AS n FROM events GROUP BY 1, 2)
SELECT track_id, CAST(epoch(d) AS BIGINT) AS start_s, {s6('rms', 'rms')}, n FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(spark, sf):
    samples = _events(spark, sf).select(F.col("user_id").alias("track_id"), "ts", F.col("value").alias("x"))
    return _drain(streams.stream_energy(samples, "1 day", "1 hour")).select("track_id", F.unix_timestamp("start").alias("start_s"), r6("rms").alias("rms"), "n")


_SESSION = """s AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN coalesce(ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) >= INTERVAL {gap}, true) THEN 1 ELSE 0 END AS fresh FROM e))"""


@register("stream_text_sessions", "WITH e AS (SELECT * FROM events), " + _SESSION.format(key="user_id", gap="2 HOUR") + """
SELECT user_id AS video_id, epoch_us(min(ts)) AS start_us, count(*) AS hits, arg_max(event_type, struct_pack(l := length(event_type), t := event_type)) AS longest FROM s GROUP BY user_id, g
HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(spark, sf):
    hits = _events(spark, sf).select(F.col("user_id").alias("video_id"), "ts", F.col("event_type").alias("text"))
    return _drain(streams.stream_text_sessions(hits, "2 hours", "1 hour")).select("video_id", F.unix_micros("start").alias("start_us"), "hits", "longest")


@register("stream_edit_compaction", "WITH e AS (SELECT * FROM events), " + _SESSION.format(key="user_id, event_type", gap="1 DAY") + f"""
SELECT user_id AS project_id, event_type AS entity_id, epoch_us(min(ts)) AS start_us, {s6('arg_max(value, event_id)', 'value')}, max(event_id) AS seq, count(*) AS edits FROM s GROUP BY user_id, event_type, g
HAVING max(ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(spark, sf):
    log = _events(spark, sf).select(F.col("user_id").alias("project_id"), F.col("event_type").alias("entity_id"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("new_value"))
    done = _drain(streams.stream_edit_compaction(log, "1 day", "1 hour"))
    return done.select("project_id", "entity_id", F.unix_micros("start").alias("start_us"), r6("value").alias("value"), "seq", "edits")


@register("stream_stage_progress", f"SELECT user_id AS run_id, event_type AS stage, epoch_us(max(ts)) AS at_us, {s6('arg_max(value, ts)', 'fraction')} FROM events GROUP BY 1, 2")
def _(spark, sf):
    progress = _events(spark, sf).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), "ts", F.lit("running").alias("status"), F.col("value").alias("fraction"))
    seen = _drain(streams.stream_stage_progress(progress), "update")
    # update mode may write a stage more than once; its newest row counts
    return seen.groupBy("run_id", "stage").agg(F.max("ts").alias("ts"), F.max_by("fraction", "ts").alias("fraction")).select(
        "run_id", "stage", F.unix_micros("ts").alias("at_us"), r6("fraction").alias("fraction"))
