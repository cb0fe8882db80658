"""Streaming operators. Each takes a streaming DataFrame with an event-time column ``ts`` and
returns one; the caller chooses source, sink, trigger and checkpoint. Rows later than the
watermark are dropped.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cutlens.functions import constants as K


def stream_frames(frames: DataFrame, stride: int = 1, delay: str = "10 seconds") -> DataFrame:
    """Every ``stride``-th frame of a frame stream, with the watermark the later stages use."""
    return frames.withWatermark("ts", delay).filter(F.col("frame_idx") % stride == 0)


def find_cuts(known: dict, at: int, final: bool, passed: int = 0) -> tuple[list, int, int]:
    """Cuts among ``known`` frames (index -> time, value, event time in ms) from ``at`` on, the first frame
    that still waits for the two frames after it, and the first one still needed as a neighbour.

    A missing frame is waited for until the watermark ``passed`` is beyond the frame after it (or the video
    is over); from then on the frames around the gap are neighbours, as in the batch form.
    """
    reach = K.ROLLING_ROWS
    order = sorted(known)
    place = bisect.bisect_left(order, at)

    def settled(k: int) -> bool:
        return final or order[k] == (order[k - 1] + 1 if k else 0) or known[order[k]][2] < passed

    cuts = []
    while place < len(order) and settled(place):
        ahead = range(place + 1, place + reach + 1)
        if not final and not all(k < len(order) and settled(k) for k in ahead):
            break
        # summed side by side as in the batch form: the last bit decides on a ratio of just ADAPTIVE_RATIO
        before, after = ([known[k][1] for k in side] for side in (order[max(0, place - reach):place], order[place + 1:place + reach + 1]))
        mean = (sum(before) + sum(after)) / (len(before) + len(after)) if before or after else 0.0
        t, value, _ = known[order[place]]
        if value >= K.MIN_CONTENT_VALUE and mean > 1e-6 and value / mean >= K.ADAPTIVE_RATIO:
            ratio = value / mean
            cuts.append((order[place], t, ratio, min(0.98, 0.62 + (ratio - K.ADAPTIVE_RATIO) / 8)))
        place += 1
    if place:
        at = max(at, order[place - 1] + 1)
    return cuts, at, order[max(0, place - reach)] if order else at


class CutProcessor(StatefulProcessor):
    """Adaptive cut detection with two frames of context on either side.

    Frames may arrive out of order inside the watermark: they wait in state until both neighbours
    on each side are there. Once the watermark is ``idle_ms`` past a video's last frame, its end
    is flushed.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "frame_idx bigint", "t double, value double, ts bigint")
        self.next = handle.getValueState("next", "frame_idx bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived, newest = {}, 0
        for batch in rows:
            newest = max(newest, int(batch["ts"].max().timestamp() * 1000))
            columns = (batch[c] for c in ("frame_idx", "t", "content_value", "ts"))
            arrived.update({int(i): (float(t), float(v), int(ts.timestamp() * 1000)) for i, t, v, ts in zip(*columns)})
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield self._ready(key, arrived, timerValues.getCurrentWatermarkInMs(), final=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._ready(key, {}, timerValues.getCurrentWatermarkInMs(), final=True)

    def _ready(self, key, arrived: dict, passed: int, final: bool) -> pd.DataFrame:
        """Judge every frame whose context is complete; only the unfinished tail stays in state."""
        stored = {int(k[0]): (float(v[0]), float(v[1]), int(v[2])) for k, v in self.rows.iterator()}
        at = int(self.next.get()[0]) if self.next.exists() else 0
        arrived = {i: row for i, row in arrived.items() if i >= at}
        cuts, at, needed = find_cuts(stored | arrived, at, final, passed)
        for old in [i for i in stored if i < needed]:
            self.rows.removeKey((old,))
        for i, row in arrived.items():
            if i >= needed:
                self.rows.updateValue((i,), row)
        self.next.update((at,))
        return pd.DataFrame([(*key, *cut) for cut in cuts], columns=["video_id", "frame_idx", "t", "ratio", "confidence"])

    def close(self) -> None:
        pass


def stream_cuts(frames: DataFrame, idle_ms: int = 10_000, delay: str = "10 seconds") -> DataFrame:
    """Cuts of each video as soon as their two following frames have arrived.

    ``frames(video_id, frame_idx, t, content_value, ts)`` with ``frame_idx`` from 0. A missing frame
    delays what follows until the watermark has passed the gap. Needs the RocksDB state store.
    """
    video = dict(frames.dtypes)["video_id"]
    return frames.withWatermark("ts", delay).groupBy("video_id").transformWithStateInPandas(
        statefulProcessor=CutProcessor(idle_ms), outputStructType=f"video_id {video}, frame_idx bigint, t double, ratio double, confidence double",
        outputMode="Append", timeMode="EventTime")


def stream_energy(samples: DataFrame, width: str = "250 milliseconds", delay: str = "1 second") -> DataFrame:
    """RMS per tumbling window of ``samples(track_id, ts, x)``."""
    return (
        samples.withWatermark("ts", delay).groupBy("track_id", F.window("ts", width))
        .agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count(F.lit(1)).alias("n"))
        .select("track_id", F.col("window.start").alias("start"), "rms", "n")
    )


def stream_text_sessions(hits: DataFrame, gap: str = "600 milliseconds", delay: str = "2 seconds") -> DataFrame:
    """Stretches of on-screen text without a silence longer than ``gap``."""
    return (
        hits.withWatermark("ts", delay).groupBy("video_id", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("hits"), F.max_by("text", F.struct(F.length("text"), "text")).alias("longest"))
        .select("video_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "hits", "longest")
    )


def stream_edit_compaction(log: DataFrame, gap: str = "1500 milliseconds", delay: str = "5 seconds") -> DataFrame:
    """One save per burst of edits: the last value of each entity in the burst."""
    return (
        log.withWatermark("ts", delay).groupBy("project_id", "entity_id", F.session_window("ts", gap))
        .agg(F.max_by("new_value", "seq").alias("value"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("edits"))
        .select("project_id", "entity_id", F.col("session_window.start").alias("start"), "value", "seq", "edits")
    )


def stream_stage_progress(progress: DataFrame) -> DataFrame:
    """Latest state per run and stage; use update mode. ``progress(run_id, stage, ts, status, fraction)``."""
    return progress.groupBy("run_id", "stage").agg(F.max(F.struct("ts", "status", "fraction")).alias("_s")).select(
        "run_id", "stage", F.col("_s.ts").alias("ts"), F.col("_s.status").alias("status"), F.col("_s.fraction").alias("fraction"))
