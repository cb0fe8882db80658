"""Edit logs: coalescing gestures, undo and redo, and replay.

``log(project_id, seq, kind, entity_id, new_value, old_value)`` with dense ``seq`` per project;
``kind`` is an edit name, ``undo`` or ``redo``. Clip order edits carry ``index``/``to_index``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlens.operators.ordered import running_sum, walk_in_order, with_neighbours
from cutlens.session import cut_lineage

PROJECT = ["project_id"]

# Edits that merge with the one before on the same entity, and their key prefix. Fixed values.
MERGING = {
    "trimClip": "trim", "setClipCrop": "crop", "setClipGrade": "grade", "setClipEffects": "effects", "setClipVolume": "clipvol",
    "setClipSpeed": "speed", "setTextFrame": "textframe", "setTextTiming": "texttime", "setTextContent": "textcontent",
    "setAudioVolume": "audiovol", "setAudioFades": "audiofade", "retimeAudioClip": "audiotime", "setOverlayFrame": "overlayframe",
}
STRUCTURAL = ["insertClip", "deleteClip", "moveClip", "splitClip"]


def coalescing_key(kind: Column, entity: Column) -> Column:
    """Null for edits that never merge."""
    table = F.create_map(*[F.lit(x) for pair in MERGING.items() for x in pair])
    prefix = F.try_element_at(table, kind)
    return F.when(prefix.isNotNull(), F.concat_ws(":", prefix, entity.cast("string")))


def coalesce_edits(log: DataFrame) -> DataFrame:
    """One row per step: an edit joins the one before it if both have the key of the gesture that is open; the step
    keeps the first old value and the last new one. ``gesture`` (an id, null when none is open) and
    ``gesture_key`` tell which gesture a row was made in. An undo closes its gesture. Without an open gesture, or
    without the columns, an edit is a step of its own."""
    key = coalescing_key(F.col("kind"), F.col("entity_id"))
    if "gesture" in log.columns:
        # only undos inside gestures, one row a gesture
        closed = log.filter("kind = 'undo' AND gesture IS NOT NULL").groupBy("project_id", "gesture").agg(F.min("seq").alias("_closed"))
        tagged = log.join(closed, ["project_id", "gesture"], "left")
        open_ = F.coalesce((F.col("gesture_key") == key) & (F.col("_closed").isNull() | (F.col("seq") < F.col("_closed"))) & F.col("gesture").isNotNull(), F.lit(False))
    else:
        tagged, open_ = log, F.lit(False)
    keyed = tagged.withColumn("_key", key).withColumn("_open", open_)
    starts = with_neighbours(keyed, PROJECT, "seq", 1, 0, lambda w: {"_same": F.col("_open") & F.coalesce(F.col("_key") == F.lag("_key").over(w), F.lit(False))})
    grouped = running_sum(starts, PROJECT, "seq", {"_group": F.when(F.col("_same"), 0).otherwise(1).cast("bigint")})
    extra = [c for c in ("index", "to_index", "amount") if c in log.columns]
    return grouped.groupBy("project_id", "_group").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("merged"),
        F.first("kind").alias("kind"), F.first("entity_id").alias("entity_id"),
        F.max_by("new_value", "seq").alias("new_value"), F.min_by("old_value", "seq").alias("old_value"),
        *[F.max_by(c, "seq").alias(c) for c in extra],
    ).withColumn("step", F.col("_group") - 1).drop("_group")


def _depths(rows: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
    """Undo depth after every step; undo and redo do nothing on an empty stack."""
    done, undone = (state["done"], state["undone"]) if state else (0, 0)
    out = []
    for kind in rows["kind"]:
        if kind == "undo":
            moved = min(1, done)
            done, undone = done - moved, undone + moved
        elif kind == "redo":
            moved = min(1, undone)
            done, undone = done + moved, undone - moved
        else:
            done, undone = done + 1, 0
        out.append(done)
    return rows[["step"]].assign(depth=out), {"done": done, "undone": undone}


def undo_depths(steps: DataFrame, rows_per_call: int = 20_000) -> DataFrame:
    schema = f"project_id {dict(steps.dtypes)['project_id']}, step bigint, depth bigint"
    return walk_in_order(steps.select("project_id", "step", "kind"), PROJECT, "step", _depths, schema, rows_per_call)


def live_edits(log: DataFrame) -> DataFrame:
    """The coalesced edits in force after every undo and redo.

    An edit at stack depth d is in force when d is at most the final depth and no later edit took
    that depth, so one aggregate per (project, depth) finds them.
    """
    steps = cut_lineage(coalesce_edits(log))
    depths = cut_lineage(undo_depths(steps))
    final = depths.groupBy("project_id").agg(F.max_by("depth", "step").alias("_final"))
    done = steps.join(depths, ["project_id", "step"]).filter(~F.col("kind").isin("undo", "redo"))
    tops = done.groupBy("project_id", "depth").agg(F.max("step").alias("step")).join(final, "project_id").filter("depth <= _final")
    return done.join(tops.select("project_id", "step"), ["project_id", "step"], "left_semi")


def latest_values(live: DataFrame) -> DataFrame:
    """Current value of every edited field: the last edit in force per entity and kind."""
    fields = live.filter(~F.col("kind").isin(*STRUCTURAL))
    return fields.groupBy("project_id", "entity_id", "kind").agg(
        F.max_by("new_value", "step").alias("value"), F.min_by("old_value", "step").alias("original"), F.count(F.lit(1)).alias("edits"))


def _reorder(rows: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
    """Clip order after structural edits; the first row of a project brings the initial order."""
    clips = state["clips"] if state else []
    for r in rows.itertuples(index=False):
        if r.kind == "start":
            clips = [[c, [[c, None]]] for c in r.initial]
        elif r.kind == "insertClip":
            clips.insert(min(int(r.index), len(clips)), [r.entity_id, [[r.entity_id, None]]])
        elif r.kind == "deleteClip" and int(r.index) < len(clips):
            clips.pop(int(r.index))
        elif r.kind == "moveClip" and int(r.index) < len(clips):
            moved = clips.pop(int(r.index))
            clips.insert(min(int(r.to_index), len(clips)), moved)
        elif r.kind == "splitClip":
            at = next((i for i, c in enumerate(clips) if c[0] == r.entity_id), None)
            if at is not None:
                line = [[c, int(r.step) if until is None else until] for c, until in clips[at][1]]
                clips.insert(at + 1, [r.new_value, [[r.new_value, None], *line]])
    # the order so far; the caller keeps the one of the last call
    return pd.DataFrame({"step": [int(rows["step"].iloc[-1])], "clips": [[{"clip_id": c, "line": [{"source_id": s, "until_step": u} for s, u in l]} for c, l in clips]]}), {"clips": clips}


def replay_order(live: DataFrame, clips: DataFrame) -> DataFrame:
    """Clip order after all structural edits in force: ``(project_id, pos, clip_id, line)``.

    ``clips(project_id, pos, clip_id)`` is the initial order. ``line`` lists the clips a split tail
    descends from and the step until which it shared their edits. ``index``/``to_index`` position
    inserts, deletes and moves; ``new_value`` of a split is the id of its tail.
    """
    start = clips.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("pos", "clip_id"))).alias("_c")).select(
        "project_id", F.lit(-1).cast("bigint").alias("step"), F.lit("start").alias("kind"), F.lit(None).cast("string").alias("entity_id"),
        F.lit(None).cast("string").alias("new_value"), F.lit(None).cast("bigint").alias("index"), F.lit(None).cast("bigint").alias("to_index"),
        F.transform("_c", lambda c: c["clip_id"].cast("string")).alias("initial"))
    moves = live.filter(F.col("kind").isin(*STRUCTURAL)).select(
        "project_id", "step", "kind", F.col("entity_id").cast("string").alias("entity_id"), F.col("new_value").cast("string").alias("new_value"),
        F.col("index").cast("bigint").alias("index"), F.col("to_index").cast("bigint").alias("to_index"), F.lit(None).cast("array<string>").alias("initial"))
    rows = start.unionByName(moves.join(start.select("project_id"), "project_id", "left_semi")).withColumn("_at", F.col("step") + 1)
    line = "array<struct<source_id:string,until_step:bigint>>"
    schema = f"project_id {dict(clips.dtypes)['project_id']}, step bigint, clips array<struct<clip_id:string,line:{line}>>"
    orders = walk_in_order(rows, PROJECT, "_at", _reorder, schema)
    last = orders.groupBy("project_id").agg(F.max_by("clips", "step").alias("clips"))
    return last.select("project_id", F.posexplode("clips").alias("pos", "_c")).select("project_id", "pos", F.col("_c.clip_id").alias("clip_id"), F.col("_c.line").alias("line"))


def replay_edits(log: DataFrame, clips: DataFrame) -> DataFrame:
    """Current clips of every project with the latest value per edited field as a map."""
    live = live_edits(log)
    order = cut_lineage(replay_order(live, clips))
    sources = order.select("project_id", "pos", "clip_id", F.explode("line").alias("s"))
    fields = live.filter(~F.col("kind").isin(*STRUCTURAL)).select(
        "project_id", F.col("entity_id").cast("string").alias("source_id"), "kind", "step", F.col("new_value").cast("string").alias("value"))
    shared = sources.select("project_id", "pos", "clip_id", "s.*").join(fields, ["project_id", "source_id"]).filter(
        F.col("until_step").isNull() | (F.col("step") < F.col("until_step")))
    latest = shared.groupBy("project_id", "pos", "clip_id", "kind").agg(F.max_by("value", "step").alias("value"))
    maps = latest.groupBy("project_id", "pos", "clip_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "value"))).alias("fields"))
    return order.drop("line").join(maps.drop("clip_id"), ["project_id", "pos"], "left")
