"""Timelines, audio mixes, quality and edit logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlens.functions import constants as K
from cutlens.operators import bind, edits, mix, quality, timeline
from cutlens.sources import adapters as A
from cutlens.session import cut_lineage, landed
from queries.common import r6, rect6, registry, s6

JOBS, SQL, register = registry()

CLIPS = """clips0 AS (SELECT l_orderkey AS project_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey AS p, l_suppkey AS s, l_linenumber AS n,
  CASE WHEN l_partkey % 50 <> 0 THEN l_partkey % 5 END AS asset_id, l_quantity * 37e-3 AS raw FROM lineitem),
framed AS (SELECT *, greatest(1, CAST(round(raw * 30) AS BIGINT)) AS fr FROM clips0),
clips AS (SELECT *, coalesce(sum(fr) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 30e0 AS start, fr / 30e0 AS duration, (s % 10) / 10e0 AS source_start, 0.5e0 + (n % 4) * 0.5e0 AS speed, (s % 3) / 2e0 AS volume,
  CASE WHEN p % 2 = 0 THEN 0e0 ELSE 0.5e0 - 0.8e0 / 2 END AS csx, CASE WHEN p % 2 = 0 THEN 1e0 ELSE 0.8e0 END AS csw, 0.7e0 + (s % 3) * 0.1e0 AS cew, 0.5e0 - (0.7e0 + (s % 3) * 0.1e0) / 2 AS cex, n % 4 AS easing,
  CASE WHEN p % 3 <> 0 THEN ['cut','dissolve','push','fadeToBlack'][s % 4 + 1] END AS tk, CASE WHEN p % 3 <> 0 THEN CASE WHEN s % 4 = 0 THEN 0e0 ELSE 0.2e0 + (p % 5) * 0.1e0 END END AS td, s % 7 = 0 AS fit,
  count(*) OVER (PARTITION BY project_id) AS n_clips FROM framed)"""
INST = "inst AS (SELECT DISTINCT l_orderkey AS project_id, (l_suppkey % 40) * 0.11e0 AS t FROM lineitem)"


def _clips(spark, sf, *columns):
    """Clips laid out, with their places and ``columns``, or all."""
    laid = timeline.relayout(A.clips(spark, sf))
    return landed(laid.select("project_id", "pos", "start", "duration", *columns) if columns else laid)


@register("relayout", f"WITH {CLIPS} SELECT project_id, pos, {s6('start', 'start_t')}, {s6('duration', 'seconds')} FROM clips")
def relayout(spark, sf):
    return timeline.relayout(A.clips(spark, sf)).select("project_id", "pos", r6("start").alias("start_t"), r6("duration").alias("seconds"))


@register("timeline_duration", f"""WITH {CLIPS}, e AS (SELECT project_id, start + duration AS x FROM clips UNION ALL SELECT o_orderkey, (o_custkey % 15) * 0.1e0 + 0.6e0 + (o_orderkey % 7) * 0.4e0 FROM orders UNION ALL SELECT o_custkey, (CAST(floor(o_totalprice) AS BIGINT) % 200) / 10.0 + (0.5e0 + (o_orderkey % 40) / 10.0) FROM orders
  UNION ALL SELECT o_orderkey, (o_custkey % 20) * 0.1e0 + 0.5e0 + (o_orderkey % 10) * 0.3e0 FROM orders), x AS (SELECT project_id, max(x) AS x FROM e GROUP BY 1)
SELECT o_orderkey AS project_id, {s6('greatest(0, coalesce(x, 0))', 'seconds')} FROM orders LEFT JOIN x ON x.project_id = o_orderkey""")
def _(spark, sf):
    projects = A.projects(spark, sf)
    d = timeline.timeline_duration(_clips(spark, sf), A.text_layers(spark, sf), A.audio_clips(spark, sf), A.overlays(spark, sf), projects)
    return d.select("project_id", r6("timeline_seconds").alias("seconds"))


SHOWN = ["clip_id", "transition", "asset_id", "source_start", "speed", "opacity", "crop_start", "crop_end", "easing", "fit"]


# the clip under each instant: the covering one, the first before the start, the last after the end
PLACED = CLIPS + ",\n" + INST + """,
sided AS (SELECT *, lag(pos) OVER w AS fp, lead(pos) OVER w AS np, lead(start) OVER w AS ns, lead(tk) OVER w AS ntk, lead(td) OVER w AS ntd FROM clips WINDOW w AS (PARTITION BY project_id ORDER BY pos)),
placed AS (SELECT i.t, c.* FROM inst i JOIN sided c ON c.project_id = i.project_id AND ((i.t >= c.start AND i.t < c.start + c.duration) OR (c.np IS NULL AND i.t >= c.start + c.duration) OR (c.fp IS NULL AND i.t < c.start)) QUALIFY row_number() OVER (PARTITION BY i.project_id, i.t ORDER BY c.pos) = 1),
staged AS (SELECT *, tk IS NOT NULL AND tk <> 'cut' AND td > 0 AND pos > 0 AND t >= start - td / 2 AND t < start + td / 2 AS entering FROM placed),
trans AS (SELECT *, coalesce(NOT coalesce(entering, false) AND ntk IS NOT NULL AND ntk <> 'cut' AND ntd > 0 AND t >= ns - ntd / 2, false) AS leaving FROM staged)"""


@register("active_at", f"WITH {PLACED} SELECT project_id, {s6('t', 't')}, pos FROM placed")
def _(spark, sf):
    return timeline.active_clip(_clips(spark, sf, "clip_id", "transition"), A.instants(spark, sf)).filter("clip IS NOT NULL").select("project_id", r6("t").alias("t"), F.col("clip.pos").alias("pos"))


@register("transition_window", f"""WITH {PLACED} SELECT project_id, {s6('t', 't')}, CASE WHEN entering THEN tk ELSE ntk END AS kind, {s6('least(1, greatest(0, CASE WHEN entering THEN (t - (start - td / 2)) / td ELSE (t - (ns - ntd / 2)) / ntd END))', 'progress')},
  CASE WHEN entering THEN fp ELSE pos END AS from_pos FROM trans WHERE entering OR leaving""")
def _(spark, sf):
    w = timeline.transition_window(_clips(spark, sf, "clip_id", "transition"), A.instants(spark, sf)).filter("stage IS NOT NULL")
    return w.select("project_id", r6("t").alias("t"), F.col("stage.kind").alias("kind"), r6("stage.progress").alias("progress"), F.substring_index("stage.from_clip", "-", -1).cast("bigint").alias("from_pos"))


@register("clip_state", f"""WITH {PLACED}, l AS (SELECT *, least(duration, greatest(0, t - start)) AS lt, least(1, greatest(0, least(duration, greatest(0, t - start)) / duration)) AS u FROM trans),
e AS (SELECT *, CASE easing WHEN 0 THEN u WHEN 1 THEN u * u WHEN 2 THEN u * (2 - u) ELSE CASE WHEN u < 0.5 THEN 2 * u * u ELSE -1 + (4 - 2 * u) * u END END AS q FROM l),
c AS (SELECT *, csw + (cew - csw) * q AS cw, csx + (cex - csx) * q AS cx FROM e)
SELECT project_id, {s6('t', 't')}, pos, {s6('CASE WHEN asset_id IS NOT NULL THEN CASE WHEN fit THEN 1 ELSE least(cw, 1) END END', 'crop_w')}, {s6('CASE WHEN asset_id IS NOT NULL THEN CASE WHEN fit THEN 0 ELSE least(greatest(cx, 0), 1 - least(cw, 1)) END END', 'crop_x')},
  {s6('CASE WHEN asset_id IS NOT NULL THEN source_start + lt * speed END', 'source_t')}, CASE WHEN entering THEN tk WHEN leaving THEN ntk END AS transition FROM c""")
def clip_state(spark, sf):
    s = timeline.clip_state(_clips(spark, sf, *SHOWN), A.instants(spark, sf)).filter("clip_id IS NOT NULL")
    return s.select("project_id", r6("t").alias("t"), F.substring_index("clip_id", "-", -1).cast("bigint").alias("pos"), r6("crop.w").alias("crop_w"), r6("crop.x").alias("crop_x"), r6("source_t").alias("source_t"), "transition")


@register("overlay_state", f"""WITH {INST}, o AS (SELECT o_orderkey AS project_id, (o_custkey % 20) * 0.1e0 AS start, (o_custkey % 20) * 0.1e0 + 0.5e0 + (o_orderkey % 10) * 0.3e0 AS stop FROM orders)
SELECT i.project_id, {s6('t', 't')} FROM inst i JOIN o ON o.project_id = i.project_id AND t >= start AND t < stop""")
def _(spark, sf):
    return timeline.overlay_state(A.overlays(spark, sf), A.instants(spark, sf)).select("project_id", r6("t").alias("t"))


from queries.scalars import WORDS  # noqa: E402

WORDS_AT = WORDS.replace("start + (o_orderkey % 23) * 0.1e0 - 0.1e0 AS t, CASE entry", "inst.t, CASE entry").replace("ELSE 0.25 END AS xs FROM tl)", "ELSE 0.25 END AS xs FROM tl JOIN inst ON inst.project_id = o_orderkey AND inst.t >= start AND inst.t < stop)")


@register("text_state", f"WITH {INST}, {WORDS_AT}, top AS (SELECT *, max(opacity) OVER (PARTITION BY o_orderkey, t) AS m FROM wz) SELECT o_orderkey AS project_id, {s6('t', 't')}, CAST(i AS INT) AS word_idx, {s6('opacity', 'opacity')}, {s6('offset_y', 'offset_y')}, {s6('scale', 'scale')} FROM top WHERE m > 0.001")
def _(spark, sf):
    s = timeline.text_state(A.text_layers(spark, sf), A.instants(spark, sf))
    return s.select("project_id", r6("t").alias("t"), "word_idx", r6("state.opacity").alias("opacity"), r6("state.offset_y").alias("offset_y"), r6("state.scale").alias("scale"))


def _timeline_state(spark, sf):
    """Projects with too many rows for one task are cut into slices; the others are taken whole, so that rows are shuffled once."""
    crowd = A.crowded_timelines(spark, sf)

    def of(whole, how):
        some = lambda df: df if crowd is None else df.join(crowd, "project_id", how)
        clips = timeline.relayout(some(A.clips(spark, sf, whole)), whole=whole).select("project_id", "pos", "start", "duration", *SHOWN)
        return timeline.timeline_state(clips if whole else landed(clips), some(A.overlays(spark, sf)), some(A.text_layers(spark, sf)), some(A.instants(spark, sf, whole)), whole)

    found = of(True, "left_anti")
    return found if crowd is None else found.unionByName(of(False, "left_semi"))


@register("timeline_state", f"""WITH {PLACED.replace(CLIPS, CLIPS)}, {WORDS_AT}, top AS (SELECT *, max(opacity) OVER (PARTITION BY o_orderkey, t) AS m FROM wz),
items AS (SELECT project_id, 'clip' AS layer, 1 AS opacity FROM placed UNION ALL SELECT i.project_id, 'overlay', 0.92 FROM inst i JOIN orders o ON o_orderkey = i.project_id AND t >= (o_custkey % 20) * 0.1e0 AND t < (o_custkey % 20) * 0.1e0 + 0.5e0 + (o_orderkey % 10) * 0.3e0
  UNION ALL SELECT o_orderkey, 'word', opacity FROM top WHERE m > 0.001)
SELECT project_id, layer, count(*) AS items, {s6('sum(opacity)', 'opacity')} FROM items GROUP BY 1, 2""")
def timeline_state(spark, sf):
    s = _timeline_state(spark, sf).filter("item IS NOT NULL")
    return s.groupBy("project_id", "layer").agg(F.count(F.lit(1)).alias("items"), r6(F.sum("opacity")).alias("opacity"))


@register("adjacent_repeats", f"WITH {CLIPS} SELECT project_id, pos FROM (SELECT *, lag(asset_id) OVER (PARTITION BY project_id ORDER BY pos) AS q FROM clips) WHERE asset_id = q")
def _(spark, sf):
    return timeline.adjacent_repeats(A.clips(spark, sf)).select("project_id", "pos")


# scenes and beats on the same events: purchases end scenes, clicks are beats, .25 s apart on average
SCENES = """ev AS (SELECT user_id AS template_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000e0 AS t, event_id FROM events),
cutp AS (SELECT template_id, t AS e, row_number() OVER (PARTITION BY template_id ORDER BY t, event_id) - 1 AS i FROM ev WHERE event_type IN ('purchase', 'view')),
sc AS (SELECT template_id, i, coalesce(lag(e) OVER (PARTITION BY template_id ORDER BY i), 0) AS st, e FROM cutp), bt AS (SELECT template_id, t FROM ev WHERE event_type IN ('click', 'signup')),
nb AS (SELECT template_id, i, nt FROM (SELECT s.template_id, s.i, b.t AS nt, abs(b.t - s.e) AS gap, row_number() OVER (PARTITION BY s.template_id, s.i ORDER BY abs(b.t - s.e), b.t) AS rn FROM sc s JOIN bt b ON b.template_id = s.template_id) WHERE rn = 1 AND gap <= 0.12),
nr AS (SELECT sc.*, nt FROM sc LEFT JOIN nb USING (template_id, i))"""


def _scenes(spark, sf):
    from cutlens.operators.ordered import positions, with_neighbours

    b = A.beats(spark, sf).select(F.col("track_id").alias("template_id"), (F.col("t") / 2).alias("t"), "event_type")
    ends = cut_lineage(positions(b.filter("event_type IN ('purchase', 'view')").select("template_id", F.col("t").alias("end")), ["template_id"], ["end"], F.floor(F.col("end")), out="scene_idx"))
    scenes = with_neighbours(ends, ["template_id"], "scene_idx", 1, 0, lambda w: {"start": F.coalesce(F.lag("end").over(w), F.lit(0.0))})
    return scenes.select("template_id", "scene_idx", "start", "end"), b.filter("event_type IN ('click', 'signup')").select("template_id", "t")


@register("scene_durations", f"""WITH RECURSIVE {SCENES}, wk AS (SELECT template_id, CAST(-1 AS BIGINT) AS i, min(st) AS at_t FROM nr WHERE i = 0 GROUP BY 1 UNION ALL
  SELECT n.template_id, n.i, CASE WHEN n.nt > w.at_t + 2 / 30e0 THEN n.nt ELSE n.e END FROM wk w JOIN nr n ON n.template_id = w.template_id AND n.i = w.i + 1)
SELECT a.template_id, a.i AS scene_idx, {s6('a.at_t', 'boundary')}, {s6('greatest(2 / 30e0, round((a.at_t - b.at_t) * 30) / 30)', 'seconds')} FROM wk a JOIN wk b ON b.template_id = a.template_id AND b.i = a.i - 1""")
def scene_durations(spark, sf):
    scenes, beats = _scenes(spark, sf)
    return timeline.scene_durations(scenes, beats).select("template_id", "scene_idx", r6("boundary").alias("boundary"), r6("seconds").alias("seconds"))


@register("retime_to_beats", f"""WITH RECURSIVE {SCENES.replace('gap <= 0.12', 'gap <= 0.14')}, wk AS (SELECT template_id, CAST(-1 AS BIGINT) AS i, min(st) AS at_t, CAST(0 AS DOUBLE) AS sh FROM nr WHERE i = 0 GROUP BY 1 UNION ALL
  SELECT n.template_id, n.i, CASE WHEN n.nt IS NULL THEN n.e ELSE greatest(n.nt, w.at_t + 0.1e0) END, CASE WHEN n.nt IS NULL THEN 0 ELSE abs(greatest(n.nt, w.at_t + 0.1e0) - n.e) END FROM wk w JOIN nr n ON n.template_id = w.template_id AND n.i = w.i + 1),
d AS (SELECT a.template_id, a.i, n.e - n.st AS dur, greatest(0.1e0, round((a.at_t - b.at_t) * 30) / 30) AS nd, a.sh FROM wk a JOIN wk b ON b.template_id = a.template_id AND b.i = a.i - 1 JOIN nr n ON n.template_id = a.template_id AND n.i = a.i),
m AS (SELECT template_id, count(*) FILTER (sh > 0.001) AS moved, sum(sh) FILTER (sh > 0.001) AS tot, count(*) FILTER (abs(nd - dur) > 0.0005) AS ch FROM d GROUP BY 1)
SELECT d.template_id AS project_id, i AS pos, {s6('CASE WHEN abs(nd - dur) > 0.0005 THEN nd ELSE dur END', 'seconds')}, moved, {s6('tot / moved', 'mean_shift')} FROM d JOIN m USING (template_id) WHERE moved > 0 AND ch > 0""")
def _(spark, sf):
    scenes, beats = _scenes(spark, sf)
    clips = scenes.select(F.col("template_id").alias("project_id"), F.col("scene_idx").alias("pos"), F.col("scene_idx").alias("clip_id"), "start", (F.col("end") - F.col("start")).alias("duration"))
    r = timeline.retime_to_beats(clips, beats.withColumnRenamed("template_id", "project_id"))
    return r.select("project_id", "pos", r6("new_duration").alias("seconds"), "moved", r6("mean_shift").alias("mean_shift"))


@register("scratch_timeline", f"""WITH a AS (SELECT CAST(n_regionkey AS BIGINT) AS project_id, s_suppkey AS k, s_suppkey % 3 = 0 AS v, CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 8) * 0.5e0 ELSE 0 END AS secs, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) - 1 AS pos FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 9 <> 8),
d AS (SELECT *, greatest(1, CAST(round((CASE WHEN v AND secs > 0 THEN least(secs, 4) ELSE 2 END) * 30) AS BIGINT)) AS fr FROM a)
SELECT project_id, pos, k AS asset_id, {s6('coalesce(sum(fr) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 30e0', 'start_t')}, {s6('fr / 30e0', 'seconds')}, {s6('CASE WHEN pos % 2 = 0 THEN 1 ELSE 0.88 END', 'start_w')} FROM d""")
def _(spark, sf):
    s = timeline.scratch_timeline(A.assets(spark, sf))
    return s.select("project_id", "pos", "asset_id", r6("start").alias("start_t"), r6("duration").alias("seconds"), r6("crop_start.w").alias("start_w"))


CLIP_ASSETS = """ca AS (SELECT *, CASE WHEN (asset_id + project_id) % 2 = 0 THEN 'video' ELSE 'image' END AS kind, 0.6e0 + asset_id * 0.4e0 AS aspect, asset_id * 0.6e0 AS secs FROM clips WHERE asset_id IS NOT NULL)"""


@register("retarget_canvas", f"""WITH {CLIPS}, {CLIP_ASSETS}, w AS (SELECT *, CASE WHEN aspect > 1 + 1e-6 THEN 1 / aspect ELSE 1 END AS ww, CASE WHEN aspect < 1 - 1e-6 THEN aspect / 1 ELSE 1 END AS wh, asset_id % 2 = 0 AS has, cew / greatest(0.01, csw) AS zoom FROM ca),
x AS (SELECT *, least(greatest(CASE WHEN has THEN asset_id / 10e0 + 0.3e0 / 2 - 0.5 * ww ELSE (1 - ww) / 2 END, 0), 1 - ww) AS wx, greatest(0.62, least(1, zoom)) AS z FROM w)
SELECT project_id, pos, {s6('wx', 'start_x')}, {s6('ww', 'start_w')}, {s6('CASE WHEN zoom < 1 THEN least(greatest(wx + ww / 2 - ww * z / 2, 0), 1 - ww * z) ELSE wx END', 'end_x')}, {s6('CASE WHEN zoom < 1 THEN ww * z ELSE ww END', 'end_w')} FROM x""")
def _(spark, sf):
    r = timeline.retarget_canvas(A.clips(spark, sf), A.clip_assets(spark, sf), 1.0)
    return r.select("project_id", "pos", r6("new_start.x").alias("start_x"), r6("new_start.w").alias("start_w"), r6("new_end.x").alias("end_x"), r6("new_end.w").alias("end_w"))


@register("footage_shortfall", f"WITH {CLIPS}, {CLIP_ASSETS} SELECT project_id, pos, {s6('duration * speed', 'needed')}, {s6('secs - source_start', 'remaining')} FROM ca WHERE kind = 'video' AND secs > 0 AND duration * speed > secs - source_start + 0.05")
def _(spark, sf):
    return timeline.footage_shortfall(_clips(spark, sf, "clip_id", "asset_id", "source_start", "speed"), A.clip_assets(spark, sf)).select("project_id", "pos", r6("needed").alias("needed"), r6("left").alias("remaining"))


def _variation(kind: str, sql: str):
    @register(f"variation_{kind}", f"WITH {CLIPS}, b AS (SELECT *, CASE WHEN csw >= cew THEN csw ELSE cew END AS bw, CASE WHEN csw >= cew THEN csx ELSE cex END AS bx FROM clips), {sql}")
    def _(spark, sf):
        v = timeline.variation(_clips(spark, sf), kind)
        return v.select("project_id", "pos", F.col("transition.kind").alias("transition"), r6("transition.duration").alias("transition_seconds"), r6("crop_start.w").alias("start_w"), r6("crop_end.w").alias("end_w"), r6("grade.contrast").alias("contrast"), r6("vignette").alias("vignette"))


_variation("cinematic", f"""k AS (SELECT *, bw * 0.9e0 AS tw FROM b) SELECT project_id, pos, CASE WHEN pos = 0 THEN tk WHEN pos = n_clips - 1 THEN 'fadeToBlack' ELSE 'dissolve' END AS transition,
  {s6('CASE WHEN pos = 0 THEN td WHEN pos = n_clips - 1 THEN 0.6 ELSE least(0.6, greatest(0.3, duration * 0.35)) END', 'transition_seconds')}, {s6('CASE WHEN pos % 2 = 0 THEN bw ELSE tw END', 'start_w')}, {s6('CASE WHEN pos % 2 = 0 THEN tw ELSE bw END', 'end_w')}, 1.12e0 AS contrast, 0.28e0 AS vignette FROM k""")
_variation("punchy", f"""k AS (SELECT *, bw * 0.84e0 AS tw FROM b) SELECT project_id, pos, CASE WHEN pos = 0 THEN tk END AS transition, {s6('CASE WHEN pos = 0 THEN td END', 'transition_seconds')}, {s6('CASE WHEN pos % 2 = 0 THEN bw ELSE tw END', 'start_w')},
  {s6('CASE WHEN pos % 2 = 0 THEN tw ELSE bw END', 'end_w')}, 1.18e0 AS contrast, 0e0 AS vignette FROM k""")
_variation("minimal", f"""k AS (SELECT * FROM b) SELECT project_id, pos, CASE WHEN pos = 0 THEN tk END AS transition, {s6('CASE WHEN pos = 0 THEN td END', 'transition_seconds')}, {s6('bw', 'start_w')}, {s6('bw', 'end_w')}, 1e0 AS contrast, 0e0 AS vignette FROM k""")
_variation("alternateTransitions", f"""k AS (SELECT * FROM b) SELECT project_id, pos, CASE WHEN pos = 0 THEN tk ELSE ['dissolve', NULL, 'push', NULL, 'slide', 'zoomIn', NULL][(pos - 1) % 7 + 1] END AS transition,
  {s6('CASE WHEN pos = 0 THEN td ELSE [0.30, NULL, 0.32, NULL, 0.30, 0.36, NULL][(pos - 1) % 7 + 1] END', 'transition_seconds')}, {s6('csw', 'start_w')}, {s6('cew', 'end_w')}, {s6('1 + (p % 3) * 0.1', 'contrast')}, {s6('(p % 4) * 0.1', 'vignette')} FROM k""")


@register("clamp_edits", f"""WITH {CLIPS}, e AS (SELECT project_id, pos, pos % 2 = 0 AS lead_edge, (s % 13 - 6) / 5e0 AS delta FROM clips), j AS (SELECT c.*, lead_edge, delta, CASE WHEN (asset_id + c.project_id) % 2 = 0 THEN true ELSE false END AS video, asset_id * 0.6e0 AS secs FROM clips c JOIN e USING (project_id, pos)),
t AS (SELECT *, least(duration - 2 / 30e0, greatest(delta, CASE WHEN video AND asset_id IS NOT NULL THEN -source_start / greatest(0.01, speed) ELSE 0 END)) AS trim, CASE WHEN video AND asset_id IS NOT NULL THEN least(start + duration + delta, start + (secs - source_start) / greatest(0.01, speed)) ELSE start + duration + delta END AS stop FROM j)
SELECT project_id, pos, {s6('CASE WHEN lead_edge THEN duration - trim ELSE greatest(2 / 30e0, stop - start) END', 'new_duration')}, {s6('CASE WHEN lead_edge THEN CASE WHEN video AND asset_id IS NOT NULL THEN source_start + trim * speed ELSE 0 END ELSE source_start END', 'new_source_start')} FROM t""")
def _(spark, sf):
    clips = _clips(spark, sf)
    asked = clips.select("project_id", F.col("pos").alias("edit_id"), "clip_id", F.when(F.col("pos") % 2 == 0, "leading").otherwise("trailing").alias("edge"), ((F.col("supp") % 13 - 6) / 5.0).alias("delta"))
    r = timeline.clamp_edits(asked, clips, A.clip_assets(spark, sf))
    return r.select("project_id", F.col("edit_id").alias("pos"), r6("new_duration").alias("new_duration"), r6("new_source_start").alias("new_source_start"))


@register("clamp_layer_moves", f"""WITH l AS (SELECT o_orderkey, (o_custkey % 15) * 0.1e0 AS start, (o_custkey % 15) * 0.1e0 + 0.6e0 + (o_orderkey % 7) * 0.4e0 AS stop, o_orderkey % 3 AS a, (o_custkey % 21 - 10) / 4e0 AS d FROM orders)
SELECT o_orderkey AS layer_id, {s6('CASE a WHEN 0 THEN least(greatest(0, start + d), greatest(0, 3 - (stop - start))) WHEN 1 THEN least(greatest(0, start + d), stop - 0.2e0) ELSE start END', 'new_start')},
  {s6('CASE a WHEN 0 THEN least(greatest(0, start + d), greatest(0, 3 - (stop - start))) + (stop - start) WHEN 1 THEN stop ELSE greatest(start + 0.2e0, least(8, stop + d)) END', 'new_end')} FROM l""")
def _(spark, sf):
    layers = A.text_layers(spark, sf)
    o = F.col("o_orderkey")
    asked = A.table(spark, sf, "orders").select(o.alias("project_id"), o.alias("edit_id"), o.alias("layer_id"), F.when(o % 3 == 0, "move").when(o % 3 == 1, "leading").otherwise("trailing").alias("action"), ((F.col("o_custkey") % 21 - 10) / 4.0).alias("delta"))
    r = timeline.clamp_layer_moves(asked, layers, layers.select("project_id", F.lit(3.0).alias("timeline_seconds")))
    return r.select("layer_id", r6("new_start").alias("new_start"), r6("new_end").alias("new_end"))


@register("clamp_audio_moves", f"""WITH a AS (SELECT o_orderkey AS clip_id, (CAST(floor(o_totalprice) AS BIGINT) % 200) / 10e0 AS st, 0.5e0 + (o_orderkey % 40) / 10e0 AS du, (o_orderkey % 3) / 10e0 AS ss, o_orderkey % 3 AS act, (o_custkey % 21 - 10) / 4e0 AS d, (o_orderkey % 5) * 1.5e0 AS secs FROM orders),
t AS (SELECT *, least(du - 0.2e0, greatest(d, -ss)) AS trim, least(st + du + d, st + secs - ss) AS stop FROM a)
SELECT clip_id, {s6('CASE act WHEN 0 THEN greatest(0, st + d) WHEN 1 THEN greatest(0, st + trim) ELSE st END', 'new_start')}, {s6('CASE act WHEN 1 THEN du - trim WHEN 2 THEN greatest(0.2, stop - st) ELSE du END', 'new_duration')} FROM t""")
def _(spark, sf):
    audio = A.audio_clips(spark, sf)
    o = F.col("o_orderkey")
    asked = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), o.alias("edit_id"), o.alias("clip_id"), F.when(o % 3 == 0, "move").when(o % 3 == 1, "leading").otherwise("trailing").alias("action"), ((F.col("o_custkey") % 21 - 10) / 4.0).alias("delta"))
    pool = audio.select("project_id", "asset_id").distinct().withColumn("asset_seconds", F.col("asset_id") * 1.5)
    return timeline.clamp_audio_moves(asked, audio, pool).select("clip_id", r6("new_start").alias("new_start"), r6("new_duration").alias("new_duration"))


@register("caption_layers", r"""WITH m AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) * 2.5e0 + 1 AS clip FROM conversations),
s AS (SELECT conv_id, turn, clip, list_filter(string_split(regexp_replace(text, '[\n\t]', ' ', 'g'), ' '), lambda w: w <> '') AS ws, greatest(0, turn * 2.5e0 - 1) AS a, least(clip, turn * 2.5e0 + 2.2e0 - 1) AS b FROM m WHERE turn * 2.5e0 + 2.2e0 - 1 > 0 AND turn * 2.5e0 - 1 < clip),
c AS (SELECT *, len(ws) AS n, unnest(range((len(ws) - 1) // 5 + 1)) AS chunk FROM s WHERE len(ws) > 0),
l AS (SELECT *, a + (b - a) * (chunk * 5) / n AS cs, CASE WHEN chunk * 5 + 5 < n THEN a + (b - a) * (chunk * 5 + 5) / n ELSE b END AS ce FROM c)
SELECT conv_id AS project_id, turn AS segment_id, CAST(chunk AS INT) AS chunk, array_to_string(ws[chunk * 5 + 1:chunk * 5 + 5], ' ') AS text, """ + s6("0.5 + cs", "start_t") + ", " + s6("least(clip + 0.3e0, 0.5 + greatest(ce, cs + 0.4))", "end_t") + " FROM l WHERE least(clip + 0.3e0, 0.5 + greatest(ce, cs + 0.4)) > 0.5 + cs + 0.05")
def _(spark, sf):
    c = timeline.caption_layers(A.segments(spark, sf))
    return c.select("project_id", "segment_id", F.col("chunk").cast("int").alias("chunk"), "text", r6("layer_start").alias("start_t"), r6("layer_end").alias("end_t"))


# --- audio mix --------------------------------------------------------------------------------

MIX = """ac AS (SELECT o_custkey AS project_id, o_orderkey AS clip_id, ['music', 'voice', 'effect'][o_orderkey % 3 + 1] AS role, (CAST(floor(o_totalprice) AS BIGINT) % 200) / 10e0 AS st, (CAST(floor(o_totalprice) AS BIGINT) % 200) / 10e0 + (0.5e0 + (o_orderkey % 40) / 10e0) AS en,
  0.2e0 + (o_orderkey % 9) / 10e0 AS vol, (o_orderkey % 4) / 10e0 AS fi, (o_orderkey % 6) / 10e0 AS fo, o_orderkey % 17 = 0 AS muted FROM orders),
vo AS (SELECT project_id, st AS s, en AS e FROM ac WHERE role = 'voice' AND NOT muted AND project_id % 5 <> 0)"""
DUCK = "CASE WHEN t >= s AND t <= e THEN 0.22 WHEN t < s AND t > s - 0.30 THEN 0.22 + (1 - 0.22) * ((s - t) / 0.30) WHEN t > e AND t < e + 0.30 THEN 0.22 + (1 - 0.22) * ((t - e) / 0.30) ELSE 1 END"


@register("duck_intervals", f"WITH {MIX}, p AS (SELECT project_id, clip_id, st AS t FROM ac WHERE role = 'music') SELECT p.project_id, clip_id, {s6(f'coalesce(min({DUCK}), 1)', 'duck')} FROM p LEFT JOIN vo ON vo.project_id = p.project_id GROUP BY 1, 2")
def _(spark, sf):
    a = A.audio_clips(spark, sf)
    points = a.filter("role = 'music'").select("project_id", "clip_id", F.col("start").alias("t"))
    return mix.duck_points(points, mix.voice_intervals(a, _switches(a))).select("project_id", "clip_id", r6("duck").alias("duck"))


def _switches(audio):
    """Every fifth project does not duck."""
    return audio.select("project_id").distinct().withColumn("duck_music_under_voice", F.col("project_id") % 5 != 0)


PLAN = MIX + f""",
pts AS (SELECT DISTINCT * FROM (SELECT ac.*, st AS t FROM ac UNION ALL SELECT *, en FROM ac UNION ALL SELECT *, least(en, st + fi) FROM ac WHERE fi > 0 UNION ALL SELECT *, greatest(st, en - fo) FROM ac WHERE fo > 0
  UNION ALL SELECT ac.*, x.t FROM ac JOIN (SELECT project_id, unnest([s - 0.3e0, s, e, e + 0.3e0]) AS t FROM vo) x ON x.project_id = ac.project_id AND ac.role = 'music' AND x.t BETWEEN ac.st AND ac.en) WHERE NOT muted),
dk AS (SELECT p.*, coalesce(d, 1) AS duck FROM pts p LEFT JOIN (SELECT project_id, clip_id, t, min({DUCK}) AS d FROM (SELECT DISTINCT project_id, clip_id, t FROM pts WHERE role = 'music') q JOIN vo USING (project_id) GROUP BY 1, 2, 3) z USING (project_id, clip_id, t)),
gn AS (SELECT *, least(t, en - 1e-6) AS u FROM dk),
plan AS (SELECT project_id, clip_id, role, t, least(1, greatest(0, least(1, greatest(0, vol * (CASE WHEN fi > 0 AND u - st < fi THEN (u - st) / fi ELSE 1 END) * (CASE WHEN fo > 0 AND en - u < fo THEN (en - u) / fo ELSE 1 END))) * duck)) AS gain FROM gn)"""


@register("mix_plan", f"WITH {PLAN} SELECT project_id, CAST(clip_id AS VARCHAR) AS track_id, role, {s6('t', 't')}, {s6('gain', 'gain')} FROM (SELECT *, max(gain) OVER (PARTITION BY project_id, clip_id) AS top FROM plan) WHERE top > 0.0005")
def mix_plan(spark, sf):
    a = A.audio_clips(spark, sf)
    pool = a.select("project_id", "asset_id").distinct().withColumn("kind", F.lit("audio"))
    silent = A.clips(spark, sf).limit(0).select("project_id", "clip_id", "asset_id", "start", "duration", "volume")
    return mix.mix_plan(a, silent, pool, _switches(a)).select("project_id", "track_id", "role", r6("t").alias("t"), r6("gain").alias("gain"))


@register("mix_plan_clip_audio", f"""WITH {CLIPS}, c AS (SELECT project_id, pos, start AS st, start + duration AS en, volume AS vol, least(0.012, duration / 2) AS f FROM clips WHERE volume > 0.0005 AND asset_id IS NOT NULL AND (asset_id + project_id) % 2 = 0),
p AS (SELECT DISTINCT project_id, pos, st, en, vol, f, unnest([st, st + f, en - f, en]) AS t FROM c)
SELECT project_id, 'c-' || pos AS track_id, {s6('t', 't')}, {s6('least(1, greatest(0, vol * (CASE WHEN t - st < f THEN (t - st) / f ELSE 1 END) * (CASE WHEN en - t < f THEN (en - t) / f ELSE 1 END)))', 'gain')} FROM p""")
def _(spark, sf):
    clips = _clips(spark, sf, "clip_id", "asset_id", "volume")
    nothing = A.audio_clips(spark, sf).limit(0)
    return mix.mix_plan(nothing, clips, A.clip_assets(spark, sf)).select("project_id", "track_id", r6("t").alias("t"), r6("gain").alias("gain"))


@register("envelope_gain", f"""WITH {PLAN}, mp AS MATERIALIZED (SELECT project_id, clip_id, t, gain FROM plan), q AS (SELECT project_id, clip_id, st + (clip_id % 30) / 10e0 - 0.2e0 AS x FROM ac WHERE NOT muted),
bk AS (SELECT q.project_id, q.clip_id, x, p.t AS pt, p.gain AS pg FROM q ASOF LEFT JOIN mp p ON p.project_id = q.project_id AND p.clip_id = q.clip_id AND q.x >= p.t),
fw AS (SELECT bk.*, p.t AS nt, p.gain AS ng FROM bk ASOF LEFT JOIN mp p ON p.project_id = bk.project_id AND p.clip_id = bk.clip_id AND bk.x <= p.t)
SELECT project_id, clip_id, {s6('CASE WHEN pt IS NULL OR nt IS NULL THEN 0 WHEN nt - pt > 1e-9 THEN pg + (ng - pg) * ((x - pt) / (nt - pt)) ELSE ng END', 'gain')} FROM fw
WHERE EXISTS (SELECT 1 FROM mp WHERE mp.project_id = fw.project_id AND mp.clip_id = fw.clip_id)""")
def _(spark, sf):
    a = A.audio_clips(spark, sf)
    pool = a.select("project_id", "asset_id").distinct().withColumn("kind", F.lit("audio"))
    silent = A.clips(spark, sf).limit(0).select("project_id", "clip_id", "asset_id", "start", "duration", "volume")
    plan = cut_lineage(mix.mix_plan(a, silent, pool, _switches(a)).select("project_id", "track_id", "t", "gain"))
    asked = a.filter("NOT muted").select("project_id", F.col("clip_id").cast("string").alias("track_id"), "clip_id", (F.col("start") + (F.col("clip_id") % 30) / 10.0 - 0.2).alias("t"))
    return mix.envelope_gain(plan, asked).select("project_id", "clip_id", r6("gain").alias("gain"))


# --- quality ----------------------------------------------------------------------------------

QUALITY = CLIPS + """,
rep AS (SELECT *, coalesce(asset_id = lag(asset_id) OVER (PARTITION BY project_id ORDER BY pos), false) AS rp FROM clips),
ct AS (SELECT project_id, asset_id, count(*) AS c FROM clips WHERE asset_id IS NOT NULL GROUP BY 1, 2), ag AS (SELECT project_id, count(*) AS dist, max(c) AS worst FROM ct GROUP BY 1),
ms AS (SELECT r.project_id, count(*) AS n, count(asset_id) AS filled, count(*) FILTER (duration < 3 / 30e0) AS short, count(*) FILTER (rp) AS reps, coalesce(any_value(dist), 0) AS dist, coalesce(any_value(worst), 0) AS worst,
  count(*) FILTER (duration > 7 AND (asset_id + r.project_id) % 2 = 1) AS stills FROM rep r LEFT JOIN ag ON ag.project_id = r.project_id GROUP BY 1),
q1 AS (SELECT *, filled / n * greatest(0, 1 - short / n) AS coverage, CASE WHEN n > 1 THEN 1 - reps / (n - 1) ELSE 1 END AS continuity,
  coalesce(filled >= 4 AND worst / nullif(filled, 0) > greatest(0.4, ((filled + dist - 1) // nullif(dist, 0)) / nullif(filled, 0) + 0.12), false) AS over FROM ms),
q2 AS (SELECT *, CASE WHEN filled > 0 THEN dist / filled * CASE WHEN over THEN greatest(0.3, 1.4 - worst / filled * 2) ELSE 1 END ELSE 0 END AS diversity FROM q1),
q3 AS (SELECT *, CASE WHEN filled < n THEN least(coverage * 0.35 + continuity * 0.25 + diversity * 0.20 + 0.20, 0.45) ELSE coverage * 0.35 + continuity * 0.25 + diversity * 0.20 + 0.20 END AS t0 FROM q2)"""


def _projects(spark, sf):
    """Every order has a timeline; those without line items are empty."""
    return A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("project_id"))


@register("edit_quality", f"""WITH {QUALITY} SELECT project_id, {s6('least(1, greatest(0, CASE WHEN stills > 0 THEN greatest(0, t0 - 0.05 * stills) ELSE t0 END))', 'total')}, {s6('diversity', 'diversity')}, {s6('continuity', 'continuity')}, {s6('coverage', 'coverage')},
  (n - filled) + short + stills + reps + CAST(over AS INT) + CAST(dist = 1 AND n >= 3 AS INT) AS issues FROM q3
UNION ALL SELECT o_orderkey, 0, 0, 0, 0, 1 FROM orders WHERE o_orderkey NOT IN (SELECT project_id FROM clips)""")
def edit_quality(spark, sf):
    q = quality.edit_quality(_clips(spark, sf, "asset_id"), A.clip_assets(spark, sf), projects=_projects(spark, sf))
    return q.select("project_id", *[r6(c).alias(c) for c in ("total", "diversity", "continuity", "coverage")], "issues")


@register("quality_issues", f"""WITH {QUALITY}, i AS (SELECT project_id, 'emptySlot' AS kind, pos FROM clips WHERE asset_id IS NULL UNION ALL SELECT project_id, 'tooShortClip', pos FROM clips WHERE duration < 3 / 30e0 UNION ALL SELECT project_id, 'adjacentRepeat', pos FROM rep WHERE rp
  UNION ALL SELECT project_id, 'longStillScene', pos FROM clips WHERE duration > 7 AND (asset_id + project_id) % 2 = 1 UNION ALL SELECT project_id, 'overusedAsset', NULL FROM q3 WHERE over UNION ALL SELECT project_id, 'lowDiversity', NULL FROM q3 WHERE dist = 1 AND n >= 3
  UNION ALL SELECT o_orderkey, 'emptySlot', NULL FROM orders WHERE o_orderkey NOT IN (SELECT project_id FROM clips))
SELECT project_id, kind, pos AS clip_idx FROM i""")
def _(spark, sf):
    return quality.quality_issues(_clips(spark, sf, "asset_id"), A.clip_assets(spark, sf), projects=_projects(spark, sf)).select("project_id", "kind", "clip_idx")


@register("quality_rhythm", f"""WITH {CLIPS}, bt AS (SELECT o_orderkey AS project_id, unnest(range(20)) * (0.3e0 + (o_custkey % 5) / 10e0) AS t FROM orders), ct AS (SELECT project_id, pos, start + duration AS e FROM clips WHERE pos < n_clips - 1 AND start + duration > 0.01),
g AS (SELECT c.project_id, c.pos, min(abs(b.t - c.e)) AS gap FROM ct c JOIN bt b ON b.project_id = c.project_id GROUP BY 1, 2), r AS (SELECT project_id, count(*) AS n, count(*) FILTER (gap <= 0.08) AS a FROM g GROUP BY 1)
SELECT c.project_id, {s6('coalesce(any_value(a / r.n), 1)', 'rhythm')} FROM clips c LEFT JOIN r ON r.project_id = c.project_id GROUP BY 1""")
def _(spark, sf):
    beats = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("project_id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i * (0.3 + (F.col("o_custkey") % 5) / 10.0))).alias("t"))
    return quality.edit_quality(_clips(spark, sf, "asset_id"), None, beats).select("project_id", r6("rhythm").alias("rhythm"))


# --- edit logs --------------------------------------------------------------------------------

LOG = """log AS (SELECT user_id AS project_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, CASE event_type WHEN 'click' THEN 'setClipVolume' WHEN 'view' THEN 'trimClip' WHEN 'purchase' THEN 'undo' WHEN 'error' THEN 'redo' ELSE 'moveClip' END AS kind,
  'c' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3) AS entity_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ky AS (SELECT *, CASE kind WHEN 'setClipVolume' THEN 'clipvol:' || entity_id WHEN 'trimClip' THEN 'trim:' || entity_id END AS key FROM log),
gp AS (SELECT *, sum(CASE WHEN coalesce(key = lag_key AND k % 4 <> 0 AND k % 7 <> 0 AND NOT closed, false) THEN 0 ELSE 1 END) OVER (PARTITION BY project_id ORDER BY seq) - 1 AS step
  FROM (SELECT *, lag(key) OVER (PARTITION BY project_id ORDER BY seq) AS lag_key, coalesce(bool_or(kind = 'undo' AND k % 4 <> 0) OVER (PARTITION BY project_id, seq // 8 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed FROM ky)),
co AS (SELECT project_id, step, min(seq) AS first_seq, max(seq) AS seq, count(*) AS merged, any_value(kind) AS kind, any_value(entity_id) AS entity_id, arg_max(value, seq) AS new_value, arg_min(k, seq) AS old_value, arg_max(k, seq) AS lk FROM gp GROUP BY 1, 2)"""


@register("coalesce_edits", f"WITH {LOG} SELECT project_id, CAST(step AS BIGINT) AS step, first_seq, seq, merged, kind, entity_id, {s6('new_value', 'new_value')}, CAST(old_value AS VARCHAR) AS old_value FROM co")
def _(spark, sf):
    c = edits.coalesce_edits(A.edit_log(spark, sf))
    return c.select("project_id", F.col("step").cast("bigint").alias("step"), "first_seq", "seq", "merged", "kind", "entity_id", r6(F.col("new_value").cast("double")).alias("new_value"), "old_value")


LIVE = LOG + """,
wk AS (SELECT project_id, CAST(-1 AS BIGINT) AS step, CAST(0 AS BIGINT) AS d, CAST(0 AS BIGINT) AS x, '' AS kind FROM co WHERE step = 0 UNION ALL
  SELECT c.project_id, CAST(c.step AS BIGINT), CASE c.kind WHEN 'undo' THEN greatest(w.d - 1, 0) WHEN 'redo' THEN w.d + CASE WHEN w.x > 0 THEN 1 ELSE 0 END ELSE w.d + 1 END, CASE c.kind WHEN 'undo' THEN w.x + CASE WHEN w.d > 0 THEN 1 ELSE 0 END WHEN 'redo' THEN greatest(w.x - 1, 0) ELSE 0 END, c.kind
  FROM wk w JOIN co c ON c.project_id = w.project_id AND c.step = w.step + 1),
fin AS (SELECT project_id, arg_max(d, step) AS fd FROM wk GROUP BY 1),
lv AS (SELECT w.project_id, w.d, max(w.step) AS step FROM wk w JOIN fin USING (project_id) WHERE w.kind NOT IN ('undo', 'redo', '') AND w.d <= fd GROUP BY 1, 2),
live AS (SELECT co.*, lv.d FROM lv JOIN co ON co.project_id = lv.project_id AND co.step = lv.step)"""


@register("live_edits", f"WITH RECURSIVE {LIVE} SELECT project_id, CAST(step AS BIGINT) AS step, CAST(d AS BIGINT) AS depth, kind, entity_id FROM live")
def live_edits(spark, sf):
    return edits.live_edits(A.edit_log(spark, sf)).select("project_id", F.col("step").cast("bigint").alias("step"), "depth", "kind", "entity_id")


@register("latest_values", f"WITH RECURSIVE {LIVE} SELECT project_id, entity_id, kind, {s6('arg_max(new_value, step)', 'value')}, count(*) AS edits FROM live WHERE kind <> 'moveClip' GROUP BY 1, 2, 3")
def _(spark, sf):
    v = edits.latest_values(cut_lineage(edits.live_edits(A.edit_log(spark, sf))))
    return v.select("project_id", "entity_id", "kind", r6(F.col("value").cast("double")).alias("value"), "edits")


@register("replay_edits", f"""WITH RECURSIVE {LIVE},
mv AS (SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY step) AS n, lk % 5 AS i, lk // 5 % 5 AS j FROM live WHERE kind = 'moveClip'),
wl AS (SELECT DISTINCT user_id AS project_id, CAST(0 AS BIGINT) AS n, ['c0', 'c1', 'c2', 'c3', 'c4'] AS cs FROM events UNION ALL
  SELECT project_id, n, list_concat(list_concat(rest[:j], [moved]), rest[j + 1:]) FROM (SELECT w.project_id, m.n, m.j, w.cs[m.i + 1] AS moved, list_concat(w.cs[:m.i], w.cs[m.i + 2:]) AS rest FROM wl w JOIN mv m ON m.project_id = w.project_id AND m.n = w.n + 1)),
fo AS (SELECT project_id, unnest(arg_max(cs, n)) AS clip_id, generate_subscripts(arg_max(cs, n), 1) - 1 AS pos FROM wl GROUP BY 1),
vl AS (SELECT project_id, entity_id, arg_max(new_value, step) AS v FROM live WHERE kind = 'setClipVolume' GROUP BY 1, 2)
SELECT fo.project_id, CAST(pos AS INT) AS pos, clip_id, {s6('v', 'volume')} FROM fo LEFT JOIN vl ON vl.project_id = fo.project_id AND vl.entity_id = clip_id""")
def _(spark, sf):
    r = edits.replay_edits(A.edit_log(spark, sf), A.edit_clips(spark, sf))
    return r.select("project_id", "pos", "clip_id", r6(F.try_element_at("fields", F.lit("setClipVolume")).cast("double")).alias("volume"))


# --- binding ----------------------------------------------------------------------------------


@register("bind_timeline")
def bind_timeline(spark, sf):
    """A music template per track bound to the five clip assets of its project."""
    from cutlens.plans.arrange_and_bind import bind_music_templates

    return bind_music_templates(spark, sf).select("project_id", "pos", "slot_id", "asset_id", r6("start").alias("start_t"), r6("duration").alias("seconds"), *rect6("crop_start", "s_"), *rect6("crop_end", "e_"), F.col("transition.kind").alias("transition"))


@register("bind_text", f"""WITH t AS (SELECT doc_id % 50 AS project_id, doc_id, 'text_' || doc_id AS slot_id, doc_id // 50 * 0.7e0 AS st, doc_id // 50 * 0.7e0 + 1.1e0 AS en, 0.02e0 + (doc_id % 8) / 100e0 AS size, CAST(length(text) % 40 AS INT) AS hint, CASE WHEN doc_id % 4 = 0 THEN '  ' WHEN doc_id % 4 <> 3 THEN source || ' ' || lang END AS words, doc_id % 3 AS f, (doc_id % 10) / 10e0 AS c FROM documents)
SELECT project_id, slot_id, words AS text, {s6('round(st * 30) / 30', 'start_t')}, {s6('round(en * 30) / 30', 'end_t')}, {s6('CASE WHEN hint > 0 THEN size * least(1.15, greatest(0.6, hint / length(words))) ELSE size END', 'size')},
  CASE WHEN c >= 0.55 THEN ['condensed', 'displayBold', 'sansSerif'][f + 1] ELSE 'sansSerif' END AS font, CASE WHEN f = 1 THEN 'heavy' ELSE 'bold' END AS weight FROM t WHERE trim(words) <> ''""")
def _(spark, sf):
    d = F.col("doc_id")
    pick = F.get(F.array(F.lit("condensed"), F.lit("displayBold"), F.lit("sansSerif")), (d % 3).cast("int"))
    docs = A.table(spark, sf, "documents")
    slots = A.text_tracks(spark, sf).select(F.col("video_id").alias("project_id"), F.col("track").alias("doc_id"), "start", "end", "frame", "size_ratio", "color_hex").join(docs.select("doc_id", (F.length("text") % 40).cast("int").alias("char_hint")), "doc_id").select(
        "project_id", F.concat(F.lit("text_"), d.cast("string")).alias("slot_id"), "start", "end", "frame", "size_ratio", "color_hex", "char_hint", F.lit("caption").alias("role"), F.lit("center").alias("alignment"), F.lit("not read").alias("sample_text"),
        F.struct(pick.alias("value"), ((d % 10) / 10.0).alias("confidence")).alias("font"), F.struct(F.lit("wordByWord").alias("entry"), F.lit(0.62).alias("entry_confidence"), F.lit("fadeOut").alias("exit"), F.lit(0.35).alias("exit_confidence")).alias("animation"))
    words = docs.filter("doc_id % 4 <> 3").select((d % 50).alias("project_id"), F.concat(F.lit("text_"), d.cast("string")).alias("slot_id"), F.when(d % 4 == 0, "  ").otherwise(F.concat_ws(" ", "source", "lang")).alias("text"))
    b = bind.bind_text(slots, words)
    return b.select("project_id", "slot_id", "text", r6("start").alias("start_t"), r6("end").alias("end_t"), r6("size_ratio").alias("size"), "font", "weight")


@register("bind_audio", f"""WITH c AS (SELECT o_orderkey AS project_id, o_totalprice / 20000 AS total, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS m, CASE WHEN o_orderkey % 4 = 1 THEN o_custkey + 1 END AS r, CASE WHEN o_orderkey % 5 = 2 THEN o_custkey + 2 END AS v FROM orders),
x AS (SELECT project_id, total, 'music' AS role, m AS asset_id, 1 AS vol, least(0.8, total * 0.1) AS fo FROM c UNION ALL SELECT project_id, total, 'reference', r, CASE WHEN m IS NULL THEN 1 ELSE 0.5 END, least(0.6, total * 0.08) FROM c UNION ALL SELECT project_id, total, 'voice', v, 1, 0.05 FROM c)
SELECT project_id, role, asset_id, {s6('CASE WHEN asset_id % 7 <> 0 AND (asset_id % 7) * 3e0 > 0 THEN least(total, (asset_id % 7) * 3e0) ELSE total END', 'seconds')}, {s6('vol', 'volume')}, {s6('fo', 'fade_out')} FROM x WHERE asset_id IS NOT NULL""")
def _(spark, sf):
    return _bound_content(spark, sf)[0].select("project_id", "role", "asset_id", r6("duration").alias("seconds"), r6("volume").alias("volume"), r6("fade_out").alias("fade_out"))


def _bound_content(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    content = A.table(spark, sf, "orders").select(
        o.alias("project_id"), (F.col("o_totalprice") / 20000).alias("template_seconds"), F.when(o % 3 != 0, c).alias("music_id"), F.when(o % 4 == 1, c + 1).alias("reference_id"), F.when(o % 5 == 2, c + 2).alias("voice_id"), F.when(o % 6 == 1, c + 3).alias("logo_id"))
    ids = content.select("project_id", F.explode(F.array("music_id", "reference_id", "voice_id")).alias("asset_id")).filter("asset_id IS NOT NULL").distinct()
    return bind.bind_content(content, ids.withColumn("asset_seconds", (F.col("asset_id") % 7) * 3.0))


@register("bind_overlays", f"""SELECT o_orderkey AS project_id, 'overlay/logo' AS overlay_id, o_custkey + 3 AS asset_id, {s6('0', 'start_t')}, {s6('o_totalprice / 20000', 'end_t')}, {s6('0.36', 'x')}, {s6('0.855', 'y')}, {s6('0.28', 'w')}, {s6('0.075', 'h')}, {s6('0.92', 'opacity')}
FROM orders WHERE o_orderkey % 6 = 1""")
def _(spark, sf):
    return _bound_content(spark, sf)[1].select("project_id", "overlay_id", "asset_id", r6("start").alias("start_t"), r6("end").alias("end_t"), *rect6("frame"), r6("opacity").alias("opacity"))
