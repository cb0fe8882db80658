"""Shots, motion, palettes and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlens.functions import color, geometry as g, motion as mot
from cutlens.operators import motion, palette, shots, template, text
from cutlens.operators.ordered import positions
from cutlens.sources import adapters as A
from queries.common import FRAMES, GRADUAL, MARKED, MERGED, RUNS, SHOTS, r6, rect6, registry, s6

JOBS, SQL, register = registry()


@register("sample_frames", f"WITH {FRAMES} SELECT video_id, frame_idx, {s6('t', 't')}, {s6('content_value', 'content_value')} FROM frames WHERE frame_idx % 8 = 0 AND t BETWEEN 0.2 AND 2.0")
def _(spark, sf):
    return shots.sample_frames(A.frames(spark, sf), 8, 0.2, 2.0).select("video_id", "frame_idx", r6("t").alias("t"), r6("content_value").alias("content_value"))


@register("content_difference", f"""WITH sig AS (
  SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS e FROM embeddings),
paired AS (SELECT *, lag(e) OVER (PARTITION BY video_id ORDER BY frame_idx) AS p FROM sig)
SELECT CAST(video_id AS BIGINT) AS video_id, frame_idx, {s6('''CASE WHEN p IS NULL THEN 0 ELSE (
  2 * list_avg(list_transform(list_zip(e, p), lambda z: least(abs(z[1] - z[2]), 1 - abs(z[1] - z[2]))))
  + list_avg(list_transform(list_zip(e, p), lambda z: abs((1 - z[1]) - (1 - z[2]))))
  + list_avg(list_transform(list_zip(e, p), lambda z: abs(z[1] * z[1] - z[2] * z[2])))) / 3 END''', 'content_value')} FROM paired""")
def _(spark, sf):
    d = shots.content_difference(A.signatures(spark, sf))
    return d.select(F.col("video_id").cast("bigint").alias("video_id"), "frame_idx", r6("content_value").alias("content_value"))


@register("rolling_mean_excluding_self", f"WITH {MARKED} SELECT video_id, frame_idx, {s6('coalesce(rolling, 0)', 'rolling')} FROM marked")
def _(spark, sf):
    return shots.mark_cuts(A.frames(spark, sf)).select("video_id", "frame_idx", r6("rolling").alias("rolling"))


@register("detect_cuts", f"WITH {MARKED} SELECT video_id, frame_idx, {s6('t', 't')}, {s6('least(0.98, 0.62 + (ratio - 3) / 8)', 'confidence')} FROM marked WHERE is_cut")
def _(spark, sf):
    return shots.detect_cuts(A.frames(spark, sf)).select("video_id", "frame_idx", r6("t").alias("t"), r6("confidence").alias("confidence"))


@register("elevated_runs", f"WITH {RUNS} SELECT video_id, first_idx, last_idx, n_frames, start_idx, end_idx FROM runs")
def _(spark, sf):
    return shots.elevated_runs(A.frames(spark, sf)).select("video_id", "first_idx", "last_idx", "n_frames", "start_idx", "end_idx")


@register("detect_gradual", f"WITH {GRADUAL} SELECT video_id, frame_idx, kind, {s6('t', 't')}, {s6('duration', 'duration')}, {s6('confidence', 'confidence')} FROM gradual")
def _(spark, sf):
    frames = A.frames(spark, sf)
    found = shots.detect_gradual(frames, A.thumbs(spark, sf, frames))
    return found.select("video_id", "frame_idx", "kind", *[r6(c).alias(c) for c in ("t", "duration", "confidence")])


@register("merge_boundaries", f"WITH RECURSIVE {MERGED} SELECT video_id, kind, {s6('t', 't')}, {s6('confidence', 'confidence')} FROM merged")
def _(spark, sf):
    frames = A.frames(spark, sf)
    found = shots.candidate_boundaries(frames, A.thumbs(spark, sf, frames))
    return shots.merge_boundaries(found, A.durations(frames)).select("video_id", "kind", r6("t").alias("t"), r6("confidence").alias("confidence"))


def _shots(spark, sf):
    frames = A.frames(spark, sf)
    return shots.detect_shots(frames, A.thumbs(spark, sf, frames), A.durations(frames))


@register("detect_shots", f"""WITH RECURSIVE {SHOTS} SELECT video_id, shot_idx, kind, {s6('start', 'start_t')}, {s6('"end"', 'end_t')}, {s6('boundary_seconds', 'boundary_seconds')}, {s6('confidence', 'confidence')} FROM shots""")
def detected_shots(spark, sf):
    return _shots(spark, sf).select("video_id", "shot_idx", "kind", r6("start").alias("start_t"), r6("end").alias("end_t"), r6("boundary_seconds").alias("boundary_seconds"), r6("confidence").alias("confidence"))


@register("shot_length_stats", f"""WITH RECURSIVE {SHOTS} SELECT video_id, count(*) AS shot_count, {s6('list_sort(list("end" - start))[count(*) // 2 + 1]', 'median_seconds')},
  {s6('max("end" - start)', 'longest_seconds')} FROM shots GROUP BY video_id""")
def shot_length_stats(spark, sf):
    s = _shots(spark, sf).withColumn("_d", F.col("end") - F.col("start"))
    return s.groupBy("video_id").agg(F.count(F.lit(1)).alias("shot_count"), r6(shots.upper_median("_d")).alias("median_seconds"), r6(F.max("_d")).alias("longest_seconds"))


@register("shot_sample_times", f"""WITH RECURSIVE {SHOTS},
inset AS (SELECT *, start + least(0.08, ("end" - start) * 0.12) AS a, greatest(start + least(0.08, ("end" - start) * 0.12), "end" - least(0.08, ("end" - start) * 0.12)) AS b FROM shots),
times AS (SELECT video_id, shot_idx, sample, a + (b - a) * sample / 4 AS sample_t FROM inset, (SELECT unnest(range(5)) AS sample)),
near AS (SELECT s.*, f.frame_idx, row_number() OVER (PARTITION BY s.video_id, shot_idx, sample ORDER BY abs(f.t - sample_t), f.t) AS rn FROM times s JOIN frames f ON f.video_id = s.video_id AND abs(f.t - sample_t) <= 0.05)
SELECT video_id, shot_idx, CAST(sample AS INT) AS sample, {s6('sample_t', 'sample_t')}, frame_idx FROM near WHERE rn = 1""")
def _(spark, sf):
    from cutlens.operators.ordered import nearest

    frames = A.frames(spark, sf)
    times = shots.shot_sample_times(shots.detect_shots(frames, A.thumbs(spark, sf, frames), A.durations(frames)).select("video_id", "shot_idx", "start", "end"))
    near = nearest(times, frames.select("video_id", F.col("t").alias("ft"), "frame_idx"), ["video_id"], "sample_t", ["frame_idx"], 0.05, right_at="ft")
    return near.filter("near_t IS NOT NULL").select("video_id", "shot_idx", "sample", r6("sample_t").alias("sample_t"), F.col("near_frame_idx").alias("frame_idx"))


# --- motion -----------------------------------------------------------------------------------

FLOW = """points AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS point_id FROM lineitem),
shaped AS (SELECT *, 0.05 + l_quantity / 50.0 * 0.9 AS sx, 0.05 + (l_partkey % 90) / 100.0 AS sy, CAST(1.02 + (l_suppkey % 5) * 0.03 AS DOUBLE) AS zoom FROM points),
flow AS (
  SELECT l_suppkey % 20 AS video_id, l_suppkey // 20 AS shot_idx, point_id % 3 AS pair, point_id, sx, sy,
         CASE WHEN point_id % 7 = 3 THEN sx + l_discount ELSE zoom * sx - 0.04 END AS tx,
         CASE WHEN point_id % 7 = 3 THEN sy - l_tax ELSE zoom * sy + 0.01 END AS ty FROM shaped),
gated AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY video_id, shot_idx, pair) AS n FROM flow
    WHERE abs(tx - sx) < 1.0 / 3 AND abs(ty - sy) < 1.0 / 3 AND sx BETWEEN 0.1 AND 0.9 AND sy BETWEEN 0.1 AND 0.9) WHERE n >= 8)"""


def _solve(source: str, name: str) -> str:
    return f"""{name}_sum AS (
  SELECT video_id, shot_idx, pair, count(*) AS n, avg(sx) AS mx, avg(sy) AS my, avg(tx) AS nx, avg(ty) AS ny,
         sum(sx * tx + sy * ty) AS dt, sum(sx * ty - sy * tx) AS cr, sum(sx * sx + sy * sy) AS ss FROM {source} GROUP BY 1, 2, 3),
{name}_ab AS (SELECT *, dt - n * (mx * nx + my * ny) AS a, cr - n * (mx * ny - my * nx) AS b, ss - n * (mx * mx + my * my) AS v FROM {name}_sum),
{name}_rs AS (SELECT *, atan2(b, a) AS rot, sqrt(a * a + b * b) / v AS scale FROM {name}_ab WHERE n >= 3 AND v > 1e-9),
{name} AS (SELECT video_id, shot_idx, pair, n, rot, scale, nx - scale * (cos(rot) * mx - sin(rot) * my) AS dx, ny - scale * (sin(rot) * mx + cos(rot) * my) AS dy FROM {name}_rs)"""


_ERR = "sqrt(power(scale * (cos(rot) * sx - sin(rot) * sy) + dx - tx, 2) + power(scale * (sin(rot) * sx + cos(rot) * sy) + dy - ty, 2))"
FITS = f"""{FLOW},
{_solve('gated', 'fit1')},
scored AS (SELECT g.*, f.n AS total, {_ERR} AS error FROM gated g JOIN fit1 f USING (video_id, shot_idx, pair)),
kept AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY video_id, shot_idx, pair ORDER BY error, point_id) AS rn FROM scored) WHERE rn <= greatest(3, CAST(floor(total * 0.8) AS BIGINT))),
{_solve('kept', 'fit2')},
resid AS (SELECT video_id, shot_idx, pair, avg({_ERR}) AS residual FROM kept JOIN fit2 USING (video_id, shot_idx, pair) GROUP BY 1, 2, 3),
fits AS (SELECT * FROM fit2 JOIN resid USING (video_id, shot_idx, pair))"""
MOTIONS = FITS + """,
motions AS (
  SELECT video_id, shot_idx, product(scale) AS scale, sum(scale * (cos(rot) * 0.5 - sin(rot) * 0.5) + dx - 0.5) AS tx,
         sum(scale * (sin(rot) * 0.5 + cos(rot) * 0.5) + dy - 0.5) AS ty, sum(rot) AS rot, avg(residual) AS residual, CAST(count(*) AS INT) AS n
  FROM fits GROUP BY 1, 2)"""


@register("flow_gate", f"WITH {FLOW} SELECT video_id, shot_idx, pair, count(*) AS points, {s6('sum(tx - sx)', 'dx')} FROM gated GROUP BY 1, 2, 3")
def _(spark, sf):
    return motion.flow_gate(A.flow(spark, sf)).groupBy("video_id", "shot_idx", "pair").agg(F.count(F.lit(1)).alias("points"), r6(F.sum(F.col("tx") - F.col("sx"))).alias("dx"))


@register("similarity_fit", f"WITH {FITS} SELECT video_id, shot_idx, pair, n, " + ", ".join(s6(c, c) for c in ("scale", "rot", "dx", "dy", "residual")) + " FROM fits")
def _(spark, sf):
    fits = motion.similarity_fit(motion.steady_vectors(A.flow(spark, sf)), min_points=motion.MIN_POINTS)
    return fits.select("video_id", "shot_idx", "pair", "n", *[r6(c).alias(c) for c in ("scale", "rot", "dx", "dy", "residual")])


def _motions(spark, sf):
    return motion.compose_motion(motion.similarity_fit(motion.steady_vectors(A.flow(spark, sf)), min_points=motion.MIN_POINTS))


@register("compose_motion", f"WITH {MOTIONS} SELECT video_id, shot_idx, n, " + ", ".join(s6(c, c) for c in ("scale", "tx", "ty", "rot", "residual")) + " FROM motions")
def _(spark, sf):
    return _motions(spark, sf).select("video_id", "shot_idx", "n", *[r6(c).alias(c) for c in ("scale", "tx", "ty", "rot", "residual")])


# Motions spread over all kinds, straight from line items.
RAW_MOTION = """m AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.82 + (l_partkey % 41) / 100.0 AS scale, (l_suppkey % 27 - 13) / 100.0 AS tx, (l_partkey % 23 - 11) / 100.0 AS ty,
         (l_orderkey % 15 - 7) / 100.0 * (CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS rot, l_discount / 2 AS residual, CAST(l_linenumber - 1 AS INT) AS n FROM lineitem)"""
KIND = """CASE WHEN abs(rot) > 0.05 AND NOT abs(scale - 1) > 0.06 AND NOT greatest(abs(tx), abs(ty)) > 0.05 THEN 'rotate'
  WHEN abs(rot) > 0.05 THEN 'complex'
  WHEN abs(scale - 1) > 0.06 AND greatest(abs(tx), abs(ty)) > 0.05 AND NOT abs(scale - 1) / 2 > greatest(abs(tx), abs(ty)) * 1.6 AND NOT greatest(abs(tx), abs(ty)) > abs(scale - 1) / 2 * 1.6 THEN 'complex'
  WHEN abs(scale - 1) > 0.06 AND NOT (greatest(abs(tx), abs(ty)) > 0.05 AND greatest(abs(tx), abs(ty)) > abs(scale - 1) / 2 * 1.6) THEN CASE WHEN scale > 1 THEN 'zoomIn' ELSE 'zoomOut' END
  WHEN greatest(abs(tx), abs(ty)) > 0.05 THEN CASE WHEN abs(tx) >= abs(ty) THEN CASE WHEN tx > 0 THEN 'panLeft' ELSE 'panRight' END ELSE CASE WHEN ty > 0 THEN 'panUp' ELSE 'panDown' END END
  ELSE 'none' END"""
CONF = "CASE WHEN n > 0 THEN least(0.97, greatest(0, 1 - residual * 8) * 0.7 + least(1, n / 5.0) * 0.3) ELSE 0 END"


def _raw_motion(spark, sf):
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    m = F.struct((0.82 + (p % 41) / 100.0).alias("scale"), ((s % 27 - 13) / 100.0).alias("tx"), ((p % 23 - 11) / 100.0).alias("ty"),
                 ((F.col("l_orderkey") % 15 - 7) / 100.0 * F.when(n == 7, 1).otherwise(0)).alias("rot"), (F.col("l_discount") / 2).alias("residual"), (n - 1).cast("int").alias("n"))
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", m.alias("m"))


@register("motion_kind", f"""WITH {RAW_MOTION} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {KIND} AS kind, {s6(CONF, 'confidence')}, {s6('least(1, abs(scale - 1) * 3 + sqrt(tx * tx + ty * ty) * 4)', 'energy')} FROM m""")
def _(spark, sf):
    m = F.col("m")
    return _raw_motion(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", mot.motion_kind(m).alias("kind"), r6(mot.motion_confidence(m)).alias("confidence"), r6(mot.motion_energy(m)).alias("energy"))


_CL = lambda v, lo, hi: f"least(greatest({v}, {lo}), {hi})"
_DX, _DY = _CL("tx", -0.1, 0.1) + " / 2", _CL("ty", -0.1, 0.1) + " / 2"


@register("camera_move_rects", f"""WITH {RAW_MOTION}, k AS (SELECT *, {KIND} AS kind, {CONF} AS conf FROM m),
z AS (SELECT *, {_CL('1 / scale', 0.62, 0.98)} AS zi, {_CL('scale', 0.62, 0.98)} AS zo FROM k)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN n <= 0 THEN 'none' WHEN kind IN ('rotate', 'complex') THEN 'zoomIn' ELSE kind END AS kind,
  {s6("CASE WHEN n <= 0 THEN 1 WHEN kind IN ('rotate', 'complex') THEN least(conf, 0.5) ELSE conf END", 'confidence')},
  {s6(f"CASE WHEN n <= 0 THEN 0 WHEN kind = 'zoomOut' THEN 0.5 - zo / 2 WHEN kind LIKE 'pan%' THEN {_CL(f'0.06 + {_DX}', 0, 0.12)} ELSE 0 END", 'start_x')},
  {s6("CASE WHEN n <= 0 THEN 1 WHEN kind = 'zoomOut' THEN zo WHEN kind LIKE 'pan%' THEN 0.88 ELSE 1 END", 'start_w')},
  {s6(f"CASE WHEN n <= 0 THEN 0 WHEN kind = 'zoomIn' THEN 0.5 - zi / 2 WHEN kind LIKE 'pan%' THEN {_CL(f'0.06 - {_DY}', 0, 0.12)} WHEN kind IN ('rotate', 'complex') THEN 0.05 ELSE 0 END", 'end_y')},
  {s6("CASE WHEN n <= 0 THEN 1 WHEN kind = 'zoomIn' THEN zi WHEN kind LIKE 'pan%' THEN 0.88 WHEN kind IN ('rotate', 'complex') THEN 0.9 ELSE 1 END", 'end_h')},
  CASE WHEN n <= 0 OR kind = 'none' THEN 'linear' ELSE 'easeInOut' END AS easing FROM z""")
def _(spark, sf):
    c = F.col("c")
    return _raw_motion(spark, sf).withColumn("c", mot.camera_move(F.col("m"))).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c["kind"].alias("kind"), r6(c["confidence"]).alias("confidence"), r6(c["start"]["x"]).alias("start_x"),
        r6(c["start"]["w"]).alias("start_w"), r6(c["end"]["y"]).alias("end_y"), r6(c["end"]["h"]).alias("end_h"), c["easing"].alias("easing"))


BOXES = """boxes AS (SELECT l_suppkey AS video_id, l_linenumber AS shot_idx, l_orderkey % 50 AS frame_idx, l_discount * 4 AS x, l_tax * 4 AS y, l_quantity / 100.0 AS w, (l_partkey % 40) / 100.0 AS h, l_orderkey, l_partkey FROM lineitem)"""


@register("subject_region", f"""WITH {BOXES}, pf AS (SELECT video_id, shot_idx, frame_idx, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM boxes GROUP BY 1, 2, 3),
m AS (SELECT video_id, shot_idx, avg(x) AS x, avg(y) AS y, least(avg(w), 1) AS w, least(avg(h), 1) AS h FROM pf GROUP BY 1, 2)
SELECT video_id, shot_idx, {s6('least(greatest(x, 0), 1 - w)', 'x')}, {s6('least(greatest(y, 0), 1 - h)', 'y')}, {s6('w', 'w')}, {s6('h', 'h')} FROM m""")
def _(spark, sf):
    return motion.subject_region(A.boxes(spark, sf), ["video_id", "shot_idx"], ["frame_idx"]).select("video_id", "shot_idx", *rect6("region"))


@register("asset_subject", f"""WITH {BOXES}, s AS (SELECT video_id AS asset_id, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b FROM boxes GROUP BY 1),
fb AS (SELECT o_custkey % 150 + 50 AS asset_id, (o_custkey % 150) / 300.0 + (o_orderkey % 10) / 100.0 AS x, (o_custkey % 75) / 150.0 + (o_orderkey % 7) / 100.0 AS y, CAST(0.05 AS DOUBLE) AS w, CAST(0.07 AS DOUBLE) AS h FROM orders),
f AS (SELECT asset_id, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b, count(*) AS n FROM fb GROUP BY 1),
p AS (SELECT asset_id, n, least((r - x) * 1.4, 1) AS w, least((b - y) * 1.4, 1) AS h, x + (r - x) / 2 - (r - x) * 1.4 / 2 AS x, y + (b - y) / 2 - (b - y) * 1.4 / 2 AS y FROM f),
q AS (SELECT asset_id, n, least(greatest(x, 0), 1 - w) AS x, least(greatest(y, 0), 1 - h) AS y, w, h FROM p)
SELECT coalesce(s.asset_id, q.asset_id) AS asset_id, {s6('least(s.x, q.x)', 'x')}, {s6('least(s.y, q.y)', 'y')}, {s6('greatest(s.r, q.x + q.w) - least(s.x, q.x)', 'w')}, {s6('greatest(s.b, q.y + q.h) - least(s.y, q.y)', 'h')},
  coalesce(n, 0) AS face_count FROM s FULL JOIN q ON s.asset_id = q.asset_id""")
def _(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    faces = A.table(spark, sf, "orders").select((c % 150 + 50).alias("asset_id"), ((c % 150) / 300.0 + (o % 10) / 100.0).alias("x"), ((c % 75) / 150.0 + (o % 7) / 100.0).alias("y"), F.lit(0.05).alias("w"), F.lit(0.07).alias("h"))
    found = motion.asset_subject(A.boxes(spark, sf).withColumnRenamed("video_id", "asset_id"), faces, ["asset_id"])
    return found.select("asset_id", *rect6("region"), "face_count")


# --- palettes ---------------------------------------------------------------------------------

PIXELS = """pixels AS (SELECT o_orderkey // 1200 AS asset_id, o_orderkey AS sample_id, o_orderkey % 40 AS x, (o_orderkey % 1200) // 40 AS y,
  (o_custkey % 51) / 50.0 AS r, (o_orderkey % 97) / 96.0 AS g, CAST(floor(o_totalprice) AS BIGINT) % 101 / 100.0 AS b FROM orders)"""
LUMA = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"
SAT = "CASE WHEN greatest(r, g, b) > 1e-6 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END"


@register("luma_thumb", f"WITH {PIXELS} SELECT asset_id, CAST(least(23, x * 24 // 40) AS INT) AS tx, CAST(least(41, y * 42 // 30) AS INT) AS ty, {s6(f'avg({LUMA})', 'luma')} FROM pixels GROUP BY 1, 2, 3")
def _(spark, sf):
    return palette.luma_thumb(A.pixel_grid(spark, sf), ["asset_id"], 40, 30).select("asset_id", "tx", "ty", r6("luma").alias("luma"))


@register("luma_thumb_stats", f"""WITH {PIXELS}, th AS (SELECT asset_id, least(23, x * 24 // 40) AS tx, least(41, y * 42 // 30) AS ty, avg({LUMA}) AS luma FROM pixels GROUP BY 1, 2, 3)
SELECT asset_id, {s6('sum(luma) / 1008', 'luma_mean')}, {s6('sqrt(greatest(0, sum(luma * luma) / 1008 - (sum(luma) / 1008) * (sum(luma) / 1008)))', 'luma_std')} FROM th GROUP BY 1""")
def _(spark, sf):
    th = palette.luma_thumb(A.pixel_grid(spark, sf), ["asset_id"], 40, 30)
    return palette.thumb_stats(th, ["asset_id"]).select("asset_id", r6("luma_mean").alias("luma_mean"), r6("luma_std").alias("luma_std"))


@register("dominant_colors")
def _(spark, sf):
    return palette.dominant_colors(A.pixel_grid(spark, sf), ["asset_id"]).select("asset_id", "rank", "n", *[r6(c).alias(c) for c in "rgb"])


@register("palette_stats", f"WITH {PIXELS} SELECT asset_id, {s6(f'avg({LUMA})', 'brightness')}, {s6(f'avg({SAT})', 'saturation')}, {s6(f'least(2, stddev_pop({LUMA}) / 0.29)', 'contrast')} FROM pixels GROUP BY 1")
def _(spark, sf):
    return palette.palette_stats(A.pixel_grid(spark, sf), ["asset_id"]).select("asset_id", *[r6(c).alias(c) for c in ("brightness", "saturation", "contrast")])


@register("overall_palette", f"""WITH {PIXELS}, sc AS (SELECT asset_id % 4 AS video_id, asset_id AS scene_idx, avg({LUMA}) AS b, avg({SAT}) AS s, least(2, stddev_pop({LUMA}) / 0.29) AS c,
  max(o_hex) AS h1, min(o_hex) AS h2 FROM (SELECT *, printf('#%02X%02X%02X', CAST(round(r * 255) AS INT), CAST(round(g * 255) AS INT), CAST(round(b * 255) AS INT)) AS o_hex FROM pixels) GROUP BY 1, 2),
fl AS (SELECT video_id, list(h ORDER BY scene_idx, k) AS hs FROM (SELECT video_id, scene_idx, 1 AS k, h1 AS h FROM sc UNION ALL SELECT video_id, scene_idx, 2, h2 FROM sc) GROUP BY 1)
SELECT video_id, {s6('avg(b)', 'mean_brightness')}, {s6('avg(s)', 'mean_saturation')}, {s6('avg(c)', 'mean_contrast')}, any_value(array_to_string(hs[1:5], ',')) AS dominant FROM sc JOIN fl USING (video_id) GROUP BY 1""")
def _(spark, sf):
    px = A.pixel_grid(spark, sf)
    hexes = px.groupBy("asset_id").agg(F.max(color.to_hex(F.col("r"), F.col("g"), F.col("b"))).alias("_a"), F.min(color.to_hex(F.col("r"), F.col("g"), F.col("b"))).alias("_b"))
    per = palette.palette_stats(px, ["asset_id"]).join(hexes, "asset_id").select(
        (F.col("asset_id") % 4).alias("video_id"), F.col("asset_id").alias("scene_idx"), "brightness", "saturation", "contrast", F.array("_a", "_b").alias("dominant"))
    out = palette.overall_palette(per, ["video_id"], "scene_idx")
    return out.select("video_id", *[r6(f"mean_{c}").alias(f"mean_{c}") for c in ("brightness", "saturation", "contrast")], F.array_join("dominant", ",").alias("dominant"))


@register("sharpness", f"""WITH {PIXELS}, gr AS (SELECT asset_id, x, y, floor({LUMA} * 255) AS luma FROM pixels),
lp AS (SELECT asset_id, luma, 4 * luma - lag(luma) OVER rw - lead(luma) OVER rw - lag(luma) OVER cl - lead(luma) OVER cl AS lap FROM gr
  WINDOW rw AS (PARTITION BY asset_id, y ORDER BY x), cl AS (PARTITION BY asset_id, x ORDER BY y))
SELECT asset_id, {s6('sum(luma) / (count(*) * 255)', 'brightness')}, {s6('least(1, greatest(0, log10(greatest(var_pop(lap), 1)) / 3))', 'sharpness')} FROM lp WHERE lap IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    grid = A.pixel_grid(spark, sf).select("asset_id", "x", "y", F.floor(color.luma709(F.col("r"), F.col("g"), F.col("b")) * 255).cast("double").alias("luma"))
    return palette.sharpness(grid, ["asset_id"]).select("asset_id", r6("brightness").alias("brightness"), r6("sharpness").alias("sharpness"))


# --- text -------------------------------------------------------------------------------------

HITS = r"""hits AS (SELECT conv_id AS video_id, turn AS hit_id, turn * CAST(0.4 AS DOUBLE) AS t,
  string_agg(regexp_replace(coalesce(text, ''), '[\n\t]', ' ', 'g'), ' ') OVER (PARTITION BY conv_id, turn - turn % 4 ORDER BY turn ROWS UNBOUNDED PRECEDING) AS text, 0.3 + (turn % 7) / 10.0 AS confidence
  FROM conversations),
gated AS (SELECT * FROM (SELECT video_id, hit_id, t, confidence, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM hits) WHERE confidence >= 0.35 AND text <> '')"""


@register("ocr_gate", f"WITH {HITS} SELECT video_id, hit_id, text, {s6('confidence', 'confidence')} FROM gated")
def _(spark, sf):
    return text.ocr_gate(A.turn_hits(spark, sf)).select("video_id", "hit_id", "text", r6("confidence").alias("confidence"))


@register("text_sessions", f"""WITH {HITS}, g AS (SELECT *, CASE WHEN coalesce(t - lag(t) OVER w > 0.6, true) THEN 1 ELSE 0 END AS fresh FROM gated WINDOW w AS (PARTITION BY video_id ORDER BY t, hit_id))
SELECT video_id, hit_id, CAST(sum(fresh) OVER (PARTITION BY video_id ORDER BY t, hit_id) AS BIGINT) AS session FROM g""")
def _(spark, sf):
    return text.sessions(text.ocr_gate(A.turn_hits(spark, sf))).select("video_id", "hit_id", F.col("session").cast("bigint").alias("session"))


@register("text_tracks", f"""WITH RECURSIVE {HITS},
g AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, hit_id) - 1 AS pos, 0.1e0 + (hit_id // 3 % 2) * 0.1e0 AS x, 0.1e0 + (hit_id // 4 % 2) * 0.4e0 AS y, 0.4e0 + (hit_id % 4) * 0.08e0 AS w, 0.08e0 AS h FROM gated),
pr AS (SELECT b.video_id, b.pos, a.pos AS par, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS areas,
  list_distinct(list_filter(string_split(lower(a.text), ' '), lambda v: v <> '')) AS u, list_distinct(list_filter(string_split(lower(b.text), ' '), lambda v: v <> '')) AS v, starts_with(a.text, b.text) OR starts_with(b.text, a.text) AS grow
  FROM g a JOIN g b ON b.video_id = a.video_id AND b.pos > a.pos AND b.t - a.t <= 0.6),
sc AS (SELECT video_id, pos, par, i / (areas - i) AS io, CASE WHEN len(u) + len(v) = 0 THEN 1 ELSE len(list_intersect(u, v)) / (len(u) + len(v) - len(list_intersect(u, v))) END AS jac, grow FROM pr),
bp AS (SELECT video_id, pos, par FROM sc WHERE io > 0.35 AND (jac > 0.55 OR grow) QUALIFY row_number() OVER (PARTITION BY video_id, pos ORDER BY io * 0.5 + greatest(jac, CASE WHEN grow THEN 0.8 ELSE 0 END) * 0.5 DESC, par DESC) = 1),
fl AS (SELECT g.video_id, g.pos, g.pos AS track FROM g LEFT JOIN bp ON bp.video_id = g.video_id AND bp.pos = g.pos WHERE bp.par IS NULL UNION ALL SELECT bp.video_id, bp.pos, fl.track FROM fl JOIN bp ON bp.video_id = fl.video_id AND bp.par = fl.pos),
lk AS (SELECT g.*, track, row_number() OVER (PARTITION BY g.video_id, track ORDER BY g.pos) AS rn, lag(w) OVER (PARTITION BY g.video_id, track ORDER BY g.pos) AS pw FROM g JOIN fl ON fl.video_id = g.video_id AND fl.pos = g.pos),
mid AS (SELECT video_id, track, list_sort(list(x))[count(*) // 2 + 1] AS x, list_sort(list(y))[count(*) // 2 + 1] AS y, list_sort(list(w))[count(*) // 2 + 1] AS w, list_sort(list(h))[count(*) // 2 + 1] AS h, arg_max(text, struct_pack(n := length(text), p := -pos)) AS text,
  min(t) AS st, max(t) AS lt, avg(confidence) AS conf, count(*) AS n, count(*) FILTER (rn <= 6 AND w > pw * 1.08) AS growth FROM lk GROUP BY 1, 2 HAVING count(*) >= 2),
fin AS (SELECT mid.*, secs, (lt - st) / greatest(secs, 0.001) AS coverage FROM mid JOIN (SELECT video_id, max(t) + 1 AS secs FROM hits GROUP BY 1) s ON s.video_id = mid.video_id)
SELECT video_id, track, text, {s6('st', 'start_t')}, {s6('least(secs, lt + 0.1)', 'end_t')}, {s6('x', 'x')}, {s6('y', 'y')}, {s6('w', 'w')}, {s6('h', 'h')}, {s6('conf', 'mean_confidence')},
  starts_with(lower(text), '@') OR regexp_matches(lower(text), '(^|\\s)@[a-z0-9._]{{2,}}') OR regexp_matches(lower(text), 'follow|subscribe|link in bio|swipe up|dm me|tap here|click link|shop now at|made with|created with')
  OR (h < 0.035 AND (y + h / 2 < 0.14 OR y + h / 2 > 0.88) AND (x + w / 2 < 0.30 OR x + w / 2 > 0.70) AND coverage > 0.75) AS is_watermark, n AS observations, growth FROM fin""")
def _(spark, sf):
    hits = A.turn_hits(spark, sf)
    seconds = hits.groupBy("video_id").agg((F.max("t") + 1).alias("video_seconds"))
    return text.text_tracks(hits, seconds).select(
        "video_id", "track", "text", r6("start").alias("start_t"), r6("end").alias("end_t"), *rect6("frame"), r6("mean_confidence").alias("mean_confidence"), "is_watermark", "observations", "growth")


TRACKS = """tracks AS (SELECT doc_id % 50 AS video_id, doc_id AS track, CASE WHEN doc_id % 7 = 0 THEN '@' || text WHEN doc_id % 11 = 0 THEN text || ' follow for more' ELSE text END AS text,
  doc_id // 50 * CAST(0.7 AS DOUBLE) AS start, doc_id // 50 * CAST(0.7 AS DOUBLE) + 1.1 AS "end", (doc_id % 60) / 100.0 AS x, (doc_id % 19) / 20.0 AS y, CAST(0.2 AS DOUBLE) + (doc_id % 4) / 10.0 AS w,
  CAST(0.02 AS DOUBLE) + (doc_id % 8) / 100.0 AS h, (doc_id % 5) / 4.0 AS coverage, doc_id % 4 AS growth, 2 + doc_id % 5 AS observations FROM documents),
flagged AS (SELECT *, starts_with(lower(text), '@') OR regexp_matches(lower(text), '(^|\\s)@[a-z0-9._]{2,}') OR regexp_matches(lower(text), 'follow|subscribe|link in bio|swipe up|dm me|tap here|click link|shop now at|made with|created with')
  OR (h < 0.035 AND (y + h / 2 < 0.14 OR y + h / 2 > 0.88) AND (x + w / 2 < 0.30 OR x + w / 2 > 0.70) AND coverage > 0.75) AS wm FROM tracks)"""


def _flagged(spark, sf):
    from cutlens.functions.text import is_watermark

    return A.text_tracks(spark, sf).withColumn("is_watermark", is_watermark(F.col("text"), F.col("frame"), F.col("coverage")))


@register("is_watermark", f"WITH {TRACKS} SELECT video_id, track, wm AS is_watermark FROM flagged")
def _(spark, sf):
    return _flagged(spark, sf).select("video_id", "track", "is_watermark")


@register("usable_text", f"WITH {TRACKS} SELECT video_id, track, dropped FROM (SELECT *, CAST(sum(CASE WHEN wm THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS BIGINT) AS dropped FROM flagged) WHERE NOT wm")
def _(spark, sf):
    return text.usable_text(_flagged(spark, sf)).select("video_id", "track", "dropped")


SLOTS = f"""{TRACKS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start, track) - 1 AS slot_idx, count(*) OVER (PARTITION BY video_id) AS n, max(h) OVER (PARTITION BY video_id) AS largest FROM flagged WHERE NOT wm),
slots AS (SELECT *, CASE WHEN regexp_matches(lower(text), 'dm|order|shop|buy|book|call|link|swipe|get yours|available|message|whatsapp|enquire|visit') THEN 'cta' WHEN slot_idx = 0 AND h >= largest * 0.85 THEN 'title'
  WHEN slot_idx = n - 1 AND n > 1 THEN 'cta' WHEN h >= largest * 0.7 THEN 'subtitle' ELSE 'caption' END AS role,
  w / greatest(1, length(text)) / h AS ratio FROM ranked)"""


@register("compile_text_slots", f"""WITH {SLOTS} SELECT video_id, printf('text_%02d', slot_idx + 1) AS slot_id, track_text, role, alignment, font, {s6('font_confidence', 'font_confidence')}, entry, {s6('entry_confidence', 'entry_confidence')}, char_hint FROM (
  SELECT *, md5(text) AS track_text, CASE WHEN x + w / 2 < 0.38 THEN 'leading' WHEN x + w / 2 >= 0.62 THEN 'trailing' ELSE 'center' END AS alignment, CASE WHEN ratio < 0.34 THEN 'condensed' WHEN h > 0.075 THEN 'displayBold' ELSE 'sansSerif' END AS font,
  CASE WHEN ratio < 0.34 THEN 0.46 WHEN h > 0.075 THEN 0.44 ELSE 0.38 END AS font_confidence, CASE WHEN growth >= 2 THEN 'wordByWord' ELSE 'fadeIn' END AS entry,
  CASE WHEN growth >= 2 THEN 0.62 WHEN observations >= 4 THEN 0.44 ELSE 0.30 END AS entry_confidence, CAST(length(text) AS INT) AS char_hint FROM slots)""")
def _(spark, sf):
    s = template.compile_text_slots(_flagged(spark, sf))
    return s.select("video_id", "slot_id", F.md5(F.encode("sample_text", "utf-8")).alias("track_text"), "role", "alignment", F.col("font.value").alias("font"), r6("font.confidence").alias("font_confidence"),
                    F.col("animation.entry").alias("entry"), r6("animation.entry_confidence").alias("entry_confidence"), "char_hint")


@register("width_growth", f"""WITH w AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
f AS (SELECT *, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY rn) AS p FROM w WHERE rn <= 6)
SELECT l_orderkey AS video_id, CAST(sum(CASE WHEN l_quantity > p * 1.08 THEN 1 ELSE 0 END) AS BIGINT) AS growth FROM f GROUP BY 1""")
def _(spark, sf):
    c = A.clips(spark, sf).select(F.col("project_id").alias("video_id"), F.lit(0).alias("track"), "pos", (F.col("duration") / 0.037).alias("width"))
    # quantities are whole numbers
    return text.width_growth(c.withColumn("width", F.round("width"))).select("video_id", "growth")


# --- templates --------------------------------------------------------------------------------

ROLES = """areas AS (SELECT *, CASE WHEN (shot_idx + video_id) % 4 = 3 THEN NULL ELSE (shot_idx * 7 + video_id) % 60 / 100.0 END AS a, "end" - start AS d,
  count(*) OVER (PARTITION BY video_id) AS n, avg("end" - start) OVER (PARTITION BY video_id) AS mean FROM shots),
hero AS (SELECT video_id, shot_idx AS hero_idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY d DESC, shot_idx) AS rn FROM areas WHERE shot_idx > 0 AND shot_idx < n - 1) WHERE rn = 1),
roles AS (SELECT a.*, CASE WHEN shot_idx = 0 THEN 'opening' WHEN n <= 2 OR shot_idx = n - 1 THEN 'closing' WHEN shot_idx = hero_idx AND d > mean * 1.4 THEN 'hero' WHEN a >= 0.45 THEN 'detail' WHEN a < 0.18 THEN 'wide' ELSE 'body' END AS role,
  CASE WHEN n <= 2 THEN 0.55 WHEN shot_idx = 0 OR shot_idx = n - 1 THEN 0.86 WHEN shot_idx = hero_idx AND d > mean * 1.4 THEN 0.71 WHEN a >= 0.45 OR a < 0.18 THEN 0.66 ELSE 0.58 END AS role_confidence
  FROM areas a LEFT JOIN hero USING (video_id))"""


def shots_with_areas(spark, sf):
    i = F.col("shot_idx")
    return _shots(spark, sf).withColumn("salient_area", F.when((i + F.col("video_id")) % 4 != 3, (i * 7 + F.col("video_id")) % 60 / 100.0))


@register("scene_roles", f"WITH RECURSIVE {SHOTS}, {ROLES} SELECT video_id, shot_idx, role, {s6('role_confidence', 'confidence')} FROM roles")
def _(spark, sf):
    return template.scene_roles(shots_with_areas(spark, sf)).select("video_id", "shot_idx", F.col("role.value").alias("role"), r6("role.confidence").alias("confidence"))


TEMPLATE = f"""{SHOTS}, {ROLES}, {RAW_MOTION}, one AS (SELECT l_suppkey % 60 AS mid, arg_min(scale, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) AS scale, arg_min(tx, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) AS tx,
  arg_min(ty, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) AS ty, arg_min(rot, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) AS rot, arg_min(residual, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) AS residual,
  arg_min(n, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) AS n FROM m GROUP BY 1),
moved AS (SELECT r.*, r.kind AS bkind, o.* EXCLUDE (n), o.n AS mn FROM roles r LEFT JOIN one o ON o.mid = (r.shot_idx * 3 + r.video_id) % 80),
scenes AS (SELECT *, CASE WHEN mid IS NULL THEN 1.0 WHEN mn <= 0 THEN 1.0 WHEN {KIND} IN ('rotate', 'complex') THEN least({CONF.replace('n > 0', 'mn > 0').replace('n / 5.0', 'mn / 5.0')}, 0.5) ELSE {CONF.replace('n > 0', 'mn > 0').replace('n / 5.0', 'mn / 5.0')} END AS mconf,
  CASE WHEN mid IS NULL OR mn <= 0 THEN 'none' WHEN {KIND} IN ('rotate', 'complex') THEN 'zoomIn' ELSE {KIND} END AS move, coalesce(least(1, abs(scale - 1) * 3 + sqrt(tx * tx + ty * ty) * 4), 0) AS energy,
  CASE WHEN bkind IN ('start', 'cut') THEN 'cut' WHEN bkind = 'dissolve' THEN 'dissolve' WHEN bkind IN ('fadeFromBlack', 'fadeToBlack') THEN 'fadeToBlack' ELSE 'fadeToWhite' END AS tkind FROM moved)"""


def _compiled(spark, sf):
    i = F.col("shot_idx")
    raw = _raw_motion(spark, sf).groupBy((F.col("l_suppkey") % 60).alias("mid")).agg(F.min_by("m", (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")).alias("motion"))
    rows = shots_with_areas(spark, sf).withColumn("mid", (i * 3 + F.col("video_id")) % 80).join(raw, "mid", "left")
    blank = F.lit(None).cast("struct<x:double,y:double,w:double,h:double>")
    return template.compile_scenes(rows.withColumn("subject", blank).withColumn("palette", F.lit(None).cast("struct<brightness:double,saturation:double,contrast:double>")))


@register("compile_scenes", f"""WITH RECURSIVE {TEMPLATE} SELECT video_id, printf('scene_%02d', shot_idx + 1) AS scene_id, role, CASE WHEN a IS NULL THEN 'medium' WHEN a >= 0.45 THEN 'closeUp' WHEN a >= 0.18 THEN 'medium' ELSE 'wide' END AS framing,
  CASE WHEN mid IS NULL THEN 'unknown' WHEN energy > 0.12 THEN 'video' ELSE 'image' END AS source_kind, move, {s6('mconf', 'move_confidence')}, CASE WHEN shot_idx > 0 THEN tkind END AS transition,
  {s6('CASE WHEN shot_idx > 0 THEN CASE WHEN tkind = $$cut$$ THEN 0 ELSE least(greatest(boundary_seconds, 0.12), 0.8) END END', 'transition_seconds')} FROM scenes""")
def _(spark, sf):
    return _compiled(spark, sf).select("video_id", "scene_id", F.col("role.value").alias("role"), F.col("framing.value").alias("framing"), "source_kind", F.col("move.kind").alias("move"), r6("move.confidence").alias("move_confidence"),
                                       F.col("transition.kind").alias("transition"), r6("transition.duration").alias("transition_seconds"))


@register("template_stats", f"""WITH RECURSIVE {TEMPLATE}, tx AS (SELECT doc_id % 50 AS video_id, count(*) AS c FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1)
SELECT s.video_id, count(*) AS scene_count, {s6('list_sort(list("end" - start))[count(*) // 2 + 1]', 'median_seconds')}, {s6('(count(*) - 1) / any_value(video_seconds)', 'cuts_per_second')},
  CAST(sum(CASE WHEN shot_idx > 0 AND tkind <> 'cut' AND confidence >= 0.55 THEN 1 ELSE 0 END) AS BIGINT) AS transition_count, coalesce(any_value(c), 0) AS text_slot_count
FROM scenes s JOIN seconds d ON d.video_id = s.video_id LEFT JOIN tx ON tx.video_id = s.video_id GROUP BY 1""")
def _(spark, sf):
    slots = A.text_tracks(spark, sf).select("video_id", F.when(F.col("track") % 7 == 0, "watermark").otherwise("caption").alias("role"))
    out = template.template_stats(_compiled(spark, sf), slots, A.durations(A.frames(spark, sf)))
    return out.select("video_id", "scene_count", r6("median_seconds").alias("median_seconds"), r6("cuts_per_second").alias("cuts_per_second"), "transition_count", "text_slot_count")


@register("confidence_rollup", f"""WITH RECURSIVE {TEMPLATE}, p AS (SELECT video_id, (sum(role_confidence) + coalesce(sum(CASE WHEN shot_idx > 0 THEN confidence END), 0)) / (count(*) + count(CASE WHEN shot_idx > 0 THEN 1 END)) AS scenes_c, avg(mconf) AS motion_c FROM scenes GROUP BY 1),
q AS (SELECT *, CASE WHEN video_id % 3 = 0 THEN 1.0 ELSE (video_id % 10) / 10.0 END AS text_c, CASE WHEN video_id % 4 = 0 THEN 1.0 ELSE (video_id % 7) / 7.0 END AS audio_c FROM p)
SELECT video_id, {s6('scenes_c', 'scenes')}, {s6('motion_c', 'motion')}, {s6('scenes_c * 0.4 + motion_c * 0.25 + audio_c * 0.2 + text_c * 0.15', 'overall')},
  CASE WHEN scenes_c <= least(motion_c, audio_c, text_c) THEN 'scenes' WHEN motion_c <= least(audio_c, text_c) THEN 'motion' WHEN audio_c <= text_c THEN 'audio' ELSE 'text' END AS weakest FROM q""")
def _(spark, sf):
    v = F.col("video_id")
    compiled = _compiled(spark, sf)
    ids = A.frames(spark, sf).select("video_id").distinct()
    slots = ids.filter("video_id % 3 <> 0").select("video_id", F.struct(((v % 10) / 10.0).alias("confidence")).alias("font"))
    tempo = ids.filter("video_id % 4 <> 0").select("video_id", ((v % 7) / 7.0).alias("confidence"))
    return template.compile_confidence(compiled, slots, tempo).select("video_id", r6("scenes").alias("scenes"), r6("motion").alias("motion"), r6("overall").alias("overall"), "weakest")


@register("aligned_ratio", f"""WITH {FRAMES}, cb AS (SELECT video_id, frame_idx, t, event_type FROM frames), j AS (SELECT c.video_id, c.frame_idx, min(abs(b.t - c.t)) AS gap FROM cb c LEFT JOIN cb b ON b.video_id = c.video_id AND b.event_type = 'click' WHERE c.event_type = 'purchase' GROUP BY 1, 2)
SELECT video_id, count(*) AS cuts, CAST(sum(CASE WHEN gap <= 0.08 THEN 1 ELSE 0 END) AS BIGINT) AS aligned, {s6('sum(CASE WHEN gap <= 0.08 THEN 1 ELSE 0 END) / count(*)', 'ratio')} FROM j GROUP BY 1""")
def _(spark, sf):
    f = A._ordered_events(spark, sf, ["event_type"]).select(F.col("user_id").alias("video_id"), (F.col("frame_idx") / 30.0).alias("t"), "event_type")
    out = template.aligned_ratio(f.filter("event_type = 'purchase'"), f.filter("event_type = 'click'"), ["video_id"])
    return out.select("video_id", "cuts", "aligned", r6("ratio").alias("ratio"))
