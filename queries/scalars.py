"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlens.functions import color, geometry as g, labels, text as txt
from cutlens.functions import constants as K
from cutlens.sources import adapters as A
from queries.visual import HITS
from queries.common import r6, rect6, registry, s6

JOBS, SQL, register = registry()

PIX = """px AS (SELECT o_orderkey, (o_custkey % 51) / 50.0 AS r, (o_orderkey % 97) / 96.0 AS g, CAST(floor(o_totalprice) AS BIGINT) % 101 / 100.0 AS b FROM orders)"""
LUMA = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"


def _px(spark, sf):
    return A.pixel_grid(spark, sf).select(F.col("sample_id").alias("o_orderkey"), "r", "g", "b")




def _rgb():
    return F.col("r"), F.col("g"), F.col("b")


@register("rgb_to_hsv", f"""WITH {PIX}, d AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS dl FROM px)
SELECT o_orderkey, {s6('''CASE WHEN dl <= 1e-6 THEN 0 WHEN mx = r THEN CASE WHEN (g - b) / dl < 0 THEN ((g - b) / dl + 6) / 6 ELSE (g - b) / dl / 6 END
  WHEN mx = g THEN ((b - r) / dl + 2) / 6 ELSE ((r - g) / dl + 4) / 6 END''', 'h')}, {s6('CASE WHEN mx > 1e-6 THEN dl / mx ELSE 0 END', 's')}, {s6('mx', 'v')}, {s6(LUMA, 'luma')} FROM d""")
def _(spark, sf):
    hsv = color.rgb_to_hsv(*_rgb())
    return _px(spark, sf).withColumn("c", hsv).select("o_orderkey", r6("c.h").alias("h"), r6("c.s").alias("s"), r6("c.v").alias("v"), r6(color.luma709(*_rgb())).alias("luma"))


@register("hue_distance", f"WITH {PIX} SELECT o_orderkey, {s6('least(abs(r - g), 1 - abs(r - g))', 'near')}, {s6('(least(abs(r - g), 1 - abs(r - g)) + least(abs(g - b), 1 - abs(g - b))) / 2 * 2', 'plane')} FROM px")
def _(spark, sf):
    return _px(spark, sf).select("o_orderkey", r6(color.hue_distance(F.col("r"), F.col("g"))).alias("near"),
                                 r6(color.mean_hue_distance(F.array("r", "g"), F.array("g", "b"))).alias("plane"))


@register("rgb_metrics", f"""WITH {PIX} SELECT o_orderkey, {s6(LUMA, 'luma')}, {s6('CASE WHEN greatest(r, g, b) > 1e-6 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END', 'saturation')},
  {s6('(r - b) * (r - b) + (g - r) * (g - r) + (b - g) * (b - g)', 'distance2')} FROM px""")
def _(spark, sf):
    r, gr, b = _rgb()
    return _px(spark, sf).select("o_orderkey", r6(color.luma709(r, gr, b)).alias("luma"), r6(color.saturation(r, gr, b)).alias("saturation"), r6(color.distance2(r, gr, b, b, r, gr)).alias("distance2"))


@register("apply_grade", f"""WITH {PIX}, gr AS (SELECT *, (o_orderkey % 9 - 4) / 10.0 AS e, 0.8 + (o_orderkey % 7) / 10.0 AS c, (o_orderkey % 11) / 8.0 AS s, (o_orderkey % 5 - 2) / 4.0 AS t FROM px),
l AS (SELECT *, (r * power(2.0, e) - 0.5) * c + 0.5 AS r1, (g * power(2.0, e) - 0.5) * c + 0.5 AS g1, (b * power(2.0, e) - 0.5) * c + 0.5 AS b1 FROM gr),
m AS (SELECT *, 0.2126 * r1 + 0.7152 * g1 + 0.0722 * b1 AS y FROM l)
SELECT o_orderkey, {s6('least(1, greatest(0, y + (r1 - y) * s + t * 0.06))', 'r')}, {s6('least(1, greatest(0, y + (g1 - y) * s))', 'g')}, {s6('least(1, greatest(0, y + (b1 - y) * s - t * 0.06))', 'b')} FROM m""")
def _(spark, sf):
    o = F.col("o_orderkey")
    gr = color.grade((o % 9 - 4) / 10.0, 0.8 + (o % 7) / 10.0, (o % 11) / 8.0, (o % 5 - 2) / 4.0)
    return _px(spark, sf).withColumn("q", color.apply_grade(*_rgb(), gr)).select("o_orderkey", *[r6(f"q.{c}").alias(c) for c in "rgb"])


@register("grades", """WITH p AS (SELECT s_suppkey, (s_suppkey % 11) / 10.0 AS ab, (s_suppkey % 13) / 12.0 AS asat, (s_suppkey % 7) / 4.0 AS ac, (s_suppkey % 17) / 16.0 AS rb, (s_suppkey % 5) / 4.0 AS rs, (s_suppkey % 9) / 5.0 AS rc FROM supplier)
SELECT s_suppkey, """ + ", ".join([
    s6("least(0.25, greatest(-0.25, (rb - ab) * 0.5))", "exposure"), s6("least(1.25, greatest(0.85, 1 + (CASE WHEN ac > 0.01 THEN rc / ac ELSE 1 END - 1) * 0.4))", "contrast"),
    s6("least(1.30, greatest(0.80, 1 + (CASE WHEN asat > 0.01 THEN rs / asat ELSE 1 END - 1) * 0.4))", "saturation"), s6("least(1.2, greatest(0.9, ac))", "scene_contrast"),
    s6("least(1.25, greatest(0.85, asat / greatest(0.01, rs)))", "scene_saturation")]) + " FROM p")
def _(spark, sf):
    k = F.col("s_suppkey")
    pal = lambda b, s, c: F.struct(b.alias("brightness"), s.alias("saturation"), c.alias("contrast"))
    a, r = pal((k % 11) / 10.0, (k % 13) / 12.0, (k % 7) / 4.0), pal((k % 17) / 16.0, (k % 5) / 4.0, (k % 9) / 5.0)
    rows = A.table(spark, sf, "supplier").select("s_suppkey", a.alias("a"), r.alias("r"))
    i, s = color.infer_grade(F.col("a"), F.col("r")), color.scene_grade(F.col("a.contrast"), F.col("a.saturation"), F.col("r.saturation"))
    return rows.select("s_suppkey", *[r6(i[c]).alias(c) for c in ("exposure", "contrast", "saturation")], r6(s["contrast"]).alias("scene_contrast"), r6(s["saturation"]).alias("scene_saturation"))


@register("hex_colors", f"""WITH {PIX}, h AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN 'nonsense' WHEN 4 THEN '#12' ELSE printf('#%02X%02X%02X', CAST(round(r * 255) AS INT), CAST(round(g * 255) AS INT), CAST(round(b * 255) AS INT)) || CASE WHEN o_orderkey % 5 = 1 THEN '80' ELSE '' END END AS hex FROM px)
SELECT o_orderkey, hex, {s6("CASE WHEN length(hex) IN (7, 9) AND hex LIKE '#%' THEN CAST('0x' || substr(hex, 2, 2) AS INT) / 255.0 ELSE 1 END", 'r')},
  {s6("CASE WHEN length(hex) IN (7, 9) AND hex LIKE '#%' THEN CAST('0x' || substr(hex, 6, 2) AS INT) / 255.0 ELSE 1 END", 'b')}, {s6("CASE WHEN length(hex) = 9 THEN 128 / 255.0 ELSE 1 END", 'a')} FROM h""")
def _(spark, sf):
    k = F.col("o_orderkey") % 5
    hx = F.concat(color.to_hex(*_rgb()), F.when(k == 1, "80").otherwise(""))
    rows = _px(spark, sf).withColumn("hex", F.when(k == 3, "nonsense").when(k == 4, "#12").otherwise(hx)).withColumn("p", color.parse_hex(F.col("hex")))
    return rows.select("o_orderkey", "hex", *[r6(f"p.{c}").alias(c) for c in "rba"])


_PRESET_SQL = ", ".join("(" + ", ".join([str(i), f"'{p[0]}'", *[f"CAST({v} AS DOUBLE)" for v in p[1:]]]) + ")" for i, p in enumerate(K.PRESETS))


@register("match_preset", f"""WITH presets(i, id, e, c, s, t, v, n) AS (VALUES {_PRESET_SQL}),
look AS (SELECT p_partkey, p.e + (p_partkey % 3) * 0.004 AS e, p.c AS c, p.s - (p_partkey % 4) * 0.003 AS s, p.t AS t, p.v + (p_partkey % 5) * 0.003 AS v, p.n AS n FROM part JOIN presets p ON p.i = p_partkey % 10),
hit AS (SELECT p_partkey, p.id, row_number() OVER (PARTITION BY p_partkey ORDER BY p.i) AS rn FROM look l JOIN presets p ON abs(p.e - l.e) < 0.01 AND abs(p.c - l.c) < 0.01 AND abs(p.s - l.s) < 0.01 AND abs(p.t - l.t) < 0.01 AND abs(p.v - l.v) < 0.01 AND abs(p.n - l.n) < 0.01)
SELECT part.p_partkey, id AS preset FROM part LEFT JOIN hit ON hit.p_partkey = part.p_partkey AND rn = 1""")
def _(spark, sf):
    k = F.col("p_partkey")
    at = lambda j: F.get(F.array(*[F.lit(float(p[j])) for p in K.PRESETS]), (k % 10).cast("int"))
    gr = color.grade(at(1) + (k % 3) * 0.004, at(2), at(3) - (k % 4) * 0.003, at(4))
    return A.table(spark, sf, "part").select("p_partkey", color.match_preset(gr, at(5) + (k % 5) * 0.003, at(6)).alias("preset"))


RECTS = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 4 AS x, l_tax * 4 AS y, l_quantity / 60.0 + 0.05 AS w, (l_partkey % 40) / 50.0 + 0.05 AS h,
  (l_suppkey % 10) / 20.0 AS x2, (l_suppkey % 7) / 20.0 AS y2, CAST(0.5 AS DOUBLE) AS w2, CAST(0.4 AS DOUBLE) AS h2 FROM lineitem)"""
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = ", ".join(KEYS)


def _rects(spark, sf):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    a = g.rect(F.col("l_discount") * 4, F.col("l_tax") * 4, F.col("l_quantity") / 60.0 + 0.05, (p % 40) / 50.0 + 0.05)
    return A.table(spark, sf, "lineitem").select(*KEYS, a.alias("a"), g.rect((s % 10) / 20.0, (s % 7) / 20.0, F.lit(0.5), F.lit(0.4)).alias("b"))


@register("rect_algebra", f"""WITH {RECTS}, c AS (SELECT *, least(w * 1.3, 1) AS cw, least(h * 1.3, 1) AS ch, x + w / 2 - w * 1.3 / 2 + 0.05 AS ox, y + h / 2 - h * 1.3 / 2 - 0.05 AS oy FROM r),
i AS (SELECT *, greatest(0, least(x + w, x2 + w2) - greatest(x, x2)) * greatest(0, least(y + h, y2 + h2) - greatest(y, y2)) AS inter FROM c)
SELECT {KEY_SQL}, {s6('w * h', 'area')}, {s6('x + w / 2', 'cx')}, {s6('least(greatest(ox, 0), 1 - cw)', 'x')}, {s6('least(greatest(oy, 0), 1 - ch)', 'y')}, {s6('cw', 'w')}, {s6('ch', 'h')},
  {s6('CASE WHEN w * h + w2 * h2 - inter > 0 THEN inter / (w * h + w2 * h2 - inter) ELSE 0 END', 'iou')}, {s6('least(x, x2)', 'ux')}, {s6('greatest(y + h, y2 + h2) - least(y, y2)', 'uh')}, {s6('x + (x2 - x) * 0.3', 'lx')}, {s6('1 - y - h', 'flip_y')} FROM i""")
def _(spark, sf):
    a, b = F.col("a"), F.col("b")
    c = g.clamp_inside(g.offset(g.scaled(a, 1.3), 0.05, -0.05))
    return _rects(spark, sf).withColumn("c", c).select(
        *KEYS, r6(g.area(a)).alias("area"), r6(g.center_x(a)).alias("cx"), *rect6("c"), r6(g.iou(a, b)).alias("iou"), r6(g.union(a, b)["x"]).alias("ux"), r6(g.union(a, b)["h"]).alias("uh"),
        r6(g.lerp(a, b, F.lit(0.3))["x"]).alias("lx"), r6(g.from_bottom_left(a["x"], a["y"], a["w"], a["h"])["y"]).alias("flip_y"))


@register("easing_and_snapping", f"""WITH e AS (SELECT {KEY_SQL}, l_quantity / 40.0 - 0.1 AS t0, least(1, greatest(0, l_quantity / 40.0 - 0.1)) AS t, l_linenumber % 4 AS k, l_extendedprice / 1000 AS s FROM lineitem)
SELECT {KEY_SQL}, {s6('CASE k WHEN 0 THEN t WHEN 1 THEN t * t WHEN 2 THEN t * (2 - t) ELSE CASE WHEN t < 0.5 THEN 2 * t * t ELSE -1 + (4 - 2 * t) * t END END', 'eased')}, {s6('round(s * 30) / 30', 'snapped')}, CAST(round(s * 24) AS BIGINT) AS frames24 FROM e""")
def _(spark, sf):
    kind = F.get(F.array(*[F.lit(v) for v in ("linear", "easeIn", "easeOut", "easeInOut")]), F.col("l_linenumber") % 4)
    s = F.col("l_extendedprice") / 1000
    return A.table(spark, sf, "lineitem").select(*KEYS, r6(g.ease(kind, F.col("l_quantity") / 40.0 - 0.1)).alias("eased"), r6(g.snap_to_frame(s, 30)).alias("snapped"), g.frame_count(s, 24).alias("frames24"))


@register("aspect_and_orientation", """WITH a AS (SELECT o_orderkey, 200 + o_custkey % 1700 AS w, (o_orderkey % 19) * 100 AS h FROM orders)
SELECT o_orderkey, CASE WHEN h <= 0 THEN 'other' WHEN w / h < 0.60 THEN 'portrait9x16' WHEN w / h < 0.90 THEN 'portrait4x5' WHEN w / h < 1.15 THEN 'square1x1' WHEN w / h < 2.10 THEN 'landscape16x9' ELSE 'other' END AS preset,
  CASE WHEN (CASE WHEN h > 0 THEN w / h ELSE 1 END) < 0.9 THEN 'portrait' WHEN (CASE WHEN h > 0 THEN w / h ELSE 1 END) <= 1.1 THEN 'square' ELSE 'landscape' END AS orientation,
  CASE WHEN (o_orderkey % 100) / 100.0 >= 0.45 THEN 'closeUp' WHEN (o_orderkey % 100) / 100.0 >= 0.18 THEN 'medium' ELSE 'wide' END AS framing FROM a""")
def _(spark, sf):
    o = F.col("o_orderkey")
    w, h = 200 + F.col("o_custkey") % 1700, (o % 19) * 100
    return A.table(spark, sf, "orders").select("o_orderkey", g.aspect_preset(w, h).alias("preset"), g.orientation(g.aspect_ratio(w, h)).alias("orientation"), g.shot_framing((o % 100) / 100.0).alias("framing"))


@register("confidence_gates", """WITH c AS (SELECT event_id, (event_id % 101) / 100.0 AS c, event_type, (event_id % 7) / 10.0 AS d FROM events)
SELECT event_id, CASE WHEN c >= 0.80 THEN 'confident' WHEN c >= 0.55 THEN 'likely' WHEN c >= 0.30 THEN 'uncertain' ELSE 'speculative' END AS band, c >= 0.55 AS trusted, c >= 0.30 AS displayed,
  CASE WHEN c >= 0.55 THEN event_type ELSE 'cut' END AS effective, round(CAST(CASE WHEN c >= 0.55 THEN d ELSE 0 END AS DOUBLE) + 1e-9, 6) AS seconds FROM c""")
def _(spark, sf):
    c = (F.col("event_id") % 101) / 100.0
    kind = labels.effective(F.col("event_type"), c, "cut")
    return A.table(spark, sf, "events").select("event_id", labels.confidence_band(c).alias("band"), labels.is_trusted(c).alias("trusted"), labels.is_displayed(c).alias("displayed"), kind.alias("effective"),
                                               r6(labels.effective_duration(kind, (F.col("event_id") % 7) / 10.0)).alias("seconds"))


@register("transition_of", f"""WITH b AS (SELECT event_id, ['start','cut','dissolve','unknownGradual','fadeFromBlack','fadeToBlack','fadeFromWhite','fadeToWhite'][event_id % 8 + 1] AS k, value / 300 AS d FROM events)
SELECT event_id, CASE WHEN k IN ('start', 'cut') THEN 'cut' WHEN k IN ('dissolve', 'unknownGradual') THEN 'dissolve' WHEN k LIKE '%Black' THEN 'fadeToBlack' ELSE 'fadeToWhite' END AS kind,
  {s6("CASE WHEN k IN ('start', 'cut') THEN 0 ELSE least(0.8, greatest(0.12, d)) END", 'duration')} FROM b""")
def _(spark, sf):
    from cutlens.functions.motion import transition_of

    kinds = F.array(*[F.lit(k) for k in ("start", "cut", "dissolve", "unknownGradual", "fadeFromBlack", "fadeToBlack", "fadeFromWhite", "fadeToWhite")])
    t = transition_of(F.get(kinds, (F.col("event_id") % 8).cast("int")), F.col("value") / 300)
    return A.table(spark, sf, "events").withColumn("t", t).select("event_id", F.col("t.kind").alias("kind"), r6("t.duration").alias("duration"))


@register("pacing_and_tags", """WITH s AS (SELECT doc_id, (doc_id % 31) / 10.0 AS m, doc_id % 4 = 1 AS al, doc_id % 6 AS tx, doc_id % 3 AS tr, CASE WHEN doc_id % 5 = 0 THEN [lang, source] END AS own FROM documents)
SELECT doc_id, CASE WHEN m < 0.6 THEN 'Very fast cuts' WHEN m < 1.2 THEN 'Fast cuts' WHEN m < 2.5 THEN 'Steady pacing' ELSE 'Relaxed pacing' END AS pacing,
  CASE WHEN own IS NOT NULL THEN array_to_string(own, ',') ELSE coalesce(nullif(concat_ws(',', CASE WHEN m < 0.8 THEN 'Fast Reel' WHEN m > 2.0 THEN 'Slideshow' END, CASE WHEN al THEN 'Beat Sync' END, CASE WHEN tx >= 3 THEN 'Text Heavy' END, CASE WHEN tr = 0 THEN 'Minimal' END), ''), 'Reference') END AS tags FROM s""")
def _(spark, sf):
    d = F.col("doc_id")
    m = (d % 31) / 10.0
    tags = labels.derived_tags(F.when(d % 5 == 0, F.array("lang", "source")), m, d % 4 == 1, d % 6, d % 3)
    return A.table(spark, sf, "documents").select("doc_id", labels.pacing_label(m).alias("pacing"), F.array_join(tags, ",").alias("tags"))


@register("token_jaccard", f"""WITH {HITS}, p AS (SELECT a.video_id AS conv_id, a.hit_id AS turn, lower(a.text) AS x, lower(b.text) AS y FROM hits a JOIN hits b ON b.video_id = a.video_id AND b.hit_id = a.hit_id + 1),
t AS (SELECT *, list_distinct(list_filter(string_split(x, ' '), lambda w: w <> '')) AS u, list_distinct(list_filter(string_split(y, ' '), lambda w: w <> '')) AS v FROM p)
SELECT conv_id, turn, {s6('CASE WHEN len(u) = 0 AND len(v) = 0 THEN 1 ELSE len(list_intersect(u, v)) / (len(u) + len(v) - len(list_intersect(u, v))) END', 'jaccard')}, starts_with(x, y) OR starts_with(y, x) AS growing FROM t""")
def _(spark, sf):
    """What is on screen at a turn against what is there at the next."""
    c = A.turn_hits(spark, sf).select(F.col("video_id").alias("conv_id"), F.col("hit_id").alias("turn"), "text")
    rows = c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other")), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", r6(txt.token_jaccard(F.col("text"), F.col("other"))).alias("jaccard"), txt.is_growing(F.lower("text"), F.lower("other")).alias("growing"))


@register("export_sizing", f"""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1080 WHEN 1 THEN 1920 WHEN 2 THEN 1080 ELSE 1080 END AS w, CASE o_orderkey % 4 WHEN 0 THEN 1920 WHEN 1 THEN 1080 WHEN 2 THEN 1350 ELSE 1080 END AS h,
  o_orderkey % 2 = 0 AS hevc, ['standard', 'high', 'maximum'][o_orderkey % 3 + 1] AS q, o_totalprice / 5000 AS secs FROM orders),
z AS (SELECT *, CAST(CASE WHEN w / h >= 1 THEN round(719 * (w / h)) ELSE 719 END AS BIGINT) AS zw, CAST(CASE WHEN w / h >= 1 THEN 719 ELSE round(719 / (w / h)) END AS BIGINT) AS zh FROM o),
e AS (SELECT *, zw - zw % 2 AS width, zh - zh % 2 AS height FROM z),
b AS (SELECT *, CAST(floor(CAST(width * height * 30 AS DOUBLE) * (CASE WHEN hevc THEN 0.09 ELSE 0.14 END) * (CASE q WHEN 'standard' THEN 0.65 WHEN 'maximum' THEN 1.6 ELSE 1.0 END)) AS BIGINT) AS bitrate FROM e)
SELECT o_orderkey, width, height, bitrate, CAST(floor(CAST(bitrate AS DOUBLE) / 8 * secs * 1.2) AS BIGINT) + 200000 AS bytes FROM b""")
def _(spark, sf):
    o = F.col("o_orderkey")
    w, h = F.when(o % 4 == 1, 1920).otherwise(1080), F.when(o % 4 == 0, 1920).when(o % 4 == 2, 1350).otherwise(1080)
    q = F.get(F.array(F.lit("standard"), F.lit("high"), F.lit("maximum")), (o % 3).cast("int"))
    rows = A.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", q.alias("q"), labels.export_size(w, h, 719).alias("z"))
    rate = labels.bitrate(F.col("z.width"), F.col("z.height"), F.lit(30), o % 2 == 0, F.col("q"))
    return rows.withColumn("bitrate", rate).select("o_orderkey", "z.width", "z.height", "bitrate", labels.estimated_bytes(F.col("bitrate"), F.col("o_totalprice") / 5000).alias("bytes"))


FILL = """f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0.4 + (l_partkey % 30) / 15.0 AS sa, 0.5625 + (l_suppkey % 3) * 0.5 AS ta, l_partkey % 4 <> 1 AS has, (l_suppkey % 10) / 12.0 AS x, (l_partkey % 9) / 12.0 AS y,
  0.1 + (l_linenumber % 4) * 0.1 AS w, 0.1 + (l_suppkey % 5) * 0.1 AS h, (l_orderkey % 8) / 10.0 AS rx, (l_orderkey % 6) / 10.0 AS ry, (l_suppkey % 6) / 5.0 AS rc, l_linenumber % 3 AS fr, (l_partkey % 10) / 9.0 AS fc FROM lineitem),
s AS (SELECT *, CASE WHEN sa > ta + 1e-6 THEN ta / sa ELSE 1 END AS ww, CASE WHEN sa < ta - 1e-6 THEN sa / ta ELSE 1 END AS wh, CASE fr WHEN 0 THEN 0.50 WHEN 1 THEN 0.28 END AS want FROM f),
t AS (SELECT *, CASE WHEN has AND fc >= 0.55 AND want IS NOT NULL AND w * h / greatest(ww * wh, 1e-6) < want * 0.6
  THEN least(1, greatest(0.62, sqrt(w * h / greatest(ww * wh, 1e-6) / want), w / greatest(ww, 1e-6), h / greatest(wh, 1e-6))) ELSE 1 END AS k FROM s),
q AS (SELECT *, ww * k AS fw, wh * k AS fh, CASE WHEN rc >= 0.4 THEN rx + 0.1 ELSE 0.5 END AS ax, CASE WHEN rc >= 0.4 THEN ry + 0.15 ELSE 0.42 END AS ay FROM t),
z AS (SELECT *, CASE WHEN has THEN x + w / 2 - ax * fw ELSE (1 - fw) / 2 END AS px, CASE WHEN has THEN y + h / 2 - ay * fh ELSE (1 - fh) * 0.35 END AS py FROM q),
win AS (SELECT *, least(greatest(px, 0), 1 - least(fw, 1)) AS wx, least(greatest(py, 0), 1 - least(fh, 1)) AS wy FROM z)"""


def _fill(spark, sf):
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    subject = F.when(p % 4 != 1, g.rect((s % 10) / 12.0, (p % 9) / 12.0, 0.1 + (n % 4) * 0.1, 0.1 + (s % 5) * 0.1))
    reference = g.rect((o % 8) / 10.0, (o % 6) / 10.0, F.lit(0.2), F.lit(0.3))
    framing = F.get(F.array(F.lit("closeUp"), F.lit("medium"), F.lit("wide")), n % 3)
    return A.table(spark, sf, "lineitem").select(*KEYS, (0.4 + (p % 30) / 15.0).alias("sa"), (0.5625 + (s % 3) * 0.5).alias("ta"), subject.alias("subject"), reference.alias("reference"),
                                                 ((s % 6) / 5.0).alias("rc"), framing.alias("framing"), ((p % 10) / 9.0).alias("fc"))


@register("fill_window", f"WITH {FILL} SELECT {KEY_SQL}, {s6('wx', 'x')}, {s6('wy', 'y')}, {s6('least(fw, 1)', 'w')}, {s6('least(fh, 1)', 'h')} FROM win")
def _(spark, sf):
    c = F.col
    win = g.fill_window(c("sa"), c("ta"), c("subject"), c("reference"), c("rc"), c("framing"), c("fc"))
    return _fill(spark, sf).withColumn("r", win).select(*KEYS, *rect6("r"))


@register("resolve_crop", f"""WITH {FILL}, mv AS (SELECT *, CASE WHEN fc >= 0.55 AND l_suppkey % 3 <> 2 THEN 0.05 ELSE 0 END AS mx, CASE WHEN fc >= 0.55 AND l_suppkey % 3 <> 2 THEN 0.9 ELSE 1 END AS mw FROM win)
SELECT {KEY_SQL}, {s6('CASE WHEN l_orderkey % 5 = 0 THEN mx ELSE least(greatest(wx + mx * least(fw, 1), 0), 1 - least(least(fw, 1) * mw, 1)) END', 'x')},
  {s6('CASE WHEN l_orderkey % 5 = 0 THEN mw ELSE least(least(fh, 1) * mw, 1) END', 'h')} FROM mv""")
def _(spark, sf):
    from cutlens.operators.bind import with_crops

    c = F.col
    move = F.struct(F.when(c("l_suppkey") % 3 != 2, "zoomIn").otherwise("none").alias("kind"), c("fc").alias("confidence"), g.full().alias("start"), g.scaled_full(0.9).alias("end"))
    pair = lambda v, conf: F.struct(v.alias("value"), conf.alias("confidence"))
    rows = with_crops(_fill(spark, sf), move, c("l_orderkey") % 5 != 0, c("sa"), c("ta"), c("subject"), pair(c("reference"), c("rc")), pair(c("framing"), c("fc")))
    return rows.select(*KEYS, r6("crop_end.x").alias("x"), r6("crop_end.h").alias("h"))


@register("fit_text_size", f"""WITH h AS (SELECT doc_id, length(text) AS n, CASE WHEN doc_id % 40 > 0 THEN length(text) * (40 + doc_id % 100) // 100 ELSE 0 END AS hint FROM documents)
SELECT doc_id, {s6('CASE WHEN hint > 0 THEN 0.05 * least(1.15, greatest(0.6, hint / greatest(n, 1))) ELSE 0.05 END', 'size')} FROM h""")
def _(spark, sf):
    """Hints of .4 to 1.39 times a text's length: within both limits and beyond them."""
    d = F.col("doc_id")
    hint = F.when(d % 40 > 0, F.expr("length(text) * (40 + doc_id % 100) div 100")).otherwise(0)
    return A.table(spark, sf, "documents").select("doc_id", r6(txt.fit_text_size(F.lit(0.05), hint.cast("int"), F.col("text"))).alias("size"))


@register("stable_ids", "SELECT p_partkey, substr(sha256(p_brand || '/clip/' || printf('scene_%02d', p_size)), 1, 32) AS id, printf('scene_%02d', p_size) AS label FROM part")
def _(spark, sf):
    label = labels.numbered("scene", F.col("p_size"))
    return A.table(spark, sf, "part").select("p_partkey", labels.stable_id(F.col("p_brand"), F.concat(F.lit("clip/"), label)).alias("id"), label.alias("label"))


@register("clip_gain", f"""WITH a AS (SELECT o_orderkey, (CAST(floor(o_totalprice) AS BIGINT) % 200) / 10.0 AS s, (CAST(floor(o_totalprice) AS BIGINT) % 200) / 10.0 + (0.5 + (o_orderkey % 40) / 10.0) AS e, 0.2 + (o_orderkey % 9) / 10.0 AS v, (o_orderkey % 4) / 10.0 AS fi, (o_orderkey % 6) / 10.0 AS fo,
  o_orderkey % 17 = 0 AS m FROM orders), t AS (SELECT *, s + (o_orderkey % 50) / 10.0 - 0.3 AS t FROM a)
SELECT o_orderkey, {s6('CASE WHEN NOT m AND t >= s AND t < e THEN least(1, greatest(0, v * (CASE WHEN fi > 0 AND t - s < fi THEN (t - s) / fi ELSE 1 END) * (CASE WHEN fo > 0 AND e - t < fo THEN (e - t) / fo ELSE 1 END))) ELSE 0 END', 'gain')} FROM t""")
def _(spark, sf):
    a = A.audio_clips(spark, sf)
    s = F.col("start")
    t = s + (F.col("clip_id") % 50) / 10.0 - 0.3
    gain = labels.clip_gain(F.col("volume"), F.col("fade_in"), F.col("fade_out"), s, s + F.col("duration"), F.col("muted"), t)
    return a.select(F.col("clip_id").alias("o_orderkey"), r6(gain).alias("gain"))


LAYERS = """tl AS (SELECT o_orderkey, (o_custkey % 15) * CAST(0.1 AS DOUBLE) AS start, (o_custkey % 15) * CAST(0.1 AS DOUBLE) + 0.6e0 + (o_orderkey % 7) * 0.4e0 AS stop,
  ['none','fadeIn','popIn','slideUp','slideDown','wordByWord','typeOn'][o_orderkey % 7 + 1] AS entry, ['none','fadeOut','popOut','slideDown'][(o_orderkey // 7) % 4 + 1] AS leave,
  CASE WHEN o_orderkey % 2 = 0 THEN upper(lower(o_orderpriority) || ' of ' || o_orderstatus || chr(10) || 'line two') ELSE lower(o_orderpriority) || ' of ' || o_orderstatus || chr(10) || 'line two' END AS text, o_orderkey % 5 = 0 AS timed FROM orders),
tm AS (SELECT *, start + (o_orderkey % 23) * 0.1e0 - 0.1e0 AS t, CASE entry WHEN 'none' THEN 0 WHEN 'fadeIn' THEN 0.25 WHEN 'popIn' THEN 0.25 WHEN 'slideUp' THEN 0.3 WHEN 'slideDown' THEN 0.3 ELSE 0.45 END AS es,
  CASE leave WHEN 'none' THEN 0 WHEN 'fadeOut' THEN 0.2 ELSE 0.25 END AS xs FROM tl)"""


@register("text_opacity", f"""WITH {LAYERS} SELECT o_orderkey, {s6('''CASE WHEN t >= start AND t < stop THEN least(1, greatest(0, least(CASE WHEN entry IN ('fadeIn', 'popIn', 'slideUp', 'slideDown') AND t - start < es THEN (t - start) / es ELSE 1 END,
  CASE WHEN xs > 0 AND stop - t < xs THEN (stop - t) / xs ELSE 1 END))) ELSE 0 END''', 'opacity')} FROM tm""")
def _(spark, sf):
    rows = A.text_layers(spark, sf)
    t = F.col("start") + (F.col("layer_id") % 23) * 0.1 - 0.1
    return rows.select(F.col("layer_id").alias("o_orderkey"), r6(txt.text_opacity(F.col("start"), F.col("end"), F.col("entry"), F.col("exit"), t)).alias("opacity"))


WORDS = LAYERS + """,
wd AS (SELECT *, unnest(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '')) AS word, generate_subscripts(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> ''), 1) - 1 AS i,
  len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '')) AS n FROM tm),
ws AS (SELECT *, t - start AS lo, stop - t AS re, CASE WHEN timed AND n = 5 THEN i * CAST(0.2 AS DOUBLE) END AS st, least(1, greatest(0, (t - start) / nullif(es, 0))) AS p, es / n AS pw FROM wd),
wa AS (SELECT *, CASE WHEN xs > 0 AND re < xs THEN greatest(0, re / xs) ELSE 1 END AS xa, es > 0 AND lo < es AS ent, p * (2 - p) AS pe, least(1, greatest(0, (lo - i * pw) / greatest(0.08, pw * 0.8))) AS bw FROM ws),
wf AS (SELECT *, CASE WHEN st IS NOT NULL THEN least(1, greatest(0, (lo - st) / 0.09)) WHEN entry IN ('fadeIn', 'popIn') AND ent THEN p WHEN entry IN ('slideUp', 'slideDown') AND ent THEN pe WHEN entry = 'wordByWord' THEN bw
    WHEN entry = 'typeOn' THEN CASE WHEN lo - i * pw >= 0 THEN 1 ELSE 0 END ELSE 1 END AS al FROM wa),
wz AS (SELECT *, least(al, xa) AS opacity,
  (CASE WHEN st IS NULL AND entry IN ('slideUp', 'slideDown') AND ent THEN (1 - pe) * (CASE WHEN entry = 'slideUp' THEN 0.06 ELSE -0.06 END) ELSE 0 END) + (CASE WHEN leave = 'slideDown' AND xs > 0 AND re < xs THEN (1 - xa) * 0.05 ELSE 0 END) AS offset_y,
  (CASE WHEN st IS NOT NULL THEN 0.96 + al * 0.04 WHEN entry = 'popIn' AND ent THEN CASE WHEN p < 0.7 THEN 0.8 + p * 0.35 ELSE 1.06 - (p - 0.7) * 0.2 END WHEN entry = 'wordByWord' THEN 0.94 + bw * 0.06 ELSE 1 END)
   * (CASE WHEN leave = 'popOut' AND xs > 0 AND re < xs THEN 0.85 + xa * 0.15 ELSE 1 END) AS scale FROM wf)"""


@register("word_reveal", f"WITH {WORDS} SELECT o_orderkey, CAST(i AS INT) AS word_idx, word, {s6('opacity', 'opacity')}, {s6('offset_y', 'offset_y')}, {s6('scale', 'scale')} FROM wz WHERE t >= start AND t < stop")
def _(spark, sf):
    rows = A.text_layers(spark, sf).withColumn("t", F.col("start") + (F.col("layer_id") % 23) * 0.1 - 0.1).filter("t >= start AND t < end")
    words = F.filter(txt.display_words(F.col("text"), F.col("all_caps")), lambda w: w != K.LINE_BREAK)
    each = rows.withColumn("_w", words).withColumn("n", F.size("_w")).select("*", F.posexplode("_w").alias("word_idx", "word"))
    st = F.when(F.size("word_starts") == F.col("n"), F.get("word_starts", F.col("word_idx")))
    state = txt.word_state(F.col("t") - F.col("start"), F.col("end") - F.col("t"), F.col("word_idx"), F.col("n"), F.col("entry"), F.col("exit"), st)
    return each.withColumn("s", state).select(F.col("layer_id").alias("o_orderkey"), "word_idx", "word", r6("s.opacity").alias("opacity"), r6("s.offset_y").alias("offset_y"), r6("s.scale").alias("scale"))


@register("display_words", "WITH w AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND NOT contains(text, 'ß') THEN upper(text) ELSE text END AS s FROM documents) SELECT doc_id, len(list_filter(string_split(replace(s, chr(10), ' ' || chr(10) || ' '), ' '), lambda w: w <> '')) AS words, md5(array_to_string(list_transform(list_filter(string_split(replace(s, chr(10), ' ' || chr(10) || ' '), ' '), lambda w: w <> ''), lambda w: CASE WHEN w = chr(10) THEN chr(8232) ELSE w END), '|')) AS joined FROM w")
def _(spark, sf):
    # upper-casing ß lengthens a text on one side only, so those texts keep their case
    w = txt.display_words(F.col("text"), (F.col("doc_id") % 2 == 0) & ~F.contains("text", F.lit("ß")))
    return A.table(spark, sf, "documents").withColumn("w", w).select("doc_id", F.size("w").cast("bigint").alias("words"), F.md5(F.encode(F.array_join("w", "|"), "utf-8")).alias("joined"))


@register("text_for_slot", r"WITH u AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '   ' WHEN turn % 3 = 1 THEN '  ' || text || ' ' END AS x FROM conversations) SELECT conv_id, turn, md5(nullif(regexp_replace(x, '^\s+|\s+$', '', 'g'), '')) AS words FROM u")
def _(spark, sf):
    t = F.col("turn")
    texts = F.create_map(F.concat(F.lit("s"), (t % 3).cast("string")), F.when(t % 3 == 0, "   ").otherwise(F.concat(F.lit("  "), "text", F.lit(" "))))
    slot = F.when(t % 3 == 2, "other").otherwise(F.concat(F.lit("s"), (t % 3).cast("string")))
    found = txt.text_for_slot(texts, slot)
    return A.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.encode(found, "utf-8")).alias("words"))


@register("quality_score", f"""WITH q AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 1 THEN (CAST(floor(s_acctbal) AS BIGINT) % 200) / 100.0 - 1 END AS a, CASE WHEN s_suppkey % 6 <> 2 THEN (s_suppkey % 20) / 20.0 END AS s, s_suppkey % 11 = 0 AS u FROM supplier),
b AS (SELECT *, CASE WHEN a IS NULL THEN 0.5 ELSE least(1, greatest(0, (a + 1) / 2)) END AS b FROM q)
SELECT s_suppkey, {s6('(CASE WHEN s IS NULL THEN b ELSE b * 0.75 + s * 0.25 END) * (CASE WHEN u THEN 0.3 ELSE 1 END)', 'score')} FROM b""")
def _(spark, sf):
    k = F.col("s_suppkey")
    score = labels.quality_score(F.when(k % 4 != 1, (F.floor("s_acctbal") % 200) / 100.0 - 1), F.when(k % 6 != 2, (k % 20) / 20.0), k % 11 == 0)
    return A.table(spark, sf, "supplier").select("s_suppkey", r6(score).alias("score"))


@register("feature_distance", f"""SELECT a.vec_id, {s6('sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: power(CAST(z[1] - z[2] AS DOUBLE), 2))))', 'distance')} FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(spark, sf):
    e = A.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id", "left").select("vec_id", r6(labels.feature_distance(F.col("embedding"), F.col("other"))).alias("distance"))


@register("names_and_titles", r"""WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'reference-' || md5(text) || '.mov' WHEN 1 THEN 'picked-' || substr(md5(text), 1, 20) || '.mov' WHEN 2 THEN 'holiday.mp4' ELSE 'picked-' || md5(text) || '-' || md5(source) END AS name,
  CASE WHEN doc_id % 9 = 0 THEN '!?*' ELSE source || ': ' || lang || ' #' || CAST(doc_id AS VARCHAR) || '!' END AS title FROM documents)
SELECT doc_id, regexp_matches(regexp_replace(name, '\.[^.]*$', ''), '^(reference-|picked-)[0-9A-Fa-f-]{32,}$') AS staged, coalesce(nullif(trim(regexp_replace(title, '[^\p{L}\p{M}\p{N}\p{Zs}\t]', '', 'g')), ''), 'Untitled Style') AS safe FROM n""")
def _(spark, sf):
    d = F.col("doc_id")
    h, h2 = F.md5(F.encode("text", "utf-8")), F.md5(F.encode("source", "utf-8"))
    name = (F.when(d % 4 == 0, F.concat(F.lit("reference-"), h, F.lit(".mov"))).when(d % 4 == 1, F.concat(F.lit("picked-"), F.substring(h, 1, 20), F.lit(".mov")))
            .when(d % 4 == 2, "holiday.mp4").otherwise(F.concat(F.lit("picked-"), h, F.lit("-"), h2)))
    title = F.when(d % 9 == 0, "!?*").otherwise(F.concat("source", F.lit(": "), "lang", F.lit(" #"), d.cast("string"), F.lit("!")))
    return A.table(spark, sf, "documents").select("doc_id", labels.is_staged_name(name).alias("staged"), labels.safe_title(title).alias("safe"))
