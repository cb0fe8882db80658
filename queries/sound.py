"""Audio and music."""

from __future__ import annotations

from pyspark.sql import functions as F

from cutlens.functions import constants as K
from cutlens.operators import audio, music
from cutlens.operators.ordered import asof, nearest
from cutlens.sources import adapters as A
from queries.common import r6, registry, s6

JOBS, SQL, register = registry()

ONSET = """onset AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, value / max(value) OVER (PARTITION BY user_id) AS v FROM events)"""
SAMPLES = """samples AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value / 500 - 5e-2 AS x FROM events)"""
SPECTRA = """spectra AS (SELECT label AS track_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS mags FROM embeddings)"""
ENERGY = """daily AS (SELECT user_id AS track_id, CAST(ts AS DATE) AS d, sum(value) AS rms FROM events GROUP BY 1, 2),
energy AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY d) - 1 AS i, rms FROM daily)"""


@register("frame_signal", f"""WITH s AS (SELECT event_type AS track_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, value / 500 AS x FROM events),
n AS (SELECT track_id, count(*) AS total FROM s GROUP BY 1), f AS (SELECT track_id, unnest(range(total // 512 - 1)) AS k FROM n)
SELECT f.track_id, f.k, {s6('(f.k * 512 + 512) / 22050e0', 't')}, {s6(f'sum(x * (1 - cos((i - f.k * 512) * (2 * pi() / 1024))) * sqrt(2e0 / 3))', 'total')}, {s6('max(abs(x * (1 - cos((i - f.k * 512) * (2 * pi() / 1024))) * sqrt(2e0 / 3)))', 'peak')}
FROM f JOIN s ON s.track_id = f.track_id AND s.i >= f.k * 512 AND s.i < f.k * 512 + 1024 GROUP BY 1, 2""")
def _(spark, sf):
    f = audio.frame_signal(A.pcm(spark, sf))
    return f.select("track_id", "k", r6("t").alias("t"), r6(F.aggregate("frame", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.array_max(F.transform("frame", F.abs))).alias("peak"))


@register("spectra")
def _(spark, sf):
    s = audio.spectra(audio.frame_signal(A.pcm(spark, sf)))
    return s.select("track_id", "k", F.size("mags").alias("bins"), r6(F.array_max("mags")).alias("peak"))


@register("frame_times", f"SELECT event_id, {s6('(event_id * 512 + 512) / 22050e0', 't')}, greatest(0, CAST(round((value * 22050e0 - 512) / 512) AS BIGINT)) AS k FROM events")
def _(spark, sf):
    return A.table(spark, sf, "events").select("event_id", r6(audio.frame_time(F.col("event_id"))).alias("t"), audio.frame_index(F.col("value")).alias("k"))


@register("peak_normalize", f"WITH {SAMPLES}, p AS (SELECT *, max(abs(x)) OVER (PARTITION BY track_id) AS peak FROM samples) SELECT track_id, i, {s6('CASE WHEN peak > 1e-6 THEN x / peak ELSE x END', 'x')} FROM p")
def _(spark, sf):
    return audio.peak_normalize(A.samples(spark, sf)).select("track_id", "i", r6("x").alias("x"))


FLUX = SPECTRA + """,
pr AS (SELECT *, lag(mags) OVER (PARTITION BY track_id ORDER BY k) AS prev FROM spectra),
flux AS (SELECT track_id, k, CASE WHEN prev IS NULL THEN 0 ELSE list_sum(list_transform(list_zip(mags, prev), lambda z: greatest(ln(1 + z[1] * 100) - ln(1 + z[2] * 100), 0))) / len(mags) END AS v FROM pr)"""


@register("onset_flux", f"WITH {FLUX} SELECT CAST(track_id AS BIGINT) AS track_id, k, {s6('v', 'v')} FROM flux")
def _(spark, sf):
    return audio.onset_flux(A.spectra(spark, sf)).select(F.col("track_id").cast("bigint").alias("track_id"), "k", r6("v").alias("v"))


@register("onset_envelope", f"""WITH {FLUX}, m AS (SELECT *, greatest(0, v - avg(v) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)) AS w FROM flux),
p AS (SELECT *, max(w) OVER (PARTITION BY track_id) AS peak FROM m) SELECT CAST(track_id AS BIGINT) AS track_id, k, {s6('CASE WHEN peak > 1e-6 THEN w / peak ELSE w END', 'v')} FROM p""")
def _(spark, sf):
    return audio.onset_envelope(A.spectra(spark, sf)).select(F.col("track_id").cast("bigint").alias("track_id"), "k", r6("v").alias("v"))


@register("local_mean_rectify", f"WITH {ONSET} SELECT track_id, k, {s6('greatest(0, v - avg(v) OVER (PARTITION BY track_id ORDER BY k ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING))', 'v')} FROM onset")
def _(spark, sf):
    return audio.local_mean_rectify(A.onset(spark, sf)).select("track_id", "k", r6("v").alias("v"))


CORR = ONSET + """,
n AS (SELECT track_id, count(*) AS n, count(*) FILTER (v > 0.25) AS onsets FROM onset GROUP BY 1),
corr AS (SELECT a.track_id, g.lag, sum(a.v * b.v) / any_value(n - g.lag) AS corr, any_value(n) AS n FROM onset a CROSS JOIN (SELECT unnest(range(2, 9)) AS lag) g JOIN onset b ON b.track_id = a.track_id AND b.k = a.k + g.lag JOIN n ON n.track_id = a.track_id GROUP BY 1, 2)"""


@register("lag_autocorrelation", f"WITH {CORR} SELECT track_id, CAST(lag AS INT) AS lag, {s6('corr', 'corr')} FROM corr")
def _(spark, sf):
    return audio.lag_table(A.onset(spark, sf), range(2, 9)).select("track_id", "lag", r6("corr").alias("corr"))


TEMPO = CORR + f""",
sc AS (SELECT *, corr * exp(-power(ln(60.0 * {K.ENVELOPE_RATE}e0 / lag / 120.0), 2) / (2 * 0.42 * 0.42)) AS score FROM corr),
best AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, lag) AS rs, row_number() OVER (PARTITION BY track_id ORDER BY corr DESC, lag) AS rr, lag(corr) OVER (PARTITION BY track_id ORDER BY lag) AS bf, lead(corr) OVER (PARTITION BY track_id ORDER BY lag) AS af,
  avg(corr) OVER (PARTITION BY track_id) AS mean FROM sc),
tempo AS (SELECT b.track_id, b.n, b.lag, 60.0 * {K.ENVELOPE_RATE}e0 / (b.lag + CASE WHEN b.lag > 2 AND b.lag < 8 AND abs(b.bf - 2 * b.corr + b.af) > 1e-12 THEN least(0.5, greatest(-0.5, 0.5 * (b.bf - b.af) / (b.bf - 2 * b.corr + b.af))) ELSE 0 END) AS bpm,
  least(0.94, greatest(0.15, ((CASE WHEN b.mean > 1e-9 THEN r.corr / b.mean ELSE 1 END) - 1) / 2.5)) * CASE WHEN abs(b.lag - r.lag) > 2 THEN 0.82 ELSE 1 END AS confidence
  FROM best b JOIN best r ON r.track_id = b.track_id AND r.rr = 1 WHERE b.rs = 1)"""


def _tempo(spark, sf, onset):
    return audio.estimate_tempo(onset, 2, 8)


@register("estimate_tempo", f"WITH {TEMPO} SELECT track_id, CAST(lag AS INT) AS lag, {s6('bpm', 'bpm')}, {s6('confidence', 'confidence')} FROM tempo")
def _(spark, sf):
    return _tempo(spark, sf, A.onset(spark, sf)).select("track_id", "lag", r6("bpm").alias("bpm"), r6("confidence").alias("confidence"))


@register("comb_phase", f"""WITH {TEMPO}, per AS (SELECT track_id, n, 60.0 / bpm * {K.ENVELOPE_RATE}e0 AS p FROM tempo),
o AS (SELECT track_id, p, n, unnest(range(CAST(greatest(1, floor(p)) AS BIGINT))) AS off FROM per WHERE p >= 2 AND n > floor(p)),
st AS (SELECT track_id, off, p, unnest(range(CAST(ceil(n / p) AS BIGINT) + 1)) AS j FROM o),
tooth AS (SELECT st.track_id, off, sum(v) AS score FROM st JOIN onset x ON x.track_id = st.track_id AND x.k = off + CAST(floor(j * p) AS BIGINT) GROUP BY 1, 2)
SELECT track_id, off AS "offset", {s6('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, off) AS rn FROM tooth) WHERE rn = 1""")
def _(spark, sf):
    onset = A.onset(spark, sf)
    return audio.comb_phase(onset, _tempo(spark, sf, onset)).select("track_id", "offset", r6("score").alias("score"))


@register("beat_grid")
def beat_grid(spark, sf):
    onset = A.onset(spark, sf)
    seconds = onset.groupBy("track_id").agg((audio.frame_time(F.max("k")) + 1).alias("track_seconds"))
    return audio.beat_grid(onset, _tempo(spark, sf, onset), seconds, max_period=13.0).select("track_id", "i", "k", r6("t").alias("t"))


BEATS = """beats AS (SELECT user_id AS track_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 43200000000e0 AS t, event_type, event_type = 'signup' AS is_downbeat FROM events)"""


@register("downbeats", f"""WITH {ONSET}, b AS (SELECT track_id, k AS i, (k * 512 + 512) / 22050e0 AS t FROM onset),
e AS (SELECT b.track_id, i % 4 AS ph, sum(o.v) AS e FROM b JOIN onset o ON o.track_id = b.track_id AND o.k = greatest(0, CAST(round((t * 22050e0 - 512) / 512) AS BIGINT)) GROUP BY 1, 2),
bp AS (SELECT track_id, ph FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY e DESC, ph) AS rn FROM e) WHERE rn = 1)
SELECT b.track_id, i, {s6('t', 't')} FROM b JOIN bp ON bp.track_id = b.track_id AND i % 4 = ph""")
def _(spark, sf):
    onset = A.onset(spark, sf)
    beats = onset.select("track_id", F.col("k").alias("i"), audio.frame_time(F.col("k")).alias("t"))
    return audio.downbeats(beats, onset).select("track_id", "i", r6("t").alias("t"))


@register("energy_curve", f"WITH {SAMPLES} SELECT track_id, i // 8 AS i, {s6('sqrt(avg(x * x))', 'rms')} FROM samples GROUP BY 1, 2 HAVING count(*) = 8")
def _(spark, sf):
    return audio.energy_curve(A.samples(spark, sf), 32.0).select("track_id", "i", r6("rms").alias("rms"))


WAVE = SAMPLES + """,
n AS (SELECT track_id, count(*) AS n FROM samples GROUP BY 1),
wb AS (SELECT s.track_id, i // (n // 10) AS bin, sqrt(avg(x * x)) AS v FROM samples s JOIN n USING (track_id) WHERE n > 10 AND i // (n // 10) < 10 GROUP BY 1, 2),
wave AS (SELECT track_id, bin, CASE WHEN max(v) OVER (PARTITION BY track_id) > 1e-5 THEN v / max(v) OVER (PARTITION BY track_id) ELSE v END AS v FROM wb)"""


@register("waveform", f"WITH {WAVE} SELECT track_id, bin, {s6('v', 'v')} FROM wave")
def _(spark, sf):
    return audio.waveform(A.samples(spark, sf), 10).select("track_id", "bin", r6("v").alias("v"))


@register("waveform_slice", f"""WITH {WAVE}, q AS (SELECT track_id, unnest(range(6)) AS i, (track_id % 5) * 0.1e0 AS st FROM n),
a AS (SELECT q.*, CAST(trunc((st + 0.9e0 * i / 6) * (10 / (n / 32e0))) AS BIGINT) AS bin FROM q JOIN n USING (track_id))
SELECT a.track_id, CAST(i AS INT) AS i, {s6('coalesce(v, 0)', 'v')} FROM a LEFT JOIN wave w ON w.track_id = a.track_id AND w.bin = a.bin""")
def _(spark, sf):
    s = A.samples(spark, sf)
    seconds = s.groupBy("track_id").agg((F.count(F.lit(1)) / 32.0).alias("track_seconds"))
    asked = seconds.select("track_id", ((F.col("track_id") % 5) * 0.1).alias("start"), F.lit(0.9).alias("length"), F.lit(6).alias("count"))
    return audio.waveform_slice(audio.waveform(s, 10), seconds, asked).select("track_id", "i", r6("v").alias("v"))


@register("speech_presence", f"""WITH {SPECTRA}, br AS (SELECT track_id, avg(CASE WHEN list_sum(mags) > 1e-6 THEN list_sum(mags[14:64]) / list_sum(mags) ELSE 0 END) AS band_ratio, count(*) AS frames FROM spectra GROUP BY 1),
ev AS (SELECT user_id % 10 AS track_id, event_id, ts, value FROM events), onset AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY ts, event_id) - 1 AS k, value / 500 AS v, count(*) OVER (PARTITION BY track_id) AS n FROM ev),
co AS (SELECT a.track_id, lag, sum(a.v * b.v) / any_value(a.n - lag) AS c FROM onset a CROSS JOIN (SELECT unnest(range(4, 29)) AS lag) JOIN onset b ON b.track_id = a.track_id AND b.k = a.k + lag GROUP BY 1, 2),
mx AS (SELECT track_id, {K.ENVELOPE_RATE}e0 / lag AS hz FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY c DESC, lag) AS rn FROM co) WHERE rn = 1)
SELECT CAST(br.track_id AS BIGINT) AS track_id, {s6('band_ratio', 'band_ratio')}, {s6('hz', 'modulation_hz')}, frames > 8 AND band_ratio > 0.62 AND hz > 3 AND hz < 8 AS present,
  {s6('CASE WHEN frames <= 8 THEN 0.2 WHEN band_ratio > 0.62 AND hz > 3 AND hz < 8 THEN 0.74 WHEN NOT band_ratio > 0.62 AND NOT (hz > 3 AND hz < 8) THEN 0.71 ELSE 0.45 END', 'confidence')} FROM br JOIN mx ON mx.track_id = br.track_id""")
def _(spark, sf):
    from cutlens.operators.ordered import positions

    ev = A.table(spark, sf, "events").select((F.col("user_id") % 10).alias("track_id"), "event_id", "ts", (F.col("value") / 500).alias("v"))
    onset = positions(ev, ["track_id"], ["ts", "event_id"], F.floor(F.unix_timestamp("ts") / 3600), out="k").select("track_id", "k", "v")
    spectra = A.spectra(spark, sf).withColumn("track_id", F.col("track_id").cast("bigint"))
    out = audio.speech_presence(spectra, onset)
    return out.select("track_id", r6("band_ratio").alias("band_ratio"), r6("modulation_hz").alias("modulation_hz"), "present", r6("confidence").alias("confidence"))


# --- music ------------------------------------------------------------------------------------


@register("trailing_average", f"WITH {ENERGY} SELECT track_id, i, {s6('avg(rms) OVER (PARTITION BY track_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)', 'smooth')} FROM energy")
def _(spark, sf):
    return music.trailing_average(A.energy(spark, sf), 4).select("track_id", "i", r6("smooth").alias("smooth"))


@register("slope", f"WITH {ENERGY} SELECT track_id, i // 6 AS run, {s6('CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(rms, i) END', 'slope')} FROM energy GROUP BY 1, 2")
def _(spark, sf):
    e = A.energy(spark, sf).withColumn("run", F.expr("i div 6"))
    return music.slope_by(e, ["track_id", "run"], "i", "rms").select("track_id", "run", r6("slope").alias("slope"))


@register("music_sections")
def _(spark, sf):
    e = A.energy(spark, sf)
    tracks = e.groupBy("track_id").agg((F.count(F.lit(1)) / 2.0).alias("track_seconds"))
    return music.music_sections(e, tracks, 2.0).select("track_id", "section", "kind", r6("start").alias("start_t"), r6("end").alias("end_t"), r6("intensity").alias("intensity"))


SECTIONS = """sections AS (SELECT track_id, s AS section, s * 10e0 AS start, ['intro','build','peak','release','outro','steady'][(s + track_id) % 6 + 1] AS kind, s / 5e0 AS intensity
  FROM (SELECT DISTINCT user_id AS track_id FROM events), (SELECT unnest(range(6)) AS s))"""


@register("section_at", f"""WITH {BEATS}, {SECTIONS} SELECT b.track_id, {s6('b.t', 't')}, s.kind, s.section FROM beats b ASOF LEFT JOIN sections s ON s.track_id = b.track_id AND s.start <= b.t""")
def _(spark, sf):
    found = asof(A.beats(spark, sf), A.music_sections(spark, sf), ["track_id"], "t", ["kind", "section"], 5.0, right_at="start")
    return found.select("track_id", r6("t").alias("t"), F.col("prev_kind").alias("kind"), F.col("prev_section").cast("bigint").alias("section"))


@register("nearest_join", f"""WITH {BEATS}, c AS (SELECT track_id, t FROM beats WHERE event_type = 'purchase'), b AS (SELECT DISTINCT track_id, t FROM beats WHERE event_type = 'click'),
j AS (SELECT c.track_id, c.t, b.t AS bt, abs(b.t - c.t) AS gap, row_number() OVER (PARTITION BY c.track_id, c.t ORDER BY abs(b.t - c.t), b.t) AS rn FROM c LEFT JOIN b ON b.track_id = c.track_id)
SELECT track_id, {s6('t', 't')}, {s6('CASE WHEN gap <= 1.5 THEN bt END', 'near_t')}, {s6('CASE WHEN gap <= 1.5 THEN gap END', 'near_gap')} FROM j WHERE rn = 1""")
def _(spark, sf):
    b = A.beats(spark, sf)
    clicks = b.filter("event_type = 'click'").select("track_id", F.col("t").alias("beat")).distinct()
    near = nearest(b.filter("event_type = 'purchase'").select("track_id", "t"), clicks, ["track_id"], "t", tolerance=1.5, width=5.0, right_at="beat")
    return near.select("track_id", r6("t").alias("t"), r6("near_t").alias("near_t"), r6("near_gap").alias("near_gap"))


# eight assets: 12 wanted scenes, intensity .5 scales beats per cut by 1.1 (peaks by .9)
CUTS = BEATS + ",\n" + SECTIONS + """,
early AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t) AS n, count(*) OVER (PARTITION BY track_id) AS total FROM beats WHERE t < 30),
aimed AS (SELECT e.track_id, e.t, e.n, e.total, e.is_downbeat, CASE s.kind WHEN 'peak' THEN 0.9e0 WHEN 'release' THEN 3 * 1.1e0 WHEN 'intro' THEN 4 * 1.1e0 WHEN 'outro' THEN 4 * 1.1e0 ELSE 2 * 1.1e0 END AS base FROM early e ASOF LEFT JOIN sections s ON s.track_id = e.track_id AND s.start <= e.t),
target AS (SELECT *, CASE WHEN total / greatest(1.0, base) > 12 * 1.6e0 THEN base * (total / greatest(1.0, base) / (12 * 1.6e0)) ELSE base END AS target FROM aimed),
step AS (
  SELECT track_id, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS last, CAST(0 AS DOUBLE) AS since, false AS cut FROM target GROUP BY track_id
  UNION ALL
  SELECT s.track_id, t.n, CASE WHEN t.t - s.last >= 0.4 AND (s.since + 1 >= t.target OR (t.is_downbeat AND s.since + 1 >= t.target - 1)) THEN t.t ELSE s.last END,
    CASE WHEN t.t - s.last < 0.4 THEN s.since WHEN s.since + 1 >= t.target OR (t.is_downbeat AND s.since + 1 >= t.target - 1) THEN 0 ELSE s.since + 1 END,
    t.t - s.last >= 0.4 AND (s.since + 1 >= t.target OR (t.is_downbeat AND s.since + 1 >= t.target - 1))
  FROM step s JOIN target t ON t.track_id = s.track_id AND t.n = s.n + 1),
inner_cuts AS (SELECT track_id, 0e0 AS t FROM (SELECT DISTINCT track_id FROM beats) UNION ALL SELECT track_id, last FROM step WHERE cut),
lasts AS (SELECT track_id, max(t) AS m, count(*) AS c FROM inner_cuts GROUP BY 1),
totals AS (SELECT b.track_id, count(e.t) AS total FROM (SELECT DISTINCT track_id FROM beats) b LEFT JOIN early e ON e.track_id = b.track_id GROUP BY 1),
all_cuts AS (
  SELECT i.track_id, i.t FROM inner_cuts i JOIN lasts l USING (track_id) JOIN totals USING (track_id) WHERE total >= 2 AND (30 - m >= 0.4 OR c = 1 OR i.t < m)
  UNION ALL SELECT track_id, 30e0 FROM lasts JOIN totals USING (track_id) WHERE total >= 2 AND (30 - m >= 0.4 OR c > 1)
  UNION ALL SELECT track_id, unnest(range(9)) * (30e0 / 8) FROM totals WHERE total < 2),
cuts AS (SELECT track_id, t, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS i FROM all_cuts)"""


def _tracks(beats):
    return beats.select("track_id").distinct().withColumn("track_seconds", F.lit(60.0))


def _cuts(spark, sf):
    beats, sections = A.beats(spark, sf), A.music_sections(spark, sf)
    return music.plan_cuts(beats.select("track_id", "t", "is_downbeat"), sections, _tracks(beats)), sections


@register("plan_cuts", f"WITH RECURSIVE {CUTS} SELECT track_id, CAST(i AS INT) AS i, {s6('t', 't')} FROM cuts")
def plan_cuts(spark, sf):
    return _cuts(spark, sf)[0].select("track_id", F.col("i").cast("int").alias("i"), r6("t").alias("t"))


@register("plan_music_template", f"""WITH RECURSIVE {CUTS}, sp AS (SELECT track_id, i, t AS a, lead(t) OVER (PARTITION BY track_id ORDER BY i) AS b FROM cuts),
md AS (SELECT track_id, i, a, b, (a + b) / 2 AS mid FROM sp WHERE b IS NOT NULL), pl AS (SELECT md.*, s.kind, s.intensity FROM md ASOF LEFT JOIN sections s ON s.track_id = md.track_id AND s.start <= md.mid),
f AS (SELECT *, greatest(0.78, 1 - (0.06 + 0.10 * intensity * 1.0)) AS tight, i % 2 = 0 AS even FROM pl),
k AS (SELECT *, kind IN ('intro', 'outro', 'build') OR (kind IN ('peak', 'steady') AND even) AS push, CASE WHEN kind IN ('intro', 'outro') THEN 0.94 WHEN kind = 'steady' THEN 0.90 ELSE tight END AS fac FROM f)
SELECT track_id, printf('scene_%02d', i + 1) AS scene_id, {s6('a', 'start_t')}, {s6('b', 'end_t')}, CASE WHEN i = 0 THEN 'opening' WHEN kind = 'peak' THEN 'hero' ELSE 'body' END AS role,
  CASE WHEN kind = 'peak' THEN CASE WHEN even THEN 'closeUp' ELSE 'medium' END WHEN kind IN ('intro', 'outro') THEN 'wide' WHEN i % 3 = 0 THEN 'wide' ELSE 'medium' END AS framing,
  CASE WHEN push THEN 'zoomIn' ELSE 'zoomOut' END AS move, {s6('CASE WHEN push THEN 1 ELSE fac END', 'start_w')}, {s6('CASE WHEN push THEN 0.5 - fac / 2 ELSE 0 END', 'end_x')},
  CASE WHEN kind = 'build' THEN 'easeIn' WHEN kind IN ('release', 'peak') THEN 'easeOut' ELSE 'easeInOut' END AS easing,
  CASE WHEN i > 0 THEN CASE WHEN kind = 'outro' OR (kind = 'release' AND even) THEN 'dissolve' ELSE 'cut' END END AS transition FROM k""")
def _(spark, sf):
    cuts, sections = _cuts(spark, sf)
    p = music.plan_music_template(cuts, sections)
    return p.select("track_id", "scene_id", r6("start").alias("start_t"), r6("end").alias("end_t"), "role", "framing", "move", r6("crop_start.w").alias("start_w"), r6("crop_end.x").alias("end_x"), "easing", "transition")
