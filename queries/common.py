"""Shared rounding, registration and SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(column: Column | str) -> Column:
    """Six places; the tiny shift keeps exact halves from depending on the last float bit."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double") + 1e-9, 6)


def rect6(column: str, prefix: str = "") -> list[Column]:
    return [r6(F.col(column)[c]).alias(prefix + c) for c in "xywh"]


def s6(expr: str, name: str | None = None) -> str:
    """The same rounding in SQL."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6)" + (f" AS {name}" if name else "")


def registry():
    jobs, sql = {}, {}

    def register(name: str, oracle: str | None = None):
        def add(job):
            assert name not in jobs, name
            jobs[name] = job
            if oracle is not None:
                sql[name] = oracle
            return job

        return add

    return jobs, sql, register


FRAMES = """frames AS (
  SELECT user_id AS video_id, event_id, ts, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
         (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 30.0 AS t,
         value / 500 AS content_value, (event_id % 11) / 10.0 AS luma_mean, (event_id % 20) / 100.0 AS luma_std
  FROM events)"""

MARKED = FRAMES + """,
around AS (
  SELECT *, (coalesce(sum(content_value) OVER b, 0) + coalesce(sum(content_value) OVER a, 0))
            / nullif(count(content_value) OVER b + count(content_value) OVER a, 0) AS rolling
  FROM frames WINDOW
    b AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
marked AS (
  SELECT *, content_value / rolling AS ratio,
         coalesce(content_value >= 0.055 AND rolling > 1e-6 AND content_value / nullif(rolling, 0) >= 3, false) AS is_cut
  FROM around)"""

RUNS = MARKED + """,
member AS (
  SELECT *, (content_value >= 0.016 AND NOT is_cut AND frame_idx >= 1) AS inside,
         sum(CASE WHEN content_value >= 0.016 AND NOT is_cut AND frame_idx >= 1 THEN 0 ELSE 1 END)
           OVER (PARTITION BY video_id ORDER BY frame_idx) AS run,
         max(frame_idx) OVER (PARTITION BY video_id) AS last_frame
  FROM marked),
runs AS (
  SELECT video_id, run, min(frame_idx) AS first_idx, max(frame_idx) AS last_idx, count(*) AS n_frames,
         min(frame_idx) - 1 AS start_idx, least(max(last_frame), max(frame_idx) + 1) AS end_idx, max(last_frame) + 1 AS total
  FROM member WHERE inside GROUP BY video_id, run)"""

THUMBS = """thumbs AS (
  SELECT f.video_id, f.frame_idx, CASE WHEN f.video_id % 2 = 0
         THEN list_transform(range(64), lambda i: CAST(0.2 AS DOUBLE) + CAST(0.011 AS DOUBLE) * f.frame_idx)
         ELSE list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) END AS thumb
  FROM frames f LEFT JOIN embeddings e ON e.vec_id = f.event_id % (SELECT count(*) FROM embeddings))"""

GRADUAL = RUNS + ",\n" + THUMBS + """,
cand AS (
  SELECT r.*, a.t AS start_t, b.t AS end_t, b.t - a.t AS seconds FROM runs r
  JOIN frames a ON a.video_id = r.video_id AND a.frame_idx = r.start_idx
  JOIN frames b ON b.video_id = r.video_id AND b.frame_idx = r.end_idx
  WHERE r.n_frames >= 3 AND r.total > 6 AND b.t - a.t <= 1.6),
flats AS (
  SELECT c.video_id, c.run, min(f.luma_std) AS min_std, arg_min(f.luma_mean, struct_pack(s := f.luma_std, i := f.frame_idx)) AS flat_mean,
         arg_min(f.frame_idx, struct_pack(s := f.luma_std, i := f.frame_idx)) AS flat_idx
  FROM cand c JOIN frames f ON f.video_id = c.video_id AND f.frame_idx BETWEEN c.start_idx AND c.end_idx GROUP BY 1, 2),
judged AS (
  SELECT c.*, min_std, flat_mean, flat_idx <= (start_idx + end_idx) // 2 AS fading_in,
         (min_std < 0.035 AND (flat_mean <= 0.14 OR flat_mean >= 1 - 0.14)) AS is_fade
  FROM cand c JOIN flats USING (video_id, run)),
fades AS (
  SELECT video_id, first_idx AS frame_idx,
         CASE WHEN flat_mean < 0.5 THEN CASE WHEN fading_in THEN 'fadeFromBlack' ELSE 'fadeToBlack' END
              ELSE CASE WHEN fading_in THEN 'fadeFromWhite' ELSE 'fadeToWhite' END END AS kind,
         CASE WHEN fading_in THEN end_t ELSE start_t END AS t, seconds AS duration, least(0.92, 0.60 + (0.035 - min_std) * 6) AS confidence
  FROM judged WHERE is_fade),
ends AS (
  SELECT j.*, a.thumb AS ta, b.thumb AS tb FROM judged j
  JOIN thumbs a ON a.video_id = j.video_id AND a.frame_idx = j.start_idx
  JOIN thumbs b ON b.video_id = j.video_id AND b.frame_idx = j.end_idx
  WHERE NOT is_fade AND list_avg(list_transform(list_zip(a.thumb, b.thumb), lambda p: abs(p[1] - p[2]))) >= 0.06),
residuals AS (
  SELECT e.video_id, e.run, any_value(first_idx) AS first_idx, any_value(end_t) AS end_t, any_value(seconds) AS seconds,
         avg(list_avg(list_transform(list_zip(m.thumb, ta, tb), lambda p: abs(p[1] - (p[2] * (1 - (m.frame_idx - start_idx) / (end_idx - start_idx))
             + p[3] * ((m.frame_idx - start_idx) / (end_idx - start_idx))))))) AS residual
  FROM ends e JOIN thumbs m ON m.video_id = e.video_id AND m.frame_idx > e.start_idx AND m.frame_idx < e.end_idx GROUP BY 1, 2),
gradual AS (
  SELECT * FROM fades UNION ALL
  SELECT video_id, first_idx, 'dissolve', end_t, seconds, least(0.94, 0.58 + (0.028 - residual) * 12) FROM residuals WHERE residual <= 0.028)"""

# boundaries of every video in time order, then the merge walked one boundary at a time
MERGED = GRADUAL + """,
bounds AS (
  SELECT video_id, -1 AS frame_idx, 'start' AS kind, CAST(0 AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS duration, CAST(1 AS DOUBLE) AS confidence, 0 AS rk FROM frames GROUP BY video_id
  UNION ALL SELECT video_id, frame_idx, 'cut', t, CAST(0 AS DOUBLE), least(0.98, 0.62 + (ratio - 3) / 8), 1 FROM marked WHERE is_cut
  UNION ALL SELECT video_id, frame_idx, kind, t, duration, confidence, 2 FROM gradual),
numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, rk, frame_idx) AS n FROM bounds),
walk AS (
  SELECT video_id, n, n AS kept, t AS kt, CAST(confidence AS DOUBLE) AS kc, kind AS kk, true AS appended FROM numbered WHERE n = 1
  UNION ALL
  SELECT b.video_id, b.n,
         CASE WHEN b.t - w.kt >= 0.15 OR (b.confidence > w.kc AND w.kk <> 'start') THEN b.n ELSE w.kept END,
         CASE WHEN b.t - w.kt >= 0.15 OR (b.confidence > w.kc AND w.kk <> 'start') THEN b.t ELSE w.kt END,
         CASE WHEN b.t - w.kt >= 0.15 OR (b.confidence > w.kc AND w.kk <> 'start') THEN CAST(b.confidence AS DOUBLE) ELSE w.kc END,
         CASE WHEN b.t - w.kt >= 0.15 OR (b.confidence > w.kc AND w.kk <> 'start') THEN b.kind ELSE w.kk END,
         b.t - w.kt >= 0.15
  FROM walk w JOIN numbered b ON b.video_id = w.video_id AND b.n = w.n + 1),
survivors AS (
  SELECT video_id, kept FROM (SELECT *, coalesce(lead(appended) OVER (PARTITION BY video_id ORDER BY n), true) AS closes FROM walk) WHERE closes),
seconds AS (SELECT video_id, count(*) / 30.0 AS video_seconds FROM frames GROUP BY video_id),
merged AS (
  SELECT b.* FROM numbered b JOIN survivors s ON s.video_id = b.video_id AND s.kept = b.n JOIN seconds d ON d.video_id = b.video_id
  WHERE b.kind = 'start' OR d.video_seconds - b.t >= 0.15)"""

SHOTS = MERGED + """,
shots AS (
  SELECT m.video_id, row_number() OVER w - 1 AS shot_idx, m.t AS start, coalesce(lead(m.t) OVER w, d.video_seconds) AS "end", m.kind,
         m.duration AS boundary_seconds, m.confidence
  FROM merged m JOIN seconds d USING (video_id) WINDOW w AS (PARTITION BY m.video_id ORDER BY m.t, m.frame_idx))"""
