"""Planted shots, motion and colours."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cutlens.functions import color
from cutlens.functions import motion as mot
from cutlens.operators import motion, palette, shots
from cutlens.sources import adapters
from queries.visual import JOBS

SCHEMA = "video_id string, frame_idx bigint, t double, content_value double, luma_mean double, luma_std double"


def boundaries(spark, frames, thumbs):
    df = spark.createDataFrame([("v", i, i / 30, *f) for i, f in enumerate(frames)], SCHEMA)
    th = spark.createDataFrame([("v", i, t) for i, t in enumerate(thumbs)], "video_id string, frame_idx bigint, thumb array<double>")
    seconds = spark.createDataFrame([("v", len(frames) / 30)], "video_id string, video_seconds double")
    found = shots.merge_boundaries(shots.candidate_boundaries(df, th), seconds)
    return sorted((r.t, r.kind) for r in found.collect())


def test_planted_cuts_are_exact(spark):
    frames = [(0.42 if i in (47, 96, 150) else 0.004, 0.5, 0.25) for i in range(200)]
    got = boundaries(spark, frames, [[0.5] * 4] * 200)
    assert got == [(0.0, "start")] + [(i / 30, "cut") for i in (47, 96, 150)]


def test_noise_pan_and_dim_shot_have_no_boundary(spark):
    noise = [(0.003, 0.5, 0.25)] * 120
    assert boundaries(spark, noise, [[0.5] * 4] * 120) == [(0.0, "start")]
    pan = [(0.03 if 20 <= i < 80 else 0.004, 0.5, 0.25) for i in range(120)]
    slide = [[0.5 + 0.4 * math.sin((j + i) / 3) for j in range(64)] for i in range(120)]
    assert boundaries(spark, pan, slide) == [(0.0, "start")]
    dim = [(0.02 if 20 <= i < 40 else 0.004, 0.35, 0.01) for i in range(60)]
    assert boundaries(spark, dim, [[0.35] * 16] * 60) == [(0.0, "start")]


def test_cross_fade_and_fade_to_black(spark):
    # the ramp runs from the last pure frame (19) to the first pure one (29)
    level = lambda i: 0.2 if i < 20 else 0.8 if i > 28 else 0.2 + 0.6 * (i - 19) / 10
    fade = [(0.03 if 20 <= i <= 28 else 0.003, 0.5, 0.25) for i in range(60)]
    got = boundaries(spark, fade, [[level(i)] * 32 for i in range(60)])
    assert [k for _, k in got] == ["start", "dissolve"]
    # flat shoulders at both ends of the ramp are no blend of the frames around it
    flat = lambda i: 0.2 if i <= 20 else 0.8 if i >= 28 else 0.2 + 0.6 * (i - 20) / 8
    got = boundaries(spark, [(0.03 if 20 < i <= 28 else 0.004, flat(i), 0.2) for i in range(60)], [[flat(i)] * 32 for i in range(60)])
    assert [k for _, k in got] == ["start"]
    lum = lambda i: 0.5 if i < 20 else max(0.02, 0.5 - 0.05 * (i - 19)) if i < 40 else 0.5
    black = [(0.42 if i == 40 else 0.02 if 20 <= i < 30 else 0.004, lum(i), 0.01 if 28 <= i < 40 else 0.2) for i in range(60)]
    kinds = [k for _, k in boundaries(spark, black, [[lum(i)] * 16 for i in range(60)])]
    assert "fadeToBlack" in kinds and "cut" in kinds


def test_long_clusters_take_the_join_path_with_the_same_result(spark, monkeypatch):
    rng = random.Random(3)
    rows, t = [], 0.0
    rows.append(("v", -1, "start", 0.0, 0.0, 1.0, "b"))
    for i in range(120):
        t += rng.choice([0.05, 0.1, 0.133, 0.2])
        rows.append(("v", i, "cut", t, 0.0, rng.choice([0.6, 0.7, 0.8, 0.9]), "b"))
    df = spark.createDataFrame(rows, "video_id string, frame_idx bigint, kind string, t double, duration double, confidence double, basis string")
    seconds = spark.createDataFrame([("v", t + 1)], "video_id string, video_seconds double")
    kept = []
    for _, _, kind, at, _, c, _ in rows:
        if kept and at - kept[-1][0] < 0.15:
            if c > kept[-1][1] and kept[-1][2] != "start":
                kept[-1] = (at, c, kind)
        else:
            kept.append((at, c, kind))
    want = [round(k[0], 9) for k in kept]
    folded = sorted(round(r.t, 9) for r in shots.merge_boundaries(df, seconds).collect())
    monkeypatch.setattr(shots, "CLUSTER_ROWS", 2)
    joined = sorted(round(r.t, 9) for r in shots.merge_boundaries(df, seconds).collect())
    assert folded == want and joined == want


def test_zoom_is_recovered_despite_outliers(spark):
    pts = []
    for i in range(9):
        for j in range(9):
            x, y = 0.1 + 0.1 * i, 0.1 + 0.1 * j
            tx, ty = (x + 0.13, y - 0.2) if x + y > 1.55 else (0.5 + (x - 0.5) * 1.17, 0.5 + (y - 0.5) * 1.17)
            pts.append(("v", 0, 0, i * 9 + j, x, y, tx, ty))
    flow = spark.createDataFrame(pts, "video_id string, shot_idx int, pair int, point_id int, sx double, sy double, tx double, ty double")
    m = motion.compose_motion(motion.similarity_fit(flow)).withColumn("kind", mot.motion_kind(F.struct("scale", "tx", "ty", "rot", "residual", "n"))).first()
    assert abs(m.scale - 1.17) < 0.0234 and m.kind == "zoomIn"


@pytest.mark.parametrize("scale,tx,ty,kind", [(1.12, 0, 0, "zoomIn"), (0.88, 0, 0, "zoomOut"), (1, 0.12, 0, "panLeft"), (1, 0, 0.12, "panUp"), (1.20, 0.055, 0, "zoomIn")])
def test_motion_names(spark, scale, tx, ty, kind):
    m = F.struct(F.lit(float(scale)).alias("scale"), F.lit(float(tx)).alias("tx"), F.lit(float(ty)).alias("ty"), F.lit(0.0).alias("rot"), F.lit(0.0).alias("residual"), F.lit(4).alias("n"))
    assert spark.range(1).select(mot.motion_kind(m).alias("k")).first().k == kind


def test_dominant_colors_match_plain_lloyd(spark):
    rng = random.Random(4)
    px = [(rng.choice([0.1, 0.5, 0.9]) + rng.uniform(-0.05, 0.05), rng.random() * 0.2, rng.random()) for _ in range(90)]
    df = spark.createDataFrame([("a", i, *p) for i, p in enumerate(px)], "e string, sample_id int, r double, g double, b double")
    order = sorted(range(90), key=lambda i: 0.2126 * px[i][0] + 0.7152 * px[i][1] + 0.0722 * px[i][2])
    cents = [px[order[min(89, i * 90 // 2)]] for i in range(3)]
    for _ in range(8):
        near = [min(range(3), key=lambda c: sum((p[d] - cents[c][d]) ** 2 for d in range(3))) for p in px]
        for c in range(3):
            mine = [p for p, n in zip(px, near) if n == c]
            if mine:
                cents[c] = tuple(sum(p[d] for p in mine) / len(mine) for d in range(3))
    want = sorted(((near.count(c), cents[c]) for c in range(3)), key=lambda x: -x[0])
    got = palette.dominant_colors(df, ["e"]).orderBy("rank").collect()
    for row, (n, c) in zip(got, want):
        assert row.n == n and all(abs(a - b) < 1e-9 for a, b in zip((row.r, row.g, row.b), c))


def test_text_tracks_show_every_turn_in_full(spark, tmp_path):
    said = [(7, turn, "user", f"turn{turn} " + " ".join(f"w{turn}x{k}" for k in range(9)) + f"\nlast{turn}") for turn in range(4)]
    spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    shown = [t.replace("\n", " ") for *_, t in said]
    hits = {r.hit_id: r.text for r in adapters.turn_hits(spark, str(tmp_path)).collect()}
    assert hits == {k: " ".join(shown[: k + 1]) for k in range(4)}
    tracks = JOBS["text_tracks"](spark, str(tmp_path)).collect()
    words = {w for r in tracks for w in r.text.split(" ")}
    assert words == {w for t in shown for w in t.split(" ")} and max(r.growth for r in tracks) > 0


def test_blend_residual_is_evaluated_once(spark):
    frames = spark.createDataFrame([("v", i, i / 30.0, 0.05, 0.5, 0.3) for i in range(12)], "video_id string, frame_idx bigint, t double, content_value double, luma_mean double, luma_std double")
    thumbs = spark.createDataFrame([("v", i, [i * 0.02 + k * 0.01 for k in range(4)]) for i in range(12)], "video_id string, frame_idx bigint, thumb array<double>")
    found = shots.detect_gradual(frames, thumbs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("abs(") == 2  # one for the ends of a run, one for its pictures
    assert [(r.kind, r.frame_idx) for r in found.collect()] == [("dissolve", 1)]


def test_blend_residual_of_odd_pictures(spark):
    rows = [(1, [1.0, 3.0], [0.0, 2.0], [2.0, 4.0], 0.5), (2, [1.5, 3.0], [0.0, 2.0], [2.0, 4.0], 0.5), (3, [1.0], [0.0, 2.0], [2.0, 4.0], 0.5), (4, None, [0.0], [2.0], 0.5), (5, [], [], [], 0.5), (6, [None, 3.0], [0.0, 2.0], [2.0, 4.0], 0.5)]
    df = spark.createDataFrame(rows, "k int, f array<double>, a array<double>, b array<double>, w double")
    found = {r.k: r.r for r in df.select("k", color.blend_residual(F.col("f"), F.col("a"), F.col("b"), F.col("w")).alias("r")).collect()}
    assert found == {1: 0.0, 2: 0.25, 3: float("inf"), 4: float("inf"), 5: float("inf"), 6: None}


def test_fits_of_whole_pairs_equal_the_sliced_ones_in_one_shuffle(spark):
    rng = random.Random(9)
    rows = [(v, s, i % 3, i, x := rng.random(), y := rng.random(), 1.1 * x + rng.gauss(0, 0.01), 1.1 * y) for v in (0, 1) for s in range(3) for i in range(5 + 30 * s)]
    rows += [(0, 2, 0, 900, None, 0.5, 0.5, 0.5), (None, 2, 0, 901, 0.5, 0.5, 0.5, 0.5), (0, 2, 1, None, 0.3, 0.4, 0.5, 0.6)]
    points = spark.createDataFrame(rows, "video_id bigint, shot_idx bigint, pair bigint, point_id bigint, sx double, sy double, tx double, ty double")
    whole = motion.similarity_fit(points.repartition("video_id", "shot_idx"), min_points=3, whole=True)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    names = ["video_id", "shot_idx", "pair", "n", "scale", "rot", "dx", "dy", "residual"]
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())
    assert plain(whole) == plain(motion.similarity_fit(points, min_points=3)) and whole.count() >= 12
