"""Click tracks, beat grids and music sections."""

import numpy as np
import pytest

from cutlens.operators import audio, music


def click_track(bpm, seconds, rate=22050):
    rng = np.random.default_rng(7)
    x = rng.uniform(-0.01, 0.01, int(seconds * rate))
    for k in range(int(seconds * bpm / 60)):
        at = int(k * 60 / bpm * rate)
        n = min(len(x) - at, int(0.02 * rate))
        x[at:at + n] += np.exp(-np.arange(n) / (0.004 * rate)) * np.sin(np.arange(n) * 0.3)
    return x


def envelope(spark, x):
    blocks = [("t", i, [float(v) for v in x[i * 512:(i + 1) * 512]]) for i in range(len(x) // 512)]
    pcm = spark.createDataFrame(blocks, "track_id string, block bigint, samples array<double>")
    return audio.onset_envelope(audio.spectra(audio.frame_signal(pcm))).cache()


@pytest.mark.parametrize("bpm", [96, 128, 140])
def test_click_tracks_give_their_tempo(spark, bpm):
    assert abs(audio.estimate_tempo(envelope(spark, click_track(bpm, 12))).first().bpm - bpm) < 2


def test_beats_of_a_click_track_lie_on_the_clicks(spark):
    onset = envelope(spark, click_track(120, 8))
    tempo = audio.estimate_tempo(onset)
    beats = audio.beat_grid(onset, tempo, spark.createDataFrame([("t", 8.0)], "track_id string, track_seconds double")).orderBy("i").collect()
    assert len(beats) >= 10
    for b in beats[:10]:
        assert abs(b.t * 2 - round(b.t * 2)) / 2 < 0.03


def plain_beats(v, bpm, rate):
    period, n = 60 / bpm * rate, len(v)
    def comb(o):
        return sum(v[o + int(j * period)] for j in range(n) if o + int(j * period) < n)
    pos = float(max(range(max(1, int(period))), key=lambda o: (comb(o), -o)))
    r, out = max(1, int(period * 0.08)), []
    while pos < n:
        c = int(pos)
        peak = c
        for i in range(max(0, c - r), min(n - 1, c + r) + 1):
            if v[i] > v[peak]:
                peak = i
        at = float(peak)
        if 0 < peak < n - 1:
            a, p, b = v[peak - 1], v[peak], v[peak + 1]
            if abs(a - 2 * p + b) > 1e-12:
                at += min(max(0.5 * (a - b) / (a - 2 * p + b), -0.5), 0.5)
        out.append(at)
        pos = at + period
    return out


def test_beat_grid_matches_a_plain_walk(spark):
    rng = np.random.default_rng(11)
    v = rng.random(300)
    onset = spark.createDataFrame([("t", i, float(x)) for i, x in enumerate(v)], "track_id string, k bigint, v double")
    bpm, rate = 121.0, 22050 / 512
    tempo = spark.createDataFrame([("t", bpm, 300)], "track_id string, bpm double, n bigint")
    got = audio.beat_grid(onset, tempo, spark.createDataFrame([("t", 1e9)], "track_id string, track_seconds double")).orderBy("i").collect()
    want = plain_beats([float(x) for x in v], bpm, rate)
    assert len(got) == len(want) and all(abs((b.t * 22050 - 512) / 512 - w) < 1e-6 for b, w in zip(got, want))


def absorb_plain(bands, least):
    """Short runs absorbed one by one, left to right, until nothing changes."""
    bands, changed = list(bands), True
    while changed:
        changed, start, i = False, 0, 1
        while i <= len(bands):
            if i == len(bands) or bands[i] != bands[start]:
                before, after = bands[start - 1] if start else None, bands[i] if i < len(bands) else None
                near = [b for b in (before, after) if b is not None]
                if i - start < least and near:
                    fill = min(near, key=lambda b: abs(b - bands[start]))
                    if fill != bands[start]:
                        bands[start:i] = [fill] * (i - start)
                        changed = True
                start = i
            i += 1
    return bands


def test_sections_follow_plain_absorption(spark):
    rng = np.random.default_rng(3)
    rows, lengths, want = [], {}, {}
    for track in range(6):
        level = np.repeat(rng.random(14), rng.integers(2, 14, 14)) + rng.normal(0, 0.02, 1)
        n = len(level)
        lengths[track] = n / 4
        rows += [(track, i, float(x)) for i, x in enumerate(level)]
        smooth = [level[max(0, i - 3):i + 1].mean() for i in range(n)]
        lo, hi = min(smooth), max(smooth)
        bands = [0 if (s - lo) / (hi - lo) < 0.35 else 1 if (s - lo) / (hi - lo) < 0.72 else 2 for s in smooth]
        least = max(1, int(max(2.0, n / 4 * 0.06) * 4))
        merged = absorb_plain(bands, least)
        want[track] = [0] + [i for i in range(1, n) if merged[i] != merged[i - 1]]
    energy = spark.createDataFrame(rows, "track_id int, i bigint, rms double")
    tracks = spark.createDataFrame(list(lengths.items()), "track_id int, track_seconds double")
    got = music.music_sections(energy, tracks).collect()
    for track, starts in want.items():
        mine = sorted((r.start, r.end) for r in got if r.track_id == track)
        assert [round(s * 4) for s, _ in mine] == starts
        assert all(a[1] == b[0] for a, b in zip(mine, mine[1:])) and mine[-1][1] == lengths[track]


def test_arch_runs_from_intro_over_peak_to_outro(spark):
    level = np.concatenate([np.full(60, 0.1), np.linspace(0.1, 0.95, 60), np.full(40, 0.95), np.linspace(0.95, 0.12, 40), np.full(40, 0.12)])
    energy = spark.createDataFrame([("t", i, float(x)) for i, x in enumerate(level)], "track_id string, i bigint, rms double")
    got = music.music_sections(energy, spark.createDataFrame([("t", 60.0)], "track_id string, track_seconds double")).orderBy("start").collect()
    kinds = [r.kind for r in got]
    assert kinds[0] == "intro" and kinds[-1] == "outro" and "peak" in kinds


def test_speech_row_for_short_and_coarse_spectra(spark):
    from cutlens.operators.audio import speech_presence

    spectra = [("short", k, [1.0] * 513) for k in range(5)] + [("coarse", k, [1.0, 2.0, 3.0]) for k in range(20)] + [("fine", k, [1.0] * 513) for k in range(20)]
    df = spark.createDataFrame(spectra, "track_id string, k int, mags array<double>")
    onset = spark.createDataFrame([(t, k, float(k % 4 == 0)) for t in ("coarse", "fine") for k in range(80)], "track_id string, k bigint, v double")
    found = {r.track_id: r for r in speech_presence(df, onset).collect()}
    assert found["short"].basis == "insufficient audio for speech heuristic" and found["short"].confidence == 0.2 and not found["short"].present
    assert found["coarse"].basis == "spectrogram too coarse for band analysis" and found["coarse"].confidence == 0.2 and not found["coarse"].present
    assert found["fine"].basis.startswith("300-3400Hz band ratio") and found["fine"].confidence > 0.2
