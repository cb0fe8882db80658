"""Assignment against brute force, text tracks and edit replay against plain walks."""

import inspect
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from cutlens.functions.labels import feature_distance
from cutlens.operators import assign, auction, edits, shots, text
from cutlens.operators.auction import cheapest_options
from cutlens.streaming.streams import find_cuts
from queries import arrange


def test_auction_equals_brute_force(spark):
    rng = random.Random(1)
    rows, best = [], {}
    for p in range(12):
        n = rng.randint(1, 5)
        m = n + rng.randint(0, 2)
        cost = [[rng.choice([rng.random() * 3, float(rng.randint(0, 3))]) for _ in range(m)] for _ in range(n)]
        best[p] = min(sum(cost[i][j] for i, j in enumerate(pick)) for pick in itertools.permutations(range(m), n))
        rows += [(p, f"s{i}", j, cost[i][j]) for i in range(n) for j in range(m)]
    rows += [(20, "s0", 0, 4.0), (20, "s0", 1, 1.0), (20, "s0", 2, 9.0), (20, "s0", 3, 7.0), (20, "s1", 0, 8.0), (20, "s1", 1, 3.0), (20, "s1", 2, 2.0), (20, "s1", 3, 6.0)]
    best[20] = 3.0
    rows += [(30, "s0", 0, 1.0), (30, "s1", 0, 1.0), (31, "s0", 0, None)]  # two slots for one option; no known cost
    costs = spark.createDataFrame(rows, "project_id int, slot_id string, option int, cost double")
    found = cheapest_options(costs).collect()
    totals = {}
    for r in found:
        totals[r.project_id] = totals.get(r.project_id, 0) + r.cost
    assert totals.keys() == best.keys() and all(abs(totals[p] - best[p]) < 1e-9 for p in best)
    assert len({(r.project_id, r.option) for r in found}) == len(found) and all(r.gap <= 1e-4 and r.rounds > 0 for r in found)
    assert sorted(r.option for r in found if r.project_id == 20) == [1, 2]
    assert cheapest_options(costs.limit(0)).count() == 0


def test_small_projects_are_solved_apart_from_the_auction(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(p, f"s{i}", j, float(rng.randint(0, 4))) for p, n in enumerate((1, 2, 3, 5)) for i in range(n) for j in range(n + p % 2)]
    rows += [(9, "s0", 0, 1.0), (9, "s1", 0, 1.0), (9, "s1", None, None)]  # no option of its own for each
    costs = spark.createDataFrame(rows, "project_id int, slot_id string, option int, cost double")

    def totals(found):
        assert len({(r.project_id, r.option) for r in found}) == len({(r.project_id, r.slot_id) for r in found}) == len(found) == 11
        return {p: sum(r.cost for r in found if r.project_id == p) for p in range(4)}

    apart = cheapest_options(costs).collect()
    assert {r.rounds for r in apart} == {1} and all(r.gap < 1e-9 for r in apart)
    monkeypatch.setattr(auction, "SMALL_SLOTS", 2)  # both ways in one call
    mixed = cheapest_options(costs).collect()
    assert totals(mixed) == totals(apart) and max(r.rounds for r in mixed if r.project_id > 1) > 1


def test_shortest_paths_equal_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 4)
        m = n + rng.randint(0, 2)
        cost = np.array([[rng.choice([rng.random(), float(rng.randint(-2, 3)), np.inf]) for _ in range(m)] for _ in range(n)])
        best = min(sum(cost[i][j] for i, j in enumerate(pick)) for pick in itertools.permutations(range(m), n))
        won, gap = auction.cheapest_columns(cost)
        assert (won is None) == (not np.isfinite(best))
        assert won is None or (abs(cost[np.arange(n), won].sum() - best) < 1e-9 and gap < 1e-9 and len(set(won)) == n)


def test_near_prints_in_a_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(assign, "CELL_PRINTS", 8)
    rng = random.Random(5)
    prints = [("hot", i, [rng.gauss(0, 0.2) for _ in range(4)]) for i in range(90)] + [("p", i, [rng.uniform(-3, 3) for _ in range(4)]) for i in range(60)]
    prints += [("hot", 90, None), ("hot", 91, []), ("hot", 92, [0.0]), ("hot", 93, prints[0][2]), (None, 94, prints[0][2])]
    df = spark.createDataFrame(prints, "project_id string, asset_id int, print array<double>").repartition(3)
    found = assign.near_duplicates(df)
    whole = [p for p in prints if p[2]]
    near = lambda a, b: len(a[2]) == len(b[2]) and sum((x - y) ** 2 for x, y in zip(a[2], b[2])) ** 0.5 < 0.55
    assert sorted((r.project_id, r.asset_id, r.other_id) for r in found.collect()) == sorted(
        (a[0], a[1], b[1]) for a, b in itertools.combinations(sorted(whole, key=lambda p: p[1]), 2) if a[0] == b[0] and a[1] != b[1] and near(a, b))


def test_blocks_of_prints_meet_as_products(spark, monkeypatch):
    monkeypatch.setattr(assign, "CELL_PRINTS", 16)
    rng = random.Random(6)
    unit = lambda v: [float(np.float32(x / sum(y * y for y in v) ** 0.5)) for x in v]
    prints = [(i % 2, i, unit([rng.gauss(0, 1) for _ in range(64)])) for i in range(160)]
    prints += [(0, 160, prints[0][2]), (0, 161, [*prints[0][2][:-1], None]), (0, 162, [*prints[0][2][:-1], float("nan")]), (0, 163, [0.5] * 32), (0, 164, [0.51] * 32), (0, 165, None)]
    df = spark.createDataFrame(prints, "project_id int, asset_id bigint, print array<float>").repartition(3)
    found = assign.near_duplicates(df, 1.25)
    assert "zip_with" not in found._jdf.queryExecution().toString()  # no pair is a row before it is close
    a, b = df.alias("a"), df.alias("b")
    plain = a.join(b, (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.asset_id") < F.col("b.asset_id"))).select(
        F.col("a.project_id"), F.col("a.asset_id"), F.col("b.asset_id").alias("other_id"), feature_distance(F.col("a.print"), F.col("b.print")).alias("distance")).filter("distance < 1.25")
    rows = sorted(tuple(r) for r in found.collect())
    assert len(rows) > 50 and (0, 0, 160, 0.0) in rows and rows == sorted(tuple(r) for r in plain.collect())


def test_exchanges_lower_cost_plus_likeness(spark):
    prints = {"a": [0.0, 0.0], "b": [0.1, 0.0], "c": [5.0, 5.0], "d": [9.0, 0.0]}
    names = ["a", "b", "c", "d"]
    rng = random.Random(3)
    costs = [[rng.random() for _ in names] for _ in names]
    rows = [("p", s, k, (k, names[k], prints[names[k]]), costs[k]) for s in (0, 1, 2) for k in range(4)] + [("two", 0, k, (k, "a", prints["a"]), [1.0, 1.0]) for k in range(2)]
    picks = spark.createDataFrame(rows, "project_id string, seed int, k int, pick struct<at:int,asset_id:string,print:array<double>>, costs array<double>")
    near = lambda x, y: max(0.0, 1 - sum((i - j) ** 2 for i, j in zip(prints[x], prints[y])) ** 0.5 / 0.55) * 1.5

    def total(order):
        return sum(costs[k][c] for k, c in enumerate(order)) + sum(near(names[x], names[y]) for x, y in zip(order, order[1:]))

    found = assign.vary(picks).collect()
    for s in (0, 1, 2):
        order = [r.pick.at for r in sorted((r for r in found if r.project_id == "p" and r.seed == s), key=lambda r: r.k)]
        assert sorted(order) == [0, 1, 2, 3] and total(order) <= total([0, 1, 2, 3])
        for i, j in itertools.combinations(range(4), 2):  # no exchange is left that would help
            other = order.copy()
            other[i], other[j] = other[j], other[i]
            assert total(other) >= total(order) - 1e-9
    assert [r.pick.at for r in sorted((r for r in found if r.project_id == "two"), key=lambda r: r.k)] == [0, 1]


def test_a_round_of_exchanges_holds_only_what_still_moves(spark, monkeypatch):
    rows = [(p, 0, k, (k, str(k), None), [float(abs(k - j)) if p == "still" else float(k != (j + 1) % 4) for j in range(4)]) for p in ("still", "moving") for k in range(4)]
    picks = spark.createDataFrame(rows, "project_id string, seed int, k int, pick struct<at:int,asset_id:string,print:array<double>>, costs array<double>")
    held, cut = [], assign.cut_lineage
    monkeypatch.setattr(assign, "cut_lineage", lambda df: (held.append(cut(df)), held[-1])[1])
    found = assign.vary(picks).collect()
    assert sorted((r.project_id, r.k) for r in found) == [(p, k) for p in ("moving", "still") for k in range(4)]
    assert [r.pick.at for r in sorted(found, key=lambda r: (r.project_id, r.k))] == [3, 0, 1, 2, 0, 1, 2, 3]
    assert [df.count() for df in held][:3] == [8, 8, 4]


def test_arranged_variety_compares_prints_for_every_seed(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, i % 25) for i in range(36)], "c_custkey bigint, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    same = [1.0, 0.0, 0.0]
    spark.createDataFrame([(i, same) for i in range(8)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, vary = [], assign.vary
    monkeypatch.setattr(assign, "vary", lambda picks: (seen.append(picks), vary(picks))[1])
    found = arrange.JOBS["arranged_variety"](spark, str(tmp_path)).collect()
    assert {r.seed for r in found} == {0, 1, 2, 3} and len(found) == 4 * 36
    assert [list(r.pick["print"]) for r in seen[0].select("pick").distinct().limit(3).collect()] == [same] * 3


def test_exchanges_go_on_until_none_is_left(spark):
    assert list(inspect.signature(assign.vary).parameters) == ["picks"]  # no limit on rounds
    n = 8  # each slot shows what belongs to the next one: an exchange puts one right, and one a round is taken
    rows = [("p", 0, k, ((k + 1) % n, str(k), None), [float(j != k) for j in range(n)]) for k in range(n)]
    picks = spark.createDataFrame(rows, "project_id string, seed int, k int, pick struct<at:int,asset_id:string,print:array<double>>, costs array<double>")
    assert all(r.pick.at == r.k for r in assign.vary(picks).collect())
    assert assign.vary(picks.limit(0)).count() == 0


RECT = "struct<x:double,y:double,w:double,h:double>"


def test_pruned_assignment_is_optimal_and_pins_hold(spark):
    rng = random.Random(2)
    slots = spark.createDataFrame(
        [("p", f"s{i}", i, r, f, 0.8, None, 0.0, "image", 1.0, 0.5625) for i, (r, f) in enumerate(zip(["opening", "hero", "body", "closing"], ["wide", "closeUp", "medium", "wide"]))],
        f"project_id string, slot_id string, scene_idx bigint, role string, framing string, framing_confidence double, subject {RECT}, subject_confidence double, source_kind string, seconds double, canvas_aspect double")
    n = 9
    assets = spark.createDataFrame([("p", i, "image", 0.75, 0.0, None, i) for i in range(n)], "project_id string, asset_id bigint, kind string, aspect double, asset_seconds double, created_at timestamp, arrival bigint")
    feats = spark.createDataFrame(
        [("p", i, rng.choice(["wide", "medium", "closeUp"]), rng.uniform(-1, 1), False, rng.random(), None, 0.75, 0, None) for i in range(n)],
        f"project_id string, asset_id bigint, framing string, aesthetic double, is_utility boolean, sharpness double, region {RECT}, aspect double, faces int, print array<float>")
    got = assign.assign_assets(slots, assets, feats).collect()
    base = {(r.slot_id, r.asset_id): r.cost for r in assign.slot_asset_costs(slots, assets, feats).collect()}
    total = lambda picks: sum(base[f"s{i}", a] + abs(a / (n - 1) - i / 3) * 0.3 for i, a in enumerate(picks))
    best = min(total(p) for p in itertools.permutations(range(n), 4))
    picks = [next(r.asset_id for r in got if r.slot_id == f"s{i}") for i in range(4)]
    assert abs(total(picks) - best) < 1e-9
    locks = spark.createDataFrame([("p", "s2", 8)], "project_id string, slot_id string, asset_id bigint")
    pinned = {r.slot_id: r for r in assign.assign_assets(slots, assets, feats, locks).collect()}
    assert pinned["s2"].asset_id == 8 and pinned["s2"].locked and len(pinned) == 4


def test_equal_costs_are_equal_to_the_last_bit(spark):
    slots = spark.createDataFrame([("p", "s", 0, "body", "wide", 0.8, None, 0.0, "image", 1.0, 0.75)], f"project_id string, slot_id string, scene_idx bigint, role string, framing string, framing_confidence double, subject {RECT}, subject_confidence double, source_kind string, seconds double, canvas_aspect double")
    assets = spark.createDataFrame([("p", 0, "video", 0.75, 9.0, None, 0)], "project_id string, asset_id bigint, kind string, aspect double, asset_seconds double, created_at timestamp, arrival bigint")
    feats = spark.createDataFrame([("p", 0, "wide", 1.0, False, 1.0, None, 0.75, 0, None)], f"project_id string, asset_id bigint, framing string, aesthetic double, is_utility boolean, sharpness double, region {RECT}, aspect double, faces int, print array<float>")
    assert assign.slot_asset_costs(slots, assets, feats).first().cost == 0.14


def _chain(hits, gap=0.6):
    """Track of every hit by a plain walk: the root of its best predecessors."""
    def alike(a, b):
        x, y = (set(w for w in s.lower().split(" ") if w) for s in (a, b))
        return len(x & y) / len(x | y) if x or y else 1.0

    def overlap(a, b):
        ix, iy = (max(0.0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
        return ix * iy / (a[2] * a[3] + b[2] * b[3] - ix * iy)

    order = sorted(range(len(hits)), key=lambda i: (hits[i][2], hits[i][1]))
    track = {}
    for n, i in enumerate(order):
        best = None
        for m, j in enumerate(order[:n]):
            a, b = hits[j], hits[i]
            grow = a[3].startswith(b[3]) or b[3].startswith(a[3])
            shared, like = overlap(a[5], b[5]), alike(a[3], b[3])
            if b[2] - a[2] <= gap and shared > 0.35 and (like > 0.55 or grow):
                score = (shared * 0.5 + max(like, 0.8 if grow else 0.0) * 0.5, m)
                best = max(best, (*score, j)) if best else (*score, j)
        track[i] = track[best[2]] if best else n
    return {hits[i][1]: t for i, t in track.items()}


def test_text_tracks_follow_best_predecessors(spark):
    rng = random.Random(6)
    words = "one two three four five six".split()
    hits = []
    for i in range(140):
        place = i % 2
        n = rng.randint(1, 6)
        hits.append(("v", i, (i // 2) * 0.25 + (2.0 if i > 90 else 0.0), " ".join(words[:n]) if place else f"fixed title {i // 60}", 0.9, (0.1, 0.1 + 0.5 * place, 0.3 + 0.02 * n, 0.08)))
    # a title shown short for one frame, two hits at one time, a box beyond the frame
    extra = [(0, "breaking news", 0.5), (1, "breaking", 0.5), (2, "breaking news today", 0.5), (3, "breaking news today", 0.51), (4, "elsewhere", 1.3)]
    hits += [("w", i, 0.2 * i if i < 3 else 0.4, t, 0.9, (x, 0.2, 0.4, 0.1)) for i, t, x in extra]
    df = spark.createDataFrame(hits, f"video_id string, hit_id bigint, t double, text string, confidence double, frame {RECT}").repartition(3)
    found = {(r.video_id, r.hit_id): r.track for r in text.link_hits(df).collect()}
    for video in "vw":
        assert {h: t for (v, h), t in found.items() if v == video} == _chain([h for h in hits if h[0] == video])
    assert 2 <= len({t for (v, _), t in found.items() if v == "v"}) <= 12
    assert [found["w", i] for i in range(5)] == [0, 0, 0, 0, 4]  # the short form does not end the track
    assert text.link_hits(df.limit(0)).count() == 0


def test_replay_with_undo_redo_and_structure(spark):
    log = [
        ("p", 0, "setClipVolume", "b", "0.5", "1", None, None), ("p", 1, "setClipVolume", "b", "0.4", "0.5", None, None),  # one gesture
        ("p", 2, "moveClip", None, None, None, 0, 2), ("p", 3, "undo", None, None, None, None, None), ("p", 4, "redo", None, None, None, None, None),
        ("p", 5, "splitClip", "b", "b2", None, None, None), ("p", 6, "setClipVolume", "b", "0.9", "0.4", None, None),
        ("p", 7, "deleteClip", None, None, None, 3, None), ("p", 8, "undo", None, None, None, None, None), ("p", 9, "undo", None, None, None, None, None),
        ("p", 10, "setClipSpeed", "c", "2", "1", None, None), ("p", 11, "redo", None, None, None, None, None),
    ]
    df = spark.createDataFrame(log, "project_id string, seq bigint, kind string, entity_id string, new_value string, old_value string, index bigint, to_index bigint")
    assert edits.coalesce_edits(df).count() == len(log)  # without an open gesture nothing merges
    df = df.selectExpr("*", "CASE WHEN seq <= 1 THEN 1 END AS gesture", "'clipvol:b' AS gesture_key")
    clips = spark.createDataFrame([("p", i, c) for i, c in enumerate("abc")], "project_id string, pos int, clip_id string")
    got = {r.clip_id: (r.pos, r.fields or {}) for r in edits.replay_edits(df, clips).collect()}
    # a moved to the end and stayed there; b was split; deleting and the second volume were undone
    assert [c for c, _ in sorted(got.items(), key=lambda kv: kv[1][0])] == ["b", "b2", "c", "a"]
    assert got["b"][1] == {"setClipVolume": "0.4"} and got["b2"][1] == {"setClipVolume": "0.4"} and got["c"][1] == {"setClipSpeed": "2"}
    steps = edits.coalesce_edits(df)
    assert {(r.step, r.depth) for r in edits.undo_depths(steps, 3).collect()} == {(r.step, r.depth) for r in edits.undo_depths(steps).collect()}


def test_edits_merge_only_under_the_key_of_an_open_gesture(spark):
    rows = [
        (0, "setClipVolume", "b", 1, "clipvol:b"), (1, "setClipVolume", "b", 1, "clipvol:b"),  # one step
        (2, "setClipVolume", "a", 2, "clipvol:b"), (3, "setClipVolume", "a", 2, "clipvol:b"),  # another clip's gesture: apart
        (4, "setClipVolume", "c", 3, "clipvol:c"), (5, "setClipVolume", "c", 3, "clipvol:c"), (6, "undo", None, 3, "clipvol:c"),
        (7, "setClipVolume", "c", 3, "clipvol:c"), (8, "setClipVolume", "c", 3, "clipvol:c"),  # the undo closed it: apart
        (9, "setClipVolume", "c", 4, "clipvol:c"),  # a new gesture with the same key goes on
        (10, "insertClip", "d", 4, "clipvol:c"), (11, "setClipVolume", "c", None, None),
    ]
    log = spark.createDataFrame([("p", q, k, e, str(q), "o", g, key) for q, k, e, g, key in rows], "project_id string, seq bigint, kind string, entity_id string, new_value string, old_value string, gesture int, gesture_key string")
    assert sorted((r.first_seq, r.seq) for r in edits.coalesce_edits(log).collect()) == [(0, 1), (2, 2), (3, 3), (4, 5), (6, 6), (7, 7), (8, 9), (10, 10), (11, 11)]


def test_streamed_cuts_wait_for_context_and_flush():
    frames = {i: (i / 30, 0.42 if i in (5, 11) else 0.004, 1000 * i) for i in range(12)}
    cuts, at, needed = find_cuts(frames, 0, final=False)
    assert [c[0] for c in cuts] == [5] and at == 10 and needed == 8
    cuts, at, _ = find_cuts(frames, at, final=True)
    assert [c[0] for c in cuts] == [11] and at == 12


def test_streamed_cuts_go_on_after_a_missing_frame():
    frames = {i: (i / 30, 0.42 if i == 25 else 0.004, 1000 * i) for i in range(40) if i != 10}
    cuts, at, _ = find_cuts(frames, 0, final=False, passed=11_000)
    assert cuts == [] and at == 8  # frames 8 and 9 wait: frame 10 may still come
    cuts, at, needed = find_cuts(frames, at, final=False, passed=11_001)
    assert [c[0] for c in cuts] == [25] and at == 38 and needed == 36
    cuts, at, _ = find_cuts(frames, 0, final=True)
    assert [c[0] for c in cuts] == [25] and at == 40


def test_streamed_cuts_sum_neighbours_as_the_batch_form():
    # just below the ratio when summed side by side, at it when summed in one go with compensation
    values = [v / 500 for v in (37.89, 5.97, 165.99, 107.64, 69.82)]
    frames = {i: (i / 30, v, 1000 * i) for i, v in enumerate(values)}
    assert find_cuts(frames, 2, final=False)[0] == []


def test_a_run_without_its_end_pictures_is_no_dissolve(spark):
    level = lambda i: 0.2 if i < 20 else 0.8 if i > 28 else 0.2 + 0.6 * (i - 19) / 10
    frames = spark.createDataFrame([("v", i, i / 30, 0.03 if 20 <= i <= 28 else 0.003, 0.5, 0.25) for i in range(60)], "video_id string, frame_idx bigint, t double, content_value double, luma_mean double, luma_std double")
    pictures = lambda gone: spark.createDataFrame([("v", i, [level(i)] * 32) for i in range(60) if i not in gone], "video_id string, frame_idx bigint, thumb array<double>")
    whole = shots.detect_gradual(frames, pictures([])).collect()
    assert [r.kind for r in whole] == ["dissolve"]
    inside = shots.detect_gradual(frames, pictures([23])).collect()
    assert [r.kind for r in inside] == ["dissolve"] and abs(inside[0].confidence - whole[0].confidence) < 0.01
    assert shots.detect_gradual(frames, pictures([29])).collect() == []

