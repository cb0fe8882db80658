"""Sliced building blocks against plain loops, with slices far smaller than the entities."""

import random
import time

import pandas as pd
from pyspark.sql import functions as F

from cutlens.operators import ordered as o
from cutlens.operators import timeline


def rows(n=60, keys=3, seed=1):
    rng = random.Random(seed)
    return [(k, i, rng.random()) for k in range(keys) for i in range(n - 7 * k)]


def test_positions_and_running_sum(spark):
    data = rows()
    df = spark.createDataFrame(data, "k int, i bigint, v double")
    ranked = o.positions(df, ["k"], ["v"], F.floor(F.col("v") * 10)).collect()
    for r in ranked:
        assert r.pos == sum(1 for k, _, v in data if k == r.k and v < r.v)
    sums = o.running_sum(df, ["k"], "i", {"s": F.col("v")}, rows=4).collect()
    before = o.running_sum(df, ["k"], "i", {"s": F.col("v")}, inclusive=False, rows=4).collect()
    for got, strict in ((sums, False), (before, True)):
        for r in got:
            want = sum(v for k, i, v in data if k == r.k and (i < r.i or (i == r.i and not strict)))
            assert abs(r.s - want) < 1e-9


def test_neighbours_islands_and_running_max(spark):
    data = rows()
    by = {(k, i): v for k, i, v in data}
    df = spark.createDataFrame(data, "k int, i bigint, v double")
    got = o.with_neighbours(df, ["k"], "i", 2, 3, lambda w: {"p": F.lag("v", 2).over(w), "n": F.lead("v", 3).over(w)}, rows=4).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.p == by.get((r.k, r.i - 2)) and r.n == by.get((r.k, r.i + 3))
    runs = {(r.k, r.i): r.run for r in o.islands(df, ["k"], "i", F.col("v") > 0.4, rows=4).collect()}
    for (k, i), run in runs.items():
        assert by[k, i] > 0.4 and run == sum(1 for j in range(i) if by[k, j] <= 0.4)
    tops = o.running_max(df, ["k"], "i", F.col("v"), "m", rows=4).collect()
    assert all(r.m == max(by[r.k, j] for j in range(r.i + 1)) for r in tops)


def test_time_joins(spark):
    rng = random.Random(5)
    left = [(k, round(rng.uniform(0, 30), 3)) for k in range(3) for _ in range(40)]
    right = [(k, round(rng.uniform(0, 30), 3)) for k in range(2) for _ in range(15)]
    l, r = spark.createDataFrame(left, "k int, t double"), spark.createDataFrame(right, "k int, b double")
    for row in o.nearest(l, r, ["k"], "t", tolerance=1.0, width=2.0, right_at="b").collect():
        own = sorted((abs(b - row.t), b) for k, b in right if k == row.k)
        want = own[0][1] if own and own[0][0] <= 1.0 else None
        assert row.near_t == want
    spans = [(k, b, b + rng.uniform(0, 9)) for k, b in right]
    s = spark.createDataFrame(spans, "k int, s double, e double")
    assert o.active_at(l, s, ["k"], "t", "s", "e", 2.0).count() == sum(1 for k, t in left for k2, a, b in spans if k == k2 and a <= t < b)


def test_chains(spark):
    rng = random.Random(9)
    nxt = {i: i + rng.randint(1, 4) for i in range(200)}
    links = spark.createDataFrame([(0, a, b) for a, b in nxt.items() if b < 200], "k int, node bigint, next bigint")
    heads = spark.createDataFrame([(0, 3)], "k int, node bigint")
    seen, at = set(), 3
    while at is not None and at < 200:
        seen.add(at)
        at = nxt.get(at)
    assert {r.node for r in o.chain_members(links, heads, ["k"]).collect()} == seen
    parents = spark.createDataFrame([(0, i, None if i % 50 == 0 else i - 1) for i in range(150)], "k int, node bigint, parent bigint")
    assert all(r.root == r.node // 50 * 50 for r in o.chain_roots(parents, ["k"]).collect())


def test_walk_continues_across_calls(spark):
    df = spark.createDataFrame([(k, i, i % 5) for k in range(3) for i in range(23)], "k int, i bigint, v bigint")

    def walk(pdf: pd.DataFrame, state):
        total = state["total"] if state else 0
        out = []
        for v in pdf["v"]:
            total = (total + int(v)) % 7
            out.append(total)
        return pdf[["i"]].assign(s=out), {"total": total}

    whole = {(r.k, r.i): r.s for r in o.walk_in_order(df, ["k"], "i", walk, "k int, i bigint, s bigint", 1000).collect()}
    parts = {(r.k, r.i): r.s for r in o.walk_in_order(df, ["k"], "i", walk, "k int, i bigint, s bigint", 5).collect()}
    assert whole == parts and len(whole) == 69


def test_walk_puts_short_entities_into_one_group(spark):
    big = 2**60  # beyond what a double holds; one entity has no key
    df = spark.range(400).selectExpr(f"nullif(id div 2, 7) + {big}L AS k", "id % 2 AS i", "id AS v").repartition(3)

    def walk(pdf: pd.DataFrame, state):
        out = pdf["v"].cumsum() + (state["s"] if state else 0)
        return pdf[["i"]].assign(s=out, at=pdf.index), {"s": int(out.iloc[-1])}

    want = {(None if v // 2 == 7 else big + v // 2, v % 2): v if v % 2 == 0 else 2 * v - 1 for v in range(400)}
    for rows_per_call in (20_000, 1):
        found = o.walk_in_order(df, ["k"], "i", walk, "k bigint, i bigint, s bigint, at bigint", rows_per_call).collect()
        assert {(r.k, r.i): r.s for r in found} == want and len(found) == 400
        assert max(r.at for r in found) > 50  # the place in the group: with a group for each entity at most 1


def test_nearest_in_one_crowded_cell_is_linear(spark):
    left = spark.range(20_000).selectExpr("'v' AS video_id", "id / 1000.0D AS t")
    right = spark.range(10_000).selectExpr("'v' AS video_id", "id / 500.0D + 0.0004D AS t", "id")
    start = time.perf_counter()
    found = o.nearest(left, right, ["video_id"], "t", ["id"], width=60.0).collect()
    assert time.perf_counter() - start < 15
    assert len(found) == 20_000
    for r in found[::501]:
        best = min(range(10_000), key=lambda i: (abs(i / 500 + 0.0004 - r.t), i)) if r.t < 1 else None
        assert best is None or r.near_id == best


def test_long_intervals_are_stored_in_few_cells(spark):
    rng = random.Random(12)
    spans = [(k % 2, a, a + d) for k, (a, d) in enumerate([(0.0, 36_000.0), (5.0, 0.0), (-3.0, 1.0), (7.25, 0.5), (100.0, 4096.0), (0.1, 1.0000001)] + [(rng.uniform(-50, 500), rng.choice([0.01, 1, 3, 70, 900])) for _ in range(40)])]
    points = [(k, rng.choice([rng.uniform(-60, 600), a, b])) for k, a, b in spans for _ in range(4)]
    left = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(points)], "i int, k int, t double")
    right = spark.createDataFrame([(j, *s) for j, s in enumerate(spans)], "j int, k int, s double, e double")
    found = o.active_at(left, right, ["k"], "t", "s", "e")
    assert found.columns == ["i", "k", "t", "j", "s", "e"]
    assert sorted((r.i, r.j) for r in found.collect()) == sorted((i, j) for i, (k, t) in enumerate(points) for j, (q, a, b) in enumerate(spans) if k == q and a <= t < b)
    stored = o.active_at(left.limit(0), right, ["k"], "t", "s", "e")
    assert stored.count() == 0 and o.active_at(left, right.limit(0), ["k"], "t", "s", "e").count() == 0


def test_a_clip_lookup_moves_only_the_columns_asked_for(spark):
    rows = [("p", i, f"c{i}", float(i), 1.0, "wide" * 9) for i in range(4)] + [("q", 0, "d0", 2.0, 1.0, "wide")]
    clips = spark.createDataFrame(rows, "project_id string, pos bigint, clip_id string, start double, duration double, crop_start string").withColumn(
        "transition", F.lit(None).cast("struct<kind:string,duration:double,direction:string>"))
    instants = spark.createDataFrame([("p", -1.0), ("p", 0.0), ("p", 2.5), ("p", 9.0), ("q", 2.0), ("none", 0.0)], "project_id string, t double")
    found = timeline.active_clip(clips, instants)
    assert sorted((r.project_id, r.t, r.clip and r.clip.clip_id) for r in found.collect()) == [
        ("p", -1.0, "c0"), ("p", 0.0, "c0"), ("p", 2.5, "c2"), ("p", 9.0, "c3"), ("q", 2.0, "d0")]
    plan = found.select("project_id", "t", "clip.pos")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("crop_start" in line for line in plan.splitlines() if "LogicalRDD" not in line)
