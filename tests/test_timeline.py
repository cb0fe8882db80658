"""What the timeline lookups move and compute."""

import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cutlens.operators import timeline
from cutlens.session import landed
from cutlens.sources import adapters as A
from queries import timelines

FOLDER = "/root/testdata/sf0.001"


def test_landed_readers_take_only_their_columns(spark):
    table = landed(spark.range(10).select("id", (F.col("id") * 2).alias("twice"), F.lit("x").alias("label")))
    plan = table.select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan.split("ReadSchema:")[1] and sorted(r.twice for r in table.select("twice").collect()) == list(range(0, 20, 2))


def test_lookup_moves_only_what_is_asked_for(spark):
    clips = landed(timeline.relayout(A.clips(spark, FOLDER)))
    state = timeline.clip_state(clips, A.instants(spark, FOLDER)).select("project_id", "t", "opacity")
    plan = state._jdf.queryExecution().optimizedPlan().toString()
    assert "crop_start" not in plan.split("Relation")[0] and "grade" not in plan.split("Relation")[0]
    full = timeline.clip_state(clips, A.instants(spark, FOLDER))
    assert full.select("project_id", "t", "opacity").exceptAll(state).isEmpty() and state.count() == full.count() > 0


def test_words_at_an_instant_are_computed_once(spark):
    state = timeline.text_state(A.text_layers(spark, FOLDER), A.instants(spark, FOLDER))
    assert state._jdf.queryExecution().optimizedPlan().toString().count("posexplode(") == 1


def test_clip_lookup_keeps_all_columns(spark):
    clips = landed(timeline.relayout(A.clips(spark, FOLDER)))
    found = timeline.active_clip(clips, A.instants(spark, FOLDER)).filter("clip IS NOT NULL")
    assert set(clips.columns) - {"project_id"} <= set(found.schema["clip"].dataType.names)
    one = found.select("project_id", F.col("clip.pos").alias("pos"), F.col("clip.grade").alias("grade")).distinct()
    assert one.join(clips.select("project_id", "pos", F.col("grade").alias("own")), ["project_id", "pos"]).filter("grade <> own").isEmpty()


def _orders_and_items(folder):
    """Orders of one to nine line items, one of forty, some values missing; as the adapters read them."""
    rng = random.Random(8)
    maybe = lambda v: None if rng.random() < 0.05 else v
    sizes = [rng.randint(1, 9) for _ in range(40)] + [40]
    items = [(o, maybe(rng.randint(0, 300)), maybe(rng.randint(0, 90)), maybe(n + 1), maybe(float(rng.randint(1, 50)))) for o, n_items in enumerate(sizes) for n in range(n_items)]
    kinds = {"l_orderkey": pa.int64(), "l_partkey": pa.int64(), "l_suppkey": pa.int64(), "l_linenumber": pa.int32(), "l_quantity": pa.float64()}
    pq.write_table(pa.table([pa.array(v, t) for v, t in zip(zip(*items), kinds.values())], names=list(kinds)), f"{folder}/lineitem.parquet")
    orders = [(o, rng.randint(0, 99), "O", 10.0, "5-LOW") for o in [*range(len(sizes)), *[3] * 5]]
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    pq.write_table(pa.table([list(c) for c in zip(*orders)], names=names), f"{folder}/orders.parquet")


def test_timeline_state_shuffles_each_table_once(spark, tmp_path, monkeypatch):
    _orders_and_items(tmp_path)
    folder, job = str(tmp_path), timelines.JOBS["timeline_state"]
    shown = lambda df: Counter(tuple(map(str, r)) for r in df.collect())
    state = job(spark, folder)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert sum("- Exchange " in line for line in plan.splitlines()) <= 6  # clips, instants for three readers, overlays, texts
    found = shown(state)
    every = lambda whole: timeline.timeline_state(timeline.relayout(A.clips(spark, folder, whole), whole=whole), A.overlays(spark, folder), A.text_layers(spark, folder), A.instants(spark, folder, whole), whole)
    assert shown(every(True)) == shown(every(False))
    monkeypatch.setattr(A, "SLICE_ROWS", 20)  # the project of forty clips and that of six texts go by slices
    monkeypatch.setattr(A, "FEW_INTERVALS", 4)
    assert sorted(r.project_id for r in A.crowded_timelines(spark, folder).collect()) == [3, 40]
    assert shown(job(spark, folder)) == found
