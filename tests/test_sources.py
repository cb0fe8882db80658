"""Documents and files on disk."""

import pytest
from pyspark.sql import functions as F

from cutlens.functions import labels
from cutlens.operators import shots
from cutlens.sources import catalog, templates


def test_documents_survive_the_disk_and_newer_ones_are_refused(spark, tmp_path):
    seeds = templates.seed_templates(spark)
    assert seeds.count() == 10 and {r.id: r.scene_count for r in seeds.collect()}["fast-reel"] == 12
    templates.write_templates(seeds.select("id", "title", "tags", "canvas", "duration", "isBuiltIn"), str(tmp_path / "t"))
    good, bad = templates.read_templates(spark, str(tmp_path / "t"))
    assert good.count() == 10 and bad.count() == 0
    (tmp_path / "t" / "part-new.txt").write_text('{"schemaVersion":2,"id":"x"}\nnot json\n{"schemaVersion":1,"id":"later","unknown":3}\n')
    good, bad = templates.read_templates(spark, str(tmp_path / "t"))
    assert good.count() == 11 and bad.count() == 2
    assert abs({r.id: r.duration for r in good.collect()}["travel"] - 10.6) < 1e-9


def test_starter_scenes_are_contiguous(spark):
    rows = templates.starter_scenes(spark).orderBy("template_id", "scene_idx").collect()
    for a, b in zip(rows, rows[1:]):
        if a.template_id == b.template_id:
            assert abs(a.end - b.start) < 1e-9
    assert all((r.transition is None) == (r.scene_idx == 0) for r in rows)


def test_media_files_and_broken_projects(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.mov").write_bytes(b"x" * 2_000_000)
    media = catalog.read_media(spark, str(tmp_path / "m"))
    row = media.select("length", F.octet_length("head").alias("head")).first()
    assert row.length == 2_000_000 and row.head == catalog.HEAD_BYTES
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.json").write_text('{"project_id": 1, "title": "a"}\n{broken\n{"project_id": 2, "title": "b"}\n')
    got = catalog.read_projects(spark, str(tmp_path / "p"), "project_id bigint, title string").collect()
    assert sorted(r.project_id for r in got) == [1, 2]


def test_time_range_reaches_the_scan_and_columns_are_pruned(spark, tmp_path):
    path = str(tmp_path / "frames")
    spark.range(100).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_idx"), (F.col("id") / 30).alias("t"), F.lit(0.1).alias("content_value"), F.lit("wide").alias("unused")).write.parquet(path)
    kept = shots.sample_frames(spark.read.parquet(path), 8, 0.5, 2.0).select("frame_idx")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t,0.5)" in plan and "unused" not in plan
    assert [r.frame_idx for r in kept.orderBy("frame_idx").collect()] == [16, 24, 32, 40, 48, 56]


@pytest.mark.parametrize("name,staged", [("picked-0123456789abcdef0123456789abcdef.mov", True), ("picked-short.mov", False), ("holiday.mp4", False)])
def test_staged_names(spark, name, staged):
    assert spark.range(1).select(labels.is_staged_name(F.lit(name)).alias("s")).first().s is staged
