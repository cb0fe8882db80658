"""The registered queries next to their SQL, at the smallest scale."""

import pytest

import queries
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
# one per operator family; ``python -m tests.compare`` runs them all
SAMPLE = ["detect_shots", "compose_motion", "compile_text_slots", "estimate_tempo", "plan_music_template", "pair_cost", "relayout", "clip_state", "mix_plan",
          "edit_quality", "scene_durations", "retime_to_beats", "live_edits", "caption_layers", "fill_window", "word_reveal", "read_templates", "stream_energy"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    rows, problem = compare(spark, con, FOLDER, queries.queries()[name], queries.oracle_sql()[name])
    assert problem is None and rows > 0


def test_every_sql_has_its_query():
    assert set(queries.oracle_sql()) <= set(queries.queries())
