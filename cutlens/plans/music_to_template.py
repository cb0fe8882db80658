"""From music to a planned edit template."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cutlens.operators import music
from cutlens.session import cut_lineage


def plan_templates(energy: DataFrame, beats: DataFrame, tracks: DataFrame, per_second: float = 4.0,
                   options: music.PlanOptions = music.PlanOptions()) -> tuple[DataFrame, DataFrame]:
    """Sections and scenes of every track.

    ``energy(track_id, i, rms)``, ``beats(track_id, t, is_downbeat)``, ``tracks(track_id,
    track_seconds)``.
    """
    sections = cut_lineage(music.music_sections(energy, tracks, per_second))
    cuts = cut_lineage(music.plan_cuts(beats, sections, tracks, options))
    return sections, music.plan_music_template(cuts, sections, options)
