"""Wall time of the headline queries: one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_RUNS``
(default 1; with more, the first run of each query is discarded and the median of the rest counts).
A short warm-up job runs before anything is timed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cutlens.session import local_session  # noqa: E402
from queries import queries  # noqa: E402

HEADLINE = [
    "detect_shots", "similarity_fit", "subject_region", "palette_stats", "onset_envelope", "estimate_tempo", "energy_curve", "plan_cuts",
    "rank_assets_for_slot", "relayout", "active_at", "clip_state", "mix_plan", "edit_quality", "scene_durations", "coalesce_edits", "project_catalog", "nearest_join",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, "cutlens-bench")
    spark.sparkContext.setLogLevel("ERROR")
    jobs, seconds = queries(), {}
    for name in ("project_catalog", "waveform"):
        jobs[name](spark, folder).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            jobs[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
