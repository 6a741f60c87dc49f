"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans.catalog import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "timeline_blocks", "two_sided_rows", "standings_before_block", "table_context", "season_to_date",
    "bounded_history", "rolling_form", "congestion", "head_to_head", "manager_tenure", "rating_fold",
    "feature_table", "round_assignment", "next_block", "squad_ratings", "rating_carry_forward",
    "tidy_spells", "gap_filled_spells", "spell_coverage", "goal_sums_by_cutoff", "score_reductions",
    "forecast_scores", "calibration_table", "block_page", "season_rollup", "forecast_of_record",
    "archive_grammar", "canonical_club_names", "emit_on_change", "state_as_of_many", "entity_tags",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": int(cores), "memory": os.environ.get("TIDEMARK_DRIVER_MEMORY", "12g"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
