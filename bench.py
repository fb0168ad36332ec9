"""Times the headline queries and prints one JSON line.

Every query runs once unmeasured on the smallest tables and is then timed over whole
results at ``BENCH_SF_DIR``.  The model fits run at ``BENCH_MODELS_DIR``, by default the
smallest tables; an empty value leaves them out.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

import registry
from pitchframe.session import local_session

HEADLINE = [
    "goal_histogram",
    "points_gap_season",
    "home_away_ppg",
    "outcome_shares",
    "ppg_ranking",
    "standings_before_match",
    "team_rows",
    "rolling_venue_5",
    "rolling_all_10",
    "rolling_points_win",
    "match_dataset",
    "match_dataset_complete",
    "scaled_features",
    "elo_enriched",
    "chrono_split",
    "walk_forward_rows",
    "class_weights",
    "majority_baseline_report",
]
MODELS = ["walk_forward_lr", "walk_forward_rf", "feature_importance_top10", "holdout_gbt"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    warm_up = Path(sf_dir).parent / "sf0.001"
    models_dir = os.environ.get("BENCH_MODELS_DIR", str(warm_up))

    def run(name: str, tables: str) -> float:
        started = time.perf_counter()
        registry.PLAIN[name](spark, tables).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    if warm_up.exists():
        for name in HEADLINE:
            run(name, str(warm_up))
    seconds = {name: run(name, sf_dir) for name in HEADLINE}
    if models_dir and Path(models_dir).exists():
        scale = Path(models_dir).name
        seconds |= {f"{name}@{scale}": run(name, models_dir) for name in MODELS}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
