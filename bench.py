"""Headline queries, timed. Prints one JSON line.

Each query runs whole tables at $BENCH_SF_DIR on local[$BENCH_CPUS] and is
timed from plan building to the last row; a small first query warms the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import QUERIES
from touchline.session import local_session

HEADLINE = [
    "normalize_season", "score_components", "trailing_feature", "walk_forward_baselines", "event_model", "model_comparison",
    "spearman_within_position", "calibration", "component_decomposition", "elo_ratings", "team_difficulty", "changed_rows",
    "as_of_join", "compute_deltas", "price_model", "free_transfers", "squad_state", "best_lineup", "best_single_swap",
    "build_train", "evaluate_squads",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["latest_state"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 2)
    total = round(sum(seconds.values()), 2)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
