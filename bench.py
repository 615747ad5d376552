"""Time every registered query; print one JSON line.

BENCH_SF_DIR names the data folder and BENCH_CPUS the local cores. Each headline
query is built and run into the ``noop`` sink (all rows, all columns computed)
BENCH_REPEAT times; the best run counts, the first is kept as "cold". With BENCH_ALL=1 every query is timed, else the headline ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

from courtline import catalog
from courtline.session import local_session

HEADLINE = [
    "schedule_flags", "player_load", "season_z_scores", "betting_metrics", "closing_line_value",
    "rolling_win_rate", "cumulative_roi", "equity_curve", "max_drawdown", "kelly_grid",
    "walk_forward_folds", "game_bets", "walk_forward_equity", "signals", "play_descriptions",
    "document_text_rules", "shot_clock", "derived_stints", "lineups_at_plays", "token_sequences",
    "plus_minus_ratings", "lambda_scores", "lineup_spacing", "shot_density", "gravity_overlap",
    "previous_form", "context_features", "injury_adjustment", "two_scenario_adjustment",
    "feature_drift", "version_lineage", "game_validation", "finder_games", "closing_lines",
]


def timed(spark, run, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    entries = catalog.entries()
    names = list(entries) if os.environ.get("BENCH_ALL") == "1" else HEADLINE
    best, cold = {}, {}
    for name in names:
        runs = [timed(spark, entries[name].run, sf_dir)]
        while len(runs) < repeat:
            runs.append(timed(spark, entries[name].run, sf_dir))
        spark.catalog.clearCache()
        best[name], cold[name] = round(min(runs), 3), round(runs[0], 3)
        print(f"{name}: {best[name]} (cold {cold[name]})", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
