"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then ``BENCH_REPEATS`` times; the median counts.
``BENCH_QUERIES`` names other queries, or "all".
Results go to a no-op sink, so every row is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from voltfleet.plans import catalog
from voltfleet.session import build_session

#: Long jobs, timed once.
SLOW = {"forecast_gbt", "forecast_rf", "forecast_linreg", "train_eval", "forecast_24h", "stream_validate", "stream_dedupe"}

HEADLINE = """
status_snapshot latest_per_asset recent_series history_by_asset dedupe_keep_first insert_ignore align_master lake_align
nearest_weather override_asof fk_semi pivot_targets campus_totals savings_summary regression_metrics typed_decode
range_validate acceptance flatline impute_recursive topic_to_rows topic_fanout lake_roundtrip lag_features fill_chain
ewma soc_replay cycle_count feature_vectors dispatch_cost dispatch_schedule stream_latest stream_dedupe stream_validate
forecast_linreg forecast_gbt
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    wanted = os.environ.get("BENCH_QUERIES")
    names = list(catalog.QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for attempt in range(1 if name in SLOW else repeats + 1):
            begin = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt or name in SLOW:
                runs.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over the timed queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
