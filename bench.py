"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1) and ``BENCH_CPUS`` the local cores. Each query
is planned and run in full once, after a short warm-up of the JVM; its rows go to a no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from peerband.session import build_session
from suite.catalog import QUERIES

HEADLINE = (
    "detrended_seasonality",
    "calendar_cube_priced",
    "calendar_cube_unpriced",
    "listing_booked_rate",
    "listing_text_parsed",
    "curated_listings",
    "nearest_point_distance",
    "occupancy_agreement",
    "model_features",
    "full_regression",
    "regression_predictions",
    "peer_group_statistics",
    "peer_positions",
    "price_ranges",
    "request_advice",
    "market_build_manifest",
    "winsorized_price_histogram",
    "seasonal_context",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["category_counts"](spark, sf_dir).collect()
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
