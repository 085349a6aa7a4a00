"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through Spark's ``noop`` sink (the whole plan
executes, nothing is collected to the driver).  A warm-up run of the
flagship job precedes the timed runs so JVM and Python worker start-up is
not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans.catalog import QUERIES  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = [
    "overlay_job",
    "overlay_intersection",
    "spatial_join_intersects",
    "overlay_touching_kept",
    "overlay_lshapes",
    "overlay_rotated",
    "shapefile_overlay_job",
    "repair_invalid",
    "dedup_keep_first",
    "geohash5",
    "geoparquet_roundtrip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tessera-bench")
    QUERIES["overlay_intersection"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
