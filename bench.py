"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from almucantar.plans import registry
from almucantar.session import get_spark

HEADLINE = ["clim_sums", "clim_blend", "area_finest", "area_percentiles", "nearest_in_window", "build_profile", "sun_events", "horizon_argmax", "kriging", "path_profiles", "envelope_minmax", "guard_counts", "clim_fields_at", "horizon_crests", "sky_correction", "areas_containing"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    known, took = registry.queries(), {}
    registry.entry(spark, sf_dir).count()  # starts the JVM's compilers
    for name in HEADLINE:
        began = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
