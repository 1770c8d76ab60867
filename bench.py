"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm up and then three times (slow ones once) into Spark's no-op sink; the median counts. ``rows_per_sec``
relates it to the samples the query reads, the measure that compares with the published 41 million samples/s."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from framewise.plans.registry import queries
from framewise.session import local_session

HEADLINE = {
    "D1_stack_average": "lineitem", "D3_stack_median": "lineitem", "D4_stack_sigma": "lineitem", "D5_stack_sigma_mad": "lineitem",
    "D6_stack_winsorized": "lineitem", "D7_stack_percentile": "lineitem", "D8_stack_max": "lineitem",
    "C1_calibrate": "embeddings", "D13_build_master": "embeddings", "B11_compose_channels": "embeddings", "B6_generalized_stretch": "embeddings",
    "C20_resample_affine": "embeddings", "D39_drizzle": "embeddings", "D42_feather_mosaic": "embeddings", "D41_cell_average": "embeddings",
    "D34_synthetic_flux": "embeddings", "C9_cone_search": "customer", "C7_match_nearest": "embeddings", "D44_split_leakage": "documents",
}
#: Slow queries, timed once after one warm-up.
SLOW = {"C16_recurrent_trails": "events", "D33_reference_color_gains": "embeddings", "D46_detect_stars": "embeddings", "I3_live_robust": "lineitem"}
#: Samples per row of the table a query reads.
SAMPLES = {"embeddings": 64}
#: Share of the samples that a query works on, where its fixture takes some of the frames (lights: seven of ten and the
#: three master frames; the flat: two of ten).
SHARE = {"C1_calibrate": 1.0, "D13_build_master": 0.2}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": cpus})
    run = queries()
    counts = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() * SAMPLES.get(t, 1) for t in {*HEADLINE.values(), *SLOW.values()}}
    seconds, rates = {}, {}
    for name, source in (HEADLINE | SLOW).items():
        times = []
        for attempt in range(2 if name in SLOW else 4):
            start = time.perf_counter()
            run[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        rates[name] = round(counts[source] * SHARE.get(name, 1.0) / seconds[name])
        print(f"{name}: {seconds[name]} s, {rates[name]} samples/s", file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "samples_per_sec": rates, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
