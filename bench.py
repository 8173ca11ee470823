"""Headline-query benchmark: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

All headline queries run once on sf0.001 to warm the JVM; then each query is
run once more on the bench tables to warm up, then ``BENCH_REPEAT`` times (default 3);
the median wall time of the full call (plan build + execution + collect) is
reported. ``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "q1_score": "score",
    "q2_shortlist": "shortlist",
    "q3_league_map": "league_map",
    "q6_compare": "diff_keyed",
    "q6_positional": "diff_positional",
    "q7_concept_index": "concept_index",
    "q7_spearman": "spearman",
    "q8_validation": "validation",
    "q10_rank_zip": "rank_zip",
    "w2_global_percentile": "global_percentile",
}


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    from cohortrank.catalog import QUERIES
    from cohortrank.session import get_spark
    spark = get_spark(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    # JVM warm-up (class loading, JIT, codegen cache) on the smallest tables, so the
    # first timed query does not pay for it
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE.values():
            QUERIES[name](spark, warm_dir).collect()
    times = {}
    for label, name in HEADLINE.items():
        q = QUERIES[name]
        q(spark, sf_dir).collect()  # warm-up
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            q(spark, sf_dir).collect()
            runs.append(time.perf_counter() - t0)
        times[label] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
