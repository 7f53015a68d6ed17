"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from postflow.catalog import QUERIES
from postflow.session import local_session

HEADLINE = {
    "term_routing": "j2_term_routing",
    "hard_filters": "f1_filter_chain",
    "similarity": "a11_best_profile",
    "suitability": "c2_suitability",
    "pii_scrub": "p43_pii_scrub",
    "corpus_page": "o2_page",
    "order_volume": "f10_order_volume",
    "retention": "f16_retention",
    "identity": "p2_stable_id",
    "page_schema": "p41_page_schema",
    "ledger_lookup": "j4_ledger_lookup",
    "routing_job": "c7_routing_job",
    "state_fold": "t8_state_fold",
    "budget_admission": "w10_budget_admission",
    "dashboard": "a3_dashboard_counters",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times = {}
    for name, key in HEADLINE.items():
        runs = []
        for _ in range(2):  # the second run is warm
            start = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
