"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR  folder of the tables      (default /root/testdata/sf0.1)
BENCH_CPUS    cores of the local master (default: all)
BENCH_ALL     1 = every registered query instead of the headline ones
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from surety.plans.registry import QUERIES  # noqa: E402
from surety.session import configure  # noqa: E402

HEADLINE = [
    "decisions", "credit_profile", "entity_trust", "liability_rollup", "decision_audit", "decision_sources",
    "trust_snapshot", "audit_trail", "source_lineage", "drift", "three_outcomes", "late_apply",
    "semantic_query", "semantic_by_feed", "metric_batch", "metric_grading", "feed_trust", "unified_signals",
    "content_dups", "key_collisions", "orphans", "kpis",
]


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE
    spark = (
        configure(SparkSession.builder.appName("bench"), cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "decisions", folder)  # start-up, class loading and code generation are not part of any query
    took = {name: round(min(run(spark, name, folder) for _ in range(2)), 3) for name in names}
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
