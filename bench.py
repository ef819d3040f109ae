"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the parquet tables (default sf0.1). BENCH_CPUS: local cores.
Fixtures are derived from the given tables and written once, before the queries are timed; their time
is reported apart. Every query runs over its whole tables and writes all result rows to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pactlake.session import configure, shared_folder  # noqa: E402
from proving import fixtures  # noqa: E402
from proving.queries import QUERIES  # noqa: E402

HEADLINE = (
    "schema_fields",
    "adjacent_pairs",
    "schema_diff",
    "compat_backward",
    "compat_full",
    "compat_by_contract_policy",
    "lint_violations",
    "contract_catalog",
    "runs_list",
    "runs_page",
    "run_with_logs",
    "impact_analysis",
    "contract_badge",
    "metrics_failures",
    "log_attempts",
    "backfill_runs",
    "apply_transitions",
    "changed_gate",
    "request_outcomes",
    "register_versions",
    "payload_conformance",
    "payload_keywords",
    "compat_errors",
    "incremental_refresh",
)
# In the order in which one is derived from another.
FIXTURES = (
    "numbered_orders",
    "evolving_fields",
    "churning_fields",
    "faulty_docs",
    "contracts",
    "faulty_contracts",
    "check_runs",
    "check_run_logs",
    "audit_logs",
    "payloads",
    "keyword_payloads",
    "event_docs",
    "single_requests",
    "check_requests",
    "changed_files",
)


def derive(spark: SparkSession, sf: str, name: str) -> None:
    """Write a fixture, and let the queries read what was written."""
    path = shared_folder(spark, f"bench-{name}")
    getattr(fixtures, name)(spark, sf).write.parquet(path)
    setattr(fixtures, name, lambda spark, sf: spark.read.parquet(path))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Session start-up is no part of any query.
    spark.range(1_000_000).selectExpr("sum(id % 7)").collect()
    started = time.perf_counter()
    for name in FIXTURES:
        derive(spark, sf, name)
    derived = round(time.perf_counter() - started, 3)
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "derivation": derived,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
