"""A batch of check requests: validate, resolve, check, and what to store for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pactlake.functions.details import details_json, no_strings
from pactlake.operators.compat import with_verdict
from pactlake.operators.diff import with_changes
from pactlake.operators.insights import EXECUTION_ERROR
from pactlake.operators.policy import PolicyPacks
from pactlake.operators.requests import WORK, resolve_requests, validate_requests
from pactlake.session import never_broadcast
from pactlake.sinks.history import request_hash, run_id_of_request


def request_outcomes(
    requests: DataFrame,
    contracts: DataFrame,
    shapes: DataFrame,
    packs: PolicyPacks,
) -> DataFrame:
    """One row per request with its verdict.

    shapes: schema_shapes of the registry, whose unreadable documents give an execution error.
    status: PASS or FAIL for accepted requests, REJECTED (with `error`) for invalid ones. A request id
    that comes more than once is answered once, by its first row in the order of its values. Equal
    requests are checked once: the work is reduced to distinct items first, so a contract that
    gets a third of all requests costs one check per distinct pair.
    """
    first = F.min(F.struct(*[c for c in requests.columns if c != "request_id"])).alias("r")
    once = requests.groupBy("request_id").agg(first).select("request_id", "r.*").select(*requests.columns)
    checked = validate_requests(once)
    valid = checked.filter("error is null")
    # What is looked up brings its document, so the registry is met once a side.
    resolved = resolve_requests(valid, contracts, shapes, packs)
    changes = with_changes(resolved.withColumn("error", F.col("execution_error")))
    judged = with_verdict(changes, packs).select(
        *WORK,
        "pack",
        "execution_error",
        F.when(F.col("execution_error").isNotNull(), "FAIL")
        .otherwise(F.col("status"))
        .alias("status"),
        "breaking_changes",
        F.when(
            F.col("execution_error").isNotNull(),
            F.array(F.concat(F.lit(EXECUTION_ERROR), "execution_error")),
        )
        .otherwise(F.col("warnings"))
        .alias("warnings"),
    )
    # Invalid requests keep null work columns on the right side only; they stay as they came in.
    keys = checked.join(never_broadcast(judged), WORK, "left")
    rejected = F.col("error").isNotNull()
    return keys.select(
        F.when(~rejected, run_id_of_request()).alias("run_id"),
        *requests.columns,
        F.when(~rejected, request_hash()).alias("input_hash"),
        F.when(~rejected, F.col("pack")).alias("pack"),
        F.when(rejected, "REJECTED").otherwise(F.col("status")).alias("status"),
        F.when(rejected, no_strings()).otherwise(F.col("breaking_changes")).alias(
            "breaking_changes"
        ),
        F.when(rejected, no_strings()).otherwise(F.col("warnings")).alias("warnings"),
        F.when(~rejected, F.col("execution_error")).alias("execution_error"),
        "error",
    )


def finished_runs(outcomes: DataFrame, at: str) -> DataFrame:
    """Accepted requests as stored runs."""
    return outcomes.filter("error is null").select(
        "run_id",
        "contract_id",
        "base_version",
        "candidate_version",
        "status",
        details_json("breaking_changes").alias("breaking_changes"),
        details_json("warnings").alias("warnings"),
        "commit_sha",
        F.lit(at).alias("created_at"),
        "triggered_by",
        F.col("mode").alias("compatibility_mode"),
        "input_hash",
        F.lit(at).alias("started_at"),
        F.lit(at).alias("finished_at"),
    )
