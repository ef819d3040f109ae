"""Rows to append to the history, and the append itself.

Ids are computed from the rows and the batch, and the time is one value per batch: a task that is
run again after a lost executor writes the same rows, and logs always name the run that was stored.

Fixed values: the codes and message texts of the log rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pactlake.functions.details import details_json, input_hash
from pactlake.functions.ids import run_slot, stable_id
from pactlake.functions.text import blank_to_null, dash_if_blank, is_blank, roles_text
from pactlake.operators.insights import EXECUTION_ERROR
from pactlake.schemas import CHECK_RUNS

RUN_COLUMNS = [part.split()[0] for part in CHECK_RUNS.split(", ")]


def recorded_runs(
    results: DataFrame,
    batch_id: str,
    recorded_at: str,
    commit_sha: str | None = None,
    triggered_by: str = "cli",
    blank_mode: str = "BACKWARD",
) -> DataFrame:
    """check_results → finished runs: created, started and finished at the same moment."""
    sha, by, at = F.lit(commit_sha).cast("string"), F.lit(triggered_by), F.lit(recorded_at)
    mode = F.coalesce("mode", F.lit(blank_mode))
    hashed = input_hash(
        "contract_id", "base_version", "candidate_version", mode, sha, by, blank_mode=blank_mode
    )
    # A check without a verdict is a failed run that says why.
    failed = F.col("status") == "ERROR"
    why = F.array(F.concat(F.lit(EXECUTION_ERROR), "error"))
    notes = F.when(failed, why).otherwise(F.col("warnings"))
    return results.select(
        stable_id(
            F.lit(batch_id),
            *[F.col(c) for c in ("contract_id", "base_version", "candidate_version", "mode", "pack")],
        ).alias("run_id"),
        "contract_id",
        "base_version",
        "candidate_version",
        F.when(failed, "FAIL").otherwise(F.col("status")).alias("status"),
        details_json("breaking_changes").alias("breaking_changes"),
        details_json(notes).alias("warnings"),
        sha.alias("commit_sha"),
        at.alias("created_at"),
        by.alias("triggered_by"),
        mode.alias("compatibility_mode"),
        hashed.alias("input_hash"),
        at.alias("started_at"),
        at.alias("finished_at"),
    )


def queued_runs(valid_requests: DataFrame, queued_at: str) -> DataFrame:
    """Valid requests → QUEUED runs; the run id follows from the request id."""
    nothing = F.lit(None).cast("string")
    return valid_requests.select(
        run_id_of_request().alias("run_id"),
        "contract_id",
        "base_version",
        "candidate_version",
        F.lit("QUEUED").alias("status"),
        F.lit("[]").alias("breaking_changes"),
        F.lit("[]").alias("warnings"),
        "commit_sha",
        F.lit(queued_at).alias("created_at"),
        "triggered_by",
        F.col("mode").alias("compatibility_mode"),
        request_hash().alias("input_hash"),
        nothing.alias("started_at"),
        nothing.alias("finished_at"),
    )


def request_hash() -> Column:
    return input_hash(
        "contract_id", "base_version", "candidate_version", "mode", "commit_sha", "triggered_by"
    )


def run_id_of_request() -> Column:
    return stable_id(F.col("request_id"), request_hash())


def recorded_run_logs(runs: DataFrame) -> DataFrame:
    """One log row per recorded run."""
    message = F.concat(F.lit("Check run recorded by CLI with status "), "status", F.lit("."))
    return runs.select(
        stable_id(F.col("run_id"), F.lit("recorded")).alias("log_id"),
        "run_id",
        F.lit("INFO").alias("level"),
        message.alias("message"),
        "created_at",
    )


def lifecycle_logs(outcomes: DataFrame, at: str, max_retries: int = 2) -> DataFrame:
    """The log rows a run leaves behind: claims, failed attempts, requeues, and the end.

    outcomes: run_id, status, execution_error (null when the check itself ran).
    """

    def entry(level: str, message: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), message.alias("message"))

    claimed = entry("INFO", F.lit("code=check_run_claimed message=Check run claimed for execution."))
    completed = entry(
        "INFO",
        F.concat(
            F.lit("code=check_run_completed status="),
            "status",
            F.lit(" message=Check run completed."),
        ),
    )
    failing = []
    for attempt in range(1, max_retries + 2):
        failing.append(claimed)
        failing.append(
            entry(
                "ERROR",
                F.concat(
                    F.lit(f"code=check_run_attempt_failed attempt={attempt} message="),
                    "execution_error",
                ),
            )
        )
        if attempt <= max_retries:
            failing.append(
                entry(
                    "WARN",
                    F.lit(
                        f"code=check_run_requeued attempt={attempt} maxRetries={max_retries} "
                        "message=Run re-queued for retry."
                    ),
                )
            )
    failing.append(
        entry("ERROR", F.lit("code=check_run_failed message=Run failed after retries."))
    )
    steps = F.when(F.col("execution_error").isNull(), F.array(claimed, completed)).otherwise(
        F.array(*failing)
    )
    return outcomes.select("run_id", F.posexplode(steps).alias("step", "entry")).select(
        stable_id(F.col("run_id"), F.col("step")).alias("log_id"),
        "run_id",
        (F.col("step") + 1).alias("step"),
        "entry.level",
        "entry.message",
        F.lit(at).alias("created_at"),
    )


def _audit_detail(fields: list[Column], error: str) -> Column:
    """JSON detail with its null members kept; `error` appears only when there is one."""
    keep_nulls = {"ignoreNullFields": "false"}
    with_error = F.to_json(F.struct(*fields, F.col(error).alias("error")), keep_nulls)
    return F.when(is_blank(error), F.to_json(F.struct(*fields), keep_nulls)).otherwise(with_error)


def request_audit_detail(error: str = "error") -> Column:
    """Detail of a check request's audit row."""
    fields = [
        F.col("contract_id").alias("contractId"),
        F.col("base_version").alias("baseVersion"),
        F.col("candidate_version").alias("candidateVersion"),
        F.col("mode"),
        F.col("commit_sha").alias("commitSha"),
        F.col("triggered_by").alias("triggeredBy"),
    ]
    return _audit_detail(fields, error)


def contract_audit_detail(error: str = "error") -> Column:
    """Detail of a contract registration's audit row."""
    fields = [
        F.col("contract_id").alias("contractId"),
        F.col("owner_team").alias("ownerTeam"),
        F.col("domain"),
        F.col("compatibility_mode").alias("compatibilityMode"),
        F.col("policy_pack").alias("policyPack"),
        F.col("initial_version").alias("initialVersion"),
    ]
    return _audit_detail(fields, error)


def version_audit_detail(error: str = "error") -> Column:
    """Detail of a version registration's audit row; accepted ones name the created version."""
    fields = [F.col("contract_id").alias("contractId"), F.col("version")]
    created = [*fields, F.col("version").alias("createdVersion")]
    keep_nulls = {"ignoreNullFields": "false"}
    return F.when(is_blank(error), F.to_json(F.struct(*created), keep_nulls)).otherwise(
        _audit_detail(fields, error)
    )


def audit_rows(
    df: DataFrame,
    action: str,
    resource_type: str,
    at: str,
    *,
    key: Column,
    resource_id: Column,
    status: Column,
    detail: Column,
    actor: Column | None = None,
    roles: Column | None = None,
    source: Column | None = None,
    request_id: Column | None = None,
    http_method: Column | None = None,
    path: Column | None = None,
) -> DataFrame:
    """Audit rows: blanks become `-`, except request and resource ids, which become null.

    `key` names the audited event within `df`; with action and time it makes the audit id.
    """
    nothing = F.lit(None).cast("string")

    def given(column: Column | None) -> Column:
        return nothing if column is None else column

    values = {
        "action": F.lit(action),
        "actor": F.coalesce(blank_to_null(given(actor)), F.lit("anonymous")),
        "actor_roles": F.lit("-") if roles is None else roles_text(roles),
        "source": dash_if_blank(given(source)),
        "request_id": blank_to_null(given(request_id)),
        "http_method": dash_if_blank(given(http_method)),
        "path": dash_if_blank(given(path)),
        "resource_type": F.lit(resource_type),
        "resource_id": blank_to_null(resource_id),
        "status": status,
        "detail": detail,
        "created_at": F.lit(at),
    }
    audit_id = stable_id(F.lit(action), F.lit(at), key)
    return df.select(
        audit_id.alias("audit_id"), *[value.alias(name) for name, value in values.items()]
    )


def _in_slots(rows: DataFrame) -> DataFrame:
    """Rows dealt by run_slot. Adaptive execution splits a large slot over several tasks, and gives several
    small ones to one."""
    return rows.withColumn("slot", run_slot(F.col("run_id"))).hint("rebalance", F.col("slot"))


def append(
    rows: DataFrame, path: str, sort_by: list[str] | None = None, by_run: bool = False
) -> None:
    """Append to a parquet table; sorting inside each file keeps min/max pruning useful.

    by_run: in folders by run_slot.
    """
    if by_run:
        rows = _in_slots(rows)
    if sort_by:
        rows = rows.sortWithinPartitions(*(["slot"] if by_run else []), *sort_by)
    writer = rows.write.mode("append")
    (writer.partitionBy("slot") if by_run else writer).parquet(path)


RUN_ORDER = ["contract_id", "created_at"]


def write_check_runs(runs: DataFrame, path: str) -> None:
    append(runs.select(*RUN_COLUMNS), path, RUN_ORDER, by_run=True)


def overwrite_slots(runs: DataFrame, path: str) -> None:
    """Put whole slots of runs in place of the stored ones; the files of other slots stay as they are.

    Spark writes the new files beside the table and exchanges folders once all of them are complete, so
    the runs may come from the same table, and a lost executor leaves it untouched.
    """
    rows = _in_slots(runs.select(*RUN_COLUMNS)).sortWithinPartitions("slot", *RUN_ORDER)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("slot").parquet(path)


def write_run_logs(logs: DataFrame, path: str) -> None:
    append(
        logs.select("log_id", "run_id", "level", "message", "created_at"),
        path,
        ["run_id", "created_at"],
        by_run=True,
    )


def write_audit_rows(rows: DataFrame, path: str) -> None:
    append(rows, path, ["created_at"])


def write_snapshot(rows: DataFrame, path: str) -> None:
    """A rewritten table (backfill, transitions) goes to a new path, never over the one it is read
    from; readers are pointed to it once it is complete."""
    rows.write.mode("errorifexists").parquet(path)
