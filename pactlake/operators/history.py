"""Questions over the stored runs and logs."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from pactlake.functions.details import parse_details
from pactlake.functions.ids import run_slot
from pactlake.functions.text import execution_state

DEFAULT_LIMIT = 50
MAX_LIMIT = 200
RECENT = 20


@dataclass(frozen=True)
class RunQuery:
    """Normalised page request: blank filters mean none, status is upper-cased, ranges checked."""

    contract_id: str | None = None
    commit_sha: str | None = None
    status: str | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    @staticmethod
    def of(contract_id=None, commit_sha=None, status=None, limit=None, offset=None) -> RunQuery:
        status = _trim(status)
        if status is not None:
            status = status.upper()
            if not re.fullmatch("[A-Z_]+", status):
                raise ValueError("status must contain only letters and underscores.")
        limit = DEFAULT_LIMIT if limit is None else limit
        offset = 0 if offset is None else offset
        if not 1 <= limit <= MAX_LIMIT:
            raise ValueError(f"limit must be between 1 and {MAX_LIMIT}.")
        if offset < 0:
            raise ValueError("offset must be greater than or equal to 0.")
        return RunQuery(_trim(contract_id), _trim(commit_sha), status, limit, offset)


def _trim(text: str | None) -> str | None:
    return text.strip() or None if text is not None else None


def time_of(text: str = "created_at") -> Column:
    """Stored times are ISO text of mixed precision: compare them as times, never as text."""
    return F.col(text).try_cast("timestamp")


def newest_first() -> list[Column]:
    return [F.desc(time_of()), F.desc("run_id")]


def run_response(runs: DataFrame, *extra: str) -> DataFrame:
    """The run as shown to a caller: lists parsed, execution state added."""
    return runs.select(
        *extra,
        "run_id",
        "contract_id",
        "base_version",
        "candidate_version",
        "status",
        execution_state("status").alias("execution_state"),
        parse_details("breaking_changes").alias("breaking_changes"),
        parse_details("warnings").alias("warnings"),
        "commit_sha",
        "created_at",
        "triggered_by",
        "started_at",
        "finished_at",
    )


def _filtered(runs: DataFrame, query: RunQuery) -> DataFrame:
    if query.contract_id is not None:
        runs = runs.filter(F.col("contract_id") == query.contract_id)
    if query.commit_sha is not None:
        runs = runs.filter(F.col("commit_sha") == query.commit_sha)
    if query.status is not None:
        runs = runs.filter(F.upper("status") == query.status)
    return runs


def list_runs(runs: DataFrame, contract_id: str | None = None, commit_sha: str | None = None) -> DataFrame:
    """All matching runs, newest first (a range-partitioned sort)."""
    query = RunQuery.of(contract_id, commit_sha)
    return run_response(_filtered(runs, query).orderBy(*newest_first()))


def page_runs(runs: DataFrame, query: RunQuery) -> DataFrame:
    """One page with its position and `has_more`, decided by fetching one row more.

    Spark plans the sort with offset and limit as a top-k; the window sees at most 201 rows.
    """
    order = newest_first()
    fetched = _filtered(runs, query).orderBy(*order).offset(query.offset).limit(query.limit + 1)
    whole = Window.partitionBy(F.lit(1))
    numbered = fetched.withColumn(
        "position", F.row_number().over(whole.orderBy(*order))
    ).withColumn("has_more", F.count(F.lit(1)).over(whole) > query.limit)
    page = numbered.filter(F.col("position") <= query.limit)
    return run_response(page, "position", "has_more")


def recent_runs(runs: DataFrame, contract_id: str | None = None) -> DataFrame:
    return page_runs(runs, RunQuery.of(contract_id=contract_id, limit=RECENT))


def page_after(runs: DataFrame, query: RunQuery, created_at: str, run_id: str) -> DataFrame:
    """The page behind a run, by its time and id: however deep, each task keeps one page of rows,
    where an offset makes it keep all rows before the page as well."""
    time = F.lit(created_at).try_cast("timestamp")
    behind = (time_of() < time) | ((time_of() == time) & (F.col("run_id") < run_id))
    return page_runs(runs.filter(behind), replace(query, offset=0))


def _of_run(rows: DataFrame, run_id: str) -> DataFrame:
    """Rows of one run. A stored table has them in one of its folders."""
    if not run_id.strip():
        raise ValueError("runId must not be blank.")
    if "slot" in rows.columns:
        rows = rows.filter(F.col("slot") == run_slot(F.lit(run_id.strip()))).drop("slot")
    return rows.filter(F.col("run_id") == run_id.strip())


def find_run(runs: DataFrame, run_id: str) -> DataFrame:
    return run_response(_of_run(runs, run_id).limit(1))


def run_logs(logs: DataFrame, run_id: str) -> DataFrame:
    """Logs of one run, oldest first."""
    return _of_run(logs, run_id).orderBy(time_of(), "log_id")


def run_with_logs(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Every run joined to its logs, in run and time order.

    Runs are unique, so a run with very many logs is a skewed stream side that AQE splits.
    """
    return (
        runs.select("run_id", "contract_id", "status")
        .join(logs, "run_id")
        .orderBy("run_id", time_of(), "log_id")
    )


def oldest_queued(runs: DataFrame, limit: int = 3) -> DataFrame:
    return (
        runs.filter(F.col("status") == "QUEUED")
        .orderBy(time_of(), "run_id")
        .limit(limit)
        .select(
            "run_id",
            "contract_id",
            "base_version",
            "candidate_version",
            "compatibility_mode",
            "commit_sha",
            "triggered_by",
            "created_at",
        )
    )
