"""Upkeep of a stored history in place: only the slots that hold changed runs are written again.

Runs lie in folders by a hash of their id (`slot`, at most RUN_SLOTS of them), so what a batch touches is
known as a few numbers, by which Spark prunes the read, and whose folders alone it exchanges.

What a batch does is decided and written before the table is touched; putting it there only assigns values.
So a job that was lost between two folders is mended by running its last step again. Nothing else may write
to the table meanwhile.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pactlake.functions.ids import run_slot
from pactlake.operators.upkeep import after_steps, backfill_logs, backfill_runs, stored_updates, transition_steps
from pactlake.sinks.history import RUN_COLUMNS, overwrite_slots, write_run_logs


def touched_slots(run_ids: DataFrame) -> list[int]:
    """The slots of rows with a run_id, ascending."""
    found = run_ids.filter("run_id is not null").select(run_slot(F.col("run_id")).alias("slot"))
    return sorted(row.slot for row in found.distinct().collect())


def _stored(spark: SparkSession, path: str, slots: list[int]) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("slot").isin(slots))


def _rewrite(
    spark: SparkSession, path: str, slots: list[int], change: Callable[[DataFrame], DataFrame]
) -> list[int]:
    if slots:
        overwrite_slots(change(_stored(spark, path, slots).select(*RUN_COLUMNS)), path)
    return slots


def decide_transitions(
    spark: SparkSession, runs_path: str, updates: DataFrame, decisions_path: str
) -> DataFrame:
    """transition_steps of a batch against the stored runs, written and read back. Only ids and statuses of
    the touched slots are read. It may be done again until put_transitions has begun."""
    updates = stored_updates(updates)
    runs = _stored(spark, runs_path, touched_slots(updates)).select("run_id", "status")
    transition_steps(runs, updates, stored=True).write.mode("overwrite").parquet(decisions_path)
    return spark.read.parquet(decisions_path)


def put_transitions(spark: SparkSession, runs_path: str, decisions: DataFrame) -> list[int]:
    """Bring the decided updates into the stored runs; returns the slots that were written. It may be done
    any number of times."""
    slots = touched_slots(decisions.filter("applied"))
    return _rewrite(spark, runs_path, slots, lambda runs: after_steps(runs, decisions))


def backfill(
    spark: SparkSession, runs_path: str, logs_path: str, contracts: DataFrame, now: str
) -> list[int]:
    """Fill the legacy runs of a stored history and give the silent ones their log row; returns the slots of
    runs that were written. It may be done again: what is filled or logged is not legacy any more."""
    runs = spark.read.parquet(runs_path).select(*RUN_COLUMNS)
    # Logs first, as a filled run no longer says that it was legacy.
    write_run_logs(backfill_logs(runs, spark.read.parquet(logs_path), now), logs_path)
    slots = touched_slots(backfill_runs(runs, contracts, now).filter("changed"))
    return _rewrite(spark, runs_path, slots, lambda old: backfill_runs(old, contracts, now))
