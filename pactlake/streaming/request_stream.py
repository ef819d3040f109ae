"""Continuous processing of check requests."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from pactlake.operators.policy import PolicyPacks
from pactlake.plans.request_batch import finished_runs, request_outcomes
from pactlake.sinks.history import RUN_COLUMNS, lifecycle_logs


def new_requests(requests: DataFrame) -> DataFrame:
    """Of the requests of a stream those whose id comes for the first time, one row each: the first in the order of its
    values. An aggregate by id in update mode, whose state remembers every id; an id that comes again in a later batch
    shows two times of arrival. That of a batch is in the checkpoint, so a replay gives the same rows."""
    rest = [c for c in requests.columns if c != "request_id"]
    seen = requests.withColumn("arrived", F.current_timestamp()).groupBy("request_id").agg(
        F.min(F.struct(*rest)).alias("first"), F.min("arrived").alias("since"), F.max("arrived").alias("last")
    )
    return seen.where("since = last").select("request_id", "first.*").select(*requests.columns)


def start_request_checks(
    requests: DataFrame,
    contracts: DataFrame,
    shapes: DataFrame,
    packs: PolicyPacks,
    runs_path: str,
    logs_path: str,
    rejected_path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Each micro-batch is judged once and stored as runs, logs and rejections.

    Exactly once: the checkpoint replays a batch under the same number, which overwrites the same
    folders, and run ids follow from the requests. Outcomes are written first and then read back
    for runs and logs, so the check itself runs once per batch. Which ids have been answered is
    state of the stream, kept by id, so a batch reads as much in its first hour as after years.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        at = datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        staged = f"{runs_path.rstrip('/')}-outcomes/batch={batch_id}"
        request_outcomes(batch, contracts, shapes, packs).write.mode("overwrite").parquet(staged)
        outcomes = spark.read.parquet(staged)
        runs = finished_runs(outcomes, at).select(*RUN_COLUMNS)
        runs.write.mode("overwrite").parquet(f"{runs_path}/batch={batch_id}")
        accepted = outcomes.filter("error is null")
        lifecycle_logs(accepted, at).write.mode("overwrite").parquet(f"{logs_path}/batch={batch_id}")
        outcomes.filter("error is not null").write.mode("overwrite").parquet(
            f"{rejected_path}/batch={batch_id}"
        )

    return (
        new_requests(requests)
        .writeStream.foreachBatch(process)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
