"""Counters, latencies and latest runs, maintained while runs come in.

A run is a few measures: its counters, its latency, its failure, and itself as the latest of its contract and of its
version. What a micro-batch adds to each key is written as a folder of its own, which a replay overwrites, and every so
many batches the values of all keys as a snapshot: the last one and the batches after it. Values merge in any order, so
that is all the state there is; none is held in memory, and a batch costs what it brings. A reader takes the last
snapshot and the few batches after it, never the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pactlake.functions.details import parse_details
from pactlake.functions.text import blank_to, tag_value
from pactlake.operators.history import time_of
from pactlake.operators.insights import EXECUTION_ERROR, is_finished

KEYS = ["contract_id", "measure", "tag"]
VALUES = "n bigint, total_ms bigint, max_ms bigint, latest struct<run_id:string,status:string,breaking_changes:string,warnings:string>, at timestamp"
METRICS = f"contract_id string, measure string, tag string, {VALUES}"


def measures(runs: DataFrame) -> DataFrame:
    """(contract_id, measure, tag, ms, at, run) of each measure of a run; a pure projection."""
    nothing = F.lit(None)
    took = F.unix_millis(time_of("finished_at")) - F.unix_millis(time_of("started_at"))
    outcome = F.upper(blank_to("status", F.lit("unknown")))
    broke = F.coalesce(F.get(parse_details("warnings"), F.lit(0)).startswith(EXECUTION_ERROR), F.lit(False))
    counted = tag_value("contract_id")
    run = F.struct("run_id", "status", "breaking_changes", "warnings")

    def one(contract, measure, tag, ms=nothing, of=None):
        return F.struct(
            contract.alias("contract_id"),
            F.lit(measure).alias("measure"),
            tag.cast("string").alias("tag"),
            ms.cast("bigint").alias("ms"),
            (nothing.cast("struct<run_id:string,status:string,breaking_changes:string,warnings:string>") if of is None else of).alias("run"),
        )

    every = [
        one(counted, "queued", nothing),
        F.when(is_finished(), one(counted, "completed", outcome)),
        F.when(is_finished() & took.isNotNull(), one(counted, "latency", nothing, took)),
        F.when(F.upper("status") == "FAIL", one(counted, "failed", F.when(broke, "execution_error").otherwise("compatibility_breaking"))),
        one(F.col("contract_id"), "latest", nothing, of=run),
        one(F.col("contract_id"), "latest_of_version", F.col("candidate_version"), of=run),
    ]
    # Spark compiles a projection but interprets what stands inside an explode, so that takes a column at hand.
    rows = runs.select(F.array(*every).alias("every"), time_of().alias("at"), F.col("run_id").alias("by"))
    rows = rows.select(F.explode_outer("every").alias("m"), "at", "by")
    return rows.where("m is not null").select("m.*", "at", "by")


def totals(rows: DataFrame) -> DataFrame:
    """Measures by key; the latest run is the newest, ties by run id."""
    return _parts(rows).drop("at")


def _parts(rows: DataFrame) -> DataFrame:
    """Totals with the time of the latest run, by which parts can be put together."""
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("ms").alias("total_ms"),
        F.max("ms").alias("max_ms"),
        F.max_by("run", F.struct("at", "by")).alias("latest"),
        F.max("at").alias("at"),
    )


def _together(parts: DataFrame) -> DataFrame:
    """The totals of what the parts are of. Each part has a row for a key, so a key has few, and rows that
    lie together are sorted once."""
    return parts.repartition(*KEYS).groupBy(*KEYS).agg(
        F.sum("n").alias("n"),
        F.sum("total_ms").alias("total_ms"),
        F.max("max_ms").alias("max_ms"),
        F.max_by("latest", F.struct("at", F.col("latest.run_id"))).alias("latest"),
        F.max("at").alias("at"),
    )


def start_metrics(
    spark: SparkSession, runs: DataFrame, path: str, checkpoint: str, every: int = 16, trigger: dict | None = None
) -> StreamingQuery:
    """runs: a stream in which each run comes once, when it has its outcome. A snapshot is written after `every`
    batches; with it a reader's work is bounded by the keys and the changes of so many batches."""
    none = spark.createDataFrame([], METRICS).coalesce(1)
    for kind in ("snapshots", "changes"):
        none.write.mode("overwrite").parquet(f"{path}/{kind}/batch=-1")

    def keep(batch: DataFrame, batch_id: int) -> None:
        _parts(measures(batch)).write.mode("overwrite").parquet(f"{path}/changes/batch={batch_id}")
        if batch_id % every == every - 1:
            now = read_metrics(batch.sparkSession, path, batch_id, True)
            now.write.mode("overwrite").parquet(f"{path}/snapshots/batch={batch_id}")

    return (
        runs.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_metrics(spark: SparkSession, path: str, upto: int | None = None, timed: bool = False) -> DataFrame:
    """The current value of every key: the last snapshot before batch `upto`, and the changes since, up to it.
    timed: with the time of the latest run, as a snapshot holds it."""
    rows = {k: spark.read.schema(f"{METRICS}, batch int").parquet(f"{path}/{k}") for k in ("snapshots", "changes")}
    if upto is not None:
        rows = {"snapshots": rows["snapshots"].where(F.col("batch") < upto), "changes": rows["changes"].where(F.col("batch") <= upto)}
    last = rows["snapshots"].agg(F.max("batch")).first()[0]
    last = -1 if last is None else last
    both = rows["snapshots"].where(F.col("batch") == last).union(rows["changes"].where(F.col("batch") > last))
    now = _together(both.drop("batch"))
    return now if timed else now.drop("at")
