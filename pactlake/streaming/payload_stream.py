"""Payload conformance on a stream, valid and invalid payloads routed apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pactlake.operators.nested import check_whole, compile_schemas
from pactlake.operators.payloads import contract_shapes, with_violations


def start_payload_check(
    payloads: DataFrame,
    docs: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    whole: bool = False,
) -> StreamingQuery:
    """Stateless: a join with the schemas and a projection, written to `path/batch=…/valid=…`.

    The join is planned inside each micro-batch, so the schema table's current size decides between
    broadcast and shuffle, and adaptive execution splits a contract that holds much of a batch. One
    pass routes both kinds: the `valid` partitions are the two outlets. Each micro-batch overwrites
    its own folder when replayed, so a restart never doubles rows. whole: against whole schemas, which are compiled
    once, when the stream starts.
    """
    shapes = contract_shapes(docs)
    compiled = compile_schemas(docs.sparkSession, docs) if whole else None

    def route(batch: DataFrame, batch_id: int) -> None:
        if whole:
            checked = check_whole(batch.sparkSession, batch, docs, compiled)
        else:
            checked = with_violations(batch, shapes)
        checked.write.mode("overwrite").partitionBy("valid").parquet(f"{path}/batch={batch_id}")

    return (
        payloads.writeStream.foreachBatch(route)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """What the stream has written so far; a filter on `valid` reads one outlet only."""
    return spark.read.parquet(path).withColumn("valid", F.col("valid").cast("boolean"))
