"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the caller of every column expression triples the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A JSON key given twice is legal and the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session that is already running the settings the operators rely on."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def never_broadcast(rows: DataFrame) -> DataFrame:
    """Rows for a join that must not go through the driver. Spark judges a written table by its files,
    and documents or texts that repeat take a hundredth of their size there."""
    return rows.hint("merge")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that every executor can reach: under the cluster's checkpoint directory, or
    under the warehouse where that setting is absent."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
