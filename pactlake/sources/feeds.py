"""Payloads and check requests, as batches or as streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactlake.schemas import CHECK_REQUESTS, PAYLOADS


def read_payloads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(PAYLOADS).format(fmt).load(path)


def stream_payloads(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(PAYLOADS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt)
        .load(path)
    )


def read_check_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(CHECK_REQUESTS).format(fmt).load(path)


def stream_check_requests(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 1000
) -> DataFrame:
    return (
        spark.readStream.schema(CHECK_REQUESTS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt)
        .load(path)
    )
