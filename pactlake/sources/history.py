"""Sources of the history: runs, logs, audit rows, from parquet or a database over JDBC.

Stored runs and logs have one column more, `slot`, by which look-ups of a run read one folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pactlake.schemas import AUDIT_LOGS, CHECK_RUN_LOGS, CHECK_RUNS


def read_table(spark: SparkSession, source: str | dict, schema: str) -> DataFrame:
    """`source`: a parquet path, or JDBC options (url, dbtable, and for a parallel read
    `predicates`: a list of WHERE conditions, one partition each)."""
    wanted = T.StructType.fromDDL(schema)
    if isinstance(source, str):
        return spark.read.schema(wanted).parquet(source)
    options = dict(source)
    predicates = options.pop("predicates", None)
    url, table = options.pop("url"), options.pop("dbtable")
    found = spark.read.jdbc(url, table, predicates=predicates, properties=options)
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])


def read_check_runs(spark: SparkSession, source: str | dict) -> DataFrame:
    return read_table(spark, source, CHECK_RUNS)


def read_check_run_logs(spark: SparkSession, source: str | dict) -> DataFrame:
    return read_table(spark, source, CHECK_RUN_LOGS)


def read_audit_logs(spark: SparkSession, source: str | dict) -> DataFrame:
    return read_table(spark, source, AUDIT_LOGS)
