"""Written intermediates: they cut lineage, and a lost executor loses nothing of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pactlake.session import shared_folder


def written(spark: SparkSession, purpose: str, rows: DataFrame) -> DataFrame:
    path = shared_folder(spark, purpose)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def text_key(text: str | Column = "text") -> Column:
    """With doc_id this names a row by its content; rows alike in both are one document listed
    more than once."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def row_key(doc_id: str = "doc_id", key: str | Column | None = None) -> Column:
    """The name of a row as one value; inside a struct, null equals null."""
    return F.struct(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        (text_key() if key is None else F.col(key)).alias("text_key"),
    )
