"""Order-dependent operators that stay parallel when one key holds much of the table.

A plain window over a key sorts all its rows in one task. Here the key is cut into ordered
buckets; a small table with one row per bucket carries what a bucket must know of the ones
before it, and the carried row joins the bucket as one more row, so no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pactlake.functions.versions import version_of

# An INT splits into at most 2^15 buckets of 2^16 version numbers: both windows are bounded.
BUCKET_BITS = 16


def _numbers(versions: DataFrame, unique: bool) -> DataFrame:
    numbers = versions.select("contract_id", "version_num").filter("version_num is not null")
    return numbers if unique else numbers.distinct()


def adjacent_pairs(versions: DataFrame, unique: bool = False) -> DataFrame:
    """Every version with the one just below it; input needs contract_id and version_num.

    `unique`: the input has one row per version (documents, shapes), so no distinct is needed.
    """
    numbered = _numbers(versions, unique).withColumn(
        "bucket", F.shiftright("version_num", BUCKET_BITS)
    )
    top = numbered.groupBy("contract_id", "bucket").agg(F.max("version_num").alias("top"))
    over_buckets = Window.partitionBy("contract_id").orderBy("bucket")
    carried = top.select(
        "contract_id",
        F.lag("top").over(over_buckets).alias("version_num"),
        "bucket",
        F.lit(True).alias("carried"),
    ).filter(F.col("version_num").isNotNull())
    in_bucket = Window.partitionBy("contract_id", "bucket").orderBy("version_num")
    return (
        numbered.withColumn("carried", F.lit(False))
        .unionByName(carried)
        .withColumn("base_num", F.lag("version_num").over(in_bucket))
        .filter(~F.col("carried") & F.col("base_num").isNotNull())
        .select(
            "contract_id",
            version_of(F.col("base_num")).alias("base_version"),
            version_of(F.col("version_num")).alias("candidate_version"),
        )
    )


# Documents are wide rows, so fewer of them share a task.
DOCUMENT_BUCKET_BITS = 12


def adjacent_documents(shapes: DataFrame) -> DataFrame:
    """Every version's document beside the one just below it: adjacent_pairs with both shapes, and
    `error` where one of them is unreadable.

    For a whole registry: the documents are shuffled once, where joining them to their pairs would
    shuffle them for each side. `shapes` has one row per version.
    """
    if "document_error" not in shapes.columns:
        shapes = shapes.withColumn("document_error", F.lit(None).cast("string"))
    keyed = (
        shapes.select("contract_id", "version_num", F.struct("shape", "document_error").alias("doc"))
        .filter("version_num is not null")
        .withColumn("bucket", F.shiftright("version_num", DOCUMENT_BUCKET_BITS))
    )
    # Numbers within the first bucket, as nearly all registries have them, leave nothing to carry; what
    # does is found by a look at the numbers alone, as carrying sorts and shuffles documents once more.
    rows = keyed.withColumn("carried", F.lit(False))
    if not shapes.filter(F.col("version_num") >= 1 << DOCUMENT_BUCKET_BITS).select("version_num").isEmpty():
        rows = rows.unionByName(_carried_documents(keyed).withColumn("carried", F.lit(True)))
    in_bucket = Window.partitionBy("contract_id", "bucket").orderBy("version_num")
    return (
        rows.withColumn("base_num", F.lag("version_num").over(in_bucket))
        .withColumn("base", F.lag("doc").over(in_bucket))
        .filter(~F.col("carried") & F.col("base_num").isNotNull())
        .select(
            "contract_id",
            version_of(F.col("base_num")).alias("base_version"),
            version_of(F.col("version_num")).alias("candidate_version"),
            F.col("base.shape").alias("base_shape"),
            F.col("doc.shape").alias("candidate_shape"),
            F.coalesce("base.document_error", "doc.document_error").alias("error"),
        )
    )


def _carried_documents(keyed: DataFrame) -> DataFrame:
    """The last document of each bucket, put into the contract's next one."""
    last = keyed.groupBy("contract_id", "bucket").agg(
        F.max_by(F.struct("version_num", "doc"), "version_num").alias("last")
    )
    over_buckets = Window.partitionBy("contract_id").orderBy("bucket")
    return (
        last.withColumn("last", F.lag("last").over(over_buckets))
        .filter(F.col("last").isNotNull())
        .select("contract_id", "last.version_num", "last.doc", "bucket")
    )


def latest_pairs(versions: DataFrame, unique: bool = False) -> DataFrame:
    """The last two versions of each contract that has two.

    Spark keeps only two rows per contract before the shuffle (window group limit).
    """
    newest = Window.partitionBy("contract_id").orderBy(F.desc("version_num"))
    last_two = (
        _numbers(versions, unique)
        .withColumn("place", F.row_number().over(newest))
        .filter(F.col("place") <= 2)
    )
    return (
        last_two.groupBy("contract_id")
        .agg(
            F.max(F.when(F.col("place") == 2, F.col("version_num"))).alias("base_num"),
            F.max(F.when(F.col("place") == 1, F.col("version_num"))).alias("candidate_num"),
        )
        .filter(F.col("base_num").isNotNull())
        .select(
            "contract_id",
            version_of(F.col("base_num")).alias("base_version"),
            version_of(F.col("candidate_num")).alias("candidate_version"),
        )
    )


def number_within(
    rows: DataFrame, key: str, bucket: Column, order: list[str], name: str
) -> DataFrame:
    """1, 2, 3, … per key in `order`; `bucket` must grow with that order and cut the key's rows.

    `order` must be unique within the key.
    """
    cut = rows.withColumn("bucket", bucket)
    sizes = cut.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(
        key, "bucket", F.sum("n").over(before).alias("step")
    ).filter(F.col("step").isNotNull())
    in_bucket = (
        Window.partitionBy(key, "bucket")
        .orderBy(F.desc("carried"), *order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cut.withColumn("step", F.lit(1).cast("long"))
        .withColumn("carried", F.lit(False))
        .unionByName(carried.withColumn("carried", F.lit(True)), allowMissingColumns=True)
        .withColumn(name, F.sum("step").over(in_bucket).cast("int"))
        .filter(~F.col("carried"))
        .drop("step", "carried", "bucket")
    )
