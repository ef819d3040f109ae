"""Buckets cut into tiles of bounded size, and connected components, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pactlake.llm.tables import written
from pactlake.session import never_broadcast


def tiles(members: DataFrame, bucket: str, node: str, size: int) -> DataFrame:
    """Members with a `tile` such that any two of one bucket meet in at least one tile.

    A bucket of up to `size` members is one tile. A larger one is dealt by hash into blocks of about
    that size, and each pair of blocks is a tile, so no task gets a whole large bucket. Members that
    are alone in their bucket are left out: they meet nobody.
    """
    counts = members.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # Members come from an explode, which Spark takes for no larger than its input.
    return dealt(members.join(never_broadcast(counts), bucket), bucket, node, size)


def dealt(met: DataFrame, bucket: str, node: str, size: int) -> DataFrame:
    """The tiles of members that have the size of their bucket as `_n`."""
    blocks = F.ceil(F.col("_n") / size).cast("int")
    met = met.withColumn("_blocks", blocks).withColumn(
        "_own", F.pmod(F.xxhash64(F.col(node), F.lit("block")), F.col("_blocks")).cast("int")
    )
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    tile = F.xxhash64(bucket, F.least("_own", "_other"), F.greatest("_own", "_other"))
    return met.withColumn("tile", tile).drop("_n", "_blocks", "_own", "_other")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), bigint: root is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each step is a grouped minimum,
    which is pre-aggregated, and a join that is unique on one side; each round is written to the shared
    folder. Ends when a round changes nothing, after about log n rounds.
    """
    low, high = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    stars = written(spark, "edges", edges.where("a <> b").select(high, low).distinct())
    mark = _mark(stars)
    while mark[0]:
        both = stars.selectExpr("hi as u", "lo as v").union(stars.selectExpr("lo as u", "hi as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # Written, so that the join below is of two plain tables: adaptive execution can then split a node
        # with very many neighbours.
        least = written(spark, "least", least.select("u", F.least("u", "m").alias("m")))
        # Large star: larger neighbours go to the smallest of the neighbourhood.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.distinct()
        # Small star: smaller neighbours and the node itself go to the smallest.
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        stars = written(spark, "stars", moved.union(small.select("hi", F.col("m").alias("lo"))).distinct())
        after = _mark(stars)
        if after == mark:
            break
        mark = after
    roots = stars.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
    return roots.union(stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _mark(stars: DataFrame) -> tuple[int, int]:
    """Count and checksum of the edges."""
    row = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return row[0], row[1] or 0
