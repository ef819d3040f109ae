"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A chat that is logged after every turn leaves snapshots that are prefixes of the last one. A rolling
hash of each turn prefix (an XOR over hashes of position, role and text, in two times 64 bits) finds
them: a conversation goes if its whole hash is the prefix hash of a longer one. Of equal conversations
the smallest conv_id stays. The rest is rendered.

A conversation is worked on in parts of `PART` turns, with one carried row for each part, so neither a
window nor a rendered row holds more of a very long one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pactlake.llm.tables import written

PART = 1024


def _turns(conversations: DataFrame, size: int) -> DataFrame:
    """Distinct turns with the hashes of what they say, and the part they stand in."""
    said = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text",
        F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit(1), *said).alias("h2"),
    )
    # Turns without a number come first, in parts by their hash.
    unnumbered = F.lit(-(1 << 62)) + F.shiftright("h1", 52).cast("bigint")
    part = F.when(F.col("turn").isNull(), unnumbered).otherwise(F.floor(F.col("turn") / size).cast("bigint"))
    return turns.withColumn("part", part)


def prefixes(conversations: DataFrame, size: int = PART) -> DataFrame:
    """(conv_id, part, at, n, p1, p2): for each distinct turn its place from 1, the number of turns of its
    conversation, and the hash of the conversation up to it."""
    turns = _turns(conversations, size).select("conv_id", "part", "turn", "h1", "h2").distinct()
    order = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "h1", "h2")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    counts = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("here"))
    counts = counts.select(
        F.struct("conv_id", "part").alias("key"),
        F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"),
        F.sum("here").over(whole).alias("n"),
    )
    placed = turns.withColumn("nth", F.row_number().over(order)).withColumn("key", F.struct("conv_id", "part"))
    placed = placed.join(counts, "key").withColumn("at", F.col("offset") + F.col("nth"))
    mark = lambda seed: F.xxhash64(F.lit(seed), "at", "h1", "h2")
    placed = placed.select("key", "conv_id", "part", "at", "n", mark(1).alias("e1"), mark(2).alias("e2"))
    sums = placed.groupBy("conv_id", "part").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    carried = sums.select(
        F.struct("conv_id", "part").alias("key"),
        *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(c) for x, c in (("x1", "c1"), ("x2", "c2"))],
    )
    rolling = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(carried, "key").select(
        "conv_id",
        "part",
        "at",
        "n",
        F.bit_xor("e1").over(rolling).bitwiseXOR(F.col("c1")).alias("p1"),
        F.bit_xor("e2").over(rolling).bitwiseXOR(F.col("c2")).alias("p2"),
    )


def maximal(spark: SparkSession, conversations: DataFrame, size: int = PART) -> DataFrame:
    """(conv_id, part, nth, n): the parts, numbered from 0, of the conversations that stay."""
    rows = written(spark, "prefixes", prefixes(conversations, size))
    whole = rows.where("at = n").groupBy("n", "p1", "p2").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("unnamed"), "conv_id")).alias("first")
    )
    shorter = rows.where("at < n").select(F.col("at").alias("n"), "p1", "p2").distinct()
    kept = whole.join(shorter, ["n", "p1", "p2"], "left_anti").select(F.struct("first.conv_id").alias("conv"), "n")
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("part")) - 1
    parts = rows.select("conv_id", "part").distinct().withColumn("nth", nth.cast("bigint"))
    parts = parts.withColumn("conv", F.struct("conv_id")).join(kept, "conv").drop("conv")
    return written(spark, "kept", parts)


def render(role: Column, text: Column) -> Column:
    """One turn. A marker inside a text is broken up, so that markers are only the template's."""
    inside = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), inside(role), F.lit("|>\n"), inside(text), F.lit("<|end|>\n"))


def formatted(spark: SparkSession, conversations: DataFrame, size: int = PART) -> DataFrame:
    """(conv_id, part, n_turns, text): the rendered conversations that stay, in parts of `size` turn
    numbers; most have one part, number 0.

    Turns are ordered by turn, those without a number first, and of one number by a hash of what they
    say; a turn logged twice counts once. A null role or text is rendered empty, and differs from an
    empty one. A null conv_id is a conversation like any other. Other columns are not looked at.
    """
    kept = maximal(spark, conversations, size).withColumn("key", F.struct("conv_id", "part")).drop("conv_id", "part", "n")
    turns = _turns(conversations, size).withColumn("key", F.struct("conv_id", "part"))
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"), "turn", "h1", "h2",
        render(F.col("role"), F.col("text")).alias("text"),
    )
    texts = turns.join(kept, "key").groupBy("conv_id", "nth", "part").agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    return texts.select(
        "conv_id",
        F.col("nth").alias("part"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"),
    )
