"""Near-duplicate documents: SimHash of word shingles, linked by covering locality-sensitive hashing.

Every pair of fingerprints within the radius collides in at least one table (Pagh, 2016): bit i of a
fingerprint gets a vector m(i) of radius + 1 bits, and the table of a non-zero vector v compares the
bits with <m(i), v> = 1. The at most `radius` vectors of the differing bits leave some v orthogonal to
all of them, and that table compares none of those bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pactlake.llm.graph import components, tiles
from pactlake.llm.simhash import by_group, forest, majority, runs
from pactlake.llm.tables import row_key, text_key, written
from pactlake.llm.words import NOT_SPACE, joined, words_of

#: Fingerprints that meet in one task at a time, at most about twice this.
TILE = 1024


def shingle_fingerprints(texts: pa.Array, size: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text over its word shingles, as int64."""
    parts = []
    for w in words_of(texts, NOT_SPACE, lower=True):
        data, start, end = joined(w)
        counts = w.counts
        shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        first = np.concatenate([[0], np.cumsum(shingles)])
        row = np.repeat(np.arange(len(counts)), shingles)
        begin = w.first[:-1][row] + np.arange(first[-1]) - first[:-1][row]
        stop = np.minimum(begin + size, w.first[1:][row]) - 1
        digest = xxhash.xxh64_intdigest
        h = np.fromiter(
            (digest(data[a:b], seed) for a, b in zip(start[begin].tolist(), end[stop].tolist())),
            np.uint64,
            len(begin),
        )
        parts.append(majority(h, first))
    return np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, text_key, fingerprint) for every row."""

    def run(batches):
        for batch in batches:
            codes = shingle_fingerprints(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(codes)],
                ["doc_id", "text_key", "fingerprint"],
            )

    columns = docs.select(F.col("doc_id").cast("bigint"), text_key().alias("text_key"), "text")
    return columns.mapInArrow(run, "doc_id bigint, text_key bigint, fingerprint bigint")


def masks(radius: int, bits: int = 64, seed: int = 1) -> list[int]:
    """The covering masks: 2^(radius + 1) - 1 of them, each of about half the bits."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), bits)
    out = []
    for v in range(1, 1 << (radius + 1)):
        chosen = np.bitwise_count(vectors & v) & 1
        out.append(sum(1 << i for i in range(bits) if chosen[i]))
    return out


def links(codes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b) between distinct `fingerprint` values: not every link, but as many as connect what the
    links within `radius` bits connect. Each tile gives a spanning forest, so a group of near copies
    makes as many rows as it has fingerprints, not their pairs."""

    def run(batches):
        for table in by_group(batches, "tile"):
            tile = table.column("tile").to_numpy()
            # Unsigned, as NumPy counts the bits of absolute values.
            code = table.column("fingerprint").to_numpy().view(np.uint64)
            at = runs(tile)
            size = np.diff(at)
            two = at[:-1][size == 2]
            close = np.bitwise_count(code[two] ^ code[two + 1]) <= radius
            a, b = [code[two][close]], [code[two + 1][close]]
            for i in np.flatnonzero(size > 2):
                group = code[at[i] : at[i + 1]]
                label = forest(group, radius)
                moved = label != np.arange(len(group))
                a.append(group[moved])
                b.append(group[label[moved]])
            ends = [pa.array(np.concatenate(e).view(np.int64)) for e in (a, b)]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    def signed(mask: int) -> int:
        return mask - (1 << 64) if mask >> 63 else mask

    tables = [
        F.xxhash64(F.lit(t), F.col("fingerprint").bitwiseAND(F.lit(signed(mask)).cast("bigint")))
        for t, mask in enumerate(masks(radius))
    ]
    distinct = codes.select("fingerprint").distinct()
    members = distinct.select("fingerprint", F.explode(F.array(*tables)).alias("bucket"))
    tiled = tiles(members, "bucket", "fingerprint", TILE).select("tile", "fingerprint")
    return tiled.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a bigint, b bigint")


def grouped(spark: SparkSession, docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, text_key, fingerprint, first) for every row: first is (unnamed, doc_id, text_key) of the
    document that stands for the group, the smallest doc_id, null last.

    Documents: columns doc_id and text, others are not looked at. A null or empty text has no words
    and fingerprint 0, linked like any other. Rows with the same text have the same fingerprint.

    Groups are settled on distinct fingerprints and written, so that documents meet them in a plain join
    of two tables, of which adaptive execution can split a fingerprint that very many documents have.
    """
    codes = written(spark, "fingerprints", fingerprints(docs, size))
    roots = components(spark, links(codes, radius))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    distinct = codes.groupBy("fingerprint").agg(F.min(place).alias("first"))
    distinct = distinct.join(roots, F.col("fingerprint") == roots.node, "left")
    distinct = distinct.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "first")
    groups = distinct.groupBy("root").agg(F.min("first").alias("first"))
    groups = distinct.drop("first").join(groups, "root").drop("root")
    return codes.join(written(spark, "groups", groups), "fingerprint")


def near_groups(spark: SparkSession, docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the
    group, null ids left aside). Empty input gives no rows; a null doc_id belongs to its group all the same."""
    return grouped(spark, docs, size, radius).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )


def one_of_each(spark: SparkSession, docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """The documents, all their columns, of which one row of each group stays: the smallest doc_id."""
    kept = grouped(spark, docs, size, radius).select("first").distinct()
    kept = kept.select(F.struct("first.doc_id", "first.text_key").alias("at"))
    # The document's own columns travel in a struct, so that none of them clashes with these.
    stay = docs.select(row_key().alias("at"), F.struct("*").alias("row")).join(kept, "at", "left_semi")
    # A row listed more than once stays once.
    once = Window.partitionBy("at").orderBy(F.lit(0))
    return stay.withColumn("nth", F.row_number().over(once)).where("nth = 1").select("row.*")
