"""Near copies by Jaccard similarity: SimHash of word shingles, covering masks part by part, exact check.

At a Jaccard similarity of 0.8 a bit of two SimHashes differs with a probability of up to 0.152, so a pair
is some ten bits of 64 apart, and covering masks for that radius would be thousands. So a fingerprint is
cut into parts, and each part has the covering masks of a small radius: with p parts and radius r, every
pair that differs in at most p * (r + 1) - 1 bits collides, as one of its parts differs in at most r. Of
the pairs beyond, most collide too, since masks often miss more bits than they must.

What collides and is close enough by its whole fingerprint is a candidate. A tile of a bucket gives the
minimum spanning forest of its candidates by distance rather than their pairs, and some more such forests
of what may yet turn out to be too unlike; their edges are checked by the exact Jaccard similarity of the
texts, and what passes links.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pactlake.llm.graph import components, tiles
from pactlake.llm.near_documents import masks
from pactlake.llm.simhash import by_group, majority, runs
from pactlake.llm.tables import row_key, text_key, written
from pactlake.llm.words import NOT_SPACE, Words, grams, hashes, mixed, words_of
from pactlake.session import never_broadcast

SIZE = 5
SIMILARITY = 0.8
#: Bits that two fingerprints may differ in within a part, sure to collide.
RADIUS = 3
#: Fingerprints that meet in one task at a time, at most about twice this.
TILE = 1024
#: Spanning forests of the candidates of a tile.
FORESTS = 4
#: Pairs compared, and edges checked, at a time.
_PAIRS, _EDGES = 1 << 22, 128
#: Bits of a row's place among the rows of a task's share, which are fewer than its pairs.
_PLACE = 26
_PLACES = (1 << _PLACE) - 1


def layout(n: int) -> tuple[int, int, int]:
    """(bits of a part, parts, 64-bit words of a fingerprint) for n documents.

    A table's key is about half a part, 16 bits or more, so that a bucket of unlike documents stays at some
    500; wider parts differ more often, so there are more of them: 4 of 32 bits up to 33 million documents,
    13 of 48 bits for 8 billion.
    """
    key = max(16, math.ceil(math.log2(max(n, 1) / 512)))
    bits = min(2 * key, 64)
    parts = math.ceil(4 * 2 ** ((key - 16) / 5))
    return bits, parts, -(-parts // (64 // bits))


def distances(bits: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """Bits of `bits` within which a pair is surely of that similarity, and beyond which it surely is not:
    the mean at that similarity less 2.5 and plus 3 deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    deviation = math.sqrt(bits * p * (1 - p))
    return math.floor(bits * p - 2.5 * deviation), math.floor(bits * p + 3 * deviation)


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each row, ascending, and where each row's begin, with the
    total appended. A row of fewer words, but not none, is one shingle."""
    h, counts, row = hashes(w), w.counts, w.row_of()
    whole = grams(h, size)
    at = np.flatnonzero(np.arange(len(whole)) + size <= w.last_of()[: len(whole)])
    rows, values = [row[at]], [whole[at]]
    for c in range(1, size):
        short = np.flatnonzero(counts == c)
        rows.append(short)
        values.append(grams(h, c)[w.first[short]] if len(short) else np.zeros(0, np.uint64))
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(rows[new], np.arange(len(counts) + 1))


def fingerprints(docs: DataFrame, words: int, size: int = SIZE) -> DataFrame:
    """(doc_id, text_key, w0, w1, ...) for every row: a SimHash of 64 bits in each of the w."""

    def run(batches):
        for batch in batches:
            parts = [np.zeros((words, 0), np.uint64)]
            for w in words_of(batch.column("text"), NOT_SPACE, lower=True):
                h, first = shingle_sets(w, size)
                salted = (mixed(h + np.uint64(salt)) for salt in range(1, words + 1))
                parts.append(np.stack([majority(s, first) for s in salted]))
            code = np.concatenate(parts, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), *map(pa.array, code)],
                ["doc_id", "text_key", *(f"w{i}" for i in range(words))],
            )

    columns = docs.select(F.col("doc_id").cast("bigint"), text_key().alias("text_key"), "text")
    schema = "doc_id bigint, text_key bigint" + "".join(f", w{i} bigint" for i in range(words))
    return columns.mapInArrow(run, schema)


def spanning(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the pairs make a minimum spanning forest, the trees then). Pairs (a, b) come by ascending
    distance; label: the tree of each node at the start, by its first node. In each round every tree
    takes its nearest pair, the first of equals."""
    n, keep, live = len(label), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return np.flatnonzero(keep), label
        nearest = np.full(n, len(a))
        np.minimum.at(nearest, label[a[live]], live)
        np.minimum.at(nearest, label[b[live]], live)
        taken = np.unique(nearest[nearest < len(a)])
        keep[taken] = True
        x, y, root = label[a[taken]], label[b[taken]], np.arange(n)
        while (root[x] != root[y]).any():
            low = np.minimum(root[x], root[y])
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            root = root[root]
        while (root != root[root]).any():
            root = root[root]
        label = root[label]


def _close(tile: np.ndarray, code: np.ndarray, sure: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) by place: the spanning forests of all tiles, which are sorted; code: a column a row. The
    forests after the first leave together what is surely near."""
    at = runs(tile)
    end = np.repeat(at[1:], np.diff(at))
    keys = []
    row, step = np.arange(len(tile)), 1
    while len(row):
        row = row[row + step < end[row]]
        apart = np.bitwise_count(code[:, row] ^ code[:, row + step]).sum(axis=0, dtype=np.int32)
        near = apart <= limit
        x = row[near]
        keys.append(apart[near].astype(np.int64) << 2 * _PLACE | x << _PLACE | x + step)
        step += 1
    # Distance, a and b as one number sort far faster than as three columns.
    key = np.sort(np.concatenate(keys))
    a, b, d = key >> _PLACE & _PLACES, key & _PLACES, key >> 2 * _PLACE
    apart = np.arange(len(tile))
    forest, _ = spanning(a, b, apart)
    surely = d <= sure
    _, together = spanning(a[surely], b[surely], apart)
    rest = np.setdiff1d(np.flatnonzero(~surely), forest, assume_unique=True)
    out = [forest]
    for _ in range(FORESTS - 1):
        more, _ = spanning(a[rest], b[rest], together)
        out.append(rest[more])
        rest = np.delete(rest, more)
    out = np.concatenate(out)
    return a[out], b[out]


def candidates(codes: DataFrame, bits: int, parts: int, words: int, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): pairs of distinct nodes that may be near, as few as span what is near in each tile.

    codes: node and w0, w1, ... of distinct fingerprints."""
    names = [f"w{i}" for i in range(words)]
    sure, limit = distances(64 * words, similarity)

    def run(batches):
        for table in by_group(batches, "tile"):
            tile = table.column("tile").to_numpy()
            node = table.column("node").to_numpy()
            # Unsigned, as NumPy counts the bits of absolute values.
            code = np.stack([table.column(c).to_numpy() for c in names]).view(np.uint64)
            at = runs(tile)
            # Whole tiles, some millions of pairs at a time.
            share = np.cumsum(np.diff(at) ** 2) // _PAIRS
            for cut in np.split(np.arange(len(at) - 1), np.flatnonzero(np.diff(share)) + 1):
                low, high = at[cut[0]], at[cut[-1] + 1]
                a, b = _close(tile[low:high], code[:, low:high], sure, limit)
                yield pa.RecordBatch.from_arrays([node[low:high][a], node[low:high][b]], ["a", "b"])

    def signed(mask: int) -> int:
        return mask - (1 << 64) if mask >> 63 else mask

    in_word = 64 // bits
    tables = [
        F.xxhash64(
            F.lit(part), F.lit(t), F.col(names[part // in_word]).bitwiseAND(F.lit(signed(mask << bits * (part % in_word))))
        )
        for part in range(parts)
        for t, mask in enumerate(masks(RADIUS, bits, seed=part + 1))
    ]
    members = codes.select("node", *names, F.explode(F.array(*tables)).alias("bucket"))
    tiled = tiles(members, "bucket", "node", TILE).select("tile", "node", *names)
    # Sorted by node too, so that tables with the same members choose the same pairs.
    tiled = tiled.repartition("tile").sortWithinPartitions("tile", "node")
    return tiled.mapInArrow(run, "a bigint, b bigint").where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def jaccard(left: pa.Array, right: pa.Array, size: int = SIZE) -> np.ndarray:
    """Of each pair of texts, the similarity of their sets of shingles; 1 for two without words."""

    def sets(texts):
        for w in words_of(texts, NOT_SPACE, lower=True):
            h, first = shingle_sets(w, size)
            yield from (h[i:j] for i, j in zip(first[:-1], first[1:]))

    out = []
    for x, y in zip(sets(left), sets(right)):
        both = len(np.intersect1d(x, y, assume_unique=True))
        either = len(x) + len(y) - both
        out.append(both / either if either else 1.0)
    return np.array(out, float)


def links(pairs: DataFrame, texts: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) are at least that similar."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _EDGES):
                part = batch.slice(at, _EDGES)
                near = jaccard(part.column("left"), part.column("right"), size) >= similarity
                yield part.select(["a", "b"]).filter(pa.array(near))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    both = pairs.join(never_broadcast(left), "a").join(never_broadcast(right), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def grouped(spark: SparkSession, docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, first) for every row: first is (unnamed, doc_id, text_key) of the document that
    stands for the group, the smallest doc_id, null last.

    Documents: columns doc_id and text, others are not looked at. Null and empty texts have no shingles and
    are one group. Texts with the same shingles, whatever their case and spacing, are one; of others two
    link at the given Jaccard similarity of their shingles, and groups are what links connect. Nodes are
    named by a 64-bit hash of their fingerprint.
    """
    bits, parts, words = layout(docs.count())
    names = [f"w{i}" for i in range(words)]
    codes = fingerprints(docs, words, size)
    codes = written(spark, "copies", codes.withColumn("node", F.xxhash64(*names)))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    nodes = codes.groupBy("node", *names).agg(F.min(place).alias("first"))
    nodes = written(spark, "nodes", nodes)
    pairs = written(spark, "pairs", candidates(nodes, bits, parts, words, similarity))
    met = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    met = nodes.join(never_broadcast(met), "node", "left_semi")
    met = met.select("node", F.struct("first.doc_id", "first.text_key").alias("at"))
    texts = docs.select(row_key().alias("at"), "text").join(never_broadcast(met), "at")
    texts = texts.dropDuplicates(["node"]).select("node", "text")
    texts = written(spark, "texts", texts)
    roots = components(spark, links(pairs, texts, size, similarity))
    named = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    groups = named.groupBy("root").agg(F.min("first").alias("first"))
    groups = written(spark, "groups", named.drop("first").join(groups, "root").drop("root"))
    return codes.select("doc_id", "text_key", "node").join(never_broadcast(groups), "node").drop("node")


def one_of_each(spark: SparkSession, docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all their columns, of which one row of each group stays: the smallest doc_id, null
    only where no other is."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = grouped(spark, docs, size, similarity).select("first").distinct()
    kept = kept.select(F.struct("first.doc_id", "first.text_key").alias("at"))
    rows = docs.select(row_key().alias("at"), F.struct(*columns).alias("row")).join(kept, "at", "left_semi")
    # A row listed more than once stays once.
    once = rows.withColumn("nth", F.row_number().over(Window.partitionBy("at").orderBy(F.lit(0)))).where("nth = 1")
    return once.select("row.*")
